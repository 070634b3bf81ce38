"""The registered queries of this package: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import ann, centroids, decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, url_filter, vector_codes
from textloom.session import table as documents

#: (verdict, rule) of the op9 query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    return decontaminate.digest(decontaminate.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingles and a Jaccard similarity of 0.75 or more."""
    profile, _, classes = ngram_join.join(documents(spark, sf_dir))
    return ngram_join.labelled(profile, classes)


def _held(parts: int, rest: int) -> F.Column:
    return F.coalesce(language_id.fold("doc_id", parts) == rest, F.lit(False)).alias("held_out")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from three of four folds of ids."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(language_id.fold("doc_id", 4) != 2))
    return language_id.predict(docs, model).select("doc_id", _held(4, 2), "lang_pred", "score", "rejected")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.digest(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; learned from nine of ten folds of ids."""
    held = _held(10, 0)
    scored = lm_score.score(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = license_scan.scan(documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select("doc_id", "n_lines", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0)).alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from the labels of two of three folds of ids."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(language_id.fold("doc_id", 3) != 1))
    return quality.predict(docs, model).select("doc_id", _held(3, 1), "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every twentieth."""
    return ann.nearest(documents(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address."""
    return url_filter.judge(documents(spark, sf_dir, "pages"), URL_RULES)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat, exactly or within two edits, an earlier line."""
    return line_dedup.digest(documents(spark, sf_dir), short=True)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of all with its text, that of the largest id."""
    return exact_dedup.digest(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts of 256 entries each, after four rounds."""
    return vector_codes.digest(documents(spark, sf_dir, "embeddings")).drop("distances")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components, after ten rounds."""
    return centroids.digest(documents(spark, sf_dir, "embeddings")).drop("distances")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_ngram_join, op3_language_id, op4_mix_sources, op5_lm_score, op6_license_scan, op7_quality, op8_nearest, op9_url_filter, op10_line_dedup, op11_exact_dedup, op12_vector_codes, op13_centroids)}
