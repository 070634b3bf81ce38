"""A corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. In all of them null texts, and texts
without words, are kept unless the classifier rejects them as it does empty ones; rows whose id is null
stay apart from each other; an empty table gives an empty one; other columns come through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, quality
from textloom.llm._spark import scratch, written
from textloom.session import table as documents


def _counted(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The cut documents with n_chars, where they have it, of the texts that are left; null texts keep theirs."""
    if "n_chars" not in docs.columns:
        return cut
    kind = dict(docs.dtypes)["n_chars"]
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (7); it learns from the folds of ids that op7 learns from.

    Each row is scored by its text alone; null texts count as empty. Without labels nothing goes.
    """
    labels = documents(spark, sf_dir, "labels").where(language_id.fold("doc_id", 3) != 1)
    return quality.keep(docs, quality.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat an earlier one (10); a document that had words and has none left goes.

    Earlier is: of a smaller id (null ids before all), then of a row read before, then further up. So of repeated rows the first keeps its lines.
    """
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    blank = docs.withColumn("__blank", empty(F.col("text")))
    cut = line_dedup.dedup(blank, short=True).where(F.col("__blank") | ~empty(F.col("text"))).drop("__blank")
    return _counted(docs, cut)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies (2).

    Rows that share an id are judged each by its text; rows whose id is null, and texts without words, stay.
    """
    return ngram_join.distinct(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more are in benchmark windows, and cuts runs of 13 such words or more out of the others (1). Each row is judged by itself."""
    return _counted(docs, decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"), span_words=decontaminate.WINDOW))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Says how often and where the mix of the sources takes each document's words (4). All rows stay, each with its own share."""
    return mixing.placed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
]

#: Learned and multi-pass stages: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage before it wrote for itself is deleted when its output stands, and that when the next one's does."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as paths:
            docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
            own = paths.pop()
            if before is not None:
                paths.append(before)
            before = own
    return STAGES[-1][1](spark, docs, sf_dir)
