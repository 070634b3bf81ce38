"""Quality classifier: hashed word and character n-gram vectors averaged per text, softmax, numpy gradient descent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm import _subword
from textloom.llm._bytes import release
from textloom.llm.language_id import bounded_sample

FEATURES = _subword.Features(grams=(1, 2, 3, 4), gram_bits=16, words=True, word_bits=17, lower=False)
#: At most so many documents of each label are learned from, chosen by a hash of their ids.
ROWS_PER_LABEL = 1200


def fit(docs: DataFrame, labels: DataFrame, per_label: int = ROWS_PER_LABEL, doc: str = "doc_id", text: str = "text", quality: str = "quality", features: _subword.Features = FEATURES, **options) -> _subword.Model | None:
    """A model of the labels 0 and 1; None without labelled rows. Repeated labels of one document count as their largest; documents that share an id have its label, and one of them, chosen by a hash of its text, is learned from."""
    known = labels.where(f"{quality} is not null and {doc} is not null").groupBy(F.col(doc).alias("key")).agg((F.max(quality) >= 1).cast("int").cast("string").alias("label"))
    counts = [tuple(r) for r in known.groupBy("label").count().orderBy("label").collect()]
    if not counts:
        return None
    # The sample of ids is bounded, so that it may be broadcast; only its texts are shuffled. Of documents that share an id one teaches.
    ids = bounded_sample(known.withColumn("text", F.lit(None).cast("string")), per_label).select("key", "label")
    own = docs.select(F.col(doc).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key")
    rows = own.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("key", "text", "label")
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = _subword.gather(rows, features)
    share = dict(counts)
    names = sorted(share)
    model = _subword.train(features, [(i, w, names.index(y)) for i, w, y in got], names, **options) if got else None
    if model is not None and len(names) == 2:
        # The sample holds both labels alike; scores are put back on the labels' own shares.
        seen = [max(1, sum(y == k for _, _, y in got)) for k in names]
        for k, name in enumerate(names):
            model.bias[k] += model.temperature * _log(share[name] / seen[k])
    del got
    release()
    return model


def _log(x: float) -> float:
    import math

    return math.log(max(x, 1e-9))


def predict(docs: DataFrame, model: _subword.Model | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) and predicted of each row; a null text is scored as empty. Without a model the score is 1. Each row is scored by itself."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    if "1" not in model.labels:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    score = F.element_at("p", model.labels.index("1") + 1)
    return _subword.score(rows, model).select("doc_id", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: _subword.Model | None, doc: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score reaches `least`, all columns unchanged; the texts pass the model once and are not shuffled."""
    return _subword.keep(docs, model, text, least)
