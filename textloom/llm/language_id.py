"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm import _subword
from textloom.llm._bytes import release

FEATURES = _subword.Features(grams=(1, 2, 3, 4), gram_bits=16, words=True, word_bits=16)
#: At most so many rows of each language are learned from, chosen by a hash of their ids; fewer of each if all together would be
#: more than SAMPLE_ROWS, but no fewer than LEAST_ROWS.
ROWS_PER_LABEL = 600
SAMPLE_ROWS = 12_000
LEAST_ROWS = 20


def fold(doc: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc).cast("string")) % parts


def bounded_sample(rows: DataFrame, per_label: int) -> DataFrame:
    """At most per_label rows (key, text, label) of each label, the first by a hash of the key."""
    # A row a label; the labels are part of the model that every task will hold, and so may be broadcast. Texts stay where they are until they are drawn.
    counts = rows.groupBy("label").count()
    share = F.when(F.col("count") <= 2 * per_label, 1.0).otherwise(2.0 * per_label / F.col("count"))
    drawn = rows.withColumn("__h", F.xxhash64(F.col("key"), F.lit(11))).join(F.broadcast(counts.select("label", share.alias("__share"))), "label")
    drawn = drawn.where((F.pmod("__h", F.lit(1 << 30)) / float(1 << 30)) < F.col("__share"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("__h", "key", F.xxhash64("text")))
    return drawn.withColumn("__n", place).where(F.col("__n") <= per_label).select("key", "text", "label")


def fit(labelled: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = ROWS_PER_LABEL, features: _subword.Features = FEATURES, **options) -> _subword.Model | None:
    """A model of the labelled rows; None if there are none. Rows with a null id or label teach nothing; every label that is there is learned.

    Shuffled texts are one more class, which is never predicted but takes its share of the scores.
    """
    rows = labelled.select(F.col(doc).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("key is not null and label is not null")
    names = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]  # the model's own labels
    if not names:
        return None
    got = _subword.gather(bounded_sample(rows, min(per_label, max(LEAST_ROWS, SAMPLE_ROWS // len(names)))), features, other=True)
    place = {n: i for i, n in enumerate(sorted(names))}
    model = _subword.train(features, [(i, w, place.get(y, len(place))) for i, w, y in got], sorted(names), **options)
    del got
    release()
    return model


def predict(docs: DataFrame, model: _subword.Model | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row.

    A null text, or one without letters, is `und` with score 0 and rejected. rejected: the
    calibrated score, the probability of the language where none of them is a possibility as well, is under the model's threshold. Without a model
    everything is `und`. Each row is judged by itself, whether or not others share its id; of equal scores the first label counts.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blank = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    # Texts without letters reach the model empty; the flag travels as a null text.
    scored = _subword.score(rows.withColumn("text", F.when(~blank, F.col("text"))), model, keep_null=True)
    own = F.slice("p", 1, len(model.labels))
    best = F.array_max(own)
    names = F.array(*[F.lit(x) for x in model.labels])
    known = F.col("p").isNotNull()
    return scored.select(
        "doc_id",
        F.when(known, F.element_at(names, F.array_position(own, best).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(known, best).otherwise(0.0).alias("score"),
        F.when(known, best < F.lit(model.reject_below)).otherwise(True).alias("rejected"),
    )
