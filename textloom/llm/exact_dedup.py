"""Exact deduplication by naming blocks, in DataFrame and SQL functions alone.

A text's bytes are cut into blocks of fixed size. All blocks that more than one document has are
sorted, and a block's place is its name, an integer: equal blocks have equal names and different ones different names, so no
hash decides anything. Then the names of neighbours are paired, and the pairs are sorted and named in turn, until each
document has one name. Documents are equal when their last names, of the same level, are. A block or pair that only one document has makes
this document unlike all others: it is left out of all that follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._spark import keyed, meet, plain, written

#: Bytes of a block.
BLOCK = 512
#: Rows up to this number may be broadcast to leave their documents out; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def as_it_is(text: Column) -> Column:
    """No change to the text."""
    return text


def cut(rows: DataFrame, text: Column, block: int = BLOCK) -> DataFrame:
    """row, n, i, block: the n blocks of each row's text by their places i, the last one as long as it is; an empty text is one empty block."""
    # The bytes are bound once, so that a block costs its own bytes however long the text is.
    parts = f"transform(array(whole), b -> transform(sequence(0L, (greatest(octet_length(b), 1) - 1) div {block}), i -> substring(b, cast(i * {block} + 1 as int), {block})))[0]"
    bytes_of = rows.select("row", F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("whole"))
    return bytes_of.select("row", F.expr(f"(greatest(octet_length(whole), 1) - 1) div {block} + 1").alias("n"), F.posexplode(F.expr(parts)).alias("i", "block"))


def _named(parts: DataFrame, key: list[str]) -> DataFrame:
    """row, n, i, name of the parts (row, n, i, key) whose rows share every part with another row."""
    met = parts.groupBy(*key).agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("times"))
    met = written(met.select(*[F.when(F.col("low") < F.col("high"), F.col(k)).alias(k) for k in key], "low", "high", "times"), "block-counts")
    total = met.agg(F.sum("times")).first()[0] or 0
    # A name is a place in the order of all keys, with gaps between the partitions.
    ordered = met.where("low < high").select(*key, "times").repartitionByRange(*key).sortWithinPartitions(*key)
    names = written(ordered.withColumn("name", F.monotonically_increasing_id()), "block-names")
    lone = met.where("low = high").select(F.col("low").alias("row")).distinct()
    return meet(parts, names, key, "times", total).join(lone, "row", "left_anti").select("row", "n", "i", "name")


def identities(rows: DataFrame, text: str = "text", block: int = BLOCK, prepare: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """row, level, name of rows (row, text); rows have equal texts if and only if both are equal. Rows whose text no other row has are left out, though not all.

    The number of levels is the logarithm of the longest text that shares all its blocks.
    """
    parts, key, level, done = cut(rows, prepare(F.col(text)), block), ["block"], 0, []
    while True:
        pair = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        named = _named(parts, key).groupBy("row", F.expr("i div 2").alias("i")).agg(F.max("n").alias("n"), pair(0).alias("a"), F.coalesce(pair(1), F.lit(-1).cast("long")).alias("b"))
        named = written(named, "block-pairs")
        done.append(named.where("n = 1").select("row", F.lit(level).alias("level"), F.col("a").alias("name")))
        parts, key, level = named.where("n > 1").select("row", F.expr("(n + 1) div 2").alias("n"), "i", "a", "b"), ["a", "b"], level + 1
        if parts.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def judge(rows: DataFrame, doc: str = "doc_id", text: str = "text", block: int = BLOCK, prepare: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """row, keep_id, keep_row, group_size of the rows (row, doc, text) whose text another row has too: of a group the row with the largest id stays, of these the largest key of a row."""
    found = identities(rows.select("row", text), text, block, prepare)
    tagged = written(rows.select("row", F.col(doc).alias("doc_id")).join(found, "row"), "block-identities")
    groups = tagged.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
    groups = written(groups.where("group_size > 1").select("level", "name", "group_size", F.col("group_size").alias("times"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "block-groups")
    return meet(tagged, groups, ["level", "name"], "times", tagged.count()).select("row", "keep_id", "keep_row", "group_size")


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", block: int = BLOCK, prepare: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """The documents, all columns, with one of each group of equal texts: that of the largest id, null ids being the smallest.

    A null text counts as empty, and is equal to one. Of rows that share the largest id and the text one stays. prepare changes what is compared, not what comes out.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = keyed(plain(docs))
    judged = judge(rows, names[docs.columns.index(doc)], names[docs.columns.index(text)], block, prepare)
    gone = written(judged.where("row != keep_row").select("row"), "block-copies")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*names).toDF(*docs.columns)


def digest(docs: DataFrame, doc: str = "doc_id", text: str = "text", block: int = BLOCK, prepare: Callable[[Column], Column] = as_it_is) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    keep_id is the id of the row that stays of those with an equal text; one row of each group is kept, also where rows
    share an id or have none. An empty table gives no rows; other columns are not looked at.
    """
    rows = keyed(docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")))
    judged = judge(rows, block=block, prepare=prepare)
    each = rows.select("row", "doc_id", F.sha2(F.coalesce(prepare(F.col("text")), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    alone = F.col("keep_row").isNull()
    return each.join(judged, "row", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("keep_row") == F.col("row"))).alias("kept"), "text_sha256"
    )
