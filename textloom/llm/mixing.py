"""Mixing sources to target weights, in DataFrame and SQL functions alone.

Each source's texts, in a pseudorandom order, are one stream of tokens cut into blocks of
fixed length. A source's share of the mix is a number of slots, and slot k of a source takes
the block that the source's permutation of pass k // blocks gives k % blocks. The slots of
all sources are dealt to output shards of equal size by one more permutation, of all places
in the mix: a shard draws its slots without replacement, so that the counts of its sources are
multinomial, given that each source's counts over all shards add up to its target. Blocks
and slots then meet by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm._spark import keyed, plain, written

BLOCK = 64
SHARD_SLOTS = 4096
#: A source is taken at most so often.
REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Rounds of the swap-or-not permutation.
ROUNDS = 16
#: Documents of one ordering group, and ordering groups of one prefix group.
GROUP_ROWS = 1000
GROUPS = 1000


def n_words(text: str) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sid, source, source_size, target of the sources of rows (source, size): one row a source.

    Sources stand in code-point order, null last, and weigh `weights` in turn. The targets
    are min(repeats * size, level * weight), where the level makes them add up to all sizes:
    what the repeated resharing of any excess by weight comes to.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight)
    by = by.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("reach", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("reach", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / rest)
    # The first source, by reach, that its level does not fill sets the level of all.
    first = F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "sid", "level"))).over(whole)["level"]
    by = by.withColumn("at", F.coalesce(first, F.lit(float("inf"))))
    return by.select("sid", "source", "source_size", F.when(F.col("reach") <= F.col("at"), F.col("cap")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def _permuted(x: str, n: str, key: str, seed: int) -> str:
    """SQL for the place of x in a pseudorandom permutation of 0 to n - 1 named by key (swap or not)."""
    # In each round x and its mirror image about a keyed centre may change places.
    mirror = f"pmod(xxhash64({seed}, {key}, r) - x, {n})"
    return f"""aggregate(sequence(0, {ROUNDS - 1}), {x}, (x, r) ->
        if(xxhash64({seed + 1}, {key}, r, greatest(x, {mirror})) & 1 = 1, {mirror}, x))"""


def slots(by_source: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, place, sid, slot, block, most of every slot of the mix, from rows (sid, source_size, target).

    Shards have shard_slots places, the last one what is left. most: the words that the slot takes of its block. Whole
    passes take every block of a source. The last pass takes as many words as the target leaves: the
    source's blocks of full length in turn of a permutation, the short one at its end only if it
    needs all others, and of its last block what is still wanted, so that a source's words are
    its target, rounded.
    """
    by = by_source.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("whole", F.expr(f"source_size div {block}"))
    by = by.withColumn("passes", F.floor(F.col("target") / F.col("source_size")))
    by = by.withColumn("rest", F.least(F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"), F.col("source_size")))
    by = by.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    # One row a source in one window, as for its target.
    by = by.withColumn("first", F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    # Slots are made from chunks that are dealt out first: a large source's do not come from one
    # task. The number is given, as the few bytes of the chunks would otherwise be put together again.
    tasks = int(by_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = by.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / shard_slots))).alias("chunk")).repartition(tasks, "sid", "chunk")
    slot = F.explode(F.sequence(F.col("chunk") * shard_slots, F.least((F.col("chunk") + 1) * shard_slots, F.col("n")) - 1))
    each = chunks.select("sid", "blocks", "whole", "passes", "rest", "n", "first", "total", slot.alias("slot"))
    each = each.withColumn("pass", F.expr("slot div blocks")).withColumn("x", F.expr("if(pass < passes, pmod(slot, blocks), slot - passes * blocks)"))
    each = each.withColumn("among", F.expr("if(pass < passes, blocks, whole)"))
    each = each.withColumn("block", F.expr(f"if(x >= among, x, {_permuted('x', 'among', 'sid, pass', seed)})"))
    each = each.withColumn("most", F.expr(f"if(pass >= passes and slot = n - 1, rest - x * {block}, {block})"))
    each = each.withColumn("at", F.expr(_permuted("first + slot", "total", "total", seed + 2)))
    return each.select(F.expr(f"at div {shard_slots}").alias("shard"), F.expr(f"pmod(at, {shard_slots})").alias("place"), "sid", "slot", "block", "most")


def _numbered(sized: DataFrame, groups: int) -> DataFrame:
    """sized (row, h and what h is of) with k, which numbers the rows that are alike in all but their row, from 0.

    Where no row has an equal, all are 0. Else they are numbered within lots, dealt out by row, from where the lots before have ended, so that no task has all of them.
    """
    same = ["h", "doc_id", "t", "size"]
    if sized.groupBy(*same).count().where("count > 1").isEmpty():
        return sized.withColumn("k", F.lit(0).cast("long"))
    lots = sized.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(groups)))
    counts = lots.groupBy(*same, "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("lot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ends = counts.select(*[F.col(c).alias(f"{c}_") for c in same], F.col("lot").alias("lot_"), before.alias("before")).where("before > 0")
    inside = F.row_number().over(Window.partitionBy(*same, "lot").orderBy("row")) - 1
    alike = [F.col("lot") == F.col("lot_"), *(F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same)]
    joined = lots.withColumn("k", inside.cast("long")).join(ends, alike, "left")
    return joined.withColumn("k", F.col("k") + F.coalesce("before", F.lit(0))).select(*sized.columns, "k")


def pieces(sized: DataFrame, by_source: DataFrame, rows: int, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """sid, block, row, doc_id, size, at, off, n: the n tokens from token `at` of each document row that stand in a block, from its token `off` on.

    sized: rows (row, doc_id, sid, t, size > 0). The order follows ids and texts, whose hash t is, and not where rows stand in
    their files: of rows alike in these any may come first, as they are the same.
    """
    groups = max(1, -(-rows // GROUP_ROWS))
    placed = _numbered(sized.withColumn("h", F.xxhash64(F.lit(seed + 4), "sid", "doc_id", "t", "size")), groups).withColumn("g", F.pmod(F.xxhash64(F.lit(seed + 5), "h", "k"), F.lit(groups)))
    sums = placed.groupBy("sid", "g").agg(F.sum("size").alias("s")).withColumn("top", F.expr(f"g div {GROUPS}"))
    tops = sums.groupBy("sid", "top").agg(F.sum("s").alias("t"))
    tops = tops.withColumn("t0", F.sum("t").over(Window.partitionBy("sid").orderBy("top")) - F.col("t")).drop("t")
    sums = sums.withColumn("s0", F.sum("s").over(Window.partitionBy("sid", "top").orderBy("g")) - F.col("s"))
    base = sums.join(tops, ["sid", "top"]).select("sid", "g", (F.col("s0") + F.col("t0")).alias("base"))
    inside = Window.partitionBy("sid", "g").orderBy("h", "doc_id", "t", "size", "k").rowsBetween(Window.unboundedPreceding, 0)
    begun = placed.withColumn("to", F.sum("size").over(inside)).join(base, ["sid", "g"])
    begun = begun.withColumn("begin", F.col("base") + F.col("to") - F.col("size"))
    first, last = F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")
    cut = begun.select("sid", "row", "doc_id", "size", "begin", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    off = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size"))
    return cut.select("sid", "block", "row", "doc_id", "size", at.alias("at"), off.alias("off"), (end - at).alias("n"))


def _sized(rows: DataFrame, doc: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, sid, size of each row; sources): texts are read once, and sizes written to the shared folder."""
    sized = written(rows.select("row", F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text).cast("string")).alias("t"), n_words(text).alias("size")), "mix-sizes")
    sources = written(targets(sized), "mix-sources")
    # One row a source: small next to the documents; Spark broadcasts it if it is under its own threshold.
    tagged = sized.join(sources.select("sid", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")))
    return tagged.select("row", "doc_id", "sid", "t", "size"), sources


def digest(docs: DataFrame, block: int = BLOCK, seed: int = 0, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row: taken counts the words that the mix takes, repeats included.

    A null source is a source of its own; null texts have size 0 and nothing is taken of
    them. Each row is judged by itself, whether or not others share its id. An empty table gives no rows.
    """
    tagged, sources = _sized(keyed(docs.select(doc, text, source)), doc, text, source)
    held = pieces(tagged.where("size > 0"), sources, tagged.count(), block, seed)
    # Slots that take a block whole are counted; a source has one that takes a part.
    uses = slots(sources, block, seed=seed).groupBy("sid", "block").agg(F.count(F.when(F.col("most") >= block, 1)).alias("uses"), F.max(F.when(F.col("most") < block, F.col("most"))).alias("part"))
    # Blocks grow with the data however well they compress: they meet by a sorted shuffle.
    words = F.col("n") * F.coalesce("uses", F.lit(0)) + F.least(F.greatest(F.coalesce("part", F.lit(0)) - F.col("off"), F.lit(0)), F.col("n"))
    taken = held.join(uses.hint("merge"), ["sid", "block"], "left").groupBy("sid", "row", "doc_id", "size").agg(F.sum(words).alias("taken"))
    every = taken.select("doc_id", "sid", "size", "taken").unionByName(tagged.where("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken")))
    return every.join(sources, "sid").select("doc_id", "source", "size", "source_size", "target", "taken")


def placed(docs: DataFrame, block: int = BLOCK, seed: int = 0, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with size, source_size, target, taken and placements (shard, place, at, n): where the mix puts which of their words.

    Placements are in the order of shard and place. A document that no slot takes has none and
    stays; null sources, null texts and rows that share an id are as in digest(). Where the documents have a column of such a name, theirs
    stays as it is and the new one gets mix_ before its name.
    """
    names = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns))), strict=True))
    rows = keyed(plain(docs))
    tagged, sources = _sized(rows, names[doc], names[text], names[source])
    # Written, as are the placements, so that the driver holds the plans of the pieces, of the slots and of the texts one after the other.
    held = written(pieces(tagged.where("size > 0"), sources, tagged.count(), block, seed), "mix-pieces")
    met = slots(sources, block, seed=seed).join(held.hint("merge"), ["sid", "block"]).withColumn("n", F.least(F.col("n"), F.col("most") - F.col("off"))).where("n > 0")
    put = met.groupBy("row").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "place", "at", "n"))).alias("placements"))
    put = written(put, "mix-put")
    none = F.array().cast("array<struct<shard:bigint,place:bigint,at:bigint,n:bigint>>")
    notes = tagged.join(sources, "sid").join(put, "row", "left").select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("placements", none).alias("placements"))
    # Texts are dealt out once, and not sorted: each task holds its part of the notes.
    both = rows.join(notes.hint("shuffle_hash"), "row")
    given = {c.lower() for c in docs.columns}
    new = [F.col(c).alias(_free(c, given)) for c in notes.columns if c != "row"]
    return both.select(*(F.col(n).alias(c) for c, n in names.items()), *new)


def _free(name: str, given: set[str]) -> str:
    while name in given:
        name = f"mix_{name}"
    return name
