"""Ordered operators over an explicit position, without putting all rows in one task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that a bucket of positions has on average, and the buckets there are at most.
BUCKET = 10_000
BUCKETS = 1 << 14


#: Ranges that the pass over the positions that counts rows tells apart; more take a second pass.
_SKETCH = 256


def _edges(df: DataFrame, value: Column) -> tuple[int, list[int]]:
    """(number of ranges wanted, the positions that end all but the last of them, repeated where a position fills several)."""
    cut = lambda n: F.percentile_approx(value, F.array(*[F.lit(k / n) for k in range(1, n)]), 8 * n).alias("b")
    rows, bounds = df.agg(F.count(F.lit(1)), cut(_SKETCH)).first()
    wanted = max(1, min(BUCKETS, -(-rows // BUCKET)))
    if wanted > _SKETCH:
        bounds = df.agg(cut(wanted)).first()[0]
    elif bounds:
        bounds = [bounds[-(-k * _SKETCH // wanted) - 1] for k in range(1, wanted)]
    return wanted, bounds or []


def _bucketed(df: DataFrame, pos: str, split: bool) -> DataFrame:
    """df with __bucket, a struct (place, lot) in the order of positions: ranges of positions with as many rows each, as far as a sketch of them tells.

    With split, a position that fills several ranges has its rows dealt out to as many lots by what else they hold. Nulls come first.
    """
    value = F.col(pos).cast("long")
    wanted, bounds = _edges(df, value)
    edges = sorted(set(bounds))
    table = F.array(*[F.lit(e).cast("long") for e in edges])
    # The number of edges below a position, by halving steps: a range ends with its edge.
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))])
    below = lambda at: F.get(table, F.least(at, F.lit(len(edges))) - 1) < value
    place = F.aggregate(halves, F.lit(0), lambda low, s: F.when((low + s <= len(edges)) & below(low + s), low + s).otherwise(low)) if edges else F.lit(0)
    lot = F.lit(0).cast("long")
    often = {e: n for e, n in Counter(bounds).items() if n > 1}
    if split and wanted > 1:
        lots = F.when(value.isNull(), wanted)
        for n in sorted(set(often.values())):
            lots = lots.when(value.isin([e for e, k in often.items() if k == n]), n + 1)
        rest = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
        # A range's edge stands behind the other positions of the range, and so do its lots.
        lot = F.pmod(rest, lots.otherwise(1).cast("long")) + F.when(value.isin(list(often)), 1).otherwise(0) if often else F.pmod(rest, lots.otherwise(1).cast("long"))
    return df.withColumn("__bucket", F.struct(F.when(value.isNull(), -1).otherwise(place).alias("place"), lot.alias("lot")))


def running_sum(df: DataFrame, value: Column, pos: str = "pos", out: str = "running", then: Sequence[str] = ()) -> DataFrame:
    """df with the sum of value over all rows up to and including each, by pos (a long) and, where positions are equal, by `then`; otherwise equals come in any order. Null positions come first.

    Two passes: sums of ranges of positions with about BUCKET rows each, then running sums within each range from where
    those before it end. Positions may be sparse or repeated: without `then`, rows of a position that many rows have are dealt out, rows alike in all columns excepted. The sums, of which there are twice BUCKETS at most, are all that meets in one place.
    """
    bucketed = _bucketed(df, pos, not then).withColumn("__value", value)
    totals = bucketed.groupBy("__bucket").agg(F.sum("__value").alias("__total"))
    base = totals.withColumn("__base", F.sum("__total").over(Window.orderBy("__bucket")) - F.col("__total")).drop("__total")
    inside = Window.partitionBy("__bucket").orderBy(pos, *then).rowsBetween(Window.unboundedPreceding, 0)
    both = bucketed.withColumn("__in", F.sum("__value").over(inside)).join(F.broadcast(base), "__bucket")
    return both.withColumn(out, F.col("__in") + F.col("__base")).drop("__bucket", "__value", "__in", "__base")


def number(df: DataFrame, pos: str = "pos", out: str = "n", then: Sequence[str] = ()) -> DataFrame:
    """df with the row number by pos, from 0."""
    return running_sum(df, F.lit(1).cast("long"), pos, out, then).withColumn(out, F.col(out) - 1)


def bounded_prefix(df: DataFrame, max_rows: int, max_bytes: int, text: str = "text", pos: str = "pos", strict: bool = False) -> DataFrame:
    """The rows before the first that would exceed max_bytes of text in all or max_rows. With strict, an empty prefix is an error at once."""
    counted = running_sum(number(df, pos, "__n"), F.octet_length(text).cast("long"), pos, "__bytes")
    out = counted.where((F.col("__n") < max_rows) & (F.col("__bytes") <= max_bytes)).drop("__n", "__bytes")
    if strict and out.isEmpty():
        raise ValueError("there is no document" if df.isEmpty() else "the first document is larger than the sample")
    return out


def first(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n rows in order: n of each partition are kept, and the best of these."""
    return df.orderBy(*(by or ("pos",))).limit(n)


def named(df: DataFrame, names: Sequence[str], column: str = "name", out: str = "place") -> DataFrame:
    """The rows with one of the names, and the name's place in the list, from 0; names that no row has are passed over."""
    places = F.create_map(*[F.lit(x) for i, n in enumerate(dict.fromkeys(names)) for x in (n, i)])
    return df.where(F.col(column).isin(*names)).withColumn(out, places[F.col(column)])


def contiguous(pos: Column, total: int, workers: int) -> Column:
    """The worker of each position when worker i has the positions from i * total // workers on."""
    return F.floor(((pos + 1) * workers - 1) / F.lit(total)).cast("long")


def skip_take(df: DataFrame, skip: int, take: int, pos: str = "pos", out: str = "n") -> DataFrame:
    """Rows skip to skip + take - 1 of those that are there, numbered from 0."""
    return number(df, pos, out).where(F.col(out).between(skip, skip + take - 1)).withColumn(out, F.col(out) - skip)


def keep_first(df: DataFrame, by: Column, *order: Column | str) -> DataFrame:
    """One row of each value of `by`, the first in order. Duplicates fold before the shuffle: no window, no hot partition."""
    columns = df.columns
    keyed = df.select(by.alias("__by"), F.struct(*[c.alias(f"o{i}") if isinstance(c, Column) else F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("__row"))
    best = keyed.groupBy("__by").agg(F.min("__row").alias("__row"))
    return best.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(columns)])


def concat(*frames: DataFrame, pos: str = "pos") -> DataFrame:
    """The frames one after the other: each one's positions, from 0, begin behind the largest of those before it.

    Each frame is read twice: for its largest position, of which there is one row a frame, and in the union.
    """
    tagged = [df.select(*frames[0].columns, F.lit(i).alias("__frame")) for i, df in enumerate(frames)]
    every = reduce(DataFrame.unionByName, tagged)
    widths = every.groupBy("__frame").agg(F.greatest(F.max(pos) + 1, F.lit(0)).alias("__width"))
    before = Window.orderBy("__frame").rowsBetween(Window.unboundedPreceding, -1)  # a row a frame
    base = widths.select("__frame", F.coalesce(F.sum("__width").over(before), F.lit(0)).alias("__base"))
    return every.join(F.broadcast(base), "__frame").withColumn(pos, F.col(pos) + F.col("__base")).select(*frames[0].columns)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the frames, whose columns meet by name; one that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def zip_strict(left: DataFrame, right: DataFrame, left_pos: str = "pos", right_pos: str = "pos") -> DataFrame:
    """Rows of both in their orders, side by side; a row without a partner is an error. Of equally named columns the left one's stay."""
    a = number(left, left_pos, "__n").withColumn("__l", F.lit(True))
    b = number(right, right_pos, "__n").drop(*[c for c in right.columns if c in left.columns]).withColumn("__r", F.lit(True))
    both = a.join(b, "__n", "full")
    whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("the sides differ in length")).cast("boolean"))).drop("__n", "__l", "__r")


def batches(df: DataFrame, size: int, pos: str = "pos", out: str = "batch") -> DataFrame:
    """df with the number of each row's batch of `size` rows by pos."""
    return number(df, pos, out).withColumn(out, F.floor(F.col(out) / size))


#: Rounds of the permutation of a turn's choices.
ROUNDS = 16


def _drawn(seed: int, *what: Column) -> Column:
    """60 bits of the SHA-256 of what is named."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[w.cast("string") for w in what]), 256), 1, 15), 16, 10).cast("long")


def permuted(x: Column, total: int, turn: Column, seed: int) -> Column:
    """The place of x in a permutation of 0 to total - 1, one for each turn: in each round x and its mirror image about a drawn centre change places, or not.

    A place is computed by itself; no order of all rows is needed.
    """

    def round_(x: Column, r: Column) -> Column:
        mirror = F.array(F.pmod(_drawn(seed, turn, r) - x, F.lit(total).cast("long")))
        # As an element of an array it is computed once.
        return F.get(F.transform(mirror, lambda m: F.when(_drawn(seed, turn, r, F.greatest(x, m)) % 2 == 1, m).otherwise(x)), 0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), round_)


def seeded_choice(df: DataFrame, key: str, count: int, seed: int, out: str = "n") -> DataFrame:
    """`count` rows in an order drawn from the seed, numbered from 0; once all are used, a new order begins.

    Keys have to be distinct. Choice k takes the row whose number by key the permutation of turn k // rows names for k % rows: rows
    meet their choices by number. Orders come from SHA-256, so reruns and other machines agree. Keys that are no
    numbers are numbered in the order of their hashes.
    """
    total = df.count()
    if not total:
        raise ValueError("there is nothing to choose from")
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rows = number(df.withColumn("__key", F.col(key) if whole else _drawn(seed, F.col(key))), "__key", "__at", (key,)).drop("__key")
    k = F.col("id")
    choices = df.sparkSession.range(count).select(k.alias(out), permuted(k % total, total, F.floor(k / total), seed).alias("__at"))
    return choices.join(rows, "__at").select(*df.columns, out)


def shard_index(shards: DataFrame, rows: str = "rows", pos: str = "shard") -> DataFrame:
    """Shards with the row offset at which each begins."""
    return running_sum(shards, F.col(rows).cast("long"), pos, "start").withColumn("start", F.col("start") - F.col(rows))


def locate(ids: DataFrame, index: DataFrame, row: str = "row_id", rows: str = "rows", width: int = 4096) -> DataFrame:
    """Each row id with its shard and place in it: an equality join on stretches of `width` ids, then a range test.

    A shard meets only the stretches that it covers, so no side is broadcast and none is crossed.
    """
    last = F.col("start") + F.col(rows) - 1
    covered = index.where(F.col(rows) > 0).withColumn("__stretch", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))
    both = ids.withColumn("__stretch", F.floor(F.col(row) / width)).join(covered, "__stretch")
    return both.where((F.col(row) >= F.col("start")) & (F.col(row) <= last)).withColumn("place", F.col(row) - F.col("start")).drop("__stretch", "start", rows)


def shuffled_shards(shards: DataFrame, shard: str, seed: int, epoch: int, workers: int) -> DataFrame:
    """The place of each shard in an epoch's hash order, and the worker that reads it, in turn."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(shard).cast("string")), 256)
    # The hash's first digits are the position, the whole of it decides between equals.
    keyed = shards.withColumn("__hash", h).withColumn("__at", F.conv(F.substring("__hash", 1, 15), 16, 10).cast("long"))
    placed = number(keyed, "__at", "place", ("__hash",)).drop("__hash", "__at")
    return placed.withColumn("worker", F.col("place") % workers)


def shuffled_rows(rows: DataFrame, shard: str, row: str, seed: int, epoch: int, workers: int) -> DataFrame:
    """rows with worker, shard_place and row_place: the order in which an epoch reads them.

    Shards come in hash order and go to the workers in turn, and so do a shard's rows among
    themselves. A shard's rows are ordered together, as it is of bounded size.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(shard).cast("string"), F.col(row).cast("string")), 256)
    placed = rows.withColumn("row_place", F.row_number().over(Window.partitionBy(shard).orderBy(h)).cast("long") - 1)
    shards = shuffled_shards(rows.select(shard).distinct(), shard, seed, epoch, workers)
    return placed.join(shards.withColumnRenamed("place", "shard_place"), shard)
