"""Prefix scans over ranges of positions, ordered unions, drawn orders and packing, against plain versions."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import order, pack


def positions(kind, n=600):
    rnd = random.Random(kind)
    if kind == "dense":
        return list(range(n))
    if kind == "sparse":
        return [i * 10**12 - 5 * 10**14 for i in range(n)]
    if kind == "repeated":
        return [7] * (n // 3) + [rnd.randrange(30) for _ in range(n - n // 3)]
    if kind == "one":
        return [3] * n
    if kind == "nulls":
        return [None if rnd.random() < 0.5 else rnd.randrange(40) for _ in range(n)]
    return [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)]


@pytest.mark.parametrize("kind", ["dense", "sparse", "repeated", "one", "nulls", "wide"])
@pytest.mark.parametrize("bucket", [10, 250, 10_000])
def test_running_sums_of_any_positions(spark, monkeypatch, kind, bucket):
    monkeypatch.setattr(order, "BUCKET", bucket)
    monkeypatch.setattr(order, "_SKETCH", 16)
    at = positions(kind)
    random.Random(1).shuffle(at)
    df = spark.createDataFrame([(p, i, i % 5) for i, p in enumerate(at)], "pos long, id long, v long").repartition(5)
    got = order.running_sum(order.number(df), F.col("v")).collect()
    assert len(got) == len(at) and [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(len(at)))
    by_n = sorted(got, key=lambda r: r["n"])
    assert [r["pos"] for r in by_n] == sorted(at, key=lambda p: (p is not None, p or 0))
    # Sums of equal positions come in any order, but each position ends where the plain sum ends.
    total, ends, last = 0, Counter(), Counter()
    for r in by_n:
        total += r["v"]
        ends[r["pos"]] = total
    for r in got:
        last[r["pos"]] = max(last[r["pos"]], r["running"])
    assert last == ends
    exact = order.running_sum(df, F.col("v"), then=("id",)).collect()
    total = 0
    for r in sorted(exact, key=lambda r: (r["pos"] is not None, r["pos"] or 0, r["id"])):
        total += r["v"]
        assert r["running"] == total


@pytest.mark.parametrize("kind", ["sparse", "repeated", "one", "nulls"])
def test_ranges_are_even(spark, monkeypatch, kind):
    """Sparse positions make no more ranges than dense ones, and a position that many rows have is dealt out."""
    monkeypatch.setattr(order, "BUCKET", 50)
    df = spark.createDataFrame([(p, i) for i, p in enumerate(positions(kind))], "pos long, id long")
    sizes = [r["count"] for r in order._bucketed(df, "pos", True).groupBy("__bucket").count().collect()]
    assert len(sizes) <= 2 * 12 + 12 and max(sizes) <= 150


def test_no_window_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET", 10)
    df = spark.range(1000).select(F.col("id").alias("pos"))
    plan = order.number(df)._jdf.queryExecution().optimizedPlan().toString()
    # The only window without a partition is that over the sums of ranges.
    windows = re.findall(r"Window \[(\w+)", plan)
    assert sorted(windows) == ["sum", "sum"] and "Aggregate [__bucket" in plan


def test_empty_tables_are_numbered(spark):
    none = spark.createDataFrame([], "pos long, id long")
    assert order.number(none).count() == 0 and order.concat(none, none).count() == 0
    assert pack.across_documents(spark.createDataFrame([], "pos long, tokens array<int>"), 4, 0).count() == 0


def test_fifty_frames_are_read_twice_each(spark):
    rnd = random.Random(3)
    frames, want, base = [], [], 0
    for f in range(50):
        rows = [(i, f"{f}:{i}") for i in range(rnd.randrange(4))]
        frames.append(spark.createDataFrame(rows, "pos long, x string"))
        want += [(base + i, x) for i, x in rows]
        base += len(rows)
    df = order.concat(*frames)
    assert sorted((r["pos"], r["x"]) for r in df.collect()) == want
    assert len(re.findall("LogicalRDD|LocalRelation", df._jdf.queryExecution().optimizedPlan().toString())) <= 100


@pytest.mark.parametrize("total", [1, 2, 3, 7, 100, 1023])
def test_every_turn_is_a_permutation(spark, total):
    got = spark.range(3 * total).select(F.floor(F.col("id") / total).alias("t"), order.permuted(F.col("id") % total, total, F.floor(F.col("id") / total), 5).alias("x")).collect()
    turns = [[r["x"] for r in got if r["t"] == t] for t in range(3)]
    assert all(sorted(t) == list(range(total)) for t in turns)
    assert total < 7 or len({tuple(t) for t in turns}) == 3 and sum(a == b for a, b in zip(turns[0], range(total), strict=True)) < total / 3


def test_many_choices_need_no_order(spark):
    keys = spark.range(300).select((F.col("id") * 7).alias("k"), F.lit("x").alias("n2"))
    df = order.seeded_choice(keys, "k", 40_000, 9)
    by = df.groupBy("k").count().collect()
    assert sum(r["count"] for r in by) == 40_000 and {r["count"] for r in by} == {40_000 // 300, 40_000 // 300 + 1}
    turns = df.groupBy(F.floor(F.col("n") / 300).alias("t")).agg(F.countDistinct("k").alias("d"), F.count("*").alias("c")).collect()
    assert all(r["d"] == r["c"] for r in turns) and df.select("n").distinct().count() == 40_000
    again = order.seeded_choice(keys.repartition(7), "k", 40_000, 9)
    assert df.exceptAll(again).isEmpty()
    assert not df.exceptAll(order.seeded_choice(keys, "k", 40_000, 10)).isEmpty()
    with pytest.raises(ValueError, match="nothing"):
        order.seeded_choice(keys.limit(0), "k", 3, 1)


@pytest.mark.parametrize("context", [1, 4, 64])
def test_packing_is_the_plain_cut(spark, monkeypatch, context):
    monkeypatch.setattr(order, "BUCKET", 20)
    rnd = random.Random(context)
    docs = [(p, None if rnd.random() < 0.05 else [rnd.randrange(100) for _ in range(rnd.choice([0, 1, 2, 3, 5, 64, 65, 66, 400]))]) for p in range(0, 900, 9)]
    df = spark.createDataFrame(docs, "pos long, tokens array<int>").repartition(6)
    stream = [x for _, t in docs if t and len(t) >= 2 for x in t]
    cut = lambda s: [s[i : i + context + 1] for i in range(0, len(s) - 1, context)]
    padded = lambda r: r + [-1] * (context + 1 - len(r))
    assert {r["k"]: r["token_ids"] for r in pack.across_documents(df, context, -1).collect()} == dict(enumerate(map(padded, cut(stream))))
    own = {(r["pos"], r["k"]): r["token_ids"] for r in pack.per_document(df, context, -1).collect()}
    assert own == {(p, k): padded(r) for p, t in docs if t and len(t) >= 2 for k, r in enumerate(cut(t))}


def test_no_row_carries_a_whole_document(spark):
    """What is made for each row of a document has its own slice: the exploded output does not hold the document's tokens."""
    df = spark.createDataFrame([(0, list(range(50)))], "pos long, tokens array<int>")
    for packed in (pack.per_document(df, 4, 0), pack.across_documents(df, 4, 0)):
        plan = packed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1
        above = plan.split("Generate explode")[0]
        assert not re.search(r"\b(tokens|t)#\d+", above)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_a_packing_run_on_byte_pairs(spark, monkeypatch):
    """The index of the shards against a plain run: rewritten texts, their ids between marks, one stream, rows and shards."""
    from textloom.operators import byte_pairs, curate, tokenize
    from textloom.plans import queries, run_queries

    monkeypatch.setattr(run_queries, "PAIRS", 150)
    source = queries.docs(spark, "/root/testdata/sf0.001")
    index = sorted(map(tuple, run_queries.pack_run_pairs(spark, "/root/testdata/sf0.001").select("shard", "first_sequence", "sequences", "tokens").collect()))
    marks = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")
    tokens = tokenize.BytePairs(tuple(byte_pairs.train(source, 150)), marks, "<bos>", "<eos>", "<pad>")
    texts = [r["text"] for r in curate.fill_in_middle(source, 0.5, 10).orderBy("pos").collect() if r["text"] is not None]
    assert any(m in t for t in texts for m in marks)
    ids = [tokens.encode(t, True, True) for t in texts]
    assert all(tokens.decode(i) == re.sub("|".join(marks), "", t) for i, t in zip(ids, texts, strict=True))
    total = sum(map(len, ids))
    rows = -(-(total - 1) // 256)
    held = 1_000_000 // 257
    assert index == [(k, k * held, min(held, rows - k * held), min(held, rows - k * held) * 257) for k in range(-(-rows // held))]
