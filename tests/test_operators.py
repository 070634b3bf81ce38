import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import code, curate, measure, order, pack, prefer, tokenize
from textloom.plans import lineage
from textloom.sources import readers


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, texts):
    return readers.inline(spark, texts)


def test_line_endings_and_length(spark):
    df = documents(spark, ["hello\r\nworld\r", "hi", "hello"])
    assert rows(curate.normalize_lines()(df).select("text"))[0] == ("hello\nworld\n",)
    assert sorted(rows(curate.length_between(3, 5)(df).select("document_id"))) == [("inline-000002",)]


def test_unicode_and_lower(spark):
    df = documents(spark, ["Café"])
    assert rows(curate.lower()(curate.normalize_unicode()(df)).select("text")) == [("café",)]


def test_exact_dedup_keeps_first(spark):
    df = documents(spark, ["same", "same", "different"])
    assert sorted(rows(curate.exact_dedup()(df).select("document_id"))) == [("inline-000000",), ("inline-000002",)]


def test_split_twice_is_an_error(spark):
    df = documents(spark, ["a"]).withColumn("split", F.lit("validation"))
    with pytest.raises(PySparkException):
        curate.assign_split(0.9, 0.05)(df).collect()


def test_null_language_is_an_error(spark):
    df = spark.createDataFrame([("a", None)], "text string, lang string")
    with pytest.raises(PySparkException):
        curate.in_set("lang", ["en"])(df).collect()


def test_fill_in_middle_keeps_all_characters(spark):
    df = documents(spark, ["abcdefghijklmnopqrstuvwxyz", "short"])
    out = curate.fill_in_middle(df, 1.0, 3).orderBy("pos").collect()
    t, a, b = out[0]["text"], out[0]["first"], out[0]["second"]
    whole = "abcdefghijklmnopqrstuvwxyz"
    assert t == f"<fim_prefix>{whole[:a]}<fim_suffix>{whole[b:]}<fim_middle>{whole[a:b]}" and min(a, b - a, 26 - b) >= 3
    assert out[1]["text"] == "short"


@pytest.mark.parametrize("tokens,context,want", [([1, 2, 3], 4, [[1, 2, 3, 0, 0]]), ([1, 2, 3, 4, 5, 6], 3, [[1, 2, 3, 4], [4, 5, 6, 0]])])
def test_pack_per_document(spark, tokens, context, want):
    df = spark.createDataFrame([(0, tokens)], "pos long, tokens array<int>")
    assert [list(r[0]) for r in pack.per_document(df, context, 0).orderBy("k").select("token_ids").collect()] == want


def test_pack_across_documents(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8])], "pos long, tokens array<int>")
    got = [list(r[0]) for r in pack.across_documents(df, 4, 0).orderBy("k").select("token_ids").collect()]
    assert got == [[1, 2, 3, 4, 5], [5, 6, 7, 8, 0]]


def test_token_over_16_bits_is_an_error(spark):
    df = spark.createDataFrame([([65536],)], "token_ids array<int>")
    with pytest.raises(PySparkException):
        pack.checked(df).collect()


def test_bounded_prefix_stops_at_first_excess(spark):
    df = documents(spark, ["aaaa", "bbbb", "cccc"])
    assert len(rows(order.bounded_prefix(df, 10, 8))) == 2


def test_running_sum_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET", 3)
    df = spark.range(20).withColumnRenamed("id", "pos")
    assert [r[0] for r in order.running_sum(df, F.col("pos")).orderBy("pos").select("running").collect()] == [i * (i + 1) // 2 for i in range(20)]


def test_contiguous_matches_slices(spark):
    got = [r[0] for r in spark.range(10).select(order.contiguous(F.col("id"), 10, 3)).collect()]
    assert got == [next(w for w in range(3) if w * 10 // 3 <= i < (w + 1) * 10 // 3) for i in range(10)]


def test_preference_pairs(spark):
    df = spark.createDataFrame([("t", 0, 2.0, False), ("t", 1, 1.0, False), ("t", 2, 1.0, False), ("u", 0, 3.0, True), ("u", 1, 3.0, True)], "task_id string, sample_index int, score double, perfect boolean")
    assert len(rows(prefer.pairs(df))) == 2


def test_stop_truncation_and_slug(spark):
    df = spark.createDataFrame([("abc STOP def END",)], "t string")
    assert rows(df.select(T.truncate_at_stop("t", ["END", "STOP"]), T.slug("t"))) == [("abc ", "abc_stop_def_end")]


def test_functions_and_reasons(spark):
    df = spark.createDataFrame([("m", "import os\ndef add(a, b):\n    return a + b\ndef _p():\n    pass\n"), ("x", "def broken(:")], "document_id string, text string")
    assert [r[0] for r in code.extract_functions(df).collect()] == ["m__function_0000_add"]
    assert code.reason_against("def broken(:") == "invalid_python"
    assert code.reason_against("@x\ndef f() -> int:\n    return 1") == "function_has_decorators"
    assert code.reason_against("def f(a) -> int:\n    return 1") == "missing_parameter_annotation"


def test_bpe_round_trip(spark):
    merges = tokenize.train_merges(iter(["abababab", "bcbcbcbc", "ababcccc"]), 5)
    df = spark.createDataFrame([("abab bcé",)], "t string").withColumn("i", tokenize.bpe_encode(merges)("t"))
    assert rows(df.select(tokenize.bpe_decode(merges)("i"))) == [("abab bcé",)]
    assert merges[0] == (b"a", b"b")


def test_lineage_runs_parents_first():
    ran = []
    stages = [lineage.Stage("b", {}, ["a"], lambda p: ran.append("b")), lineage.Stage("a", {}, [], lambda p: ran.append("a"))]
    assert lineage.execute(stages, lambda p: False) == {"a": "complete", "b": "complete"} and ran == ["a", "b"]
    with pytest.raises(ValueError):
        lineage.resolve([lineage.Stage("a", {}, ["a"])])


def test_shards_and_attempts(spark, tmp_path):
    df = documents(spark, ["a", "b", "c"]).withColumn("split", F.lit("train"))
    readers.write_shards(df, str(tmp_path / "s"), 2)
    assert readers.read_shards(spark, str(tmp_path / "s"), "train").count() == 3
    (tmp_path / "log").write_text('{"seed": {"seed_id": 3}, "sample_index": 0}\nnot json\n{"seed": {"seed_id": 3}, "sample_index": 1}\n')
    assert sorted(rows(readers.completed_attempts(spark, str(tmp_path / "log")))) == [(3, 0), (3, 1)]
    (tmp_path / "h.txt").write_bytes(b"hello\r\nworld")
    assert rows(readers.local_text(spark, [str(tmp_path / "h.txt")]).select("text")) == [("hello\nworld",)]
