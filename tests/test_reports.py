"""Reports, archives, locks and code: the cases that tables do not hold."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import formats, text as T
from textloom.operators import code, order, prefer, report
from textloom.plans import lineage
from textloom.sources import archives


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_completion_after_a_colon(spark):
    df = spark.createDataFrame([("f(x): \n", "y"), ("f:", "\ny"), ("f:", ""), ("", "y"), ("f", "y")], "p string, c string")
    assert [r[0] for r in rows(df.select(T.append_completion("p", "c")))] == ["f(x): \n\ny", "f:\ny", "f:", "y", "fy"]


def test_inference_prompt(spark):
    df = spark.createDataFrame([("a\n\n", "x"), (None, " b \n")], "p string, d string")
    assert [r[0] for r in rows(df.select(T.inference_prompt("p", "d")))] == ["a", "b\n\n"]


def test_formats(spark):
    df = spark.createDataFrame([(0.125, 1234567), (-0.00004, 1), (None, None)], "x double, n long")
    got = rows(df.select(formats.decimal(F.col("x"), 2), formats.delta(F.col("x")), formats.percent(F.col("x")), formats.integer(F.col("n"))))
    assert got == [("0.12", "+0.1250", "12.50%", "1,234,567"), ("-0.00", "-0.0000", "-0.00%", "1"), ("missing",) * 4]


def test_zip_needs_equal_lengths(spark):
    a, b = spark.range(3).withColumnRenamed("id", "pos"), spark.range(2).withColumnRenamed("id", "other")
    with pytest.raises(Exception, match="differ in length"):
        order.zip_strict(a, b, "pos", "other").collect()


def test_concat_moves_positions(spark):
    a, b = spark.createDataFrame([(0, "a"), (5, "b")], "pos long, t string"), spark.createDataFrame([(0, "c")], "pos long, t string")
    assert sorted(rows(order.concat(a, b, b))) == [(0, "a"), (5, "b"), (6, "c"), (7, "c")]
    assert sorted(rows(order.concat(a.limit(0), b))) == [(0, "c")]


def test_rows_find_their_shard(spark):
    shards = spark.createDataFrame([(0, 3), (1, 0), (2, 10)], "shard long, rows long")
    got = sorted(rows(order.locate(spark.range(13).withColumnRenamed("id", "row_id"), order.shard_index(shards), width=4).select("row_id", "shard", "place")))
    assert got == [(i, 0, i) if i < 3 else (i, 2, i - 3) for i in range(13)]


def test_seeded_choice_begins_anew(spark):
    got = rows(order.seeded_choice(spark.range(3), "id", 7, 1).select("n", "id"))
    assert [n for n, _ in sorted(got)] == list(range(7)) and sorted(i for n, i in got if n < 3) == [0, 1, 2]
    assert sorted(got) == sorted(rows(order.seeded_choice(spark.range(3).repartition(3), "id", 7, 1).select("n", "id")))


def test_tasks_of_candidates(spark):
    tasks = spark.createDataFrame([("a", 0, "old"), ("a", 1, "new")], "task_id string, pos int, prompt string")
    one = lambda t: prefer.with_tasks(spark.createDataFrame([(t, 0)], "task_id string, sample_index int"), tasks, "pos")
    assert rows(one("a").select("prompt")) == [("new",)]
    with pytest.raises(Exception, match="no task"):
        one("b").collect()


def test_checkpoints_of_ties_and_nulls(spark):
    df = spark.createDataFrame([("r", None, 1.0, None, "a"), ("r", 2, 1.0, 0.5, "b"), ("r", 3, None, 0.5, "c")], "run string, step long, loss double, rate double, path string")
    assert rows(report.chosen_checkpoints(df, "run", "step", "loss", "rate", "path")) == [("r", "c", "a", "b")]


def test_sources_run_only_if_allowed(spark):
    df = spark.createDataFrame([("while True: pass",), ("print(2)",)], "s string")
    with pytest.raises(PermissionError):
        code.run_sources(df, "s", 1.0)
    assert sorted(rows(code.run_sources(df, "s", 2.0, allow=True).select("timed_out", "return_code", "output"))) == [(False, 0, "2\n"), (True, None, "")]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_in_archives(spark, tmp_path):
    (tmp_path / "o.zip").write_bytes(zipped({"a/manifest.json": b"{}", "a/bundle.zip": zipped({"r.json": b"[1]"})}))
    (tmp_path / "p.zip").write_bytes(b"no archive")
    got = rows(archives.nested(spark, str(tmp_path / "*.zip")).select(F.regexp_replace("archive", "^.*/(?=[op].zip)", ""), "path", F.decode("content", "UTF-8")))
    assert set(got) == {("o.zip", "a/manifest.json", "{}"), ("o.zip!a/bundle.zip", "r.json", "[1]"), ("p.zip", None, None)} and len(got) == 3
    entries = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    archives.bundle(entries, f"{tmp_path}/made.zip")
    assert zipfile.ZipFile(tmp_path / "made.zip").namelist() == ["a", "b"]


def test_lock_is_held_and_taken_over(tmp_path):
    lock = lineage.Lock(tmp_path / "artifact")
    assert lock.acquire("f") and not lineage.Lock(tmp_path / "artifact").acquire("f")
    holder = tmp_path / "artifact/.lock/holder.json"
    gone = 2**22 + 1  # above the largest process number
    holder.write_text(holder.read_text().replace(str(os.getpid()), str(gone)))
    assert lineage.Lock(tmp_path / "artifact").acquire("f")
    lock.release()
    assert lock.acquire("g")


def test_grid():
    assert [m["name"] for m in lineage.grid({"a": [1, 2], "b": [3]}, "{a}-{b}")] == ["1-3", "2-3"]


def test_fingerprints_of_rows_are_those_of_stages(spark):
    configs = [{"k": 1, "name": "a"}, {"k": -2, "name": 'with "quotes" and 100%'}]
    from textloom.sources.readers import canonical_json

    df = spark.createDataFrame([(canonical_json(c),) for c in configs], "config string")
    df = df.withColumn("a", lineage.fingerprint_of("a", F.col("config"), {})).withColumn("c", lineage.fingerprint_of('c "%s"', F.col("config"), {"b": F.col("a"), "a": F.col("a")}, 3))
    for c, r in zip(configs, df.collect(), strict=True):
        a = lineage.fingerprint("a", c, {})
        assert (r["a"], r["c"]) == (a, lineage.fingerprint('c "%s"', c, {"a": a, "b": a}, 3))


def test_sweeps_have_all_values_and_names(spark):
    got = rows(lineage.swept(spark.range(2), {"d": [2, 4], "w": ["x"]}, "run{id}-{d}_{w}").select("id", "d", "w", "name"))
    assert sorted(got) == [(i, d, "x", f"run{i}-{d}_x") for i in range(2) for d in (2, 4)]
    assert [m["name"] for m in lineage.grid({"d": [2, 4]}, "d{d}")] == ["d2", "d4"]


def test_archives_are_made_of_rows(spark):
    df = spark.createDataFrame([("a.zip", "2", b"two"), ("a.zip", "1", b"one"), ("b.zip", "x", None)], "archive string, path string, content binary")
    made = archives.zipped(df, "archive")
    assert sorted(rows(archives.nested_in(made).select("archive", "path", F.decode("content", "UTF-8"), "damaged"))) == [("a.zip", "1", "one", None), ("a.zip", "2", "two", None), ("b.zip", "x", "", None)]
    assert archives.nested_in(made.withColumn("content", F.lit(None).cast("binary"))).count() == 0
