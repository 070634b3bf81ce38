"""The registered queries over the smallest tables: against SQL where there is some, else against brute force or held-out labels."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from textloom.llm import oracles, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, DIR), duck.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def held(d, parts, rest):
    return zlib.crc32(str(d).encode()) % parts == rest


def test_languages_of_held_documents(spark, duck):
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    got = queries.op3_language_id(spark, DIR).collect()
    assert len(got) == len(lang) and all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in got)
    asked = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in asked) >= 0.9 * len(asked) > 0


def test_quality_of_held_documents(spark, duck):
    label = dict(duck.sql("select doc_id, max(quality) from labels group by 1").fetchall())
    got = queries.op7_quality(spark, DIR).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    good, bad = ([r["score"] for r in got if r["held_out"] and label.get(r["doc_id"]) == k] for k in (1, 0))
    assert good and bad and np.mean([x > y for x in good for y in bad]) > 0.9


def test_model_scores_beat_the_base(spark):
    got = [r for r in queries.op5_lm_score(spark, DIR).collect()]
    own = [r for r in got if r["held_out"]]
    assert own and sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_neighbours_of_the_table(spark, duck):
    rows = duck.sql("select vec_id, embedding from embeddings").fetchall()
    x, ids = np.array([r[1] for r in rows], np.float32).astype(float), [r[0] for r in rows]
    found = defaultdict(list)
    for r in sorted(queries.op8_nearest(spark, DIR).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    hits = total = 0
    for q, i in enumerate(ids):
        if i % 20 == 0:
            s = (x * x[q]).sum(axis=1)
            want = [ids[k] for k in sorted(range(len(ids)), key=lambda k: (-s[k], ids[k])) if k != q][:20]
            assert len(found[i]) == 20
            hits, total = hits + len(set(want) & set(found[i])), total + 20
    assert hits >= 0.9 * total > 0


def test_mix_of_the_table(spark):
    by = defaultdict(list)
    for r in queries.op4_mix_sources(spark, DIR).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"] and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.5


def test_licenses_of_the_table(spark, duck):
    """Every line that is a notice word for word is found."""
    from textloom.llm import license_scan

    found = {r["doc_id"]: set(r["licenses"].split(",")) for r in queries.op6_license_scan(spark, DIR).collect()}
    notices = {t.lower().strip(" ."): n for n, texts in license_scan.TEMPLATES.items() for t in texts}
    asked = [(d, notices[line.lower().strip(" .")]) for d, t in duck.sql("select doc_id, text from documents").fetchall() for line in (t or "").split("\n") if line.lower().strip(" .") in notices]
    assert asked and all(n in found[d] for d, n in asked)
