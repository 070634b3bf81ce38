"""The pipeline on small tables: each stage against a brute-force version of what it has to leave."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import language_id, quality
from textloom.session import table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, low(t))


def distance(a, b, most=2):
    """Edit distance, or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def lines_left(docs):
    """(id, text) of documents without repeated lines, and without those that lose all."""
    seen, long, out = set(), [], []
    for d, t in docs:
        kept = []
        for line in (t or "").split("\n") if t else []:
            first = line not in seen
            near = first and len(line) >= 20 and any(abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for o in long)
            if not line or first and not near:
                kept.append(line)
            if line and first:
                seen.add(line)
                if len(line) >= 20:
                    long.append(line)
        new = t and "\n".join(kept)
        if not (t or "").strip(" ") or new.strip(" "):
            out.append((d, new))
    return out


def one_of_each(docs):
    """Documents without those whose component has a smaller id."""
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def without_items(docs, items):
    """(id, text) of documents under a twentieth of hit words, without runs of 13 or more of them."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = {}
    for x in items:
        b = words(x, pattern)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if b else ():
            grams.setdefault(n, set()).add(tuple(b[i : i + n]))
    out = []
    for d, t in docs:
        spots = [m.span() for m in re.finditer(pattern, low(t))]
        w = [low(t)[a:b] for a, b in spots]
        hit = [False] * len(w)
        for n, known in grams.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit[i : i + n] = [True] * n
        if any(hit) and 20 * sum(hit) >= len(w):
            continue
        new, at, i = "", 0, 0
        while i < len(w):
            j = i
            while j < len(w) and hit[j]:
                j += 1
            if j - i >= 13:
                new, at = new + t[at : spots[i][0]], spots[j - 1][1]
            i = max(j, i + 1)
        out.append((d, t and new + t[at:]))
    return out


def test_stages_are_brute_force(spark):
    docs = table(spark, DIR)
    labels = table(spark, DIR, "labels").where(language_id.fold("doc_id", 3) != 1)
    stay = {r["doc_id"] for r in quality.predict(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    columns, get = docs.columns, lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    before = get(docs)
    first = pipeline.keep_quality(spark, docs, DIR).cache()
    assert get(first) == [x for x in before if x[0] in stay] and 0 < len(stay) < len(before)
    second = pipeline.drop_lines(spark, first, DIR).cache()
    assert get(second) == lines_left(get(first))
    third = pipeline.drop_copies(spark, second, DIR).cache()
    kept = one_of_each(get(second))
    assert get(third) == [x for x in get(second) if x[0] in kept]
    fourth = pipeline.drop_benchmark(spark, third, DIR).cache()
    assert get(fourth) == without_items(get(third), [r["text"] for r in table(spark, DIR, "benchmark").collect()])
    for df in (first, second, third, fourth):
        assert df.columns == columns and df.where("n_chars != length(text)").count() == 0
    last = pipeline.mix_sources(spark, fourth, DIR)
    rows = last.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == get(fourth) and set(columns) < set(last.columns)
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] == sum(p["n"] for p in r["placements"]) <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    for df in (first, second, third, fourth):
        df.unpersist()


def test_run_is_the_stages(spark):
    docs = table(spark, DIR)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert sorted(map(str, docs.collect())) == sorted(map(str, pipeline.run(spark, DIR).collect()))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null ids, texts and sources, empty and repeated rows, a very long text, and an empty table."""
    good = " ".join(f"sentence{i % 97} of words{i % 89} that goes on{i}" for i in range(60))
    rows = [(None, good, None, None, 1), (None, None, "en", "a", None), (1, "", None, "a", 0), (1, "   ", None, None, 3), (2, good + " twice", "en", "a", 1), (2, good + " twice", "en", "a", 1), (3, " ".join(f"w{i}" for i in range(200_000)), None, "b", 9), (4, "one two", None, "b", 7), (4, "three four", None, None, 10)]
    docs = spark.createDataFrame(rows, DOCS)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, DIR)
            n = out.count()
            assert n <= df.count() and (k == 4 or out.columns == docs.columns), name
            assert n or k == 0 or df is not docs, name
    wider = docs.withColumn("row", F.lit(1)).withColumn("key", F.lit("x")).withColumn("size", F.lit(2)).withColumn("c0", F.lit(3))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, wider, DIR).columns == wider.columns, name
    assert {(r["doc_id"], r["text"]) for r in pipeline.drop_lines(spark, docs, DIR).collect()} == {(None, good), (None, None), (1, ""), (1, "   "), (2, good + " twice"), (3, rows[6][1]), (4, "one two"), (4, "three four")}
    assert pipeline.drop_copies(spark, docs, DIR).count() == len(rows) - 1  # of the two equal rows of id 2 one stays


def test_benchmark_passages_do_not_stay(spark, monkeypatch):
    item = table(spark, DIR, "benchmark").where("size(split(text, ' ')) >= 14").select("text").first()[0]
    other = "ü\n" + " ".join(f"ownword{i}" for i in range(900))
    rows = [(1, item, None, None, 5), (2, f"{other} é {item}, ö {item} {other}", None, None, 5), (None, f"{item}\n{other} {other}", None, None, 5), (4, other, None, None, 5), (4, None, None, None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    for most in (pipeline.decontaminate.BLOCK_WORDS, 100):
        monkeypatch.setattr(pipeline.decontaminate, "BLOCK_WORDS", most)
        out = pipeline.drop_benchmark(spark, docs, DIR)
        got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
        assert out.columns == docs.columns and len(got) == 4 and (4, other, len(other)) in got and (4, None, 5) in got
        for d, t, n in got - {(4, None, 5)}:
            assert t.count("ownword899") == (1 if d == 4 else 2) and n == len(t) and d != 1
        found = pipeline.decontaminate.matches(out, table(spark, DIR, "benchmark"))
        assert found.where("exists(spans, s -> s.last - s.first + 1 >= 13)").count() == 0


def test_plans_are_narrow(spark, monkeypatch):
    """The driver holds, all at once, what belongs to the exchanges of a plan."""
    wide, written = {}, pipeline.ngram_join.written

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    def seen(df, name):
        wide[name] = max(exchanges(df), wide.get(name, 0))
        return written(df, name)

    for module in (pipeline.ngram_join, pipeline.mixing):
        monkeypatch.setattr(module, "written", seen)
    docs = table(spark, DIR).limit(60)
    for stage in (pipeline.drop_copies, pipeline.mix_sources):
        wide[stage.__name__] = exchanges(stage(spark, docs, DIR))
    assert max(wide.values()) <= 16, wide
