"""Small cases and brute-force versions of the training-data operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from textloom.llm import ann, decontaminate, language_id, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def plain(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w]


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages, nulls, empties and one long text."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocab) for _ in range(20))
    out = [None, "", "   ", "one", "One", "two words", "a b c d", " ".join(rnd.choice(vocab) for _ in range(9000))]
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.3 and len(out) > 20:
            w = (rnd.choice(out[8:]) or "x").split(" ")
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
        elif kind < 0.5:
            out.append(" ".join(rnd.choice(vocab) for _ in range(8)) + "\n" + passage)
        else:
            out.append("\n".join(" ".join(rnd.choice(vocab).title() for _ in range(rnd.randrange(1, 12))) + "." for _ in range(rnd.randrange(1, 7))))
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(5)


def test_decontamination_is_brute_force(spark):
    docs = corpus()
    items = [(1, docs[9][1]), (2, "two words"), (3, "one"), (4, None), (5, "!!"), (6, docs[7][1][:400]), (6, docs[7][1][:400])]
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    for d, t in docs:
        w, hit, found = alnum(t), set(), set()
        for k, x in items:
            b = alnum(x)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(k))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"], got[d]["items_sha256"]) == (len(w), len(hit), len(found), sha), d
        assert got[d]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_in_blocks_and_cut(spark, monkeypatch):
    docs, bench = frame(spark, corpus()), spark.createDataFrame([(1, corpus()[9][1]), (2, corpus()[12][1])], "item_id long, text string")
    whole = decontaminate.digest(decontaminate.matches(docs, bench)).collect()
    kept = {r[0] for r in decontaminate.clean(docs, bench).select("doc_id").collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    parts = decontaminate.digest(decontaminate.matches(docs, bench)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    assert kept == {r["doc_id"] for r in whole if not r["contaminated"]} == {r[0] for r in decontaminate.clean(docs, bench).select("doc_id").collect()}
    found = decontaminate.matches(docs, bench)
    out = decontaminate.cut(docs, found, 13, 2.0)
    assert decontaminate.judged(decontaminate.matches(out, bench)).where("n_hit >= 13").count() == 0


def test_decontamination_in_blocks_keeps_rows_apart(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(None, item), (None, "clean words"), (None, None), (5, item + " and more"), (5, "other words"), (5, "other words"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "something else here"), (3, "and more")], "item_id long, text string")
    got = []
    for words in (decontaminate.BLOCK_WORDS, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        found = decontaminate.digest(decontaminate.matches(docs, bench)).collect()
        got.append((sorted(map(str, found)), sorted(map(str, decontaminate.clean(docs, bench).collect()))))
        assert len(found) == len(rows) and len(got[-1][1]) == len(rows) - 2
    assert got[0] == got[1]


def test_many_items_of_the_same_words_are_one(spark):
    """100,000 copies of a short item and 20,000 of a long one: an occurrence costs as much as one's, and all ids are listed."""
    long_ = " ".join(f"w{i}" for i in range(20))
    items = [([k], b"a b c") for k in range(100_000)] + [([-k], b"A, b c!") for k in range(1, 4)] + [([10**6 + k], long_.encode()) for k in range(20_000)] + [([None], b"b c")]
    block = decontaminate.Automaton(items)
    assert sorted(map(len, block.names)) == [0, 20_000, 100_003] and all(len(s) <= 2 for s in block.short) and all(len(s) == 1 for s in block.of.values())
    bench = spark.createDataFrame([(k[0], t.decode()) for k, t in items], "item_id long, text string")
    docs = [(1, "a b c " * 5000), (2, f"x {long_} " * 50), (3, "b c d"), (4, None)]
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.matches(frame(spark, docs), bench)).collect()}
    assert [(got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"]) for d in (1, 2, 3, 4)] == [(15_000, 15_000, 100_003), (1050, 1000, 20_000), (3, 2, 0), (0, 0, 0)]


def test_fifty_blocks_are_one_after_the_other(spark, monkeypatch):
    docs = corpus()
    items = [(i, t) for i, t in docs[7:57]] + [(99, docs[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.digest(decontaminate.matches(frame(spark, docs), bench)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    sent = []
    real = decontaminate._sent
    monkeypatch.setattr(decontaminate, "_sent", lambda *a: sent.append(real(*a)) or sent[-1])
    assert sorted(map(str, decontaminate.digest(decontaminate.matches(frame(spark, docs), bench)).collect())) == whole
    # A block of one item each; what has been sent of it is gone when the next one is.
    assert 40 < len(sent) <= len(items)


def test_lines_of_a_very_long_text(spark):
    """Half a million lines in one text, of which every other one stays."""
    lines = [f"this is line {i // 2 * 7} of a long text" for i in range(500_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:4]) + "\n\nshort")], "doc_id long, text string")
    names = [f"c{i}" for i in range(2)]
    rows = docs.toDF(*names).withColumn("row", F.monotonically_increasing_id())
    places = rows.select("row", F.when(F.col("c0") == 1, F.expr("transform(sequence(0, 249999), i -> 2 * i)")).otherwise(F.array().cast("array<int>")).alias("places"))
    kept = line_dedup.without(rows.join(places, "row"), "c1", 20)
    got = {r["c0"]: r["c1"] for r in kept.collect()}
    assert got == {1: "\n".join(lines[::2]), 2: "\nshort"}


def test_one_of_the_documents_that_share_an_id_teaches(spark, monkeypatch):
    from textloom.llm import _subword

    held = []
    real = _subword.gather
    monkeypatch.setattr(quality._subword, "gather", lambda rows, *a, **b: held.append(rows.count()) or real(rows, *a, **b))
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(5000)] + [(2, "bad words"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is not None and held == [3]


def components(docs):
    sets = {}
    for d, t in docs:
        w = plain(t)
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
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("most", "square"), [(20, 1024), (0, 3)])
def test_ngram_join_is_brute_force(spark, monkeypatch, most, square):
    monkeypatch.setattr(ngram_join, "MOST_COMBINED", most)
    monkeypatch.setattr(ngram_join, "SQUARE", square)
    docs = corpus(5, 160)
    profile, _, classes = ngram_join.join(frame(spark, docs))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.labelled(profile, classes).collect()}
    assert got == components(docs)
    kept = {r[0] for r in ngram_join.distinct(frame(spark, docs)).select("doc_id").collect()}
    assert kept == {d for d, (n, c) in components(docs).items() if c == d}


def test_texts_without_an_id_link_others(spark):
    w = [f"w{i}" for i in range(60)]
    changed = lambda i: " ".join([*w[:i], "other", *w[i + 1 :]])
    rows = [(7, changed(4)), (None, " ".join(w)), (None, " ".join(w)), (9, changed(55)), (3, "nothing like it at all here"), (None, None)]
    profile, _, classes = ngram_join.join(frame(spark, rows))
    got = ngram_join.labelled(profile, classes).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 56, 7), (0, 56, 7), (3, 2, 3), (7, 56, 7), (9, 56, 7)]
    alone = ngram_join.join(frame(spark, [(7, changed(4)), (9, changed(55))]))
    assert {r["component_id"] for r in ngram_join.labelled(alone[0], alone[2]).collect()} == {7, 9}


def test_ngram_join_of_rows_that_share_an_id(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(-5, w), (-5, w + " more"), (-(1 << 62), "a b c d e f g"), (4, w), (4, "other words than these all the time"), (4, None), (9, ""), (None, "lone text without any id at all")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, key int, n int, component int")
    profile, _, classes = ngram_join.join(docs)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.labelled(profile, classes).collect())
    assert got == sorted([("-5", 56, "-5"), ("-5", 57, "-5"), (str(-(1 << 62)), 3, str(-(1 << 62))), ("4", 56, "-5"), ("4", 3, "4"), ("4", 0, "4"), ("9", 0, "9"), ("None", 3, "None")])
    out = ngram_join.distinct(docs)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == 6 and {*kept} >= {(-(1 << 62), "a b c d e f g"), (4, rows[4][1]), (4, None), (9, ""), rows[-1]}
    assert len({(-5, w), (-5, w + " more")} & {*kept}) == 1


def test_a_text_that_shares_its_id_is_not_lost(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b + " and"), (3, "c d e f g h"), (4, a), (4, a), (5, "m n o p q r"), (5, "m n o p q r"), (None, a), (None, b)]
    kept = ngram_join.distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(str(Row(doc_id=d, text=t)) for d, t in [(1, a), (2, b), (3, "c d e f g h"), (5, "m n o p q r"), (None, a), (None, b)])


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, ngram_join.components(links).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def edited(rnd, s, k):
    s = list(s)
    for _ in range(k):
        i, o = rnd.randrange(len(s)), rnd.random()
        if o < 0.33:
            s[i] = rnd.choice("abcé")
        elif o < 0.66:
            s.insert(i, rnd.choice("abcé"))
        elif len(s) > 8:
            s.pop(i)
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd, pairs = random.Random(1), []
    while len(pairs) < 200:
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(2 * edits + 2, 30)))
        b = edited(rnd, a, rnd.randrange(0, edits + 3))
        if abs(len(a) - len(b)) <= edits and len(b) >= 2 * edits + 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "split(a, '') x", "split(b, '') y").selectExpr("a", "b", line_dedup.edit_distance("x", "y", edits) + " d")
    assert all(min(levenshtein(a, b), edits + 1) == min(d, edits + 1) for a, b, d in df.collect())


def test_line_dedup_is_brute_force(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(8, 14))) for _ in range(60)]
    lines = [edited(rnd, rnd.choice(base), rnd.randrange(0, 4)) for _ in range(150)] + ["x"] * 5
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(52)] + [(90, None), (91, "")]
    every = [(d, p, x) for d, t in docs if t for p, x in enumerate(t.split("\n")) if len(x) >= 6]
    want = {d: t and "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < 6 or not any((e, q) < (d, p) and levenshtein(x, y) <= 2 for e, q, y in every)) for d, t in docs}
    df = frame(spark, docs)
    assert {r[0]: r[1] for r in line_dedup.dedup(df, 2, 6).select("doc_id", "text").collect()} == want
    left = {d: sum(len(x) for x in (t or "").split("\n") if len(x) >= 6) for d, t in want.items()}
    assert {r["doc_id"]: r["kept_chars"] for r in line_dedup.digest(df, 2, 6).collect()} == left


def test_exact_copies_of_short_lines_go(spark):
    long = "a line of more than twenty characters"
    docs = [(1, f"Notes\n{long}\n\n- x\nNotes"), (2, f"- x\n\nnotes\n{long}"), (3, "Notes"), (4, None), (5, "")]
    df = frame(spark, docs)
    assert {r[0]: r[1] for r in line_dedup.dedup(df, short=True).select("doc_id", "text").collect()} == {1: f"Notes\n{long}\n\n- x", 2: "\nnotes", 3: "", 4: None, 5: ""}
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.digest(df, short=True).collect()}
    assert got == {1: (5, 1, 1, 0, len(long)), 2: (4, 1, 2, 0, 0), 3: (1, 0, 1, 0, 0), 4: (0, 0, 0, 0, 0), 5: (0, 0, 0, 0, 0)}


def test_lines_by_large_keys_and_joins(spark, monkeypatch):
    """Common segments in squares of blocks, keys and names that are not broadcast: the same result."""
    rnd = random.Random(9)
    lines = ["head of a common line " + "".join(rnd.choice("ab") for _ in range(12)) for _ in range(90)]
    df = frame(spark, [(i, "\n".join(rnd.choice(lines) for _ in range(4))) for i in range(40)])
    want = sorted(map(tuple, line_dedup.digest(df).collect()))
    assert sum(r[4] for r in want)
    monkeypatch.setattr(line_dedup, "SQUARE", 7)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, line_dedup.digest(df).collect())) == want


def test_lines_of_rows_that_share_an_id(spark):
    line, other = "a line of more than twenty characters", "another line of more than twenty"
    rows = [(1, f"{line}\n{other}", "a"), (1, f"{line}\n{other}", "a"), (None, other, "b"), (None, None, "c"), (2, "", "d"), (3, "z" * 70_000 + "\n" + line, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    got = line_dedup.digest(df).collect()
    assert sorted(((r["doc_id"] or 0, r["n_long"], r["n_copies"], r["kept_chars"]) for r in got)) == [(0, 0, 0, 0), (0, 1, 0, len(other)), (1, 2, 1, len(line)), (1, 2, 2, 0), (2, 0, 0, 0), (3, 2, 1, 70_000)]
    out = line_dedup.dedup(df)
    assert out.columns == df.columns and sorted(str(r["text"]) for r in out.collect() if r["doc_id"] == 1) == ["", line]
    assert sorted(map(str, (r["text"] for r in out.where("doc_id is null").collect()))) == ["None", other]


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://a.example.net/en/1", "https://EXAMPLE.com/de/", "http://notexample.com/de/", "http://w.org/fr/x?y#z", "http://a.net", "nothing", None, "", "http://net/?q"]
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [got[i][2] for i in range(10)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, "net/"]
    assert got[4][:2] == ("w.org", "/fr/x") and got[7][:2] == ("", "") and got[1][3] == "allow"


def test_many_url_rules_are_joined(spark, monkeypatch):
    """Rules beyond what is broadcast give what the trie gives, and both what the definition says."""
    rnd = random.Random(7)
    hosts = ["net", "example.net", "a.example.net", "org", "w.org", "", "x.", "EXAMPLE.com"]
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(hosts) + rnd.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/b/c/d"])) for _ in range(40)]
    urls = [rnd.choice(["http://", "https://", "", "x://"]) + rnd.choice([*hosts, "b.a.example.net", "other.com", "notexample.net"]) + rnd.choice(["", "/", "/a/b/c", "/ab", "/abc?x=/a", "/b/c/de#f", "?q/a"]) for _ in range(200)] + [None, "", "http://"]
    pages = spark.createDataFrame([(i % 180, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    by_trie = sorted(map(str, url_filter.judge(pages, rules, "none").collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 3)
    got = url_filter.judge(pages, rules, "none").collect()
    assert sorted(map(str, got)) == by_trie and len(got) == len(urls)
    for r in got:
        fits = []
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            host, path = low(host), slash + rest
            if (r["host"] == host or r["host"].endswith("." + host)) and r["path"].startswith(path):
                fits.append((-len(host.split(".")), -len(path), verdict != "allow", rule, verdict))
        assert (r["rule"], r["verdict"]) == ((min(fits)[3], min(fits)[4]) if fits else (None, "none"))


def test_licenses_of_odd_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.\n" * 3), (2, "word " * 300_000 + "\nReleased under the BSD 2-Clause License."), (3, None)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, matches string")
    got = sorted((str(r["doc_id"]), r["n_lines"], len(r["matches"])) for r in license_scan.scan(df).collect())
    assert [g[:2] for g in got] == [("1", 1), ("1", 1), ("2", 2), ("3", 0), ("None", 4)] and got[0] == got[1] and got[2][2] == 1 and got[3][2] == 0 and got[4][2] >= 3


def test_license_lines(spark):
    docs = [(0, "words here\nReleased under the MIT license\nmore"), (1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "nothing of the kind")]
    got = {r["doc_id"]: [(m["line"], m["license"]) for m in r["matches"]] for r in license_scan.scan(frame(spark, docs)).collect()}
    assert got == {0: [(1, "MIT")], 1: [(-1, "Apache-2.0"), (0, "Apache-2.0")], 2: [], 3: [], 4: []}


def test_license_texts_wrapped_and_inner_notices(spark):
    full = license_scan.templates_of_all()["MIT"][-1]
    wrapped = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    docs = [
        (0, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(full, 12)),
        (1, "some words before " * 12 + "\n" + wrapped(license_scan.TEMPLATES["ISC"][0], 7) + "\nand after"),
        (2, "Copyright 2021 Some One and others. Released under the MIT License. See the file for more of it."),
        (3, "x " * 3000 + "\n" + wrapped(license_scan.templates_of_all()["GPL-3.0"][-1], 11) + "\n" + "y " * 3000),
        (4, "the " * 50 + "of the software without any of the terms of the license to the public " * 9),
        (5, "a Released under the MIT License. " + "z " * 30 + "Released under the BSD 2-Clause License."),
    ]
    got = {r["doc_id"]: [(m["line"], m["last"], m["license"]) for m in r["matches"]] for r in license_scan.scan(frame(spark, docs)).collect()}
    assert (-1, -1, "MIT") in got[0] and got[1] == [(1, 5, "ISC")] and got[2] == [(0, 0, "MIT")] and got[4] == []
    assert [(a, c) for a, _, c in got[3] if a == 1] == [(1, "GPL-3.0")] and {c for _, _, c in got[3]} == {"GPL-3.0"}
    assert got[5] == [(0, 0, "MIT"), (0, 0, "BSD-2-Clause")]


def test_license_windows_are_brute_force():
    rnd, names = random.Random(5), {"A": ["a b c a b d"], "B": ["c c b a"], "C": ["d a"]}
    index = license_scan.Templates(names, 0.8)
    for _ in range(60):
        w = [rnd.choice("abcdx") for _ in range(14)]
        t = " ".join(w).encode()
        got = index.windows(license_scan.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), license_scan.ALNUM))
        best = {}
        for name, (x,) in names.items():
            bag = Counter(zip(x.split(), x.split()[1:]))
            for i in range(14):
                for j in range(i + 2, 15):
                    n = Counter(zip(w[i:j], w[i + 1 : j]))
                    c = sum((n & bag).values())
                    if (s := 2 * c / (n.total() + bag.total())) >= 0.8:
                        best[i, j - 1, name] = (c * s, s)
        for _, a, b, s, name in got:
            assert abs(best[a, b, name][1] - s) < 1e-9
        assert bool(got) == bool(best) and (not best or any(abs(best[a, b, n][0] - max(best.values())[0]) < 1e-9 for _, a, b, _, n in got))
        assert all(not (x[2] >= y[1] and y[2] >= x[1]) for i, x in enumerate(got) for y in got[:i])
        assert all(any(a <= q and b >= p for _, p, q, _, _ in got) for a, b, _ in best)


def test_mix_targets_and_repeats(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 90)), None, rnd.choice(["a", "b", "c", "d", None]), None) for i in range(200)] + [(500, "x " * 5000, None, "e", None), (501, None, None, "f", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.digest(df).collect()
    size, weight = Counter(), [5, 2, 1]
    for _, t, _, s, _ in rows:
        size[s] += len(plain(t))
    names = sorted([s for s in size if s], key=lambda s: s.encode()) + [None]
    w = {s: weight[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while True:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        free -= over
    target |= {s: level * w[s] for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(df.repartition(7)).collect()))
    put = mixing.placed(df).collect()
    assert sum(r["taken"] for r in put) == sum(taken.values()) and all(sum(p["n"] for p in r["placements"]) == r["taken"] for r in put)
    assert Counter((r["doc_id"], r["taken"]) for r in put) == Counter((r["doc_id"], r["taken"]) for r in got)
    for r in put:  # no word of a document is taken more than three times
        times = Counter(w for p in r["placements"] for w in range(p["at"], p["at"] + p["n"]))
        assert all(v <= 3 for v in times.values()) and all(0 <= w < r["size"] for w in times)


def test_mix_shards_are_full_draws(spark):
    by = spark.createDataFrame([(0, "a", 30_000, 52_000.0), (1, "b", 9_000, 27_000.0), (2, "c", 50_000, 10_000.0), (3, "d", 3, 2.57), (4, "e", 100, 64.0), (5, None, 0, 0.0)], "sid long, source string, source_size long, target double")
    got = mixing.slots(by, 64, 100).collect()
    shards = Counter(r["shard"] for r in got)
    last = max(shards)
    assert all(n == 100 for s, n in shards.items() if s < last) and sorted((r["shard"], r["place"]) for r in got) == [(i // 100, i % 100) for i in range(len(got))]
    words = Counter()
    for r in got:
        size = {0: 30_000, 1: 9_000, 2: 50_000, 3: 3, 4: 100}[r["sid"]]
        assert 0 <= r["block"] * 64 < size
        words[r["sid"]] += min(r["most"], size - r["block"] * 64)
    assert words == {0: 52_000, 1: 27_000, 2: 10_000, 3: 3, 4: 64}
    whole = [r for r in got if r["sid"] == 1]
    assert Counter(r["block"] for r in whole) == {b: 3 for b in range(141)}
    # Sources are spread over the shards: the counts of the first are near its share everywhere.
    own = Counter(r["shard"] for r in got if r["sid"] == 0)
    share = sum(own.values()) / len(got)
    assert all(abs(own[s] / 100 - share) < 0.2 for s in range(last)) and len({own[s] for s in range(last)}) > 1


def test_mix_counts_of_shards_follow_their_law(spark):
    """A shard's counts of the sources are those of a draw of its places out of all slots: mean and variance over 100 shards, and between sources."""
    sources = spark.createDataFrame([(0, 200_000, 64.0 * 3200), (1, 90_000, 64.0 * 1920), (2, 90_000, 64.0 * 1280)], "sid long, source_size long, target double")
    for seed in (0, 1, 2):
        got = mixing.slots(sources, 64, 64, seed).groupBy("shard", "sid").count().collect()
        n = {(r["shard"], r["sid"]): r["count"] for r in got}
        total, shards = sum(n.values()), max(s for s, _ in n)  # the last one may be short
        for sid in range(3):
            share = sum(n.get((s, sid), 0) for s in range(shards + 1)) / total
            spread = 64 * share * (1 - share) * (total - 64) / (total - 1)
            z = sum((n.get((s, sid), 0) - 64 * share) ** 2 for s in range(shards)) / spread
            assert 55 < z < 155, (seed, sid, z)  # chi-square of about 99 degrees: a thousandth lies outside on either side
        a, b = ([n.get((s, sid), 0) for s in range(shards)] for sid in (0, 1))
        assert np.corrcoef(a, b)[0, 1] < -0.4  # -0.65 by the law


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d", None, "s", 0), (1, "a b", None, "s", 0), (1, "a b", None, "s", 0), (None, "x y z", None, None, 0), (None, None, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    for got in (mixing.digest(df).collect(), mixing.placed(df).collect()):
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter([(1, 4), (1, 2), (1, 2), (None, 3), (None, 0)])
        assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mix_does_not_follow_files_and_tasks(spark, tmp_path):
    """The same rows in one file or many, in any order, under two sizes of splits and numbers of shuffle partitions: the same words are taken."""
    docs = [(d if d % 13 else None, t, None, "ab"[d % 2] if d % 5 else None, 0) for d, t in corpus(8, 300)]
    docs += docs[40:60] + [(7, "again and again", None, "a", 0)] * 50
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(one)
    spark.createDataFrame(docs[::-1], DOCS).repartition(9).write.parquet(many)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    found, placed = [], []
    try:
        for path, split, parts in ((one, "128m", "4"), (one, "20k", "7"), (many, "3k", "3")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.read.parquet(path)
            found.append(sorted(str(tuple(r)) for r in mixing.digest(df).collect()))
            placed.append(sorted(str(tuple(r)) for r in mixing.placed(df).collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(docs)
    assert placed[0] == placed[1] == placed[2]


def neighbours(x, ids, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        out[ids[q]] = [(ids[i], s[i]) for i in sorted(range(len(x)), key=lambda i: (-s[i], ids[i])) if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize(("cell", "block", "query_block"), [(4096, 8192, 2048), (300, 200, 7), (100, 20, 3)])
def test_neighbours(spark, cell, block, query_block):
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(1200, 16))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)] + [(9000, None, "a"), (9020, [0.0] * 16, "a"), (9040, [float("nan")] * 16, "a"), (7, [float(v) for v in x[7]], "b"), (None, [1.0] * 16, "a"), (9060, [1.0, 2.0], "a"), (9061, [2.0, 1.0], "a"), (9061, [9.0, 1.0], "a"), (9080, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string").repartition(4)
    got = ann.nearest(df, cell=cell, block=block, query_block=query_block).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    want = neighbours(x, list(range(1200)), range(0, 1200, 20))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert set(found) == {*want, 9060} and hits / (20 * len(want)) >= 0.9 and all(len(found[q]) == 20 for q in want)
    assert [i for i, _ in found[100]] == list(range(101, 121)) and found[9060] == [(9061, 11.0)]
    for q in want:
        assert all(s == (x[i] * x[q]).sum() for i, s in found[q]) and found[q] == sorted(found[q], key=lambda r: (-r[1], r[0]))
    assert all(r["rank"] == i for q in found for i, r in enumerate(sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"]), 1))


def test_neighbours_are_verified_until_the_test_holds():
    """On a full block of points without structure under half of them are verified, and nine in ten neighbours at least are found."""
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    limit = ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS)
    search = ann.Search(x, [np.array([i]) for i in range(len(x))], 1.0, ann.projector(64, ann.DIMENSIONS, 5), limit)
    queries = range(0, 8192, 256)
    want = neighbours(x, list(range(len(x))), queries)
    hits = 0
    for q in queries:
        found, worst = search.nearest(x[q], q, 20)
        hits += len({i for _, i in found} & {i for i, _ in want[q]})
        assert worst <= want[q][-1][1] + 1e-9
    share = search.verified / len(queries) / len(x)
    print(f"verified {share:.2f}, recall {hits / 20 / len(queries):.3f}")
    assert share < 0.5 and hits >= 0.9 * 20 * len(queries)
    # A cluster far from the rest is all that is looked at.
    middle = x[0]
    near, rest = middle + 0.3 * x[:400], -middle + x[400:4400]
    both = np.concatenate([near / np.linalg.norm(near, axis=1)[:, None], rest / np.linalg.norm(rest, axis=1)[:, None]])
    search = ann.Search(both, [np.array([i]) for i in range(len(both))], 1.0, ann.projector(64, ann.DIMENSIONS, 5), limit)
    found, _ = search.nearest(both[7], 7, 20)
    assert search.verified <= 400 and all(i < 400 for _, i in found)


def test_chi_square_quantiles():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.95, 32) - 46.194) < 1e-3


def test_classifiers_learn_and_stand_empty(spark):
    rnd = random.Random(6)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "dos", "tres"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(8)), k, None, None) for i in range(120) for k in [rnd.choice(["xx", "yy"])]]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df)
    got = language_id.predict(spark.createDataFrame([(0, "beta gamma", None, None, None), (1, "tres uno", None, None, None), (2, "12 !", None, None, None), (3, None, None, None, None), (4, "", None, None, None)], DOCS), model)
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["xx", "yy", "und", "und", "und"]
    labels = df.select("doc_id", (F.col("lang") == "xx").cast("int").alias("quality"))
    q = quality.fit(df, labels)
    assert quality.predict(df, q).join(labels, "doc_id").where("predicted != quality").count() == 0
    assert quality.keep(df, q).count() == labels.where("quality = 1").count()
    odd = spark.createDataFrame([(1, "beta gamma", "p", 1), (1, "beta gamma", "p", 1), (1, "tres uno", "p", 1), (None, "beta", "p", 1), (2, None, "p", 1)], "doc_id long, text string, p string, key int")
    assert sorted(r["lang_pred"] for r in language_id.predict(odd, model).collect()) == ["und", "xx", "xx", "xx", "yy"]
    assert sorted(r["predicted"] for r in quality.predict(odd.where("text is not null"), q).collect()) == [0, 1, 1, 1] and quality.keep(odd.where("text is not null"), q).columns == odd.columns
    assert language_id.fit(df.limit(0)) is None and quality.fit(df, labels.limit(0)) is None
    assert language_id.predict(df, None).where("lang_pred = 'und'").count() == 120


#: Sentences of languages that the model learns, and of others.
SENTENCES = {
    "en": "the house by the river was old and the people who lived there knew every stone of it and would not leave",
    "de": "das haus am fluss war alt und die leute die dort wohnten kannten jeden stein und wollten nicht fort von hier",
    "es": "la casa junto al rio era vieja y la gente que vivia en ella conocia cada piedra y no queria marcharse nunca",
}


def _language_rows(n=360):
    rnd = random.Random(12)
    for i in range(n):
        lang = rnd.choice(list(SENTENCES))
        w = SENTENCES[lang].split()
        yield i, " ".join(rnd.choice(w) for _ in range(rnd.randrange(6, 40))), lang, None, None


def test_language_scores_can_be_used(spark):
    """Learned languages are told with scores short of certainty; shuffled letters and other languages are rejected."""
    model = language_id.fit(spark.createDataFrame(list(_language_rows()), DOCS))
    shuffled = "ehtu sohe yb ehrti vrei saw dlo dna eht lppeoe ohw vdiel hreet wnke yvere tnseo fo ti dna dulow ton aevel"
    polish = "dom nad rzeka byl stary a ludzie ktorzy tam mieszkali znali kazdy kamien i nigdy nie chcieli odejsc stad"
    texts = [*SENTENCES.values(), shuffled, polish, "qwx zkv jjq xxz vvk qqj zzx kkw", SENTENCES["en"] * 400]
    got = language_id.predict(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == list(SENTENCES) and not any(r["rejected"] for r in got[:3])
    assert all(0.8 < r["score"] < 0.9999 for r in got[:3]) and all(r["rejected"] and r["score"] < 0.8 for r in got[3:6])
    assert got[6]["lang_pred"] == "en" and not got[6]["rejected"]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 400)
    rnd = random.Random(5)
    words = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(25)}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(12)), k, None, None) for i, k in enumerate([*words] * 30)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df, epochs=20)
    assert model.weight is not None and model.labels == sorted(words)
    got = language_id.predict(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 0.95 * len(rows)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    """Pieces and parts of sums give what the whole text gives but for the n-grams across cuts."""
    from textloom.llm import _subword

    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(4000)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    features = _subword.Features(gram_bits=10, word_bits=10)
    model = _subword.Model(features, ["a", "b"], np.random.Generator(np.random.PCG64(1)).normal(size=(features.size, 2)).astype(np.float32), np.zeros(2))
    whole, counts = model.probabilities(data, offs), _subword.extract(features, data, offs)[0]
    monkeypatch.setattr(_subword, "PIECE", 3000)
    monkeypatch.setattr(_subword, "_SUMS", 16)
    assert b"".join(d.tobytes() for d, _ in _subword.pieces(data, offs)) == text
    for d, _ in _subword.pieces(data, offs):
        d.tobytes().decode()
    assert np.abs(model.probabilities(data, offs) - whole).max() < 0.01
    again = _subword.extract(features, data, offs)[0]
    assert 0 <= counts[1].sum() - again[1].sum() < 200
    lone = np.frombuffer("é".encode() * 5000, np.uint8)
    assert all(d.tobytes().decode() for d, _ in _subword.pieces(lone, np.array([0, len(lone)])))


@pytest.mark.parametrize("leaf_words", [1024, 1])
def test_language_model_is_brute_force(spark, monkeypatch, leaf_words):
    """Counts and base scores against the definition, scores against the model's own probabilities and counts, with tokens that meet their counts by a join."""
    monkeypatch.setattr(lm_score, "BROADCAST_TOKENS", 40)
    monkeypatch.setattr(lm_score, "LEAF_WORDS", leaf_words)
    docs = corpus(8, 90)
    docs += [docs[20], (None, docs[21][1]), (None, None), (docs[30][0], "other words")]
    held = lambda d: d is not None and d % 10 == 0
    df = frame(spark, docs).withColumn("n", F.lit(1)).withColumn("row", F.lit("x")).withColumn("token", F.lit(2))
    learn = ~F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    got = lm_score.score(df, learn).collect()
    c = Counter(w for d, t in docs if not held(d) for w in [*plain(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in docs:
        w = [*plain(t), None]
        want[d, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    model, counts, lookup, total, distinct, least = lm_score.train(df.where(learn).selectExpr("doc_id key", "text"))
    assert (total, distinct) == (n, v) and model.depth == (0 if leaf_words == 1024 else 1 if v <= 512 else 2)
    known = {r["token"] & (1 << 64) - 1: r["n"] for r in counts.collect()}
    for r in got[::7]:
        text = next((t or "") for d, t in docs if d == r["doc_id"] and len(plain(t)) + 1 == r["n_tokens"]).encode()
        t = lm_score.Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        p, s = lm_score.log_probabilities(model, t)
        own = np.array([known.get(int(h), 0) for h in t.hash])
        p[s.rest] += np.log((own[s.rest] + 0.1) / model.leaf[s.leaf])
        assert abs(p.sum() / np.log(10) - r["score"]) < 1e-3 * len(p)


def _trained(texts, bits=12):
    """A model of texts by the class's own pieces, without Spark."""
    parts = [lm_score.Tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    token, first, n = np.unique(np.concatenate([t.hash for t in parts]), return_index=True, return_counts=True)
    cls = np.concatenate([t.cls for t in parts])[first]
    depth = lm_score.depth_for(len(token))
    head = np.arange(len(token)) % 3 == 0
    leaf = (cls << 4 * depth) + lm_score.leaf_digits(token, depth)
    size = lm_score.CLASSES << 4 * depth
    model = lm_score.Model(token[head], cls[head], n[head], np.bincount(leaf[~head], n[~head], size), np.bincount(leaf[~head], minlength=size), bits)
    return model, parts, dict(zip(token.tolist(), zip(cls.tolist(), n.tolist(), strict=True), strict=True)), set(token[head].tolist())


def test_language_model_sums_to_one(monkeypatch):
    """All words after one history: the members, the known words of every leaf, and an unknown word in each."""
    monkeypatch.setattr(lm_score, "LEAF_WORDS", 1)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(700)]
    model, parts, known, head = _trained([" ".join(rng.choice(words) for _ in range(400)).encode() for _ in range(8)])
    assert model.depth == 1
    trainer = lm_score.Trainer(model)
    for t in parts:
        trainer.learn(t)
    model.tables = trainer.tables
    leaves = [(c, x) for c in range(lm_score.CLASSES) for x in range(16)]
    history = b"one two three four"
    n = len(known) + len(leaves)
    text = b"".join([history + b" x"] * n)
    t = lm_score.Tokens(np.frombuffer(text, np.uint8), np.arange(n + 1) * (len(history) + 2))
    place = t.bounds[1:] - 2  # the word after the history
    t.hash[place] = np.array([*known, *((x << 8) + (1 << 40) for _, x in leaves)], dtype=np.uint64)
    t.cls[place] = [*(c for c, _ in known.values()), *(c for c, _ in leaves)]
    p, s = lm_score.log_probabilities(model, t)
    p, leaf = np.exp(p[place]), model.leaves(t.hash[place], t.cls[place])
    counts = np.array([*(n for _, n in known.values()), *([0] * len(leaves))])
    rest = np.array([h not in head for h in known] + [True] * len(leaves))
    share = np.where(rest, (counts + 0.1) / model.leaf[leaf], 1.0)
    assert abs((p * share).sum() - 1) < 1e-4


def test_language_model_learns_what_follows(monkeypatch):
    """A word that the one before it tells is told better, be it a member or of the rest; and by the words three and four back as well."""
    monkeypatch.setattr(lm_score, "LEAF_WORDS", 1)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    follows = {w: rng.choice(words) for w in words}
    texts = []
    for _ in range(60):
        w = [rng.choice(words)]
        while len(w) < 200:
            w.append(follows[w[-1]] if rng.random() < 0.8 else rng.choice(words))
        texts.append(" ".join(w).encode())
    model, parts, known, head = _trained(texts)
    before = [lm_score.log_probabilities(model, t)[0].copy() for t in parts[-5:]]
    trainer = lm_score.Trainer(model)
    for t in parts[:-5]:
        trainer.learn(t)
    model.tables = trainer.tables
    for t, old in zip(parts[-5:], before, strict=True):
        new, s = lm_score.log_probabilities(model, t)
        assert new.sum() > old.sum() + 0.3 * len(new) and new[s.rest].sum() > old[s.rest].sum()


def test_language_model_sees_four_words_back():
    """Texts that differ only in the class of the third or fourth word before the last are not told the same of it."""
    model, *_ = _trained([b"aa bb cc dd ee ff"])

    def rows(text):
        t = lm_score.Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return t.cls.tolist(), [int(r[-2]) for _, r in lm_score.Softmaxes(model, t).parts[0][0]]

    (one, a), (two, b), (three, c) = rows(b"aa bb cc dd ee"), rows(b"zq bb cc dd ee"), rows(b"aa zq cc dd ee")
    assert one[0] != two[0] and one[1] != three[1]
    assert a != b and a != c


def test_far_logits_are_moved_back():
    model, parts, *_ = _trained([b"aa bb cc dd ee ff aa bb"])
    model.tables[0] += np.float32(500.0)
    model.tables[5] -= np.float32(500.0)
    moved, _ = lm_score.log_probabilities(model, parts[0])
    model.tables[0] -= np.float32(500.0)
    model.tables[5] += np.float32(500.0)
    assert np.abs(moved - lm_score.log_probabilities(model, parts[0])[0]).max() < 1e-2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.matches(none, bench)).count() == 0
    assert decontaminate.digest(decontaminate.matches(frame(spark, corpus()[:9]), bench)).where("contaminated").count() == 0
    profile, _, classes = ngram_join.join(none)
    assert ngram_join.labelled(profile, classes).count() == 0
    assert line_dedup.digest(none).count() == 0 and mixing.digest(none).count() == 0 and license_scan.scan(none).count() == 0
    assert lm_score.score(none, F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


def test_clashing_columns(spark):
    docs = frame(spark, corpus()[:20]).withColumn("key", F.lit(1)).withColumn("n", F.lit(2)).withColumn("kept", F.lit(3)).withColumn("size", F.lit(4)).withColumn("line", F.lit("x"))
    assert line_dedup.dedup(docs).columns == docs.columns and ngram_join.distinct(docs).columns == docs.columns
    assert mixing.digest(docs).count() == 20
    out = mixing.placed(docs.withColumn("Taken", F.lit("t")).withColumn("mix_size", F.lit("m")))
    assert out.count() == 20 and len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.where("size = 4 and Taken = 't' and mix_size = 'm' and mix_mix_size >= mix_taken / 3 and target is not null").count() == 20
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    odd = docs.withColumn("contaminated", F.lit(5)).withColumn("row", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("spans", F.lit(3)).withColumn("text2", F.lit(4))
    assert decontaminate.cut(odd, found).count() == 19 == decontaminate.clean(docs, bench).count() and decontaminate.cut(odd, found).columns == odd.columns
    assert mixing.placed(odd).count() == 20 and line_dedup.dedup(odd).columns == odd.columns and ngram_join.distinct(odd).columns == odd.columns


def test_share_of_words_at_its_bound(spark):
    """14 of 280 words are a twentieth, however the product of the floats rounds."""
    item = " ".join(f"w{i}" for i in range(14))
    texts = [(1, " ".join([item, *(f"x{i}" for i in range(266))])), (2, " ".join([item, *(f"x{i}" for i in range(267))]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]
    judged = decontaminate.judged(decontaminate.matches(docs, items)).select("doc_id", "contaminated").collect()
    assert sorted(map(tuple, judged)) == [(1, True), (2, False)]
