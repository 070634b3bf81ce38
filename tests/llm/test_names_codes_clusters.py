"""Exact dedup by block names, vector codes and centroid clusters against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import _vectors, centroids, exact_dedup, vector_codes

DOCS = "doc_id long, text string, row string, name string"


def texts(seed, n=150, block=8):
    """Texts alike but for a byte, a block, a length or nothing, of all lengths about the blocks' bounds."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab") for _ in range(k)) for k in (0, 1, 7, 8, 9, 15, 16, 17, 40, 64, 65, 200, 1000)]
    out = [None, "", "é" * 9, "é" * 9, "a" * 64, "a" * 65, "a" * 63]
    while len(out) < n:
        t = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.5 and t:
            i = rnd.randrange(len(t))
            t = t[:i] + rnd.choice("abc") + t[i + 1 :]
        elif kind < 0.6:
            t += rnd.choice(["a", "b" * block, "\n"])
        out.append(t)
    return out


def expected(rows):
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d or 0, k))
    best = {t: max(g) for t, g in groups.items()}
    return sorted(((d, rows[best[t or ""][2]][0], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


@pytest.mark.parametrize("block", [8, 512])
def test_exact_dedup_is_brute_force(spark, block):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts(1))]
    rows += [(i, t) for i, t in rows[:20]] + [(5, "one id"), (5, "another text"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "r", "n") for d, t in rows], DOCS).repartition(7)
    got = exact_dedup.digest(docs, block=block).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.dedup(docs, block=block)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["row"], r["name"]) for r in left.collect()), key=str) == sorted(((r["doc_id"], r["text_sha256"], "r", "n") for r in kept), key=str)


def test_identities_are_of_texts_and_not_of_hashes(spark):
    """Two rows have one identity exactly when their texts are equal, also where one text is the other's blocks in another order or a part of it."""
    a, b = "x" * 8, "y" * 8
    all_ = [a + b, b + a, a, b, a + b + a, a + b + b, a + a, a + b + a + b, a + b + a + b + a]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(all_ * 2)], "row long, text string")
    found = {r["row"]: (r["level"], r["name"]) for r in exact_dedup.identities(rows, block=8).collect()}
    assert len(found) == 2 * len(all_) and len(set(found.values())) == len(all_)
    assert all(found[k] == found[k + len(all_)] for k in range(len(all_)))


def test_a_hot_group_and_a_very_long_text(spark):
    hot, long_ = "the same text again " * 60, "".join(random.Random(4).choice("abcdef ") for _ in range(3_000_000))
    rows = [(i, hot) for i in range(3000)] + [(i, f"{hot} {i}") for i in range(3000, 3200)] + [(5000, long_), (5001, long_), (5002, long_[:-1] + "!")]
    got = exact_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    sizes = {(r["keep_id"], r["group_size"]): r["n"] for r in got.where("doc_id < 3000 or doc_id >= 5000").groupBy("keep_id", "group_size").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(2999, 3000): 3000, (5001, 2): 2, (5002, 1): 1}
    assert got.where("group_size = 1").count() == 201


def test_prepared_texts_are_compared(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.dedup(docs, prepare=F.lower).collect()) == [(2, "a B"), (3, "a c")]


def test_dedup_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.digest(none).count() == 0 and exact_dedup.dedup(none).count() == 0


def lloyd(x, first, rounds):
    """Plain rounds: (codes, distances, entries)."""
    entries = x[:first].copy() if isinstance(first, int) else first.copy()

    def nearest():
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        code, _ = nearest()
        for j in range(len(entries)):
            own = x[code == j]
            if len(own):
                entries[j] = own.sum(0) // len(own)
    return *nearest(), entries


def vectors(seed, n, dims, kind):
    """Vectors in groups, with equal ones, and components that floor to few integers, so that distances tie."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(12, dims))[rnd.integers(0, 12, n)] * 0.2 + rnd.normal(size=(n, dims)) * (0.05 if kind == "groups" else 0.002)
    if kind == "ties":
        x = np.round(x * 8) / 1024
    x[n // 2 : n // 2 + 5] = x[0]
    return x


ODD = [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] + [0.0] * 7), (904, [float("inf")] * 8), (905, [1.0] * 12), (906, [1.0] * 7)]


@pytest.mark.parametrize("kind,entries,n", [("groups", 16, 300), ("ties", 16, 300), ("ties", 256, 40), ("groups", 1, 30)])
def test_vector_codes_are_plain_rounds(spark, kind, entries, n):
    x = vectors(3, n, 8, kind)
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = [(i, x[i].tolist(), "ab"[i % 2] if i % 3 else None, "extra") for i in order] + [(i, v, "a", "extra") for i, v in ODD]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code string").repartition(5)
    ints = np.floor(x * 1024).astype(np.int64)
    want = [lloyd(ints[:, 2 * p : 2 * p + 2], min(entries, n), 4) for p in range(4)]
    got = {r["vec_id"]: r for r in vector_codes.digest(table, entries=entries).collect()}
    assert sorted(got) == list(range(n))
    error = sum(w[1] for w in want)
    by = {}
    for i in range(n):
        by[rows[order.index(i)][2]] = by.get(rows[order.index(i)][2], 0) + error[i]
    books = hashlib.sha256(",".join(str(v) for w in want for v in w[2].ravel().tolist()).encode()).hexdigest()
    for i in range(n):
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == ("".join(f"{w[0][i]:02x}" for w in want), error[i], by[rows[order.index(i)][2]], books)
    if entries == 16:  # the bounds leave out most distances: five passes over four parts
        assert sum(r["distances"] for r in got.values()) < 0.7 * n * 5 * 4 * 16
    near = {r["vec_id"]: np.array(r["embedding"]) for r in vector_codes.decode(vector_codes.encode(table, entries=entries)).collect()}
    assert all(abs(((near[i] - x[i]) ** 2).sum() * 1024**2 - error[i]) <= 8 + 4 * error[i] ** 0.5 + 8 for i in range(n))


def test_bounds_hold_in_every_round():
    """upper is never under the distance of the own entry and lower never over that of any, however the entries move."""
    rnd = np.random.default_rng(5)
    x, book = rnd.integers(-2000, 2000, (200, 4)), rnd.integers(-2000, 2000, (20, 4))
    d = _vectors.squares(x, book)
    code, lower = d.argmin(1), _vectors.floats_below(_vectors.down(np.sqrt(d)))
    upper = _vectors.up(np.sqrt(d.min(1)))
    for _ in range(12):
        new = book + rnd.integers(-60, 60, book.shape)
        moved = _vectors.up(np.sqrt(((new - book) ** 2).sum(1)))
        book = new
        lower = _vectors.floats_below(_vectors.down(lower.astype(float) - moved[None]))
        upper = _vectors.up(upper + moved[code])
        code, found, upper, _ = vector_codes.assign(x, code, upper, lower, book, vector_codes._half_gaps(book))
        exact = _vectors.squares(x, book)
        assert (code == exact.argmin(1)).all() and ((found == exact.min(1)) | (found < 0)).all()
        assert (upper**2 >= exact.min(1)).all() and (lower.astype(float) ** 2 <= exact).all()


@pytest.mark.parametrize("kind,n,k", [("groups", 200, 8), ("ties", 200, 8), ("ties", 5, 8), ("groups", 200, 1)])
def test_clusters_are_plain_rounds(spark, kind, n, k):
    x = vectors(7, n, 8, kind)
    odd = [(i, v, 0) for i, v in ODD if v is None or len(v) != 8 or v[0] is None or not np.isfinite(v[0])]
    table = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(n)] + odd, "vec_id long, embedding array<double>, cluster int").repartition(4)
    ints = np.floor(x * 1024).astype(np.int64)
    first = sorted(range(n), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    code, d, entries = lloyd(ints, ints[first], 10)
    got = {r["vec_id"]: r for r in centroids.digest(table, clusters=k, components=8, segment=3).collect()}
    assert sorted(got) == list(range(n))
    for i in range(n):
        name = hashlib.sha256(",".join(map(str, entries[code[i]].tolist())).encode()).hexdigest()
        r = got[i]
        assert (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (code[i], d[i], d[code == code[i]].sum(), d.sum(), name)
    if kind == "groups" and k > 1:
        assert sum(r["distances"] for r in got.values()) < n * k


def test_screening_never_leaves_out_the_nearest():
    rnd = np.random.default_rng(2)
    for width, size in ((64, 1 << 24), (64, 4), (7, 1000)):
        x, c = rnd.integers(-size, size, (500, width)), rnd.integers(-size, size, (8, width))
        x[:100] = c[rnd.integers(0, 8, 100)] + rnd.integers(-1, 2, (100, width))
        c[5] = c[2]
        exact = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
        cluster, distance, _ = centroids.nearest(x, centroids.norms(x).astype(np.float32).astype(float), c)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_vectors_without_ids_and_with_shared_ids(spark):
    rows = [(None, [1.0] * 8), (1, [0.0] * 8), (1, [0.5] * 8), (1, [0.0] * 8), (2, [-0.5] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = vector_codes.digest(table, entries=2, label=None).collect()
    assert len(codes) == 5 and len({r["codebooks_sha256"] for r in codes}) == 1
    assert vector_codes.encode(table, entries=2, rounds=0, label=None).books[0].tolist() == [[0, 0], [0, 0]]  # the two equal rows of id 1 come first
    assert centroids.digest(table, components=8).count() == 5


def test_empty_and_too_large_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.digest(none).count() == 0 and centroids.digest(none).count() == 0
    large = spark.createDataFrame([(1, [1e9] * 64, 1)], none.schema)
    for digest in (vector_codes.digest, centroids.digest):
        with pytest.raises(Exception, match="too large"):
            digest(large).count()
