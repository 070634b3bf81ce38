"""Vector codes: each part of a vector is named by the nearest of its codebook's entries, which Lloyd's rounds have learned, with Elkan's bounds.

For each part a row keeps an upper bound of the distance to its entry and a lower bound for every entry. A
round shifts them by how far the entries have moved, and looks only at entries that the triangle inequality does not exclude
strictly. Distances of these are exact integers, and ties go to the lower index: results are those of plain rounds.
The bounds, rounded outwards, are a table in the shared folder that each round reads and writes anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm._spark import scratch, written
from textloom.llm._vectors import binaries, checked, down, floats_below, from_binaries, integers, matrix, squares, up

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Labels up to this number are broadcast with their sums; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
_STATE = "vec_id long, label string, x binary, code binary, upper binary, lower binary, error long, tried long"


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, code (binary, a byte a part), error, tried (exact distances computed in all rounds); books: the final entries by part, entry and position."""

    rows: DataFrame
    books: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _half_gaps(book: np.ndarray) -> np.ndarray:
    """Half the distances between entries, rounded down."""
    return down(np.sqrt(squares(book, book).astype(np.float64)) / 2)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance or -1, upper, tried) of one part's rows after a round; lower is brought up to date in place.

    A distance is -1 where the bounds alone have shown that the entry stays. upper and lower hold for the book as it is.
    """
    away = half.copy()
    np.fill_diagonal(away, np.inf)
    # Strictly nearer than half the way to any other entry: no other can be as near.
    asked = np.flatnonzero(upper >= away.min(axis=1)[code])
    code, upper, found, tried = code.copy(), upper.copy(), np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    if not len(asked):
        return code, found, upper, tried
    own, y = code[asked], x[asked]
    d = ((y - book[own]) ** 2).sum(1)
    root = np.sqrt(d.astype(np.float64))
    tight = up(root)
    lower[asked, own] = floats_below(down(root))
    open_ = (lower[asked] <= tight[:, None]) & (away[own] <= tight[:, None])
    open_[np.arange(len(asked)), own] = False
    i, j = np.nonzero(open_)
    exact = ((y[i] - book[j]) ** 2).sum(1)
    lower[asked[i], j] = floats_below(down(np.sqrt(exact.astype(np.float64))))
    met = np.full(open_.shape, np.iinfo(np.int64).max)
    met[np.arange(len(asked)), own] = d
    met[i, j] = exact
    best = met.argmin(axis=1)  # the first of equals
    code[asked], found[asked] = best, met[np.arange(len(asked)), best]
    upper[asked] = up(np.sqrt(found[asked].astype(np.float64)))
    tried[asked] = 1 + np.bincount(i, minlength=len(asked))
    return code, found, upper, tried


def _batch(b: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, error: np.ndarray, tried: np.ndarray) -> pa.RecordBatch:
    parts = [b.column("vec_id"), b.column("label"), binaries(x.astype("<i4")), binaries(code.astype(np.uint8)), binaries(upper.astype("<f8")), binaries(lower.astype("<f4")), pa.array(error, pa.int64()), pa.array(tried, pa.int64())]
    return pa.RecordBatch.from_arrays(parts, names=["vec_id", "label", "x", "code", "upper", "lower", "error", "tried"])


def _begin(books: np.ndarray):
    """Every entry's distance, once."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x")).reshape(-1, parts, width)
            d = np.stack([squares(x[:, p], books[p]) for p in range(parts)], axis=1)
            code = d.argmin(axis=2)
            best = np.take_along_axis(d, code[:, :, None], 2)[:, :, 0]
            root = np.sqrt(d.astype(np.float64))
            yield _batch(b, x, code, up(np.sqrt(best.astype(np.float64))), floats_below(down(root)), best.sum(1), np.full(len(x), parts * entries))

    return run


def _again(books: np.ndarray, moved: np.ndarray, last: bool):
    """A round after the entries have moved; the last one computes the distance of every row."""
    parts, entries, width = books.shape
    half = [_half_gaps(book) for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = from_binaries(b.column("x"), "<i4", parts, width).astype(np.int64)
            code, upper = from_binaries(b.column("code"), np.uint8, parts).astype(np.int64), from_binaries(b.column("upper"), "<f8", parts)
            lower = from_binaries(b.column("lower"), "<f4", parts, entries)
            codes, uppers, lowers, error, tried = [], [], [], np.zeros(len(x), np.int64), np.asarray(b.column("tried"))
            for p in range(parts):
                low = floats_below(down(lower[:, p].astype(np.float64) - moved[p][None, :]))
                c, d, u, n = assign(x[:, p], code[:, p], up(upper[:, p] + moved[p][code[:, p]]), low, books[p], half[p])
                if last:
                    rest = np.flatnonzero(d < 0)
                    d[rest] = ((x[rest, p] - books[p][c[rest]]) ** 2).sum(1)
                    error = error + d
                codes, uppers, lowers, tried = [*codes, c], [*uppers, u], [*lowers, low], tried + n
            yield _batch(b, x, np.stack(codes, 1), np.stack(uppers, 1), np.stack(lowers, 1), error, tried)

    return run


def _sums(parts: int, entries: int, width: int):
    """part, entry, n, s of a partition: one row for each entry at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, code = from_binaries(b.column("x"), "<i4", parts, width).astype(np.int64), from_binaries(b.column("code"), np.uint8, parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(s[p], code[:, p], x[:, p])
        part, entry = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(s[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], names=["part", "entry", "n", "s"])

    return run


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: the floor of the mean of their parts, unused ones as they were. A row an entry comes to the driver."""
    parts, entries, width = books.shape
    partial = state.select("x", "code").mapInArrow(_sums(parts, entries, width), "part int, entry int, n long, s array<long>")
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(width)]).alias("s")).collect():
        out[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return out


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> Codes | None:
    """The codes of all vectors and their codebooks; None if there is no vector.

    Vectors that are null or empty, or hold null or components that are not finite, take no part; components of LARGEST or more, scaled, are an error. Nor do
    those of another length than the first's (smallest id, null ids last, then by components) among the lengths that `parts` divides. Codebooks begin as the
    parts of the first `entries` vectors in this order; with fewer vectors they have fewer entries. Rows that share an id are rows of their own.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's name is one byte")
    tagged = table.select(F.col(key).cast("long").alias("vec_id"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), F.col(vector).alias("v"))
    rows = integers(tagged, scale, "v", "vec_id", "label").where(F.size("x") % parts == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).select("x").limit(1).collect()
    if not first:
        return None
    rows = rows.where(F.size("x") == len(first[0]["x"]))
    seeds = checked(np.array([r["x"] for r in rows.orderBy(*order).select("x").limit(entries).collect()], np.int64))
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    with scratch(table.sparkSession) as paths:
        state = written(rows.mapInArrow(_begin(books), _STATE), "vector-bounds")
        for k in range(rounds):
            new = _means(state, books)
            moved = up(np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)))
            books = new
            with scratch(table.sparkSession) as before:  # what the round before has written goes when this one's stands
                before.append(paths.pop())
                state = written(state.mapInArrow(_again(books, moved, k == rounds - 1), _STATE), "vector-bounds")
                paths.append(before.pop())
        paths.pop()
    return Codes(state.select("vec_id", "label", "code", "error", "tried"), books)


def decode(codes: Codes, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: the vectors that the codes stand for, the middles of the entries' components. The codebooks travel with the task."""
    books = (codes.books + 0.5) / scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = from_binaries(b.column("code"), np.uint8, len(books))
            x = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists], names=["vec_id", "embedding"])

    return codes.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def digest(table: DataFrame, **how) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256, distances (how many were computed) of every vector that takes part; null labels are one label. Without vectors there are no rows."""
    codes = encode(table, **how)
    if codes is None:
        return table.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, distances long")
    by = written(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    few = by.count() <= BROADCAST_LABELS
    both = codes.rows.join(F.broadcast(by) if few else by, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256"), F.col("tried").alias("distances"))
