"""Supervised subword embeddings in numpy: hashed n-gram vectors, averaged per text, with a linear softmax.

Used for language identification and for the quality classifier. Training takes a bounded
sample of labelled rows; scoring runs over whole texts in array operations. A text of more than
PIECE bytes is taken in pieces, cut behind a blank where there is one; only the few n-grams across a cut are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm._bytes import PLAIN, Words, mix, release, slices

_MULT = np.uint32(0x9E3779B1)
#: Bytes of a text that are taken at once, and sums of n-grams times labels.
PIECE = 1 << 22
_SUMS = 1 << 20


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of a slice of texts, or of a long text's pieces."""
    if len(data) <= PIECE or len(offs) > 2:
        yield data, offs
        return
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            blank = np.flatnonzero(~PLAIN[data[at + PIECE // 2 : end]])
            if len(blank):
                end = at + PIECE // 2 + int(blank[-1]) + 1
            else:
                while data[end] & 0xC0 == 0x80:  # not within a character
                    end -= 1
        yield data[at:end], np.array([0, end - at])
        at = end


@dataclass(frozen=True)
class Features:
    """Which hashed n-grams make up a text: character n-grams of up to four bytes, words and word pairs."""

    grams: tuple[int, ...] = (1, 2, 3, 4)
    gram_bits: int = 17
    words: bool = True
    word_bits: int = 16
    lower: bool = True

    @property
    def size(self) -> int:
        return len(self.grams) * (1 << self.gram_bits) + self.words * (2 << self.word_bits)

    def streams(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket of each n-gram, first, end): n-gram k belongs to the text d with first[d] <= k < end[d]."""
        low = data
        if self.lower:
            low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        code = low.astype(np.uint32)
        base = 0
        for n in range(1, max(self.grams, default=0) + 1):
            if n > 1:
                if len(code) < 2:
                    code = code[:0]
                else:
                    code = code[:-1] | (low[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1)))
            if n in self.grams:
                bucket = ((code ^ np.uint32(n * 0x1000193)) * _MULT) >> np.uint32(32 - self.gram_bits)
                yield bucket.astype(np.int64) + base, offs[:-1], np.maximum(offs[1:] - n + 1, offs[:-1])
                base += 1 << self.gram_bits
        if self.words:
            w = Words(data, offs, PLAIN)
            h = w.hashes(self.lower)
            shift = np.uint64(64 - self.word_bits)
            yield (h >> shift).astype(np.int64) + base, w.bounds[:-1], w.bounds[1:]
            base += 1 << self.word_bits
            pair = np.zeros(0, np.uint64)
            if len(h):
                # A word that is said again at once is one feature whatever the word.
                pair = np.where(h[1:] == h[:-1], np.uint64(0), mix(h[:-1] * np.uint64(5) + h[1:]))
            yield (pair >> shift).astype(np.int64) + base, w.bounds[:-1], np.maximum(w.bounds[1:] - 1, w.bounds[:-1])


def _sums(table: np.ndarray, bucket: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of table rows over each text's n-grams, in parts of bounded size."""
    out, step = np.zeros((len(first), table.shape[1])), max(4096, _SUMS // table.shape[1])
    for a in range(0, len(bucket), step):
        b = min(a + step, len(bucket))
        total = np.zeros((b - a + 1, table.shape[1]))
        np.cumsum(table[bucket[a:b]], axis=0, out=total[1:], dtype=np.float64)
        out += total[np.clip(end, a, b) - a] - total[np.clip(first, a, b) - a]
    return out


def extract(features: Features, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets in order, how often each is met) of each text; without n-grams, empty."""
    if len(data) > PIECE and len(offs) == 2:
        parts = [extract(features, d, o)[0] for d, o in pieces(data, offs)]
        ids, at = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
        return [(ids, np.bincount(at, np.concatenate([n for _, n in parts]), len(ids)).astype(np.int32))]
    parts = list(features.streams(data, offs))
    out = []
    for d in range(len(offs) - 1):
        ids = np.concatenate([b[f[d] : e[d]] for b, f, e in parts]) if parts else np.zeros(0, np.int64)
        ids, counts = np.unique(ids, return_counts=True)
        out.append((ids.astype(np.int32), counts.astype(np.int32)))
    return out


def shuffled(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The texts with the bytes of their words in another order, drawn from the text itself: what no language looks like."""
    out = data.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = data[a:b]
        letters = np.flatnonzero(PLAIN[own])
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(own.tobytes())))
        out[a + letters] = own[rng.permutation(letters)]
    return out


@dataclass
class Model:
    """Logits of each bucket, one column a label; or vectors, and the weights that make logits of their average, where labels are more than dimensions.

    With `other` there is one more class behind the labels: texts that are none of them.
    """

    features: Features
    labels: list
    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray | None = None
    other: bool = False
    temperature: float = 1.0
    reject_below: float = 0.0
    report: dict = field(default_factory=dict)

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(offs) - 1, self.table.shape[1])), np.zeros(len(offs) - 1)
        for own, bounds in pieces(data, offs):
            for bucket, first, end in self.features.streams(own, bounds):
                total += _sums(self.table, bucket, first, end)
                n += end - first
        total /= np.maximum(n, 1)[:, None]
        return softmax(((total if self.weight is None else total @ self.weight) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(features: Features, rows: list[tuple[np.ndarray, np.ndarray, int]], labels: list, dim: int = 8, epochs: int = 6, rate: float = 0.15, seed: int = 7, hold: int = 5, reject_error: float = 0.02) -> Model:
    """Stochastic gradient descent with per-bucket step sizes; every `hold`-th row is kept for calibration.

    A row's label is its place in labels, or len(labels) for a text that is none of them; if there
    are such rows, n-grams that no row has speak for that class. The temperature minimises the held rows' negative
    log-likelihood, their targets smoothed by one row in as many as are held, so that a classifier
    without errors does not become certain. Rows under reject_below are rejected: it lies midway between the
    scores of texts that are none of the labels and those of the rows that are told rightly, all but a share of reject_error of
    each; where these overlap, or there are no such texts, at most so many rows over it are wrong or none.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    other = any(r[2] == len(labels) for r in rows)
    k = len(labels) + other
    vectors = np.empty((features.size, dim), np.float32)
    for at in range(0, features.size, 1 << 16):  # drawn in parts: double precision is twice the size
        vectors[at : at + (1 << 16)] = rng.normal(0, 0.1, (min(1 << 16, features.size - at), dim))
    weight, bias = rng.normal(0, 0.1, (k, dim)).astype(np.float32), np.zeros(k, np.float32)
    seen_v, seen_w, seen_b = np.full(features.size, 1e-8, np.float32), np.full((k, dim), 1e-8, np.float32), np.full(k, 1e-8, np.float32)
    fit = [r for i, r in enumerate(rows) if i % hold] or rows
    held = [r for i, r in enumerate(rows) if i % hold == 0] if len(rows) > hold else rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            ids, share, y = fit[i]
            own = vectors[ids]
            hidden = share @ own if len(ids) else np.zeros(dim, np.float32)
            wrong = softmax(weight @ hidden + bias)
            wrong[y] -= 1
            back = wrong @ weight
            grad = np.outer(wrong, hidden)
            seen_w += grad**2
            seen_b += wrong**2
            weight -= step * grad / np.sqrt(seen_w)
            bias -= step * wrong / np.sqrt(seen_b)
            if len(ids):
                seen_v[ids] += share**2 * float(back @ back)
                vectors[ids] = own - (step * share / np.sqrt(seen_v[ids]))[:, None] * back
    if other:
        # The last class's logit of a bucket that was never met: as large as those of the buckets that speak for it.
        met = np.zeros(features.size, dtype=bool)
        for ids, _, _ in fit:
            met[ids] = True
        own = vectors[met] @ weight.T
        lead = own[:, -1] - own[:, :-1].max(axis=1)
        push = weight[-1] - weight[:-1].mean(axis=0)
        vectors[~met] = push * (np.median(lead[lead > 0]) if (lead > 0).any() else 0.0) / max(float(push @ push), 1e-9)
    model = Model(features, labels, (vectors @ weight.T).astype(np.float32), bias, None, other) if k <= dim else Model(features, labels, vectors, bias, np.ascontiguousarray(weight.T), other)
    sums = np.array([r[1] @ model.table[r[0]] if len(r[0]) else np.zeros(model.table.shape[1]) for r in held]).reshape(len(held), -1)
    logits = (sums if model.weight is None else sums @ model.weight) + bias
    y = np.array([r[2] for r in held], dtype=np.int64)
    at = np.arange(len(y))
    if len(y):
        target = np.full((len(y), k), 1 / (len(y) + 2) / max(k - 1, 1))
        target[at, y] = 1 - (1 / (len(y) + 2) if k > 1 else 0.0)
        loss = {t: -(target * np.log(np.maximum(softmax(logits / t), 1e-30))).sum(axis=1).mean() for t in np.geomspace(0.02, 20, 121)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)[:, : len(labels)]
        order = np.argsort(-p.max(axis=1), kind="stable")
        wrong_share = np.cumsum(p.argmax(axis=1)[order] != y[order]) / (at + 1)
        good = np.flatnonzero(wrong_share <= reject_error)
        model.reject_below = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
        real, top = y < len(labels), p.max(axis=1)
        right = real & (p.argmax(axis=1) == y)
        if right.any() and not real.all():
            low, high = np.quantile(top[right], reject_error), np.quantile(top[~real], 1 - reject_error)
            if high < low:
                model.reject_below = float(low + high) / 2
        model.report = {"held": len(y), "accuracy": float((p.argmax(axis=1) == y)[real].mean()) if real.any() else 1.0, "loss": float(loss[model.temperature]), "temperature": model.temperature}
    return model


#: Of the sampled rows one in so many is shown a second time, shuffled.
SHUFFLED = 4


def gather(sample: DataFrame, features: Features, other: bool = False) -> list[tuple[np.ndarray, np.ndarray, object]]:
    """(buckets, weights that sum to 1, label) of a bounded sample (key, text, label), taken on the executors, ordered by key.

    other: some texts come again with their letters shuffled and no label. Buckets travel as
    compressed differences and counts, a quarter of their size as arrays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(keys: pa.Array, labels: pa.Array, got: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, labels, pa.array([zlib.compress(np.diff(i, prepend=np.int32(0)).tobytes() + n.tobytes(), 1) for i, n in got], pa.binary())], names=["key", "label", "features"])

        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                keys, labels = (batch.column(i).slice(first, end - first) for i in (0, 2))
                yield packed(keys, labels, extract(features, data, offs))
                if other:
                    again = [d for d in range(end - first) if zlib.crc32(data[offs[d] : offs[d + 1]].tobytes()) % SHUFFLED == 0 and offs[d + 1] > offs[d]]
                    got = [extract(features, shuffled(data[offs[d] : offs[d + 1]], np.array([0, offs[d + 1] - offs[d]])), np.array([0, offs[d + 1] - offs[d]]))[0] for d in again]
                    yield packed(keys.take(pa.array(again, pa.int64())), pa.nulls(len(again), labels.type), got)

    kind = dict(sample.dtypes)["label"]
    rows = sample.select("key", "text", "label").mapInArrow(run, f"key long, label {kind}, features binary").collect()
    rows.sort(key=lambda r: (r["key"], str(r["label"]), r["features"]))
    rows.reverse()
    out = []
    while rows:
        r = rows.pop()
        steps, counts = np.frombuffer(zlib.decompress(r["features"]), np.int32).reshape(2, -1)
        out.append((np.cumsum(steps, dtype=np.int32), (counts / max(counts.sum(), 1)).astype(np.float32), r["label"]))
    release()
    return out


def score(docs: DataFrame, model: Model, keep_null: bool = False) -> DataFrame:
    """doc_id and p, the probabilities in the order of model.labels (and behind them that of none), of rows (doc_id, text).

    A null text is scored as an empty one, or with keep_null has a null p.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            for first, end, data, offs in slices(batch.column(1)):
                p = own.probabilities(data, offs)
                bounds = pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32(), mask=np.append(null[first:end], False) if keep_null else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(bounds, pa.array(p.ravel(), pa.float64()))], names=["doc_id", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p array<double>")


def keep(docs: DataFrame, model: Model | None, text: str, least: float, label: str = "1") -> DataFrame:
    """The rows, whole, whose probability of the label is `least` or more; without a model, or without that label in it, all or none."""
    if model is None:
        return docs
    if label not in model.labels:
        return docs.limit(0)
    shared, at, column = docs.sparkSession.sparkContext.broadcast(model), model.labels.index(label), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for first, end, data, offs in slices(batch.column(column)):
                good[first:end] = own.probabilities(data, offs)[:, at] >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
