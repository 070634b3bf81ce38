"""N-gram Jaccard join with token-combination prefixes, exact, and the components of its links.

Texts are sets of word shingles (61-bit hashes). Under one total order of the shingles, rare
classes before frequent ones, two sets of n and m shingles with Jaccard similarity t or more
share at least k shingles among the first n - ceil(t n) + k of one and the like of the other.
With k = 2, either one of the shared shingles is rare, and found by itself, or two are
frequent, and found as a pair. So prefixes are extended by one shingle; rare shingles are
indexed singly, frequent ones in pairs. Every pair of sets that meets in the index is then
verified by the hashes of all its shingles, save pairs already known to be in one component: the join is asked for components
and loses no link between them.

Sets that are equal are one class from the start; all work below is on classes. The key of a
class is a 64-bit hash of its set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm._bytes import PLAIN, U64, Words, mix, release, shingles, slices
from textloom.llm._spark import keyed, meet, plain, written

WIDTH = 5
THRESHOLD = (75, 100)
#: Counters of the frequency sketch: 8 bits of class for each, so 8 MB are broadcast at most.
SKETCH_BITS = 23
SEGMENTS = 64
#: A set with more frequent shingles than this in its prefix, whose pairs would be more than 190, indexes them singly; it is then
#: asked for by the lists of single ones, so that no link is lost.
MOST_COMBINED = 20
#: Members of a list that meet in one block; longer lists are dealt out in pairs of blocks.
SQUARE = 1024
#: Index entries for which one reducer partition is planned.
SEGMENT_ENTRIES = 500_000
#: Bits of the filter by which a pass over the texts finds the sets to verify: 4 MB, broadcast.
FILTER_BITS = 25
#: Entries of one packed row, about 10 bytes each: large rows burden the executors' heaps.
ROW_ENTRIES = 8_192
FLUSH = 16_384
#: Least bits of a set's parity sketch, whose bit b is the parity of the number of its shingles
#: that hash to b; a larger set has the power of two from about half its size.
PARITY_BITS = 1024

_TOKEN = U64((1 << 61) - 1)


def _sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, bounds, keys): the sorted distinct shingles of each text, and the key of its set (0 if empty)."""
    words = Words(data, offs, PLAIN)
    token, doc = shingles(words.hashes(), words.bounds, width)
    token = token & _TOKEN
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    if len(token):
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc = token[new], doc[new]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    n = np.diff(bounds)
    total = np.zeros(len(token) + 1, U64)
    np.cumsum(mix(token + U64(1)), out=total[1:])
    keys = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U64) * U64(0x9E3779B97F4A7C15))
    keys[n == 0] = 0
    return token, bounds, keys


_PROFILE = "doc_id long, n long, key long, parity array<long>, segment int, sketch binary"


def _parities(token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds): the parity sketch of each set. Two sets differ in at least as many shingles as their sketches in bits."""
    bits = np.maximum(PARITY_BITS, 1 << np.ceil(np.log2(np.maximum(n, 2) / 1.5)).astype(np.int64))
    base = np.append(0, np.cumsum(bits))
    place = np.repeat(base[:-1], n) + (mix(token ^ U64(0x7777)) & np.repeat(bits - 1, n).astype(U64)).astype(np.int64)
    odd = (np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), base // 64


def _profile(width: int):
    """doc_id, n, key of each row, the parity sketch of each distinct set, then the frequency sketch of the partition's sets by segment."""
    words = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("parity", words), ("segment", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        known: set[int] = set()
        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                token, bounds, keys = _sets(data, offs, width)
                n = np.diff(bounds)
                fresh = np.zeros(len(keys), dtype=bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in known:
                        known.add(k)
                        fresh[i] = True
                slot, times = np.unique((token[np.repeat(fresh, n)] & U64((1 << SKETCH_BITS) - 1)).astype(np.int64), return_counts=True)
                counts[slot] = np.minimum(counts[slot].astype(np.int64) + times, 65535)
                empty = pa.nulls(end - first, pa.int32())
                bits, edges = _parities(token[np.repeat(fresh, n)], n[fresh])
                starts = edges[np.append(0, np.cumsum(fresh))]
                parity = pa.ListArray.from_arrays(pa.array(starts, pa.int32(), mask=np.append(~fresh, False)), pa.array(bits, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(keys.view(np.int64), pa.int64(), mask=n == 0), parity, empty, pa.nulls(end - first, pa.binary())], schema=schema)
        if known:
            each = counts.reshape(SEGMENTS, -1)
            blobs = [zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].tobytes(), 1) for x in each]
            none = pa.nulls(SEGMENTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(SEGMENTS, words), pa.array(range(SEGMENTS), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sketches of a segment and gives each counter's frequency class, 0 (rare) to 3."""
    size = (1 << SKETCH_BITS) // SEGMENTS
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = zlib.decompress(blob)
            counts = np.frombuffer(plain, np.uint8, size).astype(np.int64)
            counts[counts == 255] = np.frombuffer(plain, np.uint16, offset=size)
            total[segment] = total.get(segment, 0) + counts
    for segment, counts in total.items():
        mean = counts.mean()
        limit = mean + 6 * math.sqrt(mean) + 8
        classes = np.where(counts <= limit, 0, 1 + np.minimum(2, np.log2(np.maximum(counts, 1) / limit) // 3)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())], names=["segment", "classes"])


def _least(n: np.ndarray | int, threshold: tuple[int, int]) -> np.ndarray | int:
    """The fewest shingles that a set of n shares with any set it is linked with."""
    return -(-n * threshold[0] // threshold[1])


def _signatures(token: np.ndarray, classes: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(signatures, places, number of rare shingles, whether it indexes frequent ones singly) of one set.

    A place says how many shingles of the set come before those that the signature stands
    for: two sets whose first shared shingles these are share n - place at most.
    """
    order = np.argsort((classes[(token & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(U64) << U64(61)) | token, kind="stable")
    rare = int(len(token) - np.count_nonzero(classes[(token & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)]))
    n = len(token)
    length = min(n, n - _least(n, threshold) + 2)
    prefix = token[order[:length]]
    singles = mix(prefix[:rare]) & ~U64(1)
    often = prefix[rare:]
    single = len(often) > MOST_COMBINED
    parts, places = [singles], [np.arange(len(singles))]
    if n == 1 or _least(n, threshold) < 2:
        single = single or bool(len(often))  # one shared shingle may be all there is
    if len(often):
        parts.append(mix(often ^ U64(0x5851F42D4C957F2D)) | U64(1))
        places.append(rare + np.arange(len(often)))
        if not single:
            i, j = np.triu_indices(len(often), 1)
            parts.append(mix(often[i] * U64(3) + mix(often[j])) & ~U64(1))
            places.append(rare + j - 1)
    return np.concatenate(parts), np.minimum(np.concatenate(places), 65535).astype(np.uint16), rare, single


_INDEX = "segment int, sigs binary, owners binary, places binary, keys binary, sizes binary, rares binary"


def _index(classes: bytes, segments: int, width: int, threshold: tuple[int, int]):
    """The partition's distinct sets as index entries, packed by segment of the signatures' range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(classes), np.uint8)
        known: set[int] = set()
        sigs, places, keys, sizes, rares = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(sigs), dtype=np.uint16), [len(x) for x in sigs])
            flat, place = np.concatenate(sigs), np.concatenate(places)
            order = np.argsort(flat, kind="stable")
            flat, owner, place = flat[order], owner[order], place[order]
            edges = np.searchsorted(flat, np.array([(i << 64) // segments for i in range(1, segments)], dtype=U64)) if segments > 1 else []
            columns: list[list] = [[], [], [], [], [], [], []]
            own = [np.array(keys, U64), np.array(sizes, np.uint32), np.array(rares, np.uint32)]
            for s, (x, o, at) in enumerate(zip(np.split(flat, edges), np.split(owner, edges), np.split(place, edges), strict=True)):
                if len(x):
                    used, local = np.unique(o, return_inverse=True)
                    for column, value in zip(columns, (s, x.tobytes(), local.astype(np.uint16).tobytes(), at.tobytes(), *(y[used].tobytes() for y in own)), strict=True):
                        column.append(value)
            for x in (sigs, places, keys, sizes, rares):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["segment", "sigs", "owners", "places", "keys", "sizes", "rares"])

        entries = 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                token, bounds, key = _sets(data, offs, width)
                for d, k in enumerate(key.tolist()):
                    if bounds[d + 1] == bounds[d] or k in known:
                        continue
                    known.add(k)
                    x, at, rare, single = _signatures(token[bounds[d] : bounds[d + 1]], table, threshold)
                    sigs.append(x)
                    places.append(at)
                    keys.append(k)
                    sizes.append(int(bounds[d + 1] - bounds[d]))
                    rares.append(2 * rare + single)
                    entries += len(x)
                    if len(sigs) >= FLUSH or entries >= segments * ROW_ENTRIES:
                        yield flush()
                        entries = 0
        if sigs:
            yield flush()

    return run


_LISTS = "a long, b long, list long, kind int, key long, n int, single boolean, reach int"
_LISTS_TYPE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("single", pa.bool_()), ("reach", pa.int32())])


def _postings(threshold: tuple[int, int]):
    """Pairs (a, b) of each list's hub with its other members, and the members of lists of three or more."""
    p, q = threshold

    def segment(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([np.frombuffer(r["sigs"], U64) for r in rows])
        base = np.cumsum([0, *(r["keys"].size // 8 for r in rows)])
        owner = np.concatenate([np.frombuffer(r["owners"], np.uint16).astype(np.int64) + b for r, b in zip(rows, base, strict=False)])
        keys = np.concatenate([np.frombuffer(r["keys"], U64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows]).astype(np.int64)
        rares = np.concatenate([np.frombuffer(r["rares"], np.uint32) for r in rows]).astype(np.int64)
        place = np.concatenate([np.frombuffer(r["places"], np.uint16) for r in rows]).astype(np.int64)
        order = np.argsort(sig, kind="stable")
        sig, owner, place = sig[order], owner[order], place[order]
        again = np.zeros(len(sig), dtype=bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= again[1:]
        sig, owner, place = sig[again], owner[again], place[again]
        if not len(sig):
            return
        # The same class from two tasks is one member; the hub of a list is the member with the smallest share of rare shingles.
        key = keys[owner]
        order = np.lexsort((key, (rares[owner] >> 1) / sizes[owner], sig))
        sig, owner, place, key = sig[order], owner[order], place[order], key[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, owner, place, key = sig[new], owner[new], place[new], key[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(start, len(sig)))
        n = sizes[owner]
        reach = n - place
        head = np.repeat(start, count)
        fits = (np.minimum(n, n[head]) * q >= np.maximum(n, n[head]) * p) & (np.minimum(reach, reach[head]) * (p + q) >= (n + n[head]) * p) & (key[head] != key)
        a, b = np.minimum(key[head], key)[fits], np.maximum(key[head], key)[fits]
        pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), U64)
        for at in range(0, len(pair), 1 << 16):
            x = pair[at : at + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), *(pa.nulls(len(x), _LISTS_TYPE.field(i).type) for i in range(2, 8))], schema=_LISTS_TYPE)
        # Lists with the same members are one, in which a member reaches as far as in any.
        kind = (sig[start] & U64(1)).astype(np.int64)
        name = mix(np.add.reduceat(mix(key + U64(0x1234567)), start) + kind.astype(U64))
        long = np.repeat(count > 2, count)
        if not long.any():
            return
        name, kind = np.repeat(name, count)[long], np.repeat(kind, count)[long]
        key, owner, n, reach = key[long], owner[long], n[long], reach[long]
        order = np.lexsort((key, name))
        name, kind, key, owner, n, reach = name[order], kind[order], key[order], owner[order], n[order], reach[order]
        start = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])]))
        reach = np.maximum.reduceat(reach, start)
        for at in range(0, len(start), 1 << 16):
            x = start[at : at + (1 << 16)]
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(name[x].view(np.int64)), pa.array(kind[x], pa.int32()), pa.array(key[x].view(np.int64)), pa.array(n[x], pa.int32()), pa.array((rares[owner[x]] & 1) == 1), pa.array(reach[at : at + (1 << 16)], pa.int32())], schema=_LISTS_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i, s in enumerate(columns.pop("segment").to_pylist()):
                held.setdefault(s, []).append({name: c[i].as_buffer() for name, c in columns.items()})
        for s in list(held):
            yield from segment(held.pop(s))
            release()

    return run




#: Sets that no row with an id has are found by their keys.
_BY_KEY = U64(0x5E75)


def _slots(x: np.ndarray) -> np.ndarray:
    return (mix(x) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        none = np.asarray(batch.column(0).is_null())
        ids, keys = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in (0, 1))
        bits[_slots(np.where(none, keys ^ _BY_KEY, ids))] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _fetch(packed: bytes, width: int):
    """doc_id, key, shingles of the texts whose id, or key if they have no id, may be in the filter; texts without an id once a partition and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)
        known: set[int] = set()
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            chosen = batch.filter(pa.array(bits[_slots(ids.view(U64))] | np.asarray(batch.column(0).is_null())))
            none = np.asarray(chosen.column(0).is_null())
            for first, end, data, offs in slices(chosen.column(1)):
                token, bounds, keys = _sets(data, offs, width)
                wanted = ~none[first:end] | bits[_slots(keys ^ _BY_KEY)]
                for d in np.flatnonzero(none[first:end] & wanted).tolist():
                    wanted[d] = int(keys[d]) not in known
                    known.add(int(keys[d]))
                blobs = [token[bounds[d] : bounds[d + 1]].tobytes() for d in np.flatnonzero(wanted).tolist()]
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(first, end - first).filter(pa.array(wanted)), pa.array(keys.view(np.int64)[wanted]), pa.array(blobs, pa.binary())], names=["doc_id", "key", "set"])

    return run


def _linked(threshold: tuple[int, int]):
    p, q = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, U64)
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x = x.as_py()
                if x is not last:
                    last, left = x, np.frombuffer(x, U64)
                right = np.frombuffer(y.as_buffer(), U64)
                shared = len(left) + len(right) - len(np.union1d(left, right))
                good[i] = shared * q >= p * (len(left) + len(right) - shared)
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of links (a, b), by alternating large and small stars.

    Each round is two aggregations and joins of the size of the links and is written to the
    shared folder; no round brings links to the driver.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # Small stars: b's smaller neighbours, and b itself, are tied to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        edges = written(small.where("a < b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def join(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, links, classes).

    profile: doc_id, n, key of each row; a text without words, or null, has n = 0 and a null
    key. links: pairs (a, b) of keys of classes that are similar, enough of them to join
    every component. classes: key, component of the classes with a link.
    Rows with a null id take part through their text; they have no id to give to a component.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profiled = written(source.mapInArrow(_profile(width), _PROFILE), "profile")
    profile = profiled.where("segment is null").select("doc_id", "n", "key", "parity")
    # One row a segment comes to the driver: a fixed 2**SKETCH_BITS bytes before compression.
    rows = profiled.where("segment is not null").select("segment", "sketch").repartition(SEGMENTS, "segment").mapInArrow(_classes, "segment int, classes binary").collect()
    parts = {r["segment"]: r["classes"] for r in rows}
    size = (1 << SKETCH_BITS) // SEGMENTS
    classes = zlib.compress(b"".join(zlib.decompress(parts[s]) if s in parts else bytes(size) for s in range(SEGMENTS)), 1)
    release()
    total = profile.agg(F.sum("n")).first()[0] or 0
    segments = max(12, -(-int(total * (1 - threshold[0] / threshold[1])) // SEGMENT_ENTRIES))
    packed = source.select("text").mapInArrow(_index(classes, segments, width, threshold), _INDEX).repartition(segments, "segment")
    met = written(packed.mapInArrow(_postings(threshold), _LISTS), "met")
    tried = met.where("a is not null").select("a", "b").distinct()
    tried = written(tried, "tried")
    links = written(_verify(spark, source, profile, tried, width, threshold), "links")
    nodes = written(_nodes(profile), "nodes")
    # What is left of the longer lists: pairs whose classes are not in one component yet.
    lists = met.where("list is not null").groupBy("list", "kind", "key", "n", "single").agg(F.max("reach").alias("reach"))
    found = _classed(nodes, links)
    placed = lists.join(found, "key", "left").select("list", "kind", "key", "n", "single", "reach", F.coalesce(F.col("component"), _moved("key", -(1 << 65))).alias("c"))
    # Only lists over several components; their largest component's inner pairs need no look.
    # A list of a frequent shingle alone is asked only for the sets that do not index it in pairs.
    spread = placed.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("kind").alias("k"), F.max("single").alias("s")).where("low < high and (k = 0 or s)").select("list")
    # Written, as what follows uses it several times: as one plan it all had 54 exchanges.
    open_ = written(placed.join(spread, "list"), "open-lists")
    top = open_.groupBy("list", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("list").agg(F.max(F.struct("k", "c")).alias("t")).select("list", F.col("t.c").alias("t"))
    sides = open_.join(top, "list").groupBy("list", "t").agg(F.sum(F.expr("if(c != t, 1, 0)")).alias("strays"), F.sum(F.expr("if(single, 1, 0)")).alias("singles"), F.max("kind").alias("of"), F.count(F.lit(1)).alias("all"))
    # Every pair asked for has a side outside the largest component, and in such a list a side that is single: the fewer go first.
    # Of long lists each block of one side meets each block of the other by itself.
    sides = sides.withColumn("by_single", F.expr("of = 1 and singles < strays"))
    sides = sides.select("list", "t", "by_single", F.expr(f"cast(ceil(if(by_single, singles, strays) / {SQUARE}) as int)").alias("bx"), F.expr(f"cast(ceil(all / {SQUARE}) as int)").alias("by"))
    open_ = written(open_.join(sides, "list").withColumn("first", F.expr("if(by_single, single, c != t)")).drop("t", "by_single"), "open")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    x = open_.where("first").select("list", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("reach").alias("rx"), F.col("c").alias("cx"), "kind", F.col("single").alias("sx"), place("bx").alias("i"), span("by").alias("j"))
    y = open_.where("bx > 0").select("list", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("reach").alias("ry"), F.col("c").alias("cy"), "first", F.col("single").alias("sy"), place("by").alias("j"), span("bx").alias("i"))
    p, q = threshold
    meets = f"cx != cy and (not first or x < y) and (kind = 0 or sx or sy) and least(nx, ny) * {q} >= greatest(nx, ny) * {p} and least(rx, ry) * {p + q} >= (nx + ny) * {p}"
    rest = x.join(y, ["list", "i", "j"]).where(meets).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = written(links.unionByName(_verify(spark, source, profile, rest, width, threshold)), "links")
        found = _classed(nodes, links)
    return profile.drop("parity"), links, found


def _moved(value: str, by: int) -> F.Column:
    """A long moved by a constant, as a decimal."""
    return F.expr(f"cast(cast({value} as decimal(20,0)) + cast('{by}' as decimal(20,0)) as decimal(20,0))")


#: Nodes from here on are classes none of whose rows has an id, by their keys: they stand behind all ids.
_UNNAMED = 1 << 63


def _nodes(profile: DataFrame) -> DataFrame:
    """key, node of each class: its smallest id, so that a component's smallest node is what its rows are named by."""
    firsts = profile.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    return firsts.select("key", F.coalesce(F.col("first").cast("decimal(20,0)"), _moved("key", 2 * _UNNAMED)).alias("node"))


def _classed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, component of the classes of links between keys, as a table of its own."""
    ends = lambda x: nodes.select(F.col("key").alias(x), F.col("node").alias(f"node_{x}"))
    named = links.select("a", "b").join(ends("a"), "a").join(ends("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return written(nodes.join(components(named), "node").select("key", "component"), "classed")


def _verify(spark, source: DataFrame, profile: DataFrame, pairs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs of keys whose sets are similar; each class's set comes from its first document, or from a row of its key if none has an id.

    Pairs whose parity sketches show too large a difference go before any set is fetched.
    """
    p, q = threshold
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    known = profile.where("parity is not null and key is not null").join(asked, "key", "left_semi").groupBy("key").agg(F.min(F.struct("n", "parity")).alias("k")).select("key", "k.*")
    known = written(known, "parities")
    bits = pairs.join(known.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a").join(known.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")
    # Sketches of unequal length: the longer one is folded upon itself, to the shorter one's length.
    fold = "if(size({0}) <= size({1}), {0}, transform(sequence(0, size({1}) - 1), i -> aggregate(sequence(i, size({0}) - 1, size({1})), 0L, (t, j) -> t ^ get({0}, j))))"
    apart = f"aggregate(zip_with({fold.format('pa', 'pb')}, {fold.format('pb', 'pa')}, (x, y) -> bit_count(x ^ y)), 0L, (t, x) -> t + x)"
    pairs = written(bits.where(f"{apart} * {p + q} <= (na + nb) * {q - p}").select("a", "b"), "pairs")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    firsts = written(profile.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(needed, "key", "left_semi"), "firsts")
    parts = firsts.select("doc_id", "key").coalesce(8).mapInArrow(_filter_parts, "bits binary").collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    sets = source.mapInArrow(_fetch(zlib.compress(bits.tobytes(), 1), width), "doc_id long, key long, set binary")
    sets = written(sets.join(firsts, (sets["key"] == firsts["key"]) & sets["doc_id"].eqNullSafe(firsts["doc_id"]), "left_semi").dropDuplicates(["key"]).select("key", "set"), "sets")
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_linked(threshold), "a long, b long")


def labelled(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest id reachable by links; without words, the row's own, and null if no text of the component has an id."""
    # A component is named by its smallest id from the start: no component's rows have to meet.
    named = _nodes(profile).join(classes, "key", "left").select("key", F.coalesce("component", "node").alias("c"))
    named = named.select("key", F.when(F.expr(f"c < cast('{_UNNAMED}' as decimal(20,0))"), F.col("c").cast("long")).alias("component_id"))
    # Written, so that the rows of a class with many copies can be dealt out when they meet its name.
    named = written(named, "named")
    return profile.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: Ids up to this number may be broadcast to leave their documents out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def distinct(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row, that of the smallest id, of each component.

    Texts without words, and rows whose id is null, stay. Rows that share an id are judged each by its text: of those with
    the smallest id of their component one stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = keyed(plain(docs))
    # The key of a row stands for its id, so that texts that share an id are not one.
    profile, _, classes = join(rows, width, threshold, "row", names[docs.columns.index(text)])
    each = labelled(profile, classes).where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    ids = rows.select("row", F.col(names[docs.columns.index(doc)]).cast("long").alias("id")).where("id is not null")
    each = written(each.join(ids, "row"), "members")
    first = each.groupBy("component").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "row"))["row"].alias("first")).where("times > 1")
    gone = written(meet(each, written(first, "firsts"), ["component"], "times", each.count()).where("row != first").select("row"), "copies")
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*names).toDF(*docs.columns)
