"""Benchmark decontamination with a generalised suffix automaton over the test items' words.

Training texts stream through the automaton once; at every word the longest match that ends
there is known, so that every occurrence of an item window is found without listing windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.llm._bytes import ALNUM, Words, slices
from textloom.llm._spark import keyed, plain, written

WINDOW = 13
#: Items are put into automata of so many words each, or of one longer item, which bounds what is broadcast
#: and held by a worker; more items mean more passes over the texts, put together by a key of the rows, with the same results.
BLOCK_WORDS = 200_000


class Automaton:
    """Suffix automaton of several word sequences, with the windows of each item marked.

    A window is `window` consecutive words of an item, or the whole of a shorter one. Items (ids, text) of the same words are one.
    """

    def __init__(self, items: list[tuple[list, bytes]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t for _, t in items], pa.binary())
        hashes, bounds = [np.zeros(0, np.uint64)], [0]
        for _, _, data, offs in slices(texts):
            w = Words(data, offs, ALNUM)
            hashes.append(w.hashes())
            bounds += list(bounds[-1] + w.bounds[1:])
        flat = np.concatenate(hashes)
        self.vocab, ids = np.unique(flat, return_inverse=True)
        # The names of each distinct sequence of words: however many items have it, it is marked once.
        named: dict[tuple[int, ...], set[str]] = {}
        for i, (keys, _) in enumerate(items):
            named.setdefault(tuple(ids[bounds[i] : bounds[i + 1]].tolist()), set()).update(str(k) for k in keys if k is not None)
        self.names = [sorted(x) for x in named.values()]
        sequences = [list(s) for s in named]
        self.least = min([min(len(s), window) for s in sequences if s], default=0)
        self._next: list[dict[int, int]] = [{}]
        self._link, self._len = [-1], [0]
        for s in sequences:
            self._insert(s)
        self._mark(sequences)
        pairs = [np.array(s[:-1], np.int64) * len(self.vocab) + np.array(s[1:], np.int64) for s in sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _insert(self, sequence: list[int]) -> None:
        nxt, link, length = self._next, self._link, self._len

        def split(p: int, q: int, word: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(word) == q:
                nxt[p][word] = clone
                p = link[p]
            link[q] = clone
            return clone

        last = 0
        for word in sequence:
            q = nxt[last].get(word)
            if q is not None:  # this prefix is known from an earlier item
                last = q if length[q] == length[last] + 1 else split(last, q, word)
                continue
            new, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else split(p, q, word)
            last = new

    def _mark(self, sequences: list[list[int]]) -> None:
        """anchor: the state that holds the last `window` words of a longer match; of[anchor]: the items with that window."""
        n = len(self._next)
        order = sorted(range(n), key=self._len.__getitem__)
        self.anchor = [-1] * n
        own: dict[int, list[tuple[int, int]]] = {}
        for s in order[1:]:
            up = self._link[s]
            if self._len[s] >= self.window:
                self.anchor[s] = s if self._len[up] < self.window else self.anchor[up]
        self.of: dict[int, set[int]] = {}
        for i, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence, 1):
                state = self._next[state][word]
                if at >= self.window:
                    self.of.setdefault(self.anchor[state], set()).add(i)
            if 0 < len(sequence) < self.window:
                own.setdefault(state, []).append((len(sequence), i))
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        if own:
            for s in order[1:]:
                self.short[s] = (*self.short[self._link[s]], *own.get(s, ()))

    def match(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """(which words are hit, the distinct sequences of each document) of one slice of texts."""
        hit = np.zeros(len(words.starts) + 1, np.int64)
        found: list[set[int]] = [set() for _ in words.counts]
        if not self.least or not len(words.starts):
            return hit[:-1] > 0, found
        hashes, document = words.hashes(), words.document()
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, hashes[maybe]), len(self.vocab) - 1)
        same = self.vocab[at] == hashes[maybe]
        ids = np.full(len(hashes), -1, np.int64)
        ids[maybe[same]] = at[same]
        # A match of k words needs k known words in a row, each pair of which some item has.
        if self.least == 1:
            chained = (ids[:-1] >= 0) & (ids[1:] >= 0) & (document[:-1] == document[1:])
            lone = ids >= 0
        else:
            chained = np.zeros(max(len(ids) - 1, 0), dtype=bool)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (document[:-1] == document[1:]))
            code = ids[both] * len(self.vocab) + ids[both + 1]
            where = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            chained[both[self.pairs[where] == code]] = True
            lone = None
        change = np.diff(np.concatenate([[False], chained, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + 1
        if lone is not None:  # single words outside longer runs
            lone = lone.copy()
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, begins, 1)
            np.add.at(inside, ends, -1)
            lone &= np.cumsum(inside)[:-1] == 0
            begins, ends = np.concatenate([begins, np.flatnonzero(lone)]), np.concatenate([ends, np.flatnonzero(lone) + 1])
        long = ends - begins >= self.least
        for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            self._walk(ids[b:e].tolist(), b, hit, found[document[b]])
        return np.cumsum(hit)[:-1] > 0, [self._sequences(marks) for marks in found]

    def _sequences(self, marks: set[int]) -> set[int]:
        """What the marks of a document stand for: a window's state all sequences with that window, a negative number one short sequence."""
        out = {-1 - m for m in marks if m < 0}
        for m in marks:
            if m >= 0:
                out |= self.of.get(m, set())
        return out

    def _walk(self, ids: list[int], base: int, hit: np.ndarray, marks: set[int]) -> None:
        nxt, link, length, window = self._next, self._link, self._len, self.window
        state = matched = 0
        for i, word in enumerate(ids, base + 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word not in nxt[state]:
                continue
            state = nxt[state][word]
            matched += 1
            # The state may stand for longer strings than the match; its suffixes begin below it.
            if matched >= window:
                hit[i - window] += 1
                hit[i] -= 1
                marks.add(self.anchor[state])
            for n, short in self.short[state]:  # one of each length at most
                if n <= matched:
                    hit[i - n] += 1
                    hit[i] -= 1
                    marks.add(-1 - short)


_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))])
_SPARK = "doc_id long, n_words long, items array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"

_cache: dict[str, Automaton] = {}


def _automaton(key: str, shared, window: int) -> Automaton:
    """The automaton of a block of items that was broadcast; a worker keeps the last one."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton(shared.value, window)
    return _cache[key]


def _sent(spark, block: list[tuple[list, bytes]], window: int) -> tuple[object, int, str]:
    """What a scan of the block needs: the items, broadcast, the window, and the name of its automaton."""
    return spark.sparkContext.broadcast(block), window, hashlib.sha256(repr((window, block)).encode()).hexdigest()


def _scan(shared, window: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared, window)
        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                words = Words(data, offs, ALNUM)
                hit, found = automaton.match(words)
                spans: list[list[dict]] = [[] for _ in found]
                change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for b, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
                    while b < e:  # a run of hit words may go on in the next document
                        d = int(np.searchsorted(words.bounds, b, side="right")) - 1
                        stop = min(e, int(words.bounds[d + 1]))
                        base = int(words.bounds[d])
                        spans[d].append({"first": b - base, "last": stop - 1 - base, "start": int(words.starts[b] - offs[d]), "end": int(words.ends[stop - 1] - offs[d])})
                        b = stop
                names = [sorted({n for i in s for n in automaton.names[i]}) if len(s) > 1 else [n for i in s for n in automaton.names[i]] for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(words.counts, pa.int64()), pa.array(names, _TYPE.field(2).type), pa.array(spans, _TYPE.field(3).type)], schema=_TYPE)

    return run


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[list, bytes]]]:
    """Distinct texts with their ids in blocks of bounded size; the test set streams through the driver, one partition and one block at a time."""
    block: dict[bytes, list] = {}
    size = 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(item), F.encode(F.col(text), "UTF-8")).toLocalIterator():
        data = bytes(row[1])
        if data not in block:
            n = int(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM).counts[0])
            if block and size + n > BLOCK_WORDS:
                yield [(k, d) for d, k in block.items()]
                block, size = {}, 0
            size += n
        block.setdefault(data, []).append(row[0])
    if block:
        yield [(k, d) for d, k in block.items()]


def _first(benchmark: DataFrame, item: str, text: str) -> tuple[list[tuple[list, bytes]], Iterator[list[tuple[list, bytes]]] | None]:
    """The first block, and all of them if there are more."""
    blocks = _blocks(benchmark, item, text)
    first, second = next(blocks, []), next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, items, spans of each document row.

    items: the sorted ids, as strings, of the items with a window in the text. spans: the
    runs of hit words, with first and last word and start and end byte. Null and empty texts
    have no words and no spans; items without words, or null, match nothing; an item with a
    null id marks words but is not listed. Repeated rows, and rows whose id is null, are judged each by itself.
    Where the test set needs several blocks, rows get a key by which the blocks' findings are put together.
    """
    first, blocks = _first(benchmark, item, item_text)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if blocks is None:
        return source.mapInArrow(_scan(*_sent(docs.sparkSession, first, window)), _SPARK)
    rows = keyed(source)
    found = _scanned(rows.select(F.col("row").alias("doc_id"), "text"), blocks, window).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def _scanned(source: DataFrame, blocks: Iterator[list[tuple[list, bytes]]], window: int) -> DataFrame:
    """matches() of rows (doc_id, text) under several blocks, one after the other; doc_id has to be a key.

    Each block's findings are written before the next one is sent, so that the driver and the workers hold one at a time.
    """
    parts = []
    for block in blocks:
        sent = _sent(source.sparkSession, block, window)
        part = source.mapInArrow(_scan(*sent), _SPARK)
        # All rows come from the first block, of the others those with hits.
        parts.append(written(part.where("size(spans) > 0") if parts else part, "block-hits"))
        sent[0].destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    joined = out.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Spans of different blocks may overlap: fold them into disjoint ones.
    fold = """aggregate(spans, cast(array() as array<struct<first:int,last:int,start:int,end:int>>), (done, s) ->
        case when size(done) > 0 and element_at(done, -1).last >= s.first - 1
             then concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last), 'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
             else concat(done, array(s)) end)"""
    return joined.withColumn("spans", F.expr(fold))


def judged(found: DataFrame, share: float = 0.05) -> DataFrame:
    """n_hit and contaminated (hit words reach the share of all words) beside matches()."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") / F.col("n_words") >= F.lit(share)))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op1 query."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut(docs: DataFrame, found: DataFrame, span_words: int = WINDOW, share: float = 0.05, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without contamination: those over the coverage share go, spans of span_words or more are cut out of the rest.

    found: matches() of rows whose key is in the column doc; rows whose key is null are kept as they are.
    """
    marks = judged(found, share).where("contaminated or size(filter(spans, s -> s.last - s.first + 1 >= %d)) > 0" % span_words)
    marks = marks.select(F.col("doc_id").alias("key"), F.col("contaminated").alias("bad"), F.expr(f"filter(spans, s -> s.last - s.first + 1 >= {span_words})").alias("long"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, own = names[docs.columns.index(doc)], names[docs.columns.index(text)]
    both = plain(docs).join(marks, F.col(key) == F.col("key"), "left").where("bad is null or not bad")
    raw = f"encode({own}, 'UTF-8')"
    kept = f"""decode(aggregate(long, named_struct('out', cast('' as binary), 'at', 0), (a, s) ->
        named_struct('out', concat(a.out, substring({raw}, a.at + 1, s.start - a.at)), 'at', s.end),
        a -> concat(a.out, substring({raw}, a.at + 1))), 'UTF-8')"""
    return both.withColumn(own, F.when(F.coalesce(F.size("long"), F.lit(0)) > 0, F.expr(kept)).otherwise(F.col(own))).select(*names).toDF(*docs.columns)


def _clean(shared, window: int, key: str, column: int, share: float, span_words: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared, window)
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            rest: dict[int, str] = {}
            for first, end, data, offs in slices(batch.column(column)):
                words = Words(data, offs, ALNUM)
                hit, _ = automaton.match(words)
                n_hit = np.bincount(words.document()[hit], minlength=end - first)
                good[first:end] = (n_hit == 0) | (n_hit / np.maximum(words.counts, 1) < share)
                if span_words is not None:
                    for d in np.flatnonzero((n_hit >= span_words) & good[first:end]).tolist():
                        a, b = words.bounds[d], words.bounds[d + 1]
                        change = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                        begins, ends = a + np.flatnonzero(change == 1), a + np.flatnonzero(change == -1)
                        long = ends - begins >= span_words
                        if long.any():
                            edges = [offs[d], *np.stack([words.starts[begins[long]], words.ends[ends[long] - 1]], axis=1).ravel().tolist(), offs[d + 1]]
                            rest[first + d] = b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)).decode()
            if rest:
                changed = np.zeros(batch.num_rows, dtype=bool)
                changed[list(rest)] = True
                texts = pc.replace_with_mask(batch.column(column), pa.array(changed), pa.array([rest[i] for i in sorted(rest)], batch.column(column).type))
                batch = batch.set_column(column, batch.schema.field(column), texts)
            yield batch.filter(pa.array(good))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span_words: int | None = None) -> DataFrame:
    """The documents, with all columns, but for those of whose words the share or more are in windows of the benchmark.

    Null and empty texts stay. With span_words, the runs of so many hit words or more are cut
    out of the texts that stay; otherwise these stay whole. With one block of items rows are
    judged where they are, and texts are not shuffled; with more, rows get a key by which
    verdicts meet them.
    """
    first, blocks = _first(benchmark, item, item_text)
    if not first:
        return docs
    if blocks is None:
        return docs.mapInArrow(_clean(*_sent(docs.sparkSession, first, window), docs.columns.index(text), share, span_words), docs.schema)
    rows = keyed(plain(docs))
    own = f"c{docs.columns.index(text)}"
    found = _scanned(rows.select(F.col("row").alias("doc_id"), F.col(own).cast("string").alias("text")), blocks, window)
    # Without spans to cut, no run of words is long enough.
    return cut(rows, found, span_words if span_words is not None else 1 << 30, share, "row", own).drop("row").toDF(*docs.columns)
