"""Tokenizers: characters, and byte-pair encoding trained on a bounded sample or on all of a corpus."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

from textloom.operators import byte_pairs
from textloom.sources.manifests import read_text, write_text

SPECIALS = ("<bos>", "<eos>", "<pad>")


def character_vocabulary(df: DataFrame, text: str = "text", specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """token, id: special tokens first, then the distinct characters by code point. The alphabet is small; only it is numbered."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("token")).where("token != ''").distinct()
    numbered = chars.withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1 + len(specials)).cast("int"))
    spark = df.sparkSession
    return spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int").unionByName(numbered)


def _pieces(text: str, specials: Sequence[str]) -> list[str]:
    """Plain text and special tokens by turns, the leftmost and of these the longest first."""
    if not specials:
        return [text]
    return re.split("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")", text)


def once(function):
    """A Python function whose result is computed once where it is used often: Spark leaves such a call where it stands."""
    return function.asNondeterministic()


def _lists(rows: Sequence[np.ndarray | Sequence[int] | None]) -> pa.Array:
    """Arrays of ids as one Arrow array: no Python object is made for an id."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in rows)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in rows if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in rows], pa.bool_()))


def _arrays(values: pa.Array) -> Iterator[np.ndarray | None]:
    for v in values:
        yield v.values.to_numpy(zero_copy_only=False) if v.is_valid else None


def _known(values: pa.Array, encode) -> pa.Array:
    """The ids of the texts that are there, by a function of all of them."""
    found = iter(encode(values.drop_null().to_pylist()))
    return _lists([next(found) if there else None for there in values.is_valid().to_pylist()])


#: Code points there are: an alphabet is no larger, which bounds what encoding broadcasts to 4.5 MB.
_POINTS = 0x110000


def character_encode(df: DataFrame, vocabulary: dict[str, int], text: str = "text", specials: Sequence[str] = ()) -> DataFrame:
    """df with tokens, the ids of the text's characters and of the special tokens in it; a character outside the vocabulary is an error."""
    table = np.full(_POINTS, -1, np.int32)
    for token, i in vocabulary.items():
        if len(token) == 1:
            table[ord(token)] = i
    shared = df.sparkSession.sparkContext.broadcast(table)

    def plain(value: str) -> np.ndarray:
        ids = shared.value[np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(ids) and ids.min() < 0:
            raise KeyError(f"unknown character {value[int(ids.argmin())]!r}")
        return ids

    def encode(value: str) -> np.ndarray:
        parts = [plain(p) if k % 2 == 0 else np.array([vocabulary[p]], np.int32) for k, p in enumerate(_pieces(value, specials))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    @arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return _known(values, lambda found: map(encode, found))

    return df.withColumn("tokens", once(run)(text))


def character_decode(df: DataFrame, vocabulary: dict[str, int], tokens: str = "tokens", specials: Sequence[str] = SPECIALS, out: str = "decoded") -> DataFrame:
    """df with the text of the ids, special tokens left out; an id outside the vocabulary is an error."""
    texts = {i: "" if t in specials else t for t, i in vocabulary.items()}

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "".join(map(texts.__getitem__, v.tolist())) for v in _arrays(values)], pa.string())

    return df.withColumn(out, run(tokens))


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """left, right, n of a partition's neighbouring bytes."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for texts in _groups(batch.column(0).to_pylist()):
            ids = byte_pairs.joined(texts)
            real = (ids[:-1] >= 0) & (ids[1:] >= 0)
            total += np.bincount(ids[:-1][real] * 256 + ids[1:][real], minlength=1 << 16)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found >> 8, pa.int32()), pa.array(found & 255, pa.int32()), pa.array(total[found])], names=["left", "right", "n"])


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """left, right, n of neighbouring bytes of the UTF-8 texts, overlapping ones counted. A task counts in one array; no row is made for a byte."""
    raw = df.where(F.col(text).isNotNull()).select(F.encode(text, "UTF-8").alias("b"))
    return raw.mapInArrow(_byte_pairs, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def merge(tokens: list[bytes], left: bytes, right: bytes) -> list[bytes]:
    """Left to right, without overlap."""
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and tokens[i] == left and tokens[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def train_merges(texts: Iterator[str], merges: int) -> list[tuple[bytes, bytes]]:
    """Byte-pair merges of a few texts, one by one, as byte_pairs.train learns them of a table: the most frequent pair each time, the smallest of equals.

    Ends early when no pair is left or the merged bytes exist already. Counts are kept up to
    date for the sequences that a merge touches.
    """
    sequences = [[bytes([b]) for b in t.encode()] for t in texts]
    counts: Counter = Counter()
    where: dict = defaultdict(set)
    for i, s in enumerate(sequences):
        for p in zip(s, s[1:], strict=False):
            counts[p] += 1
            where[p].add(i)
    known, out = {bytes([b]) for b in range(256)}, []
    while len(out) < merges and counts:
        best = min(counts, key=lambda p: (-counts[p], p))
        if best[0] + best[1] in known:
            break
        known.add(best[0] + best[1])
        out.append(best)
        for i in where.pop(best):
            s = sequences[i]
            for p in zip(s, s[1:], strict=False):
                counts[p] -= 1
                if not counts[p]:
                    del counts[p]
            sequences[i] = s = merge(s, *best)
            for p in zip(s, s[1:], strict=False):
                counts[p] += 1
                where[p].add(i)
    return out


def train_on(df: DataFrame, merges: int, text: str = "text") -> DataFrame:
    """rank, left, right (hex) of the merges of a table, which byte_pairs.train learns on the executors. A row a merge."""
    got = [(i, a.hex(), b.hex()) for i, (a, b) in enumerate(byte_pairs.train(df, merges, text))]
    return df.sparkSession.createDataFrame(got, "rank int, left string, right string")


#: Texts are put together in groups of about so many bytes.
_GROUP_BYTES = 1 << 19


def _groups(texts: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class BytePairs:
    """Merges and special tokens. Ids: special tokens in their order, then the 256 bytes, then the merges."""

    merges: tuple[tuple[bytes, bytes], ...]
    specials: tuple[str, ...] = ()
    bos: str | None = None
    eos: str | None = None
    pad: str | None = None
    table: tuple[bytes, ...] = field(init=False, repr=False, compare=False)
    steps: tuple[tuple[int, int], ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        table = (*(bytes([b]) for b in range(256)), *(a + b for a, b in self.merges))
        place = {t: i for i, t in enumerate(table)}
        steps = tuple((place.get(a, len(table)), place.get(b, len(table))) for a, b in self.merges)
        if len(place) != len(table) or any(max(s) >= 256 + k for k, s in enumerate(steps)):
            raise ValueError("each merge has to make a new token out of bytes and earlier ones")
        object.__setattr__(self, "table", table)
        object.__setattr__(self, "steps", steps)

    @property
    def marks(self) -> tuple[str, ...]:
        """All special tokens in the order of their ids: those of the document's ends first."""
        return tuple(dict.fromkeys(t for t in (self.bos, self.eos, self.pad, *self.specials) if t is not None))

    @property
    def size(self) -> int:
        return len(self.marks) + len(self.table)

    def id_of(self, special: str) -> int:
        return self.marks.index(special)

    def encode_all(self, texts: Sequence[str], bos: bool = False, eos: bool = False) -> list[np.ndarray]:
        """The ids of each text. Special tokens in a text are one id each; its plain parts are merged by themselves.

        The lowest-ranked pair that is left is always merged next, by a queue of ranks over all texts
        of a group together; equal texts are looked at once.
        """
        found: dict[str, np.ndarray] = {}
        out: list[np.ndarray] = []
        base, code, steps = len(self.marks), {t: k for k, t in enumerate(self.marks)}, byte_pairs.Steps(self.steps)
        distinct = list(dict.fromkeys(texts))
        for group in _groups([t.encode() for t in distinct]):
            pieces = [_pieces(t.decode(), self.specials) for t in group]
            ids = byte_pairs.joined([p.encode() for text in pieces for p in text[::2]])
            # Behind each plain part but a text's last stands its special token; -1 ends a text.
            ids[ids < 0] = [x for text in pieces for x in (*(-2 - code[p] for p in text[1::2]), -1)]
            chain = byte_pairs.Chain(ids, steps)
            chain.run()
            ids = chain.tokens()
            ends = np.flatnonzero(ids == -1)
            ids = np.where(ids >= 0, ids + base, -2 - ids).astype(np.int32)
            out += [ids[a:b] for a, b in zip(np.append(0, ends[:-1] + 1), ends, strict=True)]
        first, last = ([self.id_of(t)] if wanted else [] for t, wanted in ((self.bos, bos), (self.eos, eos)))
        found.update(zip(distinct, [np.concatenate([first, x, last]).astype(np.int32) for x in out] if bos or eos else out, strict=True))
        return [found[t] for t in texts]

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        return self.encode_all([text], bos, eos)[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids, special tokens left out; bytes that are no UTF-8 become U+FFFD."""
        base = len(self.marks)
        return b"".join(self.table[i - base] for i in ids if i >= base).decode("utf-8", "replace")

    def to_json(self) -> str:
        body = {"format": "byte_pairs", "merges": [[a.hex(), b.hex()] for a, b in self.merges], "specials": list(self.specials), "bos": self.bos, "eos": self.eos, "pad": self.pad}
        return json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> BytePairs:
        body = json.loads(text)
        return BytePairs(tuple((bytes.fromhex(a), bytes.fromhex(b)) for a, b in body["merges"]), tuple(body["specials"]), body["bos"], body["eos"], body["pad"])

    def save(self, spark: SparkSession, folder: str) -> None:
        write_text(spark, f"{folder}/tokenizer.json", self.to_json())

    @staticmethod
    def load(spark: SparkSession, folder: str) -> BytePairs:
        return BytePairs.from_json(read_text(spark, f"{folder}/tokenizer.json"))


def save_characters(spark: SparkSession, vocabulary: dict[str, int], folder: str) -> None:
    """A character vocabulary as JSON with sorted keys."""
    write_text(spark, f"{folder}/tokenizer.json", json.dumps({"format": "characters", "vocabulary": vocabulary}, sort_keys=True, indent=2, ensure_ascii=False))


def load_characters(spark: SparkSession, folder: str) -> dict[str, int]:
    return json.loads(read_text(spark, f"{folder}/tokenizer.json"))["vocabulary"]


def bpe_encode(merges: Sequence[tuple[bytes, bytes]] | BytePairs, bos: bool = False, eos: bool = False):
    """An Arrow function from text to token ids."""
    tokens = merges if isinstance(merges, BytePairs) else BytePairs(tuple(merges))

    @arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return _known(values, lambda found: tokens.encode_all(found, bos, eos))

    return once(run)


def bpe_decode(merges: Sequence[tuple[bytes, bytes]] | BytePairs):
    """An Arrow function from token ids to text."""
    tokens = merges if isinstance(merges, BytePairs) else BytePairs(tuple(merges))

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else tokens.decode(v.tolist()) for v in _arrays(values)], pa.string())

    return run


class LibraryPairs:
    """Byte-pair encoding over words by the `tokenizers` library, where it is installed: for speed, with other merges than BytePairs, as words part the text first."""

    def __init__(self, body: str, specials: Sequence[str] = (), bos: str | None = None, eos: str | None = None, pad: str | None = None):
        self.body, self.specials, self.bos, self.eos, self.pad = body, tuple(specials), bos, eos, pad

    def _model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.body)

    @property
    def size(self) -> int:
        return self._model().get_vocab_size()

    def id_of(self, token: str) -> int:
        found = self._model().token_to_id(token)
        if found is None:
            raise ValueError(f"{token} is not in the vocabulary")
        return found

    @staticmethod
    def train(sample: DataFrame, size: int, specials: Sequence[str] = (), marks: Sequence[str] = SPECIALS, text: str = "text", pos: str = "pos") -> LibraryPairs:
        """Of a sample that has been bounded before, which streams to the driver in order. size: of the vocabulary, with special tokens and 256 bytes."""
        from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

        known = list(dict.fromkeys([*marks, *specials]))
        if size < len(known) + 256:
            raise ValueError("the vocabulary has to hold special tokens and 256 bytes")
        model = Tokenizer(models.BPE())
        model.pre_tokenizer, model.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
        trainer = trainers.BpeTrainer(vocab_size=size, min_frequency=1, special_tokens=known, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
        texts = [r[0] for r in sample.where(F.col(text).isNotNull()).orderBy(pos).select(text).toLocalIterator()]
        if not texts:
            raise ValueError("there is no document")
        model.train_from_iterator(texts, trainer=trainer, length=len(texts))
        return LibraryPairs(model.to_str(), specials, *(m if m in marks else None for m in SPECIALS))

    def encode_all(self, texts: Sequence[str], bos: bool = False, eos: bool = False) -> list[list[int]]:
        """The ids of each text; special tokens in a text are one id each."""
        model = self._model()
        ends = [[model.token_to_id(t)] if wanted else [] for t, wanted in ((self.bos, bos), (self.eos, eos))]
        out = []
        for t in texts:
            parts = [model.encode(p, add_special_tokens=False).ids if k % 2 == 0 else [model.token_to_id(p)] for k, p in enumerate(_pieces(t, self.specials))]
            out.append([*ends[0], *(i for p in parts for i in p), *ends[1]])
        return out

    def decode_all(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """The texts of ids, special tokens left out."""
        return self._model().decode_batch([np.asarray(x).tolist() for x in ids], skip_special_tokens=True)

    def save(self, spark: SparkSession, folder: str) -> None:
        body = {"format": "library_pairs", "tokenizer": json.loads(self.body), "specials": list(self.specials), "bos": self.bos, "eos": self.eos, "pad": self.pad}
        write_text(spark, f"{folder}/tokenizer.json", json.dumps(body, sort_keys=True, indent=2, ensure_ascii=False))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LibraryPairs:
        body = json.loads(read_text(spark, f"{folder}/tokenizer.json"))
        if body["format"] != "library_pairs":
            raise ValueError("a tokenizer of another kind")
        return LibraryPairs(json.dumps(body["tokenizer"]), body["specials"], body["bos"], body["eos"], body["pad"])


def library_encode(tokens: LibraryPairs, bos: bool = False, eos: bool = False):
    """An Arrow function from text to token ids."""

    @arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        return _known(values, lambda found: tokens.encode_all(found, bos, eos))

    return once(run)


def library_decode(tokens: LibraryPairs):
    """An Arrow function from token ids to text."""

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        found = iter(tokens.decode_all([v for v in _arrays(values) if v is not None]))
        return pa.array([next(found) if there else None for there in values.is_valid().to_pylist()], pa.string())

    return run
