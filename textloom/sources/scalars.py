"""Scalar logs of training runs: event files as rows (path, tag, step, value).

An event file is a row of records: length (8 bytes), its checksum (4), data, its checksum (4). The data is a protocol
buffer with the step in field 2 and a summary in field 5, whose values have their tag in field
1 and a number in field 2, or in a tensor in field 8. A file is read in pieces, each by its own task: where a piece begins, the
first place whose length and checksum agree is a record's. The first record that is damaged or cut off ends its file, whichever piece it is in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from textloom.session import temporary

#: Bytes of a piece, and the largest record; a longer one counts as damaged.
PIECE = 1 << 22
LARGEST = 1 << 20


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)  # fixed value: the polynomial of CRC-32C, reflected
        out.append(n)
    return out


_CRC = _table()


def checksum(data: bytes) -> int:
    """The CRC-32C of the data as these files have it: turned by 15 bits, with a constant added."""
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _CRC[(c ^ b) & 0xFF]
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF  # fixed value of the format


def record(data: bytes) -> bytes:
    """The data as a record."""
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", checksum(length)) + data + struct.pack("<I", checksum(data))


def _varint(n: int) -> bytes:
    out = b""
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def event(step: int, tag: str, value: float) -> bytes:
    """A scalar as the data of a record."""
    sized = lambda number, data: _varint(number << 3 | 2) + _varint(len(data)) + data
    number = sized(1, tag.encode()) + b"\x15" + struct.pack("<f", value)
    return b"\x10" + _varint(step & (1 << 64) - 1) + sized(5, sized(1, number))


def event_record(step: Column | str, tag: Column | str, value: Column | str) -> Column:
    """A column of records, one a scalar."""

    @pandas_udf("binary")
    def run(step: pd.Series, tag: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([record(event(int(s), t, float(v))) for s, t, v in zip(step, tag, value, strict=True)], dtype=object)

    return run(step, tag, value)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: integers of varints, bytes of all others."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


def _number(value: dict[int, int | bytes]) -> float | None:
    if 2 in value:
        return struct.unpack("<f", value[2])[0]
    tensor = dict(_fields(value[8])) if 8 in value else {}
    # Type 1 is a float, in one of two places; type 2 a double.
    for kind, form, places in ((1, "<f", (4, 5)), (2, "<d", (4, 6))):
        if tensor.get(1) == kind:
            raw = next((tensor[p] for p in places if p in tensor), b"")
            return struct.unpack(form, raw)[0] if len(raw) == struct.calcsize(form) else None
    return None


def scalars_of(data: bytes) -> Iterator[tuple[str, int, float]]:
    """(tag, step, value) of the scalars of a record's data."""
    fields = list(_fields(data))
    step = next((v for k, v in fields if k == 2), 0)
    for summary in (v for k, v in fields if k == 5):
        for value in (dict(_fields(v)) for k, v in _fields(summary) if k == 1):
            number = _number(value)
            if number is not None:
                yield value.get(1, b"").decode(), step - (1 << 64) * (step >> 63), number


def _length(data: bytes, at: int, largest: int) -> int | None:
    """The length of the record at a place, if its checksum agrees."""
    if at + 12 > len(data):
        return None
    n, check = struct.unpack_from("<QI", data, at)
    return n if n <= largest and check == checksum(data[at : at + 8]) else None


def records(data: bytes, first: bool, piece: int, largest: int = LARGEST) -> tuple[list[tuple[int, bytes]], int | None, int | None]:
    """(place, data) of the records that begin in the first `piece` bytes, the place of the first of them, and that behind the last.

    Unless it is the file's first piece, what stands before the first place that can be a record's is the end of the piece before; no such place is None. Reading
    stops before a record that is damaged or cut off.
    """
    at, bound = 0, min(piece, len(data))
    if not first:
        while at < bound and _length(data, at, largest) is None:
            at += 1
        if at == bound:
            return [], None, None
    begin, out = at, []
    while at < bound:
        n = _length(data, at, largest)
        body = data[at + 12 : at + 12 + n] if n is not None and at + 16 + n <= len(data) else None
        if body is None or struct.unpack_from("<I", data, at + 12 + n)[0] != checksum(body):
            break
        out.append((at, body))
        at += 16 + n
    return out, begin, at


_FOUND = "path string, place long, tag string, step long, value double, stop long"


def _reader(piece: int, largest: int):
    """The scalars of pieces, and for each a row without a tag: from where to where its records go."""
    kinds = {"path": pa.string(), "place": pa.int64(), "tag": pa.string(), "step": pa.int64(), "value": pa.float64(), "stop": pa.int64()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start, content in zip(*(part.column(c).to_pylist() for c in ("path", "start", "content")), strict=True):
                found, (whole, begin, stop) = [], records(content, start == 0, piece, largest)
                for at, body in whole:
                    try:
                        found += [(start + at, *s, None) for s in scalars_of(body)]
                    except (IndexError, KeyError, UnicodeDecodeError, struct.error):  # whole, but no event
                        stop = at
                        break
                found.append((begin if begin is None else start + begin, None, None, None, stop if stop is None else start + stop))
                columns = [[path] * len(found), *([f[i] for f in found] for i in range(5))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return run


def scalars_in(files: DataFrame, path: Column | str = "path", content: Column | str = "content") -> DataFrame:
    """path, tag, step, value of all scalars of event files (path, content), up to each file's first record that is damaged or cut off.

    Files are cut into pieces that are dealt out. Contents that are null or empty have no scalars.
    """
    path, content = (F.col(c) if isinstance(c, str) else c for c in (path, content))
    whole = files.select(path.alias("path"), content.alias("whole"))
    # A piece goes on for the longest record that may begin in it.
    starts = F.expr(f"sequence(0L, greatest(octet_length(whole) - 1, 0) div {PIECE} * {PIECE}, {PIECE}L)")
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring("whole", (s + 1).cast("int"), F.lit(PIECE + LARGEST + 16)).alias("content")))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = whole.where("octet_length(whole) > 0").select("path", F.explode(cut).alias("p")).select("path", "p.*").repartition(tasks)
    read = temporary(files.sparkSession, "scalars")
    pieces.mapInArrow(_reader(PIECE, LARGEST), _FOUND).write.parquet(read)
    found = files.sparkSession.read.schema(_FOUND).parquet(read)
    # Where the records of a piece do not begin at the end of those before, the file ends: a row a piece tells.
    told = found.where("tag is null and place is not null").select("path", "stop", F.lead("place").over(Window.partitionBy("path").orderBy("place")).alias("next"))
    ends = told.where("next != stop").groupBy("path").agg(F.min("stop").alias("end"))
    held = found.where("tag is not null")
    return held.join(ends, "path", "left").where("end is null or place < end").select("path", "tag", "step", "value")


def scalar_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, tag, step, value of all scalars of event files."""
    return scalars_in(spark.read.format("binaryFile").load(paths))


def series(scalars: DataFrame, *by: str) -> DataFrame:
    """by, tag, points: each tag's (step, value) in order."""
    return scalars.groupBy(*by, "tag").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("points"))


def step_of(scalars: DataFrame, *by: str) -> DataFrame:
    """The largest step that any scalar of each group has."""
    return scalars.groupBy(*by).agg(F.max("step").alias("step"))
