"""Zip archives: archives within archives as rows, and bundles put together from members that the executors have compressed."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import report
from textloom.session import delete, temporary

MEMBER = "archive string, path string, size long, content binary, damaged string"


def members(archive: str, data: bytes, inner: str = ".zip") -> Iterator[tuple]:
    """Files of an archive and of the archives in it, as (archive, path, size, content, damaged); damaged names the first broken file."""
    try:
        opened = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield archive, None, len(data), None, archive
        return
    with opened:
        bad = opened.testzip()
        for info in sorted(opened.infolist(), key=lambda i: i.filename):
            if info.is_dir():
                continue
            content = None if info.filename == bad else opened.read(info)
            if content is not None and info.filename.endswith(inner):
                yield from members(f"{archive}!{info.filename}", content, inner)
            else:
                yield archive, info.filename, info.file_size, content, bad


def nested_in(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each file in the archives (path, content) and in archives within them; one archive is one task's work. Null contents have no files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(members(name, bytes(data)), columns=["archive", "path", "size", "content", "damaged"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("content is not null").mapInPandas(run, MEMBER)


def nested(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each file in the archives at the paths and in archives within them."""
    return nested_in(spark.read.format("binaryFile").load(paths))


def zipped(entries: DataFrame, archive: str, path: str = "path", content: str = "content") -> DataFrame:
    """path, content: a small zip for each value of the column `archive`, its name, of its entries in order of their paths. An archive is of bounded size, as one task makes it; a large one is a bundle."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for _, name, data in sorted(zip(part["archive"], part["path"], part["content"], strict=True), key=lambda r: r[1]):
                made.writestr(zipfile.ZipInfo(name), bytes(data), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": part["archive"].iloc[:1], "content": [out.getvalue()]})

    own = entries.select(F.col(archive).alias("archive"), F.col(path).alias("path"), F.coalesce(F.col(content), F.lit(b"")).alias("content"))
    return own.groupBy("archive").applyInPandas(run, "path string, content binary")


class Member(NamedTuple):
    """What the directory of an archive says of a member."""

    path: str
    size: int
    packed: int
    crc: int
    sha256: str


#: Fixed values of the archive format: signatures, version 2.0 (4.5 with long offsets), names in UTF-8, deflate, 1980-01-01.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_UTF8, _DEFLATE, _DATE = 1 << 11, 8, 0x21
_LONG = 0xFFFFFFFF


def _local(m: Member) -> bytes:
    name = m.path.encode()
    return struct.pack("<IHHHHHIIIHH", _LOCAL, 20, _UTF8, _DEFLATE, 0, _DATE, m.crc, m.packed, m.size, len(name), 0) + name


def _directory(found: list[tuple[Member, int]], at: int) -> Iterator[bytes]:
    """The directory of members with their offsets, which begins at byte `at`; offsets and counts that do not fit stand in longer fields."""
    size = 0
    for m, offset in found:
        name, far = m.path.encode(), offset >= _LONG
        extra = struct.pack("<HHQ", 1, 8, offset) if far else b""
        head = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45 if far else 20, 45 if far else 20, _UTF8, _DEFLATE, 0, _DATE, m.crc, m.packed, m.size, len(name), len(extra), 0, 0, 0, 0, _LONG if far else offset)
        size += len(head) + len(name) + len(extra)
        yield head + name + extra
    n = len(found)
    if n >= 0xFFFF or at >= _LONG or size >= _LONG:
        yield struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<IIQI", _LOCATOR, 0, at + size, 1)
    yield struct.pack("<IHHHHIIH", _END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _LONG), min(at, _LONG), 0)


def _deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(p, len(c), zlib.crc32(c), hashlib.sha256(c).hexdigest(), _deflated(c)) for p, c in zip(part["path"], map(bytes, part["content"]), strict=True)]
        out = pd.DataFrame(rows, columns=["path", "size", "crc", "sha256", "data"])
        yield out.assign(packed=out["data"].map(len))[["path", "size", "packed", "crc", "sha256", "data"]]


#: Bytes of the members that come to the driver at once, unless one has more.
PIECE = 1 << 24


def bundle(entries: DataFrame, target: str, path: str = "path", content: str = "content", pos: str | None = None, manifest: str | None = None) -> int:
    """Writes a zip of the entries in order of their paths to target, on whatever store it is, and returns its bytes.

    With pos, the last entry of a path wins. manifest: the name of a first file that lists path, size and SHA-256 of each. Null contents are empty.
    The executors compress the members into a table; the driver holds their names, sizes and offsets, and copies
    the table's bytes piece by piece, as a bundle is one file. The file appears under its name when it is whole.
    """
    spark = entries.sparkSession
    if pos is not None:
        entries = report.last_entries(entries.select(path, content, pos), path, pos)
    held = temporary(spark, "members")
    entries.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit(b"")).alias("content")).mapInPandas(_packed, "path string, size long, packed long, crc long, sha256 string, data binary").repartitionByRange("path").sortWithinPartitions("path").write.parquet(held)
    rows = spark.read.parquet(held)
    told = [Member(*r) for r in rows.select("path", "size", "packed", "crc", "sha256").orderBy("path").collect()]
    if len({m.path for m in told}) < len(told) or any(m.path == manifest for m in told):
        raise ValueError("two entries have one path")
    # Pieces are runs of members in order; each is read by itself, by its first and last path, from the sorted table.
    pieces: list[list[Member]] = []
    size = PIECE
    for m in told:
        if size + m.packed > PIECE:
            pieces.append([])
            size = 0
        pieces[-1].append(m)
        size += m.packed + len(m.path)
    fs = spark._jvm.org.apache.hadoop.fs
    final = fs.Path(target)
    store, pending = final.getFileSystem(spark._jsc.hadoopConfiguration()), fs.Path(f"{target}.pending")
    out, at, found = store.create(pending, True), 0, []
    try:
        if manifest is not None:
            body = json.dumps({"files": [{"path": m.path, "size": m.size, "sha256": m.sha256} for m in told]}, indent=2, sort_keys=True).encode()
            first, data = Member(manifest, len(body), 0, zlib.crc32(body), ""), _deflated(body)
            first = first._replace(packed=len(data))
            found.append((first, at))
            out.write(bytearray(_local(first) + data))
            at += len(_local(first)) + len(data)
        for piece in pieces:
            data = {r["path"]: bytes(r["data"]) for r in rows.where(F.col("path").between(piece[0].path, piece[-1].path)).select("path", "data").collect()}
            for m in piece:
                found.append((m, at))
                at += len(_local(m)) + m.packed
            out.write(bytearray(b"".join(_local(m) + data[m.path] for m in piece)))
        end = b"".join(_directory(found, at))
        out.write(bytearray(end))
    finally:
        out.close()
    store.delete(final, False)
    if not store.rename(pending, final):
        raise OSError(f"{target} cannot be written")
    delete(spark, held)
    return at + len(end)
