"""Small files on whatever store the session writes to: texts that appear whole or not at all, and lines of JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text: under a name of its own first, then renamed over the path, so that a reader sees the old or the new one."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    final = fs.Path(path)
    pending = fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}.pending")
    store = final.getFileSystem(hadoop)
    out = store.create(pending, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    root = store.makeQualified(final)
    fs.FileContext.getFileContext(root.toUri(), hadoop).rename(store.makeQualified(pending), root, how)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small text."""
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as lines of JSON, nulls written out; mode append adds files to a log."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def corpus_manifest(spark: SparkSession, folder: str, manifest: DataFrame, limit: int) -> dict:
    """Writes corpus.json of a corpus (split, documents, bytes, characters, shards: a row a split) and returns what it says."""
    splits = [r.asDict() for r in manifest.orderBy("split").collect()]  # one row a split
    body = {"format_version": 1, "shard_document_limit": limit, "splits": splits}
    write_text(spark, f"{folder}/corpus.json", json.dumps(body, indent=2, sort_keys=True))
    return body


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a corpus's manifest."""
    splits = json.loads(read_text(spark, f"{folder}/corpus.json"))["splits"]
    names = ("split", "documents", "bytes", "characters", "shards")
    return spark.createDataFrame([tuple(s[n] for n in names) for s in splits], "split string, documents long, bytes long, characters long, shards long")
