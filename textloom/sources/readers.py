"""Sources and sinks: inline and local texts, JSON lines, shards partitioned by split."""

from __future__ import annotations

import glob
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom.functions.text import line_endings, template, text_column
from textloom.operators import curate, order
from textloom.sources import manifests

DOCUMENT = "document_id string, text string, split string, pos long"


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"inline-{i:06d}", t, None, i) for i, t in enumerate(texts)], DOCUMENT)


def local_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """UTF-8 files as documents; the id is of the path and the content's hash. Order is by lower-cased path, then path."""
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
    digest = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    key = F.concat(F.lit("local-text-"), F.substr(F.sha2(F.concat("path", F.lit("\n"), digest), 256), F.lit(1), F.lit(24)))
    ordered = sorted({str(p) for p in paths}, key=lambda p: (p.casefold(), p))
    place = spark.createDataFrame([(p, i) for i, p in enumerate(ordered)], "path string, pos long")
    return raw.join(place, "path").select(key.alias("document_id"), line_endings(F.decode("content", "UTF-8")).alias("text"), F.lit(None).cast("string").alias("split"), "pos")


def in_file_order(df: DataFrame, out: str = "pos") -> DataFrame:
    """Rows of a file source, as it was read, with their positions: by path, then place in the file.

    A place is that of the row's part of the file and the row's number in that part; a row has a
    byte at least, so that parts do not overlap. Files of one part keep order as well.
    """
    files = sorted(df.inputFiles())
    names = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __i long")
    columns = df.columns
    placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    within = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = placed.join(names, key(F.col("__path")) == key(F.col("__file")))
    return both.select(*columns, (F.shiftleft("__i", 44) + within).alias(out))


def split_documents(rows: DataFrame, split: str, text: Column, skip: int = 0, take: int | None = None, where: Sequence[Column] = (), pos: str = "pos") -> DataFrame:
    """Documents of one split: rows that meet all conditions, without the first `skip` of them, `take` at most, numbered anew from 0."""
    for condition in where:
        rows = rows.where(condition)
    kept = order.skip_take(rows, skip, take if take is not None else 1 << 62, pos, "__n")
    return kept.select(F.format_string(f"{split.replace('%', '%%')}-%08d", "__n").alias("document_id"), text.alias("text"), F.lit(split).alias("split"), F.col("__n").alias("pos"))


def table_documents(spark: SparkSession, config: dict) -> DataFrame:
    """Documents of a dataset of Parquet or JSON-lines tables.

    config: path and format (parquet or json), text_column or text_template, allowed (column to
    list of values) and splits, each with split and, where wanted, source_split (a folder or
    file under path), skip_documents and max_documents. Splits follow one another.
    """
    out = []
    for s in config["splits"]:
        path = config["path"] + (f"/{s['source_split']}" if s.get("source_split") else "")
        rows = in_file_order(spark.read.format(config.get("format", "parquet")).load(path))
        if config.get("text_template") is not None:
            text = template(config["text_template"], rows.columns)
        elif config.get("text_column") is not None:
            text = text_column(rows, config["text_column"])
        else:
            raise ValueError("a dataset needs text_column or text_template")
        allowed = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("boolean")).otherwise(F.col(c).isin(*values)) for c, values in (config.get("allowed") or {}).items()]
        out.append(split_documents(rows, s["split"], text, s.get("skip_documents", 0), s.get("max_documents"), allowed))
    return order.concat(*out)


def documents(spark: SparkSession, config: dict) -> DataFrame:
    """document_id, text, split, pos of a dataset, by the type of its configuration: inline_text, local_text, table or shards."""
    kinds = {
        "inline_text": lambda: inline(spark, config["documents"]),
        "local_text": lambda: local_text(spark, resolve(config.get("paths", []), config.get("glob_patterns", []))),
        "table": lambda: table_documents(spark, config),
        "shards": lambda: read_shards(spark, config["path"], config.get("split")),
    }
    if config.get("type") not in kinds:
        raise ValueError(f"unknown type of dataset: {config.get('type')}")
    return kinds[config["type"]]()


def resolve(files: list[str], globs: list[str | tuple[str, str]]) -> list[str]:
    """Existing files and the files of patterns, or of (root, pattern), once each, sorted by lower-cased path, then path."""
    found = {Path(f).expanduser().resolve() for f in files}
    if missing := [str(f) for f in found if not f.is_file()]:
        raise FileNotFoundError(", ".join(missing))
    for pattern in globs:
        matched = glob.glob(pattern, recursive=True) if isinstance(pattern, str) else Path(pattern[0]).rglob(pattern[1])
        found |= {Path(p).resolve() for p in matched if Path(p).is_file()}
    return sorted(map(str, found), key=lambda p: (p.casefold(), p))


def expand(patterns: Sequence[str]) -> list[str]:
    """Configuration paths: the sorted matches of each pattern in turn, or the pattern itself where nothing matches. None at all is an error."""
    out = [p for pattern in patterns for p in (sorted(glob.glob(pattern)) or [pattern])]
    if not out:
        raise ValueError("at least one path is needed")
    return out


def load_config(path: str) -> dict:
    """A YAML (or JSON) configuration file, which has to be a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:  # JSON is all that can be read then
        value = json.loads(text)
    else:
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} has to be a mapping")
    return value


def with_overrides(config: dict, overrides: Sequence[str]) -> dict:
    """The configuration with `a.b=value` settings, values read as JSON or else as text; an unknown key is an error."""
    out = json.loads(json.dumps(config))
    for setting in overrides:
        path, _, raw = setting.partition("=")
        *parents, last = path.split(".")
        node = out
        for key in parents:
            node = node[key]
        if last not in node:
            raise KeyError(path)
        try:
            node[last] = json.loads(raw)
        except ValueError:
            node[last] = raw
    return out


def export_config(config: dict, path: str) -> None:
    """The resolved configuration as YAML, or as JSON where there is no YAML library or the name says so."""
    try:
        if path.endswith(".json"):
            raise ImportError
        import yaml

        text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
    except ImportError:
        text = json.dumps(config, indent=2, ensure_ascii=False)
    Path(path).write_text(text, encoding="utf-8")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under a fixed schema; strict fails on a malformed line, else such lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


#: The fields of evaluation tasks and of preference records.
TASK = "task_id string, prompt string, task_description string, checks array<string>, task_family string"
PREFERENCE = "task_id string, prompt string, chosen_completion string, rejected_completion string, chosen_score double, rejected_score double, score_margin double, chosen_sample_index int, rejected_sample_index int"


def tasks(spark: SparkSession, path: str, take: int | None = None) -> DataFrame:
    """Evaluation tasks of JSON lines in their order, with pos; blank lines count for nothing, a malformed one is an error. take: the first so many."""
    rows = in_file_order(json_lines(spark, path, TASK))
    return rows if take is None else order.first(rows, take)


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preference records of JSON lines; a malformed line is an error."""
    return json_lines(spark, path, PREFERENCE)


def completed_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (seed_id, sample_index) of a log of attempts; lines that do not parse are passed over."""
    lines = spark.read.text(path).select(F.from_json("value", "seed struct<seed_id:long>, sample_index int").alias("r"))
    return lines.select(F.col("r.seed.seed_id").alias("seed_id"), F.col("r.sample_index").alias("sample_index")).dropna().distinct()


def write_shards(df: DataFrame, path: str, rows: int) -> dict:
    """Parquet shards of at most `rows` documents, partitioned by split, and then corpus.json; returns what that says."""
    if rows < 1:
        raise ValueError("a shard has to hold a document")
    spark = df.sparkSession
    named = df.withColumn("split", F.coalesce("split", F.lit("unsplit")))
    named.write.partitionBy("split").option("maxRecordsPerFile", rows).parquet(path)
    back = spark.read.schema(named.schema).parquet(path)
    shards = back.groupBy("split").agg(F.count_distinct("_metadata.file_path").alias("shards"))
    return manifests.corpus_manifest(spark, path, curate.manifest(back).join(shards, "split"), rows)


def shard_list(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """split, path of a corpus's shards; their contents are not read. No split is null."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.regexp_extract("path", r"/split=([^/]*)/[^/]*$", 1)
    out = found.select(F.when(name != "unsplit", name).alias("split"), "path")
    return out.where(F.col("split").eqNullSafe(F.lit(split))) if split is not None else out


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return df.where(F.col("split") == split) if split else df


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces, for fingerprints."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
