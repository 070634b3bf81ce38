"""Records of runs put together for reports: series, checkpoints, files of bundles, ranks and batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def joined_labels(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The distinct labels of each group, in order, joined by commas; labels are few."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ", ").alias("labels"))


def scalar_series(events: DataFrame, *by: str, step: str = "step", value: str = "value") -> DataFrame:
    """Last (by step, then value), largest and least value of each series."""
    return events.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(step, value)).alias("last"), F.max(value).alias("largest"), F.min(value).alias("least"))


def path_counts(paths: DataFrame, path: str, wanted: dict[str, Column], *by: str) -> DataFrame:
    """How many paths meet each named condition."""
    return paths.groupBy(*by).agg(*[F.count(F.when(test, 1)).alias(name) for name, test in wanted.items()])


def with_prefix(paths: DataFrame, path: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose path begins with one of the prefixes."""
    return paths.where(reduce(Column.__or__, [F.startswith(path, F.lit(p)) for p in prefixes], F.lit(False)))


def listed(paths: DataFrame, path: str, names: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Rows whose path is one of the names or begins with one of the prefixes, in order of the path."""
    begins = reduce(Column.__or__, [F.startswith(path, F.lit(p)) for p in prefixes], F.lit(False))
    return paths.where(F.col(path).isin(*names) | begins).orderBy(path)


def requirements(paths: DataFrame, path: str, wanted: Sequence[tuple[str, str, tuple[str, ...]]], *by: str) -> DataFrame:
    """by, requirement, present, detail of each requirement: (name, how, values) with how `exact` (path), `ends` (prefix, suffix) or `contains` (part).

    The detail is the path or `missing` of an exact one, else how many files there are. One pass over the paths.
    """
    tests = {
        "exact": lambda p: F.col(path) == p,
        "ends": lambda p, s: F.startswith(path, F.lit(p)) & F.endswith(path, F.lit(s)),
        "contains": lambda p: F.contains(path, F.lit(p)),
    }
    counts = paths.groupBy(*by).agg(*[F.count(F.when(tests[how](*values), 1)).alias(f"__{i}") for i, (_, how, values) in enumerate(wanted)])
    told = [F.struct(F.lit(name).alias("requirement"), (F.col(f"__{i}") > 0).alias("present"), (F.when(F.col(f"__{i}") > 0, values[0]).otherwise("missing") if how == "exact" else F.format_string("%d files", f"__{i}")).alias("detail")) for i, (name, how, values) in enumerate(wanted)]
    return counts.select(*by, F.explode(F.array(*told)).alias("r")).select(*by, "r.*")


#: What the bundle of a run has to hold.
REQUIRED = (
    ("resolved_config.json", "exact", ("resolved_config.json",)),
    ("run_manifest.json", "exact", ("run_manifest.json",)),
    ("pretraining metrics.jsonl", "exact", ("artifacts/pretraining/metrics.jsonl",)),
    ("final evaluation/report.json", "exact", ("artifacts/evaluation/report.json",)),
    ("checkpoint-evaluation report.json files", "ends", ("artifacts/evaluation/sha256_", "/report.json")),
    ("TensorBoard event files", "contains", ("events.out.tfevents",)),
    ("tokenizer files", "ends", ("artifacts/tokenizer/", ".json")),
    ("latest checkpoint", "contains", ("/checkpoints/latest.",)),
)


def last_entries(entries: DataFrame, key: str, pos: str) -> DataFrame:
    """One row of each key, the last by pos, at the place of the key's first. Copies fold before the shuffle."""
    rest = [c for c in entries.columns if c not in (key, pos)]
    folded = entries.groupBy(key).agg(F.min(pos).alias(pos), F.max(F.struct(F.col(pos).alias("__pos"), *rest)).alias("__last"))
    return folded.select(key, pos, *[F.col(f"__last.{c}").alias(c) for c in rest])


def artifact_files(entries: DataFrame, *by: str, path: str = "path") -> DataFrame:
    """The sorted files of each artifact; entries without an artifact are left out."""
    known = reduce(Column.__and__, [F.col(b).isNotNull() for b in by])
    return entries.where(known).groupBy(*by).agg(F.sort_array(F.collect_list(path)).alias("files"))


def chosen_checkpoints(evaluations: DataFrame, run: str, step: str, loss: str, rate: str, path: str) -> DataFrame:
    """Each run's latest checkpoint, that of least loss and that of best rate. No step counts as -1; of equals the first by (step, path)."""
    at = F.coalesce(F.col(step), F.lit(-1))
    first = F.struct(at, F.col(path))
    best = lambda order, there: F.min_by(F.when(there, F.col(path)), F.when(there, F.struct(order, first)))
    return evaluations.groupBy(run).agg(
        F.min_by(path, F.struct(-at, F.col(path))).alias("latest"),
        best(F.col(loss), F.col(loss).isNotNull()).alias("best_loss"),
        best(-F.col(rate), F.col(rate).isNotNull()).alias("best_rate"),
    )


def over_ranks(records: DataFrame, step: str, rank: str, loss: str, norm: str, tokens: str) -> DataFrame:
    """Of each step, loss and gradient norm as means over ranks, tokens as their sum, and rank 0's own loss."""
    return records.groupBy(step).agg(F.avg(loss).alias("loss"), F.avg(norm).alias("norm"), F.sum(tokens).alias("tokens"), F.max(F.when(F.col(rank) == 0, F.col(loss))).alias("first_rank_loss"))


def topology(rank: Column, per_node: int) -> list[Column]:
    """Node and place in it of a rank."""
    return [F.floor(rank / per_node).cast("long").alias("node"), (rank % per_node).cast("long").alias("local_rank")]


def throughput(records: DataFrame, run: str, steps: Sequence[str], tokens: str, elapsed: str) -> DataFrame:
    """Tokens since a run's start over the seconds since then; records are in order of `steps`."""
    so_far = F.sum(tokens).over(Window.partitionBy(run).orderBy(*steps).rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("tokens_per_second", so_far / F.greatest(F.col(elapsed).cast("double"), F.lit(1e-9)))


def batch_throughput(rows: DataFrame, batch: str, tokens: str, seconds: str) -> DataFrame:
    """rows with tokens and sequences a second of their batch, 0 if it took no time. Sums come first; only they are joined back."""
    sums = rows.groupBy(batch).agg(F.sum(tokens).alias("__t"), F.count(F.lit(1)).alias("__n"), F.sum(seconds).alias("__s"))
    rate = lambda c: F.when(F.col("__s") > 0, F.col(c) / F.col("__s")).otherwise(0.0)
    return rows.join(sums.select(batch, rate("__t").alias("tokens_per_second"), rate("__n").alias("sequences_per_second")), batch)


def evaluation_targets(events: DataFrame, artifacts: DataFrame, every: int, step: str = "step", fingerprint: str = "fingerprint") -> DataFrame:
    """Checkpoint events of every `every`-th step with the artifact that made them; an unknown fingerprint is an error."""
    both = events.where(F.col(step) % every == 0).join(artifacts.withColumn("__known", F.lit(True)), fingerprint, "left")
    known = F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("no artifact "), F.col(fingerprint).cast("string"))).cast("boolean"))
    return both.where(known).drop("__known")
