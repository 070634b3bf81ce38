"""Aggregates over training, routing and evaluation records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def completion_totals(results: DataFrame, *by: str) -> DataFrame:
    """Tasks, parsed, executed, passed and total checks and the pass rate, of all or of each group; null groups are left out."""
    kept = results
    for b in by:
        kept = kept.where(F.col(b).isNotNull())
    sums = [F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("parsed"), 1)).alias("parsed"), F.count(F.when(F.col("executed"), 1)).alias("executed"), F.coalesce(F.sum("passed"), F.lit(0)).cast("long").alias("passed"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total")]
    out = kept.groupBy(*by).agg(*sums) if by else kept.agg(*sums)
    return out.withColumn("pass_rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def perplexity(losses: DataFrame, *by: str, loss: str = "loss") -> DataFrame:
    """The mean of the rows' losses, unweighted, and its exponential."""
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("mean_loss")).withColumn("perplexity", F.exp("mean_loss"))


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and population deviation; nulls are skipped."""
    return df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def exact_median(rows: DataFrame, by: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """by, median: the exact median of each group, in two steps that are dealt out.

    Quantile sketches give two values around the median; only what lies between them is
    then ordered, about four rows in `accuracy` and copies as one.
    """
    p = 2 / accuracy
    bounds = rows.groupBy(by).agg(F.count(value).alias("__n"), F.percentile_approx(value, F.array(F.lit(0.5 - p), F.lit(0.5 + p)), accuracy).alias("__b"))
    near = rows.where(F.col(value).isNotNull()).join(bounds, by)
    low, high = F.col("__b")[0], F.col("__b")[1]
    # All that is below counts as one value, which has no weight of its own.
    counts = near.where(F.col(value) <= high).groupBy(by, "__n", F.when(F.col(value) >= low, F.col(value)).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(by).orderBy(F.col("__v").asc_nulls_first()))
    ranked = counts.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__k") + 1)
    at = lambda r: F.max(F.when((F.col("__from") <= r) & (F.col("__to") >= r), F.col("__v")))
    first, second = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    return ranked.groupBy(by).agg(((at(first) + at(second)) / 2).alias("median"))


def training_summary(records: DataFrame, run: str, step: str, throughput: Sequence[str], final: Sequence[str], last: int = 100) -> DataFrame:
    """Of each run: final_step and final_<c> of its last record, and the throughput: last, mean of the last records, median, least and largest.

    The throughput is the first of the fields that the last record has; a record without that
    field is an error. Only the last `last` records of a run are ordered, and cut to these before the shuffle.
    """
    ends = records.groupBy(run).agg(F.max_by(F.struct(step, *dict.fromkeys([*final, *throughput])), step).alias("__last"))
    chosen = F.coalesce(*[F.when(F.col(f"__last.{c}").isNotNull(), F.lit(c)) for c in throughput])
    ends = ends.select(run, F.col(f"__last.{step}").alias("final_step"), *[F.col(f"__last.{c}").alias(f"final_{c}") for c in final], chosen.alias("throughput_field"), F.coalesce(*[F.col(f"__last.{c}") for c in throughput]).alias("final_tps"))
    own = F.coalesce(*[F.when(F.col("throughput_field") == c, F.col(c)) for c in throughput])
    each = records.join(ends.select(run, "throughput_field"), run).select(run, F.col(step).alias("__step"), F.when(own.isNull(), F.raise_error(F.lit("a record without throughput")).cast("double")).otherwise(own).alias("__tps"))
    bounds = each.groupBy(run).agg(F.min("__tps").alias("min_tps"), F.max("__tps").alias("max_tps"))
    recent = each.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("__step")))).where(F.col("__n") <= last)
    late = recent.groupBy(run).agg(F.avg("__tps").alias("last_tps"))
    median = exact_median(each, run, "__tps").withColumnRenamed("median", "median_tps")
    return ends.join(bounds, run).join(late, run).join(median, run)


def steps_of(df: DataFrame, step: str, *by: str) -> DataFrame:
    """The distinct steps of each group, in order; nulls are left out."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(step)).alias("steps"))


def joined_values(value: Column) -> Column:
    """An aggregate: the distinct values in order, joined by commas, or `missing` without any."""
    found = F.sort_array(F.collect_set(value))
    return F.when(F.size(found) == 0, "missing").otherwise(F.array_join(F.transform(found, lambda x: x.cast("string")), ", "))


def under(df: DataFrame, column: str, ceiling: float) -> DataFrame:
    """Rows whose value is under the ceiling, such as the parameters that are active."""
    return df.where(F.col(column) < ceiling)


def findings(groups: DataFrame, group: str, wanted: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """finding, group: of each finding the group with the largest value among those that meet its condition, of equals the first. One pass over the groups."""
    best = []
    for name, (value, condition) in wanted.items():
        order = F.struct(-value, F.col(group))
        best.append(F.min_by(group, F.when(value.isNotNull() if condition is None else condition & value.isNotNull(), order)).alias(name))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(f"`{n}`").alias(group)) for n in wanted]))
    return groups.agg(*best).select(rows.alias("r")).select("r.*")


def ranked(groups: DataFrame, value: str, *ties: str, out: str = "rank") -> DataFrame:
    """A result table, one row a group, in order of the value from the largest, numbered from 1; of equals the first by `ties`."""
    return groups.withColumn(out, F.row_number().over(Window.orderBy(F.desc(value), *ties)))


def size_point(parameters: Column) -> list[Column]:
    """log_parameters and radius of a model in a plot by size: four at least, and four more for each tenfold size beyond 10**5.9."""
    log = F.log10(parameters)
    return [log.alias("log_parameters"), F.greatest(F.lit(4.0), 4.0 + (log - 5.9) * 4.0).alias("radius")]


#: Position embeddings of the two older families of models.
POSITIONS = 1024


def parameter_counts(family: Column, vocabulary: Column, dim: Column, layers: Column, hidden: Column, experts: Column, active: Column, tied: Column) -> Column:
    """(total, active) parameters of a model: `dense`, `moe`, `modern_dense` or `modern_moe`; experts and active (of them, for a token) count in the moe families alone.

    Older blocks: attention and layers with biases, two parameters a dimension for each
    normalisation, positions learned. Modern ones: no biases, one parameter, gated layers of three matrices.
    """
    modern, moe = family.startswith("modern"), family.endswith("moe")
    layer = F.when(modern, 3 * dim * hidden).otherwise(2 * dim * hidden + hidden + dim)
    attention = 4 * dim * dim + F.when(modern, 0).otherwise(4 * dim)
    norm = F.when(modern, dim).otherwise(2 * dim)
    ends = vocabulary * dim * F.when(tied, 1).otherwise(2) + F.when(modern, 0).otherwise(POSITIONS * dim) + norm
    routed = lambda n: F.when(moe, dim * experts + layer * n).otherwise(layer)
    count = lambda n: (ends + layers * (attention + 2 * norm + routed(n))).cast("long")
    return F.struct(count(experts).alias("total"), count(active).alias("active"))


def best_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group by the ordering, which should end in a tie-break."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def final_against_best(series: DataFrame, run: str, step: str, value: str, largest: bool = True) -> DataFrame:
    """Each run's last and best value, largest or least, and their difference; of equal bests the earliest step."""
    sign = -F.col(value) if largest else F.col(value)
    first = F.struct(sign, F.col(step))
    best = series.where(F.col(value).isNotNull()).groupBy(run).agg(F.max_by(value, step).alias("final"), F.min_by(value, first).alias("best"), F.min_by(step, first).alias("best_step"))
    return best.withColumn("delta", F.col("final") - F.col("best"))


def router_usage(counts: DataFrame, step: str = "step", layer: str = "layer", n: str = "n") -> DataFrame:
    """For each step and layer: mean and deviation of the experts' shares, least, largest, imbalance, dominance and normalised entropy."""
    by = [step, layer]
    total = Window.partitionBy(*by)
    share = F.when(F.sum(n).over(total) > 0, F.col(n) / F.sum(n).over(total)).otherwise(0.0)
    shares = counts.withColumn("share", share)
    out = shares.groupBy(*by).agg(F.count(F.lit(1)).alias("experts"), F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("sd_share"), F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.sum(F.when(F.col("share") > 0, -F.col("share") * F.ln("share")).otherwise(0.0)).alias("__e"))
    entropy = F.when(F.col("experts") > 1, F.col("__e") / F.ln("experts")).otherwise(0.0)
    return out.withColumn("imbalance", F.col("max_share") - F.col("min_share")).withColumn("dominance", F.col("max_share")).withColumn("entropy", entropy).drop("__e")


def worst_layer(usage: DataFrame, step: str = "step") -> DataFrame:
    return usage.groupBy(step).agg(F.max("imbalance").alias("max_imbalance"), F.max("dominance").alias("max_dominance"), F.min("entropy").alias("min_entropy"))


def learning_rate(step: Column, kind: str, base: float, warmup: int, steps: int, ratio: float = 0.0) -> Column:
    """fixed, linear or cosine rate of a step from 1 to `steps`; any other step is an error.

    Up to the last step of the warm-up the rate rises in proportion. Over the steps behind it
    the part above ratio * base falls off, whole at the first and nothing at the last; a
    single such step has the whole rate. A fixed rate has no warm-up.
    """
    if kind not in ("fixed", "linear", "cosine") or steps < 1:
        raise ValueError(f"{kind} over {steps} steps")
    s, falls = step.cast("double"), steps - warmup - 1
    done = (s - warmup - 1) / max(1, falls)
    share = {"fixed": F.lit(1.0), "linear": 1 - done, "cosine": 0.5 * (1 + F.cos(F.pi() * done))}[kind]
    behind = ratio + (1 - ratio) * share if falls > 0 else F.lit(1.0)
    rate = F.lit(1.0) if kind == "fixed" else F.when(s <= warmup, s / max(1, warmup)).otherwise(behind)
    return F.when(s.between(1, steps), base * rate).otherwise(F.raise_error(F.lit(f"a step outside 1 to {steps}")).cast("double"))


def epoch_progress(batches: Column, per_epoch: Column) -> list[Column]:
    """epoch and progress of a run that has seen so many batches; without a known or positive length both are null."""
    known = F.when(per_epoch > 0, per_epoch)
    # The batch that ends an epoch still belongs to it.
    return [F.floor((F.greatest(batches, F.lit(1)) - 1) / known).cast("long").alias("epoch"), (batches / known).alias("progress")]


def retained(checkpoints: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """The latest checkpoint of each run and the `keep` before it."""
    return checkpoints.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))).where(F.col("__n") <= keep + 1).withColumn("latest", F.col("__n") == 1).drop("__n")


def related(artifacts: DataFrame, fingerprint: str) -> DataFrame:
    """Artifacts one of whose parents (a map) is the fingerprint."""
    return artifacts.where(F.array_contains(F.map_values("parents"), fingerprint))
