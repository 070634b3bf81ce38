"""Candidates, scores and preference pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def expand(prompts: DataFrame, samples: int) -> DataFrame:
    """One row for each prompt and sample index."""
    return prompts.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def score(results: DataFrame) -> DataFrame:
    """0 if not parsed, else 1 and the checks passed; perfect if all passed of one or more."""
    value = F.when(F.col("parsed"), 1.0 + F.col("passed")).otherwise(0.0)
    return results.withColumn("score", value).withColumn("perfect", F.col("parsed") & (F.col("total") > 0) & (F.col("passed") == F.col("total")))


def pairs(scored: DataFrame) -> DataFrame:
    """For each task, every pair of samples i < j of unequal score that are not both perfect, the better one as chosen.

    The number of pairs is the result itself: quadratic in a task's samples, which are few.
    """
    side = lambda s: scored.select("task_id", F.col("sample_index").alias(f"i{s}"), F.col("score").alias(f"s{s}"), F.col("perfect").alias(f"p{s}"))
    both = side("a").join(side("b"), "task_id").where("ia < ib and sa != sb and not (pa and pb)")
    better = F.col("sa") > F.col("sb")
    pick = lambda a, b: F.when(better, F.col(a)).otherwise(F.col(b))
    return both.select("task_id", pick("ia", "ib").alias("chosen_sample_index"), pick("ib", "ia").alias("rejected_sample_index"), pick("sa", "sb").alias("chosen_score"), pick("sb", "sa").alias("rejected_score"), F.abs(F.col("sa") - F.col("sb")).alias("score_margin"))


def encode(pairs_: DataFrame, pad: int, prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids", bos: int | None = None, eos: int | None = None) -> DataFrame:
    """Prompt and completion ids joined, with completion masks, all padded to the longest. bos goes before the prompt, eos behind each completion."""
    mark = lambda token: F.array(F.lit(token)) if token is not None else F.array().cast("array<int>")
    both = pairs_.withColumn("__p", F.concat(mark(bos), prompt))
    for name, c in (("chosen", chosen), ("rejected", rejected)):
        both = both.withColumn("__c", F.concat(c, mark(eos)))
        both = both.withColumn(f"{name}_input", F.concat("__p", "__c")).withColumn(f"{name}_mask", F.concat(F.array_repeat(F.lit(False), F.size("__p")), F.array_repeat(F.lit(True), F.size("__c"))))
    both = both.drop("__p", "__c")
    # One row: the longest input of all.
    longest = both.agg(F.max(F.greatest(F.size("chosen_input"), F.size("rejected_input"))).alias("__n"))
    both = both.join(F.broadcast(longest))
    for name in ("chosen", "rejected"):
        gap = F.col("__n") - F.size(f"{name}_input")
        both = both.withColumn(f"{name}_mask", F.concat(f"{name}_mask", F.array_repeat(F.lit(False), gap))).withColumn(f"{name}_input", F.concat(f"{name}_input", F.array_repeat(F.lit(pad), gap)))
    return both.drop("__n")


def product(**axes: list) -> str:
    """SQL for the product of literal axes, one column each."""
    return " cross join ".join(f"(select explode(array({', '.join(repr(v) for v in values)})) as {name})" for name, values in axes.items())


def pending(seeds: DataFrame, samples: int, done: DataFrame, key: str = "seed_id") -> DataFrame:
    """Seeds and sample indices that are not done."""
    return expand(seeds, samples).join(done.select(key, "sample_index"), [key, "sample_index"], "left_anti")


def pending_seeds(seeds: DataFrame, samples: int, done: DataFrame, key: str = "seed_id") -> DataFrame:
    """Seeds, whole and once each, of which a sample index under `samples` is not done."""
    made = done.where(F.col("sample_index").between(0, samples - 1)).groupBy(key).agg(F.count_distinct("sample_index").alias("__k"))
    return seeds.join(made.where(F.col("__k") >= samples), key, "left_anti")


#: The fields by which two task seeds are the same, whatever their ids.
SEED_KEY = ("task_family", "input_kind", "operation", "condition", "output_kind", "edge_behavior", "implementation_style", "extra_constraint", "task_detail", "description_style", "naming_style", "operation_tags")


def without_seeds(candidates: DataFrame, excluded: DataFrame, key: Sequence[str] = SEED_KEY) -> DataFrame:
    """Candidates that no excluded seed is equal to in all fields of the key; nulls are equal."""
    gone = excluded.select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    return candidates.join(gone, reduce(Column.__and__, [candidates[c].eqNullSafe(F.col(f"__{c}")) for c in key]), "left_anti")


def with_tasks(candidates: DataFrame, tasks: DataFrame, order: str, key: str = "task_id") -> DataFrame:
    """Candidates with their task's columns; of tasks of the same id the last in order counts, a missing task is an error."""
    rest = [c for c in tasks.columns if c != key]
    last = tasks.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__order"), *[F.col(c) for c in rest])).alias("__task"))
    both = candidates.join(last, key, "left")
    known = F.when(F.col("__task").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no task "), F.col(key).cast("string"))).cast("boolean"))
    return both.where(known).select(*candidates.columns, *[F.col(f"__task.{c}").alias(c) for c in rest if c not in candidates.columns])


#: What rules a task seed out. All tests of the first list hold and none of the second; a test is (axis, how, phrase).
CLASHES = (
    ([("edge", "contains", "return None")], [("output", "contains", "or None")]),
    ([("style", "contains", "dictionary accumulator")], [("output", "contains", "dictionary")]),
    ([("style", "contains", "comprehension"), ("operation", "startswith", "find the first")], []),
    ([("style", "contains", "early return")], [("output", "eqNullSafe", "a boolean"), ("output", "contains", "or None"), ("operation", "startswith", "find"), ("operation", "startswith", "check")]),
)


def compatible(**columns: str) -> Column:
    """Whether the axes of a task seed (edge, output, style and operation, or the columns given for them) go together."""

    def holds(axis: str, how: str, phrase: str) -> Column:
        return getattr(F.col(columns.get(axis, axis)), how)(phrase)

    clashes = [reduce(Column.__and__, [holds(*t) for t in all_of] + [~holds(*t) for t in none_of]) for all_of, none_of in CLASHES]
    return ~reduce(Column.__or__, clashes)


def preference_loss(policy_chosen: Column, policy_rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float) -> Column:
    """The direct preference loss of a pair from the log probabilities of both completions under both models."""
    margin = F.lit(float(beta)) * ((policy_chosen - policy_rejected) - (reference_chosen - reference_rejected))
    # softplus(-margin) without overflow
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
