"""Records that generation writes: accepted examples, rejected generations and held-out tasks, as projections of rows.

Rows have the fields of their task seed in a struct `seed` (seed_id, task_family, operation_tags,
task_detail and others), sample_index, and task_description and code, or generation,
finish_reason and rejection_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as T


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _valid(model: str, sample: Column) -> list[Column]:
    return [
        F.lit(model).alias("model"),
        F.col("seed"),
        sample.alias("sample_index"),
        F.col("seed.task_family").alias("task_family"),
        F.col("seed.operation_tags").alias("operation_tags"),
        F.col("seed.task_detail").alias("task_detail"),
        T.signature_line("code").alias("signature"),
        T.description_key("task_description").alias("normalized_description"),
        F.col("task_description"),
        F.col("code"),
    ]


def valid(rows: DataFrame, model: str) -> DataFrame:
    """Records of accepted generations."""
    return rows.select(*_valid(model, F.col("sample_index")))


def invalid(rows: DataFrame, model: str) -> DataFrame:
    """Records of rejected generations, with the reason."""
    return rows.select(F.lit(model).alias("model"), "seed", "sample_index", "generation", "finish_reason", "rejection_reason")


def heldout(rows: DataFrame, model: str) -> DataFrame:
    """Records of tasks that are held out: a prompt of the description and the signature, the checks (a column) and the reference."""
    name = F.regexp_extract("code", r"(?m)^def\s+(\w+)", 1)
    return rows.select(
        F.concat(F.format_string("heldout_%06d_", "seed.seed_id"), name).alias("task_id"),
        F.concat(_trimmed(F.col("task_description")), F.lit("\n\n"), T.signature_line("code"), F.lit("\n")).alias("prompt"),
        "checks",
        F.col("seed.task_family").alias("task_family"),
        F.col("seed.operation_tags").alias("operation_tags"),
        F.col("seed.task_detail").alias("task_detail"),
        F.col("code").alias("reference_code"),
        F.col("task_description").alias("reference_task_description"),
        F.struct(*_valid(model, F.lit(0))).alias("reference_record"),
    )
