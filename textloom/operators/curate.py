"""Corpus curation: an ordered list of transforms over documents (document_id, text, split, pos)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import hashing, text as T
from textloom.operators import code, order

Transform = Callable[[DataFrame], DataFrame]


def apply(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    return reduce(lambda d, t: t(d), transforms, df)


def rewrite(column: Column) -> Transform:
    return lambda df: df.withColumn("text", column)


def normalize_lines() -> Transform:
    return rewrite(T.line_endings("text"))


def normalize_unicode(form: str = "NFC") -> Transform:
    return rewrite(T.unicode_normalize("text", form))


def lower() -> Transform:
    return rewrite(F.lower("text"))


def length_between(least: int | None = None, most: int | None = None) -> Transform:
    """Texts of least to most characters, both included."""

    def run(df: DataFrame) -> DataFrame:
        n = F.length("text")
        return df.where((n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True)))

    return run


def exact_dedup() -> Transform:
    """The first document, by pos, of each text. Copies fold before the shuffle, and the texts before are read once."""
    return lambda df: order.keep_first(df, F.sha2("text", 256), "pos")


def assign_split(train: float, validation: float) -> Transform:
    """A split from the hash of the id; a document that has one is an error."""

    def run(df: DataFrame) -> DataFrame:
        new = hashing.split_name(F.col("document_id"), train, validation)
        return df.withColumn("split", F.when(F.col("split").isNotNull(), F.raise_error(F.lit("the document has a split"))).otherwise(new))

    return run


def in_set(column: str, values: Sequence[str]) -> Transform:
    """Rows whose column is one of the values; a null is an error, not a silent loss."""

    def run(df: DataFrame) -> DataFrame:
        return df.where(F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null")).cast("boolean")).otherwise(F.col(column).isin(*values)))

    return run


def manifest(df: DataFrame) -> DataFrame:
    """Documents, bytes and characters of each split; no split is `unsplit`."""
    return df.groupBy(F.coalesce("split", F.lit("unsplit")).alias("split")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters"),
    )


def merged(manifests: DataFrame) -> DataFrame:
    """Manifests of several writers as one: sums by split."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("documents", "bytes", "characters", "shards") if c in manifests.columns]
    return manifests.groupBy(F.coalesce("split", F.lit("unsplit")).alias("split")).agg(*sums)


#: What is counted of a chain of steps.
COUNTERS = (
    "input_documents",
    "input_bytes",
    "input_characters",
    "rejected_documents",
    "output_documents",
    "output_bytes",
    "output_characters",
    "unicode_normalized_documents",
    "line_endings_normalized_documents",
    "lower_cased_documents",
    "deduplicated_documents",
    "split_assigned_documents",
    "python_parse_failed_documents",
    "python_extracted_functions",
)
_STATE = ("document_id", "text", "split", "src", "place")


def _step_text(change: Column, counter: str) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        new = df.withColumn("__new", change)
        return new.withColumn(counter, F.col(counter) + F.when(F.col("alive") & (F.col("__new") != F.col("text")), 1).otherwise(0)).withColumn("text", F.col("__new")).drop("__new")

    return run


def _step_length(least: int | None, most: int | None) -> Transform:
    n = F.length("text")
    fits = (n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True))
    return lambda df: df.withColumn("alive", F.col("alive") & fits).withColumn("text", F.when(F.col("alive"), F.col("text")))


def _step_dedup(df: DataFrame) -> DataFrame:
    # Rows that fold hand on the sums of their counters; those that are out already are one group.
    rows = df.groupBy(F.when(F.col("alive"), F.sha2("text", 256)).alias("__h")).agg(F.min(F.struct("place", "document_id", "text", "split", "src")).alias("__r"), (F.count(F.lit(1)) - 1).alias("__k"), *[F.sum(c).alias(c) for c in COUNTERS])
    rows = rows.withColumn("deduplicated_documents", F.col("deduplicated_documents") + F.when(F.col("__h").isNotNull(), F.col("__k")).otherwise(0))
    return rows.select(*[F.col(f"__r.{c}").alias(c) for c in _STATE], F.col("__h").isNotNull().alias("alive"), *COUNTERS)


def _step_functions(private: bool, methods: bool, asynchronous: bool) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        found = df.withColumn("__f", code.functions_column(F.when(F.col("alive"), F.col("text")), private, methods, asynchronous))
        failed = F.col("alive") & F.col("__f").isNull()
        found = found.withColumn("python_parse_failed_documents", F.col("python_parse_failed_documents") + F.when(failed, 1).otherwise(0))
        found = found.withColumn("python_extracted_functions", F.col("python_extracted_functions") + F.when(F.col("__f").isNotNull(), F.size("__f")).otherwise(0))
        # A document's counters stay with its first row; without functions that is a row that is out.
        each = found.select("*", F.posexplode_outer("__f").alias("__i", "__one"))
        first = F.coalesce(F.col("__i"), F.lit(0)) == 0
        name = F.format_string("%s__function_%04d_%s", "document_id", "__i", "__one.name")
        return each.select(
            F.coalesce(name, "document_id").alias("document_id"), F.col("__one.text").alias("text"), "split", "src",
            F.concat("place", F.array(F.coalesce(F.col("__i"), F.lit(0)).cast("long"))).alias("place"),
            F.col("__one").isNotNull().alias("alive"), *[F.when(first, F.col(c)).otherwise(0).alias(c) for c in COUNTERS],
        )

    return run


def _step_split(train: float, validation: float) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        taken = F.col("alive") & F.col("split").isNotNull()
        new = F.when(taken, F.raise_error(F.lit("the document has a split")).cast("string")).when(F.col("alive"), hashing.split_name(F.col("document_id"), train, validation))
        return df.withColumn("split", new).withColumn("split_assigned_documents", F.col("split_assigned_documents") + F.when(F.col("alive"), 1).otherwise(0))

    return run


#: Steps by name, each from its options to a transform of rows and their counters.
STEPS: dict[str, Callable[..., Transform]] = {
    "normalize_unicode": lambda form="NFC": _step_text(T.unicode_normalize("text", form), "unicode_normalized_documents"),
    "normalize_line_endings": lambda: _step_text(T.line_endings("text"), "line_endings_normalized_documents"),
    "lower_case": lambda: _step_text(F.lower("text"), "lower_cased_documents"),
    "min_length": lambda min_characters: _step_length(min_characters, None),
    "max_length": lambda max_characters: _step_length(None, max_characters),
    "exact_deduplication": lambda: _step_dedup,
    "extract_python_functions": lambda include_async_functions=False, include_private_functions=False, include_methods=False: _step_functions(include_private_functions, include_methods, include_async_functions),
    "assign_split": _step_split,
}


def counted(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """The rows of a chain of named steps with their counters: document_id, text, split, src, place, alive and COUNTERS.

    Rows that are out stay without their text, for what they add to the counters; a null text
    is out from the start. src is the position of the document that a row comes from, place its
    order. preprocessed() and counters() take it from here.
    """
    n = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(0)
    own = {"input_documents": F.lit(1).cast("long"), "input_bytes": F.coalesce(F.octet_length("text").cast("long"), F.lit(0)), "input_characters": n}
    rows = df.select("document_id", "text", "split", F.col("pos").alias("src"), F.array(F.col("pos").cast("long")).alias("place"), F.col("text").isNotNull().alias("alive"), *[own.get(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS])
    return apply(rows, [STEPS[name](**options) for name, options in steps])


def preprocessed(rows: DataFrame) -> DataFrame:
    """document_id, text, split, place of the rows of counted() that are left."""
    return rows.where("alive").select("document_id", "text", "split", "place")


def counters(rows: DataFrame) -> DataFrame:
    """One row of the counters of counted(); rejected are documents that no row is left of."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    left = F.when(F.col("alive"), F.col("src"))
    made = {"output_documents": total(F.when(F.col("alive"), 1)), "output_bytes": total(F.when(F.col("alive"), F.octet_length("text"))), "output_characters": total(F.when(F.col("alive"), F.length("text")))}
    out = rows.agg(*[made.get(c, total(c)).alias(c) for c in COUNTERS], F.count_distinct(left).alias("__left"))
    return out.withColumn("rejected_documents", F.col("input_documents") - F.col("__left")).select(*COUNTERS)


def fill_in_middle(df: DataFrame, probability: float, least: int, marks: tuple[str, str, str] = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")) -> DataFrame:
    """text rewritten as prefix, suffix, middle behind their marks, for the share of ids chosen by hash and texts of 3 * least characters or more."""
    key, n = F.col("document_id"), F.length("text").cast("long")
    chosen = (F.lit(probability >= 1) | (hashing.hash_fraction(F.concat(key, F.lit(":fill_in_middle"))) < F.lit(float(probability)))) & (n >= 3 * least)
    first, second = hashing.fim_bounds(key, F.when(n >= 3 * least, n).otherwise(3 * least), least)
    cut = df.withColumn("fim", chosen).withColumn("first", first).withColumn("second", second)
    piece = lambda a, b: F.substr("text", (a + 1).cast("int"), (b - a).cast("int"))
    whole = F.concat(F.lit(marks[0]), piece(F.lit(0), F.col("first")), F.lit(marks[1]), piece(F.col("second"), n), F.lit(marks[2]), piece(F.col("first"), F.col("second")))
    return cut.withColumn("text", F.when(F.col("fim"), whole).otherwise(F.col("text"))).withColumn("first", F.when(F.col("fim"), F.col("first"))).withColumn("second", F.when(F.col("fim"), F.col("second")))
