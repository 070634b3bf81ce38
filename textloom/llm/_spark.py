"""Intermediate tables on the shared folder, and keys of rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from textloom.session import delete, temporary

_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Later stages recompute nothing above this point and survive a lost executor. The table is
    deleted when the program ends, or scratch() before. After each table the driver collects its garbage: what jobs have
    shuffled and broadcast is freed only then.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.parquet(path)
    spark._jvm.System.gc()
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark) -> Iterator[list[str]]:
    """Deletes, at its end, the tables written within it; paths that are taken out of the list stay."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for path in _open.pop():
            delete(spark, path)


def _is_scan(df: DataFrame) -> bool:
    """Whether df is a file table, perhaps projected and filtered: its rows come in the same partitions and order whenever they are read."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def keyed(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a key of its rows, a long that stays the same whenever they are read: ids may be null or repeated.

    Rows of files are numbered where they stand; any other table is written first.
    """
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    return numbered if _is_scan(df) else written(numbered, "keyed")


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... in their order: names of an operator's own cannot clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


#: A key with more than one in so many of all rows is hot, so that there are fewer hot keys than that.
HOT = 1024


def meet(rows: DataFrame, table: DataFrame, key: list[str], times: str, total: int) -> DataFrame:
    """rows, which have a column row, with the columns of the table's row of their key; rows whose key it lacks go. times: how many of the total rows have the key.

    The rows of hot keys are dealt out by a salt, and the table's rows of these keys are there once for each salt.
    Only the hot keys are broadcast, fewer than HOT.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(times) * HOT > F.lit(total)
    hot = table.where(is_hot).select(*key, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(0)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, F.lit(salts - 1)).otherwise(0).cast("long")))).drop(times)
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt.cast("long")).drop("hot").join(salted, [*key, "salt"]).drop("salt")
