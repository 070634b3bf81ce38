"""Packing token arrays into rows of context + 1 tokens that overlap by one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.curate import fill_in_middle
from textloom.operators.order import running_sum
from textloom.session import delete, temporary


def per_document(df: DataFrame, context: int, pad: int, tokens: str = "tokens", pos: str = "pos") -> DataFrame:
    """pos, k, token_ids: each document's own rows, the last one padded; documents of under two tokens have none.

    A document is cut before its rows are made, so that no row has more than its own tokens.
    """
    last = F.ceil((F.size(tokens) - 1) / context).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), F.slice(tokens, k * context + 1, F.lit(context + 1)).alias("p")))
    rows = df.where(F.size(tokens) >= 2).select(pos, F.explode(cut).alias("c")).select(pos, "c.k", "c.p")
    return rows.select(pos, "k", F.concat("p", F.array_repeat(F.lit(pad), context + 1 - F.size("p"))).alias("token_ids"))


def across_documents(df: DataFrame, context: int, pad: int, tokens: str = "tokens", pos: str = "pos") -> DataFrame:
    """k, token_ids: rows of one stream of all documents by pos; the last row is padded if two tokens or more are left for it.

    Tokens are written once beside their numbers, from which each document's offset comes. Each document is cut at the rows it reaches.
    Rows that lie in one document are whole as they are; only the pieces of others, two a document at most, meet by a shuffle: no task walks the whole
    stream, and no row but a document's own holds all its tokens.
    """
    spark = df.sparkSession
    sized = df.where(F.size(tokens) >= 2).select(F.col(pos).alias("pos"), F.col(tokens).cast("array<int>").alias("t"), F.size(tokens).cast("long").alias("n"))
    path = temporary(spark, "tokens")
    sized.write.parquet(path)
    kept = spark.read.schema(sized.schema).parquet(path)
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = -(-(total - 1) // context) if total else 0
    placed = running_sum(kept, F.col("n"), "pos", "end").withColumn("start", F.col("end") - F.col("n"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("start") - context) / context))
    last = F.least(F.floor((F.col("end") - 1) / context), F.lit(rows - 1).cast("long"))

    def piece(k: Column) -> Column:
        a, b = F.greatest(k * context, F.col("start")), F.least((k + 1) * context, F.col("end") - 1)
        return F.struct(k.alias("k"), a.alias("a"), F.slice("t", (a - F.col("start") + 1).cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int")).alias("p"))

    # The rows whose first and last token are both the document's.
    inside = lambda k: (k * context >= F.col("start")) & ((k + 1) * context < F.col("end"))
    reached = placed.where(first <= last)

    def cut(own: bool) -> DataFrame:
        rows = F.filter(F.sequence(first, last), inside if own else lambda k: ~inside(k))
        return reached.select(F.explode(F.transform(rows, piece)).alias("c")).select("c.*")

    whole = cut(False).where(F.size("p") > 0).groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "p"))), lambda x: x["p"])).alias("x"))
    met = whole.select("k", F.concat("x", F.array_repeat(F.lit(pad), context + 1 - F.size("x"))).alias("token_ids"))
    return cut(True).select("k", F.col("p").alias("token_ids")).unionByName(met)


def statistics(rows: DataFrame, pad: int) -> DataFrame:
    """Rows, tokens, padding tokens, their share and the average fill; 0 where there are no rows."""
    each = rows.select(F.size("token_ids").cast("long").alias("n"), F.size(F.filter("token_ids", lambda x: x == pad)).cast("long").alias("p"))
    out = each.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("p"), F.lit(0)).alias("pad_tokens"))
    share = F.when(F.col("tokens") > 0, F.col("pad_tokens") / F.col("tokens")).otherwise(0.0)
    return out.withColumn("pad_fraction", share).withColumn("average_fill", F.when(F.col("tokens") > 0, 1 - share).otherwise(0.0))


def shard_of(row: str, row_tokens: int, max_tokens: int):
    """The shard of a row when shards hold at most max_tokens tokens, and at least a row."""
    return F.floor(F.col(row) / max(1, max_tokens // row_tokens))


def checked(rows: DataFrame, most: int = 65535) -> DataFrame:
    """The rows; a token outside 0 to most is an error."""
    bad = F.exists("token_ids", lambda x: (x < 0) | (x > most))
    return rows.withColumn("token_ids", F.when(bad, F.raise_error(F.lit("token id out of range")).cast("array<int>")).otherwise(F.col("token_ids")))


def pack(docs: DataFrame, encode: Callable[[DataFrame], DataFrame], context: int, pad: int, bos: int | None = None, eos: int | None = None, across: bool = True, fim: dict | None = None) -> DataFrame:
    """k, token_ids: documents (document_id, text, pos), some rewritten with a middle to fill in, as rows of context + 1 tokens, checked and numbered.

    encode adds the column tokens, an array of integers; bos and eos go around each
    document's. fim: probability and least, and marks, which the tokenizer has to know as
    special tokens. across: one stream of all documents, else each has its own rows.
    """
    mark = lambda token: F.array(F.lit(token)) if token is not None else F.array().cast("array<int>")
    texts = fill_in_middle(docs, **fim) if fim else docs
    tokens = encode(texts.select("pos", "text").where("text is not null")).select("pos", F.concat(mark(bos), "tokens", mark(eos)).alias("tokens"))
    if across:
        return checked(across_documents(tokens, context, pad))
    rows = per_document(tokens, context, pad)
    # Rows are numbered in order of documents: by how many the documents before have.
    counts = tokens.where(F.size("tokens") >= 2).select("pos", F.ceil((F.size("tokens") - 1) / context).cast("long").alias("n"))
    starts = running_sum(counts, F.col("n"), "pos", "end").select("pos", (F.col("end") - F.col("n")).alias("start"))
    return checked(rows.join(starts, "pos").select((F.col("start") + F.col("k")).alias("k"), "token_ids"))


#: Tokens that a file of shards has at least, as far as there are so many: smaller shards share one.
FILE_TOKENS = 1 << 20


def write_shards(rows: DataFrame, path: str, row_tokens: int, max_tokens: int) -> DataFrame:
    """Writes rows (k, token_ids) with their shard as Parquet files under path/shards and returns the index that it writes to path/index.

    A file has one shard, or so many whole ones in their order that it has about FILE_TOKENS: a file each would be a million of a few kilobytes for 6 GB of text in shards of 6,500 tokens.
    A shard holds as many rows as fit into max_tokens. Rows of another length than row_tokens, tokens outside 16 bits, shards
    too small for a row and an empty table are errors. The index has shard, sequences, tokens and
    first_sequence; it is written last, so that a reader who finds it finds all shards.
    """
    if max_tokens < row_tokens:
        raise ValueError("a shard has to hold a row")
    spark = rows.sparkSession
    even = F.when(F.size("token_ids") == row_tokens, F.col("token_ids")).otherwise(F.raise_error(F.lit("a row of another length")).cast("array<int>"))
    # The rows are made once; the shards and their index are both of this table.
    held = temporary(spark, "packed-rows")
    checked(rows.withColumn("token_ids", even)).withColumn("shard", shard_of("k", row_tokens, max_tokens)).write.parquet(held)
    placed = spark.read.parquet(held)
    files = placed.withColumn("file", F.floor(F.col("shard") / max(1, FILE_TOKENS // max_tokens)))
    # Tasks put their files in place themselves, else the driver moves one after the other; the index says when all are there.
    files.repartition("file").sortWithinPartitions("file", "k").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file").parquet(f"{path}/shards")
    index = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("sequences"), F.min("k").alias("first_sequence")).withColumn("tokens", F.col("sequences") * row_tokens)
    if index.isEmpty():
        raise ValueError("packing made no rows")
    index.write.parquet(f"{path}/index")
    delete(spark, held)
    return spark.read.parquet(f"{path}/index")


def uint16(rows: DataFrame) -> DataFrame:
    """shard, sequences, data: each shard's rows in order as little-endian 16-bit numbers, for readers of flat files. A shard is of bounded size."""

    def run(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard.column("k").to_numpy(), kind="stable")
        lists = shard.column("token_ids").take(pa.array(order)).combine_chunks()
        data = lists.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes()
        return pa.table({"shard": shard.column("shard").slice(0, 1), "sequences": pa.array([shard.num_rows], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.select(F.col("shard").cast("long").alias("shard"), "k", "token_ids").groupBy("shard").applyInArrow(run, "shard long, sequences long, data binary")


def training_split(docs: DataFrame, split: str = "train") -> DataFrame:
    """The documents of the split `train` if there are any, else all."""
    own = docs.where(F.col("split") == split)
    return docs if own.isEmpty() else own
