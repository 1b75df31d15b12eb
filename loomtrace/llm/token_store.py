"""Token-ID output: Parquet files of token lists in ascending doc_id order, with selective reads.

Layout. One row per document: shard, doc_id, shard_start, n_tokens and the id list. Token lists are
dictionary encoded, the numeric columns delta encoded (Parquet v2 pages), row groups and pages have
set sizes, and the writer leaves column and offset indexes, so a reader that asks for some columns
or some documents touches only those pages.

Defined cases: a null text is an empty one (only the end id); a null doc_id sorts first; rows that
share a doc_id stay apart, in the order of their text's hash; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm.tokens import END_ID, encoder, releasing, slices
from loomtrace.runtime import scratch_path, ship_package

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000

STORE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, tokens array<int>"


def _encode_partitions(tokenizer: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, start, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                values, ends = coder.encode(batch.column("text"), end_id)
                offsets = np.concatenate([[0], ends])
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), shard, np.int32)),
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(start + ends - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view("<i4"))),
                    ],
                    names=["shard", "doc_id", "shard_start", "n_tokens", "tokens"],
                )
                start += int(ends[-1]) if len(ends) else 0

    return run


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text and write the store. Range-partitions by doc_id (one shuffle); equal
    doc_ids may be split over partitions by their text's hash, so no key gathers in one task."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    (
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(releasing(_encode_partitions(tokenizer, end_id)), STORE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#shard_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_token_store(
    spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Selective read: the named columns (start is the corpus-wide position) of doc_id first..last."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(path)
    columns = columns or ["doc_id", "start", "n_tokens", "tokens"]
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    if "start" in columns:
        rows = rows.join(F.broadcast(_shard_bases(spark, path)), "shard").withColumn(
            "start", F.col("base") + F.col("shard_start")
        )
    return rows.select(*columns)


def _shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before each shard: one row per written task, so at most as many as shuffle partitions."""
    sums = spark.read.schema(STORE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _crc(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("tokens")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        cuts = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(np.array(sums, np.int64))],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_store_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = read_token_store(spark, path, ["doc_id", "start", "n_tokens", "tokens"])
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_store(docs, path, tokenizer)
    return token_store_digest(docs.sparkSession, path)
