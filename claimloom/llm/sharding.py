"""Contiguous balanced shards by global byte-size prefix sums (operator 10)."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

RANGE_ROWS = 250_000


def _running(batches):
    """Within a range partition, in its order: bytes before each row and rows before it. State: two numbers."""
    import numpy as np

    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = b.column("size").to_numpy()
        ends = np.cumsum(sizes) + size
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), pa.array(np.arange(rows, rows + len(sizes)))],
            names=[*b.schema.names, "part", "before", "nth"],
        )
        if len(sizes):
            size, rows = int(ends[-1]), rows + len(sizes)


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard, slot.

    Rows stand in the order of key (null first; rows with one key by size, checksum, then place in the input). A row's
    global offset is the bytes of all rows before it: per-partition totals of a range-partitioned narrow table give each
    partition its start. Shard i takes the rows whose middle byte lies in the i-th of `shards` equal parts of all bytes, so
    shards are contiguous and differ by about one row's size. slot counts from 0 in each shard. Null text has size 1 and
    checksum 0. An empty table gives no rows. Only (key, size, checksum) is moved; texts and other columns are not read on.
    """
    narrow = docs.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"),
    )
    order = [F.col("k").asc_nulls_first(), "size", "crc", "tie"]
    n = max(12, -(-docs.count() // range_rows))
    laid = cut(narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_running, "k long, size long, crc long, tie long, part int, before long, nth long"))
    # one row per range partition: their number follows the rows over range_rows
    starts, at, nth = [], 0, 0
    for p, size, rows in sorted(laid.groupBy("part").agg(F.sum("size"), F.count("*")).collect()):
        starts.append((p, at, nth))
        at, nth = at + size, nth + rows
    spark = docs.sparkSession
    begin = spark.createDataFrame(starts, "part int, part_bytes long, part_rows long")
    total = max(at, 1)
    middle = (F.col("part_bytes") + F.col("before")) * 2 + F.col("size")
    placed = laid.join(F.broadcast(begin), "part").select(
        "k", "size", "crc",
        F.least(F.floor(middle.cast("decimal(30,0)") * shards / F.lit(2 * total).cast("decimal(30,0)")), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("part_rows") + F.col("nth")).alias("row"),
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32 function, so the query has a brute-force test and no SQL.
QUERIES = {"op10_sharding": op10_sharding}
ORACLE: dict[str, str] = {}
