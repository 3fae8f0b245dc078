"""Contiguous shards of nearly equal bytes, from global prefix sums of sizes.

Rows are put in a total order by range partitioning, each partition sends one (bytes, rows)
total to the driver, and the exclusive prefix sums of those totals turn each partition's own
running sums into global ones. Equal byte targets then cut the order into shards. Only
integers are shuffled, never the texts, and no partition has to be combined with another.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

ROW_OVERHEAD = 8


def balanced_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Give every row a shard, its slot there and its size: law ``bytes``.

    Shard k takes the rows whose middle byte lies in the k-th equal part of all bytes, so a
    shard is off its target by at most half a row at either end. Order: id (nulls first),
    checksum, size; equal rows keep an arbitrary order, which changes no returned column but
    the slot. Null text counts as no bytes and has the checksum of the empty text; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    # One row per partition: bounded by the number of partitions, not by the data.
    totals = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    before = list(zip(accumulate((t[1] for t in totals), initial=0), accumulate((t[2] for t in totals), initial=0), strict=True))
    total = before[-1][0]
    starts = spark.createDataFrame([(t[0], *b) for t, b in zip(totals, before, strict=False)], "part int, bytes_before long, rows_before long")

    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("upto", F.col("bytes_before") + F.sum("size").over(running))
        .withColumn("row", F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * upto - size) * {n_shards}) div {max(1, 2 * total)}")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
