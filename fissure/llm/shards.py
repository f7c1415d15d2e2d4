"""Sharding: global byte-size prefix sums, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, table


def with_global_prefix(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds rank (rows before) and before (bytes before) in the given global order.

    Rows are range-partitioned, so each partition holds a run of the order and
    needs only the totals of the partitions in front of it: one small row each.
    No partition's rows leave it, and no sort is global.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    # Range bounds come from a sample; the written copy fixes each row's partition for both uses below.
    ranged = materialise(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"), F.sum(size).alias("part_bytes"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.coalesce(F.sum("part_bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("total_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"at": F.row_number().over(inside) - 1, "sum_upto": F.sum(size).over(upto)})
    # One row per partition, far below any broadcast limit: as many as shuffle partitions.
    return (
        placed.join(F.broadcast(totals), "part")
        .withColumns({"rank": F.col("at") + F.col("rows_ahead"), "before": F.col("sum_upto") - F.col(size) + F.col("bytes_ahead")})
        .drop("part", "at", "sum_upto", "rows_ahead", "bytes_ahead")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contiguous shards in doc_id order whose byte sizes are near equal.

    A document goes to the shard whose target interval, total/shards long,
    holds the middle of its bytes, so a shard is off its target by at most one
    document. Only ids and sizes are shuffled, never texts.

    A null text has no bytes and size 1; null doc_ids come first; repeated rows
    each get a slot of their own, ordered by size and checksum among equal ids;
    an empty table gives no rows; other columns are ignored. A document larger
    than a target leaves the shards that it spans in full empty.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col("text").cast("string")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = with_global_prefix(sized, ["doc_id", "size", "text_crc32"], "size")
    n = F.lit(shards)
    middle = F.expr(f"(2 * before + size) * {shards} div (2 * total_bytes)")
    placed = placed.withColumn("shard", F.least(middle, n - 1).cast("int"))
    # At most `shards` rows.
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
