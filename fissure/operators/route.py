"""Mate order, multi-mapping classes, edit culling, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fissure.functions.geometry import mapping_type

#: Columns that change ends with a block, as the mate's number does. Edits, mapping counts and qualities stay where they are unless asked.
BLOCK = ["chrom", "start", "end", "strand"]
QUALITIES = ["edit", "mappings", "mapq"]


def order_mates(mappings: DataFrame, swap_qualities: bool = False) -> DataFrame:
    """First block first: by start within a chromosome, by name (bytes) between two. Adds mate1, the mate whose place block 1 then is.

    which_mate_is_block1 goes on telling about the order of the input.
    """
    same = F.col("chrom1") == F.col("chrom2")
    flip = F.when(same, F.col("start2") < F.col("start1")).otherwise(F.col("chrom2") < F.col("chrom1"))
    moved = {}
    for c in BLOCK + (QUALITIES if swap_qualities else []):
        moved[f"{c}1"] = F.when(flip, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
        moved[f"{c}2"] = F.when(flip, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    mate = F.when(F.col("which_mate_is_block1") == 1, 1).otherwise(2)
    return mappings.withColumns(moved | {"flipped": flip, "mate1": F.when(flip, 3 - mate).otherwise(mate)})


def classify(mappings: DataFrame) -> DataFrame:
    """Adds n1 and n2, the distinct places of mates 1 and 2 of a read, and mapping_type; counts replace mappings1 and mappings2.

    Takes the output of order_mates, or mappings in the order of their input. All comes from one exchange by
    read, which culling shares; a read's mappings are few, as aligners limit them.
    """
    first = F.struct(F.col("chrom1").alias("c"), F.col("start1").alias("s"), F.col("end1").alias("e"))
    second = F.struct(F.col("chrom2").alias("c"), F.col("start2").alias("s"), F.col("end2").alias("e"))
    holds_1 = F.col("mate1" if "mate1" in mappings.columns else "which_mate_is_block1") == 1
    read = Window.partitionBy("file_num", "read_id")
    # Dealt out by read ahead of the windows, whose orders would otherwise travel with each row.
    ranks = {f"n{mate}": F.dense_rank().over(read.orderBy(F.when(holds_1, one).otherwise(other))) for mate, one, other in ((1, first, second), (2, second, first))}
    out = mappings.repartition("file_num", "read_id").withColumns(ranks).withColumns({n: F.max(n).over(read).cast("long") for n in ("n1", "n2")})
    return out.withColumns({"mapping_type": mapping_type(F.col("n1"), F.col("n2")), "mappings1": F.col("n1"), "mappings2": F.col("n2")})


def cull(mappings: DataFrame, usage: str | int = "best") -> DataFrame:
    """Keeps a read's mappings with the fewest edits (`best`), within k of the fewest (k), or `all`."""
    if usage == "all":
        return mappings
    slack = 0 if usage == "best" else int(usage)
    edits = F.col("edit1") + F.col("edit2")
    least = F.min(edits).over(Window.partitionBy("file_num", "read_id"))
    return mappings.withColumn("least_edits", least).filter(edits <= F.col("least_edits") + slack).drop("least_edits")


def given_type(mappings: DataFrame) -> DataFrame:
    """mapping_type from the mapping counts that a read's first row (by row_id) brings along."""
    first = mappings.groupBy("file_num", "read_id").agg(F.min_by("mappings1", "row_id").alias("n1"), F.min_by("mappings2", "row_id").alias("n2"))
    return mappings.join(first, ["file_num", "read_id"]).withColumn("mapping_type", mapping_type(F.col("n1"), F.col("n2")))


def inner_span(mappings: DataFrame, between: bool = True) -> DataFrame:
    """Mappings whose second block starts behind the first one's end; between: also for two chromosomes."""
    behind = F.col("start2") > F.col("end1")
    return mappings.filter(behind if between else behind | (F.col("chrom1") != F.col("chrom2")))


def route_name(lump_inversions: bool = False):
    strands = F.concat_ws(".", "strand1", "strand2")
    if lump_inversions:
        strands = F.when(F.col("strand1") == F.col("strand2"), F.lit("+.+")).otherwise(strands)
    return F.concat_ws(".", "chrom1", "chrom2", strands)


def routed(mappings: DataFrame, usage: str | int = "best", lump_inversions: bool = False) -> DataFrame:
    """Ordered, classified, culled mappings with an inner span, each with the name of its route."""
    out = cull(classify(order_mates(mappings)), usage)
    return inner_span(out).withColumn("route", route_name(lump_inversions)).drop("n1", "n2", "flipped", "mate1")
