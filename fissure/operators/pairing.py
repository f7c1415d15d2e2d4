"""Pairs from single-end mappings: all combinations of a read's two ends, with concordance and repeat limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bases beyond which two ends of a chromosome count as distant.
DISTANT = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Spans of concordant pairs (half-open), least gap, combinations kept, and places beyond which a read is a repeat."""

    concordant: tuple[int, int] = (200, 500)
    least_span: int = 0
    most: int = 1000
    anchor: int = 1000
    multi: int = 100


def _counted(ends: DataFrame) -> DataFrame:
    """Per read, the places of either end, and whether it lacks an end (orphan) or has too many places (repeat)."""
    counts = ends.groupBy("read_id").agg(F.count_if(F.col("read_num") == 1).alias("m1"), F.count_if(F.col("read_num") == 2).alias("m2"))
    return counts.withColumn("lacks", (F.col("m1") == 0) | (F.col("m2") == 0))


def _is_repeat(limits: Limits) -> Column:
    one_unique = (F.col("m1") == 1) | (F.col("m2") == 1)
    return F.when(one_unique, F.greatest("m1", "m2") > limits.anchor).otherwise(F.col("m1") * F.col("m2") > limits.multi)


def _combinations(ends: DataFrame, counts: DataFrame, limits: Limits) -> DataFrame:
    """Each combination of a read's ends, with sizes, edits, its place among the read's and what it shows."""
    columns = ("chrom", "start", "end", "edit", "strand")
    place = F.row_number().over(Window.partitionBy("read_id", "read_num").orderBy("chrom", "start", "end", "strand", "edit"))
    kept = ends.join(counts.filter(~F.col("lacks") & ~_is_repeat(limits)), "read_id").withColumn("place", place)
    side = lambda i: kept.filter(F.col("read_num") == i).select("read_id", *([] if i == 2 else ["m1", "m2"]), *[F.col(c).alias(f"{c}_{i}") for c in (*columns, "place")])
    both = side(1).join(side(2), "read_id")
    same = F.col("chrom_1") == F.col("chrom_2")
    gap = F.greatest("start_1", "start_2") - F.least("end_1", "end_2")
    size = gap + (F.col("end_1") - F.col("start_1")) + (F.col("end_2") - F.col("start_2"))
    low, high = limits.concordant
    forward = (F.col("strand_1") == "+") & (F.col("strand_2") == "-") & (F.col("end_2") - F.col("start_1") >= low) & (F.col("end_2") - F.col("start_1") < high)
    backward = (F.col("strand_1") == "-") & (F.col("strand_2") == "+") & (F.col("end_1") - F.col("start_2") >= low) & (F.col("end_1") - F.col("start_2") < high)
    return both.withColumns({
        "frag_size": F.when(same & (size <= DISTANT), size),
        "tag": F.when(same & (forward | backward), "concordant").when(same & (gap <= limits.least_span), "badSpan").otherwise("discordant"),
        "edits": F.col("edit_1") + F.col("edit_2"),
        "place": F.col("place_1") + F.col("place_2"),
    })


def _chosen(both: DataFrame, limits: Limits, order: str, edit_slop: int | None) -> DataFrame:
    """Of reads with discordant combinations alone, those with the fewest edits; of other reads, the first that isn't."""
    spoils = F.col("tag") != "discordant"
    read = Window.partitionBy("read_id")
    both = both.withColumns({"spoilt": F.bool_or(spoils).over(read), "least": F.min("edits").over(read)})
    both = both.filter(spoils | ~F.col("spoilt"))
    if edit_slop is not None:
        both = both.filter(F.col("spoilt") | (F.col("edits") <= F.col("least") + edit_slop))
    first = [F.when(F.col("spoilt"), F.col("place_1")).otherwise(F.col("edits")), F.when(F.col("spoilt"), F.col("place_2"))]
    by = {"size": F.col("frag_size").asc_nulls_last(), "genome": F.col("place")}[order]
    ranked = read.orderBy(*first, by, "chrom_1", "start_1", "end_1", "strand_1", "chrom_2", "start_2", "end_2", "strand_2", "edit_1")
    return both.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= F.when(F.col("spoilt"), 1).otherwise(limits.most))


def _oriented(both: DataFrame, more: list[Column | str]) -> DataFrame:
    """Blocks by chromosome and start; of equal starts a combination that spoils its read has end 2 first."""
    same, spoils = F.col("chrom_1") == F.col("chrom_2"), F.col("tag") != "discordant"
    flip = (F.col("chrom_1") > F.col("chrom_2")) | (same & ((F.col("start_1") > F.col("start_2")) | ((F.col("start_1") == F.col("start_2")) & spoils)))
    pick = lambda c, i: F.when(flip, F.col(f"{c}_{3 - i}")).otherwise(F.col(f"{c}_{i}")).alias(f"{c}{i}")
    return both.select(
        *[pick(c, i) for i in (1, 2) for c in ("chrom", "start", "end")], "read_id", F.when(flip, 2).otherwise(1).alias("which_mate_is_block1"),
        *[pick(c, i) for c in ("strand", "edit") for i in (1, 2)],
        F.when(flip, F.col("m2")).otherwise(F.col("m1")).alias("mappings1"), F.when(flip, F.col("m1")).otherwise(F.col("m2")).alias("mappings2"), "frag_size", *more,
    )


def pair_combinations(ends: DataFrame, limits: Limits = Limits(), order: str = "size", edit_slop: int | None = None) -> DataFrame:
    """Discordant combinations of each read id's mappings of end 1 and end 2.

    ends: read_id, read_num (1 or 2), chrom, start, end, edit, strand. A read id goes if any combination is concordant
    (facing, its span in the given half-open range) or overlaps too far (gap at most least_span), or if
    its ends map to too many places. The most combinations with the fewest edits stay, among equals by span (`size`) or by
    the order of the ends' places (`genome`).
    """
    both = _chosen(_combinations(ends, _counted(ends), limits), limits, order, edit_slop)
    return _oriented(both.filter(~F.col("spoilt")), [])


def tagged_pairs(ends: DataFrame, limits: Limits = Limits(), order: str = "size", edit_slop: int | None = None) -> DataFrame:
    """What becomes of every read id, by tag: its discordant combinations, or one row that says why it has none.

    `concordant` and `badSpan` rows hold the first combination, by end 1 and then end 2, that spoils the read; `orphan` and `repeat`
    rows have nulls for places. Total edits and the combination's place among the read's come along.
    """
    counts = _counted(ends)
    found = _oriented(_chosen(_combinations(ends, counts, limits), limits, order, edit_slop), [F.col("edits").alias("total_edits"), "place", "tag"])
    rest = counts.filter(F.col("lacks") | _is_repeat(limits)).select("read_id", F.when(F.col("lacks"), "orphan").otherwise("repeat").alias("tag"))
    return found.unionByName(rest, allowMissingColumns=True)


#: Columns of the text layouts by mode; `hydra` has the qualities that routing takes, unknown here, behind them.
MODES = {
    "hydra": ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "read_id", "which_mate_is_block1", "strand1", "strand2", "edit1", "edit2", "mappings1", "mappings2", "mapq1", "mapq2"],
    "discordant": ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "read_id", "which_mate_is_block1", "strand1", "strand2", "edit1", "edit2", "frag_size", "mappings1", "mappings2", "total_edits"],
    "detail": ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "read_id", "which_mate_is_block1", "strand1", "strand2", "edit1", "edit2", "frag_size", "mappings1", "mappings2", "total_edits", "place", "tag"],
}


def pairs_by_mode(ends: DataFrame, mode: str, limits: Limits = Limits(), order: str = "size", edit_slop: int | None = None) -> DataFrame:
    """Rows in one of the MODES: `detail` tells what became of every read, the others have the discordant combinations; `distant` stands for no size."""
    if mode == "hydra":
        return end_pairs(ends, limits, order, edit_slop).select(MODES[mode])
    rows = tagged_pairs(ends, limits, order, edit_slop)
    rows = rows if mode == "detail" else rows.filter("tag = 'discordant'")
    size = F.when(F.col("chrom1").isNotNull(), F.coalesce(F.col("frag_size").cast("string"), F.lit("distant")))
    return rows.withColumn("frag_size", size).select(MODES[mode])


def end_pairs(ends: DataFrame, limits: Limits = Limits(), order: str = "size", edit_slop: int | None = None) -> DataFrame:
    """Discordant combinations in the layout of mappings, for routing; mapping qualities are unknown (0)."""
    rows = pair_combinations(ends, limits, order, edit_slop)
    return rows.drop("frag_size").withColumns({"mapq1": F.lit(0), "mapq2": F.lit(0)})
