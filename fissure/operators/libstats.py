"""Insert-size statistics of libraries, and which alignments are discordant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a library that are ranked by themselves.
PARTS = 64


def forward_reverse() -> Column:
    """The leftmost end of a pair that faces its mate."""
    return ~F.col("is_reverse") & F.col("mate_is_reverse") & (F.col("tlen") > 0) & (F.col("tid") == F.col("rnext"))


def size_sample(alignments: DataFrame, per_library: int = 100_000) -> DataFrame:
    """At most per_library facing pairs of each library, the first by hash: a sample that doesn't depend on file order.

    Each library is ranked in PARTS parts first, whose first pairs alone are ranked together: none needs a task for all its pairs.
    """
    mark = F.md5("qname")
    facing = alignments.filter(forward_reverse()).withColumns({"mark_": mark, "part_": F.pmod(F.xxhash64("qname"), F.lit(PARTS))})
    for within in (["file_num", "part_"], ["file_num"]):
        order = Window.partitionBy(*within).orderBy("mark_", "qname", "pos", "tlen")
        facing = facing.withColumn("at_", F.row_number().over(order)).filter(F.col("at_") <= per_library)
    return facing.drop("at_", "mark_", "part_")


def library_statistics(alignments: DataFrame) -> DataFrame:
    """file_num, median insert size, and the median of absolute deviations from it (both exact)."""
    facing = alignments.filter(forward_reverse()).select("file_num", "tlen")
    medians = facing.groupBy("file_num").agg(F.median("tlen").alias("median_size"))
    # One row for each library.
    off = facing.join(F.broadcast(medians), "file_num").withColumn("off", F.abs(F.col("tlen") - F.col("median_size")))
    return off.groupBy("file_num").agg(F.first("median_size").alias("median_size"), F.median("off").alias("mad"), F.count(F.lit(1)).alias("pairs"))


def discordant(alignments: DataFrame, libraries: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """Alignments of mapped pairs whose placement their library's insert size doesn't explain.

    Between chromosomes, on equal strands, everted, or facing with a size beyond the expected one plus num_devs
    deviations (statistics not truncated here). Small sizes count as concordant.
    """
    a = alignments.join(F.broadcast(libraries.select("file_num", "exp_size", "variance", "num_devs")), "file_num")
    mapped = F.col("is_paired") & ~F.col("is_unmapped") & ~F.col("mate_is_unmapped")
    fresh = F.lit(True) if allow_duplicates else ~F.col("is_duplicate")
    forward, reverse = ~F.col("is_reverse") & F.col("mate_is_reverse"), F.col("is_reverse") & ~F.col("mate_is_reverse")
    proper = (forward & (F.col("pos") <= F.col("pnext"))) | (reverse & (F.col("pos") >= F.col("pnext")))
    too_long = F.abs("tlen") > F.col("exp_size") + F.col("variance") * F.col("num_devs")
    odd = (F.col("tid") != F.col("rnext")) | (F.col("is_reverse") == F.col("mate_is_reverse")) | ~proper | too_long
    return a.filter(mapped & fresh & odd).select(alignments.columns)


def pair_mates(alignments: DataFrame, libraries: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Paired-interval rows from both mates of a name, ordered by position; names without both mates are left out."""
    a = alignments.filter(F.col("mapq") >= min_mapq)
    strand = F.when(F.col("is_reverse"), "-").otherwise("+")
    end = F.struct("tid", "pos", F.col("aend").alias("end"), F.when(F.col("is_read1"), 1).otherwise(2).alias("mate"), F.col("rname").alias("chrom"), strand.alias("strand"), F.coalesce("nm", F.lit(0)).alias("edit"), "mapq")
    both = a.groupBy("file_num", "qname").agg(F.min(end).alias("x"), F.max(end).alias("y"), F.count_if("is_read1").alias("ones"), F.count(F.lit(1)).alias("n"))
    both = both.filter("n = 2 and ones = 1").join(F.broadcast(libraries.select("file_num", "sample")), "file_num")
    return both.select(
        F.col("x.chrom").alias("chrom1"), F.col("x.pos").alias("start1"), F.col("x.end").alias("end1"), F.col("y.chrom").alias("chrom2"), F.col("y.pos").alias("start2"), F.col("y.end").alias("end2"),
        F.concat_ws(".", "sample", "qname").alias("read_id"), F.col("x.mate").alias("which_mate_is_block1"), F.col("x.strand").alias("strand1"), F.col("y.strand").alias("strand2"),
        F.col("x.edit").alias("edit1"), F.col("y.edit").alias("edit2"), F.lit(1).alias("mappings1"), F.lit(1).alias("mappings2"), F.col("x.mapq").alias("mapq1"), F.col("y.mapq").alias("mapq2"), "file_num",
    )
