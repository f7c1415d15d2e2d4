"""Paired-interval views that Spark derives from the order tables, for runs at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The libraries' insert-size statistics, as a config file would give them.
LIBRARIES = [(0, "S0", 300.0, 20.0, 3.0), (1, "S1", 350.0, 30.0, 3.0), (2, "S2", 250.0, 10.0, 6.0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def libraries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIBRARIES, "file_num int, sample string, exp_size double, variance double, num_devs double")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping per line item: two blocks with strands, edits, mapping qualities; row_id names the row."""
    base = F.when(F.expr("l_orderkey % 5 = 0"), F.expr("l_orderkey % 2000")).otherwise(F.col("l_partkey"))
    part = F.when(F.expr("l_suppkey % 5 = 0"), F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    start1 = base * 5000 + F.expr("l_orderkey % 7") * 20
    start2 = F.col("l_partkey") * 5000 + 600 + F.expr("l_suppkey % 11") * 60
    file_num = F.expr("l_orderkey % 3").cast("int")
    return read(spark, sf_dir, "lineitem").select(
        file_num.alias("file_num"),
        F.concat(F.lit("S"), file_num.cast("string"), F.lit("."), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("read_id"),
        F.concat(F.lit("chr"), (1 + base % 4).cast("string")).alias("chrom1"),
        start1.alias("start1"),
        (start1 + 100).alias("end1"),
        F.concat(F.lit("chr"), (1 + part % 4).cast("string")).alias("chrom2"),
        start2.alias("start2"),
        (start2 + 100).alias("end2"),
        F.expr("cast(1 + l_orderkey % 2 as int)").alias("which_mate_is_block1"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand1"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand2"),
        F.expr("cast(l_suppkey % 3 as int)").alias("edit1"),
        F.expr("cast(l_orderkey % 2 as int)").alias("edit2"),
        F.lit(1).alias("mappings1"),
        F.lit(1).alias("mappings2"),
        F.col("l_quantity").cast("int").alias("mapq1"),
        F.col("l_quantity").cast("int").alias("mapq2"),
        F.expr("concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))").alias("row_id"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alignments per line item, as a sequencer's aligner would give them: read 1 and its mate."""
    m = mappings(spark, sf_dir).withColumns({"t1": F.expr("cast(substring(chrom1, 4) as int) - 1"), "t2": F.expr("cast(substring(chrom2, 4) as int) - 1")})

    def end(i: int, j: int) -> list:
        sign = F.when(F.col(f"start{i}") <= F.col(f"start{j}"), 1).otherwise(-1)
        span = F.when(F.col("t1") == F.col("t2"), sign * (F.greatest("end1", "end2") - F.least("start1", "start2"))).otherwise(0)
        return [
            "file_num", F.concat_ws("_", "read_id", F.col("row_id")).alias("qname"), F.col(f"t{i}").alias("tid"), F.col(f"chrom{i}").alias("rname"), F.col(f"start{i}").alias("pos"), F.col(f"end{i}").alias("aend"),
            F.col(f"t{j}").alias("rnext"), F.col(f"start{j}").alias("pnext"), span.alias("tlen"), F.col("mapq1").alias("mapq"), F.lit(True).alias("is_paired"),
            (F.col("mapq1") % 10 == 9).alias("is_unmapped"), (F.col("mapq1") % 10 == 9).alias("mate_is_unmapped"), (F.col(f"strand{i}") == "-").alias("is_reverse"), (F.col(f"strand{j}") == "-").alias("mate_is_reverse"),
            (F.col("mapq1") % 7 == 6).alias("is_duplicate"), F.lit(i == 1).alias("is_read1"), F.when(F.col(f"edit{i}") > 0, F.col(f"edit{i}")).alias("nm"),
        ]

    return m.select(*end(1, 2)).unionByName(m.select(*end(2, 1)))
