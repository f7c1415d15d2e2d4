"""One cluster for each read, calls with footprints and supports, details, sample counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissure.functions.geometry import ANCHORED, MULTIPLE, UNIQUE, weight_tenths
from fissure.operators.runs import with_runs
from fissure.sources.schemas import FINAL
from fissure.sources.shared import materialise

FAR = 1_000_000


def cluster_stats(mappings: DataFrame, far: int = FAR) -> DataFrame:
    """Per cluster: size of its footprint, edits, weight in tenths, and whether it spans chromosomes or more than `far`."""
    unlinked = (F.col("chrom1") != F.col("chrom2")) | (F.col("end2") - F.col("start1") > far)
    return mappings.groupBy("cluster_id").agg(
        (F.max("end2") - F.min("start1") + 1).alias("cluster_size"),
        F.sum(F.col("edit1") + F.col("edit2")).alias("total_edits"),
        F.sum(weight_tenths(F.col("mapping_type"))).alias("weight_tenths"),
        F.bool_or(unlinked).alias("unlinked"),
    )


def choose_clusters(mappings: DataFrame, last: bool = False) -> DataFrame:
    """Adds included: whether a mapping's cluster is its read's best (greatest weight, fewest edits, smallest id); and leads: true for one included mapping of each read. Written once.

    One exchange by cluster, one by read; both are small, as islands are bounded and aligners limit a read's mappings.
    last: nothing else reads the written tables that mappings are made from, so they go.
    """
    cluster, read = Window.partitionBy("cluster_id"), Window.partitionBy("read_id")
    scored = mappings.withColumns({
        "weight_tenths": F.sum(weight_tenths(F.col("mapping_type"))).over(cluster),
        "total_edits": F.sum(F.col("edit1") + F.col("edit2")).over(cluster),
    })
    rank = F.struct((-F.col("weight_tenths")).alias("w"), F.col("total_edits").alias("e"), F.col("cluster_id").alias("c"))
    best = F.min(rank).over(read)["c"]
    scored = scored.withColumn("best_cluster", best).withColumn("included", F.col("cluster_id") == F.col("best_cluster"))
    leads = F.col("read_id").isNotNull() & (F.row_number().over(read.orderBy(F.desc("included"))) == 1)
    return materialise(scored.withColumn("leads", leads).drop("weight_tenths", "total_edits", "best_cluster"), "chosen", last)


def calls(chosen: DataFrame) -> DataFrame:
    """One row per cluster: footprints and means of the included mappings (of all where none is), supports, counts by type.

    Rows are dealt out by cluster as they are: they are slimmer than what they would be summed up in, one by one, ahead of it.
    """
    on = F.col("included")

    def among(f, c: str) -> Column:
        return F.coalesce(f(F.when(on, F.col(c))), f(F.col(c)))

    def total(c: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(on, c if isinstance(c, Column) else F.col(c))), F.lit(0))

    weight = weight_tenths(F.col("mapping_type"))
    g = chosen.repartition("cluster_id").groupBy("cluster_id").agg(
        *[F.min(c).alias(c) for c in ("chrom1", "chrom2", "strand1", "strand2")],
        among(F.min, "start1").alias("min_start1"), among(F.max, "end1").alias("max_end1"), among(F.min, "start2").alias("min_start2"), among(F.max, "end2").alias("max_end2"),
        *[total(f"{c}{i}").alias(f"sum_{c}{i}") for c in ("edit", "mappings", "mapq") for i in (1, 2)],
        F.count_if(on).alias("final_support"), F.count(F.lit(1)).alias("num_pairs"),
        F.count_if(F.col("leads")).alias("distinct_reads"),
        F.sum(weight).alias("all_tenths"), total(weight).alias("final_tenths"),
        *[F.count_if(on & (F.col("mapping_type") == k)).alias(n) for k, n in ((UNIQUE, "num_uniq"), (ANCHORED, "num_anch"), (MULTIPLE, "num_mult"))],
    )
    mean = lambda c: F.when(F.col("final_support") > 0, F.floor(F.col(c) / F.col("final_support"))).otherwise(F.lit(0))
    return g.select(
        "chrom1", "min_start1", "max_end1", "chrom2", "min_start2", "max_end2", F.col("cluster_id").alias("contig_id"), F.col("final_support").alias("distinct_pairs"), "strand1", "strand2",
        mean("sum_edit1").alias("mean_mm1"), mean("sum_edit2").alias("mean_mm2"), mean("sum_mappings1").alias("mean_mappings1"), mean("sum_mappings2").alias("mean_mappings2"),
        mean("sum_mapq1").alias("mean_mapq1"), mean("sum_mapq2").alias("mean_mapq2"), (F.col("max_end2") - F.col("min_start1") + 1).alias("contig_size"), "num_pairs",
        (F.col("all_tenths") / 10).alias("all_weighted_support"), "final_support", (F.col("final_tenths") / 10).alias("final_weighted_support"), "num_uniq", "num_anch", "num_mult", "distinct_reads",
    )


def final_calls(chosen: DataFrame, least_reads: int = 2) -> DataFrame:
    return calls(chosen).filter(F.col("distinct_reads") >= least_reads)


def detail(chosen: DataFrame, finals: DataFrame) -> DataFrame:
    """All mappings of the final clusters, marked Y where the cluster is their read's best."""
    kept = chosen.join(finals.select(F.col("contig_id").alias("cluster_id")), "cluster_id", "left_semi")
    return kept.withColumns({"contig_id": F.col("cluster_id"), "included": F.when(F.col("included"), "Y").otherwise("N")})


def with_sample(details: DataFrame, samples: list[str]) -> DataFrame:
    """Adds sample_place: which of the samples has the longest name that a read_id starts with, a point behind it; a read without one fails the job.

    Names are looked up by hash, once for each number of points that they hold. samples are a config's, so their table is small.
    """
    names = details.sparkSession.createDataFrame([(i, s) for i, s in enumerate(samples)], "place_ int, name_ string")
    rows, found = details.withColumn("parts_", F.split("read_id", r"\.")), []
    for points in sorted({s.count(".") for s in samples}, reverse=True):
        known = F.broadcast(names.select(F.col("place_").alias(f"place{points}_"), F.col("name_").alias(f"name{points}_")))
        start = F.when(F.size("parts_") > points + 1, F.array_join(F.slice("parts_", 1, points + 1), "."))
        rows = rows.join(known, start == F.col(f"name{points}_"), "left").drop(f"name{points}_")
        found.append(f"place{points}_")
    none = F.raise_error(F.concat(F.lit("no sample of the config names read "), "read_id")).cast("int")
    return rows.withColumn("sample_place", F.coalesce(*found, none)).drop("parts_", *found)


def count_vectors(details: DataFrame, samples: list[str]) -> DataFrame:
    """Per call, counts: how many included mappings each sample gives, by its place among the samples."""
    each = with_sample(details.filter("included = 'Y'"), samples).groupBy("contig_id", "sample_place").agg(F.count(F.lit(1)).alias("n"))
    held = each.groupBy("contig_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_place", "n"))).alias("held"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0)))
    return held.select("contig_id", filled.alias("counts"))


def sample_counts(details: DataFrame, samples: list[str]) -> DataFrame:
    """count_vectors with a column for each sample; samples that several libraries share count once, in order."""
    samples = list(dict.fromkeys(samples))
    counted = count_vectors(details, samples)
    return counted.select("contig_id", *[F.col("counts")[i].alias(s) for i, s in enumerate(samples)])


def frequency_table(finals: DataFrame, details: DataFrame, samples: list[str]) -> DataFrame:
    """Calls with all their columns and a count `<sample>Y` for each sample, 0 where it has none."""
    samples = list(dict.fromkeys(samples))
    joined = finals.select(FINAL).join(count_vectors(details, samples), "contig_id", "left")
    return joined.select(*FINAL, *[F.coalesce(F.col("counts")[i], F.lit(0)).alias(f"{s}Y") for i, s in enumerate(samples)])


def numbered(calls_frame: DataFrame, last: bool = False) -> DataFrame:
    """Numbers calls within their chromosomes and strands from 1, by position: every call is a run of its own."""
    order = ["min_start1", "max_end1", "min_start2", "max_end2", "contig_id"]
    return with_runs(calls_frame, ["chrom1", "chrom2", "strand1", "strand2"], "min_start1", order, [], lambda before: F.lit(True), "number", last=last)
