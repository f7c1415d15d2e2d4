"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.functions.geometry import inner_size, length_tolerance, size_off_expected, span_tolerance
from fissure.jobs import pipeline
from fissure.operators import assemble, breakpoints, dedup, finalize, islands, libstats, merge, pairing, route
from fissure.sources import bam, tables, text
from fissure.sources.schemas import ROUTE
from fissure.sources.shared import materialise, new_folder, spent

MOST = 12  # islands beyond this size are set aside in the punted_islands query
LOW_PUNT = 3  # mappings for each library beyond which the punted_calls query sets an island aside
SLOP = 25_000  # bases that footprints may lie apart: derived positions of a chromosome are 20000 apart
SAMPLED = 1000  # facing pairs taken from each library
SAMPLES = [row[1] for row in tables.LIBRARIES]
#: Columns of mappings that calls tell nothing of, and those that say where a call lies.
NOT_IN_CALLS = ["row_id", "file_num", "which_mate_is_block1"]
PLACED = [*ROUTE, "contig_id", "min_start1", "max_end1", "min_start2", "max_end2"]


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mappings(spark, sf_dir)


def _routed(spark, sf_dir, usage="best"):
    return route.routed(_mappings(spark, sf_dir), usage)


def _islands(spark, sf_dir, rule="gap", without=()):
    """Mappings in islands; routed ones are written first, so that the exchange by read doesn't stand beside that by route."""
    routed = _routed(spark, sf_dir)
    routed = materialise(routed.drop(*[c for c in without if c not in islands.ORDER]), "routed")
    return islands.with_islands(routed, rule, without=without, last=True)


def _stand_in(spark, sf_dir, without=()):
    """Islands of several mappings in place of clusters, so that SQL can check what follows assembly."""
    inside, _ = islands.split_by_size(_islands(spark, sf_dir, without=without), pipeline.PUNT * len(SAMPLES), last=True)
    return inside.withColumn("cluster_id", F.concat_ws("_", "route", "island"))


def _chosen(spark, sf_dir, without=()):
    return finalize.choose_clusters(_stand_in(spark, sf_dir, without).drop("route", "island", "island_size"), last=True)


def _finals(spark, sf_dir):
    return finalize.final_calls(_chosen(spark, sf_dir, NOT_IN_CALLS))


def _written_finals(spark, sf_dir, columns=PLACED):
    """Final calls for what reads them several times."""
    return materialise(_finals(spark, sf_dir).select(columns), "finals", last=True)


def config_truncation(spark, sf_dir):
    used = _mappings(spark, sf_dir).groupBy("file_num").agg(F.count(F.lit(1)).alias("mappings"))
    return used.join(F.broadcast(tables.libraries(spark)), "file_num").select("file_num", "sample", length_tolerance().alias("length_tol"), span_tolerance().alias("span_tol"), "mappings")


def frag_size(spark, sf_dir):
    m = _mappings(spark, sf_dir).join(F.broadcast(tables.libraries(spark)), "file_num")
    return m.select("row_id", inner_size().alias("frag_size"), size_off_expected().alias("size_off"))


def mate_order(spark, sf_dir):
    return route.order_mates(_mappings(spark, sf_dir)).select("row_id", "chrom1", "start1", "end1", "strand1", "chrom2", "start2", "end2", "strand2", "edit1", "edit2", "flipped")


def _culled(usage):
    def query(spark, sf_dir):
        return route.cull(route.classify(route.order_mates(_mappings(spark, sf_dir))), usage).select("row_id", "mapping_type", "mappings1", "mappings2")

    return query


def mapping_type_given(spark, sf_dir):
    return route.given_type(_mappings(spark, sf_dir).withColumns({"mappings1": F.col("mapq1") % 3 + 1, "mappings2": F.col("mapq2") % 2 + 1})).select("row_id", "mapping_type")


def route_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("route").agg(F.count(F.lit(1)).alias("mappings"))


def inner_span_filter(spark, sf_dir):
    return route.inner_span(route.order_mates(_mappings(spark, sf_dir))).select("row_id")


def inversion_routes(spark, sf_dir):
    m = route.order_mates(_mappings(spark, sf_dir)).filter("strand1 = strand2")
    return m.groupBy(route.route_name(lump_inversions=True).alias("route")).agg(F.count(F.lit(1)).alias("mappings"))


def _island_query(rule):
    return lambda spark, sf_dir: islands.island_sizes(_islands(spark, sf_dir, rule)).select("route", "island", "n", "first_start", "last_end")


def punted_calls(spark, sf_dir):
    """What a job with a low limit for each library sets aside."""
    _, punted = pipeline.in_islands(_mappings(spark, sf_dir), LOW_PUNT * len(SAMPLES))
    return punted.select("row_id", "route", "island", "island_size")


def punted_islands(spark, sf_dir):
    _, large = islands.split_by_size(_islands(spark, sf_dir), MOST, last=True)
    return large.select("row_id", "route", "island", "island_size")


def pair_support(spark, sf_dir):
    inside, _ = islands.split_by_size(_islands(spark, sf_dir), pipeline.PUNT * len(SAMPLES), last=True)
    return islands.pair_support(islands.tolerances(inside, tables.libraries(spark))).select("row_id", "support")


def cluster_stats(spark, sf_dir):
    return finalize.cluster_stats(_stand_in(spark, sf_dir))


def best_cluster_per_read(spark, sf_dir):
    return _chosen(spark, sf_dir).select("row_id", "cluster_id", "included")


def all_calls(spark, sf_dir):
    return finalize.calls(_chosen(spark, sf_dir)).filter("all_weighted_support > 0")


def final_detail(spark, sf_dir):
    chosen = _chosen(spark, sf_dir)
    return finalize.detail(chosen, finalize.final_calls(chosen)).select("row_id", "contig_id", "included", "mapping_type")


def sample_frequency_pivot(spark, sf_dir):
    chosen = _chosen(spark, sf_dir)
    return finalize.sample_counts(finalize.detail(chosen, finalize.final_calls(chosen)), SAMPLES)


def frequency_table(spark, sf_dir):
    chosen = _chosen(spark, sf_dir, NOT_IN_CALLS)
    finals = materialise(finalize.final_calls(chosen), "finals")
    return finalize.frequency_table(finals, finalize.detail(chosen, finals), SAMPLES)


def numbered_calls(spark, sf_dir):
    return finalize.numbered(_finals(spark, sf_dir).select(PLACED), last=True).select("contig_id", "number")


def breakpoint_intervals(spark, sf_dir):
    return breakpoints.breakpoint_intervals(_finals(spark, sf_dir))


def variant_counts(spark, sf_dir):
    return breakpoints.breakpoint_intervals(_finals(spark, sf_dir)).groupBy("variant").agg(F.count(F.lit(1)).alias("calls"), F.sum("score").alias("score"))


def bed12_rows(spark, sf_dir):
    return breakpoints.bed12(_finals(spark, sf_dir))


def lib_median_mad(spark, sf_dir):
    return libstats.library_statistics(tables.alignments(spark, sf_dir))


def discordant_filter(spark, sf_dir):
    return libstats.discordant(tables.alignments(spark, sf_dir), tables.libraries(spark)).select("qname", "is_read1", "tlen")


def mate_pairing(spark, sf_dir):
    found = libstats.discordant(tables.alignments(spark, sf_dir), tables.libraries(spark))
    return libstats.pair_mates(found, tables.libraries(spark), 5)


def footprint_overlap_join(spark, sf_dir):
    return breakpoints.overlapping_calls(_written_finals(spark, sf_dir), SLOP)


def notboth_anti(spark, sf_dir):
    finals = _written_finals(spark, sf_dir)
    pairs = breakpoints.overlapping_calls(finals, SLOP)
    return finals.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("contig_id")).distinct(), "contig_id", "left_anti").select("contig_id")


def merge_runs(spark, sf_dir):
    return merge.merge_runs(_finals(spark, sf_dir).select(PLACED), SLOP, last=True).select("contig_id", "run", "agrees")


def merge_round(spark, sf_dir):
    calls = _finals(spark, sf_dir).withColumn("members", F.array("contig_id"))
    return merge.merge_round(calls, SLOP, last=True).select("contig_id", "min_start1", "max_end1", "min_start2", "max_end2", "distinct_pairs", "mean_mapq1", F.size("members").alias("n_members"))


def merge_fixpoint(spark, sf_dir):
    merged = merge.merge_calls(_finals(spark, sf_dir), SLOP, last=True)
    return merged.select(*ROUTE, "min_start1", "max_end1", "min_start2", "max_end2", "master_id", F.array_join("members", ",").alias("members"), "final_support")


def merged_final(spark, sf_dir):
    return merge.merged_finals(merge.merge_calls(_finals(spark, sf_dir), SLOP, last=True))


def merge_map(spark, sf_dir):
    return merge.merge_map(merge.merge_calls(_finals(spark, sf_dir), SLOP, last=True))


def merged_detail(spark, sf_dir):
    chosen = _chosen(spark, sf_dir)
    finals = materialise(finalize.final_calls(chosen), "finals")
    details = materialise(finalize.detail(chosen, finals).select("row_id", "contig_id", "included"), "details")
    spent(chosen)
    return merge.remap_detail(details, merge.merge_calls(finals, SLOP, last=True)).select("row_id", "contig_id", "included")


def assembled_rows(spark, sf_dir):
    """Clustered mappings as the text layout has them."""
    return text.assembled_layout(islands.tolerances(_stand_in(spark, sf_dir, ["row_id"]), tables.libraries(spark)).withColumn("support", F.lit(1)))


def track_lines(spark, sf_dir):
    """The browser rows of a track in its order."""
    lines = breakpoints.track_lines(breakpoints.bed12(_finals(spark, sf_dir)))
    return lines.select("chrom", "start", "line")


def binary_alignments(spark, sf_dir):
    """The derived alignments, written as block-compressed binary files by library and read back in splits."""
    rows = tables.alignments(spark, sf_dir).withColumn("mate_name", F.concat(F.lit("chr"), (F.col("rnext") + 1).cast("string")))
    folders = []
    for file_num, *_ in tables.LIBRARIES:
        folders.append((file_num, new_folder(spark, "bam")))
        text.write_bam(rows.filter(F.col("file_num") == file_num), folders[-1][1], [(f"chr{i}", bam.FARTHEST) for i in range(1, 5)])
    return text.read_alignments(spark, spark.createDataFrame(folders, "file_num int, mapping_file string"), split=1 << 20)


def dup_runs(spark, sf_dir):
    return dedup.duplicate_runs(_mappings(spark, sf_dir), slop=40).select("row_id", "duplicate", "run")


def dedup_reads(spark, sf_dir):
    return dedup.drop_duplicates(_mappings(spark, sf_dir), slop=40).select("row_id", "read_id")


def dedup_either(spark, sf_dir):
    return dedup.drop_duplicates(_mappings(spark, sf_dir), slop=1, either=True).select("row_id", "read_id")


def _ends(spark, sf_dir):
    m = _mappings(spark, sf_dir)
    end = lambda i: m.select("read_id", F.lit(i).alias("read_num"), *[F.col(f"{c}{i}").alias(c) for c in ("chrom", "start", "end", "edit", "strand")])
    return end(1).unionByName(end(2)).distinct()


def pair_combinations(spark, sf_dir):
    return pairing.pair_combinations(_ends(spark, sf_dir), edit_slop=1)


def tagged_pairs(spark, sf_dir):
    """Ends of low quality are left out of one side, so that some reads are orphans, and few places make a repeat."""
    ends = _ends(spark, sf_dir).filter("read_num = 1 or start % 7 <> 3")
    return pairing.tagged_pairs(ends, pairing.Limits(anchor=4, multi=6, most=3), order="genome", edit_slop=1)


def size_sample(spark, sf_dir):
    return libstats.size_sample(tables.alignments(spark, sf_dir), SAMPLED).select("file_num", "qname", "tlen")


def greedy_clusters(spark, sf_dir):
    inside, punted = pipeline.supported(_mappings(spark, sf_dir), tables.libraries(spark), pipeline.PUNT * len(SAMPLES))
    spent(punted)
    found = assemble.assemble(inside)
    return found.select("row_id", "cluster_id", "mapping_type", "support")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "config_truncation": config_truncation,
    "frag_size": frag_size,
    "mate_order": mate_order,
    "mapping_type_best": _culled("best"),
    "mapping_type_within1": _culled(1),
    "mapping_type_all": _culled("all"),
    "mapping_type_given": mapping_type_given,
    "inner_span_filter": inner_span_filter,
    "route_counts": route_counts,
    "inversion_routes": inversion_routes,
    "islands_gap": _island_query("gap"),
    "islands_inner": _island_query("inner"),
    "punted_islands": punted_islands,
    "punted_calls": punted_calls,
    "pair_support": pair_support,
    "cluster_stats": cluster_stats,
    "best_cluster_per_read": best_cluster_per_read,
    "all_calls": all_calls,
    "final_calls": _finals,
    "final_detail": final_detail,
    "sample_frequency_pivot": sample_frequency_pivot,
    "frequency_table": frequency_table,
    "numbered_calls": numbered_calls,
    "breakpoint_intervals": breakpoint_intervals,
    "variant_counts": variant_counts,
    "bed12_rows": bed12_rows,
    "lib_median_mad": lib_median_mad,
    "discordant_filter": discordant_filter,
    "mate_pairing": mate_pairing,
    "footprint_overlap_join": footprint_overlap_join,
    "notboth_anti": notboth_anti,
    "merge_runs": merge_runs,
    "merge_round": merge_round,
    "merge_fixpoint": merge_fixpoint,
    "merged_final": merged_final,
    "merge_map": merge_map,
    "merged_detail": merged_detail,
    "assembled_rows": assembled_rows,
    "track_lines": track_lines,
    "binary_alignments": binary_alignments,
    "dup_runs": dup_runs,
    "dedup_reads": dedup_reads,
    "dedup_either": dedup_either,
    "pair_combinations": pair_combinations,
    "tagged_pairs": tagged_pairs,
    "size_sample": size_sample,
    "greedy_clusters": greedy_clusters,
    "breakpoint_calls": flagship,
}
from fissure.jobs.oracles import ORACLES  # noqa: E402, F401
