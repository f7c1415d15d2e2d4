"""From files to files: configs, calls from alignments, paired intervals or assembled rows, merged calls, duplicates, pairs, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.jobs import pipeline
from fissure.jobs.stages import Stages, not_kept
from fissure.operators import breakpoints, dedup, finalize, libstats, merge, pairing
from fissure.sources import schemas, text
from fissure.sources.shared import materialise

BEDPE = [c.split()[0] for c in schemas.BEDPE.split(", ")]


def make_config(spark: SparkSession, stub_path: str, out: str, num_devs: float = 8, per_library: int = 100_000) -> None:
    """Writes a library config for a stub's alignments (SAM text): median size and deviation from a bounded sample of each."""
    stub = text.read_stub(spark, stub_path).collect()  # a row for each library
    libraries = spark.createDataFrame([(i, r["sample"], r["bam_path"]) for i, r in enumerate(stub)], "file_num int, sample string, mapping_file string")
    sample = materialise(libstats.size_sample(text.read_alignments(spark, libraries), per_library), "sizes")
    text.write_libraries(libstats.library_statistics(sample).join(libraries, "file_num"), out, num_devs)


def extract(spark: SparkSession, config_path: str, out: str, min_mapq: int = 0, allow_duplicates: bool = False) -> DataFrame:
    """Discordant pairs of all alignments that a config names, as mappings; also written as paired intervals under out."""
    libraries = text.read_libraries(spark, config_path)
    found = libstats.discordant(text.read_alignments(spark, libraries), libraries, allow_duplicates)
    pairs = libstats.pair_mates(found, libraries, min_mapq).withColumn("row_id", F.concat_ws(".", "file_num", "read_id"))
    pairs = materialise(pairs, "mappings")
    text.write_tsv(pairs.select(BEDPE), out)
    return pairs


def write_chosen(chosen: DataFrame, config_path: str, out: str) -> None:
    """Writes out.all, .final, .detail and .freq from mappings in clusters with their choice: every cluster, the calls, their mappings, counts by sample."""
    samples = text.read_samples(chosen.sparkSession, config_path)
    finals = materialise(finalize.final_calls(chosen), "finals")
    details = materialise(finalize.detail(chosen, finals), "details")
    text.write_tsv(finalize.calls(chosen).filter("all_weighted_support > 0").select(schemas.FINAL), out + ".all")
    text.write_tsv(finals.select(schemas.FINAL), out + ".final")
    text.write_tsv(details.select(schemas.DETAIL), out + ".detail")
    text.write_frequencies(finalize.frequency_table(finals, details, samples), out + ".freq")


def write_calls(spark: SparkSession, mappings: DataFrame, config_path: str, out: str, punt: int = pipeline.PUNT, stages: str | None = None) -> None:
    """Writes the files of write_chosen, and out.assembled and out.punted: all mappings in clusters, and what was set aside.

    stages: a folder where the job's stages stay; a run that finds finished ones there goes on behind them.
    """
    libraries = text.read_libraries(spark, config_path)
    rows = [list(map(str, r)) for r in libraries.orderBy("file_num").collect()]  # a row for each library
    keep = Stages(spark, stages, {"libraries": rows, "punt": punt}).keep if stages else not_kept
    found = pipeline.breakpoint_calls(mappings, libraries, len(rows), punt, keep)
    text.write_assembled(found.chosen, out + ".assembled")
    text.write_tsv(found.punted.select(*BEDPE, "mapping_type", "route", "island"), out + ".punted")
    write_chosen(found.chosen, config_path, out)


def finalise(spark: SparkSession, assembled: str | list[str], config_path: str, out: str) -> None:
    """The files of write_chosen from assembled rows."""
    write_chosen(finalize.choose_clusters(text.read_assembled(spark, assembled)), config_path, out)


def merge_files(spark: SparkSession, final: str, detail: str, out: str, slop: int = 100) -> None:
    """Writes out.final, out.mergemap and out.detail: calls that show the same breakpoint as one, which calls those were, and their mappings under the new ids."""
    merged = materialise(merge.merge_calls(text.read_finals(spark, final), slop), "merged")
    text.write_tsv(merge.merged_finals(merged), out + ".final")
    text.write_tsv(merge.merge_map(merged), out + ".mergemap")
    text.write_tsv(merge.remap_detail(text.read_details(spark, detail), merged).select(schemas.DETAIL), out + ".detail")


def dedup_file(spark: SparkSession, mappings: str, out: str, slop: int = 1, most_mappings: int = 1, either: bool = False) -> None:
    """Writes paired intervals without duplicates, in the order of read names."""
    kept = dedup.drop_duplicates(text.read_bedpe(spark, mappings), slop, most_mappings, either)
    text.write_tsv(kept.orderBy("read_id", "row_id").select(BEDPE), out)


def pair_file(spark: SparkSession, ends: str, out: str, mode: str = "discordant", limits: pairing.Limits = pairing.Limits(), order: str = "size", edit_slop: int | None = None) -> None:
    """Writes pairs of single-end mappings in the layout of a mode."""
    text.write_tsv(pairing.pairs_by_mode(text.read_ends(spark, ends), mode, limits, order, edit_slop), out)


def write_track(spark: SparkSession, calls: str, out: str, name: str, far: int = 1_000_000) -> None:
    """A browser track of calls (ten columns or more): rows by position under one header, over the parts of out in the order of their names."""
    lines = breakpoints.track_lines(breakpoints.bed12(text.read_calls(spark, calls), far))
    text.write_ordered(lines, out, f"track name={name} itemRgb=On", ["chrom", "start", "end", "name", "strand"])


def call_alignments(spark: SparkSession, config_path: str, out: str, punt: int = pipeline.PUNT, stages: str | None = None) -> None:
    """Calls from the alignments of a config; the discordant pairs are written as out.bedpe."""
    write_calls(spark, extract(spark, config_path, out + ".bedpe"), config_path, out, punt, stages)


def call_mappings(spark: SparkSession, config_path: str, out: str, punt: int = pipeline.PUNT, stages: str | None = None) -> None:
    """Calls from paired intervals that lie beside the alignments of a config."""
    write_calls(spark, text.read_mappings(spark, text.read_libraries(spark, config_path)), config_path, out, punt, stages)
