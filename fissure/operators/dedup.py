"""Duplicate pairs: reads whose mappings start at the same places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissure.operators.components import connected_components
from fissure.operators.runs import with_runs
from fissure.sources.shared import materialise, spent

ROUTE = ["chrom1", "chrom2", "strand1", "strand2"]


def five_prime(mappings: DataFrame) -> DataFrame:
    """Adds p1 and p2, where each block's read starts, total_edits and total_mappings."""
    first = lambda i: F.when(F.col(f"strand{i}") == "-", F.col(f"end{i}")).otherwise(F.col(f"start{i}"))
    return mappings.withColumns({"p1": first(1), "p2": first(2), "total_edits": F.col("edit1") + F.col("edit2"), "total_mappings": F.col("mappings1") * F.col("mappings2")})


def duplicate_runs(mappings: DataFrame, slop: int = 1, either: bool = False, end: int = 1) -> DataFrame:
    """Marks mappings that lie within slop of their predecessor at both ends (either: at one), under another name; adds run.

    Mappings follow each other by where their read starts at the given end, then by the other one.
    """
    return _marked(five_prime(mappings), slop, either, end)


def _marked(placed: DataFrame, slop: int, either: bool, end: int) -> DataFrame:
    """duplicate_runs of mappings with p1 and p2."""
    order = [f"p{end}", f"p{3 - end}", "read_id", "row_id"]

    def same(before) -> Column:
        near = [F.abs(F.col(c) - before(c)) <= slop for c in ("p1", "p2")]
        return F.coalesce(((near[0] | near[1]) if either else (near[0] & near[1])) & (F.col("read_id") != before("read_id")), F.lit(False))

    m = with_runs(placed, ROUTE, f"p{end}", order, ["p1", "p2", "read_id"], lambda before: ~same(before), "run")
    marked = m.withColumns({"duplicate": same(lambda c: F.col(f"before_{c}")), "before": F.col("before_read_id")})
    return marked.drop("before_p1", "before_p2", "before_read_id")


def _blocks(mappings: DataFrame, slop: int, either: bool) -> DataFrame:
    """The mappings of runs of several, (block, row_id, read_id, total_edits, total_mappings), by end 1 and with either by end 2 too."""
    found, slim = [], mappings.select(*[f"{c}{i}" for c in ("chrom", "start", "end", "strand", "edit", "mappings") for i in (1, 2)], "read_id", "row_id")
    for end in (1, 2) if either else (1,):
        placed = five_prime(slim).select(*ROUTE, "p1", "p2", "total_edits", "total_mappings", "read_id", "row_id")
        runs = _marked(placed, slop, either, end)
        rows = runs.select(F.concat_ws(".", F.lit(end), *ROUTE, "run").alias("block"), "row_id", "read_id", "total_edits", "total_mappings")
        several = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block")
        found.append(materialise(rows.join(several, "block", "left_semi"), "blocks"))
        spent(runs)
    return reduce(DataFrame.unionByName, found)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Reads of some blocks, (read_id, edits, n): n has the order of their names, so that what follows compares and shuffles numbers."""
    reads = blocks.groupBy("read_id").agg(F.min("total_edits").alias("edits"))
    return materialise(reads.orderBy("read_id").withColumn("n", F.monotonically_increasing_id()), "reads")


def drop_duplicates(mappings: DataFrame, slop: int = 1, most_mappings: int = 1, either: bool = False) -> DataFrame:
    """Mappings without duplicates; what stays of an inferior read goes under the name of the best one.

    Of the reads that blocks of duplicates tie together, directly or through others, the one with the fewest edits (then the
    smallest name) is best, so the choice doesn't depend on the order in which blocks are met. A block keeps
    the best read's mappings, or where it has none those of its own read with the fewest edits. Mappings outside
    blocks stay. A read with more than most_mappings combinations in a block goes with all its mappings, before anything else.
    Every step is written, and what it was made of goes then, so the disk holds a few slim tables at a time.
    """
    blocks = _blocks(mappings, slop, either)
    many = materialise(blocks.filter(F.col("total_mappings") > most_mappings).select("read_id").distinct(), "many")
    reads = _numbered(blocks.join(many, "read_id", "left_anti"))
    tied = materialise(blocks.join(reads.select("read_id", "n"), "read_id").select("block", "row_id", "total_edits", "n"), "tied")
    spent(blocks)
    heads = materialise(tied.groupBy("block").agg(F.min("n").alias("head"), F.min(F.struct("total_edits", "n"))["n"].alias("own")), "heads")
    groups = connected_components(tied.join(heads, "block").select("n", "head"), "n", "head")
    rooted = materialise(groups.join(reads.select("n", "edits"), groups["id"] == F.col("n")).select("n", "root", "edits"), "rooted")
    spent(groups)
    winners = rooted.groupBy("root").agg(F.min(F.struct("edits", "n"))["n"].alias("best"))
    best = materialise(rooted.join(winners, "root").select("n", "best"), "best", last=True)

    own = heads.join(best.withColumnRenamed("n", "head"), "head", "left").select("block", F.coalesce("best", "head").alias("best"), "own")  # a block of one read has no links
    members = materialise(tied.join(own, "block").select("block", "row_id", "n", "best", "own"), "members")
    spent(tied, heads)
    stays = members.groupBy("block").agg(F.bool_or(F.col("n") == F.col("best")).alias("has_best"))
    stays_by = F.when(F.col("has_best"), F.col("best")).otherwise(F.col("own"))
    inferior = materialise(members.join(stays, "block").filter(F.col("n") != stays_by).select("row_id").distinct(), "inferior", last=True)

    names = reads.select(F.col("n").alias("best"), F.col("read_id").alias("name"))
    marks = reads.join(best, "n").join(names, "best").select("read_id", "name", F.lit(False).alias("many"))
    marks = materialise(marks.unionByName(many.select("read_id", F.lit(None).cast("string").alias("name"), F.lit(True).alias("many"))), "marks", last=True)
    kept = mappings.join(marks, "read_id", "left").filter(~F.coalesce("many", F.lit(False))).join(inferior, "row_id", "left_anti")
    return kept.withColumn("read_id", F.coalesce("name", "read_id")).select(mappings.columns)
