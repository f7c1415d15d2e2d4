"""Position islands: runs of neighbouring mappings within a route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.functions.geometry import length_tolerance, mates_agree, size_off_expected, span_tolerance
from fissure.operators.runs import with_runs
from fissure.sources.shared import materialise

#: Fixed value: bases between one mapping's first block and the next one's beyond which a run ends.
GAP = 2000
#: Places in an island beyond which they meet in bins.
CROWDED = 64
ORDER = ["start1", "end1", "start2", "end2", "read_id", "row_id"]
KEY = ["route", "island"]


def with_islands(routed: DataFrame, rule: str = "gap", gap: int = GAP, without: Sequence[str] = (), last: bool = False) -> DataFrame:
    """Adds island, numbered from 1 within each route.

    `gap`: a mapping starts a new island if its start1 lies more than gap behind its predecessor's end1.
    `inner`: if its end1 does not lie before its predecessor's start2. Only the immediate predecessor counts.
    without: columns that are dropped once rows have their order. last: nothing else reads the written tables that routed is made from, so they go.
    """
    if rule == "gap":
        found = with_runs(routed, ["route"], "start1", ORDER, ["end1"], lambda before: F.col("start1") - before("end1") > gap, "island", without=without, last=last)
        return found.drop("before_end1")
    return with_runs(routed, ["route"], "start1", ORDER, ["start2"], lambda before: F.col("end1") >= before("start2"), "island", without=without, last=last).drop("before_start2")


def island_sizes(islands: DataFrame) -> DataFrame:
    return islands.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("start1").alias("first_start"), F.max("end1").alias("last_end"))


def split_by_size(islands: DataFrame, most: int, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Islands of 2 to `most` mappings, and larger ones, which are set aside whole: a stated output, not a loss. Written once.

    last: nothing else reads these islands, so the tables that they come from go.
    """
    sizes = islands.groupBy(*KEY).agg(F.count(F.lit(1)).alias("island_size")).filter("island_size > 1")
    sized = materialise(islands.join(sizes, KEY), "islands", last)
    return sized.filter(f"island_size <= {most}"), sized.filter(f"island_size > {most}")


def tolerances(islands: DataFrame, libraries: DataFrame) -> DataFrame:
    """Adds what the agreement of two mappings needs from their libraries."""
    stats = libraries.select("file_num", "exp_size", "variance", "num_devs")
    out = islands.join(F.broadcast(stats), "file_num")  # one row for each library
    return out.withColumns({"size_off": size_off_expected(), "length_tol": length_tolerance(), "span_tol": span_tolerance()}).drop("exp_size", "variance", "num_devs")


def pair_support(islands: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Adds support: how many other mappings of the island agree with each.

    Equal places are counted first, once for all their mappings. In an island of more than `crowded` places they meet in bins of size
    and position as wide as the largest tolerances, so that none meets one far off; in smaller islands all meet.
    """
    shape = ["within_", "start1", "end1", "start2", "end2", "size_off", "length_tol", "span_tol"]
    marked = islands.withColumn("within_", F.col("chrom1") == F.col("chrom2"))
    places = marked.groupBy(*KEY, *shape).agg(F.count(F.lit(1)).alias("n"))
    sizes = places.groupBy(*KEY).agg(F.count(F.lit(1)).alias("places"), F.max("length_tol").alias("wide_size"), F.max("span_tol").alias("wide_span"))
    crowds = sizes.filter(F.col("places") > crowded).select(*KEY, F.greatest("wide_size", F.lit(1)).alias("wide_size"), F.greatest("wide_span", F.lit(1)).alias("wide_span"))
    places = materialise(places.join(crowds, KEY, "left"), "places")
    in_crowd = F.col("wide_size").isNotNull()
    size_bin, span_bin = F.floor(F.col("size_off") / F.col("wide_size")), F.floor(F.col("start1") / F.col("wide_span"))
    none = F.lit(0).cast("long")
    a = places.withColumns({"size_bin": F.when(in_crowd, size_bin).otherwise(none), "span_bin": F.when(in_crowd, span_bin).otherwise(none)})
    near = lambda of: F.explode(F.when(in_crowd, F.sequence(of - 1, of + 1)).otherwise(F.array(none)))
    b = places.withColumn("size_bin", near(size_bin)).withColumn("span_bin", near(span_bin)).select(*KEY, "size_bin", "span_bin", *shape, "n")
    a, b = a.alias("a"), b.alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "size_bin", "span_bin")]).filter(mates_agree("a", "b"))
    found = met.groupBy(*[F.col(f"a.{c}") for c in (*KEY, *shape)]).agg(F.sum("b.n").alias("agreeing"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) if c == "within_" else F.col(f"m.{c}") == F.col(f"f.{c}") for c in (*KEY, *shape)]
    # A place that agrees at all agrees with itself, and so do its mappings with each other; none supports itself.
    out = marked.alias("m").join(found.alias("f"), same, "left").select("m.*", (F.coalesce("f.agreeing", F.lit(1)) - 1).alias("support"))
    return out.drop("within_")
