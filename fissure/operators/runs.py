"""Runs of neighbouring rows within a key, computed in bins of position so that no key needs a task of its own.

A row's run depends on its immediate predecessor alone. Windows therefore span one bin of a key and never look
further than a row back; what crosses bins is one row for each bin: its first row, its last one, and how many runs open in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissure.sources.shared import materialise

#: Positions in a bin.
WIDTH = 100_000


def with_runs(df: DataFrame, key: list[str], position: str, order: list[str], carried: list[str], opens: Callable[[Callable[[str], Column]], Column], name: str, width: int = WIDTH, without: Sequence[str] = (), last: bool = False) -> DataFrame:
    """Adds name, the number of each row's run from 1 in its key, and before_<c> for each carried column: its value in the preceding row.

    order starts with position, so that bins follow each other. opens gives the condition for a row to start a run, from a
    function that names a carried column of the preceding row; a null condition counts as true, and the first row of a key
    always starts one. The rows are written once, with their place in their bin; bins are then numbered from the ends of each.
    without: columns that order alone needs, which the rows lose then. last: nothing else reads the written tables that df is made from, so they go.
    """
    w = Window.partitionBy(*key, "bin_").orderBy(*order)
    before = lambda c: F.col(f"before_{c}")
    starts = F.coalesce(opens(before), F.lit(True)).cast("long")
    rows = df.withColumn("bin_", F.floor(F.col(position) / width))
    rows = rows.withColumns({"at_": F.row_number().over(w), "last_": F.lead(F.lit(1)).over(w).isNull()} | {f"before_{c}": F.lag(c).over(w) for c in carried})
    rows = rows.withColumn("starts_", F.when(F.col("at_") > 1, starts).otherwise(0))
    rows = materialise(rows.withColumn("upto_", F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("starts_", *without), "binned", last)

    # One row for each bin of a key: its first row, with what its last one carries and how many runs open behind the first.
    first = rows.filter("at_ = 1").drop("at_", "last_", "upto_", *[f"before_{c}" for c in carried])
    last = rows.filter("last_").select(*key, "bin_", F.struct(*[F.col(c).alias(f"before_{c}") for c in carried]).alias("ends_"), F.col("upto_").alias("inside_"))
    along = Window.partitionBy(*key).orderBy("bin_")
    bins = first.join(last, [*key, "bin_"]).withColumn("ends_", F.lag("ends_").over(along))
    bins = bins.withColumns({f"before_{c}": F.col(f"ends_.before_{c}") for c in carried})
    bins = bins.withColumn("first_", F.when(F.row_number().over(along) == 1, 1).otherwise(starts))
    ahead = F.coalesce(F.sum(F.col("first_") + F.col("inside_")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("first_")
    bins = bins.select(*key, "bin_", ahead.alias("ahead_"), F.col("ends_"))

    joined = rows.join(bins, [*key, "bin_"]).withColumn(name, F.col("ahead_") + F.col("upto_"))
    crossing = {f"before_{c}": F.when(F.col("at_") == 1, F.col(f"ends_.before_{c}")).otherwise(before(c)) for c in carried}
    return joined.withColumns(crossing).drop("bin_", "at_", "last_", "upto_", "ahead_", "ends_")
