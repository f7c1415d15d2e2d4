"""The breakpoint job end to end: mappings to clusters, calls, details, counts, and what is set aside."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from fissure.jobs.stages import not_kept
from fissure.operators import assemble, finalize, islands, route
from fissure.sources import tables
from fissure.sources.shared import materialise

#: Mappings in an island for each library beyond which it is set aside.
PUNT = 50


class Found(NamedTuple):
    """Final calls; all mappings in clusters with their choice of cluster; mappings of islands that were set aside."""

    finals: DataFrame
    chosen: DataFrame
    punted: DataFrame


def in_islands(mappings: DataFrame, most: int, usage: str | int = "best", rule: str = "gap") -> tuple[DataFrame, DataFrame]:
    """Routed mappings in islands of 2 to most mappings, and those of larger islands; written."""
    routed = materialise(route.routed(mappings, usage), "routed")
    return islands.split_by_size(islands.with_islands(routed, rule, last=True), most, last=True)


def supported(mappings: DataFrame, libraries: DataFrame, most: int, usage: str | int = "best", rule: str = "gap") -> tuple[DataFrame, DataFrame]:
    """Routed mappings in islands of bounded size, with support, and those of larger islands; written, as several steps read them."""
    inside, punted = in_islands(mappings, most, usage, rule)
    punted = materialise(punted, "punted")
    return materialise(islands.pair_support(islands.tolerances(inside, libraries)), "supported", last=True), punted


def breakpoint_calls(mappings: DataFrame, libraries: DataFrame, n_libraries: int, punt: int = PUNT, keep: Callable[..., DataFrame] = not_kept) -> Found:
    """Calls of all islands of at most punt mappings for each library; the larger ones are an output of their own.

    keep holds the stages (see Stages): mappings with support, those set aside, and those in clusters, by island.
    """
    split: list[tuple[DataFrame, DataFrame]] = []

    def part(i: int) -> DataFrame:
        if not split:
            split.append(supported(mappings, libraries, n_libraries * punt) if keep is not_kept else in_islands(mappings, n_libraries * punt))
        return split[0][i]

    rows = keep("supported", lambda: part(0) if keep is not_kept else islands.pair_support(islands.tolerances(part(0), libraries)), islands.KEY)
    punted = keep("punted", lambda: part(1), islands.KEY)
    clustered = keep("clustered", lambda: assemble.assemble(rows), ["cluster_id"])
    chosen = finalize.choose_clusters(clustered, last=True)
    return Found(finalize.final_calls(chosen), chosen, punted)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakpoint_calls(tables.mappings(spark, sf_dir), tables.libraries(spark), len(tables.LIBRARIES)).finals
