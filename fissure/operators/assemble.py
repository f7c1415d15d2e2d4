"""Greedy assembly of mutually consistent mappings into clusters, many islands in one batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

KEY = ["route", "island"]
#: A mapping's place, which settles ties between equal ones.
PLACE = ["start1", "end1", "start2", "end2", "read_id", "file_num", "row_id"]
NUMBERS = ["start1", "end1", "start2", "end2", "size_off", "length_tol", "span_tol", "support", "tie_"]


def _agreeing(rows: dict[str, np.ndarray], i: int, among: np.ndarray) -> np.ndarray:
    """Which of the given mappings agree with mapping i in size, span and inner span."""
    lengths = np.abs(rows["size_off"][among] - rows["size_off"][i]) <= np.maximum(rows["length_tol"][among], rows["length_tol"][i])
    spread = np.abs(rows["start1"][among] - rows["start1"][i]) + np.abs(rows["end2"][among] - rows["end2"][i])
    spans = spread <= np.maximum(rows["span_tol"][among], rows["span_tol"][i])
    common = np.minimum(rows["start2"][among], rows["start2"][i]) > np.maximum(rows["end1"][among], rows["end1"][i])
    return lengths & spans & (common | ~(rows["within_"][among] & rows["within_"][i]))


def assemble_island(rows: dict[str, np.ndarray], first: int, end: int, least: int, cluster: np.ndarray) -> None:
    """Writes the clusters of one island, rows first to end in the order of seeds, into cluster (from 1; 0 stays for none).

    The seed is the best mapping left (type, then support, then place). Candidates come by how little they differ
    from it and join if they agree with every member so far. A cluster of at least `least` mappings is kept and its
    members leave; otherwise only the seed does.
    """
    left, found = np.ones(end - first, bool), 0
    for seed in range(first, end):
        if not left[seed - first] or rows["support"][seed] == 0:
            continue
        left[seed - first] = False
        others = np.flatnonzero(left) + first
        if not len(others):
            break
        # Whoever disagrees with a member is out for good, so each new member thins the candidates that follow.
        others = others[_agreeing(rows, seed, others)]
        differs = np.abs(rows["start1"][others] - rows["start1"][seed]) + np.abs(rows["end2"][others] - rows["end2"][seed])
        members, others = [seed], others[np.lexsort((rows["tie_"][others], differs))]
        while len(others):
            member, others = others[0], others[1:]
            members.append(member)
            others = others[_agreeing(rows, member, others)]
        if len(members) >= least:
            found += 1
            left[np.array(members) - first] = False
            cluster[members] = found


def assemble_batch(rows: dict[str, np.ndarray], starts: np.ndarray, least: int = 2) -> np.ndarray:
    """The cluster of each row within its island, 0 for none; islands are runs of rows that start at `starts`.

    Where each mapping agrees with all others of its island, as nearly always in small ones, the island is one
    cluster; such islands are closed together, and only the others are walked.
    """
    ends = np.r_[starts[1:], len(rows["support"])]
    sizes = ends - starts
    cluster = np.zeros(len(rows["support"]), np.int64)
    whole = np.minimum.reduceat(rows["support"], starts) == sizes - 1
    cluster[np.repeat(whole & (sizes >= least), sizes)] = 1
    for i in np.flatnonzero(~whole):
        assemble_island(rows, int(starts[i]), int(ends[i]), least, cluster)
    return cluster


def _in_batches(least: int, names: list[str]):
    """mapInArrow body over partitions sorted by route, island and seeds: clustered rows with their cluster; an island that crosses batches waits for its end."""

    def closed(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = {c: table.column(c).to_numpy().astype(np.int64) for c in NUMBERS} | {"within_": table.column("within_").to_numpy(zero_copy_only=False).astype(bool)}
        cluster = assemble_batch(rows, starts, least)
        out = table.select(names).append_column("cluster", pa.array(cluster)).filter(pa.array(cluster > 0))
        yield from out.combine_chunks().to_batches()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
            island, route = table.column("island").to_numpy(), table.column("route").combine_chunks()
            opens = (np.diff(island) != 0) | pc.not_equal(route[1:], route[:-1]).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(opens) + 1]
            if len(starts) > 1:
                yield from closed(table.slice(0, int(starts[-1])), starts[:-1])
            waiting = table.slice(int(starts[-1]))
        if waiting is not None:
            yield from closed(waiting, np.array([0]))

    return assemble


def assemble(supported: DataFrame, least: int = 2) -> DataFrame:
    """Mappings in clusters, with cluster_id `route_island.cluster`; a mapping is in one cluster at most.

    Needs support and tolerances on each mapping. One exchange by island; Spark sorts, first to rank mappings by place, then by the
    order of seeds, and Python gets batches of whole islands. Islands of one mapping, and mappings that none supports, never reach it.
    """
    by_place = Window.partitionBy(*KEY).orderBy(*PLACE)
    rows = supported.filter("support > 0").withColumns({"within_": F.col("chrom1") == F.col("chrom2"), "tie_": F.row_number().over(by_place)})
    rows = rows.sortWithinPartitions(*KEY, "mapping_type", F.desc("support"), "tie_")
    schema = StructType([*supported.schema.fields, StructField("cluster", LongType())])
    found = rows.mapInArrow(_in_batches(least, supported.columns), schema)
    return found.withColumn("cluster_id", F.concat(F.col("route"), F.lit("_"), F.col("island"), F.lit("."), F.col("cluster"))).drop("cluster")
