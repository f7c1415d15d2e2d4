"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.components import connected_components
from fissure.llm.shared import materialise, table

#: Distinct vectors a cell holds on average, most cells, and the bounded sample (in numbers) that fits them. Where vectors have no
#: clusters the bound on distances spares few cells, so cells are large: a product costs less than one more row to ship.
CELL, MOST_CELLS, SAMPLE_VALUES = 8192, 4096, 1 << 21
ROUNDS = 8
#: Vectors of a cell that one block compares with as many others, the numbers that these hold, and the vectors of a product.
BLOCK, BLOCK_VALUES, SLICE = 4096, 1 << 20, 512


def spherical_k_means(unit: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors; starts from the first k rows, which the caller has put in random order."""
    centres = unit[:k].copy()
    for _ in range(rounds):
        cell = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def visits(unit: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and all cells that it must be compared in (its own included).

    Two vectors whose cosine is at least the threshold lie within sqrt(2 - 2 threshold) of each other. If neither
    visited the other's cell, the sum of their leads over the other's centroid would exceed that distance times the
    centroids' distance, which it can't. So one of them does, and no link is lost.
    """
    near = unit @ centres.T
    own = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    reach = 0.5 * np.sqrt(max(2 - 2 * threshold, 0)) * apart[own] + 1e-9
    return own, near[np.arange(len(own)), own][:, None] - near <= reach


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return x


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (rep, mult, embedding) to (rep, mult, dim, unit vector as bytes)."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()  # else squares of very large or small numbers overflow
            out.append((len(x), (x / np.linalg.norm(x)).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["rep", "mult", "dim", "unit"])


def _fit(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by dimension, from a bounded sample by hash; a dimension that the sample lacks has one cell."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    out = {}
    for dim, n in sizes.items():
        rows = max(1, SAMPLE_VALUES // dim)
        sample = distinct.filter(F.col("dim") == dim).orderBy(F.xxhash64("unit"), "rep").limit(rows).select("unit").collect()
        k = int(np.clip(-(-n // CELL), 1, min(MOST_CELLS, max(1, len(sample) // 8))))
        out[dim] = spherical_k_means(_unit([bytes(r["unit"]) for r in sample], dim), k)
    return out


def _local_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides of a block, the smallest id reachable by the block's links (own id without links)."""
    a, b = left.copy(), right.copy()
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    some = linked[np.ix_(rows, columns)]
    top = np.iinfo(np.int64).max
    while len(rows):
        x, y, ahead = a[rows], b[columns].copy(), b[columns]
        for at in range(0, len(rows), SLICE):
            part = some[at : at + SLICE]
            x[at : at + SLICE] = np.minimum(x[at : at + SLICE], np.where(part, ahead[None, :], top).min(1))
            y = np.minimum(y, np.where(part, x[at : at + SLICE, None], top).min(0))
        if (x == a[rows]).all() and (y == b[columns]).all():
            break
        a[rows], b[columns] = x, y
    return a, b


def _places(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (rep, mult, dim, unit) to one row for each cell where a vector is compared."""
    names = ["rep", "mult", "dim", "unit", "cell", "own"]
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            raw = batch.column(3).take(pa.array(rows))
            if int(dim) in centres:
                own, at = visits(_unit(raw.to_pylist(), int(dim)), centres[int(dim)], threshold)
            else:
                own, at = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
            i, cell = np.nonzero(at)
            some = batch.take(pa.array(rows[i]))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(own[i], pa.int32())], names)


def _compare(centres: dict[int, np.ndarray], threshold: float):
    def compare(block: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(block["dim"].iat[0]), int(block["cell"].iat[0])
        inner = bool(block["inner"].iat[0])
        is_left, is_right = block["is_left"].to_numpy(), block["is_right"].to_numpy()
        unit, rep, mult, own = _unit(block["unit"].tolist(), dim), block["rep"].to_numpy(), block["mult"].to_numpy(), block["own"].to_numpy()
        left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
        same = inner and len(left) == len(right) and (left == right).all()
        linked, others = np.zeros((len(left), len(right)), bool), unit[right].T
        links_left, links_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for at in range(0, len(left), SLICE):
            some = left[at : at + SLICE]
            here = unit[some] @ others >= threshold
            if same:
                here[np.arange(len(some)), np.arange(at, at + len(some))] = False
            elif not inner and len(right) and dim in centres:
                # A pair of different cells may meet in both; the smaller cell counts it.
                _, near = visits(unit[some], centres[dim], threshold)
                here &= ~(near[:, own[right]] & (own[right] < cell)[None, :])
            linked[at : at + SLICE] = here
            rows, columns = np.nonzero(here)
            np.add.at(links_left, rows + at, mult[right[columns]])
            np.add.at(links_right, columns, mult[some[rows]])
        a, b = _local_links(linked, rep[left], rep[right])
        parts = [pd.DataFrame({"rep": rep[left], "links": links_left, "root": a})]
        if not same:
            parts.append(pd.DataFrame({"rep": rep[right], "links": links_right, "root": b}))
        out = pd.concat(parts)
        return out[out["links"] > 0]

    return compare


def near_vectors(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    Vectors link if their cosine in double precision is at least the threshold. Equal vectors are one class with a
    count. Each class goes to its own cell and to all cells where it could have links (see visits), and each
    cell is compared in blocks of bounded size, so a hot cell becomes many blocks. A block gives link counts and the
    components of its own links, never pairs.

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing, nor do vectors of different lengths
    with each other. A null vec_id stays by itself: no links, a null component, kept. Rows that repeat a vec_id
    count as vectors each. An empty table gives no rows; other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("embedding"))
    rows = rows.withColumns({"m1": F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")), "m2": F.xxhash64(F.lit(7), "embedding")})
    mark = ["m1", "m2"]
    classes = materialise(rows.filter("m1 is not null").groupBy(*mark).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "classes")
    first = rows.join(classes, mark).filter("vec_id = rep").dropDuplicates([*mark]).select("rep", "mult", "embedding")
    distinct = materialise(first.mapInArrow(_normalised, "rep long, mult long, dim int, unit binary"), "units")

    centres = _fit(distinct)
    shared = embeddings.sparkSession.sparkContext.broadcast(centres)
    placed = distinct.mapInArrow(lambda batches: _places(batches, shared.value, threshold), "rep long, mult long, dim int, unit binary, cell int, own int")
    placed = materialise(placed, "cells")
    counts = placed.groupBy("dim", "cell").agg(F.count_if(F.col("own") == F.col("cell")).alias("homes"), F.count_if(F.col("own") != F.col("cell")).alias("guests"))
    block_rows = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.greatest("dim", F.lit(1)))), F.lit(1))
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1)).cast("int")
    # At most MOST_CELLS rows for each dimension.
    placed = placed.join(F.broadcast(counts.select("dim", "cell", chunks("homes").alias("h"), chunks("guests").alias("g"))), ["dim", "cell"])
    home = F.col("own") == F.col("cell")
    mine = F.pmod(F.xxhash64("rep"), F.when(home, F.col("h")).otherwise(F.col("g"))).cast("int")

    def block(inner: bool, i, j, is_left, is_right):
        as_column = lambda x: x if not isinstance(x, bool) else F.lit(x)
        return F.struct(F.lit(inner).alias("inner"), i.cast("int").alias("i"), j.cast("int").alias("j"), as_column(is_left).alias("is_left"), as_column(is_right).alias("is_right"))

    all_h, all_g = F.sequence(F.lit(0), F.col("h") - 1), F.sequence(F.lit(0), F.col("g") - 1)
    homes_with_homes = F.transform(all_h, lambda j: block(True, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j), F.col("mine") <= j, F.col("mine") >= j))
    homes_with_guests = F.transform(all_g, lambda j: block(False, F.col("mine"), j, True, False))
    guests = F.transform(all_h, lambda i: block(False, i, F.col("mine"), False, True))
    blocks = F.when(home, F.concat(homes_with_homes, homes_with_guests)).otherwise(guests)
    placed = placed.withColumn("mine", mine).select("rep", "mult", "dim", "unit", "cell", "own", F.explode(blocks).alias("b")).select("*", "b.*").drop("b")
    compare = _compare
    threshold_here = threshold

    def in_block(frame: pd.DataFrame) -> pd.DataFrame:
        return compare(shared.value, threshold_here)(frame)

    found = materialise(placed.groupBy("dim", "cell", "inner", "i", "j").applyInPandas(in_block, "rep long, links long, root long"), "block-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select(*mark, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id", *mark).join(named, mark, "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
