"""Connected components of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm.shared import materialise


def _hub(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node u, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, root) for each id that some link holds; root is the smallest id that it reaches.

    Each round ties every node's larger neighbours to its smallest one, then its
    smaller neighbours and itself likewise, and writes the links that result;
    it ends when a round changes none. The number of links never grows, and
    a node with very many neighbours meets them in a join that Spark can split, after
    its minimum was found with partial aggregates. Self-links and null ends are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = _fingerprint(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.join(_hub(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now u > v in each row: tie u and its smaller neighbours to the smallest of them.
        hubs = _hub(larger)
        smaller = larger.join(hubs, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = smaller.unionByName(hubs.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(edges, "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
