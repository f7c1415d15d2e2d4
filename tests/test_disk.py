"""What jobs leave on the disk: written tables and shuffle files go as soon as nothing reads them."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fissure.jobs.registry import QUERIES
from fissure.sources.shared import materialise, shared_dir, spent

SF = "/root/testdata/sf0.001"


def tables(spark):
    """Written tables that hold files, by name."""
    return {p.name: p.name.split("-")[1] for p in Path(shared_dir(spark).removeprefix("file://")).glob("fissure-*") if any(p.rglob("*.parquet"))}


def left(spark, name):
    before = tables(spark)
    out = QUERIES[name](spark, SF)
    out.write.format("noop").mode("overwrite").save()
    return sorted(kind for folder, kind in tables(spark).items() if folder not in before)


def test_shuffle_files_go_with_the_write(spark):
    blocks = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = blocks()
    out = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while blocks() > before and time.time() < end:
        time.sleep(0.2)
    assert blocks() <= before and out.count() == 7


def test_spent_tables_go(spark):
    a = materialise(spark.range(10), "a")
    b = materialise(a.filter("id > 4"), "b", last=True)
    assert b.count() == 5 and "a" not in tables(spark).values()
    spent(b, spark.range(3))
    assert "b" not in tables(spark).values()


@pytest.mark.parametrize(("name", "most"), [("dedup_either", ["inferior", "marks"]), ("numbered_calls", ["binned"]), ("frequency_table", ["chosen", "finals"]), ("notboth_anti", ["finals"]), ("merged_detail", ["calls", "details"]), ("merge_fixpoint", ["calls"]), ("merged_final", ["calls"]), ("merge_map", ["calls"]), ("footprint_overlap_join", ["finals"]), ("merge_round", ["binned"]), ("greedy_clusters", ["supported"]), ("merge_runs", ["binned"]), ("breakpoint_calls", ["chosen", "punted"])])
def test_a_query_leaves_what_its_rows_come_from(spark, name, most):
    assert left(spark, name) == most
