"""Tables in the folder that the driver and all executors share, for loops that must cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete an execution's shuffle files when it ends, not when the driver's JVM happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster set it; a folder of our own only in local mode, where one machine is all there is."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fissure-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/fissure-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/rows"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def spent(*frames: DataFrame) -> None:
    """Deletes the written tables that some frames read: whatever was made of them must be written by now."""
    for df in frames:
        spark = df.sparkSession
        for name in {m[1] for f in df.inputFiles() if (m := re.search(r"/(fissure-[a-z-]+-[0-9a-f]{32})/rows/", f))}:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: survives the loss of executors. The write's shuffle files go with its end.

    last: nothing else reads the written tables that df is made from, so they go too.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    if last:
        spent(df)
    return spark.read.schema(df.schema).parquet(path)
