"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def shared_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast that gives its value in a task; classes travel by value, so executors don't import this package."""
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(raw.value)


def process_state() -> types.ModuleType:
    """A module that lives as long as this Python worker, which Spark reuses for many tasks."""
    return sys.modules.setdefault("_fissure_process_state", types.ModuleType("_fissure_process_state"))


def kept_in_process(name: str, make: Callable[[], object]) -> object:
    """A value that this worker makes once; the one it kept before under another name goes."""
    state = process_state()
    if not hasattr(state, name):
        vars(state).clear()
        setattr(state, name, make())
    return getattr(state, name)


def released(body: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow body that gives freed memory back to the system at its end: workers stay, idle, beside the tasks of other stages."""

    def run(batches: Iterator) -> Iterator:
        yield from body(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect all garbage: a heap keeps what earlier stages touched, beside the Python workers of the next, and a full collection gives it back.

    One task for each core, so that every idle executor gets some; one that is left out just keeps its heap.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') done").collect()


#: Rows of an Arrow batch of whole texts, unless the session sets its own number.
BATCH_ROWS, ARROW_ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose Arrow batches hold few rows: texts can be long, and a batch is in memory at both ends."""
    conf = docs.sparkSession.conf
    if ARROW_ROWS not in conf.getAll:
        conf.set(ARROW_ROWS, BATCH_ROWS)
    return docs


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
