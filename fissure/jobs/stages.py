"""Stages of a job that stay under a folder: a later run goes on from the last one that was finished."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Buckets of a stage; each is a task's work at least, and several files where tasks wrote to it.
BUCKETS = 64


def not_kept(name: str, make: Callable[[], DataFrame], by: list[str], order: list[str] | None = None) -> DataFrame:
    """The way of a job without stages."""
    return make()


class Stages:
    """Tables under a folder, bucketed by the columns that the next step groups by, so that a restart needs no exchange for it.

    A stage counts once its manifest is written, which comes last: it names what the stage was made from, its schema and its buckets. A
    folder whose stages were made from something else fails the job, so nothing old is taken for new. A stage without a manifest is that of
    a run that ended within it, and is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, made_from: dict, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.made_from = json.loads(json.dumps(made_from))
        self.made: list[str] = []

    def _path(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> dict | None:
        place, files = self._path(f"{name}.json")
        if not files.exists(place):
            return None
        found = json.loads("".join(r["value"] for r in self.spark.read.text(place.toString(), wholetext=True).collect()))  # one small file
        if found["made_from"] != self.made_from:
            raise ValueError(f"stage {name} under {self.folder} was made from something else: {found['made_from']}")
        return found

    def _table(self, name: str) -> str:
        return f"fissure_{name}_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}"

    def keep(self, name: str, make: Callable[[], DataFrame], by: list[str], order: list[str] | None = None) -> DataFrame:
        """The rows of a stage: read where an earlier run finished it, else made and written, bucketed by some columns and in an order within."""
        table, manifest = self._table(name), self._manifest(name)
        place, files = self._path(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if manifest is None:
            files.delete(place, True)
            rows = make()
            rows.write.bucketBy(self.buckets, *by).sortBy(*(order or by)).option("path", place.toString()).saveAsTable(table)
            text = json.dumps({"made_from": self.made_from, "schema": json.loads(rows.schema.json()), "buckets": self.buckets, "by": by, "order": order or by})
            draft, _ = self._path(f"_{name}.json")
            out = files.create(draft, True)
            out.write(bytearray(text.encode()))
            out.close()
            files.rename(draft, self._path(f"{name}.json")[0])
            self.made.append(name)
            return self.spark.table(table)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(manifest["schema"]).fields)
        columns = lambda of: ", ".join(f"`{c}`" for c in of)
        where = str(PurePosixPath(place.toUri().getPath())) if not place.toUri().getScheme() else place.toString()
        self.spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({columns(manifest['by'])}) SORTED BY ({columns(manifest['order'])}) INTO {manifest['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)
