"""Keyed sources as numbered snapshots, so that a stream sees one version of all of them per micro-batch.

A version is a folder with one Parquet table per source and, written last, a list of them; only versions
with the list exist for readers.  The version a micro-batch is answered with is noted before the batch
runs and never changed, so a batch that is repeated after a failure gives the rows it gave before, also
when newer versions have appeared meanwhile."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession


class Places:
    """Small files in a folder that all executors reach, through the cluster's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def names(self) -> list[str]:
        place = self.path_of(self.folder)
        return sorted(f.getPath().getName() for f in self.system.listStatus(place)) if self.system.exists(place) else []

    def exists(self, *parts: str) -> bool:
        return self.system.exists(self.path_of(self.path(*parts)))

    def write_once(self, name: str, text: str) -> str:
        """What the file holds: the text, or what somebody wrote there before."""
        place = self.path_of(self.path(name))
        if not self.system.exists(place):
            draft = self.path_of(self.path(f".{name}-draft"))
            out = self.system.create(draft, True)
            out.write(bytearray(text.encode()))
            out.close()
            self.system.rename(draft, place)
        return self.read(name)

    def read(self, name: str) -> str:
        lines = self.spark.read.text(self.path(name)).collect()  # one short line
        return lines[0].value if lines else ""


class Snapshots:
    """Versions of a dataclass whose fields are DataFrames or None."""

    def __init__(self, spark: SparkSession, folder: str, kind: type):
        self.spark, self.kind, self.places = spark, kind, Places(spark, folder)

    def publish(self, sources) -> int:
        """Write the sources as the next version."""
        number = max(self.versions(), default=-1) + 1
        names = [f.name for f in fields(self.kind) if getattr(sources, f.name) is not None]
        for name in names:
            getattr(sources, name).write.mode("overwrite").parquet(self.places.path(f"version-{number:09d}", name))
        self.places.write_once(f"version-{number:09d}.sources", ",".join(names))
        return number

    def versions(self) -> list[int]:
        return [int(n.removeprefix("version-").removesuffix(".sources")) for n in self.places.names() if n.startswith("version-") and n.endswith(".sources")]

    def read(self, number: int):
        names = self.places.read(f"version-{number:09d}.sources").split(",")
        return self.kind(**{f.name: self.spark.read.parquet(self.places.path(f"version-{number:09d}", f.name)) if f.name in names else None for f in fields(self.kind)})

    def version_of(self, batch: int) -> int:
        """The version of a micro-batch: the newest when it first ran."""
        return int(self.places.write_once(f"batch-{batch:09d}.version", str(max(self.versions()))))


def lookup_stream(addresses: DataFrame, snapshots: Snapshots, lookup: Callable[[DataFrame, object], DataFrame], folder: str, progress: str):
    """Writer that answers every micro-batch with one version of the sources, into a folder of the batch's own, which a
    repeated batch replaces.  ``answers`` reads them."""

    def run(batch: DataFrame, number: int) -> None:
        version = snapshots.version_of(number)
        lookup(batch, snapshots.read(version)).write.mode("overwrite").parquet(os.path.join(folder, f"batch={number}"))

    return addresses.writeStream.option("checkpointLocation", progress).foreachBatch(run)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of all batches; answers of batches without rows have the same columns."""
    return spark.read.option("basePath", folder).parquet(os.path.join(folder, "batch=*")).drop("batch")
