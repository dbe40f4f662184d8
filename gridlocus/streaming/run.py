"""Run a stream over the data available now and hand back what it wrote."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's checkpoint folder; a temporary one only in
    local mode when the session names none."""
    return os.path.join(shared_root(spark), f"stream-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The Parquet data at a path as a stream; files are taken in bounded numbers."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if name.endswith(".parquet") and os.path.isfile(path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


#: Rows of one input file of a stream: what a task of a micro-batch holds is bounded by it.
ROWS_PER_FILE = 100_000


def write_arrivals(rows: DataFrame, arrival: Column, batches: int, files: int = 4) -> str:
    """Write rows as the input of a stream: batch number ``arrival`` (0, 1, ...) of a row is the micro-batch it comes with.

    All batches have the same number of files, ``files`` or as many more as the largest batch needs."""
    folder = os.path.join(shared_folder(rows.sparkSession), "arrivals")
    largest = rows.where(arrival.between(0, batches - 1)).groupBy(arrival.alias("arrival")).count().agg(F.max("count")).first()[0]
    files = max(files, -(-(largest or 0) // ROWS_PER_FILE))
    for i in range(batches):
        rows.where(arrival == i).repartition(files).write.parquet(os.path.join(folder, f"batch-{i:06d}"))
    return folder


def arrivals(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The stream of rows written by ``write_arrivals``, a batch of it at a time unless ``files`` says otherwise."""
    written = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if files is None:
        files = max(Counter(os.path.dirname(f) for f in written.inputFiles()).values())
    return spark.readStream.schema(written.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def drain(stream: DataFrame) -> DataFrame:
    """Process everything available now into Parquet (append mode) and read it back."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = os.path.join(folder, "table")
    writer = stream.writeStream.option("checkpointLocation", os.path.join(folder, "progress")).trigger(availableNow=True)
    writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Upserts:
    """A table of the last row per key, fed by the updates of a stream.

    Batch n writes its updates to a folder of its own, so a batch that is repeated replaces itself; the
    table is the row of the latest batch per key.  ``compact`` writes the table as it stands after a batch to a base,
    which readers use in place of the batches up to it."""

    def __init__(self, spark: SparkSession, schema, keys: list[str], folder: str | None = None):
        self.spark, self.schema, self.keys = spark, schema, keys
        self.folder = folder or os.path.join(shared_folder(spark), "upserts")

    def _folder(self, kind: str, batch: int) -> str:
        return os.path.join(self.folder, f"{kind}={batch:09d}")

    def _numbers(self, kind: str) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        done = [n for n in names if n.startswith(f"{kind}=") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, n, "_SUCCESS")))]
        return sorted(int(n.split("=")[1]) for n in done)

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder("batch", batch))

    def table(self) -> DataFrame:
        base, batches = self._numbers("base")[-1:], self._numbers("batch")
        later = [b for b in batches if not base or b > base[0]]
        parts = [(self._folder("base", b), b) for b in base] + [(self._folder("batch", b), b) for b in later]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        read = [self.spark.read.schema(self.schema).parquet(path).withColumn("_batch", F.lit(n)) for path, n in parts]
        rows = reduce(DataFrame.unionByName, read)
        others = [c for c in rows.columns if c not in self.keys and c != "_batch"]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return latest.select(*[F.col(k) if k in self.keys else F.col(f"_row.{k}") for k in [c for c in rows.columns if c != "_batch"]])

    def compact(self) -> None:
        if batches := self._numbers("batch"):
            self.table().write.mode("overwrite").parquet(self._folder("base", batches[-1]))


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything available now in update mode: only changed rows leave the state, which the watermark may evict."""
    spark = stream.sparkSession
    upserts = Upserts(spark, stream.schema, keys)
    writer = stream.writeStream.option("checkpointLocation", os.path.join(shared_folder(spark), "progress")).trigger(availableNow=True)
    writer.outputMode("update").foreachBatch(upserts.put).start().awaitTermination()
    return upserts.table()


def drain_batches(stream: DataFrame, transform, schema: str) -> DataFrame:
    """Like ``drain`` for a per-batch transformation; each batch owns a folder, so a
    repeated batch replaces itself."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = os.path.join(folder, "table")

    def write(df: DataFrame, epoch: int) -> None:
        transform(df).write.mode("overwrite").parquet(os.path.join(out, f"batch={epoch}"))

    query = stream.writeStream.option("checkpointLocation", os.path.join(folder, "progress")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(os.path.join(out, "*")).drop("batch")
