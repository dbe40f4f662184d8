"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlocus.streaming.run import shared_folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """The rows written once as Parquet to the shared folder and read back: later plans are
    short, know the real size, read only the columns they name and survive lost executors."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Whole texts go to Python in batches of so many rows; the default of 10,000 holds tens of MB more per worker.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
