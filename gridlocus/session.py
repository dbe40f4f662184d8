"""Session settings and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Join strategy is left to the planner: a side is broadcast only when its measured
# size is below the bound; anything larger falls back to a shuffled join with skew
# splitting.  An estimate is made from file sizes and knows neither compression nor
# exploded arrays (it took 500 MB of cells for less than 32), so it decides
# only for tables of a few rows.
BROADCAST_BOUND = "8MB"
ESTIMATED_BOUND = "16KB"

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose output is not already hash-placed for the next operator may be
    # split even if that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": ESTIMATED_BOUND,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_BOUND,
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.caseSensitive": "false",
    # State of streams lives on disk beside the executors and is saved as changes only; timers need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "gridlocus", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime-settable engine options on a session somebody else built."""
    for key, value in ENGINE_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input although its files are small (exploded, or well compressed).  The join is a
    shuffled merge whatever bound for broadcasts the session has when the rows are asked for: it need not be ours any more."""
    return side.hint("shuffle_merge")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own is set only in local
    mode where the session names none (tests)."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[.*\])?$", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        shared = os.path.join(tempfile.mkdtemp(prefix="gridlocus-"), "checkpoints")
        context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder as Parquet and read back: an iterative plan, or one whose
    part is used many times, stays short, knows its real size, reads only the columns it names and survives
    the loss of an executor."""
    spark = df.sparkSession
    folder = os.path.join(shared_root(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
