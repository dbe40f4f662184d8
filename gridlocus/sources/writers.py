"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the stored result columns, in order
RESULT_COLUMNS = """address state utility_type engine_provider engine_eia_id engine_confidence
    engine_match_method engine_is_deregulated engine_source engine_needs_review engine_alternatives
    engine_catalog_id engine_catalog_title engine_id_match_score engine_id_confident alt_catalog_ids
    tenant_raw tenant_normalized tenant_catalog_id tenant_catalog_title tenant_id_match_score
    comparison match_detail id_match""".split()


def result_rows(results: DataFrame) -> DataFrame:
    """The 24 stored columns; alternatives stay arrays of names and of ids."""
    df = results
    if "alternatives" in df.columns:
        df = df.withColumns({
            "engine_alternatives": F.transform("alternatives", lambda a: a["provider"]),
            "alt_catalog_ids": F.transform(F.filter("alternatives", lambda a: a["catalog_id"].isNotNull()), lambda a: a["catalog_id"].cast("string")),
        })
    missing = [c for c in RESULT_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*RESULT_COLUMNS)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by type.  Rows are not shuffled to the partition column:
    one type may hold most rows, and a writer task handles the few types it sees."""
    result_rows(results).write.mode(mode).partitionBy("utility_type").parquet(path)


def write_results_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat = result_rows(results)
    joined = {c: F.array_join(c, "|") for c in ("engine_alternatives", "alt_catalog_ids") if flat.schema[c].dataType.typeName() == "array"}
    flat.withColumns(joined).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def decision_log(candidates: DataFrame, primaries: DataFrame) -> DataFrame:
    """One record per (address, type): every candidate considered, the choice and why.
    A group holds one entry per source, so it is small by construction."""
    keys = ["address_id", "utility_type"]
    seen = candidates.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("source_ordinal", "source", "provider_name", "confidence", "match_method"))).alias("considered"))
    chosen = primaries.select(*keys, F.struct("provider_name", "confidence", "source", "match_method").alias("selected"), "needs_review")
    reason = F.when(F.col("selected").isNull(), "no candidate").when(F.col("needs_review"), "low confidence").otherwise("highest confidence")
    return seen.join(chosen, keys, "left").withColumn("reason", reason)


def write_decision_log(candidates: DataFrame, primaries: DataFrame, path: str, mode: str = "append") -> None:
    decision_log(candidates, primaries).write.mode(mode).json(path)


FLAT_COLUMNS = ["address", "lat", "lon", "geocode_confidence"]


def flat_results(wide: DataFrame) -> DataFrame:
    """Fourteen columns, one row per address; an absent type leaves blanks."""
    def field(t, f):
        return F.col(f"{t}.{f}").alias(f"{t}_{f}")

    def rounded(t):
        return F.bround(F.col(f"{t}.confidence"), 3).alias(f"{t}_confidence")

    return wide.select(
        *FLAT_COLUMNS,
        F.col("electric.provider_name").alias("electric_provider"), rounded("electric"),
        field("electric", "match_method").alias("electric_method"), F.col("electric.is_deregulated").alias("electric_deregulated"),
        F.col("gas.provider_name").alias("gas_provider"), rounded("gas"), F.col("gas.match_method").alias("gas_method"),
        F.col("water.provider_name").alias("water_provider"), rounded("water"), "lookup_time_ms")


def write_flat_results(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat_results(wide).write.mode(mode).option("header", True).csv(path)
