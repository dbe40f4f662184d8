"""Re-tests: what a changed lookup does to the answers that were wrong.

Only rows that mismatched go through the lookup and the comparison again, each address once; old and new
answers come back side by side as a change set, from which outcomes and fix rates are counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.operators.compare import CORRECT
from gridlocus.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


def change_set(rows: DataFrame, addresses: DataFrame, lookup: Step, compare: Step) -> DataFrame:
    """One row per row: row_id, address_id, utility_type, state, tenant_raw, old_provider, new_provider, source, comparison,
    outcome (fixed | still_mismatch | no_coords).

    ``rows``: row_id, address_id, utility_type, state, tenant_raw, engine_provider.  ``lookup`` takes addresses and gives one
    answer per (address_id, utility_type); ``compare`` adds ``comparison`` to rows with engine_provider and alternatives.
    An address without coordinates is not asked again; a type without an answer is compared as a missing answer."""
    rows = cut_lineage(rows.select("row_id", "address_id", "utility_type", "state", "tenant_raw", F.col("engine_provider").alias("old_provider")))
    located = addresses.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    asked = cut_lineage(located.join(rows.select("address_id").distinct(), "address_id", "left_semi"))
    answers = lookup(asked).select("address_id", "utility_type", F.col("provider_name").alias("new_provider"), "source")
    again = rows.join(asked.select("address_id", F.lit(True).alias("_asked")), "address_id", "left").join(answers, ["address_id", "utility_type"], "left")
    again = cut_lineage(again)
    none = F.array().cast("array<struct<provider:string>>")
    due = again.where("_asked").select("row_id", "utility_type", "state", "tenant_raw", F.col("new_provider").alias("engine_provider"), none.alias("alternatives"))
    verdicts = compare(due).select("row_id", "comparison")
    outcome = F.when(F.col("_asked").isNull(), "no_coords").when(F.col("comparison").isin(CORRECT), "fixed").otherwise("still_mismatch")
    return again.join(verdicts, "row_id", "left").withColumn("outcome", outcome).drop("_asked")


def outcome_counts(changes: DataFrame) -> DataFrame:
    """Per type, state and source of the new answer: rows by outcome."""
    return changes.groupBy("utility_type", "state", F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("fixed", "still_mismatch", "no_coords")])
