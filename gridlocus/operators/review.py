"""The human review loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions.address import extract_zip


def build_review_rows(results: DataFrame) -> DataFrame:
    """The nineteen review columns.  An alternative is shown with its own id.

    ``results``: address, state, utility_type, engine_*, tenant_raw, comparison,
    alternatives ARRAY<STRUCT<provider, catalog_id, …>>.
    """
    shown = F.array_join(F.transform("alternatives", lambda a: F.concat(
        a["provider"], F.coalesce(F.concat(F.lit(" (ID:"), a["catalog_id"].cast("string"), F.lit(")")), F.lit("")))), " | ")
    blank = lambda n: F.lit("").alias(n)
    return results.select(
        F.col("address").alias("Address"), F.col("state").alias("State"),
        F.coalesce(extract_zip("address"), F.lit("")).alias("ZIP"), F.col("utility_type").alias("Utility Type"),
        F.col("engine_provider").alias("Engine Provider"), F.col("engine_catalog_id").alias("Engine Provider ID"),
        F.col("engine_confidence").alias("Engine Confidence"), F.col("engine_source").alias("Engine Source"),
        F.col("engine_id_match_score").alias("ID Match Score"), F.col("engine_id_confident").alias("ID Confident"),
        F.col("tenant_raw").alias("Tenant Provider"), blank("Tenant Provider ID"), F.col("comparison").alias("Match Status"),
        F.coalesce(shown, F.lit("")).alias("Alternatives (with IDs)"),
        P.review_reason("comparison", F.coalesce("engine_needs_review", F.lit(False)), "engine_provider", "engine_catalog_id",
                        F.coalesce("engine_id_confident", F.lit(False))).alias("Review Reason"),
        blank("Mapper Decision"), blank("Mapper Corrected Provider"), blank("Mapper Corrected ID"), blank("Mapper Notes"),
    )


def review_order(status, state, utility_type) -> list:
    """Mismatches, then matches on an alternative, then the rest; state; type."""
    place = F.when(F.col(status) == "MISMATCH", 0).when(F.col(status) == "MATCH_ALT", 1).otherwise(2)
    return [place, F.col(state), F.col(utility_type)]


def build_review_queue(results: DataFrame) -> DataFrame:
    due = results.where(P.needs_review_queue("comparison", "engine_confidence", "tenant_raw", "engine_provider", "engine_catalog_id"))
    return build_review_rows(due).orderBy(*review_order("Match Status", "State", "Utility Type"), "Address")


def import_corrections(queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(address corrections, id corrections, counts) from reviewed rows."""
    def t(c):
        return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))

    decision = t("Mapper Decision")
    alternative, manual = decision == "Wrong - Use Alternative", decision == "Wrong - Manual Entry"
    named = F.nullif(t("Mapper Corrected Provider"), F.lit(""))
    corrected = F.when(alternative, F.coalesce(named, F.nullif(t("Tenant Provider"), F.lit("")))).when(manual, named)
    df = queue.select(
        t("Address").alias("address"), t("ZIP").alias("zip_code"), t("State").alias("state"), F.lower(t("Utility Type")).alias("utility_type"),
        corrected.alias("corrected_provider"), F.expr("try_cast(trim(`Mapper Corrected ID`) AS BIGINT)").alias("corrected_catalog_id"),
        t("Engine Provider").alias("original_provider"), t("Engine Source").alias("original_source"), t("Mapper Notes").alias("notes"),
        manual.alias("manual"), decision.isin("", "Correct", "Skip").alias("skipped"),
    )
    addresses = df.where("corrected_provider IS NOT NULL").drop("manual", "skipped")
    ids = df.where("manual AND corrected_provider IS NOT NULL AND corrected_catalog_id IS NOT NULL AND corrected_catalog_id <> 0 AND original_provider <> ''").select(
        F.col("original_provider").alias("engine_provider_name"), "utility_type", F.col("corrected_catalog_id").alias("correct_catalog_id"))
    known = F.col("corrected_provider").isNotNull()
    counts = df.agg(
        F.count_if(known).alias("address_corrections"),
        F.count_if(F.col("manual") & known & (F.coalesce("corrected_catalog_id", F.lit(0)) != 0) & (F.col("original_provider") != "")).alias("id_corrections"),
        F.count_if(F.col("skipped") | (decision_known(df) & ~known)).alias("skipped"),
    )
    return addresses, ids, counts


def decision_known(df: DataFrame):
    return ~F.col("skipped")


def queue_for_picks(results: DataFrame, min_confidence: float = 0.80) -> DataFrame:
    """Rows an external picker should look at."""
    disagree = F.coalesce(F.col("comparison").isin("MISMATCH", "MATCH_ALT"), F.lit(False))
    return results.where(
        F.col("engine_provider").isNotNull() & F.col("engine_confidence").isNotNull() & ((F.col("engine_confidence") < min_confidence) | disagree))


def pick_queue_counts(results: DataFrame, min_confidence: float = 0.80) -> DataFrame:
    return queue_for_picks(results, min_confidence).groupBy("utility_type", "comparison").agg(F.count("*").alias("n"))


def pick_matches_tenant(pick, tenant):
    p, t = F.upper(pick), F.upper(F.coalesce(tenant, F.lit("")))
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: F.length(w) > 3)
    hit = t.contains(p) | p.contains(t) | F.exists(words, lambda w: p.contains(w))
    return F.coalesce((p != "") & (p != "NONE") & hit, F.lit(False))


def score_picks(picks: DataFrame) -> DataFrame:
    """How often each of two pickers agrees with the tenant.  ``picks``: tenant_raw,
    pick_a, pick_b."""
    a, b = pick_matches_tenant(F.col("pick_a"), F.col("tenant_raw")), pick_matches_tenant(F.col("pick_b"), F.col("tenant_raw"))
    return picks.select(a.alias("a"), b.alias("b")).agg(
        F.count("*").alias("total"), F.count_if("a").alias("a_correct"), F.count_if("b").alias("b_correct"),
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
        F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"),
    )
