"""Output shapes built from the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_AVAILABLE = "NOT AVAILABLE"  # fixed value


def confidence_label(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.85, "verified").when(c >= 0.70, "high").when(c >= 0.50, "medium").otherwise("low")


def v1_projection(answers: DataFrame, utilities: Column | str = "electric,gas,water,sewer,internet") -> DataFrame:
    """Older answer shape, for the utilities listed.  ``answers``: one row per
    (address_id, utility_type) with provider_name, phone, website, confidence, source,
    is_deregulated, deregulated_note, alternatives."""
    asked = F.transform(F.split(F.lit(utilities) if isinstance(utilities, str) else utilities, ","), lambda u: F.lower(F.trim(u)))
    offered = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NOT_AVAILABLE))
    choice = F.coalesce("is_deregulated", F.lit(False))
    conf = F.coalesce("confidence", F.lit(0.0))
    return answers.where(F.array_contains(asked, F.col("utility_type"))).select(
        "address_id", "utility_type", F.col("provider_name").alias("name"), offered("phone").alias("phone"), offered("website").alias("website"),
        F.bround(conf * 100, 0).cast("int").alias("confidence_score"), confidence_label(conf).alias("confidence"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.struct(choice.alias("has_choice"), F.when(choice, F.coalesce("deregulated_note", F.lit(""))).otherwise("").alias("message"),
                 F.lit("").alias("choice_website")).alias("deregulated"),
        F.transform("alternatives", lambda a: F.struct(
            a["provider"].alias("name"), F.lit(NOT_AVAILABLE).alias("phone"), F.lit(NOT_AVAILABLE).alias("website"),
            F.coalesce(a["confidence"], F.lit(0.5)).alias("confidence"), F.lit(False).alias("is_propane"))).alias("other_providers"),
    )


def contact_projection(answers: DataFrame) -> DataFrame:
    """Name, phone and website per answer."""
    return answers.select(
        "address_id", "utility_type",
        F.struct(F.col("provider_name").alias("name"), F.coalesce("phone", F.lit("")).alias("phone"),
                 F.coalesce("website", F.lit("")).alias("website")).alias("contact"))


def internet_projection(blocks: DataFrame, n: int = 5) -> DataFrame:
    """First providers of an ordered broadband list (the shape shows five)."""
    return blocks.withColumn("internet", F.transform(F.slice("internet_providers", 1, n), lambda p: F.struct(
        p["name"].alias("name"), p["technology"].alias("technology"),
        p["max_down"].alias("max_download_mbps"), p["max_up"].alias("max_upload_mbps"))))
