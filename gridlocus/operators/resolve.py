"""From candidates to one ranked answer per (address, utility type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules, text
from gridlocus.operators import lookups
from gridlocus.operators.catalog import match_catalog
from gridlocus.operators.names import resolve_names

# fixed values: confidence by match method, and the general cap
BASE_CONFIDENCE = {"eia_id": 0.90, "exact": 0.85, "fuzzy": 0.75, "substring": 0.75, "passthrough": 0.60}
WATER_CONFIDENCE = 0.82
MAX_CONFIDENCE = 0.98
GROUP = ["address_id", "utility_type"]


def collect_candidates(branches: list[DataFrame]) -> DataFrame:
    """Union of the sources; a source's place in the list is its ordinal."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [b.withColumn("source_ordinal", F.lit(i)) for i, b in enumerate(branches)],
    )


def _round3(c: Column) -> Column:
    return F.round(c, 3)


def resolve_candidates(
    candidates: DataFrame, aliases: DataFrame, reps: DataFrame | None, states: DataFrame,
    eia_index: DataFrame, min_score: float | None = 85.0,
) -> DataFrame:
    """Raw names to display names with a confidence.

    ``candidates``: address_id, utility_type, raw_name, source, source_ordinal,
    candidate_state and optionally eia_id, cntrl_area, territory_type,
    max_confidence, set_confidence.  ``eia_index``: eia_id, canonical_id,
    display_name.  ``states``: canonical_id, states.
    """
    kinds = {"eia_id": "string", "cntrl_area": "string", "territory_type": "string",
             "max_confidence": "double", "set_confidence": "double"}
    df = candidates
    for column, kind in kinds.items():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(kind))
    water = F.col("utility_type") == "water"
    df = df.withColumn("_eia", F.split_part(F.col("eia_id").cast("string"), F.lit("."), F.lit(1)).try_cast("int"))
    by_id = eia_index.select(F.col("eia_id").alias("_eia"), F.struct("canonical_id", "display_name").alias("_by_id"))
    df = df.join(by_id, "_eia", "left")
    names = df.where(~water & F.col("_by_id").isNull()).select(F.col("raw_name").alias("name")).where("name IS NOT NULL").distinct()
    matches = resolve_names(names, aliases, reps, "name", min_score).join(
        states, "canonical_id", "left"
    ).join(
        eia_index.groupBy("canonical_id").agg(F.min("eia_id").alias("matched_eia_id")), "canonical_id", "left"
    ).select(F.col("name").alias("raw_name"), F.struct(
        "canonical_id", "display_name", "matched", "match_type", "similarity", "states", "matched_eia_id").alias("_m"))
    df = df.join(matches, "raw_name", "left")
    m = F.col("_m")
    state = F.upper(F.trim(F.coalesce("candidate_state", F.lit(""))))
    fuzzy_ok = (m["similarity"] >= 95) | ((m["similarity"] >= 90) & ((state == "") | F.coalesce(F.array_contains(m["states"], state), F.lit(False))))
    named = F.coalesce(m["matched"] & ((m["match_type"] != "fuzzy") | fuzzy_ok), F.lit(False))
    method = F.when(water, "passthrough").when(F.col("_by_id").isNotNull(), "eia_id").when(named, m["match_type"]).otherwise("passthrough")
    base = F.create_map(*[F.lit(v) for pair in BASE_CONFIDENCE.items() for v in pair])[F.col("match_method")]
    df = df.withColumn("match_method", method)
    df = df.withColumn("confidence", F.least(F.when(water, WATER_CONFIDENCE).otherwise(base), F.lit(MAX_CONFIDENCE)))
    df = df.withColumn("confidence", F.coalesce("set_confidence", F.least("confidence", "max_confidence")))
    df = df.withColumn("confidence", F.when(F.col("source").startswith("state_gis"), F.greatest("confidence", F.lit(0.90))).otherwise(F.col("confidence")))
    by_name = (F.col("match_method") != "passthrough") & (F.col("match_method") != "eia_id")
    return df.select(
        *GROUP, "source_ordinal",
        F.when(F.col("match_method") == "eia_id", F.col("_by_id.display_name")).when(by_name, m["display_name"])
        .otherwise(text.clean_passthrough("raw_name")).alias("provider_name"),
        F.when(F.col("match_method") == "eia_id", F.col("_by_id.canonical_id")).when(by_name, m["canonical_id"]).alias("canonical_id"),
        F.when(F.col("match_method") == "eia_id", F.col("_eia")).when(by_name, m["matched_eia_id"]).alias("eia_id"),
        "confidence", "match_method", "source",
        F.when(water, False).otherwise(P.is_deregulated("raw_name", "cntrl_area", "territory_type")).alias("is_deregulated"),
        F.when(~water & P.is_deregulated("raw_name", "cntrl_area", "territory_type"), text.deregulated_note("raw_name")).alias("deregulated_note"),
    ).where("provider_name <> ''")


def water_name_guard(state_answers: DataFrame) -> DataFrame:
    """State water answers that are not utility names become the city's, or go."""
    water = (F.col("utility_type") == "water") & ~P.is_water_utility_name("name")
    has_city = F.col("city").isNotNull() & (F.col("city") != "")
    return state_answers.where(~water | has_city).withColumn(
        "name", F.when(water, F.concat(F.lit("City of "), F.col("city"))).otherwise(F.col("name"))
    )


def dedupe_and_boost(candidates: DataFrame, aliases: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """One candidate per provider; agreement of several raises its confidence.

    Providers are the same when their display names share a dictionary id, or are
    equal without case.  The most confident stays, the earliest on a tie.
    """
    keys = keys or GROUP
    df = candidates.withColumn("_upper", F.upper(F.trim("provider_name")))
    if aliases is not None:
        table = aliases.select(F.col("alias_lower").alias("_lower"), F.upper("canonical_id").alias("_canon"))
        df = df.withColumn("_lower", F.lower(text.clean_name("provider_name"))).join(table, "_lower", "left").drop("_lower")
        df = df.withColumn("provider_key", F.coalesce("_canon", "_upper")).drop("_canon")
    else:
        df = df.withColumn("provider_key", F.col("_upper"))
    df = df.drop("_upper")
    record = [c for c in df.columns if c not in (*keys, "provider_key")]
    g = df.groupBy(*keys, "provider_key").agg(
        F.min_by(F.struct(*record), F.struct(-F.col("confidence"), F.col("source_ordinal"))).alias("_b"),
        F.min("source_ordinal").alias("first_ordinal"),
        F.count("*").alias("n_agree"),
        # more than one distinct source, without a distinct aggregate
        (F.min(F.coalesce("source", F.lit(""))) != F.max(F.coalesce("source", F.lit("")))).alias("_several"),
    ).select(*keys, "provider_key", "first_ordinal", "n_agree", "_several", "_b.*")
    n = F.col("n_agree")
    boosted = F.least(F.lit(MAX_CONFIDENCE), F.col("confidence") + F.least(F.lit(0.10), 0.05 * (n - 1)))
    return (
        g.withColumn("confidence", F.when(n > 1, boosted).otherwise(F.col("confidence")))
        .withColumn("source", F.when(
            (n > 1) & F.col("_several"),
            F.concat(F.coalesce("source", F.lit("")), F.lit(" (+"), (n - 1).cast("string"), F.lit(" agree)")),
        ).otherwise(F.col("source")))
        .drop("_several")
    )


def rank_candidates(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or GROUP
    order = "first_ordinal" if "first_ordinal" in candidates.columns else "source_ordinal"
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col(order), F.col("provider_name"))
    return candidates.withColumn("rank", F.row_number().over(w))


def demote_large_iou(ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Where a large investor-owned utility leads, the first local utility that is
    confident enough for the leader's source takes its place."""
    keys = keys or GROUP
    group = Window.partitionBy(*keys)
    leads = F.col("rank") == 1
    source = F.lower(F.coalesce("source", F.lit("")))
    needed = F.when(source.contains("eia_zip"), 0.55).when(source.contains("state_gis"), 0.70).otherwise(0.60)
    df = ranked.withColumn("_need", F.max(F.when(
        leads & (F.col("utility_type") == "electric") & P.is_large_iou("provider_name"), needed)).over(group))
    weak = source.contains("findenergy_city") | source.contains("state_gas_default")
    able = (~leads) & P.is_local_utility("provider_name") & (F.col("confidence") >= F.col("_need")) & ~weak
    df = df.withColumn("_promoted", F.min(F.when(able, F.col("rank"))).over(group))
    rank = (
        F.when(F.col("rank") == F.col("_promoted"), 1)
        .when(F.col("rank") < F.col("_promoted"), F.col("rank") + 1)
        .otherwise(F.col("rank"))
    )
    return df.withColumn("rank", rank.cast("int")).drop("_need", "_promoted")


NOT_VERIFIED_SOURCES = ["eia_zip", "correction_address", "correction_zip"]


def apply_eia_verification(ranked: DataFrame, zips: DataFrame, eia_zip: DataFrame) -> DataFrame:
    """Adjusts the electric leader by registry agreement and fills a missing id.

    ``zips``: address_id, zip_code.
    """
    due = ranked.where((F.col("rank") == 1) & (F.col("utility_type") == "electric") & ~F.col("source").isin(NOT_VERIFIED_SOURCES))
    due = due.select("address_id", "utility_type", "rank", "provider_name").join(zips, "address_id").where("zip_code IS NOT NULL")
    verdict = due.join(lookups.eia_verify(due, eia_zip), ["zip_code", "provider_name"]).select(
        *GROUP, "rank", "adjustment", "verified_eia_id"
    )
    return ranked.join(verdict, [*GROUP, "rank"], "left").withColumns({
        "confidence": F.when(
            F.col("adjustment").isNotNull(),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("adjustment"))),
        ).otherwise(F.col("confidence")),
        "eia_id": F.coalesce("eia_id", F.col("verified_eia_id").cast("int")),
    }).drop("adjustment", "verified_eia_id")


def primary_with_alternatives(ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rank 1, with ranks 2-5 of other names as alternatives.  Only the first five
    candidates of a group are brought together."""
    keys = keys or GROUP
    df = ranked.where("rank <= 5")
    primary = F.struct(*[c for c in df.columns if c not in (*keys, "rank")])
    alt = F.struct(
        F.col("rank").alias("rank"), F.col("provider_name").alias("provider"), _round3(F.col("confidence")).alias("confidence"),
        F.coalesce("source", F.lit("")).alias("source"), F.col("eia_id").cast("int").alias("eia_id"),
    )
    g = df.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, primary)).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, alt))).alias("_a"),
    ).select(*keys, "_p.*", "_a")
    lead = F.upper("provider_name")
    fresh = F.filter("_a", lambda a: F.upper(a["provider"]) != lead)
    distinct = F.filter(fresh, lambda a: ~F.exists(fresh, lambda b: (F.upper(b["provider"]) == F.upper(a["provider"])) & (b["rank"] < a["rank"])))
    return (
        g.withColumn("alternatives", F.transform(distinct, lambda a: F.struct(
            a["provider"].alias("provider"), a["confidence"].alias("confidence"), a["source"].alias("source"), a["eia_id"].alias("eia_id"))))
        .withColumn("needs_review", P.needs_review_flag("confidence"))
        .drop("_a")
    )


# ---- sewer -------------------------------------------------------------------
def sewer_resolution(addresses: DataFrame, water: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Sewer from the water provider, the city, the county; else the water name.

    ``water``: address_id, provider_name, confidence.  Name variants are matched once
    per distinct (variant, state).
    """
    base = addresses.select("address_id", F.coalesce("state", F.lit("")).alias("state"), "city", "county").join(
        water.select("address_id", F.col("provider_name").alias("water_name"), F.col("confidence").alias("water_confidence")), "address_id", "left"
    )
    from gridlocus.functions.address import county_clean

    city, county = F.col("city"), county_clean("county")
    has_city, has_county = F.coalesce(city != "", F.lit(False)), F.coalesce(county != "", F.lit(False))

    def variant(step, pos, name):
        return F.struct(F.lit(step).alias("step"), F.lit(pos).alias("pos"), name.alias("name"))

    none = F.array().cast("array<struct<step:int,pos:int,name:string>>")
    variants = F.concat(
        F.when(F.col("water_name").isNotNull(), F.array(variant(1, 0, F.col("water_name")))).otherwise(none),
        F.when(has_city, F.array(*[variant(2, i, n) for i, n in enumerate([
            F.concat(F.lit("City of "), city), F.concat(city, F.lit(" Sewer")), F.concat(city, F.lit(" Utilities")),
            F.concat(city, F.lit(" Public Works")), city])])).otherwise(none),
        F.when(has_county, F.array(*[variant(3, i, n) for i, n in enumerate([
            F.concat(county, F.lit(" County Sanitary")), F.concat(county, F.lit(" Sanitary")), county])])).otherwise(none),
    )
    rows = base.select("address_id", "state", "water_confidence", F.inline(variants))
    asked = rows.select("name", F.lit("sewer").alias("utility_type"), "state").distinct()
    ids = match_catalog(asked, catalog, overrides, fuzzy).drop("utility_type")
    floor = F.when(F.col("step") == 1, 80).when(F.col("step") == 2, 75).otherwise(70)
    best = rows.join(ids, ["name", "state"]).where(F.col("id_match_score") >= floor).groupBy("address_id", "step").agg(
        F.min_by(F.struct("catalog_title", "catalog_id", "id_match_score", "water_confidence"), F.col("pos")).alias("b")
    ).select("address_id", "step", "b.*")
    found = best.select(
        "address_id", F.col("catalog_title").alias("provider_name"),
        F.when(F.col("step") == 1, F.least(F.col("water_confidence") + 0.05, F.lit(0.88))).when(F.col("step") == 2, 0.82).otherwise(0.75).alias("confidence"),
        F.when(F.col("step") == 1, "water_inheritance").when(F.col("step") == 2, "sewer_city_match").otherwise("sewer_county_match").alias("source"),
        "catalog_id", F.col("step").alias("source_ordinal"),
    )
    fallback = base.where("water_name IS NOT NULL").join(found.select("address_id"), "address_id", "left_anti").select(
        "address_id", F.col("water_name").alias("provider_name"), F.lit(0.50).alias("confidence"),
        F.lit("water_fallback_no_sewer_id").alias("source"), F.lit(None).cast("bigint").alias("catalog_id"), F.lit(4).alias("source_ordinal"),
    )
    candidates = found.unionByName(fallback).withColumn("utility_type", F.lit("sewer")).withColumn("eia_id", F.lit(None).cast("int"))
    return primary_with_alternatives(rank_candidates(dedupe_and_boost(candidates)))


# ---- other adjustments -------------------------------------------------------
def boost_with_tenant(confidence: Column, method: Column) -> tuple[Column, Column]:
    return F.least(F.lit(0.98), confidence + 0.08), F.concat(F.lit("tenant_verified+"), method)


def broadband_summary(blocks: DataFrame, providers: str = "providers") -> DataFrame:
    """Providers ordered by technology then speed, and the block's headline numbers.

    ``providers``: ARRAY<STRUCT<name, tech, down, up, low_lat>>.
    """
    labels = F.create_map(*[F.lit(v) for pair in rules.TECH_LABELS.items() for v in pair])
    order = F.array(*[F.lit(t) for t in rules.TECH_ORDER])
    code = lambda p: F.coalesce(p["tech"].cast("string"), F.lit("0"))
    place = lambda p: F.coalesce(F.nullif(F.array_position(order, code(p)), F.lit(0)), F.lit(100))
    ranked = F.array_sort(F.transform(providers, lambda p, i: F.struct(
        place(p).alias("place"), (-F.coalesce(p["down"], F.lit(0))).alias("slow"), i.alias("i"),
        F.struct(
            F.coalesce(p["name"], F.lit("")).alias("name"),
            F.coalesce(F.try_element_at(labels, code(p)), F.concat(F.lit("Unknown ("), code(p), F.lit(")"))).alias("technology"),
            code(p).alias("tech_code"), F.coalesce(p["down"], F.lit(0)).alias("max_down"), F.coalesce(p["up"], F.lit(0)).alias("max_up"),
            (F.coalesce(p["low_lat"].cast("int"), F.lit(0)) != 0).alias("low_latency"),
        ).alias("p"),
    )))
    df = blocks.withColumn("_sorted", F.transform(ranked, lambda s: s["p"]))
    return df.withColumns({
        "internet_providers": F.col("_sorted"),
        "provider_count": F.size(F.array_distinct(F.transform("_sorted", lambda p: p["name"]))),
        "has_fiber": F.exists("_sorted", lambda p: p["tech_code"] == "50"),
        "has_cable": F.exists("_sorted", lambda p: p["tech_code"] == "40"),
        "max_download_speed": F.coalesce(F.array_max(F.transform("_sorted", lambda p: p["max_down"])), F.lit(0)),
        "source": F.lit("fcc_bdc"),
        "confidence": F.lit(0.95),
    }).drop("_sorted", providers)


# ---- picks -------------------------------------------------------------------
PICK_SCHEMA = "array<struct<provider:string,confidence:double,source:string>>"


def build_pick_candidates(results: DataFrame, mode: str = "batch") -> DataFrame:
    """Numbered choices for rows that need a pick; at least two per row.

    ``results``: row_id, utility_type, provider_name, confidence, source,
    needs_review, comparison, tenant_raw, alternatives.
    """
    primary = F.array(F.struct(F.col("provider_name").alias("provider"), F.col("confidence").alias("confidence"), F.coalesce("source", F.lit("")).alias("source")))
    if mode == "api":
        due = results.where("needs_review AND size(alternatives) > 0")
        options = F.concat(primary.cast(PICK_SCHEMA), F.transform("alternatives", lambda a: F.struct(
            a["provider"].alias("provider"), F.coalesce(a["confidence"], F.lit(0.5)).alias("confidence"),
            F.coalesce(a["source"], F.lit("alternative")).alias("source"))).cast(PICK_SCHEMA))
    else:
        disagree = F.coalesce(F.col("comparison").isin("MISMATCH", "MATCH_ALT"), F.lit(False))
        due = results.where(disagree | ((F.col("confidence") < 0.80) & (F.size("alternatives") > 0)))
        alts = F.transform(F.filter("alternatives", lambda a: a["provider"] != ""), lambda a: F.struct(
            a["provider"].alias("provider"), F.lit(0.5).alias("confidence"), F.lit("alternative").alias("source")))
        tenant = F.when(disagree & (F.trim(F.coalesce("tenant_raw", F.lit(""))) != ""), F.array(F.struct(
            F.trim("tenant_raw").alias("provider"), F.lit(0.6).alias("confidence"), F.lit("tenant_reported").alias("source")))).otherwise(F.array())
        options = F.concat(primary.cast(PICK_SCHEMA), alts.cast(PICK_SCHEMA), tenant.cast(PICK_SCHEMA))
    return (
        due.where("provider_name IS NOT NULL").withColumn("candidates", options).where("size(candidates) >= 2")
        .select("row_id", "utility_type", "candidates", F.posexplode("candidates").alias("_p", "candidate"))
        .select("row_id", "utility_type", (F.col("_p") + 1).alias("number"), "candidate.*", F.size("candidates").alias("n_candidates"))
    )


def apply_picks(results: DataFrame, candidates: DataFrame, picks: DataFrame, allow_alternative: bool = False, guard: bool = True) -> DataFrame:
    """Replace the leader by the picked candidate, unless that would overrule a
    protected source.  ``picks``: row_id, utility_type, pick (1-based), confidence."""
    chosen = picks.where("pick IS NOT NULL").select(
        "row_id", "utility_type", F.col("pick").alias("number"), F.col("confidence").alias("pick_confidence")
    ).join(
        candidates.select("row_id", "utility_type", "number", F.col("provider").alias("picked"), F.col("confidence").alias("candidate_confidence"), F.col("source").alias("candidate_source")),
        ["row_id", "utility_type", "number"],
    ).drop("number")
    df = results.join(chosen, ["row_id", "utility_type"], "left")
    overrules = (F.col("picked") != F.col("provider_name")) & P.is_protected_source("source")
    if allow_alternative:
        p = F.lower("picked")
        listed = F.exists("alternatives", lambda a: (F.length(a["provider"]) >= 4) & (F.length(p) >= 4) & (
            F.lower(a["provider"]).contains(p) | p.contains(F.lower(a["provider"]))))
        overrules = overrules & ~F.coalesce(listed, F.lit(False))
    use = F.col("picked").isNotNull() & (~overrules if guard else F.lit(True))
    confidence = F.least(F.lit(0.90), F.greatest("candidate_confidence", "pick_confidence"))
    return df.withColumn("pick_applied", F.coalesce(use, F.lit(False))).withColumns({
        "provider_name": F.when(F.col("pick_applied"), F.col("picked")).otherwise(F.col("provider_name")),
        "source": F.when(F.col("pick_applied"), F.concat(F.lit("ai_resolver (was: "), F.col("candidate_source"), F.lit(")"))).otherwise(F.col("source")),
        "needs_review": F.when(F.col("pick_applied"), confidence < 0.80).otherwise(F.col("needs_review")),
        "confidence": F.when(F.col("pick_applied"), confidence).otherwise(F.col("confidence")),
    }).drop("picked", "candidate_confidence", "candidate_source", "pick_confidence")
