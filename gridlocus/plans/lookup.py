"""The lookup: addresses in, one ranked answer per (address, utility type) out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.functions.address import blank_to_null, extract_city, extract_state, extract_zip
from gridlocus.operators import lookups as L
from gridlocus.operators import resolve as V
from gridlocus.operators import spatial as S
from gridlocus.operators.catalog import attach_catalog_ids
from gridlocus.session import cut_lineage


@dataclass
class Sources:
    """Flattened inputs.  A source that is None is not part of the plan."""

    aliases: DataFrame
    states: DataFrame
    eia_index: DataFrame
    reps: DataFrame | None = None
    territories: DataFrame | None = None       # prepared: rings, bbox, layer, attributes
    address_corrections: DataFrame | None = None
    zip_corrections: DataFrame | None = None
    state_config: DataFrame | None = None
    state_regions: DataFrame | None = None
    state_features: DataFrame | None = None
    gas_mapping: DataFrame | None = None
    county_emc: DataFrame | None = None
    county_gas: DataFrame | None = None
    live_layer: DataFrame | None = None        # address_id, live_pos, live_name, live_state, telephone, live_website
    zip_dominance: DataFrame | None = None
    special_districts: DataFrame | None = None
    eia_zip: DataFrame | None = None
    city_cache: DataFrame | None = None
    state_defaults: DataFrame | None = None
    catalog: DataFrame | None = None           # prepared
    catalog_overrides: DataFrame | None = None
    contacts: DataFrame | None = None
    broadband: DataFrame | None = None         # block_geoid, providers


def fill_address_parts(addresses: DataFrame) -> DataFrame:
    """City, state and ZIP from the geocoder, else from the text."""
    have = set(addresses.columns)
    given = lambda c: blank_to_null(c) if c in have else F.lit(None).cast("string")
    return addresses.withColumns({
        "state": F.coalesce(given("state"), extract_state("address")),
        "zip_code": F.coalesce(given("zip_code"), extract_zip("address")),
        "city": F.coalesce(given("city"), extract_city("address")),
        "county": given("county"),
        "block_geoid": given("block_geoid"),
    })


def territory_candidates(addresses: DataFrame, territories: DataFrame, utility_type: str, base: float) -> DataFrame:
    points = addresses.where("lat IS NOT NULL AND NOT (lat = 0 AND lon = 0)").select(
        F.col("address_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("state").alias("address_state"))
    hits = S.point_in_territory(points, territories.where(F.col("layer") == utility_type).drop("layer"), base).drop("x", "y")
    if utility_type == "electric":
        best = S.resolve_electric(hits.drop("address_state"))
    elif utility_type == "gas":
        best = S.resolve_gas(hits)
    else:
        best = S.resolve_water(hits.drop("address_state"))
    tags = {  # fixed values
        "electric": "HIFLD Electric Retail Service Territories",
        "gas": "HIFLD Natural Gas Service Territories",
        "water": "EPA CWS Boundaries",
    }
    return best.select(
        F.col("point_id").alias("address_id"), F.lit(utility_type).alias("utility_type"), F.col("name").alias("raw_name"),
        F.lit(tags[utility_type]).alias("source"), F.col("state").alias("candidate_state"),
        F.col("eia_id").cast("string").alias("eia_id"), "cntrl_area", F.col("type").alias("territory_type"),
    ).where("raw_name IS NOT NULL")


def gather(addresses: DataFrame, s: Sources, types: tuple[str, ...], base: float) -> DataFrame:
    """All sources in priority order; only those of the requested types."""
    branches: list[DataFrame] = []
    wanted = F.col("utility_type").isin(*types)

    def add(df: DataFrame) -> None:
        branches.append(df.where(wanted))

    by_address = None
    if s.address_corrections is not None:
        by_address = L.correction_by_address(addresses, s.address_corrections)
        add(by_address)
    if s.zip_corrections is not None:
        none = addresses.select("address_id", F.lit("").alias("utility_type")).limit(0)
        add(L.correction_by_zip(addresses, s.zip_corrections, by_address if by_address is not None else none))
    if s.state_config is not None:
        asked = addresses.where("state IS NOT NULL AND lat IS NOT NULL").select(
            F.col("address_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "state",
            F.explode(F.array(*[F.lit(t) for t in types])).alias("utility_type"))
        answers = S.state_source_join(asked, s.state_config, s.state_regions, s.state_features, base)
        answers = answers.withColumnRenamed("point_id", "address_id").join(addresses.select("address_id", "city"), "address_id")
        add(V.water_name_guard(answers).select(
            "address_id", "utility_type", F.col("name").alias("raw_name"), "source",
            F.col("confidence").alias("table_confidence"), F.col("state").alias("candidate_state")))
    if "gas" in types and s.gas_mapping is not None:
        add(L.gas_zip_join(addresses, s.gas_mapping))
    if "electric" in types and s.county_emc is not None:
        asked = addresses
        if s.state_config is not None:  # not where the state has polygons of its own
            own = s.state_config.where("utility_type = 'electric'").select("state").distinct()
            asked = addresses.join(own, "state", "left_anti")
        add(L.county_emc_join(asked, s.county_emc))
    if "gas" in types and s.county_gas is not None:
        add(L.county_gas_join(addresses, s.county_gas))
    if s.territories is not None:
        for t in ("electric", "gas", "water"):
            if t in types:
                add(territory_candidates(addresses, s.territories, t, base))
    if "electric" in types and s.live_layer is not None:
        add(s.live_layer.join(addresses.select("address_id", "state"), "address_id").select(
            "address_id", F.lit("electric").alias("utility_type"), F.col("live_name").alias("raw_name"), F.lit("hifld_api").alias("source"),
            F.lit(0.78).alias("max_confidence"), F.coalesce("live_state", "state").alias("candidate_state")))
    if s.zip_dominance is not None:
        add(L.zip_dominance_join(addresses, s.zip_dominance))
    if "water" in types and s.special_districts is not None:
        add(L.special_district_join(addresses, s.special_districts))
    if "electric" in types and s.eia_zip is not None:
        add(L.eia_zip_join(addresses, s.eia_zip))
    if s.city_cache is not None:
        add(L.city_cache_join(addresses, s.city_cache))
    if "gas" in types and s.state_defaults is not None:
        add(L.state_default_join(addresses, s.state_defaults))
    return V.collect_candidates(branches)


def lookup(
    addresses: DataFrame, s: Sources, types: tuple[str, ...] = ("electric", "gas", "water"),
    base: float = 0.05, min_score: float | None = 85.0, sewer: bool = False,
) -> DataFrame:
    """One row per (address_id, utility_type).

    ``addresses``: address_id, address, lat, lon and whatever the geocoder gave.
    The stages follow one key, (address_id, utility_type), so the aggregation, the
    ranking and the alternatives reuse one exchange of the resolved candidates.
    """
    # Each of these is read by several of the steps after it; they are written once.
    addresses = cut_lineage(fill_address_parts(addresses))
    raw = cut_lineage(gather(addresses, s, types, base))
    resolved = V.resolve_candidates(raw, s.aliases, s.reps, s.states, s.eia_index, min_score)
    ranked = V.rank_candidates(V.dedupe_and_boost(resolved, s.aliases))
    if "electric" in types:
        ranked = cut_lineage(V.demote_large_iou(ranked))
        if s.eia_zip is not None:
            ranked = V.apply_eia_verification(ranked, addresses.select("address_id", "zip_code"), s.eia_zip)
    answers = cut_lineage(V.primary_with_alternatives(ranked))
    if sewer and s.catalog is not None:
        water = answers.where("utility_type = 'water'").select("address_id", "provider_name", "confidence")
        answers = answers.unionByName(
            V.sewer_resolution(addresses, water, s.catalog, s.catalog_overrides, min_score is not None).withColumnRenamed("catalog_id", "matched_id"), allowMissingColumns=True)
    answers = cut_lineage(answers.drop("provider_key", "first_ordinal", "source_ordinal"))
    if s.catalog is not None:
        answers = cut_lineage(with_catalog_ids(answers, addresses, s, min_score is not None))
    if s.contacts is not None:
        answers = answers.withColumn("_k", F.coalesce("canonical_id", F.lit("")))
        found = L.contact_join(answers.select("canonical_id", "provider_name", "utility_type"), s.contacts).withColumn(
            "_k", F.coalesce("canonical_id", F.lit(""))).drop("canonical_id")
        answers = answers.join(found, ["_k", "provider_name", "utility_type"], "left").drop("_k")
        if s.live_layer is not None:
            electric = answers.where("utility_type = 'electric'")
            answers = L.contact_backfill(electric, s.live_layer.drop("live_state")).unionByName(answers.where("utility_type <> 'electric'"))
    return answers


def with_catalog_ids(answers: DataFrame, addresses: DataFrame, s: Sources, fuzzy: bool) -> DataFrame:
    rows = answers.join(addresses.select("address_id", F.coalesce("state", F.lit("")).alias("state")), "address_id").withColumn(
        "row_id", F.struct("address_id", "utility_type")).withColumnRenamed("provider_name", "provider")
    out = attach_catalog_ids(rows, s.catalog, s.catalog_overrides, fuzzy)
    if "matched_id" in out.columns:  # a sewer answer is a catalog entry; only one without an entry is looked up
        out = out.withColumn("catalog_id", F.coalesce("matched_id", "catalog_id")).drop("matched_id")
    return out.drop("row_id", "state").withColumnRenamed("provider", "provider_name")


def lookup_wide(addresses: DataFrame, answers: DataFrame, s: Sources) -> DataFrame:
    """One row per address: a struct per type and the broadband summary."""
    from gridlocus.operators.report import wide_result

    base = fill_address_parts(addresses).select("address_id", "address", "lat", "lon", "block_geoid")
    out = base.join(wide_result(answers), "address_id", "left")
    if s.broadband is not None:
        blocks = V.broadband_summary(s.broadband).select("block_geoid", F.struct(
            "internet_providers", "provider_count", "has_fiber", "has_cable", "max_download_speed", "source", "confidence").alias("internet"))
        out = out.join(blocks, "block_geoid", "left")
    return out
