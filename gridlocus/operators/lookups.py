"""Keyed lookups.  Each takes ``addresses`` (address_id, address, state, city,
zip_code, county, …) and one flattened table, and returns the candidate columns

    address_id, utility_type, raw_name, source, table_confidence, max_confidence,
    set_confidence, candidate_state

No join is hinted: lookup tables that are small are broadcast by the planner under
its size bound, larger ones are shuffled with skew splitting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.functions.address import as_col, county_clean

CANDIDATE_COLUMNS = ["address_id", "utility_type", "raw_name", "source", "table_confidence",
                     "max_confidence", "set_confidence", "candidate_state"]


def _candidate(df: DataFrame, utility_type, name, source, confidence, state=None, cap=None, fixed=None, more=()) -> DataFrame:
    def col(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return df.select(
        "address_id",
        col(utility_type, "string").alias("utility_type"),
        as_col(name).alias("raw_name"),
        col(source, "string").alias("source"),
        col(confidence, "double").alias("table_confidence"),
        col(cap, "double").alias("max_confidence"),
        col(fixed, "double").alias("set_confidence"),
        (F.col("state") if state is None else as_col(state)).alias("candidate_state"),
        *more,
    ).where("raw_name IS NOT NULL AND raw_name <> ''")


# ---- reviewer corrections ----------------------------------------------------
def latest_address_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("address", "utility_type").agg(
        F.max_by(F.struct("corrected_provider", "state"), F.struct("corrected_at", "correction_id")).alias("c")
    ).select("address", "utility_type", F.col("c.corrected_provider").alias("corrected_provider"),
             F.nullif(F.col("c.state"), F.lit("")).alias("correction_state"))


def correction_by_address(addresses: DataFrame, corrections: DataFrame) -> DataFrame:
    hit = addresses.join(latest_address_corrections(corrections), "address")
    return _candidate(hit, F.col("utility_type"), "corrected_provider", "correction_address", 0.99,
                      F.coalesce("correction_state", "state"), fixed=0.99)


def correction_by_zip(addresses: DataFrame, zip_corrections: DataFrame, by_address: DataFrame) -> DataFrame:
    """ZIP corrections, only where no address correction exists for the type."""
    hit = addresses.join(zip_corrections.select("utility_type", "zip_code", "provider", "confidence"), "zip_code")
    hit = hit.join(by_address.select("address_id", "utility_type"), ["address_id", "utility_type"], "left_anti")
    return _candidate(hit, F.col("utility_type"), "provider", "correction_zip",
                      F.coalesce("confidence", F.lit(0.98)), fixed=0.98)


# ---- gas ---------------------------------------------------------------------
GAS_CONFIDENCE = {"override": 0.93, "ambiguous": 0.80, "prefix": 0.88}


def _one_per_key(table: DataFrame, kind: str, of: str, key: str, name: str, out: str) -> DataFrame:
    """(state, ``out``_key, ``out``): the first name of every key of one kind."""
    return table.where(F.col(kind) == of).groupBy("state", F.col(key).alias(f"{out}_key")).agg(F.min(name).alias(out))


def gas_zip_join(addresses: DataFrame, gas_mapping: DataFrame) -> DataFrame:
    """5-digit override, else first provider of an ambiguous ZIP, else 3-digit prefix.

    ``gas_mapping``: state, key_kind, key, name, phone, website.  One left join per
    kind; an address is one row throughout.
    """
    zip5 = F.substring(F.trim("zip_code"), 1, 5)
    df = addresses.where("zip_code IS NOT NULL AND state IS NOT NULL").select(
        "address_id", F.upper("state").alias("state"), zip5.alias("override_key"), zip5.alias("ambiguous_key"), F.substring(zip5, 1, 3).alias("prefix_key"))
    for kind in GAS_CONFIDENCE:
        df = df.join(_one_per_key(gas_mapping, "key_kind", kind, "key", "name", kind), ["state", f"{kind}_key"], "left")
    found = lambda values: reduce(lambda c, kind: c.when(F.col(kind).isNotNull(), values[kind]), GAS_CONFIDENCE, F)
    tail = found({kind: F.lit("_ambiguous" if kind == "ambiguous" else "") for kind in GAS_CONFIDENCE})
    source = F.concat(F.lit("gas_zip_mapping_"), F.lower("state"), tail)
    return _candidate(df, "gas", F.coalesce(*GAS_CONFIDENCE), source, found({kind: F.lit(c) for kind, c in GAS_CONFIDENCE.items()}))


# fixed values: confidence by what was found
COUNTY_GAS_CONFIDENCE = {"city": 0.88, "county": 0.85, "default": 0.60}


def county_gas_join(addresses: DataFrame, county_gas: DataFrame) -> DataFrame:
    """City, else county, else the state's default; names compared without case.

    ``county_gas``: state, kind (city | county | default), key_lower, utility.  One
    left join per kind; an address is one row throughout.
    """
    df = addresses.where("state IS NOT NULL").select(
        "address_id", F.upper("state").alias("state"), F.lower(F.trim("city")).alias("city_key"), F.lower(county_clean("county")).alias("county_key"),
        F.lit("_default").alias("default_key"))
    for kind in COUNTY_GAS_CONFIDENCE:
        df = df.join(_one_per_key(county_gas, "kind", kind, "key_lower", "utility", kind), ["state", f"{kind}_key"], "left")
    found = lambda values: reduce(lambda c, kind: c.when(F.col(kind).isNotNull(), values[kind]), COUNTY_GAS_CONFIDENCE, F)
    conf = found({kind: F.lit(c) for kind, c in COUNTY_GAS_CONFIDENCE.items()})
    source = F.concat(F.lit("county_gas_"), F.lower("state"), found({kind: F.lit("" if kind == "county" else f"_{kind}") for kind in COUNTY_GAS_CONFIDENCE}))
    return _candidate(df, "gas", F.coalesce(*COUNTY_GAS_CONFIDENCE), source, conf, cap=conf)


def state_default_join(addresses: DataFrame, state_defaults: DataFrame) -> DataFrame:
    """``state_defaults``: state, provider, confidence."""
    hit = addresses.join(state_defaults.where("provider IS NOT NULL"), "state")
    conf = F.coalesce("confidence", F.lit(0.45))
    return _candidate(hit, "gas", "provider", "state_gas_default", conf, cap=conf)


# ---- electric ----------------------------------------------------------------
def county_emc_join(addresses: DataFrame, county_emc: DataFrame, state: str = "GA", has_state_source: bool = False) -> DataFrame:
    """Every cooperative of the county, first one most likely.  The county name is
    case-sensitive, and the table is not consulted where the state has polygons.

    ``county_emc``: county, pos (0-based), n, emc.
    """
    asked = addresses.where((F.col("state") == state) & F.lit(not has_state_source))
    hit = asked.withColumn("_county", county_clean("county")).join(
        county_emc.withColumnRenamed("county", "_county"), "_county"
    )
    conf = F.greatest(
        F.when(F.col("n") == 1, F.lit(0.87)).otherwise(0.72 - F.col("pos") * 0.05), F.lit(0.50)
    )
    return _candidate(hit, "electric", "emc", "georgia_emc", conf, cap=conf)


def county_emc_primary(county_emc: DataFrame) -> DataFrame:
    """First cooperative per county, the rest as alternatives."""
    return county_emc.groupBy("county").agg(
        F.min_by("emc", "pos").alias("name"),
        F.when(F.count("*") == 1, 0.87).otherwise(0.72).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("pos", "emc"))).alias("_all"),
    ).select("county", "name", "confidence",
             F.transform(F.slice("_all", F.lit(2), F.greatest(F.size("_all") - 1, F.lit(0))), lambda s: s["emc"]).alias("alternatives"))


def eia_zip_join(addresses: DataFrame, eia_zip: DataFrame) -> DataFrame:
    """``eia_zip``: zip, pos (0-based), name, eiaid, state."""
    first = eia_zip.where("pos = 0").select(F.col("zip").alias("zip_code"), "name", F.col("state").alias("eia_state"), F.col("eiaid").cast("string").alias("eia_id"))
    return _candidate(addresses.join(first, "zip_code"), "electric", "name", "eia_zip", 0.70,
                      F.coalesce(F.nullif(F.col("eia_state"), F.lit("")), F.col("state")), cap=0.70, more=("eia_id",))


# ---- several types -----------------------------------------------------------
def zip_dominance_confidence(level: Column, dominance: Column, samples: Column) -> Column:
    level = F.coalesce(level, F.lit("medium"))
    base = (
        F.when((level == "high") & (dominance >= 90), 0.82).when(level == "high", 0.78)
        .when((level == "medium") & (dominance >= 80), 0.75).when(level == "medium", 0.72).otherwise(0.65)
    )
    return F.when(samples >= 20, F.least(base + 0.03, F.lit(0.85))).otherwise(base)


def zip_dominance_join(addresses: DataFrame, zip_dominance: DataFrame) -> DataFrame:
    """``zip_dominance``: utility_type, state, zip, name, confidence_level,
    dominance_pct, sample_count."""
    table = zip_dominance.withColumnRenamed("zip", "zip_code")
    hit = addresses.withColumn("state", F.upper("state")).join(table, ["state", "zip_code"])
    conf = zip_dominance_confidence(
        F.col("confidence_level"), F.coalesce("dominance_pct", F.lit(0.0)), F.coalesce("sample_count", F.lit(0))
    )
    return _candidate(hit, F.col("utility_type"), "name",
                      F.concat(F.lit("remaining_states_"), F.col("utility_type")), conf, cap=conf)


def special_district_join(addresses: DataFrame, districts: DataFrame) -> DataFrame:
    """``districts``: zip, name, state."""
    table = districts.select(F.col("zip").alias("zip_code"), "name", F.col("state").alias("district_state"))
    hit = addresses.withColumn("zip_code", F.substring("zip_code", 1, 5)).join(table, "zip_code")
    return _candidate(hit, "water", "name", "special_districts", 0.82,
                      F.coalesce(F.nullif(F.col("district_state"), F.lit("")), F.col("state")), cap=0.82)


def city_cache_join(addresses: DataFrame, city_cache: DataFrame) -> DataFrame:
    """``city_cache``: state, city_lower, utility_type, name."""
    hit = addresses.select("address_id", F.upper("state").alias("state"), F.lower(F.trim("city")).alias("city_lower")).join(
        city_cache.where("utility_type IN ('electric', 'gas')"), ["state", "city_lower"]
    )
    return _candidate(hit, F.col("utility_type"), "name", "findenergy_city", 0.65, cap=0.65)


# ---- contacts ----------------------------------------------------------------
def contact_join(providers: DataFrame, contacts: DataFrame) -> DataFrame:
    """(canonical_id, provider_name, utility_type) -> phone, website.

    All keys a provider may be filed under become probe rows with their place in
    the chain; one join finds them and the earliest acceptable one is kept.
    ``contacts``: key, key_lower, phone, url, label, match_method.
    """
    keys = ["canonical_id", "provider_name", "utility_type"]
    distinct = providers.select(*keys).distinct()
    name, kind = F.col("provider_name"), F.lower(F.coalesce("utility_type", F.lit("")))

    def probe(step: float, key: Column, folded: bool, rule: str) -> Column:
        return F.struct(
            F.lit(float(step)).alias("step"), (F.lower(key) if folded else key).alias("key"),
            F.lit(folded).alias("folded"), F.lit(rule).alias("rule"),
        )

    probes = [
        probe(1, F.col("canonical_id"), False, "typed"), probe(2, name, False, "typed"), probe(3, name, True, "typed"),
        probe(90, F.col("canonical_id"), False, "any"), probe(91, name, False, "any"), probe(92, name, True, "any"),
    ]
    variants = F.array().cast("array<struct<step:double,key:string,folded:boolean,rule:string>>")
    for utility, suffixes in rules.CONTACT_SUFFIXES.items():
        rows = []
        for i, suffix in enumerate(suffixes):
            for j, joint in enumerate((" ", "-")):
                key = F.concat(name, F.lit(joint + suffix))
                step = 10 + 4 * i + 2 * j
                rows += [probe(step, key, False, "free"), probe(step + 1, key, True, "free")]
        variants = F.when(kind == utility, F.array(*rows)).otherwise(variants)
    exploded = distinct.select(*keys, F.explode(F.concat(F.array(*probes), variants)).alias("p")).select(*keys, "p.*").where("key IS NOT NULL")
    fields = ["phone", "url", "label", "match_method"]
    exact = contacts.select("key", F.lit(False).alias("folded"), *fields)
    folded = contacts.groupBy("key_lower").agg(F.max_by(F.struct(*fields), F.col("ordinal")).alias("f")).select(
        F.col("key_lower").alias("key"), F.lit(True).alias("folded"), "f.*"
    )
    label = F.lower(F.coalesce("label", F.lit("")))
    same_type = (label == "") | (label == kind)
    allowed = (
        (F.col("rule") == "free") | ((F.col("rule") == "typed") & same_type)
        | ((F.col("rule") == "any") & ((F.coalesce("match_method", F.lit("")) != "substring") | same_type))
    )
    best = exploded.join(exact.unionByName(folded), ["key", "folded"]).where(allowed).groupBy(*keys).agg(
        F.min_by(F.struct("phone", "url", "step"), F.col("step")).alias("c")
    )
    out = [F.nullif(F.col("c.phone"), F.lit("")).alias("phone"), F.nullif(F.col("c.url"), F.lit("")).alias("website")]
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "c")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return distinct.join(best, same, "left").select(*keys, *out)


def contact_backfill(primaries: DataFrame, live: DataFrame, key: str = "address_id") -> DataFrame:
    """Fill a missing phone or website from the address's live-layer attributes whose
    name contains, lies in, or starts with the same word as the provider's.

    ``primaries``: key, provider_name, phone, website.  ``live``: key, live_pos,
    live_name, telephone, live_website.
    """
    a, b = F.upper("provider_name"), F.upper("live_name")
    first_word = lambda c: F.get(F.split(F.trim(c), r"\s+"), F.lit(0))
    missing = primaries.where("phone IS NULL OR website IS NULL")
    near = (
        missing.join(live, key)
        .where(a.contains(b) | b.contains(a) | (first_word(a) == first_word(b)))
        .groupBy(key).agg(F.min_by(F.struct("telephone", "live_website"), F.col("live_pos")).alias("l"))
    )
    return primaries.join(near, key, "left").select(
        *[c for c in primaries.columns if c not in ("phone", "website")],
        F.coalesce("phone", F.nullif(F.col("l.telephone"), F.lit(""))).alias("phone"),
        F.coalesce("website", F.nullif(F.col("l.live_website"), F.lit(""))).alias("website"),
    )


# ---- broadband, geocode reference, cache ------------------------------------
def broadband_join(addresses: DataFrame, broadband: DataFrame) -> DataFrame:
    """``broadband``: block_geoid, providers.  Several million blocks: shuffled on the
    block, or co-located when both tables are bucketed on it."""
    return addresses.where("block_geoid IS NOT NULL").join(broadband, "block_geoid")


POINT_FIELDS = ["lat", "lon", "confidence", "city", "state", "zip_code", "county", "block_geoid"]


def geocode_by_reference(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """Primary reference point per address key, else the fallback one.

    ``addresses``: address_id, address_key.  ``points``: address_key, source
    (primary | fallback), lat, lon, …
    """
    usable = points.where("lat IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    best = usable.groupBy("address_key").agg(
        F.min_by(F.struct("source", *POINT_FIELDS), F.when(F.col("source") == "primary", 0).otherwise(1)).alias("g")
    )
    return addresses.join(best, "address_key", "left").select(
        *addresses.columns, F.coalesce("g.source", F.lit("miss")).alias("hit_source"),
        *[F.col(f"g.{f}").alias(f"geo_{f}") for f in POINT_FIELDS],
    )


def needs_lookup(addresses: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Addresses without an unexpired, geocoded cached result."""
    fresh = cache.where((F.col("expires_at") > now) & (F.col("lat") != 0)).select("address_key")
    return addresses.join(fresh, "address_key", "left_anti")


def upsert_results(cache: DataFrame, fresh: DataFrame, now: Column, ttl_days: int = 90) -> DataFrame:
    """Insert or replace by key, with a new expiry; expired rows go."""
    stamped = fresh.withColumn("created_at", now).withColumn("expires_at", now + F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    merged = cache.where(F.col("expires_at") > now).unionByName(stamped)
    fields = [c for c in merged.columns if c != "address_key"]
    return merged.groupBy("address_key").agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "version")).alias("r")
    ).select("address_key", "r.*")


# ---- verification against the registry by ZIP -------------------------------
def _meaningful_words(upper: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(upper, "[,.]", ""), r"\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in rules.EIA_STOP_WORDS]))


def eia_verify(pairs: DataFrame, eia_zip: DataFrame) -> DataFrame:
    """(zip_code, provider_name) -> adjustment, eia_id, eia_name, verified.

    The first utility of the ZIP that agrees decides; none that agrees costs 0.05;
    a ZIP without data changes nothing.
    """
    keys = ["zip_code", "provider_name"]
    asked = pairs.select(*keys).distinct()
    table = eia_zip.select(F.col("zip").alias("zip_code"), "pos", F.col("name").alias("eia_name"), "eiaid")
    p, e = F.upper(F.trim(F.coalesce("provider_name", F.lit("")))), F.upper(F.trim("eia_name"))
    pw, ew = _meaningful_words(p), _meaningful_words(e)
    common = F.size(F.array_intersect(pw, ew))
    shorter = F.greatest(F.least(F.size(pw), F.size(ew)), F.lit(1))
    gain = (
        F.when(p == "", F.lit(None).cast("double")).when(p == e, 0.05)
        .when((common > 0) & (common / shorter >= 0.5), 0.03)
        .when(e.contains(p) | p.contains(e), 0.02)
    )
    scored = asked.join(table, "zip_code").withColumn("gain", gain)
    record = F.struct("gain", F.col("eia_name"), "eiaid")
    best = scored.groupBy(*keys).agg(
        F.min_by(record, F.when(F.col("gain").isNotNull(), F.col("pos"))).alias("hit"),
        F.min_by(record, F.col("pos")).alias("head"),
    )
    blank = F.trim(F.coalesce("provider_name", F.lit(""))) == ""
    return asked.join(best, keys, "left").select(
        *keys,
        F.col("hit").isNotNull().alias("verified"),
        F.when(F.col("head").isNull() | blank, 0.0).when(F.col("hit").isNull(), -0.05).otherwise(F.col("hit.gain")).alias("adjustment"),
        F.coalesce("hit.eia_name", "head.eia_name").alias("eia_name"),
        F.coalesce("hit.eiaid", "head.eiaid").alias("verified_eia_id"),
    )


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
