"""Address, predicate and name columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlocus.functions import address as A
from gridlocus.functions import predicates as P
from gridlocus.functions import rules, text
from gridlocus.operators import projections
from gridlocus.workload.bindings import BINDINGS, pick
from gridlocus.workload.bindings import text as as_text
from gridlocus.workload.registry import has_any, in_list, query, quoted

RX_STATE = r"coalesce(nullif(regexp_extract(address, ',\s*([A-Z]{2})\s+\d{5}', 1), ''), nullif(regexp_extract(address, ',\s*([A-Z]{2})\s*$', 1), ''))"
RX_ZIP = r"coalesce(nullif(regexp_extract(address, '\b(\d{5})(?:-\d{4})?\s*$', 1), ''), nullif(regexp_extract(address, ',\s*[A-Z]{2}\s+(\d{5})', 1), ''))"
RX_CITY = r"nullif(trim(regexp_extract(address, ',\s*([^,]+?)\s*,\s*[A-Z]{2}', 1)), '')"


@query("a1_extract_state", f"SELECT address_id, {RX_STATE} AS state FROM addresses")
def _(t):
    return t.addresses.select("address_id", A.extract_state("address").alias("state"))


@query("a2_extract_zip", f"SELECT address_id, {RX_ZIP} AS zip_code FROM addresses")
def _(t):
    return t.addresses.select("address_id", A.extract_zip("address").alias("zip_code"))


@query("a3_extract_city", f"SELECT address_id, {RX_CITY} AS city FROM addresses")
def _(t):
    return t.addresses.select("address_id", A.extract_city("address").alias("city"))


# The same address with one, two or three comma parts.
BINDINGS["odd_addresses"] = """
SELECT address_id, CASE address_id % 4 WHEN 0 THEN address WHEN 1 THEN split_part(address, ',', 1) || ',' || split_part(address, ',', 2) || ' TX 75001'
  WHEN 2 THEN split_part(address, ',', 1) ELSE split_part(address, ',', 1) || ', ' || city END AS address FROM addresses
"""


@query("a4_split_address", r"""
SELECT address_id,
  CASE WHEN n >= 2 THEN trim(p[1]) ELSE address END AS street,
  nullif(CASE WHEN n >= 3 THEN trim(p[2]) WHEN n = 2 THEN CASE WHEN regexp_matches(l, '^.+?\s+[A-Za-z]{2}\s+\d{5}(-\d{4})?') THEN regexp_extract(l, '^(.+?)\s+([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)', 1) ELSE l END END, '') AS city,
  nullif(CASE WHEN n >= 3 THEN CASE WHEN regexp_matches(l, '^[A-Za-z]{2}\s+\d{5}') THEN substr(l, 1, 2) ELSE l END WHEN n = 2 THEN regexp_extract(l, '^(.+?)\s+([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)', 2) END, '') AS state,
  nullif(CASE WHEN n >= 3 THEN regexp_extract(l, '^([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)', 2) WHEN n = 2 THEN regexp_extract(l, '^(.+?)\s+([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)', 3) END, '') AS zip
FROM (SELECT address_id, address, string_split(address, ',') AS p, len(string_split(address, ',')) AS n, trim(string_split(address, ',')[-1]) AS l FROM odd_addresses) x
""")
def _(t):
    return t.odd_addresses.select("address_id", A.split_address("address").alias("s")).select("address_id", "s.*")


_key = r"regexp_replace(trim(lower(address)), '\s+', ' ', 'g')"
for _word, _short in rules.ADDRESS_ABBREVIATIONS:
    _key = rf"regexp_replace({_key}, '\b{_word}\b', '{_short}', 'g')"


@query("a5_address_key", f"SELECT address_id, {_key} AS address_key FROM addresses")
def _(t):
    return t.addresses.select("address_id", A.address_key("address").alias("address_key"))


BINDINGS["geocodes"] = f"""
SELECT c_custkey AS address_id, {pick('c_custkey % 5', ['ROOFTOP', 'RANGE_INTERPOLATED', 'GEOMETRIC_CENTER', 'APPROXIMATE', None])} AS location_type,
       c_custkey % 35 AS place_rank, c_custkey % 2 = 0 AS has_line FROM customer
"""


@query("a6_geocode_confidence", """
SELECT address_id, CASE WHEN has_line THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS tiger,
  CASE location_type WHEN 'ROOFTOP' THEN 0.98::DOUBLE WHEN 'RANGE_INTERPOLATED' THEN 0.9::DOUBLE WHEN 'GEOMETRIC_CENTER' THEN 0.8::DOUBLE WHEN 'APPROXIMATE' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS by_type,
  CASE WHEN place_rank >= 30 THEN 0.92::DOUBLE WHEN place_rank >= 26 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS by_rank FROM geocodes
""")
def _(t):
    return t.geocodes.select("address_id", A.tiger_confidence(F.col("has_line")).alias("tiger"),
                             A.location_type_confidence("location_type").alias("by_type"), A.place_rank_confidence("place_rank").alias("by_rank"))


BINDINGS["fips"] = f"""
SELECT c_custkey AS address_id, '48' AS f_state, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad({as_text('c_nationkey')}, 3, '0') END AS f_county,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE lpad({as_text('c_custkey % 1000000')}, 6, '0') END AS f_tract, '1000' AS f_block FROM customer
"""


@query("a7_block_geoid", "SELECT address_id, CASE WHEN f_county <> '' AND f_tract IS NOT NULL THEN f_state || f_county || f_tract || f_block END AS block_geoid FROM fips")
def _(t):
    return t.fips.select("address_id", A.block_geoid("f_state", "f_county", "f_tract", "f_block").alias("block_geoid"))


@query("a8_county_clean", "SELECT address_id, trim(replace(replace(county, ' County', ''), ' county', '')) AS county FROM addresses")
def _(t):
    return t.addresses.select("address_id", A.county_clean("county").alias("county"))


@query("a9_coordinate_cell", "SELECT round_even(lat, 3) AS lat, round_even(lon, 3) AS lon, count(*) AS n FROM addresses GROUP BY 1, 2")
def _(t):
    return t.addresses.select(A.coordinate_cell("lat", "lon").alias("c")).groupBy("c.lat", "c.lon").agg(F.count("*").alias("n"))


_label = "CASE WHEN confidence >= 0.85 THEN 'verified' WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.50 THEN 'medium' ELSE 'low' END"


@query("a10_v1_projection", f"""
SELECT address_id, utility_type, provider_name AS name, CASE WHEN address_id % 2 = 0 THEN '555' ELSE 'NOT AVAILABLE' END AS phone,
       CAST(round(confidence * 100) AS INT) AS confidence_score, {_label} AS confidence, source, address_id % 3 = 0 AS has_choice,
       CASE WHEN address_id % 3 = 0 THEN 'choose' ELSE '' END AS message, 'Other ' || provider_name AS others
FROM candidates WHERE source_ordinal = 0 AND utility_type = 'electric'
""")
def _(t):
    answers = t.candidates.where("source_ordinal = 0").select(
        "address_id", "utility_type", "provider_name", "confidence", "source",
        F.when(F.col("address_id") % 2 == 0, "555").otherwise("").alias("phone"), F.lit(None).cast("string").alias("website"),
        (F.col("address_id") % 3 == 0).alias("is_deregulated"), F.lit("choose").alias("deregulated_note"),
        F.array(F.struct(F.concat(F.lit("Other "), "provider_name").alias("provider"), F.lit(0.4).alias("confidence"))).alias("alternatives"))
    v1 = projections.v1_projection(answers, "electric, WATER")
    return v1.select("address_id", "utility_type", "name", "phone", "confidence_score", "confidence", "source", F.col("deregulated.has_choice").alias("has_choice"),
                     F.col("deregulated.message").alias("message"), F.array_join(F.transform("other_providers", lambda p: p["name"]), "|").alias("others"))


@query("a11_contact_projection", """
SELECT address_id, utility_type, provider_name AS name, CASE WHEN address_id % 2 = 0 THEN '555' ELSE '' END AS phone, '' AS website
FROM candidates WHERE source_ordinal = 1
""")
def _(t):
    answers = t.candidates.where("source_ordinal = 1").withColumns({
        "phone": F.when(F.col("address_id") % 2 == 0, "555"), "website": F.lit(None).cast("string")})
    return projections.contact_projection(answers).select("address_id", "utility_type", "contact.*")


# ---- predicates --------------------------------------------------------------
@query("p1_is_null_value", f"""
SELECT raw, lower(trim(raw)) IN {in_list(rules.TENANT_NULLS)} OR len(trim(raw)) <= 2 AS is_null, count(*) AS n
FROM (SELECT raw FROM reported UNION ALL SELECT unnest(string_split_regex(text, '[ \n]')) AS raw FROM documents) x GROUP BY 1, 2
""")
def _(t):
    words = t.documents.select(F.explode(F.split("text", "[ \n]")).alias("raw"))
    return t.reported.select("raw").unionByName(words).groupBy("raw", P.is_null_value("raw").alias("is_null")).agg(F.count("*").alias("n"))


_l = r"lower(regexp_replace(trim(raw_name), '\s+', ' ', 'g'))"


@query("p2_reserved_names", f"""
SELECT p_partkey, CASE WHEN {_l} IN {in_list(rules.NULL_NAMES)} OR {_l} = '' THEN 'null_value' WHEN {_l} IN {in_list(rules.PROPANE_NAMES)} THEN 'propane'
  WHEN {_l} IN {in_list(rules.HOLDING_NAMES)} THEN 'holding' WHEN {_l} IN (SELECT rep_lower FROM reps) THEN 'rep' END AS kind FROM raw_names
""")
def _(t):
    lookup = F.lower(text.clean_name("raw_name"))
    base = t.raw_names.withColumn("l", lookup).join(t.reps.select(F.col("rep_lower").alias("l"), F.lit("rep").alias("rep")), "l", "left")
    return base.select("p_partkey", F.coalesce(P.reserved_kind(F.col("l")), F.col("rep")).alias("kind"))


@query("p3_is_propane", f"SELECT raw, {has_any('lower(raw)', rules.PROPANE_WORDS)} AS propane, count(*) AS n FROM reported WHERE utility_type = 'gas' GROUP BY 1, 2")
def _(t):
    return t.reported.where("utility_type = 'gas'").groupBy("raw", P.is_propane("raw").alias("propane")).agg(F.count("*").alias("n"))


@query("p4_is_tdu", f"SELECT row_id, coalesce({has_any('upper(engine_provider)', rules.TDU_NAMES)}, false) AS tdu FROM results")
def _(t):
    return t.results.select("row_id", P.is_tdu("engine_provider").alias("tdu"))


@query("p5_is_large_iou", f"SELECT territory_id, {has_any('upper(name)', rules.LARGE_IOU_NAMES)} AS large_iou FROM territories")
def _(t):
    return t.territories.select("territory_id", P.is_large_iou("name").alias("large_iou"))


@query("p6_is_local_utility", f"SELECT territory_id, {has_any('upper(name)', rules.LOCAL_WORDS + rules.LOCAL_NAMES)} AS local FROM territories")
def _(t):
    return t.territories.select("territory_id", P.is_local_utility("name").alias("local"))


@query("p7_is_water_utility_name", f"SELECT territory_id, {has_any('upper(name)', rules.WATER_WORDS)} AS water FROM territories")
def _(t):
    return t.territories.select("territory_id", P.is_water_utility_name("name").alias("water"))


_tdu = "(" + " OR ".join(f"contains(upper(name), {quoted(n)}) OR contains({quoted(n)}, upper(name))" for n in rules.ERCOT_TDUS) + ")"


@query("p8_is_deregulated", f"""
SELECT territory_id, CASE WHEN type IN ('COOPERATIVE', 'MUNICIPAL') THEN contains(upper(name), 'LUBBOCK') WHEN {_tdu} THEN true
  ELSE cntrl_area IN ('ERCO', 'ERCOT') AND contains(type, 'INVESTOR') END AS deregulated FROM territories
""")
def _(t):
    return t.territories.select("territory_id", P.is_deregulated("name", "cntrl_area", "type").alias("deregulated"))


@query("p9_is_protected_source", f"SELECT row_id, {has_any('lower(engine_source)', rules.PROTECTED_SOURCE_WORDS)} AS protected FROM results")
def _(t):
    return t.results.select("row_id", P.is_protected_source("engine_source").alias("protected"))


@query("p10_needs_review_flag", "SELECT row_id, engine_confidence < 0.7 AS low, engine_confidence < 0.8 AS low_after_pick FROM results")
def _(t):
    return t.results.select("row_id", P.needs_review_flag("engine_confidence").alias("low"), P.needs_review_flag("engine_confidence", 0.80).alias("low_after_pick"))


DUE = """(comparison IN ('MISMATCH', 'MATCH_ALT') OR (engine_confidence > 0 AND engine_confidence < 0.7)
  OR (trim(coalesce(tenant_raw, '')) <> '' AND engine_confidence > 0 AND engine_confidence < 0.75) OR (engine_provider IS NOT NULL AND engine_catalog_id IS NULL))"""
REASON = """concat_ws('; ', CASE WHEN comparison = 'MISMATCH' THEN 'MISMATCH' END, CASE WHEN comparison = 'MATCH_ALT' THEN 'MATCH_ALT' END,
  CASE WHEN engine_needs_review THEN 'Low confidence' END, CASE WHEN engine_provider IS NOT NULL AND engine_catalog_id IS NULL THEN 'No catalog ID' END,
  CASE WHEN NOT engine_id_confident AND engine_catalog_id IS NOT NULL THEN 'Low ID confidence' END)"""


@query("p11_needs_review_queue", f"SELECT row_id, {DUE} AS due FROM results")
def _(t):
    return t.results.select("row_id", P.needs_review_queue("comparison", "engine_confidence", "tenant_raw", "engine_provider", "engine_catalog_id").alias("due"))


@query("p12_review_reason", f"SELECT row_id, {REASON} AS reason FROM results")
def _(t):
    return t.results.select("row_id", P.review_reason("comparison", "engine_needs_review", "engine_provider", "engine_catalog_id", "engine_id_confident").alias("reason"))


DENY = " OR ".join(f"(contains(lower(engine_provider), {quoted(n)}) AND upper(state) IN {in_list(s)})" for n, s in rules.CROSS_STATE_DENY.items())


@query("p13_cross_state_override", f"SELECT row_id, coalesce({DENY}, false) AS denied FROM results")
def _(t):
    return t.results.select("row_id", P.cross_state_override("engine_provider", "state").alias("denied"))


def registry(t):
    """registry_names with the name variants as an array (two per entity)."""
    return t.registry_names.groupBy("eia_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("n")).select(
        "eia_id", F.transform("n", lambda x: x["name"]).alias("names"))


@query("p14_is_wholesale", f"SELECT eia_id, {has_any('names', rules.WHOLESALE_WORDS)} AS wholesale FROM (SELECT eia_id, lower(string_agg(name, ' ' ORDER BY pos)) AS names FROM registry_names GROUP BY eia_id) x")
def _(t):
    return registry(t).select("eia_id", P.is_wholesale("names").alias("wholesale"))


@query("p15_feature_filter", "SELECT territory_id, contains(lower(type), 'coop') AND name NOT IN ('Nicor Gas', 'ATMOS ENERGY CORP') AS kept FROM territories")
def _(t):
    excluded = F.array(F.lit("Nicor Gas"), F.lit("ATMOS ENERGY CORP"))
    return t.territories.select("territory_id", P.feature_kept("name", "type", F.lit("Coop"), excluded).alias("kept"))


@query("p15_feature_filter_equal", "SELECT territory_id, customers IS NOT NULL AND customers = 0 AND name <> 'Nicor Gas' AS kept FROM territories")
def _(t):
    return t.territories.select("territory_id", P.feature_kept("name", F.col("customers").cast("string"), F.lit(None).cast("string"), F.array(F.lit("Nicor Gas")), F.lit("0.0")).alias("kept"))


@query("p16_is_compound_key", """
SELECT p_partkey, contains(raw_name, ', ') AND len(list_filter(string_split(raw_name, ', '), lambda p: len(trim(p)) <= 3)) = 0
  AND len(list_filter(string_split(raw_name, ', '), lambda p: len(trim(p)) > 5)) >= 2 AS compound FROM raw_names
""")
def _(t):
    return t.raw_names.select("p_partkey", P.is_compound_key("raw_name").alias("compound"))


NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(trim({0}), ',+$', '')), '\s+', ' ', 'g')), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("p17_names_are_similar", f"""
SELECT p_partkey, a <> '' AND b <> '' AND (a = b OR (len(a) > 3 AND len(b) > 3 AND (contains(a, b) OR contains(b, a)))
  OR coalesce(list_filter(string_split(a, ' '), lambda w: len(w) > 3)[1] = list_filter(string_split(b, ' '), lambda w: len(w) > 3)[1], false)) AS similar
FROM (SELECT p_partkey, {NORM.format('raw_name')} AS a, {NORM.format('p_name')} AS b FROM raw_names JOIN part USING (p_partkey)) x
""")
def _(t):
    df = t.raw_names.join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return df.select("p_partkey", P.names_are_similar(text.norm_key("raw_name"), text.norm_key("p_name")).alias("similar"))


# ---- name columns ------------------------------------------------------------
BINDINGS["water_names"] = f"""
SELECT s_suppkey, {pick('s_suppkey % 10', ["=s_name || ', City Of'", "=s_name || ' Wtr Dept'", "=s_name || ' WSC - TX'", "=s_name || ' (TX123)'",
  "=s_name || ' Water Department'", "=s_name || ' Auth VA'", "='Mt ' || s_name", "=s_name || ' Sud'", "='Lee s ' || s_name || ' Mud 12'", "=s_name || ' Co'"])} AS name FROM supplier
"""
_w = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(name), '\s*-\s*[A-Z]{2}\s*$', '', 'i'), '\s+[A-Z]{2}\s*$', ''), '\s*\([^)]*\)', '', 'g'), '^(.+?),\s*(City Of|Town Of|Village Of|County Of)\s*$', '\2 \1', 'i')"""
for _p, _f in rules.WATER_ABBREVIATIONS:
    # RE2 has no look-ahead; the data has none of the cases where that matters.
    _p = _p.replace(r"(?=\s|$)", "").replace(r"(?=\s[A-Z])", "").replace(r"(?=\s*\d)", "NEVER").replace(r"(?=\s)", "")
    _w = f"regexp_replace({_w}, '{_p}', '{_f}', 'gi')"
_w = rf"regexp_replace({_w}, '\b({'|'.join(rules.WATER_GENERIC_SUFFIXES)}|Mud \d+)\b', '', 'gi')"
_w = rf"regexp_replace(trim(regexp_replace({_w}, '\s+', ' ', 'g')), '^[ \-,.]+|[ \-,.]+$', '', 'g')"


WATER_NORM = _w


@query("n10_normalize_water_name", f"SELECT s_suppkey, {_w} AS water_name FROM water_names")
def _(t):
    return t.water_names.select("s_suppkey", text.normalize_water_name("name").alias("water_name"))


@query("n11_normalize_catalog_title", r"""
SELECT ordinal, trim(regexp_replace(regexp_replace(
   CASE WHEN b LIKE '% corp' THEN left(b, len(b) - 5) ELSE b END, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm
FROM (SELECT ordinal, regexp_replace(regexp_replace(regexp_replace(lower(trim("Title")), ' elec$', ' electric'), '\s*[-–]\s*\(?[a-z]{2}\)?\s*$', ''), '\s*\([a-z]{2}\)\s*$', '') AS b FROM catalog_raw) x
""")
def _(t):
    return t.catalog_raw.select("ordinal", text.normalize_catalog_title("Title").alias("norm"))


def _strip_sql(expression: str, suffixes) -> str:
    for s in suffixes:
        n = len(s)
        expression = f"(SELECT CASE WHEN ends_with(upper(v), {quoted(s)}) THEN trim(left(v, len(v) - {n})) ELSE v END FROM (SELECT {expression} AS v))"
    return expression


_bare = "trim(name)"
_stage = "SELECT territory_id, trim(name) AS v FROM territories"
for _s in rules.LEGAL_SUFFIXES:
    _stage = f"SELECT territory_id, CASE WHEN ends_with(upper(v), {quoted(_s)}) THEN trim(left(v, len(v) - {len(_s)})) ELSE v END AS v FROM ({_stage}) x"
_title = r"list_reduce(list_transform(regexp_extract_all(lower(v), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b)"


@query("n12_clean_passthrough", f"SELECT territory_id, CASE WHEN v = upper(v) AND len(v) > 3 THEN {_title} ELSE v END AS clean FROM ({_stage}) y")
def _(t):
    return t.territories.select("territory_id", text.clean_passthrough("name").alias("clean"))


@query("n13_normal_keys", f"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(raw_name), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS fuzzy_form,
  {NORM.format('raw_name')} AS norm_key, regexp_replace(trim(regexp_replace(trim(raw_name), ',+$', '')), '\\s+', ' ', 'g') AS alias,
  regexp_replace(trim(raw_name), '\\s+', ' ', 'g') AS clean FROM raw_names
""")
def _(t):
    return t.raw_names.select("p_partkey", text.normalize_for_fuzzy("raw_name").alias("fuzzy_form"), text.norm_key("raw_name").alias("norm_key"),
                              text.clean_alias("raw_name").alias("alias"), text.clean_name("raw_name").alias("clean"))


_casing = "CASE lower(trim(w)) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.CASING.items()) + " ELSE w END"
BINDINGS["cased_names"] = f"""
SELECT p_partkey, {pick('p_partkey % 8', ['AEP', 'pg&e', 'xcel energy', 'COMED', '=p_name', '=upper(p_name)', 'Met-Ed', '=p_brand'])} AS w, p_type FROM part
"""


@query("n14_fix_casing_best_display", f"""
SELECT p_type, arg_min(f, (CASE WHEN f = upper(f) AND f <> lower(f) THEN 'b' ELSE 'a' END) || lpad(CAST(9999 - len(f) AS VARCHAR), 5, '0') || f) AS display
FROM (SELECT p_type, {_casing} AS f FROM cased_names) x GROUP BY p_type
""")
def _(t):
    fixed = text.fix_casing("w")
    return t.cased_names.groupBy("p_type").agg(F.min_by(fixed, text.display_preference(fixed)).alias("display"))


BINDINGS["stated_names"] = f"""
SELECT p_name AS canonical_id, p_name || ' ' || {pick('p_partkey % 4', ['TX', 'of (GA)', 'INDIANA', '- NC'])} AS display_name, p_brand || ', ' || {pick('p_partkey % 3', ['OH', 'ohio', 'IN PA'])} AS alias FROM part
"""


@query("n15_canonical_states", f"""
SELECT canonical_id, string_agg(DISTINCT s, ',' ORDER BY s) AS states FROM (
  SELECT canonical_id, unnest(regexp_extract_all(upper(canonical_id || ' ' || display_name || ' ' || alias), '[^\\s,\\-().]+')) AS s FROM stated_names) x
WHERE s IN {in_list(rules.STATE_CODES)} GROUP BY canonical_id
""")
def _(t):
    from gridlocus.operators.names import canonical_states

    return canonical_states(t.stated_names).select("canonical_id", F.array_join("states", ",").alias("states"))


_dstage = "SELECT eia_id, pos, trim(name) AS v FROM registry_names"
for _s in rules.DISPLAY_SUFFIXES:
    _dstage = f"SELECT eia_id, pos, CASE WHEN ends_with(v, {quoted(_s)}) THEN trim(left(v, len(v) - {len(_s)})) ELSE v END AS v FROM ({_dstage}) x"


@query("n16_display_name_picker", f"SELECT eia_id, arg_min(v, len(v) * 10 + pos) AS display FROM ({_dstage}) y GROUP BY eia_id")
def _(t):
    return registry(t).select("eia_id", text.pick_display_name("names").alias("display"))


CATEGORY = """CASE WHEN contains(lower({0}), ',') THEN 'Compound (comma-separated)' WHEN regexp_matches(lower({0}), 'choose|select|enter|n/a|none|power to') THEN 'Placeholder'
  WHEN regexp_matches(lower({0}), 'water|sewer|waste') THEN 'Water/sewer' WHEN regexp_matches(lower({0}), 'co-op|coop|cooperative|emc') THEN 'Co-op'
  WHEN regexp_matches(lower({0}), 'municipal|city of|town of|village of') THEN 'Municipal' WHEN contains(lower({0}), 'gas') AND NOT contains(lower({0}), 'electric') THEN 'Gas utility' ELSE '' END"""


@query("n17_classify_unmatched", f"SELECT {CATEGORY.format('line')} AS category, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents UNION ALL SELECT name FROM territories) x(line) GROUP BY 1")
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    names = lines.unionByName(t.territories.select(F.col("name").alias("line")))
    return names.groupBy(text.classify_unmatched("line").alias("category")).agg(F.count("*").alias("n"))


@query("n17b_state_word_in_title", """SELECT ordinal, list_contains(regexp_extract_all(upper("Title"), '[A-Z]+'), 'TX') AS in_texas FROM catalog_raw""")
def _(t):
    return t.catalog_raw.select("ordinal", text.state_word_in_title("Title", F.lit("TX")).alias("in_texas"))


INFER = """CASE WHEN contains(n, 'gas') AND NOT contains(n, 'electric') THEN 'gas' WHEN regexp_matches(n, 'water|irrigation') THEN 'water'
  WHEN regexp_matches(n, 'electric|power|energy|light') THEN 'electric' ELSE 'multi' END"""


@query("n18_infer_utility_type", f"SELECT eia_id, {INFER} AS utility_type FROM (SELECT eia_id, lower(string_agg(name, ' ' ORDER BY pos)) AS n FROM registry_names GROUP BY eia_id) x")
def _(t):
    return registry(t).select("eia_id", text.infer_utility_type("names").alias("utility_type"))


@query("n8_providers_match", """
SELECT p_partkey, CASE WHEN raw_name IS NULL THEN false ELSE contains(lower(trim(raw_name)), lower(p_name)) OR contains(lower(p_name), lower(trim(raw_name))) END AS same
FROM raw_names JOIN part USING (p_partkey)
""")
def _(t):
    from gridlocus.operators.names import providers_match

    df = t.raw_names.join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return df.select("p_partkey", providers_match(F.trim("raw_name"), F.col("p_name")).alias("same"))


@query("v14_deregulated_note", f"SELECT territory_id, 'Address is in ' || CASE WHEN v = upper(v) AND len(v) > 3 THEN {_title} ELSE v END || ' TDU territory. Tenant chooses their Retail Electric Provider (REP).' AS note FROM ({_stage}) y")
def _(t):
    return t.territories.select("territory_id", text.deregulated_note("name").alias("note"))
