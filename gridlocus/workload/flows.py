"""Readers, writers, streams and the whole lookup."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.operators import activity, report
from gridlocus.operators import resolve as V
from gridlocus.operators.catalog import catalog_overrides
from gridlocus.operators.compare import CORRECT, compare_providers
from gridlocus.operators.dictionary import build_dictionary
from gridlocus.operators.names import canonical_states, parent_table
from gridlocus.plans import retest
from gridlocus.plans.lookup import Sources, lookup, lookup_wide, territory_candidates
from gridlocus.session import cut_lineage
from gridlocus.sources import readers as R
from gridlocus.sources import writers as W
from gridlocus.streaming import operators as T
from gridlocus.streaming.run import arrivals, drain, drain_batches, drain_updates, file_stream, shared_folder, write_arrivals
from gridlocus.streaming.snapshots import Snapshots, answers, lookup_stream
from gridlocus.workload.bindings import BINDINGS, pick
from gridlocus.workload.bindings import text as as_text
from gridlocus.workload.matching import match_ctes, prepared, segment_ctes
from gridlocus.workload.registry import TEXTS, has_any, in_list, query, quoted
from gridlocus.workload.reporting import RUNS, compared_ctes, result_alternatives, reviewed
from gridlocus.workload.resolving import BASE, HITS, SCORED, VERIFY, state_inputs


def folder(t, name: str) -> str:
    return os.path.join(shared_folder(t.spark), name)


# ---- readers -----------------------------------------------------------------
@query("s1_read_addresses", "SELECT address FROM addresses WHERE address_id % 7 <> 0")
def _(t):
    path = folder(t, "addresses")
    t.addresses.select(F.col("city"), F.when(F.col("address_id") % 7 != 0, F.col("address")).otherwise("  ").alias("Display")).write.option("header", True).csv(path)
    return R.read_addresses(t.spark, path).select("address")


@query("s2_read_territories", "SELECT 'gas' AS layer, name, state, type, customers, CAST(NULL AS VARCHAR) AS pwsid, 1 AS n_rings, 5 AS corners FROM territories WHERE layer = 'gas'")
def _(t):
    path = folder(t, "gas.geojson")
    corner = lambda dx, dy: F.array(F.col("cx") + dx * F.col("r"), F.col("cy") + dy * F.col("r"))
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("name").alias("NAME"), F.col("state").alias("STATE"), F.col("type").alias("TYPE"), F.col("customers").cast("string").alias("TOTAL_CUST"), F.col("eia_id").alias("SVCTERID")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    t.territories.where("layer = 'gas'").select(F.to_json(feature).alias("value")).write.text(path)
    df = R.read_territories(t.spark, path, "gas")
    return df.select("layer", "name", "state", "type", "customers", "pwsid", F.size("rings").alias("n_rings"), F.size(F.col("rings")[0]).alias("corners"))


# JSON documents of fixed size, one per row of a given table.
BINDINGS["zip_docs"] = f"""
SELECT address_id, zip_code, CASE address_id % 3 WHEN 0 THEN '{{"corrections": {{"' || zip_code || '": "Plain ' || {as_text('address_id')} || '", "_note": "x"}}}}'
  WHEN 1 THEN '{{"' || zip_code || '": {{"provider": "Object ' || {as_text('address_id')} || '", "confidence": 0.5}}}}' ELSE '{{"' || zip_code || '": {{"name": "Named ' || {as_text('address_id')} || '"}}}}' END AS doc
FROM addresses WHERE zip_code IS NOT NULL
"""


@query("s5_flatten_zip_corrections", "SELECT 'gas' AS utility_type, zip_code, CASE address_id % 3 WHEN 0 THEN 'Plain ' WHEN 1 THEN 'Object ' ELSE 'Named ' END || address_id AS provider, CASE WHEN address_id % 3 = 1 THEN 0.5::DOUBLE ELSE 0.98::DOUBLE END AS confidence FROM zip_docs")
def _(t):
    return R.flatten_zip_corrections(t.zip_docs, F.lit("gas"))


BINDINGS["gas_docs"] = f"""
SELECT s_suppkey, 'S' || {as_text('s_suppkey')} AS state, '{{"utilities": {{"A": {{"name": "' || s_name || '", "phone": "1"}}, "B": {{"phone": "2"}}}}, "zip_to_utility": {{"' || lpad({as_text('s_suppkey % 1000')}, 3, '0') || '": "A", "zzz": "MISSING"}}, "zip_overrides": {{"' || lpad({as_text('s_suppkey')}, 5, '0')
  || '": "B"}}, "ambiguous_zips": {{"99' || lpad({as_text('s_suppkey % 1000')}, 3, '0') || '": {{"providers": ["A", "B"]}}}}}}' AS doc FROM supplier
"""


@query("s6_flatten_gas_mapping", """SELECT 'S' || s_suppkey AS state, 'prefix' AS key_kind, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS key, s_name AS name, '1' AS phone FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'override', lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), 'B', '2' FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'ambiguous', '99' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0'), s_name, '1' FROM supplier""")
def _(t):
    return R.flatten_gas_mapping(t.gas_docs, F.col("state")).drop("website")


BINDINGS["county_docs"] = f"""
SELECT s_suppkey, '{{"_metadata": {{"x": 1}}, "S' || {as_text('s_suppkey')} || '": {{"_default": "Def ' || {as_text('s_suppkey')} || '", "counties": {{"Cook": {{"utility": "Cook gas", "notes": "n"}}}}, "cities": {{"Elgin": "Elgin gas"}}}}}}' AS doc FROM supplier
"""


@query("s7_flatten_county_gas", "SELECT 'S' || s_suppkey AS state, 'default' AS kind, '_default' AS key_lower, 'Def ' || s_suppkey AS utility FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'county', 'cook', 'Cook gas' FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'city', 'elgin', 'Elgin gas' FROM supplier")
def _(t):
    return R.flatten_county_gas(t.county_docs)


BINDINGS["emc_docs"] = f"""
SELECT s_suppkey, '{{"county_to_emc": {{"C' || {as_text('s_suppkey')} || '": ["E' || {as_text('s_suppkey')} || '", "F"]}}, "emcs": {{"E' || {as_text('s_suppkey')} || '": {{"phone": "7"}}}}}}' AS doc FROM supplier
"""


@query("s8_flatten_county_emc", "SELECT 'C' || s_suppkey AS county, 0 AS pos, 2 AS n, 'E' || s_suppkey AS emc, '7' AS phone FROM supplier UNION ALL SELECT 'C' || s_suppkey, 1, 2, 'F', NULL FROM supplier")
def _(t):
    return R.flatten_county_emc(t.emc_docs).drop("website")


BINDINGS["eia_docs"] = f"""
SELECT address_id, zip_code, '{{"' || zip_code || '": [{{"name": "", "eiaid": 1}}, {{"name": "U' || {as_text('address_id % 9')} || '", "eiaid": ' || {as_text('address_id')} || ', "state": "TX"}}, {{"name": "V", "eiaid": 2}}, {{"name": "V", "eiaid": 3}}]}}' AS doc FROM addresses WHERE zip_code IS NOT NULL
"""


@query("s9_flatten_eia_zip", "SELECT zip_code AS zip, 0 AS pos, 'U' || address_id % 9 AS name, CAST(address_id AS VARCHAR) AS eiaid FROM eia_docs UNION ALL SELECT zip_code, 1, 'V', '2' FROM eia_docs")
def _(t):
    return R.flatten_eia_zip(t.eia_docs).select("zip", "pos", "name", "eiaid")


BINDINGS["dominance_docs"] = f"""
SELECT address_id, zip_code, '{{"gas": {{"TX": {{"' || zip_code || '": {{"name": "G", "confidence_level": "high", "dominance_pct": ' || {as_text('address_id % 100')} || ', "sample_count": 4}}}}}}}}' AS doc FROM addresses WHERE zip_code IS NOT NULL
"""


@query("s10_flatten_zip_dominance", "SELECT 'gas' AS utility_type, 'TX' AS state, zip_code AS zip, 'G' AS name, 'high' AS confidence_level, (address_id % 100)::DOUBLE AS dominance_pct, 4 AS sample_count FROM dominance_docs")
def _(t):
    return R.flatten_zip_dominance(t.dominance_docs)


BINDINGS["city_docs"] = f"""
SELECT s_suppkey, '{{"_metadata": {{"n": 1}}, "tx:Town ' || {as_text('s_suppkey')} || ':gas": {{"providers": [{{"name": "P' || {as_text('s_suppkey')} || '"}}, {{"name": "Q"}}]}}, "GA:Empty:gas": {{"providers": []}}}}' AS doc FROM supplier
"""


@query("s11_flatten_city_cache", "SELECT 'TX' AS state, 'town ' || s_suppkey AS city_lower, 'gas' AS utility_type, 'P' || s_suppkey AS name FROM supplier")
def _(t):
    return R.flatten_city_cache(t.city_docs)


BINDINGS["dictionary_docs"] = f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{{"C' || {as_text('p_partkey')} || '": {{"display_name": "Disp", "aliases": ["A' || {as_text('p_partkey')} || '", "Shared"], "eia_id": "' || {as_text('p_partkey')} || '.0"}}}}' ELSE '{{"C' || {as_text('p_partkey')} || '": ["B' || {as_text('p_partkey')} || '"]}}' END AS doc FROM part
"""


@query("s12_flatten_alias_index", """SELECT 'c' || p_partkey AS alias_lower, 'C' || p_partkey AS canonical_id, CASE WHEN p_partkey % 2 = 0 THEN 'Disp' ELSE 'C' || p_partkey END AS display_name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS INT) AS eia_id FROM part
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END || p_partkey, 'C' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Disp' ELSE 'C' || p_partkey END, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS INT) FROM part
UNION ALL SELECT 'shared', 'C' || max(p_partkey), 'Disp', CAST(max(p_partkey) AS INT) FROM part WHERE p_partkey % 2 = 0""")
def _(t):
    # The documents are read in part order: the last one to claim an alias has it.
    entries = R.read_dictionary(t.dictionary_docs).withColumn("ordinal", F.substr("canonical_id", F.lit(2)).cast("long"))
    return R.flatten_alias_index(entries).select("alias_lower", "canonical_id", "display_name", "eia_id")


BINDINGS["rep_docs"] = f"""
SELECT s_suppkey, '{{"reps": {{"Rep ' || {as_text('s_suppkey')} || '": {{"aliases": ["R' || {as_text('s_suppkey')} || '"]}}, "Lone ' || {as_text('s_suppkey')} || '": {{}}}}}}' AS doc FROM supplier
"""


@query("s14_flatten_reps", "SELECT 'rep ' || s_suppkey AS rep_lower, 'Rep ' || s_suppkey AS rep_name FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'Rep ' || s_suppkey FROM supplier UNION ALL SELECT 'lone ' || s_suppkey, 'Lone ' || s_suppkey FROM supplier")
def _(t):
    return R.flatten_reps(t.rep_docs)


@query("s15_parse_geocode_batch", """SELECT CAST(address_id AS VARCHAR) AS uid, address_id % 4 <> 0 AND address_id % 9 <> 0 AS matched, CASE WHEN address_id % 4 <> 0 AND address_id % 9 <> 0 THEN 32.5::DOUBLE END AS lat, CASE WHEN address_id % 4 <> 0 AND address_id % 9 <> 0 THEN (address_id % 50)::DOUBLE END AS lon,
 CASE WHEN address_id % 4 <> 0 AND address_id % 9 <> 0 THEN city END AS city, CASE WHEN address_id % 4 <> 0 AND address_id % 9 <> 0 AND address_id % 5 <> 0 THEN '480010001001' END AS block_geoid FROM addresses""")
def _(t):
    path = folder(t, "geocoded")
    i = F.col("address_id")
    rows = t.addresses.select(
        i.cast("string"), F.col("address"), F.when(i % 4 == 0, "No_Match").otherwise("Match"), F.lit("Exact"), F.concat(F.lit("1 MAIN ST, "), F.col("city"), F.lit(", TX, 75001")),
        F.when(i % 9 == 0, "bad").otherwise(F.concat((i % 50).cast("string"), F.lit(",32.5"))), F.lit("1"), F.lit("L"), F.lit("48"), F.when(i % 5 != 0, "001").otherwise(""), F.lit("0001"), F.lit("001"))
    rows.write.option("emptyValue", "").csv(path)
    return R.read_geocode_batch(t.spark, path).select("uid", "matched", "lat", "lon", "city", "block_geoid")


@query("s17_read_review_queue", "SELECT decision, count(*) AS n FROM reviewed GROUP BY 1")
def _(t):
    path = folder(t, "queue")
    reviewed(t).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    queue = R.read_review_queue(t.spark, path)
    return queue.groupBy(F.coalesce("`Mapper Decision`", F.lit("")).alias("decision")).agg(F.count("*").alias("n"))


@query("s18_write_results", "SELECT utility_type, comparison, count(*) AS n, count(DISTINCT address) AS addresses FROM results GROUP BY 1, 2")
def _(t):
    path = folder(t, "results")
    rows = result_alternatives(t)
    W.write_results(rows.where("row_id % 2 = 0"), path)
    W.write_results(rows.where("row_id % 2 = 1"), path)  # a resumed run appends
    return t.spark.read.parquet(path).groupBy("utility_type", "comparison").agg(F.count("*").alias("n"), F.count_distinct("address").alias("addresses"))


def simple_answers(t):
    ranked = V.rank_candidates(V.dedupe_and_boost(t.candidates))
    return V.primary_with_alternatives(ranked)


@query("s19_write_decision_log", "SELECT address_id, count(*) AS n_considered, CASE WHEN max(confidence) IS NOT NULL THEN 'chosen' END AS outcome FROM candidates GROUP BY 1")
def _(t):
    path = folder(t, "log")
    W.write_decision_log(t.candidates, simple_answers(t), path)
    schema = "address_id bigint, utility_type string, considered array<struct<source:string>>, selected struct<provider_name:string>, reason string"
    return t.spark.read.schema(schema).json(path).select("address_id", F.size("considered").cast("long").alias("n_considered"), F.when(F.col("selected").isNotNull(), "chosen").alias("outcome"))


BINDINGS["contact_docs"] = f"""
SELECT s_suppkey, '{{"Key ' || {as_text('s_suppkey')} || '": {{"phone": "5", "url": "u", "label": "gas", "match_method": "exact"}}}}' AS doc FROM supplier
"""


@query("s20_flatten_contacts", "SELECT 'Key ' || s_suppkey AS key, 'key ' || s_suppkey AS key_lower, '5' AS phone, 'u' AS url, 'gas' AS label, 'exact' AS match_method FROM supplier")
def _(t):
    return R.flatten_contacts(t.contact_docs).drop("ordinal")


BINDINGS["endpoint_docs"] = f"""
SELECT s_suppkey, '{{"electric": {{"S' || {as_text('s_suppkey')} || '": {{"layers": ["a", {{"url": "b"}}], "url": "x", "name_field": "N"}}}}, "gas": {{"S' || {as_text('s_suppkey')} || '": {{"url": "g", "name_field": "N", "filter_field": "K", "filter_value": "gas", "exclude_names": ["Z"], "fallback_url": "h", "fallback_name_field": "M", "confidence": 0.9}}, "H' || {as_text('s_suppkey')}
  || '": {{"type": "coordinate_mapping", "mappings": {{"Oahu": {{"name": "HECO", "lon_range": [-159, -157], "lat_min": 21}}}}}}}}, "water": {{"W' || {as_text('s_suppkey')} || '": {{"layers": [3, 7], "url": "http://x/{{layer}}/query", "name_field": "N", "filter_field": "A", "filter_value": "q", "exclude_names": ["Y"]}}, "V' || {as_text('s_suppkey')}
  || '": {{"url": "v", "name_field": "N", "filter_field": "F", "filter_value": 5}}}}}}' AS doc FROM supplier
"""


@query("s21_read_state_source_config", """SELECT utility_type, state || s_suppkey AS state, kind, layer_ordinal, layer, name_field, filter_text, CASE WHEN state = 'V' THEN '5' END AS filter_equal, CASE WHEN utility_type = 'gas' AND kind = 'arcgis' THEN 1 ELSE 0 END AS n_excluded, is_fallback, confidence FROM supplier, (VALUES ('electric', 'S', 'layers', 0, 'x', 'N', NULL, false, 0.92::DOUBLE), ('electric', 'S', 'layers', 1, 'b', 'N', NULL, false, 0.92::DOUBLE), ('gas', 'S', 'arcgis', 0, 'g', 'N', 'gas', false, 0.9::DOUBLE),
 ('water', 'W', 'layers', 0, 'http://x/3/query', 'N', NULL, false, 0.92::DOUBLE), ('water', 'W', 'layers', 1, 'http://x/7/query', 'N', NULL, false, 0.92::DOUBLE), ('water', 'V', 'arcgis', 0, 'v', 'N', NULL, false, 0.9::DOUBLE),
 ('gas', 'S', 'arcgis', 1, 'h', 'M', NULL, true, 0.9::DOUBLE), ('gas', 'H', 'coordinate_mapping', 0, NULL, NULL, NULL, false, 0.95::DOUBLE)) v(utility_type, state, kind, layer_ordinal, layer, name_field, filter_text, is_fallback, confidence)""")
def _(t):
    layers, _regions = R.flatten_state_sources(t.endpoint_docs)
    return layers.select("utility_type", "state", "kind", "layer_ordinal", "layer", "name_field", "filter_text", "filter_equal", F.size("exclude_names").alias("n_excluded"), "is_fallback", "confidence")


BINDINGS["stored_docs"] = f"""
SELECT address_id, '{{"address": "A' || {as_text('address_id')} || '", "lat": 1.5, "electric": {{"provider_name": "P' || {as_text('address_id % 9')} || '", "alternatives": [{{"provider": "Q", "confidence": 0.5}}]}}, "gas": null, "water": {{"provider_name": "W", "confidence": 0.8}}}}' AS result_json FROM addresses
"""


@query("s22_read_cached_results", "SELECT 'A' || address_id AS address, 1.5::DOUBLE AS lat, 0.0::DOUBLE AS lon, 'P' || address_id % 9 AS electric, 0.0::DOUBLE AS electric_confidence, 1 AS n_alternatives, CAST(NULL AS VARCHAR) AS gas, 0.8::DOUBLE AS water_confidence, 0 AS water_alternatives FROM stored_docs")
def _(t):
    df = R.read_cached_results(t.stored_docs)
    return df.select("address", "lat", "lon", F.col("electric.provider_name").alias("electric"), F.col("electric.confidence").alias("electric_confidence"), F.size("electric.alternatives").alias("n_alternatives"),
                     F.col("gas.provider_name").alias("gas"), F.col("water.confidence").alias("water_confidence"), F.size("water.alternatives").alias("water_alternatives"))


@query("s23_write_flat_results", "SELECT 'A' || address_id AS address, 'P' || address_id % 9 AS electric_provider, CAST(NULL AS VARCHAR) AS gas_provider, '0.8' AS water_confidence FROM stored_docs")
def _(t):
    path = folder(t, "flat")
    W.write_flat_results(R.read_cached_results(t.stored_docs), path)
    return t.spark.read.option("header", True).csv(path).select("address", "electric_provider", "gas_provider", "water_confidence")


# ---- resolution and the whole lookup -----------------------------------------
def state_index(t):
    return canonical_states(t.dictionary.select("canonical_id", "display_name", "alias"))


def eia_index(t):
    return t.aliases.where("eia_id IS NOT NULL").groupBy("eia_id").agg(F.min(F.struct("canonical_id", "display_name")).alias("e")).select("eia_id", "e.*")


BINDINGS["raw_candidates"] = f"""
SELECT p_partkey AS address_id, {pick('p_partkey % 3', ['electric', 'gas', 'water'])} AS utility_type, CAST(0 AS INT) AS source_ordinal, raw_name, {pick('p_partkey % 4', ['eia_zip', 'state_gis_tx', 'HIFLD', 'correction_zip'])} AS source, 'TX' AS candidate_state,
  CASE WHEN p_partkey % 5 = 0 THEN {as_text('p_partkey % 60')} || '.0' WHEN p_partkey % 5 = 1 THEN 'x' ELSE NULL END AS eia_id, CASE WHEN p_partkey % 4 = 0 THEN 7e-1 ELSE NULL END AS max_confidence, CASE WHEN p_partkey % 4 = 3 THEN 98e-2 ELSE NULL END AS set_confidence
FROM raw_names
"""


_shown = r"list_reduce(list_transform(regexp_extract_all(lower(v), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b)"
_bases = " ".join(f"WHEN {quoted(k)} THEN {v}::DOUBLE" for k, v in V.BASE_CONFIDENCE.items())
_tdus = "(" + " OR ".join(f"contains(upper(raw_name), {quoted(n)}) OR contains({quoted(n)}, upper(raw_name))" for n in rules.ERCOT_TDUS) + ")"
_public = "(contains(upper(coalesce(territory_type, '')), 'COOPERATIVE') OR contains(upper(coalesce(territory_type, '')), 'MUNICIPAL'))"
_area = "(upper(coalesce(cntrl_area, '')) IN ('ERCO', 'ERCOT') AND contains(upper(coalesce(territory_type, '')), 'INVESTOR'))"


def resolved_ctes(source: str) -> str:
    """Common table expressions from raw candidates (a table with raw_name, eia_id, cntrl_area, territory_type, ...) to ``resolved``:
    names and confidences, by the matching of distinct names."""
    bare = f"SELECT DISTINCT raw_name, trim(raw_name) AS v FROM {source} WHERE raw_name IS NOT NULL"
    for suffix in rules.LEGAL_SUFFIXES:
        bare = f"SELECT raw_name, CASE WHEN ends_with(upper(v), {quoted(suffix)}) THEN trim(left(v, len(v) - {len(suffix)})) ELSE v END AS v FROM ({bare}) x"
    names = f"SELECT raw_name AS name FROM {source} WHERE utility_type <> 'water' AND raw_name IS NOT NULL"
    return f"""{segment_ctes(names)}, {match_ctes('SELECT segment AS name FROM m_seg')},
 m_all AS (SELECT s.name, s.cleaned, pos, canonical_id, display_name, matched, match_type, similarity FROM m_seg s JOIN m_match m ON m.name = s.segment),
 best AS MATERIALIZED (SELECT name, canonical_id, display_name, matched, match_type, similarity FROM (
   SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, CASE WHEN matched THEN similarity END DESC, pos) AS rn FROM m_all) x WHERE rn = 1),
 by_eia AS MATERIALIZED (SELECT eia_id AS eid, min((canonical_id, display_name)) AS e FROM alias_index WHERE eia_id <> -1 GROUP BY eia_id),
 of_canon AS (SELECT e[1] AS canonical_id, min(eid) AS matched_eia FROM by_eia GROUP BY 1),
 in_states AS (SELECT canonical_id, list(DISTINCT w) AS states FROM (SELECT canonical_id, unnest(regexp_extract_all(upper(canonical_id || ' ' || display_name || ' ' || alias), '[^\\s,\\-().]+')) AS w FROM dictionary) q
   WHERE w IN {in_list(rules.STATE_CODES)} GROUP BY canonical_id),
 plain AS MATERIALIZED (SELECT raw_name, CASE WHEN v = upper(v) AND len(v) > 3 THEN {_shown} ELSE v END AS clean FROM ({bare}) y),
 asked AS (SELECT *, TRY_CAST(split_part(eia_id, '.', 1) AS INT) AS eid FROM {source}),
 known AS (SELECT a.* EXCLUDE (eia_id), e[1] AS id_canon, e[2] AS id_name, b.canonical_id AS name_canon, b.display_name AS name_shown, match_type, matched_eia, clean,
   CASE WHEN utility_type = 'water' THEN 'passthrough' WHEN e IS NOT NULL THEN 'eia_id' WHEN coalesce(matched AND (match_type <> 'fuzzy' OR similarity >= 95 OR (similarity >= 90 AND (coalesce(candidate_state, '') = ''
     OR list_contains(states, upper(trim(candidate_state)))))), false) THEN match_type ELSE 'passthrough' END AS match_method
   FROM asked a LEFT JOIN by_eia USING (eid) LEFT JOIN best b ON b.name = a.raw_name LEFT JOIN of_canon o ON o.canonical_id = b.canonical_id LEFT JOIN in_states s ON s.canonical_id = b.canonical_id LEFT JOIN plain p ON p.raw_name = a.raw_name),
 valued AS (SELECT *, coalesce(set_confidence, least(CASE WHEN utility_type = 'water' THEN {V.WATER_CONFIDENCE}::DOUBLE ELSE CASE match_method {_bases} END END, {V.MAX_CONFIDENCE}::DOUBLE, max_confidence)) AS c FROM known),
 resolved AS MATERIALIZED (SELECT * FROM (SELECT address_id, utility_type, source_ordinal, CASE match_method WHEN 'eia_id' THEN id_name WHEN 'passthrough' THEN clean ELSE name_shown END AS provider_name,
   CASE match_method WHEN 'eia_id' THEN id_canon WHEN 'passthrough' THEN NULL ELSE name_canon END AS canonical_id, CASE match_method WHEN 'eia_id' THEN eid WHEN 'passthrough' THEN NULL ELSE matched_eia END AS eia_id,
   CASE WHEN starts_with(source, 'state_gis') THEN greatest(c, 0.90::DOUBLE) ELSE c END AS confidence, match_method, source,
   utility_type <> 'water' AND CASE WHEN {_public} THEN contains(upper(raw_name), 'LUBBOCK') WHEN {_tdus} THEN true ELSE {_area} END AS is_deregulated FROM valued) r WHERE provider_name <> '')"""


@query("v1_resolve_candidate", f"WITH given AS (SELECT *, NULL::VARCHAR AS cntrl_area, NULL::VARCHAR AS territory_type FROM raw_candidates), {resolved_ctes('given')} SELECT * FROM resolved")
def _(t):
    out = V.resolve_candidates(t.raw_candidates, t.aliases, t.reps, state_index(t), eia_index(t))
    return out.drop("deregulated_note")


@query("v12_sewer_resolution")
def _(t):
    water = t.candidates.where("source_ordinal = 0 AND address_id % 4 <> 0").join(t.part.select(F.col("p_partkey").alias("k"), "p_name"), F.col("address_id") == F.col("k")).select(
        "address_id", F.col("p_name").alias("provider_name"), "confidence")
    out = V.sewer_resolution(t.addresses, water, prepared(t), catalog_overrides(t.id_corrections))
    return out.select("address_id", "provider_name", F.round("confidence", 6).alias("confidence"), "source", "needs_review")


def all_sources(t) -> Sources:
    _points, config, features = state_inputs(t)
    return Sources(
        aliases=t.aliases, states=state_index(t), eia_index=eia_index(t), reps=t.reps, territories=t.shapes.drop("cx", "cy", "r"),
        address_corrections=t.address_corrections, zip_corrections=t.zip_corrections,
        state_config=config, state_regions=t.regions, state_features=features,
        gas_mapping=t.gas_mapping, county_emc=t.county_emc, county_gas=t.county_gas, live_layer=t.live_layer,
        zip_dominance=t.zip_dominance, special_districts=t.special_districts, eia_zip=t.eia_zip, city_cache=t.city_cache,
        state_defaults=t.state_defaults, catalog=prepared(t), contacts=t.contacts, broadband=R.parse_broadband_json(t.broadband))


_none, _text = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"


def _branch(ordinal: int, rows: str, columns: str = "address_id, utility_type, raw_name, source, max_confidence, set_confidence, candidate_state", eia_id: str = _text) -> str:
    return f"SELECT {columns}, {eia_id} AS eia_id, {_text} AS cntrl_area, {_text} AS territory_type, CAST({ordinal} AS INT) AS source_ordinal FROM ({rows}) b{ordinal}"


def _territory(ordinal: int, utility_type: str, tag: str, rows: str) -> str:
    return f"""SELECT point_id, '{utility_type}', name, '{tag}', {_none}, {_none}, state, eia_id, cntrl_area, type, {ordinal} FROM ({rows}) b{ordinal} WHERE name IS NOT NULL"""


#: All sources in their order.  The county cooperatives (place 4) are asked in no state, as every state has polygons.
GATHERED = f"""{HITS}, {SCORED}, gathered AS MATERIALIZED ({" UNION ALL ".join([
    _branch(0, TEXTS["j5_correction_by_address"]), _branch(1, TEXTS["j6_correction_by_zip"]),
    _branch(2, "SELECT point_id AS address_id, 'electric' AS utility_type, name AS raw_name, source, state AS candidate_state FROM (" + TEXTS["j4_state_source_join"].replace("WHERE NOT (lat = 0 AND lon = 0)", "WHERE lat IS NOT NULL") + ") s JOIN addresses ON address_id = point_id",
            f"address_id, utility_type, raw_name, source, {_none} AS max_confidence, {_none} AS set_confidence, candidate_state"),
    _branch(3, TEXTS["j8_gas_zip_join"]), _branch(5, TEXTS["j9_county_gas_join"]),
    _territory(6, "electric", "HIFLD Electric Retail Service Territories", "SELECT * FROM electric"),
    _territory(7, "gas", "HIFLD Natural Gas Service Territories", "SELECT h.* FROM hits h JOIN (" + TEXTS["v6_resolve_overlap_gas"] + ") USING (point_id, territory_id)"),
    _territory(8, "water", "EPA CWS Boundaries", "SELECT h.* FROM hits h JOIN (" + TEXTS["v7_resolve_overlap_water"] + ") USING (point_id, territory_id)"),
    _branch(9, f"SELECT address_id, 'electric' AS utility_type, live_name AS raw_name, 'hifld_api' AS source, 0.78::DOUBLE AS max_confidence, {_none} AS set_confidence, coalesce(live_state, state) AS candidate_state FROM live_layer JOIN addresses USING (address_id)"),
    _branch(10, TEXTS["j11_zip_dominance_join"], f"address_id, utility_type, raw_name, source, table_confidence AS max_confidence, {_none} AS set_confidence, (SELECT state FROM addresses a WHERE a.address_id = b10.address_id) AS candidate_state"),
    _branch(11, TEXTS["j12_special_district_join"]), _branch(12, TEXTS["j13_eia_zip_join"].replace("'eia_zip' AS source", "'eia_zip' AS source, eiaid"), eia_id="eiaid"), _branch(13, TEXTS["j14_city_cache_join"]), _branch(14, TEXTS["j15_state_default_join"]),
])})"""

#: Candidates of one provider as one, ranked, the utility in doubt behind the local one, the leader checked against the registry.
ANSWERED = f"""keyed AS (SELECT r.*, coalesce(upper(i.canonical_id), upper(trim(provider_name))) AS k FROM resolved r LEFT JOIN alias_index i ON i.alias_lower = lower(regexp_replace(trim(provider_name), '\\s+', ' ', 'g'))),
 dd AS MATERIALIZED (SELECT * EXCLUDE (confidence, source), CASE WHEN n > 1 THEN least(0.98::DOUBLE, confidence + least(0.10, 0.05 * (n - 1))) ELSE confidence END AS confidence,
   CASE WHEN n > 1 AND low <> high THEN source || ' (+' || (n - 1) || ' agree)' ELSE source END AS source FROM (
   SELECT *, count(*) OVER w AS n, min(source_ordinal) OVER w AS first_ordinal, min(source) OVER w AS low, max(source) OVER w AS high,
     row_number() OVER (PARTITION BY address_id, utility_type, k ORDER BY confidence DESC, source_ordinal) AS rn FROM keyed WINDOW w AS (PARTITION BY address_id, utility_type, k)) q WHERE rn = 1),
 rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY address_id, utility_type ORDER BY confidence DESC, first_ordinal, provider_name) AS rank FROM dd),
 need AS (SELECT address_id, CASE WHEN contains(lower(source), 'eia_zip') THEN 0.55 WHEN contains(lower(source), 'state_gis') THEN 0.70 ELSE 0.60 END AS need FROM rk WHERE rank = 1 AND utility_type = 'electric' AND {has_any("upper(provider_name)", rules.LARGE_IOU_NAMES)}),
 pro AS (SELECT address_id, min(rank) AS p FROM rk JOIN need USING (address_id) WHERE utility_type = 'electric' AND rank > 1 AND {has_any("upper(provider_name)", rules.LOCAL_WORDS + rules.LOCAL_NAMES)} AND confidence >= need
   AND NOT contains(lower(source), 'findenergy_city') AND NOT contains(lower(source), 'state_gas_default') GROUP BY address_id),
 dm AS MATERIALIZED (SELECT rk.* EXCLUDE (rank), CASE WHEN rank = p THEN 1 WHEN rank < p THEN rank + 1 ELSE rank END AS rank FROM rk LEFT JOIN pro ON pro.address_id = rk.address_id AND utility_type = 'electric'),
 leaders AS (SELECT DISTINCT zip_code, provider_name FROM dm JOIN addresses USING (address_id) WHERE rank = 1 AND utility_type = 'electric' AND source NOT IN {in_list(V.NOT_VERIFIED_SOURCES)} AND zip_code IS NOT NULL),
 {VERIFY.replace('verify_pairs', 'leaders')},
 checked AS MATERIALIZED (SELECT dm.* EXCLUDE (confidence, eia_id), CASE WHEN v.zip_code IS NULL THEN confidence ELSE greatest(0, least(1, confidence + coalesce(gain, -0.05)::DOUBLE)) END AS confidence,
   coalesce(eia_id, CAST(v.eiaid AS INT)) AS eia_id FROM dm JOIN addresses a USING (address_id) LEFT JOIN verdict v ON rank = 1 AND utility_type = 'electric' AND source NOT IN {in_list(V.NOT_VERIFIED_SOURCES)} AND v.zip_code = a.zip_code AND v.provider_name = dm.provider_name),
 lead AS (SELECT * FROM checked WHERE rank = 1),
 alts AS (SELECT d.address_id, d.utility_type, string_agg(d.provider_name || '/' || round(d.confidence, 3)::DOUBLE, '|' ORDER BY d.rank) AS alternatives FROM checked d JOIN lead l USING (address_id, utility_type)
   WHERE d.rank BETWEEN 2 AND 5 AND upper(d.provider_name) <> upper(l.provider_name) AND NOT EXISTS (SELECT 1 FROM checked e WHERE e.address_id = d.address_id AND e.utility_type = d.utility_type AND e.rank BETWEEN 2 AND 5 AND e.rank < d.rank
     AND upper(e.provider_name) = upper(d.provider_name)) GROUP BY d.address_id, d.utility_type)"""


@query("v17_lookup_answers", f"""WITH {GATHERED}, {resolved_ctes('gathered')}, {ANSWERED}
SELECT address_id, utility_type, provider_name, canonical_id, eia_id, round(confidence, 6) AS confidence, match_method, source, is_deregulated, n AS n_agree, confidence < 0.7 AS needs_review, coalesce(alternatives, '') AS alternatives
FROM lead LEFT JOIN alts USING (address_id, utility_type)""")
def _(t):
    """The whole lookup from addresses to ranked answers; catalog ids, contacts and sewer are added by v17_lookup."""
    s = all_sources(t)
    s.catalog = s.contacts = None
    return answer_rows(lookup(t.addresses, s, base=BASE))


def answer_rows(answers):
    """Answers with their alternatives as text."""
    return answers.select("address_id", "utility_type", "provider_name", "canonical_id", "eia_id", F.round("confidence", 6).alias("confidence"), "match_method", "source", "is_deregulated", "n_agree", "needs_review",
                          F.array_join(F.transform("alternatives", lambda a: F.concat_ws("/", a["provider"], a["confidence"].cast("string"))), "|").alias("alternatives"))


@query("v17_lookup")
def _(t):
    answers = lookup(t.addresses, all_sources(t), base=BASE, sewer=True)
    return answers.withColumn("alternatives", F.array_join(F.transform("alternatives", lambda a: a["provider"]), "|"))


@query("v17_lookup_wide")
def _(t):
    s = all_sources(t)
    wide = lookup_wide(t.addresses, lookup(t.addresses, s, base=BASE, sewer=True), s)
    return wide.select("address_id", *[F.col(f"{u}.provider_name").alias(u) for u in ("electric", "gas", "water")], F.col("internet.provider_count").alias("internet_providers"))


# Stored answers per address and type, every other one wrong; what was reported is a name that some source may give now.
BINDINGS["stored_rows"] = f"""
SELECT c_custkey * 3 + k AS row_id, c_custkey AS address_id, {pick('k', ['electric', 'gas', 'water'])} AS utility_type, state,
  {pick('(c_custkey + k) % 7', ["=p_name || ' Energy'", "='Cached ' || p_name", "='City of ' || n_name", "='State gas ' || n_name", "=p_name || ' district'", 'landlord', '=upper(p_name)'])} AS tenant_raw,
  'Old ' || p_name AS engine_provider, CASE WHEN c_custkey % 2 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS comparison
FROM (SELECT *, @SERIES(3) AS k FROM customer_names) x
"""

RETESTED = f"""fresh AS MATERIALIZED (WITH {GATHERED}, {resolved_ctes('gathered')}, {ANSWERED} SELECT address_id, utility_type, provider_name, source FROM lead),
 again AS MATERIALIZED (SELECT s.row_id, s.address_id, s.utility_type, s.state, tenant_raw, s.engine_provider AS old_provider, CASE WHEN here THEN provider_name END AS engine_provider, CASE WHEN here THEN source END AS source, here
   FROM (SELECT s.*, NOT (lat = 0 AND lon = 0) AS here FROM stored_rows s JOIN addresses USING (address_id) WHERE comparison = 'MISMATCH') s LEFT JOIN fresh USING (address_id, utility_type)),
 again_rows AS (SELECT *, NULL::VARCHAR AS alt FROM again WHERE here), {compared_ctes('again_rows')},
 changes AS MATERIALIZED (SELECT a.*, c.comparison, CASE WHEN NOT here THEN 'no_coords' WHEN c.comparison IN {in_list(CORRECT)} THEN 'fixed' ELSE 'still_mismatch' END AS outcome FROM again a LEFT JOIN compared c USING (row_id))"""


def changed(t, rows):
    """The change set of wrong rows with the lookup as it is now, without catalog ids and contacts, which no comparison reads."""
    s = all_sources(t)
    s.catalog = s.contacts = None
    compare = lambda due: compare_providers(due, t.aliases, t.reps, t.rebrands, parent_table(t.spark))
    return retest.change_set(rows, t.addresses, lambda asked: lookup(asked, s, base=BASE), compare)


@query("c5_retest_changes", f"WITH {RETESTED} SELECT row_id, old_provider, engine_provider AS new_provider, source, comparison, outcome FROM changes")
def _(t):
    return changed(t, t.stored_rows.where("comparison = 'MISMATCH'")).select("row_id", "old_provider", "new_provider", "source", "comparison", "outcome")


@query("c5_retest_rows", f"""WITH {RETESTED} SELECT utility_type, state, coalesce(source, 'none') AS source, count(*) AS n, count(*) FILTER (WHERE outcome = 'fixed') AS fixed,
  count(*) FILTER (WHERE outcome = 'still_mismatch') AS still_mismatch, count(*) FILTER (WHERE outcome = 'no_coords') AS no_coords FROM changes GROUP BY 1, 2, 3""")
def _(t):
    return retest.outcome_counts(changed(t, t.stored_rows.where("comparison = 'MISMATCH'")))


def fix_rates(t, per_stratum: int):
    """Wrong rows sampled per type and state, tested again, and their fix rate carried over to all wrong rows."""
    wrong = cut_lineage(t.stored_rows.where("comparison = 'MISMATCH'"))
    changes = changed(t, report.stratified_sample(wrong, ["utility_type", "state"], "row_id", per_stratum))
    tested = changes.where("outcome <> 'no_coords'").select("utility_type", "state", (F.col("outcome") == "fixed").alias("fixed"))
    return report.stratified_fix_rate(wrong, tested).withColumn("fix_rate", F.round("fix_rate", 6))


@query("g18_stratified_fix_rate")
def _(t):
    return fix_rates(t, 20)


@query("g18_whole_fix_rate", f"""WITH {RETESTED}, sizes AS (SELECT utility_type, state, count(*) AS mismatches, row_number() OVER (PARTITION BY utility_type ORDER BY count(*) DESC, state) AS rn FROM stored_rows WHERE comparison = 'MISMATCH' GROUP BY 1, 2),
 rates AS (SELECT utility_type, state, count(*) AS tested, count(*) FILTER (WHERE outcome = 'fixed') AS fixed FROM changes WHERE here GROUP BY 1, 2)
SELECT utility_type, state, mismatches, tested, fixed, round(fixed::DOUBLE / tested, 6) AS fix_rate, CAST(floor(fixed::DOUBLE / tested * mismatches) AS BIGINT) AS projected FROM sizes JOIN rates USING (utility_type, state) WHERE rn <= 15""")
def _(t):
    """The same with strata taken whole."""
    return fix_rates(t, 1 << 30)


FLAGSHIP = f"""WITH {HITS}, {SCORED}, named AS (SELECT point_id, name FROM electric)
SELECT name AS provider, count(*) AS n_addresses, min(point_id) AS first_address FROM named GROUP BY name"""


@query("flagship_electric_by_provider", FLAGSHIP)
def flagship(t):
    """Points, territories, overlap rule, count per provider."""
    best = territory_candidates(t.addresses, t.shapes.drop("cx", "cy", "r"), "electric", BASE)
    return best.groupBy(F.col("raw_name").alias("provider")).agg(F.count("*").alias("n_addresses"), F.min("address_id").alias("first_address"))


@query("r0_build_dictionary")
def _(t):
    parents = t.canonicals.where("ordinal % 2 = 0").select(F.col("canonical_id").alias("child"), "parent_company")
    return build_dictionary(t.name_sources, t.brands, parents, t.auto_names)


# ---- streams -----------------------------------------------------------------
def event_stream(t):
    s = file_stream(t.spark, f"{t.folder}/events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


#: Micro-batches of the event log: ten days each; some rows of the six hours before a border come with the next one.
BATCHES = 3


def arriving_events(t):
    """The event log as a stream of several micro-batches with late rows, closed by a row without id that moves the watermark past all others."""
    if "_arrivals" not in t._cache:
        events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
        border = lambda i: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.lit(10 * i))
        late = F.when(F.col("event_id") % 3 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
        arrival = sum(((F.col("ts") + late >= border(i)).cast("int") for i in range(1, BATCHES)), F.lit(0))
        last = events.agg((F.max("ts") + F.expr("INTERVAL 48 HOURS")).alias("ts")).where("ts IS NOT NULL")
        rows = events.withColumn("arrival", F.coalesce(arrival, F.lit(0))).unionByName(last.withColumn("arrival", F.lit(BATCHES)), allowMissingColumns=True)
        t._cache["_arrivals"] = write_arrivals(rows, F.col("arrival"), BATCHES + 1)
    return arrivals(t.spark, t._cache["_arrivals"]).drop("arrival")


@query("t1_stream_lookup", f"WITH {HITS}, {SCORED} SELECT point_id AS address_id, name AS provider FROM electric")
def _(t):
    shapes = t.shapes.drop("cx", "cy", "r")
    stream = file_stream(t.spark, f"{t.folder}/customer.parquet").select(F.col("c_custkey").alias("address_id"))
    known = t.addresses.select("address_id", "state", "lat", "lon")

    def resolve(batch):
        located = batch.join(known, "address_id")
        return territory_candidates(located, shapes, "electric", BASE).select("address_id", F.col("raw_name").alias("provider"))

    return drain_batches(stream, resolve, "address_id bigint, provider string")


@query("t1_stream_whole_lookup", TEXTS["v17_lookup_answers"])
def _(t):
    """Three micro-batches of addresses through the whole lookup, all sources as published snapshots; equal to the batch lookup."""
    folder = shared_folder(t.spark)
    snapshots, sources = Snapshots(t.spark, os.path.join(folder, "sources"), Sources), all_sources(t)
    sources.catalog = sources.contacts = None
    snapshots.publish(sources)
    stream = arrivals(t.spark, write_arrivals(t.addresses, F.col("address_id") % BATCHES, BATCHES))
    out, progress = os.path.join(folder, "answers"), os.path.join(folder, "progress")
    writer = lookup_stream(stream, snapshots, lambda batch, s: lookup(batch, s, base=BASE), out, progress)
    writer.trigger(availableNow=True).start().awaitTermination()
    return answer_rows(answers(t.spark, out))


#: One row of a key after the other, by (ts, event_id), each step from the state that the row before left.
STEPS = "o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {0} ORDER BY ts, event_id) AS rn FROM events)"


@query("t2_stream_cache_ttl", f"""WITH {STEPS.replace("{0}", "user_id")},
k AS (SELECT *, CASE WHEN event_type = 'error' THEN 2 WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS kind FROM o),
s AS (SELECT user_id, rn, event_id, false AS cached, CASE WHEN kind < 2 THEN event_id END AS answered_by, CASE WHEN kind < 2 THEN event_id END AS id, CASE WHEN kind < 2 THEN us END AS since, CASE WHEN kind < 2 THEN kind END AS held FROM k WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, hit, CASE WHEN hit THEN id WHEN kind < 2 THEN event_id END, CASE WHEN hit OR kind = 2 THEN id ELSE event_id END, CASE WHEN hit OR kind = 2 THEN since ELSE us END, CASE WHEN hit OR kind = 2 THEN held ELSE kind END
  FROM (SELECT k.user_id, k.rn, k.event_id, k.kind, k.us, s.id, s.since, s.held, coalesce(k.us - s.since < CASE s.held WHEN 0 THEN 7776000000000 ELSE 86400000000 END, false) AS hit FROM s JOIN k ON k.user_id = s.user_id AND k.rn = s.rn + 1) n)
SELECT event_id AS request_id, user_id AS address_key, cached, answered_by FROM s""", recursive=True)
def _(t):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type").isin("view", "click"), "answer").otherwise("miss")
    s = arriving_events(t).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("address_key"), "ts", kind.alias("kind"))
    return drain(T.cache_lives(s)).withColumnRenamed("key", "address_key")


@query("t2_stream_first_requests", "SELECT DISTINCT user_id AS address_key FROM events")
def _(t):
    return drain(T.first_within_ttl(event_stream(t).select(F.col("user_id").alias("address_key"), "ts"))).select("address_key")


@query("t3_stream_single_use_token", "SELECT DISTINCT user_id || ':' || strftime(ts, '%Y-%m-%d %H:%M') AS token FROM events WHERE event_id % 120 <= 60")
def _(t):
    s = event_stream(t).select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("token"), "ts",
                               (F.col("ts") - F.make_dt_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))).alias("issued_ts"))
    return drain(T.single_use_tokens(s)).select("token")


@query("t4_stream_rate_limit", f"""WITH {STEPS.replace("{0}", "user_id")},
s AS (SELECT user_id, rn, event_id, [us] AS recent, true AS accepted, CAST(4 AS INT) AS remaining FROM o WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN len(live) < 5 THEN list_append(live, us) ELSE live END, len(live) < 5, CAST(greatest(0, 4 - len(live)) AS INT)
  FROM (SELECT o.user_id, o.rn, o.event_id, o.us, list_filter(s.recent, lambda x: x > o.us - 86400000000) AS live FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1) n)
SELECT event_id, 'u' || user_id AS email, accepted, remaining FROM s""", recursive=True)
def _(t):
    s = arriving_events(t).select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), "ts")
    return drain(T.rate_limit(s)).select("event_id", "email", "accepted", "remaining")


@query("t4_stream_recent_lookups", """SELECT a.event_id, CAST(least(5, count(b.event_id)) AS INT) AS n_before, count(b.event_id) >= 5 AS limited FROM events a
LEFT JOIN events b ON b.user_id = a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.ts > a.ts - INTERVAL 24 HOURS GROUP BY a.event_id""")
def _(t):
    return drain(T.recent_lookups(arriving_events(t).select("event_id", "user_id", "ts"), "user_id")).select("event_id", "n_before", "limited")


@query("t4_stream_rate_monitor", "SELECT CAST(epoch(date_trunc('hour', ts) - to_hours(k)) AS BIGINT) AS window_start, user_id, count(*) AS n FROM (SELECT *, unnest(range(0, 24)) AS k FROM events) q GROUP BY 1, 2")
def _(t):
    s = arriving_events(t).where("event_id IS NOT NULL")
    m = T.rate_monitor(s, "user_id").select(F.unix_timestamp("window.start").alias("window_start"), "user_id", "n")
    return drain_updates(m, ["window_start", "user_id"])


@query("t5_stream_cta_attribution", """
SELECT c.event_id AS click_id, CASE WHEN epoch_us(c.ts) - epoch_us(l.ts) <= 86400000000 THEN l.event_id END AS lookup_id FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN LATERAL (SELECT event_id, ts FROM events l WHERE l.user_id = c.user_id AND l.event_type <> 'click' AND l.ts <= c.ts ORDER BY ts DESC, event_id DESC LIMIT 1) l ON true
""")
def _(t):
    s = arriving_events(t).select("event_id", F.col("user_id").alias("email"), "ts", (F.col("event_type") == "click").alias("is_click"))
    return drain(T.attribute_clicks_stream(s)).select("click_id", "lookup_id")


@query("t6_stream_circuit_breaker", f"WITH {RUNS.replace('{0}', '7200')} SELECT call_id, source, run_length, disabled FROM cb")
def _(t):
    s = arriving_events(t).select(F.col("event_id").alias("call_id"), F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"), "ts", (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return drain(T.circuit_breaker(s, cooldown=7200))


@query("t7_stream_progress_metrics", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY 1")
def _(t):
    s = arriving_events(t).where("event_id IS NOT NULL").select("ts", (F.col("event_type") != "error").alias("ok"))
    m = T.progress_metrics(s).select(F.unix_timestamp("window_start").alias("window_start"), "n_rows", "n_failed")
    return drain_updates(m, ["window_start"])


def batch_runs(t):
    """The batch form of the breaker on the same calls (compared in the tests)."""
    return activity.failure_runs(t.source_calls, cooldown=7200).select("call_id", "source", "run_length", "disabled")
