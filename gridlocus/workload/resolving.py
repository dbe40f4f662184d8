"""Territories, keyed lookups and candidate resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.functions.address import address_key
from gridlocus.operators import lookups as L
from gridlocus.operators import resolve as V
from gridlocus.operators.projections import internet_projection
from gridlocus.operators import spatial as S
from gridlocus.sources.readers import parse_broadband_json
from gridlocus.workload.bindings import BINDINGS, STATES, pick
from gridlocus.workload.bindings import text as as_text
from gridlocus.workload.registry import has_any, in_list, query, quoted

BASE = 1.0  # grid size of the test plane
PTS = "pts AS MATERIALIZED (SELECT address_id AS point_id, lon AS x, lat AS y, state AS address_state FROM addresses WHERE NOT (lat = 0 AND lon = 0))"
HITS = PTS + """, hits AS MATERIALIZED (SELECT point_id, address_state, t.* FROM pts JOIN territories t ON x BETWEEN cx - r AND cx + r AND y BETWEEN cy - r AND cy + r AND abs(x - cx) + abs(y - cy) < r)"""


@query("j1_point_in_territory", f"WITH {HITS} SELECT point_id, territory_id, layer, name FROM hits")
def _(t):
    return S.point_in_territory(t.points, t.shapes, BASE).select("point_id", "territory_id", "layer", "name")


@query("j2_bbox_candidates", f"WITH {PTS} SELECT point_id, territory_id FROM pts JOIN territories ON x BETWEEN cx - r AND cx + r AND y BETWEEN cy - r AND cy + r")
def _(t):
    return S.bbox_candidates(t.points, t.shapes, BASE).select("point_id", "territory_id")


@query("k5_area_ascending", f"""WITH {HITS} SELECT point_id, territory_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY area_km2 ASC NULLS LAST, territory_id) AS INT) AS hit_rank FROM hits WHERE layer = 'water'""")
def _(t):
    hits = S.point_in_territory(t.points, t.shapes.where("layer = 'water'"), BASE)
    return S.rank_hits(hits).select("point_id", "territory_id", "hit_rank")


@query("s3_prepare_territories", "SELECT territory_id, round(2 * r * r, 6) AS area, round(cx - r, 6) AS xmin, round(cx + r, 6) AS xmax, round(cy - r, 6) AS ymin, round(cy + r, 6) AS ymax, 5 AS corners FROM territories")
def _(t):
    return t.shapes.select("territory_id", F.round(S.ring_area(F.col("rings")), 6).alias("area"), F.round("bbox.xmin", 6).alias("xmin"), F.round("bbox.xmax", 6).alias("xmax"),
                           F.round("bbox.ymin", 6).alias("ymin"), F.round("bbox.ymax", 6).alias("ymax"), F.size(F.col("rings")[0]).alias("corners"))


# Two parts and a hole with an island, wound as the key says; areas in closed form.
def _square(x, y, half, turned):
    corner = lambda dx, dy: F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))
    around = [corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)]
    return F.when(turned, F.array(*around[::-1])).otherwise(F.array(*around))


@query("s3_multipart_areas", """SELECT territory_id, round((4 - 1 + 0.25 + 0.25) * r * r, 6) AS area, 4 AS n_rings, round(cx + 2.5 * r, 6) AS xmax FROM territories""")
def _(t):
    x, y, r, k = F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("r"), F.col("territory_id")
    rings = F.array(_square(x, y, r / 4, k % 5 == 1), _square(x, y, r, k % 2 == 1), _square(x + 2.25 * r, y, r / 4, k % 7 == 1), _square(x, y, r / 2, k % 3 == 1))
    shaped = S.prepare_territories(t.territories.select("territory_id", rings.alias("rings")))
    return shaped.select("territory_id", F.round(S.ring_area(F.col("rings")), 6).alias("area"), F.size("rings").alias("n_rings"), F.round("bbox.xmax", 6).alias("xmax"))


@query("s3_mercator_territories", "SELECT territory_id, round((cx - 5000) / 100.0, 6) AS xmin, round((cx - 5000) / 100.0 + r, 6) AS xmax, round(cy / 200.0 - r, 6) AS ymin, round(cy / 200.0, 6) AS ymax FROM territories")
def _(t):
    """Territories given in Web Mercator metres come out in degrees."""
    lon, lat, r = (F.col("cx") - 5000) / 100.0, F.col("cy") / 200.0, F.col("r")
    metres = lambda x, y: F.struct((F.radians(x) * 6378137.0).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2)) * 6378137.0).alias("y"))
    ring = F.array(metres(lon, lat - r), metres(lon + r, lat - r), metres(lon + r, lat), metres(lon, lat))
    shaped = S.prepare_territories(t.territories.select("territory_id", F.array(ring).alias("rings")), mercator=True)
    return shaped.select("territory_id", *[F.round(f"bbox.{c}", 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


_iou = has_any("upper(name)", rules.LARGE_IOU_NAMES)
SCORED = f"""sc AS (SELECT *, type IN ('COOPERATIVE', 'MUNICIPAL') AS pub, {_iou} AS iou, coalesce(customers, 0) AS c, coalesce(nullif(area_km2, 0), 1) AS a,
   CASE upper(name) {' '.join(f'WHEN {quoted(k)} THEN {v}' for k, v in rules.TDU_PRIORITY.items())} END AS prio FROM hits WHERE layer = 'electric'),
 s2 AS (SELECT *, prio IS NOT NULL AND NOT pub AS tdu,
   (CASE WHEN c = 0 THEN CASE WHEN a < 5000 THEN 1e7 / a ELSE 100.0 / a END ELSE c END)
   * CASE WHEN a < 1000 AND c > 1000 THEN 2.0 WHEN a < 5000 AND c > 50000 THEN 1.5 ELSE 1 END * CASE WHEN type = 'MUNICIPAL' AND c > 50000 THEN 1.5 ELSE 1 END
   * CASE WHEN type = 'COOPERATIVE' THEN CASE WHEN a < 3000 THEN 1.5 WHEN a > 10000 THEN 0.3 ELSE 1 END WHEN type = 'NOT AVAILABLE' AND a > 10000 THEN 0.2 ELSE 1 END
   * CASE WHEN iou THEN 0.5 ELSE 1 END * CASE WHEN a > 50000 THEN 0.1 WHEN a > 20000 AND c < 10000 THEN 0.3 ELSE 1 END AS score FROM sc),
 s3 AS (SELECT *, row_number() OVER w AS area_rank, row_number() OVER (PARTITION BY point_id ORDER BY round(score, 6) DESC, area_km2 ASC NULLS LAST, territory_id) AS score_rank,
   count(*) OVER (PARTITION BY point_id) AS n, bool_or(upper(state) = 'TX' OR prio IS NOT NULL) OVER (PARTITION BY point_id) AS texas, bool_or(iou AND NOT pub) OVER (PARTITION BY point_id) AS has_iou,
   bool_or(tdu) OVER (PARTITION BY point_id) AS has_tdu FROM s2 WINDOW w AS (PARTITION BY point_id ORDER BY area_km2 ASC NULLS LAST, territory_id)),
 s4 AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN texas THEN CASE WHEN has_tdu THEN CASE WHEN pub AND area_km2 < 5000 THEN area_rank WHEN tdu THEN 10000 + prio * 1000 + area_rank END ELSE CASE WHEN pub THEN area_rank ELSE 10000 + area_rank END END
   ELSE CASE WHEN has_iou AND pub AND coalesce(area_km2, 0) < 5000 THEN area_rank ELSE 10000 + score_rank END END AS pref FROM s3),
 electric AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY pref NULLS LAST) AS rn FROM s4) q WHERE rn = 1)"""


@query("v4_resolve_overlap_electric", f"WITH {HITS}, {SCORED} SELECT point_id, n AS n_hits, territory_id FROM electric WHERE NOT texas")
def _(t):
    hits = electric_hits(t)
    picked = S.resolve_electric(hits)
    texas = hits.groupBy("point_id").agg(F.bool_or((F.col("state") == "TX") | F.upper("name").isin(list(rules.TDU_PRIORITY))).alias("texas"))
    return picked.join(texas.where("NOT texas"), "point_id").select("point_id", "n_hits", "territory_id")


def electric_hits(t):
    return S.point_in_territory(t.points.drop("address_state"), t.shapes.where("layer = 'electric'").drop("layer", "cx", "cy", "r"), BASE).drop("x", "y")


@query("v5_resolve_overlap_tdu", f"WITH {HITS}, {SCORED} SELECT point_id, n AS n_hits, territory_id FROM electric WHERE texas")
def _(t):
    hits = electric_hits(t)
    picked = S.resolve_electric(hits)
    texas = hits.groupBy("point_id").agg(F.bool_or((F.col("state") == "TX") | F.upper("name").isin(list(rules.TDU_PRIORITY))).alias("texas"))
    return picked.join(texas.where("texas"), "point_id").select("point_id", "n_hits", "territory_id")


@query("v6_resolve_overlap_gas", f"""WITH {HITS} SELECT point_id, territory_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN state = address_state THEN 0 ELSE 1 END, area_km2 ASC NULLS LAST, territory_id) AS rn
  FROM hits WHERE layer = 'gas') q WHERE rn = 1""")
def _(t):
    hits = S.point_in_territory(t.points, t.shapes.where("layer = 'gas'"), BASE)
    return S.resolve_gas(hits).select("point_id", "territory_id")


@query("v7_resolve_overlap_water", f"""WITH {HITS} SELECT point_id, territory_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY nullif(area_km2, 0) ASC NULLS LAST, territory_id) AS rn
  FROM hits WHERE layer = 'water') q WHERE rn = 1""")
def _(t):
    hits = S.point_in_territory(t.points, t.shapes.where("layer = 'water'"), BASE)
    return S.resolve_water(hits, keep=("address_state",)).select("point_id", "territory_id")


# ---- state layers ------------------------------------------------------------
BINDINGS["regions"] = f"""
SELECT {pick('n_nationkey % 10', STATES)} AS state, 'electric' AS utility_type, CAST(n_nationkey AS INT) AS ordinal, n_nationkey * 1e0 AS lon_min, n_nationkey * 1e0 + 60 AS lon_max,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 0e0 ELSE 40e0 END AS lat_min, 'Region ' || n_name AS name FROM nation
"""
BINDINGS["state_config"] = f"""
SELECT u AS utility_type, state, kind, CAST(layer_ordinal AS INT) AS layer_ordinal, filter_text, is_fallback, 9e-1 AS confidence, CASE WHEN kind = 'single_utility' THEN 'Single ' || state END AS default_name FROM (
  SELECT DISTINCT 'electric' AS u, {pick('n_nationkey % 10', STATES)} AS state, {pick('n_nationkey % 10', ['coordinate_mapping', 'single_utility', 'layers', 'arcgis', 'arcgis', 'layers', 'coordinate_mapping', 'single_utility', 'layers', 'arcgis'])} AS kind,
    k AS layer_ordinal, CASE WHEN n_nationkey % 10 = 4 AND k = 0 THEN 'coop' END AS filter_text, n_nationkey % 10 IN (3, 4, 9) AND k = 1 AS is_fallback
  FROM (SELECT *, @SERIES(2) AS k FROM nation) z) y
"""
# Every electric territory is a feature of every state whose sources have polygons.
_features = "SELECT c.state, 'electric' AS utility_type, CAST(territory_id % 2 AS INT) AS layer_ordinal, territory_id AS feature_ordinal, name, type AS filter_value, cx, cy, r FROM territories t JOIN (SELECT DISTINCT state FROM state_config WHERE kind IN ('layers', 'arcgis')) c ON territory_id % 3 = 0 WHERE layer = 'electric'"


@query("j3_region_by_coordinate", f"""WITH {PTS} SELECT point_id, state, name FROM (SELECT point_id, state, name, row_number() OVER (PARTITION BY point_id ORDER BY ordinal) AS rn FROM pts JOIN regions ON state = address_state
  AND x BETWEEN lon_min AND lon_max AND (lat_min IS NULL OR lat_min = 0 OR y >= lat_min)) q WHERE rn = 1""")
def _(t):
    pts = t.points.withColumnRenamed("address_state", "state").withColumn("utility_type", F.lit("electric"))
    return S.region_by_coordinate(pts, t.regions).select("point_id", "state", "name")


_shown = ", ".join(f"'{n}'" for n in ["DUKE ENERGY CAROLINAS, LLC"])


@query("j4_state_source_join", f"""WITH {PTS}, feats AS MATERIALIZED ({_features}),
 cfg AS (SELECT DISTINCT state, kind, default_name FROM state_config),
 single AS (SELECT point_id, default_name AS name, false AS fb FROM pts JOIN cfg ON state = address_state AND kind = 'single_utility'),
 mapped AS (SELECT point_id, name, false AS fb FROM (SELECT point_id, r.name, row_number() OVER (PARTITION BY point_id ORDER BY ordinal) AS rn FROM pts JOIN cfg ON cfg.state = address_state AND kind = 'coordinate_mapping'
    JOIN regions r ON r.state = address_state AND x BETWEEN lon_min AND lon_max AND (lat_min IS NULL OR lat_min = 0 OR y >= lat_min)) q WHERE rn = 1),
 lay AS (SELECT point_id, f.layer_ordinal, is_fallback AS fb, f.name, c.kind, row_number() OVER (PARTITION BY point_id, f.layer_ordinal ORDER BY feature_ordinal) AS rn FROM pts JOIN feats f ON f.state = address_state
    AND abs(x - cx) + abs(y - cy) <= r JOIN state_config c ON c.state = f.state AND c.layer_ordinal = f.layer_ordinal AND (filter_text IS NULL OR c.kind = 'layers' OR contains(lower(filter_value), filter_text))),
 layered AS (SELECT point_id, name, fb FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY layer_ordinal) AS r2 FROM lay WHERE rn = 1 AND (kind = 'layers' OR name NOT IN ({_shown}))) q WHERE r2 = 1)
SELECT point_id, name, 'state_gis_' || lower(address_state) || CASE WHEN fb THEN '_fallback' ELSE '' END AS source FROM (SELECT * FROM single UNION ALL SELECT * FROM mapped UNION ALL SELECT * FROM layered) a JOIN pts USING (point_id)""")
def _(t):
    points, config, features = state_inputs(t)
    return S.state_source_join(points, config, t.regions, features, BASE).select("point_id", "name", "source")


def state_inputs(t):
    features = t.sql(_features)
    features = features.withColumn("rings", S.close_rings(F.array(F.array(*[
        F.struct((F.col("cx") + dx * F.col("r")).alias("x"), (F.col("cy") + dy * F.col("r")).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])))).drop("cx", "cy", "r")
    config = t.state_config.withColumn("exclude_names", F.array(F.lit("DUKE ENERGY CAROLINAS, LLC")))
    points = t.points.withColumnRenamed("address_state", "state").withColumn("utility_type", F.lit("electric"))
    return points, config, features


# ---- keyed lookups -----------------------------------------------------------
OUT = ["address_id", "utility_type", "raw_name", "source", "table_confidence", "max_confidence", "set_confidence", "candidate_state"]


def out(df):
    return df.select(*OUT)


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, utility_type ORDER BY corrected_at DESC, correction_id DESC) AS rn FROM address_corrections) q WHERE rn = 1)"
NONE = "CAST(NULL AS DOUBLE)"


@query("j5_correction_by_address", f"WITH {LATEST} SELECT address_id, utility_type, corrected_provider AS raw_name, 'correction_address' AS source, 0.99::DOUBLE AS table_confidence, {NONE} AS max_confidence, 0.99::DOUBLE AS set_confidence, l.state AS candidate_state FROM addresses a JOIN latest l ON l.address = a.address")
def _(t):
    return out(L.correction_by_address(t.addresses, t.address_corrections))


@query("j6_correction_by_zip", f"""WITH {LATEST}, hit AS (SELECT address_id, utility_type FROM addresses a JOIN latest l ON l.address = a.address)
SELECT a.address_id, z.utility_type, provider AS raw_name, 'correction_zip' AS source, 0.98::DOUBLE AS table_confidence, {NONE} AS max_confidence, 0.98::DOUBLE AS set_confidence, state AS candidate_state
FROM addresses a JOIN zip_corrections z USING (zip_code) ANTI JOIN hit h ON h.address_id = a.address_id AND h.utility_type = z.utility_type""")
def _(t):
    return out(L.correction_by_zip(t.addresses, t.zip_corrections, L.correction_by_address(t.addresses, t.address_corrections)))


BINDINGS["fix_points"] = f"""
SELECT event_id AS correction_id, (user_id % 50) / 1e1 + (event_id % 7) / 2e3 AS lat, (user_id % 40) / 1e1 + (event_id % 5) / 2e3 AS lon, {pick('event_id % 2', ['electric', 'gas'])} AS utility_type, 'Fix ' || {as_text('event_id')} AS corrected_provider, ts AS corrected_at
FROM events WHERE event_type IN ('signup', 'purchase')
"""
BINDINGS["asked_points"] = f"""
SELECT event_id AS point_id, (user_id % 50) / 1e1 + (event_id % 11) / 4e3 AS lat, (user_id % 40) / 1e1 + (event_id % 3) / 2e3 AS lon, {pick('event_id % 2', ['gas', 'electric'])} AS utility_type FROM events WHERE event_type = 'view'
"""


@query("j7_correction_near_point", """
SELECT point_id, utility_type, corrected_provider FROM (SELECT p.point_id, p.utility_type, corrected_provider, row_number() OVER (PARTITION BY p.point_id ORDER BY corrected_at DESC, correction_id DESC) AS rn
FROM asked_points p JOIN fix_points c ON c.utility_type = p.utility_type AND abs(c.lat - p.lat) < 1e-3 AND abs(c.lon - p.lon) < 1e-3) q WHERE rn = 1
""")
def _(t):
    return S.correction_near_point(t.asked_points, t.fix_points).select("point_id", "utility_type", "corrected_provider")


@query("j8_gas_zip_join", f"""
SELECT address_id, 'gas' AS utility_type, name AS raw_name, 'gas_zip_mapping_' || lower(state) || CASE WHEN key_kind = 'ambiguous' THEN '_ambiguous' ELSE '' END AS source,
  CASE key_kind WHEN 'override' THEN 0.93::DOUBLE WHEN 'ambiguous' THEN 0.8::DOUBLE ELSE 0.88::DOUBLE END AS table_confidence, {NONE} AS max_confidence, {NONE} AS set_confidence, state AS candidate_state
FROM (SELECT address_id, a.state, name, key_kind, row_number() OVER (PARTITION BY address_id ORDER BY CASE key_kind WHEN 'override' THEN 1 WHEN 'ambiguous' THEN 2 ELSE 3 END) AS rn
  FROM addresses a JOIN gas_mapping m ON m.state = a.state AND ((key_kind <> 'prefix' AND key = zip_code) OR (key_kind = 'prefix' AND key = substr(zip_code, 1, 3)))) q WHERE rn = 1
""")
def _(t):
    return out(L.gas_zip_join(t.addresses, t.gas_mapping))


@query("j9_county_gas_join", """
SELECT address_id, 'gas' AS utility_type, utility AS raw_name, 'county_gas_' || lower(state) || CASE kind WHEN 'county' THEN '' ELSE '_' || kind END AS source, conf AS table_confidence, conf AS max_confidence, CAST(NULL AS DOUBLE) AS set_confidence, state AS candidate_state
FROM (SELECT *, CASE kind WHEN 'city' THEN 0.88::DOUBLE WHEN 'county' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS conf FROM (SELECT address_id, a.state, utility, kind, row_number() OVER (PARTITION BY address_id ORDER BY CASE kind WHEN 'city' THEN 1 WHEN 'county' THEN 2 ELSE 3 END) AS rn
  FROM addresses a JOIN county_gas g ON g.state = a.state AND ((kind = 'city' AND key_lower = lower(city)) OR (kind = 'county' AND key_lower = lower(replace(county, ' County', ''))) OR kind = 'default')) q WHERE rn = 1) z
""")
def _(t):
    return out(L.county_gas_join(t.addresses, t.county_gas))


@query("j10_county_emc_join", """
SELECT address_id, 'electric' AS utility_type, emc AS raw_name, 'georgia_emc' AS source, round(conf, 6) AS table_confidence, 'GA' AS candidate_state
FROM (SELECT address_id, emc, CASE WHEN n = 1 THEN 0.87::DOUBLE ELSE greatest(0.72::DOUBLE - 0.05 * pos, 0.5::DOUBLE) END AS conf FROM addresses a JOIN county_emc e ON e.county = replace(a.county, ' County', '') WHERE state = 'GA') q
""")
def _(t):
    return L.county_emc_join(t.addresses, t.county_emc).select("address_id", "utility_type", "raw_name", "source", F.round("table_confidence", 6).alias("table_confidence"), "candidate_state")


@query("j10b_county_emc_primary", "SELECT county, arg_min(emc, pos) AS name, CASE WHEN count(*) = 1 THEN 0.87::DOUBLE ELSE 0.72::DOUBLE END AS confidence, coalesce(string_agg(emc, '|' ORDER BY pos) FILTER (WHERE pos > 0), '') AS others FROM county_emc GROUP BY county")
def _(t):
    return L.county_emc_primary(t.county_emc).select("county", "name", "confidence", F.array_join("alternatives", "|").alias("others"))


@query("j11_zip_dominance_join", """
SELECT address_id, utility_type, name AS raw_name, 'remaining_states_' || utility_type AS source, round(CASE WHEN sample_count >= 20 THEN least(c + 0.03, 0.85::DOUBLE) ELSE c END, 6) AS table_confidence FROM (
 SELECT address_id, utility_type, name, sample_count, CASE WHEN lv = 'high' AND dominance_pct >= 90 THEN 0.82::DOUBLE WHEN lv = 'high' THEN 0.78::DOUBLE WHEN lv = 'medium' AND dominance_pct >= 80 THEN 0.75::DOUBLE WHEN lv = 'medium' THEN 0.72::DOUBLE ELSE 0.65::DOUBLE END AS c
 FROM (SELECT a.address_id, z.*, coalesce(confidence_level, 'medium') AS lv FROM addresses a JOIN zip_dominance z ON z.state = a.state AND zip = zip_code) q) q2
""")
def _(t):
    return L.zip_dominance_join(t.addresses, t.zip_dominance).select("address_id", "utility_type", "raw_name", "source", F.round("table_confidence", 6).alias("table_confidence"))


@query("j12_special_district_join", "SELECT address_id, 'water' AS utility_type, name AS raw_name, 'special_districts' AS source, 0.82::DOUBLE AS table_confidence, 0.82::DOUBLE AS max_confidence, CAST(NULL AS DOUBLE) AS set_confidence, s.state AS candidate_state FROM addresses JOIN special_districts s ON zip = zip_code")
def _(t):
    return out(L.special_district_join(t.addresses, t.special_districts))


@query("j13_eia_zip_join", "SELECT address_id, 'electric' AS utility_type, name AS raw_name, 'eia_zip' AS source, 0.7::DOUBLE AS table_confidence, 0.7::DOUBLE AS max_confidence, CAST(NULL AS DOUBLE) AS set_confidence, e.state AS candidate_state FROM addresses JOIN eia_zip e ON zip = zip_code AND pos = 0")
def _(t):
    return out(L.eia_zip_join(t.addresses, t.eia_zip))


@query("j14_city_cache_join", "SELECT address_id, utility_type, name AS raw_name, 'findenergy_city' AS source, 0.65::DOUBLE AS table_confidence, 0.65::DOUBLE AS max_confidence, CAST(NULL AS DOUBLE) AS set_confidence, a.state AS candidate_state FROM addresses a JOIN city_cache c ON c.state = a.state AND city_lower = lower(city) WHERE utility_type IN ('electric', 'gas')")
def _(t):
    return out(L.city_cache_join(t.addresses, t.city_cache))


@query("j15_state_default_join", "SELECT address_id, 'gas' AS utility_type, provider AS raw_name, 'state_gas_default' AS source, coalesce(confidence, 0.45::DOUBLE) AS table_confidence, coalesce(confidence, 0.45::DOUBLE) AS max_confidence, CAST(NULL AS DOUBLE) AS set_confidence, a.state AS candidate_state FROM addresses a JOIN state_defaults d ON d.state = a.state AND provider IS NOT NULL")
def _(t):
    return out(L.state_default_join(t.addresses, t.state_defaults))


# ---- contacts, broadband, geocoding, cache -----------------------------------
BINDINGS["providers_asked"] = f"""
SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE canonical_id END AS canonical_id, CASE WHEN c_custkey % 3 = 0 THEN canonical_id ELSE display_name END AS provider_name, {pick('c_custkey % 3', ['electric', 'gas', 'water'])} AS utility_type
FROM customer JOIN part ON p_partkey = c_custkey JOIN canonicals ON canonical_id = p_name
"""


def _contact_probes() -> str:
    rows = ["SELECT *, 1 AS step, canonical_id AS k, false AS folded, 'typed' AS rule FROM providers_asked", "SELECT *, 2, provider_name, false, 'typed' FROM providers_asked",
            "SELECT *, 3, lower(provider_name), true, 'typed' FROM providers_asked", "SELECT *, 90, canonical_id, false, 'any' FROM providers_asked",
            "SELECT *, 91, provider_name, false, 'any' FROM providers_asked", "SELECT *, 92, lower(provider_name), true, 'any' FROM providers_asked"]
    for u, suffixes in rules.CONTACT_SUFFIXES.items():
        for i, s in enumerate(suffixes):
            for j, joint in enumerate(" -"):
                step = 10 + 4 * i + 2 * j
                rows.append(f"SELECT *, {step}, provider_name || {quoted(joint + s)}, false, 'free' FROM providers_asked WHERE utility_type = {quoted(u)}")
                rows.append(f"SELECT *, {step + 1}, lower(provider_name || {quoted(joint + s)}), true, 'free' FROM providers_asked WHERE utility_type = {quoted(u)}")
    return " UNION ALL ".join(rows)


@query("j18_contact_join", f"""WITH probes AS ({_contact_probes()}), low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key_lower ORDER BY ordinal DESC) AS rn FROM contacts) q WHERE rn = 1),
 found AS (SELECT p.*, c.phone, c.url, c.label, c.match_method FROM probes p JOIN contacts c ON NOT folded AND k = key UNION ALL SELECT p.*, c.phone, c.url, c.label, c.match_method FROM probes p JOIN low c ON folded AND k = key_lower),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, provider_name, utility_type ORDER BY step) AS rn FROM found WHERE rule = 'free' OR (rule = 'typed' AND coalesce(label, utility_type) = utility_type)
   OR (rule = 'any' AND (match_method <> 'substring' OR coalesce(label, utility_type) = utility_type))) q WHERE rn = 1)
SELECT a.canonical_id, a.provider_name, a.utility_type, phone, url AS website FROM providers_asked a LEFT JOIN best b ON a.canonical_id IS NOT DISTINCT FROM b.canonical_id AND a.provider_name = b.provider_name AND a.utility_type = b.utility_type""")
def _(t):
    return L.contact_join(t.providers_asked, t.contacts)


BINDINGS["live_layer"] = f"""
SELECT c_custkey AS address_id, CAST(k AS INT) AS live_pos, CASE k WHEN 0 THEN 'Other ' || n_name WHEN 1 THEN upper(split_part(p_name, ' ', 1)) || ' POWER' ELSE p_name || ' Energy' END AS live_name, state AS live_state, {as_text('c_custkey')} AS telephone, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'w' END AS live_website
FROM (SELECT *, @SERIES(3) AS k FROM customer_names WHERE c_custkey % 4 = 1) x
"""
BINDINGS["plain_primaries"] = f"""
SELECT c_custkey AS address_id, p_name AS provider_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '1' END AS phone, CASE WHEN c_custkey % 5 = 0 THEN 'site' END AS website FROM customer_names
"""


@query("j19_contact_backfill", """
SELECT p.address_id, provider_name, coalesce(phone, nullif(telephone, '')) AS phone, coalesce(website, nullif(live_website, '')) AS website FROM plain_primaries p LEFT JOIN (
  SELECT * FROM (SELECT q.address_id, telephone, live_website, row_number() OVER (PARTITION BY q.address_id ORDER BY live_pos) AS rn FROM plain_primaries q JOIN live_layer l ON l.address_id = q.address_id AND (q.phone IS NULL OR q.website IS NULL)
   AND (contains(upper(provider_name), upper(live_name)) OR contains(upper(live_name), upper(provider_name)) OR split_part(upper(live_name), ' ', 1) = split_part(upper(provider_name), ' ', 1))) z WHERE rn = 1) l ON l.address_id = p.address_id
""")
def _(t):
    return L.contact_backfill(t.plain_primaries, t.live_layer)


@query("j20_broadband_join", "SELECT address_id, block_geoid, providers FROM addresses JOIN broadband USING (block_geoid)")
def _(t):
    return L.broadband_join(t.addresses.select("address_id", "block_geoid"), t.broadband).select("address_id", "block_geoid", "providers")


@query("s16_parse_broadband_json", """
SELECT block_geoid, CAST(coalesce(json_array_length(p), 0) AS INT) AS n, p ->> '$[0].name' AS first_name, CAST(p ->> '$[0].down' AS INT) AS first_down FROM (SELECT block_geoid, CASE WHEN providers LIKE '{%' THEN '[' || providers || ']' ELSE providers END AS p FROM broadband) q
""")
def _(t):
    return parse_broadband_json(t.broadband).select("block_geoid", F.size("providers").alias("n"), F.col("providers")[0]["name"].alias("first_name"), F.col("providers")[0]["down"].alias("first_down"))


_order = "CASE tech " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(rules.TECH_ORDER)) + " ELSE 99 END"
_labels = "CASE tech " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in rules.TECH_LABELS.items()) + " ELSE 'Unknown (' || tech || ')' END"


@query("v15_broadband_summary", f"""
WITH e AS (SELECT block_geoid, i, p ->> ('$[' || i || '].name') AS name, p ->> ('$[' || i || '].tech') AS tech, CAST(p ->> ('$[' || i || '].down') AS INT) AS down
  FROM (SELECT block_geoid, p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM (SELECT block_geoid, CASE WHEN providers LIKE '{{%' THEN '[' || providers || ']' ELSE providers END AS p FROM broadband) q) q2)
SELECT block_geoid, string_agg(name || '/' || {_labels}, '|' ORDER BY {_order}, -down, i) AS listed, CAST(count(DISTINCT name) AS INT) AS provider_count, bool_or(tech = '50') AS has_fiber, bool_or(tech = '40') AS has_cable, max(down) AS max_download_speed FROM e GROUP BY block_geoid
""")
def _(t):
    s = V.broadband_summary(parse_broadband_json(t.broadband))
    return s.select("block_geoid", F.array_join(F.transform("internet_providers", lambda p: F.concat_ws("/", p["name"], p["technology"])), "|").alias("listed"), "provider_count", "has_fiber", "has_cable", "max_download_speed")


@query("a11_internet_projection", f"""
WITH e AS (SELECT block_geoid, i, p ->> ('$[' || i || '].name') AS name, p ->> ('$[' || i || '].tech') AS tech, CAST(p ->> ('$[' || i || '].down') AS INT) AS down
  FROM (SELECT block_geoid, p, unnest(range(0, CAST(json_array_length(p) AS BIGINT))) AS i FROM (SELECT block_geoid, CASE WHEN providers LIKE '{{%' THEN '[' || providers || ']' ELSE providers END AS p FROM broadband) q) q2)
SELECT block_geoid, array_to_string(list(name || '/' || {_labels} || '/' || down ORDER BY {_order}, -down, i)[1:2], '|') AS shown, least(count(*), 2)::INT AS n_shown FROM e GROUP BY block_geoid
""")
def _(t):
    shown = internet_projection(V.broadband_summary(parse_broadband_json(t.broadband)), 2)
    line = F.transform("internet", lambda p: F.concat_ws("/", p["name"], p["technology"], p["max_download_mbps"].cast("string")))
    return shown.select("block_geoid", F.array_join(line, "|").alias("shown"), F.size("internet").alias("n_shown"))


BINDINGS["address_points"] = """
SELECT lower(address) AS address_key, 'primary' AS source, CASE WHEN address_id % 6 = 0 THEN 0e0 ELSE lat END AS lat, CASE WHEN address_id % 6 = 0 THEN 0e0 ELSE lon END AS lon, 95e-2 AS confidence, city, state, zip_code, county, block_geoid FROM addresses WHERE address_id % 5 <> 0
UNION ALL SELECT lower(address) AS address_key, 'fallback' AS source, lat + 1 AS lat, lon AS lon, 8e-1 AS confidence, city, state, zip_code, county, block_geoid FROM addresses WHERE address_id % 7 <> 0
"""
GEO = """geo AS (SELECT a.address_id, coalesce(p.source, f.source, 'miss') AS hit_source, CASE WHEN p.address_key IS NOT NULL THEN p.lat ELSE f.lat END AS geo_lat FROM addresses a
  LEFT JOIN address_points p ON p.address_key = lower(a.address) AND p.source = 'primary' AND NOT (p.lat = 0 AND p.lon = 0) LEFT JOIN address_points f ON f.address_key = lower(a.address) AND f.source = 'fallback' AND NOT (f.lat = 0 AND f.lon = 0))"""


def geocoded(t):
    return L.geocode_by_reference(t.addresses.select("address_id", F.lower("address").alias("address_key")), t.address_points)


@query("j21_geocode_by_reference", f"WITH {GEO} SELECT * FROM geo")
def _(t):
    return geocoded(t).select("address_id", "hit_source", "geo_lat")


@query("g20_geocoder_stats", f"""WITH {GEO} SELECT count(*) AS total, count(*) FILTER (WHERE hit_source = 'primary') AS primary_hits, count(*) FILTER (WHERE hit_source = 'fallback') AS fallback_hits, count(*) FILTER (WHERE hit_source = 'miss') AS misses,
  round(100.0 * count(*) FILTER (WHERE hit_source <> 'miss') / count(*), 6) AS hit_pct, round(100.0 * count(*) FILTER (WHERE hit_source = 'fallback') / count(*), 6) AS fallback_pct FROM geo""")
def _(t):
    from gridlocus.operators.report import geocoder_stats

    return geocoder_stats(geocoded(t)).withColumns({"hit_pct": F.round("hit_pct", 6), "fallback_pct": F.round("fallback_pct", 6)})


BINDINGS["result_cache"] = """
SELECT lower(address) AS address_key, o_orderdate AS created_at, o_orderdate AS expires_at, CASE WHEN o_custkey % 9 = 0 THEN 0e0 ELSE lat END AS lat, o_orderkey AS version, 'old' AS result FROM (
  SELECT o_custkey, max(o_orderdate) AS o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o JOIN addresses ON address_id = o_custkey
"""
NOW = "TIMESTAMP '1998-06-01 00:00:00'"


@query("j22_needs_lookup", f"SELECT address_id FROM addresses WHERE lower(address) NOT IN (SELECT address_key FROM result_cache WHERE expires_at > {NOW} AND lat <> 0)")
def _(t):
    return L.needs_lookup(t.addresses.select("address_id", F.lower("address").alias("address_key")), t.result_cache, F.expr(NOW)).select("address_id")


@query("j23_upsert_results", f"""
WITH fresh AS (SELECT lower(address) AS address_key, 'new' AS result FROM addresses WHERE address_id % 3 = 0)
SELECT coalesce(f.address_key, c.address_key) AS address_key, coalesce(f.result, c.result) AS result FROM (SELECT * FROM result_cache WHERE expires_at > {NOW} AND created_at <= {NOW} OR expires_at > {NOW}) c FULL JOIN fresh f ON f.address_key = c.address_key
""")
def _(t):
    fresh = t.addresses.where("address_id % 3 = 0").select(F.lower("address").alias("address_key"), "lat", F.lit(10**12).alias("version"), F.lit("new").alias("result"))
    # created_at of stored rows is in the past of the clock that stamps new ones.
    cache = t.result_cache.withColumn("created_at", F.least("created_at", F.expr(f"{NOW} - INTERVAL 1 DAY")))
    return L.upsert_results(cache, fresh, F.expr(NOW)).select("address_key", "result")


# ---- verification, candidates ------------------------------------------------
_mean = f"list_filter(list_distinct(list_filter(string_split(regexp_replace({{0}}, '[,.]', '', 'g'), ' '), lambda w: w <> '')), lambda w: w NOT IN {in_list(rules.EIA_STOP_WORDS)})"
BINDINGS["verify_pairs"] = f"""
SELECT DISTINCT zip AS zip_code, {pick('c_custkey % 5', ['=p_name', "=upper(p_name) || ' POWER'", "=p_name || ' Energy Co'", "='City of ' || n_name", 'Nobody'])} AS provider_name FROM customer_names
"""
VERIFY = f"""scored AS (SELECT v.zip_code, v.provider_name, pos, name, eiaid, upper(trim(v.provider_name)) AS p, upper(trim(name)) AS e FROM verify_pairs v JOIN eia_zip z ON zip = zip_code),
 g AS (SELECT *, {_mean.replace('{0}', 'p')} AS pw, {_mean.replace('{0}', 'e')} AS ew FROM scored),
 g2 AS (SELECT *, CASE WHEN p = e THEN 0.05 WHEN len(list_intersect(pw, ew)) > 0 AND len(list_intersect(pw, ew)) * 1.0 / greatest(least(len(pw), len(ew)), 1) >= 0.5 THEN 0.03 WHEN contains(e, p) OR contains(p, e) THEN 0.02 END AS gain FROM g),
 verdict AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zip_code, provider_name ORDER BY CASE WHEN gain IS NULL THEN 1 ELSE 0 END, pos) AS rn FROM g2) q WHERE rn = 1)"""


@query("v3_eia_verify", f"WITH {VERIFY} SELECT v.zip_code, v.provider_name, gain IS NOT NULL AS verified, CASE WHEN d.zip_code IS NULL THEN 0.0::DOUBLE ELSE coalesce(gain, -0.05)::DOUBLE END AS adjustment, name AS eia_name, eiaid AS verified_eia_id FROM verify_pairs v LEFT JOIN verdict d USING (zip_code, provider_name)")
def _(t):
    return L.eia_verify(t.verify_pairs, t.eia_zip)


@query("j24_eia_verify_join", f"WITH {VERIFY} SELECT zip_code, provider_name, pos, eiaid FROM verdict WHERE gain IS NOT NULL")
def _(t):
    agreed = L.eia_verify(t.verify_pairs, t.eia_zip).where("verified")
    zips = t.eia_zip.select(F.col("zip").alias("zip_code"), "pos", F.col("name").alias("eia_name"), "eiaid")
    return agreed.join(zips, ["zip_code", "eia_name"]).groupBy("zip_code", "provider_name").agg(F.min("pos").alias("pos"), F.min_by("eiaid", "pos").alias("eiaid"))


@query("u1_collect_candidates", """
SELECT source, source_ordinal, utility_type, count(*) AS n FROM (
  SELECT 'special_districts' AS source, 0 AS source_ordinal, 'water' AS utility_type FROM addresses JOIN special_districts ON zip = zip_code
  UNION ALL SELECT 'eia_zip', 1, 'electric' FROM addresses JOIN eia_zip ON zip = zip_code AND pos = 0
  UNION ALL SELECT 'state_gas_default', 2, 'gas' FROM addresses a JOIN state_defaults d ON d.state = a.state AND provider IS NOT NULL) q GROUP BY 1, 2, 3
""")
def _(t):
    a = t.addresses
    every = V.collect_candidates([L.special_district_join(a, t.special_districts), L.eia_zip_join(a, t.eia_zip), L.state_default_join(a, t.state_defaults)])
    return every.groupBy("source", "source_ordinal", "utility_type").agg(F.count("*").alias("n"))


DEDUPE = """dd AS MATERIALIZED (SELECT address_id, utility_type, k, n, first_ordinal, provider_name, CASE WHEN n > 1 THEN least(0.98::DOUBLE, confidence + least(0.10, 0.05 * (n - 1))) ELSE confidence END AS confidence,
   CASE WHEN n > 1 AND ns > 1 THEN source || ' (+' || (n - 1) || ' agree)' ELSE source END AS source FROM (
  SELECT *, upper(trim(provider_name)) AS k, count(*) OVER w AS n, min(source_ordinal) OVER w AS first_ordinal, (SELECT count(DISTINCT c2.source) FROM candidates c2 WHERE c2.address_id = c.address_id AND upper(trim(c2.provider_name)) = upper(trim(c.provider_name))) AS ns,
    row_number() OVER (PARTITION BY address_id, utility_type, upper(trim(provider_name)) ORDER BY confidence DESC, source_ordinal) AS rn FROM candidates c WINDOW w AS (PARTITION BY address_id, utility_type, upper(trim(provider_name)))) q WHERE rn = 1)"""
RANK = DEDUPE + ", rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY address_id, utility_type ORDER BY confidence DESC, first_ordinal, provider_name) AS rank FROM dd)"
_liou = has_any("upper(provider_name)", rules.LARGE_IOU_NAMES)
_local = has_any("upper(provider_name)", rules.LOCAL_WORDS + rules.LOCAL_NAMES)
DEMOTE = RANK + f""", need AS (SELECT address_id, CASE WHEN contains(lower(source), 'eia_zip') THEN 0.55 WHEN contains(lower(source), 'state_gis') THEN 0.70 ELSE 0.60 END AS need FROM rk WHERE rank = 1 AND utility_type = 'electric' AND {_liou}),
 pro AS (SELECT address_id, min(rank) AS p FROM rk JOIN need USING (address_id) WHERE rank > 1 AND {_local} AND confidence >= need AND NOT contains(lower(source), 'findenergy_city') AND NOT contains(lower(source), 'state_gas_default') GROUP BY address_id),
 dm AS MATERIALIZED (SELECT rk.* EXCLUDE (rank), CAST(CASE WHEN rank = p THEN 1 WHEN rank < p THEN rank + 1 ELSE rank END AS INT) AS rank FROM rk LEFT JOIN pro USING (address_id))"""


@query("v2_dedupe_and_boost", f"WITH {DEDUPE} SELECT address_id, utility_type, k AS provider_key, n AS n_agree, provider_name, round(confidence, 6) AS confidence, source FROM dd")
def _(t):
    return V.dedupe_and_boost(t.candidates).select("address_id", "utility_type", "provider_key", "n_agree", "provider_name", F.round("confidence", 6).alias("confidence"), "source")


def ranked(t):
    return V.rank_candidates(V.dedupe_and_boost(t.candidates))


@query("v9_rank_candidates", f"WITH {RANK} SELECT address_id, utility_type, provider_name, CAST(rank AS INT) AS rank FROM rk")
def _(t):
    return ranked(t).select("address_id", "utility_type", "provider_name", "rank")


@query("v8_demote_large_iou", f"WITH {DEMOTE} SELECT address_id, utility_type, provider_name, rank FROM dm")
def _(t):
    return V.demote_large_iou(ranked(t)).select("address_id", "utility_type", "provider_name", "rank")


@query("v10_primary_with_alternatives", f"""WITH {DEMOTE}, lead AS (SELECT * FROM dm WHERE rank = 1),
 alts AS (SELECT d.address_id, string_agg(d.provider_name || '/' || round(d.confidence, 3)::DOUBLE, '|' ORDER BY d.rank) AS alternatives FROM dm d JOIN lead l ON l.address_id = d.address_id WHERE d.rank BETWEEN 2 AND 5 AND upper(d.provider_name) <> upper(l.provider_name)
   AND NOT EXISTS (SELECT 1 FROM dm e WHERE e.address_id = d.address_id AND e.rank BETWEEN 2 AND 5 AND e.rank < d.rank AND upper(e.provider_name) = upper(d.provider_name)) GROUP BY d.address_id)
SELECT l.address_id, l.utility_type, l.provider_name, round(l.confidence, 6) AS confidence, l.confidence < 0.7 AS needs_review, coalesce(alternatives, '') AS alternatives FROM lead l LEFT JOIN alts USING (address_id)""")
def _(t):
    out_ = V.primary_with_alternatives(V.demote_large_iou(ranked(t)))
    return out_.select("address_id", "utility_type", "provider_name", F.round("confidence", 6).alias("confidence"), "needs_review",
                       F.array_join(F.transform("alternatives", lambda a: F.concat_ws("/", a["provider"], a["confidence"].cast("string"))), "|").alias("alternatives"))


@query("v11_water_name_guard", f"""SELECT territory_id, CASE WHEN {has_any('upper(name)', rules.WATER_WORDS)} THEN name ELSE 'City of ' || city END AS name FROM (SELECT territory_id, name, CASE WHEN territory_id % 4 = 0 THEN NULL ELSE state END AS city FROM territories WHERE layer = 'water') q
 WHERE {has_any('upper(name)', rules.WATER_WORDS)} OR city IS NOT NULL""")
def _(t):
    df = t.territories.where("layer = 'water'").select("territory_id", "name", F.lit("water").alias("utility_type"), F.when(F.col("territory_id") % 4 != 0, F.col("state")).alias("city"))
    return V.water_name_guard(df).select("territory_id", "name")


@query("v13_boost_with_tenant", "SELECT address_id, source_ordinal, round(least(0.98::DOUBLE, confidence + 0.08), 6) AS confidence, 'tenant_verified+' || match_method AS match_method FROM candidates")
def _(t):
    confidence, method = V.boost_with_tenant(F.col("confidence"), F.col("match_method"))
    return t.candidates.select("address_id", "source_ordinal", F.round(confidence, 6).alias("confidence"), method.alias("match_method"))


# ---- picks -------------------------------------------------------------------
BINDINGS["pick_rows"] = f"""
SELECT row_id, utility_type, engine_provider AS provider_name, engine_confidence AS confidence, engine_source AS source, engine_needs_review AS needs_review, comparison, tenant_raw,
  CASE WHEN row_id % 3 = 0 THEN NULL ELSE 'Alt ' || {as_text('row_id % 10')} END AS alt FROM results WHERE engine_provider IS NOT NULL
"""
BINDINGS["picks"] = """SELECT row_id, utility_type, CASE WHEN row_id % 5 = 0 THEN NULL ELSE 1 + row_id % 3 END AS pick, (row_id % 10) / 1e1 AS confidence FROM pick_rows"""


def pick_rows(t):
    alts = F.when(F.col("alt").isNotNull(), F.array(F.struct(F.col("alt").alias("provider"), F.lit(0.55).alias("confidence"), F.lit("x").alias("source")))).otherwise(
        F.array().cast("array<struct<provider:string,confidence:double,source:string>>"))
    return t.pick_rows.withColumn("alternatives", alts).drop("alt")


_dis = "comparison IN ('MISMATCH', 'MATCH_ALT')"
CAND = f"""c1 AS (SELECT row_id, utility_type, 1 AS o, provider_name AS provider, confidence, source FROM pick_rows WHERE {_dis} OR (confidence < 0.8 AND alt IS NOT NULL)
  UNION ALL SELECT row_id, utility_type, 2, alt, 0.5, 'alternative' FROM pick_rows WHERE alt IS NOT NULL AND ({_dis} OR confidence < 0.8) UNION ALL SELECT row_id, utility_type, 3, trim(tenant_raw), 0.6, 'tenant_reported' FROM pick_rows WHERE {_dis} AND trim(coalesce(tenant_raw, '')) <> ''),
 cand AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY o) AS INT) AS number, count(*) OVER (PARTITION BY row_id) AS n FROM c1) q WHERE n >= 2)"""


@query("v18_build_pick_candidates", f"WITH {CAND} SELECT row_id, utility_type, number, provider, round(confidence, 6)::DOUBLE AS confidence, source FROM cand")
def _(t):
    return V.build_pick_candidates(pick_rows(t)).select("row_id", "utility_type", "number", "provider", F.round("confidence", 6).alias("confidence"), "source")


@query("v19_apply_picks", f"""WITH {CAND}, ch AS (SELECT p.row_id, c.provider, c.confidence AS cc, c.source AS cs, p.confidence AS pc FROM picks p JOIN cand c ON c.row_id = p.row_id AND c.number = p.pick)
SELECT row_id, CASE WHEN ok THEN provider ELSE provider_name END AS provider_name, CASE WHEN ok THEN 'ai_resolver (was: ' || cs || ')' ELSE source END AS source, round(CASE WHEN ok THEN least(0.9, greatest(cc, pc)) ELSE confidence END, 6)::DOUBLE AS confidence, ok AS pick_applied
FROM (SELECT r.*, provider, cc, cs, pc, provider IS NOT NULL AND NOT (provider <> provider_name AND {has_any('lower(source)', rules.PROTECTED_SOURCE_WORDS)}) AS ok FROM pick_rows r LEFT JOIN ch USING (row_id)) q""")
def _(t):
    rows = pick_rows(t)
    done = V.apply_picks(rows, V.build_pick_candidates(rows), t.picks)
    return done.select("row_id", "provider_name", "source", F.round("confidence", 6).alias("confidence"), "pick_applied")
