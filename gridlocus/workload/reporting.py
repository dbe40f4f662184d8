"""Comparison, reports, review, dictionary upkeep, activity logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.operators import activity, compare, dictionary, names, report, review
from gridlocus.session import cut_lineage
from gridlocus.sources.readers import clean_catalog
from gridlocus.workload.bindings import BINDINGS, pick
from gridlocus.workload.bindings import text as as_text
from gridlocus.workload.columns import CATEGORY, DENY, DUE, INFER, REASON, WATER_NORM, registry
from gridlocus.workload.matching import CORE, N3, match_ctes, over, parent_values, segment_ctes
from gridlocus.workload.registry import has_any, in_list, query


def r6(*columns):
    return {c: F.round(c, 6) for c in columns}


def pct(part: str, whole: str) -> str:
    return f"coalesce(round(100.0 * ({part}) / nullif({whole}, 0), 6), 0.0)::DOUBLE"


COR = "count(*) FILTER (WHERE comparison IN ('MATCH', 'MATCH_TDU', 'MATCH_PARENT'))"
SCO = "count(*) FILTER (WHERE comparison IN ('MATCH', 'MATCH_TDU', 'MATCH_PARENT', 'MISMATCH'))"

# ---- comparison --------------------------------------------------------------
# A case per order: the answers reuse the given names; tenant values are plain or in
# two segments; every category occurs.
BINDINGS["cases"] = f"""
SELECT o_orderkey AS row_id, {pick('o_orderkey % 3', ['electric', 'gas', 'water'])} AS utility_type, {pick('o_custkey % 4', ['TX', 'GA', 'NH', 'OH'])} AS state,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE {pick('o_custkey % 9', ['ONCOR', 'Nicor Gas', 'Intermountain Gas', '=a.p_name', '=upper(a.p_name)', 'Duke Energy Ohio', '=b.p_name', "='City of ' || b.p_name", 'Georgia Power'])} END AS engine_provider,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {pick('o_orderkey % 11', ['=a.p_name', 'landlord', "='Amerigas ' || a.p_name", 'Gas South', '=b.p_name', "=a.p_name || ', ' || b.p_name", 'Piedmont Natural Gas', '=c.p_name', 'Some Electric', "='Town of ' || b.p_name", 'Alabama Power'])} END AS tenant_raw,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c.p_name END AS alt, CASE WHEN o_orderkey % 28 = 0 THEN 0e0 ELSE 1e0 END AS lat
FROM orders JOIN part a ON a.p_partkey = o_custkey JOIN part b ON b.p_partkey = o_custkey + 1 JOIN part c ON c.p_partkey = o_custkey + 2
"""


def case_rows(t):
    alts = F.when(F.col("alt").isNotNull(), F.array(F.struct(F.col("alt").alias("provider")))).otherwise(F.array().cast("array<struct<provider:string>>"))
    return t.cases.withColumn("alternatives", alts).drop("alt")


def compared(t):
    return compare.compare_providers(case_rows(t), t.aliases, t.reps, t.rebrands, names.parent_table(t.spark))


_nul = f"(tenant_raw IS NULL OR lower(trim(tenant_raw)) IN {in_list(rules.TENANT_NULLS)} OR len(trim(tenant_raw)) <= 2)"


@query("c1_compare_providers_early", f"""
SELECT row_id, CASE WHEN {_nul} THEN CASE WHEN engine_provider IS NULL THEN 'BOTH_EMPTY' ELSE 'ENGINE_ONLY' END WHEN utility_type = 'gas' AND {has_any('lower(tenant_raw)', rules.PROPANE_WORDS)} THEN 'TENANT_PROPANE' WHEN engine_provider IS NULL THEN 'TENANT_ONLY' END AS comparison
FROM cases WHERE {_nul} OR engine_provider IS NULL OR (utility_type = 'gas' AND {has_any('lower(tenant_raw)', rules.PROPANE_WORDS)})
""")
def _(t):
    return compared(t).where("comparison IN ('BOTH_EMPTY', 'ENGINE_ONLY', 'TENANT_PROPANE', 'TENANT_ONLY')").select("row_id", "comparison")


def _same(x: str, y: str) -> str:
    """The names of two rows of ``full`` mean one entity."""
    norm = lambda t: f"coalesce({t}.normalized, '')"
    return f"""coalesce({x}.low <> '' AND {y}.low <> '' AND ({x}.low = {y}.low OR {over(f'{x}.low', f'{y}.low')} OR {over(f'{x}.core', f'{y}.core')} OR coalesce({x}.canonical_id = {y}.canonical_id, false)
  OR ({norm(x)} <> '' AND {norm(y)} <> '' AND (contains(lower({norm(x)}), lower({norm(y)})) OR contains(lower({norm(y)}), lower({norm(x)}))))), false)"""


def _same_water(x: str, y: str) -> str:
    least = f"least(len({x}.wcore), len({y}.wcore))"
    return f"""coalesce({x}.low <> '' AND {y}.low <> '' AND ({x}.wa = {y}.wa OR ({x}.wn <> '' AND {y}.wn <> '' AND ({x}.wna = {y}.wna OR {x}.wn = {y}.wn OR {over(f'{x}.wn', f'{y}.wn')}
  OR ({least} > 0 AND len(list_intersect({x}.wcore, {y}.wcore)) >= {least})))), false)"""


def compared_ctes(rows: str) -> str:
    """Common table expressions from ``rows`` (row_id, utility_type, state, engine_provider, tenant_raw, alt) to ``compared``:
    early cases by themselves, all others through the names of both sides."""
    parents = f"parents(name_lower, parent, ordinal) AS (VALUES {parent_values()})"
    renamed = lambda kind, name: f"coalesce((SELECT max(renamed) FROM rebrands WHERE utility_type = '{kind}' AND name_lower = {name}), {name})"
    tenants, used = "SELECT tenant AS name FROM due", "SELECT candidate AS name FROM pairs UNION SELECT segment FROM pairs UNION SELECT display FROM pairs"
    has = lambda column, words: has_any(column, words)
    deny = DENY.replace("engine_provider", "engine")
    return f"""{parents},
 placed AS MATERIALIZED (SELECT row_id, utility_type, upper(coalesce(state, '')) AS state, nullif(trim(engine_provider), '') AS engine, trim(coalesce(tenant_raw, '')) AS tenant, alt,
   CASE WHEN {_nul} THEN CASE WHEN nullif(trim(engine_provider), '') IS NULL THEN 'BOTH_EMPTY' ELSE 'ENGINE_ONLY' END WHEN utility_type = 'gas' AND {has('lower(tenant_raw)', rules.PROPANE_WORDS)} THEN 'TENANT_PROPANE'
     WHEN nullif(trim(engine_provider), '') IS NULL THEN 'TENANT_ONLY' END AS early FROM {rows}),
 due AS MATERIALIZED (SELECT * FROM placed WHERE early IS NULL),
 {segment_ctes(tenants, 't')}, {match_ctes('SELECT segment AS name FROM t_seg', tag='t')},
 parts AS MATERIALIZED (SELECT s.name AS tenant, pos, trim(segment) AS segment, coalesce(display_name, '') AS display FROM t_seg s JOIN t_match m ON m.name = s.segment),
 pairs AS MATERIALIZED (SELECT row_id, alt_pos, candidate, segment, display, utility_type FROM (SELECT row_id, -1 AS alt_pos, engine AS candidate, tenant, utility_type FROM due UNION ALL SELECT row_id, 0, alt, tenant, utility_type FROM due WHERE alt <> '') x JOIN parts USING (tenant)),
 {segment_ctes(used)}, {match_ctes('SELECT segment AS name FROM m_seg')},
 m_all AS (SELECT s.name, s.cleaned, pos, segment, canonical_id, display_name, matched, is_rep, match_type, similarity, matched_on FROM m_seg s JOIN m_match m ON m.name = s.segment),
 m_best AS (SELECT name, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, CASE WHEN matched THEN similarity END DESC, pos) AS rn FROM m_all) x WHERE rn = 1),
 m_norm AS (SELECT name, nullif(normalized, '~null') AS normalized FROM ({N3}) y),
 named AS (SELECT name, lower(trim(name)) AS low, {CORE.replace('{0}', 'name')} AS core, lower({WATER_NORM}) AS wn, canonical_id, normalized FROM ({used}) u LEFT JOIN m_best USING (name) LEFT JOIN m_norm USING (name)),
 families AS (SELECT name, coalesce((SELECT parent FROM parents WHERE name_lower = low), (SELECT arg_min(parent, ordinal) FROM parents WHERE low <> '' AND (contains(name_lower, low) OR contains(low, name_lower)))) AS parent FROM named),
 full_names AS MATERIALIZED (SELECT n.*, parent, {renamed('electric', 'low')} AS ea, {renamed('gas', 'low')} AS ga, {renamed('water', 'low')} AS wa, {renamed('water', 'wn')} AS wna,
   list_filter(list_distinct(string_split(wn, ' ')), lambda w: w <> '' AND w NOT IN {in_list(rules.WATER_GENERIC_WORDS)}) AS wcore FROM named n JOIN families USING (name)),
 flagged AS MATERIALIZED (SELECT p.*, {_same('a', 's')} OR (display <> segment AND {_same('a', 'd')}) AS hit, utility_type = 'water' AND ({_same_water('a', 's')} OR (display <> segment AND {_same_water('a', 'd')})) AS water,
   (utility_type = 'electric' AND (a.ea = s.ea OR (display <> segment AND a.ea = d.ea))) OR (utility_type = 'gas' AND (a.ga = s.ga OR (display <> segment AND a.ga = d.ga))) AS renamed,
   coalesce(a.parent = s.parent OR a.parent = d.parent, false) AS related, a.parent AS parent_name
   FROM pairs p JOIN full_names a ON a.name = candidate JOIN full_names s ON s.name = segment JOIN full_names d ON d.name = display),
 flags AS (SELECT row_id, bool_or(alt_pos = -1 AND (hit OR water OR renamed)) AS match, bool_or(alt_pos = -1 AND related) AS parent, max(parent_name) FILTER (WHERE alt_pos = -1 AND related) AS parent_name,
   min(candidate) FILTER (WHERE alt_pos = 0 AND (hit OR water)) AS alt_hit FROM flagged GROUP BY row_id),
 listed AS (SELECT tenant, string_agg(segment, ' | ' ORDER BY pos) AS tn FROM (SELECT DISTINCT tenant, pos, segment FROM parts) x GROUP BY tenant),
 sides AS (SELECT p.*, coalesce(tn, '') AS tn, coalesce(match, false) AS match, coalesce(parent, false) AS related, parent_name, alt_hit FROM placed p LEFT JOIN listed USING (tenant) LEFT JOIN flags USING (row_id)),
 judged AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN match THEN 'MATCH' WHEN state = 'TX' AND utility_type = 'electric' AND {has('upper(engine)', rules.TDU_NAMES)} AND tn <> '' THEN 'MATCH_TDU'
   WHEN state = 'GA' AND utility_type = 'gas' AND (({has('lower(engine)', rules.GA_GAS_DISTRIBUTORS)} AND {has('lower(trim(tn))', rules.GA_GAS_MARKETERS)}) OR ({has('lower(engine)', rules.GA_GAS_MARKETERS)} AND {has('lower(trim(tn))', rules.GA_GAS_DISTRIBUTORS)})) THEN 'GA'
   WHEN related THEN 'MATCH_PARENT' WHEN alt_hit IS NOT NULL THEN 'MATCH_ALT' WHEN {deny} THEN 'DENIED' WHEN utility_type = 'electric' AND lower(engine) IN {in_list(rules.GAS_ONLY_NAMES)} THEN 'GAS_ONLY'
   WHEN utility_type = 'gas' AND {has('lower(tn)', rules.ELECTRIC_WORDS_IN_GAS)} THEN 'ELECTRIC' ELSE 'MISMATCH' END AS verdict FROM sides),
 compared AS MATERIALIZED (SELECT row_id, utility_type, state, CASE verdict WHEN 'GA' THEN 'MATCH_TDU' WHEN 'DENIED' THEN 'MISMATCH' WHEN 'GAS_ONLY' THEN 'MISMATCH' WHEN 'ELECTRIC' THEN 'MATCH' ELSE verdict END AS comparison,
   CASE verdict WHEN 'TENANT_PROPANE' THEN 'propane=' || tenant WHEN 'TENANT_ONLY' THEN 'no_polygon_hit' WHEN 'MATCH_TDU' THEN 'tdu=' || engine || ', rep=' || tn WHEN 'GA' THEN 'ga_gas_deregulated: ldc=' || engine || ', marketer=' || tn
     WHEN 'MATCH_PARENT' THEN 'parent=' || parent_name WHEN 'MATCH_ALT' THEN 'alt=' || alt_hit || ', primary=' || engine WHEN 'DENIED' THEN 'cross_state_override: engine=' || engine || ' wrong for ' || state
     WHEN 'GAS_ONLY' THEN 'gas_provider_in_electric: engine=' || engine WHEN 'ELECTRIC' THEN 'tenant_electric_in_gas: tenant=' || tn WHEN 'MISMATCH' THEN 'engine=' || engine || ' vs tenant=' || tn ELSE '' END AS match_detail,
   CASE WHEN early = 'TENANT_ONLY' THEN tenant WHEN early IS NULL THEN tn ELSE '' END AS tenant_normalized FROM judged)"""


@query("c1_compare_providers", f"WITH {compared_ctes('cases')} SELECT row_id, comparison, match_detail, tenant_normalized FROM compared")
def _(t):
    return compared(t).select("row_id", "comparison", "match_detail", "tenant_normalized")


@query("c2_compare_with_geocode_failure", f"""SELECT row_id, CASE WHEN {_nul} THEN 'BOTH_EMPTY' ELSE 'TENANT_ONLY' END AS comparison, CASE WHEN {_nul} THEN '' ELSE 'geocode_failed' END AS match_detail FROM cases WHERE lat = 0 AND engine_provider IS NULL""")
def _(t):
    df = compare.with_geocode_failure(compared(t).withColumn("lon", F.col("lat")))
    return df.where("lat = 0 AND engine_provider IS NULL").select("row_id", "comparison", "match_detail")


@query("c3_id_match_bucket", "SELECT row_id, id_match FROM results")
def _(t):
    return compare.id_match_bucket(t.results.drop("id_match")).select("row_id", "id_match")


@query("c3_id_match_bucket_aliased", """
SELECT row_id, CASE WHEN e IS NOT NULL AND u IS NOT NULL THEN CASE WHEN e = u THEN 'ID_MATCH' WHEN comparison = 'MATCH_TDU' THEN 'ID_MATCH_TDU' WHEN comparison IN ('MATCH', 'MATCH_PARENT', 'MATCH_ALT') THEN 'NAME_MATCH_ID_MISMATCH' ELSE 'TRUE_MISMATCH' END
  WHEN e IS NOT NULL THEN 'TENANT_ID_MISSING' WHEN u IS NOT NULL THEN 'ENGINE_ID_MISSING' ELSE 'BOTH_ID_MISSING' END AS id_match
FROM (SELECT r.row_id, r.comparison, coalesce(x.canonical_id, CAST(engine_catalog_id AS VARCHAR)) AS e, coalesce(y.canonical_id, CAST(tenant_catalog_id AS VARCHAR)) AS u FROM results r
  LEFT JOIN catalog_aliases x ON x.alias_id = CAST(engine_catalog_id AS VARCHAR) LEFT JOIN catalog_aliases y ON y.alias_id = CAST(tenant_catalog_id AS VARCHAR)) q
""")
def _(t):
    return compare.id_match_bucket(t.results.drop("id_match"), t.catalog_aliases).select("row_id", "id_match")


BINDINGS["after_rows"] = """SELECT row_id, utility_type, CASE WHEN row_id % 3 = 0 THEN 'MATCH' WHEN row_id % 7 = 0 THEN 'MATCH_ALT' ELSE comparison END AS comparison, CASE WHEN row_id % 11 = 0 THEN 0e0 ELSE 1e0 END AS lat, CASE WHEN row_id % 11 = 0 THEN 0e0 ELSE 1e0 END AS lon, engine_source AS source FROM results"""


@query("c6_accuracy_by_type", f"SELECT utility_type, {SCO} AS scoreable, {COR} AS correct, {pct(COR, SCO)} AS accuracy_pct FROM results GROUP BY 1")
def _(t):
    return compare.accuracy(t.results, ["utility_type"]).withColumns(r6("accuracy_pct"))


@query("c6b_accuracy_by_state", f"SELECT utility_type, state, {SCO} AS scoreable, {COR} AS correct, {pct(COR, SCO)} AS accuracy_pct FROM results GROUP BY 1, 2")
def _(t):
    return compare.accuracy(t.results, ["utility_type", "state"]).withColumns(r6("accuracy_pct"))


_idr, _ida, _ids = (f"count(*) FILTER (WHERE id_match IN {x})" for x in ("('ID_MATCH', 'ID_MATCH_TDU')", "('ID_MATCH', 'ID_MATCH_TDU', 'NAME_MATCH_ID_MISMATCH')", "('ID_MATCH', 'ID_MATCH_TDU', 'NAME_MATCH_ID_MISMATCH', 'TRUE_MISMATCH')"))


@query("c7_id_accuracy", f"SELECT utility_type, {_ids} AS scoreable, {_idr} AS correct, {_ida} AS adjusted_correct, {pct(_idr, _ids)} AS accuracy_pct, {pct(_ida, _ids)} AS adjusted_pct FROM results GROUP BY ROLLUP (utility_type)")
def _(t):
    return compare.id_accuracy(t.results).withColumns(r6("accuracy_pct", "adjusted_pct"))


_ans, _flag = "count(engine_provider)", "count(*) FILTER (WHERE engine_provider IS NOT NULL AND engine_needs_review)"
_cs, _cc = (x.replace("WHERE ", "WHERE NOT engine_needs_review AND ") for x in (SCO, COR))


@query("c7b_review_rate", f"SELECT utility_type, {_ans} AS answered, {_flag} AS flagged, {_cs} AS confident_scoreable, {_cc} AS confident_correct, {pct(_flag, _ans)} AS review_pct, {pct(_cc, _cs)} AS confident_pct FROM results GROUP BY 1")
def _(t):
    return compare.review_rate(t.results).withColumns(r6("review_pct", "confident_pct"))


@query("c8_confidence_calibration", f"""SELECT CAST(floor(round(engine_confidence / 0.05, 6)) AS INT) AS level, count(*) AS n, {COR} AS correct, round(avg(engine_confidence), 6) AS mean_confidence, {pct(COR, 'count(*)')} AS accuracy_pct
FROM results WHERE comparison IN ('MATCH', 'MATCH_TDU', 'MATCH_PARENT', 'MISMATCH') GROUP BY 1""")
def _(t):
    return compare.confidence_calibration(t.results).withColumns(r6("mean_confidence", "accuracy_pct")).drop("from_confidence")


# ---- aggregates --------------------------------------------------------------
@query("g1_comparison_counts", "SELECT utility_type, " + ", ".join(f"count(*) FILTER (WHERE comparison = '{c}') AS {c.lower()}" for c in rules.CATEGORIES) + " FROM results GROUP BY 1")
def _(t):
    return report.comparison_counts(t.results)


@query("g2_id_bucket_breakdown", f"SELECT b AS id_match, (SELECT count(*) FROM results WHERE id_match = b) AS n, round(100.0 * (SELECT count(*) FROM results WHERE id_match = b) / (SELECT count(*) FROM results), 6)::DOUBLE AS share_pct FROM (VALUES {', '.join(f'({chr(39)}{b}{chr(39)})' for b in rules.ID_BUCKETS)}) v(b)")
def _(t):
    return report.id_bucket_breakdown(t.results).withColumns(r6("share_pct"))


@query("g3_top_mismatch_pairs", "SELECT * FROM (SELECT utility_type, engine_provider, tenant_normalized, count(*) AS n, CAST(row_number() OVER (PARTITION BY utility_type ORDER BY count(*) DESC, engine_provider NULLS FIRST, tenant_normalized NULLS FIRST) AS INT) AS rank FROM results WHERE comparison = 'MISMATCH' GROUP BY 1, 2, 3) q WHERE rank <= 20")
def _(t):
    return report.top_mismatch_pairs(t.results)


@query("g4_mismatches_by_state", "SELECT * FROM (SELECT utility_type, state, count(*) AS n, CAST(row_number() OVER (PARTITION BY utility_type ORDER BY count(*) DESC, state) AS INT) AS rank FROM results WHERE comparison = 'MISMATCH' GROUP BY 1, 2) q WHERE rank <= 10")
def _(t):
    return report.mismatches_by_state(t.results)


@query("g5_deregulated_breakdown", """SELECT engine_provider, count(*) AS total, count(*) FILTER (WHERE comparison = 'MATCH_TDU') AS matched_tdu, count(*) FILTER (WHERE engine_provider IS NOT NULL AND NOT engine_is_deregulated) AS not_deregulated, count(*) FILTER (WHERE engine_provider IS NULL) AS no_result
FROM results WHERE state = 'TX' AND utility_type = 'electric' GROUP BY 1""")
def _(t):
    return report.deregulated_breakdown(t.results)


@query("g6_geocode_failures", "SELECT state, count(*) AS failures, min(address) AS example FROM addresses WHERE lat = 0 AND lon = 0 GROUP BY state ORDER BY failures DESC, state LIMIT 10")
def _(t):
    return report.geocode_failures(t.addresses)


@query("g6_geocode_failure_sample", "SELECT address_id, address FROM addresses WHERE lat = 0 AND lon = 0 ORDER BY address_id LIMIT 100")
def _(t):
    return report.geocode_failure_sample(t.addresses).select("address_id", "address")


@query("g7_catalog_duplicate_pairs", "SELECT engine_provider, engine_catalog_id, tenant_catalog_title, tenant_catalog_id, count(*) AS n FROM results WHERE id_match = 'NAME_MATCH_ID_MISMATCH' GROUP BY 1, 2, 3, 4")
def _(t):
    return report.catalog_duplicate_pairs(t.results)


FLAGS = f"""{segment_ctes('SELECT DISTINCT trim(raw) AS name FROM reported')}, {match_ctes('SELECT segment AS name FROM m_seg')},
 fl AS MATERIALIZED (SELECT s.name AS raw, bool_or(match_type = 'null_value') AS any_null, bool_or(match_type = 'propane') AS any_propane, bool_or(is_rep) AS any_rep, bool_or(matched) AS any_matched, bool_and(matched) AS all_matched FROM m_seg s JOIN m_match m ON m.name = s.segment GROUP BY 1),
 oc AS MATERIALIZED (SELECT *, CASE WHEN any_null THEN 'null' WHEN any_propane THEN 'propane' WHEN any_rep THEN 'rep' WHEN any_matched THEN 'matched' ELSE 'unmatched' END AS outcome FROM fl),
 ct AS MATERIALIZED (SELECT utility_type, trim(raw) AS raw, count(*) AS n FROM reported WHERE trim(raw) <> '' GROUP BY 1, 2)"""


@query("g8_coverage_by_type", f"""WITH {FLAGS}, j AS (SELECT ct.*, outcome, any_matched FROM ct JOIN oc USING (raw)), sc AS (SELECT utility_type AS scope, * FROM j UNION ALL SELECT 'electric+gas', * FROM j WHERE utility_type <> 'water' UNION ALL SELECT 'all', * FROM j)
SELECT scope, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN outcome = 'matched' OR (outcome = 'rep' AND any_matched) THEN n ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN outcome = 'unmatched' THEN n ELSE 0 END) AS BIGINT) AS unmatched, CAST(sum(CASE WHEN outcome = 'rep' THEN n ELSE 0 END) AS BIGINT) AS rep_flagged,
 CAST(sum(CASE WHEN outcome = 'null' THEN n ELSE 0 END) AS BIGINT) AS null_values, CAST(sum(CASE WHEN outcome = 'propane' THEN n ELSE 0 END) AS BIGINT) AS propane, {pct("sum(CASE WHEN outcome = 'matched' OR (outcome = 'rep' AND any_matched) THEN n ELSE 0 END)", 'sum(n)')} AS matched_pct FROM sc GROUP BY scope""")
def _(t):
    return report.coverage_by_type(t.reported, t.aliases, t.reps).withColumns(r6("matched_pct"))


@query("g9_comma_split_stats", f"""WITH {FLAGS} SELECT CAST(sum(n) AS BIGINT) AS with_comma, CAST(sum(CASE WHEN any_matched THEN n ELSE 0 END) AS BIGINT) AS some_matched, CAST(sum(CASE WHEN all_matched THEN n ELSE 0 END) AS BIGINT) AS all_matched FROM ct JOIN oc USING (raw) WHERE contains(raw, ',')""")
def _(t):
    return report.comma_split_stats(t.reported, t.aliases, t.reps)


@query("g10_coverage_exact", f"""WITH c AS (SELECT trim(raw) AS raw, count(*) AS n FROM reported WHERE trim(raw) <> '' GROUP BY 1), j AS (SELECT c.*, alias_lower IS NOT NULL AS hit FROM c LEFT JOIN alias_index ON alias_lower = lower(regexp_replace(raw, '\\s+', ' ', 'g')))
SELECT CAST(sum(n) AS BIGINT) AS instances, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS matched_instances, count(*) AS names, count(*) FILTER (WHERE hit) AS matched_names, {pct('sum(CASE WHEN hit THEN n ELSE 0 END)', 'sum(n)')} AS instance_pct, {pct('count(*) FILTER (WHERE hit)', 'count(*)')} AS name_pct FROM j""")
def _(t):
    return report.coverage_exact(t.reported, t.aliases).withColumns(r6("instance_pct", "name_pct"))


def _top(outcome: str, n: int) -> str:
    return f"WITH {FLAGS} SELECT raw, CAST(sum(n) AS BIGINT) AS n, {CATEGORY.format('raw')} AS category FROM ct JOIN oc USING (raw) WHERE utility_type <> 'water' AND outcome = '{outcome}' GROUP BY raw ORDER BY n DESC, raw LIMIT {n}"


@query("g11_top_unmatched", _top("unmatched", 50))
def _(t):
    return report.top_unmatched(t.reported, t.aliases, t.reps)


@query("g11_top_rep", _top("rep", 30))
def _(t):
    return report.top_unmatched(t.reported, t.aliases, t.reps, 30, "rep")


FREQ = """freq AS MATERIALIZED (SELECT utility_type, name, count(*) AS n FROM (SELECT utility_type, trim(raw) AS name FROM reported WHERE trim(raw) <> '' UNION ALL
  SELECT utility_type, trim(s) AS name FROM (SELECT utility_type, unnest(string_split(raw, ',')) AS s FROM reported WHERE contains(raw, ',')) q WHERE trim(s) <> '') z GROUP BY 1, 2)"""


@query("g12_name_frequencies", f"WITH {FREQ} SELECT * FROM freq")
def _(t):
    return report.name_frequencies(t.reported)


IMPACT = FREQ + f""", lowf AS (SELECT utility_type, lower(name) AS l, arg_min(n, name) AS n FROM freq GROUP BY 1, 2), hits AS (SELECT eia_id, coalesce(f.n, l.n) AS n FROM registry_names r JOIN lowf l ON l.l = lower(trim(r.name)) LEFT JOIN freq f ON f.utility_type = l.utility_type AND f.name = trim(r.name)),
 impact AS MATERIALIZED (SELECT r.eia_id, CAST(coalesce((SELECT sum(n) FROM hits h WHERE h.eia_id = r.eia_id), 0) AS BIGINT) AS tenant_mentions, {INFER} AS utility_type, {has_any('n', rules.WHOLESALE_WORDS)} AS is_wholesale FROM (SELECT eia_id, lower(string_agg(name, ' ' ORDER BY pos)) AS n FROM registry_names GROUP BY eia_id) r)"""


@query("g13_tenant_impact_score", f"WITH {IMPACT} SELECT * FROM impact")
def _(t):
    return report.tenant_impact_score(registry(t), report.name_frequencies(t.reported)).drop("names", "mention_details")


@query("g14_addition_candidates", f"WITH {IMPACT} SELECT eia_id, utility_type, tenant_mentions, CASE WHEN tenant_mentions >= 10 THEN 'high' ELSE 'low' END AS priority FROM impact WHERE NOT is_wholesale AND tenant_mentions >= 1")
def _(t):
    scored = report.tenant_impact_score(registry(t), report.name_frequencies(t.reported))
    return report.addition_candidates(scored).select("eia_id", "utility_type", "tenant_mentions", "priority")


@query("g15_extract_reps", f"""SELECT name, count(*) AS n FROM (SELECT trim(s) AS name FROM (SELECT unnest(string_split(raw, ',')) AS s FROM reported WHERE state = 'TX' AND trim(raw) <> '') q) z
WHERE name <> '' AND lower(name) NOT IN {in_list(rules.NOT_RETAIL)} AND NOT {has_any('lower(name)', rules.NOT_RETAIL_WORDS)} AND len(name) >= 3 GROUP BY name HAVING count(*) >= 2""")
def _(t):
    return report.extract_reps(t.reported)


_pt = "engine_provider IS NOT NULL AND coalesce(tenant_raw, '') <> ''"


@query("g16_review_stats", f"""SELECT utility_type, count(*) FILTER (WHERE {_pt}) AS scoreable, count(*) FILTER (WHERE {_pt} AND comparison IN ('MATCH', 'MATCH_TDU', 'MATCH_PARENT')) AS correct, count(engine_provider) AS with_provider, count(*) FILTER (WHERE engine_provider IS NOT NULL AND engine_catalog_id IS NOT NULL) AS id_matched,
 count(*) FILTER (WHERE engine_provider IS NOT NULL AND engine_id_confident) AS id_confident, count(*) FILTER (WHERE {DUE}) AS review_rows, {pct(f"count(*) FILTER (WHERE {_pt} AND comparison IN ('MATCH', 'MATCH_TDU', 'MATCH_PARENT'))", f"count(*) FILTER (WHERE {_pt})")} AS accuracy_pct FROM results GROUP BY 1""")
def _(t):
    return report.review_stats(t.results).withColumns(r6("accuracy_pct"))


@query("g16_review_reason_counts", f"SELECT utility_type, reason, count(*) AS n FROM (SELECT utility_type, unnest(string_split({REASON}, '; ')) AS reason FROM results WHERE {DUE}) q WHERE reason <> '' GROUP BY 1, 2")
def _(t):
    return report.review_reason_counts(t.results)


@query("g17_source_distribution", "SELECT utility_type, engine_source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY utility_type), 6)::DOUBLE AS share_pct FROM results WHERE engine_source <> '' GROUP BY 1, 2")
def _(t):
    return report.source_distribution(t.results).withColumns(r6("share_pct"))


_altc, _alts = (x.replace("'MATCH', ", "'MATCH', 'MATCH_ALT', ") for x in (COR, SCO))


@query("g19_accuracy_impact", f"""WITH o AS (SELECT utility_type, {SCO} AS old_scoreable, {COR} AS old_correct, {pct(COR, SCO)} AS old_accuracy_pct FROM results GROUP BY 1), n AS (SELECT utility_type, {SCO} AS new_scoreable, {COR} AS new_correct, {pct(COR, SCO)} AS new_accuracy_pct FROM after_rows GROUP BY 1)
SELECT *, round(new_accuracy_pct - old_accuracy_pct, 6) AS delta_pp FROM o JOIN n USING (utility_type)""")
def _(t):
    return compare.accuracy_change(t.results, t.after_rows, count_alternatives=False).withColumns(r6("old_accuracy_pct", "new_accuracy_pct")).withColumn(
        "delta_pp", F.round(F.col("new_accuracy_pct") - F.col("old_accuracy_pct"), 6))


_sides = f"""o AS (SELECT utility_type, {_alts} AS old_scoreable, {_altc} AS old_correct, {pct(_altc, _alts)} AS old_accuracy_pct FROM (SELECT utility_type, CASE WHEN row_id % 2 = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS comparison FROM cases) x GROUP BY 1),
 n AS (SELECT utility_type, {_alts} AS new_scoreable, {_altc} AS new_correct, {pct(_altc, _alts)} AS new_accuracy_pct FROM compared GROUP BY 1)"""


@query("c4_recompare", f"WITH {compared_ctes('cases')}, {_sides} SELECT *, round(new_accuracy_pct - old_accuracy_pct, 6) AS delta_pp FROM o JOIN n USING (utility_type)")
def _(t):
    stored = cut_lineage(case_rows(t).withColumn("comparison", F.when(F.col("row_id") % 2 == 0, "MATCH").otherwise("MISMATCH")))
    _fresh, change = compare.recompare(stored, t.aliases, t.reps, t.rebrands, names.parent_table(t.spark))
    return change.withColumns(r6("old_accuracy_pct", "new_accuracy_pct")).withColumn("delta_pp", F.round(F.col("new_accuracy_pct") - F.col("old_accuracy_pct"), 6))


@query("c4_accuracy_change", f"""WITH o AS (SELECT utility_type, {_alts} AS old_scoreable, {_altc} AS old_correct, {pct(_altc, _alts)} AS old_accuracy_pct FROM results GROUP BY 1), n AS (SELECT utility_type, {_alts} AS new_scoreable, {_altc} AS new_correct, {pct(_altc, _alts)} AS new_accuracy_pct FROM after_rows GROUP BY 1)
SELECT *, round(new_accuracy_pct - old_accuracy_pct, 6) AS delta_pp FROM o JOIN n USING (utility_type)""")
def _(t):
    return compare.accuracy_change(t.results, t.after_rows).withColumns(r6("old_accuracy_pct", "new_accuracy_pct")).withColumn(
        "delta_pp", F.round(F.col("new_accuracy_pct") - F.col("old_accuracy_pct"), 6))


@query("g21_alias_collisions", "SELECT lower(alias) AS alias_lower, count(DISTINCT canonical_id) AS n_canonicals, min(canonical_id) AS first_canonical FROM dictionary GROUP BY 1 HAVING count(DISTINCT canonical_id) > 1")
def _(t):
    return dictionary.alias_collisions(t.dictionary)


PER = "per AS (SELECT canonical_id, max(display_name) AS display_name, max(parent_company) AS parent_company, count(alias) AS n_aliases FROM dictionary GROUP BY 1)"


@query("g22_dictionary_summary", f"""WITH {PER} SELECT count(*) AS canonicals, CAST(sum(n_aliases) AS BIGINT) AS aliases, count(*) FILTER (WHERE display_name <> canonical_id) AS display_overrides, count(parent_company) AS with_parent, min(n_aliases) AS min_aliases, avg(n_aliases) AS avg_aliases,
 median(n_aliases)::DOUBLE AS median_aliases, max(n_aliases) AS max_aliases FROM per""")
def _(t):
    return dictionary.dictionary_summary(t.dictionary)


@query("g22_alias_histogram", f"WITH {PER} SELECT n_aliases, count(*) AS n FROM per GROUP BY 1")
def _(t):
    return dictionary.alias_histogram(t.dictionary)


@query("g23_zip_dominance_build", """SELECT utility_type, state, zip, name, sample_count, round(share, 6) AS dominance_pct, CASE WHEN share >= 80 THEN 'high' WHEN share >= 60 THEN 'medium' ELSE 'low' END AS confidence_level FROM (
 SELECT utility_type, state, zip, name, CAST(sum(n) OVER (PARTITION BY utility_type, state, zip) AS BIGINT) AS sample_count, n * 100e0 / sum(n) OVER (PARTITION BY utility_type, state, zip) AS share, row_number() OVER (PARTITION BY utility_type, state, zip ORDER BY n DESC, name) AS rn
 FROM (SELECT utility_type, state, zip, raw AS name, count(*) AS n FROM reported GROUP BY 1, 2, 3, 4) q) z WHERE rn = 1""")
def _(t):
    return report.zip_dominance_build(t.reported.withColumnRenamed("raw", "name")).withColumns(r6("dominance_pct"))


@query("g24_territory_overlap", """
WITH s AS (SELECT territory_id, ix, iy FROM (SELECT t.*, ix, unnest(range(CAST(floor((cy - r) / 0.5) AS BIGINT), CAST(floor((cy + r) / 0.5) AS BIGINT) + 1)) AS iy FROM (SELECT *, unnest(range(CAST(floor((cx - r) / 0.5) AS BIGINT), CAST(floor((cx + r) / 0.5) AS BIGINT) + 1)) AS ix FROM territories WHERE layer = 'electric') t) q
  WHERE abs((ix + 0.5) * 0.5 - cx) + abs((iy + 0.5) * 0.5 - cy) < r), a AS (SELECT territory_id, count(*) * 0.25 AS area FROM s GROUP BY 1)
SELECT p.territory_id, p.other_id, round(overlap, 6)::DOUBLE AS overlap, round(100.0 * overlap / a.area, 6)::DOUBLE AS pct_of_first, round(100.0 * overlap / b.area, 6)::DOUBLE AS pct_of_second
FROM (SELECT x.territory_id, y.territory_id AS other_id, count(*) * 0.25 AS overlap FROM s x JOIN s y ON x.ix = y.ix AND x.iy = y.iy AND x.territory_id < y.territory_id GROUP BY 1, 2) p JOIN a ON a.territory_id = p.territory_id JOIN a b ON b.territory_id = p.other_id
""")
def _(t):
    from gridlocus.operators.spatial import territory_overlap

    return territory_overlap(t.shapes.where("layer = 'electric'"), 0.5).withColumns(r6("overlap", "pct_of_first", "pct_of_second"))


@query("g25_phase_timing", "SELECT event_type AS phase, count(*) AS n_rows, round(avg(value), 6) AS mean_ms, round(sum(value), 6) AS total_ms FROM events GROUP BY 1")
def _(t):
    return report.phase_timing(t.events.select(F.col("event_type").alias("phase"), F.col("value").alias("elapsed_ms"))).withColumns(r6("mean_ms", "total_ms"))


@query("g26_layer_counts", "SELECT layer, count(*) AS n FROM territories GROUP BY 1")
def _(t):
    return report.layer_counts(t.territories)


@query("g27_source_coverage", "SELECT r.utility_type, r.state, count(*) AS mismatches, bool_or(g.state IS NOT NULL) AS has_source FROM results r LEFT JOIN (SELECT DISTINCT 'gas' AS utility_type, state FROM gas_mapping WHERE state <> 'TX') g ON g.utility_type = r.utility_type AND g.state = r.state WHERE comparison = 'MISMATCH' GROUP BY 1, 2")
def _(t):
    return report.source_coverage(t.results, t.gas_mapping.where("state <> 'TX'").select(F.lit("gas").alias("utility_type"), "state"))


@query("g28_dictionary_sanity", f"""WITH d AS (SELECT canonical_id, CASE WHEN ordinal % 4 = 0 THEN canonical_id || ' Holdings, Inc.' ELSE display_name END AS display_name, CASE WHEN ordinal % 6 = 1 THEN 'Exelon' WHEN ordinal % 6 = 2 THEN NULL ELSE alias END AS alias FROM dictionary),
 p AS (SELECT canonical_id, max(display_name) AS display_name, count(alias) AS n FROM d GROUP BY 1)
SELECT 'corporate_suffix' AS "check", canonical_id, display_name AS detail FROM p WHERE regexp_matches(display_name, '(?i)(,? inc\\.?|,? corp\\.?|,? llc| company| co\\.?)$') UNION ALL SELECT 'long_display', canonical_id, display_name FROM p WHERE len(display_name) > 40
UNION ALL SELECT 'holding_alias', canonical_id, alias FROM d WHERE lower(alias) IN {in_list(rules.HOLDING_NAMES)} UNION ALL SELECT 'no_alias', canonical_id, NULL FROM p WHERE n = 0""")
def _(t):
    df = t.sql("""SELECT canonical_id, parent_company, CASE WHEN ordinal % 4 = 0 THEN canonical_id || ' Holdings, Inc.' ELSE display_name END AS display_name, CASE WHEN ordinal % 6 = 1 THEN 'Exelon' WHEN ordinal % 6 = 2 THEN NULL ELSE alias END AS alias FROM dictionary""")
    return dictionary.dictionary_sanity(df)


# ---- sorts, limits -----------------------------------------------------------
@query("k1_review_queue_order", f"SELECT CAST(row_number() OVER (ORDER BY CASE comparison WHEN 'MISMATCH' THEN 0 WHEN 'MATCH_ALT' THEN 1 ELSE 2 END, state, utility_type, row_id) AS INT) AS place, row_id FROM results WHERE {DUE}")
def _(t):
    from gridlocus.functions.predicates import needs_review_queue

    due = t.results.where(needs_review_queue("comparison", "engine_confidence", "tenant_raw", "engine_provider", "engine_catalog_id"))
    return report.numbered(due, [*review.review_order("comparison", "state", "utility_type"), F.col("row_id")], "place").select("row_id", F.col("place").cast("int").alias("place"))


@query("k2_most_common", "SELECT raw, count(*) AS n FROM reported GROUP BY raw ORDER BY n DESC, raw LIMIT 20")
def _(t):
    return report.most_common(t.reported, "raw", 20)


@query("k3_row_range", "SELECT address_id FROM addresses WHERE address_id >= 40 AND address_id < 40 + 100")
def _(t):
    return report.row_range(t.addresses, "address_id", 40, 100).select("address_id")


@query("k4_alphabetical_dictionary", "SELECT canonical_id, CAST(row_number() OVER (ORDER BY lower(canonical_id)) AS INT) AS place FROM canonicals")
def _(t):
    return report.numbered(t.canonicals, [F.lower("canonical_id")], "place").select("canonical_id", F.col("place").cast("int").alias("place"))


@query("k6_examples_per_group", "SELECT utility_type, comparison, row_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY utility_type, comparison ORDER BY row_id) AS INT) AS rank FROM results) q WHERE rank <= 5")
def _(t):
    return report.examples_per_group(t.results, ["utility_type", "comparison"], ["row_id"], 5).select("utility_type", "comparison", "row_id", "rank")


@query("k7_wide_result", """SELECT address_id, max(provider_name) FILTER (WHERE utility_type = 'electric') AS electric_provider, max(provider_name) FILTER (WHERE utility_type = 'gas') AS gas_provider FROM candidates WHERE source_ordinal = 0 GROUP BY 1""")
def _(t):
    wide = report.wide_result(t.candidates.where("source_ordinal = 0").select("address_id", "utility_type", "provider_name", "confidence"))
    return wide.select("address_id", F.col("electric.provider_name").alias("electric_provider"), F.col("gas.provider_name").alias("gas_provider"))


# ---- sets --------------------------------------------------------------------
@query("u2_union_sources", "SELECT source_name, count(*) AS n FROM (SELECT 'curated' AS source_name, canonical AS name FROM name_sources UNION ALL SELECT 'auto', raw_name FROM raw_names) q GROUP BY 1")
def _(t):
    curated = t.name_sources.select(F.lit("curated").alias("source_name"), F.col("canonical").alias("name"))
    return curated.unionByName(t.raw_names.select(F.lit("auto").alias("source_name"), F.col("raw_name").alias("name"))).groupBy("source_name").agg(F.count("*").alias("n"))


@query("u3_distinct_addresses", "SELECT DISTINCT address FROM results WHERE comparison = 'MISMATCH'")
def _(t):
    return t.results.where("comparison = 'MISMATCH'").select("address").dropDuplicates()


@query("u4_set_difference_rows", "SELECT a.address_id FROM addresses a WHERE a.address_id NOT IN (SELECT correction_id FROM address_corrections)")
def _(t):
    return t.addresses.select("address_id").join(t.address_corrections.select(F.col("correction_id").alias("address_id")), "address_id", "left_anti")


@query("u5_word_set_ops", """SELECT a, b, CAST(len(list_intersect(x, y)) AS INT) AS shared, CAST(len(list_filter(x, lambda w: NOT list_contains(y, w))) AS INT) AS only_a FROM (SELECT a, b, list_distinct(string_split(lower(a), ' ')) AS x, list_distinct(string_split(lower(b), ' ')) AS y FROM name_pairs) q""")
def _(t):
    a, b = F.array_distinct(F.split(F.lower("a"), " ")), F.array_distinct(F.split(F.lower("b"), " "))
    return t.name_pairs.select("a", "b", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_a"))


# ---- dictionary upkeep -------------------------------------------------------
_nk = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim({0}), ',+$', ''))), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
EDGES = f"""edges AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT source, {_nk.format('canonical')} AS canonical_key, {_nk.format('canonical')} AS alias_key, true AS own FROM name_sources
  UNION ALL SELECT source, {_nk.format('canonical')}, {_nk.format('alias')}, false FROM name_sources WHERE {_nk.format('alias')} NOT IN {in_list(rules.HOLDING_NAMES_DICTIONARY)}) q WHERE alias_key <> '')"""


@query("r1_name_edges", f"WITH {EDGES} SELECT source, canonical_key, alias_key, own FROM edges")
def _(t):
    return dictionary.name_edges(t.name_sources).select("source", "canonical_key", "alias_key", "own")


COMPONENTS = EDGES + """, und AS MATERIALIZED (SELECT canonical_key AS a, alias_key AS b FROM edges UNION SELECT alias_key, canonical_key FROM edges),
 reach(a, b) AS (SELECT a, b FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a = r.b), comp AS (SELECT a AS alias_key, min(least(a, b)) AS component FROM reach GROUP BY 1)"""


@query("r2_merge_groups", f"WITH RECURSIVE {COMPONENTS} SELECT * FROM comp", recursive=True)
def _(t):
    return dictionary.merge_groups(dictionary.name_edges(t.name_sources))


@query("r3_name_groups", f"""WITH RECURSIVE {COMPONENTS} SELECT component, arg_min(n, pl || CASE WHEN pl = '2' AND n = upper(n) THEN 'b' ELSE 'a' END || CASE WHEN pl = '2' THEN lpad(CAST(9999 - len(n) AS VARCHAR), 5, '0') ELSE '' END || n) AS canonical FROM (
  SELECT component, regexp_replace(trim(canonical), '\\s+', ' ', 'g') AS n, CASE source WHEN 's1' THEN '0' WHEN 's2' THEN '1' ELSE '2' END AS pl FROM name_sources JOIN comp ON alias_key = {_nk.format('canonical')}) q GROUP BY component""", recursive=True)
def _(t):
    edges = cut_lineage(dictionary.name_edges(t.name_sources))
    return dictionary.name_groups(edges, dictionary.merge_groups(edges), "s1", "s2")


BINDINGS["auto_names"] = f"""
SELECT CASE WHEN p_partkey % 4 = 0 THEN 'name ' || {as_text('p_partkey')} ELSE p_name || ' ' || {as_text('p_partkey % 90')} END AS key, CASE WHEN p_partkey % 3 = 0 THEN 'name ' || {as_text('p_partkey')} || ' north' WHEN p_partkey % 3 = 1 THEN p_name || ' plus' ELSE 'unrelated thing, something else' END AS alias FROM part
UNION ALL SELECT 'grid ' || {as_text('p_partkey')} AS key, 'grid ' || {as_text('CAST(floor(p_partkey / 3) AS BIGINT) * 3')} || ' joined' AS alias FROM part
UNION ALL SELECT 'grid ' || {as_text('p_partkey')} AS key, 'name ' || {as_text('p_partkey')} || ' grid ' || {as_text('p_partkey')} AS alias FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'Name ' || {as_text('p_partkey * 2')} AS key, 'name ' || {as_text('p_partkey * 2')} || ' grid ' || {as_text('p_partkey * 2')} AS alias FROM part WHERE p_partkey % 10 = 5
"""

_r3 = f"""named AS MATERIALIZED (SELECT component, arg_min(n, pl || CASE WHEN pl = '2' AND n = upper(n) THEN 'b' ELSE 'a' END || CASE WHEN pl = '2' THEN lpad(CAST(9999 - len(n) AS VARCHAR), 5, '0') ELSE '' END || n) AS canonical FROM (
  SELECT component, regexp_replace(trim(canonical), '\\s+', ' ', 'g') AS n, CASE source WHEN 's1' THEN '0' WHEN 's2' THEN '1' ELSE '2' END AS pl FROM name_sources JOIN comp ON alias_key = {_nk.format('canonical')}) q GROUP BY component),
 keyed AS MATERIALIZED (SELECT alias_key, canonical FROM comp JOIN named USING (component))"""
_words = "list_filter(string_split({0}, ' '), lambda w: len(w) > 3)[1]"


@query("r4_attach_auto_aliases", f"""WITH RECURSIVE {COMPONENTS}, {_r3},
 clean AS (SELECT regexp_replace(trim(key), '\\s+', ' ', 'g') AS key, {_nk.format('key')} AS kk, {_nk.format('alias')} AS ak FROM auto_names WHERE NOT contains(alias, ', ')),
 linked AS MATERIALIZED (SELECT DISTINCT kk, ak, k.canonical AS by_key, a.canonical AS by_alias FROM clean LEFT JOIN keyed k ON k.alias_key = kk LEFT JOIN keyed a ON a.alias_key = ak
   WHERE kk = ak OR (len(kk) > 3 AND len(ak) > 3 AND (contains(kk, ak) OR contains(ak, kk))) OR coalesce({_words.format('kk')} = {_words.format('ak')}, false)),
 own AS MATERIALIZED (SELECT kk, min(key) AS name FROM clean WHERE kk NOT IN (SELECT alias_key FROM keyed) GROUP BY kk),
 pairs AS MATERIALIZED (SELECT kk AS a, ak AS b FROM linked WHERE by_key IS NULL AND by_alias IS NULL UNION SELECT ak, kk FROM linked WHERE by_key IS NULL AND by_alias IS NULL
   UNION SELECT kk, kk FROM own UNION SELECT ak, ak FROM linked WHERE by_key IS NOT NULL AND by_alias IS NULL),
 walk(a, b) AS (SELECT a, b FROM pairs UNION SELECT w.a, p.b FROM walk w JOIN pairs p ON p.a = w.b), fresh AS (SELECT a AS node, min(least(a, b)) AS comp_id FROM walk GROUP BY 1),
 anchor AS (SELECT ak AS node, 0 AS place, by_key AS canonical FROM linked WHERE by_key IS NOT NULL AND by_alias IS NULL UNION ALL SELECT kk, 1, by_alias FROM linked WHERE by_key IS NULL AND by_alias IS NOT NULL
   UNION ALL SELECT kk, 2, name FROM own),
 best AS (SELECT comp_id, min((place, canonical)) AS t FROM anchor JOIN fresh USING (node) GROUP BY comp_id)
SELECT node AS alias_key, t[2] AS canonical, ['existing', 'via_alias', 'new'][t[1] + 1] AS placement FROM fresh JOIN best USING (comp_id)""", recursive=True)
def _(t):
    edges = cut_lineage(dictionary.name_edges(t.name_sources))
    groups = dictionary.merge_groups(edges)
    keyed = groups.join(dictionary.name_groups(edges, groups, "s1", "s2"), "component").select("alias_key", "canonical")
    return dictionary.attach_auto_aliases(t.auto_names, cut_lineage(keyed))


BINDINGS["brand_rows"] = """
SELECT canonical_id AS canonical, canonical_id || ' corp' AS alias_text FROM canonicals
"""
BINDINGS["brands"] = """
SELECT lower(canonical_id) AS legal_lower, CASE WHEN ordinal % 2 = 0 THEN canonical_id || ' Brand' ELSE split_part(canonical_id, ' ', 1) END AS brand FROM canonicals WHERE ordinal % 3 = 0
UNION ALL SELECT lower(canonical_id || ' corp') AS legal_lower, CASE WHEN ordinal % 5 = 0 THEN 'Exelon ' || canonical_id ELSE canonical_id || ' Power' END AS brand FROM canonicals
"""


@query("r5_choose_display", """
SELECT r.canonical, CASE WHEN o.brand IS NOT NULL THEN CASE WHEN len(o.brand) < len(r.canonical) AND contains(lower(r.canonical), lower(o.brand)) THEN r.canonical ELSE o.brand END
  WHEN a.brand IS NOT NULL AND NOT contains(lower(a.brand), 'exelon') THEN a.brand ELSE r.canonical END AS display_name
FROM brand_rows r LEFT JOIN brands o ON o.legal_lower = lower(r.canonical) LEFT JOIN brands a ON a.legal_lower = lower(alias_text)
""")
def _(t):
    return dictionary.choose_display(t.brand_rows, t.brands)


@query("r6_attach_parent", "SELECT canonical_id AS canonical, max(b.parent_company) AS parent_company FROM canonicals c LEFT JOIN (SELECT upper(canonical_id) AS child, parent_company FROM canonicals WHERE ordinal % 2 = 0) b ON lower(child) = lower(canonical_id) GROUP BY 1")
def _(t):
    parents = t.canonicals.where("ordinal % 2 = 0").select(F.upper("canonical_id").alias("child"), "parent_company")
    return dictionary.attach_parent(t.canonicals.select(F.col("canonical_id").alias("canonical")), parents)


@query("r7_detect_conflicts", f"WITH {EDGES} SELECT alias_key, count(DISTINCT canonical_key) AS n_canonicals FROM edges GROUP BY 1 HAVING count(DISTINCT canonical_key) > 1")
def _(t):
    return dictionary.detect_conflicts(dictionary.name_edges(t.name_sources)).select("alias_key", "n_canonicals")


@query("r8_single_source_groups", f"WITH {EDGES} SELECT canonical_key, min(source) AS source FROM edges GROUP BY 1 HAVING count(DISTINCT source) = 1")
def _(t):
    return dictionary.single_source_groups(dictionary.name_edges(t.name_sources))


BINDINGS["mergers"] = f"""
SELECT p_name || ' old ' || {as_text('p_partkey % 60')} AS old_name, {pick('p_partkey % 4', ['=p_name', ' Exelon ', "='Unknown ' || p_brand", "=p_name || ' Electric'"])} AS new_name, CASE WHEN p_partkey % 8 = 2 THEN p_name ELSE NULL END AS new_parent FROM part
"""


@query("r9_parent_errors", f"SELECT old_name, new_name, lower(trim(new_name)) IN {in_list(rules.HOLDING_NAMES_DICTIONARY)} AS is_error FROM mergers")
def _(t):
    good, bad = dictionary.parent_errors(t.mergers.select("old_name", "new_name"))
    return good.withColumn("is_error", F.lit(False)).unionByName(bad.withColumn("is_error", F.lit(True)))


BINDINGS["eia_found"] = "SELECT p_name AS canonical_id, CAST(p_partkey AS INT) AS eia_id FROM part WHERE p_partkey % 3 = 1"


@query("r10_add_eia_ids", """SELECT c.canonical_id, coalesce(CASE WHEN ordinal % 2 = 0 THEN c.eia_id END, f.eia_id) AS eia_id, CASE WHEN f.eia_id IS NULL THEN 'unmatched' WHEN ordinal % 2 = 0 THEN 'present' ELSE 'added' END AS eia_status
FROM canonicals c LEFT JOIN (SELECT canonical_id, min(eia_id) AS eia_id FROM eia_found GROUP BY 1) f USING (canonical_id)""")
def _(t):
    have = t.canonicals.select("canonical_id", F.when(F.col("ordinal") % 2 == 0, F.col("eia_id")).alias("eia_id"))
    return dictionary.add_eia_ids(have, t.eia_found)


@query("r11_ingest_mergers", """SELECT DISTINCT canonical_id, old_name AS alias, new_name, false AS unresolved FROM (SELECT m.old_name, trim(m.new_name) AS new_name, coalesce(a.canonical_id, b.canonical_id) AS canonical_id FROM mergers m LEFT JOIN alias_index a ON a.alias_lower = lower(trim(m.new_name)) LEFT JOIN alias_index b ON b.alias_lower = lower(m.new_parent)) q
 WHERE canonical_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM alias_index x WHERE x.alias_lower = lower(old_name) AND x.canonical_id = q.canonical_id)
UNION ALL SELECT NULL, old_name, trim(new_name), true FROM mergers m WHERE NOT EXISTS (SELECT 1 FROM alias_index a WHERE a.alias_lower IN (lower(trim(m.new_name)), lower(coalesce(m.new_parent, ''))))""")
def _(t):
    fresh, unresolved = dictionary.ingest_mergers(t.mergers, t.aliases)
    rest = unresolved.select(F.lit(None).cast("string").alias("canonical_id"), F.col("old_name").alias("alias"), "new_name", F.lit(True).alias("unresolved"))
    return fresh.withColumn("unresolved", F.lit(False)).unionByName(rest)


BINDINGS["edits"] = """
SELECT 'add_alias' AS action, canonical_id AS canonical, canonical_id || ' new' AS value, CAST(NULL AS STRING) AS display_name FROM canonicals WHERE ordinal % 3 = 0
UNION ALL SELECT 'remove_alias' AS action, canonical_id AS canonical, upper(canonical_id || ' electric') AS value, NULL AS display_name FROM canonicals WHERE ordinal % 4 = 1
UNION ALL SELECT 'delete_entry' AS action, canonical_id AS canonical, NULL AS value, NULL AS display_name FROM canonicals WHERE ordinal % 7 = 2
UNION ALL SELECT 'add_entry' AS action, 'Added ' || canonical_id AS canonical, parent_company AS value, NULL AS display_name FROM canonicals WHERE ordinal % 9 = 3
"""


@query("r12_apply_dictionary_edits", """
WITH al AS (SELECT canonical_id AS canonical, alias FROM dictionary UNION ALL SELECT canonical, value FROM edits WHERE action = 'add_alias'),
 kept AS (SELECT canonical, min(alias) AS alias FROM al WHERE canonical NOT IN (SELECT canonical FROM edits WHERE action = 'delete_entry') AND lower(alias) <> lower(canonical)
   AND NOT EXISTS (SELECT 1 FROM edits e WHERE action = 'remove_alias' AND e.canonical = al.canonical AND lower(value) = lower(alias)) GROUP BY canonical, lower(alias)),
 en AS (SELECT DISTINCT canonical_id AS canonical FROM dictionary WHERE canonical_id NOT IN (SELECT canonical FROM edits WHERE action = 'delete_entry') UNION SELECT canonical FROM edits WHERE action = 'add_entry')
SELECT en.canonical, alias FROM en LEFT JOIN kept USING (canonical)
""")
def _(t):
    entries = t.dictionary.select(F.col("canonical_id").alias("canonical"), "display_name", "parent_company").dropDuplicates(["canonical"])
    after, aliases = dictionary.apply_dictionary_edits(entries, t.dictionary.select(F.col("canonical_id").alias("canonical"), "alias"), t.edits)
    return after.select("canonical").join(aliases, "canonical", "left")


# ---- review loop -------------------------------------------------------------
def result_alternatives(t):
    alts = F.array(F.struct(F.col("tenant_normalized").alias("provider"), F.col("tenant_catalog_id").alias("catalog_id")), F.struct(F.lit("Other").alias("provider"), F.lit(None).cast("bigint").alias("catalog_id")))
    return t.results.withColumns({"alternatives": alts, "engine_id_match_score": F.lit(90.0)})


REVIEW = f"""SELECT address AS "Address", state AS "State", regexp_extract(address, '\\b(\\d{{5}})(?:-\\d{{4}})?\\s*$', 1) AS "ZIP", comparison AS "Match Status", tenant_normalized || coalesce(' (ID:' || tenant_catalog_id || ')', '') || ' | Other' AS "Alternatives (with IDs)", {REASON} AS "Review Reason", '' AS "Mapper Decision" FROM results"""
_seven = ["Address", "State", "ZIP", "Match Status", "Alternatives (with IDs)", "Review Reason", "Mapper Decision"]


@query("q1_build_review_rows", REVIEW)
def _(t):
    return review.build_review_rows(result_alternatives(t)).select(*[f"`{c}`" for c in _seven])


@query("q2_build_review_queue", REVIEW + f" WHERE {DUE}")
def _(t):
    return review.build_review_queue(result_alternatives(t)).select(*[f"`{c}`" for c in _seven])


BINDINGS["reviewed"] = f"""
SELECT row_id, address, state, utility_type, engine_provider, tenant_raw, {pick('row_id % 6', ['', 'Correct', 'Skip', 'Wrong - Use Alternative', 'Wrong - Manual Entry', 'Wrong - Manual Entry'])} AS decision,
  CASE WHEN row_id % 4 = 0 THEN '' ELSE 'Mapped ' || {as_text('row_id % 30')} END AS fixed, CASE WHEN row_id % 3 = 0 THEN {as_text('row_id % 70')} WHEN row_id % 3 = 1 THEN 'abc' ELSE '' END AS fixed_id FROM results
"""


def reviewed(t):
    names_ = {"Address": "address", "State": "state", "Utility Type": "utility_type", "Engine Provider": "engine_provider", "Tenant Provider": "tenant_raw", "Mapper Decision": "decision", "Mapper Corrected Provider": "fixed", "Mapper Corrected ID": "fixed_id"}
    return t.reviewed.select(*[F.col(names_[c]).alias(c) if c in names_ else F.lit("").alias(c) for c in rules.REVIEW_COLUMNS])


_fix = "CASE WHEN decision = 'Wrong - Use Alternative' THEN coalesce(nullif(fixed, ''), nullif(trim(tenant_raw), '')) WHEN decision = 'Wrong - Manual Entry' THEN nullif(fixed, '') END"


@query("q3_import_corrections", f"SELECT address, utility_type, {_fix} AS corrected_provider, TRY_CAST(fixed_id AS BIGINT) AS corrected_catalog_id FROM reviewed WHERE {_fix} IS NOT NULL")
def _(t):
    return review.import_corrections(reviewed(t))[0].select("address", "utility_type", "corrected_provider", "corrected_catalog_id")


_idok = f"decision = 'Wrong - Manual Entry' AND {_fix} IS NOT NULL AND coalesce(TRY_CAST(fixed_id AS BIGINT), 0) <> 0 AND coalesce(engine_provider, '') <> ''"


@query("q3_import_id_corrections", f"SELECT engine_provider AS engine_provider_name, utility_type, TRY_CAST(fixed_id AS BIGINT) AS correct_catalog_id FROM reviewed WHERE {_idok}")
def _(t):
    return review.import_corrections(reviewed(t))[1]


@query("q3_import_counts", f"SELECT count(*) FILTER (WHERE {_fix} IS NOT NULL) AS address_corrections, count(*) FILTER (WHERE {_idok}) AS id_corrections, count(*) FILTER (WHERE {_fix} IS NULL) AS skipped FROM reviewed")
def _(t):
    return review.import_corrections(reviewed(t))[2]


_pq = "engine_provider IS NOT NULL AND (engine_confidence < 0.8 OR comparison IN ('MISMATCH', 'MATCH_ALT'))"


@query("q4_queue_for_picks", f"SELECT utility_type, comparison, count(*) AS n FROM results WHERE {_pq} GROUP BY 1, 2")
def _(t):
    return review.pick_queue_counts(t.results)


BINDINGS["two_picks"] = f"""SELECT row_id, tenant_raw, {pick('row_id % 4', ['Duke', 'NONE', '=tenant_raw', 'Oncor Delivery'])} AS pick_a, {pick('row_id % 3', ['Reliant Energy', 'x', None])} AS pick_b FROM results WHERE tenant_raw IS NOT NULL"""


def _hit(p: str) -> str:
    return f"coalesce(upper({p}) <> 'NONE' AND {p} <> '' AND (contains(upper(tenant_raw), upper({p})) OR contains(upper({p}), upper(tenant_raw)) OR len(list_filter(string_split(upper(tenant_raw), ' '), lambda w: len(w) > 3 AND contains(upper({p}), w))) > 0), false)"


@query("q5_score_picks", f"SELECT count(*) AS total, count(*) FILTER (WHERE a) AS a_correct, count(*) FILTER (WHERE b) AS b_correct, count(*) FILTER (WHERE a AND b) AS \"both\", count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only FROM (SELECT {_hit('pick_a')} AS a, {_hit('pick_b')} AS b FROM two_picks) q")
def _(t):
    return review.score_picks(t.two_picks)


# ---- windows over logs -------------------------------------------------------
@query("w5_rolling_24h_count", """
SELECT a.event_id, count(DISTINCT b.event_id) - 1 AS recent_lookups, count(DISTINCT b.event_id) - 1 >= 5 AS limited FROM lookup_events a JOIN lookup_events b ON (b.email = a.email OR b.ip_address = a.ip_address) AND b.created_at <= a.created_at AND b.created_at > a.created_at - INTERVAL 24 HOURS GROUP BY a.event_id
""")
def _(t):
    return activity.lookup_limits(t.lookup_events).select("event_id", "recent_lookups", "limited")


@query("w6_latest_prior_event", """
SELECT click_id, lookup_id FROM (SELECT c.event_id AS click_id, l.event_id AS lookup_id, row_number() OVER (PARTITION BY c.event_id ORDER BY l.created_at DESC, l.event_id DESC) AS rn
 FROM (SELECT * FROM lookup_events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM lookup_events WHERE event_type = 'view') l ON (l.email = c.email OR l.ip_address = c.ip_address) AND l.created_at <= c.created_at) q WHERE rn = 1
""")
def _(t):
    e = t.lookup_events
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("created_at").alias("clicked_at"), "email", F.col("ip_address").alias("ref_code"))
    lookups = e.where("event_type = 'view'").select(F.col("event_id").alias("lookup_id"), "created_at", "email", F.col("ip_address").alias("ref_code"))
    return activity.attribute_clicks(clicks, lookups).select("click_id", "lookup_id")


RUNS = """g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts, call_id) AS grp FROM source_calls),
 runs AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source, grp ORDER BY ts, call_id) AS BIGINT) AS run_length FROM g),
 cb AS (SELECT call_id, source, CASE WHEN ok THEN 0 ELSE run_length END AS run_length, coalesce(lag(CASE WHEN ok THEN 0 ELSE run_length END) OVER w >= 3 AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {0} * CAST(1000000 AS BIGINT), false) AS disabled FROM runs WINDOW w AS (PARTITION BY source ORDER BY ts, call_id))"""


@query("w7_consecutive_failures", f"WITH {RUNS.replace('{0}', '7200')} SELECT call_id, source, run_length, run_length = 3 AS opens, disabled FROM cb")
def _(t):
    return activity.failure_runs(t.source_calls, cooldown=7200).select("call_id", "source", "run_length", "opens", "disabled")



@query("w1_first_by_priority", "SELECT address_id, source FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY source_ordinal) AS rn FROM candidates WHERE confidence >= 0.6) q WHERE rn = 1")
def _(t):
    from gridlocus.operators.lookups import first_by

    return first_by(t.candidates.where("confidence >= 0.6"), ["address_id"], [F.col("source_ordinal")]).select("address_id", "source")


@query("w2_best_per_group", "SELECT address_id, provider_name FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY confidence DESC, source_ordinal) AS rn FROM candidates) q WHERE rn = 1")
def _(t):
    best = F.min_by("provider_name", F.struct(-F.col("confidence"), F.col("source_ordinal")))
    return t.candidates.groupBy("address_id").agg(best.alias("provider_name"))


@query("w3_latest_per_key", "SELECT address, utility_type, corrected_provider FROM (SELECT *, row_number() OVER (PARTITION BY address, utility_type ORDER BY corrected_at DESC, correction_id DESC) AS rn FROM address_corrections) q WHERE rn = 1")
def _(t):
    from gridlocus.operators.lookups import latest_address_corrections

    return latest_address_corrections(t.address_corrections).select("address", "utility_type", "corrected_provider")


@query("w4_share_of_total", "SELECT comparison, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share_pct FROM results GROUP BY 1")
def _(t):
    counts = t.results.groupBy("comparison").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    # One row per category reaches the window.
    return counts.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


# ---- catalog reader ----------------------------------------------------------
@query("s13_read_catalog", """SELECT TRY_CAST("ID" AS BIGINT) AS catalog_id, "UtilityTypeId" AS type_id, trim("Title") AS title, coalesce("URL", '') AS url FROM catalog_raw WHERE TRY_CAST("ID" AS BIGINT) IS NOT NULL AND "UtilityTypeId" IN ('2', '3', '4', '5', '6', '7', '8')""")
def _(t):
    return clean_catalog(t.catalog_raw).select("catalog_id", "type_id", "title", "url")
