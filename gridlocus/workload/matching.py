"""Name matching, catalog matching and the name-keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlocus.functions import rules, similarity, text
from gridlocus.operators import blocking, catalog, dictionary, names
from gridlocus.session import cut_lineage
from gridlocus.sources.readers import clean_catalog
from gridlocus.workload.bindings import BINDINGS, pick
from gridlocus.workload.bindings import text as as_text
from gridlocus.workload.columns import registry
from gridlocus.workload.registry import in_list, indel, may_reach, query, quoted, sorted_words

CLEAN = r"regexp_replace(trim({0}), '\s+', ' ', 'g')"
FUZZ = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"


def match_ctes(source: str, score: float | None = 85.0, tag: str = "m") -> str:
    """Common table expressions ending in ``{tag}_match``: the single-segment match of
    every distinct ``name`` of the source query."""
    fuzzy = f"""
{tag}_left AS MATERIALIZED (SELECT lookup, {FUZZ.format('lookup')} AS a, {sorted_words(FUZZ.format('lookup'))} AS sa FROM {tag}_open),
{tag}_right AS MATERIALIZED (SELECT *, {FUZZ.format('alias_lower')} AS b, {sorted_words(FUZZ.format('alias_lower'))} AS sb FROM alias_index),
{tag}_pairs AS (SELECT lookup, alias_lower, canonical_id, display_name, ordinal, {indel('a', 'b')} AS s FROM {tag}_left, {tag}_right
   WHERE len(a) >= 4 AND len(b) >= 4 AND {may_reach('a', 'b', score or 0)}
   UNION ALL SELECT lookup, alias_lower, canonical_id, display_name, ordinal, 0.95 * {indel('sa', 'sb')} AS s FROM {tag}_left, {tag}_right
   WHERE len(a) >= 4 AND len(b) >= 4 AND {may_reach('sa', 'sb', (score or 0) / 0.95)}),
{tag}_fuzzy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY s DESC, ordinal, alias_lower) AS rn FROM {tag}_pairs WHERE s >= {score or 0}) x WHERE rn = 1),""" if score else f"""
{tag}_fuzzy AS (SELECT lookup, alias_lower, canonical_id, display_name, 0.0 AS s FROM {tag}_open JOIN alias_index ON false),"""
    return f"""
{tag}_names AS MATERIALIZED (SELECT DISTINCT name, {CLEAN.format('name')} AS cleaned, lower({CLEAN.format('name')}) AS lookup FROM ({source}) src),
{tag}_base AS (SELECT n.*, CASE WHEN lookup IN {in_list(rules.NULL_NAMES)} OR lookup = '' THEN 'null_value' WHEN lookup IN {in_list(rules.PROPANE_NAMES)} THEN 'propane'
   WHEN lookup IN {in_list(rules.HOLDING_NAMES)} THEN 'holding' END AS kind, rep_lower IS NOT NULL AS rep, e.alias_lower AS e_alias, e.canonical_id AS e_id, e.display_name AS e_name
   FROM {tag}_names n LEFT JOIN reps ON rep_lower = lookup LEFT JOIN alias_index e ON e.alias_lower = lookup),
{tag}_open AS MATERIALIZED (SELECT DISTINCT lookup FROM {tag}_base WHERE kind IS NULL AND NOT rep AND e_alias IS NULL),{fuzzy}
{tag}_inside AS (SELECT * FROM (SELECT lookup, alias_lower, canonical_id, display_name, row_number() OVER (PARTITION BY lookup ORDER BY len(alias_lower) DESC, ordinal, alias_lower) AS rn
   FROM {tag}_open JOIN alias_index ON len(lookup) > 4 AND len(alias_lower) >= 4 AND contains(lookup, alias_lower)) x WHERE rn = 1),
{tag}_hit AS (SELECT b.*, kind IS NULL AND NOT rep AS free, f.alias_lower AS f_alias, f.canonical_id AS f_id, f.display_name AS f_name, f.s, i.alias_lower AS i_alias, i.canonical_id AS i_id, i.display_name AS i_name
   FROM {tag}_base b LEFT JOIN {tag}_fuzzy f USING (lookup) LEFT JOIN {tag}_inside i USING (lookup)),
{tag}_match AS MATERIALIZED (SELECT name, cleaned, CASE WHEN free THEN coalesce(e_id, f_id, i_id) END AS canonical_id,
   CASE WHEN kind = 'null_value' THEN NULL WHEN free THEN coalesce(e_name, f_name, i_name, cleaned) ELSE cleaned END AS display_name,
   free AND coalesce(e_alias, f_alias, i_alias) IS NOT NULL AS matched, kind IS NULL AND rep AS is_rep,
   CASE WHEN kind IN ('null_value', 'propane') THEN kind WHEN NOT free THEN 'none' WHEN e_alias IS NOT NULL THEN 'exact' WHEN f_alias IS NOT NULL THEN 'fuzzy' WHEN i_alias IS NOT NULL THEN 'substring' ELSE 'none' END AS match_type,
   CASE WHEN NOT free THEN 0.0::DOUBLE WHEN e_alias IS NOT NULL THEN 100.0::DOUBLE WHEN f_alias IS NOT NULL THEN round(s, 1)::DOUBLE ELSE 0.0::DOUBLE END AS similarity,
   CASE WHEN free THEN coalesce(e_alias, f_alias, i_alias) END AS matched_on FROM {tag}_hit)"""


def segment_ctes(source: str, tag: str = "m") -> str:
    """``{tag}_seg``: name, cleaned, pos, segment."""
    return f"""
{tag}_whole AS (SELECT DISTINCT name, {CLEAN.format('name')} AS cleaned FROM ({source}) src),
{tag}_cut AS (SELECT name, cleaned, CASE WHEN NOT contains(cleaned, ',') OR alias_lower IS NOT NULL THEN [cleaned]
   ELSE list_filter(list_transform(string_split(cleaned, ','), lambda p: trim(p)), lambda p: p <> '') END AS parts
   FROM {tag}_whole LEFT JOIN alias_index ON contains(cleaned, ',') AND alias_lower = lower(cleaned) WHERE cleaned <> ''),
{tag}_seg AS MATERIALIZED (SELECT name, cleaned, CAST(i - 1 AS INT) AS pos, parts[i] AS segment FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM {tag}_cut) x)"""


RAW = "SELECT raw_name AS name FROM raw_names"
SEGMENTS = f"{segment_ctes(RAW)}, {match_ctes('SELECT segment AS name FROM m_seg')}, m_all AS (SELECT s.name, s.cleaned, pos, segment, canonical_id, display_name, matched, is_rep, match_type, similarity, matched_on FROM m_seg s JOIN m_match m ON m.name = s.segment)"


def raw(t):
    return t.raw_names.select(F.col("raw_name").alias("name"))


@query("n1_match_name", f"WITH {match_ctes(RAW)} SELECT name, canonical_id, display_name, matched, is_rep, match_type, similarity, matched_on FROM m_match")
def _(t):
    return names.match_name(raw(t), t.aliases, t.reps)


@query("n2_match_name_multi", f"WITH {SEGMENTS} SELECT * FROM m_all")
def _(t):
    return names.match_name_multi(raw(t), t.aliases, t.reps)


N3 = """SELECT name, coalesce(max(CASE WHEN rn = 1 AND matched THEN display_name END), max(CASE WHEN n = 1 THEN coalesce(display_name, '~null') ELSE cleaned END)) AS normalized
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, pos) AS rn, count(*) OVER (PARTITION BY name) AS n FROM m_all) x GROUP BY name"""


@query("n3_normalize_name", f"WITH {SEGMENTS} SELECT name, nullif(normalized, '~null') AS normalized FROM ({N3}) y")
def _(t):
    return names.resolve_names(raw(t), t.aliases, t.reps).select("name", "normalized")


@query("n4_match_name_best", f"""WITH {SEGMENTS} SELECT name, canonical_id, display_name, matched, is_rep, match_type, similarity, matched_on FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, CASE WHEN matched THEN similarity END DESC, pos) AS rn FROM m_all) x WHERE rn = 1""")
def _(t):
    return names.resolve_names(raw(t), t.aliases, t.reps).drop("normalized")


@query("n5_dictionary_lookup", f"""
SELECT p_partkey, a.canonical_id, a.display_name, nullif(a.parent_company, '') AS parent_company, nullif(a.eia_id, -1) AS eia_id, rep_name, rep_name IS NOT NULL AS is_rep,
  CASE WHEN rep_name IS NOT NULL THEN 'ERCOT' END AS market
FROM raw_names LEFT JOIN alias_index a ON alias_lower = lower({CLEAN.format('raw_name')}) LEFT JOIN reps ON rep_lower = lower({CLEAN.format('raw_name')})
""")
def _(t):
    found = names.rep_lookup(names.alias_lookup(t.raw_names, t.aliases, "raw_name"), t.reps, "raw_name")
    return found.drop("raw_name")


# Reported against engine names, for the pairwise tests.
BINDINGS["name_pairs"] = """
SELECT DISTINCT raw_name AS a, display_name AS b FROM (
  SELECT r.raw_name, c.display_name FROM raw_names r JOIN part p ON p.p_partkey = r.p_partkey JOIN canonicals c ON c.canonical_id = p.p_name
  UNION ALL SELECT r.raw_name, p.p_name || ' Corp - (TX)' AS display_name FROM raw_names r JOIN part p ON p.p_partkey = r.p_partkey + 1) x
WHERE raw_name IS NOT NULL
"""
BINDINGS["rebrands"] = """
SELECT 'water' AS utility_type, lower(canonical_id || ' water') AS name_lower, lower(display_name) AS renamed FROM canonicals WHERE ordinal % 2 = 0
UNION ALL SELECT 'electric' AS utility_type, lower(canonical_id || ' inc') AS name_lower, 'brand ' || lower(parent_company) AS renamed FROM canonicals WHERE ordinal % 3 = 0
UNION ALL SELECT 'gas' AS utility_type, lower(canonical_id || ' electric') AS name_lower, lower(display_name) AS renamed FROM canonicals
"""
CORE = "lower(trim({0}))"
for _p in rules.CORE_STRIP_PATTERNS:
    CORE = f"trim(regexp_replace({CORE}, '{_p}', '', 'g'))"
CORE = rf"trim(regexp_replace({CORE}, '\s+', ' ', 'g'))"


def over(a: str, b: str) -> str:
    return f"(len({a}) >= 4 AND len({b}) >= 4 AND (contains({a}, {b}) OR contains({b}, {a})))"


PAIR_NAMES = "SELECT a AS name FROM name_pairs UNION ALL SELECT b AS name FROM name_pairs"
FACTS = f"""{segment_ctes(PAIR_NAMES)}, {match_ctes('SELECT segment AS name FROM m_seg')},
 m_all AS (SELECT s.name, s.cleaned, pos, segment, canonical_id, display_name, matched, is_rep, match_type, similarity, matched_on FROM m_seg s JOIN m_match m ON m.name = s.segment),
 m_best AS (SELECT name, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, CASE WHEN matched THEN similarity END DESC, pos) AS rn FROM m_all) x WHERE rn = 1),
 m_norm AS (SELECT name, nullif(normalized, '~null') AS normalized FROM ({N3}) y),
 facts AS MATERIALIZED (SELECT name, lower(trim(name)) AS lower_name, {CORE.replace('{0}', 'name')} AS core, canonical_id, normalized FROM m_best JOIN m_norm USING (name))"""


@query("n7_names_match", f"""WITH {FACTS} SELECT p.a, p.b,
  x.lower_name = y.lower_name OR {over('x.lower_name', 'y.lower_name')} OR {over('x.core', 'y.core')} OR coalesce(x.canonical_id = y.canonical_id, false)
  OR (coalesce(x.normalized, '') <> '' AND coalesce(y.normalized, '') <> '' AND (contains(lower(x.normalized), lower(y.normalized)) OR contains(lower(y.normalized), lower(x.normalized)))) AS same
FROM name_pairs p JOIN facts x ON x.name = p.a JOIN facts y ON y.name = p.b""")
def _(t):
    return with_pair_facts(t).select("a", "b", names.names_match(F.col("fa"), F.col("fb")).alias("same"))


def with_pair_facts(t):
    pairs = t.name_pairs
    used = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
    facts = names.name_facts(used, t.aliases, t.reps, t.rebrands, names.parent_table(t.spark))
    return pairs.join(facts.select(F.col("name").alias("a"), F.col("facts").alias("fa")), "a").join(
        facts.select(F.col("name").alias("b"), F.col("facts").alias("fb")), "b")


_generic = in_list(rules.WATER_GENERIC_WORDS)
BINDINGS["water_pairs"] = """
SELECT 'City of ' || s_name AS a, CASE s_suppkey % 5 WHEN 0 THEN upper(s_name) WHEN 1 THEN 'Town of ' || s_name WHEN 2 THEN 'Supplier' WHEN 3 THEN 'Elsewhere' ELSE s_name || ' renamed' END AS b FROM supplier
"""
BINDINGS["water_aliases"] = "SELECT 'water' AS utility_type, 'elsewhere' AS name_lower, 'city of supplier#000000003' AS renamed FROM supplier WHERE s_suppkey = 0"


@query("n9_water_names_match", f"""
SELECT a, b, aa = ab OR (a2 = b2 OR {over('na', 'nb')} OR (least(len(ca), len(cb)) > 0 AND len(list_intersect(ca, cb)) >= least(len(ca), len(cb)))) AS same FROM (
 SELECT a, b, lower(a) AS na, lower(b) AS nb, coalesce(x.renamed, lower(a)) AS aa, coalesce(y.renamed, lower(b)) AS ab, coalesce(x.renamed, lower(a)) AS a2, coalesce(y.renamed, lower(b)) AS b2,
   list_filter(list_distinct(string_split(lower(a), ' ')), lambda w: w NOT IN {_generic}) AS ca, list_filter(list_distinct(string_split(lower(b), ' ')), lambda w: w NOT IN {_generic}) AS cb
 FROM water_pairs LEFT JOIN water_aliases x ON x.name_lower = lower(a) LEFT JOIN water_aliases y ON y.name_lower = lower(b)) z
""")
def _(t):
    pairs = t.water_pairs
    used = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
    facts = names.name_facts(used, t.aliases, None, t.water_aliases, names.parent_table(t.spark), min_score=None)
    joined = pairs.join(facts.select(F.col("name").alias("a"), F.col("facts").alias("fa")), "a").join(
        facts.select(F.col("name").alias("b"), F.col("facts").alias("fb")), "b")
    return joined.select("a", "b", names.water_names_match(F.col("fa"), F.col("fb")).alias("same"))


# ---- similarity --------------------------------------------------------------
BINDINGS["part_pairs"] = """
SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1
"""


@query("f5_indel_ratio", f"SELECT a, b, round({indel('a', 'b')}, 6) AS score FROM part_pairs")
def _(t):
    return t.part_pairs.select("a", "b", F.round(similarity.indel_ratio("a", "b"), 6).alias("score"))


@query("f2_token_sort_ratio", f"SELECT a, b, round({indel('sa', 'sb')}, 6) AS score FROM (SELECT a, b, {sorted_words('a')} AS sa, {sorted_words('b')} AS sb FROM part_pairs) x")
def _(t):
    return t.part_pairs.select("a", "b", F.round(similarity.token_sort_ratio("a", "b"), 6).alias("score"))


@query("f3_fuzzy_score", f"SELECT a, b, round(greatest({indel('a', 'b')}, 0.95 * {indel('sa', 'sb')}), 6) AS score FROM (SELECT a, b, {sorted_words('a')} AS sa, {sorted_words('b')} AS sb FROM part_pairs) x")
def _(t):
    return t.part_pairs.select("a", "b", F.round(similarity.fuzzy_score("a", "b"), 6).alias("score"))


_words = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
TOKEN_SET = f"""CASE WHEN len(s) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 100.0::DOUBLE ELSE greatest({indel('sl', 'sr')},
  CASE WHEN len(s) > 0 THEN {indel('s', 'sl')} ELSE 0 END, CASE WHEN len(s) > 0 THEN {indel('s', 'sr')} ELSE 0 END) END"""


def token_set_rows(source: str, keep: str) -> str:
    ta, tb = _words.format("a"), _words.format("b")
    return f"""SELECT {keep}, s, l, r, trim(s || ' ' || l) AS sl, trim(s || ' ' || r) AS sr FROM (SELECT {keep}, array_to_string(list_sort(list_intersect({ta}, {tb})), ' ') AS s,
      array_to_string(list_sort(list_filter({ta}, lambda w: NOT list_contains({tb}, w))), ' ') AS l, array_to_string(list_sort(list_filter({tb}, lambda w: NOT list_contains({ta}, w))), ' ') AS r FROM {source}) q"""


@query("f4_token_set_ratio", f"SELECT a, b, round({TOKEN_SET}, 6) AS score FROM ({token_set_rows('part_pairs', 'a, b')}) z")
def _(t):
    return t.part_pairs.select("a", "b", F.round(similarity.token_set_ratio("a", "b"), 6).alias("score"))


@query("f1_block_pairs", f"""
WITH l AS MATERIALIZED (SELECT DISTINCT {FUZZ.format('raw_name')} AS a FROM raw_names), r AS MATERIALIZED (SELECT DISTINCT {FUZZ.format('alias_lower')} AS b FROM alias_index)
SELECT a, b, round(s, 6) AS score FROM (SELECT a, b, {indel('a', 'b')} AS s FROM l, r WHERE len(a) > 0 AND len(b) > 0 AND {may_reach('a', 'b', 85)}) x WHERE s >= 85
""")
def _(t):
    left = t.raw_names.select(text.normalize_for_fuzzy("raw_name").alias("a")).distinct()
    right = t.alias_index.select(text.normalize_for_fuzzy("alias_lower").alias("b")).distinct()
    return blocking.similar_pairs(left, right, "a", "b", 85.0).select("a", "b", F.round("score", 6).alias("score"))


# ---- catalog -----------------------------------------------------------------
def prepared(t):
    return cut_lineage(catalog.prepare_catalog(clean_catalog(t.catalog_raw)))


BINDINGS["asked_names"] = f"""
SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Corporation' WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
   WHEN 3 THEN p_name || ' of the north' WHEN 4 THEN substr(p_name, 2) ELSE 'mapped ' || {as_text('p_partkey % 20')} END AS name,
   {pick('p_partkey % 3', ['electric', 'gas', 'water'])} AS utility_type, {pick('p_partkey % 3', ['TX', 'GA', 'OH'])} AS state FROM part
"""
BINDINGS["id_corrections"] = f"""
SELECT 'Mapped ' || {as_text('p_partkey % 20')} AS engine_provider_name, {pick('p_partkey % 3', ['electric', 'gas', 'water'])} AS utility_type, min(p_partkey * 4) AS correct_catalog_id FROM part WHERE p_partkey % 7 = 1 GROUP BY 1, 2
"""
CAT = r"""cat AS MATERIALIZED (SELECT catalog_id, type_id, title, ordinal, norm, """ + sorted_words("norm") + r""" AS snorm FROM (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN b LIKE '% corp' THEN left(b, len(b) - 5) ELSE b END, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm
  FROM (SELECT TRY_CAST("ID" AS BIGINT) AS catalog_id, "UtilityTypeId" AS type_id, trim("Title") AS title, ordinal,
    regexp_replace(regexp_replace(regexp_replace(lower(trim("Title")), ' elec$', ' electric'), '\s*[-–]\s*\(?[a-z]{2}\)?\s*$', ''), '\s*\([a-z]{2}\)\s*$', '') AS b FROM catalog_raw) q
  WHERE catalog_id IS NOT NULL AND type_id IN ('2', '3', '4', '5', '6', '7', '8')) q2)"""
ASK = r"""ask AS MATERIALIZED (SELECT name, utility_type, state, CASE utility_type WHEN 'electric' THEN '2' WHEN 'gas' THEN '4' WHEN 'water' THEN '3' END AS type_id, n AS norm, """ + sorted_words("n") + r""" AS snorm
  FROM (SELECT *, trim(regexp_replace(CASE WHEN lower(name) LIKE '% corporation' THEN left(lower(name), len(name) - 12) ELSE lower(name) END, '\s+', ' ', 'g')) AS n FROM asked_names) q)"""
FORCED = """forced AS (SELECT lower(engine_provider_name) AS norm, utility_type, min(catalog_id) AS catalog_id FROM id_corrections JOIN cat ON correct_catalog_id = catalog_id GROUP BY 1, 2)"""
STAGED = f"""
  st0 AS (SELECT a.*, 0 AS stage, 100.0::DOUBLE AS score, f.catalog_id, 0 AS ord FROM ask a JOIN forced f USING (norm, utility_type)),
  st1 AS (SELECT a.*, 1 AS stage, 100.0::DOUBLE AS score, catalog_id, ordinal AS ord FROM ask a JOIN cat c USING (type_id, norm)),
  done AS (SELECT name, utility_type, state FROM st0 UNION SELECT name, utility_type, state FROM st1),
  rest AS MATERIALIZED (SELECT * FROM ask ANTI JOIN done USING (name, utility_type, state)),
  st2 AS (SELECT * FROM (SELECT a.*, 2 AS stage, {indel('a.snorm', 'c.snorm')} AS score, catalog_id, ordinal AS ord FROM rest a JOIN cat c ON a.type_id = c.type_id
       AND list_contains(regexp_extract_all(upper(title), '[A-Z]+'), state) AND {may_reach('a.snorm', 'c.snorm', 70)}) q WHERE score >= 70),
  forms AS MATERIALIZED (SELECT DISTINCT type_id, snorm, norm FROM cat),
  st3f AS (SELECT * FROM (SELECT a.*, {indel('a.snorm', 'c.snorm')} AS score, c.norm AS cnorm, c.snorm AS csnorm FROM rest a JOIN forms c ON a.type_id = c.type_id AND {may_reach('a.snorm', 'c.snorm', 82)}) q WHERE score >= 82),
  st3 AS (SELECT s.name, s.utility_type, s.state, s.type_id, s.norm, s.snorm, 3 AS stage, s.score, catalog_id, ordinal AS ord FROM st3f s JOIN cat c ON c.type_id = s.type_id AND c.norm = s.cnorm),
  done2 AS (SELECT name, utility_type, state FROM st2 UNION SELECT name, utility_type, state FROM st3),
  rest2 AS MATERIALIZED (SELECT DISTINCT a.name, a.utility_type, a.state, a.type_id, a.norm, a.snorm, a.norm AS a, c.norm AS b FROM (SELECT * FROM rest ANTI JOIN done2 USING (name, utility_type, state)) a JOIN forms c ON a.type_id = c.type_id),
  st4f AS (SELECT * FROM (SELECT *, {TOKEN_SET} AS score FROM ({token_set_rows('rest2', 'name, utility_type, state, type_id, norm, snorm, a, b')}) z) q WHERE score >= 90),
  st4 AS (SELECT s.name, s.utility_type, s.state, s.type_id, s.norm, s.snorm, 4 AS stage, score, catalog_id, ordinal AS ord FROM st4f s JOIN cat c ON c.type_id = s.type_id AND c.norm = s.b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name, utility_type, state ORDER BY stage, score DESC, ord) AS rn FROM (SELECT * FROM st0 UNION ALL SELECT * FROM st1 UNION ALL SELECT * FROM st2 UNION ALL SELECT * FROM st3 UNION ALL SELECT * FROM st4) q),
  best AS (SELECT * FROM ranked WHERE rn = 1)"""


@query("n6_match_catalog", f"""WITH {CAT}, {ASK}, {FORCED}, {STAGED}
SELECT a.name, a.utility_type, a.state, b.catalog_id, c.title AS catalog_title, CASE WHEN b.stage >= 3 THEN floor(score)::DOUBLE ELSE round(score, 6)::DOUBLE END AS id_match_score,
  CASE b.stage WHEN 0 THEN 'override' WHEN 1 THEN 'exact' WHEN 2 THEN 'state_specific' WHEN 3 THEN 'fuzzy' WHEN 4 THEN 'fuzzy_set' END AS id_match_method,
  CASE WHEN b.stage >= 3 THEN floor(score) ELSE score END >= 85 AS id_confident
FROM ask a LEFT JOIN best b USING (name, utility_type, state) LEFT JOIN cat c ON c.catalog_id = b.catalog_id""")
def _(t):
    out = catalog.match_catalog(t.asked_names, prepared(t), catalog.catalog_overrides(t.id_corrections))
    return out.withColumn("id_match_score", F.round("id_match_score", 6))


@query("j16_catalog_override_join", f"WITH {CAT}, {ASK}, {FORCED} SELECT a.name, a.utility_type, a.state, f.catalog_id FROM ask a JOIN forced f USING (norm, utility_type)")
def _(t):
    out = catalog.match_catalog(t.asked_names, prepared(t), catalog.catalog_overrides(t.id_corrections), fuzzy=False)
    return out.where("id_match_method = 'override'").select("name", "utility_type", "state", "catalog_id")


@query("j17_catalog_alias_join", "SELECT p_partkey, coalesce(canonical_id, CAST(p_partkey AS VARCHAR)) AS canonical FROM part LEFT JOIN catalog_aliases ON alias_id = CAST(p_partkey AS VARCHAR)")
def _(t):
    return catalog.catalog_alias(t.part.select("p_partkey"), t.catalog_aliases, "p_partkey", "canonical")


@query("j17_catalog_alias_closure", """
WITH RECURSIVE chain AS (SELECT alias_id, canonical_id, 1 AS hops FROM catalog_aliases UNION ALL SELECT c.alias_id, a.canonical_id, hops + 1 FROM chain c JOIN catalog_aliases a ON a.alias_id = c.canonical_id)
SELECT alias_id, arg_max(canonical_id, hops) AS canonical_id FROM chain GROUP BY alias_id
""", recursive=True)
def _(t):
    return catalog.close_catalog_aliases(t.catalog_aliases)


@query("r13_rewrite_catalog_ids", """
SELECT r.row_id, coalesce(e.canonical_id, CAST(engine_catalog_id AS VARCHAR)) AS engine_id, coalesce(u.canonical_id, CAST(tenant_catalog_id AS VARCHAR)) AS tenant_id
FROM results r LEFT JOIN catalog_aliases e ON e.alias_id = CAST(engine_catalog_id AS VARCHAR) LEFT JOIN catalog_aliases u ON u.alias_id = CAST(tenant_catalog_id AS VARCHAR)
""")
def _(t):
    out = catalog.catalog_alias(t.results.select("row_id", "engine_catalog_id", "tenant_catalog_id"), t.catalog_aliases, "engine_catalog_id", "engine_id")
    return catalog.catalog_alias(out, t.catalog_aliases, "tenant_catalog_id", "tenant_id").select("row_id", "engine_id", "tenant_id")


BINDINGS["answer_rows"] = f"""
SELECT c_custkey AS row_id, {pick('c_custkey % 2', ['electric', 'gas'])} AS utility_type, {pick('c_custkey % 3', ['TX', 'GA', 'OH'])} AS state, a.p_name AS provider, b.p_name || ' Corporation' AS alt1, c.p_name AS alt2
FROM customer JOIN part a ON a.p_partkey = c_custkey JOIN part b ON b.p_partkey = c_custkey + 1 JOIN part c ON c.p_partkey = c_custkey + 2
"""


@query("v16_attach_catalog_ids", f"""WITH {CAT}, lk AS (SELECT type_id, norm, min(catalog_id) AS catalog_id FROM (SELECT type_id, norm, arg_min(catalog_id, ordinal) AS catalog_id FROM cat GROUP BY 1, 2) q GROUP BY 1, 2),
  r AS (SELECT *, CASE utility_type WHEN 'electric' THEN '2' ELSE '4' END AS type_id FROM answer_rows)
SELECT row_id, p.catalog_id, coalesce(CAST(x.catalog_id AS VARCHAR), '-') || '|' || coalesce(CAST(y.catalog_id AS VARCHAR), '-') AS alt_ids
FROM r LEFT JOIN lk p ON p.type_id = r.type_id AND p.norm = provider LEFT JOIN lk x ON x.type_id = r.type_id AND x.norm = replace(alt1, ' Corporation', '') LEFT JOIN lk y ON y.type_id = r.type_id AND y.norm = alt2""")
def _(t):
    rows = t.answer_rows.select("row_id", "utility_type", "state", "provider", F.array(F.struct(F.col("alt1").alias("provider")), F.struct(F.col("alt2").alias("provider"))).alias("alternatives"))
    out = catalog.attach_catalog_ids(rows, prepared(t))
    return out.select("row_id", "catalog_id", F.array_join(F.transform("alternatives", lambda a: F.coalesce(a["catalog_id"].cast("string"), F.lit("-"))), "|").alias("alt_ids"))


# ---- name-keyed joins --------------------------------------------------------
BINDINGS["named_rows"] = f"""
SELECT p_partkey, {pick('p_partkey % 3', ['water', 'electric', 'gas'])} AS utility_type, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ' Water' WHEN p_partkey % 3 = 1 THEN p_name || ' Inc' ELSE ' ' || p_name || ' electric' END AS name FROM part
"""


@query("j25_rebrand_join", "SELECT p_partkey, coalesce(renamed, lower(trim(name))) AS rebranded FROM named_rows n LEFT JOIN rebrands r ON r.utility_type = n.utility_type AND name_lower = lower(trim(name))")
def _(t):
    return names.rebrand(t.named_rows, t.rebrands).select("p_partkey", "rebranded")


def parent_values() -> str:
    table: dict[str, str] = {}
    for parent, listed in rules.PARENT_GROUPS.items():
        for n in listed:
            table[n.lower()] = parent
    return ", ".join(f"({quoted(n)}, {quoted(p)}, {i})" for i, (n, p) in enumerate(table.items()))


BINDINGS["family_names"] = f"""
SELECT DISTINCT {pick('s_suppkey % 9', ['Duke', "='Dominion Energy ' || s_name", 'dominion energy', 'AEP', "='Met-Ed of ' || s_name", 'Gas', "=upper(s_name)", 'Questar Gas', 'ipl power'])} AS name FROM supplier
"""


@query("j26_parent_join", f"""
WITH parents(name_lower, parent, ordinal) AS (VALUES {parent_values()})
SELECT name, coalesce((SELECT parent FROM parents WHERE name_lower = lower(trim(name))), (SELECT arg_min(parent, ordinal) FROM parents WHERE contains(name_lower, lower(trim(name))) OR contains(lower(trim(name)), name_lower))) AS parent
FROM family_names
""")
def _(t):
    return names.parent_of(t.family_names, names.parent_table(t.spark))


CROSS = f"""direct AS (SELECT g.eia_id, arg_min(canonical_id, pos) AS canonical_id, arg_min(name, pos) AS matched_name FROM registry_names g JOIN alias_index ON alias_lower = lower(trim(name)) GROUP BY g.eia_id),
  open_names AS (SELECT eia_id, pos, name FROM registry_names ANTI JOIN direct USING (eia_id)), {segment_ctes('SELECT name FROM open_names')}, {match_ctes('SELECT segment AS name FROM m_seg')},
  m_all AS (SELECT s.name, s.cleaned, pos, segment, canonical_id, matched, match_type, similarity FROM m_seg s JOIN m_match m ON m.name = s.segment),
  m_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN matched THEN 0 ELSE 1 END, CASE WHEN matched THEN similarity END DESC, pos) AS rn FROM m_all) x WHERE rn = 1 AND matched AND match_type IN ('exact', 'fuzzy')),
  scored AS (SELECT eia_id, arg_min(b.canonical_id, o.pos) AS canonical_id, arg_min(o.name, o.pos) AS matched_name FROM open_names o JOIN m_best b USING (name) GROUP BY eia_id),
  crossed AS (SELECT e.eia_id, coalesce(d.canonical_id, s.canonical_id) AS canonical_id, coalesce(d.matched_name, s.matched_name) AS matched_name FROM (SELECT DISTINCT eia_id FROM registry_names) e LEFT JOIN direct d USING (eia_id) LEFT JOIN scored s USING (eia_id))"""


@query("j27_registry_crossref", f"WITH {CROSS} SELECT eia_id, canonical_id, matched_name, canonical_id IS NOT NULL AS matched FROM crossed")
def _(t):
    return names.registry_crossref(registry(t), t.aliases, t.reps).drop("names")


@query("g29_registry_coverage", f"WITH {CROSS} SELECT count(*) AS entities, count(canonical_id) AS matched, round(100.0 * count(canonical_id) / count(*), 6) AS matched_pct FROM crossed")
def _(t):
    return dictionary.registry_coverage(names.registry_crossref(registry(t), t.aliases, t.reps)).withColumn("matched_pct", F.round("matched_pct", 6))
