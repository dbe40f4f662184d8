"""Domain tables as projections of the given tables.

The text of a binding is plain SQL that Spark and DuckDB read alike, so that a query
and its check start from the same rows.  Two markers differ per engine:
``@SERIES(n)`` (the numbers 0 … n-1, one row each) and ``@MAXBY``/``@MINBY``.
Every table here grows with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

STATES = ["TX", "GA", "CA", "NC", "FL", "OH", "IL", "PA", "NY", "AZ"]


def pick(expression: str, values: list, default: str | None = None) -> str:
    """CASE over the numbers 0, 1, …"""
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) and not v.startswith("=") else str(v).lstrip("="))

    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {expression} {arms} {'ELSE ' + default if default else ''} END"


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def pad(expression: str, n: int) -> str:
    return f"lpad({text(expression)}, {n}, '0')"


_state = pick("c_nationkey % 10", STATES)
_zip = pad("c_custkey * 7919 % 100000", 5)

BINDINGS: dict[str, str] = {}

# B1/B2: addresses with coordinates.  Blocks of 1,500 customers and of 100 suppliers
# share a tile of 100 x 100 units, so density stays the same at every scale.
BINDINGS["addresses"] = f"""
SELECT c_custkey AS address_id,
       {text('c_custkey')} || pick_street || n_name || ', ' || {_state} ||
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ' ' || {_zip} END ||
         CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 = 0 THEN '-1234' ELSE '' END AS address,
       n_name AS city, {_state} AS state,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_zip} END AS zip_code,
       n_name || ' County' AS county,
       CASE WHEN c_custkey % 97 = 0 THEN 0e0 ELSE (c_custkey * 37 % 1000) / 1e1 + 13e-3 + 100 * (floor(c_custkey / 15e2) % 100) END AS lon,
       CASE WHEN c_custkey % 97 = 0 THEN 0e0 ELSE (c_custkey * 91 % 1000) / 1e1 + 17e-3 + 100 * floor(floor(c_custkey / 15e2) / 100) END AS lat,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE '48' || {pad('c_nationkey', 3)} || {pad('c_custkey % 1000000', 6)} || {pad('c_custkey % 7', 4)} END AS block_geoid
FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN ' North  Oak Avenue, ' ELSE ' Main Street, ' END AS pick_street FROM customer) c
JOIN nation ON c_nationkey = n_nationkey
"""

_layers = []
for _i, (_layer, _mx, _my) in enumerate([("electric", 53, 29), ("gas", 31, 67), ("water", 71, 43)]):
    _names = {
        "electric": ["ONCOR ELECTRIC DELIVERY COMPANY LLC", "DUKE ENERGY CAROLINAS, LLC", "TEXAS-NEW MEXICO POWER CO",
                     "=upper(s_name) || ' ELECTRIC COOP'", "=upper(s_name) || ' POWER INC'"],
        "gas": ["=upper(s_name) || ' GAS CO'", "ATMOS ENERGY CORP", "=s_name || ' Gas'", "=upper(s_name) || ' NATURAL GAS COMPANY'", "Nicor Gas"],
        "water": ["=upper(s_name) || ' MUD'", "=s_name || ', CITY OF'", "=upper(s_name) || ' WSC'", "=s_name || ' Court'", "=upper(s_name) || ' WATER CO'"],
    }[_layer]
    _layers.append(f"""
SELECT '{_layer}' AS layer, s_suppkey * 3 + {_i} AS territory_id,
       {pick('s_suppkey % 5', _names)} AS name,
       {pick('s_nationkey % 5', STATES[:5])} AS state,
       {pick('s_suppkey % 4', ['INVESTOR OWNED', 'COOPERATIVE', 'MUNICIPAL', 'NOT AVAILABLE'])} AS type,
       CASE WHEN s_suppkey % 3 = 0 THEN 'ERCOT' ELSE 'PJM' END AS cntrl_area,
       CASE WHEN s_suppkey % 10 = 0 THEN 0 WHEN s_suppkey % 23 = 0 THEN NULL ELSE CAST(floor(abs(s_acctbal) * 10) AS BIGINT) END AS customers,
       CASE WHEN s_suppkey % 4 = 0 THEN {text('s_suppkey % 200')} || '.0' ELSE NULL END AS eia_id,
       CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE 2e0 * (2 + s_suppkey % 9) * (2 + s_suppkey % 9) * CASE WHEN s_suppkey % 6 = 0 THEN 100 ELSE 1 END END AS area_km2,
       (s_suppkey * {_mx} % 100) + 100 * (floor(s_suppkey / 1e2) % 100) AS cx,
       (s_suppkey * {_my} % 100) + 100 * floor(floor(s_suppkey / 1e2) / 100) AS cy,
       2e0 + s_suppkey % 9 AS r
FROM supplier""")
BINDINGS["territories"] = " UNION ALL ".join(_layers)

# B3: provider names, the dictionary, retail names.
BINDINGS["canonicals"] = """
SELECT p_name AS canonical_id, p_name || ' Energy' AS display_name, min(p_brand) AS parent_company,
       CAST(min(p_partkey) AS INT) AS eia_id, min(p_partkey) AS ordinal
FROM part GROUP BY p_name
"""
BINDINGS["dictionary"] = """
SELECT canonical_id, CASE WHEN ordinal % 3 = 0 THEN canonical_id ELSE display_name END AS display_name,
       CASE WHEN ordinal % 2 = 0 THEN parent_company ELSE NULL END AS parent_company,
       CASE WHEN ordinal % 5 = 4 THEN NULL ELSE eia_id END AS eia_id, ordinal,
       CASE k WHEN 0 THEN canonical_id WHEN 1 THEN canonical_id || ' electric' WHEN 2 THEN replace(canonical_id, ' ', '-')
              WHEN 3 THEN split_part(canonical_id, ' ', 1) || ' power' ELSE canonical_id || ', the' END AS alias
FROM (SELECT *, @SERIES(5) AS k FROM canonicals) x
"""
BINDINGS["alias_index"] = """
SELECT lower(alias) AS alias_lower, max_by(canonical_id, ordinal) AS canonical_id, max_by(display_name, ordinal) AS display_name,
       max_by(coalesce(parent_company, ''), ordinal) AS parent_company, max_by(coalesce(eia_id, -1), ordinal) AS eia_id, min(ordinal) AS ordinal
FROM dictionary GROUP BY lower(alias)
"""
BINDINGS["reps"] = """
SELECT lower(p_name || ' retail') AS rep_lower, min(p_name || ' Retail') AS rep_name FROM part WHERE p_partkey % 4 = 0 GROUP BY lower(p_name || ' retail')
"""
BINDINGS["raw_names"] = f"""
SELECT p_partkey, CASE p_partkey % 11
    WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || replace(p_name, ' ', '  ') || ' ' WHEN 2 THEN p_name || ' Inc'
    WHEN 3 THEN p_name || ' Electric' WHEN 4 THEN p_name || ' district ' || {text('p_partkey % 100')}
    WHEN 5 THEN {pick('p_partkey % 5', ['n/a', 'AmeriGas', 'Exelon', 'landlord', '=upper(p_name)'])}
    WHEN 6 THEN substr(p_name, 1, 3) || substr(p_name, 5) WHEN 7 THEN p_name || ', somebody else ' || {text('p_partkey % 10')}
    WHEN 8 THEN p_name || ' retail' WHEN 9 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    ELSE p_name || ', the' END AS raw_name
FROM part
"""

# B4: keyed lookup tables, filled from customers so that they grow and are hit.
_name_of = "p_name"
BINDINGS["customer_names"] = f"""
SELECT c_custkey, {_zip} AS zip, {_state} AS state, n_name, p_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = c_custkey
"""
BINDINGS["address_corrections"] = f"""
SELECT a.address_id AS correction_id, a.address, a.lat, a.lon, a.zip_code, a.state,
       {pick('a.address_id % 3', ['electric', 'gas', 'water'])} AS utility_type,
       'Corrected ' || {text('a.address_id % 40')} AS corrected_provider, o_orderdate AS corrected_at
FROM (SELECT addresses.*, o.o_orderdate FROM addresses JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey) o
      ON o_custkey = address_id WHERE address_id % 7 = 0) a
"""
BINDINGS["zip_corrections"] = f"""
SELECT {pick('c_custkey % 3', ['electric', 'gas', 'water'])} AS utility_type, zip AS zip_code,
       min('Zip fix ' || {text('c_custkey % 30')}) AS provider, CAST(NULL AS DOUBLE) AS confidence
FROM customer_names WHERE c_custkey % 5 = 0 GROUP BY 1, 2
"""
BINDINGS["gas_mapping"] = f"""
SELECT state, 'override' AS key_kind, zip AS key, min(p_name) AS name FROM customer_names WHERE c_custkey % 13 = 0 GROUP BY 1, 2, 3
UNION ALL SELECT state, 'ambiguous' AS key_kind, zip AS key, min(p_name || ' gas') AS name FROM customer_names WHERE c_custkey % 17 = 0 GROUP BY 1, 2, 3
UNION ALL SELECT state, 'prefix' AS key_kind, substr(zip, 1, 3) AS key, min('Prefix ' || p_name) AS name FROM customer_names WHERE c_custkey % 4 = 0 GROUP BY 1, 2, 3
"""
BINDINGS["county_gas"] = """
SELECT state, 'city' AS kind, lower(n_name) AS key_lower, min('City gas ' || p_name) AS utility FROM customer_names WHERE c_custkey % 3 = 0 AND state IN ('IL', 'PA') GROUP BY 1, 2, 3
UNION ALL SELECT state, 'county' AS kind, lower(n_name) AS key_lower, min('County gas ' || p_name) AS utility FROM customer_names WHERE state IN ('IL', 'NY') GROUP BY 1, 2, 3
UNION ALL SELECT state, 'default' AS kind, '_default' AS key_lower, min('Default gas ' || p_name) AS utility FROM customer_names WHERE state IN ('TX', 'PA') GROUP BY 1, 2, 3
"""
BINDINGS["county_emc"] = """
SELECT county, CAST(row_number() OVER (PARTITION BY county ORDER BY emc) - 1 AS INT) AS pos, CAST(count(*) OVER (PARTITION BY county) AS INT) AS n, emc
FROM (SELECT DISTINCT n_name AS county, 'EMC ' || p_name AS emc FROM customer_names WHERE state = 'GA' AND c_custkey % 9 < 2) x
"""
BINDINGS["zip_dominance"] = f"""
SELECT {pick('c_custkey % 3', ['electric', 'gas', 'water'])} AS utility_type, state, zip, min(p_name) AS name,
       min({pick('c_custkey % 4', ['high', 'medium', 'low', None])}) AS confidence_level,
       CAST(min(50 + c_custkey % 50) AS DOUBLE) AS dominance_pct, CAST(min(c_custkey % 40) AS INT) AS sample_count
FROM customer_names WHERE c_custkey % 2 = 0 GROUP BY 1, 2, 3
"""
BINDINGS["special_districts"] = """
SELECT zip, min(p_name || ' district') AS name, min(state) AS state FROM customer_names WHERE c_custkey % 6 = 0 GROUP BY zip
"""
BINDINGS["eia_zip"] = f"""
SELECT zip, CAST(row_number() OVER (PARTITION BY zip ORDER BY k, name) - 1 AS INT) AS pos, name, eiaid, state FROM (
  SELECT zip, k, min(CASE k WHEN 0 THEN upper(p_name) || ' POWER' WHEN 1 THEN 'City of ' || n_name ELSE p_name || ' Energy' END) AS name,
         min({text('c_custkey % 300')}) AS eiaid, min(state) AS state
  FROM (SELECT *, @SERIES(3) AS k FROM customer_names WHERE c_custkey % 3 <> 1) y GROUP BY zip, k) x
"""
BINDINGS["city_cache"] = f"""
SELECT state, lower(n_name) AS city_lower, {pick('c_custkey % 3', ['electric', 'gas', 'water'])} AS utility_type, min('Cached ' || p_name) AS name
FROM customer_names GROUP BY 1, 2, 3
"""
BINDINGS["state_defaults"] = f"""
SELECT state, CASE WHEN state = 'AZ' THEN NULL ELSE min('State gas ' || n_name) END AS provider,
       CASE WHEN state IN ('TX', 'GA') THEN 6e-1 ELSE NULL END AS confidence
FROM customer_names GROUP BY state
"""
BINDINGS["contacts"] = f"""
SELECT k AS key, lower(k) AS key_lower, {text('ordinal + 5550000')} AS phone, CASE WHEN ordinal % 3 = 0 THEN NULL ELSE 'https://' || replace(lower(k), ' ', '') END AS url,
       {pick('ordinal % 4', [None, 'electric', 'gas', 'water'])} AS label, {pick('ordinal % 2', ['exact', 'substring'])} AS match_method, ordinal
FROM (SELECT CASE WHEN ordinal % 5 = 0 THEN canonical_id WHEN ordinal % 5 = 1 THEN display_name WHEN ordinal % 5 = 2 THEN upper(display_name)
        WHEN ordinal % 5 = 3 THEN display_name || ' Gas' ELSE display_name || '-Power' END AS k, ordinal FROM canonicals) x
"""
BINDINGS["broadband"] = f"""
SELECT block_geoid, CASE WHEN address_id % 9 = 0 THEN one ELSE '[' || one || ', ' || two || ', ' || three || ']' END AS providers FROM (
  SELECT block_geoid, address_id,
    '{{"name": "ISP ' || {text('address_id % 20')} || '", "tech": "' || {pick('address_id % 4', ['50', '40', '10', '99'])} || '", "down": ' || {text('address_id % 900')} || ', "up": 20, "low_lat": 1}}' AS one,
    '{{"name": "ISP ' || {text('address_id % 3')} || '", "tech": "' || {pick('address_id % 3', ['61', '70', '50'])} || '", "down": ' || {text('address_id % 90')} || ', "up": 5, "low_lat": 0}}' AS two,
    '{{"name": "ISP 7", "tech": "' || {pick('address_id % 2', ['40', '0'])} || '", "down": 250, "up": 5}}' AS three
  FROM addresses WHERE block_geoid IS NOT NULL) x
"""

# B5: candidates, four sources per address.
BINDINGS["candidates"] = f"""
SELECT c_custkey AS address_id, {pick('c_custkey % 3', ['electric', 'electric', 'gas'])} AS utility_type,
       CAST(k AS INT) AS source_ordinal, {pick('(c_custkey + k) % 5', ['eia_zip', 'state_gis_tx', 'HIFLD', 'findenergy_city', 'remaining_states_electric'])} AS source,
       {pick('c_custkey * (k + 3) % 9', ['Duke Energy', 'Georgia Power', 'Walton EMC', 'City of Dalton', 'Acme Light', 'DUKE ENERGY', 'Jackson EMC', 'Brass Hill Power', 'acme light'])} AS provider_name,
       (40 + (c_custkey * 13 + k * 29) % 60) / 1e2 AS confidence, CAST(NULL AS INT) AS eia_id, 'exact' AS match_method
FROM (SELECT *, @SERIES(4) AS k FROM customer) x
"""

# B6: stored results.
BINDINGS["results"] = f"""
SELECT *,
  CASE WHEN engine_catalog_id IS NOT NULL AND tenant_catalog_id IS NOT NULL THEN
     CASE WHEN engine_catalog_id = tenant_catalog_id THEN 'ID_MATCH' WHEN comparison = 'MATCH_TDU' THEN 'ID_MATCH_TDU'
          WHEN comparison IN ('MATCH', 'MATCH_PARENT', 'MATCH_ALT') THEN 'NAME_MATCH_ID_MISMATCH' ELSE 'TRUE_MISMATCH' END
     WHEN engine_catalog_id IS NOT NULL THEN 'TENANT_ID_MISSING' WHEN tenant_catalog_id IS NOT NULL THEN 'ENGINE_ID_MISSING' ELSE 'BOTH_ID_MISSING' END AS id_match,
  engine_confidence < 7e-1 AS engine_needs_review
FROM (
SELECT o_orderkey AS row_id, {text('o_orderkey')} || ' Main Street, ' || n_name || ', ' || {_state} || ' ' || {_zip} AS address,
       {_state} AS state, {pick('o_orderkey % 3', ['electric', 'gas', 'water'])} AS utility_type,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {pick('o_custkey % 6', ['ONCOR', 'Duke Energy', 'City of Dalton', 'Nicor Gas', 'CENTERPOINT ENERGY', '=n_name'])} END AS engine_provider,
       (40 + o_orderkey * 7 % 60) / 1e2 AS engine_confidence,
       {pick('o_orderkey % 5', ['HIFLD', 'eia_zip', 'state_gis_tx', '', 'remaining_states_gas'])} AS engine_source,
       o_orderkey % 4 = 0 AS engine_is_deregulated,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % 50 END AS engine_catalog_id,
       o_orderkey % 6 <> 0 AS engine_id_confident,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL WHEN o_orderkey % 9 = 7 THEN 'n/a' ELSE {pick('o_orderkey % 4', ['Reliant', 'Duke Energy', '=n_name', 'Oncor'])} END AS tenant_raw,
       {pick('o_orderkey % 4', ['Reliant', 'Duke Energy', '=n_name', 'Oncor'])} AS tenant_normalized,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 50 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS tenant_catalog_id,
       'Title ' || {text('o_custkey % 50')} AS tenant_catalog_title,
       {pick('o_orderkey * 5 % 11', ['MATCH', 'MATCH', 'MATCH_TDU', 'MATCH_PARENT', 'MATCH_ALT', 'MISMATCH', 'MISMATCH', 'ENGINE_ONLY', 'TENANT_ONLY', 'TENANT_PROPANE', 'BOTH_EMPTY'])} AS comparison,
       o_totalprice, o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) x
"""
BINDINGS["reported"] = f"""
SELECT o_orderkey AS row_id, {pick('o_orderkey % 3', ['electric', 'gas', 'water'])} AS utility_type, {_state} AS state, raw_name AS raw, {_zip} AS zip
FROM orders JOIN customer ON o_custkey = c_custkey JOIN raw_names ON p_partkey = o_custkey
"""

# B7: activity.
BINDINGS["lookup_events"] = f"""
SELECT event_id, ts AS created_at, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'u' || {text('user_id')} || '@example.org' END AS email,
       '10.0.0.' || {text('user_id % 40')} AS ip_address, event_type
FROM events
"""
BINDINGS["source_calls"] = f"""
SELECT event_id AS call_id, 'src' || {text('user_id % 7')} AS source, ts, event_type NOT IN ('error', 'view', 'click') AS ok FROM events
"""

# B8: graphs of ids and names.
BINDINGS["catalog_aliases"] = f"""
SELECT {text('p_partkey')} AS alias_id, {text('p_partkey * 2')} AS canonical_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0
"""
BINDINGS["name_sources"] = f"""
SELECT 's' || {text('p_partkey % 4')} AS source, 'name ' || {text('p_partkey')} AS canonical,
       CASE WHEN p_partkey % 3 = 0 THEN 'Name ' || {text('p_partkey * 2')} WHEN p_partkey % 7 = 0 THEN 'Exelon' ELSE p_brand || ' ' || {text('CAST(floor(p_partkey / 40) AS BIGINT)')} || ',' END AS alias
FROM part
"""
BINDINGS["registry_names"] = f"""
SELECT {text('p_partkey')} AS eia_id, CAST(k AS INT) AS pos,
       CASE WHEN k = 0 THEN p_name || ' ' || {pick('p_partkey % 4', ['cooperative', 'electric', 'gas generation', 'water'])}
            WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || ' Light, Inc.' END AS name
FROM (SELECT *, @SERIES(2) AS k FROM part) x
"""
BINDINGS["catalog_raw"] = f"""
SELECT CASE WHEN p_partkey % 50 = 49 THEN 'x' || {text('p_partkey')} ELSE {text('p_partkey')} END AS "ID",
       CASE WHEN p_partkey % 41 = 40 THEN '9' ELSE {pick('p_partkey % 4', ['2', '3', '4', '6'])} END AS "UtilityTypeId",
       ' ' || {pick('p_partkey % 5', ['=p_name', "=p_name || ' Corp'", "=upper(p_name) || ' - TX'", "=p_name || ' (GA)'", "=p_name || ' elec'"])} || ' ' AS "Title",
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'https://x/' || {text('p_partkey')} END AS "URL", {text('p_partkey')} AS "Phone", p_brand AS "Source", p_partkey AS ordinal
FROM part
"""

# B9: free text.
BINDINGS["first_lines"] = """
SELECT doc_id, split_part(text, chr(10), 1) AS line, lang, source, n_chars FROM documents
"""

_NAME = re.compile(r"[a-z_]+")


def needed(sql: str) -> list[str]:
    """Bindings the text uses, in an order in which each comes after its own."""
    seen: list[str] = []

    def visit(body: str) -> None:
        for word in _NAME.findall(body):
            if word in BINDINGS and word not in seen:
                visit(BINDINGS[word])
                if word not in seen:
                    seen.append(word)

    visit(sql)
    return seen


def duckdb_text(sql: str) -> str:
    return re.sub(r"@SERIES\((\d+)\)", r"unnest(range(0, \1))", sql)


def oracle(sql: str, recursive: bool = False) -> str:
    """The query with the bindings it uses as common table expressions."""
    names = needed(sql)
    body = sql.strip()
    parts = [f"{n} AS MATERIALIZED ({BINDINGS[n].strip()})" for n in names]
    lead = "WITH RECURSIVE " if recursive else "WITH "
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if m:
        lead, body = ("WITH RECURSIVE " if m.group(1) or recursive else "WITH "), body[m.end():]
        text_ = lead + ", ".join([*parts, body]) if parts else lead + body
    else:
        text_ = lead + ", ".join(parts) + " " + body if parts else body
    return duckdb_text(text_)


class Tables:
    """Given tables and bindings of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in GIVEN:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._cache[name] = self.sql(BINDINGS[name])
        return self._cache[name]

    def sql(self, query: str) -> DataFrame:
        """Run SQL over given tables and bindings."""
        used = {w for w in _NAME.findall(query) if w in BINDINGS or w in GIVEN}
        body = re.sub(r"@SERIES\((\d+)\)", lambda m: f"explode(sequence(0, {int(m.group(1)) - 1}))", query)
        body = re.sub(r'AS "(\w+)"', r"AS `\1`", body)
        frames = {}
        for w in used:
            pattern = rf"\b(FROM|JOIN)\s+{w}\b"
            if re.search(pattern, body):
                # a table without an alias of its own keeps its name
                body = re.sub(pattern + r"(?!\s+[a-z])", rf"\1 {{{w}}} {w}", body)
                body = re.sub(pattern + r"(?=\s+[a-z])", rf"\1 {{{w}}}", body)
                frames[w] = getattr(self, w)
        # Braces of JSON text are not placeholders.
        body = re.sub(r"\{(?!\w+\} )", "{{", body)
        body = re.sub(r"(?<!\w)\}|\}(?! \w)", "}}", body)
        return self.spark.sql(body, **frames)

    # ---- shapes that plain SQL text cannot share ------------------------------
    @property
    def shapes(self) -> DataFrame:
        """Territories with rings and bounding boxes."""
        from gridlocus.operators.spatial import prepare_territories

        def corner(dx, dy):
            return F.struct((F.col("cx") + dx * F.col("r")).alias("x"), (F.col("cy") + dy * F.col("r")).alias("y"))

        ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))
        return prepare_territories(self.territories.withColumn("rings", F.array(ring)))

    @property
    def points(self) -> DataFrame:
        return self.addresses.where("NOT (lat = 0 AND lon = 0)").select(
            F.col("address_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("state").alias("address_state"))

    @property
    def aliases(self) -> DataFrame:
        if "_aliases" not in self._cache:
            from gridlocus.session import cut_lineage

            self._cache["_aliases"] = cut_lineage(self.alias_index.withColumns({
                "parent_company": F.nullif("parent_company", F.lit("")), "eia_id": F.nullif("eia_id", F.lit(-1))}))
        return self._cache["_aliases"]
