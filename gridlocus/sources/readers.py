"""Readers: every nested or loosely typed input becomes a flat, typed table.

JSON documents are read whole as text and parsed with explicit schemas; a key whose
value may be text or an object is kept as JSON text and decided per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.functions import rules, text
from gridlocus.functions.address import blank_to_null, block_geoid
from gridlocus.operators.spatial import LAYER_COLUMNS

STR_MAP = "map<string,string>"


def json_documents(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One row per file: the whole text, and the file's base name without suffix."""
    raw = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return raw.select(
        F.col("value").alias(column), F.regexp_extract("_path", r"([^/]+?)\.json[^/]*$", 1).alias("file")
    )


def entries(doc: Column, value: str = "string") -> Column:
    """A JSON object as key/value entries; values stay JSON text unless typed."""
    return F.map_entries(F.from_json(doc, f"map<string,{value}>"))


# ---- addresses ---------------------------------------------------------------
ADDRESS_NAMES = ["address", "display", "full_address"]


def pick_address(df: DataFrame) -> DataFrame:
    """Adds ``address``: the first known address column, else the first column."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    source = next((by_lower[n] for n in ADDRESS_NAMES if n in by_lower), df.columns[0])
    out = df.withColumn("_a", F.trim(F.col(f"`{source}`"))).where("_a IS NOT NULL AND _a <> ''")
    return out.drop(source).withColumnRenamed("_a", "address")


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    return pick_address(spark.read.csv(path, header=True, multiLine=True, escape='"'))


# ---- territories -------------------------------------------------------------
def rename_layer(df: DataFrame, layer: str) -> DataFrame:
    """Layer attributes under common names; a column the source lacks is NULL."""
    mapping = LAYER_COLUMNS[layer]
    present = {c.lower(): c for c in df.columns}
    wanted = dict.fromkeys(["name", "state", "type", "holding_co", "cntrl_area", "customers", "eia_id", "pwsid", "population_served"])
    for source, target in mapping.items():
        if source.lower() in present:
            wanted[target] = F.col(f"`{present[source.lower()]}`")
    numbers = {"customers", "population_served"}
    columns = [
        (c if c is not None else F.lit(None)).cast("bigint" if n in numbers else "string").alias(n) for n, c in wanted.items()
    ]
    keep = [c for c in ("territory_id", "rings", "area_km2") if c in df.columns]
    # fixed value: -999999 stands for "not available"
    return df.select(F.lit(layer).alias("layer"), *keep, *columns).withColumn(
        "customers", F.when(F.col("customers") != -999999, F.col("customers")))


GEOJSON_FEATURE = """type string, properties map<string,string>,
    geometry struct<type:string,coordinates:string>"""


def read_territories(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A polygon layer from GeoJSON features (one per line) or from Parquet with
    ``rings``."""
    if path.endswith((".json", ".geojson", ".jsonl", ".ndjson")):
        raw = spark.read.schema("value string").text(path).where(F.col("value").rlike(r'"Feature"'))
        parsed = raw.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), GEOJSON_FEATURE).alias("f")).where("f.geometry IS NOT NULL")
        point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
        single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
        multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
        rings = F.transform(F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(multi), lambda r: F.transform(r, point))
        names = list(LAYER_COLUMNS[layer])
        df = parsed.select(
            F.xxhash64(F.col("f.geometry.coordinates"), F.to_json("f.properties")).alias("territory_id"), rings.alias("rings"),
            *[F.col("f.properties")[n].alias(n) for n in names])
    else:
        df = spark.read.parquet(path)
        if "territory_id" not in df.columns:
            df = df.withColumn("territory_id", F.xxhash64(F.to_json(F.struct("*"))))
    return rename_layer(df, layer)


def read_territories_jdbc(spark: SparkSession, url: str, table: str, layer: str, partitions: int = 16, **options: str) -> DataFrame:
    """A layer from a spatial database, the geometry as GeoJSON text.  The row
    number splits the read; rows are never fetched through one connection."""
    query = f"(SELECT t.*, ST_AsGeoJSON(geometry) AS coordinates_json, mod(abs(id), {int(partitions)}) AS part FROM {table} t) q"
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=query, partitionColumn="part", lowerBound="0", upperBound=str(partitions), numPartitions=str(partitions), **options)
    df = reader.load()
    single = F.from_json(F.get_json_object("coordinates_json", "$.coordinates"), "array<array<array<double>>>")
    multi = F.flatten(F.from_json(F.get_json_object("coordinates_json", "$.coordinates"), "array<array<array<array<double>>>>"))
    is_polygon = F.get_json_object("coordinates_json", "$.type") == "Polygon"
    rings = F.transform(F.when(is_polygon, single).otherwise(multi), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rename_layer(df.withColumn("rings", rings).withColumnRenamed("id", "territory_id"), layer)


# ---- corrections and lookup tables ------------------------------------------
def flatten_zip_corrections(docs: DataFrame, utility_type: Column, doc: str = "doc") -> DataFrame:
    """utility_type, zip_code, provider, confidence.  The map may be wrapped; an
    entry is a name or an object."""
    inner = F.coalesce(F.get_json_object(doc, "$.corrections"), F.col(doc))
    e = docs.select(utility_type.alias("utility_type"), F.explode(entries(inner)).alias("e"))
    v = F.col("e.value")
    name = F.coalesce(F.get_json_object(v, "$.provider"), F.get_json_object(v, "$.name"), F.when(~v.startswith("{"), v))
    confidence = F.coalesce(F.get_json_object(v, "$.confidence").try_cast("double"), F.lit(0.98))
    return e.where(~F.col("e.key").startswith("_")).select(
        "utility_type", F.col("e.key").alias("zip_code"), F.trim(name).alias("provider"), confidence.alias("confidence")
    ).where("provider IS NOT NULL AND provider <> ''")


def flatten_gas_mapping(docs: DataFrame, state: Column, doc: str = "doc") -> DataFrame:
    """state, key_kind (override | ambiguous | prefix), key, name, phone, website.
    Keys whose utility is not listed are dropped, so that the next kind applies."""
    field = lambda f: F.get_json_object(doc, f"$.{f}")
    base = docs.select(F.upper(state).alias("state"), doc)
    utilities = base.select("state", F.explode(entries(field("utilities"))).alias("e")).select(
        "state", F.col("e.key").alias("utility_key"),
        F.coalesce(F.get_json_object("e.value", "$.name"), F.col("e.key")).alias("name"),
        F.get_json_object("e.value", "$.phone").alias("phone"), F.get_json_object("e.value", "$.website").alias("website"))
    kinds = []
    for kind, source in (("override", "zip_overrides"), ("prefix", "zip_to_utility")):
        kinds.append(base.select("state", F.lit(kind).alias("key_kind"), F.explode(entries(field(source))).alias("e")).select(
            "state", "key_kind", F.col("e.key").alias("key"), F.col("e.value").alias("utility_key")))
    kinds.append(base.select("state", F.lit("ambiguous").alias("key_kind"), F.explode(entries(field("ambiguous_zips"))).alias("e")).select(
        "state", "key_kind", F.col("e.key").alias("key"), F.get_json_object("e.value", "$.providers[0]").alias("utility_key")))
    keys = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return keys.join(utilities, ["state", "utility_key"]).select("state", "key_kind", "key", "name", "phone", "website")


def flatten_county_gas(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """state, kind (city | county | default), key_lower, utility."""
    top = docs.select(F.explode(entries(F.col(doc))).alias("e")).where(~F.col("e.key").startswith("_")).select(
        F.col("e.key").alias("state"), F.col("e.value").alias("v"))
    out = top.select("state", F.lit("default").alias("kind"), F.lit("_default").alias("key_lower"), F.get_json_object("v", "$._default").alias("utility"))
    for kind, source in (("county", "counties"), ("city", "cities")):
        e = top.select("state", F.explode(entries(F.get_json_object("v", f"$.{source}"))).alias("e"))
        value = F.col("e.value")
        out = out.unionByName(e.select("state", F.lit(kind).alias("kind"), F.lower("e.key").alias("key_lower"),
                                       F.coalesce(F.get_json_object(value, "$.utility"), F.when(~value.startswith("{"), value)).alias("utility")))
    return out.where("utility IS NOT NULL AND utility <> ''")


def flatten_county_emc(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """county, pos, n, emc, phone, website."""
    lists = docs.select(F.explode(F.from_json(F.get_json_object(doc, "$.county_to_emc"), "map<string,array<string>>")).alias("county", "emcs"))
    rows = lists.select("county", F.size("emcs").alias("n"), F.posexplode("emcs").alias("pos", "emc"))
    info = docs.select(F.explode(entries(F.get_json_object(doc, "$.emcs"))).alias("e")).select(
        F.col("e.key").alias("emc"), F.get_json_object("e.value", "$.phone").alias("phone"), F.get_json_object("e.value", "$.website").alias("website"))
    return rows.join(info, "emc", "left").select("county", "pos", "n", "emc", "phone", "website")


def flatten_eia_zip(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """zip, pos, name, eiaid, state, ownership: blank names dropped, the first of
    equal names kept, positions renumbered."""
    item = "array<struct<name:string,eiaid:string,state:string,ownership:string>>"
    return rank_eia_zip(docs.select(F.explode(F.from_json(doc, f"map<string,{item}>")).alias("zip", "items")))


def rank_eia_zip(lists: DataFrame) -> DataFrame:
    named = F.filter("items", lambda u: F.coalesce(u["name"], F.lit("")) != "")
    first = F.filter(named, lambda u, i: ~F.exists(F.slice(named, F.lit(1), i), lambda b: b["name"] == u["name"]))
    return lists.select("zip", F.posexplode(first).alias("pos", "u")).select("zip", "pos", "u.*")


def flatten_zip_dominance(docs: DataFrame, doc: str = "doc") -> DataFrame:
    entry = "struct<name:string,confidence_level:string,dominance_pct:double,sample_count:int>"
    nested = f"map<string,map<string,map<string,{entry}>>>"
    return (
        docs.select(F.explode(F.from_json(doc, nested)).alias("utility_type", "states"))
        .select("utility_type", F.explode("states").alias("state", "zips"))
        .select("utility_type", "state", F.explode("zips").alias("zip", "x")).select("utility_type", "state", "zip", "x.*")
    )


def flatten_city_cache(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """state, city_lower, utility_type, name from keys "ST:city:type"."""
    e = docs.select(F.explode(entries(F.col(doc))).alias("e")).where(F.col("e.key") != "_metadata")
    parts = F.split("e.key", ":")
    return e.select(
        F.upper(parts[0]).alias("state"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("city_lower"), F.get(parts, F.lit(2)).alias("utility_type"),
        F.get_json_object("e.value", "$.providers[0].name").alias("name")).where("name IS NOT NULL AND name <> ''")


# ---- dictionary --------------------------------------------------------------
def read_dictionary(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """canonical_id, display_name, parent_company, eia_id, aliases, ordinal; an entry
    is an object or, in the older form, the list of aliases."""
    e = docs.select(F.posexplode(entries(F.col(doc))).alias("ordinal", "e"))
    v = F.col("e.value")
    is_list = v.startswith("[")
    listed = F.from_json(F.when(is_list, v).otherwise(F.get_json_object(v, "$.aliases")), "array<string>")
    eia = F.split_part(F.get_json_object(v, "$.eia_id"), F.lit("."), F.lit(1))
    return e.select(
        F.col("e.key").alias("canonical_id"),
        F.when(is_list, F.col("e.key")).otherwise(F.coalesce(F.get_json_object(v, "$.display_name"), F.col("e.key"))).alias("display_name"),
        F.when(~is_list, F.get_json_object(v, "$.parent_company")).alias("parent_company"),
        F.when(~is_list, eia.try_cast("int")).alias("eia_id"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("aliases"), "ordinal")


def flatten_alias_index(dictionary: DataFrame) -> DataFrame:
    """alias_lower (unique) -> canonical_id, display_name, …: the canonical itself and
    its aliases; of two entries claiming an alias the later one has it."""
    rows = dictionary.select(
        "canonical_id", "display_name", "parent_company", "eia_id", "ordinal",
        F.explode(F.array_union(F.array("canonical_id"), F.col("aliases"))).alias("alias"))
    fields = ["canonical_id", "display_name", "parent_company", "eia_id"]
    return rows.groupBy(F.lower("alias").alias("alias_lower")).agg(
        F.max_by(F.struct(*fields), "ordinal").alias("x"), F.min("ordinal").alias("ordinal")
    ).select("alias_lower", "x.*", "ordinal")


def flatten_reps(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """rep_lower, rep_name from {reps: {name: {aliases: […]}}}."""
    e = docs.select(F.explode(entries(F.get_json_object(doc, "$.reps"))).alias("e"))
    aliases = F.coalesce(F.from_json(F.get_json_object("e.value", "$.aliases"), "array<string>"), F.array().cast("array<string>"))
    rows = e.select(F.col("e.key").alias("rep_name"), F.explode(F.concat(F.array("e.key"), aliases)).alias("a"))
    return rows.groupBy(F.lower("a").alias("rep_lower")).agg(F.max("rep_name").alias("rep_name"))


# ---- catalog and contacts ----------------------------------------------------
def clean_catalog(raw: DataFrame) -> DataFrame:
    """Typed catalog; rows with another type or a non-integer id are dropped.
    ``raw``: ID, UtilityTypeId, Title, URL, Phone, Source and optionally ordinal."""
    order = F.col("ordinal") if "ordinal" in raw.columns else F.monotonically_increasing_id()
    return raw.select(
        F.expr("try_cast(trim(ID) AS BIGINT)").alias("catalog_id"), F.col("UtilityTypeId").alias("type_id"), F.trim("Title").alias("title"),
        F.coalesce("URL", F.lit("")).alias("url"), F.coalesce("Phone", F.lit("")).alias("phone"), F.coalesce("Source", F.lit("")).alias("source"),
        order.alias("ordinal"),
    ).where(F.col("catalog_id").isNotNull() & F.col("type_id").isin(rules.CATALOG_TYPES_KEPT))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return clean_catalog(spark.read.csv(path, header=True, escape='"'))


def flatten_contacts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """key, key_lower, phone, url, label, match_method, ordinal."""
    e = docs.select(F.posexplode(entries(F.col(doc))).alias("ordinal", "e"))
    field = lambda f: F.get_json_object("e.value", f"$.{f}").alias(f)
    return e.select(F.col("e.key").alias("key"), F.lower("e.key").alias("key_lower"), *[field(f) for f in ("phone", "url", "label", "match_method")], "ordinal")


# ---- geocoder, broadband -----------------------------------------------------
GEOCODE_SCHEMA = ", ".join(f"f{i} string" for i in range(12))


def read_geocode_batch(spark: SparkSession, path: str) -> DataFrame:
    return parse_geocode_batch(spark.read.csv(path, schema=GEOCODE_SCHEMA, escape='"'))


def parse_geocode_batch(rows: DataFrame) -> DataFrame:
    """Geocoder batch response (f0 … f11) to columns; everything but a match is NULL.
    Field 5 is "lon,lat"."""
    matched = F.col("f2") == "Match"
    lon = F.split_part("f5", F.lit(","), F.lit(1)).try_cast("double")
    lat = F.split_part("f5", F.lit(","), F.lit(2)).try_cast("double")
    good = F.coalesce(matched & F.col("f5").contains(",") & lon.isNotNull() & lat.isNotNull(), F.lit(False))
    part = lambda i: blank_to_null(F.get(F.split("f4", ","), F.lit(i)))
    value = lambda c, n: F.when(good, c).alias(n)
    return rows.where("f2 IS NOT NULL").select(
        F.col("f0").alias("uid"), good.alias("matched"), value(lat, "lat"), value(lon, "lon"), value(F.lit(0.95), "confidence"),
        value(F.col("f4"), "formatted_address"), value(part(1), "city"), value(part(2), "state"), value(part(3), "zip_code"),
        value(block_geoid("f8", "f9", "f10", "f11"), "block_geoid"))


PROVIDER_JSON = "array<struct<name:string,tech:string,down:int,up:int,low_lat:int>>"


def parse_broadband_json(df: DataFrame, column: str = "providers") -> DataFrame:
    """A JSON list, or a single object, as a provider array."""
    c = F.trim(F.col(column))
    return df.withColumn(column, F.from_json(F.when(c.startswith("{"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c), PROVIDER_JSON))


def read_review_queue(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in rules.REVIEW_COLUMNS)
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)


# ---- state sources -----------------------------------------------------------
def flatten_state_sources(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(layers, regions) from {utility: {state: settings}}.

    Layers: utility_type, state, kind, layer_ordinal, layer, name_field, filter_field,
    filter_text, filter_equal, exclude_names, is_fallback, confidence, default_name.
    A layer that is a number or a name stands for ``{layer}`` in the state's URL.  A
    filter value that is text is looked for in the attribute, any other has to equal
    it.  Filters and excluded names hold for sources of one URL, not for layers.
    """
    top = docs.select(F.explode(entries(F.col(doc), STR_MAP)).alias("u")).select(
        F.col("u.key").alias("utility_type"), F.explode("u.value").alias("state", "v")).where(
        ~F.col("utility_type").startswith("_") & ~F.col("state").startswith("_") & F.col("v").startswith("{"))
    field = lambda f: F.get_json_object("v", f"$.{f}")
    named = F.coalesce(field("type"), F.lit("arcgis"))
    layered = field("layers").isNotNull()
    confidence = field("confidence").try_cast("double")
    listed = F.transform(F.from_json(field("layers"), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.url"), F.replace(field("url"), F.lit("{layer}"), x), x))
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("v"), "$.filter_value", "variant")) == "STRING"
    main = F.when(layered, listed).otherwise(F.array(field("url")))
    fallback = F.when(~layered & field("fallback_url").isNotNull(), F.array(field("fallback_url"))).otherwise(F.array().cast("array<string>"))
    default = F.when(named == "single_utility", 0.95).when(named == "coordinate_mapping", 0.95).when(layered, 0.92).otherwise(0.90)
    rows = top.select(
        "utility_type", "state", F.when(layered, "layers").otherwise(named).alias("kind"), F.size(main).alias("_n"),
        F.posexplode(F.concat(main, fallback)).alias("layer_ordinal", "layer"),
        field("name_field").alias("_name"), F.coalesce(field("fallback_name_field"), field("name_field")).alias("_fallback_name"),
        F.when(~layered, field("filter_field")).alias("_filter_field"), F.when(~layered, field("filter_value")).alias("_filter_value"), is_text.alias("_is_text"),
        F.coalesce(F.when(~layered, F.from_json(field("exclude_names"), "array<string>")), F.array().cast("array<string>")).alias("exclude_names"),
        F.coalesce(confidence, default).alias("_conf"),
        F.coalesce(field("fallback_confidence").try_cast("double"), confidence, F.lit(0.85)).alias("_fallback_conf"),
        field("default_name").alias("default_name"))
    back = F.col("layer_ordinal") >= F.col("_n")
    layers = rows.select(
        "utility_type", "state", "kind", "layer_ordinal", "layer", F.when(back, F.col("_fallback_name")).otherwise(F.col("_name")).alias("name_field"),
        F.when(~back, F.col("_filter_field")).alias("filter_field"), F.when(~back & F.col("_is_text"), F.col("_filter_value")).alias("filter_text"), F.when(~back & ~F.col("_is_text"), F.col("_filter_value")).alias("filter_equal"),
        "exclude_names", back.alias("is_fallback"), F.when(back, F.col("_fallback_conf")).otherwise(F.col("_conf")).alias("confidence"), "default_name")
    region = lambda f: F.get_json_object("e.value", f"$.{f}")
    regions = top.where(named == "coordinate_mapping").select("utility_type", "state", F.posexplode(entries(field("mappings"))).alias("ordinal", "e")).select(
        "utility_type", "state", "ordinal", region("name").alias("name"),
        region("lon_range[0]").try_cast("double").alias("lon_min"), region("lon_range[1]").try_cast("double").alias("lon_max"),
        region("lat_min").try_cast("double").alias("lat_min")).where("lon_min IS NOT NULL AND lon_max IS NOT NULL")
    return layers, regions


# ---- stored results ----------------------------------------------------------
ALT_JSON = "array<struct<provider:string,confidence:double,source:string,eia_id:int,catalog_id:bigint,catalog_title:string>>"
ANSWER_JSON = f"""struct<provider_name:string,canonical_id:string,eia_id:int,confidence:double,match_method:string,
    is_deregulated:boolean,deregulated_note:string,polygon_source:string,needs_review:boolean,catalog_id:bigint,
    catalog_title:string,id_match_score:double,id_confident:boolean,phone:string,website:string,alternatives:{ALT_JSON}>"""
RESULT_JSON = f"""struct<address:string,lat:double,lon:double,geocode_confidence:double,electric:{ANSWER_JSON},
    gas:{ANSWER_JSON},water:{ANSWER_JSON},sewer:{ANSWER_JSON},lookup_time_ms:int>"""


def read_cached_results(df: DataFrame, column: str = "result_json") -> DataFrame:
    """Stored JSON results as typed rows; absent numbers become 0 and absent
    alternatives an empty list."""
    parsed = df.withColumn("r", F.from_json(column, RESULT_JSON)).drop(column)

    def answer(t):
        a = F.col(f"r.{t}")
        return F.when(a.isNotNull(), a.withField("confidence", F.coalesce(a["confidence"], F.lit(0.0)))
                      .withField("is_deregulated", F.coalesce(a["is_deregulated"], F.lit(False)))
                      .withField("needs_review", F.coalesce(a["needs_review"], F.lit(False)))
                      .withField("alternatives", F.coalesce(a["alternatives"], F.array().cast(ALT_JSON)))).alias(t)

    zero = lambda f: F.coalesce(F.col(f"r.{f}"), F.lit(0)).alias(f)
    return parsed.select(*[c for c in parsed.columns if c != "r"], F.col("r.address").alias("address"), zero("lat"), zero("lon"),
                         zero("geocode_confidence"), *[answer(t) for t in ("electric", "gas", "water", "sewer")], zero("lookup_time_ms"))


def read_name_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(text.clean_name(column).alias("name")).where("name <> ''")
