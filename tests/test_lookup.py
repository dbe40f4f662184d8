"""Candidate resolution by hand, and invariants of the whole lookup."""

from pyspark.sql import functions as F

from gridlocus.operators import resolve
from gridlocus.operators.catalog import prepare_catalog
from gridlocus.plans.lookup import lookup
from gridlocus.workload.bindings import Tables
from gridlocus.workload.flows import all_sources
from gridlocus.workload.resolving import BASE

FOLDER = "/root/testdata/sf0.001"


def test_resolve_candidates(spark):
    aliases = spark.createDataFrame(
        [("duke energy", "duke", "Duke Energy", 0), ("monroe power of nc", "monroe", "Monroe Power", 1)],
        "alias_lower string, canonical_id string, display_name string, ordinal int")
    states = spark.createDataFrame([("monroe", ["NC"])], "canonical_id string, states array<string>")
    eia = spark.createDataFrame([(4110, "duke", "Duke Energy")], "eia_id int, canonical_id string, display_name string")
    rows = [
        (1, "water", "MANHATTAN WATER CO", "EPA", "KS", None, None, None), (2, "electric", "ANY NAME", "HIFLD", "NC", "4110.0", None, None),
        (3, "electric", "Duke Energy", "HIFLD", "NC", "junk", None, None), (4, "electric", "Monroe Powers of NC", "HIFLD", "NC", None, None, None),
        (5, "electric", "Monroe Powxr of NC", "HIFLD", "OH", None, None, None), (6, "gas", "Unknown Gas Co", "state_gis_tx", "TX", None, None, None),
        (7, "gas", "Duke Energy", "eia_zip", "TX", None, 0.70, None), (8, "gas", "Nobody LLC", "correction_zip", "TX", None, None, 0.98),
    ]
    df = spark.createDataFrame(rows, """address_id int, utility_type string, raw_name string, source string, candidate_state string, eia_id string,
        max_confidence double, set_confidence double""").withColumn("source_ordinal", F.lit(0))
    got = {r.address_id: (r.provider_name, r.match_method, r.confidence) for r in resolve.resolve_candidates(df, aliases, None, states, eia).collect()}
    assert got[1] == ("Manhattan Water", "passthrough", 0.82)
    assert got[2] == ("Duke Energy", "eia_id", 0.90) and got[3] == ("Duke Energy", "exact", 0.85)
    assert got[4] == ("Monroe Power", "fuzzy", 0.75)       # 97.3: no state needed
    assert got[5][1] == "passthrough" and got[5][2] == 0.60  # 94.4 in another state
    assert got[6] == ("Unknown Gas", "passthrough", 0.90)    # floor of a state layer
    assert got[7][2] == 0.70 and got[8] == ("Nobody", "passthrough", 0.98)


def test_sewer_steps(spark):
    catalog = prepare_catalog(spark.createDataFrame(
        [(1, "6", "Waco Water", 0), (2, "6", "City of Elgin", 1), (3, "6", "Lake County Sanitary", 2)], "catalog_id bigint, type_id string, title string, ordinal bigint"))
    addresses = spark.createDataFrame([(1, "TX", None, None), (2, "IL", "Elgin", None), (3, "IL", "Nowhere", "Lake County"), (4, "IL", None, None), (5, "IL", None, None)],
                                      "address_id int, state string, city string, county string")
    water = spark.createDataFrame([(1, "Waco Water", 0.82), (4, "Some Water", 0.9)], "address_id int, provider_name string, confidence double")
    got = {r.address_id: (r.provider_name, round(r.confidence, 3), r.source) for r in resolve.sewer_resolution(addresses, water, catalog, fuzzy=False).collect()}
    assert got == {1: ("Waco Water", 0.87, "water_inheritance"), 2: ("City of Elgin", 0.82, "sewer_city_match"),
                   3: ("Lake County Sanitary", 0.75, "sewer_county_match"), 4: ("Some Water", 0.50, "water_fallback_no_sewer_id")}


def test_lookup_invariants(spark):
    t = Tables(spark, FOLDER)
    s = all_sources(t)
    s.catalog = s.contacts = None
    rows = lookup(t.addresses, s, base=BASE, min_score=None).collect()
    assert rows and len({(r.address_id, r.utility_type) for r in rows}) == len(rows)
    assert all(0 <= r.confidence <= 1 for r in rows)
    assert all(r.needs_review == (r.confidence < 0.70) for r in rows)
    assert all(r.provider_name.upper() not in [a.provider.upper() for a in r.alternatives] for r in rows)
    assert all(len(r.alternatives) <= 4 for r in rows)
