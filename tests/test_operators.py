"""Small fixtures: rules that are easy to get wrong, and brute-force comparisons."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridlocus.functions import address, predicates, text
from gridlocus.functions.similarity import lcs_length
from gridlocus.operators import activity, blocking, catalog, compare, dictionary, lookups, names, report, resolve, spatial
from gridlocus.sources import readers


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("o")).first()["o"]


# ---- columns -----------------------------------------------------------------
def test_address_parts(spark):
    assert one(spark, "1 A St, Austin, TX 78701-1234", address.extract_state) == "TX"
    assert one(spark, "1 A St, Austin, TX 78701-1234", address.extract_zip) == "78701"
    assert one(spark, "1 A St, Austin, TX 78701", address.extract_city) == "Austin"
    assert one(spark, "1 A St, tx 78701", address.extract_state) is None
    # Two comma parts give no city.
    assert one(spark, "1 A St Austin, TX 78701", address.extract_city) is None
    assert one(spark, "1  North Oak Street", address.address_key) == "1 n oak st"
    s = one(spark, "5 Elm, Waco TX 76701", address.split_address)
    assert (s.street, s.city, s.state, s.zip) == ("5 Elm", "Waco", "TX", "76701")


def test_title_case_differs_from_initcap(spark):
    assert one(spark, "AT&T CO-OP", text.clean_passthrough) == "At&T Co-Op"
    assert one(spark, "SOME RANDOM UTILITY INC", text.clean_passthrough) == "Some Random Utility"
    assert one(spark, "EPB", text.clean_passthrough) == "EPB"


@pytest.mark.parametrize("title, norm", [
    ("East Ohio Gas", "enbridge gas ohio"), ("PG&E", "pg e"), ("Mo Amer Water St Louis", "missouri american water"),
    ("Jones Onslow Elec Member Corp", "jones onslow electric membership"), ("City Light - TX", "city light"),
    ("Greer Commission Of Public Works", "greer commission of public works"), ("Acme Coop Inc", "acme cooperative"),
])
def test_catalog_titles(spark, title, norm):
    assert one(spark, title, text.normalize_catalog_title) == norm


def test_water_names(spark):
    assert one(spark, "Gilbert, Town Of", text.normalize_water_name) == "Town Of Gilbert"
    assert one(spark, "Lee's Wtr Dept (TX123)", text.normalize_water_name) == "Lees"


def test_state_codes_as_words(spark):
    assert sorted(one(spark, "CITY OF X - (TX), OK INDIANA", text.states_in_text)) == ["OK", "TX"]


def test_raw_substring_predicates(spark):
    # "REC" is found inside DIRECT, unless whole words are asked for.
    assert one(spark, "Direct Energy", predicates.is_local_utility) is True
    assert one(spark, "Direct Energy", lambda c: predicates.is_local_utility(c, whole_word=True)) is False


def test_deregulated(spark):
    df = spark.createDataFrame([
        ("ONCOR ELECTRIC DELIVERY COMPANY LLC", "", "INVESTOR OWNED", True), ("X COOP", "ERCO", "COOPERATIVE", False),
        ("CITY OF LUBBOCK - (TX)", "", "MUNICIPAL", True), ("", "", "", True), ("ACME", "ERCOT", "INVESTOR OWNED", True), ("ACME", "PJM", "INVESTOR", False),
    ], "n string, a string, k string, want boolean")
    assert df.where(predicates.is_deregulated("n", "a", "k") != F.col("want")).count() == 0


# ---- blocking ----------------------------------------------------------------
def test_similar_pairs_lose_nothing(spark):
    random.seed(5)
    words = "duke energy city of power light coop member gas north".split()

    def noisy():
        s = list(" ".join(random.choice(words) for _ in range(random.randint(1, 3))))
        for _ in range(random.randint(0, 3)):
            s.insert(random.randrange(len(s) + 1), random.choice("abc "))
        return "".join(s).strip() or "x"

    a, b = sorted({noisy() for _ in range(120)} | {"a", "ab"}), sorted({noisy() for _ in range(120)} | {"a", "abd"})
    left, right = spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string")
    for score in (70.0, 85.0):
        got = {(r.l, r.r) for r in blocking.similar_pairs(left, right, "l", "r", score).collect()}
        assert got == {(x, y) for x in a for y in b if 200 * lcs_length(x, y) / (len(x) + len(y)) >= score}
    got = {(r.l, r.r) for r in blocking.contained_pairs(left, right, "l", "r").collect()}
    assert got == {(x, y) for x in a for y in b if y in x}


# ---- matching ----------------------------------------------------------------
@pytest.fixture(scope="module")
def aliases(spark):
    rows = [("duke energy", "duke", "Duke Energy", 0), ("duke power", "duke", "Duke Energy", 0), ("georgia power", "gp", "Georgia Power", 1),
            ("sce", "sce", "SCE", 2), ("acme, inc", "acme", "Acme", 3)]
    return spark.createDataFrame(rows, "alias_lower string, canonical_id string, display_name string, ordinal int")


def test_match_order(spark, aliases):
    reps = spark.createDataFrame([("txu energy",)], "rep_lower string")
    asked = ["Duke  Energy", "Duke Enrgy", "My Georgia Power Account", "sce of it", "Exelon", "N/A", "AmeriGas", "TXU Energy", "zzz qqq"]
    got = {r.name: (r.canonical_id, r.match_type, r.is_rep) for r in names.match_name(
        spark.createDataFrame([(x,) for x in asked], "name string"), aliases, reps).collect()}
    assert got["Duke  Energy"] == ("duke", "exact", False)
    assert got["Duke Enrgy"] == ("duke", "fuzzy", False)
    assert got["My Georgia Power Account"] == ("gp", "substring", False)
    assert got["sce of it"][0] is None  # an alias under four letters is never a substring match
    assert got["Exelon"] == (None, "none", False) and got["N/A"][1] == "null_value" and got["AmeriGas"][1] == "propane"
    assert got["TXU Energy"] == (None, "none", True) and got["zzz qqq"][0] is None


def test_segments(spark, aliases):
    df = spark.createDataFrame([("Duke Energy, , ,",), ("Acme, Inc",), ("",)], "name string")
    got = sorted((r.name, r.segment) for r in names.name_segments(df, aliases).collect())
    assert got == [("Acme, Inc", "Acme, Inc"), ("Duke Energy, , ,", "Duke Energy")]


def test_compare_categories(spark, aliases):
    rows = [
        (1, None, None, "gas", "TX", []), (2, "Duke Energy", "n/a", "gas", "OH", []), (3, "Duke Energy", "Blue Rhino tank", "gas", "OH", []),
        (4, None, "Duke Energy", "gas", "OH", []), (5, "Duke Energy", "duke power, txu", "electric", "OH", []), (6, "ONCOR", "Reliant", "electric", "TX", []),
        (7, "Nicor Gas", "Scana Energy", "gas", "GA", []), (8, "Ohio Edison", "Mon Power", "electric", "OH", []), (9, "Georgia Power", "Walton EMC", "electric", "GA", ["Walton EMC"]),
        (10, "Nicor Gas", "Somebody", "gas", "TN", []), (11, "Nicor Gas", "Acorn electric", "gas", "OH", []), (12, "Georgia Power", "Zed Utility", "electric", "GA", []),
    ]
    df = spark.createDataFrame([(*r[:5], [(a,) for a in r[5]]) for r in rows],
                               "row_id int, engine_provider string, tenant_raw string, utility_type string, state string, alternatives array<struct<provider:string>>")
    none = spark.createDataFrame([], "utility_type string, name_lower string, renamed string")
    out = compare.compare_providers(df, aliases, None, none, names.parent_table(spark), min_score=None)
    got = {r.row_id: r.comparison for r in out.collect()}
    assert got == {1: "BOTH_EMPTY", 2: "ENGINE_ONLY", 3: "TENANT_PROPANE", 4: "TENANT_ONLY", 5: "MATCH", 6: "MATCH_TDU", 7: "MATCH_TDU",
                   8: "MATCH_PARENT", 9: "MATCH_ALT", 10: "MISMATCH", 11: "MATCH", 12: "MISMATCH"}
    detail = {r.row_id: r.match_detail for r in out.collect()}
    assert detail[10].startswith("cross_state_override") and detail[8] == "parent=FirstEnergy"


# ---- space -------------------------------------------------------------------
def square(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


def test_containment_edges_holes_and_levels(spark):
    shapes = [(1, [square(0, 0, 10, 10), square(4, 4, 6, 6)]), (2, [square(-500, -500, 500, 500)]), (3, [square(0, 0, 1, 1), square(20, 20, 21, 21)])]
    df = spark.createDataFrame(shapes, "territory_id int, rings array<array<struct<x:double,y:double>>>")
    pts = [(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 1.5, 1.5), (4, 20.5, 20.5), (5, 900.0, 0.0), (6, 4.0, 4.5)]
    points = spark.createDataFrame(pts, "point_id int, x double, y double")
    shapes_ready = spatial.prepare_territories(df)
    strict = {(r.point_id, r.territory_id) for r in spatial.point_in_territory(points, shapes_ready, 0.5).collect()}
    assert strict == {(1, 2), (2, 2), (3, 1), (3, 2), (4, 2), (4, 3), (6, 2)}
    inclusive = {(r.point_id, r.territory_id) for r in spatial.point_in_territory(points, shapes_ready, 0.5, inclusive=True).collect()}
    assert inclusive == strict | {(2, 1), (6, 1)}


def test_random_polygons_against_ray_casting(spark):
    random.seed(9)
    shapes = []
    for i in range(25):
        cx, cy, n = random.uniform(0, 50), random.uniform(0, 50), random.randint(3, 12)
        import math

        radii = [(math.tau * k / n, random.uniform(0.3, 9)) for k in range(n)]
        shapes.append((i, [[(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in radii]]))
    pts = [(i, random.uniform(-5, 55), random.uniform(-5, 55)) for i in range(400)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    df = spatial.prepare_territories(spark.createDataFrame(shapes, "territory_id int, rings array<array<struct<x:double,y:double>>>"))
    got = {(r.point_id, r.territory_id) for r in spatial.point_in_territory(spark.createDataFrame(pts, "point_id int, x double, y double"), df, 0.25).collect()}
    assert got == {(p, s) for p, x, y in pts for s, rings in shapes if inside(x, y, rings[0])}


def test_texas_rule(spark):
    cols = "point_id int, territory_id int, name string, state string, type string, customers bigint, area_km2 double"
    hits = spark.createDataFrame([
        (1, 1, "BIG COOP", "TX", "COOPERATIVE", 10, 12000.0), (1, 2, "ONCOR ELECTRIC DELIVERY COMPANY LLC", "TX", "INVESTOR OWNED", 10, 90000.0),
        (1, 3, "TEXAS-NEW MEXICO POWER CO", "TX", "INVESTOR OWNED", 10, 50000.0), (2, 4, "CPS", "TX", "MUNICIPAL", 10, 1500.0),
        (2, 2, "ONCOR ELECTRIC DELIVERY COMPANY LLC", "TX", "INVESTOR OWNED", 10, 90000.0),
        (3, 5, "DUKE ENERGY CAROLINAS", "NC", "INVESTOR OWNED", 900000, 60000.0), (3, 6, "WAKE", "NC", "COOPERATIVE", 5, 400.0)], cols)
    got = {r.point_id: r.territory_id for r in spatial.resolve_electric(hits).collect()}
    assert got == {1: 2, 2: 4, 3: 6}


# ---- candidates --------------------------------------------------------------
def test_boost_lowers_a_correction_and_demotion(spark):
    cols = "address_id int, utility_type string, source_ordinal int, source string, provider_name string, confidence double, eia_id int"
    df = spark.createDataFrame([
        (1, "electric", 0, "correction_address", "Duke Energy", 0.99, None), (1, "electric", 1, "HIFLD", "DUKE ENERGY", 0.85, None),
        (1, "electric", 2, "hifld_api", "Wake EMC", 0.65, None), (2, "electric", 0, "state_gis_nc", "Duke Energy", 0.90, None), (2, "electric", 1, "HIFLD", "Wake EMC", 0.65, None)], cols)
    ranked = resolve.demote_large_iou(resolve.rank_candidates(resolve.dedupe_and_boost(df)))
    got = {(r.address_id, r.rank): (r.provider_name, round(r.confidence, 3), r.source) for r in ranked.collect()}
    assert got[(1, 1)] == ("Wake EMC", 0.65, "hifld_api") and got[(1, 2)] == ("Duke Energy", 0.98, "correction_address (+1 agree)")
    assert got[(2, 1)][0] == "Duke Energy"  # a state layer asks for 0.70
    answers = resolve.primary_with_alternatives(ranked).collect()
    assert {r.address_id: r.needs_review for r in answers} == {1: True, 2: False}
    assert all(r.provider_name not in [a.provider for a in r.alternatives] for r in answers)


def test_eia_verify(spark):
    table = spark.createDataFrame([("1", 0, "DUKE ENERGY", "7"), ("1", 1, "City of Wake", "8"), ("2", 0, "Zed", "9")], "zip string, pos int, name string, eiaid string")
    pairs = spark.createDataFrame([("1", "Duke Energy"), ("1", "Wake Electric"), ("1", "Nobody"), ("3", "Any")], "zip_code string, provider_name string")
    got = {(r.zip_code, r.provider_name): (r.adjustment, r.verified_eia_id) for r in lookups.eia_verify(pairs, table).collect()}
    assert got == {("1", "Duke Energy"): (0.05, "7"), ("1", "Wake Electric"): (0.03, "8"), ("1", "Nobody"): (-0.05, "7"), ("3", "Any"): (0.0, None)}


# ---- graphs, logs, readers ---------------------------------------------------
def test_components_chain_and_star(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("solo", "solo")]
    got = {r.node: r.component for r in dictionary.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] in "hs" and k != "solo"} == {"hub"} and got["solo"] == "solo"


def test_rolling_count_is_exact_at_24_hours(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 30, 15)
    stamps = [0, 3600 * 24, 3600 * 24 + 1, 60, 3600 * 23 + 59, 3600 * 40]
    rows = [(i, t0 + dt.timedelta(seconds=s), "a", "ip%d" % (i % 2)) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, "event_id int, created_at timestamp, email string, ip_address string")
    got = {r.event_id: r.recent_lookups for r in activity.lookup_limits(df).collect()}
    want = {i: sum(1 for j, u in enumerate(stamps) if u <= s and u > s - 86400 and j != i) for i, s in enumerate(stamps)}
    assert got == want


def test_failure_runs_across_buckets(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 59)
    oks = [False, False, True, False, False, False, True]
    rows = [("s", t0 + dt.timedelta(seconds=50 * i), i, ok) for i, ok in enumerate(oks)]
    got = sorted((r.call_id, r.run_length, r.disabled) for r in activity.failure_runs(spark.createDataFrame(rows, "source string, ts timestamp, call_id int, ok boolean"), bucket=60).collect())
    assert got == [(0, 1, False), (1, 2, False), (2, 0, False), (3, 1, False), (4, 2, False), (5, 3, False), (6, 0, True)]


def test_albers_area_of_a_degree_cell(spark):
    # One degree square at 31 N is close to 111.1 km x 95.4 km.
    df = spark.createDataFrame([(1, [square(-100, 31, -99, 32)])], "territory_id int, rings array<array<struct<x:double,y:double>>>")
    assert abs(spatial.prepare_territories(df, area=True).first()["area_km2"] - 10510) < 60


def test_areas_of_parts_holes_and_islands_whatever_their_winding(spark):
    outer, hole, island, apart = square(0, 0, 10, 10), square(2, 2, 8, 8), square(4, 4, 6, 6), square(20, 0, 21, 1)
    touching = square(0, 0, 5, 5)  # a hole that shares two sides with its shell
    turned = lambda ring: ring[::-1]
    shapes = [
        (1, [outer, apart], 101), (2, [outer, turned(apart)], 101), (3, [outer, hole], 64), (4, [outer, turned(hole)], 64), (5, [hole, turned(outer)], 64),
        (6, [island, outer, hole], 68), (7, [turned(island), hole, outer, turned(apart)], 69), (8, [outer, touching], 75), (9, [outer, outer], 0), (10, [outer], 100),
    ]
    df = spark.createDataFrame([(i, r) for i, r, _ in shapes], "territory_id int, rings array<array<struct<x:double,y:double>>>")
    got = {r.territory_id: r.area for r in spatial.prepare_territories(df).select("territory_id", spatial.ring_area(F.col("rings")).alias("area")).collect()}
    assert got == {i: float(a) for i, _, a in shapes}


def test_area_in_square_kilometres_from_metres(spark):
    import math

    metres = lambda x, y: {"x": math.radians(x) * 6378137.0, "y": math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * 6378137.0}
    ring = [metres(-100, 31), metres(-99, 31), metres(-99, 32), metres(-100, 32)]
    df = spark.createDataFrame([(1, [ring])], "territory_id int, rings array<array<struct<x:double,y:double>>>")
    row = spatial.prepare_territories(df, mercator=True, area=True).first()
    assert abs(row["area_km2"] - 10510) < 60 and abs(row["bbox"]["ymin"] - 31) < 1e-9


def test_new_names_are_grouped_beside_placed_ones(spark):
    auto = [
        ("Alpha Power", "Alpha Power North"), ("Alpha Power West", "Alpha Power North"),  # two new keys share an alias
        ("Alpha Power West", "Alpha West"), ("Beta Gas", "Beta Gas Company"), ("Beta Gas Co", "Beta Gas Company"),  # beta gas is placed
        ("Gamma Water", "Delta Water"), ("Gamma Water Two", "Gamma Water"),  # the alias gamma water is new, delta has another first word
        ("Epsilon Light", "Epsilon"), ("Lonely Name", "Something Else"), ("One Two Three, Four Five Six", "One Two Three"),
        ("Zeta Energy", "Zeta Energy Plus"), ("Zeta Energy Two", "Zeta Energy Plus"), ("Zeta Energy Two", "Zeta Old"),
    ]
    placed = [("beta gas", "Beta"), ("epsilon", "Epsilon Corp"), ("zeta old", "Zeta Group"), ("unrelated", "U")]
    got = dictionary.attach_auto_aliases(spark.createDataFrame(auto, "key string, alias string"), spark.createDataFrame(placed, "alias_key string, canonical string")).collect()
    alpha, zeta = ("Alpha Power", "new"), ("Zeta Group", "via_alias")
    assert {r.alias_key: (r.canonical, r.placement) for r in got} == {
        "alpha power": alpha, "alpha power north": alpha, "alpha power west": alpha, "alpha west": alpha,
        "beta gas company": ("Beta", "existing"), "beta gas co": ("Beta", "existing"), "gamma water": ("Gamma Water", "new"), "gamma water two": ("Gamma Water", "new"),
        "epsilon light": ("Epsilon Corp", "via_alias"), "lonely name": ("Lonely Name", "new"), "zeta energy": zeta, "zeta energy plus": zeta, "zeta energy two": zeta}
    assert len(got) == 13


def test_state_config_and_dictionary_readers(spark):
    doc = '{"gas": {"TX": {"url": "u", "name_field": "N", "fallback_url": "v"}}, "electric": {"HI": {"type": "coordinate_mapping", "mappings": {"a": {"name": "H", "lon_range": [-160, -150]}}}, "DC": {"type": "single_utility", "default_name": "P"}}}'
    layers, regions = readers.flatten_state_sources(spark.createDataFrame([(doc,)], "doc string"))
    assert {(r.utility_type, r.state, r.kind, r.is_fallback) for r in layers.collect()} == {
        ("gas", "TX", "arcgis", False), ("gas", "TX", "arcgis", True), ("electric", "HI", "coordinate_mapping", False), ("electric", "DC", "single_utility", False)}
    assert regions.first()["name"] == "H"


def test_alias_chains_and_cycles_are_closed(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("t", "c"), ("k", "k"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]]
    got = {r.alias_id: r.canonical_id for r in catalog.close_catalog_aliases(spark.createDataFrame(pairs, "alias_id string, canonical_id string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "t": "a", "k": "k", **{f"n{i:02}": "n20" for i in range(20)}}
    assert catalog.close_catalog_aliases(spark.createDataFrame([], "alias_id string, canonical_id string")).count() == 0


def test_every_row_is_numbered_in_order(spark):
    df = spark.range(0, 5000, 1, 9).withColumn("k", F.pmod(F.hash("id"), F.lit(700)))
    got = {r.id: r.place for r in report.numbered(df, [F.col("k"), F.col("id")], "place").collect()}
    want = sorted(df.collect(), key=lambda r: (r.k, r.id))
    assert got == {r.id: i + 1 for i, r in enumerate(want)}


def test_a_cut_plan_knows_its_size(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(256)], "a int, b int")
    found = dictionary.connected_components(chain)
    assert {r.component for r in found.collect()} == {0}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 24


def test_names_keep_letters_outside_ascii(spark):
    row = spark.range(1).select(text.norm_key(F.lit("Peñasco  Water!")).alias("a"), text.normalize_catalog_title(F.lit("Peñasco Water")).alias("b")).first()
    assert row.a == "peñasco water" and "peñasco" in row.b


def test_no_alternatives_stay_an_empty_array(spark):
    entries = catalog.prepare_catalog(spark.createDataFrame([(1, "2", "X Power", 0)], "catalog_id long, type_id string, title string, ordinal int"))
    rows = spark.createDataFrame([(1, "electric", "TX", "X Power", [])], "row_id int, utility_type string, state string, provider string, alternatives array<struct<provider:string>>")
    out = catalog.attach_catalog_ids(rows, entries).first()
    assert out.alternatives == [] and out.catalog_id == 1
