"""Registered queries against their SQL on the smallest data, and streams against batch."""

import pytest
from checks import compare, connect

from gridlocus.workload import ORACLES, QUERIES, resolving, runnable
from gridlocus.workload.bindings import Tables
from gridlocus.workload.flows import batch_runs

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "a1_extract_state", "p8_is_deregulated", "j1_point_in_territory", "v4_resolve_overlap_electric", "v5_resolve_overlap_tdu", "j4_state_source_join",
    "j8_gas_zip_join", "j18_contact_join", "v8_demote_large_iou", "v15_broadband_summary", "c7_id_accuracy", "g3_top_mismatch_pairs", "q3_import_counts",
    "r2_merge_groups", "w5_rolling_24h_count", "w6_latest_prior_event", "flagship_electric_by_provider", "s18_write_results",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(runnable(QUERIES[name])(spark, FOLDER), con, ORACLES[name]) == ""


def test_names_are_registered_once_and_checked():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) / len(QUERIES) > 0.9


def test_breaker_stream_equals_batch(spark):
    t = Tables(spark, FOLDER)
    key = ["call_id", "source", "run_length", "disabled"]
    stream = sorted(map(tuple, QUERIES["t6_stream_circuit_breaker"](t).select(*key).collect()))
    assert stream == sorted(map(tuple, batch_runs(t).select(*key).collect()))


def test_rate_limit_stream_by_hand(spark):
    got = QUERIES["t4_stream_rate_limit"](Tables(spark, FOLDER)).collect()
    events = Tables(spark, FOLDER).events.select("event_id", "ts", "user_id").orderBy("ts", "event_id").collect()
    kept, want = {}, {}
    for e in events:
        recent = [x for x in kept.get(e.user_id, []) if (e.ts - x).total_seconds() < 86400]
        want[e.event_id] = len(recent) < 5
        kept[e.user_id] = recent + ([e.ts] if want[e.event_id] else [])
    assert {r.event_id: r.accepted for r in got} == want


def test_every_state_with_polygons_has_all_electric_territories(spark):
    t = Tables(spark, FOLDER)
    states = t.state_config.where("kind IN ('layers', 'arcgis')").select("state").distinct().count()
    features = resolving.state_inputs(t)[2]
    assert states == 6 and features.select("state", "feature_ordinal").distinct().count() == 6 * t.territories.where("layer = 'electric'").count()
