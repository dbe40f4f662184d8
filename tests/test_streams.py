"""Streams of several micro-batches with late rows against batch results and by hand."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlocus.operators import activity
from gridlocus.streaming import operators as T
from gridlocus.streaming.run import Upserts, arrivals, drain, drain_updates, shared_folder, write_arrivals
from gridlocus.workload import QUERIES
from gridlocus.workload.bindings import Tables

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    from gridlocus.session import apply_conf

    return Tables(apply_conf(spark), FOLDER)


def at(hours):
    return START + timedelta(hours=hours)


def stream_of(spark, rows, schema, batches):
    """Rows are (batch, ...)."""
    df = spark.createDataFrame(rows, f"arrival int, {schema}")
    return arrivals(spark, write_arrivals(df, F.col("arrival"), batches, 1), 1).drop("arrival")


def test_recent_lookups_equal_the_batch_count(tables):
    events = tables.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    batch = activity.rolling_count(events, "user_id", "ts", "event_id")
    want = {r.event_id: min(5, r.n_recent - 1) for r in batch.collect()}
    got = QUERIES["t4_stream_recent_lookups"](tables).collect()
    assert {r.event_id: r.n_before for r in got} == want and all(r.limited == (r.n_before >= 5) for r in got)


def test_attribution_equals_the_batch_join(tables):
    events = tables.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    lookups = events.where("event_type <> 'click'").select("user_id", "ts", F.col("event_id").alias("lookup_id"), F.col("ts").alias("seen"))
    batch = activity.latest_prior(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), lookups, "user_id", "ts", "ts", ["lookup_id", "seen"])
    want = {r.event_id: r.lookup_id if r.seen is not None and r.ts - r.seen <= timedelta(hours=24) else None for r in batch.collect()}
    got = QUERIES["t5_stream_cta_attribution"](tables).collect()
    assert {r.click_id: r.lookup_id for r in got} == want


def test_rows_come_in_order_over_batches_and_too_late_rows_go(spark, tables):
    rows = [
        (0, 1, "a", at(0)), (0, 3, "a", at(2)), (1, 2, "a", at(1)), (1, 4, "a", at(30)),
        (2, 5, "a", at(29)),  # late within a day
        (3, 9, "a", at(3)), (3, 6, "a", at(31)),  # 9 is behind the watermark that batch 1 left (6 hours)
        (3, 7, None, at(31)), (3, 8, "b", None), (3, None, "z", at(200)),
    ]
    got = drain(T.rate_limit(stream_of(spark, rows, "event_id long, email string, ts timestamp", 4), limit=2)).collect()
    by_id = {r.event_id: (r.accepted, r.remaining) for r in got}
    assert by_id == {1: (True, 1), 2: (True, 0), 3: (False, 0), 5: (True, 1), 4: (True, 0), 6: (False, 0), 7: (True, 1)}


def test_cache_lives_by_kind(spark, tables):
    rows = [
        (0, 1, "a", at(0), "miss"), (0, 2, "a", at(23), "answer"), (1, 3, "a", at(24), "failure"), (1, 4, "a", at(25), "answer"),
        (1, 5, "a", at(26), "miss"), (2, 6, "a", at(25 + 90 * 24 - 1), "miss"), (3, 7, "a", at(25 + 90 * 24), "failure"),
        (3, 8, "b", at(0 + 90 * 24), "failure"), (3, 9, "b", at(1 + 90 * 24), "failure"), (4, None, "z", at(9999), "miss"),
    ]
    got = drain(T.cache_lives(stream_of(spark, rows, "request_id long, address_key string, ts timestamp, kind string", 5))).collect()
    assert {r.request_id: (r.cached, r.answered_by) for r in got} == {
        1: (False, 1), 2: (True, 1), 3: (False, None), 4: (False, 4), 5: (True, 4), 6: (True, 4), 7: (False, None), 8: (False, None), 9: (False, None)}


def test_breaker_runs_over_batches(spark, tables):
    ok = [False, False, False, False, True, False]
    rows = [(i % 3, i, "s", at(i / 100), v) for i, v in enumerate(ok)] + [(3, None, "s", at(900), None)]
    got = drain(T.circuit_breaker(stream_of(spark, rows, "call_id long, source string, ts timestamp, ok boolean", 4))).collect()
    assert {r.call_id: (r.run_length, r.disabled) for r in got} == {0: (1, False), 1: (2, False), 2: (3, False), 3: (4, True), 4: (0, True), 5: (1, False)}


def test_state_of_metrics_stays_flat_over_ten_batches(spark, tables):
    rows = [(i // 50, i, at(i), i % 7 > 0) for i in range(500)]
    stream = stream_of(spark, rows, "event_id long, ts timestamp, ok boolean", 10)
    metrics = T.progress_metrics(stream.select("ts", "ok"), late="5 hours")
    folder = shared_folder(spark)
    table = Upserts(spark, metrics.schema, ["window_start"], os.path.join(folder, "table"))
    run = metrics.writeStream.option("checkpointLocation", os.path.join(folder, "progress")).trigger(availableNow=True).outputMode("update").foreachBatch(table.put).start()
    run.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 10 and max(sizes[2:]) <= 110  # the rows of two batches at most, not of all ten
    got = sorted(map(tuple, table.table().collect()))
    assert got == [(at(i), 1, int(i % 7 == 0)) for i in range(500)]


def test_updates_merge_once_per_key(spark, tables):
    table = Upserts(spark, spark.createDataFrame([], "k long, n long").schema, ["k"])
    assert table.table().count() == 0
    batch = lambda rows: spark.createDataFrame(rows, "k long, n long")
    table.put(batch([(1, 1), (2, 1)]), 0)
    table.put(batch([(2, 5)]), 1)
    table.put(batch([(2, 2), (3, 1)]), 1)  # the same batch again replaces itself
    want = [(1, 1), (2, 2), (3, 1)]
    assert sorted(map(tuple, table.table().collect())) == want
    table.compact()
    table.put(batch([(1, 7)]), 2)
    assert sorted(map(tuple, table.table().collect())) == [(1, 7), (2, 2), (3, 1)]


def test_monitor_counts_late_rows(spark, tables):
    rows = [(0, 1, "a", at(0.5)), (1, 2, "a", at(20)), (1, 3, "a", at(0.6))]
    got = drain_updates(T.rate_monitor(stream_of(spark, rows, "event_id long, email string, ts timestamp", 2)).select("window", "email", "n"), ["window", "email"])
    assert got.where(F.col("window.start") == at(0)).first().n == 3


def test_lookup_stream_equals_the_batch_lookup_and_replays(spark, tables):
    from gridlocus.plans.lookup import Sources, lookup
    from gridlocus.streaming.snapshots import Snapshots, answers, lookup_stream
    from gridlocus.workload.flows import all_sources
    from gridlocus.workload.resolving import BASE

    sources = all_sources(tables)
    for name in ("catalog", "contacts", "state_config", "territories", "gas_mapping", "county_emc", "county_gas", "live_layer", "zip_dominance", "special_districts"):
        setattr(sources, name, None)
    folder = shared_folder(spark)
    snapshots = Snapshots(spark, os.path.join(folder, "sources"), Sources)
    assert snapshots.publish(sources) == 0
    run = lambda batch, s: lookup(batch, s, base=BASE, min_score=None).drop("alternatives")
    stream = arrivals(spark, write_arrivals(tables.addresses, F.col("address_id") % 3, 3))
    out = os.path.join(folder, "answers")
    query = lookup_stream(stream, snapshots, run, out, os.path.join(folder, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 3
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    want = rows(run(tables.addresses, sources))
    assert want and rows(answers(spark, out)) == want

    # a newer version does not change what a noted batch is answered with, a new batch takes it
    sources.city_cache = sources.eia_zip = None
    assert snapshots.publish(sources) == 1
    assert snapshots.version_of(0) == 0 and snapshots.version_of(7) == 1 and snapshots.version_of(7) == 1
    assert snapshots.read(1).city_cache is None and snapshots.read(0).city_cache is not None
