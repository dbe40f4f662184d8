"""Sizes that must not grow with the input: what is broadcast, what a task of a stream holds."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridlocus.operators import dictionary as D
from gridlocus.operators import spatial as S
from gridlocus.session import apply_conf
from gridlocus.streaming import keyed, run
from gridlocus.streaming import operators as T


def test_exploded_cells_are_not_broadcast_by_an_estimate(spark):
    apply_conf(spark)
    corner = lambda dx, dy: F.struct((F.col("id") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y"))
    ids = spark.range(5000)  # estimated at 40 KB; the cells of each take twenty times that
    ring = F.array(corner(5, 0), corner(0, 5), corner(-5, 0), corner(0, -5))
    shapes = S.prepare_territories(ids.select(F.col("id").alias("territory_id"), F.array(ring).alias("rings")))
    points = ids.select(F.col("id").alias("point_id"), (F.col("id") + 0.25).alias("x"), F.lit(0.25).alias("y"))
    hits = S.point_in_territory(points, shapes, 1.0)
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    n = {r.point_id: r.n for r in hits.groupBy("point_id").agg(F.count("*").alias("n")).collect()}
    assert n[2500] == 9 and n[0] == 5 and len(n) == 5000  # |0.25 + d| + 0.25 < 5 for d in -4 ... 4


class States:
    """State of one key and its timers, with a count of the calls."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return One(self, name)

    def getMapState(self, name, *schema):
        return Many(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class One:
    def __init__(self, states, name):
        self.states, self.name = states, name

    def _kept(self):
        self.states.calls += 1
        return self.states.kept

    def get(self):
        return self._kept().get(self.name)

    def exists(self):
        return self.name in self._kept()

    def update(self, value):
        self._kept()[self.name] = value

    def clear(self):
        del self._kept()[self.name]


class Many(One):
    def getValue(self, key):
        return self._kept().get((self.name, key))

    def containsKey(self, key):
        return (self.name, key) in self._kept()

    def updateValue(self, key, value):
        self._kept()[self.name, key] = value

    def removeKey(self, key):
        del self._kept()[self.name, key]


def decided(processor, batches):
    """Output for batches of (rows, watermark after them), as the engine runs them, and the calls."""
    states, out = States(), []
    processor.init(states)
    for rows, watermark in batches:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        list(processor.handleInputRows(("k",), iter(rows), times))
        while rung := sorted(t for t in states.timers if t < watermark):
            states.timers.discard(rung[0])
            out += processor.handleExpiredTimer(("k",), times, SimpleNamespace(getExpiryTimeInMs=lambda: rung[0]))
    return out, states


@pytest.mark.parametrize("few", [16_384, 7])
def test_state_is_touched_per_batch_and_rows_come_in_order(monkeypatch, few):
    monkeypatch.setattr(keyed, "FEW", few, raising=False)
    rng, hour = random.Random(few), 3_600_000_000
    rows = [Row(micros=rng.randrange(0, 200 * hour, 500), id=i, kind=rng.randrange(2)) for i in range(1500)]
    rows += [Row(micros=r.micros, id=2000 + r.id, kind=r.kind) for r in rows[:40]]  # same instants
    rng.shuffle(rows)
    batch = lambda r: r.micros // (50 * hour) + (r.id % 3 == 0 and r.micros % (50 * hour) > 44 * hour)
    batches = [([r for r in rows if batch(r) == b], (50 * b + 44) * 3_600_000) for b in range(5)] + [([], 10**9)]

    now, want = None, []
    plain = keyed.FailureRun(3, 7200, 5 * 3600)
    for r in sorted(rows, key=lambda r: (r.micros, r.kind, r.id)):
        if now is not None and keyed.until(now[1] + 5 * hour) + 1 < keyed.until(r.micros):
            now = None
        now, row = plain.decide("k", now, r.micros, r.id, r.kind)
        want.append(row)
    got, states = decided(keyed.FailureRun(3, 7200, 5 * 3600), batches)
    assert got == want and not states.kept
    assert few < len(rows) or states.calls < 200  # a dozen a batch and one alarm after each, not several a row


def test_files_of_a_batch_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(run, "ROWS_PER_FILE", 10)
    rows = spark.range(150).withColumn("arrival", (F.col("id") % 2).cast("int"))
    folder = run.write_arrivals(rows, F.col("arrival"), 2)
    files = [os.path.dirname(f) for f in spark.read.option("recursiveFileLookup", "true").parquet(folder).inputFiles()]
    assert [files.count(d) for d in sorted(set(files))] == [8, 8]
    sizes = []
    query = run.arrivals(spark, folder).writeStream.trigger(availableNow=True).foreachBatch(lambda df, n: sizes.append(df.count()))
    query.option("checkpointLocation", run.shared_folder(spark)).start().awaitTermination()
    assert sizes == [75, 75]


def test_cells_are_made_only_where_points_are(spark):
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    ids = spark.range(400).select(F.col("id").alias("territory_id"), (F.col("id") * 40.0 - 8000).alias("cx"), (F.col("id") % 7 * 9.0 - 30).alias("cy"))
    r = 2.0 + F.col("territory_id") % 90
    rings = F.array(F.array(*[corner(dx * r, dy * r) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))]))
    shapes = S.prepare_territories(ids.select("*", r.alias("r"), rings.alias("rings")))
    points = spark.range(60).select(F.col("id").alias("point_id"), (F.col("id") * 1.5 - 40.25).alias("x"), (F.col("id") % 11 * 3 - 15.125).alias("y"))
    hits = sorted(map(tuple, S.point_in_territory(points, shapes, 1.0).select("point_id", "territory_id").collect()))
    want = points.crossJoin(ids.withColumn("r", r)).where("abs(x - cx) + abs(y - cy) < r").select("point_id", "territory_id").collect()
    assert hits and hits == sorted(map(tuple, want))
    asked = S.point_cells(points, 1.0, S.levels_in_use(shapes, 1.0))
    few, all_ = (S.territory_cells(shapes, 1.0, ["territory_id"], asked=a).count() for a in (asked, None))
    assert few < all_ / 10


@pytest.fixture
def another_bound(spark):
    """The session as its owner has it when the rows are asked for: a bound under which all of these tables would be broadcast."""
    apply_conf(spark)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    kept = {k: spark.conf.get(k) for k in keys}
    yield lambda: [spark.conf.set(k, "10MB") for k in keys]
    for k, v in kept.items():
        spark.conf.set(k, v)


def plan_of(df):
    """The plan as it ran."""
    rows = df._jdf.queryExecution()
    rows.executedPlan().executeCollect()
    return rows.executedPlan().toString()


def squares(spark, n):
    corner = lambda dx, dy: F.struct((F.col("id") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y"))
    ring = F.array(corner(2, 0), corner(0, 2), corner(-2, 0), corner(0, -2))
    return S.prepare_territories(spark.range(n).select(F.col("id").alias("territory_id"), F.array(ring).alias("rings")))


def test_territories_are_not_broadcast_under_any_bound(spark, another_bound):
    shapes = squares(spark, 200)
    points = spark.range(200).select(F.col("id").alias("point_id"), (F.col("id") + 0.25).alias("x"), F.lit(0.25).alias("y"))
    inside = S.point_in_territory(points, shapes, 1.0)
    boxes = S.bbox_candidates(points, shapes, 1.0)
    overlap = S.territory_overlap(shapes, 0.5)
    another_bound()
    wide = [line for line in plan_of(inside).splitlines() if "BroadcastHashJoin" in line and "LeftSemi" not in line]
    assert not wide  # the tiles that hold points may go to all tasks, as measured
    for df in (boxes, overlap):
        assert "BroadcastHashJoin" not in plan_of(df)
    assert {r.point_id: r.n for r in boxes.groupBy("point_id").agg(F.count("*").alias("n")).collect()}[100] == 4
    assert overlap.count() == 199 + 198  # neighbours at distance 1 and 2 share samples


def test_names_are_not_broadcast_under_any_bound(spark, another_bound):
    sources = spark.range(60).select(F.lit("s1").alias("source"), F.concat(F.lit("name "), F.col("id")).alias("canonical"),
                                     F.concat(F.lit("Name "), (F.col("id") % 30).cast("string")).alias("alias"))
    edges = D.name_edges(sources)
    groups = D.merge_groups(edges)
    named = D.name_groups(edges, groups, "s1", "s2")
    brands = spark.createDataFrame([("name 31", "First")], "legal_lower string, brand string")
    parents = spark.createDataFrame([("name 32", "Parent")], "child string, parent_company string")
    auto = spark.createDataFrame([("name 3", "name 3 north"), ("other 1", "other 1 plus")], "key string, alias string")
    whole = D.build_dictionary(sources, brands, parents, auto)
    another_bound()
    assert "BroadcastHashJoin" not in plan_of(named)
    assert "BroadcastHashJoin" not in plan_of(whole)
    assert named.count() == 30
    got = {r.canonical.lower(): r for r in whole.collect()}
    assert got["name 31"].display_name == "First" and got["name 32"].parent_company == "Parent" and "name 1" not in got


@pytest.mark.parametrize("few", [16_384, 50])
def test_keys_of_a_group_share_the_calls_to_the_state(monkeypatch, few):
    monkeypatch.setattr(keyed, "FEW", few)
    rng, hour = random.Random(3), 3_600_000_000
    names = [None, *(f"k{i}" for i in range(299))]
    rows = [Row(micros=rng.randrange(0, 200 * hour, 500), id=i, kind=rng.randrange(2), key=names[i * i % 300]) for i in range(3000)]
    batches = [([r for r in rows if r.micros // (50 * hour) == b], (50 * b + 44) * 3_600_000) for b in range(4)] + [([], 10**9)]
    for make in (lambda: keyed.RateLimit(2, 86400), lambda: keyed.RollingCount(3, 86400), lambda: keyed.FailureRun(3, 7200, 5 * 3600)):
        got, states = decided(make(), batches)
        want, plain = [], make()
        for name in names:
            now = None
            for r in sorted((r for r in rows if r.key == name), key=lambda r: (r.micros, r.kind, r.id)):
                if now is not None and plain._over(now) + 1 < keyed.until(r.micros):
                    now = None
                now, row = plain.decide(name, now, r.micros, r.id, r.kind)
                want.append(row)
        assert sorted(map(str, got)) == sorted(map(str, want)) and not states.kept
        assert few < len(rows) or states.calls < 200  # not several a key


def test_a_stream_groups_keys_of_any_type(spark):
    apply_conf(spark)
    rows = [(0, i, i % 40, i) for i in range(400)] + [(1, 400 + i, i % 40, 500 + i) for i in range(40)] + [(2, None, None, 900_000)]
    df = spark.createDataFrame(rows, "arrival int, event_id long, who long, second long").withColumn("ts", F.timestamp_seconds(F.col("second") + 1_000_000))
    got = run.drain(T.recent_lookups(run.arrivals(spark, run.write_arrivals(df, F.col("arrival"), 3)), "who"))
    assert dict(got.dtypes)["who"] == "bigint"
    assert {r.event_id: (r.who, r.n_before) for r in got.collect()} == {i: (i % 40, min(5, i // 40)) for i in range(440)}
