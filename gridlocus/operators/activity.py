"""Lookup and source-call logs: rolling counts, as-of attribution, failure runs.

One user, address or source may own a third of a log, so no window here spans a
whole key.  Rows are windowed within (key, time bucket); what a bucket needs from
the buckets before it comes from one pre-aggregated row per (key, bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
# fixed values
LOOKUP_LIMIT = 5
WINDOW_SECONDS = 24 * HOUR


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_count(events: DataFrame, key: str, ts: str, event_id: str, seconds: int = WINDOW_SECONDS, bucket: int = HOUR) -> DataFrame:
    """Adds ``n_recent``: events of the key less than ``seconds`` old at each event's
    own instant, itself included.  ``seconds`` is a multiple of ``bucket``.  Events
    without a key or an instant are left out.

    The rows pass one exchange, by (key, bucket), and nothing is joined back to them.
    Beside them travel, in the same frame, a ghost of every event ``seconds`` later,
    which tells who has left the window, and one carry row per bucket with the number
    of events in the whole buckets between; those come from per-bucket counts.
    """
    span, width = seconds * 1_000_000, bucket * 1_000_000
    steps = seconds // bucket
    given = F.struct(*events.columns)
    df = events.withColumn("_t", _micros(ts)).where(F.col("_t").isNotNull() & F.col(key).isNotNull()).withColumn("_b", F.floor(F.col("_t") / width))
    between = Window.partitionBy("_k").orderBy("_b").rangeBetween(-(steps - 1), -1)
    per_bucket = df.groupBy(F.col(key).alias("_k"), "_b").agg(F.count("*").alias("_n"))
    carry = per_bucket.select("_k", "_b", (F.col("_b") * width).alias("_t"), F.lit(2).alias("_kind"), F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_middle"))
    live = df.select(F.col(key).alias("_k"), "_b", "_t", F.lit(0).alias("_kind"), given.alias("_row"))
    ghosts = df.select(F.col(key).alias("_k"), (F.col("_b") + steps).alias("_b"), (F.col("_t") + span).alias("_t"), F.lit(1).alias("_kind"))
    every = live.unionByName(ghosts, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)

    place = Window.partitionBy("_k", "_b")
    upto = place.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    after = place.orderBy("_t").rangeBetween(1, Window.unboundedFollowing)
    number = lambda kind: F.when(F.col("_kind") == kind, 1).otherwise(0)
    counted = every.select(
        "_kind", "_row",
        (F.sum(number(0)).over(upto) + F.coalesce(F.sum(number(1)).over(after), F.lit(0)) + F.coalesce(F.max("_middle").over(place), F.lit(0))).alias("n_recent"),
    )
    return counted.where("_kind = 0").select("_row.*", "n_recent")


def lookup_limits(events: DataFrame, allowed_emails: list[str] | None = None, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Lookups in the last 24 hours by the same e-mail or the same IP, not counting
    the event itself twice.  ``events``: event_id, created_at, email, ip_address.

    |E or I| = |E| + |I| - |E and I|, three rolling counts one after the other instead
    of collected ids.  An event without a key counts under a key of its own.
    """
    alone = F.concat(F.lit("\u0000"), F.col("event_id").cast("string"))
    email, ip = F.coalesce(F.col("email").cast("string"), alone), F.coalesce(F.col("ip_address").cast("string"), alone)
    df = events.where("created_at IS NOT NULL")
    for out, key in (("_e", email), ("_i", ip), ("_p", F.struct(email.alias("e"), ip.alias("i")))):
        df = rolling_count(df.withColumn("_key", key), "_key", "created_at", "event_id").drop("_key").withColumnRenamed("n_recent", out)
    known = lambda out, *columns: F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), F.col(out)).otherwise(0)
    n = known("_e", "email") + known("_i", "ip_address") - known("_p", "email", "ip_address") - 1
    if allowed_emails:
        n = F.when(F.lower("email").isin([e.lower() for e in allowed_emails]), 0).otherwise(n)
    return df.withColumn("recent_lookups", n).drop("_e", "_i", "_p").withColumns({
        "limited": F.col("recent_lookups") >= limit,
        "searches_remaining": F.greatest(F.lit(0), limit - F.col("recent_lookups") - 1),
    })


def latest_prior(events: DataFrame, references: DataFrame, key: str, ts: str, ref_ts: str, payload: list[str], bucket: int = 24 * HOUR) -> DataFrame:
    """As-of join: each event with the latest reference of its key not after it.

    Within a bucket the reference is carried forward by a window; across buckets by
    the last reference of every earlier bucket.
    """
    width = bucket * 1_000_000
    record = F.struct(F.col("_t").alias("t"), *payload)
    refs = references.select(key, _micros(ref_ts).alias("_t"), *payload).where(F.col(key).isNotNull())
    refs = refs.withColumns({"_b": F.floor(F.col("_t") / width), "_ref": record})
    per_bucket = refs.groupBy(key, "_b").agg(F.max("_ref").alias("_last"))
    mine = events.withColumn("_t", _micros(ts)).withColumn("_b", F.floor(F.col("_t") / width))
    union = refs.select(key, "_b", "_t", F.lit(0).alias("_kind"), "_ref", *[F.lit(None).cast(events.schema[c].dataType).alias(f"_e_{c}") for c in events.columns]).unionByName(
        mine.select(key, "_b", "_t", F.lit(1).alias("_kind"), F.lit(None).cast(refs.schema["_ref"].dataType).alias("_ref"), *[F.col(c).alias(f"_e_{c}") for c in events.columns]))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind", F.col("_ref")).rowsBetween(Window.unboundedPreceding, 0)
    here = union.withColumn("_here", F.last("_ref", ignorenulls=True).over(w)).where("_kind = 1")
    # Bucket-level carry: one row per (key, bucket) that has events or references.
    buckets = union.select(key, "_b").distinct().join(per_bucket, [key, "_b"], "left")
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(key, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    out = here.join(carried, [key, "_b"], "left").withColumn("_pick", F.coalesce("_here", "_before"))
    return out.select(*[F.col(f"_e_{c}").alias(c) for c in events.columns], *[F.col(f"_pick.{p}").alias(p) for p in payload])


def attribute_clicks(clicks: DataFrame, lookups: DataFrame) -> DataFrame:
    """Each click with the latest earlier lookup of the same e-mail or reference code.

    ``clicks``: click_id, clicked_at, email, ref_code.  ``lookups``: lookup_id,
    created_at, email, ref_code.
    """
    found = []
    for column in ("email", "ref_code"):
        refs = lookups.where(F.col(column).isNotNull()).select(column, "created_at", "lookup_id", F.col("created_at").alias("lookup_at"))
        mine = clicks.where(F.col(column).isNotNull()).select("click_id", column, "clicked_at")
        hit = latest_prior(mine, refs, column, "clicked_at", "created_at", ["lookup_at", "lookup_id"])
        found.append(hit.where("lookup_id IS NOT NULL").select("click_id", "lookup_at", "lookup_id"))
    best = found[0].unionByName(found[1]).groupBy("click_id").agg(F.max_by("lookup_id", F.struct("lookup_at", "lookup_id")).alias("lookup_id"))
    return clicks.join(best, "click_id", "left")


def failure_runs(calls: DataFrame, threshold: int = 3, cooldown: int = 300, bucket: int = 24 * HOUR) -> DataFrame:
    """Adds ``run_length`` (failures since the last success), ``opens`` (the failure
    that reaches the threshold) and ``disabled``: a call no more than ``cooldown``
    seconds after a failure at or beyond the threshold, with no success in between.

    ``calls``: source, ts, call_id, ok.
    """
    width = bucket * 1_000_000
    df = calls.withColumn("_t", _micros("ts")).withColumn("_b", F.floor(F.col("_t") / width))
    order = ["_t", "call_id"]
    w = Window.partitionBy("source", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fails = F.when(F.col("ok"), 0).otherwise(1)
    df = df.withColumn("_seen", F.sum(fails).over(w)).withColumn("_mark", F.max(F.when(F.col("ok"), F.col("_seen"))).over(w))
    # Per bucket: did it succeed at all, and how many failures trail its last success.
    per = df.groupBy("source", "_b").agg(
        F.sum(fails).alias("_fails"), F.bool_or("ok").alias("_any"), F.max(F.when(F.col("ok"), F.col("_seen"))).alias("_last_mark"))
    per = per.withColumn("_tail", F.col("_fails") - F.coalesce("_last_mark", F.lit(0)))
    prefix = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_cum", F.coalesce(F.sum("_fails").over(prefix), F.lit(0)))
    per = per.withColumn("_reset", F.max(F.when(F.col("_any"), F.col("_cum") + F.col("_fails") - F.col("_tail"))).over(prefix))
    carry = per.select("source", "_b", (F.col("_cum") - F.coalesce("_reset", F.lit(0))).alias("_carry"))
    df = df.join(carry, ["source", "_b"])
    run = F.when(F.col("ok"), 0).otherwise(F.when(F.col("_mark").isNull(), F.col("_carry") + F.col("_seen")).otherwise(F.col("_seen") - F.col("_mark")))
    df = df.withColumn("run_length", run.cast("long")).withColumn("opens", F.col("run_length") == threshold)
    prior = df.select("source", "_b", *order, "ts", "run_length", "ok", "opens", *[c for c in calls.columns if c not in ("source", "ts", "call_id", "ok")])
    # The state before a call is the state after the call before it.
    back = Window.partitionBy("source", "_b").orderBy(*order)
    state = F.struct(F.col("_t").alias("t"), F.col("run_length").alias("run"))
    prior = prior.withColumn("_prev", F.lag(state).over(back))
    last = prior.groupBy("source", "_b").agg(F.max_by(state, F.struct(*order)).alias("_end"))
    bucket_back = Window.partitionBy("source").orderBy("_b")
    before = last.select("source", "_b", F.lag("_end").over(bucket_back).alias("_before"))
    out = prior.join(before, ["source", "_b"]).withColumn("_prev", F.coalesce("_prev", "_before"))
    disabled = (F.col("_prev.run") >= threshold) & ((F.col("_t") - F.col("_prev.t")) <= cooldown * 1_000_000)
    return out.withColumn("disabled", F.coalesce(disabled, F.lit(False))).drop("_b", "_t", "_prev", "_before")
