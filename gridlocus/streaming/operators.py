"""Structured Streaming forms of the request-at-a-time behaviour.

State per key is constant in size (a handful of timestamps or one record) and is
dropped by event-time timers, so it does not grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.streaming.keyed import CacheLives, FailureRun, LatestLookup, RateLimit, RollingCount, in_order

# fixed values
TOKEN_SECONDS = 60
RATE_LIMIT, RATE_WINDOW = 5, 24 * 3600
BREAKER_THRESHOLD, BREAKER_COOLDOWN = 3, 300
ANSWER_LIFE, MISS_LIFE = 90 * 24 * 3600, 24 * 3600

#: How long a row may come after later ones.
LATE = "24 hours"

def first_within_ttl(requests: DataFrame, key: str = "address_key", ts: str = "ts", ttl: str = "90 days") -> DataFrame:
    """Requests whose key was not seen within the time to live."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def cache_lives(requests: DataFrame, key: str = "address_key", ts: str = "ts", number: str = "request_id", kind: str = "kind",
                answer: int = ANSWER_LIFE, miss: int = MISS_LIFE, late: str = LATE) -> DataFrame:
    """Which requests the cache answers.  ``kind`` is what asking at that time gives: `answer` (kept for ``answer`` seconds),
    `miss` (an answer that there is nothing, kept for ``miss`` seconds) or anything else, a failure, which is never kept.

    Result: request_id, key, cached, answered_by (the request whose answer is used; null for a failure)."""
    code = F.when(F.col(kind) == "answer", 0).when(F.col(kind) == "miss", 1).otherwise(2)
    return in_order(requests, CacheLives({0: answer, 1: miss}), f"request_id bigint, key {kind_of(requests, key)}, cached boolean, answered_by bigint", key, ts, number, code, late)


def single_use_tokens(requests: DataFrame, token: str = "token", issued: str = "issued_ts", ts: str = "ts") -> DataFrame:
    """A token is accepted once, within a minute of its issue."""
    age = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(issued))
    fresh = requests.where((age >= 0) & (age <= TOKEN_SECONDS * 1_000_000))
    return fresh.withWatermark(ts, f"{TOKEN_SECONDS} seconds").dropDuplicatesWithinWatermark([token])


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def rate_limit(events: DataFrame, key: str = "email", ts: str = "ts", limit: int = RATE_LIMIT, late: str = LATE) -> DataFrame:
    """Accepts an event while fewer than ``limit`` accepted ones are under 24 h old.
    The state is the key's last ``limit`` accepted instants.

    Event columns: event_id, key, ts.  Result: event_id, key, ts, accepted, remaining.
    """
    decided = in_order(events, RateLimit(limit, RATE_WINDOW), f"event_id bigint, key {kind_of(events, key)}, micros bigint, accepted boolean, remaining int",
                       key, ts, "event_id", F.lit(0), late)
    return decided.select("event_id", F.col("key").alias(key), F.timestamp_micros("micros").alias(ts), "accepted", "remaining")


def recent_lookups(events: DataFrame, key: str = "email", ts: str = "ts", limit: int = RATE_LIMIT, late: str = LATE) -> DataFrame:
    """The earlier events of the key in the last 24 hours, counted up to ``limit``, and whether they reach it.  The state
    is as many instants.  Result: event_id, key, n_before, limited."""
    decided = in_order(events, RollingCount(limit, RATE_WINDOW), f"event_id bigint, key {kind_of(events, key)}, n_before int, limited boolean", key, ts, "event_id", F.lit(0), late)
    return decided.withColumnRenamed("key", key)


def rate_monitor(events: DataFrame, key: str = "email", ts: str = "ts") -> DataFrame:
    """Approximate load per key: 24-hour windows sliding by the hour."""
    return events.withWatermark(ts, LATE).groupBy(F.window(ts, "24 hours", "1 hour"), key).agg(F.count("*").alias("n"))


def attribute_clicks_stream(events: DataFrame, key: str = "email", ts: str = "ts", keep_hours: int = 24, late: str = LATE) -> DataFrame:
    """Each click with the latest earlier lookup of its key.  The state is that one
    lookup, so no (click, lookup) pairs are formed.

    Event columns: event_id, key, ts, is_click.
    """
    decided = in_order(events, LatestLookup(keep_hours * 3600), f"click_id bigint, key {kind_of(events, key)}, lookup_id bigint", key, ts, "event_id", F.col("is_click"), late)
    return decided.withColumnRenamed("key", key)


def circuit_breaker(calls: DataFrame, threshold: int = BREAKER_THRESHOLD, cooldown: int = BREAKER_COOLDOWN, keep: int = 30 * 24 * 3600, late: str = LATE) -> DataFrame:
    """Run length of failures per source, and whether a call came while the source was
    disabled.  State: failures in a row and the instant of the last call, for ``keep`` seconds after it.

    Call columns: call_id, source, ts, ok.
    """
    return in_order(calls, FailureRun(threshold, cooldown, keep), f"call_id bigint, source {kind_of(calls, 'source')}, run_length bigint, disabled boolean",
                    "source", "ts", "call_id", F.col("ok"), late)


def progress_metrics(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Rows and failures per tumbling window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_failed")
    ).select(F.col("window.start").alias("window_start"), "n_rows", "n_failed")
