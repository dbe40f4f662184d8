"""URL filters by dated lists: which list entries were active when a page was fetched.

A list entry is an event: on a date an entry (a host, a domain with all below it, or a URL prefix) is added to or removed from a
list.  The events of an entry become validity intervals: an addition holds until the next event of the same entry.  A capture is
matched with every key its URL gives (its host, each parent domain, each path prefix), as of its fetch time.  A
capture is blocked if an active entry of a block list meets it and no active entry of an allow list does.

The join is on the key, with the interval as a condition, so a host that holds a third of all captures is an
ordinary hot join key (entries per key are few, and the planner splits the capture side); nothing is collected per host.

Cases: a null or unreadable URL has no keys and is never met; a null fetch time is met by nothing; an event without a
date, entry or action is ignored; of several events of an entry at the same time a removal wins; repeated events change
nothing; an entry whose first event is a removal is not active before it; hosts are compared without regard to letter case, paths with it; captures equal in id, URL and time are one row; empty captures
give an empty table, empty lists block nothing; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plain_entry() -> Column:
    """Hosts and domains in lower case; of a prefix the host alone, as paths tell letter cases apart."""
    path = F.regexp_extract("entry", r"(?s)^[^/]*(.*)$", 1)
    return F.when(F.col("kind") == "prefix", F.concat(F.lower(F.substring_index("entry", "/", 1)), path)).otherwise(F.lower("entry"))


def validity(events: DataFrame) -> DataFrame:
    """(list, kind, entry, since, until) from events (list, kind, entry, action 'add' or 'remove', at); until null is open."""
    seen = events.where("list is not null and kind is not null and entry is not null and at is not null and action in ('add', 'remove')")
    once = seen.withColumn("entry", plain_entry()).groupBy("list", "kind", "entry", "at").agg(F.max("action").alias("action"))  # remove wins
    order = Window.partitionBy("list", "kind", "entry").orderBy("at")
    return once.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "entry", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def keys_of(url: Column) -> Column:
    """[(kind, entry)]: the host, every domain it lies in (itself included), and every path prefix of it, ending in a slash or whole."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    prefix = lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.when(i < F.size(steps), prefix(i)).otherwise(F.concat(host, path)).alias("entry")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("entry"))), domains, prefixes)))


def judge_captures(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, url, fetched, blocked, block_entry, allow_entry): the least block and allow entry (kind:entry) that were active at
    fetch time, one row per distinct capture."""
    keyed = captures.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.col(fetched).alias("_at"), F.explode_outer(keys_of(F.col(url))).alias("_key"))
    keyed = keyed.select("_id", "_url", "_at", F.col("_key.kind").alias("kind"), F.col("_key.entry").alias("entry"))
    active = validity(events).withColumnsRenamed({"kind": "_kind", "entry": "_entry"})
    as_of = F.expr("kind = _kind and entry = _entry and _at >= since and (until is null or _at < until)")
    name = F.concat("kind", F.lit(":"), "entry")
    met = keyed.join(active, as_of, "left").groupBy("_id", "_url", "_at").agg(
        F.min(F.when(F.col("list") == "block", name)).alias("block_entry"), F.min(F.when(F.col("list") == "allow", name)).alias("allow_entry"))
    blocked = F.col("block_entry").isNotNull() & F.col("allow_entry").isNull()
    return met.select(F.col("_id").alias(key), F.col("_url").alias(url), F.col("_at").alias(fetched), blocked.alias("blocked"), "block_entry", "allow_entry")
