"""Counts, shares and top lists.  Every list is aggregated before it is ranked, so
ranking sees one row per distinct value, and a rank filter is applied map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules, text
from gridlocus.operators.compare import CORRECT, pct
from gridlocus.operators.names import alias_lookup, match_name_multi
from gridlocus.session import cut_lineage

UTILITY_TYPES = ["electric", "gas", "water"]


def top_n(counts: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def comparison_counts(results: DataFrame) -> DataFrame:
    """Wide counts: one row per type, one column per category."""
    return results.groupBy("utility_type").agg(
        *[F.count_if(F.col("comparison") == c).alias(c.lower()) for c in rules.CATEGORIES]
    )


def id_bucket_breakdown(results: DataFrame) -> DataFrame:
    """Count and share per id bucket; empty buckets are kept."""
    present = results.agg(*[F.count_if(F.col("id_match") == b).alias(b) for b in rules.ID_BUCKETS])
    rows = F.array(*[F.struct(F.lit(b).alias("id_match"), F.col(b).alias("n")) for b in rules.ID_BUCKETS])
    total = sum((F.col(b) for b in rules.ID_BUCKETS), F.lit(0))
    return present.select(total.alias("total"), F.inline(rows)).select(
        "id_match", "n", pct(F.col("n"), F.col("total")).alias("share_pct")
    )


def top_mismatch_pairs(results: DataFrame, n: int = 20) -> DataFrame:
    counts = results.where("comparison = 'MISMATCH'").groupBy("utility_type", "engine_provider", "tenant_normalized").agg(F.count("*").alias("n"))
    return top_n(counts, ["utility_type"], [F.col("n").desc(), F.col("engine_provider"), F.col("tenant_normalized")], n)


def mismatches_by_state(results: DataFrame, n: int = 10) -> DataFrame:
    counts = results.where("comparison = 'MISMATCH'").groupBy("utility_type", "state").agg(F.count("*").alias("n"))
    return top_n(counts, ["utility_type"], [F.col("n").desc(), F.col("state")], n)


def deregulated_breakdown(results: DataFrame) -> DataFrame:
    """Texas electric rows per answer: total, matched to the delivery utility, not
    deregulated, without an answer."""
    texas = results.where((F.upper("state") == "TX") & (F.col("utility_type") == "electric"))
    return texas.groupBy("engine_provider").agg(
        F.count("*").alias("total"), F.count_if(F.col("comparison") == "MATCH_TDU").alias("matched_tdu"),
        F.count_if(F.col("engine_provider").isNotNull() & ~F.coalesce("engine_is_deregulated", F.lit(False))).alias("not_deregulated"),
        F.count_if(F.col("engine_provider").isNull()).alias("no_result"),
    )


def geocode_failures(addresses: DataFrame, n_states: int = 10) -> DataFrame:
    failed = addresses.where("lat IS NULL OR (lat = 0 AND lon = 0)")
    return failed.groupBy("state").agg(F.count("*").alias("failures"), F.min("address").alias("example")).orderBy(
        F.col("failures").desc(), "state"
    ).limit(n_states)


def geocode_failure_sample(addresses: DataFrame, n: int = 100) -> DataFrame:
    return addresses.where("lat IS NULL OR (lat = 0 AND lon = 0)").orderBy("address_id").limit(n)


def catalog_duplicate_pairs(results: DataFrame) -> DataFrame:
    keys = ["engine_provider", "engine_catalog_id", "tenant_catalog_title", "tenant_catalog_id"]
    return results.where("id_match = 'NAME_MATCH_ID_MISMATCH'").groupBy(*keys).agg(F.count("*").alias("n"))


# ---- coverage ----------------------------------------------------------------
def coverage_flags(reported: DataFrame, aliases: DataFrame, reps: DataFrame, min_score: float | None = 85.0) -> DataFrame:
    """Flags per distinct reported value.  ``reported``: utility_type, raw."""
    values = reported.select("raw").distinct()
    segments = match_name_multi(values, aliases, reps, "raw", min_score)
    return segments.groupBy("raw").agg(
        F.bool_or(F.col("match_type") == "null_value").alias("any_null"),
        F.bool_or(F.col("match_type") == "propane").alias("any_propane"),
        F.bool_or("is_rep").alias("any_rep"), F.bool_or("matched").alias("any_matched"),
        F.bool_and("matched").alias("all_matched"),
    ).withColumn("outcome", F.when(F.col("any_null"), "null").when(F.col("any_propane"), "propane")
                 .when(F.col("any_rep"), "rep").when(F.col("any_matched"), "matched").otherwise("unmatched"))


def _counted(reported: DataFrame) -> DataFrame:
    return reported.where("trim(raw) <> ''").withColumn("raw", F.trim("raw")).groupBy("utility_type", "raw").agg(F.count("*").alias("n"))


def coverage_by_type(reported: DataFrame, aliases: DataFrame, reps: DataFrame, min_score: float | None = 85.0) -> DataFrame:
    """Per type, for electric and gas together, and for all types."""
    counted = _counted(reported)
    df = counted.join(coverage_flags(counted, aliases, reps, min_score), "raw")
    groups = F.array_compact(F.array(
        F.col("utility_type"), F.when(F.col("utility_type").isin("electric", "gas"), "electric+gas"), F.lit("all")))
    n, o = F.col("n"), F.col("outcome")
    return df.select("*", F.explode(groups).alias("scope")).groupBy("scope").agg(
        F.sum("n").alias("total"),
        F.sum(F.when((o == "matched") | ((o == "rep") & F.col("any_matched")), n).otherwise(0)).alias("matched"),
        F.sum(F.when(o == "unmatched", n).otherwise(0)).alias("unmatched"),
        F.sum(F.when(o == "rep", n).otherwise(0)).alias("rep_flagged"),
        F.sum(F.when(o == "null", n).otherwise(0)).alias("null_values"),
        F.sum(F.when(o == "propane", n).otherwise(0)).alias("propane"),
    ).withColumn("matched_pct", pct(F.col("matched"), F.col("total")))


def comma_split_stats(reported: DataFrame, aliases: DataFrame, reps: DataFrame, min_score: float | None = 85.0) -> DataFrame:
    counted = _counted(reported).where(F.col("raw").contains(","))
    df = counted.join(coverage_flags(counted, aliases, reps, min_score), "raw")
    return df.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("with_comma"),
        F.coalesce(F.sum(F.when(F.col("any_matched"), F.col("n"))), F.lit(0)).alias("some_matched"),
        F.coalesce(F.sum(F.when(F.col("all_matched"), F.col("n"))), F.lit(0)).alias("all_matched"),
    )


def coverage_exact(reported: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact dictionary coverage, weighted by occurrence and by distinct name."""
    counted = reported.where("trim(raw) <> ''").groupBy(F.trim("raw").alias("raw")).agg(F.count("*").alias("n"))
    df = alias_lookup(counted, aliases, "raw")
    hit = F.col("canonical_id").isNotNull()
    return df.agg(
        F.sum("n").alias("instances"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("matched_instances"),
        F.count("*").alias("names"), F.count_if(hit).alias("matched_names"),
    ).withColumns({"instance_pct": pct(F.col("matched_instances"), F.col("instances")), "name_pct": pct(F.col("matched_names"), F.col("names"))})


def top_unmatched(reported: DataFrame, aliases: DataFrame, reps: DataFrame, n: int = 50, outcome: str = "unmatched", min_score: float | None = 85.0) -> DataFrame:
    """Most frequent electric and gas values with the outcome, with a category."""
    counted = _counted(reported.where("utility_type IN ('electric', 'gas')")).groupBy("raw").agg(F.sum("n").alias("n"))
    flags = coverage_flags(counted, aliases, reps, min_score).where(F.col("outcome") == outcome)
    return counted.join(flags, "raw").select("raw", "n", text.classify_unmatched("raw").alias("category")).orderBy(F.col("n").desc(), "raw").limit(n)


def name_frequencies(reported: DataFrame) -> DataFrame:
    """Counts of whole values and, for values with a comma, of their segments too."""
    counted = _counted(reported)
    parts = F.when(F.col("raw").contains(","), F.filter(F.transform(F.split("raw", ","), lambda p: F.trim(p)), lambda s: s != "")).otherwise(F.array())
    return counted.select("utility_type", F.explode(F.concat(F.array("raw"), parts)).alias("name"), "n").groupBy("utility_type", "name").agg(F.sum("n").alias("n"))


def tenant_impact_score(missing: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Mentions of each missing entity: per name and type the exact count, else the
    count of the first value (by name) that differs in case only.

    ``missing``: eia_id, names.
    """
    names = missing.select("eia_id", F.explode("names").alias("name")).select("eia_id", F.trim("name").alias("name"))
    exact = frequencies.select("utility_type", "name", F.col("n").alias("exact_n"))
    folded = frequencies.groupBy("utility_type", F.lower("name").alias("lower")).agg(F.min_by("n", "name").alias("folded_n"))
    probes = names.select("eia_id", "name", F.lower("name").alias("lower"))
    hits = (
        probes.join(folded, "lower").join(exact, ["utility_type", "name"], "left")
        .select("eia_id", F.concat_ws(":", "utility_type", "name").alias("mention"), F.coalesce("exact_n", "folded_n").alias("n"))
    )
    # The same name listed twice for an entity counts twice, and appears once in the details.
    per_mention = hits.groupBy("eia_id", "mention").agg(F.sum("n").alias("total"), F.max("n").alias("n"))
    per_entity = per_mention.groupBy("eia_id").agg(
        F.sum("total").alias("tenant_mentions"), F.map_from_entries(F.collect_list(F.struct("mention", "n"))).alias("mention_details")
    )
    return missing.join(per_entity, "eia_id", "left").select(
        "eia_id", "names", F.coalesce("tenant_mentions", F.lit(0)).alias("tenant_mentions"), "mention_details",
        text.infer_utility_type("names").alias("utility_type"), P.is_wholesale("names").alias("is_wholesale"),
    )


def addition_candidates(scored: DataFrame) -> DataFrame:
    """Entities worth adding: 10 mentions or more high, 1-9 low priority."""
    kept = scored.where("NOT is_wholesale AND tenant_mentions >= 1")
    display = text.pick_display_name("names")
    return kept.select(
        display.alias("display_name"), "eia_id",
        F.array_sort(F.array_except("names", F.array(display))).alias("aliases"), "utility_type", "tenant_mentions",
        F.when(F.col("tenant_mentions") >= 10, "high").otherwise("low").alias("priority"),
    )


def extract_reps(reported: DataFrame, min_count: int = 2) -> DataFrame:
    """Retail providers: frequent Texas electric segments that are nothing else.

    ``reported``: state, raw (electric values).
    """
    counted = reported.where("state = 'TX' AND trim(raw) <> ''").groupBy("raw").agg(F.count("*").alias("n"))
    segments = counted.select(F.explode(F.transform(F.split("raw", ","), lambda p: F.trim(p))).alias("name"), "n").where("name <> ''")
    totals = segments.groupBy("name").agg(F.sum("n").alias("n"))
    lower = F.lower("name")
    return totals.where(
        ~lower.isin(rules.NOT_RETAIL) & ~P.contains_any(lower, rules.NOT_RETAIL_WORDS)
        & (F.col("n") >= min_count) & (F.length("name") >= 3)
    )


# ---- review and sources ------------------------------------------------------
def review_stats(results: DataFrame) -> DataFrame:
    provider, tenant = F.col("engine_provider").isNotNull(), F.col("tenant_raw").isNotNull() & (F.col("tenant_raw") != "")
    due = P.needs_review_queue("comparison", "engine_confidence", "tenant_raw", "engine_provider", "engine_catalog_id")
    return results.groupBy("utility_type").agg(
        F.count_if(provider & tenant).alias("scoreable"),
        F.count_if(provider & tenant & F.col("comparison").isin(CORRECT)).alias("correct"),
        F.count_if(provider).alias("with_provider"),
        F.count_if(provider & F.col("engine_catalog_id").isNotNull()).alias("id_matched"),
        F.count_if(provider & F.coalesce("engine_id_confident", F.lit(False))).alias("id_confident"),
        F.count_if(due).alias("review_rows"),
    ).withColumn("accuracy_pct", pct(F.col("correct"), F.col("scoreable")))


def review_reason_counts(results: DataFrame) -> DataFrame:
    due = P.needs_review_queue("comparison", "engine_confidence", "tenant_raw", "engine_provider", "engine_catalog_id")
    reason = P.review_reason("comparison", F.coalesce("engine_needs_review", F.lit(False)), "engine_provider", "engine_catalog_id", F.coalesce("engine_id_confident", F.lit(False)))
    return (
        results.where(due).select("utility_type", F.explode(F.split(reason, "; ")).alias("reason")).where("reason <> ''")
        .groupBy("utility_type", "reason").agg(F.count("*").alias("n"))
    )


def source_distribution(results: DataFrame) -> DataFrame:
    counts = results.where("engine_source IS NOT NULL AND engine_source <> ''").groupBy("utility_type", "engine_source").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("utility_type"))))


def stratified_sample(rows: DataFrame, by: list[str], key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """At most n rows per stratum, by a seeded hash of the key: repeatable, and a
    large stratum is cut map-side before it is brought together."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_fix_rate(mismatches: DataFrame, tested: DataFrame, n_states: int = 15) -> DataFrame:
    """Fix rate of the sampled rows per (type, state), projected on all mismatches.

    ``tested``: utility_type, state, fixed BOOLEAN — the sampled and re-tested rows.
    """
    sizes = mismatches.groupBy("utility_type", "state").agg(F.count("*").alias("mismatches"))
    top = top_n(sizes, ["utility_type"], [F.col("mismatches").desc(), F.col("state")], n_states).drop("rank")
    rates = tested.groupBy("utility_type", "state").agg(F.count("*").alias("tested"), F.count_if("fixed").alias("fixed"))
    rate = F.try_divide(F.col("fixed").cast("double"), F.col("tested"))
    return top.join(rates, ["utility_type", "state"]).withColumns({
        "fix_rate": rate, "projected": F.floor(rate * F.col("mismatches")).cast("long"),
    })


def geocoder_stats(geocoded: DataFrame) -> DataFrame:
    s = F.col("hit_source")
    return geocoded.agg(
        F.count("*").alias("total"), F.count_if(s == "primary").alias("primary_hits"),
        F.count_if(s == "fallback").alias("fallback_hits"), F.count_if(s == "miss").alias("misses"),
    ).withColumns({
        "hit_pct": pct(F.col("primary_hits") + F.col("fallback_hits"), F.col("total")),
        "fallback_pct": pct(F.col("fallback_hits"), F.col("total")),
    })


def zip_dominance_build(reported: DataFrame) -> DataFrame:
    """Leading provider per (type, state, ZIP), its share and the sample size.

    ``reported``: utility_type, state, zip, name.  Level thresholds are ours: high
    from 80 %, medium from 60 %, else low.
    """
    keys = ["utility_type", "state", "zip"]
    counts = reported.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"), F.min_by(F.struct("name", "n"), F.struct(-F.col("n"), F.col("name"))).alias("b")
    )
    share = F.col("b.n") * 100.0 / F.col("sample_count")
    return best.select(*keys, F.col("b.name").alias("name"), "sample_count", share.alias("dominance_pct"),
                       F.when(share >= 80, "high").when(share >= 60, "medium").otherwise("low").alias("confidence_level"))


def phase_timing(run_log: DataFrame) -> DataFrame:
    return run_log.groupBy("phase").agg(
        F.count("*").alias("n_rows"), F.avg("elapsed_ms").alias("mean_ms"), F.sum("elapsed_ms").alias("total_ms")
    )


def layer_counts(territories: DataFrame) -> DataFrame:
    return territories.groupBy("layer").agg(F.count("*").alias("n"))


def source_coverage(results: DataFrame, covered: DataFrame) -> DataFrame:
    """Mismatches per (type, state) with a flag whether a polygon or ZIP source
    exists.  ``covered``: utility_type, state."""
    known = covered.select("utility_type", "state").distinct().withColumn("has_source", F.lit(True))
    counts = results.where("comparison = 'MISMATCH'").groupBy("utility_type", "state").agg(F.count("*").alias("mismatches"))
    return counts.join(known, ["utility_type", "state"], "left").withColumn("has_source", F.coalesce("has_source", F.lit(False)))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def examples_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return top_n(df, by, [F.col(c) for c in order], n)


def row_range(df: DataFrame, row_id: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows start … start+limit-1 of a table that carries its own row number."""
    out = df.where(F.col(row_id) >= start)
    return out if limit is None else out.where(F.col(row_id) < start + limit)


def wide_result(long: DataFrame, key: str = "address_id", types: list[str] | None = None) -> DataFrame:
    """One row per address with one struct per utility type."""
    types = types or ["electric", "gas", "water", "sewer"]
    record = F.struct(*[c for c in long.columns if c not in (key, "utility_type")])
    return long.groupBy(key).agg(*[F.max(F.when(F.col("utility_type") == t, record)).alias(t) for t in types])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order.  Ranges of the order are numbered side
    by side and shifted by the sizes of the ranges before; only one row per range is summed in one place."""
    width = len(order)
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_o{i}") for i in range(width)]
    ranged = cut_lineage(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*keys)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    out = ranged.withColumn("_nth", F.row_number().over(inside)).join(shift, "_range")
    return out.select(*df.columns, (F.col("_shift") + F.col("_nth")).alias(name))
