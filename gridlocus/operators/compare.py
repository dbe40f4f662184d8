"""Engine answers against reported truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules
from gridlocus.operators.catalog import catalog_alias
from gridlocus.operators.names import match_name_multi, name_facts, names_match, water_names_match
from gridlocus.session import cut_lineage

CORRECT = ["MATCH", "MATCH_TDU", "MATCH_PARENT"]
SCOREABLE = [*CORRECT, "MISMATCH"]

CASE = ["engine_provider", "tenant_raw", "utility_type", "state", "alternatives"]


def compare_providers(
    rows: DataFrame, aliases: DataFrame, reps: DataFrame | None, rebrands: DataFrame,
    parents: DataFrame, min_score: float | None = 85.0,
) -> DataFrame:
    """Adds comparison, match_detail and tenant_normalized.

    ``rows``: engine_provider, tenant_raw, utility_type, state, alternatives
    ARRAY<STRUCT<provider, …>>.  The verdict depends on those five only, so it is
    worked out once per distinct case and joined back; cases that need no name
    matching are decided without a join.
    """
    engine, tenant = F.nullif(F.trim("engine_provider"), F.lit("")), F.trim(F.coalesce("tenant_raw", F.lit("")))
    null_tenant = P.is_null_value(tenant)
    propane = (F.col("utility_type") == "gas") & P.is_propane(tenant)
    early = (
        F.when(null_tenant, F.when(engine.isNull(), "BOTH_EMPTY").otherwise("ENGINE_ONLY"))
        .when(propane, "TENANT_PROPANE")
        .when(engine.isNull(), "TENANT_ONLY")
    )
    alt_names = F.filter(
        F.transform("alternatives", lambda a: a["provider"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    case = F.struct(
        F.coalesce(engine, F.lit("")).alias("engine"), tenant.alias("tenant"), F.col("utility_type").alias("utility_type"),
        F.upper(F.coalesce("state", F.lit(""))).alias("state"),
        F.coalesce(alt_names, F.array().cast("array<string>")).alias("alts"),
    )
    df = rows.withColumn("_early", early).withColumn("_case", F.when(F.col("_early").isNull(), F.md5(F.to_json(case))))
    cases = cut_lineage(
        df.where("_early IS NULL").select(case.alias("c"), F.col("_case").alias("case_id")).dropDuplicates(["case_id"])
        .select("case_id", "c.*")
    )
    verdicts = _judge(cases, aliases, reps, rebrands, parents, min_score)
    joined = df.join(verdicts.withColumnRenamed("case_id", "_case"), "_case", "left")
    return joined.withColumns({
        "comparison": F.coalesce("_early", "_v.comparison"),
        "match_detail": F.when(F.col("_early") == "TENANT_PROPANE", F.concat(F.lit("propane="), tenant))
        .when(F.col("_early") == "TENANT_ONLY", "no_polygon_hit").otherwise(F.coalesce("_v.detail", F.lit(""))),
        "tenant_normalized": F.when(F.col("_early") == "TENANT_ONLY", tenant).otherwise(F.coalesce("_v.tenant_normalized", F.lit(""))),
    }).drop("_early", "_case", "_v")


def _judge(cases, aliases, reps, rebrands, parents, min_score) -> DataFrame:
    segments = match_name_multi(cases.select(F.col("tenant").alias("name")), aliases, reps, "name", min_score)
    segs = cut_lineage(segments.select(F.col("name").alias("tenant"), "pos", F.trim("segment").alias("segment"),
                                       F.coalesce("display_name", F.lit("")).alias("display")))
    others = cases.select("case_id", F.posexplode("alts").alias("alt_pos", "candidate"))
    sides = cases.select("case_id", F.lit(-1).alias("alt_pos"), F.col("engine").alias("candidate")).unionByName(others)
    pairs = sides.join(cases.select("case_id", "tenant", "utility_type"), "case_id").join(segs, "tenant")
    distinct = cut_lineage(pairs.select("candidate", "segment", "display", "utility_type").distinct())
    used = (
        distinct.select(F.col("candidate").alias("name")).unionByName(distinct.select(F.col("segment").alias("name")))
        .unionByName(distinct.select(F.col("display").alias("name"))).distinct()
    )
    facts = cut_lineage(name_facts(used, aliases, reps, rebrands, parents, "name", min_score))

    def with_facts(df, column, out):
        return df.join(facts.select(F.col("name").alias(column), F.col("facts").alias(out)), column)

    p = with_facts(with_facts(with_facts(distinct, "candidate", "a"), "segment", "s"), "display", "d")
    a, s, d = F.col("a"), F.col("s"), F.col("d")
    shown = F.col("display") != F.col("segment")
    kind = F.col("utility_type")
    hit = names_match(a, s) | (shown & names_match(a, d))
    water = (kind == "water") & (water_names_match(a, s) | (shown & water_names_match(a, d)))

    def same(field):
        return F.coalesce(a[field] == s[field], F.lit(False)) | (shown & F.coalesce(a[field] == d[field], F.lit(False)))

    renamed = ((kind == "electric") & same("electric_alias")) | ((kind == "gas") & same("gas_alias"))
    parent = F.coalesce((a["parent"] == s["parent"]) | (a["parent"] == d["parent"]), F.lit(False))
    p = p.select("candidate", "segment", "display", "utility_type", hit.alias("hit"), water.alias("water"),
                 renamed.alias("renamed"), parent.alias("parent"), a["parent"].alias("parent_name"))
    flags = pairs.join(p, ["candidate", "segment", "display", "utility_type"]).groupBy("case_id").agg(
        F.bool_or((F.col("alt_pos") == -1) & (F.col("hit") | F.col("water") | F.col("renamed"))).alias("match"),
        F.bool_or((F.col("alt_pos") == -1) & F.col("parent")).alias("parent"),
        F.max(F.when((F.col("alt_pos") == -1) & F.col("parent"), F.col("parent_name"))).alias("parent_name"),
        F.min_by(F.col("candidate"), F.when((F.col("alt_pos") >= 0) & (F.col("hit") | F.col("water")), F.col("alt_pos"))).alias("alt"),
    )
    listed = segs.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("l")).select(
        "tenant", F.array_join(F.transform("l", lambda x: x["segment"]), " | ").alias("tenant_norm")
    )
    df = cases.join(listed, "tenant", "left").join(flags, "case_id", "left").withColumn("tenant_norm", F.coalesce("tenant_norm", F.lit("")))
    return df.select("case_id", _verdict().alias("_v"))


def _verdict() -> Column:
    engine, state, kind, tn = (F.col(c) for c in ("engine", "state", "utility_type", "tenant_norm"))
    el, tl = F.lower(F.trim(engine)), F.lower(F.trim(tn))
    ldc = lambda c: P.contains_any(c, rules.GA_GAS_DISTRIBUTORS)
    marketer = lambda c: P.contains_any(c, rules.GA_GAS_MARKETERS)

    def out(category, detail):
        return F.struct(F.lit(category).alias("comparison"), detail.alias("detail"), tn.alias("tenant_normalized"))

    def note(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(yes("match"), out("MATCH", F.lit("")))
        .when((state == "TX") & (kind == "electric") & P.is_tdu(engine) & (tn != ""), out("MATCH_TDU", note("tdu=", engine, ", rep=", tn)))
        .when((state == "GA") & (kind == "gas") & ((ldc(el) & marketer(tl)) | (marketer(el) & ldc(tl))),
              out("MATCH_TDU", note("ga_gas_deregulated: ldc=", engine, ", marketer=", tn)))
        .when(yes("parent"), out("MATCH_PARENT", note("parent=", F.col("parent_name"))))
        .when(F.col("alt").isNotNull(), out("MATCH_ALT", note("alt=", F.col("alt"), ", primary=", engine)))
        .when(P.cross_state_override(engine, state), out("MISMATCH", note("cross_state_override: engine=", engine, " wrong for ", state)))
        .when((kind == "electric") & F.lower(engine).isin(rules.GAS_ONLY_NAMES), out("MISMATCH", note("gas_provider_in_electric: engine=", engine)))
        .when((kind == "gas") & P.contains_any(F.lower(tn), rules.ELECTRIC_WORDS_IN_GAS), out("MATCH", note("tenant_electric_in_gas: tenant=", tn)))
        .otherwise(out("MISMATCH", note("engine=", engine, " vs tenant=", tn)))
    )


def with_geocode_failure(compared: DataFrame) -> DataFrame:
    """Rows without coordinates and without an answer are not the engine's fault."""
    failed = (F.col("lat") == 0) & (F.col("lon") == 0) & F.col("engine_provider").isNull()
    reported = ~P.is_null_value("tenant_raw")
    return compared.withColumns({
        "comparison": F.when(failed, F.when(reported, "TENANT_ONLY").otherwise("BOTH_EMPTY")).otherwise(F.col("comparison")),
        "match_detail": F.when(failed, F.when(reported, "geocode_failed").otherwise("")).otherwise(F.col("match_detail")),
        "tenant_normalized": F.when(failed, F.when(reported, F.trim("tenant_raw")).otherwise("")).otherwise(F.col("tenant_normalized")),
    })


def id_match_bucket(rows: DataFrame, alias_table: DataFrame | None = None) -> DataFrame:
    """Adds ``id_match`` from the two catalog ids, each resolved through the aliases."""
    df = rows
    if alias_table is not None:
        df = catalog_alias(df, alias_table, "engine_catalog_id", "_e")
        df = catalog_alias(df, alias_table, "tenant_catalog_id", "_t")
    else:
        df = df.withColumns({"_e": F.col("engine_catalog_id").cast("string"), "_t": F.col("tenant_catalog_id").cast("string")})
    e, t, c = F.col("_e"), F.col("_t"), F.col("comparison")
    bucket = (
        F.when(e.isNotNull() & t.isNotNull(),
               F.when(e == t, "ID_MATCH").when(c == "MATCH_TDU", "ID_MATCH_TDU")
               .when(c.isin("MATCH", "MATCH_PARENT", "MATCH_ALT"), "NAME_MATCH_ID_MISMATCH").otherwise("TRUE_MISMATCH"))
        .when(e.isNotNull(), "TENANT_ID_MISSING").when(t.isNotNull(), "ENGINE_ID_MISSING").otherwise("BOTH_ID_MISSING")
    )
    return df.withColumn("id_match", bucket).drop("_e", "_t")


# ---- accuracy ----------------------------------------------------------------
def _n(condition: Column) -> Column:
    return F.count_if(condition)


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def accuracy(results: DataFrame, by: list[str], correct: list[str] = CORRECT, scoreable: list[str] = SCOREABLE) -> DataFrame:
    c = F.col("comparison")
    return results.groupBy(*by).agg(_n(c.isin(scoreable)).alias("scoreable"), _n(c.isin(correct)).alias("correct")).withColumn(
        "accuracy_pct", pct(F.col("correct"), F.col("scoreable"))
    )


def id_accuracy(results: DataFrame) -> DataFrame:
    """Per type and overall (utility_type NULL): id accuracy, plain and counting
    duplicate catalog entries as right."""
    c = F.col("id_match")
    right = ["ID_MATCH", "ID_MATCH_TDU"]
    return results.rollup("utility_type").agg(
        _n(c.isin(*right, "NAME_MATCH_ID_MISMATCH", "TRUE_MISMATCH")).alias("scoreable"),
        _n(c.isin(right)).alias("correct"),
        _n(c.isin(*right, "NAME_MATCH_ID_MISMATCH")).alias("adjusted_correct"),
    ).withColumns({
        "accuracy_pct": pct(F.col("correct"), F.col("scoreable")),
        "adjusted_pct": pct(F.col("adjusted_correct"), F.col("scoreable")),
    })


def review_rate(results: DataFrame) -> DataFrame:
    """Share flagged for review, and accuracy over what was not flagged."""
    c, flagged = F.col("comparison"), F.coalesce("engine_needs_review", F.lit(False))
    answered = F.col("engine_provider").isNotNull()
    return results.groupBy("utility_type").agg(
        _n(answered).alias("answered"), _n(answered & flagged).alias("flagged"),
        _n(c.isin(SCOREABLE) & ~flagged).alias("confident_scoreable"), _n(c.isin(CORRECT) & ~flagged).alias("confident_correct"),
    ).withColumns({
        "review_pct": pct(F.col("flagged"), F.col("answered")),
        "confident_pct": pct(F.col("confident_correct"), F.col("confident_scoreable")),
    })


def confidence_calibration(results: DataFrame, step: float = 0.05) -> DataFrame:
    """Observed accuracy per confidence level."""
    level = F.floor(F.round(F.col("engine_confidence") / step, 6)).cast("int")
    c = F.col("comparison")
    return (
        results.where(c.isin(SCOREABLE) & F.col("engine_confidence").isNotNull()).groupBy(level.alias("level"))
        .agg(F.count("*").alias("n"), _n(c.isin(CORRECT)).alias("correct"), F.avg("engine_confidence").alias("mean_confidence"))
        .withColumns({"from_confidence": F.round(F.col("level") * step, 2), "accuracy_pct": pct(F.col("correct"), F.col("n"))})
    )


def accuracy_change(before: DataFrame, after: DataFrame, count_alternatives: bool = True) -> DataFrame:
    """Accuracy per type before and after; a match on an alternative counts as right."""
    extra = ["MATCH_ALT"] if count_alternatives else []
    correct, scoreable = [*CORRECT, *extra], [*SCOREABLE, *extra]

    def side(df, tag):
        a = accuracy(df, ["utility_type"], correct, scoreable)
        return a.select("utility_type", *[F.col(c).alias(f"{tag}_{c}") for c in ("scoreable", "correct", "accuracy_pct")])

    return side(before, "old").join(side(after, "new"), "utility_type", "full").withColumn(
        "delta_pp", F.coalesce("new_accuracy_pct", F.lit(0.0)) - F.coalesce("old_accuracy_pct", F.lit(0.0))
    )


def recompare(stored: DataFrame, aliases, reps, rebrands, parents, min_score: float | None = 85.0) -> tuple[DataFrame, DataFrame]:
    """Stored results compared again: (new rows, accuracy change per type)."""
    fresh = compare_providers(
        stored.drop("comparison", "match_detail", "tenant_normalized"), aliases, reps, rebrands, parents, min_score
    )
    return fresh, accuracy_change(stored, fresh)
