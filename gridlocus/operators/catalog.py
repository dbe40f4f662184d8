"""Provider names to catalog ids, and catalog-id aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import rules, text
from gridlocus.functions.similarity import sorted_tokens, token_set_ratio
from gridlocus.operators.blocking import similar_pairs, token_cover_candidates
from gridlocus.session import cut_lineage


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Adds the matching form.  ``catalog``: catalog_id, type_id, title, ordinal, …"""
    return catalog.withColumn("norm", text.normalize_catalog_title("title")).withColumn(
        "sorted_norm", sorted_tokens("norm")
    )


def type_id_of(utility_type):
    table = F.create_map(*[F.lit(x) for pair in rules.CATALOG_TYPE_IDS.items() for x in pair])
    return F.try_element_at(table, utility_type)


def match_catalog(
    names: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True
) -> DataFrame:
    """Best catalog entry per distinct (name, utility_type, state).

    Stages, first hit wins: override, exact form, same-state title (>= 70), word
    order ignored (>= 82), shared words (>= 90).  ``catalog`` is prepared.
    ``overrides``: norm_name, utility_type, catalog_id.
    """
    keys = ["name", "utility_type", "state"]
    base = (
        names.select("name", "utility_type", F.coalesce("state", F.lit("")).alias("state"))
        .where("name IS NOT NULL AND name <> ''").distinct()
        .withColumn("type_id", type_id_of(F.col("utility_type")))
        .withColumn("norm", text.normalize_catalog_title("name"))
        .withColumn("sorted_norm", sorted_tokens("norm"))
    )
    entry = F.struct("catalog_id", "title")
    exact = catalog.groupBy("type_id", "norm").agg(F.min_by(entry, "ordinal").alias("_exact"))
    base = base.join(exact, ["type_id", "norm"], "left")
    if overrides is not None:
        forced = overrides.join(catalog.select("catalog_id", "title"), "catalog_id").groupBy(
            F.col("norm_name").alias("norm"), "utility_type"
        ).agg(F.min_by(entry, "catalog_id").alias("_forced"))
        base = base.join(forced, ["norm", "utility_type"], "left")
    else:
        base = base.withColumn("_forced", F.when(F.lit(False), F.col("_exact")))

    def hit(column: str, method: str):
        return F.when(F.col(column).isNotNull(), F.struct(
            F.lit(100.0).alias("score"), F.lit(method).alias("method"), F.col(column).alias("entry")))

    base = cut_lineage(base.withColumn("_hit", F.coalesce(hit("_forced", "override"), hit("_exact", "exact"))))
    if fuzzy:
        form = ["type_id", "state", "sorted_norm", "norm"]
        open_forms = base.where("_hit IS NULL AND type_id IS NOT NULL").select(*form).distinct()
        right = catalog.select("type_id", "catalog_id", "title", "ordinal", F.col("norm").alias("cnorm"),
                               F.col("sorted_norm").alias("csorted"))
        by_state = right.select(
            "*", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("title"), F.lit("[A-Z]+"), F.lit(0)))).alias("state_word")
        ).where(F.length("state_word") == 2)
        in_state = similar_pairs(
            open_forms.where("state <> ''").withColumn("state_word", F.upper("state")),
            by_state, "sorted_norm", "csorted", 70.0, on=["type_id", "state_word"],
        ).select(*form, F.lit(2).alias("stage"), "score", "ordinal", entry.alias("entry"))
        any_state = similar_pairs(open_forms, right, "sorted_norm", "csorted", 82.0, on=["type_id"]).select(
            *form, F.lit(3).alias("stage"), "score", "ordinal", entry.alias("entry")
        )
        sorted_hits = cut_lineage(in_state.unionByName(any_state))
        rest = open_forms.join(sorted_hits.select(*form).distinct(), form, "left_anti")
        shared = _token_set_hits(rest, right, form, entry)
        ranked = (
            sorted_hits.unionByName(shared).groupBy(*form)
            .agg(F.min_by(F.struct("stage", "score", "entry"), F.struct("stage", -F.col("score"), "ordinal")).alias("_s"))
        )
        base = base.join(ranked, form, "left")
        s = F.col("_s")
        method = F.element_at(F.array(F.lit("state_specific"), F.lit("fuzzy"), F.lit("fuzzy_set")), s["stage"] - 1)
        score = F.when(s["stage"] == 2, s["score"]).otherwise(F.floor(s["score"]).cast("double"))
        base = base.withColumn("_hit", F.coalesce(
            "_hit", F.when(s.isNotNull(), F.struct(score.alias("score"), method.alias("method"), s["entry"].alias("entry")))
        ))
    return base.select(
        *keys,
        F.col("_hit.entry.catalog_id").alias("catalog_id"),
        F.col("_hit.entry.title").alias("catalog_title"),
        F.col("_hit.score").alias("id_match_score"),
        F.col("_hit.method").alias("id_match_method"),
        (F.col("_hit.score") >= 85).alias("id_confident"),
    )


def _token_set_hits(forms: DataFrame, right: DataFrame, form: list[str], entry) -> DataFrame:
    """Shared-word ratio >= 90.  One of three things must hold: the shared words make
    up 9/11 of one side, or of the other, or both whole texts share 90 % of their
    characters whatever the order."""
    on = ["type_id"]
    spread = lambda c: F.array_join(F.array_sort(F.split(F.col(c), "")), "")
    left = forms.select("type_id", "norm").distinct().withColumn("_chars", spread("norm"))
    texts = right.select("type_id", "cnorm").distinct().withColumn("_cchars", spread("cnorm"))
    cover = 9 / 11
    near = similar_pairs(left, texts, "_chars", "_cchars", 90.0, on).select("type_id", "norm", "cnorm")
    pairs = reduce(
        DataFrame.unionByName,
        [
            token_cover_candidates(left, texts, "norm", "cnorm", cover, on),
            token_cover_candidates(texts, left, "cnorm", "norm", cover, on).select("type_id", "norm", "cnorm"),
            near,
        ],
    ).distinct()
    scored = pairs.withColumn("score", token_set_ratio("norm", "cnorm")).where("score >= 90")
    return (
        scored.join(right, ["type_id", "cnorm"]).join(forms, ["type_id", "norm"])
        .select(*form, F.lit(4).alias("stage"), "score", "ordinal", entry.alias("entry"))
    )


def attach_catalog_ids(
    rows: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True
) -> DataFrame:
    """Catalog columns for a provider column and every entry of ``alternatives``.

    ``rows``: row_id, utility_type, state, provider, alternatives ARRAY<STRUCT<provider, …>>.
    """
    rows = rows.withColumn("state", F.coalesce("state", F.lit("")))
    alts = rows.select("row_id", "utility_type", "state", F.posexplode("alternatives").alias("pos", "alt"))
    used = rows.select(F.col("provider").alias("name"), "utility_type", "state").unionByName(
        alts.select(F.col("alt.provider").alias("name"), "utility_type", "state")
    )
    ids = match_catalog(used, catalog, overrides, fuzzy)
    keyed = ids.withColumnRenamed("name", "provider")
    fields = [F.col(f"alt.{f.name}") for f in rows.schema["alternatives"].dataType.elementType
              if f.name not in ("catalog_id", "catalog_title")]
    alt_ids = alts.withColumn("provider", F.col("alt.provider")).join(
        keyed, ["provider", "utility_type", "state"], "left"
    )
    given = rows.schema["alternatives"].dataType.elementType
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in given if f.name not in ("catalog_id", "catalog_title")]
    empty += [F.lit(None).cast(ids.schema[c].dataType).alias(c) for c in ("catalog_id", "catalog_title")]
    grouped = alt_ids.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields, "catalog_id", "catalog_title").alias("alt")))).alias("_alts")
    )
    return (
        rows.drop("alternatives")
        .join(keyed, ["provider", "utility_type", "state"], "left")
        .join(grouped, "row_id", "left")
        .withColumn("alternatives", F.transform("_alts", lambda a: a["alt"]))
        .withColumn("alternatives", F.coalesce("alternatives", F.filter(F.array(F.struct(*empty)), lambda a: F.lit(False))))
        .drop("_alts")
    )


def catalog_overrides(id_corrections: DataFrame) -> DataFrame:
    """Reviewer id corrections keyed by the matching form of the provider name."""
    return id_corrections.select(
        text.normalize_catalog_title("engine_provider_name").alias("norm_name"),
        "utility_type", F.col("correct_catalog_id").alias("catalog_id"),
    ).dropDuplicates(["norm_name", "utility_type", "catalog_id"])


def catalog_alias(rows: DataFrame, alias_table: DataFrame, column: str, out: str) -> DataFrame:
    """Single hop through (alias_id, canonical_id); an id without an entry stays."""
    table = alias_table.select(F.col("alias_id").alias("_a"), F.col("canonical_id").alias("_c"))
    return (
        rows.join(table, F.col(column).cast("string") == F.col("_a"), "left")
        .withColumn(out, F.coalesce("_c", F.col(column).cast("string"))).drop("_a", "_c")
    )


def close_catalog_aliases(alias_table: DataFrame) -> DataFrame:
    """Every alias pointed at the end of its chain.  Each round doubles the number of
    hops taken, so a chain of length n needs log2(n) rounds.  Aliases that lead into a
    cycle are pointed at the smallest id of the cycle."""
    table = cut_lineage(alias_table.select("alias_id", "canonical_id", F.least("alias_id", "canonical_id").alias("low")))
    n, hops = table.count(), 1
    while hops <= 2 * n:
        step = table.select(F.col("alias_id").alias("_a"), F.col("canonical_id").alias("_next"), F.col("low").alias("_low"))
        moved = cut_lineage(
            table.join(step, F.col("canonical_id") == F.col("_a"), "left")
            .select("alias_id", F.coalesce("_next", "canonical_id").alias("canonical_id"), F.least("low", "_low").alias("low"), F.col("_next").isNotNull().alias("_moved"))
        )
        table, hops = moved.drop("_moved"), 2 * hops
        if moved.where("_moved").isEmpty():
            return table.select("alias_id", "canonical_id")
    # More hops than aliases: a target that is still an alias lies on a cycle, and its own hops went all round it.
    around = table.select(F.col("alias_id").alias("_a"), F.col("low").alias("_low"))
    return table.join(around, F.col("canonical_id") == F.col("_a"), "left").select("alias_id", F.coalesce("_low", "canonical_id").alias("canonical_id"))
