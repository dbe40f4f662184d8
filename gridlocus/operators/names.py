"""Provider-name matching.  Every operator works on *distinct* names and is joined
back by the caller, so a name that occurs in a third of all rows is matched once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules, text
from gridlocus.functions.similarity import indel_ratio, sorted_tokens
from gridlocus.operators.blocking import contained_pairs, similar_pairs
from gridlocus.session import cut_lineage

MATCH_COLUMNS = ["canonical_id", "display_name", "matched", "is_rep", "match_type", "similarity", "matched_on"]


def match_name(
    names: DataFrame, aliases: DataFrame, reps: DataFrame | None = None,
    name: str = "name", min_score: float | None = 85.0,
) -> DataFrame:
    """Match single-segment names: reserved, exact alias, fuzzy, longest contained alias.

    ``aliases``: alias_lower (unique), canonical_id, display_name, ordinal.
    ``min_score=None`` leaves the fuzzy step out.
    """
    base = names.select(name).distinct().withColumn("_lookup", F.lower(text.clean_name(name)))
    base = base.withColumn("_kind", P.reserved_kind(F.col("_lookup")))
    if reps is not None:
        known = reps.select(F.col("rep_lower").alias("_lookup")).distinct().withColumn("_rep", F.lit(True))
        base = base.join(known, "_lookup", "left")
    else:
        base = base.withColumn("_rep", F.lit(None).cast("boolean"))
    entry = F.struct("canonical_id", "display_name", F.col("alias_lower").alias("matched_on"))
    exact = aliases.select(F.col("alias_lower").alias("_lookup"), entry.alias("_exact"))
    base = cut_lineage(base.join(exact, "_lookup", "left"))
    open_names = base.where("_kind IS NULL AND _rep IS NULL AND _exact IS NULL").select("_lookup").distinct()

    inside = contained_pairs(
        open_names.where(F.length("_lookup") > 4), aliases, "_lookup", "alias_lower", min_len=4
    ).join(aliases, "alias_lower")
    longest = inside.groupBy("_lookup").agg(
        F.min_by(entry, F.struct(-F.length("alias_lower"), F.col("ordinal"), F.col("alias_lower"))).alias("_inside")
    )
    base = base.join(longest, "_lookup", "left")
    if min_score is not None:
        best = (
            fuzzy_alias_scores(open_names, aliases, min_score)
            .groupBy("_lookup")
            .agg(
                F.min_by(entry, F.struct(-F.col("score"), F.col("ordinal"), F.col("alias_lower"))).alias("_fuzzy"),
                F.max("score").alias("_score"),
            )
        )
        base = base.join(best, "_lookup", "left")
    else:
        base = base.withColumns({"_fuzzy": F.lit(None).cast(
            "struct<canonical_id:string,display_name:string,matched_on:string>"), "_score": F.lit(None).cast("double")})

    free = F.col("_kind").isNull() & F.col("_rep").isNull()
    hit = F.when(free, F.coalesce("_exact", "_fuzzy", "_inside"))
    cleaned = text.clean_name(name)
    return base.select(
        name,
        hit["canonical_id"].alias("canonical_id"),
        F.when(hit.isNotNull(), hit["display_name"])
        .when(F.col("_kind") == "null_value", None)
        .otherwise(cleaned).alias("display_name"),
        hit.isNotNull().alias("matched"),
        (F.col("_kind").isNull() & F.col("_rep").isNotNull()).alias("is_rep"),
        F.when(F.col("_kind").isin("null_value", "propane"), F.col("_kind"))
        .when(hit.isNull(), "none")
        .when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_fuzzy").isNotNull(), "fuzzy")
        .otherwise("substring").alias("match_type"),
        F.when(hit.isNull(), 0.0)
        .when(F.col("_exact").isNotNull(), 100.0)
        .when(F.col("_fuzzy").isNotNull(), F.round("_score", 1))
        .otherwise(0.0).alias("similarity"),
        hit["matched_on"].alias("matched_on"),
    )


def fuzzy_alias_scores(open_names: DataFrame, aliases: DataFrame, min_score: float) -> DataFrame:
    """(lookup, alias, score) for every alias scoring at least ``min_score``: in
    character order, or word order ignored at a 5 % discount."""
    left = open_names.withColumn("_norm", text.normalize_for_fuzzy("_lookup")).where(F.length("_norm") >= 4)
    right = aliases.withColumn("_anorm", text.normalize_for_fuzzy("alias_lower")).where(F.length("_anorm") >= 4)
    straight = similar_pairs(left, right, "_norm", "_anorm", min_score)
    left_sorted = left.withColumn("_ns", sorted_tokens("_norm"))
    right_sorted = right.withColumn("_as", sorted_tokens("_anorm"))
    shuffled = similar_pairs(left_sorted, right_sorted, "_ns", "_as", min_score / 0.95).withColumn(
        "score", 0.95 * F.col("score")
    )
    columns = ["_lookup", "alias_lower", "canonical_id", "display_name", "ordinal", "score"]
    return (
        straight.select(columns).unionByName(shuffled.select(columns))
        .groupBy(columns[:-1]).agg(F.max("score").alias("score"))
    )


def name_segments(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """(name, pos, segment): the whole text when it has no comma or is itself an
    alias, else its non-blank comma parts.  Blank names give no rows."""
    base = names.select(name).distinct().withColumn("_clean", text.clean_name(name)).where("_clean <> ''")
    whole = aliases.select(F.col("alias_lower").alias("_whole"), F.lit(True).alias("_known"))
    base = base.withColumn("_whole", F.when(F.col("_clean").contains(","), F.lower("_clean"))).join(
        whole, "_whole", "left"
    )
    parts = F.filter(F.transform(F.split("_clean", ","), lambda p: F.trim(p)), lambda s: s != "")
    segments = F.when(
        F.col("_whole").isNull() | F.col("_known").isNotNull(), F.array("_clean")
    ).otherwise(parts)
    return base.select(name, F.col("_clean").alias("cleaned"), F.posexplode(segments).alias("pos", "segment"))


def match_name_multi(
    names: DataFrame, aliases: DataFrame, reps: DataFrame | None = None,
    name: str = "name", min_score: float | None = 85.0,
) -> DataFrame:
    """One row per (name, segment) with the match columns."""
    segments = cut_lineage(name_segments(names, aliases, name))
    matches = match_name(segments, aliases, reps, "segment", min_score)
    return segments.join(matches, "segment").select(name, "cleaned", "pos", "segment", *MATCH_COLUMNS)


def resolve_names(
    names: DataFrame, aliases: DataFrame, reps: DataFrame | None = None,
    name: str = "name", min_score: float | None = 85.0,
) -> DataFrame:
    """One row per name: ``normalized`` (first matched segment's display, else the
    cleaned text) and the columns of the best segment."""
    segments = match_name_multi(names, aliases, reps, name, min_score)
    record = F.struct(*MATCH_COLUMNS)
    matched = F.col("matched")
    per_name = segments.groupBy(name).agg(
        F.first("cleaned").alias("cleaned"),
        F.count("*").alias("n_segments"),
        F.min_by(F.col("display_name"), F.when(matched, F.col("pos"))).alias("_first_display"),
        F.min_by(record, F.when(matched, F.struct(-F.col("similarity"), F.col("pos")))).alias("_best"),
        F.min_by(record, F.col("pos")).alias("_head"),
    )
    best = F.coalesce("_best", "_head")
    return per_name.select(
        name,
        F.when(F.col("_first_display").isNotNull(), F.col("_first_display"))
        .when(F.col("n_segments") == 1, F.col("_head.display_name"))
        .otherwise(F.col("cleaned")).alias("normalized"),
        *[best[c].alias(c) for c in MATCH_COLUMNS],
    )


def alias_lookup(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Exact dictionary lookup: canonical id, display, parent company and EIA id."""
    key = F.lower(text.clean_name(name))
    known = aliases.select(
        F.col("alias_lower").alias("_lookup"), "canonical_id", "display_name", "parent_company", "eia_id"
    )
    return names.withColumn("_lookup", key).join(known, "_lookup", "left").drop("_lookup")


def rep_lookup(names: DataFrame, reps: DataFrame, name: str = "name") -> DataFrame:
    known = reps.select(F.col("rep_lower").alias("_lookup"), "rep_name")
    return (
        names.withColumn("_lookup", F.lower(text.clean_name(name))).join(known, "_lookup", "left").drop("_lookup")
        .withColumn("is_rep", F.col("rep_name").isNotNull())
        .withColumn("market", F.when(F.col("is_rep"), "ERCOT"))
    )


def providers_match(display1: Column, display2: Column) -> Column:
    """Both missing, equal, or one inside the other (case folded)."""
    a, b = F.coalesce(display1, F.lit("")), F.coalesce(display2, F.lit(""))
    la, lb = F.lower(a), F.lower(b)
    return F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False).otherwise(
        la.contains(lb) | lb.contains(la)
    )


def parent_table(spark, groups: dict[str, str] | None = None) -> DataFrame:
    """(name_lower, parent, ordinal).  A name listed twice keeps its first place and
    takes the last parent."""
    table: dict[str, str] = {}
    for parent, listed in (groups or rules.PARENT_GROUPS).items():
        for n in listed:
            table[n.lower()] = parent
    rows = [(n, p, i) for i, (n, p) in enumerate(table.items())]
    return spark.createDataFrame(rows, "name_lower string, parent string, ordinal int")


def parent_of(names: DataFrame, parents: DataFrame, name: str = "name") -> DataFrame:
    """(name, parent): exact name, else the first table entry that contains the name
    or is contained in it."""
    base = names.select(name).distinct().withColumn("_lower", F.lower(F.trim(F.col(name)))).where("_lower <> ''")
    exact = cut_lineage(base.join(
        parents.select(F.col("name_lower").alias("_lower"), F.col("parent").alias("_exact")), "_lower", "left"
    ))
    open_names = exact.where("_exact IS NULL").select("_lower").distinct()
    pairs = contained_pairs(open_names, parents, "_lower", "name_lower").unionByName(
        contained_pairs(parents, open_names, "name_lower", "_lower")
    )
    first = (
        pairs.join(parents, "name_lower").groupBy("_lower")
        .agg(F.min_by("parent", "ordinal").alias("_near"))
    )
    return exact.join(first, "_lower", "left").select(
        name, F.coalesce("_exact", "_near").alias("parent")
    )


def rebrand(names: DataFrame, rebrands: DataFrame, name: str = "name", kind: str = "utility_type") -> DataFrame:
    """Adds ``rebranded``: the type-specific alias of the lower-case name, or itself.

    ``rebrands``: utility_type, name_lower, renamed.
    """
    key = F.lower(F.trim(F.col(name)))
    table = rebrands.select(
        F.col("utility_type").alias("_t"), F.col("name_lower").alias("_n"), F.col("renamed").alias("_r")
    )
    joined = names.withColumn("_key", key).join(
        table, (F.col("_key") == F.col("_n")) & (F.col(kind) == F.col("_t")), "left"
    )
    return joined.withColumn("rebranded", F.coalesce("_r", "_key")).drop("_key", "_t", "_n", "_r")


def name_facts(
    names: DataFrame, aliases: DataFrame, reps: DataFrame | None, rebrands: DataFrame,
    parents: DataFrame, name: str = "name", min_score: float | None = 85.0,
) -> DataFrame:
    """Everything pairwise comparison needs, one row per distinct name."""
    base = cut_lineage(names.select(name).where(F.col(name).isNotNull()).distinct())
    base = base.join(resolve_names(base, aliases, reps, name, min_score), name, "left")
    base = base.join(parent_of(base, parents, name), name, "left")
    base = base.withColumn("lower", F.lower(F.trim(F.col(name))))
    base = base.withColumn("core", text.name_core(F.col("lower")))
    base = base.withColumn("water_norm", F.lower(text.normalize_water_name(name)))
    lookups = [("electric", "lower", "electric_alias"), ("gas", "lower", "gas_alias"),
               ("water", "lower", "water_alias"), ("water", "water_norm", "water_norm_alias")]
    for kind, source, out in lookups:
        table = rebrands.where(F.col("utility_type") == kind).select(
            F.col("name_lower").alias(source), F.col("renamed").alias("_r")
        )
        base = base.join(table, source, "left").withColumn(out, F.coalesce("_r", source)).drop("_r")
    words = F.array_distinct(F.filter(F.split("water_norm", " "), lambda w: w != ""))
    generic = F.array(*[F.lit(w) for w in rules.WATER_GENERIC_WORDS])
    base = base.withColumn("water_core", F.array_except(words, generic))
    return base.select(
        name,
        F.struct("lower", "core", "normalized", "canonical_id", "parent", "electric_alias", "gas_alias",
                 "water_alias", "water_norm", "water_norm_alias", "water_core").alias("facts"),
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (a.contains(b) | b.contains(a))


def names_match(a: Column, b: Column) -> Column:
    """Same entity, from two ``facts`` structs."""
    present = (F.length(a["lower"]) > 0) & (F.length(b["lower"]) > 0)
    hit = (
        (a["lower"] == b["lower"])
        | _overlaps(a["lower"], b["lower"])
        | _overlaps(a["core"], b["core"])
        | F.coalesce(a["canonical_id"] == b["canonical_id"], F.lit(False))
        | (
            providers_match(a["normalized"], b["normalized"])
            & (F.length(F.coalesce(a["normalized"], F.lit(""))) > 0)
        )
    )
    return F.coalesce(present & hit, F.lit(False))


def water_names_match(a: Column, b: Column) -> Column:
    present = (F.length(a["lower"]) > 0) & (F.length(b["lower"]) > 0)
    usable = (F.length(a["water_norm"]) > 0) & (F.length(b["water_norm"]) > 0)
    shared = F.size(F.array_intersect(a["water_core"], b["water_core"]))
    fewest = F.least(F.size(a["water_core"]), F.size(b["water_core"]))
    hit = (a["water_alias"] == b["water_alias"]) | (
        usable
        & (
            (a["water_norm_alias"] == b["water_norm_alias"])
            | (a["water_norm"] == b["water_norm"])
            | _overlaps(a["water_norm"], b["water_norm"])
            | ((fewest > 0) & (shared >= fewest))
        )
    )
    return F.coalesce(present & hit, F.lit(False))


def canonical_states(dictionary: DataFrame) -> DataFrame:
    """(canonical_id, states): state codes standing as words in the id, the display
    name or an alias.  ``dictionary``: canonical_id, display_name, alias."""
    words = F.concat_ws(" ", "canonical_id", "display_name", "alias")
    return (
        dictionary.select("canonical_id", F.explode(text.states_in_text(words)).alias("state"))
        .groupBy("canonical_id").agg(F.array_sort(F.collect_set("state")).alias("states"))
    )


def registry_crossref(
    registry: DataFrame, aliases: DataFrame, reps: DataFrame | None = None, min_score: float | None = 85.0
) -> DataFrame:
    """Registry entities against the dictionary: first name variant that is an alias,
    else first variant with an exact or fuzzy match; unmatched rows keep NULLs.

    ``registry``: eia_id, names ARRAY<STRING>.
    """
    variants = registry.select("eia_id", F.posexplode("names").alias("pos", "name"))
    direct = variants.withColumn("alias_lower", F.lower(F.trim("name"))).join(
        aliases.select("alias_lower", "canonical_id"), "alias_lower"
    )
    record = F.struct("canonical_id", F.col("name").alias("matched_name"))
    direct = direct.groupBy("eia_id").agg(F.min_by(record, "pos").alias("_direct"))
    open_variants = variants.join(direct, "eia_id", "left_anti")
    scored = open_variants.join(
        resolve_names(open_variants, aliases, reps, "name", min_score)
        .where("matched AND match_type IN ('exact', 'fuzzy')"), "name"
    ).groupBy("eia_id").agg(F.min_by(record, "pos").alias("_scored"))
    hit = F.coalesce("_direct", "_scored")
    return (
        registry.join(direct, "eia_id", "left").join(scored, "eia_id", "left")
        .select("eia_id", "names", hit["canonical_id"].alias("canonical_id"),
                hit["matched_name"].alias("matched_name"), hit.isNotNull().alias("matched"))
    )


def pair_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the four similarity scores; distinct pairs are scored once."""
    from gridlocus.functions.similarity import fuzzy_score, token_set_ratio, token_sort_ratio

    scored = pairs.select(a, b).distinct().withColumns({
        "indel": indel_ratio(a, b), "token_sort": token_sort_ratio(a, b),
        "token_set": token_set_ratio(a, b), "fuzzy": fuzzy_score(a, b),
    })
    return pairs.join(scored, [a, b])
