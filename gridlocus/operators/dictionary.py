"""Provider dictionary: merging name sources, edits, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules, text
from gridlocus.session import cut_lineage, shuffled


def _holding_keys() -> list[str]:
    import re

    return [" ".join(re.sub(r"[^\w\s]", "", n).split()) for n in rules.HOLDING_NAMES_DICTIONARY]


def name_edges(sources: DataFrame) -> DataFrame:
    """(source, canonical, canonical_key, alias, alias_key): the canonical itself and
    every alias that is not a holding company.  ``sources``: source, canonical, alias."""
    canonical = text.clean_alias("canonical")
    own = sources.select("source", canonical.alias("canonical")).distinct().withColumn("alias", F.col("canonical"))
    listed = sources.where("alias IS NOT NULL").select("source", canonical.alias("canonical"), text.clean_alias("alias").alias("alias"))
    df = own.withColumn("own", F.lit(True)).unionByName(listed.withColumn("own", F.lit(False)))
    df = df.withColumns({"canonical_key": text.norm_key("canonical"), "alias_key": text.norm_key("alias")})
    return df.where((F.col("alias_key") != "") & (F.col("own") | ~F.col("alias_key").isin(_holding_keys()))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of the component.

    Each round takes the smallest label among a node's neighbours and then jumps to
    that label's own label, so a chain of n needs about log n rounds.  Minima are
    combined map-side; a node with very many edges is a skewed join key that AQE
    splits, since the label side holds one row per node.
    """
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t")
    both = cut_lineage(both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
    nodes = edges.select(F.explode(F.array(F.col(a), F.col(b))).alias("node")).distinct()
    labels = cut_lineage(nodes.withColumn("label", F.col("node")))
    while True:  # labels only fall, and a round in which none falls is the last
        near = both.join(shuffled(labels.select(F.col("node").alias("t"), "label")), "t").groupBy("s").agg(F.min("label").alias("near"))
        hooked = labels.join(shuffled(near), labels["node"] == near["s"], "left").select("node", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        step = cut_lineage(
            hooked.join(shuffled(target), "low", "left").select(
                "node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved"))
        )
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return labels.withColumnRenamed("label", "component")


def merge_groups(edges: DataFrame) -> DataFrame:
    """(alias_key, component): groups that share any key are one group."""
    return connected_components(edges, "canonical_key", "alias_key").withColumnRenamed("node", "alias_key")


def name_groups(edges: DataFrame, groups: DataFrame, brand_source: str = "brand_resolver", preferred_source: str = "provider_normalizer") -> DataFrame:
    """(component, canonical): a brand name of the group, else a name of the
    preferred source, else the best display text among its canonical names."""
    own = edges.where("own").select("source", "canonical", F.col("canonical_key").alias("alias_key")).join(shuffled(groups), "alias_key")
    fixed = text.fix_casing("canonical")
    place = F.when(F.col("source") == brand_source, 0).when(F.col("source") == preferred_source, 1).otherwise(2)
    tie = F.when(F.col("source").isin(brand_source, preferred_source), F.struct(F.lit(False).alias("shout"), F.lit(0).alias("short"), fixed.alias("name"))).otherwise(text.display_preference(fixed))
    return own.groupBy("component").agg(F.min_by(fixed, F.struct(place.alias("place"), tie.alias("tie"))).alias("canonical"))


def key_texts(edges: DataFrame) -> DataFrame:
    """(alias_key, alias_text): best display text seen for a key."""
    fixed = text.fix_casing("alias")
    return edges.groupBy("alias_key").agg(F.min_by(fixed, text.display_preference(fixed)).alias("alias_text"))


def attach_auto_aliases(auto: DataFrame, keyed: DataFrame) -> DataFrame:
    """Placement of a noisy source's names beside groups that are there already.

    ``auto``: key, alias (compound names are ignored, dissimilar aliases dropped).
    ``keyed``: alias_key, canonical - keys already placed; their groups are neither
    recomputed nor joined.  Only keys without a place are grouped: an entry's key and
    its aliases belong together, so new keys that share an alias are one group, through
    any number of entries.  Such a group goes to the group of a placed key whose entry
    lists one of its names, else to the group of a placed name that one of its entries
    lists, else it is new and takes the first of its entries' keys by name; among
    several the first canonical by name.  Result: alias_key, canonical, placement
    (existing | via_alias | new), one row per key without a place.
    """
    clean = auto.select(text.clean_alias("key").alias("key"), text.clean_alias("alias").alias("alias")).where("key <> '' AND alias <> ''")
    clean = clean.where(~P.is_compound_key("key") & ~P.is_compound_key("alias"))
    clean = clean.withColumns({"kk": text.norm_key("key"), "ak": text.norm_key("alias")}).where("kk <> ''")
    place = lambda column, out: shuffled(keyed.select(F.col("alias_key").alias(column), F.col("canonical").alias(out)))
    links = clean.where(P.names_are_similar(F.col("kk"), F.col("ak"))).select("kk", "ak").distinct()
    links = cut_lineage(links.join(place("kk", "by_key"), "kk", "left").join(place("ak", "by_alias"), "ak", "left"))
    keys = cut_lineage(clean.groupBy("kk").agg(F.min(text.fix_casing("key")).alias("name")).join(shuffled(keyed.select(F.col("alias_key").alias("kk"))), "kk", "left_anti"))

    alone = keys.select(F.col("kk").alias("a"), F.col("kk").alias("b")).unionByName(
        links.where("by_key IS NOT NULL AND by_alias IS NULL").select(F.col("ak").alias("a"), F.col("ak").alias("b")))
    both = links.where("by_key IS NULL AND by_alias IS NULL").select(F.col("kk").alias("a"), F.col("ak").alias("b"))
    groups = cut_lineage(connected_components(both.unionByName(alone).distinct()))

    anchors = links.where("by_key IS NOT NULL AND by_alias IS NULL").select(F.col("ak").alias("node"), F.lit(0).alias("place"), F.col("by_key").alias("canonical")).unionByName(
        links.where("by_key IS NULL AND by_alias IS NOT NULL").select(F.col("kk").alias("node"), F.lit(1).alias("place"), F.col("by_alias").alias("canonical"))).unionByName(
        keys.select(F.col("kk").alias("node"), F.lit(2).alias("place"), F.col("name").alias("canonical")))
    target = anchors.join(shuffled(groups), "node").groupBy("component").agg(F.min(F.struct("place", "canonical")).alias("t"))
    kind = F.element_at(F.array(F.lit("existing"), F.lit("via_alias"), F.lit("new")), F.col("t.place") + 1)
    return groups.join(shuffled(target), "component").select(F.col("node").alias("alias_key"), F.col("t.canonical").alias("canonical"), kind.alias("placement"))


def _valid_display(candidate, canonical):
    c, n = F.lower(candidate), F.lower(canonical)
    # fixed values: a holding name, or its stem when longer than five characters
    stems = [s for s in (h.replace(" group", "").replace(" corp", "").replace(" corporation", "") for h in rules.HOLDING_NAMES_DICTIONARY) if len(s) > 5]
    return ~P.contains_any(c, rules.HOLDING_NAMES_DICTIONARY + stems) & ~((F.length(candidate) < F.length(canonical)) & n.contains(c))


def choose_display(groups: DataFrame, brands: DataFrame) -> DataFrame:
    """(canonical, display_name).  ``groups``: canonical, alias_text; ``brands``:
    legal_lower, brand.  A brand of the canonical decides alone, even when it is not
    usable; otherwise the first usable brand of an alias."""
    brand = brands.select("legal_lower", text.fix_casing("brand").alias("brand"))
    own = groups.select("canonical").distinct().join(shuffled(brand), F.lower("canonical") == F.col("legal_lower"), "left").select("canonical", F.col("brand").alias("own_brand"))
    other = groups.join(shuffled(brand), F.lower("alias_text") == F.col("legal_lower")).where(_valid_display(F.col("brand"), F.col("canonical"))).groupBy("canonical").agg(
        F.min_by("brand", "alias_text").alias("alias_brand"))
    usable = _valid_display(F.col("own_brand"), F.col("canonical"))
    return own.join(shuffled(other), "canonical", "left").select(
        "canonical",
        F.when(F.col("own_brand").isNotNull(), F.when(usable, F.col("own_brand")).otherwise(F.col("canonical")))
        .otherwise(F.coalesce("alias_brand", "canonical")).alias("display_name"),
    )


def attach_parent(canonicals: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent company as metadata.  ``parents``: child, parent_company."""
    table = parents.groupBy(F.lower("child").alias("_c")).agg(F.max("parent_company").alias("parent_company"))
    return canonicals.join(shuffled(table), F.lower("canonical") == F.col("_c"), "left").drop("_c")


def build_dictionary(sources: DataFrame, brands: DataFrame, parents: DataFrame, auto: DataFrame | None = None) -> DataFrame:
    """(canonical, display_name, parent_company, alias): the whole build."""
    edges = cut_lineage(name_edges(sources))
    groups = merge_groups(edges)
    named = name_groups(edges, groups)
    keyed = groups.join(shuffled(named), "component").select("alias_key", "canonical")
    texts = key_texts(edges)
    if auto is not None:
        extra = attach_auto_aliases(auto, keyed)
        auto_text = auto.select(F.explode(F.array("key", "alias")).alias("alias")).select(text.clean_alias("alias").alias("alias")).withColumn("alias_key", text.norm_key("alias"))
        texts = key_texts(edges.select("alias", "alias_key").unionByName(auto_text))
        keyed = keyed.unionByName(extra.select("alias_key", "canonical"))
    members = keyed.join(shuffled(texts), "alias_key").select("canonical", "alias_text")
    display = choose_display(members, brands)
    full = attach_parent(display, parents)
    aliases = members.where(F.lower("alias_text") != F.lower("canonical")).select("canonical", F.col("alias_text").alias("alias")).distinct()
    return full.join(shuffled(aliases), "canonical", "left")


def detect_conflicts(edges: DataFrame) -> DataFrame:
    """Alias keys filed under several canonical names, with the sources of each."""
    per = edges.groupBy("alias_key", "canonical_key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return per.groupBy("alias_key").agg(
        F.count("*").alias("n_canonicals"),
        F.array_sort(F.collect_list(F.struct("canonical_key", "sources"))).alias("mappings"),
    ).where("n_canonicals > 1")


def single_source_groups(edges: DataFrame) -> DataFrame:
    return edges.groupBy("canonical_key").agg(F.min("source").alias("source"), F.max("source").alias("_last")).where("source = _last").drop("_last")


def parent_errors(mergers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(true mergers, entries whose target is a holding company).  ``mergers``:
    old_name, new_name."""
    held = F.lower(F.trim("new_name")).isin(rules.HOLDING_NAMES_DICTIONARY)
    return mergers.where(~held), mergers.where(held)


def add_eia_ids(canonicals: DataFrame, matched: DataFrame) -> DataFrame:
    """Fill missing EIA ids.  ``matched``: canonical_id, eia_id; the smallest id wins."""
    found = matched.groupBy("canonical_id").agg(F.min("eia_id").alias("_new"))
    return canonicals.join(found, "canonical_id", "left").select(
        *[c for c in canonicals.columns if c != "eia_id"], F.coalesce("eia_id", "_new").alias("eia_id"),
        F.when(F.col("_new").isNull(), "unmatched").when(F.col("eia_id").isNull(), "added").otherwise("present").alias("eia_status"),
    )


def ingest_mergers(mergers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new aliases, unresolved).  The old name becomes an alias of the new utility,
    or of its new parent.  ``mergers``: old_name, new_name, new_parent."""
    table = aliases.select("alias_lower", "canonical_id")
    m = mergers.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("old_name", "new_name", "new_parent")]).where("old_name <> '' AND new_name <> ''")
    by_name = table.select(F.col("alias_lower").alias("_n"), F.col("canonical_id").alias("_by_name"))
    by_parent = table.select(F.col("alias_lower").alias("_p"), F.col("canonical_id").alias("_by_parent"))
    found = m.join(by_name, F.lower("new_name") == F.col("_n"), "left").join(by_parent, F.lower("new_parent") == F.col("_p"), "left").select(
        "old_name", "new_name", "new_parent", F.coalesce("_by_name", "_by_parent").alias("canonical_id"))
    known = table.select(F.col("alias_lower").alias("_o"), F.col("canonical_id").alias("_oc"))
    fresh = found.where("canonical_id IS NOT NULL").join(
        known, (F.lower("old_name") == F.col("_o")) & (F.col("canonical_id") == F.col("_oc")), "left_anti")
    return fresh.select("canonical_id", F.col("old_name").alias("alias"), "new_name").distinct(), found.where("canonical_id IS NULL").drop("canonical_id")


def apply_dictionary_edits(entries: DataFrame, aliases: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, aliases) after the edits.

    ``entries``: canonical, display_name, parent_company.  ``aliases``: canonical,
    alias.  ``edits``: action (add_alias | remove_alias | merge | add_entry |
    delete_entry), canonical, value, display_name.  A merge moves the canonical and
    its aliases under ``value``; ``display_name`` renames the target.
    """
    merges = edits.where("action = 'merge'").select(F.col("canonical").alias("_from"), F.col("value").alias("_to"), F.col("display_name").alias("_shown"))
    deleted = edits.where("action = 'delete_entry'").select("canonical")
    added = edits.where("action = 'add_entry'").select("canonical", F.coalesce("display_name", "canonical").alias("display_name"), F.col("value").alias("parent_company"))
    kept = entries.join(deleted, "canonical", "left_anti").join(merges, F.col("canonical") == F.col("_from"), "left_anti")
    shown = merges.where("_shown IS NOT NULL").groupBy("_to").agg(F.max("_shown").alias("_shown"))
    from_parent = entries.join(merges, F.col("canonical") == F.col("_from")).groupBy(F.col("_to").alias("_pt")).agg(F.max("parent_company").alias("_parent"))
    out = kept.join(shown, F.col("canonical") == F.col("_to"), "left").join(from_parent, F.col("canonical") == F.col("_pt"), "left").select(
        "canonical", F.coalesce("_shown", "display_name").alias("display_name"), F.coalesce("parent_company", "_parent").alias("parent_company"))
    out = out.unionByName(added.join(out.select("canonical"), "canonical", "left_anti"))

    moved = aliases.join(merges, F.col("canonical") == F.col("_from"), "left").select(F.coalesce("_to", "canonical").alias("canonical"), "alias")
    moved = moved.unionByName(merges.select(F.col("_to").alias("canonical"), F.col("_from").alias("alias")))
    plus = edits.where("action = 'add_alias'").select("canonical", F.col("value").alias("alias"))
    minus = edits.where("action = 'remove_alias'").select("canonical", F.lower("value").alias("_l"))
    final = moved.unionByName(plus).join(deleted, "canonical", "left_anti").withColumn("_l", F.lower("alias"))
    final = final.join(minus, ["canonical", "_l"], "left_anti").where(F.col("_l") != F.lower("canonical"))
    return out, final.groupBy("canonical", "_l").agg(F.min("alias").alias("alias")).drop("_l")


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases filed under more than one canonical."""
    return aliases.groupBy(F.lower("alias").alias("alias_lower")).agg(
        F.count_distinct("canonical_id").alias("n_canonicals"), F.min("canonical_id").alias("first_canonical")
    ).where("n_canonicals > 1")


def _alias_counts(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("canonical_id").agg(
        F.max("display_name").alias("display_name"), F.max("parent_company").alias("parent_company"), F.count("alias").alias("n_aliases"))


def dictionary_summary(dictionary: DataFrame) -> DataFrame:
    """One row of totals.  ``dictionary``: canonical_id, display_name,
    parent_company, alias (NULL for an entry without aliases)."""
    return _alias_counts(dictionary).agg(
        F.count("*").alias("canonicals"), F.sum("n_aliases").alias("aliases"),
        F.count_if(F.col("display_name") != F.col("canonical_id")).alias("display_overrides"),
        F.count("parent_company").alias("with_parent"), F.min("n_aliases").alias("min_aliases"),
        F.avg("n_aliases").alias("avg_aliases"), F.median("n_aliases").alias("median_aliases"), F.max("n_aliases").alias("max_aliases"),
    )


def alias_histogram(dictionary: DataFrame) -> DataFrame:
    return _alias_counts(dictionary).groupBy("n_aliases").agg(F.count("*").alias("n"))


def dictionary_sanity(dictionary: DataFrame) -> DataFrame:
    """(check, canonical_id, detail) for every finding."""
    per = _alias_counts(dictionary)
    # fixed values: corporate suffixes that should not be shown, and the length limit
    suffix = F.col("display_name").rlike(r"(?i)(,? inc\.?|,? corp\.?|,? llc| company| co\.?)$")
    checks = [
        per.where(suffix).select(F.lit("corporate_suffix").alias("check"), "canonical_id", F.col("display_name").alias("detail")),
        per.where(F.length("display_name") > 40).select(F.lit("long_display").alias("check"), "canonical_id", F.col("display_name").alias("detail")),
        dictionary.where(F.lower("alias").isin(rules.HOLDING_NAMES)).select(F.lit("holding_alias").alias("check"), "canonical_id", F.col("alias").alias("detail")),
        per.where("n_aliases = 0").select(F.lit("no_alias").alias("check"), "canonical_id", F.lit(None).cast("string").alias("detail")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def registry_coverage(crossref: DataFrame) -> DataFrame:
    return crossref.agg(F.count("*").alias("entities"), F.count_if("matched").alias("matched")).withColumn(
        "matched_pct", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("entities")), F.lit(0.0)))
