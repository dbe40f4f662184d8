"""Boolean (and reason) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.functions.address import as_col


def contains_any(text: Column, words: list[str], whole_word: bool = False) -> Column:
    pattern = rules.any_of(words)
    return text.rlike(rf"\b(?:{pattern})\b" if whole_word else pattern)


def _upper_has(c, words, whole_word=False) -> Column:
    return F.coalesce(contains_any(F.upper(as_col(c)), words, whole_word), F.lit(False))


def is_null_value(value: Column | str) -> Column:
    v = F.lower(F.trim(F.coalesce(as_col(value), F.lit(""))))
    return v.isin(rules.TENANT_NULLS) | (F.length(v) <= 2)


def reserved_kind(name_lower: Column) -> Column:
    """null_value, propane or holding: exact names that never reach matching."""
    return (
        F.when(name_lower.isin(rules.NULL_NAMES) | (name_lower == ""), "null_value")
        .when(name_lower.isin(rules.PROPANE_NAMES), "propane")
        .when(name_lower.isin(rules.HOLDING_NAMES), "holding")
    )


def is_propane(value: Column | str) -> Column:
    return F.coalesce(contains_any(F.lower(as_col(value)), rules.PROPANE_WORDS), F.lit(False))


def is_tdu(name: Column | str) -> Column:
    return _upper_has(name, rules.TDU_NAMES)


def is_large_iou(name: Column | str, whole_word: bool = False) -> Column:
    return _upper_has(name, rules.LARGE_IOU_NAMES, whole_word)


def is_local_utility(name: Column | str, whole_word: bool = False) -> Column:
    return _upper_has(name, rules.LOCAL_WORDS + rules.LOCAL_NAMES, whole_word)


def is_water_utility_name(name: Column | str) -> Column:
    return _upper_has(name, rules.WATER_WORDS)


def is_deregulated(name: Column | str, control_area: Column | str, kind: Column | str) -> Column:
    n = F.upper(F.coalesce(as_col(name), F.lit("")))
    k = F.upper(F.coalesce(as_col(kind), F.lit("")))
    area = F.upper(F.coalesce(as_col(control_area), F.lit("")))
    public = k.contains("COOPERATIVE") | k.contains("MUNICIPAL")
    tdus = F.array(*[F.lit(t) for t in rules.ERCOT_TDUS])
    return (
        F.when(public, n.contains("LUBBOCK"))
        .when(F.exists(tdus, lambda t: n.contains(t) | t.contains(n)), True)
        .otherwise(area.isin("ERCO", "ERCOT") & k.contains("INVESTOR"))
    )


def is_protected_source(source: Column | str) -> Column:
    return F.coalesce(
        contains_any(F.lower(as_col(source)), rules.PROTECTED_SOURCE_WORDS), F.lit(False)
    )


def needs_review_flag(confidence: Column | str, threshold: float = 0.70) -> Column:
    return as_col(confidence) < threshold


def needs_review_queue(comparison, confidence, tenant_raw, provider, catalog_id) -> Column:
    comparison, provider, catalog_id = as_col(comparison), as_col(provider), as_col(catalog_id)
    conf = F.coalesce(as_col(confidence), F.lit(0.0))
    has_tenant = F.length(F.trim(F.coalesce(as_col(tenant_raw), F.lit("")))) > 0
    return (
        F.coalesce(comparison.isin("MISMATCH", "MATCH_ALT"), F.lit(False))
        | ((conf > 0) & (conf < 0.70))
        | (has_tenant & (conf > 0) & (conf < 0.75))
        | (provider.isNotNull() & catalog_id.isNull())
    )


def review_reason(comparison, needs_review, provider, catalog_id, id_confident) -> Column:
    comparison, provider, catalog_id = as_col(comparison), as_col(provider), as_col(catalog_id)
    return F.concat_ws(
        "; ",
        F.when(comparison == "MISMATCH", "MISMATCH"),
        F.when(comparison == "MATCH_ALT", "MATCH_ALT"),
        F.when(as_col(needs_review), "Low confidence"),
        F.when(provider.isNotNull() & catalog_id.isNull(), "No catalog ID"),
        F.when(~as_col(id_confident) & catalog_id.isNotNull(), "Low ID confidence"),
    )


def cross_state_override(name: Column | str, state: Column | str) -> Column:
    n, s = F.lower(as_col(name)), F.upper(as_col(state))
    hit = F.lit(False)
    for text, states in rules.CROSS_STATE_DENY.items():
        hit = hit | (n.contains(text) & s.isin(states))
    return F.coalesce(hit, F.lit(False))


def is_wholesale(names: Column | str) -> Column:
    return contains_any(F.lower(F.array_join(as_col(names), " ")), rules.WHOLESALE_WORDS)


def feature_kept(name, filter_value, filter_text, exclude_names, filter_equal=None) -> Column:
    """State-layer feature filter: case-insensitive containment of the configured
    text in the filter attribute, equality with a configured number or truth value,
    and the name is not excluded.  NULL = no rule."""
    name, filter_text = as_col(name), as_col(filter_text)
    passes = filter_text.isNull() | F.lower(as_col(filter_value)).contains(F.lower(filter_text))
    if filter_equal is not None:
        equal, value = as_col(filter_equal), as_col(filter_value)
        passes = passes & (equal.isNull() | F.coalesce(value.try_cast("double") == equal.try_cast("double"), F.lower(value) == F.lower(equal)))
    excluded = F.array_contains(F.coalesce(as_col(exclude_names), F.array().cast("array<string>")), name)
    return F.coalesce(passes, F.lit(False)) & ~F.coalesce(excluded, F.lit(False))


def is_compound_key(name: Column | str) -> Column:
    n = as_col(name)
    parts = F.transform(F.split(n, ", "), lambda p: F.trim(p))
    return (
        n.contains(", ")
        & ~F.exists(parts, lambda p: F.length(p) <= 3)
        & (F.size(F.filter(parts, lambda p: F.length(p) > 5)) >= 2)
    )


def names_are_similar(key1: Column, key2: Column) -> Column:
    """Plausibly the same entity, from two normal keys (see ``text.norm_key``)."""
    def first_long(k):
        return F.get(F.filter(F.split(k, " "), lambda w: F.length(w) > 3), F.lit(0))

    both = (F.length(key1) > 3) & (F.length(key2) > 3)
    similar = (
        (key1 == key2)
        | (both & (key1.contains(key2) | key2.contains(key1)))
        | F.coalesce(first_long(key1) == first_long(key2), F.lit(False))
    )
    return (F.length(key1) > 0) & (F.length(key2) > 0) & similar
