"""Name normalisation columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlocus.functions import rules
from gridlocus.functions.address import as_col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def clean_name(name: Column | str) -> Column:
    return F.regexp_replace(F.trim(_empty(name)), r"\s+", " ")


def normalize_for_fuzzy(name: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(_empty(name)), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def clean_alias(name: Column | str) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(_empty(name)), ",+$", ""))
    return F.regexp_replace(bare, r"\s+", " ")


def norm_key(name: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(clean_alias(name)), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def _strip_suffixes(c: Column, suffixes: list[str], fold_case: bool) -> Column:
    flag = "(?i)" if fold_case else ""
    for suffix in suffixes:
        c = F.trim(F.regexp_replace(c, f"{flag}{re.escape(suffix)}$", ""))
    return c


def title_case(name: Column) -> Column:
    """A capital after every non-letter, the rest lower ("AT&T CO-OP" -> "At&T Co-Op")."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.initcap(w)), "")


def clean_passthrough(name: Column | str) -> Column:
    def shown(bare):
        shout = (bare == F.upper(bare)) & (F.length(bare) > 3)
        return F.when(shout, title_case(bare)).otherwise(bare)

    return let(_strip_suffixes(F.trim(_empty(name)), rules.LEGAL_SUFFIXES, fold_case=True), shown)


def strip_display_suffixes(name: Column) -> Column:
    return _strip_suffixes(F.trim(name), rules.DISPLAY_SUFFIXES, fold_case=False)


def pick_display_name(names: Column | str) -> Column:
    """Shortest name after legal suffixes are gone; the first one on a tie."""
    ranked = F.transform(
        as_col(names),
        lambda n, i: F.struct(
            F.length(strip_display_suffixes(n)).alias("n"), i.alias("i"),
            strip_display_suffixes(n).alias("name"),
        ),
    )
    return F.coalesce(F.array_min(ranked)["name"], F.lit(""))


def fix_casing(name: Column | str) -> Column:
    n = as_col(name)
    table = F.create_map(*[F.lit(x) for pair in rules.CASING.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(n))), n)


def display_preference(name: Column) -> Column:
    """Sort key of the better display text: not all capitals first, then the longest."""
    shout = (name == F.upper(name)) & (name != F.lower(name))
    return F.struct(shout.alias("shout"), (-F.length(name)).alias("short"), name.alias("name"))


def name_core(name_lower: Column) -> Column:
    core = name_lower
    for pattern in rules.CORE_STRIP_PATTERNS:
        core = F.trim(F.regexp_replace(core, pattern, ""))
    return F.trim(F.regexp_replace(core, r"\s+", " "))


def normalize_water_name(name: Column | str) -> Column:
    n = F.trim(_empty(name))
    n = F.regexp_replace(n, r"(?i)\s*-\s*[A-Z]{2}\s*$", "")
    n = F.regexp_replace(n, r"\s+[A-Z]{2}\s*$", "")
    n = F.regexp_replace(n, r"\s*\([^)]*\)", "")
    n = F.regexp_replace(n, r"(?i)^(.+?),\s*(City Of|Town Of|Village Of|County Of)\s*$", "$2 $1")
    for pattern, full in rules.WATER_ABBREVIATIONS:
        n = F.regexp_replace(n, f"(?i){pattern}", full)
    generic = "|".join(rules.WATER_GENERIC_SUFFIXES)
    n = F.regexp_replace(n, rf"(?i)\b({generic}|Mud \d+)\b", "")
    n = F.regexp_replace(n, "['’]", "")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    return F.regexp_replace(n, r"^[ \-,.]+|[ \-,.]+$", "")


def normalize_catalog_title(title: Column | str) -> Column:
    """Ordered rewrites of a catalog title into its matching form."""
    t = F.lower(F.trim(_empty(title)))
    for pattern, full in [
        (" elec ", " electric "), (" elec$", " electric"), ("elec member", "electric membership"),
        (" coop", " cooperative"), (" pwr ", " power "), (" pwr$", " power"),
        (" svc ", " service "), (" svcs ", " services "), (" util ", " utilities "),
        (" utils ", " utilities "), ("east ohio gas", "enbridge gas ohio"),
        ("dominion east ohio", "enbridge gas ohio"), ("little rock pine bluff", "entergy arkansas"),
        ("cheyenne light fuel power", "black hills energy"),
        ("cheyenne light fuel & power", "black hills energy"),
    ]:
        t = F.regexp_replace(t, pattern, full)
    t = _title_rules(t, rules.CATALOG_TITLE_RULES)
    t = let(t, _state_american_water)
    t = _title_rules(t, rules.CATALOG_TITLE_RULES_LATE)
    short = {}
    for key, full in rules.CATALOG_ABBREVIATIONS.items():
        short.setdefault(re.sub("[& ]", "", key), full)
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    t = let(t, lambda v: F.coalesce(F.try_element_at(table, F.regexp_replace(v, "[&\\- ]", "")), v))
    t = F.regexp_replace(t, r"(?i)\s*[-–]\s*\(?[A-Z]{2}\)?\s*$", "")
    t = F.regexp_replace(t, r"(?i)\s*\([A-Z]{2}\)\s*$", "")
    for suffix in rules.CATALOG_LEGAL_SUFFIXES:
        t = F.regexp_replace(t, f"{suffix}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"\s+", " "))


def _title_rules(t: Column, table: list) -> Column:
    """The rules in order, each on the text so far: all words of the first list, and
    one of the second unless it is empty, give the replacement."""
    words = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    listed = F.array(*[
        F.struct(words(every).alias("every"), words(some).alias("some"), F.lit(new).alias("new")) for every, some, new in table
    ])

    def apply(text_so_far, rule):
        has = lambda w: text_so_far.contains(w)
        hit = F.forall(rule["every"], has) & ((F.size(rule["some"]) == 0) | F.exists(rule["some"], has))
        return F.when(hit, rule["new"]).otherwise(text_so_far)

    return F.aggregate(listed, t, apply)


def _state_american_water(t: Column) -> Column:
    def expand(wide):
        out = F.when(F.lit(False), wide)
        for short, full in rules.AMERICAN_WATER_STATES.items():
            near = F.substring(wide, len(short) + 1, 12).contains("american")
            out = out.when(wide.startswith(short) & near, F.lit(full + "american water"))
        return out.otherwise(wide)

    return F.when(t.contains("amer"), let(F.regexp_replace(t, r"\bamer\b", "american"), expand)).otherwise(t)


def state_word_in_title(title: Column | str, state: Column | str) -> Column:
    words = F.regexp_extract_all(F.upper(as_col(title)), F.lit("[A-Z]+"), F.lit(0))
    return F.array_contains(words, F.upper(as_col(state)))


def states_in_text(text: Column) -> Column:
    """Two-letter state codes that stand as words in the text."""
    codes = "|".join(rules.STATE_CODES)
    # Separators between two codes are shared, so they are looked at, not consumed.
    pattern = rf"(?<=^|[\s,\-(])(?:{codes})(?=$|[\s,\-).)])"
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(0)))


def classify_unmatched(name: Column | str) -> Column:
    n = F.lower(as_col(name))
    return (
        F.when(n.contains(","), "Compound (comma-separated)")
        .when(n.rlike("choose|select|enter|n/a|none|power to"), "Placeholder")
        .when(n.rlike("water|sewer|waste"), "Water/sewer")
        .when(n.rlike("co-op|coop|cooperative|emc"), "Co-op")
        .when(n.rlike("municipal|city of|town of|village of"), "Municipal")
        .when(n.contains("gas") & ~n.contains("electric"), "Gas utility")
        .otherwise("")
    )


def infer_utility_type(names: Column | str) -> Column:
    n = F.lower(F.array_join(as_col(names), " "))
    return (
        F.when(n.contains("gas") & ~n.contains("electric"), "gas")
        .when(n.rlike("water|irrigation"), "water")
        .when(n.rlike("electric|power|energy|light"), "electric")
        .otherwise("multi")
    )


def deregulated_note(name: Column | str) -> Column:
    return F.format_string(
        "Address is in %s TDU territory. Tenant chooses their Retail Electric Provider (REP).",
        clean_passthrough(name),
    )
