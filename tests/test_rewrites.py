"""Every rewrite of names and titles, each on a text made for it."""

import pytest
from pyspark.sql import functions as F

from gridlocus.functions import rules, text


def normal(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, name string").select("i", fn("name").alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


#: Title, matching form: one line per word rewrite, state ending, suffix and sign.
TITLES = [
    ("Acme Elec Coop", "acme electric cooperative"), ("Acme Elec", "acme electric"), ("Acme Elec Member Corp", "acme electric member"), ("Acme Pwr Plant", "acme power plant"),
    ("Acme Pwr", "acme power"), ("Acme Svc Unit", "acme service unit"), ("Acme Svcs Unit", "acme services unit"), ("Acme Util Board", "acme utilities board"),
    ("Acme Utils Board", "acme utilities board"), ("East Ohio Gas", "enbridge gas ohio"), ("Dominion East Ohio", "enbridge gas ohio"), ("Little Rock Pine Bluff", "entergy arkansas"),
    ("Cheyenne Light Fuel Power", "black hills energy"), ("Cheyenne Light Fuel & Power", "black hills energy"), ("Acme Light - TX", "acme light"), ("Acme Light (TX)", "acme light"),
    ("Acme Light – (tx)", "acme light"), ("Acme Corporation", "acme"), ("Acme Corp", "acme"), ("Acme Inc", "acme"), ("Acme LLC", "acme"), ("Acme Co-op", "acme co"), ("Acme Company", "acme"),
    ("Acme Electric Delivery", "acme"), ("  Acme's   Light, (old) ", "acme s light old"), ("MO Amer Water", "missouri american water"), ("PA American Wtr", "pennsylvania american water"),
    ("Amer Steel", "american steel"), ("", ""), (None, ""),
]


def test_titles(spark):
    assert normal(spark, text.normalize_catalog_title, [a for a, _ in TITLES]) == [b for _, b in TITLES]


def first_rule(title, table):
    for every, some, new in table:
        if all(w in title for w in every) and (not some or any(w in title for w in some)):
            title = new
    return title


@pytest.mark.parametrize("late", [False, True])
def test_title_rules(spark, late):
    table = rules.CATALOG_TITLE_RULES_LATE if late else rules.CATALOG_TITLE_RULES
    made = [" ".join([*every, *([word] if word else [])]) for every, some, _ in table for word in (some or [""])]
    short = {key.replace("&", "").replace(" ", ""): full for key, full in reversed(rules.CATALOG_ABBREVIATIONS.items())}

    def plain(title):
        for part in ([] if late else [rules.CATALOG_TITLE_RULES]) + [rules.CATALOG_TITLE_RULES_LATE]:
            title = first_rule(title, part)
        title = short.get(title.replace("&", "").replace("-", "").replace(" ", ""), title)
        for suffix in rules.CATALOG_LEGAL_SUFFIXES:
            title = title.removesuffix(suffix)
        return title

    got = normal(spark, text.normalize_catalog_title, made)
    assert got == [plain(x) for x in made] and sum(a != b for a, b in zip(got, made)) > 0.8 * len(made)


def test_title_abbreviations_and_states(spark):
    keys = list(rules.CATALOG_ABBREVIATIONS)
    first = {}
    for k, v in rules.CATALOG_ABBREVIATIONS.items():
        first.setdefault(k.replace("&", "").replace(" ", ""), v)
    want = [first[k.replace("&", "").replace(" ", "")] for k in keys]
    assert normal(spark, text.normalize_catalog_title, [k.upper() for k in keys]) == want
    states = list(rules.AMERICAN_WATER_STATES.items())
    assert normal(spark, text.normalize_catalog_title, [f"{k}american water" for k, _ in states]) == [f"{v}american water" for _, v in states]


#: Water name, normal form: each abbreviation with its look-ahead met and, where it has one, not met.
WATERS = [
    ("Elm Wtr", "Elm Water"), ("Elm Co", "Elm County"), ("Elm Co.", "Elm Co"), ("Elm Ws", "Elm"), ("Elm Dept", "Elm Department"), ("Elm Auth", "Elm Authority"), ("Elm Svc", "Elm Service"),
    ("Elm Comm", "Elm Commission"), ("Elm Bd", "Elm Board"), ("KC North", "Kansas City North"), ("Ft Elm", "Fort Elm"), ("St Elm", "Saint Elm"), ("Elm St", "Elm St"), ("Mt Elm", "Mount Elm"),
    ("Elm Wsa", "Elm Water and Sewer Authority"), ("Elm Sud", "Elm Special Utility District"), ("Elm Wsc", "Elm Water Supply Corporation"), ("Elm Wcid", "Elm Water Control and Improvement District"),
    ("Elm Fwsd", "Elm Fresh Water Supply District"), ("Elm Pwsd", "Elm Public Water Supply District"), ("Elm Sd 4", "Elm Supply District 4"), ("Elm Sd north", "Elm Sd north"), ("Elm Wtp", "Elm Water Treatment Plant"),
    ("Elm - TX", "Elm"), ("Elm TX", "Elm"), ("Elm (TX0001)", "Elm"), ("Elm, City Of", "City Of Elm"), ("Elm, Town Of", "Town Of Elm"), ("Elm Water Department", "Elm"), ("Elm Mud 12", "Elm"),
    ("Lee's Elm", "Lees Elm"), (" - Elm., ", "Elm"), ("", ""), (None, ""),
]


def test_water_names(spark):
    got = dict(zip([a for a, _ in WATERS], normal(spark, text.normalize_water_name, [a for a, _ in WATERS])))
    assert {a: b for a, b in WATERS if got[a] != b} == {}, {a: got[a] for a, b in WATERS if got[a] != b}


def test_every_generic_water_ending_goes(spark):
    made = [f"Elm {x}" for x in rules.WATER_GENERIC_SUFFIXES]
    assert set(normal(spark, lambda c: F.trim(text.normalize_water_name(c)), made)) == {"Elm"}
