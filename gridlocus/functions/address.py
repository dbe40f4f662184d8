"""Address text columns.  Missing parts are NULL, never empty strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlocus.functions import rules


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def _first_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_state(address: Column | str) -> Column:
    a = as_col(address)
    return F.coalesce(
        _first_match(a, r",\s*([A-Z]{2})\s+\d{5}"), _first_match(a, r",\s*([A-Z]{2})\s*$")
    )


def extract_zip(address: Column | str) -> Column:
    """ZIP at the end of the text, else the one that follows the state."""
    a = as_col(address)
    return F.coalesce(
        _first_match(a, r"\b(\d{5})(?:-\d{4})?\s*$"), _first_match(a, r",\s*[A-Z]{2}\s+(\d{5})")
    )


def extract_city(address: Column | str) -> Column:
    return blank_to_null(_first_match(as_col(address), r",\s*([^,]+?)\s*,\s*[A-Z]{2}"))


def split_address(address: Column | str) -> Column:
    """STRUCT<street, city, state, zip> from a one-line address."""
    a = as_col(address)
    parts = F.transform(F.split(a, ","), lambda p: F.trim(p))
    n = F.size(parts)
    last = F.element_at(parts, -1)
    tail = r"^([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)"
    two = r"^(.+?)\s+([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)"
    has_tail, has_two = last.rlike(tail), last.rlike(two)
    street = F.when(n >= 2, parts[0]).otherwise(a)
    city = F.when(n >= 3, parts[1]).when(
        n == 2, F.when(has_two, F.regexp_extract(last, two, 1)).otherwise(last)
    )
    state = F.when(
        n >= 3, F.when(has_tail, F.regexp_extract(last, tail, 1)).otherwise(last)
    ).when((n == 2) & has_two, F.regexp_extract(last, two, 2))
    zip_code = F.when((n >= 3) & has_tail, F.regexp_extract(last, tail, 2)).when(
        (n == 2) & has_two, F.regexp_extract(last, two, 3)
    )
    return F.struct(
        street.alias("street"),
        blank_to_null(city).alias("city"),
        blank_to_null(state).alias("state"),
        zip_code.alias("zip"),
    )


def address_key(address: Column | str) -> Column:
    key = F.regexp_replace(F.trim(F.lower(as_col(address))), r"\s+", " ")
    for word, short in rules.ADDRESS_ABBREVIATIONS:
        key = F.regexp_replace(key, rf"\b{word}\b", short)
    return key


def tiger_confidence(has_line: Column) -> Column:
    return F.when(has_line, 0.95).otherwise(0.80)


def location_type_confidence(location_type: Column | str) -> Column:
    c = as_col(location_type)
    score = F.lit(rules.LOCATION_TYPE_DEFAULT)
    for name, value in rules.LOCATION_TYPE_SCORE.items():
        score = F.when(c == name, value).otherwise(score)
    return score


def place_rank_confidence(rank: Column | str) -> Column:
    r = F.coalesce(as_col(rank), F.lit(0))
    return F.when(r >= 30, 0.92).when(r >= 26, 0.80).otherwise(0.60)


def block_geoid(state: Column | str, county: Column | str, tract: Column | str, block: Column | str) -> Column:
    parts = [blank_to_null(p) for p in (state, county, tract, block)]
    return F.concat(*parts)  # NULL as soon as one part is missing


def county_clean(county: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(county), " [Cc]ounty", ""))


def coordinate_cell(lat: Column | str, lon: Column | str, digits: int = 3) -> Column:
    return F.struct(
        F.bround(as_col(lat), digits).alias("lat"), F.bround(as_col(lon), digits).alias("lon")
    )
