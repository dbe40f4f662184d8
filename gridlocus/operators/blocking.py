"""Candidate generation for name matching, without a cross product.

Both joins below are exact: a pair that satisfies the final predicate always
shares a join key.  Keys are chosen by rarity, so that a gram carried by a large
part of either side is used only where nothing rarer exists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlocus.functions.similarity import indel_ratio


def substrings(text: Column, length: int) -> Column:
    """Every substring of the given length, in order; empty if the text is shorter."""
    n = F.length(text) - length + 1
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(length)))
    ).otherwise(F.array().cast("array<string>"))


def contained_pairs(
    texts: DataFrame, parts: DataFrame, text: str, part: str, min_len: int = 1, gram: int = 4
) -> DataFrame:
    """Distinct (text, part) with ``part`` occurring inside ``text``.

    A part is filed under its rarest gram only; a text looks up all its grams.
    Parts shorter than a gram are filed under themselves.
    """
    needles = parts.select(part).where(F.length(part) >= max(min_len, 1)).distinct()
    short = F.length(part) < gram
    keyed = needles.select(
        part,
        F.explode(
            F.when(short, F.array(F.col(part))).otherwise(F.array_distinct(substrings(F.col(part), gram)))
        ).alias("_gram"),
    )
    frequency = keyed.groupBy("_gram").agg(F.count("*").alias("_df"))
    filed = (
        keyed.join(frequency, "_gram")
        .groupBy(part)
        .agg(F.min_by("_gram", F.struct("_df", "_gram")).alias("_gram"))
    )
    lengths = range(max(min_len, 1), gram + 1)
    grams = F.array_distinct(F.flatten(F.array(*[substrings(F.col(text), k) for k in lengths])))
    probes = texts.select(text).distinct().select(text, F.explode(grams).alias("_gram"))
    return probes.join(filed, "_gram").where(F.col(text).contains(F.col(part))).select(text, part)


def multiset_grams(text: Column, q: int) -> Column:
    """Grams numbered by occurrence, so that set overlap equals multiset overlap."""
    grams = substrings(text, q)
    return F.transform(
        grams,
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")
        ),
    )


def _overlap_slope(ratio: float, q: int) -> float:
    return (2 * q - 1) * ratio / 2 - (q - 1)


def gram_candidates(
    left: DataFrame,
    right: DataFrame,
    left_text: str,
    right_text: str,
    min_score: float,
    on: Sequence[str] = (),
) -> DataFrame:
    """Distinct (on, left text, right text) that may reach ``indel_ratio >= min_score``;
    none that does is lost.

    With LCS = L, two strings of n and m characters share at least
    ``(2q-1)L - (q-1)(n+m) - (q-1)`` grams, which bounds how many of the rarest
    grams of each string have to be looked up (prefix filtering).  Names of the text
    columns and of ``on`` must differ.
    """
    t = min_score / 100.0
    q = 2 if t >= 0.82 else 1
    slope = _overlap_slope(t, q)
    on = list(on)
    # Strings too short for a gram bound can only pass by being equal.
    shortest = math.floor((q - 1) * (2 - t) / (2 * slope)) + 1

    def grams_of(df: DataFrame, text: str) -> DataFrame:
        whole = F.array(F.concat(F.lit("="), F.col(text)))
        grams = F.when(F.length(text) < shortest, whole).otherwise(multiset_grams(F.col(text), q))
        distinct = df.select(*on, text).distinct().where(F.length(text) > 0)
        return distinct.select(*on, text, F.explode(grams).alias("_gram"))

    lg, rg = grams_of(left, left_text), grams_of(right, right_text)
    frequency = rg.groupBy("_gram").agg(F.count("*").alias("_df"))

    def prefixes(df: DataFrame, text: str, tag: str) -> DataFrame:
        """Grams by rarity, and the prefix of them to look up."""
        n = F.length(text)
        least = F.greatest(F.ceil(slope * n * 2 / (2 - t) - 1e-9) - (q - 1), F.lit(1))
        ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("f"), F.col("_gram").alias("g"))))
        return (
            df.join(frequency, "_gram", "left").groupBy(*on, text).agg(ranked.alias("_r"))
            .select(*on, text, F.col("_r.g").alias(f"_{tag}"))
            .withColumn(f"_{tag}n", F.greatest(F.size(f"_{tag}") - least + 1, F.lit(1)).cast("int"))
        )

    le = prefixes(lg, left_text, "l").withColumn("_key", F.explode(F.slice("_l", F.lit(1), F.col("_ln"))))
    re_ = prefixes(rg, right_text, "r").withColumn("_key", F.explode(F.slice("_r", F.lit(1), F.col("_rn"))))
    n, m = F.length(left_text), F.length(right_text)
    first_shared = F.get(F.array_intersect(F.slice("_l", F.lit(1), F.col("_ln")), F.slice("_r", F.lit(1), F.col("_rn"))), F.lit(0))
    overlap = F.size(F.array_intersect("_l", "_r"))
    return (
        le.join(re_, on + ["_key"])
        .where((F.least(n, m) * 200.0) >= (n + m) * (min_score - 1e-9))
        # one row per pair: only under the first prefix gram both sides share
        .where(first_shared == F.col("_key"))
        .where((F.col(left_text) == F.col(right_text)) | (overlap >= F.ceil(slope * (n + m) - 1e-9) - (q - 1)))
        .select(*on, left_text, right_text)
    )


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    left_text: str,
    right_text: str,
    min_score: float,
    on: Sequence[str] = (),
) -> DataFrame:
    """All pairs with ``indel_ratio >= min_score`` and their ``score``; distinct texts
    are scored once, then the columns of both sides are joined back."""
    on = list(on)
    scored = (
        gram_candidates(left, right, left_text, right_text, min_score, on)
        .withColumn("score", indel_ratio(left_text, right_text))
        .where(F.col("score") >= min_score)
    )
    return scored.join(left, on + [left_text]).join(right, on + [right_text])


def token_cover_candidates(
    probe: DataFrame, other: DataFrame, probe_text: str, other_text: str, cover: float, on: Sequence[str] = ()
) -> DataFrame:
    """Pairs whose shared words may make up ``cover`` of the probe text.

    The rarest words of the probe are looked up until what is left is too short
    to reach the cover on its own.
    """
    on = list(on)

    def words(df: DataFrame, text: str) -> DataFrame:
        tokens = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return df.select(*on, text).distinct().select(*on, text, F.explode(tokens).alias("_word"))

    pw, ow = words(probe, probe_text), words(other, other_text)
    frequency = ow.groupBy("_word").agg(F.count("*").alias("_df"))
    ordered = (
        pw.join(frequency, "_word", "left")
        .groupBy(*on, probe_text)
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("f"), F.col("_word").alias("w")))).alias("_order"))
    )
    # Length (with one separator each) of the words that come before position i.
    spent = lambda i: F.aggregate(
        F.slice("_order", F.lit(1), i), F.lit(0), lambda acc, s: acc + F.length(s["w"]) + 1
    )
    room = F.length(probe_text) * (1 - cover) + 1
    keyed = ordered.select(
        *on,
        probe_text,
        F.explode(F.filter("_order", lambda s, i: spent(i) <= room)).alias("_s"),
    ).select(*on, probe_text, F.col("_s.w").alias("_word"))
    return keyed.join(ow, on + ["_word"]).select(*on, probe_text, other_text).distinct()
