"""Queries by name, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlocus.session import apply_conf
from gridlocus.workload.bindings import Tables, oracle

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The SQL as written, for checks that are composed of others.
TEXTS: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            TEXTS[name] = sql
            ORACLES[name] = oracle(sql, recursive)
        return fn

    return register


def runnable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Tables(apply_conf(spark), folder))


# ---- SQL fragments -----------------------------------------------------------
def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def has_any(expression: str, words) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quoted(w)})" for w in words) + ")"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two texts: one row of the table per character."""
    return f"""list_max(list_reduce(list_concat([list_transform(range(0, len({b})), lambda z: CAST(0 AS BIGINT))],
      list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda d: CAST(c = d AS BIGINT)))),
      lambda p, x: list_transform(range(1, len(x) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(p[k], (CASE WHEN k > 1 THEN p[k - 1] ELSE 0 END) + x[k]))))))"""


def indel(a: str, b: str) -> str:
    return f"(200.0 * {lcs(a, b)} / (len({a}) + len({b})))"


def sorted_words(a: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({a}, ' '), lambda w: w <> '')), ' ')"


def may_reach(a: str, b: str, score: float) -> str:
    """Cheap necessary condition of ``indel(a, b) >= score``."""
    ca, cb = f"list_distinct(string_split({a}, ''))", f"list_distinct(string_split({b}, ''))"
    gap = f"(len({ca}) + len({cb}) - 2 * len(list_intersect({ca}, {cb})))"
    return f"(200.0 * least(len({a}), len({b})) >= {score} * (len({a}) + len({b})) AND {gap} <= (1 - {score} / 100.0) * (len({a}) + len({b})) + 1e-9)"
