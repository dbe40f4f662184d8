"""Quality rules: text statistics, fixed rules, and robust multivariate outliers per language and source.

Statistics are column expressions over the whole text; repeated five-word windows are found inside the row by sorting
the hashes of its windows, so nothing is exploded or shuffled per word.

Each (language, source), each language and the whole table has a minimum-covariance-determinant estimate of the
transformed statistics, found by concentration steps: a start's mean and covariance give distances, the ``share`` of the
rows with the least of them gives the next mean and covariance, until the determinants stand still.  There are three starts
(medians with deviations, plain moments, moments of directions); after ``TRIAL_STEPS`` steps each group goes on from the
one of least determinant.  Every step is two aggregations with mergeable states (moments and approximate quantiles), so a
source that holds a third of the rows is summed in parts; what the groups know is joined to the rows as a small table.

A group is judged by a mean and covariance between its own and its language's (and that between its own and the table's),
weighted w and 1 - w with w = m / (m + ``STEADY_ROWS``) and m its rows beyond the ``NEEDED_ROWS`` that four dimensions
need.  So there is no size at which a group is suddenly judged by another estimate: a row more moves w by less than
1 / ``STEADY_ROWS``.  Rows whose Mahalanobis distance from that estimate is beyond the cut are rejected.

Cases: a null text has no words; a text of under ``min_words`` words fails the fixed rules; a null language or source is a
group value of its own kind, the empty string; equal rows have equal results, however often they occur; ties at the quantile are all taken in;
statistics without spread get the floor of ``FLOORS`` as their deviation; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlocus.llm.store import stored

SPACE = r"[\x20\x09-\x0D]+"
#: Transformed statistics with the least deviation that counts as spread.
FLOORS = {"v1": 0.06, "v2": 0.05, "v3": 0.12, "v4": 0.08}
SHARE = 0.75
#: Makes the covariance of the central 75 % of a four-dimensional normal sample consistent.
CONSISTENCY = 1.486
#: Squared distance that one in 100,000 rows of a four-dimensional normal sample passes.
CUT = 28.5
PRIOR_WORDS = 20
MOST_STEPS = 12
TRIAL_STEPS = 2
NEEDED_ROWS = 8
STEADY_ROWS = 50
#: Tables of at most so many rows (a few hundred bytes each) are broadcast to the rows; larger ones are joined by key.
BROADCAST_ROWS = 50_000


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; columns of these names are replaced."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in df.columns if c not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = df.select(
        *kept, F.filter(F.split(body, SPACE), lambda x: x != "").alias("_words"), lines.alias("_lines"), F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    n = F.size("_words")
    counted = base.select(
        *kept, "_words", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform("_words", lambda w: F.xxhash64(w))).alias("_hashes"))
    w = F.col("_hashes")
    windows = counted.select(
        *kept, *own[:4],
        F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))).alias("_windows"))
    g = F.col("_windows")
    again = windows.select("*", (F.size(F.array_distinct(g)) < F.size(g)).alias("_again"))
    ordered = again.select("*", F.when(F.col("_again"), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("_sorted"))
    s = F.col("_sorted")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["p"]))
    placed = ordered.select(*kept, *own[:4], F.sort_array(F.filter(twice, lambda p: p.isNotNull())).alias("_places"))
    p = F.col("_places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    return placed.select(*kept, *own[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def fixed_rules(min_words: int = 10, most_repeated: int = 20) -> Column:
    """Whether the fixed rules reject a row of statistics."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def vectors() -> list[Column]:
    """Logarithm of the mean word length, and of the shares of symbols, repeated lines and repeated words.  Every
    mean takes some typical words along, so that few words give no extreme value."""
    n = F.col("n_words") + PRIOR_WORDS
    return [F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / n).alias("v1"), F.log1p(F.col("n_symbols") / n).alias("v2"),
            F.log1p(F.col("n_dup_lines") / F.sqrt(n)).alias("v3"), F.log1p(F.col("n_repeat_words") / n).alias("v4")]


NAMES = list(FLOORS)


def factored(moments: DataFrame) -> DataFrame:
    """Lower triangular factor l_ij of the covariance c_ij, and the logarithm of its determinant."""
    out = moments
    for i in range(len(NAMES)):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{j}{i}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", reduce(lambda a, i: a + 2 * F.log(f"l{i}{i}"), range(len(NAMES)), F.lit(0.0)))


def distance() -> Column:
    """Squared Mahalanobis distance from (m_i, l_ij) by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * solved[k], range(i), F.col(name) - F.col(f"m{i}"))
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in solved])


MEANS = [f"m{i}" for i in range(len(NAMES))]
COVARIANCES = [f"c{i}{j}" for j in range(len(NAMES)) for i in range(j + 1)]


def with_table(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of a table that has a row per key; the rows stay where they are if the table is small."""
    table = stored(table, "groups")
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys)


def moments(weight: float = 1.0) -> list[Column]:
    """Aggregates: means, and covariances times ``weight`` with the floors' squares added."""
    floors = list(FLOORS.values())
    return [*[F.avg(v).alias(m) for v, m in zip(NAMES, MEANS)],
            *[(F.covar_pop(NAMES[i], NAMES[j]) * weight + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for j in range(len(NAMES)) for i in range(j + 1)]]


def starts(rows: DataFrame) -> DataFrame:
    """(grp, start, m_i, c_ij) of three starts per group."""
    size, floors = len(NAMES), list(FLOORS.values())
    near = rows.groupBy("grp").agg(*[F.percentile_approx(v, 0.5, 2000).alias(m) for v, m in zip(NAMES, MEANS)])
    centred = with_table(rows, near, ["grp"])
    spread = centred.groupBy("grp").agg(*[F.first(m).alias(m) for m in MEANS], *[F.percentile_approx(F.abs(F.col(v) - F.col(m)), 0.5, 2000).alias(f"d{i}") for i, (v, m) in enumerate(zip(NAMES, MEANS))])
    spread = spread.select("grp", *MEANS, *[F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i])).alias(f"s{i}") for i in range(size)])
    medians = spread.select("grp", F.lit(0).alias("start"), *MEANS, *[F.when(F.lit(i == j), F.col(f"s{i}") * F.col(f"s{i}")).otherwise(0.0).alias(f"c{i}{j}") for j in range(size) for i in range(j + 1)])
    plain = rows.groupBy("grp").agg(*moments()).select("grp", F.lit(1).alias("start"), *MEANS, *COVARIANCES)
    scaled = with_table(rows, spread, ["grp"])
    for i, (v, m) in enumerate(zip(NAMES, MEANS)):
        scaled = scaled.withColumn(f"z{i}", (F.col(v) - F.col(m)) / F.col(f"s{i}"))
    length = F.greatest(reduce(lambda a, i: a + F.col(f"z{i}") * F.col(f"z{i}"), range(size), F.lit(0.0)), F.lit(1e-12))
    turned = scaled.groupBy("grp").agg(*[F.first(c).alias(c) for c in (*MEANS, *[f"s{i}" for i in range(size)])],
                                       *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / length).alias(f"u{i}{j}") for j in range(size) for i in range(j + 1)])
    directions = turned.select("grp", F.lit(2).alias("start"), *MEANS, *[
        (F.col(f"u{i}{j}") * size * F.col(f"s{i}") * F.col(f"s{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for j in range(size) for i in range(j + 1)])
    return medians.unionByName(plain).unionByName(directions)


def concentrated(rows: DataFrame, state: DataFrame, share: float) -> DataFrame:
    """One concentration step of every (grp, start)."""
    keys = ["grp", "start"]
    far = with_table(rows, state.select(*keys, *MEANS, *[c for c in state.columns if c.startswith("l")]), ["grp"]).select(*keys, *NAMES, distance().alias("d"), F.col("log_det").alias("was"))
    cuts = far.groupBy(*keys).agg(F.percentile_approx("d", share, 5000).alias("cut"))
    central = with_table(far, cuts, keys).where("d <= cut")
    return stored(factored(central.groupBy(*keys).agg(F.first("was").alias("was"), *moments(CONSISTENCY))), "estimate")


def estimates(rows: DataFrame, share: float = SHARE, most_steps: int = MOST_STEPS) -> DataFrame:
    """(grp, n, m_i, c_ij): rows, mean and covariance of each ``grp`` of rows with columns v1.. by concentration steps."""
    state = stored(factored(starts(rows)), "estimate")
    for step in range(most_steps):
        state = concentrated(rows, state, share)
        if step + 1 == TRIAL_STEPS:
            rest = [c for c in state.columns if c != "grp"]
            state = stored(state.groupBy("grp").agg(F.min_by(F.struct(*rest), F.struct("log_det", "start")).alias("s")).select("grp", "s.*"), "estimate")
        elif step + 1 > TRIAL_STEPS and (state.agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0] or 0.0) < 0.01:
            break
    return state.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp").select("grp", "n", *MEANS, *COVARIANCES)


def shrunk(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Estimates (grp, parent, n, ...) drawn towards those of their parents (grp, ...) by their rows."""
    above = parent.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in (*MEANS, *COVARIANCES)])
    m = F.greatest(F.col("n") - NEEDED_ROWS, F.lit(0))
    weighed = own.join(above, "parent").withColumn("w", m / (m + STEADY_ROWS))
    return weighed.select("grp", *[(F.col("w") * F.col(c) + (1 - F.col("w")) * F.col(f"p_{c}")).alias(c) for c in (*MEANS, *COVARIANCES)])


def models(rows: DataFrame, levels: int) -> DataFrame:
    """(grp, m_i, l_ij) of the last level, from rows with columns k0 (the whole table), k1, ... and v1..."""
    keys = F.explode(F.array(*[F.concat(F.lit(f"{i}\x1f"), F.col(f"k{i}")) for i in range(levels)])).alias("grp")
    known = stored(estimates(rows.select(keys, *NAMES)), "estimates")
    of = lambda i: known.where(F.col("grp").startswith(f"{i}\x1f")).withColumn("grp", F.substr("grp", F.lit(3)))
    drawn = of(0)
    for i in range(1, levels):
        parents = rows.select(F.col(f"k{i}").alias("grp"), F.col(f"k{i - 1}").alias("parent")).distinct()
        drawn = shrunk(of(i).join(parents, "grp"), drawn)
    return factored(drawn)


def judged(df: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), key: str = "doc_id", cut: float = CUT, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """(key, statistics, base_failed, distance2, kept)."""
    names = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    labels = [F.concat_ws("\x1f", F.lit(""), *names[:i]).alias(f"k{i}") for i in range(len(groups) + 1)]
    given = text_statistics(df.select(key, F.col(text).alias("text"), *labels)).drop("text")
    stats = stored(given.withColumn("base_failed", fixed_rules(min_words, most_repeated)).select("*", *vectors()), "statistics")
    model = models(stats, len(groups) + 1).withColumnRenamed("grp", f"k{len(groups)}")
    far = with_table(stats, model, [f"k{len(groups)}"]).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance().alias("distance2"))
    return far.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= cut))
