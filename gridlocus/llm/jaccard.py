"""Groups of documents whose word-shingle sets are similar: an exact Jaccard join with adaptive
multi-match prefixes.

Two sets of sizes n and m with |A∩B| * 100 >= percent * |A∪B| share at least t = ceil(percent * n / 100)
elements.  In any fixed order of all shingles, the first n - t + l of A and the like prefix of B share
at least min(l_A, l_B) of them.  So a document may lengthen its prefix by choosing a larger l, and then
a partner must share that many more prefix shingles before it is worth verifying.

* Order: shingles that are common in the corpus come last, by count, all others by hash.  The common ones are
  found by counting over all documents, and the most common ``COMMON_MOST`` of them are known to every task; they
  only set the order, never the result.
* Cost: the number of documents that have a prefix shingle is counted exactly.  A shingle of more than
  ``dear`` documents is dear.  Each document takes the l with the least estimated cost (entries read
  for its other prefix shingles, plus the candidates these can yield, at most entries / r, where r = l minus
  its dear ones): dear shingles need not be read, as r >= 1 cheap ones are always shared.  A
  document without such an l (nearly all its shingles are dear) is open: l = 1 and all are read.
* Groups: equal sets are one node from the start.  In a few star rounds, each document is verified against one
  document of the buckets it is in: of those of about its size, the one whose prefix has the fewest rarer shingles before the bucket's,
  which in a group of copies is the one nearest to what they were copied from.  The members of a star (of all rounds) that are still
  in different components are then compared with each other by their differences from the star's centre; those that only one
  member has count against it, so that few members have to meet.  The last round takes the pairs of all buckets whose ends
  are in different components and have no star in common.
* Need: with a partner of size m, a document of size n shares at least T = ceil(percent * (n + m) / (100 + percent)), so
  for that pair only the first n - T + l of its prefix count.
* Verification is exact on the sets of the whole texts.

Cases: a text that is null or without words has the empty set and links with nothing; a text with
fewer words than ``width`` has one shingle, the whole sequence; equal sets are linked; rows that repeat a
document id are one document, linked if any of its texts is; a null id is a row of its own with a
null component; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlocus.llm.components import components
from gridlocus.llm.store import stored
from gridlocus.llm.textual import U64, Words, inside_one, mix, parts_of, shingles

DEAR = 16
COMMON = 8
COMMON_MOST = 1_000_000
BROADCAST_ROWS = 1_000_000
VERIFY_COST = 24
STAR_ROUNDS = 2
TOP = U64(1) << U64(63)


def shingle_sets(column: pa.Array, width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts on end, ascending in each text; offsets)."""
    words = Words(column, lower)
    h = words.hashes
    full = shingles(h, width)
    sets = []
    for a, b in pairwise(words.first.tolist()):
        if b - a >= width:
            sets.append(np.unique(full[a : b - width + 1]))
        else:
            sets.append(shingles(h[a:b], b - a) if b > a else h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def common_shingles(df: DataFrame, text: str, width: int, lower: bool) -> np.ndarray:
    """The most common shingles, at most ``COMMON_MOST``, ascending by count.  Repeats are counted within
    slices of the documents and summed, so a count is a lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, text, 4 << 20):
            tokens, counts = np.unique(shingle_sets(part.column(text), width, lower)[0], return_counts=True)
            more = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(tokens[more].view(np.int64)), pa.array(counts[more].astype(np.int64))], ["token", "n"])

    counted = stored(df.select(text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "common")
    histogram = sorted(((r["n"], r["m"]) for r in counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, room = COMMON, COMMON_MOST
    for n, m in histogram:
        room -= m
        if room < 0:
            least = n + 1
            break
    rows = counted.where(F.col("n") >= least).toArrow()
    order = np.lexsort((rows["token"].to_numpy(), rows["n"].to_numpy()))
    return rows["token"].to_numpy().view(U64)[order]


def lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix length at l = 1, largest l)."""
    t = (percent * n + 99) // 100
    base = n - t + 1
    return np.where(n > 0, base, 0), np.where(n > 0, np.minimum(t, 3 + base // 4), 0)


def prefixes(df: DataFrame, common: np.ndarray, key: str, text: str, width: int, percent: int, lower: bool) -> DataFrame:
    """A row per document: size and signature of its set, and its longest prefix in the global order."""
    spark = df.sparkSession
    ranked = np.argsort(common, kind="stable")
    shared = spark.sparkContext.broadcast((common[ranked], ranked.astype(U64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash, rank = shared.value
        for part in parts_of(batches, text):
            tokens, offsets = shingle_sets(part.column(text), width, lower)
            order = mix(tokens.copy()) >> U64(1)
            if len(by_hash) and len(tokens):
                at = np.minimum(np.searchsorted(by_hash, tokens), len(by_hash) - 1)
                found = by_hash[at] == tokens
                order[found] = TOP | rank[at[found]]
            n = np.diff(offsets)
            base, most = lengths(n, percent)
            keep = np.where(n > 0, base - 1 + most, 0)
            first, second = mix(tokens.copy()), mix(tokens ^ U64(0xA5A5A5A5A5A5A5A5))
            heads = []
            sums = np.zeros((2, len(n)), U64)
            for i, (a, b) in enumerate(pairwise(offsets.tolist())):
                mine = order[a:b]
                heads.append(tokens[a:b][np.argsort(mine, kind="stable")[: keep[i]]])
                sums[:, i] = first[a:b].sum(dtype=U64), second[a:b].sum(dtype=U64)
            flat = (np.concatenate(heads) if heads else tokens[:0]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(flat))],
                ["doc", "n", "s1", "s2", "prefix"])

    kind = df.schema[key].dataType.simpleString()
    return stored(df.select(key, text).mapInArrow(run, f"doc {kind}, n long, s1 long, s2 long, prefix array<long>"), "prefixes")


def chosen(repeated: DataFrame, percent: int) -> DataFrame:
    """Each document's choice of l applied to its repeated prefix shingles ``(doc, n, found: [(pos, token, df)])``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column("doc").to_pylist(), batch.column("n").to_numpy()
            found = batch.column("found")
            fields = found.flatten()
            pos, token, df = (fields.field(x).to_numpy() for x in ("pos", "token", "df"))
            bounds = found.offsets.to_numpy() - found.offsets[0].as_py()
            base, most = lengths(sizes, percent)
            out = [[], [], [], [], [], [], [], []]
            for i, (a, b) in enumerate(pairwise(bounds.tolist())):
                p, f = pos[a:b], df[a:b]
                l = np.arange(1, most[i] + 1)
                grown = base[i] - 1 + l
                order = np.argsort(p)
                upto = np.searchsorted(p[order], grown)
                dear = np.concatenate([[0], np.cumsum(f[order] > DEAR)])[upto]
                read = np.concatenate([[0], np.cumsum(np.where(f[order] > DEAR, 0, f[order] - 1))])[upto]
                r = l - dear
                cost = np.where(r > 0, read + VERIFY_COST * read / np.maximum(r, 1), np.inf)
                best = int(np.argmin(cost))
                is_open = not np.isfinite(cost[best])
                if is_open:
                    best = 0
                use = np.flatnonzero(p < grown[best]) + a
                out[0].extend([docs[i]] * len(use))
                out[1].append(np.full(len(use), sizes[i]))
                out[2].append(token[use])
                out[3].append(df[use] > DEAR)
                out[4].append(np.full(len(use), 1 if is_open else r[best]))
                out[5].append(np.full(len(use), is_open))
                out[6].append(pos[use].astype(np.int64))
                out[7].append(np.full(len(use), best + 1))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), *(pa.array(np.concatenate(x)) for x in out[1:])], ["doc", "n", "token", "dear", "r", "open", "pos", "l"])

    return repeated.mapInArrow(run, "doc long, n long, token long, dear boolean, r long, open boolean, pos long, l long")


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, width: int, percent: int, lower: bool, differences: bool = False) -> DataFrame:
    """The pairs (x, y) whose sets really are similar.  With ``differences`` all pairs come back, with ``linked``, the sizes
    nx and ny, and the members that only one set has, where these are fewer than either has (else null).  The pair
    list is broadcast to the scan of the texts while it is short; a longer one is joined by a shuffle."""
    short = pairs.count() <= BROADCAST_ROWS
    ends = pairs.select("x", "y", F.explode(F.array("x", "y")).alias("doc"))
    side = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    met = side.join(F.broadcast(ends) if short else ends, "doc")
    of = lambda c: F.collect_set(F.when(F.col("doc") == F.col(c), F.coalesce("text", F.lit("")))).alias("of_" + c)
    both = met.groupBy("x", "y").agg(of("x"), of("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = []
                for name in ("of_x", "of_y"):
                    lists = part.column(name)
                    tokens, offsets = shingle_sets(lists.flatten(), width, lower)
                    sets.append(([tokens[a:b] for a, b in pairwise(offsets.tolist())], lists.offsets.to_numpy() - lists.offsets[0].as_py()))
                (xs, xo), (ys, yo) = sets
                good, sizes, apart = [], [[], []], []
                for i in range(part.num_rows):
                    ours, theirs = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                    good.append(any(similar(p, q, percent) for p in ours for q in theirs))
                    if differences:
                        p, q = ours[0], theirs[0]
                        only = np.setxor1d(p, q, assume_unique=True) if len(ours) == len(theirs) == 1 else None
                        sizes[0].append(len(p))
                        sizes[1].append(len(q))
                        apart.append(only.view(np.int64) if only is not None and len(only) < min(len(p), len(q)) else None)
                out = [part.column("x"), part.column("y")]
                if differences:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(good, pa.bool_()), *(pa.array(n, pa.int64()) for n in sizes), pa.array(apart, pa.list_(pa.int64()))], ["x", "y", "linked", "nx", "ny", "apart"])
                else:
                    yield pa.RecordBatch.from_arrays(out, ["x", "y"]).filter(pa.array(good, pa.bool_()))

    more = ", linked boolean, nx long, ny long, apart array<long>" if differences else ""
    return stored(both.mapInArrow(run, "x long, y long" + more), "links")


def star_members(stars: DataFrame) -> DataFrame:
    """(doc, pivot, n, d, apart): the documents of each star whose difference from the pivot is known, d its size, and the pivot."""
    known = stars.where("apart is not null")
    one = known.select(F.col("doc"), "pivot", F.when(F.col("doc") == F.col("x"), F.col("nx")).otherwise(F.col("ny")).alias("n"), F.size("apart").alias("d"), "apart")
    centre = known.groupBy("pivot").agg(F.first(F.when(F.col("pivot") == F.col("x"), F.col("nx")).otherwise(F.col("ny"))).alias("n"))
    return one.unionByName(centre.select(F.col("pivot").alias("doc"), "pivot", "n", F.lit(0).alias("d"), F.array().cast("array<bigint>").alias("apart")))


def links_without_shared(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): links that connect every two similar members of a star whose differences from the pivot have nothing in common.

    The difference of such two is d_x + d_y, and they are similar if (100 + percent) times it is at most (100 - percent) (n_x + n_y).
    Then both are similar to the member with the least slack (100 + percent) d - (100 - percent) n."""
    up, down = 100 + percent, 100 - percent
    slack = members.select("pivot", "doc", (up * F.col("d") - down * F.col("n")).alias("slack"))
    least = slack.groupBy("pivot").agg(F.min(F.struct("slack", "doc")).alias("m"))
    close = slack.join(least, "pivot").where("slack + m.slack <= 0 and doc <> m.doc")
    return close.select(F.least("doc", "m.doc").alias("x"), F.greatest("doc", "m.doc").alias("y"))


def links_within_stars(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): the similar pairs of members of a star with different labels, found from differences alone.  Members that are similar
    without sharing anything in their differences must have one label.

    With d the difference from the pivot, the difference of x and y is |d_x| + |d_y| - 2 |d_x and d_y|, and at most
    D = (100 - percent) (n_x + n_y) div (100 + percent) if they are similar.  So they share at least S = ceil((|d_x| + |d_y| - D) / 2) tokens
    of their differences, all of which members of different labels share.  With e_x and e_y such tokens they meet in the first e_x - S + 1
    and e_y - S + 1 of them in any common order; rare ones come first.  A member with more than (100 - percent) n div percent
    other tokens in its difference is similar to none."""
    up, down = 100 + percent, 100 - percent
    mixed = members.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("pivot")
    rows = members.join(mixed, "pivot").select("pivot", "doc", "label", "n", "d", F.explode("apart").alias("token"))
    often = rows.groupBy("pivot", "token").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("pivot", "token", "m")
    # each difference in ascending order of how many members share its tokens
    mine = Window.partitionBy("pivot", "doc")
    shared = rows.join(often, ["pivot", "token"]).withColumn("at", F.row_number().over(mine.orderBy("m", "token"))).withColumn("e", F.count("*").over(mine))
    shared = stored(shared.where(f"(d - e) * {percent} <= {down} * n").select("pivot", "token", "doc", "label", "n", "d", "e", "at"), "differences")
    a, b = shared.alias("a"), shared.alias("b")
    most = f"({down} * (a.n + b.n)) div {up}"
    least = f"(a.d + b.d - {most} + 1) div 2"
    met = a.join(b, F.expr(f"""a.pivot = b.pivot and a.token = b.token and a.label <> b.label and a.doc < b.doc and abs(a.n - b.n) <= {most}
        and a.at <= a.e - {least} + 1 and b.at <= b.e - {least} + 1"""))
    pairs = stored(met.select("a.pivot", F.col("a.doc").alias("x"), F.col("b.doc").alias("y")).distinct(), "candidates")
    side = lambda c: members.select("pivot", F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("apart").alias(f"apart_{c}"))
    both = pairs.join(side("x"), ["pivot", "x"]).join(side("y"), ["pivot", "y"])
    differ = F.size("apart_x") + F.size("apart_y") - 2 * F.size(F.array_intersect("apart_x", "apart_y"))
    return stored(both.where(up * differ <= down * (F.col("nx") + F.col("ny"))).select("x", "y"), "links")


def size_class(column: str, percent: int, shift: float) -> Column:
    """Sizes of one class are similar enough for a link; another shift has other limits between classes."""
    return F.col(column) if percent >= 100 else F.floor(F.log(column) / math.log(100 / percent) + shift)


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if not len(p) or not len(q) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    merged = np.concatenate([p, q])
    merged.sort()
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (len(merged) - shared)


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest id reachable by links."""
    df = df.withColumn(key, F.col(key).cast("long"))
    with_id = df.where(F.col(key).isNotNull())
    sets = prefixes(df, common_shingles(df, text, width, lower), key, text, width, percent, lower)
    classes = stored(sets.where("doc is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep")), "classes")
    heads = sets.where("n > 0").join(classes.select(F.col("rep").alias("doc"), "n", "s1", "s2"), ["doc", "n", "s1", "s2"]).dropDuplicates(["doc", "n", "s1", "s2"])
    entries = stored(heads.select("doc", "n", F.posexplode("prefix").alias("pos", "token")), "entries")
    counts = stored(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    repeated = entries.join(counts, "token").groupBy("doc", "n").agg(F.collect_list(F.struct("pos", "token", "df")).alias("found"))
    buckets = stored(chosen(repeated, percent), "buckets")

    labelled = lambda rows, groups: rows.join(groups, rows.doc == groups.node, "left").select(*rows.columns, F.coalesce("label", "doc").alias("label"))
    links, members, rays = None, None, None
    named = buckets.withColumn("label", F.col("doc"))
    for turn in range(STAR_ROUNDS):  # each document with one document of about its size, of the buckets that are not of one component
        sized = named.withColumn("sized", size_class("n", percent, turn / STAR_ROUNDS))
        heads = sized.groupBy("token", "sized").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("pos", F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n")).alias("p"))
        heads = stored(heads.where("lo < hi"), "heads")
        near = F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent
        met = sized.join(heads.select("token", "sized", "p"), ["token", "sized"]).where("doc <> p.doc").where(near)
        met = met.groupBy("doc", F.col("p.doc").alias("pivot")).agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        if rays is not None:
            met = met.join(rays, ["doc", "pivot"], "left_anti")
        enough = F.col("shared") * 4 >= F.col("n") * (100 - percent) / 100
        best = met.where(enough).groupBy("doc").agg(F.max(F.struct("shared", "pivot")).alias("b"))
        rays = stored(best.select("doc", F.col("b.pivot").alias("pivot")), "rays")
        ends = [F.least("doc", "pivot").alias("x"), F.greatest("doc", "pivot").alias("y")]
        compared = verified(stored(rays.select(*ends).distinct(), "pairs"), with_id, key, text, width, percent, lower, differences=True)
        joined = stored(star_members(rays.select("doc", "pivot", *ends).join(compared, ["x", "y"])), "members")
        # a star that two rounds have in common is one
        members = joined if members is None else members.unionByName(joined.join(members.select("doc", "pivot"), ["doc", "pivot"], "left_anti"))
        found = compared.where("linked").select("x", "y").unionByName(links_without_shared(members, percent))
        links = found if links is None else links.unionByName(found)
        groups = stored(components(links), "groups")
        named = labelled(buckets, groups)

    links = links.unionByName(links_within_stars(labelled(members, groups), percent))
    # every pair that is still apart and in no common star
    apart = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("open").alias("any_open"), F.max("dear").alias("is_dear")).where("lo < hi")
    left = named.join(stored(apart.where("any_open or not is_dear").select("token"), "apart"), "token")
    left = left.join(stored(members.groupBy("doc").agg(F.collect_set("pivot").alias("stars")), "stars"), "doc", "left")
    left = stored(left.withColumn("stars", F.coalesce("stars", F.array().cast("array<bigint>"))), "left")
    a, b = left.alias("a"), left.alias("b")
    both = f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"
    met = a.join(b, F.expr(f"""a.token = b.token and a.doc < b.doc and a.label <> b.label and (not a.dear or a.open or b.open)
        and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} and a.pos < a.n - {both} + a.l and b.pos < b.n - {both} + b.l
        and not arrays_overlap(a.stars, b.stars)"""))
    counted = met.groupBy(F.col("a.doc").alias("x"), F.col("b.doc").alias("y")).agg(F.count("*").alias("shared"), F.min(F.least("a.r", "b.r")).alias("needed"))
    pairs = stored(counted.where("shared >= needed").select("x", "y"), "pairs")
    links = links.unionByName(verified(pairs, with_id, key, text, width, percent, lower))
    groups = stored(components(links), "groups")

    placed = classes.join(groups, classes.rep == groups.node, "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component"))
    rows = sets.select("doc", "n", "s1", "s2")
    joined = rows.join(placed, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc"))
    return joined.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """The table without the documents that belong to a group and are not its smallest id.  Of rows that
    repeat an id one stays (the least text); rows without an id all stay."""
    groups = stored(similar_documents(df, key, text, width, percent, lower), "membership")
    known = groups.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("m"), F.min("component_id").alias("c"))
    gone, repeated = known.where(F.col("c") != F.col(key)).select(key), known.where((F.col("c") == F.col(key)) & (F.col("m") > 1)).select(key)
    order = Window.partitionBy(key).orderBy(text)
    again = df.join(repeated, key, "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return df.join(gone.unionByName(repeated), key, "left_anti").unionByName(again.select(df.columns))
