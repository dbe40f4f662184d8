"""Removal of long passages that already occur in a document with a smaller id.

Every word covered by a window of ``width`` consecutive words goes if the same window starts in a
document with a smaller id; windows are judged on the input.

1. Fingerprints.  Of every ``width - gram + 1`` consecutive word grams the one with the least hash is
   kept (a choice that depends on the window's words alone), so two equal windows keep the same one.  Equal
   word sequences are found first: all but the smallest id lose everything.
2. Windows whose fingerprint occurs in two documents are hashed whole, and the first document and place of
   every such window is found by a minimum.  The places at which windows occur first, cut into shards of at
   most ``shard`` words, are the reference; every other document's run of windows is sent to the shards it may match.
3. Each reference shard becomes a suffix automaton; the runs sent to it are streamed through it for their matching
   statistics, and the maximal stretches that match for at least ``width`` words are removed.

The reference is all earlier text and grows with the corpus, so automata of all of it cannot be broadcast to all
tasks; step 2 sends each bounded shard only to the rows that need it (a join, whose hot keys are split).
Hashes only choose what is compared; what is removed is decided by the automata on the words.

Cases: a null text has no words and stays null; a text shorter than ``width`` words keeps them all;
rows that repeat an id do not count against each other; a null id is left alone and removes nothing; an empty
table gives an empty table; other columns are kept (``n_words`` and ``n_removed`` of the input are replaced)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridlocus.llm.store import stored
from gridlocus.llm.textual import Words, inside_one, parts_of, shingles

SHARD = 2000
BROADCAST_ROWS = 500_000


# ---- fingerprints ------------------------------------------------------------
def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(h) < width:
        return h[:0]
    size, low = 1, h
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def window_prints(words: Words, width: int, gram: int) -> np.ndarray:
    """The fingerprint of the window at every word (meaningless where it leaves the text)."""
    return least_of(shingles(words.hashes, gram), width - gram + 1)


def joined_words(words: Words) -> tuple[bytes, np.ndarray]:
    """All words, one space after each, and where each text begins in that."""
    lengths = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(total[-1]), 0x20, np.uint8)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    # a word may begin where the one of the text before ends
    mask = np.cumsum(inside[:-1]) > 0
    spot = np.ones(len(out), bool)
    spot[total[1:] - 1] = False
    out[spot] = words.data[mask]
    return out.tobytes(), total[words.first]


def fingerprints(df: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "text"):
            words = Words(part.column("text"))
            low = window_prints(words, width, gram)
            flat, at = joined_words(words)
            prints = [np.unique(low[a : max(a, b - width + 1)]) for a, b in pairwise(words.first.tolist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prints])]).astype(np.int32)
            same = pa.array([hashlib.sha1(flat[a:b]).digest() for a, b in pairwise(at.tolist())], pa.binary())
            values = (np.concatenate(prints) if prints else low[:0]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("sig"), pa.array(words.counts), same, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc", "sig", "n", "same", "prints"])

    return stored(df.mapInArrow(run, "doc long, sig long, n long, same binary, prints array<long>"), "prints")


# ---- windows -----------------------------------------------------------------
def candidate_runs(df: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs of windows whose fingerprint is in ``found``: place, words and window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "text"):
            words = Words(part.column("text"))
            low, full = window_prints(words, width, gram), shingles(words.hashes, width)
            ok = inside_one(words.first, width)
            flat, _ = joined_words(words)
            at = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
            wanted, bounds = part.column("found").flatten().to_numpy().view(np.uint64), part.column("found").offsets.to_numpy()
            bounds = bounds - bounds[0]
            docs, sigs = part.column("doc").to_numpy(), part.column("sig").to_numpy()
            out = [[], [], [], [], []]
            for i, (a, b) in enumerate(pairwise(words.first.tolist())):
                b = min(b, len(full))
                hit = np.isin(low[a:b], wanted[bounds[i] : bounds[i + 1]]) & ok[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    for x, value in zip(out, (docs[i], sigs[i], s, flat[at[a + s] : at[a + e + width - 1] - 1].decode(errors="replace"), full[a + s : a + e].view(np.int64))):
                        x.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))], ["doc", "sig", "start", "words", "windows"])

    return stored(df.mapInArrow(run, "doc long, sig long, start long, words string, windows array<long>"), "runs")


def placed_runs(df: DataFrame, width: int, shard: int) -> DataFrame:
    """Rows for the shards: the words of a shard's own document (``doc`` is null), and of the documents to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for row in batch.to_pylist():
                words = row["words"].split(" ")
                mine = (row["doc"], row["sig"])
                last = None
                for w in sorted(row["firsts"], key=lambda w: w["i"]):
                    i, own = w["i"], (w["doc"], w["sig"]) == mine
                    if own and w["p"] != row["start"] + i or not own and w["doc"] == mine[0]:
                        continue  # seen before in this document only
                    to = (own, w["doc"], w["sig"], w["p"] // shard)
                    if last and last[0] == to and last[2] == i - 1:
                        last[2] = i
                    else:
                        if last:
                            add(out, row, words, last, width)
                        last = [to, i, i]
                if last:
                    add(out, row, words, last, width)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    def add(out, row, words, last, width):
        (own, doc, sig, number), a, b = last
        for x, value in zip(out, (doc, sig, number, None if own else row["doc"], row["sig"], row["start"] + a, " ".join(words[a : b + width]))):
            x.append(value)

    names = ["src", "src_sig", "shard", "doc", "sig", "start", "words"]
    return stored(df.mapInArrow(run, "src long, src_sig long, shard long, doc long, sig long, start long, words string"), "placed")


# ---- suffix automata ---------------------------------------------------------
class SuffixAutomaton:
    """All substrings of a few word sequences, with transitions on words."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for number, sequence in enumerate(sequences):
            for word in sequence:
                last = self.extend(last, word)
            last = self.extend(last, number)  # a symbol that no text holds ends the sequence

    def extend(self, last: int, word) -> int:
        nexts, links, lengths = self.next, self.link, self.length
        new = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = links[at]
        if at >= 0:
            to = nexts[at][word]
            if lengths[to] == lengths[at] + 1:
                links[new] = to
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[to]))
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                while at >= 0 and nexts[at].get(word) == to:
                    nexts[at][word] = twin
                    at = links[at]
                links[to] = links[new] = twin
        return new

    def spans(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of words that lie in matches of at least ``least`` words."""
        nexts, links, lengths = self.next, self.link, self.length
        at = held = 0
        out: list[list[int]] = []
        for i, word in enumerate(words):
            while at and word not in nexts[at]:
                at = links[at]
                held = lengths[at]
            if word in nexts[at]:
                at = nexts[at][word]
                held += 1
            if held >= least:
                if out and out[-1][1] >= i + 1 - least:
                    out[-1][1] = i + 1
                else:
                    out.append([i + 1 - least, i + 1])
        return [tuple(x) for x in out]


def matched(df: DataFrame, width: int) -> DataFrame:
    """Spans of each run that its shard contains: (doc, sig, spans: [(a, b)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for batch in batches:
            out = [[], [], []]
            for src, sig, number, reference, doc, dsig, start, words in zip(*(batch.column(x).to_pylist() for x in ("src", "src_sig", "shard", "reference", "doc", "sig", "start", "words"))):
                if key != (src, sig, number):
                    key, held = (src, sig, number), SuffixAutomaton([x.split(" ") for x in reference])
                if found := held.spans(words.split(" "), width):
                    for x, value in zip(out, (doc, dsig, [{"a": a + start, "b": b + start} for a, b in found])):
                        x.append(value)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), kind))], ["doc", "sig", "spans"])

    return df.mapInArrow(run, "doc long, sig long, spans array<struct<a: long, b: long>>")


# ---- the operator ------------------------------------------------------------
def repeated_spans(df: DataFrame, width: int = 50, gram: int = 20, shard: int = SHARD) -> DataFrame:
    """(doc, sig, spans) of the rows (doc, sig, text) that lose words."""
    prints = fingerprints(df.where("doc is not null"), width, gram)
    classes = prints.groupBy("same").agg(F.min("doc").alias("head"), F.count("*").alias("m"))
    copies = prints.join(classes.where("m > 1"), "same").where(f"doc > head and n >= {width}")
    copies = stored(copies.select("doc", "sig", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans")).distinct(), "copies")
    heads = prints.join(classes.select("same", F.col("head").alias("doc")), ["same", "doc"])
    entries = heads.select("doc", "sig", F.explode("prints").alias("print"))
    # the small sides are tables of their own, so that a hot print or window is a join key the planner can split
    often = stored(entries.groupBy("print").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("print"), "often")
    found = stored(entries.join(often, "print").groupBy("doc", "sig").agg(F.collect_set("print").alias("found")), "found")
    runs = candidate_runs(df.join(found, ["doc", "sig"]), width, gram)
    windows = runs.select("doc", "sig", "start", F.posexplode("windows").alias("i", "h"))
    place = F.struct("doc", "sig", (F.col("start") + F.col("i")).alias("p"))
    firsts = stored(windows.groupBy("h").agg(F.min(place).alias("first"), F.max("doc").alias("hi")).where("first.doc < hi").select("h", "first"), "firsts")
    with_first = windows.join(firsts, "h").groupBy("doc", "sig", "start").agg(F.collect_list(F.struct("i", "first.doc", "first.sig", "first.p")).alias("firsts"))
    placed = placed_runs(with_first.join(runs.select("doc", "sig", "start", "words"), ["doc", "sig", "start"]), width, shard)
    reference = placed.where("doc is null").groupBy("src", "src_sig", "shard").agg(F.collect_set("words").alias("reference"))
    queries = placed.where("doc is not null").join(reference, ["src", "src_sig", "shard"])
    spans = matched(queries, width).unionByName(copies)
    return stored(spans.groupBy("doc", "sig").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, gram: int = 20, shard: int = SHARD) -> DataFrame:
    """The table with the repeated words cut out of ``text``, and ``n_words`` and ``n_removed``.  A cut
    goes from the first removed word to the next kept one, so kept words keep the space before them."""
    df = df.drop(*[c for c in df.columns if c in ("n_words", "n_removed")])
    spans = repeated_spans(df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("sig"), F.col(text).alias("text")), width, gram, shard)
    short = (spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    side = spans.select(F.col("doc").alias("__doc"), F.col("sig").alias("__sig"), F.col("spans").alias("__spans"))
    side = F.broadcast(side) if short else side
    both = df.join(side, (F.col(key).cast("long") == F.col("__doc")) & (F.xxhash64(text) == F.col("__sig")), "left").drop("__doc", "__sig")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, text):
            words = Words(part.column(text))
            lists = part.column("__spans")
            texts = part.column(text)
            removed = np.zeros(part.num_rows, np.int64)
            if lists.null_count < len(lists):
                changed = texts.to_pylist()
                for i, cuts in enumerate(lists.to_pylist()):
                    if not cuts:
                        continue
                    a, b = words.first[i], words.first[i + 1]
                    gone = np.zeros(b - a + 1, np.int32)
                    np.add.at(gone, [x["a"] for x in cuts], 1)
                    np.add.at(gone, [x["b"] for x in cuts], -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    removed[i] = gone.sum()
                    stops = np.append(words.starts[a + 1 : b], words.offsets[i + 1])  # up to the next word
                    keep = ~gone
                    head = words.data[words.offsets[i] : words.starts[a]].tobytes()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
                    changed[i] = (head + b"".join(words.data[words.starts[a + s] : stops[e - 1]].tobytes() for s, e in zip(edges[::2], edges[1::2]))).decode(errors="replace")
                texts = pa.array(changed, texts.type)
            columns = [texts if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.counts), pa.array(removed)], [*names, "n_words", "n_removed"])

    schema = StructType([*df.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return both.mapInArrow(run, schema)
