"""How far the sources of a language differ in their use of words.

In-mapper stripes: every task folds whole documents into a hash of term -> stripe, the stripe holding
for each source the term's occurrences and documents.  A full hash is spilled as rows, one a stripe;
one shuffle brings the stripes of a term together, where they are added up entry by entry.  Terms in
too few documents go; the merged stripes of the others directly emit what each adds to the divergence
of every pair of sources, summed inside the task before the one small shuffle of pair sums.

A share p is 1 + floor(10^9 * (count + 5) / (N + 5 * V)), computed exactly by long division, three digits at a time
(so the occurrences of a language must stay below 9 * 10^15).

Cases: null text, language and source are ''; an empty text has no terms but its group exists; repeated
rows count again; an empty table gives no rows; a language without kept terms has only pair rows, of
value 0; a language of one source has no pair rows; other columns are ignored, whatever their names.
A very long text is a slice of its own and one document.  Each language's sources are held in one
array per row: the pair rows are already the square of their number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlocus.llm.folding import Fold
from gridlocus.llm.store import stored
from gridlocus.llm.textual import Words, binary_array, parts_of, ragged

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: every byte below 0x80 that is no letter separates terms.
NO_TERM = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
SCALE_STEPS, SCALE_STEP = 3, 1000  # 1000 ** 3 = 10 ** 9
SMOOTH = 5
TOP_TERMS = 50
CELLS = 2_000_000  # of a term x source matrix, and of pair sums held
STRIPES = "lang string, term binary, stripe array<struct<source: string, n: long, docs: long>>"


def slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of a slice; the empty term counts the documents of each group."""
    lang, source, n_docs = lang.fill_null("").cast(pa.string()), source.fill_null("").cast(pa.string()), len(text)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    w = Words(text, lower=True, separators=NO_TERM)
    lengths = w.ends - w.starts
    coded = binary_array(w.data[ragged(w.starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    size = max(1, len(coded.dictionary))
    in_docs, n = np.unique(w.doc_of_words() * size + coded.indices.to_numpy(), return_counts=True)
    key = group[in_docs // size] * size + in_docs % size
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n, head) if len(head) else n
    docs = np.diff(np.append(head, len(key)))
    groups, group_docs = np.unique(group, return_counts=True)
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(key[head] % size)), pa.array([b""] * len(groups), pa.binary())])
    at = np.concatenate([key[head] // size, groups])
    return pa.table({
        "lang": langs.dictionary.take(pa.array(at // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(at % len(sources.dictionary))),
        "term": terms, "n": np.concatenate([sums, np.zeros(len(groups), np.int64)]).astype(np.int64), "docs": np.concatenate([docs, group_docs]).astype(np.int64)})


def stripes_of(rows: pa.Table, at_once: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Combined rows as stripes, one row per (lang, term)."""
    rows = rows.sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
    lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
    lang, term = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lang, term))
    same = np.logical_and(*[pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) for x in (lang, term)])
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(term)]])
    entries = pa.StructArray.from_arrays([rows[c].combine_chunks() if not isinstance(rows[c].combine_chunks(), pa.ChunkedArray) else rows[c].combine_chunks().chunk(0) for c in ("source", "n", "docs")], ["source", "n", "docs"])
    for a in range(0, len(heads) - 1, at_once):
        cuts = heads[a : min(a + at_once, len(heads) - 1) + 1]
        lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), entries.slice(cuts[0], cuts[-1] - cuts[0]))
        first = pa.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([lang.take(first), term.take(first), lists], ["lang", "term", "stripe"])


def term_stripes(df: DataFrame, min_docs: int = 30, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, docs, stripe): merged stripes of the terms in at least ``min_docs`` documents of their language, and
    for every language the stripe of the empty term, which lists all its sources."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Fold(["lang", "term", "source"], ["n", "docs"])
        for part in parts_of(batches, "text"):
            for full in held.add(slice_counts(part.column("lang"), part.column("source"), part.column("text"))):
                yield from stripes_of(full)
        for full in held.rest():
            yield from stripes_of(full)

    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    spilled = rows.mapInArrow(fold, STRIPES).repartition("lang", "term")
    entries = spilled.select("lang", "term", F.explode("stripe").alias("e")).groupBy("lang", "term", "e.source").agg(F.sum("e.n").alias("n"), F.sum("e.docs").alias("docs"))
    merged = entries.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))
    return merged.where((F.col("docs") >= min_docs) | (F.col("term") == F.lit(b"")))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 5) / totals) without overflow; ``totals`` are N + 5 * V."""
    if totals.size and totals.max() > 9_000_000_000_000_000:
        raise OverflowError("too many occurrences for exact 64-bit division")
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts + SMOOTH
    for _ in range(SCALE_STEPS):
        quotient, rest = np.divmod(rest * SCALE_STEP, totals)
        out = out * SCALE_STEP + quotient
    return out + 1


class Emitter:
    """Pair sums and term differences of the stripes that one task sees."""

    def __init__(self):
        self.pairs: dict[str, tuple[list[str], np.ndarray]] = {}

    def language(self, lang: str, groups: list[dict], terms: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sources = [g["source"] for g in groups]
        number = {s: i for i, s in enumerate(sources)}
        totals = np.array([g["n"] for g in groups], np.int64) + SMOOTH * terms
        if lang not in self.pairs:
            if self.pairs and sum(x.size for _, x in self.pairs.values()) + len(sources) ** 2 > CELLS:
                yield from self.flush()
            self.pairs[lang] = sources, np.zeros((len(sources), len(sources)), np.int64)
        sums = self.pairs[lang][1]
        step = max(1, CELLS // max(1, len(sources)))
        real = np.flatnonzero(pc.not_equal(rows.column("term"), b"").to_numpy(zero_copy_only=False))
        for a in range(0, len(real), step):
            some = rows.take(pa.array(real[a : a + step]))
            stripe, term = some.column("stripe"), some.column("term")
            entries = stripe.flatten()
            coded = entries.field("source").dictionary_encode()
            column = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(some)), pc.list_value_length(stripe).to_numpy())
            counts = np.zeros((len(some), len(sources)), np.int64)
            counts[row, column] = entries.field("n").to_numpy()
            p = shares(counts, totals)
            for i in range(len(sources) - 1):
                sums[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(0)
            whole = shares(counts.sum(1), np.array([totals.sum() - SMOOTH * terms * (len(sources) - 1)]))
            at_row, at_source = np.nonzero((counts > 0) & (p > whole[:, None]))
            yield self.batch(lang, "term", pa.array(sources, pa.string()).take(pa.array(at_source)), term.take(pa.array(at_row)), (p - whole[:, None])[at_row, at_source])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, (sources, sums) in self.pairs.items():
            names, first, second = pa.array(sources, pa.string()), *np.triu_indices(len(sources), 1)
            for a in range(0, len(first), CELLS):
                i, j = first[a : a + CELLS], second[a : a + CELLS]
                yield self.batch(lang, "pair", names.take(pa.array(i)), names.take(pa.array(j)).cast(pa.binary()), sums[i, j])
        self.pairs = {}

    @staticmethod
    def batch(lang: str, part: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), pa.array([part] * len(item), pa.string()), source, item, pa.array(value)], ["lang", "part", "source", "item", "value"])


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    emitter = Emitter()
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            at = np.flatnonzero(coded.indices.to_numpy() == i)
            rows = batch.take(pa.array(at))
            yield from emitter.language(lang, rows.column("groups")[0].as_py(), rows.column("terms")[0].as_py(), rows)
    yield from emitter.flush()


def source_divergence(df: DataFrame, min_docs: int = 30, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).  Part `pair`: the summed differences of the shares of all kept terms to each
    other source of the language.  Part `term`: the ``top`` terms whose share in the source exceeds that in the language most."""
    kept = stored(term_stripes(df, min_docs, text, lang, source), "stripes")
    per_source = kept.select("lang", "term", F.explode("stripe").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("n"))
    groups = per_source.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    terms = kept.groupBy("lang").agg(F.count_if(F.col("term") != F.lit(b"")).alias("terms"))
    totals = stored(groups.join(terms, "lang"), "source-totals")  # a row per language: the planner sees its size
    found = stored(kept.select("lang", "term", "stripe").join(totals, "lang").mapInArrow(emit, "lang string, part string, source string, item binary, value long"), "divergence")
    found = found.withColumn("item", F.col("item").cast("string"))
    one_way = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = one_way.select("lang", "value", both.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
