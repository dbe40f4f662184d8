"""Benchmark items found in documents, with edits, by pigeonhole pieces and Myers' bit-parallel distance.

Texts are compared as words: Unicode lower case, cut at ASCII characters that are no letter or digit.  An item of n
words may differ by k = n * percent // 100 word edits (insertions, deletions, replacements).  It is split into k + 1 pieces of
consecutive words; an occurrence with at most k edits leaves a piece untouched, so every occurrence shows at least one exact
piece hit.  Hits are found for all pieces of a length at once on hashes of the document's words; the stretch
around each hit is verified by Myers' algorithm over words, which gives the least number of edits of the whole item.

Items come to the tasks in blocks of about ``block_words`` words, a bound that does not grow with either table; a larger
benchmark is worked off block by block, each against all documents.

Cases: null or empty documents hold nothing; a null item or one without words is found nowhere; an item of
fewer than 100 / percent words must occur unchanged; repeated documents or items give one row per pair of ids with the
least distance; ties take the first place; empty tables give an empty table; other columns are ignored."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlocus.llm.textual import U64, Words, inside_one, parts_of, shingles

PERCENT = 20
BLOCK_WORDS = 200_000
#: Bytes between words: ASCII characters that are no letter or digit.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SIEVE = (1 << 22) - 1


def normal_words(column: pa.Array) -> Words:
    return Words(pc.utf8_lower(column.fill_null("")), separators=BETWEEN)


def pieces_of(n: int, k: int) -> list[tuple[int, int]]:
    """(first word, words) of k + 1 pieces of n words, as even as can be."""
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def best_end(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edits between the whole item and a stretch of the text, words of the text up to its end)."""
    n = len(item)
    equal: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        equal[word] |= 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = (n, 0)
    for j, word in enumerate(text):
        eq = equal.get(word, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(across | up)) & full
        minus = up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = (plus << 1) & full  # a match may begin at any word
        minus = (minus << 1) & full
        eq |= down
        up = (minus | ~(eq | plus)) & full
        down = plus & eq
        if score < best[0]:
            best = (score, j + 1)
    return best


class Items:
    """A block of items: word hashes, and pieces by length."""

    def __init__(self, ids: list, texts: pa.Array, percent: int):
        words = normal_words(texts)
        self.ids, self.hashes, self.budgets = [], [], []
        by_length = defaultdict(list)
        for i, item_id in enumerate(ids):
            h = words.hashes[words.first[i] : words.first[i + 1]]
            if not len(h):
                continue
            k = len(h) * percent // 100
            for at, size in pieces_of(len(h), k):
                by_length[size].append((int(shingles(h[at : at + size], size)[0]), len(self.ids), at))
            self.ids.append(item_id)
            self.hashes.append(h.tolist())
            self.budgets.append(k)
        self.pieces = {}
        for size, found in by_length.items():
            found.sort()
            keys = np.array([x[0] for x in found], U64)
            sieve = np.zeros(SIEVE + 1, bool)
            sieve[(keys & U64(SIEVE)).astype(np.int64)] = True
            self.pieces[size] = (keys, np.array([x[1] for x in found]), np.array([x[2] for x in found]), sieve)

    def hits(self, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """(item number, word at which the item would begin) of all exact piece hits, per piece length."""
        out = []
        for size, (keys, items, at, sieve) in self.pieces.items():
            h = shingles(words.hashes, size)
            maybe = np.flatnonzero(sieve[(h & U64(SIEVE)).astype(np.int64)])
            maybe = maybe[inside_one(words.first, size)[maybe]]
            low, high = np.searchsorted(keys, h[maybe]), np.searchsorted(keys, h[maybe], "right")
            for j in range(int((high - low).max()) if len(maybe) else 0):
                more = low + j < high
                out.append((items[low[more] + j], maybe[more] - at[low[more] + j], maybe[more]))
        return out

    def matches(self, words: Words) -> list[tuple[int, object, int, int]]:
        """(text number, item id, edits, word after the occurrence) of the best occurrence in each text."""
        found = self.hits(words)
        if not found:
            return []
        item, begin, seen = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(words.first, seen, "right") - 1
        order = np.lexsort((begin, item, doc))
        out, hashes = [], words.hashes
        groups = np.flatnonzero(np.diff(doc[order]) | np.diff(item[order])) + 1
        for part in np.split(order, groups):
            d, i = int(doc[part[0]]), int(item[part[0]])
            n, k = len(self.hashes[i]), self.budgets[i]
            first, last = int(words.first[d]), int(words.first[d + 1])
            best = None
            stretch = None
            for b in [*begin[part].tolist(), None]:
                if stretch and (b is None or b - k > stretch[1]):
                    score, end = best_end(self.hashes[i], hashes[stretch[0] : stretch[1]].tolist())
                    if score <= k and (best is None or score < best[0]):
                        best = (score, stretch[0] + end - first)
                    stretch = None
                if b is not None:
                    lo, hi = max(first, b - k), min(last, b + n + k)
                    stretch = (stretch[0], hi) if stretch else (lo, hi)
            if best:
                out.append((d, self.ids[i], *best))
        return out


def item_blocks(benchmark: DataFrame, item_key: str, item_text: str, percent: int, block_words: int) -> Iterator[tuple[Items, pa.DataType]]:
    """The items in blocks of bounded size, one after the other."""
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0  # a word has a character and one between
    blocks = max(1, -(-size // (2 * block_words)))
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        texts = held["text"].combine_chunks()
        yield Items(held["item"].to_pylist(), texts, percent), held.schema.field("item").type


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item_key, distance, end_word): the documents that hold an item within its budget of edits, with the least
    number of edits and the number of document words up to the end of that occurrence."""
    kinds = documents.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, distance long, end_word long"

    def search(items: Items, kind: pa.DataType) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts_of(batches, text):
                found = shared.value.matches(normal_words(part.column(text)))
                docs = part.column(key).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([x[1] for x in found], kind), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())],
                    ["doc", "item", "distance", "end_word"])

        return documents.select(key, text).mapInArrow(run, schema)

    rows = reduce(DataFrame.unionByName, [search(*block) for block in item_blocks(benchmark, item_key, item_text, percent, block_words)])
    best = rows.groupBy("doc", "item").agg(F.min(F.struct("distance", "end_word")).alias("m"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), "m.distance", "m.end_word")


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item within its budget of edits, by one pass over them per block."""

    def keep(rows: DataFrame, items: Items) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts_of(batches, text):
                clean = np.ones(part.num_rows, bool)
                clean[[x[0] for x in shared.value.matches(normal_words(part.column(text)))]] = False
                yield part.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    return reduce(keep, (items for items, _ in item_blocks(benchmark, item_key, item_text, percent, block_words)), documents)
