"""Token counts of a byte-level BPE vocabulary without tokens.

A piece of text that is itself a vocabulary string mostly is one token, but not always: the merges
may never reach it.  So it is proved beforehand, once per vocabulary: every vocabulary string goes
through the merges alone, and those that end as one token are *whole*.  While counting, a distinct
piece that is whole counts one by a set lookup; only the other pieces are merged, for their number
of tokens alone, and remembered in a cache of bounded size.

Pieces are cut by codepoint classes (``byte_bpe.cut``).  Where the library gives a codepoint another
class than the table used here (other Unicode version), texts that hold it are counted by the library.

Special strings inside texts are one token each, as the library has it by default.  If the file has
one added token without strip or word flags, texts are split at it; otherwise texts that hold an
added token's string are counted by the library.

Cases: a null text has 0 bytes and 0 tokens, as an empty one; rows are independent, so repeated rows
repeat their result and null keys stay; an empty table gives an empty table; other columns are
ignored, whatever their names; a very long text is a slice of its own, a very long piece is merged
by a heap in n log n steps.  Bytes that are not UTF-8 are read as U+FFFD."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.llm.byte_bpe import LETTER, NUMBER, OTHER, QUOTE, WHITE, cut, symbol_table
from gridlocus.llm.textual import binary_array, parts_of, text_bytes

PIECES_KEPT = 400_000
#: Shorter pieces are merged by repeated search, longer ones by a heap.
SHORT = 40
CODEPOINTS = 0x110000
CHUNK = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones stand for themselves, the rest follow from U+0100."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Merges:
    """The merges of a tokenizer file, by pairs of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and file["normalizer"] is None
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("token counts need a byte-level BPE file without normalizer and prefix space")
        letters = byte_letters()
        self.vocabulary = {word: i for word, i in model["vocab"].items()}
        self.strings = {i: bytes(letters[c] for c in word) for word, i in model["vocab"].items() if all(c in letters for c in word)}
        self.of_byte = [self.vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(self.vocabulary[a] << 32 | self.vocabulary[b], (rank, self.vocabulary[a + b]))
        self.added = file.get("added_tokens") or []

    def ids(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of lowest rank is joined, leftmost first, until no pair has a rank."""
        return self._short(piece) if len(piece) <= SHORT else self._long(piece)

    def _short(self, piece: bytes) -> list[int]:
        ids, pairs = [self.of_byte[b] for b in piece], self.pairs
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = pairs.get(ids[i] << 32 | ids[i + 1])
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _long(self, piece: bytes) -> list[int]:
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []  # rank, place, the two ids it was offered for

        def offer(i: int) -> None:
            j = following[i]
            if j < n and (found := self.pairs.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been joined since
            ids[i], ids[j] = self.pairs[a << 32 | b][1], -1
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


@lru_cache(2)
def merges_from(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# ---- proved beforehand -------------------------------------------------------
def prove_whole(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token, whole): whole vocabulary strings are one token when they are encoded alone as one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_from(path)
        for batch in batches:
            ids = [i for i in batch.column(0).to_pylist() if i in merges.strings]
            words = [merges.strings[i] for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array([merges.ids(w) == [i] for i, w in zip(ids, words)], pa.bool_())], ["token_id", "token", "whole"])

    top = max(merges_from(path).strings, default=-1) + 1
    return spark.range(0, top, 1, 8).mapInArrow(run, "token_id long, token binary, whole boolean")


HEADS = {LETTER: "a", NUMBER: "1", OTHER: "!"}


def class_in_library(split, code: int) -> int:
    """The class of the letter, digit or sign that a codepoint is not cut off from, else white space."""
    return next((kind for kind, head in HEADS.items() if len(split(head + chr(code))) == 1), WHITE)


def class_differences(spark: SparkSession, path: str) -> DataFrame:
    """(codepoint): those that the library's own splitting puts into another class than the table of ``byte_bpe``.
    A run of one class is right if the library leaves it in one piece; only other runs are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = library(path).pre_tokenizer.pre_tokenize_str, np.where(symbol_table() == QUOTE, OTHER, symbol_table())
        for batch in batches:
            out = []
            for start in batch.column(0).to_pylist():
                codes = [c for c in range(start, start + CHUNK) if not 0xD800 <= c < 0xE000]
                for kind, same in groupby(codes, lambda c: int(table[c])):
                    same = list(same)
                    if kind not in HEADS or len(split(HEADS[kind] + "".join(map(chr, same)))) > 1:
                        out += [c for c in same if class_in_library(split, c) != kind]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["codepoint"])

    return spark.range(0, CODEPOINTS, CHUNK, 8).mapInArrow(run, "codepoint long")


class Proof:
    """What tasks need to know of a vocabulary; its size is bounded by the vocabulary and by Unicode."""

    def __init__(self, whole: list[bytes], odd: list[int], contents: list[str], split_at: str | None):
        self.whole, self.odd, self.contents, self.split_at = whole, odd, contents, split_at

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Proof:
        whole = [bytes(r.token) for r in prove_whole(spark, path).where("whole").select("token").collect()]
        odd = [r.codepoint for r in class_differences(spark, path).collect()]
        added = merges_from(path).added
        plain = [t for t in added if not (t.get("lstrip") or t.get("rstrip") or t.get("single_word"))]
        contents = [t["content"] for t in added]
        return cls(sorted(whole), sorted(odd), contents, contents[0] if len(added) == 1 and plain else None)


class Counter:
    """Counts in one worker, with the lookup forms of a proof and the cache of merged pieces."""

    def __init__(self, path: str, proof: Proof):
        self.merges, self.path, self.proof = merges_from(path), path, proof
        self.whole = pa.array(proof.whole, pa.binary())
        self.odd = np.zeros(CODEPOINTS, bool)
        self.odd[proof.odd] = True
        self.cache: dict[bytes, int] = {}

    def merged(self, piece: bytes) -> int:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= PIECES_KEPT:
                self.cache.clear()
            found = self.cache[piece] = len(self.merges.ids(piece))
        return found

    def by_library(self, text: str) -> int:
        return len(library(self.path).encode(text, add_special_tokens=False).ids)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, pieces, whole pieces) of each text."""
        column = column.fill_null("")
        special = np.zeros(len(column), np.int64)
        ends = np.arange(len(column) + 1)
        if self.proof.split_at is not None and pc.any(pc.match_substring(column, self.proof.split_at)).as_py():
            split = pc.split_pattern(column, self.proof.split_at)
            ends = split.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            special = np.diff(ends) - 1
            column = split.flatten()
        data, offsets, first, codes = cut(column)
        n = len(offsets) - 1
        if n:
            coded = binary_array(data, offsets).dictionary_encode()
            known = pc.is_in(coded.dictionary, value_set=self.whole).to_numpy(zero_copy_only=False)
            tokens = np.ones(len(known), np.int64)
            for i in np.flatnonzero(~known).tolist():
                tokens[i] = self.merged(coded.dictionary[i].as_py())
            at = coded.indices.to_numpy()
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([tokens[at], known[at]], 1), 0)])
        else:
            sums = np.zeros((1, 2), np.int64)
        bounds = first[ends]  # first piece of each text, over its segments
        tokens, whole = np.diff(sums[bounds, 0]) + special, np.diff(sums[bounds, 1])
        pieces = np.diff(bounds)
        strange = self.strange(column, ends, codes)
        for i in strange:
            text = (self.proof.split_at or "").join(column[int(ends[i]) : int(ends[i + 1])].to_pylist())
            tokens[i], whole[i] = self.by_library(text), 0
        return tokens, pieces, whole

    def strange(self, column: pa.Array, ends: np.ndarray, codes: np.ndarray) -> list[int]:
        """Texts for the library: with a codepoint of another class, or with an added token that is not split off."""
        found = np.zeros(len(ends) - 1, bool)
        if len(codes) and len(hits := np.flatnonzero(self.odd.take(codes))):
            lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))])[ends]
            found[np.searchsorted(lengths, hits, "right") - 1] = True
        if self.proof.split_at is None:
            for content in self.proof.contents:
                found |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found).tolist()


#: The counter of this worker: (broadcast id, counter).
_counter: tuple[int, Counter] | None = None


def counter_of(path: str, proof) -> Counter:
    global _counter
    if _counter is None or _counter[0] != proof.id:
        _counter = (proof.id, Counter(path, proof.value))
    return _counter[1]


class Shared:
    """A broadcast with an id that workers can tell apart."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(value)
        self.id = self.data._jbroadcast.id()

    def __getstate__(self):
        return {"data": self.data, "id": self.id}

    @property
    def value(self):
        return self.data.value


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, n_pieces, n_whole) of every row: UTF-8 bytes, tokens, whether there are more
    than ``limit`` of them, pieces, and pieces counted by the proof alone."""
    spark = df.sparkSession
    proof = Shared(spark, Proof.of(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, proof)
        for part in parts_of(batches, "text"):
            _, offsets = text_bytes(part.column("text"))
            tokens, pieces, whole = counter.counts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *[pa.array(x.astype(np.int64)) for x in (np.diff(offsets), tokens, pieces, whole)]], ["key", "n_bytes", "n_tokens", "n_pieces", "n_whole"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, n_pieces long, n_whole long")
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pieces", "n_whole")
