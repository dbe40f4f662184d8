"""Byte-level BPE encoding and decoding.

Texts are cut before the merges without a regular expression: every codepoint becomes one of a
few symbols by a lookup array (with one codepoint of look-ahead), and a small automaton over the
symbols marks where a piece begins.  The automaton runs as a scan over its transition functions,
which compose associatively: blocks of text are composed side by side, their summaries are
scanned, and the blocks are replayed from the state each begins in.  Distinct pieces are found by
dictionary encoding and merged once per worker, in a cache of bounded size.

Cases: a null text is an empty text; an empty text has no tokens and decodes to no bytes; rows
are independent, so repeated rows repeat their result; an empty table gives an empty table; other
columns are ignored.  Bytes that are not UTF-8 are read as U+FFFD."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlocus.llm.textual import binary_array, parts_of, ragged, text_bytes

#: The codepoints of the Unicode property White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# symbols; the look-ahead parts "short/long contraction" and "last space" are set per text
LETTER, SHORT, LONG, NUMBER, OTHER, QUOTE, SPACE_LAST, WHITE_LAST, WHITE, SYMBOLS = range(10)
# states: what the piece under way is
IN_LETTER, IN_NUMBER, IN_OTHER, AT_QUOTE, IN_LONG, CLOSED, AFTER_SPACE, IN_WHITE, STATES = range(9)
PIECES_KEPT = 120_000
#: Letters of contractions: those that end one, and those that begin one with the letter that must follow.
SHORTS = np.isin(np.arange(128), [ord(c) for c in "stmd"])
THEN = np.zeros(128, np.uint32)
THEN[[ord(c) for c in "rvl"]] = [ord(c) for c in "eel"]
CONTRACTED = SHORTS | (THEN > 0)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at this codepoint)."""
    if symbol in (LETTER, SHORT, LONG):
        if state == AT_QUOTE and symbol != LETTER:
            return (CLOSED if symbol == SHORT else IN_LONG), False
        if state == IN_LONG:
            return CLOSED, False
        return IN_LETTER, state not in (IN_LETTER, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER_SPACE)
    if symbol in (OTHER, QUOTE):
        joined = state in (IN_OTHER, AT_QUOTE, AFTER_SPACE)
        return (AT_QUOTE if symbol == QUOTE and not joined else IN_OTHER), not joined
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    if symbol == WHITE_LAST:
        return CLOSED, True
    return IN_WHITE, state != IN_WHITE


class Automaton:
    """The step function as tables, with the transition functions it generates numbered so that
    composing two of them is a table lookup.  Symbol s + SYMBOLS begins a text; the last one does nothing."""

    def __init__(self):
        width = 2 * SYMBOLS + 1
        self.width = width
        self.next = np.zeros((STATES, width), np.int64)
        self.begins = np.zeros((STATES, width), bool)
        for state in range(STATES):
            for symbol in range(SYMBOLS):
                if symbol == WHITE + 1:
                    continue
                self.next[state, symbol], self.begins[state, symbol] = step(state, symbol)
                self.next[state, symbol + SYMBOLS] = step(CLOSED, symbol)[0]
                self.begins[state, symbol + SYMBOLS] = True
            self.next[state, width - 1] = state
        generators = [tuple(self.next[:, s]) for s in range(width)]
        functions = {tuple(range(STATES)): 0}
        queue = list(functions)
        for f in queue:
            for g in generators:
                if (h := tuple(g[x] for x in f)) not in functions:
                    functions[h] = len(functions)
                    queue.append(h)
        self.apply = np.array(queue)
        self.extend = np.array([[functions[tuple(g[x] for x in f)] for g in generators] for f in queue])
        self.compose = np.array([[functions[tuple(g[x] for x in f)] for g in queue] for f in queue])
        self.flat_extend = (self.extend * width).ravel()
        self.flat_next = (self.next * width).ravel()
        self.flat_begins = self.begins.ravel()

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Where pieces begin, for the symbols of texts on end."""
        n = len(symbols)
        lanes = int(min(8192, max(1, n // 64)))
        steps = -(-n // lanes)
        padded = np.full(lanes * steps, self.width - 1, np.uint8)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        function = np.zeros(lanes, np.int64)  # times width
        for column in columns:
            function = self.flat_extend.take(function + column)
        function //= self.width
        shift = 1
        while shift < lanes:  # inclusive scan of the lanes' functions
            function[shift:] = self.compose[function[:-shift].copy(), function[shift:]]
            shift *= 2
        state = np.full(lanes, CLOSED, np.int64)
        state[1:] = self.apply[function[:-1], CLOSED]
        state *= self.width
        out = np.empty((steps, lanes), bool)
        for i, column in enumerate(columns):
            at = state + column
            self.flat_begins.take(at, out=out[i])
            state = self.flat_next.take(at)
        return np.flatnonzero(out.T.ravel()[:n])


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(1)
def symbol_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[ord("'")] = QUOTE
    return table


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte offset of every piece and the end, first piece of every text and the end, codepoints)."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(offsets, offsets[1:])]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        text = data.tobytes().decode()
    if not text:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) == len(data):
        at, heads = np.arange(len(codes) + 1), offsets
    else:
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        heads = np.searchsorted(at, offsets)
    symbols = symbol_table().take(codes)
    ends = np.zeros(len(codes) + 1, bool)
    ends[heads] = True  # a text begins here, or all end
    following = np.append(codes[1:], 0)
    same = ~ends[1:]
    last = same & np.append(symbols[1:] != WHITE, False) & (symbols == WHITE)
    symbols[last] = np.where(codes[last] == 0x20, SPACE_LAST, WHITE_LAST)
    letter = np.flatnonzero(CONTRACTED.take(np.minimum(codes, 127)))
    here, then = codes[letter], following[letter] * same[letter]
    long = THEN.take(here) == then
    symbols[letter] = np.where(long, LONG, np.where(SHORTS.take(here), SHORT, LETTER))
    symbols[heads[:-1][heads[:-1] < heads[1:]]] += SYMBOLS
    begins = automaton().boundaries(symbols)
    return data, np.append(at[begins], len(data)), np.searchsorted(begins, heads), codes


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbouring pair of lowest rank, leftmost first, until none is in the table."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n > 48:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(n)]
    high = len(ranks) + 1
    pairs = [ranks.get(parts[i] + parts[i + 1], high) for i in range(n - 1)]
    while pairs:
        low = min(pairs)
        if low == high:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], high)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], high)
    return [ranks[x] for x in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and linked positions: n log n for a very long piece."""
    n = len(piece)
    stop, back = list(range(1, n + 1)), list(range(-1, n))
    heap = []

    def offer(i: int) -> None:
        j = stop[i]
        if j < n and (rank := ranks.get(piece[i : stop[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, stop[j]))

    live = bytearray(b"\x01") * n
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not live[i] or stop[i] != j or not live[j] or stop[j] != end:
            continue
        live[j], stop[i] = 0, end
        if end < n:
            back[end] = i
        offer(i)
        if back[i] >= 0:
            offer(back[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class PieceCache:
    """Token ids of pieces met so far, in flat arrays; emptied when it holds too many.

    ``encode_many`` takes a list of pieces and gives (ids on end, number of ids of each)."""

    def __init__(self, encode_many, limit: int = PIECES_KEPT):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids on end, number of tokens of each piece)."""
        coded = binary_array(data, offsets).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > self.limit:
            self.clear()
        if missing := [x for x in distinct if x not in self.number]:
            ids, lengths = self.encode_many(missing)
            self.number.update(zip(missing, range(len(self.number), len(self.number) + len(missing))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        at = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        return self.ids[ragged(starts, lengths)], lengths


@lru_cache(2)
def ranks_from(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def rank_cache(path: str) -> PieceCache:
    ranks = ranks_from(path)

    def encode_many(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        merged = [merge_piece(x, ranks) for x in pieces]
        return np.fromiter(chain.from_iterable(merged), np.uint32), np.fromiter(map(len, merged), np.int64, len(merged))

    return PieceCache(encode_many)


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens on end, offsets by id)."""
    ranks = ranks_from(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    words = [b""] * len(lengths)
    for word, i in ranks.items():
        lengths[i], words[i] = len(word), word
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def encode_texts(column: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts on end, first id of every text and the end)."""
    data, offsets, first, _ = cut(column)
    if len(offsets) < 2:
        return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
    ids, lengths = cache.encode(data, offsets)
    return ids, np.concatenate([[0], np.cumsum(lengths)])[first]


def encode(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): ids are little-endian unsigned 32-bit integers in a binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, text):
            ids, first = encode_texts(part.column(text), rank_cache(ranks_path))
            packed = binary_array(ids.astype("<u4").view(np.uint8), first * 4)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(first)), packed], ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """(key, n_tokens, ids, decoded[, token_offsets]): the bytes of the tokens on end and, if asked for, the byte
    offset of every token in them.  A null is no tokens; an id outside the table fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = vocabulary(ranks_path)
        for part in parts_of(batches, ids):
            raw, bounds = text_bytes(part.column(ids))
            numbers = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
            if len(numbers) and numbers.max() >= len(at) - 1:
                raise ValueError(f"token id {numbers.max()} is not in the table")
            lengths = (at[1:] - at[:-1])[numbers]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            out = words[ragged(at[numbers], lengths)]
            columns = [part.column(key), pa.array(np.diff(bounds) // 4), part.column(ids).fill_null(b""), binary_array(out, ends[bounds // 4])]
            if offsets:
                within = ends[:-1] - np.repeat(ends[bounds[:-1] // 4], np.diff(bounds) // 4)
                columns.append(pa.ListArray.from_arrays(pa.array((bounds // 4).astype(np.int32)), pa.array(within)))
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids", "decoded", "token_offsets"][: len(columns)])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids binary, decoded binary" + ", token_offsets array<long>" * offsets
    return df.select(key, ids).mapInArrow(run, schema).withColumnRenamed("key", key)
