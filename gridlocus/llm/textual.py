"""Array helpers for text inside tasks: Arrow slices, words, word and shingle hashes.

Everything works on the UTF-8 bytes of a few megabytes of whole texts at a time, with one
array operation per step instead of one Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)

#: `[^\x20\x09-\x0D]+`: these six bytes separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def parts_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets); a null is an empty text."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of several texts: ``starts``/``ends`` are byte positions in ``data``; the words of
    text i are those from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = SPACES):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = np.ones(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, taken eight bytes at a time."""
        if self._hashes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
            left = self.ends - self.starts
            h = left.astype(U64) * GOLDEN
            live, at = np.arange(len(left)), self.starts
            while len(live):
                here = np.minimum(left, 8)
                mask = U64(0xFFFFFFFFFFFFFFFF) >> ((8 - here).astype(U64) * U64(8))
                h[live] = mix((h[live] ^ (eights[at] & mask)) + GOLDEN)
                more = left > 8
                live, at, left = live[more], at[more] + 8, left[more] - 8
            self._hashes = h
        return self._hashes

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, doc: int) -> bytes:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes()

    def words(self, doc: int) -> list[bytes]:
        a, b = self.first[doc], self.first[doc + 1]
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])]


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, by doubling; one per start that has room."""
    if len(h) < width:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, h, 1
    rest = width
    while rest:
        if rest & 1:
            n = len(h) - (done + size) + 1
            out = mix(power[:n].copy() + U64(size)) if out is None else mix(out[:n] * GOLDEN + power[done : done + n] + U64(size))
            done += size
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - size] * GOLDEN + power[size:])
            size *= 2
    return out


def inside_one(first: np.ndarray, width: int) -> np.ndarray:
    """Which of the starts 0..n-width keep ``width`` words inside one text."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n - width + 1) + width <= ends[: n - width + 1]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].., one run of the given length after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary values over one buffer without a copy; a piece is below 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
