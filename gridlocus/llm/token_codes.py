"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first.  Level 0 holds the first chunk of every
token, level k the k-th chunk of the tokens that have one, and a bitmap beside each level says
which tokens go on; a rank directory (ones before every 512 bits) turns a position in one level
into a position in the next.  Any token range is read with a few byte ranges of the file and no
block is decoded for it.

A file holds whole documents in ascending key order and ends once it has ``file_tokens`` tokens,
so a task keeps one file in memory.  Layout: magic, length of the JSON header, header, then the
sections the header names by (offset, length): keys, token offsets, and chunks, bitmap and
directory of each level.

A task writes under a name of its own and reports it in a manifest table; only files that the
stored manifest names exist for readers, so repeated attempts do no harm.

Cases: a null text is an empty text; every document, also an empty one, ends with the end id;
repeated keys are separate documents (ordered by text); a null key sorts first and comes back as
null; an empty table writes no file and reads as no rows; other columns are ignored."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlocus.llm.byte_bpe import PieceCache, cut
from gridlocus.llm.store import fresh_folder, stored
from gridlocus.llm.textual import PIECE_BYTES, binary_array, parts_of

MAGIC = b"TOKDAC01"
CHUNK = 8
RANK_BITS = 512
FILE_TOKENS = 4 << 20
MANIFEST = "part int, file int, path string, n_docs long, n_tokens long, n_bytes long"
NO_KEY = np.iinfo(np.int64).min


def open_place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object store) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- the codes ---------------------------------------------------------------
def levels_of(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) of every level."""
    out, left = [], ids.astype(np.uint32)
    while True:
        goes_on = left >> CHUNK != 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(left), RANK_BITS), dtype=np.int64) if len(left) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out.append(((left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        left = left[goes_on] >> CHUNK
        if not len(left):
            return out


class CodedFile:
    """Random access to one file; ``read(offset, length)`` gives bytes."""

    def __init__(self, read):
        self.read = read
        head = read(0, len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", head[len(MAGIC) :])
        self.header = json.loads(read(len(head), size))
        self.base = len(head) + size

    def section(self, name: str, start: int, stop: int) -> bytes:
        at, length = self.header[name]
        return self.read(self.base + at + start, min(stop, length) - start)

    def keys(self) -> np.ndarray:
        return np.frombuffer(self.section("keys", 0, 1 << 62), "<i8")

    def offsets(self) -> np.ndarray:
        return np.frombuffer(self.section("offsets", 0, 1 << 62), "<i8")

    def rank(self, level: int, i: int) -> int:
        """Tokens before position i of a level that go on in the next."""
        block = i // RANK_BITS
        (ones,) = struct.unpack("<I", self.section(f"ranks{level}", 4 * block, 4 * block + 4))
        bits = np.frombuffer(self.section(f"bits{level}", block * RANK_BITS // 8, (i + 7) // 8), np.uint8)
        return ones + int(np.unpackbits(bits, count=i - block * RANK_BITS, bitorder="little").sum(dtype=np.int64))

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids of the tokens a to b (excluded)."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level in range(self.header["levels"]):
            if a >= b:
                break
            out[where] |= np.frombuffer(self.section(f"chunks{level}", a, b), np.uint8).astype(np.uint32) << np.uint32(CHUNK * level)
            if level + 1 == self.header["levels"]:
                break
            bits = np.unpackbits(np.frombuffer(self.section(f"bits{level}", a // 8, (b + 7) // 8), np.uint8), bitorder="little")
            goes_on = bits[a % 8 : a % 8 + b - a].astype(bool)
            where = where[goes_on]
            a = self.rank(level, a)
            b = a + len(where)
        return out


def file_bytes(keys: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    sections = {"keys": keys.astype("<i8").tobytes(), "offsets": offsets.astype("<i8").tobytes()}
    levels = levels_of(ids)
    for i, (chunks, bits, ranks) in enumerate(levels):
        sections |= {f"chunks{i}": chunks, f"bits{i}": bits, f"ranks{i}": ranks}
    header, at = {"levels": len(levels)}, 0
    for name, value in sections.items():
        header[name] = (at, len(value))
        at += len(value)
    text = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *sections.values()])


# ---- tokens by the library ---------------------------------------------------
@lru_cache(2)
def library_cache(path: str):
    """The tokenizer of a file and a cache of the ids it gives to distinct pieces."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode_many(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for a in range(0, len(pieces), 20_000):
            some = [x.decode() for x in pieces[a : a + 20_000]]
            e = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(lengths)

    return tokenizer, PieceCache(encode_many, 900_000)


def library_tokens(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each closed by the end id, first id of every text and the end).

    Merges never cross the tokenizer's own pieces, so distinct pieces are encoded once.  A text
    with codepoints whose class may differ between Unicode versions, or with the string of an added
    token (which the library takes for that token), is encoded whole."""
    tokenizer, cache = library_cache(path)
    data, offsets, first, codes = cut(column)
    ids, lengths = cache.encode(data, offsets) if len(offsets) > 1 else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    ends = np.concatenate([[0], np.cumsum(lengths)])[first]
    parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
    if len(codes) and ((codes >= 0x250) | ((codes < 0x20) & (codes > 0x0D)) | ((codes >= 0x7F) & (codes < 0xA1))).any():
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[first], offsets[first[1:]])):
            text = raw[a:b].decode()
            if any(c >= "ɐ" or "\r" < c < " " or "\x7f" <= c < "\xa1" for c in set(text)):
                parts[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    texts = column.fill_null("")
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    for i in {i for content in added for i in np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist()}:
        parts[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
    closed = [x for part in parts for x in (part, np.array([end_id], np.uint32))]
    sizes = np.array([len(x) + 1 for x in parts], np.int64)
    return np.concatenate(closed) if closed else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])


# ---- writing and reading -----------------------------------------------------
def write_tokens(df: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
                 end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the token files and return their stored manifest, in ascending key order by (part, file)."""
    spark = df.sparkSession
    folder = folder or fresh_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_place(folder)
        part_no = TaskContext.get().partitionId()
        keys, sizes, ids, held, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, sizes, ids, held, number
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            value = file_bytes(np.concatenate(keys), offsets, np.concatenate(ids))
            name = f"part-{part_no:06d}-{number:06d}-{uuid.uuid4().hex[:8]}.tok"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(value)
            row = [[part_no], [number], [f"{folder}/{name}"], [len(offsets) - 1], [int(offsets[-1])], [len(value)]]
            keys, sizes, ids, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)

        names = [x.split()[0] for x in MANIFEST.split(", ")]
        for piece in parts_of(batches, text, min(PIECE_BYTES, file_tokens)):
            got, first = library_tokens(piece.column(text), tokenizer_path, end_id)
            keys.append(piece.column(key).cast(pa.int64()).fill_null(NO_KEY).to_numpy())
            sizes.extend(np.diff(first).tolist())
            ids.append(got)
            held += len(got)
            if held >= file_tokens:
                yield flush()
        if keys:
            yield flush()

    ordered = df.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, key: str = "doc_id", read_at_once: int = 1 << 20) -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files; start counts the tokens of all documents before
    it, ids are little-endian unsigned 32-bit integers in a binary value."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n_files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, place = open_place(path)
                with system.open_input_file(place) as source:
                    coded = CodedFile(lambda at, length: source.read_at(length, at))
                    keys, offsets = coded.keys(), coded.offsets()
                    at = 0
                    while at < len(keys):
                        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + read_at_once, "right")) - 1)
                        ids = coded.tokens(int(offsets[at]), int(offsets[stop]))
                        mine = pa.array(keys[at:stop], mask=keys[at:stop] == NO_KEY)
                        bounds = offsets[at : stop + 1]
                        yield pa.RecordBatch.from_arrays(
                            [mine, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), binary_array(ids.astype("<u4").view(np.uint8), (bounds - bounds[0]) * 4)],
                            ["key", "start", "n_tokens", "ids"])
                        at = stop

    spread = files.select("path", "start").repartition(min(n_files, 20_000), "path")
    return spread.mapInArrow(run, "key long, start long, n_tokens long, ids binary").withColumnRenamed("key", key)
