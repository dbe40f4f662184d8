"""Phrases that occur more often than their parts explain, per language.

First pass: every n-gram of one to ``longest`` words inside a piece of text is a key of a hash; the
upper bits of the hash name its partition (slot).  Tasks hand out summaries (keys with counts) per
slot, and the summaries of a slot are merged as Misra-Gries summaries: whenever a merged summary has
more than ``capacity`` keys, the count of the key after the ``capacity`` largest is taken off all of
them and the empty ones go.  The capacity exceeds the slot's mass (all occurrences in it) divided by the
threshold, so what is ever taken off one key stays below the threshold, and a key that is frequent
enough survives; memory is the capacity, whatever the number of distinct n-grams.  Keys that share 32
bits of hash only add up, which keeps the guarantee.  Survivors become bits of a bitmap of bounded size.

Second pass: occurrences whose bit is set are counted exactly, by their text: folded inside tasks, then
added up per slot.  Bits that are set for other reasons only cost work here, they change no result.

Cases: a null text is empty; a null language is ``und``; a text or piece without words has no phrases;
repeated rows count again; an empty table gives no rows; ties are ordered by occurrences, then by the
phrase's bytes; other columns are ignored, whatever their names.  A very long text is a slice of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlocus.llm.folding import Fold
from gridlocus.llm.store import stored
from gridlocus.llm.textual import SPACES, U64, Words, binary_array, mix, parts_of, ragged, shingles, text_bytes

#: `[.,;:!?\x0A-\x0D]` separates pieces; space and tab separate words inside them.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
KEY_BITS = 32
SPARE = 5
SLOT_MASS = 8 << 20  # n-gram occurrences that a slot is planned for
LEAST_SLOTS = 64
KEYS_HELD = 1 << 20  # n-grams a task holds before it hands out summaries
KEYS_A_ROW = 2048
GRAMS_A_ROW = 500
PART_BYTES = 1 << 20
BITMAP_BITS = (20, 28)  # least and largest size of the bitmap as powers of two: 128 KB and 32 MB
SALTS = 16
UNKNOWN = "und"


class Phrases:
    """The n-grams of several texts: ``keys(k)`` are hashes of the runs of k words inside one piece, ``bytes_of`` their text
    with single spaces."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.langs = lang.fill_null(UNKNOWN).cast(pa.string()).dictionary_encode()
        w = Words(text, lower=True, separators=SPACES | BREAKS)
        self.lang_of_word = self.langs.indices.to_numpy()[w.doc_of_words()]
        salt = np.array([hash_of(x) for x in self.langs.dictionary.to_pylist()], U64)
        self.words = mix(w.hashes ^ salt[self.lang_of_word]) if len(w.starts) else np.zeros(0, U64)
        edges = np.zeros(len(w.data) + 1, np.int64)
        np.add.at(edges, w.offsets, 1)
        self.piece = (np.cumsum(edges)[:-1] + np.cumsum(BREAKS[w.data]))[w.starts]
        self.lengths = w.ends - w.starts
        self.data = np.append(w.data, np.uint8(0x20))[ragged(w.starts, self.lengths + 1)]
        self.begins = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.data[self.begins + self.lengths] = 0x20

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes)."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])
        return at, mix(shingles(self.words, k)[at] ^ mix(np.full(1, k, U64)))

    def bytes_of(self, at: np.ndarray, k: int) -> pa.Array:
        lengths = self.begins[at + k - 1] + self.lengths[at + k - 1] - self.begins[at]
        return binary_array(self.data[ragged(self.begins[at], lengths)], np.concatenate([[0], np.cumsum(lengths)]))


def hash_of(lang: str) -> int:
    return int(Words(pa.array(["x" + lang.encode().hex()])).hashes[0])


# ---- summaries ---------------------------------------------------------------
def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], (np.add.reduceat(counts, heads) if len(heads) else counts)


class Summary:
    """A Misra-Gries summary of weighted keys; ``error`` bounds what was taken off any key."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting_keys = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.waiting_keys += len(keys)
        if self.waiting_keys >= max(self.capacity, 1 << 18):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        self.keys, self.counts = added_up(np.concatenate([self.keys, *[k for k, _ in self.waiting]]), np.concatenate([self.counts, *[c for _, c in self.waiting]]))
        self.waiting, self.waiting_keys = [], 0
        if len(self.keys) > self.capacity:
            off = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            self.error += int(off)
            self.counts = self.counts - off
            left = self.counts > 0
            self.keys, self.counts = self.keys[left], self.counts[left]

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key that may have occurred ``threshold`` times."""
        self.settle()
        return self.keys[self.counts + self.error >= threshold]


def capacity_for(mass: int, threshold: int) -> int:
    """Exceeds mass / threshold, ``SPARE`` times over: what is taken off a key then stays below threshold / ``SPARE``, so that
    few rare keys survive beside the frequent ones."""
    return SPARE * mass // threshold + 1


def slots_for(n_bytes: int, longest: int) -> int:
    """A power of two: n words of two bytes or more give at most ``longest`` n-grams each; six bytes a word are planned for."""
    slots = LEAST_SLOTS
    while slots * SLOT_MASS < n_bytes // 6 * longest:
        slots *= 2
    return slots


def power_of(slots: int) -> int:
    return slots.bit_length() - 1


def summaries(df: DataFrame, slots: int, longest: int) -> DataFrame:
    """(slot, mass, keys, counts): rows with a mass announce occurrences; the others hold keys in order and their counts."""
    shift = U64(64 - power_of(slots) - KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            keys, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            held, size = [], 0
            slot = (keys >> U64(KEY_BITS)).astype(np.int64)
            key = (keys & U64(0xFFFFFFFF)).astype("<u4")
            cuts = np.searchsorted(slot, np.arange(slots + 1))
            full = np.flatnonzero(np.diff(cuts))
            mass = np.add.reduceat(counts, cuts[full])
            rows = [(s, int(m), None, None) for s, m in zip(full.tolist(), mass)]
            for s in full.tolist():
                for a in range(cuts[s], cuts[s + 1], KEYS_A_ROW):
                    b = min(a + KEYS_A_ROW, cuts[s + 1])
                    rows.append((s, None, key[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()))
            columns = list(zip(*rows))
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 1000], t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["slot", "mass", "keys", "counts"])

        for part in parts_of(batches, "text", PART_BYTES):
            phrases = Phrases(part.column("text"), part.column("lang"))
            for k in range(1, longest + 1):
                held.append(phrases.keys(k)[1])
                size += len(held[-1])
            if size >= KEYS_HELD:
                yield from hand_out()
        if size:
            yield from hand_out()

    return df.mapInArrow(run, "slot int, mass long, keys binary, counts binary")


def surviving_bits(summary_rows: DataFrame, slots: int, bits: int, threshold: int) -> DataFrame:
    """(slot, error, survivors, bits): the part of the bitmap that belongs to each slot, with a bit for every survivor.
    A slot's announcements of mass are read before its keys, so the capacity is known before the first merge."""
    own = bits - power_of(slots)  # bits of a slot, as a power of two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, mass, summary = None, 0, None

        def close() -> pa.RecordBatch:
            keys = summary.survivors(threshold) if summary else np.zeros(0, np.uint32)
            marks = np.zeros(1 << own, bool)
            marks[keys >> np.uint32(KEY_BITS - own)] = True
            row = [[slot], [summary.error if summary else 0], [len(keys)], [np.packbits(marks, bitorder="little").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["slot", "error", "survivors", "bits"])

        for batch in batches:
            for s, m, keys, counts in zip(*[batch.column(c) for c in ("slot", "mass", "keys", "counts")]):
                if (s := s.as_py()) != slot:
                    if slot is not None:
                        yield close()
                    slot, mass, summary = s, 0, None
                if (m := m.as_py()) is not None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(capacity_for(mass, threshold))
                summary.merge(np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64))
        if slot is not None:
            yield close()

    ordered = summary_rows.repartition("slot").sortWithinPartitions("slot", F.col("mass").isNull())
    return ordered.mapInArrow(run, "slot int, error long, survivors long, bits binary")


def bitmap_of(rows: DataFrame, slots: int, bits: int) -> np.ndarray:
    """The whole bitmap: ``bits`` bounds its size, whatever the corpus."""
    size = (1 << bits) // 8 // slots
    out = np.zeros((slots, size), np.uint8)
    for row in rows.select("slot", "bits").toLocalIterator():
        out[row.slot] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


# ---- exact counts ------------------------------------------------------------
GRAMS = "slot int, lang string, phrases binary, counts binary"


def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(slot, lang, phrase, f) as rows of one slot and language with up to ``GRAMS_A_ROW`` phrases, in order and a line each
    (no word holds a line end), and their counts as unsigned 32-bit integers."""
    rows = rows.sort_by([("slot", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
    slot, lang, phrase, f = (x.chunk(0) if isinstance(x := rows[c].combine_chunks(), pa.ChunkedArray) else x for c in ("slot", "lang", "phrase", "f"))
    same = pc.and_(pc.equal(slot[1:], slot[:-1]), pc.equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    cuts = np.append(np.concatenate([np.arange(a, b, GRAMS_A_ROW) for a, b in zip(heads, np.append(heads[1:], len(slot)))]), len(slot))
    counts = f.to_numpy().astype("<u4").view(np.uint8)
    for a in range(0, len(cuts) - 1, 200):
        part = cuts[a : a + 201]
        within = part - part[0]
        lists = pa.ListArray.from_arrays(pa.array(within.astype(np.int32)), phrase.slice(part[0], part[-1] - part[0]))
        first = pa.array(part[:-1])
        yield pa.RecordBatch.from_arrays(
            [slot.take(first).cast(pa.int32()), lang.take(first), pc.binary_join(lists, b"\n"), binary_array(counts[4 * part[0] : 4 * part[-1]], 4 * within)], ["slot", "lang", "phrases", "counts"])


def unpacked(rows: pa.RecordBatch) -> pa.Table:
    phrases = pc.split_pattern(rows.column("phrases"), "\n")
    counts = np.frombuffer(text_bytes(rows.column("counts"))[0].tobytes(), "<u4").astype(np.int64)
    lang = rows.column("lang").take(pa.array(np.repeat(np.arange(rows.num_rows), pc.list_value_length(phrases).to_numpy())))
    return pa.table({"lang": lang, "phrase": phrases.flatten(), "f": counts})


def exact_counts(df: DataFrame, bitmap, slots: int, bits: int, threshold: int, longest: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of up to ``longest`` words with f >= ``threshold``; the empty phrase counts all words
    of its language.  ``bitmap`` is broadcast.  Tasks hand out counts packed by slot, and the counts of a slot are added up in
    one place, where the survivors of the first pass bound their number."""
    slot_shift = U64(64 - power_of(slots))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held = np.frombuffer(bitmap.value, np.uint8), Fold(["slot", "lang", "phrase"], ["f"], 300_000)
        for part in parts_of(batches, "text", PART_BYTES):
            phrases = Phrases(part.column("text"), part.column("lang"))
            langs = phrases.langs.dictionary
            n = np.bincount(phrases.lang_of_word, minlength=len(langs)).astype(np.int64)
            tables = [pa.table({"slot": np.zeros(len(langs), np.int64), "lang": langs, "phrase": pa.array([b""] * len(langs), pa.binary()), "f": n})]
            for k in range(1, longest + 1):
                at, keys = phrases.keys(k)
                place = (keys >> U64(64 - bits)).astype(np.int64)
                marked = (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at, keys = at[marked], keys[marked]
                if not len(at):
                    continue
                coded = phrases.bytes_of(at, k).dictionary_encode()
                size = len(coded.dictionary)
                key, first, f = np.unique(phrases.lang_of_word[at].astype(np.int64) * size + coded.indices.to_numpy(), return_index=True, return_counts=True)
                tables.append(pa.table({"slot": (keys[first] >> slot_shift).astype(np.int64), "lang": langs.take(pa.array(key // size)), "phrase": coded.dictionary.take(pa.array(key % size)), "f": f.astype(np.int64)}))
            for full in held.add(pa.concat_tables(tables)):
                yield from packed(full)
        for full in held.rest():
            yield from packed(full)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, None

        def close() -> Iterator[pa.RecordBatch]:
            for full in held.rest():
                kept = full.filter(pc.or_(pc.greater_equal(full["f"], threshold), pc.equal(full["phrase"], b"")))
                yield from kept.combine_chunks().to_batches(max_chunksize=20_000)

        for batch in batches:
            slots_here = batch.column("slot").to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], slots_here[1:] != slots_here[:-1]])), len(slots_here))
            for a, b in zip(edges, edges[1:]):
                if slots_here[a] != slot:
                    if held is not None:
                        yield from close()
                    slot, held = slots_here[a], Fold(["lang", "phrase"], ["f"], 300_000, spills=False)
                for _ in held.add(unpacked(batch.slice(a, b - a))):
                    raise AssertionError("a fold of bounded keys does not spill")
        if held is not None:
            yield from close()

    counted = df.mapInArrow(count, GRAMS).repartition("slot").sortWithinPartitions("slot")
    return counted.mapInArrow(add_up, "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(df: DataFrame, threshold: int = 30, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f) by the two passes, stored."""
    spark: SparkSession = df.sparkSession
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = slots_for(n_bytes, longest)
    least, largest = BITMAP_BITS
    bits = max(power_of(slots) + 3, min(largest, max(least, (n_bytes // 6 * longest // threshold * 8).bit_length())))
    found = surviving_bits(summaries(rows, slots, longest), slots, bits, threshold)
    bitmap = spark.sparkContext.broadcast(bitmap_of(found, slots, bits).tobytes())
    return stored(exact_counts(rows, bitmap, slots, bits, threshold, longest), "phrases")


def collocations(df: DataFrame, threshold: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language.

    A phrase of two to ``longest`` words with a >= ``threshold`` occurrences is scored by its weakest cut into two parts of l and r
    occurrences, floor(2000000 * a / (l + r)); it goes if a longer phrase that holds it has ``covered`` percent of a or more."""
    grams = frequent_phrases(df, threshold, longest, text, lang).withColumn("words", F.split("phrase", " "))
    counted = grams.where("phrase <> ''").withColumn("size", F.size("words"))
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")

    # what longer phrases cover: one row per (phrase, shorter phrase in it)
    inside = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    longer = counted.where("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("cover"))
    both = counted.where("size > 1").select("lang", "phrase", "f", F.lit(None).cast("long").alias("cover")).unionByName(longer.withColumn("f", F.lit(None).cast("long")).select("lang", "phrase", "f", "cover"))
    kept = both.groupBy("lang", "phrase").agg(F.max("f").alias("a"), F.max("cover").alias("cover"))
    kept = kept.where(F.coalesce(F.expr(f"cast(100 as decimal(20,0)) * cover < cast({covered} as decimal(20,0)) * a"), F.lit(True)))

    # the parts of every cut: a word may be a part of very many phrases, so words are salted
    salt = lambda phrase: F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int")
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), F.array(part(1, k), part(k + 1, F.size("words") - k)).alias("parts"))))
    asked = kept.withColumn("words", F.split("phrase", " ")).select("lang", "phrase", "a", cuts.alias("cut")).select(
        "lang", "phrase", "a", "cut.k", F.posexplode("cut.parts").alias("side", "part"))
    asked = asked.withColumn("salt", F.when(F.contains("part", F.lit(" ")), 0).otherwise(salt("phrase")))
    parts = counted.where(F.col("size") < longest).select(
        "lang", F.col("phrase").alias("part"), F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col("f").alias("part_f"))
    found = asked.join(parts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"))
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = found.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # the first of each language: first within shares of it, then among those
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = best.withColumn("share", salt("phrase")).withColumn("near", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = grams.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
