"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (3 to 5 bytes of the Unicode lower case) inside words, with a mark at each word's ends,
hashed into ``SLOTS`` slots.  For every slot the documents of either class that hold it are counted over all
labelled training rows; r is the log ratio of its smoothed shares.  The slots with the strongest evidence
(|r| * sqrt(count), at most ``features``) stay, and a logistic regression is fitted on presence * r.

The counts use every training row.  The regression is fitted on about ``fit_rows`` of them (the documented bound; the
rows whose id has a small hash, so the choice does not depend on the layout).  The model is a table of at most
``features`` weights, whatever the corpus.

Cases: a null text is an empty text and gets the model's score for no features; rows without a label are scored and not
learned from; a label row without a document is ignored; repeated rows are learned and scored as often as they occur;
labels of one class only, or no labels, give a constant score (1 if all are toxic, else 0); an empty table gives an empty table;
other columns are kept out of the score."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridlocus.llm.textual import U64, parts_of, text_bytes

GRAMS = (3, 4, 5)
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
SPREAD = U64(0x9E3779B97F4A7C15)
FEATURES = 4096
FIT_ROWS = 12_000
LEAST_DOCS = 3
BROADCAST_ROWS = 1_000_000
#: Bytes that end a word: everything in ASCII but letters, digits and the apostrophe.
BREAKS = np.array([b < 128 and not (chr(b).isalnum() or chr(b) == "'") for b in range(256)])


def gram_slots(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(slot of the n-gram at every byte, whether it is one)] per n, first byte of every text and the end)."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    # a break before, between and behind the texts, so that no gram crosses
    lengths = np.diff(offsets)
    spaced = np.full(len(data) + len(lengths) + 9, 0x20, np.uint8)
    heads = offsets + np.arange(len(offsets))
    inner = np.ones(len(data) + len(lengths) + 1, bool)
    inner[heads] = False
    spaced[: len(inner)][inner] = np.where(BREAKS[data], 0x20, data)
    n = len(inner)
    eights = np.ndarray((n,), "<u8", spaced, strides=(1,)).copy()
    letter = spaced != 0x20
    out, whole = [], np.ones(n, bool)
    for size in GRAMS:  # a break only as the first or the last byte
        first = 1 if size == GRAMS[0] else size - 2
        for k in range(first, size - 1):
            whole = whole & letter[k : k + n]
        tagged = (eights & U64((1 << (8 * size)) - 1)) | U64(size << 56)
        tagged *= SPREAD
        tagged >>= U64(64 - SLOT_BITS)
        out.append((tagged.astype(np.int32), whole))
    return out, heads


def counted(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): training documents of each class with the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS), np.int32)
        seen = np.zeros(SLOTS, np.int32)
        for part in parts_of(batches, "text", 2 << 20):
            slots, heads = gram_slots(part.column("text"))
            for label, (a, b) in zip(part.column("label").to_pylist(), pairwise(heads.tolist())):
                mine = np.concatenate([s[a:b][ok[a:b]] for s, ok in slots])
                number = np.arange(len(mine), dtype=np.int32)
                seen[mine] = number
                counts[label][mine[seen[mine] == number]] += 1
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1][found].astype(np.int64)), pa.array(counts[0][found].astype(np.int64))], ["feature", "toxic", "clean"])

    return train.mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Model:
    """Weights of slots (ascending) and a constant."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, constant: float):
        self.features, self.weights, self.constant = features, weights, constant
        self._numbers = None

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature number) of a column, ascending."""
        if self._numbers is None:
            self._numbers = np.zeros(SLOTS, np.int16)
            self._numbers[self.features] = np.arange(1, len(self.features) + 1)
        slots, heads = gram_slots(column)
        found, places = [], []
        for slot, ok in slots:
            number = self._numbers[slot]
            at = np.flatnonzero((number != 0) & ok)
            found.append(number[at].astype(np.int64) - 1)
            places.append(np.searchsorted(heads, at, "right") - 1)
        pairs = np.unique(np.concatenate(places) * SLOTS + np.concatenate(found))
        return pairs // SLOTS, pairs % SLOTS

    def __getstate__(self):
        return self.__dict__ | {"_numbers": None}

    def scores(self, column: pa.Array) -> np.ndarray:
        docs, at = self.present(column)
        z = self.constant + np.bincount(docs, self.weights[at], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(docs: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, n_features: int, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on sparse rows by gradient steps with momentum.  In sum, clean rows weigh twice as
    much as toxic ones, whatever their numbers."""
    n = len(y)
    share = np.where(y == 1, 1 / 3 / max(1, (y == 1).sum()), 2 / 3 / max(1, (y == 0).sum()))
    w = v = np.zeros(n_features)
    c = u = 0.0
    sizes = np.bincount(docs, x * x, n)
    rate = 1 / (np.average(sizes, weights=share) + 1)
    for k in range(rounds):
        ahead, above = w + 0.9 * v, c + 0.9 * u
        z = above + np.bincount(docs, x * ahead[at], n)
        miss = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(at, x * miss[docs], n_features) + penalty * ahead
        v, u = 0.9 * v - rate * grad, 0.9 * u - rate * miss.sum()
        w, c = w + v, c + u
    return w, c


def train_model(labelled: DataFrame, features: int = FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """A model from rows (doc, text, label 0 or 1)."""
    labelled = labelled.where("label in (0, 1)").select("doc", "text", F.col("label").cast("long").alias("label"))
    totals = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), 500.0 if share == 1 else -500.0)
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (n - toxic + 2))
    best = counted(labelled).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("r", ratio)
    best = best.orderBy(F.desc(F.abs("r") * F.sqrt(F.col("toxic") + F.col("clean"))), "feature").limit(features).toArrow()
    hashes, r = best["feature"].to_numpy(), best["r"].to_numpy()
    order = np.argsort(hashes)
    model = Model(hashes[order], r[order], 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, "text"):
            docs, at = shared.value.present(part.column("text"))
            bounds = np.searchsorted(docs, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32)))], ["label", "found"])

    # about fit_rows rows of at most ``features`` small numbers come to the driver
    part = labelled.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < (fit_rows << 20) // n)
    fit = part.mapInArrow(rows, "label long, found array<int>").toArrow().combine_chunks()
    lists = fit["found"].combine_chunks()
    at = lists.flatten().to_numpy()
    docs = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    weights, constant = logistic(docs, at, model.weights[at], fit["label"].to_numpy().astype(float), len(hashes))
    return Model(model.features, model.weights * weights, constant)


def scored(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The table with a score column; a column of that name is replaced."""
    df = df.drop(name)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(text)))], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def held_out(key: str) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def training_rows(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc, text, label) of the labelled rows outside the held-out fold."""
    known = labels.select(F.col(key).alias("doc"), F.col(label).alias("label")).where("label is not null and doc is not null")
    known = known.where(~held_out("doc"))
    if known.count() <= BROADCAST_ROWS:  # two numbers a row; more labels are joined by a shuffle
        known = F.broadcast(known)
    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(known, "doc")
