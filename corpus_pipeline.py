"""A corpus pipeline: toxic documents go, one document of each group of near duplicates stays, passages of 50 words that an
earlier document has are cut out, documents with benchmark items go, and the rest becomes token ids.

Every stage takes what the one before kept, as Parquet; all but the last return the columns of ``documents``.  Rows without an
id are kept by every filter that tells documents apart by id; an empty table runs through to an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlocus.llm.byte_bpe import decode, encode
from gridlocus.llm.decontaminate import without_leaks
from gridlocus.llm.jaccard import one_of_each_group
from gridlocus.llm.queries import vocabulary_file
from gridlocus.llm.store import stored, table
from gridlocus.llm.substring import remove_repeats
from gridlocus.llm.toxicity import scored, train_model, training_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half."""
    model = train_model(training_rows(docs, table(spark, sf_dir, "labels")))
    return scored(docs.select(COLUMNS), model).where("score < 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return one_of_each_group(docs.select(COLUMNS)).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has; n_chars follows the text."""
    cut = remove_repeats(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and the digest of the bytes they decode to."""
    path = vocabulary_file("byte_bpe_50k.tiktoken")
    return decode(encode(docs, path), path).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier and the edit distances are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
