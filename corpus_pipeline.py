"""A training corpus in four stages: quality, near copies, repeated passages, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm.packing import pack
from caseloom.llm.quality import score_quality, train_quality
from caseloom.llm.simhash import keep_one_of_each
from caseloom.llm.substrings import find_repeats
from caseloom.session import cut_lineage

#: Words of a shingle and differing bits up to which fingerprints link.
SHINGLE, DISTANCE = 3, 2
#: Words of a passage that may not repeat, and tokens of a sequence.
PASSAGE, CAPACITY = 50, 1024


def _apart(docs: DataFrame) -> DataFrame:
    """(row, text): the other columns as one struct, so that no name of theirs meets a name of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others, F.lit(0).alias("caseloom_row")).alias("row"), "text")


def _together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, does not reject.  Unlabelled ones are judged like all others.

    All columns of `docs` stay as they are, those called score or predicted too.
    """
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _together(score_quality(_apart(docs), net).where("predicted = 1"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints: the one with the smallest doc_id."""
    return keep_one_of_each(docs, shingle=SHINGLE, bits=64, max_distance=DISTANCE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur more than once; texts without such a passage stay as they are.

    n_chars, where `docs` has it, follows a cut text; all other columns stay as they are, whatever their names.
    """
    found = find_repeats(_apart(docs), window=PASSAGE)
    cut = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    kept = _together(cut, docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most CAPACITY tokens, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=CAPACITY, added=True)


STAGES = [
    ("quality", drop_low_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack_sequences),
]
#: SQL cannot express the classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
