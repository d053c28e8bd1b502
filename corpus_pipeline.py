"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, and token ids, in five stages.

Each stage reads what its predecessor wrote and returns the columns of documents; the last adds the ids. Stages rely
on the operators' rules for nulls, empty texts and repeated rows. A stage leaves its session with Arrow batches of BATCH_BYTES.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import bpe, linededup, phraseindex, quality, simhash
from recallgrid.llm.common import table, write_shared


#: Bytes of an Arrow batch between the JVM and Python, for the session in which a stage runs: texts are long, and a batch
#: is held on both sides by every core.
BATCH_BYTES = "8m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def set_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return set_first


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew where a stage has rewritten texts."""
    return df.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


@_in_small_batches
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_in_small_batches
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more have (the largest id keeps them)."""
    return _as_documents(linededup.dedup_lines(docs), docs)


@_in_small_batches
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles 0.8 similar or more): the one with the smallest id."""
    return simhash.keep_one_similar(docs)


@_in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    return phraseindex.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def with_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids (byte-level BPE), the number of ids, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN, check_col="round_trip")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", with_token_ids),
]

#: SQL can't express the classifier, nor the stages that depend on what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = write_shared(docs, f"stage{number}")
    return docs
