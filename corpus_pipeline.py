"""From raw documents to packed training sequences.

The stages, in this order: quality rules, SimHash near-dedup, suffix dedup, mixing of
sources, packing. Each takes the rows its predecessor kept, as Parquet; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import mix, packing, quality, simhash, suffixes
from tabwright.llm.common import BATCH_BYTES, Scratch, kept_tables, release

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_before: list[str] = []     # scratch tables that the result of the last stage called reads


def stage(fn):
    """A stage that first drops the scratch tables of the stage before it.

    A stage is called when the rows of its predecessor are written: ``docs`` reads
    those, and nothing reads the predecessor's scratch tables any more.
    """
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _before)
        spark.conf.set(BATCH_BYTES, str(16 << 20))     # for the stage's result, which is written after this call
        with kept_tables() as left:
            out = fn(spark, docs, sf_dir)
        _before[:] = left
        return out
    return run


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.accepted(docs.select(COLUMNS))


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 bits or fewer, the one with the smallest id."""
    return simhash.one_of_each(docs.select(COLUMNS), shingle=3, distance=2)


@stage
def passage_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes and more that stand earlier."""
    return suffixes.without_repeats(docs.select(COLUMNS))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a document as often as it is taken."""
    return mix.mix(docs.select(COLUMNS))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    # small workers: they live on beside the stages of a later run
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), rows=1_000, cached=250_000)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", passage_dedup_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Fingerprints, fitted estimates and token ids are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, call) in enumerate(STAGES):
        rows = call(spark, docs, sf_dir)
        docs = scratch.keep(rows, f"stage-{i}") if i + 1 < len(STAGES) else rows
        if 0 < i < len(STAGES) - 1:
            scratch.drop(f"stage-{i - 1}")
    _before.clear()     # the result still reads them
    return docs
