"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read
again before the next. All but the last return the columns of documents.

Edge cases, in each stage: other columns are kept, whatever their names, and an empty table gives an empty result. Language ID
drops null texts and texts without a letter; near-dedup keeps rows without a doc_id and links nothing to an empty text;
mixing takes a null source as the last one and leaves out sources without words; packing gives an empty or null text one piece
of one token, the end. Repeated rows: language ID keeps them all, near-dedup one of equal doc_id and text, mixing lets rows of
one doc_id fare alike, packing packs each copy. A very long text is read whole by every stage, and cut by packing alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stormshift.llm._shared import table, work_path
from stormshift.llm.language_id import fit, predict
from stormshift.llm.mixing import mix
from stormshift.llm.near_dedup import keep_one
from stormshift.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language the calibrated model rejects."""
    return predict(docs, fit(docs)).where("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return keep_one(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents so that sources meet their target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4,096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), by_chunk=True, cache_bytes=36_000_000)


STAGES: list[tuple[str, Callable]] = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: A trained classifier, hashed candidates and a tokenizer: no stage is SQL. tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
