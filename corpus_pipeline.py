"""A corpus made ready for training: five stages, each the result of one operator.

Each stage takes the documents that its predecessor kept and all but the last
return the columns of documents. ``run`` writes what a stage returns as Parquet
into the shared folder and hands the reread table on.

What a stage decides: the quality classifier drops documents that it rejects;
exact dedup leaves one document of each normalised text; near dedup leaves the
first document of each group of linked ones; mixing leaves every document as
often as it is taken, so a document may repeat; packing places them all.

Extra columns pass through all stages but the last, whatever their names; null
texts count as empty and are documents like others until mixing, which never
takes a document without words; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from ledgerloom.llm.common import pinned, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, seq_len=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_equal_texts),
    ("minhash_near_dedup", drop_similar_texts),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The quality model, the mix and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
