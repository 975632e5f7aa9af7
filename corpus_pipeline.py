"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing; each stage on what the last kept.

A stage's result is written as Parquet before the next stage is called. So each stage, when it is called, deletes what the
one before it kept in the shared folder for its result's evaluation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from visparq.llm import mixing, packing, pii, quality, queries, simhash
from visparq.llm._common import MADE, durable, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: set[str] = set()


def _alone(stage: Stage) -> Stage:
    """A stage that starts without its predecessor's tables."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*_left)
        _left.clear()
        before = set(MADE)
        out = stage(spark, docs, sf_dir)
        if run is not STAGES[-1][1]:  # the last one's tables are read when the whole result is
            _left.update(set(MADE) - before)
        return out

    return run


@_alone
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


@_alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the least id's: groups of five-word shingles with a similarity of 0.8 or more."""
    return simhash.keep_first(docs)


@_alone
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with entities and disclosing terms rewritten."""
    return pii.sanitise(docs)


@_alone
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it."""
    return mixing.apply_mix(docs, queries.domain_of(), queries.WEIGHTS, queries.PERCENT, queries.EPOCHS, queries.SEED)


@_alone
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, and their places in training sequences."""
    return packing.pack(docs, queries.vocabulary(), queries.CAPACITY, 0, keep_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("best_fit_packing", pack)]
ORACLE_SQL = None  # fingerprints, merges and packing have no SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage wrote goes when the next is done."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        done = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:
            release(read)
        docs = read = done
    return STAGES[-1][1](spark, docs, sf_dir)
