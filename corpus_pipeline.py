"""The corpus pipeline: raw documents to shuffled training shards, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import foldwise
from foldwise.llm import decontaminate, mixing, neardup, quality, sharding
from foldwise.llm.base import frozen, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go.

    Null and empty texts are scored as one empty line; a very long text is scored
    whole; rows with equal texts go or stay together; an empty table gives an empty
    one. All columns pass unchanged, whatever their names.
    """
    foldwise.ship(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8) stays.

    It is the one with the least doc_id, null ids last, and of rows equal in doc_id and
    text one. Null texts and those without words have no duplicates but rows of their
    own doc_id; very long texts are compared whole; an empty table gives an empty
    one. All columns pass unchanged, whatever their names.
    """
    foldwise.ship(spark)
    return neardup.without_near_duplicates(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go.

    Null and empty texts are clean; very long texts are scanned whole; rows with equal
    texts go or stay together; an empty table or benchmark changes nothing. All
    columns pass unchanged, whatever their names.
    """
    foldwise.ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, none more than three times.

    Null is a source of its own; null texts and those without words are taken at their
    expected copies; of ties in rank the lesser doc_id is taken first; an empty table
    gives an empty one. All columns pass unchanged, whatever their names.
    """
    return mixing.mixed_rows(docs)


def _shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot of a uniform shuffle; shards differ by one row at most.

    Null, empty and very long texts and copies are rows like any other; an empty table
    gives an empty one; columns named shard or slot are replaced.
    """
    foldwise.ship(spark)
    return sharding.shard(docs, 8)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("benchmark", _benchmark), ("mix", _mix), ("shards", _shards)]

#: The CRF's scores, the MinHash verification and the random shuffle are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
