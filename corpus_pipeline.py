"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs; all but the last return the columns of documents.  When a stage
is called, the one before it has been written, so the scratch tables of that one go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from tidewatch.llm.common import delete, documents, drop_stage, release, scratch, stage

#: Scratch paths of the stage that was called last.
_held: list[str] = []


def _after(apply: Callable, first: bool = False) -> Callable:
    """``apply`` once the scratch tables of the stage before it, whose result is written, are gone."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            delete(spark, _held)
        _held.clear()
        release(spark)
        with scratch() as made:
            out = apply(spark, docs, sf_dir)
        _held.extend(made)
        return out

    run.__name__, run.__doc__ = apply.__name__, apply.__doc__
    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard 0.8 or more: one document of each linked group stays."""
    return jaccard_join.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, shard by shard."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", _after(quality, first=True)),
    ("exact dedup", _after(dedup)),
    ("n-gram Jaccard join", _after(near_dedup)),
    ("mixing to target weights", _after(mix)),
    ("packing", _after(pack)),
]

#: The mix draws and the token ids have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (name, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = stage(out, "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            drop_stage(before)
        before = docs
