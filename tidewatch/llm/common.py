"""Shared pieces of the training-data operators: scratch tables, bounded broadcasts, distributed ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java's and Python's regular expressions.
SPACE = r"\x20\x09-\x0D"
#: A table is only broadcast by hint while its row count is at most this.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    for held in _SCOPES:
        held.append(path)
    return path


#: Lists of the scratch paths made while a :func:`scratch` scope is open.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the scratch paths that are made inside, to be deleted with :func:`delete` once nothing reads them."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES.remove(held)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stage` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, [p for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if "/tidewatch/" in p])


def own_columns(docs: DataFrame, keep: list[str] | None = None) -> Column:
    """The caller's columns as one struct ``_own``, so that no name of theirs meets one of an operator."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep or docs.columns]).alias("_own")


def give_back(docs: DataFrame, keep: list[str] | None = None, made: tuple[str, ...] = ()) -> list[Column]:
    """The caller's columns out of ``_own``; a column that the operator makes replaces one of the same name."""
    names = {m.lower() for m in made}
    return [F.col("_own")[c].alias(c) for c in keep or docs.columns if c.lower() not in names]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def binary_arrow(df: DataFrame, *columns: str) -> DataFrame:
    """Columns for an Arrow kernel, with the text column as UTF-8 bytes."""
    return df.select(*[F.encode(whole_text(c), "UTF-8").alias(c) if c == "text" else F.col(c) for c in columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows, so that a kernel's Python objects stay few."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished tables now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
