"""Exact deduplication by a stateful stream.

The documents are read as a file stream into a keyed state on disk (RocksDB) that never
expires: the key is the SHA-256 of the normalised text, the value the stable identifier
(smallest doc_id), its content locator (file and row) and the number of rows.  When the
stream has taken all that is available, the state is read as a table.  Every hit, a row
whose digest is shared, is then compared with the bytes of the row that stays; rows that
differ in spite of an equal digest are grouped again by their whole text.

Defined results: null text is the empty text; null doc_ids count as largest; among rows
with the same doc_id the one at the smallest locator stays; an empty table gives an empty
result; very long texts are rows like any other.  Further columns stay as they are; where one
has the name of a column that :func:`deduplicate` makes, the made one replaces it, while
:func:`keep_first` returns all of the caller's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, delete, give_back, own_columns, scratch_path, small, stage, whole_text

#: Session settings while the stream runs: state on disk, and closed once committed so that executors keep no copy.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Bytes of input that one micro-batch takes.
BATCH_BYTES = 64 << 30


def _files(docs: DataFrame) -> str | None:
    """Path of the Parquet folder or file that ``docs`` scans unchanged, else None."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.isStreaming():
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or "parquet" not in relation.fileFormat().toString().lower():
        return None
    roots = relation.location().rootPaths()
    return roots.head().toString() if roots.size() == 1 else None


def _rows(frame: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The caller's columns as one struct, normalised text, digest and locator of each row."""
    norm = F.regexp_replace(whole_text(), f"[{SPACE}]+", " ")
    meta = F.col("_metadata")
    locator = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    rows = frame.select(own_columns(frame, keep), locator.alias("locator"), norm.alias("norm"))
    return rows.withColumn("digest", F.coalesce(F.sha2(F.encode("norm", "UTF-8"), 256), F.lit("")))


def keyed_state(spark: SparkSession, path: str, schema, state: str) -> DataFrame:
    """(digest, first, n) of every digest, as the stream's state in the folder ``state`` holds it at the end of the input."""
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
            path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)
        seen = _rows(stream).groupBy("digest").agg(F.min("locator").alias("first"), F.count(F.lit(1)).alias("n"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        fresh = query.lastProgress is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if fresh:
        first = "struct<no_id:boolean,id:bigint,file:string,row:bigint>"
        return spark.createDataFrame([], f"digest string, first {first}, n bigint")
    value = spark.read.format("statestore").load(state)
    fields = value.schema["value"].dataType.names
    return value.select(F.col("key.digest"), F.col("value")[fields[0]].alias("first"), F.col("value")[fields[1]].alias("n"))


MADE = ("keep_id", "group_size", "kept", "text_sha256")


def _judged(spark: SparkSession, docs: DataFrame, keep: list[str] | None, state: str | None = None) -> DataFrame:
    """_own, keep_id, group_size, kept and digest of every row."""
    path = _files(docs)
    if path is None:  # anything but the plain scan of a table is written once, so that a stream can read it
        docs = stage(docs, "dedup-input")
        path = _files(docs)
    folder = state or scratch_path(spark, "dedup-state")
    shared = stage(keyed_state(spark, path, docs.schema, folder).where("n > 1"), "dedup-shared")
    if state is None:
        delete(spark, [folder])
    rows = _rows(spark.read.schema(docs.schema).parquet(path), keep)
    tagged = rows.join(small(shared), "digest", "left")
    out = ["_own", *MADE[:3], "digest"]
    alone = tagged.where("n is null").withColumns({"keep_id": F.col("locator.id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out)
    at = shared.select("digest", F.col("first.file").alias("at_file"), F.col("first.row").alias("at_row"))
    bytes_kept = rows.join(small(at), (F.col("locator.file") == F.col("at_file")) & (F.col("locator.row") == F.col("at_row"))).select(at["digest"], F.col("norm").alias("first_norm"))
    hits = tagged.where("n is not null").join(bytes_kept, "digest").withColumn("same", F.col("norm") == F.col("first_norm"))
    checked = stage(hits.select("_own", "digest", "locator", "first", "n", "same", F.when(~F.col("same"), F.col("norm")).alias("norm")), "dedup-hits")
    odd = checked.where(~F.col("same"))
    odd_counts = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_odd"))
    equal = (
        checked.where("same").join(odd_counts, "digest", "left")
        .withColumns({"keep_id": F.col("first.id"), "group_size": F.col("n") - F.coalesce("n_odd", F.lit(0)), "kept": F.col("locator") == F.col("first")})
        .select(*out)
    )
    regrouped = odd.groupBy("digest", "norm").agg(F.min("locator").alias("odd_first"), F.count(F.lit(1)).alias("odd_n"))
    other = (
        odd.join(regrouped, ["digest", "norm"])
        .withColumns({"keep_id": F.col("odd_first.id"), "group_size": F.col("odd_n"), "kept": F.col("locator") == F.col("odd_first")})
        .select(*out)
    )
    return alone.unionByName(equal).unionByName(other)


def deduplicate(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, state: str | None = None) -> DataFrame:
    """The columns of ``docs`` (or those named in ``keep``) with keep_id, group_size, kept and text_sha256 (dropped rows too).

    ``state``: a folder for the keyed state; a later call over the same source with more files goes on from it.
    """
    judged = _judged(spark, docs, keep, state)
    return judged.select(*give_back(docs, keep, MADE), *MADE[:3], F.col("digest").alias("text_sha256"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return _judged(spark, docs, None).where("kept").select(*give_back(docs))
