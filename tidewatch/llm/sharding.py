"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a 64-bit ring; a document's key is hashed to a
point and goes to the shard of the next node clockwise.  A shard takes at most its bound:
the first ``n mod shards`` shards one row more than ``n // shards``.  Rows of an arc that
find their shard full continue clockwise to the next node of a shard with room, so counts
differ by one at most (law ``rows``), and only the overflow leaves its ring shard.

Only the counts by arc (``shards * virtual_nodes`` numbers) reach the driver, which lays out
runs (arc, first rank, shard, first slot); a row's rank in its arc comes from its table
partition, so a hot key is dealt like any other rows.

Defined results: null text has no bytes (size 1, CRC of nothing); null doc_ids share one
ring point; repeated rows, ties and groups of equal texts are rows like any other, so a group
is spread over the shards and balance holds whatever its size; a very long text is one row;
an empty table gives no rows; equal counts are met for any number of rows, fewer than shards
included; other columns are ignored.  Which rows of a full arc move on follows their place in
the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_arrow, stage

SHARDS = 8
VIRTUAL_NODES = 128


def point(key: object) -> int:
    return int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "big")


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node points and the shard of each; more shards only add nodes."""
    nodes = sorted((point(f"shard {s} node {v}"), s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in nodes], dtype=np.uint64), np.array([s for _, s in nodes])


def lay_out(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot, shards passed) of bounded loads, arc after arc."""
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs = []
    for arc, n in enumerate(counts):
        at, rank, passed = arc, 0, set()
        while rank < n:
            s = int(owners[at % len(owners)])
            take = min(int(n) - rank, room[s] - used[s])
            if take > 0:
                runs.append((arc, rank, rank + take, s, used[s], len(passed)))
                used[s] += take
                rank += take
            passed.add(s)
            at += 1
    return runs


def _deal(points: np.ndarray):
    """Kernel: size, CRC, arc and the row's rank among this partition's rows of the arc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(points), dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x.as_buffer() for x in batch.column(1)]
            arcs = np.searchsorted(points, np.array([point(i) for i in ids], dtype=np.uint64)) % len(points)
            ranks = np.empty(len(ids), dtype=np.int64)
            for k, a in enumerate(arcs):
                ranks[k] = seen[a]
                seen[a] += 1
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(arcs, pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(ranks)],
                names=["doc_id", "size", "text_crc32", "arc", "part", "rank"],
            )

    return run


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, home_shard (the ring's own) and passed (full shards passed)."""
    spark = docs.sparkSession
    points, owners = ring(shards, virtual_nodes)
    rows = stage(binary_arrow(docs, "doc_id", "text").mapInArrow(_deal(points), "doc_id long, size long, text_crc32 long, arc int, part int, rank long"), "ring-rows")
    by_part = rows.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(len(points), dtype=np.int64)
    for r in by_part.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one number for each node of the ring
        counts[r.arc] = r.n
    runs = spark.createDataFrame(lay_out(counts, owners, shards), "run_arc int, lo long, hi long, shard int, first_slot long, passed int")
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).drop("n")
    homes = F.array(*[F.lit(int(s)) for s in owners])
    ranked = rows.join(before, ["arc", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Runs: a row for each node and one more for each shard that fills, so broadcasting them is bounded.
    held = ranked.join(F.broadcast(runs), (F.col("arc") == F.col("run_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return held.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"), F.get(homes, "arc").alias("home_shard"), "passed")
