"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

MAX_ROUNDS = 60


def _stars(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _stars(both).where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    stars = _stars(down)
    links = stars.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return links.unionByName(stars.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node reachable."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        new = stage(_small_star(_large_star(now)), "edges")
        drop_stage(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    else:
        raise RuntimeError("components: no fixed point")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
