"""Seeded generators: uniform tables, a galaxy catalogue, random walks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_table(spark: SparkSession, length: int, columns: list[dict], seed: int = 0, final: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Columns {name, start, end[, func]}: uniform in [start, end), transformed by func(column); one label."""
    df = spark.range(length).select(F.lit("generated_data").alias("label"), F.col("id").alias("idx"), *[F.rand(seed + k).alias(f"_{k}") for k in range(len(columns))])
    for k, c in enumerate(columns):
        value = F.col(f"_{k}") * (c["end"] - c["start"]) + c["start"]
        df = df.withColumn(c["name"], c["func"](value) if c.get("func") else value)
    df = df.drop(*[f"_{k}" for k in range(len(columns))])
    return final(df) if final else df


def nfw_table(scale: float = 1.0, n: int = 513, most: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Radii and cumulative share of members of the projected profile, as a table."""
    r = np.linspace(0, most * scale, 64 * n + 1)
    x = np.maximum(r / scale, 1e-6)
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.where(x < 0.999, (1 - 2 / np.sqrt(np.abs(1 - x * x)) * np.arctanh(np.sqrt(np.clip((1 - x) / (1 + x), 0, 1 - 1e-12)))) / (x * x - 1), np.where(x < 1.001, 1 / 3, (1 - 2 / np.sqrt(np.abs(x * x - 1)) * np.arctan(np.sqrt(np.clip((x - 1) / (1 + x), 0, None)))) / (x * x - 1)))
    y = np.nan_to_num(f) * r
    total = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(r))])
    keep = np.linspace(0, len(r) - 1, n).astype(int)
    return r[keep], total[keep] / total[-1]


def galaxy_catalogue(spark: SparkSession, ra: tuple[float, float], dec: tuple[float, float], density: float, seed: int = 0, members: int = 100, scale_degrees: float = 0.05) -> DataFrame:
    """RA, Dec, Cluster_ID: a uniform background on the sphere inside an open box (-1), and members of one cluster (0)."""
    from ..functions.astro import move_point

    n = int(density * 4 * math.pi * (180 / math.pi) ** 2)
    sky = spark.range(n).select((F.rand(seed) * 360).alias("RA"), F.degrees(F.asin(2 * F.rand(seed + 1) - 1)).alias("Dec"), F.lit(-1).alias("Cluster_ID"))
    sky = sky.where((F.col("RA") > ra[0]) & (F.col("RA") < ra[1]) & (F.col("Dec") > dec[0]) & (F.col("Dec") < dec[1]))
    r, share = nfw_table(scale_degrees)
    grid = np.interp(np.linspace(0, 1, 257), share, r)
    table, at = F.array(*[F.lit(float(v)) for v in grid]), F.col("_u") * 256
    k = F.least(F.floor(at), F.lit(255)).cast("int")
    radius = F.get(table, k) + (at - k) * (F.get(table, k + 1) - F.get(table, k))
    centre = (sum(ra) / 2, sum(dec) / 2)
    drawn = spark.range(members).select(F.rand(seed + 2).alias("_u"), (F.rand(seed + 3) * 360).alias("_b"))
    cluster = drawn.select(move_point(F.lit(centre[0]), F.lit(centre[1]), F.col("_b"), radius).alias("p")).select(F.col("p.ra").alias("RA"), F.col("p.dec").alias("Dec"), F.lit(0).alias("Cluster_ID"))
    return sky.unionByName(cluster).withColumn("label", F.lit("Cluster_Catalog_01"))


def gauss_markov(spark: SparkSession, labels: int, length: int, tau: float, variance: float, noise: float, seed: int = 0) -> DataFrame:
    """(label, pos, measurement, state): a simulated series for each label."""
    import pandas as pd

    from ..operators.kernels import simulate_fogm

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["id"].iloc[0])
        z, x = simulate_fogm(length, tau, variance, noise, seed + k)
        return pd.DataFrame({"label": str(k), "pos": range(length), "measurement": z, "state": x})

    return spark.range(labels).groupBy("id").applyInPandas(kernel, "label string, pos long, measurement double, state double")


def uniform_walk(box: tuple[float, float, float, float], n: int, seed: int = 0) -> np.ndarray:
    """n proposals in a box (centre x, centre y, width, height)."""
    cx, cy, w, h = box
    return np.random.default_rng(seed).uniform([cx - w / 2, cy - h / 2], [cx + w / 2, cy + h / 2], (n, 2))


def gaussian_walk(start: tuple[float, float], box: tuple[float, float, float, float], step: float, n: int, seed: int = 0) -> np.ndarray:
    """n steps of a Gaussian walk kept in the box."""
    rng, cx, cy, w, h = np.random.default_rng(seed), *box
    low, high = np.array([cx - w / 2, cy - h / 2]), np.array([cx + w / 2, cy + h / 2])
    out = [np.clip(np.array(start, float), low, high)]
    for _ in range(n):
        out.append(np.clip(out[-1] + rng.normal(0, step, 2), low, high))
    return np.array(out[1:])
