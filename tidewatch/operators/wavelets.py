"""Orthogonal wavelet packets of series and back: each sample sends its share to the coefficients it touches, so no label has to fit a task."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import LABEL, position


def scaling_filter(wavelet: str) -> np.ndarray:
    """Low-pass reconstruction filter of ``dbN`` (least phase) or ``symN`` (of the same factors the choice nearest to its own mirror image), N from 1 to 10."""
    family, n = wavelet[:-1] if wavelet[-2:] != "10" else wavelet[:-2], int(wavelet[-2:] if wavelet[-2:] == "10" else wavelet[-1])
    if family not in ("db", "sym") or not 1 <= n <= 10:
        raise ValueError("wavelets are db1 to db10 and sym1 to sym10")
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n)][::-1])
    pairs = []  # the roots in z of each real y or conjugate pair of them, the one within the unit circle
    for v in y[np.imag(y) >= -1e-12]:
        z = np.roots([1, 4 * v - 2, 1])
        z = z[np.argmin(np.abs(z))]
        pairs.append([z, np.conj(z)] if abs(v.imag) > 1e-12 else [z.real])

    def made(outside) -> np.ndarray:
        h = np.array([1.0])
        for _ in range(n):
            h = np.convolve(h, [1, 1])
        for roots, out in zip(pairs, outside, strict=True):
            h = np.convolve(h, np.poly([1 / z if out else z for z in roots]).real)
        return h * math.sqrt(2) / h.sum()

    choices = [made(o) for o in itertools.product([False, True], repeat=len(pairs))] if family == "sym" else [made([False] * len(pairs))]
    return min(choices, key=lambda h: round(float(((h - h[::-1]) ** 2).sum()), 9))


def _filters(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    low = scaling_filter(wavelet)
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def wavelet_packets(df: DataFrame, column: str, wavelet: str, levels: int) -> DataFrame:
    """(label, n, path, k, value): the full tree of ``levels`` steps with mirrored ends; nodes named by a and d from the top, ``n`` the label's rows.

    A step of m values gives (m + taps - 1) // 2 of each kind; a missing value counts as zero.
    """
    low, high = _filters(wavelet)
    taps = len(low)
    rows = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    at = df.select(LABEL, position().cast("long").alias("k"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value"))
    now = at.join(rows, LABEL).select(LABEL, "n", F.col("n").alias("m"), F.lit("").alias("path"), "k", "value")
    shares = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(a)).alias("a"), F.lit(float(d)).alias("d")) for j, (a, d) in enumerate(zip(low[::-1], high[::-1], strict=True))])
    for _ in range(levels):
        turns = F.lit(taps) / (2 * F.col("m"))
        copies = now.withColumn("_t", F.explode(F.sequence(-F.ceil(turns), F.ceil(turns)))).withColumn("_e", F.explode(F.array(F.col("k") + 2 * F.col("m") * F.col("_t"), -1 - F.col("k") + 2 * F.col("m") * F.col("_t"))))
        size = F.floor((F.col("m") + taps - 1) / 2)
        sent = copies.where(F.col("_e").between(1 - taps, F.col("m") + taps)).withColumn("_s", F.explode(shares)).withColumn("_k", (F.col("_e") + F.col("_s.j") - 1) / 2)
        sent = sent.where((F.col("_k") == F.floor("_k")) & (F.col("_k") >= 0) & (F.col("_k") < size))
        sums = sent.groupBy(LABEL, "n", size.alias("m"), "path", F.col("_k").cast("long").alias("k")).agg(F.sum(F.col("value") * F.col("_s.a")).alias("a"), F.sum(F.col("value") * F.col("_s.d")).alias("d"))
        both = F.explode(F.array(*[F.struct(F.concat("path", F.lit(c)).alias("path"), F.col(c).alias("value")) for c in "ad"]))
        now = sums.select(LABEL, "n", "m", "k", both.alias("b")).select(LABEL, "n", "m", "b.path", "k", "b.value")
    return now.select(LABEL, "n", "path", "k", "value")


def from_wavelet_packets(packets: DataFrame, wavelet: str, levels: int, nodes: list[str] | None = None) -> DataFrame:
    """(label, k, value) rebuilt from a tree of ``levels`` steps; with ``nodes`` all other nodes count as zero."""
    low, high = _filters(wavelet)
    taps = len(low)
    now = packets if nodes is None else packets.withColumn("value", F.when(F.col("path").isin(*nodes), F.col("value")).otherwise(0.0))
    for level in range(levels, 0, -1):
        size = F.col("n")
        for _ in range(level - 1):
            size = F.floor((size + taps - 1) / 2)
        is_a = F.right("path", F.lit(1)) == "a"
        shares = F.array(*[F.struct(F.lit(j).alias("j"), F.when(is_a, float(a)).otherwise(float(d)).alias("w")) for j, (a, d) in enumerate(zip(low, high, strict=True))])
        sent = now.withColumn("_s", F.explode(shares)).withColumn("_i", 2 * F.col("k") - (taps - 2) + F.col("_s.j")).where((F.col("_i") >= 0) & (F.col("_i") < size))
        now = sent.groupBy(LABEL, "n", F.left("path", F.length("path") - 1).alias("path"), F.col("_i").alias("k")).agg(F.sum(F.col("value") * F.col("_s.w")).alias("value"))
    return now.select(LABEL, F.col("k").cast("long").alias("k"), "value")
