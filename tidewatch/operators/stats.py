"""Aggregations and statistics of labelled tables (A rows of the survey)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, melt
from .filters import round_dates

#: Fixed value: scale of a normal distribution's median absolute deviation.
MAD_SCALE = 0.6744897501960817


def pairs_of_series(series: DataFrame) -> DataFrame:
    """All pairs (k1 <= k2) of series values at equal times: an equi-join on time."""
    a = series.select(F.col("key").alias("k1"), TIME, F.col("value").alias("x"))
    b = series.select(F.col("key").alias("k2"), TIME, F.col("value").alias("y"))
    return a.join(b, TIME).where("k1 <= k2 AND x IS NOT NULL AND y IS NOT NULL")


def correlate(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(k1, k2, n, r) of all pairs of label.column series over their common times; k1 <= k2, mirror for the rest."""
    series = melt(df, columns).select(F.concat_ws(".", LABEL, "name").alias("key"), TIME, "value")
    return _correlation(pairs_of_series(series), ["k1", "k2"], method)


def correlate_columns(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(label, k1, k2, n, r): the matrix of the columns of each label."""
    a = melt(df, columns, "x", "k1")
    b = melt(df, columns, "y", "k2")
    pairs = a.join(b, [LABEL, TIME]).where("k1 <= k2 AND x IS NOT NULL AND y IS NOT NULL")
    return _correlation(pairs, [LABEL, "k1", "k2"], method)


def _correlation(pairs: DataFrame, keys: list[str], method: str) -> DataFrame:
    if method == "pearson":
        return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    if method == "spearman":  # average ranks among the rows that both have
        rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
        ranked = pairs.withColumns({"_rx": rank("x"), "_ry": rank("y")})
        return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("r"))
    if method == "kendall":  # tau-b by inversions in a kernel for each pair of series
        import numpy as np
        import pandas as pd

        def swaps(y: np.ndarray) -> int:
            """Pairs out of order, counted while halves are merged."""
            total, width = 0, 1
            while width < len(y):
                for lo in range(0, len(y) - width, 2 * width):
                    a, b = y[lo : lo + width], y[lo + width : lo + 2 * width]
                    total += int((len(a) - np.searchsorted(a, b, "right")).sum())
                    y[lo : lo + len(a) + len(b)] = np.sort(np.concatenate([a, b]), kind="stable")
                width *= 2
            return total

        def tied(*columns: np.ndarray) -> int:
            n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
            return int((n * (n - 1) // 2).sum())

        def tau(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            n, order = len(x) * (len(x) - 1) // 2, np.lexsort((y, x))
            ties_x, ties_y = tied(x), tied(y)
            concordant = n - ties_x - ties_y + tied(x, y) - 2 * swaps(y[order].copy())
            below = math.sqrt((n - ties_x) * (n - ties_y))
            return pd.DataFrame([(*key, len(x), concordant / below if below else None)])

        schema = ", ".join([*(f"{k} string" for k in keys), "n long", "r double"])
        return pairs.groupBy(*keys).applyInPandas(tau, schema)
    raise ValueError("method is 'pearson', 'spearman' or 'kendall'")


def trimmed_skew(df: DataFrame, column: str, share: float = 0.02) -> DataFrame:
    """(label, n, skew): population skewness without the lowest and highest 2 percent of values."""
    known = df.where(F.col(column).isNotNull())
    at = known.withColumns({"_r": F.row_number().over(Window.partitionBy(LABEL).orderBy(column, TIME)), "_n": F.count(F.lit(1)).over(Window.partitionBy(LABEL))})
    cut = F.bround(F.col("_n") * share, 0)
    return at.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), F.skewness(column).alias("skew"))


def mad_scale(df: DataFrame, column: str, prefix: str = "MAD_Scale_") -> DataFrame:
    """New column: the value over its label's scaled median absolute deviation (not centred)."""
    w = Window.partitionBy(LABEL)
    df = df.withColumn("_med", F.percentile(column, 0.5).over(w)).withColumn("_dev", F.abs(F.col(column) - F.col("_med")))
    mad = F.percentile("_dev", 0.5).over(w) / MAD_SCALE
    return df.withColumn("_mad", mad).withColumn(prefix + column, F.col(column) / F.nullif("_mad", F.lit(0.0))).drop("_med", "_dev", "_mad")


def midas(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """(label, n, velocity, uncertainty) from the median of differences ``days`` apart, cut at two deviations."""
    x = df.where(F.col(column).isNotNull()).select(LABEL, TIME, F.col(column).alias("x"))
    later = x.select(LABEL, (F.col(TIME) - F.expr(f"INTERVAL {days} DAYS")).alias(TIME), F.col("x").alias("y"))
    d = x.join(later, [LABEL, TIME]).select(LABEL, (F.col("y") - F.col("x")).alias("d"))
    w = Window.partitionBy(LABEL)
    d = d.withColumn("_med", F.percentile("d", 0.5).over(w)).withColumn("_dev", F.abs(F.col("d") - F.col("_med")))
    d = d.withColumn("_mad", F.percentile("_dev", 0.5).over(w) / MAD_SCALE)
    kept = d.where((F.col("d") > F.col("_med") - 2 * F.col("_mad")) & (F.col("d") < F.col("_med") + 2 * F.col("_mad")))
    kept = kept.withColumn("_v", F.percentile("d", 0.5).over(w)).withColumn("_kdev", F.abs(F.col("d") - F.col("_v")))
    mad = F.percentile("_kdev", 0.5) / MAD_SCALE
    return kept.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), F.first("_v").alias("velocity"), (math.sqrt(math.pi / 2) * mad / F.sqrt(F.count(F.lit(1)))).alias("uncertainty"))


def zscore(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    w = Window.partitionBy(LABEL)
    return df.withColumn(name or column, (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_samp(column).over(w), F.lit(0.0)))


def group_median_normalize(df: DataFrame, column: str, group: str) -> DataFrame:
    """The value over the median of its label and group."""
    med = F.percentile(column, 0.5).over(Window.partitionBy(LABEL, group))
    return df.withColumn(column, F.col(column) / F.nullif(med, F.lit(0.0)))


def remove_common_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Subtract the mean over all labels at each time."""
    w = Window.partitionBy(TIME)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def clip_uncertain(df: DataFrame, column: str, error: str, clip: float = 5.0) -> DataFrame:
    """NULL value and error where the error exceeds ``clip`` times its label's median."""
    df = df.withColumn("_limit", clip * F.percentile(error, 0.5).over(Window.partitionBy(LABEL)))
    fine = ~F.coalesce(F.col(error) > F.col("_limit"), F.lit(False))
    return df.withColumns({column: F.when(fine, F.col(column)), error: F.when(fine, F.col(error))}).drop("_limit")


def calibrate_mass(df: DataFrame, meta: DataFrame, solutions: list[str], name: str = "EWD", rounded: bool = True, scaled: bool = True) -> DataFrame:
    """Mean of the solutions (NULLs skipped) times the label's scale factor, with its measurement error."""
    values = F.filter(F.array(*solutions), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    df = df.join(meta.select(LABEL, "scale_factor", "measurement_error"), LABEL, "left")
    df = df.withColumns({name: mean * F.col("scale_factor") if scaled else mean, f"{name}_Error": F.col("measurement_error")}).drop("scale_factor", "measurement_error")
    return round_dates(df) if rounded else df


def calibrate_mascon(df: DataFrame, meta: DataFrame, name: str = "EWD", rounded: bool = True, scaled: bool = True) -> DataFrame:
    if scaled:
        df = df.join(meta.select(LABEL, "scale_factor"), LABEL, "left").withColumn(name, F.col(name) * F.col("scale_factor")).drop("scale_factor")
    return round_dates(df) if rounded else df


def scale_image(cells: DataFrame, key: str = "label", value: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    """Values to 0..255: clipped to [low, high], by default the image's median less and plus one deviation."""
    w = Window.partitionBy(key)
    df = cells.withColumn("_med", F.percentile(value, 0.5).over(w)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    df = df.withColumn("_mad", F.percentile("_dev", 0.5).over(w) / MAD_SCALE)
    a = F.lit(low) if low is not None else F.col("_med") - F.col("_mad")
    b = F.lit(high) if high is not None else F.col("_med") + F.col("_mad")
    clipped = F.least(F.greatest(F.col(value), a), b)
    return df.withColumn("scaled", F.bround((clipped - a) / F.nullif(b - a, F.lit(0.0)) * 255, 0).cast("short")).drop("_med", "_dev", "_mad")


def run_distances(results: DataFrame, key: str, value: str) -> DataFrame:
    """(run_i, run_j, distance): Euclidean distances between runs over the rows of equal key; run_i <= run_j."""
    a = results.select(F.col("run_id").alias("run_i"), key, F.col(value).alias("x"))
    b = results.select(F.col("run_id").alias("run_j"), key, F.col(value).alias("y"))
    return a.join(b, key).where("run_i <= run_j").groupBy("run_i", "run_j").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))


def run_means(results: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over runs."""
    return results.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def two_sample_ks(df: DataFrame, value: str, sample: str) -> DataFrame:
    """(label, n1, n2, statistic, p_value) of the Kolmogorov-Smirnov test of two samples (column ``sample``: 0 or 1)."""
    w = Window.partitionBy(LABEL)
    df = df.withColumns({"_n1": F.sum(1 - F.col(sample)).over(w), "_n2": F.sum(sample).over(w)})
    upto = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum(1 - F.col(sample)).over(upto) / F.col("_n1") - F.sum(sample).over(upto) / F.col("_n2"))
    out = df.withColumn("_gap", gap).groupBy(LABEL).agg(F.max("_n1").alias("n1"), F.max("_n2").alias("n2"), F.max("_gap").alias("statistic"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("statistic")
    p = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(2, 60)), 2.0 * F.exp(-2.0 * lam * lam))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(lam < 0.2, 1.0).otherwise(p))))


def one_sample_ks(df: DataFrame, value: str, cdf) -> DataFrame:
    """(label, n, statistic): distance of the sample's distribution from ``cdf`` (a function of a column)."""
    w = Window.partitionBy(LABEL)
    at = df.withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(value).over(w), "_f": cdf(F.col(value))})
    gap = F.greatest(F.col("_r") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_r") - 1) / F.col("_n"))
    return at.withColumn("_gap", gap).groupBy(LABEL).agg(F.max("_n").alias("n"), F.max("_gap").alias("statistic"))


def anderson_two_sample(df: DataFrame, value: str, sample: str) -> DataFrame:
    """(label, statistic): two-sample Anderson-Darling statistic (right-continuous form, no ties corrected)."""
    w = Window.partitionBy(LABEL)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = df.withColumns({"_i": F.row_number().over(w.orderBy(value)), "_N": F.count(F.lit(1)).over(w), "_m": F.sum(1 - F.col(sample)).over(w), "_mi": F.sum(1 - F.col(sample)).over(upto)})
    term = F.when(F.col("_i") < F.col("_N"), F.pow(F.col("_mi") * F.col("_N") - F.col("_i") * F.col("_m"), 2) / (F.col("_i") * (F.col("_N") - F.col("_i"))))
    return at.withColumn("_t", term).groupBy(LABEL).agg((F.sum("_t") / (F.first("_m") * (F.first("_N") - F.first("_m")))).alias("statistic"))


def ellipse_favourability(cells: DataFrame, major: float, minor: float, azimuth: float, degrees: float, value: str = "value") -> DataFrame:
    """(raster_id, j, i, mean, std) of the values inside an ellipse around each cell; ``degrees`` bounds its reach.

    Cells are joined by blocks of the bounding size, so a cell meets only its surroundings.
    """
    from ..functions.geodesy import in_ellipse

    a = cells.withColumns({"_bx": F.floor(F.col("lon") / degrees), "_by": F.floor(F.col("lat") / degrees)})
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), x -> struct(y, x))))")).alias("o")
    b = a.select("raster_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col(value).alias("v2"), "_bx", "_by", near).withColumns({"_bx": F.col("_bx") + F.col("o.x"), "_by": F.col("_by") + F.col("o.y")}).drop("o")
    met = a.join(b, ["raster_id", "_bx", "_by"]).where(in_ellipse(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), F.lit(major), F.lit(minor), F.lit(azimuth)))
    return met.groupBy("raster_id", "j", "i").agg(F.avg("v2").alias("mean"), F.stddev_pop("v2").alias("std"))


def targets_at_cells(arrays: DataFrame) -> DataFrame:
    """(j, i, targets): the targets whose travel time is zero in a cell."""
    return arrays.where("time = 0").groupBy("j", "i").agg(F.array_sort(F.collect_set("target")).alias("targets"))
