"""Gap filling, resampling and trends of labelled series (T rows of the survey) as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, along, position

#: Periods in days of the seasonal fits.
PERIODS = (365.0, 182.5, 91.25, 30.5)


def _fill(column: str, clamp: bool) -> Column:
    """Linear by position between the values around a gap; the next value is the last one seen from the end."""
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(LABEL).orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(column).isNotNull(), F.col("_pos"))
    v0, p0 = F.last(column, True).over(back), F.last(known, True).over(back)
    v1, p1 = F.last(column, True).over(ahead), F.last(known, True).over(ahead)
    between = v0 + (v1 - v0) * (F.col("_pos") - p0) / F.nullif(p1 - p0, F.lit(0))
    out = F.coalesce(F.col(column), between, v0)
    return F.coalesce(out, v1) if clamp else out


def interpolate_clamped(df: DataFrame, columns: list[str]) -> DataFrame:
    """Linear by position; both ends take the nearest value."""
    return df.withColumn("_pos", position()).withColumns({c: _fill(c, True) for c in columns}).drop("_pos")


def interpolate_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """Linear by position; leading gaps stay, trailing ones take the last value."""
    return df.withColumn("_pos", position()).withColumns({c: _fill(c, False) for c in columns}).drop("_pos")


def resample(df: DataFrame, start=None, end=None, step: str = "1 day") -> DataFrame:
    """Each label on the regular range of times: no aggregation, rows off the range go, missing ones are NULL."""
    own = df.groupBy(LABEL).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"))
    kind = df.schema[TIME].dataType.simpleString()
    a = F.lit(start).cast(kind) if start is not None else F.col("_a")
    b = F.lit(end).cast(kind) if end is not None else F.col("_b")
    grid = own.select(LABEL, F.explode(F.sequence(a, b, F.expr(f"INTERVAL {step}"))).alias(TIME))
    return grid.join(df, [LABEL, TIME], "left")


def line_fit(df: DataFrame, column: str) -> DataFrame:
    """(label, slope, intercept) of the least-squares line over positions, NULLs skipped."""
    at = df.withColumn("_pos", position())
    return at.groupBy(LABEL).agg(F.regr_slope(column, "_pos").alias("slope"), F.regr_intercept(column, "_pos").alias("intercept"))


def detrend(df: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """Subtract each label's line; ``keep`` also returns slope, intercept and trend.  The sums are taken once a label and joined back."""
    at = df.withColumn("_pos", position())
    lines = at.groupBy(LABEL).agg(F.regr_slope(column, "_pos").alias("slope"), F.regr_intercept(column, "_pos").alias("intercept"))
    at = at.join(lines, LABEL).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("_pos"))
    out = at.withColumn(column, F.col(column) - F.col("trend")).drop("_pos")
    return out if keep else out.drop("slope", "intercept", "trend")


def seasonal_fit(df: DataFrame, column: str, periods: int = 2, name: str = "fit") -> DataFrame:
    """Sum of independent fits ``a cos + b sin + c`` for the first ``periods`` periods, each with its constant.

    The 3 by 3 normal equations of each fit are solved in closed form from sums, taken once a label.
    """
    df = df.withColumn("_pos", position())
    known, x = F.when(F.col(column).isNotNull(), 1.0), F.col(column)
    wave = lambda period: (F.cos(F.col("_pos") * (2 * math.pi / period)), F.sin(F.col("_pos") * (2 * math.pi / period)))
    sums, total = {"_w": F.sum(known), "_y": F.sum(x)}, F.lit(0.0)
    for k, period in enumerate(PERIODS[:periods]):
        c, s = wave(period)
        for key, v in {"c": c * known, "s": s * known, "cc": c * c * known, "ss": s * s * known, "cs": c * s * known, "cy": c * x, "sy": s * x}.items():
            sums[f"_{key}{k}"] = F.sum(v)
    df = df.join(df.groupBy(LABEL).agg(*[v.alias(key) for key, v in sums.items()]), LABEL)
    for k, period in enumerate(PERIODS[:periods]):
        m = lambda key: F.col(f"_{key}{k}")  # noqa: B023, E731
        n, y = F.col("_w"), F.col("_y")
        # Centred covariances reduce the system to two by two.
        cc, ss, cs = m("cc") - m("c") * m("c") / n, m("ss") - m("s") * m("s") / n, m("cs") - m("c") * m("s") / n
        cy, sy = m("cy") - m("c") * y / n, m("sy") - m("s") * y / n
        det = cc * ss - cs * cs
        a, b = (cy * ss - sy * cs) / det, (sy * cc - cy * cs) / det
        c, s = wave(period)
        total = total + a * c + b * s + (y - a * m("c") - b * m("s")) / n
    return df.withColumn(name, total).drop("_pos", *sums)


def trend_filter(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Take out ``linear``, then ``annual`` or ``semiannual`` (both periods), one after the other."""
    unknown = set(parts) - {"linear", "annual", "semiannual"}
    if unknown:
        raise ValueError(f"unknown trends {sorted(unknown)}")
    if "linear" in parts:
        df = detrend(df, column)
    if "semiannual" in parts or "annual" in parts:
        df = seasonal_fit(df, column, 2 if "semiannual" in parts else 1, "_fit").withColumn(column, F.col(column) - F.col("_fit")).drop("_fit")
    return df


def step_detrend(df: DataFrame, column: str) -> DataFrame:
    """Find the step that a one-split regression tree finds, close it and take out the line.

    The later part is shifted by the median of the four rows before the earlier part's last
    one less the median of its own first five.
    """
    w, everything = along(), Window.partitionBy(LABEL)
    known = df.where(F.col(column).isNotNull()).withColumns({"_pos": position(), "_n": F.count(F.lit(1)).over(everything)})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s, t = F.sum(column).over(upto), F.sum(column).over(everything)
    k = F.col("_pos") + 1
    gain = F.when(k < F.col("_n"), s * s / k + (t - s) * (t - s) / (F.col("_n") - k))
    known = known.withColumn("_gain", gain)
    best = known.groupBy(LABEL).agg(F.max_by("_pos", F.struct("_gain", -F.col("_pos"))).alias("_at"))
    known = known.join(best, LABEL)
    before = F.when((F.col("_pos") <= F.col("_at") - 1) & (F.col("_pos") >= F.col("_at") - 4), F.col(column))
    after = F.when((F.col("_pos") > F.col("_at")) & (F.col("_pos") <= F.col("_at") + 5), F.col(column))
    level = F.coalesce(F.percentile(before, 0.5).over(everything) - F.percentile(after, 0.5).over(everything), F.lit(0.0))
    known = known.withColumn("_level", level).withColumn(column, F.col(column) + F.when(F.col("_pos") > F.col("_at"), F.col("_level")).otherwise(0.0))
    line = F.regr_intercept(column, "_pos").over(everything) + F.regr_slope(column, "_pos").over(everything) * F.col("_pos")
    closed = known.withColumn("_line", line).select(LABEL, TIME, (F.col(column) - F.col("_line")).alias(column))
    return df.drop(column).join(closed, [LABEL, TIME], "left")


def antenna_offsets(df: DataFrame, column: str, events: DataFrame, min_diff: float = 0.0, near: int = 10) -> DataFrame:
    """Take out steps at logged times (label, ts): differences of the medians of ``near`` rows around, if larger than ``min_diff``."""
    marks = events.select(LABEL, F.col(TIME).alias("event")).distinct()
    sides = df.where(F.col(column).isNotNull()).join(marks, LABEL).withColumn("_after", F.col(TIME) >= F.col("event"))
    close = F.row_number().over(Window.partitionBy(LABEL, "event", "_after").orderBy(F.abs(F.unix_micros(F.col(TIME).cast("timestamp")) - F.unix_micros(F.col("event").cast("timestamp")))))
    steps = sides.withColumn("_r", close).where(F.col("_r") <= near).groupBy(LABEL, "event").agg((F.percentile(F.when(F.col("_after"), F.col(column)), 0.5) - F.percentile(F.when(~F.col("_after"), F.col(column)), 0.5)).alias("step"))
    steps = steps.where(F.abs("step") > min_diff)
    shift = df.select(LABEL, TIME).join(steps, LABEL).where(F.col(TIME) >= F.col("event")).groupBy(LABEL, TIME).agg(F.sum("step").alias("_shift"))
    return df.join(shift, [LABEL, TIME], "left").withColumn(column, F.col(column) - F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def decimate(df: DataFrame, step: int = 100) -> DataFrame:
    return df.withColumn("_pos", position()).where(F.col("_pos") % step == 0).drop("_pos")


def rescale(df: DataFrame, column: str, end: float = 1.0) -> DataFrame:
    """Min-max scaled to [0, end] within each label."""
    w = Window.partitionBy(LABEL)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(column, (F.col(column) - low) / F.nullif(high - low, F.lit(0.0)) * end)


def unix_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def spiral(df: DataFrame, period_days: float) -> DataFrame:
    """Polar coordinates of a series wound by a period: radius in days from the start, angle by the period."""
    days = F.unix_micros(F.col(TIME).cast("timestamp")) / 86_400_000_000
    r = days - F.min(days).over(Window.partitionBy(LABEL))
    return df.withColumns({"radius": r, "theta": 2 * math.pi * r / period_days})


def haar(df: DataFrame, column: str) -> DataFrame:
    """One Haar step: (label, k, approx, detail) of pairs of rows; an odd last row pairs with itself."""
    at = df.withColumn("_pos", position()).withColumns({"k": F.floor(F.col("_pos") / 2), "_odd": F.col("_pos") % 2})
    pair = at.groupBy(LABEL, "k").agg(F.max(F.when(F.col("_odd") == 0, F.col(column))).alias("x0"), F.max(F.when(F.col("_odd") == 1, F.col(column))).alias("x1"))
    x1 = F.coalesce("x1", "x0")
    return pair.select(LABEL, "k", ((F.col("x0") + x1) / math.sqrt(2)).alias("approx"), ((F.col("x0") - x1) / math.sqrt(2)).alias("detail"))


def inverse_haar(pairs: DataFrame) -> DataFrame:
    """(label, pos, value) from one Haar step."""
    a, d = F.col("approx"), F.col("detail")
    both = F.explode(F.array(F.struct((2 * F.col("k")).alias("pos"), ((a + d) / math.sqrt(2)).alias("value")), F.struct((2 * F.col("k") + 1).alias("pos"), ((a - d) / math.sqrt(2)).alias("value"))))
    return pairs.select(LABEL, both.alias("b")).select(LABEL, "b.*")


def usable_points(df: DataFrame, column: str, index: str = "days") -> DataFrame:
    """(label, index, value) of the finite values: the index in days from the label's first row, its row number (``rows``) or an angle to 2 pi (``angle``)."""
    w = Window.partitionBy(LABEL)
    days = F.unix_micros(F.col(TIME).cast("timestamp")) / 86_400_000_000
    made = {"days": days - F.min(days).over(w), "rows": position().cast("double"), "angle": position() * (2 * math.pi) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0))}
    if index not in made:
        raise ValueError(f"index is one of {sorted(made)}")
    at = df.select(LABEL, made[index].alias("index"), F.col(column).cast("double").alias("value"))
    return at.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def haar_packets(df: DataFrame, column: str, levels: int) -> DataFrame:
    """(label, path, k, value): the full tree of Haar steps, its nodes named by a (sum) and d (difference) from the top."""
    now = df.select(LABEL, F.lit("").alias("path"), position().alias("k"), F.col(column).alias("value"))
    for _ in range(levels):
        even = F.max(F.when(F.col("k") % 2 == 0, F.col("value")))
        odd = F.coalesce(F.max(F.when(F.col("k") % 2 == 1, F.col("value"))), even)
        pairs = now.groupBy(LABEL, "path", F.floor(F.col("k") / 2).alias("k")).agg(even.alias("x0"), odd.alias("x1"))
        step = lambda letter, v: F.struct(F.concat("path", F.lit(letter)).alias("path"), (v / math.sqrt(2)).alias("value"))
        both = F.explode(F.array(step("a", F.col("x0") + F.col("x1")), step("d", F.col("x0") - F.col("x1"))))
        now = pairs.select(LABEL, "k", both.alias("s")).select(LABEL, "s.path", "k", "s.value")
    return now


def from_packets(packets: DataFrame, nodes: list[str] | None = None) -> DataFrame:
    """(label, k, value) rebuilt from a tree of Haar steps; with ``nodes`` all other nodes count as zero."""
    now = packets if nodes is None else packets.withColumn("value", F.when(F.col("path").isin(*nodes), F.col("value")).otherwise(0.0))
    for _ in range(packets.agg(F.max(F.length("path"))).first()[0] or 0):
        last = F.right("path", F.lit(1))
        up = now.groupBy(LABEL, F.left("path", F.length("path") - 1).alias("path"), "k").agg(F.max(F.when(last == "a", F.col("value"))).alias("a"), F.max(F.when(last == "d", F.col("value"))).alias("d"))
        both = F.explode(F.array(F.struct((2 * F.col("k")).alias("k"), ((F.col("a") + F.col("d")) / math.sqrt(2)).alias("value")), F.struct((2 * F.col("k") + 1).alias("k"), ((F.col("a") - F.col("d")) / math.sqrt(2)).alias("value"))))
        now = up.select(LABEL, "path", both.alias("s")).select(LABEL, "path", "s.k", "s.value")
    return now.select(LABEL, "k", "value")
