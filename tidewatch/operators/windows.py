"""Rolling and neighbourhood operators (W rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, along, position


def centred(n: int):
    """ROWS frame of n rows around the present one; even n takes one row more before."""
    return along().rowsBetween(-(n // 2), (n - 1) // 2)


def rolling_median(df: DataFrame, column: str, n: int, min_periods: int = 1, name: str = "median") -> DataFrame:
    """Median of the centred window, NULLs skipped, NULL below ``min_periods`` values."""
    enough = F.count(column).over(centred(n)) >= min_periods
    return df.withColumn(name, F.when(enough, F.percentile(column, 0.5).over(centred(n))))


def reflected_median(df: DataFrame, column: str, n: int, name: str = "median") -> DataFrame:
    """Rank median with mirrored ends (the edge row repeated); of an even window the upper middle value.

    The rows that the mirrored ends need are added as copies, so every window has n rows and no array holds a label.
    """
    before, after = n // 2, (n - 1) // 2
    at = df.withColumns({"_pos": position(), "_n": F.count(F.lit(1)).over(Window.partitionBy(LABEL))})
    period = 2 * F.col("_n")
    # A row at p lies at p + t * period and at -1 - p + t * period.
    turns = F.sequence(F.floor(-before / period).cast("int") - 1, F.ceil(after / period).cast("int") + 1)
    spots = F.concat(F.transform(turns, lambda t: F.col("_pos") + t * period), F.transform(turns, lambda t: -1 - F.col("_pos") + t * period))
    copies = at.select(LABEL, F.col(column).alias("_v"), "_n", F.explode(F.filter(spots, lambda q: (q >= -before) & (q < F.col("_n") + after))).alias("_at"))
    window = F.collect_list("_v").over(Window.partitionBy(LABEL).orderBy("_at").rowsBetween(-before, after))
    medians = copies.withColumn(name, F.get(F.sort_array(window), F.lit(n // 2))).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
    return at.join(medians.select(LABEL, F.col("_at").alias("_pos"), name), [LABEL, "_pos"]).drop("_pos", "_n")


def range_median(df: DataFrame, column: str, span_us: int, name: str = "median") -> DataFrame:
    """For each non-NULL row the median over times strictly within half a span (microseconds)."""
    t = F.unix_micros(F.col(TIME).cast("timestamp"))
    frame = Window.partitionBy(LABEL).orderBy(t).rangeBetween(-(span_us // 2) + 1, span_us // 2 - 1)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.percentile(column, 0.5).over(frame)))


def median_filter(df: DataFrame, column: str, window: int, interpolate: bool = True, subtract: bool = False, regular: bool = True, min_periods: int = 1, day_us: int = 86_400_000_000, update: bool = False) -> DataFrame:
    """The three modes: filled and mirrored, by time range, or centred rows; ``subtract`` leaves the residual.

    With ``update``, the form for single series, a row without a result keeps its value.
    """
    from .series import interpolate_forward

    if interpolate:
        df = reflected_median(interpolate_forward(df, [column]), column, window, "_m")
    elif not regular:
        df = range_median(df, column, window * day_us, "_m")
    else:
        df = rolling_median(df, column, window, min_periods, "_m")
    out = F.col(column) - F.col("_m") if subtract else F.col("_m")
    return df.withColumn(column, F.coalesce(out, F.col(column)) if update else out).drop("_m")


def weighted_average(df: DataFrame, column: str, window: int, error: str | None = None, mask: bool = False) -> DataFrame:
    """Centred inverse-variance mean and its error; a plain mean without errors.

    As in the model followed, the weights of rows without a value count; ``mask`` skips them.
    """
    w = centred(window)
    if error is None:
        return df.withColumn(column, F.avg(column).over(w))
    weight = 1 / (F.col(error) * F.col(error))
    counted = F.when(F.col(column).isNotNull(), weight) if mask else weight
    total = F.sum(counted).over(w)
    return df.withColumns({column: F.sum(F.col(column) * weight).over(w) / total, error: 1 / F.sqrt(total)})


def rolling_std_over(df: DataFrame, column: str, n: int, threshold: float) -> DataFrame:
    """For each label the number of full trailing windows whose standard deviation exceeds the threshold."""
    w = along().rowsBetween(-(n - 1), 0)
    full = df.withColumn("_s", F.when(F.count(column).over(w) == n, F.stddev_samp(column).over(w)))
    return full.groupBy(LABEL).agg(F.count_if(F.col("_s") > threshold).alias("n_over"))


def gap_segments(df: DataFrame, gap_seconds: float, name: str = "segment") -> DataFrame:
    """Number of the gap-free segment: a new one starts where more than the gap has passed."""
    t = F.unix_micros(F.col(TIME).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(along()) > int(gap_seconds * 1e6)).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(along())).drop("_new")


def remove_jumps(df: DataFrame, column: str, cut: float = 0.25, max_gap_seconds: float = 60.0, by_day: bool = False) -> DataFrame:
    """Take out steps larger than ``cut`` between rows closer than the gap: what is earlier is shifted to the last level.

    ``by_day`` treats the start of a day like a step, whatever its size.
    """
    t = F.unix_micros(F.col(TIME).cast("timestamp"))
    step = F.col(column) - F.lag(column).over(along())
    split = F.abs(step) > cut
    if by_day:
        split = split | (F.to_date(TIME) != F.to_date(F.lag(TIME).over(along())))
    jump = F.when(split & (t - F.lag(t).over(along()) < int(max_gap_seconds * 1e6)), step).otherwise(0.0)
    df = df.withColumn("_jump", F.coalesce(jump, F.lit(0.0)))
    later = Window.partitionBy(LABEL).orderBy(F.col(TIME).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(column, F.col(column) + F.coalesce(F.sum("_jump").over(later), F.lit(0.0))).drop("_jump")


def gradient(column: Column, window) -> Column:
    """Central differences of unit steps, one-sided at the ends."""
    before, after = F.lag(column).over(window), F.lead(column).over(window)
    return F.when(before.isNull() & after.isNull(), F.lit(None).cast("double")).when(before.isNull(), after - column).when(after.isNull(), column - before).otherwise((after - before) / 2)


def grid_slope(cells: DataFrame, value: str, dx: Column, dy: Column) -> DataFrame:
    """Slope in degrees of cells (j, i): central differences over cell sizes dx and dy."""
    gx = gradient(F.col(value), Window.partitionBy("raster_id", "j").orderBy("i")) / dx
    gy = gradient(F.col(value), Window.partitionBy("raster_id", "i").orderBy("j")) / dy
    return cells.withColumns({"_gx": gx, "_gy": gy}).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)))).drop("_gx", "_gy")


def _around(cells: DataFrame, value: str) -> DataFrame:
    """Columns z<dj>_<di> and cell positions of the eight neighbours (inside the raster)."""
    row, col = Window.partitionBy("raster_id", "j").orderBy("i"), Window.partitionBy("raster_id", "i").orderBy("j")
    df = cells.withColumns({"z0_-1": F.lag(value).over(row), "z0_1": F.lead(value).over(row)})
    for name in (value, "z0_-1", "z0_1"):
        di = {value: 0, "z0_-1": -1, "z0_1": 1}[name]
        df = df.withColumns({f"z-1_{di}": F.lag(name).over(col), f"z1_{di}": F.lead(name).over(col)})
    return df


def horn_slope(cells: DataFrame, value: str = "value", radius: float = 6371.0) -> DataFrame:
    """Weighted 3 by 3 slope in degrees of cells (raster_id, j, i, lon, lat); NULL at the border.

    Every difference is divided by the great-circle distance of the two cells it uses.
    """
    from ..functions.geodesy import haversine

    df = _around(cells, value)
    col = Window.partitionBy("raster_id", "i").orderBy("j")
    row = Window.partitionBy("raster_id", "j").orderBy("i")
    lat_up, lat_down = F.lag("lat").over(col), F.lead("lat").over(col)
    lon_west, lon_east = F.lag("lon").over(row), F.lead("lon").over(row)
    df = df.withColumns({"_up": lat_up, "_down": lat_down, "_west": lon_west, "_east": lon_east})
    across = lambda lat: haversine(lat, F.col("_west"), lat, F.col("_east"), radius)
    along_ = haversine(F.col("_up"), F.col("lon"), F.col("_down"), F.col("lon"), radius)
    z = lambda j, i: F.col(f"`z{j}_{i}`")
    dx = ((z(-1, 1) - z(-1, -1)) / across(F.col("_up")) + 2 * (z(0, 1) - z(0, -1)) / across(F.col("lat")) + (z(1, 1) - z(1, -1)) / across(F.col("_down"))) / 4
    dy = ((z(-1, -1) - z(1, -1)) + 2 * (z(-1, 0) - z(1, 0)) + (z(-1, 1) - z(1, 1))) / along_ / 4
    return df.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).select(*cells.columns, "slope")


def neighbour_std(cells: DataFrame, height: int, width: int, value: str = "value", window: int = 3, planet: bool = True) -> DataFrame:
    """Population standard deviation around each cell, NULLs skipped.

    The border wraps in longitude and crosses the poles (``planet``) or is mirrored.
    """
    half, j, i = window // 2, F.col("j"), F.col("i")
    within = lambda n, size: (n >= -half) & (n < size + half)
    # Where a cell appears in the raster with its border: at its own place, and as the copies that the border takes of it.
    rows = F.filter(F.array(j, -j - 1, 2 * height - 1 - j), lambda n: within(n, height))
    if planet:
        base = lambda n: F.when((n < 0) | (n >= height), width - 1 - i).otherwise(i)
        columns = lambda n: F.array(*[base(n) + k * width for k in (-1, 0, 1)])
    else:
        columns = lambda n: F.array(i, -i - 1, 2 * width - 1 - i)
    places = F.flatten(F.transform(rows, lambda n: F.transform(F.filter(columns(n), lambda m: within(m, width)), lambda m: F.struct(n.alias("nj"), m.alias("ni")))))
    span = F.sequence(F.lit(-half), F.lit(half))
    held = cells.select("raster_id", F.col(value).alias("_v"), F.explode(places).alias("p")).select("raster_id", "_v", "p.nj", "p.ni", F.explode(span).alias("dj"))
    held = held.where((F.col("nj") + F.col("dj") >= 0) & (F.col("nj") + F.col("dj") < height)).withColumn("di", F.explode(span))
    held = held.where((F.col("ni") + F.col("di") >= 0) & (F.col("ni") + F.col("di") < width))
    # Each place gives its value to the cells around it: one shuffle of partial sums, no join.
    return held.groupBy("raster_id", (F.col("nj") + F.col("dj")).cast(cells.schema["j"].dataType).alias("j"), (F.col("ni") + F.col("di")).cast(cells.schema["i"].dataType).alias("i")).agg(F.stddev_pop("_v").alias("std"))


def bordered(cells: DataFrame, height: int, width: int, size: int = 1, planet: bool = True) -> DataFrame:
    """Cells with a border of ``size``: remapped copies of the cells near the edges."""
    spots = cells.sparkSession.range((height + 2 * size) * (width + 2 * size)).select((F.floor(F.col("id") / (width + 2 * size)) - size).cast("int").alias("j"), (F.col("id") % (width + 2 * size) - size).cast("int").alias("i"))
    flip = F.when(F.col("j") < 0, -F.col("j") - 1).when(F.col("j") >= height, 2 * height - 1 - F.col("j")).otherwise(F.col("j"))
    over = (F.col("j") < 0) | (F.col("j") >= height)
    turned = F.pmod(F.col("i"), F.lit(width))
    mirrored = F.when(F.col("i") < 0, -F.col("i") - 1).when(F.col("i") >= width, 2 * width - 1 - F.col("i")).otherwise(F.col("i"))
    source_i = F.when(over, width - 1 - turned).otherwise(turned) if planet else mirrored
    spots = spots.withColumns({"_j": flip, "_i": source_i})
    held = cells.withColumnsRenamed({"j": "_j", "i": "_i"})
    return spots.join(held, ["_j", "_i"]).drop("_j", "_i")
