"""Filters and predicates over labelled tables (F rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME
from ..functions.geodesy import haversine_km, vincenty_km

#: Label lists longer than this are joined instead of listed in the plan.
LISTED = 1000


def keep_labels(df: DataFrame, labels: list, invert: bool = False) -> DataFrame:
    """Remove the listed labels; ``invert`` keeps only them."""
    labels = [str(x) for x in labels]
    if len(labels) > LISTED:
        listed = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        return df.join(listed, LABEL, "left_semi" if invert else "left_anti")
    hit = F.col(LABEL).cast("string").isin(*labels) if labels else F.lit(False)
    return df.where(hit if invert else ~hit)


def within_radius(df: DataFrame, meta: DataFrame, lat: float, lon: float, radius_km: float, method: str = "wgs84") -> DataFrame:
    """Keep labels at most ``radius_km`` from a point on the WGS84 ellipsoid (or on a sphere, ``haversine``); labels further away go.

    A latitude band and the distance on a sphere leave only what can be so near for the exact distance.
    """
    at = (F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    if method == "haversine":
        kept = meta.where(haversine_km(*at) <= radius_km)
    else:  # a degree of latitude has 110.5 km at least; the sphere is within 1 % of the ellipsoid
        near = meta.where((F.abs(F.col("lat") - lat) <= radius_km / 110.0) & (haversine_km(*at) <= radius_km * 1.01))
        kept = near.where(vincenty_km(*at) <= radius_km)
    return df.join(kept.select(LABEL), LABEL, "left_semi")


def blank_range(df: DataFrame, columns: list[str], start=None, end=None, labels: list | None = None) -> DataFrame:
    """NULL the columns in the closed range [start, end] (open where None) of the listed labels (all where None)."""
    hit = F.lit(True)
    if start is not None:
        hit = hit & (F.col(TIME) >= F.lit(start))
    if end is not None:
        hit = hit & (F.col(TIME) <= F.lit(end))
    if labels is not None:
        hit = hit & F.col(LABEL).isin(*labels)
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def blank_days(df: DataFrame, columns: list[str], ranges: DataFrame, labels: list | None = None) -> DataFrame:
    """NULL the columns on the days of any closed range (start, end) of a table, of the listed labels (all where None)."""
    days = ranges.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day")).distinct()
    met = df.withColumn("_at", F.to_date(TIME)).join(days, F.col("_at") == F.col("_day"), "left")
    hit = F.col("_day").isNotNull() & (F.lit(True) if labels is None else F.col(LABEL).isin(*labels))
    return met.withColumns({c: F.when(~hit, F.col(c)) for c in columns}).drop("_at", "_day")


def propagate_nulls(df: DataFrame, source: str, targets: list[str]) -> DataFrame:
    """NULL the targets where the source is NULL."""
    return df.withColumns({c: F.when(F.col(source).isNotNull(), F.col(c)) for c in targets})


def combine_columns(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """first with its gaps filled from second; whichever exists if only one does."""
    found = [c for c in (first, second) if c in df.columns]
    if not found:
        raise KeyError(f"neither {first} nor {second} is a column")
    return df.withColumn(name, F.coalesce(*found))


def drop_noisy_snow(df: DataFrame, sigma: float = 1.5, column: str = "dN", snow: str = "Snow") -> DataFrame:
    """Drop labels that scatter more than ``sigma`` times as much on snow (code 4) as without (code 2)."""
    spread = df.groupBy(LABEL).agg(F.stddev_pop(F.when(F.col(snow) == 4, F.col(column))).alias("with_snow"), F.stddev_pop(F.when(F.col(snow) == 2, F.col(column))).alias("without"))
    return df.join(spread.where(F.col("with_snow") > sigma * F.col("without")).select(LABEL), LABEL, "left_anti")


def round_to_day(ts: Column) -> Column:
    """Nearest day; noon goes to the even day number."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.bround(micros.cast("decimal(20,0)") / F.lit(86_400_000_000), 0).cast("int"))


def round_dates(df: DataFrame) -> DataFrame:
    return df.withColumn(TIME, round_to_day(F.col(TIME)))


def feature_filter(features: DataFrame, name: str, values: list) -> DataFrame:
    """Geometry of the features whose field is one of the values."""
    return features.where(F.col(name).isin(*values)).select("feature_id", "geometry")


def trim_map(cells: DataFrame, per_degree: float, north: float, south: float, west: float, east: float, lat_top: float = 90.0, lon_offset: float = 0.0) -> DataFrame:
    """Cells (j, i) inside a latitude and longitude box; bounds are cut to whole cells."""
    j0, j1 = int((lat_top - north) * per_degree), int((lat_top - south) * per_degree)
    i0, i1 = int((west - lon_offset) * per_degree), int((east - lon_offset) * per_degree)
    return cells.where((F.col("j") >= j0) & (F.col("j") < j1) & (F.col("i") >= i0) & (F.col("i") < i1))


def select_channels(images: DataFrame, channels: list[int] | int) -> DataFrame:
    """Take channels of (label, channels, height, width, pixels); a single number leaves one channel."""
    wanted = [channels] if isinstance(channels, int) else list(channels)
    size = F.col("height") * F.col("width")
    parts = [F.slice("pixels", (F.lit(c) * size + 1).cast("int"), size.cast("int")) for c in wanted]
    return images.withColumns({"pixels": F.concat(*parts), "channels": F.lit(len(wanted))})


def busy_satellites(obs: DataFrame, hour: float, lat: float, lon: float, lat_window: float = 5.0, lon_window: float = 5.0, threshold: int = 1000) -> DataFrame:
    """Satellites with more than ``threshold`` observations strictly inside the hour and box around an event."""
    hours = F.pmod(F.col("t"), F.lit(1.0)) * 24
    inside = (F.abs(hours - hour) < 1) & (F.abs(F.col("pplat") - lat) < lat_window) & (F.abs(F.col("pplon") - lon) < lon_window)
    return obs.where(inside).groupBy("prn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)


def can_extend(visited: Column, cell: Column, duration: Column, longest: float) -> Column:
    """A path may go on to a cell it has not visited, within the longest duration."""
    return (duration <= longest) & ~F.array_contains(visited, cell)
