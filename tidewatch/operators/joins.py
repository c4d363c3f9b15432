"""Joins of labelled tables, points, polygons and cells (J rows of the survey)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, written
from ..functions.polygons import contains, distance_to_edges, polygons_touch


def with_metadata(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Many-to-one join on label; Spark broadcasts the metadata when its size allows."""
    return df.join(meta, LABEL, "left")


def attach(df: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on (label, ts): rows without a partner get NULL."""
    return df.join(other, [LABEL, TIME], "left")


def fuse_grid_series(df: DataFrame, meta: DataFrame, grid: DataFrame, column: str, cell_degrees: float) -> DataFrame:
    """Attach the series of the grid cell (lat_cell, lon_cell, ts, column) that holds each label's point."""
    cells = meta.select(LABEL, F.floor(F.col("lat") / cell_degrees).alias("lat_cell"), F.floor(F.col("lon") / cell_degrees).alias("lon_cell"))
    found = cells.join(grid, ["lat_cell", "lon_cell"]).select(LABEL, TIME, column)
    return attach(df, found)


def month_match(a: DataFrame, b: DataFrame, value_a: str, value_b: str, tolerance_days: int = 10) -> DataFrame:
    """Left join on label and month; pairs ``tolerance_days`` or more apart don't match; the nearest of several does."""
    right = b.select(LABEL, F.date_format(TIME, "yyyy-MM").alias("_month"), F.col(TIME).alias("_ts"), F.col(value_b).alias("_v"))
    left = a.withColumn("_month", F.date_format(TIME, "yyyy-MM"))
    gap = F.abs(F.datediff("_ts", TIME))
    met = left.select(LABEL, TIME, "_month").join(right, [LABEL, "_month"]).where(gap < tolerance_days)
    best = met.groupBy(LABEL, TIME).agg(F.min_by("_v", F.struct(gap, F.col("_ts"))).alias(value_b))
    return left.drop("_month").join(best, [LABEL, TIME], "left") if value_b not in a.columns else left.drop("_month", value_b).join(best, [LABEL, TIME], "left")


def fuse_mass(df: DataFrame, mass: DataFrame, land: DataFrame | None = None, mode: str = "off", column: str = "Grace", error: str = "Grace_Uncertainty") -> DataFrame:
    """Attach a calibrated mass series (EWD, EWD_Error); ``remove`` takes the land model (monthly) off, ``only`` attaches it alone."""
    if mode not in ("off", "remove", "only"):
        raise ValueError("mode is 'off', 'remove' or 'only'")
    if mode == "off":
        found = mass.select(LABEL, TIME, F.col("EWD").alias(column), F.col("EWD_Error").alias(error))
    else:
        both = month_match(mass, land, "EWD", "GLDAS")
        value = F.col("GLDAS") if mode == "only" else F.col("EWD") - F.col("GLDAS")
        found = both.select(LABEL, TIME, value.alias(column), F.when(F.col("GLDAS").isNotNull(), F.col("EWD_Error")).alias(error))
    return attach(df, found)


def nearest_before(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """As-of join: each row of a with the last value of b at or before it, by one union and one window."""
    tagged = a.select(LABEL, TIME).withColumns({"_v": F.lit(None).cast(b.schema[value].dataType), "_side": F.lit(1)})
    events = b.select(LABEL, TIME, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(LABEL).orderBy(TIME, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.unionByName(events).withColumn(value, F.last("_v", True).over(w)).where("_side = 1").select(LABEL, TIME, value).distinct()
    return a.drop(value).join(filled, [LABEL, TIME], "left")


def same_site_and_satellite(day: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of sites and satellites that both days have, by two semi-joins each."""
    keys = ["site", "prn"]
    a = day.join(previous.select("site").distinct(), "site", "left_semi").join(previous.select(*keys).distinct(), keys, "left_semi")
    b = previous.join(day.select("site").distinct(), "site", "left_semi").join(day.select(*keys).distinct(), keys, "left_semi")
    return a, b


def _gridded(boxes: DataFrame, size: float, prefix: str) -> DataFrame:
    """A row for each grid square that a box (xmin, ymin, xmax, ymax) touches."""
    bx = F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))
    by = F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))
    return boxes.withColumn("_bx", F.explode(bx)).withColumn("_by", F.explode(by))


def _candidates(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Points (x, y) with the array ``_near`` of the polygons whose boxes touch their grid square; each row stays one row."""
    kept = F.struct("id", "shell", "holes", "xmin", "ymin", "xmax", "ymax")
    squares = _gridded(polygons, size, "p").groupBy("_bx", "_by").agg(F.collect_list(kept).alias("_near"))
    at = points.withColumns({"_bx": F.floor(F.col("x") / size), "_by": F.floor(F.col("y") / size)})
    return at.join(squares, ["_bx", "_by"], "left").drop("_bx", "_by")


def _holds(p: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    return (x >= p["xmin"]) & (x <= p["xmax"]) & (y >= p["ymin"]) & (y <= p["ymax"]) & contains(x, y, p["shell"], p["holes"])


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(point columns, polygon, hits): the polygon (id, shell, holes, box) that holds each point (x, y).

    Points meet polygons through shared grid squares.  No polygon gives -1; ``hits`` counts
    them, so that overlaps can be told.
    """
    met = _candidates(points, polygons, size).withColumn("_ids", F.transform(F.filter("_near", _holds), lambda p: p["id"]))
    return met.select(*points.columns, F.coalesce(F.array_min("_ids"), F.lit(-1)).alias("polygon"), F.coalesce(F.size("_ids"), F.lit(0)).cast("long").alias("hits"))


def nearest_polygon(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    """(point columns, polygon, distance): the nearest polygon that doesn't hold the point and whose code isn't 999.

    Looks ``reach`` around each point through grid squares of that size; points with nothing so near
    look four times as far, until the reach spans all points and polygons.  NULL only where no polygon is left.
    """
    others = polygons.where("coalesce(code, 0) <> 999")
    box = others.agg(*[F.min(c).alias(c) for c in ("xmin", "ymin")], *[F.max(c).alias(c) for c in ("xmax", "ymax")]).unionByName(points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")))
    e = box.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()  # one row
    span = 0.0 if None in e else math.hypot(e[2] - e[0], e[3] - e[1])
    out, rest = None, points
    while True:
        wide = others.withColumns({"xmin": F.col("xmin") - reach, "ymin": F.col("ymin") - reach, "xmax": F.col("xmax") + reach, "ymax": F.col("ymax") + reach})
        x, y = F.col("x"), F.col("y")
        near = F.filter("_near", lambda p: ~contains(x, y, p["shell"], p["holes"]))
        best = F.array_min(F.transform(near, lambda p: F.struct(distance_to_edges(x, y, p["shell"], p["holes"]).alias("d"), p["id"].alias("id"))))
        met = _candidates(rest, wide, reach).withColumn("_best", best)
        found = (F.col("_best.d") <= reach) if reach < span else F.lit(True)
        met = met.select(*points.columns, F.when(found, F.col("_best.id")).alias("polygon"), F.when(found, F.col("_best.d")).alias("distance"))
        if reach >= span:
            return met if out is None else out.unionByName(met)
        met = met.checkpoint()
        done = met.where("distance IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        rest = met.where("distance IS NULL").select(*points.columns)
        if not rest.limit(1).count():
            return out
        reach *= 4


def spatial_semi_join(a: DataFrame, b: DataFrame, touches=polygons_touch, size: float = 1.0, anti: bool = False) -> DataFrame:
    """Features of a that touch (or, ``anti``, don't touch) one of b; ``touches(a_geom, b_geom)`` decides in shared grid squares.

    Both sides have feature_id, geom (by default a ring) and a bounding box.
    """
    # Equal geometries are told once, and each only up to the first that it touches.
    shape = ["geom", "xmin", "ymin", "xmax", "ymax"]
    left = _gridded(a.select(*shape).distinct(), size, "a")
    right = _gridded(b.select(*shape).distinct(), size, "b").select("_bx", "_by", F.col("geom").alias("_gb")).distinct()
    met = (left["_bx"] == right["_bx"]) & (left["_by"] == right["_by"])
    hit = left.join(right, met & touches(F.col("geom"), F.col("_gb")), "left_semi").select(*shape).distinct()
    return a.join(hit, shape, "left_anti" if anti else "left_semi").select(*a.columns)


def neighbour_edges(cells: DataFrame, times: DataFrame, limit: float) -> DataFrame:
    """(src, dst, times): targets whose travel-time arrays reach each other's cells.

    ``cells`` is (target, j, i), ``times`` (target, j, i, time); both directions' times are
    kept together, and an edge where any of them is within the limit.
    """
    reached = times.withColumnRenamed("target", "src").join(cells.withColumnRenamed("target", "dst"), ["j", "i"]).where("src <> dst AND time IS NOT NULL")
    one = reached.select("src", "dst", "time").unionByName(reached.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "time"))
    edges = one.groupBy("src", "dst").agg(F.array_sort(F.collect_list("time")).alias("times"))
    return edges.where(F.exists("times", lambda t: t <= limit))


def matched_points(matches: DataFrame, query: DataFrame, train: DataFrame) -> DataFrame:
    """Coordinates of matched key points: two lookups by index."""
    q = query.select(F.col("idx").alias("query_idx"), F.col("x").alias("query_x"), F.col("y").alias("query_y"))
    t = train.select(F.col("idx").alias("train_idx"), F.col("x").alias("train_x"), F.col("y").alias("train_y"))
    return matches.join(q, "query_idx").join(t, "train_idx")


def lookup_info(points: DataFrame, polygons: DataFrame, key: str, fill: str) -> DataFrame:
    """A field of each row's polygon, with a default where there is none."""
    info = polygons.select(F.col("id").alias("polygon"), F.try_element_at("info", F.lit(key)).alias("_v"))
    return points.join(info, "polygon", "left").withColumn(key, F.coalesce("_v", F.lit(fill))).drop("_v")


def in_shares(large: DataFrame, small: DataFrame, key: list[str], by: str, rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with the further key ``_share``: a key's rows of ``large`` are dealt into shares of about
    ``rows``, each of which meets all of ``small``'s, so that no key that many rows have lands in one task.  The number
    of tasks is named: few bytes in may be many rows out."""
    session = large.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    shares = large.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_shares"))
    dealt = large.join(shares, key).withColumn("_share", F.pmod(F.xxhash64(by), F.col("_shares")).cast("int"))
    met = small.join(shares, key).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    # Both, as Spark may send either of them to where the other lies.
    return tuple(df.drop("_shares").repartition(tasks, *key, "_share") for df in (dealt, met))


def shared_vertices(regions: DataFrame) -> DataFrame:
    """(a, b): regions (id, vertices) that share a vertex, themselves included.

    Regions with equal sets of vertices are one class; classes that share a vertex are told first, so that each pair of
    regions is made once, however many vertices it shares, and none is compared with another.
    """
    sets = written(regions.select("id", F.explode("vertices").alias("v")).groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("set")).where(F.size("set") > 0))
    classes = sets.select("set").distinct()
    v = classes.select("set", F.explode("set").alias("v"))
    pairs = v.select(F.col("set").alias("_a"), "v").join(v.select(F.col("set").alias("_b"), "v"), "v").select("_a", "_b").distinct()
    first = pairs.join(sets.select(F.col("set").alias("_a"), F.col("id").alias("a")), "_a").select("_b", "a")
    second, first = in_shares(sets.select(F.col("set").alias("_b"), F.col("id").alias("b")), first, ["_b"], "b", rows=1024)
    return first.join(second, ["_b", "_share"]).select("a", "b")
