"""Planar polygons as arrays of struct<x, y>: area, containment, distance, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Array of struct(a, b) of a ring's edges, the closing one included."""
    return F.transform(ring, lambda p, k: F.struct(p.alias("a"), F.get(ring, ((k + 1) % F.size(ring)).cast("int")).alias("b")))


def shoelace(ring: Column) -> Column:
    """Signed area: positive for anticlockwise rings."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def in_box(x: Column, y: Column) -> Column:
    return (x >= F.col("xmin")) & (x <= F.col("xmax")) & (y >= F.col("ymin")) & (y <= F.col("ymax"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: an odd number of edges to the right."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def contains(x: Column, y: Column, shell: Column, holes: Column) -> Column:
    return in_ring(x, y, shell) & ~F.exists(F.coalesce(holes, F.array()), lambda h: in_ring(x, y, h))


def crosses_box(shell: Column, holes: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does an edge of the polygon pass through the box?  The part of the edge inside both slabs is not empty."""

    def through(e: Column) -> Column:
        a, b = e["a"], e["b"]
        lo, hi = F.lit(0.0), F.lit(1.0)
        for p, q, low, high in ((a["x"], b["x"], x0, x1), (a["y"], b["y"], y0, y1)):
            d = q - p
            s, t = (low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))
            beside = (d == 0) & ((p < low) | (p > high))
            lo = F.when(beside, 2.0).otherwise(F.greatest(lo, F.least(s, t)))
            hi = F.least(hi, F.greatest(s, t))
        return lo <= hi

    rings = F.concat(F.array(shell), F.coalesce(holes, F.array()))
    return F.exists(rings, lambda r: F.exists(_edges(r), through))


def polygons_touch(a: Column, b: Column) -> Column:
    """Do two rings share a point: edges that cross or touch, or one that holds the other."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def between(p: Column, q: Column, r: Column) -> Column:
        return (r["x"] >= F.least(p["x"], q["x"])) & (r["x"] <= F.greatest(p["x"], q["x"])) & (r["y"] >= F.least(p["y"], q["y"])) & (r["y"] <= F.greatest(p["y"], q["y"]))

    def meet(e: Column, f: Column) -> Column:
        p, q, r, s = e["a"], e["b"], f["a"], f["b"]
        d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
        ends = ((d1 == 0) & between(p, q, r)) | ((d2 == 0) & between(p, q, s)) | ((d3 == 0) & between(r, s, p)) | ((d4 == 0) & between(r, s, q))
        return ((d1 != d2) & (d3 != d4) & (d1 * d2 < 0) & (d3 * d4 < 0)) | ends

    first = lambda r: F.get(r, F.lit(0))
    crossing = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: meet(e, f)))
    return crossing | in_ring(first(a)["x"], first(a)["y"], b) | in_ring(first(b)["x"], first(b)["y"], a)


def _segment_distance(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)


def distance_to_edges(x: Column, y: Column, shell: Column, holes: Column) -> Column:
    """Least distance to the outer and inner rings."""
    rings = F.concat(F.array(shell), F.coalesce(holes, F.array()))
    return F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(_edges(r), lambda e: _segment_distance(x, y, e)))))


def bounding_box(df: DataFrame, ring: str = "shell") -> DataFrame:
    pick = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return df.withColumns({"xmin": pick(F.array_min, "x"), "xmax": pick(F.array_max, "x"), "ymin": pick(F.array_min, "y"), "ymax": pick(F.array_max, "y")})


def rings_to_polygons(rings: DataFrame) -> DataFrame:
    """Polygons from rings (part, id, ring, info) in id order: a ring of negative area starts a shell, a positive one is a hole of it."""
    marked = rings.withColumn("_shell", F.when(shoelace(F.col("ring")) < 0, F.col("id")))
    owner = F.last("_shell", True).over(Window.partitionBy("part").orderBy("id"))
    owned = marked.withColumn("_owner", owner).where("_owner IS NOT NULL")
    holes = F.array_sort(F.collect_list(F.when(F.col("_shell").isNull(), F.struct("id", "ring"))))
    return owned.groupBy("part", F.col("_owner").alias("id")).agg(F.max_by("ring", F.col("_shell")).alias("shell"), F.transform(holes, lambda h: h["ring"]).alias("holes"), F.max_by("info", F.col("_shell")).alias("info"))


def _cut_half(points: Column, axis: str, other: str, bound: Column, sign: int) -> Column:
    """The ring's part on one side of a line parallel to an axis."""
    inside = lambda p: (p[axis] - bound) * sign >= 0

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        cross = {axis: bound, other: a[other] + t * (b[other] - a[other])}
        met = F.struct(cross["x"].cast("double").alias("x"), cross["y"].cast("double").alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        first = F.when(inside(a), F.array(F.struct(a["x"].alias("x"), a["y"].alias("y")))).otherwise(none)
        return F.concat(first, F.when(inside(a) != inside(b), F.array(met)).otherwise(none))

    return F.flatten(F.transform(_edges(points), cut))


def clip_to_box(df: DataFrame, ring: str, box: tuple[str, str, str, str], name: str = "clipped") -> DataFrame:
    """New column: the ring cut to the box of columns (x0, y0, x1, y1), side after side (exact for convex rings)."""
    df = df.withColumn(name, F.col(ring))
    for axis, other, bound, sign in (("x", "y", box[0], 1), ("x", "y", box[2], -1), ("y", "x", box[1], 1), ("y", "x", box[3], -1)):
        # A lambda variable holds the ring, so that the cuts don't copy each other's expression.
        df = df.withColumn(name, F.get(F.transform(F.array(name), lambda points: _cut_half(points, axis, other, F.col(bound), sign)), F.lit(0)))  # noqa: B023
    return df


def box_overlap(df: DataFrame, ring: str, box: tuple[str, str, str, str], name: str = "share") -> DataFrame:
    """New column: share of the box that the ring covers."""
    df = clip_to_box(df, ring, box, "_cut")
    x0, y0, x1, y1 = map(F.col, box)
    return df.withColumn(name, F.abs(F.coalesce(shoelace(F.col("_cut")), F.lit(0.0))) / ((x1 - x0) * (y1 - y0))).drop("_cut")


def remap(ring: Column, from_box: tuple[float, float, float, float], to_box: tuple[float, float, float, float]) -> Column:
    """Coordinates moved linearly from one extent (xmin, ymin, xmax, ymax) to another."""
    fx, fy, gx, gy = from_box
    tx, ty, ux, uy = to_box
    return F.transform(ring, lambda p: F.struct((tx + (p["x"] - fx) * ((ux - tx) / (gx - fx))).alias("x"), (ty + (p["y"] - fy) * ((uy - ty) / (gy - fy))).alias("y")))
