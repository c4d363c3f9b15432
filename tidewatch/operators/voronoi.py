"""Outlines of the spherical Voronoi cells of sites, from great-circle half-spaces.

A cell is what is left of a wide square round its site after every other site has cut away the
half that lies nearer to itself.  Sites meet only those within a reach, found in latitude
bands and longitude cells; no site farther than twice the distance of a cell's farthest corner
can cut it, so a cell whose reach is that wide is final.  The others look twice as far and are
cut only by the sites that take away one of their corners, starting from what they have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import written
from .images import _cells_in, _sphere_cells

CORNERS = "array<struct<x:double,y:double,z:double>>"
#: Angle of the first square's corners from their site: cells must lie within this of their site.
WIDE = math.radians(89.9)
#: Corners nearer to one another than this are one.
SAME = 1e-12


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def on_sphere(lat: Column, lon: Column) -> Column:
    """Unit vector of a place in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    return _point(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def cross(p: Column, q: Column) -> Column:
    return _point(p["y"] * q["z"] - p["z"] * q["y"], p["z"] * q["x"] - p["x"] * q["z"], p["x"] * q["y"] - p["y"] * q["x"])


def angle(p: Column, q: Column) -> Column:
    """Angle between unit vectors, exact for small ones as well."""
    c = cross(p, q)
    return F.atan2(F.sqrt(dot(c, c)), dot(p, q))


def _unit(x: Column, y: Column, z: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    return _point(x / n, y / n, z / n)


def _axes(p: Column) -> tuple[Column, Column]:
    """Two unit vectors at right angles to p and to each other, anticlockwise seen from outside."""
    flat = F.abs(p["z"]) < 0.9
    e = _unit(*[F.when(flat, c).otherwise(d) for c, d in ((-p["y"], F.lit(0.0)), (p["x"], -p["z"]), (F.lit(0.0), p["y"]))])
    return e, cross(p, e)


def _square(p: Column) -> Column:
    """Four corners round p, anticlockwise."""
    e, f = _axes(p)
    at = lambda c: _point(*[math.cos(WIDE) * p[i] + math.sin(WIDE) * c(i) for i in "xyz"])
    return F.array(at(lambda i: e[i]), at(lambda i: f[i]), at(lambda i: -e[i]), at(lambda i: -f[i]))


def cut_ring(corners: np.ndarray, p: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The part of a convex ring of corners (anticlockwise round p) that is nearer to p than to any of ``near``."""
    for q in near:
        d = p - q
        side = corners @ (d / np.sqrt(d @ d))
        side[np.abs(side) <= SAME] = 0.0  # rounding can't tell
        if (side >= 0).all():
            continue
        after, then = np.roll(corners, -1, axis=0), np.roll(side, -1)
        out = []
        for c, s, e, t in zip(corners, side, after, then, strict=True):
            if s >= 0:
                out.append(c)
            if s * t < 0:
                m = (c * t - e * s) * np.sign(t - s)
                out.append(m / np.sqrt(m @ m))
        corners = np.array(out).reshape(-1, 3)
        if not len(corners):
            break
    return corners


def _cut_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kernel over (cell columns, near): each cell cut by the sites near it, and the angle of its farthest corner."""
    point = lambda c: (c["x"], c["y"], c["z"])
    for pdf in batches:
        rings, widest = [], []
        for p, corners, near in zip(pdf["p"], pdf["corners"], pdf["near"], strict=True):
            at = np.array(point(p))
            ring = np.array([point(c) for c in corners]).reshape(-1, 3)
            if near is not None and len(near):
                ring = cut_ring(ring, at, np.array([point(q) for q in near]))
            rings.append([{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in ring])
            widest.append(float(np.arctan2(np.linalg.norm(np.cross(ring, at), axis=1), ring @ at).max()) if len(ring) else 0.0)
        yield pdf.drop(columns="near").assign(corners=rings, widest=widest)


def _spread(sites: DataFrame, reach: float) -> DataFrame:
    """Sites under every band and cell in which a place may lie within ``reach`` degrees of them."""
    bands = F.floor((F.col("_lat") + 90) / reach)
    at = sites.withColumn("_b", F.explode(F.sequence(bands - 1, bands + 1)))
    n = _cells_in(F.col("_b"), reach)
    cell = F.floor(F.pmod(F.col("_lon") + 180, F.lit(360.0)) / 360 * n)
    return at.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda o: F.pmod(cell + o, n).cast("int")))))


def _placed(df: DataFrame, lat: str, lon: str, reach: float) -> DataFrame:
    """Rows under the one band and cell of their place."""
    band, cells = _sphere_cells(F.col(lat), reach)
    return df.withColumns({"_b": band, "_c": F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * cells).cast("int")})


def _first_levels(own: DataFrame, n: int, crowd: int = 6) -> DataFrame:
    """Sites with ``level``: they look 180 / 2^level degrees far at first, where their own cell still has ``crowd`` sites."""
    finest = max(1, math.ceil(math.log2(180 / math.degrees(math.sqrt(4 * math.pi / n)))) + 6)
    places = []
    for level in range(1, finest + 1):
        band, cells = _sphere_cells(F.col("lat"), 180 / 2**level)
        places.append(F.struct(F.lit(level).alias("level"), band.alias("b"), F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * cells).cast("int").alias("c")))
    at = own.select("site", F.explode(F.array(*places)).alias("at")).select("site", "at.*")
    full = at.groupBy("level", "b", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowd)
    best = at.join(full, ["level", "b", "c"]).groupBy("site").agg(F.max("level").alias("level"))
    return own.join(best, "site", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def voronoi_cells(sites: DataFrame) -> DataFrame:
    """(site, lat, lon, corners, area, final) of sites (site, lat, lon): corners anticlockwise as unit vectors, area in steradians.

    Sites at one place count once (the smallest).  ``final`` is false where a cell reaches 89.9 degrees from its
    site: then the outline is cut there.  How far a site looks at first follows from how crowded its place is.  In
    each round the nearest site of each of twelve directions cuts first, so that few others are left to be gathered.
    """
    own = sites.groupBy("lat", "lon").agg(F.min("site").alias("site")).select("site", "lat", "lon", on_sphere(F.col("lat"), F.col("lon")).alias("p"))
    own = written(own.withColumn("corners", _square(F.col("p"))).withColumn("widest", F.lit(WIDE)))
    others = own.select(F.col("site").alias("_site"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("p").alias("q"))
    rest, done = written(_first_levels(own, max(1, own.count()))), None
    schema = rest.schema
    p, q = F.col("p"), F.col("q")
    by_distance = F.struct((-dot(p, q)).alias("d"), F.col("_site").alias("s"), q.alias("q"))
    gathered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["q"]).alias("near")

    e, f = _axes(p)
    way = F.floor((F.atan2(dot(q, f), dot(q, e)) + math.pi) / (math.pi / 6)).cast("int").alias("way")
    reached = (F.col("widest") > math.pi / 2) | (dot(p, q) > F.cos(2 * F.col("widest")) - SAME)
    level = rest.agg(F.max("level")).first()[0]
    while level is not None:
        reach = 180 / 2**level
        spread = _spread(others, reach)
        now = rest.where(F.col("level") == level)

        def cutters(df: DataFrame) -> DataFrame:
            """Sites in reach that a corner may be nearer to: none farther than twice the farthest corner."""
            met = _placed(df, "lat", "lon", reach).join(spread, ["_b", "_c"]).where("site <> _site")  # noqa: B023  used at once
            return met.where(reached)

        def cut(df: DataFrame, near: DataFrame) -> DataFrame:
            return written(df.join(near, "site", "left").select(*schema.names, "near").mapInPandas(_cut_cells, schema))

        first = cutters(now).groupBy("site", way).agg(F.min(by_distance).alias("n")).groupBy("site").agg(gathered(F.col("n")))
        now = cut(now, first)
        now = cut(now, cutters(now).groupBy("site").agg(gathered(by_distance)))
        final = (F.col("widest") * 2 <= math.radians(reach)) if level else F.lit(True)
        done = now.where(final) if done is None else done.unionByName(now.where(final))
        # On to the level whose reach would do, two at most, as a cell still open asks for more sites than it needs.
        wanted = F.floor(F.log2(math.pi / (2 * F.col("widest")))).cast("int")
        onward = F.greatest(F.lit(max(0, level - 2)), F.least(F.lit(level - 1), wanted))
        rest = written(rest.where(F.col("level") < level).unionByName(now.where(~final).withColumn("level", onward)))
        level = rest.agg(F.max("level")).first()[0]
    if done is None:
        done = rest
    # Corners that three or more sites share come out of the cuts more than once.
    before = lambda k: F.get("corners", F.pmod(k - 1, F.size("corners")).cast("int"))
    apart = F.filter("corners", lambda c, k: angle(c, before(k)) > SAME)
    out = done.withColumn("corners", F.when(F.size("corners") > 1, apart).otherwise(F.col("corners")))
    return out.select("site", "lat", "lon", "corners", _fan(F.col("corners"), p).alias("area"), (F.col("widest") < WIDE).alias("final"))


def _fan(corners: Column, p: Column) -> Column:
    """Area of the triangles from p to each side."""
    after = lambda k: F.get(corners, ((k + 1) % F.size(corners)).cast("int"))
    third = lambda c, k: 2 * F.atan2(dot(p, cross(c, after(k))), 1 + dot(p, c) + dot(c, after(k)) + dot(after(k), p))
    return F.aggregate(F.transform(corners, third), F.lit(0.0), lambda s, a: s + a)


def outlines(cells: DataFrame) -> DataFrame:
    """(site, k, lat, lon): the corners of each cell in degrees, anticlockwise."""
    c = cells.select("site", F.posexplode("corners").alias("k", "c"))
    return c.select("site", "k", F.degrees(F.atan2(F.col("c.z"), F.hypot("c.x", "c.y"))).alias("lat"), F.degrees(F.atan2(F.col("c.y"), F.col("c.x"))).alias("lon"))
