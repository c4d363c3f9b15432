"""Images, rasters and vector layers as rows (I rows of the survey).

An image is (label, channels, height, width, pixels ARRAY<DOUBLE>, meta MAP, extent ARRAY<INT>),
its pixels channel after channel, row after row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polygons import box_overlap, contains, crosses_box

IMAGE = "label string, channels int, height int, width int, pixels array<double>, meta map<string,string>, extent array<int>"


def as_images(df: DataFrame, label: str, pixels: str, height: int, width: int, channels: int = 1) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return df.select(F.col(label).cast("string").alias("label"), F.lit(channels).alias("channels"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.col(pixels).cast("array<double>").alias("pixels"), empty.alias("meta"), F.array(F.lit(0), F.lit(height), F.lit(0), F.lit(width)).alias("extent"))


def apply_function(images: DataFrame, function) -> DataFrame:
    """Any function of an array (height, width) or (channels, height, width), image by image."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, c, h, w in zip(pdf["pixels"], pdf["channels"], pdf["height"], pdf["width"], strict=True):
                a = np.asarray(p, float).reshape((h, w) if c == 1 else (c, h, w))
                out.append(np.asarray(function(a), float))
            pdf = pdf.assign(pixels=[a.ravel().tolist() for a in out], height=[a.shape[-2] for a in out], width=[a.shape[-1] for a in out], channels=[1 if a.ndim == 2 else a.shape[0] for a in out])
            yield pdf

    return images.mapInPandas(run, images.schema)


def cells_of(images: DataFrame) -> DataFrame:
    """(label, c, j, i, value)."""
    p = images.select("label", "height", "width", F.posexplode("pixels").alias("p", "value"))
    size = F.col("height") * F.col("width")
    return p.select("label", F.floor(F.col("p") / size).cast("int").alias("c"), F.floor(F.col("p") % size / F.col("width")).cast("int").alias("j"), (F.col("p") % F.col("width")).cast("int").alias("i"), "value")


def _turned(k: int) -> Column:
    """Pixels turned k quarter turns anticlockwise."""
    c, h, w = F.col("channels"), F.col("height"), F.col("width")
    ow = w if k % 2 == 0 else h
    place = F.sequence(F.lit(0), c * h * w - 1)

    def source(p: Column) -> Column:
        ch, j, i = F.floor(p / (h * w)), F.floor(p % (h * w) / ow), p % ow
        sj, si = {0: (j, i), 1: (i, w - 1 - j), 2: (h - 1 - j, w - 1 - i), 3: (h - 1 - i, j)}[k]
        return (ch * h * w + sj * w + si).cast("int")

    return F.transform(place, lambda p: F.get("pixels", source(p)))


def rotate_images(images: DataFrame) -> DataFrame:
    """Each image turned by 0, 90, 180 and 270 degrees, named and marked so."""
    out = None
    for k in range(4):
        degrees = str(90 * k)
        turned = images.withColumns(
            {
                "pixels": _turned(k),
                "label": F.concat(F.col("label"), F.lit(f", Rotated: {degrees}")),
                "meta": F.map_concat("meta", F.create_map(F.lit("Rotated"), F.lit(degrees))),
            }
        )
        if k % 2:
            turned = turned.withColumnsRenamed({"height": "_h", "width": "_w"}).withColumnsRenamed({"_h": "width", "_w": "height"}).select(*images.columns)
        out = turned if out is None else out.unionByName(turned)
    return out


def tiles(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiles (label, tile, x0, y0, size, pixels) of one-channel images, column after column.

    Offsets are range(0, side - size, stride), so the last fitting one is left out; tiles
    with a missing pixel go.
    """
    xs = F.expr(f"filter(sequence(0, width, {stride}), x -> x < width - {size})")
    ys = F.expr(f"filter(sequence(0, height, {stride}), y -> y < height - {size})")
    at = images.withColumn("x0", F.explode(xs)).withColumn("y0", F.explode(ys))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice("pixels", ((F.col("y0") + r) * F.col("width") + F.col("x0") + 1).cast("int"), F.lit(size))))
    cut = at.select("label", "x0", "y0", F.lit(size).alias("size"), rows.alias("pixels"))
    cut = cut.where(~F.exists("pixels", lambda p: p.isNull() | F.isnan(p)))
    order = F.row_number().over(Window.partitionBy("label").orderBy("x0", "y0")) - 1
    return cut.withColumn("tile", order).select("label", "tile", "x0", "y0", "size", "pixels")


def select_tiles(tiled: DataFrame, threshold, min_deviation: float, min_fraction: float, percent: bool = False) -> DataFrame:
    """Keep tiles of which at least ``min_fraction`` of the absolute pixels lie below the limit.

    The limit is ``min_deviation``, as a percentage of ``threshold`` (a function of the array
    of absolute pixels) when ``percent``.
    """
    size = F.transform("pixels", lambda p: F.abs(p))
    limit = threshold(size) * min_deviation / 100 if percent else F.lit(min_deviation)
    below = F.size(F.filter(size, lambda p: p < limit)) / F.size("pixels")
    return tiled.where(below >= min_fraction).withColumn("label", F.concat("label", F.lit(", Square: "), F.col("tile")))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Rows numbered from 0 in an order, range by range: only a count for each range meets in one place."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % (1 << 33)}).checkpoint()
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.withColumn("_s", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def add_random_channel(images: DataFrame, tiled: DataFrame, seed: int = 0) -> DataFrame:
    """Stack a tile under each image as a further channel: tiles in seeded order, dealt round to the images in label order."""
    dealt = numbered(tiled.select("label", "tile", F.col("pixels").alias("_tile"), F.xxhash64(F.lit(seed), "label", "tile").alias("_o")), "_k", "_o", "label", "tile").select("_tile", "_k")
    n = max(1, tiled.count())
    at = numbered(images, "_k", "label").withColumn("_k", F.col("_k") % n)
    return at.join(dealt, "_k").withColumns({"pixels": F.concat("pixels", "_tile"), "channels": F.col("channels") + 1}).drop("_k", "_tile")


def squares_over_polygons(polygons: DataFrame, size: float = 100.0, stride: float = 20.0, required: float = 0.5) -> DataFrame:
    """(id, x0, y0, share): squares over each polygon's padded bounds that it covers by more than ``required``."""
    from . import overlay, trapezoids as T

    names = ["xmin", "ymin", "xmax", "ymax"]
    laid = polygons.select("id", "shell", F.array().cast(f"array<{overlay.RING}>").alias("holes"), *[F.col(c).cast("double").alias(c) for c in names])
    few, many = overlay._by_corners(laid)

    def squares(t):
        """The squares of features in rows of bounded number, without those that the feature's box covers too little."""
        box = np.column_stack([np.asarray(t[c], float) for c in names])
        told = np.isfinite(box).all(axis=1)
        n = np.where(told[:, None], np.floor((box[:, 2:] - box[:, :2] + 2 * size) / stride) + 1, 0).astype(int)
        last = np.cumsum(n[:, 0] * n[:, 1])
        for k in range(0, int(last[-1]), 250_000):
            flat = np.arange(k, min(k + 250_000, int(last[-1])))
            row = np.searchsorted(last, flat, "right")
            at = flat - (last[row] - n[row, 0] * n[row, 1])
            x, y = box[row, 0] - size + at // n[row, 1] * stride, box[row, 1] - size + at % n[row, 1] * stride
            over = np.maximum(0, np.minimum(x + size, box[row, 2]) - np.maximum(x, box[row, 0])) * np.maximum(0, np.minimum(y + size, box[row, 3]) - np.maximum(y, box[row, 1]))
            keep = over > required * size**2 * (1 - 1e-9)
            yield row[keep], x[keep], y[keep]

    def run(batches):
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for low in range(0, len(whole), overlay.TILE):
                t = whole.slice(low, overlay.TILE).combine_chunks()
                shapes = overlay._pieces_of(t)
                for row, x, y in squares(t):
                    u, v = x + size, y + size
                    tiles = T.Pieces(np.arange(len(x)), np.column_stack([x, u, x, y, u, y, x, v, u, v]), len(x))
                    share = np.zeros(len(x))
                    for pair, piece in T.common(shapes, tiles, row, np.arange(len(x))):
                        share += np.bincount(pair, T.area(piece), len(x))
                    share /= (u - x) * (v - y)
                    k = np.flatnonzero(share > required)
                    yield pa.RecordBatch.from_arrays([t["id"].chunk(0).take(pa.array(row[k])), pa.array(x[k]), pa.array(y[k]), pa.array(share[k])], ["id", "x0", "y0", "share"])

    kind = polygons.schema["id"].dataType.simpleString()
    if required < 0:  # squares that no polygon meets count as well
        return _squares_by_clipping(laid, size, stride, required)
    found = few.repartition(overlay._tasks(few), "id").mapInArrow(run, f"id {kind}, x0 double, y0 double, share double")
    return found if many is None else found.unionByName(_squares_by_clipping(many, size, stride, required))


def _squares_by_clipping(polygons: DataFrame, size: float, stride: float, required: float) -> DataFrame:
    """The same for rings of any number of corners, a square after the other."""
    xs = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("xmax") - F.col("xmin") + 2 * size) / stride)), lambda k: F.col("xmin") - size + k * stride))
    ys = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("ymax") - F.col("ymin") + 2 * size) / stride)), lambda k: F.col("ymin") - size + k * stride))
    at = polygons.withColumn("x0", xs).withColumn("y0", ys).withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})
    return box_overlap(at, "shell", ("x0", "y0", "x1", "y1")).where(F.col("share") > required).select("id", "x0", "y0", "share")


def recentre(cells: DataFrame, width: int, shift: int) -> DataFrame:
    """Columns of a raster turned to another central meridian."""
    return cells.withColumn("i", F.pmod(F.col("i") + shift, F.lit(width)).cast("int"))


def rasterize(polygons: DataFrame, height: int, width: int, box: tuple[float, float, float, float], background: float = 1.0, burn: float = 0.0, attribute: str | None = None, all_touched: bool = False) -> DataFrame:
    """(j, i, value): cells whose centre a polygon holds, or with ``all_touched`` that it touches at all, take the burn value or the polygon's attribute (of the last id)."""
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) / width, (y1 - y0) / height
    grid = polygons.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("j"), (F.col("id") % width).cast("int").alias("i"))
    # A polygon only meets the cells of its box.
    j0, j1 = F.greatest(F.lit(0), F.floor((y1 - F.col("ymax")) / dy)), F.least(F.lit(height - 1), F.floor((y1 - F.col("ymin")) / dy))
    i0, i1 = F.greatest(F.lit(0), F.floor((F.col("xmin") - x0) / dx)), F.least(F.lit(width - 1), F.floor((F.col("xmax") - x0) / dx))
    touched = polygons.where((j0 <= j1) & (i0 <= i1)).withColumn("j", F.explode(F.sequence(j0, j1))).withColumn("i", F.explode(F.sequence(i0, i1)))
    x, y = x0 + (F.col("i") + 0.5) * dx, y1 - (F.col("j") + 0.5) * dy
    value = F.col(attribute).cast("double") if attribute else F.lit(burn)
    inside = contains(x, y, F.col("shell"), F.col("holes"))
    if all_touched:
        inside = inside | crosses_box(F.col("shell"), F.col("holes"), x - dx / 2, y - dy / 2, x + dx / 2, y + dy / 2)
    hit = touched.where(inside).groupBy(F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i")).agg(F.max_by(value, F.col("id")).alias("_v"))
    return grid.join(hit, ["j", "i"], "left").select("j", "i", F.coalesce("_v", F.lit(background)).alias("value"))


def path_codes(polygons: DataFrame) -> DataFrame:
    """(id, ring, k, x, y, code): drawing codes 1 (move), 2 (line), 79 (close) of the outer and inner rings."""
    rings = F.posexplode(F.concat(F.array("shell"), F.coalesce("holes", F.array()))).alias("ring", "points")
    p = polygons.select("id", rings).select("id", "ring", F.size("points").alias("_n"), F.posexplode("points").alias("k", "p"))
    code = F.when(F.col("k") == 0, 1).when(F.col("k") == F.col("_n") - 1, 79).otherwise(2)
    return p.select("id", "ring", "k", "p.x", "p.y", code.alias("code"))


def _sphere_cells(lat: Column, reach: float) -> tuple[Column, Column]:
    """Latitude band of a point and the number of longitude cells in that band: at least ``reach`` degrees wide everywhere in it."""
    band = F.floor((lat + 90) / reach)
    return band, _cells_in(band, reach)


def _cells_in(band: Column, reach: float) -> Column:
    far = F.greatest(F.abs(band * reach - 90), F.abs((band + 1) * reach - 90))
    return F.when(far >= 90 - reach, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(far + reach)) / (2 * reach)))).cast("int")


def nearest_sites(points: DataFrame, sites: DataFrame, reach: float) -> DataFrame:
    """(point columns, site, distance): spherical Voronoi assignment of points (lat, lon) to sites (site, lat, lon).

    Sites at one place count once (the smallest).  Of sites whose distances in radians agree to nine decimals
    the smallest is taken, so that rounding decides no tie.  Points meet the sites within ``reach`` degrees through
    latitude bands and longitude cells that widen toward the poles; points with none so near look
    three times as far, until the reach spans the sphere.  NULL only where there are no sites.
    """
    from ..functions.geodesy import haversine

    s = sites.groupBy("lat", "lon").agg(F.min("site").alias("site")).select("site", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    out, rest = None, points
    while True:
        bands = F.floor((F.col("_lat") + 90) / reach)
        spread = s.withColumn("_b", F.explode(F.sequence(bands - 1, bands + 1)))
        n = _cells_in(F.col("_b"), reach)
        cell = F.floor(F.pmod(F.col("_lon") + 180, F.lit(360.0)) / 360 * n)
        spread = spread.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda o: F.pmod(cell + o, n).cast("int")))))
        held = spread.groupBy("_b", "_c").agg(F.collect_list(F.struct("site", "_lat", "_lon")).alias("_near"))
        band, own = _sphere_cells(F.col("lat"), reach)
        at = rest.withColumns({"_b": band, "_c": F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * own).cast("int")}).join(held, ["_b", "_c"], "left")
        met = F.transform("_near", lambda p: F.struct(haversine(F.col("lat"), F.col("lon"), p["_lat"], p["_lon"]).alias("d"), p["site"].alias("site")))
        at = at.withColumn("_met", met).withColumn("_d", F.degrees(F.array_min("_met")["d"]))
        best = F.array_min(F.transform("_met", lambda p: F.struct(F.round(p["d"], 9).alias("d"), p["site"].alias("site"))))["site"]
        # What ties with a site so near lies within reach as well.
        found = F.lit(True) if reach >= 180 else F.col("_d") <= reach - 1e-7
        met = at.select(*points.columns, F.when(found, best).alias("site"), F.when(found, F.col("_d")).alias("distance"))
        if reach >= 180:
            return met if out is None else out.unionByName(met)
        met = met.checkpoint()
        done = met.where("distance IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        rest = met.where("distance IS NULL").select(*points.columns)
        if not rest.limit(1).count():
            return out
        reach = min(180.0, 3 * reach)


def clip_points(points: DataFrame, polygon: DataFrame, size: float = 1.0) -> DataFrame:
    """Points (x, y) inside any of the polygons, with their fields; they meet through grid squares."""
    from .joins import points_in_polygons

    return points_in_polygons(points, polygon.select("shell", "holes", "xmin", "ymin", "xmax", "ymax", F.lit(0).alias("id")), size).where("hits > 0").select(*points.columns)
