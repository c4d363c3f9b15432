"""Further queries of the catalogue: joins, selections, geometry, paths, provenance, each with its SQL."""

from __future__ import annotations

import datetime as dt
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, Dataset, melt, widen
from ..functions import astro, deformation, fuzzy, geodesy, polygons
from ..operators import decomposition, filters, images, inversion, joins, scan, search, series, stats, wavelets, windows
from ..sources import readers
from .catalogue import EV, EVG, FILLED, GRID, HAV, LI, NEAR, OD, ORACLES, PATHS, POS, SITES, _images, _in_diamond, _near, _squares, ev, evg, grid, li, od, query, r, sites, table
from .pipeline import Incremental, Param, ParamCycle, Pipeline, Stage, run_grid

# --- joins ----------------------------------------------------------------------------------


@query(f"WITH {EV}, {OD} SELECT ev.label, ev.ts, round(b.n * 1.0, 4) AS n2 FROM ev LEFT JOIN (SELECT label, ts + 1 AS ts, n FROM ev WHERE day(ts) % 3 = 0) b USING (label, ts)")
def attach_column(spark, sf_dir):
    a = ev(spark, sf_dir)
    b = a.where(F.dayofmonth(TIME) % 3 == 0).select(LABEL, F.date_add(TIME, 1).alias(TIME), F.col("n").cast("double").alias("n2"))
    return joins.attach(a.select(LABEL, TIME), b).select(LABEL, TIME, r("n2").alias("n2"))


def _stations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A series for each of 25 stations, their places, and a monthly grid of 30 degree cells."""
    o = table(spark, sf_dir, "orders")
    df = o.groupBy((F.col("o_custkey") % 25).cast("string").alias(LABEL), F.trunc("o_orderdate", "month").alias(TIME)).agg((F.sum("o_totalprice") / 1000).alias("v"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias(LABEL), (F.col("n_nationkey") * 7 % 90).cast("double").alias("lat"), (F.col("n_nationkey") * 14 % 170).cast("double").alias("lon"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select((F.col("s_suppkey") % 3).alias("lat_cell"), (F.col("s_suppkey") % 6).alias("lon_cell"), F.col("s_acctbal").alias("g"))
    months = df.select(TIME).distinct().where(F.month(TIME) % 2 == 0)
    g = s.groupBy("lat_cell", "lon_cell").agg(F.avg("g").alias("g"))
    return df, n, months.join(g, F.lit(True))


STATIONS = (
    "st AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS label, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2), pl AS (SELECT CAST(n_nationkey AS VARCHAR) AS label, CAST(n_nationkey * 7 % 90 AS DOUBLE) AS lat, CAST(n_nationkey * 14 % 170 AS DOUBLE) AS lon FROM nation),"
    " ce AS (SELECT s_suppkey % 3 AS la, s_suppkey % 6 AS lo, avg(s_acctbal) AS g FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1, 2)"
)


@query(f"WITH {STATIONS} SELECT st.label, st.ts, round(CASE WHEN month(st.ts) % 2 = 0 THEN ce.g END, 4) AS g FROM st LEFT JOIN pl USING (label) LEFT JOIN ce ON ce.la = floor(pl.lat / 30) AND ce.lo = floor(pl.lon / 30)")
def fuse_grid_series(spark, sf_dir):
    df, meta, cells = _stations(spark, sf_dir)
    return joins.fuse_grid_series(df.select(LABEL, TIME), meta, cells, "g", 30.0).select(LABEL, TIME, r("g").alias("g"))


def _mass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = ev(spark, sf_dir)
    mass = a.where(F.dayofmonth(TIME) % 2 == 0).select(LABEL, TIME, F.col("v").alias("EWD"), F.col("s").alias("EWD_Error"))
    return mass, a.groupBy(LABEL, F.date_add(F.trunc(TIME, "month"), 14).alias(TIME)).agg(F.avg("n").alias("GLDAS"))


MASS = "ms AS (SELECT label, ts, v AS e, s AS u FROM ev WHERE day(ts) % 2 = 0), la AS (SELECT label, CAST(date_trunc('month', ts) AS DATE) + 14 AS ts, avg(n) AS g FROM ev GROUP BY 1, 2), mm AS (SELECT ms.*, CASE WHEN abs(ms.ts - la.ts) < 10 THEN la.g END AS g FROM ms LEFT JOIN la ON ms.label = la.label AND date_trunc('month', ms.ts) = date_trunc('month', la.ts))"


@query(f"WITH {EV}, {MASS} SELECT ev.label, ev.ts, round(e, 4) AS off, round(u, 4) AS off_u, round(e - g, 4) AS removed, round(g, 4) AS land, round(CASE WHEN g IS NOT NULL THEN u END, 4) AS land_u FROM ev LEFT JOIN mm USING (label, ts)")
def fuse_mass(spark, sf_dir):
    mass, land = _mass(spark, sf_dir)
    df = ev(spark, sf_dir).select(LABEL, TIME)
    df = joins.fuse_mass(df, mass, column="off", error="off_u")
    df = joins.fuse_mass(df, mass, land, "remove", "removed", "removed_u")
    df = joins.fuse_mass(df, mass, land, "only", "land", "land_u")
    return df.select(LABEL, TIME, *[r(c).alias(c) for c in ("off", "off_u", "removed", "land", "land_u")])


@query(
    "WITH a AS (SELECT 's' || user_id % 40 AS site, CAST(event_id % 7 AS INTEGER) AS prn FROM events WHERE day(ts) = 5), b AS (SELECT 's' || user_id % 60 AS site, CAST(event_id % 5 AS INTEGER) AS prn FROM events WHERE day(ts) = 6)"
    " SELECT 'day' AS side, site, prn, count(*) AS n FROM a WHERE site IN (SELECT site FROM b) AND (site, prn) IN (SELECT (site, prn) FROM b) GROUP BY 2, 3 UNION ALL SELECT 'previous', site, prn, count(*) FROM b WHERE site IN (SELECT site FROM a) AND (site, prn) IN (SELECT (site, prn) FROM a) GROUP BY 2, 3"
)
def same_site_and_satellite(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda day, users, prns: e.where(F.dayofmonth("ts") == day).select(F.concat(F.lit("s"), F.col("user_id") % users).alias("site"), (F.col("event_id") % prns).cast("int").alias("prn"))
    a, b = joins.same_site_and_satellite(side(5, 40, 7), side(6, 60, 5))
    counted = lambda df, name: df.groupBy("site", "prn").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return counted(a, "day").unionByName(counted(b, "previous"))


def _boxes(df: DataFrame, key: str, x, y, size) -> DataFrame:
    df = df.select(F.col(key).alias("feature_id"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + size).cast("double").alias("xmax"), (y + size).cast("double").alias("ymax"))
    return df.withColumn("geom", F.struct("xmin", "ymin", "xmax", "ymax"))


BOXES = "a AS (SELECT p_partkey AS id, p_size AS x0, p_partkey % 97 AS y0, p_size + 1.5 AS x1, p_partkey % 97 + 1.5 AS y1 FROM part), b AS (SELECT s_suppkey AS id, s_suppkey % 53 AS x0, s_suppkey * 7 % 101 AS y0, s_suppkey % 53 + 0.75 AS x1, s_suppkey * 7 % 101 + 0.75 AS y1 FROM supplier)"
_TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


@query(f"WITH {BOXES} SELECT id AS feature_id, EXISTS (SELECT 1 FROM b WHERE {_TOUCH}) AS touches FROM a")
def spatial_semi_join(spark, sf_dir):
    a = _boxes(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size"), F.col("p_partkey") % 97, 1.5)
    b = _boxes(table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_suppkey") % 53, F.col("s_suppkey") * 7 % 101, 0.75)
    touch = lambda p, q: (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])
    near = joins.spatial_semi_join(a, b, touch).select("feature_id", F.lit(True).alias("touches"))
    return near.unionByName(joins.spatial_semi_join(a, b, touch, anti=True).select("feature_id", F.lit(False).alias("touches")))


def _times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cells = p.select((F.col("p_size") % 10).alias("target"), (k % 20).alias("j"), (k % 7).alias("i")).distinct()
    times = p.groupBy((F.col("p_size") * 3 % 10).alias("target"), (k % 20).alias("j"), (k % 7).alias("i")).agg(F.min(F.col("p_retailprice") / 100).alias("time"))
    return cells, times


TIMES = (
    "cl AS (SELECT DISTINCT CAST(p_size % 10 AS INTEGER) AS target, p_partkey % 20 AS j, p_partkey % 7 AS i FROM part), tm AS (SELECT CAST(p_size * 3 % 10 AS INTEGER) AS target, p_partkey % 20 AS j, p_partkey % 7 AS i, min(p_retailprice / 100) AS time FROM part GROUP BY 1, 2, 3),"
    " rc AS (SELECT tm.target AS src, cl.target AS dst, time FROM tm JOIN cl USING (j, i) WHERE tm.target <> cl.target), ed AS (SELECT src, dst, count(*) AS n, min(time) AS lo, max(time) AS hi FROM (SELECT src, dst, time FROM rc UNION ALL SELECT dst, src, time FROM rc) GROUP BY 1, 2)"
)


@query(f"WITH {TIMES} SELECT src, dst, CAST(n AS INTEGER) AS n, round(lo, 4) AS lo, round(hi, 4) AS hi FROM ed WHERE lo <= 9.001")
def neighbour_edges(spark, sf_dir):
    cells, times = _times(spark, sf_dir)
    return joins.neighbour_edges(cells, times, 9.001).select("src", "dst", F.size("times").alias("n"), r(F.array_min("times")).alias("lo"), r(F.array_max("times")).alias("hi"))


@query(f"WITH {TIMES} SELECT src, dst, round(hi, 4) AS time FROM ed WHERE lo <= 9.001 AND hi <= 9.99")
def neighbourhoods(spark, sf_dir):
    cells, times = _times(spark, sf_dir)
    return search.neighbourhoods(joins.neighbour_edges(cells, times, 9.001), 9.99).select("src", "dst", r("time").alias("time"))


@query("SELECT o_orderkey AS query_idx, p_partkey AS train_idx, round(o_totalprice, 2) AS query_x, CAST(o_custkey AS DOUBLE) AS query_y, round(p_retailprice, 2) AS train_x, CAST(p_size AS DOUBLE) AS train_y FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def matched_points(spark, sf_dir):
    matches = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("query_idx"), F.col("l_partkey").alias("train_idx")).distinct()
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return joins.matched_points(matches, q, t).select("query_idx", "train_idx", r("query_x", 2).alias("query_x"), "query_y", r("train_x", 2).alias("train_x"), "train_y")


@query("SELECT c_custkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'none' END AS code FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_info(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("polygon"))
    n = table(spark, sf_dir, "nation")
    info = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("code"), F.col("n_name"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return joins.lookup_info(points, n.select(F.col("n_nationkey").alias("id"), info.alias("info")), "code", "none").select("k", "code")


# --- calibration, filters, selections -------------------------------------------------------


@query(f"WITH {EV} SELECT label, ts, round(v * (1.0 + length(label) / 10.0), 4) AS \"EWD\" FROM ev")
def calibrate_mascon(spark, sf_dir):
    df = ev(spark, sf_dir).select(LABEL, TIME, F.col("v").alias("EWD"))
    meta = df.select(LABEL).distinct().withColumn("scale_factor", 1.0 + F.length(LABEL) / 10.0)
    return stats.calibrate_mascon(df, meta).select(LABEL, TIME, r("EWD").alias("EWD"))


_BEARING = "atan2(-sin(radians(a.lon - b.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)))"


@query(
    f"WITH {GRID}, c AS (SELECT raster_id, j, i, value, 10.0 - j AS lat, i * 1.0 AS lon FROM grid), q AS (SELECT a.raster_id, a.j, a.i, b.value, {HAV.format(a='a.', b='b.')} AS d, {_BEARING} AS be FROM c a JOIN c b ON a.raster_id = b.raster_id AND abs(a.j - b.j) <= 2 AND abs(a.i - b.i) <= 2)"
    " SELECT raster_id, j, i, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM q WHERE d <= sqrt(2) * 200 * 120 / sqrt((120 * 120 - 200 * 200) * cos(2 * be - 2 * 0.6) + 200 * 200 + 120 * 120) GROUP BY 1, 2, 3"
)
def ellipse_favourability(spark, sf_dir):
    c = grid(spark, sf_dir).withColumns({"lat": 10.0 - F.col("j"), "lon": F.col("i") * 1.0})
    return stats.ellipse_favourability(c, 200.0, 120.0, 0.6, 2.0).select("raster_id", "j", "i", r("mean").alias("mean"), r("std").alias("std"))


@query("SELECT p_partkey AS feature_id, p_retailprice AS geometry FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#23')")
def feature_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("geometry"), "p_brand")
    return filters.feature_filter(p, "p_brand", ["Brand#1", "Brand#11", "Brand#12", "Brand#23"])


@query("SELECT CAST(vec_id AS VARCHAR) AS label, round(list_sum(embedding[49:64]) + list_sum(embedding[17:32]), 3) AS total, round(CAST(embedding[49] AS DOUBLE), 5) AS first FROM embeddings")
def select_channels(spark, sf_dir):
    im = images.as_images(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4, 4)
    taken = filters.select_channels(im, [3, 1])
    return taken.select("label", r(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), r(F.get("pixels", F.lit(0)), 5).alias("first"))


@query(
    "WITH o AS (SELECT CAST(event_id % 20 AS INTEGER) AS prn, epoch_us(ts) / 86400000000.0 AS t, event_id % 37 - 18.0 AS la, event_id % 41 - 20.0 AS lo FROM events)"
    " SELECT prn, count(*) AS n FROM o WHERE abs((t - floor(t)) * 24 - 12.0) < 1 AND abs(la - 2.0) < 15 AND abs(lo + 1.0) < 15 GROUP BY prn HAVING count(*) > 10"
)
def busy_satellites(spark, sf_dir):
    k = F.col("event_id")
    obs = table(spark, sf_dir, "events").select((k % 20).cast("int").alias("prn"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0).alias("t"), (k % 37 - 18.0).alias("pplat"), (k % 41 - 20.0).alias("pplon"))
    return filters.busy_satellites(obs, 12.0, 2.0, -1.0, 15.0, 15.0, 10)


@query("SELECT o_orderkey AS k, o_totalprice <= 150000 AND o_custkey % 5 <> o_orderkey % 5 AND o_custkey % 3 <> o_orderkey % 5 AS ok FROM orders")
def path_validity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), filters.can_extend(F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 3), F.col("o_orderkey") % 5, F.col("o_totalprice"), 150000.0).alias("ok"))


# --- windows --------------------------------------------------------------------------------


@query(f"WITH {EVG}, m AS (SELECT label, ts, v, count(v) OVER w AS c, median(v) OVER w AS md FROM evg WINDOW w AS (PARTITION BY label ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT label, ts, round(CASE WHEN c >= 3 THEN md ELSE v END, 4) AS v FROM m")
def series_median(spark, sf_dir):
    return windows.median_filter(evg(spark, sf_dir), "v", 3, interpolate=False, min_periods=3, update=True).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EVG}, {FILLED.format(src='evg', clamp='')} SELECT label, ts, round(avg(v) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS v FROM filled")
def plain_average(spark, sf_dir):
    return windows.weighted_average(series.interpolate_forward(evg(spark, sf_dir), ["v"]), "v", 5).select(LABEL, TIME, r("v").alias("v"))


@query(
    "WITH x AS (SELECT user_id % 50 AS label, ts, event_id, value AS v, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY ts, event_id)), j AS (SELECT *, CASE WHEN (abs(v - pv) > 30 OR CAST(ts AS DATE) <> CAST(pt AS DATE)) AND epoch_us(ts) - epoch_us(pt) < 14400000000 THEN v - pv ELSE 0 END AS k FROM x)"
    " SELECT label, event_id, round(v + coalesce(sum(k) OVER (PARTITION BY label ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 3) AS v FROM j"
)
def day_jumps_removed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias(LABEL), "ts", "event_id", F.col("value").alias("v"))
    return windows.remove_jumps(e, "v", 30.0, 14400.0, by_day=True).select(LABEL, "event_id", r("v", 3).alias("v"))


@query(
    f"WITH {GRID}, s AS (SELECT j, i, CASE WHEN j < 0 THEN -j - 1 WHEN j >= 8 THEN 15 - j ELSE j END AS mj, CASE WHEN j < 0 OR j >= 8 THEN 7 - (i + 8) % 8 ELSE (i + 8) % 8 END AS mi FROM (SELECT unnest(range(-2, 10)) AS j), (SELECT unnest(range(-2, 10)) AS i))"
    " SELECT g.raster_id, CAST(s.j AS INTEGER) AS j, CAST(s.i AS INTEGER) AS i, round(g.value, 5) AS value FROM s JOIN grid g ON g.j = s.mj AND g.i = s.mi"
)
def planet_border(spark, sf_dir):
    return windows.bordered(grid(spark, sf_dir), 8, 8, 2).select("raster_id", "j", "i", r("value", 5).alias("value"))


@query(
    f"WITH {GRID}, s AS (SELECT j, i, CASE WHEN j < 0 THEN -j - 1 WHEN j >= 8 THEN 15 - j ELSE j END AS mj, CASE WHEN i < 0 THEN -i - 1 WHEN i >= 8 THEN 15 - i ELSE i END AS mi FROM (SELECT unnest(range(-1, 9)) AS j), (SELECT unnest(range(-1, 9)) AS i))"
    " SELECT g.raster_id, CAST(s.j AS INTEGER) AS j, CAST(s.i AS INTEGER) AS i, round(g.value, 5) AS value FROM s JOIN grid g ON g.j = s.mj AND g.i = s.mi"
)
def mirrored_border(spark, sf_dir):
    return windows.bordered(grid(spark, sf_dir), 8, 8, 1, planet=False).select("raster_id", "j", "i", r("value", 5).alias("value"))


# --- geodesy --------------------------------------------------------------------------------

PAIR = "pr AS (SELECT a.k, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM sites a JOIN sites b ON b.k = a.k + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sites(spark, sf_dir)
    return a.join(a.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "k")


_XYZ = {f"{c}{n}": e.format(la=f"radians(lat{n})", lo=f"radians(lon{n})") for n in ("", "2") for c, e in (("x", "cos({la}) * cos({lo})"), ("y", "cos({la}) * sin({lo})"), ("z", "sin({la})"))}


@query(f"WITH {SITES}, {PAIR}, v AS (SELECT k, " + ", ".join(f"{e} AS {c}" for c, e in _XYZ.items()) + " FROM pr) SELECT k, round(y * z2 - z * y2, 6) AS cx, round(z * x2 - x * z2, 6) AS cy, round(x * y2 - y * x2, 6) AS cz FROM v")
def great_circle_normals(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("c", geodesy.cross(geodesy.nvector(F.col("lat"), F.col("lon")), geodesy.nvector(F.col("lat2"), F.col("lon2"))))
    return p.select("k", *[r(F.col(f"c.{c}"), 6).alias(f"c{c}") for c in "xyz"])


@query(f"WITH {SITES} SELECT k, round(lat, 5) AS lat, round(lon, 5) AS lon FROM sites WHERE abs(lat) < 89")
def nvectors_back(spark, sf_dir):
    s = sites(spark, sf_dir).where(F.abs("lat") < 89).withColumn("b", geodesy.latlon_of_nvector(geodesy.nvector(F.col("lat"), F.col("lon"))))
    return s.select("k", r("b.lat", 5).alias("lat"), F.when(r("b.lon", 5) == 180.0, -180.0).otherwise(r("b.lon", 5)).alias("lon"))


@query(
    f"WITH {SITES}, {PAIR}, b AS (SELECT k, -atan2(sin(radians(lon - lon2)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon - lon2))) AS a, lat, lon, lat2, lon2 FROM pr WHERE abs(lat) < 89)"
    " SELECT k, round(a - 2 * pi() * floor(a / (2 * pi())), 5) AS bearing, round(degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))), 5) AS angle FROM b"
)
def bearings(spark, sf_dir):
    p = _pairs(spark, sf_dir).where(F.abs("lat") < 89)
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    return p.select("k", r(geodesy.bearing(*c), 5).alias("bearing"), r(geodesy.angular_separation(c[1], c[0], c[3], c[2]), 5).alias("angle"))


_E2 = "(1 / 298.257223563 * (2 - 1 / 298.257223563))"


@query(f"WITH {SITES} SELECT k, round(cos(radians(lat)) * 6378137.0 / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) * pi() / 180 / 4, 3) AS across, round(6378137.0 * (1 - {_E2}) / pow(1 - {_E2} * pow(sin(radians(lat)), 2), 1.5) * pi() / 180 / 4, 3) AS along, round(cos(radians(lat)) * 1737400.0 * pi() / 180 / 4, 3) AS moon FROM sites")
def degree_lengths(spark, sf_dir):
    lat = F.col("lat")
    return sites(spark, sf_dir).select("k", r(geodesy.lateral_metres(lat, 4.0), 3).alias("across"), r(geodesy.medial_metres(lat, 4.0), 3).alias("along"), r(geodesy.lateral_metres(lat, 4.0, "moon"), 3).alias("moon"))


@query(f"WITH {SITES}, t AS (SELECT k, lat * 3 AS la, lon * 2 AS lo, (lat * 3 + 90) - 360 * floor((lat * 3 + 90) / 360) AS u FROM sites), o AS (SELECT *, CASE WHEN u > 180 THEN lo + 180 ELSE lo END + 180 AS w FROM t) SELECT k, round(CASE WHEN u > 180 THEN 270 - u ELSE u - 90 END, 6) AS lat, round(w - 360 * floor(w / 360) - 180, 6) AS lon FROM o")
def wrapped_positions(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("w", geodesy.wrap_latlon(F.col("lat") * 3, F.col("lon") * 2))
    return s.select("k", r("w.lat", 6).alias("lat"), r("w.lon", 6).alias("lon"))


@query(f"WITH {GRID} SELECT raster_id, j, i, round(100.0 + (i + 0.5) * 2.5, 4) AS x, round(50.0 - (j + 0.5) * 1.5, 4) AS y, CAST(floor((101.0 + i * 2.0 - 100.0) / 2.5) AS BIGINT) AS pi, CAST(floor((49.0 - j * 1.2 - 50.0) / -1.5) AS BIGINT) AS pj FROM grid")
def pixel_coordinates(spark, sf_dir):
    g = grid(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    g = g.withColumns({"c": geodesy.affine(i, j, 100.0, 2.5, 50.0, -1.5), "p": geodesy.pixel_of(101.0 + i * 2.0, 49.0 - j * 1.2, 100.0, 2.5, 50.0, -1.5)})
    return g.select("raster_id", "j", "i", r("c.x").alias("x"), r("c.y").alias("y"), F.col("p.i").alias("pi"), F.col("p.j").alias("pj"))


@query("SELECT p_partkey, round((p_size + 0.5) * (360.0 / 100) - 180.0, 4) AS lon, round(90.0 - (p_partkey % 50 + 0.5) * (180.0 / 50), 4) AS lat FROM part")
def pixel_centres(spark, sf_dir):
    lon, lat = geodesy.pixel_centre(F.col("p_size"), F.col("p_partkey") % 50, 100, 50)
    return table(spark, sf_dir, "part").select("p_partkey", r(lon).alias("lon"), r(lat).alias("lat"))


@query(f"WITH {SITES} SELECT k, round(2.5 * cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(2.5 * cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(2.5 * sin(radians(lat)), 6) AS z, round(lat, 5) AS lat, 2.5 AS radius FROM sites")
def sphere_coordinates(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("p", geodesy.spherical_to_xyz(F.col("lat"), F.col("lon"), 2.5)).withColumn("b", geodesy.xyz_to_spherical(F.col("p")))
    return s.select("k", *[r(f"p.{c}", 6).alias(c) for c in "xyz"], r("b.lat", 5).alias("lat"), r("b.radius", 6).alias("radius"))


@query(
    f"WITH {SITES} SELECT k, round(sqrt(2) * 5 * 3 / sqrt((9 - 25) * cos(2 * radians(lon) - 2 * 0.4) + 25 + 9), 6) AS radius, CAST(trunc(100 + 400 / (1 + exp(-0.75 * (abs(lat) - 85)))) AS INTEGER) AS nodes, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat / 100) / 2), 2) + cos(radians(lat / 100)) * pow(sin(radians(lon / 100) / 2), 2)))"
    " <= sqrt(2) * 150 * 60 / sqrt((3600 - 22500) * cos(2 * atan2(-sin(-radians(lon / 100)) * cos(radians(lat / 100)), sin(radians(lat / 100))) - 2 * 0.4) + 22500 + 3600) AS inside FROM sites"
)
def ellipses(spark, sf_dir):
    lit = F.lit
    return sites(spark, sf_dir).select(
        "k",
        r(geodesy.ellipse_radius(lit(5.0), lit(3.0), lit(0.4), F.radians("lon")), 6).alias("radius"),
        geodesy.ellipse_nodes(F.col("lat")).alias("nodes"),
        geodesy.in_ellipse(lit(0.0), lit(0.0), F.col("lat") / 100, F.col("lon") / 100, lit(150.0), lit(60.0), lit(0.4)).alias("inside"),
    )


@query(f"WITH {SITES} SELECT k, round(radians(lon - 10) * cos(radians(5.0)) * 6371.0, 4) AS x, round(radians(lat - 5) * 6371.0, 4) AS y FROM sites")
def planar_offsets(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("o", deformation.planar_offsets(F.col("lat"), F.col("lon"), F.lit(5.0), F.lit(10.0)))
    return s.select("k", r("o.x").alias("x"), r("o.y").alias("y"))


# --- astronomy, fuzzy logic -----------------------------------------------------------------


@query("SELECT p_partkey, round(sqrt((1 + p_size * 1000 / 299792.458) / (1 - p_size * 1000 / 299792.458)) - 1, 6) AS z FROM part")
def velocity_redshift(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(astro.redshift_of_velocity(F.col("p_size") * 1000.0), 6).alias("z"))


@query(
    "WITH t AS (SELECT k, k / 600.0 * 3 AS z, 1 / sqrt(0.3 * pow(1 + k / 600.0 * 3, 3) + 0.7) AS e FROM (SELECT unnest(range(601)) AS k)), d AS (SELECT k, z, (1 + z) * 299792.458 / 70.0 * coalesce(sum((e + pe) / 2 * 3 / 600.0) OVER (ORDER BY k), 0) AS d FROM (SELECT k, z, e, lag(e) OVER (ORDER BY k) AS pe FROM t)),"
    " p AS (SELECT p_partkey, p_size / 20.0 AS z, CAST(least(floor(p_size / 20.0 / 3 * 600), 599) AS INTEGER) AS k FROM part) SELECT p_partkey, round(a.d + (p.z / 3 * 600 - a.k) * (b.d - a.d), 3) AS distance, round(20.0 - 5 * log10((a.d + (p.z / 3 * 600 - a.k) * (b.d - a.d)) * 1e5), 5) AS magnitude FROM p JOIN d a ON a.k = p.k JOIN d b ON b.k = p.k + 1"
)
def luminosity_distances(spark, sf_dir):
    z = F.col("p_size") / 20.0
    return table(spark, sf_dir, "part").select("p_partkey", r(astro.luminosity_distance(z), 3).alias("distance"), r(astro.absolute_magnitude(F.lit(20.0), z), 5).alias("magnitude"))


@query(
    f"WITH {SITES}, n AS (SELECT k, lon, asin(sin(radians(lat)) * cos(radians(10.0)) + cos(radians(lat)) * sin(radians(10.0)) * cos(radians(35.0))) AS d, lat FROM sites), t AS (SELECT k, d, lon + degrees(atan2(sin(radians(35.0)) * sin(radians(10.0)) * cos(radians(lat)), cos(radians(10.0)) - sin(radians(lat)) * sin(d))) AS ra FROM n)"
    " SELECT k, round(ra - 360 * floor(ra / 360), 5) AS ra, round(degrees(d), 5) AS dec FROM t"
)
def moved_points(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("m", astro.move_point(F.col("lon"), F.col("lat"), F.lit(35.0), F.lit(10.0)))
    return s.select("k", r("m.ra", 5).alias("ra"), r("m.dec", 5).alias("dec"))


@query(
    "WITH x AS (SELECT p_partkey, p_size / 10.0 AS rr, greatest(p_size / 10.0, 0.3) / 2.0 AS x FROM part WHERE p_size NOT BETWEEN 19 AND 21) SELECT p_partkey, round(2 * pi() * rr * CASE WHEN x < 0.999 THEN (1 - 2 / sqrt(1 - x * x) * atanh(sqrt((1 - x) / (1 + x)))) / (x * x - 1) ELSE (1 - 2 / sqrt(x * x - 1) * atan(sqrt((x - 1) / (1 + x)))) / (x * x - 1) END, 5) AS density FROM x"
)
def nfw_profile(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(~F.col("p_size").between(19, 21))
    return p.select("p_partkey", r(astro.nfw_density(F.col("p_size") / 10.0, 2.0, 0.3), 5).alias("density"))


# --- rasters and layers ---------------------------------------------------------------------


@query(
    f"WITH {GRID}, o AS (SELECT x AS x0, y AS y0 FROM (SELECT unnest(range(0, 4, 2)) AS x), (SELECT unnest(range(0, 4, 2)) AS y)), t AS (SELECT raster_id, x0, y0, count(*) FILTER (abs(value) < 0.1) / 16.0 AS f FROM grid JOIN o ON i >= x0 AND i < x0 + 4 AND j >= y0 AND j < y0 + 4 GROUP BY 1, 2, 3)"
    " SELECT raster_id || ', Square: ' || CAST(x0 + y0 // 2 AS INTEGER) AS label, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0 FROM t WHERE f >= 0.5"
)
def selected_tiles(spark, sf_dir):
    t = images.tiles(images.as_images(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8), 4, 2)
    return images.select_tiles(t, None, 0.1, 0.5).select("label", "x0", "y0")


@query(
    "WITH p AS (SELECT unnest(range(12)) AS id), b AS (SELECT id, 5.0 * (id % 4) AS x0, 9.0 + 3 * (id // 4) AS y0 FROM p), c AS (SELECT id, x0, y0, x0 - 2 + i * 0.5 AS sx, y0 - 2 + k * 0.5 AS sy FROM b, (SELECT unnest(range(17)) AS i), (SELECT unnest(range(14)) AS k) WHERE i * 0.5 <= 8 AND k * 0.5 <= 6.5),"
    " s AS (SELECT id, sx, sy, greatest(0, least(sx + 2, x0 + 4) - greatest(sx, x0)) * greatest(0, least(sy + 2, y0 + 2.5) - greatest(sy, y0)) / 4 AS share FROM c) SELECT CAST(id AS INTEGER) AS id, round(sx, 3) AS x0, round(sy, 3) AS y0, round(share, 5) AS share FROM s WHERE share > 0.5"
)
def squares_over_polygons(spark, sf_dir):
    return images.squares_over_polygons(_squares(spark).where("id < 12"), 2.0, 0.5, 0.5).select("id", r("x0", 3).alias("x0"), r("y0", 3).alias("y0"), r("share", 5).alias("share"))


@query(f"WITH {GRID} SELECT raster_id, j, CAST((i + 3) % 8 AS INTEGER) AS i, round(value, 5) AS value FROM grid")
def recentred(spark, sf_dir):
    return images.recentre(grid(spark, sf_dir), 8, 3).select("raster_id", "j", "i", r("value", 5).alias("value"))


@query("WITH p AS (SELECT p_partkey AS k, p_size + 0.25 AS x, p_retailprice / 100 AS y FROM part), s AS (SELECT unnest(range(12)) AS id) SELECT k FROM p WHERE EXISTS (SELECT 1 FROM s WHERE x >= 5 * (id % 4) AND x < 5 * (id % 4) + 4 AND y >= 9 + 3 * (id // 4) AND y < 11.5 + 3 * (id // 4)) OR " + _in_diamond("x", "y"))
def clipped_points(spark, sf_dir):
    pts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 0.25).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return images.clip_points(pts, _squares(spark), 5.0).select("k")


@query(f"WITH {SITES}, s AS (SELECT min(k) AS k, lat, lon FROM sites WHERE k % 4 = 1 GROUP BY lat, lon), d AS (SELECT a.k, b.k AS site, {HAV.format(a='a.', b='b.')} / 6371.0 AS d FROM sites a, s b) SELECT k, CAST(arg_min(site, {{'d': round(d, 9), 's': site}}) AS BIGINT) AS site, round(degrees(min(d)), 4) AS distance FROM d GROUP BY k")
def nearest_sites(spark, sf_dir):
    s = sites(spark, sf_dir)
    return images.nearest_sites(s, s.where("k % 4 = 1").withColumnRenamed("k", "site"), 5.0).select("k", "site", r("distance").alias("distance"))


@query("SELECT CAST(id AS INTEGER) AS id, CAST(k AS INTEGER) AS k, x, y, CAST(CASE WHEN k = 0 THEN 1 WHEN k = 3 THEN 79 ELSE 2 END AS INTEGER) AS code FROM (SELECT id, 0 AS k, 5.0 * (id % 4) AS x, 9.0 + 3 * (id // 4) AS y FROM (SELECT unnest(range(12)) AS id) UNION ALL SELECT id, 1, 5.0 * (id % 4) + 4, 9.0 + 3 * (id // 4) FROM (SELECT unnest(range(12)) AS id) UNION ALL SELECT id, 2, 5.0 * (id % 4) + 4, 11.5 + 3 * (id // 4) FROM (SELECT unnest(range(12)) AS id) UNION ALL SELECT id, 3, 5.0 * (id % 4), 11.5 + 3 * (id // 4) FROM (SELECT unnest(range(12)) AS id))")
def path_codes(spark, sf_dir):
    return images.path_codes(_squares(spark).where("id < 12")).select("id", "k", "x", "y", "code")


# --- time, paths, runs ----------------------------------------------------------------------


@query(f"WITH RECURSIVE {NEAR}, w AS (SELECT n_nationkey AS node, n_nationkey AS target, 0.0::DOUBLE AS time FROM nation UNION SELECT w.node, e.dst, w.time + e.time FROM w JOIN e ON w.target = e.src WHERE w.time + e.time <= 7) SELECT node, target, min(time) AS time FROM w GROUP BY 1, 2")
def within_time(spark, sf_dir):
    return search.within_time(_near(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), 7.0)


GROUPS = "gr AS (SELECT CAST(s AS INTEGER) AS scenario, n_nationkey AS node, 'g' || n_regionkey AS grp, CASE WHEN n_regionkey <= s THEN 0 WHEN n_regionkey < 4 THEN 1 END AS priority FROM nation, (SELECT unnest(range(3)) AS s))"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(2))))
    region = F.col("n_regionkey")
    return n.select("scenario", F.col("n_nationkey").alias("node"), F.concat(F.lit("g"), region).alias("grp"), F.when(region <= F.col("scenario"), 0).when(region < 4, 1).alias("priority"))


@query(
    f"WITH RECURSIVE {NEAR}, {GROUPS}, w AS (SELECT n_nationkey AS node, n_nationkey AS target, 0.0::DOUBLE AS time FROM nation UNION SELECT w.node, e.dst, w.time + e.time FROM w JOIN e ON w.target = e.src WHERE w.time + e.time <= 6),"
    " h AS (SELECT scenario, w.node, count(DISTINCT grp) AS n FROM w JOIN gr ON gr.node = w.target AND priority = 0 GROUP BY 1, 2) SELECT scenario, node FROM h WHERE n = scenario + 1"
)
def threshold_targets(spark, sf_dir):
    return search.threshold_targets(_near(spark, sf_dir), _groups(spark, sf_dir), 6.0).select("scenario", "node")


@query(
    f"WITH RECURSIVE {PATHS}, {GROUPS}, vs AS (SELECT start, path, times, unnest(path) AS node, unnest(times) AS met_at FROM ended), m AS (SELECT start, path, times, scenario, priority, grp, met_at FROM vs JOIN gr USING (node) WHERE priority IS NOT NULL),"
    " f AS (SELECT start, path, times, scenario, grp, min(met_at) AS met_at FROM m WHERE priority = 0 GROUP BY 1, 2, 3, 4, 5), d AS (SELECT start, path, times, scenario, max(met_at) AS duration FROM f GROUP BY 1, 2, 3, 4 HAVING count(*) = scenario + 1)"
    " SELECT start, array_to_string(path, '-') AS path, scenario, duration, CAST(priority AS INTEGER) AS priority, count(*) AS met, count(DISTINCT grp) AS distinct_met FROM d JOIN m USING (start, path, times, scenario) GROUP BY start, path, times, scenario, duration, priority"
)
def paths_with_all_groups(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    met = search.met_groups(search.traverse_paths(_near(spark, sf_dir), starts, 9.0), _groups(spark, sf_dir))
    return met.withColumn("path", F.array_join("path", "-")).drop("times")


@query(
    "SELECT o_orderkey AS k, round(2.0 * (o_custkey % 7) / 7.0 + 1.5 * 0.5 + 3.0 * (1 - o_totalprice / 600000.0) + 0.5 * (o_custkey % 3 + 1) / 4.0 + 0.25 * (1 - (o_custkey % 3 + 1) / 5.0), 4) AS rank FROM orders"
)
def path_ranks(spark, sf_dir):
    c = F.col("o_custkey") % 3 + 1
    rank = search.path_rank((F.col("o_custkey") % 7) / 7.0, F.lit(5.0), F.lit(10.0), F.col("o_totalprice"), 600000.0, c, F.lit(4), c, F.lit(5), {"data": 2.0, "sinuosity": 1.5, "duration": 3.0, "group": 0.5, "number": 0.25})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), r(rank).alias("rank"))


@query(f"WITH {EV} SELECT label, k * 2.0 AS factor, round(avg(v) * (1 + k) * 2, 4) AS v, CAST(k AS BIGINT) AS run_id FROM ev, (SELECT unnest(range(3)) AS k) GROUP BY label, k")
def scaled_runs(spark, sf_dir):
    """Runs of two stages whose results carry their run: a cycle of factors, then means by label."""
    source = Dataset.of(ev(spark, sf_dir).select(LABEL, TIME, "v"), ["v"])
    scale = Stage("scale", lambda d, k: d.with_df(d.df.withColumns({"v": F.col("v") * (1 + k), "factor": F.lit(k * 2.0)})), ParamCycle([0, 1, 2]))
    double = Stage("double", lambda d: readers.snapshot(d.with_df(d.df.groupBy(LABEL, "factor").agg((F.avg("v") * 2).alias("v"))), "means"))
    return Pipeline(lambda run_id: source, [scale, double]).run(3).results("means").select(LABEL, "factor", r("v").alias("v"), "run_id")


@query("SELECT CAST(run_id AS INTEGER) AS run_id, CAST(s AS INTEGER) AS stage_no, CASE s WHEN 1 THEN 'scale[' || (run_id * 10 + 1) || ']' ELSE 'keep[x]' END AS description FROM (SELECT unnest(range(4)) AS run_id), (SELECT unnest(range(1, 3)) AS s)")
def run_history(spark, sf_dir):
    """Provenance of four runs: what each stage was told."""
    source = Dataset.of(ev(spark, sf_dir).select(LABEL, TIME, "v"), ["v"])
    stages = [Stage("scale", lambda d, k: d, ParamCycle([1, 11, 21, 31])), Stage("keep", lambda d, k: d, Param("x"))]
    history = Pipeline(lambda run_id: source, stages).run(4).history(spark)
    return history.where("stage_no > 0").select(F.col("run_id").cast("int").alias("run_id"), F.col("stage_no").cast("int").alias("stage_no"), "description")


@query(f"WITH {EV}, k AS (SELECT unnest(range(3)) AS k) SELECT label, ts, round(CASE k WHEN 0 THEN v * 2 WHEN 1 THEN v * 2 + 1 ELSE abs(v * 2 + 1) END, 4) AS v, CAST(k AS BIGINT) AS run_id FROM ev, k")
def growing_chain(spark, sf_dir):
    """A chain that grows by one stage a run."""
    on = lambda f: lambda d: d.with_df(d.df.withColumn("v", f(F.col("v"))))
    chain = Incremental([Stage("double", on(lambda v: v * 2)), Stage("add", on(lambda v: v + 1)), Stage("size", on(F.abs))])
    source = Dataset.of(ev(spark, sf_dir).select(LABEL, TIME, "v"), ["v"])
    return Pipeline(lambda run_id: source, [chain]).run(3).data().select(LABEL, TIME, r("v").alias("v"), "run_id")


@query(f"WITH {EV} SELECT label, round(avg(v * (1 + k)), 4) AS v FROM ev, (SELECT unnest(range(4)) AS k) GROUP BY label")
def means_over_runs(spark, sf_dir):
    runs = run_grid(lambda k: ev(spark, sf_dir).select(LABEL, (F.col("v") * (1 + k)).alias("v")), [{"k": k} for k in range(4)])
    return stats.run_means(runs, [LABEL], ["v"]).select(LABEL, r("v").alias("v"))


@query(f"WITH {EV} SELECT label, ts, name, round(value, 4) AS value FROM (SELECT label, ts, 'v' AS name, v AS value FROM ev UNION ALL SELECT label, ts, 's', s FROM ev)")
def table_to_series(spark, sf_dir):
    return melt(ev(spark, sf_dir).select(LABEL, TIME, "v", "s"), ["v", "s"]).select(LABEL, TIME, "name", r("value").alias("value"))


@query(f"WITH {EV} SELECT label, ts, round(v, 4) AS v, round(s, 4) AS s FROM ev")
def series_to_table(spark, sf_dir):
    return widen(melt(ev(spark, sf_dir).select(LABEL, TIME, "v", "s"), ["v", "s"]), ["v", "s"]).select(LABEL, TIME, r("v").alias("v"), r("s").alias("s"))


@query("SELECT p_brand AS brand FROM part GROUP BY 1 ORDER BY 1")
def field_values(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("fields"))
    return readers.field_values(f, "brand", unique=True)


@query(f"WITH {GRID} SELECT raster_id, j, i, round(CASE WHEN (raster_id + j) % 5 > 0 THEN value * 0.5 + 3 END, 5) AS value, 10.0 + (i + 0.5) * 0.25 AS lon, 60.0 - (j + 0.5) * 0.25 AS lat FROM grid")
def raster_values(spark, sf_dir):
    """Stored values with a no-data mark, scaled and placed."""
    g = grid(spark, sf_dir).withColumn("value", F.when((F.col("raster_id") + F.col("j")) % 5 > 0, F.col("value")).otherwise(readers.NO_DATA))
    placed = readers.place_cells(readers.raster_values(g, scale=0.5, offset=3.0), readers.geotransform(10.0, 60.0, 0.25))
    return placed.select("raster_id", "j", "i", r("value", 5).alias("value"), "lon", "lat")


@query("SELECT * FROM (SELECT event_id, event_id % 37 - 18.0 AS pplat, event_id % 41 - 20.0 AS pplon, 'd' || day(ts) AS day FROM events WHERE day(ts) IN (3, 4)) WHERE pplat BETWEEN -10 AND 12.5 AND pplon BETWEEN -8 AND 9")
def stitched_days(spark, sf_dir):
    k = F.col("event_id")
    day = lambda d: table(spark, sf_dir, "events").where(F.dayofmonth("ts") == d).select("event_id", (k % 37 - 18.0).alias("pplat"), (k % 41 - 20.0).alias("pplon"))
    return readers.stitch_days({"d3": day(3), "d4": day(4)}, -10.0, 12.5, -8.0, 9.0)


@query(
    "WITH p AS (SELECT s_suppkey AS id, s_suppkey // 10 AS part, s_suppkey % 3 > 0 AS hole, CASE WHEN s_suppkey % 3 > 0 THEN 1.0 ELSE 2.0 + s_suppkey % 4 END AS side FROM supplier WHERE s_suppkey >= 3), o AS (SELECT *, last_value(CASE WHEN NOT hole THEN id END IGNORE NULLS) OVER (PARTITION BY part ORDER BY id) AS shell FROM p)"
    " SELECT CAST(shell AS BIGINT) AS id, round(max(CASE WHEN NOT hole THEN side * side END), 4) AS area, CAST(count(*) FILTER (hole) AS INTEGER) AS n_holes FROM o WHERE shell IS NOT NULL GROUP BY shell"
)
def rings_to_polygons(spark, sf_dir):
    """Shells run clockwise, holes anticlockwise; a hole belongs to the shell before it."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey >= 3")
    k = F.col("s_suppkey")
    hole, side = k % 3 > 0, F.when(k % 3 > 0, 1.0).otherwise(2.0 + k % 4)
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.when(hole, F.array(pt(zero, zero), pt(side, zero), pt(side, side), pt(zero, side))).otherwise(F.array(pt(zero, zero), pt(zero, side), pt(side, side), pt(side, zero)))
    rings = s.select(F.floor(k / 10).alias("part"), k.alias("id"), ring.alias("ring"), F.create_map(F.lit("n"), k.cast("string")).alias("info"))
    made = polygons.rings_to_polygons(rings)
    return made.select(F.col("id").cast("long").alias("id"), r(F.abs(polygons.shoelace(F.col("shell")))).alias("area"), F.size(F.coalesce("holes", F.array())).alias("n_holes"))


@query(f"WITH {EV}, m AS (SELECT label, v, avg(v) OVER (PARTITION BY label) AS mu, stddev_pop(v) OVER (PARTITION BY label) AS sd, row_number() OVER (PARTITION BY label ORDER BY v) AS i, count(*) OVER (PARTITION BY label) AS n FROM ev), c AS (SELECT *, 0.5 + atan((v - mu) / sd) / pi() AS f FROM m) SELECT label, CAST(any_value(n) AS BIGINT) AS n, round(max(greatest(i * 1.0 / n - f, f - (i - 1) * 1.0 / n)), 5) AS statistic FROM c GROUP BY label")
def ks_against_cauchy(spark, sf_dir):
    """One-sample test of standardised values against a Cauchy distribution."""
    z = stats.zscore(ev(spark, sf_dir), "v", "z").withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(LABEL)))
    z = z.withColumn("z", F.col("z") * F.sqrt(F.col("n_rows") / (F.col("n_rows") - 1)))  # deviation of the population
    return stats.one_sample_ks(z, "z", lambda x: 0.5 + F.atan(x) / math.pi).select(LABEL, "n", r("statistic", 5).alias("statistic"))


@query(f"WITH {EVG}, {POS.format(src='evg')}, n AS (SELECT *, count(*) OVER (PARTITION BY label) AS c, min(ts) OVER (PARTITION BY label) AS t0 FROM x) SELECT label, CAST(ts - t0 AS DOUBLE) AS days, round(pos * 2 * pi() / (c - 1), 5) AS angle, round(v, 4) AS value FROM n WHERE v IS NOT NULL")
def usable_points(spark, sf_dir):
    df = evg(spark, sf_dir)
    days = series.usable_points(df, "v").withColumn("k", F.row_number().over(Window.partitionBy(LABEL).orderBy("index")))
    turned = series.usable_points(df, "v", "angle").withColumn("k", F.row_number().over(Window.partitionBy(LABEL).orderBy("index")))
    return days.select(LABEL, "k", F.col("index").alias("days"), r("value").alias("value")).join(turned.select(LABEL, "k", r("index", 5).alias("angle")), [LABEL, "k"]).drop("k")


@query(
    f"WITH {EV}, {POS.format(src='ev')}, h1 AS (SELECT label, pos // 2 AS k, max(CASE WHEN pos % 2 = 0 THEN v END) AS x0, coalesce(max(CASE WHEN pos % 2 = 1 THEN v END), max(CASE WHEN pos % 2 = 0 THEN v END)) AS x1 FROM x GROUP BY 1, 2), n1 AS (SELECT label, 'a' AS path, k, (x0 + x1) / sqrt(2) AS v FROM h1 UNION ALL SELECT label, 'd', k, (x0 - x1) / sqrt(2) FROM h1),"
    " h2 AS (SELECT label, path, k // 2 AS k, max(CASE WHEN k % 2 = 0 THEN v END) AS x0, coalesce(max(CASE WHEN k % 2 = 1 THEN v END), max(CASE WHEN k % 2 = 0 THEN v END)) AS x1 FROM n1 GROUP BY 1, 2, 3) SELECT label, path || 'a' AS path, CAST(k AS BIGINT) AS k, round((x0 + x1) / sqrt(2), 4) AS value FROM h2 UNION ALL SELECT label, path || 'd', CAST(k AS BIGINT), round((x0 - x1) / sqrt(2), 4) FROM h2"
)
def haar_packets(spark, sf_dir):
    return series.haar_packets(ev(spark, sf_dir), "v", 2).select(LABEL, "path", "k", r("value").alias("value"))


@query(f"WITH {LI}, {POS.format(src='li')} SELECT label, CAST(pos AS BIGINT) AS k, round(v, 1) AS v FROM x")
def haar_packets_back(spark, sf_dir):
    df = li(spark, sf_dir)
    n = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    back = series.from_packets(series.haar_packets(df, "v", 3)).join(n, LABEL).where("k < n")
    return back.select(LABEL, F.col("k").cast("long").alias("k"), r("value", 1).alias("v"))


@query("WITH c AS (SELECT CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, -10.3 + i * 0.75 AS x0, -10.3 + i * 0.75 + 0.75 AS x1, 20.3 - (j + 1) * 0.812 AS y0, 20.3 - j * 0.812 AS y1 FROM (SELECT unnest(range(25)) AS j), (SELECT unnest(range(80)) AS i)), s AS (SELECT unnest(range(12)) AS id) SELECT j, i, CASE WHEN EXISTS (SELECT 1 FROM s WHERE x0 <= 5 * (id % 4) + 4 AND x1 >= 5 * (id % 4) AND y0 <= 11.5 + 3 * (id // 4) AND y1 >= 9 + 3 * (id // 4)) THEN 0.0 ELSE 1.0 END AS value FROM c")
def rasterize_all_touched(spark, sf_dir):
    return images.rasterize(_squares(spark).where("id < 12"), 25, 80, (-10.3, 0.0, 49.7, 20.3), all_touched=True)


@query(f"WITH {BOXES} SELECT id AS feature_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_TOUCH})")
def touching_polygons(spark, sf_dir):
    """Rings as geometries, and the test that comes with the join."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    a = _boxes(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size"), F.col("p_partkey") % 97, 1.5).withColumn("geom", ring)
    b = _boxes(table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_suppkey") % 53, F.col("s_suppkey") * 7 % 101, 0.75).withColumn("geom", ring)
    return joins.spatial_semi_join(a, b).select("feature_id")


@query("SELECT CAST(id AS INTEGER) AS id, round((5.0 * (id % 4) - 0) * 2 + 100, 4) AS x0, round((9.0 + 3 * (id // 4) - 9) * 10 / 8.5 - 5, 4) AS y0 FROM (SELECT unnest(range(12)) AS id)")
def moved_extent(spark, sf_dir):
    moved = _squares(spark).where("id < 12").withColumn("shell", polygons.remap(F.col("shell"), (0.0, 9.0, 19.0, 17.5), (100.0, -5.0, 138.0, 5.0)))
    first = F.get("shell", F.lit(0))
    return moved.select("id", r(first["x"]).alias("x0"), r(first["y"]).alias("y0"))


@query(
    f"WITH {SITES}, m AS (SELECT k, lat, lon, avg(lat) OVER () AS mlat, avg(lon) OVER () AS mlon, sin(k) AS n, cos(k * 2) AS e FROM sites), f AS (SELECT count(*) FILTER (abs(atan2(lat - mlat, lon - mlon) - atan2(n, e)) >= pi() / 2) > count(*) FILTER (abs(atan2(lat - mlat, lon - mlon) - atan2(n, e)) < pi() / 2) AS turn FROM m)"
    " SELECT k AS label, round(CASE WHEN turn THEN -n ELSE n END, 6) AS north, round(CASE WHEN turn THEN -e ELSE e END, 6) AS east FROM m, f"
)
def oriented_eigenvectors(spark, sf_dir):
    s = sites(spark, sf_dir).select(F.col("k").alias(LABEL), "lat", "lon", F.sin("k").alias("north"), F.cos(F.col("k") * 2).alias("east"))
    return decomposition.orient_eigenvectors(s).select(LABEL, r("north", 6).alias("north"), r("east", 6).alias("east"))


@query(
    "WITH RECURSIVE p AS (SELECT CAST(p_size % 2 AS VARCHAR) AS label, p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 40 AS y FROM part), nb AS (SELECT a.label, a.id, b.id AS id2 FROM p a JOIN p b ON a.label = b.label AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1),"
    " co AS (SELECT label, id FROM nb GROUP BY 1, 2 HAVING count(*) >= 4), ed AS (SELECT nb.* FROM nb JOIN co USING (label, id) JOIN co c2 ON c2.label = nb.label AND c2.id = nb.id2), re AS (SELECT label, id, id AS root FROM co UNION SELECT re.label, ed.id2, re.root FROM re JOIN ed ON ed.label = re.label AND ed.id = re.id),"
    " cl AS (SELECT label, id, min(root) AS c FROM re GROUP BY 1, 2), bo AS (SELECT nb.label, nb.id, arg_min(cl.c, nb.id2) AS c FROM nb JOIN cl ON cl.label = nb.label AND cl.id = nb.id2 GROUP BY 1, 2) SELECT label, id, CAST(coalesce(cl.c, bo.c, -1) AS BIGINT) AS cluster FROM p LEFT JOIN cl USING (label, id) LEFT JOIN bo USING (label, id)"
)
def density_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("string").alias(LABEL), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40).alias("y"))
    return decomposition.density_clusters(p, "x", "y", 1.0, 4)


@query(f"WITH {EV}, k AS (SELECT label, ts, v, s, atan2(v, s) AS x FROM ev) SELECT label, ts, round(least(1.0, greatest(0.0, (x - 1.0) / 0.5)), 5) AS m FROM k WHERE x IS NOT NULL")
def fuzzy_ramp(spark, sf_dir):
    """A trapezoid whose right side is never reached."""
    df = ev(spark, sf_dir).withColumn("x", F.atan2("v", "s")).where("x IS NOT NULL")
    return df.select(LABEL, TIME, r(fuzzy.trapezoid(F.col("x"), 1.0, 1.5, 10.0, 11.0, 0.0, 1.0), 5).alias("m"))


ORACLES["dbscan_labels"] = ORACLES["density_clusters"]


# --- recurrences over blocks ----------------------------------------------------------------


@query(ORACLES["kalman_forward"])
def kalman_forward_blocks(spark, sf_dir):
    """Blocks of 100 rows instead of whole series."""
    return scan.kalman_forward(li(spark, sf_dir), "v", rows=100).select(LABEL, TIME, r("state").alias("state"), r("state_var").alias("state_var"))


@query(ORACLES["kalman_two_sided"])
def kalman_two_sided_blocks(spark, sf_dir):
    return scan.kalman_smooth(od(spark, sf_dir), "v", tau=30.0, variance=100.0, noise=400.0, clip=1e9, rows=100).select(LABEL, TIME, r("v", 3).alias("v"))


@query(ORACLES["rts_smooth"])
def rts_smooth_blocks(spark, sf_dir):
    return scan.rts_smooth(series.resample(od(spark, sf_dir)), "v", 30.0, 100.0, 400.0, rows=100).select(LABEL, TIME, r("v", 3).alias("v"))


# --- linkage --------------------------------------------------------------------------------

_POINTS = "pt AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x, sin(s_suppkey) * 3 AS y, s_nationkey / 5.0 AS z FROM supplier), ds AS (SELECT p.id AS a, q.id AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM pt p JOIN pt q ON p.id < q.id)"


@query(
    f"WITH RECURSIVE {_POINTS}, w AS (SELECT 0 AS step, a, b, d AS t, 1::BIGINT AS n, first_value(a) OVER o AS ma, first_value(b) OVER o AS mb FROM ds WINDOW o AS (ORDER BY d, a, b)"
    " UNION ALL SELECT step, a, b, t, n, first_value(a) OVER (ORDER BY t / n, a, b) AS ma, first_value(b) OVER (ORDER BY t / n, a, b) AS mb FROM (SELECT step + 1 AS step, least(u, v) AS a, greatest(u, v) AS b, sum(t) AS t, sum(n)::BIGINT AS n FROM (SELECT step, CASE WHEN a = mb THEN ma ELSE a END AS u, CASE WHEN b = mb THEN ma ELSE b END AS v, t, n FROM w) WHERE u <> v GROUP BY 1, 2, 3)),"
    " m AS MATERIALIZED (SELECT step, a AS l, b AS r, t / n AS d, n FROM w WHERE a = ma AND b = mb),"
    " z AS (SELECT 0 AS step, id AS leaf, id AS c FROM pt UNION ALL SELECT z.step + 1, leaf, CASE WHEN c = m.r THEN m.l ELSE c END FROM z JOIN m ON m.step = z.step)"
    ' SELECT m.l AS "left", m.r AS "right", round(m.d, 6) AS distance, count(*) AS size FROM m JOIN z ON z.step = m.step AND z.c IN (m.l, m.r) GROUP BY m.step, m.l, m.r, m.d'
)
def average_linkage(spark, sf_dir):
    """Merges of the suppliers by balance, a wave of their keys, and nation."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (F.sin("s_suppkey") * 3).alias("y"), (F.col("s_nationkey") / 5.0).alias("z"))
    return decomposition.linkage_of_points(p.select("id", F.array("x", "y", "z").alias("v"))).select("left", "right", r("distance", 6).alias("distance"), "size")


# --- images and files -----------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that checkpoints go to."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {GRID} SELECT CAST(raster_id AS VARCHAR) AS label, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, round(value - avg(value) OVER (PARTITION BY raster_id), 5) AS value FROM grid")
def image_apply(spark, sf_dir):
    """Each image less its own mean, by a function of the array."""
    flat = images.apply_function(_images(spark, sf_dir), lambda a: a - a.mean())
    return images.cells_of(flat).select("label", "j", "i", r("value", 5).alias("value"))


@query(f"WITH {GRID} SELECT CAST(raster_id AS VARCHAR) AS label, raster_id % 2 AS run, round(sum(value), 4) AS total FROM grid GROUP BY 1, 2")
def saved_runs(spark, sf_dir):
    """Images saved by two runs in folders of their own, and one view over both."""
    whole, folders = _images(spark, sf_dir), [_folder(spark, "images") for _ in range(2)]
    for k, folder in enumerate(folders):
        readers.save_run(whole.where(F.col("label").cast("long") % 2 == k), folder, k)
    seen = readers.linked(spark, folders)
    run = F.regexp_extract("saved_in", "run_([0-9]{6})", 1).cast("long")
    return seen.select("label", run.alias("run"), r(F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(f"WITH {NEAR} SELECT src AS start, array_to_string(list_sort(list(dst)), ',') AS dst, round(sum(time), 4) AS time FROM e GROUP BY src")
def paths_as_text(spark, sf_dir):
    """Rows of arrays and structs written as text and read again."""
    from_each = _near(spark, sf_dir).groupBy(F.col("src").alias("start")).agg(F.array_sort(F.collect_list("dst")).alias("path"), F.collect_list(F.struct("dst", "time")).alias("steps"))
    kind = {f.name: f.dataType.simpleString() for f in from_each.schema}
    path = _folder(spark, "paths")
    readers.write_paths(from_each, path)
    back = readers.read_paths(spark, path, kind)
    total = F.aggregate("steps", F.lit(0.0), lambda s, e: s + e["time"])
    return back.select("start", F.array_join(F.transform("path", lambda v: v.cast("string")), ",").alias("dst"), r(total).alias("time"))


@query(f"WITH {EV}, d AS (SELECT min(ts) + 4 AS a, min(ts) + 11 AS b FROM ev) SELECT label, ts, CASE WHEN label IN ('click', 'view') AND ts BETWEEN a AND b THEN NULL ELSE round(v, 4) END AS v FROM ev, d")
def blank_range(spark, sf_dir):
    """One range of days, counted from the first, of two labels."""
    df = ev(spark, sf_dir)
    first = df.agg(F.min(TIME)).first()[0]  # one date
    return filters.blank_range(df, ["v"], first + dt.timedelta(days=4), first + dt.timedelta(days=11), ["click", "view"]).select(LABEL, TIME, r("v").alias("v"))


_SOURCE = {"lat0": "n_nationkey * 2 - 20 + (n_nationkey % 7 - 3) / 100.0", "lon0": "n_nationkey * 5 - 60 + (n_nationkey % 5 - 2) / 50.0", "depth0": "4.0 + n_nationkey % 5 * 0.5", "amplitude0": "(1 + n_nationkey % 3) * 1e-4"}


@query(
    "WITH m AS (SELECT unnest(['closed_pipe', 'constant_open_pipe', 'finite_sphere', 'mogi', 'rising_open_pipe', 'sill']) AS model), n AS (SELECT n_nationkey FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) >= 8)"
    f" SELECT n_nationkey || '-' || model AS label, model, round(CAST({_SOURCE['lat0']} AS DOUBLE), 4) AS lat, round(CAST({_SOURCE['lon0']} AS DOUBLE), 4) AS lon, round(CAST({_SOURCE['depth0']} AS DOUBLE), 3) AS depth,"
    f" round(CAST({_SOURCE['amplitude0']} AS DOUBLE) * 1e4, 3) AS amplitude, CASE WHEN model IN ('mogi', 'sill') THEN NULL ELSE 1.5 END AS extra, true AS converged FROM n, m"
)
def invert_sources(spark, sf_dir):
    """Customers as stations over a source of each model below their nation: the sources found from the displacements."""
    places = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.expr("c_nationkey * 2 - 20 + (c_custkey * 37 % 401 - 200) / 1000.0").cast("double").alias("lat"), F.expr("c_nationkey * 5 - 60 + (c_custkey * 73 % 397 - 198) / 1000.0").cast("double").alias("lon"))
    at = places.withColumns({c: F.expr(v).cast("double") for c, v in _SOURCE.items()})
    o = deformation.planar_offsets(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    made = []
    for name, (form, n_extra) in sorted(deformation.MODELS.items()):
        u = form(o["x"], o["y"], F.col("depth0"), F.col("amplitude0"), *[F.lit(1.5)] * n_extra)
        made.append(F.struct(F.lit(name).alias("model"), *[F.coalesce(u[c], F.lit(0.0)).alias(d) for c, d in zip("xyz", ("east", "north", "up"), strict=True)]))
    stations = at.select("n_nationkey", "lat", "lon", F.explode(F.array(*made)).alias("u")).select(F.concat_ws("-", "n_nationkey", "u.model").alias(LABEL), "lat", "lon", "u.*")
    found = inversion.invert_sources(stations, stations.select(LABEL, "model"), min_stations=8)
    return found.select(LABEL, "model", r("lat").alias("lat"), r("lon").alias("lon"), r("depth", 3).alias("depth"), r(F.col("amplitude") * 1e4, 3).alias("amplitude"), r("extra", 3).alias("extra"), "converged")


@query(
    f"WITH {EV}, {POS.format(src='ev')}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY label), h AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest([1 + sqrt(3), 3 + sqrt(3), 3 - sqrt(3), 1 - sqrt(3)]) / (4 * sqrt(2)) AS h),"
    " t AS (SELECT j.i AS j, a.h AS a, j.h * CASE WHEN j.i % 2 = 0 THEN -1 ELSE 1 END AS d FROM h j JOIN h a ON a.i = 3 - j.i), k AS (SELECT label, n, unnest(range((n + 3) // 2)) AS k FROM n), e AS (SELECT label, n, k, a, d, 2 * k + 1 - j AS e FROM k, t),"
    " y AS (SELECT e.label, k, sum(a * v) AS a, sum(d * v) AS d FROM e JOIN x ON x.label = e.label AND x.pos = CASE WHEN e < 0 THEN -1 - e WHEN e >= n THEN 2 * n - 1 - e ELSE e END GROUP BY 1, 2)"
    " SELECT label, 'a' AS path, CAST(k AS BIGINT) AS k, round(a, 4) AS value FROM y UNION ALL SELECT label, 'd', CAST(k AS BIGINT), round(d, 4) FROM y"
)
def wavelet_packets(spark, sf_dir):
    return wavelets.wavelet_packets(ev(spark, sf_dir), "v", "db2", 1).select(LABEL, "path", "k", r("value").alias("value"))


@query(f"WITH {LI}, {POS.format(src='li')} SELECT label, CAST(pos AS BIGINT) AS k, round(v, 1) AS v FROM x")
def wavelet_packets_back(spark, sf_dir):
    packets = wavelets.wavelet_packets(li(spark, sf_dir), "v", "sym4", 3)
    return wavelets.from_wavelet_packets(packets, "sym4", 3).select(LABEL, "k", r("value", 1).alias("v"))
