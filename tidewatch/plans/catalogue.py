"""Queries over the test tables and the SQL that DuckDB runs for them.

Series: ``ev`` (daily means of events by type), ``evg`` (the same with days blanked),
``li`` (daily sums of line items by return flag), ``od`` (daily means of orders by
priority, gappy).  Floating results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, Dataset
from ..functions import astro, deformation, fuzzy, geodesy, polygons
from ..operators import decomposition, filters, images, joins, kernels, search, series, stats, windows
from ..sources import generators
from .pipeline import ParamCycle, Pipeline, Stage, run_grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT event_type AS label, CAST(ts AS DATE) AS ts, avg(value) AS v, count(*) AS n, stddev_samp(value) AS s FROM events GROUP BY 1, 2)"
EVG = EV + ", evg AS (SELECT label, ts, CASE WHEN label < 'p' AND day(ts) BETWEEN 10 AND 12 OR day(ts) = 1 AND label > 'p' OR ts >= (SELECT max(ts) - 1 FROM ev) AND label < 'p' THEN NULL ELSE v END AS v, n, s FROM ev)"
LI = "li AS (SELECT l_returnflag AS label, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY 1, 2)"
OD = "od AS (SELECT o_orderpriority AS label, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1, 2)"
SITES = "sites AS (SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(s_suppkey * 73 % 360 - 180 AS DOUBLE) AS lon FROM supplier)"
GRID = "grid AS (SELECT CAST(vec_id AS BIGINT) AS raster_id, (k - 1) // 8 AS j, (k - 1) % 8 AS i, CAST(embedding[k] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias(LABEL), F.col("ts").cast("date").alias(TIME)).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("s"))


def evg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ev(spark, sf_dir)
    # The last day of the table, from the column alone.
    last = table(spark, sf_dir, "events").agg(F.date_sub(F.max(F.col("ts").cast("date")), 1).alias("last"))
    day = F.dayofmonth(TIME)
    blank = ((F.col(LABEL) < "p") & day.between(10, 12)) | ((day == 1) & (F.col(LABEL) > "p")) | ((F.col(TIME) >= F.col("last")) & (F.col(LABEL) < "p"))
    # One row: the last day.
    return df.join(F.broadcast(last)).withColumn("v", F.when(~blank, F.col("v"))).drop("last")


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias(LABEL), F.col("l_shipdate").cast("date").alias(TIME)).agg((F.sum("l_extendedprice") / 1000).alias("v"))


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.groupBy(F.col("o_orderpriority").alias(LABEL), F.col("o_orderdate").cast("date").alias(TIME)).agg((F.avg("o_totalprice") / 1000).alias("v"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 73 % 360 - 180).cast("double").alias("lon"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(table(spark, sf_dir, "embeddings"))


def cells(embeddings: DataFrame) -> DataFrame:
    p = embeddings.select(F.col("vec_id").alias("raster_id"), F.posexplode("embedding").alias("p", "value"))
    return p.select("raster_id", F.floor(F.col("p") / 8).alias("j"), (F.col("p") % 8).cast("long").alias("i"), F.col("value").cast("double").alias("value"))


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular days, gaps filled, centred 7-day median, residual, skewness and scaled MAD."""
    df = series.interpolate_clamped(series.resample(evg(spark, sf_dir).select(LABEL, TIME, "v")), ["v"])
    df = windows.rolling_median(df, "v", 7)
    df = stats.mad_scale(df.withColumn("residual", F.col("v") - F.col("median")), "residual")
    skew = stats.trimmed_skew(df, "residual").select(LABEL, "skew")
    return df.join(skew, LABEL).select(LABEL, TIME, r("v").alias("v"), r("median").alias("median"), r("residual").alias("residual"), r("MAD_Scale_residual", 3).alias("scaled"), r("skew").alias("skew"))


FILLED = """f0 AS (SELECT label, ts, v, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS pos FROM {src}),
 f1 AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
   first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM f0
   WINDOW b AS (PARTITION BY label ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY label ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 filled AS (SELECT label, ts, pos, coalesce(v, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0{clamp}) AS v FROM f1)"""
REGULAR = "reg AS (SELECT g.label, g.ts, e.v FROM (SELECT label, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM {src} GROUP BY label) g LEFT JOIN {src} e USING (label, ts))"

query(
    f"WITH {EVG}, {REGULAR.format(src='evg')}, {FILLED.format(src='reg', clamp=', v1')}, m AS (SELECT label, ts, v, median(v) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med FROM filled),"
    " q AS (SELECT *, v - med AS res FROM m), d AS (SELECT label, mad(res) / 0.6744897501960817 AS md FROM q GROUP BY label),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY res, ts) AS rn, count(*) OVER (PARTITION BY label) AS c FROM q WHERE res IS NOT NULL),"
    " t AS (SELECT label, res, avg(res) OVER (PARTITION BY label) AS mu FROM k WHERE rn > round_even(0.02 * c, 0) AND rn <= c - round_even(0.02 * c, 0)),"
    " sk AS (SELECT label, avg(pow(res - mu, 3)) / pow(avg(pow(res - mu, 2)), 1.5) AS skew FROM t GROUP BY label)"
    " SELECT label, ts, round(v, 4) AS v, round(med, 4) AS median, round(res, 4) AS residual, round(res / nullif(md, 0), 3) AS scaled, round(skew, 4) AS skew FROM q JOIN d USING (label) JOIN sk USING (label)"
)(flagship)


# --- filters --------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT label, ts, round(v, 4) AS v FROM ev WHERE label NOT IN ('click', 'view')")
def label_filter(spark, sf_dir):
    return filters.keep_labels(ev(spark, sf_dir), ["click", "view"]).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EV} SELECT label, ts, round(v, 4) AS v FROM ev WHERE label IN ('click', 'view')")
def label_filter_invert(spark, sf_dir):
    return filters.keep_labels(ev(spark, sf_dir), ["click", "view"], invert=True).select(LABEL, TIME, r("v").alias("v"))


HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def vincenty_sql(pairs: str) -> str:
    """Recursive tables up to ``geodesic`` (k, km) of the WGS84 distances of ``pairs`` (k, lat, lon, lat2, lon2)."""
    flat, major = 1 / 298.257223563, 6378137.0
    minor = major * (1 - flat)
    round_ = (
        "SELECT k, u1, u2, l, lam, it, ss, cs, sg, sa, ca, CASE WHEN ca = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / ca END AS cm FROM (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa"
        " FROM (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM {src})))"
    )
    return (
        f"geo0 AS (SELECT k, atan((1 - {flat}) * tan(radians(lat))) AS u1, atan((1 - {flat}) * tan(radians(lat2))) AS u2, radians(lon2 - lon) AS l FROM {pairs}),"
        f" geo AS (SELECT k, u1, u2, l, l AS lam, l + 1 AS was, 0 AS it FROM geo0 UNION ALL SELECT k, u1, u2, l, l + (1 - c) * {flat} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))), lam, it + 1 FROM (SELECT *, {flat} / 16 * ca * (4 + {flat} * (4 - 3 * ca)) AS c FROM ({round_.format(src='(SELECT * FROM geo WHERE it < 200 AND abs(lam - was) >= 1e-12)')}))),"
        f" geoend AS (SELECT k, u1, u2, l, lam, it FROM geo WHERE abs(lam - was) < 1e-12),"
        f" geodesic AS (SELECT k, round({minor} * aa * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000, 3) AS km FROM (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS aa, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM (SELECT *, ca * {(major**2 - minor**2) / minor**2} AS q FROM ({round_.format(src='geoend')}))))"
    )


@query(f"WITH RECURSIVE {SITES}, pairs AS (SELECT k, lat, lon, 10.0 AS lat2, 20.0 AS lon2 FROM sites), {vincenty_sql('pairs')} SELECT k AS label FROM geodesic WHERE km <= 6000")
def geo_radius(spark, sf_dir):
    meta = sites(spark, sf_dir).withColumnRenamed("k", LABEL)
    return filters.within_radius(meta.select(LABEL), meta, 10.0, 20.0, 6000.0)


@query(f"WITH RECURSIVE {SITES}, pairs AS (SELECT a.k, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM sites a JOIN sites b ON b.k = a.k + 1), {vincenty_sql('pairs')} SELECT pairs.k, km FROM pairs LEFT JOIN geodesic USING (k)")
def vincenty_pairs(spark, sf_dir):
    a = sites(spark, sf_dir)
    b = a.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "k").select("k", r(geodesy.vincenty_km("lat", "lon", "lat2", "lon2"), 3).alias("km"))


@query(f"WITH {EV} SELECT label, ts, CASE WHEN label IN ('click') AND day(ts) BETWEEN 5 AND 9 THEN NULL ELSE round(v, 4) END AS v FROM (SELECT * FROM ev)")
def data_remover(spark, sf_dir):
    df = ev(spark, sf_dir)
    month = df.where(F.dayofmonth(TIME).between(5, 9)).groupBy(F.trunc(TIME, "month").alias("m")).agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"))
    return filters.blank_days(df, ["v"], month, ["click"]).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EVG} SELECT label, ts, CASE WHEN v IS NULL THEN NULL ELSE n END AS n FROM evg")
def propagate_nulls(spark, sf_dir):
    return filters.propagate_nulls(evg(spark, sf_dir), "v", ["n"]).select(LABEL, TIME, "n")


@query(f"WITH {EVG} SELECT label, ts, round(coalesce(v, s), 4) AS both_cols FROM evg")
def combine_columns(spark, sf_dir):
    return filters.combine_columns(evg(spark, sf_dir), "v", "s", "both_cols").select(LABEL, TIME, r("both_cols").alias("both_cols"))


@query("WITH s AS (SELECT o_custkey % 50 AS label, o_totalprice AS dn, CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 2 END AS snow FROM orders), g AS (SELECT label FROM s GROUP BY label HAVING stddev_pop(dn) FILTER (snow = 4) > 1.02 * stddev_pop(dn) FILTER (snow = 2)) SELECT label, count(*) AS n FROM s WHERE label NOT IN (SELECT label FROM g) GROUP BY label")
def snow_remover(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias(LABEL), F.col("o_totalprice").alias("dN"), F.when(F.col("o_orderstatus") == "O", 4).otherwise(2).alias("Snow"))
    return filters.drop_noisy_snow(o, 1.02).groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(DATE '1970-01-01' + CAST(CASE WHEN epoch_us(ts) % 86400000000 = 43200000000 THEN (epoch_us(ts) // 86400000000) + (epoch_us(ts) // 86400000000) % 2 ELSE (epoch_us(ts) + 43200000000) // 86400000000 END AS INTEGER) AS DATE) AS day FROM events")
def round_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", filters.round_to_day(F.col("ts")).alias("day"))


@query(f"WITH {GRID} SELECT raster_id, j, i, round(value, 5) AS value FROM grid WHERE j BETWEEN 2 AND 4 AND i BETWEEN 1 AND 5")
def trim_map(spark, sf_dir):
    return filters.trim_map(grid(spark, sf_dir), 1.0, 88.0, 85.0, 1.0, 6.0).select("raster_id", "j", "i", r("value", 5).alias("value"))


# --- resampling, filling, rolling -----------------------------------------------------------


@query(f"WITH {OD}, {REGULAR.format(src='od')} SELECT label, ts, round(v, 8) AS v FROM reg")
def resample_daily(spark, sf_dir):
    return series.resample(od(spark, sf_dir)).select(LABEL, TIME, r("v", 8).alias("v"))


@query(f"WITH {EVG}, {FILLED.format(src='evg', clamp=', v1')} SELECT label, ts, round(v, 4) AS v FROM filled")
def interpolate_clamped(spark, sf_dir):
    return series.interpolate_clamped(evg(spark, sf_dir), ["v"]).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EVG}, {FILLED.format(src='evg', clamp='')} SELECT label, ts, round(v, 4) AS v FROM filled")
def interpolate_forward(spark, sf_dir):
    return series.interpolate_forward(evg(spark, sf_dir), ["v"]).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {LI} SELECT label, ts, round(median(v) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 8) AS v FROM li")
def rolling_median(spark, sf_dir):
    return windows.median_filter(li(spark, sf_dir), "v", 15, interpolate=False).select(LABEL, TIME, r("v", 8).alias("v"))


@query(f"WITH {LI} SELECT label, ts, round(v - median(v) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 8) AS v FROM li")
def rolling_median_residual(spark, sf_dir):
    return windows.median_filter(li(spark, sf_dir), "v", 30, interpolate=False, subtract=True).select(LABEL, TIME, r("v", 8).alias("v"))


@query(f"WITH {OD} SELECT label, ts, round(median(v) OVER (PARTITION BY label ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING), 8) AS v FROM od")
def range_median(spark, sf_dir):
    return windows.median_filter(od(spark, sf_dir), "v", 7, interpolate=False, regular=False).select(LABEL, TIME, r("v", 8).alias("v"))


@query(
    f"WITH {EV}, x AS (SELECT label, ts, v, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY label) AS c FROM ev),"
    " o AS (SELECT unnest(range(-2, 3)) AS o), y AS (SELECT x.label, x.ts, CASE WHEN x.pos + o < 0 THEN -1 - x.pos - o WHEN x.pos + o >= c THEN 2 * c - 1 - x.pos - o ELSE x.pos + o END AS p FROM x, o)"
    " SELECT y.label, y.ts, round(median(x.v), 4) AS v FROM y JOIN x ON x.label = y.label AND x.pos = y.p GROUP BY y.label, y.ts"
)
def reflected_median(spark, sf_dir):
    return windows.reflected_median(ev(spark, sf_dir), "v", 5).select(LABEL, TIME, r("median").alias("v"))


@query(f"WITH {EV} SELECT label, ts, round(sum(v / (s * s)) OVER w / sum(1 / (s * s)) OVER w, 4) AS v, round(1 / sqrt(sum(1 / (s * s)) OVER w), 4) AS s FROM ev WINDOW w AS (PARTITION BY label ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def weighted_average(spark, sf_dir):
    return windows.weighted_average(ev(spark, sf_dir), "v", 7, "s").select(LABEL, TIME, r("v").alias("v"), r("s").alias("s"))


@query(f"WITH {LI}, x AS (SELECT label, CASE WHEN count(v) OVER w = 10 THEN stddev_samp(v) OVER w END AS sd FROM li WINDOW w AS (PARTITION BY label ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT label, count(*) FILTER (sd > 100) AS n_over FROM x GROUP BY label")
def rolling_std_gate(spark, sf_dir):
    return windows.rolling_std_over(li(spark, sf_dir), "v", 10, 100.0)


@query("WITH x AS (SELECT user_id AS label, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400000000 THEN 1 ELSE 0 END AS g FROM events) SELECT label, event_id, CAST(sum(g) OVER (PARTITION BY label ORDER BY ts) AS BIGINT) AS segment FROM x")
def gap_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias(LABEL), "ts", "event_id")
    return windows.gap_segments(e, 86400.0).select(LABEL, "event_id", F.col("segment").cast("long").alias("segment"))


@query(f"WITH {EV}, x AS (SELECT label, ts, v, v - lag(v) OVER (PARTITION BY label ORDER BY ts) AS d FROM ev), j AS (SELECT *, CASE WHEN abs(d) > 2 THEN d ELSE 0 END AS k FROM x) SELECT label, ts, round(v + coalesce(sum(k) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 4) AS v FROM j")
def step_offsets_removed(spark, sf_dir):
    return windows.remove_jumps(ev(spark, sf_dir), "v", 2.0, 2 * 86400.0).select(LABEL, TIME, r("v").alias("v"))


# --- trends ---------------------------------------------------------------------------------

POS = "x AS (SELECT label, ts, v, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS pos FROM {src})"
SEASON = """SELECT label, sum(w) n, sum(w*c) c, sum(w*s) s, sum(w*c*c) cc, sum(w*s*s) ss, sum(w*c*s) cs, sum(v) y, sum(c*v) cy, sum(s*v) sy FROM (SELECT label, v, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS w, cos(pos*2*pi()/{p}) AS c, sin(pos*2*pi()/{p}) AS s FROM {src}) GROUP BY label"""


def _season(src: str, p: float, n: int) -> str:
    return (
        f"m{n} AS ({SEASON.format(src=src, p=p)}), k{n} AS (SELECT *, cc-c*c/n AS xcc, ss-s*s/n AS xss, cs-c*s/n AS xcs, cy-c*y/n AS xcy, sy-s*y/n AS xsy FROM m{n}),"
        f" h{n} AS (SELECT label, (xcy*xss-xsy*xcs)/(xcc*xss-xcs*xcs) AS a, (xsy*xcc-xcy*xcs)/(xcc*xss-xcs*xcs) AS b, n, c, s, y FROM k{n}),"
        f" z{n} AS (SELECT label, a, b, (y-a*c-b*s)/n AS k FROM h{n})"
    )


@query(f"WITH {LI}, {POS.format(src='li')}, f AS (SELECT label, regr_slope(v, pos) AS a, regr_intercept(v, pos) AS b FROM x GROUP BY label) SELECT label, ts, round(v - b - a * pos, 3) AS v FROM x JOIN f USING (label)")
def linear_detrend(spark, sf_dir):
    return series.detrend(li(spark, sf_dir), "v").select(LABEL, TIME, r("v", 3).alias("v"))


@query(f"WITH {LI}, {POS.format(src='li')} SELECT label, round(regr_slope(v, pos), 6) AS slope, round(regr_intercept(v, pos), 4) AS intercept FROM x GROUP BY label")
def line_fit(spark, sf_dir):
    return series.line_fit(li(spark, sf_dir), "v").select(LABEL, r("slope", 6).alias("slope"), r("intercept").alias("intercept"))


@query(f"WITH {LI}, {POS.format(src='li')}, {_season('x', 365.0, 1)} SELECT label, ts, round(v - (a*cos(pos*2*pi()/365.0) + b*sin(pos*2*pi()/365.0) + k), 3) AS v FROM x JOIN z1 USING (label)")
def annual_fit_removed(spark, sf_dir):
    return series.trend_filter(li(spark, sf_dir), "v", ["annual"]).select(LABEL, TIME, r("v", 3).alias("v"))


@query(f"WITH {LI}, {POS.format(src='li')}, {_season('x', 365.0, 1)}, {_season('x', 182.5, 2)} SELECT x.label, ts, round(v - (z1.a*cos(pos*2*pi()/365.0) + z1.b*sin(pos*2*pi()/365.0) + z1.k) - (z2.a*cos(pos*2*pi()/182.5) + z2.b*sin(pos*2*pi()/182.5) + z2.k), 3) AS v FROM x JOIN z1 USING (label) JOIN z2 USING (label)")
def semiannual_fit_removed(spark, sf_dir):
    return series.trend_filter(li(spark, sf_dir), "v", ["semiannual"]).select(LABEL, TIME, r("v", 3).alias("v"))


@query(f"WITH {LI}, {POS.format(src='li').replace('x AS', 'x0 AS')}, lf AS (SELECT label, regr_slope(v, pos) AS a, regr_intercept(v, pos) AS b FROM x0 GROUP BY label), x AS (SELECT label, ts, pos, v - b - a * pos AS v FROM x0 JOIN lf USING (label)), {_season('x', 365.0, 1)} SELECT label, ts, round(v - (a*cos(pos*2*pi()/365.0) + b*sin(pos*2*pi()/365.0) + k), 3) AS v FROM x JOIN z1 USING (label)")
def trend_filter(spark, sf_dir):
    return series.trend_filter(li(spark, sf_dir), "v", ["linear", "annual"]).select(LABEL, TIME, r("v", 3).alias("v"))


@query(
    f"WITH {LI}, {POS.format(src='li')}, c AS (SELECT *, sum(v) OVER (PARTITION BY label ORDER BY pos) AS s, sum(v) OVER (PARTITION BY label) AS t, count(*) OVER (PARTITION BY label) AS n, pos + 1 AS k FROM x),"
    " b AS (SELECT label, arg_max(pos, s * s / k + (t - s) * (t - s) / (n - k)) AS cut FROM c WHERE k < n GROUP BY label),"
    " m AS (SELECT label, cut, median(v) FILTER (pos BETWEEN cut - 4 AND cut - 1) - median(v) FILTER (pos BETWEEN cut + 1 AND cut + 5) AS lev FROM x JOIN b USING (label) GROUP BY label, cut),"
    " y AS (SELECT label, ts, pos, v + CASE WHEN pos > cut THEN coalesce(lev, 0) ELSE 0 END AS v FROM x JOIN m USING (label)), f AS (SELECT label, regr_slope(v, pos) AS a, regr_intercept(v, pos) AS b FROM y GROUP BY label)"
    " SELECT label, ts, round(v - b - a * pos, 3) AS v FROM y JOIN f USING (label)"
)
def offset_detrend(spark, sf_dir):
    return series.step_detrend(li(spark, sf_dir), "v").select(LABEL, TIME, r("v", 3).alias("v"))


@query()
def offset_detrend_deep(spark, sf_dir):
    return kernels.steps_detrend(li(spark, sf_dir), "v", 3)


@query(
    f"WITH {EV}, e AS (SELECT label, ts AS event FROM ev WHERE day(ts) = 15), s AS (SELECT label, event, ts >= event AS after, v, row_number() OVER (PARTITION BY label, event, ts >= event ORDER BY abs(ts - event)) AS r FROM ev JOIN e USING (label)),"
    " d AS (SELECT label, event, median(v) FILTER (after) - median(v) FILTER (NOT after) AS step FROM s WHERE r <= 5 GROUP BY 1, 2)"
    " SELECT label, ts, round(v - coalesce((SELECT sum(step) FROM d WHERE d.label = ev.label AND ev.ts >= d.event AND abs(step) > 0.1), 0), 4) AS v FROM ev"
)
def antenna_offsets(spark, sf_dir):
    events = ev(spark, sf_dir).where(F.dayofmonth(TIME) == 15).select(LABEL, TIME)
    return series.antenna_offsets(ev(spark, sf_dir), "v", events, 0.1, 5).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {LI}, {POS.format(src='li')} SELECT label, ts, round(v, 8) AS v FROM x WHERE pos % 100 = 0")
def decimate(spark, sf_dir):
    return series.decimate(li(spark, sf_dir), 100).select(LABEL, TIME, r("v", 8).alias("v"))


@query(f"WITH {EV} SELECT label, ts, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 10, 4) AS v FROM ev WINDOW w AS (PARTITION BY label)")
def rescale(spark, sf_dir):
    return series.rescale(ev(spark, sf_dir), "v", 10.0).select(LABEL, TIME, r("v").alias("v"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def unix_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", series.unix_seconds(F.col("ts")).alias("seconds"))


@query(f"WITH {EV}, d AS (SELECT label, ts, CAST(ts - min(ts) OVER (PARTITION BY label) AS DOUBLE) AS rr FROM ev) SELECT label, ts, round(rr, 4) AS radius, round(2 * pi() * rr / 7.0, 4) AS theta FROM d")
def spiral(spark, sf_dir):
    return series.spiral(ev(spark, sf_dir), 7.0).select(LABEL, TIME, r("radius").alias("radius"), r("theta").alias("theta"))


@query(f"WITH {EV}, {POS.format(src='ev')}, p AS (SELECT label, CAST(pos // 2 AS BIGINT) AS k, max(CASE WHEN pos % 2 = 0 THEN v END) AS a, max(CASE WHEN pos % 2 = 1 THEN v END) AS b FROM x GROUP BY 1, 2) SELECT label, k, round((a + coalesce(b, a)) / sqrt(2), 4) AS approx, round((a - coalesce(b, a)) / sqrt(2), 4) AS detail FROM p")
def haar_step(spark, sf_dir):
    return series.haar(ev(spark, sf_dir), "v").select(LABEL, "k", r("approx").alias("approx"), r("detail").alias("detail"))


# --- statistics -----------------------------------------------------------------------------

PAIRS = "p AS (SELECT a.label AS k1, b.label AS k2, a.v AS x, b.v AS y FROM {src} a JOIN {src} b USING (ts) WHERE a.label <= b.label AND a.v IS NOT NULL AND b.v IS NOT NULL)"


@query(f"WITH {EVG}, {PAIRS.format(src='evg')} SELECT k1 || '.v' AS k1, k2 || '.v' AS k2, count(*) AS n, round(corr(x, y), 6) AS r FROM p GROUP BY 1, 2")
def correlate_all_pairs(spark, sf_dir):
    return stats.correlate(evg(spark, sf_dir), ["v"]).select("k1", "k2", "n", r("r", 6).alias("r"))


@query(f"WITH {EVG}, {PAIRS.format(src='evg')}, q AS (SELECT k1, k2, rank() OVER (PARTITION BY k1, k2 ORDER BY x) + (count(*) OVER (PARTITION BY k1, k2, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k1, k2 ORDER BY y) + (count(*) OVER (PARTITION BY k1, k2, y) - 1) / 2.0 AS ry FROM p) SELECT k1 || '.v' AS k1, k2 || '.v' AS k2, count(*) AS n, round(corr(rx, ry), 6) AS r FROM q GROUP BY 1, 2")
def correlate_spearman(spark, sf_dir):
    return stats.correlate(evg(spark, sf_dir), ["v"], "spearman").select("k1", "k2", "n", r("r", 6).alias("r"))


@query(
    f"WITH {EVG}, {PAIRS.format(src='evg')}, q AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY x, y) AS i FROM p), n AS (SELECT k1, k2, count(*) AS n FROM p GROUP BY 1, 2),"
    " t AS (SELECT a.k1, a.k2, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s, count(*) FILTER (a.x != b.x) AS nx, count(*) FILTER (a.y != b.y) AS ny FROM q a JOIN q b ON a.k1 = b.k1 AND a.k2 = b.k2 AND a.i < b.i GROUP BY 1, 2)"
    " SELECT k1 || '.v' AS k1, k2 || '.v' AS k2, n, round(s / sqrt(CAST(nx AS DOUBLE) * ny), 6) AS r FROM n LEFT JOIN t USING (k1, k2)"
)
def correlate_kendall(spark, sf_dir):
    return stats.correlate(evg(spark, sf_dir), ["v"], "kendall").select("k1", "k2", "n", r("r", 6).alias("r"))


@query(f"WITH {EV} SELECT label, 's' AS k1, 'v' AS k2, count(*) AS n, round(corr(v, s), 6) AS r FROM ev WHERE v IS NOT NULL AND s IS NOT NULL GROUP BY label")
def correlate_local(spark, sf_dir):
    return stats.correlate_columns(ev(spark, sf_dir), ["s", "v"]).where("k1 < k2").select(LABEL, "k1", "k2", "n", r("r", 6).alias("r"))


@query(
    f"WITH {LI}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v, ts) AS rn, count(*) OVER (PARTITION BY label) AS c FROM li), t AS (SELECT label, v, avg(v) OVER (PARTITION BY label) AS mu FROM k WHERE rn > round_even(0.02 * c, 0) AND rn <= c - round_even(0.02 * c, 0))"
    " SELECT label, count(*) AS n, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 5) AS skew FROM t GROUP BY label"
)
def trimmed_skew(spark, sf_dir):
    return stats.trimmed_skew(li(spark, sf_dir), "v").select(LABEL, "n", r("skew", 5).alias("skew"))


@query(f"WITH {LI}, d AS (SELECT label, mad(v) / 0.6744897501960817 AS m FROM li GROUP BY label) SELECT label, ts, round(v / m, 4) AS scaled FROM li JOIN d USING (label)")
def mad_scale(spark, sf_dir):
    return stats.mad_scale(li(spark, sf_dir), "v").select(LABEL, TIME, r("MAD_Scale_v").alias("scaled"))


@query(
    f"WITH {LI}, d AS (SELECT a.label, b.v - a.v AS d FROM li a JOIN li b ON a.label = b.label AND b.ts = a.ts + 365), m AS (SELECT label, median(d) AS md, mad(d) / 0.6744897501960817 AS s FROM d GROUP BY label),"
    " k AS (SELECT label, d FROM d JOIN m USING (label) WHERE d > md - 2 * s AND d < md + 2 * s) SELECT label, count(*) AS n, round(median(d), 4) AS velocity, round(sqrt(pi() / 2) * mad(d) / 0.6744897501960817 / sqrt(count(*)), 4) AS uncertainty FROM k GROUP BY label"
)
def midas_velocity(spark, sf_dir):
    return stats.midas(li(spark, sf_dir), "v").select(LABEL, "n", r("velocity").alias("velocity"), r("uncertainty").alias("uncertainty"))


@query(f"WITH {EV} SELECT label, ts, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 4) AS v FROM ev WINDOW w AS (PARTITION BY label)")
def zscore(spark, sf_dir):
    return stats.zscore(ev(spark, sf_dir), "v").select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {LI} SELECT label, ts, round(v / median(v) OVER (PARTITION BY label, year(ts)), 4) AS v FROM li")
def grouped_median_normalize(spark, sf_dir):
    return stats.group_median_normalize(li(spark, sf_dir).withColumn("q", F.year(TIME)), "v", "q").select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EV} SELECT label, ts, round(v - avg(v) OVER (PARTITION BY ts), 4) AS v FROM ev")
def common_mode_removed(spark, sf_dir):
    return stats.remove_common_mode(ev(spark, sf_dir), ["v"]).select(LABEL, TIME, r("v").alias("v"))


@query(f"WITH {EV}, m AS (SELECT label, 1.05 * median(s) AS lim FROM ev GROUP BY label) SELECT label, ts, CASE WHEN s > lim THEN NULL ELSE round(v, 4) END AS v, CASE WHEN s > lim THEN NULL ELSE round(s, 4) END AS s FROM ev JOIN m USING (label)")
def uncertainty_clip(spark, sf_dir):
    return stats.clip_uncertain(ev(spark, sf_dir), "v", "s", 1.05).select(LABEL, TIME, r("v").alias("v"), r("s").alias("s"))


@query(f"WITH {EV} SELECT label, ts, round((v + n + s) / 3 * (1.0 + length(label) / 10.0), 4) AS \"EWD\", round(length(label) / 100.0, 4) AS \"EWD_Error\" FROM ev")
def calibrate_mass(spark, sf_dir):
    df = ev(spark, sf_dir)
    meta = df.select(LABEL).distinct().withColumns({"scale_factor": 1.0 + F.length(LABEL) / 10.0, "measurement_error": F.length(LABEL) / 100.0})
    return stats.calibrate_mass(df, meta, ["v", "n", "s"]).select(LABEL, TIME, r("EWD").alias("EWD"), r("EWD_Error").alias("EWD_Error"))


@query(f"WITH {GRID}, m AS (SELECT raster_id, median(value) AS md, mad(value) / 0.6744897501960817 AS s FROM grid GROUP BY 1) SELECT raster_id, j, i, CAST(round_even((least(greatest(value, md - s), md + s) - (md - s)) / (2 * s) * 255, 0) AS SMALLINT) AS scaled FROM grid JOIN m USING (raster_id)")
def scale_image(spark, sf_dir):
    return stats.scale_image(grid(spark, sf_dir), "raster_id").select("raster_id", "j", "i", "scaled")


@query(f"WITH {EV}, a AS (SELECT label, ts, v, n, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS h FROM ev), c AS (SELECT label, v, sum(1 - h) OVER (PARTITION BY label ORDER BY v) / sum(1 - h) OVER (PARTITION BY label) AS f1, sum(h) OVER (PARTITION BY label ORDER BY v) / sum(h) OVER (PARTITION BY label) AS f2 FROM a) SELECT label, round(max(abs(f1 - f2)), 5) AS statistic FROM c GROUP BY label")
def ks_two_sample(spark, sf_dir):
    df = ev(spark, sf_dir).withColumn("h", F.when(F.dayofmonth(TIME) <= 15, 0).otherwise(1))
    return stats.two_sample_ks(df, "v", "h").select(LABEL, r("statistic", 5).alias("statistic"))


@query(
    f"WITH {EV}, a AS (SELECT label, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS h, row_number() OVER (PARTITION BY label ORDER BY v) AS i, count(*) OVER (PARTITION BY label) AS n, sum(CASE WHEN day(ts) <= 15 THEN 1.0 ELSE 0 END) OVER (PARTITION BY label) AS m, sum(CASE WHEN day(ts) <= 15 THEN 1.0 ELSE 0 END) OVER (PARTITION BY label ORDER BY v ROWS UNBOUNDED PRECEDING) AS mi FROM ev)"
    " SELECT label, round(sum(CASE WHEN i < n THEN pow(mi * n - i * m, 2) / (i * (n - i)) END) / (any_value(m) * (any_value(n) - any_value(m))), 5) AS statistic FROM a GROUP BY label"
)
def anderson_two_sample(spark, sf_dir):
    df = ev(spark, sf_dir).withColumn("h", F.when(F.dayofmonth(TIME) <= 15, 0).otherwise(1))
    return stats.anderson_two_sample(df, "v", "h").select(LABEL, r("statistic", 5).alias("statistic"))


@query("WITH x AS (SELECT CAST(p_size AS INTEGER) % 10 AS target, p_partkey % 20 AS j, p_partkey % 7 AS i, CAST(p_partkey % 3 AS DOUBLE) AS time FROM part) SELECT j, i, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM x WHERE time = 0 GROUP BY j, i")
def targets_at_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("target"), (F.col("p_partkey") % 20).alias("j"), (F.col("p_partkey") % 7).alias("i"), (F.col("p_partkey") % 3).cast("double").alias("time"))
    return stats.targets_at_cells(p).withColumn("targets", F.array_join("targets", ","))


# --- joins ----------------------------------------------------------------------------------


@query(f"WITH {EV}, b AS (SELECT label, date_trunc('month', ts)::DATE + 14 AS ts, avg(v) AS g FROM ev GROUP BY 1, 2) SELECT ev.label, ev.ts, round(CASE WHEN abs(ev.ts - b.ts) < 10 THEN b.g END, 4) AS g FROM ev LEFT JOIN b ON ev.label = b.label AND strftime(ev.ts, '%Y-%m') = strftime(b.ts, '%Y-%m')")
def month_match_tolerance(spark, sf_dir):
    a = ev(spark, sf_dir)
    b = a.groupBy(LABEL, F.date_add(F.trunc(TIME, "month"), 14).alias(TIME)).agg(F.avg("v").alias("g"))
    return joins.month_match(a, b, "v", "g").select(LABEL, TIME, r("g").alias("g"))


@query(f"WITH {EV}, {OD}, b AS (SELECT label, ts, v AS q FROM ev WHERE day(ts) % 4 = 0) SELECT a.label, a.ts, round(b.q, 4) AS q FROM ev a ASOF LEFT JOIN b ON a.label = b.label AND a.ts >= b.ts")
def nearest_asof(spark, sf_dir):
    a = ev(spark, sf_dir)
    b = a.where(F.dayofmonth(TIME) % 4 == 0).select(LABEL, TIME, F.col("v").alias("q"))
    return joins.nearest_before(a, b, "q").select(LABEL, TIME, r("q").alias("q"))


@query("SELECT c_custkey AS label, n_name AS name, round(c_acctbal, 2) AS v FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def label_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias(LABEL), "c_acctbal")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(LABEL), F.col("n_name").alias("name"))
    return joins.with_metadata(c, n).select(F.col("cust").alias(LABEL), "name", r("c_acctbal", 2).alias("v"))


def _squares(spark: SparkSession) -> DataFrame:
    """Twelve squares and a diamond with a hole, over part size and price in hundreds."""
    rows = [(k, [(5.0 * (k % 4), 9.0 + 3 * (k // 4)), (5.0 * (k % 4) + 4, 9.0 + 3 * (k // 4)), (5.0 * (k % 4) + 4, 11.5 + 3 * (k // 4)), (5.0 * (k % 4), 11.5 + 3 * (k // 4))], []) for k in range(12)]
    rows.append((12, [(30.0, 10.0), (40.0, 14.0), (30.0, 18.0), (22.0, 14.0)], [[(28.0, 13.0), (32.0, 13.0), (32.0, 15.0), (28.0, 15.0)]]))
    df = spark.createDataFrame(rows, "id int, shell array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    return polygons.bounding_box(df.withColumn("code", F.col("id")))


def _in_diamond(x: str, y: str) -> str:
    ring, hole = [(30.0, 10.0), (40.0, 14.0), (30.0, 18.0), (22.0, 14.0)], [(28.0, 13.0), (32.0, 13.0), (32.0, 15.0), (28.0, 15.0)]

    def odd(pts):
        edges = [f"CASE WHEN ({a[1]} > {y}) != ({b[1]} > {y}) AND {x} < {a[0]} + ({y} - {a[1]}) * ({b[0]} - {a[0]}) / nullif({b[1]} - {a[1]}, 0) THEN 1 ELSE 0 END" for a, b in zip(pts, pts[1:] + pts[:1])]
        return "(" + " + ".join(edges) + ") % 2 = 1"

    return f"({odd(ring)} AND NOT {odd(hole)})"


@query(
    "WITH p AS (SELECT p_partkey AS k, p_size + 0.25 AS x, p_retailprice / 100 AS y FROM part), s AS (SELECT unnest(range(12)) AS id), q AS (SELECT k, id FROM p JOIN s ON x >= 5 * (id % 4) AND x < 5 * (id % 4) + 4 AND y >= 9 + 3 * (id // 4) AND y < 11.5 + 3 * (id // 4)"
    f" UNION ALL SELECT k, 12 FROM p WHERE {_in_diamond('x', 'y')}) SELECT p.k, CAST(coalesce(min(q.id), -1) AS INTEGER) AS polygon FROM p LEFT JOIN q USING (k) GROUP BY p.k"
)
def point_in_polygon(spark, sf_dir):
    pts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 0.25).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return joins.points_in_polygons(pts, _squares(spark), 5.0).select("k", "polygon")


def _edges_sql() -> str:
    """Values (id, x1, y1, x2, y2) of all edges of the squares and the diamond."""
    rings = [(k, [(5.0 * (k % 4) + dx, 9.0 + 3 * (k // 4) + dy) for dx, dy in ((0, 0), (4, 0), (4, 2.5), (0, 2.5))]) for k in range(12)]
    rings += [(12, [(30.0, 10.0), (40.0, 14.0), (30.0, 18.0), (22.0, 14.0)]), (12, [(28.0, 13.0), (32.0, 13.0), (32.0, 15.0), (28.0, 15.0)])]
    return "e(id, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"


@query(
    f"WITH {_edges_sql()}, p AS (SELECT p_partkey AS k, p_size + 0.25 AS x, p_retailprice / 100 AS y FROM part),"
    " q AS (SELECT k, id, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM p CROSS JOIN e),"
    " d AS (SELECT k, id, min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) AS d, sum(CASE WHEN (y1 > y) != (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM q GROUP BY 1, 2)"
    " SELECT k, CAST(arg_min(id, {'d': d, 'id': id}) AS INTEGER) AS polygon, round(min(d), 4) AS distance FROM d WHERE NOT inside GROUP BY k"
)
def nearest_polygon(spark, sf_dir):
    pts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 0.25).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return joins.nearest_polygon(pts, _squares(spark), 5.0).select("k", "polygon", r("distance").alias("distance"))


@query("WITH v AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier) SELECT DISTINCT a.id AS a, b.id AS b FROM v a JOIN v b USING (v)")
def shared_vertices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_nationkey", ((F.col("s_nationkey") + 1) % 25).cast("int")).alias("vertices"))
    return joins.shared_vertices(s)


# --- functions ------------------------------------------------------------------------------


@query(f"WITH {SITES} SELECT k, round(1e-3 * x / pow(x*x + y*y + 25, 1.5) * 1e6, 4) AS ux, round(1e-3 * y / pow(x*x + y*y + 25, 1.5) * 1e6, 4) AS uy, round(1e-3 * 5 / pow(x*x + y*y + 25, 1.5) * 1e6, 4) AS uz FROM (SELECT k, lon / 10 AS x, lat / 10 AS y FROM sites)")
def mogi_forward(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("u", deformation.mogi(F.col("lon") / 10, F.col("lat") / 10, F.lit(5.0), F.lit(1e-3)))
    return s.select("k", *[r(F.col(f"u.{c}") * 1e6).alias(f"u{c}") for c in "xyz"])


@query(f"WITH {SITES} SELECT k, round(1e-1 * x * 25 / pow(x*x + y*y + 25, 2.5) * 1e6, 3) AS ux, round(1e-1 * y * 25 / pow(x*x + y*y + 25, 2.5) * 1e6, 3) AS uy, round(1e-1 * 125 / pow(x*x + y*y + 25, 2.5) * 1e6, 3) AS uz FROM (SELECT k, lon / 10 AS x, lat / 10 AS y FROM sites)")
def sill_forward(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("u", deformation.sill(F.col("lon") / 10, F.col("lat") / 10, F.lit(5.0), F.lit(1e-1)))
    return s.select("k", *[r(F.col(f"u.{c}") * 1e6, 3).alias(f"u{c}") for c in "xyz"])


@query(f"WITH {SITES}, q AS (SELECT k, lon / 10 AS x, lat / 10 AS y, 1.25 / (2 * -5.75) AS c1, 15 * -1.75 / (4 * -5.75) AS c2 FROM sites), g AS (SELECT k, x, y, x*x + y*y + 25 AS r2, c1, c2 FROM q) SELECT k, round(1e-2 * x / pow(r2, 1.5) * 8 * (1 + 0.064 * (c1 + c2 * 25 / r2)) * 1e6, 3) AS ux, round(1e-2 * y / pow(r2, 1.5) * 8 * (1 + 0.064 * (c1 + c2 * 25 / r2)) * 1e6, 3) AS uy, round(1e-2 * 5 / pow(r2, 1.5) * 8 * (1 + 0.064 * (c1 + c2 * 25 / r2)) * 1e6, 3) AS uz FROM g")
def finite_sphere_forward(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("u", deformation.finite_sphere(F.col("lon") / 10, F.col("lat") / 10, F.lit(5.0), F.lit(1e-2), F.lit(2.0)))
    return s.select("k", *[r(F.col(f"u.{c}") * 1e6, 3).alias(f"u{c}") for c in "xyz"])


# Depth 5, half length 2, amplitude 0.01, Poisson ratio 0.25.
_PIPE = "q AS (SELECT k, lon / 10 + 0.05 AS x, lat / 10 + 0.05 AS y FROM sites), g AS (SELECT k, x, y, x*x + y*y AS r2, sqrt(x*x + y*y + 9) AS r3, sqrt(x*x + y*y + 49) AS r7 FROM q)"
_LEVELS = {
    "closed": "(pow(3 / r3, 3) - 10.5 / r3 + (857.5 + 24.5 * r2) / pow(r7, 3)) / r2",
    "open": "(pow(7 / r7, 3) - 17.5 / r7 + (40.5 + 7.5 * r2) / pow(r3, 3)) / r2",
    "rising": "(-9 / pow(r3, 3) + 0.5 / r3 + (49 - 0.5 * (49 + r2)) / pow(r7, 3)) / 7",
}
_UPS = {
    "closed": "9 / pow(r3, 3) - 1.5 / r3 + (24.5 + 1.5 * r2) / pow(r7, 3)",
    "open": "49 / pow(r7, 3) - 0.5 / r7 + (-9 + 0.5 * r3 * r3) / pow(r3, 3)",
    "rising": "27 / pow(r3, 3) / 7 - (49 - 0.5 * (49 + r2)) / pow(r7, 3)",
}


@query(f"WITH {SITES}, {_PIPE} SELECT k, " + ", ".join(f"round(1e4 * x * ({_LEVELS[n]}), 3) AS {n}_x, round(1e4 * y * ({_LEVELS[n]}), 3) AS {n}_y, round(-1e4 * ({_UPS[n]}), 3) AS {n}_z" for n in _LEVELS) + " FROM g")
def pipes_forward(spark, sf_dir):
    x, y = F.col("lon") / 10 + 0.05, F.col("lat") / 10 + 0.05
    s = sites(spark, sf_dir)
    for name, model in (("closed", "closed_pipe"), ("open", "constant_open_pipe"), ("rising", "rising_open_pipe")):
        s = s.withColumn(name, deformation.MODELS[model][0](x, y, F.lit(5.0), F.lit(1e-2), F.lit(2.0)))
    return s.select("k", *[r(F.col(f"{n}.{c}") * 1e6, 3).alias(f"{n}_{c}") for n in ("closed", "open", "rising") for c in "xyz"])


@query("SELECT p_partkey, round(CASE WHEN p_size BETWEEN 20 AND 30 THEN 1 WHEN p_size > 10 AND p_size < 20 THEN 0.2 + 0.8 * (p_size - 10) / 10.0 WHEN p_size > 30 AND p_size < 45 THEN 1 - 0.8 * (p_size - 30) / 15.0 ELSE 0.2 END, 5) AS m FROM part")
def fuzzy_trapezoid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(fuzzy.trapezoid(F.col("p_size").cast("double"), 10, 20, 30, 45), 5).alias("m"))


@query("WITH x AS (SELECT p_partkey, p_size / 51.0 AS a, p_retailprice / 3000 AS b FROM part) SELECT p_partkey, round(pow(1 - (1 - a) * (1 - b), 0.7) * pow(a * b, 0.3), 5) AS g, round(greatest(a, b), 5) AS u, round(least(a, b), 5) AS i, round(1 - a, 5) AS c FROM x")
def fuzzy_gamma(spark, sf_dir):
    a, b = F.col("p_size") / 51.0, F.col("p_retailprice") / 3000
    return table(spark, sf_dir, "part").select("p_partkey", r(fuzzy.gamma(0.7, a, b), 5).alias("g"), r(fuzzy.union(a, b), 5).alias("u"), r(fuzzy.intersection(a, b), 5).alias("i"), r(fuzzy.complement(a), 5).alias("c"))


@query("WITH p AS (SELECT s_suppkey AS k, list_value(0.0, 4.0 + s_suppkey % 7, 3.0, 1.0) AS x, list_value(0.0, 1.0, 5.0 + s_suppkey % 3, 4.0) AS y FROM supplier) SELECT k, round((x[1]*y[2]-x[2]*y[1] + x[2]*y[3]-x[3]*y[2] + x[3]*y[4]-x[4]*y[3] + x[4]*y[1]-x[1]*y[4]) / 2, 4) AS area FROM p")
def shoelace_area(spark, sf_dir):
    k = F.col("s_suppkey")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(pt(F.lit(0), F.lit(0)), pt(4 + k % 7, F.lit(1)), pt(F.lit(3), 5 + k % 3), pt(F.lit(1), F.lit(4)))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), ring.alias("ring")).select("k", r(polygons.shoelace(F.col("ring"))).alias("area"))


@query("SELECT s_suppkey AS k, round(6371.0 * 6371.0 * radians(0.5) * (sin(radians(s_suppkey % 80 + 1)) - sin(radians(s_suppkey % 80))), 3) AS area FROM supplier")
def cell_area(spark, sf_dir):
    lat = F.col("s_suppkey") % 80
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), r(geodesy.cell_area(F.lit(0.0), F.lit(0.5), lat, lat + 1), 3).alias("area"))


@query(f"WITH {SITES} SELECT k, round(pow(lat, 0) * cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM sites")
def nvectors(spark, sf_dir):
    s = sites(spark, sf_dir).withColumn("n", geodesy.nvector(F.col("lat"), F.col("lon")))
    return s.select("k", *[r(f"n.{c}", 6).alias(c) for c in "xyz"])


@query(f"WITH {SITES} SELECT a.k, round({HAV.format(a='a.', b='b.')}, 3) AS km FROM sites a JOIN sites b ON b.k = a.k + 1")
def haversine_pairs(spark, sf_dir):
    a = sites(spark, sf_dir)
    b = a.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "k").select("k", r(geodesy.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("km"))


@query("SELECT p_partkey, round(299792.458 * (pow(1 + p_size / 100.0, 2) - 1) / (pow(1 + p_size / 100.0, 2) + 1), 3) AS v FROM part")
def redshift_velocity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(astro.velocity_of_redshift(F.col("p_size") / 100.0), 3).alias("v"))


@query("SELECT p_partkey, round(pow(pow(10, -0.4 * (p_size / 10.0 - 3)), -0.2) * exp(-pow(10, -0.4 * (p_size / 10.0 - 3))), 5) AS n FROM part")
def schechter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(astro.schechter(F.col("p_size") / 10.0, 3.0, -1.2), 5).alias("n"))


# --- rasters and images ---------------------------------------------------------------------


@query(
    f"WITH {GRID}, g AS (SELECT raster_id, j, i, CASE WHEN lag(value) OVER a IS NULL THEN lead(value) OVER a - value WHEN lead(value) OVER a IS NULL THEN value - lag(value) OVER a ELSE (lead(value) OVER a - lag(value) OVER a) / 2 END AS gx,"
    " CASE WHEN lag(value) OVER b IS NULL THEN lead(value) OVER b - value WHEN lead(value) OVER b IS NULL THEN value - lag(value) OVER b ELSE (lead(value) OVER b - lag(value) OVER b) / 2 END AS gy FROM grid WINDOW a AS (PARTITION BY raster_id, j ORDER BY i), b AS (PARTITION BY raster_id, i ORDER BY j))"
    " SELECT raster_id, j, i, round(degrees(atan(sqrt(pow(gx / 2, 2) + pow(gy / 3, 2)))), 4) AS slope FROM g"
)
def grid_gradient(spark, sf_dir):
    return windows.grid_slope(grid(spark, sf_dir), "value", F.lit(2.0), F.lit(3.0)).select("raster_id", "j", "i", r("slope").alias("slope"))


_AT = ", ".join(f"max(CASE WHEN b.j = a.j + {dj} AND b.i = a.i + {di} THEN b.z END) AS z{n}" for n, (dj, di) in enumerate((dj, di) for dj in (-1, 0, 1) for di in (-1, 0, 1)))
_GC = "2 * 6371.0 * asin(sqrt(pow(cos(radians({lat})), 2) * pow(sin(radians(1.0)), 2)))"


@query(
    f"WITH {GRID}, c AS (SELECT raster_id, j, i, value * 100 AS z, 40.0 - j AS lat FROM grid), n AS (SELECT a.raster_id, a.j, a.i, a.lat, {_AT} FROM c a JOIN c b ON a.raster_id = b.raster_id AND b.j BETWEEN a.j - 1 AND a.j + 1 AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY 1, 2, 3, 4),"
    f" s AS (SELECT raster_id, j, i, ((z2 - z0) / ({_GC.format(lat='lat + 1')}) + 2 * (z5 - z3) / ({_GC.format(lat='lat')}) + (z8 - z6) / ({_GC.format(lat='lat - 1')})) / 4 AS dx, ((z0 - z6) + 2 * (z1 - z7) + (z2 - z8)) / (2 * 6371.0 * radians(1.0)) / 4 AS dy FROM n)"
    " SELECT raster_id, j, i, round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) AS slope FROM s"
)
def horn_slope(spark, sf_dir):
    whole = cells(table(spark, sf_dir, "embeddings")).withColumns({"lon": F.col("i") * 1.0, "lat": 40.0 - F.col("j"), "value": F.col("value") * 100})
    return windows.horn_slope(whole).select("raster_id", "j", "i", r("slope").alias("slope"))


@query(
    f"WITH {GRID}, o AS (SELECT a AS dj, b AS di FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)), q AS (SELECT raster_id, j, i, j + dj AS nj, i + di AS ni FROM grid, o),"
    " w AS (SELECT raster_id, j, i, CASE WHEN nj < 0 THEN -nj - 1 WHEN nj >= 8 THEN 15 - nj ELSE nj END AS mj, CASE WHEN nj < 0 OR nj >= 8 THEN 7 - (ni + 8) % 8 ELSE (ni + 8) % 8 END AS mi FROM q)"
    " SELECT w.raster_id, w.j, w.i, round(stddev_pop(g.value), 4) AS std FROM w JOIN grid g ON g.raster_id = w.raster_id AND g.j = w.mj AND g.i = w.mi GROUP BY 1, 2, 3"
)
def neighbour_std(spark, sf_dir):
    return windows.neighbour_std(grid(spark, sf_dir), 8, 8).select("raster_id", "j", "i", r("std").alias("std"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.as_images(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8)


@query(f"WITH {GRID}, o AS (SELECT x AS x0, y AS y0 FROM (SELECT unnest(range(0, 4, 2)) AS x), (SELECT unnest(range(0, 4, 2)) AS y)) SELECT CAST(raster_id AS VARCHAR) AS label, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, round(sum(value), 4) AS total FROM grid JOIN o ON i >= x0 AND i < x0 + 4 AND j >= y0 AND j < y0 + 4 GROUP BY 1, 2, 3")
def image_tiles(spark, sf_dir):
    t = images.tiles(_images(spark, sf_dir), 4, 2)
    return t.select("label", "x0", "y0", r(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    f"WITH {GRID}, t AS (SELECT raster_id, 0 AS k, j, i, value FROM grid UNION ALL SELECT raster_id, 1, 7 - i, j, value FROM grid UNION ALL SELECT raster_id, 2, 7 - j, 7 - i, value FROM grid UNION ALL SELECT raster_id, 3, i, 7 - j, value FROM grid)"
    " SELECT raster_id || ', Rotated: ' || (k * 90) AS label, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, round(value, 5) AS value FROM t"
)
def image_rotate(spark, sf_dir):
    return images.cells_of(images.rotate_images(_images(spark, sf_dir))).select("label", "j", "i", r("value", 5).alias("value"))


@query("WITH c AS (SELECT j, i, -10 + (i + 0.5) AS x, 20 - (j + 0.5) AS y FROM (SELECT unnest(range(20)) AS j), (SELECT unnest(range(60)) AS i)), q AS (SELECT j, i, x, y, CASE WHEN " + _in_diamond("x", "y") + " THEN 12 END AS d FROM c), s AS (SELECT unnest(range(12)) AS id) SELECT CAST(q.j AS INTEGER) AS j, CAST(q.i AS INTEGER) AS i, CASE WHEN coalesce(max(s.id), max(d)) IS NULL THEN 1.0 ELSE 0.0 END AS value FROM q LEFT JOIN s ON x >= 5 * (id % 4) AND x < 5 * (id % 4) + 4 AND y >= 9 + 3 * (id // 4) AND y < 11.5 + 3 * (id // 4) GROUP BY q.j, q.i")
def rasterize(spark, sf_dir):
    return images.rasterize(_squares(spark), 20, 60, (-10.0, 0.0, 50.0, 20.0))


# --- graphs, runs, kernels ------------------------------------------------------------------


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation), p AS (SELECT n_nationkey AS node, n_nationkey AS target, 0 AS d FROM nation WHERE n_regionkey = 0 UNION SELECT p.node, e.dst, p.d + 1 FROM p JOIN e ON p.target = e.src WHERE p.d < 3) SELECT DISTINCT CAST(node AS INTEGER) AS node, CAST(target AS INTEGER) AS target FROM p")
def edge_reachability(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst"))
    b = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 5) % 25).alias("dst"))
    return search.reachable(a.union(b).distinct(), n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("node")), 3)


NEAR = "e AS (SELECT n_nationkey AS src, CAST((n_nationkey * 7 + n_regionkey) % 25 AS INTEGER) AS dst, 1.0::DOUBLE + n_nationkey % 3 AS time FROM nation UNION SELECT n_nationkey, CAST((n_nationkey + 5) % 25 AS INTEGER), 2.0 FROM nation)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    a = n.select(key.alias("src"), ((key * 7 + F.col("n_regionkey")) % 25).cast("int").alias("dst"), (1.0 + key % 3).alias("time"))
    return a.union(n.select(key, ((key + 5) % 25).cast("int"), F.lit(2.0))).distinct()


PATHS = (
    f"{NEAR}, w AS (SELECT n_nationkey AS start, [n_nationkey] AS path, 0.0::DOUBLE AS duration, [0.0::DOUBLE] AS times FROM nation WHERE n_regionkey = 0 UNION ALL SELECT start, list_append(path, dst), duration + time, list_append(times, duration + time) FROM w JOIN e ON e.src = path[-1] AND NOT list_contains(path, e.dst) AND duration + time <= 9),"
    " ended AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.path[-1] AND NOT list_contains(w.path, e.dst) AND w.duration + e.time <= 9))"
)


@query(f"WITH RECURSIVE {PATHS} SELECT start, array_to_string(path, '-') AS path, duration, CAST(len(path) AS DOUBLE) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC, duration DESC, path DESC) AS r FROM ended) WHERE r = 1")
def traverse_paths(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    paths = search.traverse_paths(_near(spark, sf_dir), starts, 9.0)
    best = search.best_paths(paths.withColumn("rank", F.size("path").cast("double")))
    return best.select("start", F.array_join("path", "-").alias("path"), "duration", "rank")


@query("WITH " + LI + ", " + ", ".join(f"r{k} AS (SELECT label, ts, round(median(v) OVER (PARTITION BY label ORDER BY ts ROWS BETWEEN {n // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING), 8) AS v, {k} AS run_id FROM li)" for k, n in enumerate((1, 15, 40, 70))) + " SELECT label, ts, v, CAST(run_id AS BIGINT) AS run_id FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2 UNION ALL FROM r3)")
def run_grid_medians(spark, sf_dir):
    source = Dataset.of(li(spark, sf_dir), ["v"])
    stage = Stage("median", lambda d, n: d.with_df(windows.rolling_median(d.df, "v", n, name="v")), ParamCycle([1, 15, 40, 70]))
    return Pipeline(lambda run_id: source, [stage]).run(4).data().select(LABEL, TIME, r("v", 8).alias("v"), "run_id")


@query(f"WITH {EV}, g AS (SELECT label, ts, v * (1 + k) AS v, k AS run_id FROM ev, (SELECT unnest(range(3)) AS k)) SELECT CAST(a.run_id AS BIGINT) AS run_i, CAST(b.run_id AS BIGINT) AS run_j, round(sqrt(sum(pow(a.v - b.v, 2))), 3) AS distance FROM g a JOIN g b ON a.label = b.label AND a.ts = b.ts AND a.run_id <= b.run_id GROUP BY 1, 2")
def run_distance_matrix(spark, sf_dir):
    runs = run_grid(lambda k: ev(spark, sf_dir).select(F.concat_ws("|", LABEL, TIME).alias("key"), (F.col("v") * (1 + k)).alias("v")), [{"k": k} for k in range(3)])
    return stats.run_distances(runs, "key", "v").select("run_i", "run_j", r("distance", 3).alias("distance"))


FORWARD = (
    "z AS (SELECT label, ts, v, row_number() OVER (PARTITION BY label ORDER BY ts) AS i, count(*) OVER (PARTITION BY label) AS n FROM {src}),"
    " fw AS (SELECT label, i, {x0} AS x, {p0}::DOUBLE AS p, {x0} AS xp, {p0}::DOUBLE AS pp FROM z WHERE i = 1 UNION ALL SELECT label, i, CASE WHEN v IS NULL THEN xq ELSE xq + pq / (pq + {noise}) * (v - xq) END, CASE WHEN v IS NULL THEN pq ELSE (1 - pq / (pq + {noise})) * pq END, xq, pq FROM (SELECT z.label, z.i, z.v, exp(-1.0 / {tau}) * fw.x AS xq, exp(-2.0 / {tau}) * fw.p + {s2} * (1 - exp(-2.0 / {tau})) AS pq FROM fw JOIN z ON z.label = fw.label AND z.i = fw.i + 1))"
)


@query(f"WITH RECURSIVE {LI}, {FORWARD.format(src='li', x0='0.0::DOUBLE', p0='1e6', noise=1.0, tau=100.0, s2=4.0)} SELECT z.label, z.ts, round(x, 4) AS state, round(p, 4) AS state_var FROM fw JOIN z USING (label, i)")
def kalman_forward(spark, sf_dir):
    return kernels.kalman_forward(li(spark, sf_dir), "v").select(LABEL, TIME, r("state").alias("state"), r("state_var").alias("state_var"))




BACKWARD = (
    "md AS (SELECT label, median(v) AS md FROM od GROUP BY label), bw AS (SELECT fw.label, i, x, p * 1e6 AS p, x AS xp, p * 1e6 AS pp FROM fw JOIN z USING (label, i) WHERE i = n UNION ALL SELECT label, i, CASE WHEN v IS NULL THEN xq ELSE xq + pq / (pq + 400.0) * (v - xq) END, CASE WHEN v IS NULL THEN pq ELSE (1 - pq / (pq + 400.0)) * pq END, xq, pq"
    " FROM (SELECT z.label, z.i, z.v, bw.x / exp(-1.0 / 30) AS xq, (bw.p + 100.0 * (1 - exp(-2.0 / 30))) / exp(-2.0 / 30) AS pq FROM bw JOIN z ON z.label = bw.label AND z.i = bw.i - 1))"
)


@query(
    f"WITH RECURSIVE {OD}, {FORWARD.format(src='od', x0='(SELECT median(v) FROM od o WHERE o.label = z.label)', p0='1e6', noise=400.0, tau=30.0, s2=100.0)}, {BACKWARD}"
    " SELECT z.label, z.ts, round(fw.x + fw.p / (bw.pp + fw.p) * (bw.xp - fw.x), 3) AS v FROM fw JOIN bw USING (label, i) JOIN z USING (label, i)"
)
def kalman_two_sided(spark, sf_dir):
    """The smoother with a clip that takes nothing out."""
    return kernels.kalman_smooth(od(spark, sf_dir), "v", tau=30.0, variance=100.0, noise=400.0, clip=1e9).select(LABEL, TIME, r("v", 3).alias("v"))


@query(ORACLES["kalman_two_sided"])
def kalman_smooth(spark, sf_dir):
    """The smoother with its usual clip, which finds nothing to take out here."""
    return kernels.kalman_smooth(od(spark, sf_dir), "v", tau=30.0, variance=100.0, noise=400.0).select(LABEL, TIME, r("v", 3).alias("v"))


@query(
    f"WITH RECURSIVE {OD}, {REGULAR.format(src='od')}, z AS (SELECT label, ts, v, row_number() OVER (PARTITION BY label ORDER BY ts) AS i, count(*) OVER (PARTITION BY label) AS n FROM reg),"
    " s0 AS (SELECT label, arg_min(v, i) AS x0 FROM z WHERE v IS NOT NULL GROUP BY label),"
    " fw AS (SELECT label, 0::BIGINT AS i, x0 AS x, 1000.0::DOUBLE AS p, x0 AS xp, 1000.0::DOUBLE AS pp FROM s0 UNION ALL SELECT label, i, CASE WHEN v IS NULL THEN xq ELSE xq + pq / (pq + 400.0) * (v - xq) END, CASE WHEN v IS NULL THEN pq ELSE (1 - pq / (pq + 400.0)) * pq END, xq, pq FROM (SELECT z.label, z.i, z.v, exp(-1.0 / 30) * fw.x AS xq, exp(-2.0 / 30) * fw.p + 100.0 * (1 - exp(-2.0 / 30)) AS pq FROM fw JOIN z ON z.label = fw.label AND z.i = fw.i + 1)),"
    " bw AS (SELECT fw.label, fw.i, fw.x AS xs, fw.xp, fw.pp FROM fw JOIN z USING (label, i) WHERE i = n UNION ALL SELECT fw.label, fw.i, fw.x + fw.p * exp(-1.0 / 30) / bw.pp * (bw.xs - bw.xp), fw.xp, fw.pp FROM bw JOIN fw ON fw.label = bw.label AND fw.i = bw.i - 1 AND fw.i > 0)"
    " SELECT z.label, z.ts, round(xs, 3) AS v FROM bw JOIN z USING (label, i)"
)
def rts_smooth(spark, sf_dir):
    return kernels.rts_smooth(series.resample(od(spark, sf_dir)), "v", 30.0, 100.0, 400.0).select(LABEL, TIME, r("v", 3).alias("v"))


#: The first 16 of the 31 symmetric taps of equal ripples for the bands [0, 0.05] and [0.1, 0.5].
TAPS = [0.015453651345365473, 0.0006281916979150712, -0.003562870267700821, -0.00993919946049043, -0.017017487944635402, -0.022620442542746737, -0.024242053304148733, -0.019584764200918498, -0.007153646293424008, 0.01324758866190878, 0.04024887654682462, 0.07098185361543867, 0.10148654100220096, 0.12740095642599253, 0.14478698891551794, 0.15090841568917468]


@query(
    f"WITH {LI}, {POS.format(src='li')}, taps AS (SELECT unnest(range(31)) AS k, unnest({TAPS + TAPS[14::-1]}) AS w), n AS (SELECT label, count(*) AS n, least(93, count(*) - 1) AS pad, arg_min(v, pos) AS first, arg_max(v, pos) AS last FROM x GROUP BY label),"
    " wide AS (SELECT label, pos AS i, v FROM x UNION ALL SELECT label, -pos, 2 * first - v FROM x JOIN n USING (label) WHERE pos BETWEEN 1 AND pad UNION ALL SELECT label, 2 * (n - 1) - pos, 2 * last - v FROM x JOIN n USING (label) WHERE pos BETWEEN n - 1 - pad AND n - 2),"
    " once AS (SELECT e.label, e.i, sum(w * b.v) AS v FROM wide e CROSS JOIN taps JOIN wide b ON b.label = e.label AND b.i = e.i - k GROUP BY 1, 2), twice AS (SELECT e.label, e.i, sum(w * b.v) AS v FROM once e CROSS JOIN taps JOIN once b ON b.label = e.label AND b.i = e.i + k GROUP BY 1, 2)"
    " SELECT x.label, x.ts, round(twice.v, 3) AS v FROM twice JOIN x ON x.label = twice.label AND x.pos = twice.i"
)
def lowpass(spark, sf_dir):
    return kernels.low_pass(li(spark, sf_dir), "v").select(LABEL, TIME, r("v", 3).alias("v"))


@query()
def tanh_fit(spark, sf_dir):
    return kernels.tanh_fit(ev(spark, sf_dir), "v")


@query(
    f"WITH {EV}, {POS.format(src='ev')}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY label), k AS (SELECT label, n, unnest(range(n)) AS k FROM n)"
    " SELECT label, CAST(k AS BIGINT) AS k, round(CASE WHEN 2 * k < n THEN k ELSE k - n END / n, 6) AS frequency, round(sum(v * cos(2 * pi() * k * pos / n)), 4) AS re, round(-sum(v * sin(2 * pi() * k * pos / n)), 4) AS im FROM x JOIN k USING (label) GROUP BY label, k, n"
)
def dft(spark, sf_dir):
    return kernels.dft(ev(spark, sf_dir), "v").select(LABEL, "k", r("frequency", 6).alias("frequency"), r("re").alias("re"), r("im").alias("im"))


@query(f"WITH {EV} SELECT label, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS pos, round(v, 6) AS v, true AS several FROM ev")
def empirical_modes(spark, sf_dir):
    """Modes and residual of each label, summed up again."""
    modes = kernels.empirical_modes(ev(spark, sf_dir), "v")
    return modes.groupBy(LABEL, "pos").agg(r(F.sum("value"), 6).alias("v"), (F.count(F.lit(1)) > 2).alias("several"))


def _power(n: int) -> str:
    """SQL of component ``n`` of the matrix in ``m{n - 1}`` by power iteration, and of the matrix without it."""
    rows = "list_transform(m, lambda row: list_dot_product(row, v))"
    return (
        f" u{n} AS (SELECT 0 AS i, list_transform(m, lambda row, k: 1.0 / (k + 1)) AS v FROM m{n - 1} UNION ALL SELECT i + 1, list_transform(w, lambda e: e / sqrt(list_dot_product(w, w))) FROM (SELECT i, {rows} AS w FROM u{n}, m{n - 1} WHERE i < 3000)),"
        f" e{n} AS (SELECT {n - 1} AS component, v, list_dot_product(v, {rows}) AS l FROM u{n}, m{n - 1} WHERE i = 3000),"
        f" m{n} AS (SELECT list_transform(m, lambda row, a: list_transform(row, lambda x, b: x - l * v[a] * v[b])) AS m FROM m{n - 1}, e{n}),"
    )


@query(
    f"WITH RECURSIVE {EVG}, s AS (SELECT label || '.v' AS key, ts, v AS value FROM evg WHERE v IS NOT NULL UNION ALL SELECT label || '.s', ts, s FROM evg WHERE s IS NOT NULL), whole AS (SELECT ts FROM s GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT key) FROM s)), c AS (SELECT * FROM s JOIN whole USING (ts)),"
    " cov AS (SELECT a.key AS k1, b.key AS k2, covar_samp(a.value, b.value) AS c FROM c a JOIN c b USING (ts) GROUP BY 1, 2), m0 AS (SELECT list(r ORDER BY k1) AS m, list(k1 ORDER BY k1) AS keys FROM (SELECT k1, list(c ORDER BY k2) AS r FROM cov GROUP BY k1)),"
    + "".join(map(_power, (1, 2, 3)))
    + " x AS (SELECT component, l, unnest(keys) AS key, unnest(v) AS v FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3), m0)"
    " SELECT CAST(component AS INTEGER) AS component, key, round(v * sign(arg_max(v, abs(v)) OVER (PARTITION BY component)), 5) AS loading, round(l, 4) AS variance FROM x"
)
def pca_variance(spark, sf_dir):
    loadings, _ = decomposition.principal_components(evg(spark, sf_dir), ["v", "s"], 3)
    return loadings.select("component", "key", r("loading", 5).alias("loading"), r("variance").alias("variance"))


@query()
def ica_projection(spark, sf_dir):
    return decomposition.independent_components(ev(spark, sf_dir), ["v", "s"], 3)


@query()
def dbscan_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("string").alias(LABEL), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40).alias("y"))
    return decomposition.density_clusters(p, "x", "y", 1.0, 4)


@query(f"WITH {EV}, x AS (SELECT label, v, s, atan((row_number() OVER (PARTITION BY label ORDER BY ts) - 1 - 15.0) / 3.0) AS a FROM ev) SELECT label, 'v' AS name, round(pi() * regr_slope(v, a), 4) AS amplitude FROM x GROUP BY label UNION ALL SELECT label, 's', round(pi() * regr_slope(s, a), 4) FROM x GROUP BY label")
def arctan_amplitudes(spark, sf_dir):
    return decomposition.arctan_amplitudes(ev(spark, sf_dir), ["v", "s"], 15.0, 3.0).select(LABEL, "name", r("amplitude").alias("amplitude"))


@query()
def fast_marching(spark, sf_dir):
    whole = cells(table(spark, sf_dir, "embeddings")).withColumns({"j": F.col("j").cast("int"), "i": F.col("i").cast("int"), "lon": F.col("i") * 1.0, "lat": 4.0 - F.col("j"), "velocity": 1 + F.abs("value"), "initiation": F.when((F.col("j") == 3) & (F.col("i") == 3), 0.0).otherwise(1.0)})
    return search.fast_marching(whole)


@query("SELECT range AS idx FROM range(1000)")
def uniform_table(spark, sf_dir):
    return generators.uniform_table(spark, 1000, [{"name": "a", "start": 0.0, "end": 1.0}], 7).select("idx")


@query()
def galaxy_catalogue(spark, sf_dir):
    return generators.galaxy_catalogue(spark, (10.0, 14.0), (-2.0, 2.0), 2.0, 3)


@query(f"WITH {EVG} SELECT label, ts, round(v, 4) AS v FROM evg WHERE label = 'click' UNION ALL SELECT label, ts, round(s, 4) FROM evg WHERE label = 'view'")
def row_union(spark, sf_dir):
    df = evg(spark, sf_dir)
    a = filters.keep_labels(df, ["click"], True).select(LABEL, TIME, r("v").alias("v"))
    return a.unionByName(filters.keep_labels(df, ["view"], True).select(LABEL, TIME, r("s").alias("v")))


from . import catalogue_layers, catalogue_more  # noqa: E402, F401  further queries, registered on import
