import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.dataset import LABEL, TIME, Dataset, melt, nan_to_null, widen
from tidewatch.functions import astro, deformation, fuzzy, geodesy, polygons
from tidewatch.operators import decomposition, filters, images, joins, kernels, search, series, source_numpy, stats, windows
from tidewatch.sources import generators, readers


def daily(spark, values, label="a", start=dt.date(2020, 1, 1)):
    rows = [(label, start + dt.timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{LABEL} string, {TIME} date, v double")


def values(df, column="v"):
    return [r[column] for r in df.orderBy(LABEL, TIME).collect()]


@pytest.mark.parametrize(
    "a, b, km",
    [((0, 0), (0, 0), 0.0), ((0, 0), (0, 1), 111.319491), ((0, 0), (1, 0), 110.574389), ((0, 0), (0.5, 179.5), 19936.288579), ((42.3541165, -71.0693514), (40.7791472, -73.9680804), 298.396057)],
)
def test_vincenty_golden(a, b, km):
    assert geodesy.vincenty([a[0]], [a[1]], [b[0]], [b[1]])[0] == pytest.approx(km, abs=2e-6)


def test_vincenty_miles_and_failure():
    assert geodesy.vincenty([42.3541165], [-71.0693514], [40.7791472], [-73.9680804], miles=True)[0] == pytest.approx(185.414657, abs=1e-4)
    assert np.isnan(geodesy.vincenty([0], [0], [0.5], [179.7])[0])


def test_interpolation_ends(spark):
    df = daily(spark, [None, 1, None, 3, None])
    assert values(series.interpolate_clamped(df, ["v"])) == [1, 1, 2, 3, 3]
    assert values(series.interpolate_forward(df, ["v"])) == [None, 1, 2, 3, 3]
    assert values(series.interpolate_clamped(daily(spark, [None, None]), ["v"])) == [None, None]


def test_resample_fills_days(spark):
    df = daily(spark, [1, 2, 3]).where(F.dayofmonth(TIME) != 2)
    assert values(series.resample(df)) == [1, None, 3]
    assert values(series.resample(df, "2020-01-02", "2020-01-04")) == [None, 3, None]


def test_even_window_and_min_periods(spark):
    df = daily(spark, [1, 2, 3, 4])
    want = pd.Series([1.0, 2, 3, 4]).rolling(2, center=True, min_periods=2).median()
    assert values(windows.rolling_median(df, "v", 2, 2), "median") == [None if np.isnan(x) else x for x in want]


def test_round_to_day_half_even(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 12),), (dt.datetime(2020, 1, 2, 12),), (dt.datetime(2020, 1, 1, 12, 0, 1),)], "ts timestamp")
    got = [r[0] for r in df.select(filters.round_to_day(F.col("ts"))).collect()]
    want = [x.date() for x in pd.to_datetime(["2020-01-01 12:00:00", "2020-01-02 12:00:00", "2020-01-01 12:00:01"]).round("D")]
    assert got == want


def test_trend_recovers_line_and_cycle(spark):
    t = np.arange(730)
    x = 5 + 0.01 * t + 3 * np.cos(2 * np.pi * t / 365 + 0.4)
    df = daily(spark, x)
    assert max(abs(v) for v in values(series.detrend(daily(spark, 5 + 0.01 * t), "v"))) < 1e-8
    assert np.std(values(series.seasonal_fit(df.withColumn("v", F.col("v") - 0.01 * F.datediff(TIME, F.lit("2020-01-01"))), "v", 1), "fit")) == pytest.approx(3 / np.sqrt(2), rel=1e-3)


def test_step_is_closed(spark):
    x = np.r_[np.zeros(50), np.full(50, 10.0)]
    assert max(abs(v) for v in values(series.step_detrend(daily(spark, x), "v"))) < 1e-9
    assert max(abs(v) for v in values(kernels.steps_detrend(daily(spark, x), "v", 1))) < 1e-9


def test_weighted_average_weights(spark):
    df = daily(spark, [1, 2, 3]).withColumn("s", F.lit(2.0))
    out = windows.weighted_average(df, "v", 3, "s")
    assert values(out) == pytest.approx([1.5, 2, 2.5])
    assert values(out, "s") == pytest.approx([2 / np.sqrt(2), 2 / np.sqrt(3), 2 / np.sqrt(2)])


def test_constant_series_have_no_scale(spark):
    assert values(stats.mad_scale(daily(spark, [2, 2, 2]), "v"), "MAD_Scale_v") == [None] * 3
    assert values(stats.zscore(daily(spark, [2, 2, 2]), "v")) == [None] * 3


def test_combine_needs_a_column(spark):
    with pytest.raises(KeyError):
        filters.combine_columns(daily(spark, [1]), "x", "y", "z")


def test_nan_becomes_null_and_columns_are_checked(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), float("nan"))], f"{LABEL} string, {TIME} date, v double")
    assert nan_to_null(df).first().v is None
    with pytest.raises(KeyError):
        Dataset.of(df, ["w"])


def test_melt_and_widen(spark):
    df = daily(spark, [1, 2]).withColumn("w", F.col("v") * 2)
    back = widen(melt(df, ["v", "w"]), ["v", "w"])
    assert sorted(map(tuple, back.select("v", "w").collect())) == [(1.0, 2.0), (2.0, 4.0)]


def test_smoother_lowers_error():
    z, x = kernels.simulate_fogm(600, 40.0, 9.0, 4.0, 1)
    xs, ps, _ = kernels.smooth_markov(z, 40.0, 9.0, 4.0)
    assert np.std(xs - x) < 0.7 * np.std(z - x)
    assert (ps > 0).all()


def test_kalman_partitions_agree(spark):
    df = daily(spark, np.sin(np.arange(60))).unionByName(daily(spark, np.cos(np.arange(60)), "b"))
    one = values(kernels.kalman_smooth(df.repartition(1), "v"))
    many = values(kernels.kalman_smooth(df.repartition(8), "v"))
    assert one == many and len(one) == 120


def test_fir_passes_and_stops():
    taps = kernels.fir_taps(41, 0.05, 0.12)
    assert taps.sum() == pytest.approx(1, abs=0.02)
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.3 * t)
    out = kernels.zero_phase(slow + fast, taps)
    assert np.std((out - slow)[50:-50]) < 0.05


def test_savgol_keeps_polynomials():
    t = np.arange(50.0)
    x = 1 + t - 0.01 * t**2 + 0.001 * t**3
    assert kernels.savgol(x, 11, 3) == pytest.approx(x, abs=1e-6)


def test_tanh_fit_recovers(spark):
    t = np.arange(200.0)
    out = kernels.tanh_fit(daily(spark, 4 * np.tanh((t - 90) / 20) + 1 + 0.01 * t), "v")
    assert max(abs(v) for v in values(out)) < 0.05


def test_modes_sum_to_signal():
    x = np.sin(np.arange(200) / 3) + np.arange(200) / 50
    assert sum(kernels.imfs(x)) == pytest.approx(x)


def test_fuzzy_edges(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (1.5,), (2.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(fuzzy.trapezoid(F.col("x"), 0, 1, 2, 3)).collect()]
    assert got == [0.1, 0.1, 0.2, 1.0, 1.0, 1.0, 0.2]
    with pytest.raises(ValueError):
        fuzzy.gamma(2.0, F.col("x"))
    assert df.limit(1).select(fuzzy.union(F.col("x"), F.lit(1.0))).first()[0] is None


def test_polygon_area_hole_and_overlap(spark):
    sq = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    df = polygons.bounding_box(spark.createDataFrame([(1, sq, [hole])], "id int, shell array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"))
    assert df.select(polygons.shoelace(F.col("shell"))).first()[0] == 16
    boxed = df.withColumns({"x0": F.lit(2.0), "y0": F.lit(2.0), "x1": F.lit(6.0), "y1": F.lit(6.0)})
    assert polygons.box_overlap(boxed, "shell", ("x0", "y0", "x1", "y1")).first().share == pytest.approx(0.25)
    assert images.squares_over_polygons(df, 2.0, 1.0, 0.9).count() > 0
    pts = spark.createDataFrame([(1.5, 1.5), (3.0, 3.0), (9.0, 9.0)], "x double, y double")
    got = {(r.x, r.polygon) for r in joins.points_in_polygons(pts, df).collect()}
    assert got == {(1.5, -1), (3.0, 1), (9.0, -1)}


def test_rings_to_polygons(spark):
    shell, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
    rows = [("p", 0, shell, "s"), ("p", 1, hole, "h"), ("p", 2, shell, "t")]
    out = polygons.rings_to_polygons(spark.createDataFrame(rows, "part string, id int, ring array<struct<x:double,y:double>>, info string")).orderBy("id").collect()
    assert [(r.id, len(r.holes), r.info) for r in out] == [(0, 1, "s"), (2, 0, "t")]


def test_fast_marching_plane():
    n = 21
    lon, lat = np.meshgrid(np.linspace(0, 1, n), np.linspace(0.5, -0.5, n))
    start = np.ones((n, n))
    start[n // 2, n // 2] = 0
    time, source = search.march(start, np.ones((n, n)), lon, lat)
    want = geodesy.EARTH_RADIUS_KM * np.radians(np.hypot(lon - 0.5, lat))
    assert np.abs(time - want).max() < 0.12 * want.max()
    assert (source == n // 2).all()


def test_fast_marching_wall_and_stop():
    v = np.ones((5, 5))
    v[:, 2] = 0
    lon, lat = np.meshgrid(np.arange(5.0), np.arange(5.0))
    start = np.ones((5, 5))
    start[0, 0] = 0
    time, _ = search.march(start, v, lon, lat)
    assert np.isinf(time[:, 3:]).all() and np.isfinite(time[:, :2]).all()
    time, _ = search.march(start, np.ones((5, 5)), lon, lat, stop=1.0)
    assert np.isfinite(time).sum() < 25


def test_reachability_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0)], "src int, dst int, time double")
    starts = spark.createDataFrame([(1,)], "node int")
    assert {r.target for r in search.reachable(edges, starts, 5).collect()} == {1, 2, 3}
    paths = search.traverse_paths(edges, starts, 10.0)
    assert [(tuple(r.path), r.duration, r.times) for r in paths.collect()] == [((1, 2, 3), 2.0, [0.0, 1.0, 2.0])]  # what can be extended is no path yet
    assert {(r.node, r.target): r.time for r in search.within_time(edges, starts, 1.5).collect()} == {(1, 1): 0.0, (1, 2): 1.0}
    groups = spark.createDataFrame([(0, 1, "a", 0), (0, 3, "b", 0), (0, 4, "c", 1)], "scenario int, node int, grp string, priority int")
    assert {r.node for r in search.threshold_targets(edges, groups, 10.0).collect()} == {1, 3}


def test_density_clusters(spark):
    rows = [("a", k, float(k), 0.0) for k in range(5)] + [("a", 10 + k, 100.0 + k, 0.0) for k in range(5)] + [("a", 99, 50.0, 50.0)]
    got = {r.id: r.cluster for r in decomposition.density_clusters(spark.createDataFrame(rows, "label string, id long, x double, y double"), "x", "y", 1.1, 3).collect()}
    assert {got[k] for k in range(5)} == {got[1]} and got[10] == got[14] != got[0] and got[99] == -1


def test_density_clusters_against_all_pairs(spark):
    """Crowded and sparse places, points at one place, chains over many cells, distances of eps but for rounding, missing values."""
    rng = np.random.default_rng(5)
    crowd = [(float(a), float(b)) for a, b in rng.normal(0, 0.3, (300, 2))] + [(5.0, 5.0)] * 40
    chain = [(10 + 0.9 * k, 0.9 * (k % 2)) for k in range(60)] + [(7 + 0.1 * k, 20.0) for k in range(5)] + [(7.4 + 1.0, 20.0)]
    loose = [(float(a), float(b)) for a, b in rng.uniform(-30, 30, (500, 2))]
    rows = [("ab"[k % 7 == 0], int(n), *q) for k, (n, q) in enumerate(zip(rng.permutation(len(crowd + chain + loose)), crowd + chain + loose, strict=True))]
    schema = "label string, id long, x double, y double"
    odd = [("a", 9001, None, 0.0), ("a", 9002, float("nan"), 0.0), (None, 9003, 0.0, 0.0)]
    got = {r.id: r.cluster for r in decomposition.density_clusters(spark.createDataFrame(rows + odd, schema), "x", "y", 1.0, 4).collect()}
    want = {9001: -1, 9002: -1, 9003: -1}
    for label in "ab":
        ids, at = np.array([r[1] for r in rows if r[0] == label]), np.array([r[2:] for r in rows if r[0] == label])
        near = ((at[:, None] - at[None]) ** 2).sum(axis=2) <= 1
        core = near.sum(axis=1) >= 4
        name = np.where(core, ids, 10**6)
        while True:
            new = np.where(core, np.where(near & core, name, 10**6).min(axis=1), 10**6)
            if (new == name).all():
                break
            name = new
        for k, i in enumerate(ids):
            cores = np.flatnonzero(near[k] & core)
            want[int(i)] = int(name[k]) if core[k] else int(name[cores[ids[cores].argmin()]]) if len(cores) else -1
    assert got == want and len(set(got.values())) > 3


def test_density_clusters_of_a_crowd(spark):
    """60,000 points within one eps: their pairs, 3.6 billion, are never made."""
    n = 30_000
    df = spark.range(2 * n).select(F.lit("a").alias("label"), "id", (F.rand(1) * 0.4 + F.col("id") % 2 * 1.3).alias("x"), (F.rand(2) * 0.4).alias("y"))
    got = decomposition.density_clusters(df, "x", "y", 1.0, 4).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in got} == {(0, 2 * n)}


def test_touching_in_a_crowd(spark):
    """20,000 equal shapes on each side: each shape is told once, not 400 million pairs."""
    at = "array(struct({0} as x, 0.0D as y), struct({0} + 1 as x, 0.0D as y), struct({0} as x, 1.0D as y))"
    made = lambda n, x: spark.range(n).selectExpr("id as feature_id", f"{at.format(x)} as geom", f"{x} as xmin", "0.0D as ymin", f"{x} + 1 as xmax", "1.0D as ymax")
    a, b = made(20_000, "CAST(id % 2 * 40 AS DOUBLE)"), made(20_000, "0.5D")
    assert joins.spatial_semi_join(a, b).agg(F.count(F.lit(1)), F.max(F.col("feature_id") % 2)).first() == (10_000, 0)
    assert joins.spatial_semi_join(a, b, anti=True).count() == 10_000
    assert {q.name for q in joins.spatial_semi_join(a, b).schema} == set(a.columns)


def test_shared_vertices_and_shares(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [int(v) for v in rng.integers(0, 40, 3)]) for k in range(120)] + [(500, []), (501, None), (502, [7, 7, None])]
    regions = spark.createDataFrame(rows, "id int, vertices array<int>")
    sets = {k: set(v or []) - {None} for k, v in rows}
    got = [tuple(r) for r in joins.shared_vertices(regions).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in sets for b in sets if sets[a] & sets[b]}
    large, small = spark.range(100).selectExpr("id as l", "id % 2 as k"), spark.range(6).selectExpr("id as s", "id % 3 as k")
    dealt, met = joins.in_shares(large, small, ["k"], "l", rows=10)
    assert dealt.select("k", "_share").distinct().count() > 2  # one key lies in several shares
    assert sorted(tuple(r) for r in dealt.join(met, ["k", "_share"]).select("l", "s").collect()) == sorted((a, b) for a in range(100) for b in range(6) if a % 2 == b % 3)


def test_squares_against_clipping(spark):
    rings = [[{"x": float(3 * k + r * np.cos(t)), "y": float(r * np.sin(t))} for t, r in zip(np.arange(9) * 2 * np.pi / 9, (1, 0.4, 1.3) * 3, strict=True)] for k in range(5)] + [[{"x": 0.0, "y": 0.0}, {"x": 30.0, "y": 0.0}, {"x": 0.0, "y": 9.0}]]
    df = polygons.bounding_box(spark.createDataFrame(list(enumerate(rings)), "id int, shell array<struct<x:double,y:double>>"))
    for size, required in ((0.7, 0.5), (2.0, 0.0)):
        told = lambda d: {(r.id, round(r.x0, 6), round(r.y0, 6)): pytest.approx(r.share, abs=1e-9) for r in d.where("share > 1e-9").collect()}
        got = told(images.squares_over_polygons(df, size, 0.3, required))
        assert len(got) > 100 and got == told(images._squares_by_clipping(df, size, 0.3, required))


def test_nearest_sites_that_tie(spark):
    """At the pole all sites of one latitude are as near but for rounding; the smallest is taken."""
    sites = spark.createDataFrame([(k, -89.0, float(73 * k % 360 - 180)) for k in range(3, 90)] + [(k, 60.0, 10.0 * k) for k in (200, 201)], "site int, lat double, lon double")
    points = spark.createDataFrame([(float(lon), -90.0) for lon in range(-170, 180, 20)], "lon double, lat double")
    got = images.nearest_sites(points, sites, 5.0).collect()
    assert len(got) == 18 and {r.site for r in got} == {3} and all(r.distance == pytest.approx(1.0) for r in got)


def test_linkage(spark):
    rows = [(0, 1, 1.0), (0, 2, 9.0), (1, 2, 8.0)]
    df = spark.createDataFrame(rows, "a int, b int, distance double")
    assert [tuple(r) for r in decomposition.linkage(df).orderBy("distance").collect()] == [(0, 1, 1.0, 2), (0, 2, 8.5, 3)]
    assert decomposition.linkage(df.where("false")).count() == 0
    tied = spark.createDataFrame([(a, b, 1.0) for a in range(5) for b in range(a + 1, 5)], "a int, b int, distance double")
    merges = decomposition.linkage(tied).collect()
    assert len(merges) == 4 and {r.distance for r in merges} == {1.0} and max(r.size for r in merges) == 5


def test_linkage_of_points_without_a_table(spark, monkeypatch):
    """Rounds over blocks of points, down to few clusters, give the merges of the whole table of distances."""
    monkeypatch.setattr(decomposition, "POINTS", 20)
    at = np.random.default_rng(2).normal(size=(70, 3))
    points = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(at)], "id long, v array<double>")
    pairs = [(a, b, float(np.sqrt(((at[a] - at[b]) ** 2).sum()))) for a in range(70) for b in range(a + 1, 70)]
    told = lambda df: {(r.left, r.right, r.size): pytest.approx(r.distance) for r in df.collect()}
    got = told(decomposition.linkage_of_points(points, few=10))
    assert len(got) == 69 and got == told(decomposition.linkage(spark.createDataFrame(pairs, "a long, b long, distance double")))
    assert decomposition.linkage_of_points(points.limit(1)).count() == 0 and decomposition.linkage_of_points(points.where("false")).count() == 0


def test_spline_and_modes_of_two_tones():
    knots, at = np.array([0.0, 1.0, 2.5, 4.0]), np.linspace(0, 4, 81)
    cubic = kernels.natural_spline(at, knots, np.array([1.0, 3.0, -2.0, 0.5]))
    assert cubic[[0, 20, 50, 80]] == pytest.approx([1.0, 3.0, -2.0, 0.5])
    bend = np.diff(cubic, 2)
    assert abs(bend[0]) < 2e-3 and abs(bend[-1]) < 2e-3 and np.abs(np.diff(bend)).max() < 2e-3  # ends straight, bends without a jump
    assert kernels.natural_spline(at, knots, 2 * knots - 1) == pytest.approx(2 * at - 1)
    t = np.arange(600)
    fast, slow = np.sin(t / 3), 2 * np.sin(t / 40) + 0.002 * t
    modes = kernels.imfs(fast + slow)
    assert sum(modes) == pytest.approx(fast + slow)
    assert np.corrcoef(modes[0], fast)[0, 1] > 0.99 and np.corrcoef(sum(modes[1:]), slow)[0, 1] > 0.99


def test_source_inversion_recovers():
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-0.2, 0.2, 30), rng.uniform(-0.2, 0.2, 30)
    truth = np.array([0.02, -0.03, 6.0, 2e-4])
    got = decomposition.invert_source(lat, lon, source_numpy.displacement("mogi", lat, lon, truth))
    assert got == pytest.approx(truth, rel=0.02, abs=1e-3)


@pytest.mark.parametrize("model", sorted(source_numpy.EXTRA))
def test_array_models_match_columns(spark, model):
    """Every source model on arrays against its column form, and its parameters found again from displacements."""
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-0.2, 0.2, 40), rng.uniform(-0.2, 0.2, 40)
    extra = [1.5] * source_numpy.EXTRA[model]
    p = np.array([0.0, 0.0, 6.0, 2e-4, *extra])
    got = source_numpy.displacement(model, lat, lon, p)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(np.radians(lon) * 6371, np.radians(lat) * 6371, strict=True)], "x double, y double")
    form = deformation.MODELS[model][0](F.col("x"), F.col("y"), F.lit(6.0), F.lit(2e-4), *map(F.lit, extra))
    want = np.array([tuple(r.u) for r in df.select(form.alias("u")).collect()])
    assert got == pytest.approx(want, rel=1e-9, abs=1e-15)
    fitted = decomposition.invert_source(lat, lon, got, model)
    assert source_numpy.displacement(model, lat, lon, fitted) == pytest.approx(got, abs=0.05 * np.abs(got).max())


def test_markov_fit_finds_its_parameters():
    z, _ = kernels.simulate_fogm(900, 12.0, 25.0, 1.0, 3)
    for method in ("brute", "igrid", "simple"):
        fit = kernels.fit_markov(z, 1.0, 100.0, method)
        assert 12.0 < fit.variance < 50.0 and fit.tau > 1 and fit.tau_by_likelihood > 1
    with pytest.raises(ValueError):
        kernels.fit_markov(z, 1.0, 100.0, "x")


def test_tanh_fit_within_limits(spark):
    """Rows far off by their errors don't count, and t0 stays inside its limits."""
    t = np.arange(120)
    x = 3 * np.tanh((t - 60) / 8.0) + 1 + 0.01 * t
    x[5] += 500
    df = daily(spark, x, "a").withColumn("e", F.when(F.dayofyear(TIME) == 6, 1e6).otherwise(1.0))
    base = df.agg(F.min(TIME)).first()[0]
    got = kernels.tanh_fit(df, "v", error="e").orderBy(TIME).toPandas()["fit"].to_numpy()
    assert np.abs(got - (3 * np.tanh((t - 60) / 8.0) + 1 + 0.01 * t)).max() < 0.05
    late = kernels.tanh_fit(df, "v", error="e", limits=(base + dt.timedelta(days=90), None)).orderBy(TIME).toPandas()["fit"].to_numpy()
    assert np.abs(late - got).max() > 0.5


def test_rotations_of_four_components(spark):
    rng = np.random.default_rng(2)
    assert decomposition.rotation4([0.3, 0.2, 0.1, 0.7]) @ decomposition.rotation4([0.3, 0.2, 0.1, 0.7]).T == pytest.approx(np.eye(4))
    assert decomposition.translate(np.zeros((2, 3)), [1, 2, 3]).tolist() == [[1, 2, 3]] * 2
    found = decomposition.best_rotation(spark, rng.normal(size=(40, 4)), 3, "remove", components=4)
    assert len(found["angles"]) == 4


def test_columns_match_array_models(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double").select(deformation.mogi(F.col("x"), F.col("y"), F.lit(5.0), F.lit(1.0)).alias("u"))
    assert tuple(df.first().u) == pytest.approx((3 / 50**1.5, 4 / 50**1.5, 5 / 50**1.5))


def test_rotation_search(spark):
    t = np.arange(60.0)
    base = np.stack([np.sin(t / 5), 0 * t + 1e-3, 0 * t], axis=1)
    found = decomposition.best_rotation(spark, base, 4, "dtw", np.sin(t / 5))
    assert found["score"] < 1e-6


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3)) @ np.diag([5, 2, 1])
    df = daily(spark, x[:, 0], "a").unionByName(daily(spark, x[:, 1], "b")).unionByName(daily(spark, x[:, 2], "c"))
    loadings, projected = decomposition.principal_components(df, ["v"], 3)
    variances = [r.variance for r in loadings.select("component", "variance").distinct().orderBy("component").collect()]
    assert variances == pytest.approx(sorted(np.linalg.eigvalsh(np.cov(x.T)), reverse=True))
    assert projected.groupBy("component").agg(F.avg("projection").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-9


def test_images(spark):
    df = spark.createDataFrame([(1, [float(k) for k in range(12)])], "id int, px array<double>")
    im = images.as_images(df, "id", "px", 3, 4)
    turned = {r.label.rsplit(" ", 1)[1]: np.array(r.pixels).reshape(r.height, r.width) for r in images.rotate_images(im).collect()}
    base = np.arange(12.0).reshape(3, 4)
    for k in range(4):
        assert (turned[str(90 * k)] == np.rot90(base, k)).all()
    assert images.apply_function(im, lambda a: a * 2).first().pixels == [2.0 * k for k in range(12)]
    assert images.tiles(im, 2, 1).count() == 2
    assert filters.select_channels(im.withColumns({"pixels": F.concat("pixels", "pixels"), "channels": F.lit(2)}), 1).first().pixels == base.ravel().tolist()
    stacked = images.add_random_channel(im, images.tiles(im, 2, 1))
    assert stacked.first().channels == 2


def test_sources_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1.5), (1, 0, 0, 1, None)], "raster_id int, band int, j int, i int, value double")
    readers.write_raster(cells, str(tmp_path / "r"), scale=0.5)
    back = readers.raster_values(spark.read.parquet(str(tmp_path / "r")), scale=0.5)
    assert sorted((r.i, r.value) for r in back.collect()) == [(0, 1.5), (1, None)]
    paths = spark.createDataFrame([([1, 2], 3.0)], "path array<int>, t double")
    readers.write_paths(paths, str(tmp_path / "p"))
    assert readers.read_paths(spark, str(tmp_path / "p"), {"path": "array<int>", "t": "double"}).collect() == paths.collect()
    where = readers.save_run(images.as_images(spark.createDataFrame([(1, [1.0])], "id int, px array<double>"), "id", "px", 1, 1), str(tmp_path / "runs"), 7)
    assert where.endswith("run_000007") and readers.linked(spark, [str(tmp_path / "runs")]).count() == 1


def test_generators(spark):
    df = generators.uniform_table(spark, 100, [{"name": "x", "start": 2.0, "end": 3.0, "func": lambda c: c * 10}], 1)
    low, high = df.agg(F.min("x"), F.max("x")).first()
    assert 20 <= low and high < 30 and df.count() == 100
    cat = generators.galaxy_catalogue(spark, (10.0, 12.0), (-1.0, 1.0), 5.0)
    assert cat.where("Cluster_ID = 0").count() == 100
    assert generators.gaussian_walk((0, 0), (0, 0, 2, 2), 5.0, 50).max() <= 1


def test_astro_inverses(spark):
    df = spark.createDataFrame([(0.1,), (0.7,)], "z double")
    back = df.select((astro.redshift_of_velocity(astro.velocity_of_redshift(F.col("z"))) - F.col("z")).alias("d"), (astro.apparent_magnitude(astro.absolute_magnitude(F.lit(20.0), F.col("z")), F.col("z")) - 20).alias("m"))
    assert all(abs(r.d) < 1e-9 and abs(r.m) < 1e-9 for r in back.collect())


@pytest.mark.parametrize(("n", "f_pass", "f_stop", "weights"), [(31, 0.05, 0.1, (1, 1)), (30, 0.05, 0.1, (1, 1)), (61, 0.05, 0.08, (1, 10)), (5, 0.1, 0.3, (1, 1)), (150, 0.1, 0.12, (3, 1))])
def test_taps_have_equal_ripples(n, f_pass, f_stop, weights):
    """Minimax: the weighted error reaches one height, in turning signs, once more often than there are free taps."""
    taps = kernels.fir_taps(n, f_pass, f_stop, weights)
    assert len(taps) == n and taps == pytest.approx(taps[::-1])
    f = [np.linspace(0, f_pass, 20000), np.linspace(f_stop, 0.5, 20000)]
    level = lambda f: np.cos(2 * np.pi * f[:, None] * (np.arange(n) - (n - 1) / 2)) @ taps
    error = np.concatenate([weights[0] * (1 - level(f[0])), -weights[1] * level(f[1])])
    height = np.abs(error).max()
    signs = np.sign(error[np.abs(error) > height * 0.995])
    assert 1 + np.count_nonzero(np.diff(signs)) >= (n + 1) // 2 + 1


def test_taps_that_cannot_be():
    for bad in ((31, 0.1, 0.05), (31, 0.0, 0.1), (2, 0.1, 0.2), (31, 0.1, 0.5)):
        with pytest.raises(ValueError):
            kernels.fir_taps(*bad)


def test_tec_low_pass():
    t = np.arange(0, 0.2, 15 / 86400)
    slow = 10 + 5 * t
    out = kernels.low_pass_tec(t, slow, 81, 3)
    assert np.nanmax(np.abs(out - slow)) < 1e-6
    with pytest.raises(ValueError):
        kernels.low_pass_tec(t, slow, 80, 3)


def test_vector_layers(spark):
    from tidewatch.operators import vectors

    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    schema = "feature_id int, shell array<struct<x:double,y:double>>, fields map<string,string>"
    a = polygons.bounding_box(spark.createDataFrame([(1, square(0.0, 0.0, 2.0), {"n": "a"}), (2, square(9.0, 9.0, 1.0), {})], schema))
    b = polygons.bounding_box(spark.createDataFrame([(7, square(1.0, 1.0, 2.0), {})], schema))
    got = vectors.intersect_layers(a, b).withColumn("area", polygons.shoelace(F.col("shell"))).collect()
    assert [(r.a_id, r.b_id, r.area, r.fields) for r in got] == [(1, 7, 1.0, {"n": "a"})]
    assert vectors.union_area(a, b).first().area == pytest.approx(4 + 1 + 4 - 1)
    union = vectors.union_layers(a, b).withColumn("area", F.abs(polygons.shoelace(F.col("shell")))).groupBy("a_id", "b_id").agg(F.round(F.sum("area"), 9).alias("area"))
    assert {(r.a_id, r.b_id): r.area for r in union.collect()} == {(1, 7): 1.0, (1, None): 3.0, (None, 7): 3.0, (2, None): 1.0}
    grown = vectors.buffer_features(a.where("feature_id = 1"), 1.0, 64).withColumn("area", polygons.shoelace(F.col("shell"))).first()
    assert grown.area == pytest.approx(4 + 8 + np.pi, rel=1e-3)
    line = vectors.borders(a.where("feature_id = 1").withColumn("holes", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))).first().line
    assert len(line) == 5 and line[0] == line[-1]
    assert vectors.effective_size(np.random.default_rng(0).normal(size=500)) == pytest.approx(500, rel=0.2)


@pytest.mark.parametrize(("window", "planet"), [(3, True), (5, True), (3, False), (5, False)])
def test_neighbour_std_at_borders(spark, window, planet):
    from tidewatch.operators import windows

    h, w, half = 5, 7, window // 2
    rng = np.random.default_rng(window)
    z = rng.normal(size=(h, w))
    cells = spark.createDataFrame([(1, j, i, None if (j, i) == (2, 3) else float(z[j, i])) for j in range(h) for i in range(w)], "raster_id long, j int, i int, value double")
    z[2, 3] = np.nan

    def at(j, i):
        if planet:
            over, i = not 0 <= j < h, i % w
            i = w - 1 - i if over else i
        else:
            i = -i - 1 if i < 0 else 2 * w - 1 - i if i >= w else i
        j = -j - 1 if j < 0 else 2 * h - 1 - j if j >= h else j
        return z[j, i]

    got = {(r.j, r.i): r.std for r in windows.neighbour_std(cells, h, w, window=window, planet=planet).collect()}
    assert len(got) == h * w
    for (j, i), s in got.items():
        near = [at(j + a, i + b) for a in range(-half, half + 1) for b in range(-half, half + 1)]
        assert s == pytest.approx(np.nanstd(near))
