"""Overlay, outlines and buffers of concave rings with holes, in places where edges touch or lie on each other."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import polygons
from tidewatch.operators import overlay, vectors, voronoi
from tidewatch.operators import trapezoids as T

RING = "array<struct<x:double,y:double>>"
C = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 4.0), (0.0, 4.0)]
FRAME = ([(10.0, 0.0), (10.0, 4.0), (14.0, 4.0), (14.0, 0.0)], [[(11.0, 1.0), (13.0, 1.0), (13.0, 3.0), (11.0, 3.0)]])


def layer(spark, shapes):
    rows = [(k, s, h, {"n": str(k)}) for k, (s, h) in shapes.items()]
    return polygons.bounding_box(spark.createDataFrame(rows, f"feature_id int, shell {RING}, holes array<{RING}>, fields map<string,string>"))


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)], []


def areas(df, *keys):
    found = df.groupBy(*keys).agg(F.sum(F.abs(polygons.shoelace(F.col("shell")))).alias("area")).collect()
    return {tuple(r[k] for k in keys): pytest.approx(r.area, abs=1e-9) for r in found if r.area > 1e-9}


def test_notches_and_holes(spark):
    a = layer(spark, {1: (C, []), 2: FRAME, 3: square(50.0, 50.0, 1.0)})
    b = layer(spark, {7: ([(2.0, -1.0), (6.0, -1.0), (6.0, 5.0), (2.0, 5.0)], []), 8: ([(12.0, 2.0), (18.0, 2.0), (12.0, 8.0)], [])})
    assert areas(vectors.intersect_layers(a, b), "a_id", "b_id") == {(1, 7): 4.0, (2, 8): 3.0}
    assert areas(vectors.subtract_layers(a, b), "a_id") == {(1,): 6.0, (2,): 9.0, (3,): 1.0}
    assert areas(vectors.union_layers(a, b), "a_id", "b_id") == {(1, 7): 4.0, (2, 8): 3.0, (1, None): 6.0, (2, None): 9.0, (3, None): 1.0, (None, 7): 20.0, (None, 8): 15.0}
    parts = vectors.outlines(vectors.intersect_layers(a, b), ["a_id", "b_id"]).collect()
    assert sorted((r.a_id, len(r.shell)) for r in parts) == [(1, 4), (1, 4), (2, 6)]


def test_shared_borders_and_equal_features(spark):
    """Neighbours on a grid of thirds, the same layer twice, one layer reversed: no slivers, no gaps."""
    cells = {3 * i + j: square(i / 3, j / 3, 1 / 3) for i in range(3) for j in range(3)}
    a = layer(spark, cells)
    turned = layer(spark, {k: (s[::-1], []) for k, (s, _) in cells.items()})
    assert areas(vectors.intersect_layers(a, turned), "a_id", "b_id") == {(k, k): 1 / 9 for k in cells}
    assert areas(vectors.subtract_layers(a, turned), "a_id") == {}
    whole = layer(spark, {1: square(0.0, 0.0, 1.0)})
    assert areas(vectors.subtract_layers(whole, a), "a_id") == {}
    ring = vectors.outlines(vectors.intersect_layers(whole, a), ["a_id"]).collect()
    assert len(ring) == 1 and len(ring[0].shell) == 4 and not ring[0].holes
    assert vectors.union_area(whole, a).first().area == pytest.approx(1.0)


def test_pieces_of_a_frame_give_its_hole_back(spark):
    a = layer(spark, {2: FRAME})
    parts = vectors.outlines(vectors.intersect_layers(a, layer(spark, {1: square(0.0, -10.0, 40.0)})), ["a_id"]).collect()
    assert len(parts) == 1 and len(parts[0].holes) == 1
    assert {(p.x, p.y) for p in parts[0].holes[0]} == set(FRAME[1][0]) and {(p.x, p.y) for p in parts[0].shell} == set(FRAME[0])


def test_empty_layers(spark):
    a, none = layer(spark, {1: (C, [])}), layer(spark, {1: (C, [])}).where("false")
    assert vectors.intersect_layers(a, none).count() == 0 and vectors.subtract_layers(none, a).count() == 0
    assert areas(vectors.subtract_layers(a, none), "a_id") == {(1,): 10.0}


def test_box_pairs_of_houses_and_a_country(spark):
    rng = np.random.default_rng(4)
    shapes = {k: square(*map(float, rng.uniform(0, 1000, 2)), float(rng.choice([0.01, 0.5, 3, 400]))) for k in range(200)}
    other = {k: square(*map(float, rng.uniform(-50, 1000, 2)), float(rng.choice([0.0, 2, 60, 5000]))) for k in range(60)}
    box = lambda s: (s[0][0], s[0][1], s[2][0], s[2][1])
    want = {(i, k) for i, (s, _) in shapes.items() for k, (t, _) in other.items() if box(s)[0] <= box(t)[2] and box(t)[0] <= box(s)[2] and box(s)[1] <= box(t)[3] and box(t)[1] <= box(s)[3]}
    got = [(r.a_id, r.b_id) for r in overlay.box_pairs(layer(spark, shapes), layer(spark, other)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_large_features_go_through_joins(spark, monkeypatch):
    monkeypatch.setattr(overlay, "CORNERS", 3)  # of these, all but the triangle are large
    a = layer(spark, {1: (C, []), 2: FRAME, 3: square(50.0, 50.0, 1.0)})
    b = layer(spark, {7: ([(2.0, -1.0), (6.0, -1.0), (6.0, 5.0), (2.0, 5.0)], []), 8: ([(12.0, 2.0), (18.0, 2.0), (12.0, 8.0)], [])})
    assert {(r.a_id, r.b_id): r.area for r in vectors.intersection_areas(a, b).collect()} == {(1, 7): pytest.approx(4.0), (2, 8): pytest.approx(3.0)}
    assert {r.a_id: r.area for r in vectors.difference_areas(a, b).collect()} == {1: pytest.approx(6.0), 2: pytest.approx(9.0), 3: pytest.approx(1.0)}
    assert sorted((r.a_id, len(r.shell), len(r.holes)) for r in vectors.intersection_outlines(a, b).collect()) == [(1, 4, 0), (1, 4, 0), (2, 6, 0)]


def test_array_kernels_against_unions():
    """Many features on top of each other: a common part is what two have less their union, a rest what a union grows by."""
    rng = np.random.default_rng(8)
    ring = lambda x, y, r, n, notch: [{"x": x + r * (notch if k % 2 else 1) * np.cos(2 * np.pi * k / n + r), "y": y + r * (notch if k % 2 else 1) * np.sin(2 * np.pi * k / n + r)} for k in range(n)]
    rings = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def made(n):
        at = rng.uniform((0, 0, 0.5), (6, 6, 1.5), (n, 3))
        return pa.array([ring(x, y, r, 10, 0.5) for x, y, r in at], rings), pa.array([[ring(x, y, 0.3 * r, 4, 1.0)] for x, y, r in at], pa.list_(rings))

    a, b = made(30), made(60)
    whole = lambda *sides: T.area(T.plain(T.sweep(np.zeros(sum(len(s[2]) for s in sides), int), *(np.concatenate(c) for c in list(zip(*sides, strict=True))[1:]))[1])).sum()
    pick = lambda f, k: tuple(v[f[0] == k] for v in f)
    ea, eb = T.feature_edges(*a), T.feature_edges(*b)
    own, other = T.features(*a), T.features(*b)
    i, k = np.nonzero(T.meet(own.hulls()[:, None], other.hulls()[None]))
    found, traced = np.zeros(len(i)), np.zeros(len(i))
    for pair, piece in T.common(own, other, i, k):
        np.add.at(found, pair, T.area(piece))
        g, _, shells, holes = T.outlines(pair, piece, 9, overlay.trace, overlay._inside)
        size = lambda rs: sum(x * v - u * y for r in rs for (x, y), (u, v) in zip(r, r[1:] + r[:1], strict=True)) / 2
        for p, s, h in zip(g, shells.to_pylist(), holes.to_pylist(), strict=True):
            traced[p] += size([[(c["x"], c["y"]) for c in r] for r in [s, *h]])
    want = [whole(pick(ea, x)) + whole(pick(eb, y)) - whole(pick(ea, x), pick(eb, y)) for x, y in zip(i, k, strict=True)]
    assert len(i) > 300 and found == pytest.approx(want, abs=1e-9) and traced == pytest.approx(want, abs=1e-7)
    rest = T.less(own, other, window=3)
    left = np.bincount(rest.owner, T.area(T.plain(rest.at)), own.n)
    assert left == pytest.approx([whole(pick(ea, x), eb) - whole(eb) for x in range(own.n)], abs=1e-9) and 0 < (left > 1e-9).sum()


def test_buffer_holds_what_is_near(spark):
    """Points clearly nearer than the distance lie inside, points clearly farther outside; a small hole closes."""
    shape = {1: (C, []), 2: (FRAME[0], [FRAME[1][0], [(10.3, 0.3), (10.6, 0.3), (10.6, 0.6), (10.3, 0.6)]])}
    features = layer(spark, shape)
    grown = vectors.buffer_features(features, 0.25, 16)
    assert {r.feature_id: len(r.holes) for r in grown.collect()} == {1: 0, 2: 1}
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform((-1, -1), (15, 5), (4000, 2))], "x double, y double")
    at = points.crossJoin(features.select("feature_id", F.col("shell").alias("s"), F.col("holes").alias("h"))).join(grown, "feature_id")
    x, y = F.col("x"), F.col("y")
    told = at.select(F.when(polygons.contains(x, y, F.col("s"), F.col("h")), 0.0).otherwise(polygons.distance_to_edges(x, y, F.col("s"), F.col("h"))).alias("d"), polygons.contains(x, y, F.col("shell"), F.col("holes")).alias("inside"))
    rows = told.where("abs(d - 0.25) > 0.002").collect()
    assert len(rows) > 7000 and all(r.inside == (r.d < 0.25) for r in rows)
    with pytest.raises(ValueError):
        vectors.buffer_features(features, -1.0)


def test_voronoi_cells_hold_what_is_nearest(spark):
    rng = np.random.default_rng(3)
    places = [(k, float(np.degrees(np.arcsin(z))), float(lon)) for k, (z, lon) in enumerate(zip(rng.uniform(-1, 1, 40), rng.uniform(-180, 180, 40), strict=True))]
    places += [(100 + k, float(60 + rng.uniform(0, 0.2)), float(20 + rng.uniform(0, 0.4))) for k in range(25)] + [(900, 90.0, 0.0), (901, *places[0][1:])]
    df = spark.createDataFrame(places, "site int, lat double, lon double")
    cells = voronoi.voronoi_cells(df).collect()
    assert len(cells) == len(places) - 1 and all(c.final for c in cells)  # two at one place
    assert sum(c.area for c in cells) == pytest.approx(4 * np.pi)
    sites = {c.site: np.array([np.cos(np.radians(c.lat)) * np.cos(np.radians(c.lon)), np.cos(np.radians(c.lat)) * np.sin(np.radians(c.lon)), np.sin(np.radians(c.lat))]) for c in cells}
    every = np.array(list(sites.values()))
    for c in cells:
        ring = np.array([(v.x, v.y, v.z) for v in c.corners])
        own = ring @ sites[c.site]
        assert np.allclose((ring @ every.T).max(axis=1), own, atol=1e-9)  # no site is nearer to a corner
        assert ((np.abs(ring @ every.T - own[:, None]) < 1e-9).sum(axis=1) >= 3).all()  # and three are as near


def test_voronoi_of_few_sites(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 170.0)], "site int, lat double, lon double")
    assert {c.site: c.final for c in voronoi.voronoi_cells(df).collect()} == {1: False, 2: False}  # half a sphere each
    assert voronoi.voronoi_cells(df.where("site = 1")).first().final is False
    assert voronoi.voronoi_cells(df.where("false")).count() == 0
