"""Sources over tables against the array forms, noise, missing numbers and small groups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import deformation
from tidewatch.operators import inversion, source_numpy

COLUMNS = "label string, lat double, lon double, east double, north double, up double"


def stations(label, model, p, n=40, seed=0, noise=0.0):
    rng = np.random.default_rng(seed)
    lat, lon = p[0] + rng.uniform(-0.2, 0.2, n), p[1] + rng.uniform(-0.2, 0.2, n)
    u = source_numpy.displacement(model, lat, lon, np.array(p)) + rng.normal(0, noise, (n, 3))
    return [(label, float(a), float(b), *map(float, v)) for a, b, v in zip(lat, lon, u, strict=True)]


def test_groups_and_models_at_once(spark):
    """Two groups under all six models: the model that made the displacements misfits least, and finds its source."""
    p, q = [1.0, 2.0, 6.0, 2e-4], [-3.0, 4.0, 5.5, -1e-4, 1.5]
    rows = stations("a", "mogi", p) + stations("b", "closed_pipe", q, seed=1)
    got = {(r.label, r.model): r for r in inversion.invert_sources(spark.createDataFrame(rows, COLUMNS), rounds=25).collect()}
    assert set(got) == {(g, m) for g in "ab" for m in deformation.MODELS}
    assert min((r.misfit, m) for (g, m), r in got.items() if g == "b")[1] == "closed_pipe"
    a, b = got["a", "mogi"], got["b", "closed_pipe"]
    assert [a.lat, a.lon, a.depth, a.amplitude] == pytest.approx(p, rel=1e-6) and a.extra is None and a.converged and a.n_stations == 40
    assert [b.lat, b.lon, b.depth, b.amplitude, b.extra] == pytest.approx(q, rel=1e-4)


def test_noise_missing_numbers_and_small_groups(spark):
    p = [1.0, 2.0, 6.0, 2e-4]
    rows = stations("a", "mogi", p, 300, noise=1e-7) + stations("few", "mogi", p, 4)
    rows += [("a", None, 2.0, 1.0, 1.0, 1.0), ("a", 1.0, 2.0, float("nan"), 1.0, 1.0), ("a", 1.0, 2.0, 1.0, 1.0, None)]
    r = inversion.invert_sources(spark.createDataFrame(rows, COLUMNS), ["mogi"]).collect()
    assert [x.label for x in r] == ["a"] and r[0].n_stations == 300
    assert [r[0].lat, r[0].lon, r[0].depth, r[0].amplitude] == pytest.approx(p, rel=0.02) and 0.5e-7 < r[0].misfit < 2e-7
    assert inversion.invert_sources(spark.createDataFrame([], COLUMNS)).count() == 0
    with pytest.raises(ValueError):
        inversion.invert_sources(spark.createDataFrame([], COLUMNS), ["x"])


def test_from_series(spark):
    """The source of an event seen in the stations' series."""
    p = [0.5, 1.0, 5.0, 3e-4]
    at = stations("s", "sill", p, 12, seed=3)
    day, t = dt.date(2020, 1, 1), np.arange(60)
    shape = np.arctan((t - 30) / 4.0) / np.pi
    rows = [(f"s{k:02d}", day + dt.timedelta(days=int(i)), float(v[4] * s / 1e-6), float(v[3] * s / 1e-6), float(v[5] * s / 1e-6)) for k, v in enumerate(at) for i, s in zip(t, shape, strict=True)]
    df = spark.createDataFrame(rows, "label string, ts date, dN double, dE double, dU double")
    places = spark.createDataFrame([(f"s{k:02d}", v[1], v[2]) for k, v in enumerate(at)], "label string, lat double, lon double")
    r = inversion.invert_series(df, places, 30.0, 4.0, models=["sill"]).first()
    assert [r.lat, r.lon, r.depth, r.amplitude] == pytest.approx(p, rel=1e-4)
