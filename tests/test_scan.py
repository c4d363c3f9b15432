"""Recurrences over blocks against whole series, fits of the Gauss-Markov parameters, and the clip that makes them anew."""

import datetime as dt

import numpy as np
import pytest

from tidewatch.dataset import LABEL, TIME
from tidewatch.operators import kernels, scan

DAY = dt.date(2020, 1, 1)


def table(spark, series):
    """series: label -> list of (value, error)."""
    rows = [(label, DAY + dt.timedelta(days=k), None if v is None or np.isnan(v) else float(v), None if e is None else float(e)) for label, pairs in series.items() for k, (v, e) in enumerate(pairs)]
    return spark.createDataFrame(rows, f"{LABEL} string, {TIME} date, v double, e double").repartition(5)


def found(df, *columns):
    return {(r[LABEL], r[TIME]): [r[c] for c in columns] for r in df.collect()}


def near(a, b):
    assert a.keys() == b.keys()
    for k, want in b.items():
        for x, y in zip(a[k], want, strict=True):
            assert (x is None or np.isnan(x)) == (y is None or np.isnan(y)), k
            if x is not None and not np.isnan(x):
                assert x == pytest.approx(y, rel=1e-7, abs=1e-7), k


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    walk = lambda n: np.cumsum(rng.normal(size=n)) + rng.normal(0, 2, n)
    spiky = walk(130)
    spiky[[20, 60, 61]] += 60
    holes = walk(90)
    holes[rng.random(90) < 0.3] = np.nan
    late = walk(70)
    late[:25] = np.nan
    errors = lambda n: [float(x) if x > 0.2 else None for x in rng.gamma(2, 0.5, n)]
    series = {"spiky": spiky, "holes": holes, "late": late, "none": np.full(12, np.nan), "one": np.array([3.0])}
    return table(spark, {k: list(zip(v, errors(len(v)), strict=True)) for k, v in series.items()})


@pytest.mark.parametrize("rows", [7, 100])
def test_smoother_over_blocks(df, rows):
    for given in ({"noise": 4.0}, {"noise": 4.0, "error": "e"}, {"noise": None, "error": "e"}, {"noise": 4.0, "error": "e", "fill": False}):
        args = {"tau": 30.0, "variance": 50.0, "clip": 2.5} | given
        columns = ["v", *(["e"] if "error" in given else [])]
        near(found(scan.kalman_smooth(df, "v", rows=rows, **args), *columns), found(kernels.kalman_smooth(df, "v", **args), *columns))


def test_forward_and_rts_over_blocks(df):
    near(found(scan.kalman_forward(df, "v", rows=9), "state", "state_var"), found(kernels.kalman_forward(df, "v"), "state", "state_var"))
    near(found(scan.rts_smooth(df, "v", 20.0, 30.0, 4.0, rows=9), "v"), found(kernels.rts_smooth(df, "v", 20.0, 30.0, 4.0), "v"))


def test_fitted_smoother_over_blocks(spark):
    z, _ = kernels.simulate_fogm(150, 20.0, 4.0, 9.0, 2)
    z[70] += 80
    df = table(spark, {"a": [(v, None) for v in z]})
    args = {"tau": None, "variance": None, "noise": 1.0, "method": "igrid"}
    near(found(scan.kalman_smooth(df, "v", rows=40, **args), "v"), found(kernels.kalman_smooth(df, "v", **args), "v"))


def test_the_fitted_noise_is_used():
    """Noise assumed far too small: the smoother runs with what the two costs imply, and smooths better."""
    z, x = kernels.simulate_fogm(800, 20.0, 4.0, 9.0, 7)
    state, spread, _, (tau, variance, noise) = kernels.smooth_and_fit(z, None, None, 1.0)
    fit = kernels.fit_markov(z, 1.0)
    assert (tau, variance) == (fit.tau, fit.variance) and noise == pytest.approx(fit.variance / fit.variance_by_mean_square) and noise > 4
    again, _ = kernels.two_sided(z, tau, variance, noise)
    assert np.allclose(state, again)
    assumed, _ = kernels.two_sided(z, tau, variance, 1.0)
    assert np.std(state - x) < np.std(assumed - x)


def test_fit_is_made_anew_without_outliers():
    z, _ = kernels.simulate_fogm(300, 20.0, 4.0, 1.0, 8)
    spoilt = z.copy()
    spoilt[[50, 150, 250]] += 100
    found = kernels.smooth_and_fit(spoilt, None, None, 1.0, method="igrid")
    left = np.where(np.isnan(found[2]), np.nan, z)
    assert np.isnan(found[2][[50, 150, 250]]).all() and np.isnan(found[2]).sum() < 12
    assert found[3][1] < 0.2 * kernels.fit_markov(spoilt, 1.0, method="igrid").variance
    assert np.nanmax(np.abs(found[0] - left)) < 10


def test_costs_of_a_grid_are_those_of_single_passes():
    z, _ = kernels.simulate_fogm(120, 9.0, 4.0, 1.0, 3)
    z[[5, 6, 40]] = np.nan
    points = np.array([(2.0, 1.0), (10.0, 4.0), (50.0, 9.0), (-1.0, 2.0)])
    got = kernels.grid_costs(z, 1.5, 0.3, 100.0, points)
    want = [kernels.markov_costs(z, kernels.recursive_pass(z, 1.5, 0.3, 100.0, *kernels.markov_step(*p)), 1.5) for p in points[:3]]
    assert np.allclose(got[:3], want) and np.isnan(got[3]).all()


@pytest.mark.parametrize("method", ["brute", "igrid", "simple"])
def test_fits_come_near_the_least_cost(method):
    z, _ = kernels.simulate_fogm(400, 15.0, 9.0, 1.0, 6)
    fit = kernels.fit_markov(z, 1.0, 1e6, method)
    cost = lambda *p: kernels.grid_costs(z, 1.0, np.nanmedian(z), 1e6, np.array([p]))[0]
    dense = np.array([(t, v) for t in np.linspace(1, 400, 60) for v in np.linspace(0.1, 2 * np.var(z), 60)])
    least = np.nanmin(kernels.grid_costs(z, 1.0, np.nanmedian(z), 1e6, dense), axis=0)
    assert cost(fit.tau_by_likelihood, fit.variance)[1] <= least[1] + 0.05
    assert cost(fit.tau, fit.variance_by_mean_square)[0] <= least[0] * 1.05


def test_shrinking_grids():
    bowl = lambda p: (p[:, 0] - 3.3) ** 2 + (p[:, 1] + 1.2) ** 2
    at, value = kernels.shrinking_grid(bowl, np.array([0.0, -4.0]), np.array([8.0, 4.0]), tolerance=1e-3)
    assert at == pytest.approx([3.3, -1.2], abs=1e-2) and value < 1e-3
    # A least point in a corner is only reached by searching again around what was found.
    far = lambda p: (p[:, 0] - 9.5) ** 2 + (p[:, 1] - 1.0) ** 2
    once, _ = kernels.shrinking_grid(far, np.array([0.0, 0.0]), np.array([10.0, 10.0]), rounds=2)
    more = kernels.searched_again(far, np.array([0.0, 0.0]), np.array([10.0, 10.0]))
    assert np.hypot(*(more - [9.5, 1.0])) < 0.2 < np.hypot(*(once - [9.5, 1.0]))


def test_elements_compose_in_any_grouping():
    rng = np.random.default_rng(0)
    z = np.where(rng.random(40) < 0.2, np.nan, rng.normal(size=40))
    e = scan.steps(z, np.full(40, 2.0), 0.9, 0.5)
    whole = scan.composed(e)
    for cut in (1, 13, 39):
        assert np.allclose(scan.composed(e[:cut]).then(scan.composed(e[cut:])), whole)
    made = kernels.recursive_pass(np.concatenate([[np.nan], z]), 2.0, 1.0, 7.0, 0.9, 0.5)
    assert np.allclose(whole.of(1.0, 7.0), (made.state[-1], made.variance[-1]))
