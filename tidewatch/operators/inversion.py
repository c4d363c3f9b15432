"""Buried sources found from the displacements of stations, for all groups of stations and all source models at once.

Levenberg-Marquardt in rounds: Spark sums the normal equations of every (group, model) over its stations, a small
batch step solves five unknowns a row.  Stations are never gathered, so a group may hold any number of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import LABEL, written
from ..functions.deformation import MODELS
from .decomposition import arctan_amplitudes
from .source_numpy import displacement

NAMES = ("lat", "lon", "depth", "amplitude", "extra")
#: What one of each unknown is counted in, and the step of its slope in that unit.
UNITS = (1.0, 1.0, 1.0, 1e-4, 1.0)
STEPS = (1e-6, 1e-6, 1e-5, 1e-4, 1e-5)
#: Depth (km), amplitude and extra length (km) that a search starts from.
START = (5.0, 1e-4, 1.0)

_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def _sums(stations: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_cost, new_normal, new_slope) of the trials of all searches that still run; each batch of stations sends one row a search."""
    tried = stations.join(state.where("NOT done").select(*keys, *[F.col("trial")[k].alias(f"q{k}") for k in range(5)]), keys[0])
    names = ["new_cost", *[f"n{i}{j}" for i, j in _PAIRS], *[f"s{i}" for i in range(5)]]

    def measure(batches):
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                seen, q = part[["east", "north", "up"]].to_numpy(float), part[[f"q{k}" for k in range(5)]].to_numpy(float).T
                moved = lambda q: displacement(model, part["lat"].to_numpy(float), part["lon"].to_numpy(float), q * np.array(UNITS)[:, None])  # noqa: E731, B023
                with np.errstate(all="ignore"):
                    base = moved(q)
                    left = seen - base
                    slope = [(moved(q + step * (np.arange(5) == k)[:, None]) - base) / step for k, step in enumerate(STEPS)]
                    made = [(left * left).sum(1), *[(slope[i] * slope[j]).sum(1) for i, j in _PAIRS], *[(slope[i] * left).sum(1) for i in range(5)]]
                sums = pd.DataFrame(np.array(made).T, columns=names).assign(**{k: part[k].to_numpy() for k in keys})
                yield sums.groupby(keys, as_index=False)[names].sum(min_count=1)[[*keys, *names]]

    schema = ", ".join([f"`{k}` {state.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} double" for c in names])
    whole = tried.mapInPandas(measure, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return whole.select(*keys, "new_cost", F.array(*[f"n{i}{j}" for i, j in _PAIRS]).alias("new_normal"), F.array(*[f"s{i}" for i in range(5)]).alias("new_slope"))


def _step(normal: np.ndarray, slope: np.ndarray, damping: float) -> np.ndarray:
    a = np.zeros((5, 5))
    for (i, j), v in zip(_PAIRS, normal, strict=True):
        a[i, j] = a[j, i] = v
    d = np.diag(a).copy()
    free = d > 0  # a model without an extra length has no slope there
    out = np.zeros(5)
    scale = np.sqrt(d[free])
    b = a[np.ix_(free, free)] / np.outer(scale, scale) + damping * np.eye(free.sum())
    out[free] = np.linalg.lstsq(b, slope[free] / scale, rcond=None)[0] / scale
    return out


def _fitted_amplitude(row: dict) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Cost, unknowns, normal equations and slope of a trial after its amplitude, in which all models are linear, is put to its best value."""
    q, a, s = np.array(row["trial"], float), np.zeros((5, 5)), np.array(row["new_slope"], float)
    for (i, j), v in zip(_PAIRS, row["new_normal"], strict=True):
        a[i, j] = a[j, i] = v
    cost = row["new_cost"]
    if np.isfinite(cost) and a[3, 3] > 0 and q[3] != 0:
        more = s[3] / a[3, 3]
        by = np.full(5, (q[3] + more) / q[3])
        by[3] = 1.0
        cost, s, a = max(cost - s[3] * more, 0.0), by * (s - a[:, 3] * more), a * np.outer(by, by)
        s[3] = 0.0
        q[3] += more
    return cost, q, np.array([a[i, j] for i, j in _PAIRS]), s


def _advanced(row: dict, tolerance: float) -> dict:
    """One search after its trial was measured: taken if it costs less, else tried again with more damping."""
    if row["done"] or row["new_normal"] is None:
        return row | {"done": True}
    cost, q, normal, slope = _fitted_amplitude(row)
    if np.isfinite(cost) and not cost >= row["cost"]:
        little = np.isfinite(row["cost"]) and row["cost"] - cost <= 1e-6 * row["cost"]
        row |= {"p": list(q), "cost": cost, "normal": list(normal), "slope": list(slope), "damping": max(row["damping"] / 5, 1e-15)}
        row["done"] = row["converged"] = bool(little or cost <= tolerance * row["size"])
    else:
        row["damping"] *= 3
        row["done"] = row["damping"] > 1e6
        row["converged"] = bool(row["done"] and np.isfinite(row["cost"]))
    if not row["done"] and np.isfinite(row["cost"]):
        q = np.asarray(row["p"], float) + _step(np.asarray(row["normal"], float), np.asarray(row["slope"], float), row["damping"])
        q[2] = max(q[2], row["p"][2] / 3)  # a source stays below ground
        row["trial"] = list(q)
    return row


def invert_sources(stations: DataFrame, models: list[str] | DataFrame | None = None, group: str = LABEL, min_stations: int = 5, rounds: int = 60, tolerance: float = 1e-18) -> DataFrame:
    """(group, model, lat, lon, depth, amplitude, extra, misfit, n_stations, converged): the source of least squared misfit for every group and model.

    ``stations`` has the group, lat, lon (degrees) and east, north, up (km); rows with a missing number are left out, and
    so are groups of fewer than ``min_stations`` rows.  ``models`` are names for all groups (none: every model) or a table
    (group, model) of the searches wanted.  ``misfit`` is the root of the mean squared difference; ``extra`` is null
    where the model has no extra length.  A search begins in the middle of its stations and ends when a round gains
    less than 1e-6 of the cost or the cost falls to ``tolerance`` of the displacements' squares; searches that do
    neither in ``rounds`` rounds have ``converged`` false.
    """
    wanted, models = (models, sorted(MODELS)) if isinstance(models, DataFrame) else (None, sorted(MODELS) if models is None else list(models))
    if unknown := set(models) - set(MODELS):
        raise ValueError(f"no source model {sorted(unknown)}; there are {sorted(MODELS)}")
    numbers = ["lat", "lon", "east", "north", "up"]
    given = written(stations.select(group, *[F.col(c).cast("double").alias(c) for c in numbers]))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) for c in numbers]
    known = given.where(finite[0] & finite[1] & finite[2] & finite[3] & finite[4])
    keys = [group, "model"]
    size = F.col("east") ** 2 + F.col("north") ** 2 + F.col("up") ** 2
    middle = lambda c: (F.min(c) + F.max(c)) / 2
    whole = known.groupBy(group).agg(middle("lat").alias("_lat"), middle("lon").alias("_lon"), F.sum(size).alias("size"), F.count(F.lit(1)).alias("n_stations")).where(F.col("n_stations") >= min_stations)
    begin = F.array("_lat", "_lon", *[F.lit(v / u) for v, u in zip(START, UNITS[2:], strict=True)])
    none, never = F.lit(None).cast("array<double>"), F.lit(float("inf"))
    asked = whole.withColumn("model", F.explode(F.array(*map(F.lit, models)))) if wanted is None else whole.join(wanted.select(group, "model").where(F.col("model").isin(models)).distinct(), group)
    state = asked.select(group, "model", "size", "n_stations", begin.alias("p"), never.alias("cost"), none.alias("normal"), none.alias("slope"), F.lit(1e-2).alias("damping"), begin.alias("trial"), F.lit(False).alias("done"), F.lit(False).alias("converged"))
    state = written(state)
    fields = state.columns

    def advance(batches):
        for pdf in batches:
            rows = [_advanced(row, tolerance) for row in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=pdf.columns)[fields]

    for _ in range(rounds):
        measured = state.join(_sums(known, state, keys), keys, "left")
        state = written(measured.mapInPandas(advance, state.schema))
        if not state.where("NOT done").limit(1).count():
            break
    found = [(F.col("p")[k] * unit).alias(name) for k, (name, unit) in enumerate(zip(NAMES[:4], UNITS, strict=False))]
    extra = F.when(F.col("model").isin([m for m in models if MODELS[m][1]]), F.col("p")[4]).alias("extra")
    return state.select(*keys, *found, extra, F.sqrt(F.col("cost") / (3 * F.col("n_stations"))).alias("misfit"), "n_stations", "converged")


def invert_series(df: DataFrame, places: DataFrame, t0: float, c: float, north: str = "dN", east: str = "dE", up: str = "dU", unit: float = 1e-6, models: list[str] | DataFrame | None = None, group: str | None = None, **search) -> DataFrame:
    """:func:`invert_sources` of the event at ``t0`` of duration ``c`` (rows) in the stations' series: each direction's amplitude by ``unit`` km.

    ``places`` has label, lat, lon and, where the stations form several groups, the column ``group``.
    """
    moved = arctan_amplitudes(df, [north, east, up], t0, c).groupBy(LABEL).pivot("name", [north, east, up]).agg(F.first("amplitude") * unit)
    at = places if group else places.withColumn("group", F.lit("all"))
    stations = moved.toDF(LABEL, "north", "east", "up").join(at, LABEL)
    return invert_sources(stations, models, group or "group", **search)
