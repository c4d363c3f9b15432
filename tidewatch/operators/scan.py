"""Gauss-Markov recurrences over blocks of a series, for labels that no task could hold.

A filter step on a state of unknown mean and variance is one of a family that is closed under
composition; five numbers describe a step as well as a whole block of them

    mean -> slope * mean' + shift,  variance -> slope^2 variance' + rest,

with (mean', variance') what is left of the incoming state once the block's own measurements
(``pull``, ``weight``) have had their say on it.  Rows are sorted over all tasks and cut into
blocks wherever they lie; each block is reduced to its five numbers; those, a row a block, are
composed in order for each label; then every block, knowing what comes in, runs on its own.
The pass back and the Rauch-Tung-Striebel pass (an affine map of the state to come) work alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME
from .kernels import Pass, fit_markov, markov_step, recursive_pass, sample_variance

PLACE = [LABEL, "part", "no"]
BLOCK = 50_000
ROUNDS = 11


class Element(NamedTuple):
    """What a run of steps does to a state: see the module."""

    slope: float
    shift: float
    rest: float
    pull: float
    weight: float

    def then(self, after: Element) -> Element:
        d = 1 + self.rest * after.weight
        return Element(
            after.slope * self.slope / d,
            after.slope * (self.shift + self.rest * after.pull) / d + after.shift,
            after.slope**2 * self.rest / d + after.rest,
            self.slope * (after.pull - after.weight * self.shift) / d + self.pull,
            self.slope**2 * after.weight / d + self.weight,
        )

    def of(self, state: float, variance: float) -> tuple[float, float]:
        """The state after the run, from the one before it."""
        d = 1 + variance * self.weight
        return self.slope * (state + variance * self.pull) / d + self.shift, self.slope**2 * variance / d + self.rest


NOTHING = Element(1.0, 0.0, 0.0, 0.0, 0.0)


def steps(z: np.ndarray, noise: np.ndarray, decay: float, added: float) -> list[Element]:
    """The elements of single rows; a missing row only predicts."""
    seen = ~np.isnan(z)
    spread = added + noise
    gain = np.where(seen, added / spread, 0.0)
    y = np.where(seen, z, 0.0)
    columns = ((1 - gain) * decay, gain * y, (1 - gain) * added, np.where(seen, decay * y / spread, 0.0), np.where(seen, decay**2 / spread, 0.0))
    return [Element(*row) for row in np.stack(columns, axis=1).tolist()]


def composed(elements: list[Element]) -> Element:
    return reduce(Element.then, elements, NOTHING)


def resumed(z: np.ndarray, noise: np.ndarray, state: float, variance: float, decay: float, added: float, begins: bool) -> Pass:
    """The pass over a block; the first row of a series holds the start."""
    if begins:
        return recursive_pass(z, noise, state, variance, decay, added)
    made = recursive_pass(np.concatenate([[np.nan], z]), np.concatenate([[0.0], noise]), state, variance, decay, added)
    return Pass(*(c[1:] for c in made))


# ---- blocks ---------------------------------------------------------------------------------------------------------


def blocks(df: DataFrame, columns: list[str], rows: int = BLOCK) -> DataFrame:
    """(label, part, no, at, columns as arrays): runs of at most ``rows`` rows of a label in the order of time, by task and place in it."""
    kind = df.schema[TIME].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, held = TaskContext.get().partitionId(), 0, []

        def block(pdf: pd.DataFrame) -> dict:
            return {LABEL: pdf[LABEL].iloc[0], "part": part, "no": no, "at": pdf[TIME].tolist(), **{c: pdf[c].to_numpy(float) for c in columns}}

        for batch in batches:
            for _, pdf in batch.groupby(LABEL, sort=False, dropna=False):
                if held and held[0][LABEL].iloc[0] != pdf[LABEL].iloc[0]:
                    yield pd.DataFrame([block(pd.concat(held))])
                    no, held = no + 1, []
                held.append(pdf)
                while sum(map(len, held)) >= rows:
                    whole = pd.concat(held)
                    yield pd.DataFrame([block(whole.iloc[:rows])])
                    no, held = no + 1, [whole.iloc[rows:]] if len(whole) > rows else []
        if held:
            yield pd.DataFrame([block(pd.concat(held))])

    laid = df.select(LABEL, TIME, *[F.col(c).cast("double").alias(c) for c in columns]).repartitionByRange(LABEL, TIME).sortWithinPartitions(LABEL, TIME)
    schema = ", ".join([f"{LABEL} string, part int, no int, at array<{kind}>", *[f"{c} array<double>" for c in columns]])
    return laid.mapInPandas(cut, schema).checkpoint()


def _array(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


_PARAMETERS = "tau double, variance double, noise double"
_ELEMENT = list(Element._fields)


def _reduced(blk: DataFrame, back: bool) -> DataFrame:
    """Blocks (label, part, no, z, r, tau, variance) as (label, part, no, first, rest): the element of the row at the block's end that a pass meets first, and of the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for z, r, tau, variance in zip(pdf["z"], pdf["r"], pdf["tau"], pdf["variance"], strict=True):
                z, r = _array(z), _array(r)
                decay, added = markov_step(tau, variance)
                ahead = steps(z, r, decay, added)
                row = [*ahead[0], *composed(ahead[1:])]
                if back:
                    turned = steps(z[::-1], r[::-1], 1 / decay, added / decay**2)
                    row += [*turned[0], *composed(turned[1:])]
                out.append(row)
            yield pd.DataFrame({**{c: pdf[c] for c in PLACE}, "e": out})

    return blk.select(*PLACE, "z", "r", "tau", "variance").mapInPandas(run, f"{LABEL} string, part int, no int, e array<double>")


def _incoming(elements: DataFrame, starts: DataFrame, back: bool, factor: float = 1e6) -> DataFrame:
    """(label, part, no, x, p, begins, bx, bp, ends): the state that comes into each block, forward from the label's start, and back from its end.

    ``starts``: (label, state, variance).  Only a few numbers of each block of a label meet here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"], ignore_index=True)
        e = np.stack(pdf["e"].to_numpy())
        state, variance = float(pdf["state"].iloc[0]), float(pdf["start_variance"].iloc[0])
        comes = []
        for k, row in enumerate(e):
            comes.append((state, variance))
            if k:
                state, variance = Element(*row[:5]).of(state, variance)
            state, variance = Element(*row[5:10]).of(state, variance)
        returns = [(np.nan, np.nan)] * len(e)
        if back:
            variance *= factor
            for k in range(len(e) - 1, -1, -1):
                returns[k] = (state, variance)
                if k < len(e) - 1:
                    state, variance = Element(*e[k][10:15]).of(state, variance)
                state, variance = Element(*e[k][15:20]).of(state, variance)
        at = np.arange(len(e))
        (x, p), (bx, bp) = (np.array(c, float).T for c in (comes, returns))
        return pd.DataFrame({**{c: pdf[c] for c in PLACE}, "x": x, "p": p, "begins": at == 0, "bx": bx, "bp": bp, "ends": at == len(e) - 1})

    schema = f"{LABEL} string, part int, no int, x double, p double, begins boolean, bx double, bp double, ends boolean"
    return elements.join(starts, LABEL).groupBy(LABEL).applyInPandas(run, schema)


def _outgoing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kernel: forward estimates of each block, as arrays."""
    for pdf in batches:
        made = [resumed(_array(z), _array(r), x, p, *markov_step(t, v), begins) for z, r, t, v, x, p, begins in zip(pdf["z"], pdf["r"], pdf["tau"], pdf["variance"], pdf["x"], pdf["p"], pdf["begins"], strict=True)]
        yield pd.DataFrame({**{c: pdf[c] for c in PLACE}, "at": pdf["at"], "state": [m.state for m in made], "spread": [m.variance for m in made]})


def _two_sided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kernel: estimates from both sides of each block, as arrays."""
    for pdf in batches:
        states, spreads = [], []
        for z, r, t, v, x, p, begins, bx, bp, ends in zip(*(pdf[c] for c in ("z", "r", "tau", "variance", "x", "p", "begins", "bx", "bp", "ends")), strict=True):
            z, r = _array(z), _array(r)
            decay, added = markov_step(t, v)
            ahead = resumed(z, r, x, p, decay, added, begins)
            back = resumed(z[::-1], r[::-1], bx, bp, 1 / decay, added / decay**2, ends).turned()
            weight = ahead.variance / (ahead.variance + back.predicted_variance)
            states.append(ahead.state + weight * (back.predicted - ahead.state))
            spreads.append(ahead.variance * (1 - weight))
        yield pd.DataFrame({**{c: pdf[c] for c in [*PLACE, "tau", "variance", "noise"]}, "at": pdf["at"], "z": pdf["z"], "state": states, "spread": spreads})


def _rows(blk: DataFrame, **arrays: str) -> DataFrame:
    """Blocks as rows again: (label, ts, and each array's elements under a name)."""
    row = F.explode(F.arrays_zip("at", *arrays.values())).alias("row")
    kept = [c for c in ("tau", "variance", "noise") if c in blk.columns]
    return blk.select(LABEL, *kept, row).select(LABEL, F.col("row.at").alias(TIME), *kept, *[F.col(f"row.{a}").alias(name) for name, a in arrays.items()])


def _time_is(df: DataFrame) -> str:
    return df.schema[TIME].dataType.simpleString()


# ---- operators ------------------------------------------------------------------------------------------------------


def kalman_forward(df: DataFrame, column: str, tau: float = 100.0, variance: float = 4.0, noise: float = 1.0, p0: float = 1e6, rows: int = BLOCK) -> DataFrame:
    """(label, ts, state, state_var) of the forward pass from state 0, over blocks of ``rows`` rows."""
    blk = blocks(df.select(LABEL, TIME, F.col(column).alias("z"), F.lit(noise).alias("r")), ["z", "r"], rows).withColumns({"tau": F.lit(tau), "variance": F.lit(variance)})
    starts = blk.select(LABEL).distinct().withColumns({"state": F.lit(0.0), "start_variance": F.lit(p0)})
    comes = _incoming(_reduced(blk, False), starts, False)
    made = blk.join(comes, PLACE).mapInPandas(_outgoing, f"{LABEL} string, part int, no int, at array<{_time_is(df)}>, state array<double>, spread array<double>")
    return _rows(made, state="state", state_var="spread")


def fitted(blk: DataFrame, noise: float, start: float, method: str, before: DataFrame | None) -> DataFrame:
    """(label, tau, variance, noise) fitted to each label's blocks; ``before`` has the noise found last.  A label's values meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"])
        z = np.concatenate([_array(v) for v in pdf["z"]])
        assumed = float(pdf["known_noise"].iloc[0])
        found = fit_markov(z, assumed, start, method) if not np.isnan(z).all() else (1.0, 1.0, assumed)
        return pd.DataFrame({LABEL: [pdf[LABEL].iloc[0]], "tau": [found[0]], "variance": [found[1]], "noise": [found[2]]})

    known = blk.select(*PLACE, "z").withColumn("known_noise", F.lit(noise)) if before is None else blk.select(*PLACE, "z").join(before.select(LABEL, F.col("noise").alias("known_noise")), LABEL)
    return known.groupBy(LABEL).applyInPandas(run, f"{LABEL} string, {_PARAMETERS}").checkpoint()


def smooth_blocks(blk: DataFrame, tau: float | None, variance: float | None, noise: float | None, start: float = 1e6, clip: float = 5.0, method: str = "brute", rounds: int = ROUNDS) -> DataFrame:
    """Blocks (label, part, no, at, z, r) with state, spread, tau, variance and noise.

    Values off by more than ``clip`` root mean squares of their label are taken out and all is made anew, parameters
    to be fitted included, until none is or ``rounds`` are done.  ``noise`` None keeps the noise of each row in r.
    """
    kind = blk.schema["at"].dataType.simpleString()
    schema = f"{LABEL} string, part int, no int, {_PARAMETERS}, at {kind}, z array<double>, state array<double>, spread array<double>"
    found = None
    for k in range(rounds):
        if tau is None or variance is None:
            found = fitted(blk, 1.0 if noise is None else noise, start, method, found)
            told = blk.join(found, LABEL)
        else:
            told = blk.withColumns({"tau": F.lit(float(tau)), "variance": F.lit(float(variance)), "noise": F.lit(None if noise is None else float(noise)).cast("double")})
        told = told.withColumn("r", F.transform("r", lambda v: F.coalesce(F.col("noise"), v)))
        median = blk.select(LABEL, F.explode("z").alias("v")).groupBy(LABEL).agg(F.median("v").alias("state")).withColumn("start_variance", F.lit(float(start)))
        comes = _incoming(_reduced(told, True), median.where("state IS NOT NULL"), True)
        made = told.join(comes, PLACE).mapInPandas(_two_sided, schema).checkpoint()
        if k == rounds - 1:
            return made
        off = F.transform(F.arrays_zip("z", "state"), lambda v: F.pow(v["z"] - v["state"], 2))
        square = made.select(LABEL, F.explode(off).alias("d")).groupBy(LABEL).agg((clip * clip * F.avg("d")).alias("most"))
        keep = F.zip_with("z", "state", lambda z, x: F.when(F.pow(z - x, 2) <= F.col("most"), z))
        left = made.join(square, LABEL).withColumn("z2", keep).withColumn("gone", F.exists(F.zip_with("z", "z2", lambda z, y: z.isNotNull() & y.isNull()), lambda g: g)).checkpoint()
        if not left.where("gone").limit(1).count():
            return made
        blk = blk.drop("z").join(left.select(*PLACE, F.col("z2").alias("z")), PLACE)
    return made


def kalman_smooth(df: DataFrame, column: str, error: str | None = None, tau: float | None = 100.0, variance: float | None = 4.0, noise: float | None = 1.0, clip: float = 5.0, fill: bool = True, method: str = "brute", rows: int = BLOCK) -> DataFrame:
    """As :func:`kernels.kalman_smooth`, over blocks of ``rows`` rows; a fit alone needs a label's values in one task."""
    e = F.col(error).cast("double") if error else F.lit(None).cast("double")
    data = df.select(LABEL, TIME, F.col(column).cast("double").alias("v"), e.alias("e"))
    whole = data.groupBy(LABEL).agg(F.median("e").alias("me"), F.count(F.lit(1)).alias("n"), F.min(TIME).alias("t0"))
    data = data.join(whole, LABEL).withColumn("far", F.coalesce(F.col("e") > clip * F.col("me"), F.lit(False)))
    data = data.withColumns({"z": F.when(~F.col("far"), F.col("v")), "e": F.when(~F.col("far"), F.col("e"))})
    some = data.groupBy(LABEL).agg(F.min(F.when(F.col("z").isNotNull(), F.col(TIME))).alias("known"), F.median("z").alias("mz"), F.min(F.when(F.col(TIME) > F.col("t0"), F.col(TIME))).alias("t1"), F.median("e").alias("me2"))
    data = data.join(some, LABEL)
    late = data.groupBy(LABEL).agg(F.count(F.when(F.col(TIME) < F.col("known"), 1)).alias("before"))
    data = data.join(late, LABEL)
    # A label that begins with nothing gets two values to start from.
    begin = (F.col("before") >= 20) & (F.col("n") > 20) & ((F.col(TIME) == F.col("t0")) | (F.col(TIME) == F.col("t1")))
    data = data.withColumns({"z": F.when(begin, F.col("mz")).otherwise(F.col("z")), "r": F.pow(F.coalesce("e", "me2", F.lit(1.0)), 2)})
    blk = blocks(data, ["z", "r", "v", "e", "n"], rows)
    made = smooth_blocks(blk.select(*PLACE, "at", "z", "r"), tau, variance, noise, clip=clip, method=method)
    both = blk.drop("z", "r", "at").join(made, PLACE)
    size = F.pandas_udf(lambda s, t, n: pd.Series([sample_variance(*x) for x in zip(s, t, n.astype(int), strict=True)]), "double")
    row = _rows(both.withColumn("extra", size("variance", "tau", F.get("n", F.lit(0)))).withColumn("extra", F.array_repeat("extra", F.size("at"))), v="v", e="e", state="state", spread="spread", extra="extra")
    smooth = F.col("state") if fill else F.when(F.col("v").isNotNull(), F.col("state"))
    wide = F.sqrt(F.pow(F.coalesce("e", "spread"), 2) + F.col("extra"))
    out = row.select(LABEL, TIME, smooth.alias(column), *([(wide if fill else F.when(F.col("v").isNotNull(), wide).otherwise(F.col("e"))).alias(error)] if error else []))
    # Labels without a value stay as they are.
    none = data.where("mz IS NULL").select(LABEL, TIME, F.col("v").alias(column), *([F.col("e").alias(error)] if error else []))
    return out.unionByName(none)


def rts_smooth(df: DataFrame, column: str, tau: float = 100.0, variance: float = 4.0, noise: float = 1.0, rows: int = BLOCK) -> DataFrame:
    """As :func:`kernels.rts_smooth`, over blocks of ``rows`` rows."""
    decay, added = markov_step(tau, variance)
    blk = blocks(df.select(LABEL, TIME, F.col(column).alias("z"), F.lit(noise).alias("r")), ["z", "r"], rows).withColumns({"tau": F.lit(tau), "variance": F.lit(variance)})
    known = df.where(F.col(column).isNotNull()).groupBy(LABEL).agg(F.min_by(F.col(column).cast("double"), TIME).alias("state")).withColumn("start_variance", F.lit(1e3))
    # The start lies before the first row here, so that row is a step as well.
    elements = _reduced(blk, False).withColumn("e", F.concat(F.array(*[F.lit(float(v)) for v in NOTHING]), "e"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(e=[[*NOTHING, *Element(*e[5:10]).then(Element(*e[10:15]))] for e in pdf["e"]])

    elements = elements.groupBy(*PLACE).applyInPandas(whole, elements.schema)
    comes = _incoming(elements, known, False).select(*PLACE, "x", "p")
    held = blk.join(comes, PLACE)

    def ahead(z, r, x, p) -> tuple[Pass, np.ndarray, np.ndarray]:
        made = resumed(_array(z), _array(r), x, p, decay, added, False)
        gain = made.variance * decay / (decay * decay * made.variance + added)
        return made, gain, made.state - gain * decay * made.state

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state at a block's first row as a line in the state after its last; for a label's last block that row itself is the start."""
        for pdf in batches:
            out = []
            for z, r, x, p in zip(pdf["z"], pdf["r"], pdf["x"], pdf["p"], strict=True):
                made, gain, own = ahead(z, r, x, p)
                slope, shift, tail = 1.0, 0.0, float(made.state[-1])
                for g, c in zip(gain[::-1], own[::-1], strict=True):
                    slope, shift = g * slope, g * shift + c
                for g, c in zip(gain[-2::-1], own[-2::-1], strict=True):
                    tail = g * tail + c
                out.append([slope, shift, tail])
            yield pd.DataFrame({**{c: pdf[c] for c in PLACE}, "m": out})

    def returns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"], ignore_index=True)
        after, state = [np.nan] * len(pdf), np.nan
        for k in range(len(pdf) - 1, -1, -1):
            slope, shift, tail = pdf["m"].iloc[k]
            after[k] = state
            state = tail if k == len(pdf) - 1 else slope * state + shift
        return pd.DataFrame({**{c: pdf[c] for c in PLACE}, "after": after, "last": [k == len(pdf) - 1 for k in range(len(pdf))]})

    after = held.mapInPandas(maps, f"{LABEL} string, part int, no int, m array<double>").groupBy(LABEL).applyInPandas(returns, f"{LABEL} string, part int, no int, after double, last boolean")

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for z, r, x, p, later, last in zip(*(pdf[c] for c in ("z", "r", "x", "p", "after", "last")), strict=True):
                made, gain, own = ahead(z, r, x, p)
                s = np.empty(len(own))
                state = later
                for i in range(len(own) - 1, -1, -1):
                    state = made.state[i] if last and i == len(own) - 1 else gain[i] * state + own[i]
                    s[i] = state
                out.append(s)
            yield pd.DataFrame({**{c: pdf[c] for c in PLACE}, "at": pdf["at"], "s": out})

    smooth = _rows(held.join(after, PLACE).mapInPandas(back, f"{LABEL} string, part int, no int, at array<{_time_is(df)}>, s array<double>"), **{column: "s"})
    none = df.join(known.select(LABEL), LABEL, "left_anti").select(LABEL, TIME, F.col(column).cast("double").alias(column))
    return smooth.unionByName(none)
