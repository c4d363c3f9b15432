"""Pipelines of parameterised stages: alternatives, incremental chains, perturbed runs, provenance.

A stage is a function of (Dataset, parameter values); a pipeline run is one lazy plan, and
all runs of a grid are the union of their plans with a ``run_id``.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset


class Param:
    """A value that a run may perturb: from ``choices`` at random, or within ``bounds``."""

    def __init__(self, value, choices=None, bounds=None):
        self.initial = self.value = value
        self.choices, self.bounds = list(choices or ()), bounds

    def __call__(self):
        return self.value

    def perturb(self, rng: random.Random) -> None:
        if self.choices:
            self.value = rng.choice(self.choices)
        elif self.bounds:
            low, high = self.bounds
            self.value = rng.uniform(low, high) if isinstance(low, float) or isinstance(high, float) else rng.randint(low, high)

    def reset(self) -> None:
        self.value = self.initial

    def __str__(self) -> str:
        return str(self.value)


class ParamList(Param):
    """Several parameters at once: each element is perturbed on its own."""

    def __init__(self, params):
        super().__init__([p.value for p in params])
        self.params = list(params)

    def __call__(self):
        return [p() for p in self.params]

    def perturb(self, rng):
        for p in self.params:
            p.perturb(rng)

    def reset(self):
        for p in self.params:
            p.reset()

    def __str__(self):
        return str(self())


class ParamCycle(Param):
    """Walks through its values, one a run."""

    def __init__(self, values):
        super().__init__(values[0])
        self.values, self.at = list(values), 0

    def perturb(self, rng):
        self.at = (self.at + 1) % len(self.values)
        self.value = self.values[self.at]

    def reset(self):
        self.at, self.value = 0, self.values[0]


class Stage:
    """One item: a description, an operator and its parameters."""

    kind = "SC"

    def __init__(self, description: str, operator: Callable[..., Dataset], *params: Param, needs: tuple[str, ...] = ()):
        self.description, self.operator, self.params, self.needs = description, operator, params, needs

    def apply(self, data: Dataset) -> Dataset:
        return self.operator(data, *(p() for p in self.params))

    def perturb(self, rng: random.Random) -> None:
        for p in self.params:
            p.perturb(rng)

    def reset(self) -> None:
        for p in self.params:
            p.reset()

    def metadata(self) -> str:
        return f"{self.description}[{', '.join(map(str, self.params))}]"

    def stages(self) -> list[Stage]:
        return [self]

    def structure(self) -> list[str]:
        return [self.description]

    def nested(self) -> str:
        """Kind and content, stage within stage."""
        return f"#{self.kind}({self.description})"


class Alternative(Stage):
    """One of several stages: the first until perturbed, then one at random, itself perturbed."""

    kind = "ALT"

    def __init__(self, options: list[Stage]):
        self.options, self.at = list(options), 0

    def apply(self, data):
        return self.options[self.at].apply(data)

    def perturb(self, rng):
        self.at = rng.randrange(len(self.options))
        self.options[self.at].perturb(rng)

    def reset(self):
        self.at = 0
        for o in self.options:
            o.reset()

    def metadata(self):
        return self.options[self.at].metadata()

    def stages(self):
        return [self.options[self.at]]

    def structure(self):
        return [o.description for o in self.options]

    def nested(self):
        return f"#{self.kind}({''.join(o.nested() for o in self.options)})"


class Incremental(Stage):
    """A growing chain: the first stage in the first run, one more after each perturbation.

    Runs over the same data share what their chains have in common; with ``cache`` Spark keeps
    each shared step, on disk where memory is short.
    """

    kind = "INCA"

    def __init__(self, chain: list[Stage], cache: bool = False):
        self.chain, self.n, self.cache = list(chain), 1, cache
        self._made: dict[tuple, tuple[Dataset, Dataset]] = {}

    def apply(self, data):
        source, done = data, ()
        for s in self.chain[: self.n]:
            done = (*done, s.metadata())
            held = self._made.get((id(source), done))
            if held is None or held[0] is not source:
                data = s.apply(data)
                if self.cache:
                    data = data.with_df(data.df.persist(StorageLevel.MEMORY_AND_DISK))
                self._made[id(source), done] = held = (source, data)
            data = held[1]
        return data

    def perturb(self, rng):
        self.n = min(self.n + 1, len(self.chain))

    def reset(self):
        self.n = 1
        for _, data in self._made.values() if self.cache else ():
            data.df.unpersist()
        self._made.clear()

    def metadata(self):
        return " -> ".join(s.metadata() for s in self.chain[: self.n])

    def stages(self):
        return self.chain[: self.n]

    def structure(self):
        return [s.description for s in self.chain]

    def nested(self):
        return f"#{self.kind}({''.join(s.nested() for s in self.chain)})"


@dataclass
class Run:
    run_id: int
    data: Dataset
    metadata: list[str] = field(default_factory=list)


class Pipeline:
    """A source and a list of stages.

    ``source`` is a function of (run_id) that returns a Dataset, with an optional
    ``perturb(rng)`` attribute.  Result names that stages need are checked when a run is
    built, not when it is executed.
    """

    def __init__(self, source: Callable[[int], Dataset], stages: list[Stage], seed: int = 0):
        self.source, self.items, self.seed = source, list(stages), seed
        self.runs: list[Run] = []
        self._rng = random.Random(seed)

    def _once(self, run_id: int) -> Run:
        data = self.source(run_id)
        meta = [getattr(self.source, "__name__", "source")]
        for item in self.items:
            for s in item.stages():
                lacking = [n for n in getattr(s, "needs", ()) if n not in data.results]
                if lacking:
                    raise KeyError(f"stage {s.description!r} needs results that no earlier stage gives: {lacking}")
            data = item.apply(data)
            meta.append(item.metadata())
        return Run(run_id, data, meta)

    def run(self, num_runs: int = 1, perturb: str = "pipeline") -> Pipeline:
        """Build the plans of ``num_runs`` runs; parameters change between runs and, with several runs, after the last."""
        if perturb not in ("pipeline", "data", "both"):
            raise ValueError("perturb is 'pipeline', 'data' or 'both'")
        start = len(self.runs)
        for k in range(num_runs):
            self.runs.append(self._once(start + k))
            if num_runs > 1:
                if perturb in ("pipeline", "both"):
                    self.perturb()
                if perturb in ("data", "both"):
                    self.perturb_data()
        return self

    def perturb(self) -> None:
        for item in self.items:
            item.perturb(self._rng)

    def perturb_data(self) -> None:
        if hasattr(self.source, "perturb"):
            self.source.perturb(self._rng)

    def reset(self) -> None:
        for item in self.items:
            item.reset()
        self.runs.clear()
        self._rng = random.Random(self.seed)

    def results(self, name: str) -> DataFrame:
        """A named result of all runs, with run_id."""
        return self._union(lambda r: r.data.result(name))

    def data(self) -> DataFrame:
        """The final data of all runs, with run_id."""
        return self._union(lambda r: r.data.df)

    def _union(self, pick) -> DataFrame:
        if not self.runs:
            raise ValueError("the pipeline has no runs yet")
        parts = [pick(r).withColumn("run_id", F.lit(r.run_id).cast("long")) for r in self.runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def result_iter(self):
        """Pairs of a run's results and its metadata."""
        return ((r.data.results, r.metadata) for r in self.runs)

    def history(self, spark: SparkSession) -> DataFrame:
        """Provenance: run_id, stage_no, description."""
        rows = [(r.run_id, k, m) for r in self.runs for k, m in enumerate(r.metadata)]
        return spark.createDataFrame(rows, "run_id long, stage_no int, description string")

    def metadata(self) -> list[str]:
        return [i.metadata() for i in self.items]

    def nested_types(self) -> str:
        """The stages as one string of nested kinds."""
        return "".join(i.nested() for i in self.items)

    def dot(self, whole: bool = True) -> str:
        """Graph in DOT: every option (``whole``) or only what the next run executes."""
        lines, before = ["digraph pipeline {", "  source [shape=box];"], ["source"]
        for k, item in enumerate(self.items):
            names = item.structure() if whole else [s.description for s in item.stages()]
            nodes = [f"s{k}_{j}" for j in range(len(names))]
            lines += [f'  {n} [label="#{item.kind}({name})"];' for n, name in zip(nodes, names, strict=True)]
            if item.kind == "INCA":
                lines += [f"  {a} -> {b};" for a, b in zip(nodes, nodes[1:], strict=False)]
                lines += [f"  {b} -> {nodes[0]};" for b in before]
                before = [nodes[-1]]
            else:
                lines += [f"  {b} -> {n};" for b in before for n in nodes]
                before = nodes
        return "\n".join([*lines, "}"])


def run_grid(build: Callable[..., DataFrame], grid: list[dict]) -> DataFrame:
    """The union over a grid of parameter values of build(**values), with run_id."""
    out = None
    for k, values in enumerate(grid):
        part = build(**values).withColumn("run_id", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the grid is empty")
    return out


class Config:
    """Settings in a JSON file, with values of the Spark session behind them."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def _all(self) -> dict:
        return json.load(open(self.path)) if os.path.exists(self.path) else {}

    def get(self, section: str, key: str, default=None):
        found = self._all().get(section, {})
        if key in found:
            return found[key]
        return self.spark.conf.get(f"{section}.{key}", default) if self.spark is not None else default

    def set(self, section: str, key: str, value) -> None:
        found = self._all()
        found.setdefault(section, {})[key] = value
        with open(self.path, "w") as out:
            json.dump(found, out, indent=1)
