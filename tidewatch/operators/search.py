"""Travel time, reachability, routes and events (M11-M18 of the survey)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_RADIUS_KM
from .filters import can_extend


def _metric(lat1, lon1, lat2, lon2, radius: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * math.asin(min(1.0, math.sqrt(h)))


def march(start: np.ndarray, velocity: np.ndarray, lon: np.ndarray, lat: np.ndarray, radius: float = EARTH_RADIUS_KM, stop: float = math.inf, planet: bool = False):
    """Arrival times over a grid and the start cell each comes from, by second-order fast marching.

    ``start`` is 0 in start cells.  Rows wrap in longitude and cross the poles when ``planet``.
    """
    h, w = velocity.shape
    time = np.full((h, w), np.inf)
    source = np.full((h, w, 2), -1)
    alive = np.zeros((h, w), bool)
    heap = []
    for j, i in np.argwhere(start == 0):
        time[j, i], source[j, i] = 0.0, (j, i)
        heapq.heappush(heap, (0.0, int(j), int(i)))

    def step(j: int, i: int, dj: int, di: int):
        j, i = j + dj, i + di
        if planet:
            if j < 0 or j >= h:
                j, i = (-j - 1 if j < 0 else 2 * h - 1 - j), w - 1 - i
            return j, i % w
        return (j, i) if 0 <= j < h and 0 <= i < w else None

    def arrival(j: int, i: int) -> float:
        a, b, c = 0.0, 0.0, -1.0 / velocity[j, i] ** 2
        for (dj, di), (ej, ei) in (((-1, 0), (1, 0)), ((0, -1), (0, 1))):
            best = None
            for sj, si in ((dj, di), (ej, ei)):
                one = step(j, i, sj, si)
                if one is None or not alive[one]:
                    continue
                t1 = time[one]
                if best is not None and best[0] <= t1:
                    continue
                d1 = _metric(lat[j, i], lon[j, i], lat[one], lon[one], radius)
                two = step(*one, sj, si)
                if two is not None and alive[two] and time[two] <= t1:
                    d2 = _metric(lat[one], lon[one], lat[two], lon[two], radius)
                    best = (t1, 9.0 / (d1 + d2) ** 2, (4 * t1 - time[two]) / 3)
                else:
                    best = (t1, 1.0 / d1**2, t1)
            if best is not None:
                _, alpha, t = best
                a, b, c = a + alpha, b - 2 * alpha * t, c + alpha * t * t
        root = b * b - 4 * a * c
        return (-b + math.sqrt(root)) / (2 * a) if a > 0 and root >= 0 else math.inf

    while heap:
        t, j, i = heapq.heappop(heap)
        if alive[j, i]:
            continue
        if t > stop:
            break
        alive[j, i] = True
        for dj, di in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            at = step(j, i, dj, di)
            if at is None or alive[at] or not velocity[at] > 0:
                continue
            new = arrival(*at)
            if new < time[at]:
                time[at], source[at] = new, source[j, i]
                heapq.heappush(heap, (new, *at))
    time[~alive] = np.inf
    return time, source


def fast_marching(cells: DataFrame, radius: float = EARTH_RADIUS_KM, stop: float = math.inf, planet: bool = False) -> DataFrame:
    """(raster_id, j, i, time, src_j, src_i) of rasters (raster_id, j, i, lon, lat, velocity, initiation); unreached cells are NULL.

    The march is serial by nature: one task for each raster.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["j", "i"], ignore_index=True)
        h, w = pdf["j"].nunique(), pdf["i"].nunique()
        grid = lambda c: pdf[c].to_numpy(float).reshape(h, w)
        time, source = march(grid("initiation"), grid("velocity"), grid("lon"), grid("lat"), radius, stop, planet)
        flat = time.ravel()
        seen = np.isfinite(flat)
        return pd.DataFrame({"raster_id": pdf["raster_id"], "j": pdf["j"], "i": pdf["i"], "time": np.where(seen, flat, np.nan), "src_j": source[..., 0].ravel(), "src_i": source[..., 1].ravel()})

    out = cells.select("raster_id", "j", "i", "lon", "lat", "velocity", "initiation").groupBy("raster_id").applyInPandas(kernel, "raster_id long, j int, i int, time double, src_j int, src_i int")
    return out.withColumn("time", F.when(~F.isnan("time"), F.col("time")))


def neighbourhoods(edges: DataFrame, limit: float) -> DataFrame:
    """Edges (src, dst, times) whose slowest direction is within the limit."""
    return edges.where(F.array_max("times") <= limit).select("src", "dst", F.array_max("times").alias("time"))


def reachable(edges: DataFrame, starts: DataFrame, rounds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, target): targets reachable within a number of hops, the start included; frontier joins, not path lists."""
    base = starts.select(*keys, F.col("node").alias("start"), F.col("node"))
    seen = base.checkpoint()
    frontier = seen
    for _ in range(rounds):
        hop = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(*keys, "start", F.col("dst").alias("node")).distinct()
        frontier = hop.join(seen, [*keys, "start", "node"], "left_anti").checkpoint()
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier).checkpoint()
    return seen.select(*keys, F.col("start").alias("node"), F.col("node").alias("target"))


def within_time(edges: DataFrame, starts: DataFrame, limit: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, target, time): targets whose least cumulative time from a start is within the limit, the start included.

    Frontier joins that go on from what has become nearer, until nothing does.
    """
    best = starts.select(*keys, F.col("node").alias("start"), "node", F.lit(0.0).alias("time")).distinct().checkpoint()
    frontier, on = best, [*keys, "start", "node"]
    hops = edges.select(F.col("src").alias("node"), "dst", F.col("time").alias("_t"))
    while frontier.limit(1).count():
        reached = frontier.join(hops, "node").where(F.col("time") + F.col("_t") <= limit)
        reached = reached.groupBy(*keys, "start", F.col("dst").alias("node")).agg(F.min(F.col("time") + F.col("_t")).alias("_new"))
        merged = best.join(reached, on, "full").checkpoint()
        nearer = F.col("_new").isNotNull() & (F.col("time").isNull() | (F.col("_new") < F.col("time")))
        frontier = merged.where(nearer).select(*on, F.col("_new").alias("time"))
        best = merged.select(*on, F.least("time", "_new").alias("time"))
    return best.select(*keys, F.col("start").alias("node"), F.col("node").alias("target"), "time")


def threshold_targets(edges: DataFrame, groups: DataFrame, limit: float) -> DataFrame:
    """(scenario, node): nodes from which every priority-0 group of the scenario is reached within the cumulative time.

    ``groups`` is (scenario, node, grp, priority); ``edges`` is (src, dst, time).
    """
    got = within_time(edges, groups.select("node").distinct(), limit)
    wanted = groups.where("priority = 0").select("scenario", F.col("node").alias("target"), "grp")
    need = wanted.groupBy("scenario").agg(F.count_distinct("grp").alias("need"))
    held = got.join(wanted, "target").groupBy("scenario", "node").agg(F.count_distinct("grp").alias("held"))
    return held.join(need, "scenario").where("held = need").select("scenario", "node")


def traverse_paths(edges: DataFrame, starts: DataFrame, longest: float) -> DataFrame:
    """(start, path, duration, times): the simple paths within a duration that no edge can extend, by frontier joins with the visited array.

    ``times`` has the cumulative time of each node of the path.  All paths are followed to their ends.
    """
    frontier = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.lit(0.0).alias("duration"), F.array(F.lit(0.0)).alias("times")).checkpoint()
    hops, out = edges.select("src", "dst", "time"), None
    while True:
        grown = frontier.withColumn("src", F.element_at("path", -1)).join(hops, "src")
        grown = grown.where(can_extend(F.col("path"), F.col("dst"), F.col("duration") + F.col("time"), longest)).checkpoint()
        ended = frontier.join(grown.select("start", "path", "times").distinct(), ["start", "path", "times"], "left_anti")
        out = ended if out is None else out.unionByName(ended)
        if not grown.limit(1).count():
            return out
        total = F.col("duration") + F.col("time")
        frontier = grown.select("start", F.concat("path", F.array("dst")).alias("path"), total.alias("duration"), F.concat("times", F.array(total)).alias("times")).checkpoint()


def met_groups(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """(start, path, times, scenario, duration, priority, met, distinct_met): paths that meet every priority-0 group of a scenario.

    ``groups`` is (scenario, node, grp, priority), a null priority doesn't count.  The duration ends where the last
    of the priority-0 groups is met; the counts are of visits and of distinct groups of each priority.
    """
    used = groups.where("priority IS NOT NULL")
    need = used.where("priority = 0").groupBy("scenario").agg(F.count_distinct("grp").alias("need"))
    own = ["start", "path", "times"]
    visits = paths.select(*own, F.explode(F.arrays_zip("path", "times")).alias("v")).select(*own, F.col("v.path").alias("node"), F.col("v.times").alias("at"))
    met = visits.join(used, "node")
    first = met.where("priority = 0").groupBy(*own, "scenario", "grp").agg(F.min("at").alias("at"))
    done = first.groupBy(*own, "scenario").agg(F.count(F.lit(1)).alias("held"), F.max("at").alias("duration")).join(need, "scenario").where("held = need")
    counts = met.groupBy(*own, "scenario", "priority").agg(F.count(F.lit(1)).alias("met"), F.count_distinct("grp").alias("distinct_met"))
    return done.select(*own, "scenario", "duration").join(counts, [*own, "scenario"])


def path_rank(data_share: Column, straight: Column, length: Column, duration: Column, longest: float, visited_groups: Column, target_groups: Column, distinct: Column, visited: Column, weights: dict[str, float]) -> Column:
    """Weighted score of a path: data, sinuosity, duration, groups met, repeats."""
    return (
        weights["data"] * data_share
        + weights["sinuosity"] * straight / F.nullif(length, F.lit(0.0))
        + weights["duration"] * (1 - duration / longest)
        + weights["group"] * visited_groups / F.nullif(target_groups, F.lit(0))
        + weights["number"] * (1 - distinct / F.nullif(visited, F.lit(0)))
    )


def best_paths(paths: DataFrame, rank: str = "rank") -> DataFrame:
    """The best path of each start: the highest rank, then duration and path."""
    return paths.groupBy("start").agg(F.max_by(F.struct("path", "duration", rank), F.struct(rank, "duration", "path")).alias("best")).select("start", "best.*")


def tec_events(day: DataFrame, previous: DataFrame, hour: float, width: int = 200, n_std: int = 10, most_std: float = 0.75, window: int = 481) -> DataFrame:
    """(site, prn, ks, ks_p, ad, accepted): satellites whose signal around an event differs from the day before.

    The gates follow the survey: both days have the satellite, the event is inside the data,
    rolling deviations stay low, starts are within half an hour, no gap around the event;
    then both two-sample tests must be below 0.05.
    """
    from .joins import same_site_and_satellite

    a, b = same_site_and_satellite(day, previous)
    both = a.select("site", "prn", "t", "vtec").withColumn("side", F.lit(0)).unionByName(b.select("site", "prn", "t", "vtec").withColumn("side", F.lit(1)))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        from .kernels import low_pass_tec

        out = {"site": pdf["site"].iloc[0], "prn": pdf["prn"].iloc[0], "ks": np.nan, "ks_p": np.nan, "ad": np.nan, "accepted": False}
        sides = []
        for s in (0, 1):
            x = pdf[pdf["side"] == s].sort_values("t")
            t = x["t"].to_numpy(float)
            sides.append(((t % 1) * 24, x["vtec"].to_numpy(float) - low_pass_tec(t, x["vtec"].to_numpy(float), window)))
        (ha, da), (hb, db) = sides
        if min(len(ha), len(hb)) < 3:
            return pd.DataFrame([out])
        at = int(np.argmin(np.abs(ha - hour)))
        if at in (0, len(ha) - 1) or abs(ha[0] - hb[0]) > 0.5 or ha[-1] < hour:
            return pd.DataFrame([out])
        lo, hi = max(0, at - width), min(len(ha), at + width)
        near = (hb >= ha[lo]) & (hb <= ha[hi - 1])
        x, y = da[lo:hi], db[near]
        x, y = x[np.isfinite(x)], y[np.isfinite(y)]
        noisy = any((pd.Series(v).rolling(n_std).std() > most_std).sum() > n_std for v in (x, y))
        if min(len(x), len(y)) < 3 or noisy or np.max(np.diff(ha[lo:hi])) > 0.25:
            return pd.DataFrame([out])
        grid = np.sort(np.concatenate([x, y]))
        ks = np.max(np.abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y)))
        en = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
        lam = (en + 0.12 + 0.11 / en) * ks
        p = float(np.clip(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 100)), 0, 1))
        n, m = len(grid), len(x)
        below = np.searchsorted(np.sort(x), grid[:-1], "right")
        k = np.arange(1, n)
        ad = float(np.sum((below * n - k * m) ** 2 / (k * (n - k))) / (m * (n - m)))
        return pd.DataFrame([out | {"ks": ks, "ks_p": p, "ad": ad, "accepted": p < 0.05 and ad > 2.492}])

    return both.groupBy("site", "prn").applyInPandas(kernel, "site string, prn int, ks double, ks_p double, ad double, accepted boolean")
