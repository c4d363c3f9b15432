"""Trapezoids of many small features at once, as arrays: sweep, common parts, differences, outlines.

The kernels of :mod:`overlay` for features that fit a row.  A trapezoid is a row of ``XL, XR`` and of the two
edges (x1, y1, x2, y2, left end first) that bound it from below and above, so that its heights come from the
feature's own corners however often it is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Pieces lower than this share of their coordinates at both ends are rounding, not area.
SLIVER = 1e-12
#: Rows that a step makes at once.
ROWS = 1_000_000
LOW, HIGH = slice(2, 6), slice(6, 10)


def height(line: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Height of edges (rows of x1, y1, x2, y2) at x, exact at their ends."""
    x1, y1, x2, y2 = line.T
    return np.where(x == x2, y2, y1 + (x - x1) * ((y2 - y1) / (x2 - x1)))


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that become n rows each: the old row of every new one, and its number within that."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def portions(weight: np.ndarray, most: int = ROWS) -> Iterator[slice]:
    """Slices of rows whose weights sum to about ``most``."""
    if len(weight):
        cut = np.flatnonzero(np.diff(np.cumsum(weight) // most)) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(weight)), strict=True):
            yield slice(int(a), int(b))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(new) > 1 else True
    return new


# ---- features -------------------------------------------------------------------------------------------------------


def ring_edges(g: np.ndarray, way: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, edges, turn) of rings; ``turn`` is 1 where the feature lies above an edge, -1 where it lies below."""
    n = np.diff(offsets)
    ring, k = expand(n)
    at = offsets[:-1][ring] + k
    to = offsets[:-1][ring] + (k + 1) % n[ring]
    px, py, qx, qy = x[at], y[at], x[to], y[to]
    sign = np.sign(np.bincount(ring, px * qy - qx * py, len(n))) * way
    ahead = (px < qx)[:, None]
    edges = np.where(ahead, np.stack([px, py, qx, qy], 1), np.stack([qx, qy, px, py], 1))
    turn = (sign[ring] * np.where(ahead[:, 0], 1, -1)).astype(int)
    keep = (edges[:, 0] != edges[:, 2]) & (turn != 0)  # upright edges bound no piece from below or above
    return g[ring][keep], edges[keep], turn[keep]


def feature_edges(shell: pa.Array, holes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, edges, turn) of Arrow arrays of shells and of lists of holes."""

    def flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = rings.flatten()
        n = np.asarray(rings.value_lengths().fill_null(0))
        return np.append(0, np.cumsum(n)), *(np.asarray(points.field(c), float) for c in "xy")

    out = [ring_edges(np.arange(len(shell)), np.ones(len(shell)), *flat(shell))]
    inner = holes.flatten()
    if len(inner):
        owner = np.repeat(np.arange(len(holes)), np.asarray(holes.value_lengths().fill_null(0)))
        out.append(ring_edges(owner, -np.ones(len(owner)), *flat(inner)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# ---- sweep ----------------------------------------------------------------------------------------------------------


def _crossings(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, x) where two edges of a group cross; groups are in order."""
    size = np.bincount(g)
    last = np.cumsum(size)[g]
    after = last - np.arange(len(g)) - 1
    found = []
    for part in portions(after):
        row, k = expand(after[part])
        p = row + part.start
        q = p + 1 + k
        a, b = e[p], e[q]
        low, high = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 2], b[:, 2])
        near = (low < high) & (np.minimum(a[:, 1], a[:, 3]) <= np.maximum(b[:, 1], b[:, 3])) & (np.minimum(b[:, 1], b[:, 3]) <= np.maximum(a[:, 1], a[:, 3]))
        p, a, b, low, high = p[near], a[near], b[near], low[near], high[near]
        d, f = height(a, low) - height(b, low), height(a, high) - height(b, high)
        hit = d * f < 0
        d, f, low, high = d[hit], f[hit], low[hit], high[hit]
        found.append((g[p[hit]], low + (high - low) * (d / (d - f))))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))


def sweep(g: np.ndarray, edges: np.ndarray, turn: np.ndarray, rule: Callable = lambda n: n > 0) -> tuple[np.ndarray, np.ndarray]:
    """(group, trapezoids): where ``rule`` of a group's cover count holds, pieces between the same two edges in one; groups in order."""
    order = np.lexsort((*edges.T[::-1], g))
    g, edges, turn = g[order], edges[order], turn[order]
    new = _starts(g, *edges.T)
    turn = np.add.reduceat(turn, np.flatnonzero(new)) if len(turn) else turn
    g, edges = g[new][turn != 0], edges[new][turn != 0]
    turn = turn[turn != 0]
    if not len(g):
        return np.zeros(0, int), np.zeros((0, 10))
    cg, cx = _crossings(g, edges)
    n = len(g)
    ag, ax = np.concatenate([g, g, cg]), np.concatenate([edges[:, 0], edges[:, 2], cx])
    order = np.lexsort((ax, ag))
    first = _starts(ag[order], ax[order])
    place = np.empty(len(order), int)
    place[order] = np.cumsum(first) - 1
    at = ax[order][first]
    out = []
    for part in _whole_groups(g, place[n : 2 * n] - place[:n]):
        k0, k1 = place[:n][part], place[n : 2 * n][part]
        row, k = expand(k1 - k0)
        k += k0[row]
        row += part.start
        low, high = height(edges[row], at[k]), height(edges[row], at[k + 1])
        order = np.lexsort((row, low + high, k))
        row, k, low, high = row[order], k[order], low[order], high[order]
        start = _starts(k)
        total = np.cumsum(turn[row])
        base = (total - turn[row])[start]
        cover = total - base[np.cumsum(start) - 1]
        least = SLIVER * (1 + np.maximum(np.abs(low), np.abs(high)))
        apart = np.ones(len(k), bool)
        # Of edges that lie on each other the last alone decides, so that no gap of rounding opens between them.
        apart[:-1] = start[1:] | (low[1:] - low[:-1] > least[:-1]) | (high[1:] - high[:-1] > least[:-1])
        row, k, low, high, least, inside = (v[apart] for v in (row, k, low, high, least, rule(cover)))
        before = np.append(False, inside[:-1]) & ~_starts(k)
        turned = inside != before
        row, k, low, high, least, inside = (v[turned] for v in (row, k, low, high, least, inside))
        p = np.flatnonzero(inside[:-1] & (k[1:] == k[:-1]))
        p = p[(low[p + 1] - low[p] > least[p]) | (high[p + 1] - high[p] > least[p])]
        bottom, top, k = row[p], row[p + 1], k[p]
        order = np.lexsort((k, top, bottom))
        bottom, top, k = bottom[order], top[order], k[order]
        run = _starts(bottom, top, k - np.arange(len(k)))
        s = np.flatnonzero(run)
        e = np.append(s[1:], len(k)) - 1 if len(s) else s
        out.append((g[bottom[s]], np.column_stack([at[k[s]], at[k[e] + 1], edges[bottom[s]], edges[top[s]]])))
    g, t = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(g, kind="stable")
    return g[order], t[order]


def _whole_groups(g: np.ndarray, weight: np.ndarray) -> Iterator[slice]:
    """Slices as of :func:`portions` that part no group."""
    new = np.flatnonzero(_starts(g))
    ends = np.append(new, len(g))
    for part in portions(np.add.reduceat(weight, new)):
        yield slice(int(ends[part.start]), int(ends[part.stop]))


@dataclass
class Pieces:
    """Trapezoids by owner, in order, with the box of each; ``ends[k]`` to ``ends[k + 1]`` are those of owner k."""

    owner: np.ndarray
    at: np.ndarray
    n: int

    def __post_init__(self):
        low = np.minimum(height(self.at[:, LOW], self.at[:, 0]), height(self.at[:, LOW], self.at[:, 1]))
        high = np.maximum(height(self.at[:, HIGH], self.at[:, 0]), height(self.at[:, HIGH], self.at[:, 1]))
        self.box = np.column_stack([self.at[:, 0], low, self.at[:, 1], high])
        self.ends = np.append(0, np.cumsum(np.bincount(self.owner, minlength=self.n)))

    def hulls(self) -> np.ndarray:
        """The box of each owner; empty (and meeting nothing) where it has no trapezoid."""
        out = np.tile([np.inf, np.inf, -np.inf, -np.inf], (self.n, 1))
        some = np.flatnonzero(np.diff(self.ends))
        if len(some):
            out[some, :2] = np.minimum.reduceat(self.box[:, :2], self.ends[some])
            out[some, 2:] = np.maximum.reduceat(self.box[:, 2:], self.ends[some])
        return out


def features(shell: pa.Array, holes: pa.Array) -> Pieces:
    return Pieces(*sweep(*feature_edges(shell, holes)), len(shell))


def meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Do boxes share area?"""
    return (p[..., 0] < q[..., 2]) & (q[..., 0] < p[..., 2]) & (p[..., 1] < q[..., 3]) & (q[..., 1] < p[..., 3])


# ---- common parts ---------------------------------------------------------------------------------------------------


def _cut(left: np.ndarray, right: np.ndarray, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted places from left to right: the ends, and where pairs of edges cross between them."""
    places = [left, right]
    for p, q in lines:
        d, f = height(p, left) - height(q, left), height(p, right) - height(q, right)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = left + (right - left) * (d / (d - f))
        places.append(np.where(d * f < 0, np.clip(x, left, right), left))
    return np.sort(np.stack(places, 1), axis=1)


def common(a: Pieces, b: Pieces, i: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, pieces) for pairs of owners i of a and k of b; a piece is xl, xr and its heights: low and high at xl, low and high at xr."""
    hull_a, hull_b = a.hulls(), b.hulls()
    size = lambda t, own: (t.ends[own + 1] - t.ends[own])
    for part in portions(size(a, i) + size(b, k) + size(a, i) * size(b, k) // 4):
        ip, kp = i[part], k[part]
        sides = []
        for t, own, hull in ((a, ip, hull_b[kp]), (b, kp, hull_a[ip])):
            row, at = expand(size(t, own))
            at += t.ends[own][row]
            keep = meet(t.box[at], hull[row])
            sides.append((row[keep], at[keep], np.bincount(row[keep], minlength=len(ip))))
        (ra, ta, na), (_, tb, nb) = sides
        row, m = expand(nb[ra])
        pair, p = ra[row], ta[row]
        q = tb[(np.cumsum(nb) - nb)[pair] + m]
        keep = meet(a.box[p], b.box[q])
        pair, s, t = pair[keep], a.at[p[keep]], b.at[q[keep]]
        left, right = np.maximum(s[:, 0], t[:, 0]), np.minimum(s[:, 1], t[:, 1])
        h = lambda v, c, x: height(v[:, c], x)
        keep = ((h(s, HIGH, left) > h(t, LOW, left)) | (h(s, HIGH, right) > h(t, LOW, right))) & ((h(t, HIGH, left) > h(s, LOW, left)) | (h(t, HIGH, right) > h(s, LOW, right)))
        pair, s, t, left, right = pair[keep], s[keep], t[keep], left[keep], right[keep]
        cuts = _cut(left, right, [(s[:, LOW], t[:, LOW]), (s[:, HIGH], t[:, HIGH]), (s[:, LOW], t[:, HIGH]), (s[:, HIGH], t[:, LOW])])
        r, c = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
        x0, x1, s, t = cuts[r, c], cuts[r, c + 1], s[r], t[r]
        low, high = ([f(h(s, e, x), h(t, e, x)) for x in (x0, x1)] for f, e in ((np.maximum, LOW), (np.minimum, HIGH)))
        least = SLIVER * (1 + np.maximum(np.abs(low[0]), np.abs(low[1])))
        keep = ((high[0] - low[0] > least) | (high[1] - low[1] > least)) & (high[0] + high[1] > low[0] + low[1])
        out = np.column_stack([x0, x1, low[0], np.maximum(low[0], high[0]), low[1], np.maximum(low[1], high[1])])
        yield pair[r[keep]] + part.start, out[keep]


def plain(t: np.ndarray) -> np.ndarray:
    """Trapezoids as rows of xl, xr and heights."""
    x0, x1 = t[:, 0], t[:, 1]
    return np.column_stack([x0, x1, height(t[:, LOW], x0), height(t[:, HIGH], x0), height(t[:, LOW], x1), height(t[:, HIGH], x1)])


def area(piece: np.ndarray) -> np.ndarray:
    x0, x1, a, b, c, d = piece.T
    return (x1 - x0) * ((b - a) + (d - c)) / 2


# ---- differences ----------------------------------------------------------------------------------------------------


def _less(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, trapezoids): what is left of each p outside its q."""
    left, right = np.maximum(p[:, 0], q[:, 0]), np.minimum(p[:, 1], q[:, 1])
    out = []
    for keep, x0, x1 in ((p[:, 0] < left, p[:, 0], left), (right < p[:, 1], right, p[:, 1])):
        out.append((np.flatnonzero(keep), np.column_stack([x0, x1, p[:, 2:]])[keep]))
    for above in (True, False):
        own, other = (LOW, HIGH) if above else (HIGH, LOW)
        cuts = _cut(left, right, [(p[:, own], q[:, other]), (p[:, other], q[:, other])])
        r, c = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
        x0, x1, s, t = cuts[r, c], cuts[r, c + 1], p[r], q[r]
        middle = (x0 + x1) / 2
        beyond = height(t[:, other], middle) > height(s[:, own], middle)
        edge = np.where((beyond if above else ~beyond)[:, None], t[:, other], s[:, own])
        new = np.column_stack([x0, x1, edge, s[:, HIGH]] if above else [x0, x1, s[:, LOW], edge])
        out.append((r, new))
    row, new = (np.concatenate(c) for c in zip(*out, strict=True))
    gap = [height(new[:, HIGH], x) - height(new[:, LOW], x) for x in (new[:, 0], new[:, 1])]
    least = SLIVER * (1 + np.abs(height(new[:, LOW], new[:, 0])))
    keep = (new[:, 0] < new[:, 1]) & (gap[0] + gap[1] > 0) & ((gap[0] > least) | (gap[1] > least))
    return row[keep], new[keep]


def less(a: Pieces, b: Pieces, window: int = 32) -> Pieces:
    """a's trapezoids outside all of b's.  Each takes the first of b's that it meets, and what is left goes on behind that one."""
    hull = a.hulls()
    lists, n = [], np.zeros(a.n, int)
    for part in portions(np.full(a.n, max(1, len(b.box)))):
        own, t = np.nonzero(meet(hull[part][:, None], b.box[None]))
        lists.append(t)
        n[part] = np.bincount(own, minlength=part.stop - part.start)
    todo = np.concatenate(lists) if lists else np.zeros(0, int)
    first, last = np.cumsum(n) - n, np.cumsum(n)
    owner, at, box, j = a.owner, a.at, a.box, first[a.owner]
    done = []
    while len(owner):
        over = j >= last[owner]
        if over.any():
            done.append((owner[over], at[over]))
            owner, at, box, j = owner[~over], at[~over], box[~over], j[~over]
            continue
        grown = []
        for part in portions(np.full(len(owner), window)):
            o, p, pb, jj = owner[part], at[part], box[part], j[part]
            k = jj[:, None] + np.arange(window)
            hit = (k < last[o][:, None]) & meet(pb[:, None], b.box[todo[np.minimum(k, len(todo) - 1)]])
            some = hit.any(axis=1)
            grown.append((o[~some], p[~some], pb[~some], jj[~some] + window))
            o, p, pb, jj = o[some], p[some], pb[some], jj[some] + hit[some].argmax(axis=1)
            q = b.at[todo[jj]]
            left, right = np.maximum(p[:, 0], q[:, 0]), np.minimum(p[:, 1], q[:, 1])
            apart = np.zeros(len(p), bool)
            for low, high in ((q, p), (p, q)):  # one lies above the other from end to end
                apart |= (height(low[:, LOW], left) >= height(high[:, HIGH], left)) & (height(low[:, LOW], right) >= height(high[:, HIGH], right))
            grown.append((o[apart], p[apart], pb[apart], jj[apart] + 1))
            row, new = _less(p[~apart], q[~apart])
            o, jj = o[~apart][row], jj[~apart][row]
            grown.append((o, new, Pieces(o, new, a.n).box, jj + 1))
        owner, at, box, j = (np.concatenate(c) for c in zip(*grown, strict=True))
    owner, at = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (owner, at)
    order = np.argsort(owner, kind="stable")
    return Pieces(owner[order], at[order], a.n)


# ---- outlines -------------------------------------------------------------------------------------------------------


def sides(g: np.ndarray, piece: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, directed outer sides x1, y1, x2, y2) of adjoining pieces, the inside on their left, in order of group and start."""
    x0, x1, a, b, c, d = np.round(piece, digits).T
    level = [(g, x0, a, x1, c), (g, x1, d, x0, b)]
    # Upright sides at one x: up at the right of a piece, down at the left; where both lie, none is left.
    pg, px, py = np.concatenate([g] * 4), np.concatenate([x1, x1, x0, x0]), np.concatenate([c, d, b, a])
    w = np.repeat([1, -1, 1, -1], len(g))
    order = np.lexsort((py, px, pg))
    pg, px, py, w = pg[order], px[order], py[order], w[order]
    new = np.flatnonzero(_starts(pg, px, py))
    w = np.add.reduceat(w, new)
    pg, px, py, w = pg[new][w != 0], px[new][w != 0], py[new][w != 0], w[w != 0]
    n = np.cumsum(w)  # comes to nothing at each x
    k = np.flatnonzero(n)
    up = n[k] > 0
    level.append((pg[k], px[k], np.where(up, py[k], py[np.minimum(k + 1, len(py) - 1)]), px[k], np.where(up, py[np.minimum(k + 1, len(py) - 1)], py[k])))
    g, s = np.concatenate([v[0] for v in level]), np.concatenate([np.column_stack(v[1:]) for v in level])
    keep = (s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])
    g, s = g[keep], s[keep] + 0.0
    # Opposite sides of two pieces that lie on each other cancel.
    ahead = (s[:, 0] < s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] < s[:, 3]))
    s = np.where(ahead[:, None], s, s[:, [2, 3, 0, 1]])
    order = np.lexsort((*s.T[::-1], g))
    g, s = g[order], s[order]
    new = np.flatnonzero(_starts(g, *s.T))
    w = np.add.reduceat(np.where(ahead, 1, -1)[order], new)
    g, s, w = g[new][w != 0], s[new][w != 0], w[w != 0]
    s = np.where((w > 0)[:, None], s, s[:, [2, 3, 0, 1]])
    order = np.lexsort((s[:, 1], s[:, 0], g))
    return g[order], s[order]


def rings(g: np.ndarray, s: np.ndarray, trace: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each ring, ring of each corner, corners) along directed sides; where one corner starts two sides, ``trace`` tells the way."""
    start = _starts(g, s[:, 0], s[:, 1])
    forked = np.unique(g[~start])
    lone = ~np.isin(g, forked)
    out_g, out_r, out_p, made = [], [], [], 0
    for f in forked:
        for ring in trace(s[g == f] if len(forked) < 8 else s[np.searchsorted(g, f) : np.searchsorted(g, f, "right")]):
            out_g.append([f]), out_r.append(np.full(len(ring), made)), out_p.append(ring)
            made += 1
    g, s = g[lone], s[lone]
    if len(g):
        # Every corner starts one side and ends one: the sides are a permutation, told by sorting both ends.
        nxt, ends = np.empty(len(g), int), np.lexsort((s[:, 3], s[:, 2], g))
        nxt[ends] = np.arange(len(g))
        name, far = np.arange(len(g)), nxt
        while True:
            new = np.minimum(name, name[far])
            if (new == name).all() and (name[far] == name).all():
                break
            name, far = new, far[far]
        lead = name == np.arange(len(g))
        # Steps from each side to the first of its ring.
        far, steps = np.where(lead, np.arange(len(g)), nxt), np.where(lead, 0, 1)
        while (far[far] != far).any():
            steps, far = steps + steps[far], far[far]
        order = np.lexsort((-np.where(lead, len(g) + 1, steps), name))
        name, p = name[order], s[order, :2]
        first = np.flatnonzero(_starts(name))
        n = np.diff(np.append(first, len(name)))
        ring = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(name)) - first[ring]
        u = p - p[first[ring] + (k - 1) % n[ring]]
        v = p[first[ring] + (k + 1) % n[ring]] - p
        bend = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 1e-9 * np.hypot(*u.T) * np.hypot(*v.T)
        bend &= np.bincount(ring, bend)[ring] > 2
        ring, p = ring[bend], p[bend]
        kept, ring = np.unique(ring, return_inverse=True)
        out_g.append(g[order][first][kept]), out_r.append(ring + made), out_p.append(p)
    if not out_g:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 2))
    return np.concatenate(out_g).astype(int), np.concatenate(out_r).astype(int), np.concatenate(out_p)


def outlines(g: np.ndarray, piece: np.ndarray, digits: int, trace: Callable, inside: Callable) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(group, part, shells, holes) of the rings round the adjoining pieces of each group; parts go by size."""
    owner, ring, p = rings(*sides(g, piece, digits), trace)
    n = np.bincount(ring, minlength=len(owner))
    first = np.cumsum(n) - n
    to = np.where(np.arange(len(ring)) + 1 < (first + n)[ring], np.arange(len(ring)) + 1, first[ring])
    size = np.bincount(ring, p[:, 0] * p[to, 1] - p[to, 0] * p[:, 1], len(owner)) / 2
    shells = np.flatnonzero(size > 0)
    shells = shells[np.lexsort((size[shells], owner[shells]))]
    start = _starts(owner[shells])
    part = np.arange(len(shells)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(shells) else shells
    inner = np.flatnonzero(size < 0)
    left, right = (np.searchsorted(owner[shells], owner[inner], side) for side in ("left", "right"))
    home = np.where(right > left, left, -1)
    for k in np.flatnonzero(right - left > 1):  # the smallest shell that holds it
        middle = p[first[inner[k]] : first[inner[k]] + 2].mean(axis=0)
        home[k] = next((m for m in range(left[k], right[k]) if inside(middle, p[first[shells[m]] : first[shells[m]] + n[shells[m]]])), -1)
    inner, home = inner[home >= 0], home[home >= 0]
    inner = inner[np.argsort(home, kind="stable")]
    held = np.bincount(home, minlength=len(shells))

    def lists(which: np.ndarray) -> pa.Array:
        row, k = expand(n[which])
        at = p[first[which][row] + k]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[which])), pa.int32()), points(at))

    return owner[shells], part, lists(shells), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), lists(inner))


def points(at: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["x", "y"])


def shells(piece: np.ndarray) -> pa.Array:
    """Pieces as rings of four corners."""
    x0, x1, a, b, c, d = piece.T
    at = np.stack([np.stack(v, 1) for v in ((x0, a), (x1, c), (x1, d), (x0, b))], 1).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(piece) + 1, 4), pa.int32()), points(at))
