"""Fuzzy membership and combination of map layers; a missing layer gives a missing result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trapezoid(x: Column, a: float, b: float, c: float, d: float, bottom: float = 0.2, plateau: float = 1.0, missing: float = 0.1) -> Column:
    """Membership: the plateau on [b, c], lines on (a, b) and (c, d), the bottom elsewhere, ``missing`` for NULL or NaN."""
    if not a <= b <= c <= d:
        raise ValueError("a <= b <= c <= d is needed")
    rise = bottom + (plateau - bottom) * (x - a) / (b - a) if b > a else F.lit(plateau)
    fall = plateau + (bottom - plateau) * (x - c) / (d - c) if d > c else F.lit(plateau)
    return F.when(x.isNull() | F.isnan(x), missing).when((x >= b) & (x <= c), plateau).when((x > a) & (x < b), rise).when((x > c) & (x < d), fall).otherwise(bottom)


def _whole(out: Column, xs: tuple[Column, ...]) -> Column:
    return F.when(reduce(lambda p, q: p & q, [x.isNotNull() for x in xs]), out)


def union(*xs: Column) -> Column:
    return _whole(F.greatest(*xs) if len(xs) > 1 else xs[0], xs)


def intersection(*xs: Column) -> Column:
    return _whole(F.least(*xs) if len(xs) > 1 else xs[0], xs)


def complement(x: Column) -> Column:
    return 1 - x


def product(*xs: Column) -> Column:
    return reduce(lambda p, q: p * q, xs)


def algebraic_sum(*xs: Column) -> Column:
    return 1 - product(*[1 - x for x in xs])


def gamma(g: float, *xs: Column) -> Column:
    """Between product (0) and algebraic sum (1)."""
    if not 0 <= g <= 1:
        raise ValueError("gamma is between 0 and 1")
    return F.pow(algebraic_sum(*xs), F.lit(g)) * F.pow(product(*xs), F.lit(1.0 - g))
