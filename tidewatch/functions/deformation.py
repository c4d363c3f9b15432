"""Surface deformation of buried sources as column expressions (x, y offsets and depth in km)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NU = 0.25


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _r(x: Column, y: Column, c: Column) -> Column:
    return F.sqrt(x * x + y * y + c * c)


def mogi(x: Column, y: Column, depth: Column, amplitude: Column) -> Column:
    k = amplitude / F.pow(_r(x, y, depth), 3)
    return _vector(k * x, k * y, k * depth)


def sill(x: Column, y: Column, depth: Column, amplitude: Column) -> Column:
    k = amplitude * depth * depth / F.pow(_r(x, y, depth), 5)
    return _vector(k * x, k * y, k * depth)


def finite_sphere(x: Column, y: Column, depth: Column, amplitude: Column, radius: Column) -> Column:
    c1 = (1 + NU) / (2 * (-7 + 5 * NU))
    c2 = 15 * (-2 + NU) / (4 * (-7 + 5 * NU))
    far = _r(x, y, depth)
    grown = F.pow(radius, 3) * (1 + F.pow(radius / depth, 3) * (c1 + c2 * depth * depth / (far * far)))
    m = mogi(x, y, depth, amplitude)
    return _vector(m["x"] * grown, m["y"] * grown, m["z"] * grown)


def closed_pipe(x: Column, y: Column, depth: Column, amplitude: Column, half: Column) -> Column:
    c1, c2, r2 = depth - half, depth + half, x * x + y * y
    q1, q2 = _r(x, y, c1), _r(x, y, c2)
    level = amplitude * (F.pow(c1 / q1, 3) + 2 * c1 * (-3 + 5 * NU) / q1 + (5 * F.pow(c2, 3) * (1 - 2 * NU) - 2 * c2 * r2 * (-3 + 5 * NU)) / F.pow(q2, 3)) / F.nullif(r2, F.lit(0.0))
    up = -amplitude * (c1 * c1 / F.pow(q1, 3) + 2 * (-2 + 5 * NU) / q1 + (c2 * c2 * (3 - 10 * NU) - 2 * r2 * (-2 + 5 * NU)) / F.pow(q2, 3))
    return _vector(level * x, level * y, up)


def constant_open_pipe(x: Column, y: Column, depth: Column, amplitude: Column, half: Column) -> Column:
    c1, c2, r2 = depth + half, depth - half, x * x + y * y
    q1, q2 = _r(x, y, c1), _r(x, y, c2)
    level = amplitude * (F.pow(c1 / q1, 3) - 2 * c1 * (1 + NU) / q1 + (F.pow(c2, 3) * (1 + 2 * NU) + 2 * c2 * r2 * (1 + NU)) / F.pow(q2, 3)) / F.nullif(r2, F.lit(0.0))
    up = -amplitude * (c1 * c1 / F.pow(q1, 3) - 2 * NU / q1 + (-c2 * c2 + 2 * q2 * q2 * NU) / F.pow(q2, 3))
    return _vector(level * x, level * y, up)


def rising_open_pipe(x: Column, y: Column, depth: Column, amplitude: Column, half: Column) -> Column:
    c0, c1, r2 = depth - half, depth + half, x * x + y * y
    q0, q1 = _r(x, y, c0), _r(x, y, c1)
    level = amplitude * (-(c0 * c0) / F.pow(q0, 3) + 2 * NU / q0 + (c1 * c1 - 2 * (c1 * c1 + r2) * NU) / F.pow(q1, 3)) / c1
    up = -amplitude * (F.pow(c0, 3) / F.pow(q0, 3) / c1 - (c1 * c1 - 2 * (c1 * c1 + r2) * NU) / F.pow(q1, 3))
    return _vector(level * x, level * y, up)


MODELS = {"mogi": (mogi, 0), "sill": (sill, 0), "finite_sphere": (finite_sphere, 1), "closed_pipe": (closed_pipe, 1), "constant_open_pipe": (constant_open_pipe, 1), "rising_open_pipe": (rising_open_pipe, 1)}


def planar_offsets(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = 6371.0) -> Column:
    """Signed east and north distance in km from an origin."""
    east = F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius
    return F.struct(east.alias("x"), (F.radians(lat - lat0) * radius).alias("y"))
