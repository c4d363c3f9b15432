"""Astronomical functions as column expressions; distances by a quadrature table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light in km/s, Hubble constant and matter density.
C_KM_S, HUBBLE, OMEGA_M = 299792.458, 70.0, 0.3


def velocity_of_redshift(z: Column) -> Column:
    q = (1 + z) * (1 + z)
    return C_KM_S * (q - 1) / (q + 1)


def redshift_of_velocity(v: Column) -> Column:
    return F.sqrt((1 + v / C_KM_S) / (1 - v / C_KM_S)) - 1


def distance_table(z_max: float = 3.0, n: int = 3001) -> tuple[np.ndarray, np.ndarray]:
    """Redshifts and luminosity distances in Mpc of a flat universe."""
    z = np.linspace(0, z_max, n)
    e = 1 / np.sqrt(OMEGA_M * (1 + z) ** 3 + 1 - OMEGA_M)
    comoving = np.concatenate([[0], np.cumsum((e[1:] + e[:-1]) / 2 * np.diff(z))]) * C_KM_S / HUBBLE
    return z, comoving * (1 + z)


def luminosity_distance(z: Column, z_max: float = 3.0, n: int = 601) -> Column:
    """Luminosity distance in Mpc, linear between the table's entries."""
    _, d = distance_table(z_max, n)
    table, at = F.array(*[F.lit(float(v)) for v in d]), z / z_max * (n - 1)
    k = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    return F.get(table, k) + (at - k) * (F.get(table, k + 1) - F.get(table, k))


def absolute_magnitude(apparent: Column, z: Column) -> Column:
    return apparent - 5 * F.log10(luminosity_distance(z) * 1e5)


def apparent_magnitude(absolute: Column, z: Column) -> Column:
    return absolute + 5 * F.log10(luminosity_distance(z) * 1e5)


def move_point(ra: Column, dec: Column, bearing: Column, distance: Column) -> Column:
    """A direction moved by a bearing and an angle, all in degrees; RA in 0..360."""
    d, b, r = F.radians(dec), F.radians(bearing), F.radians(distance)
    new = F.asin(F.sin(d) * F.cos(r) + F.cos(d) * F.sin(r) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(r) * F.cos(d), F.cos(r) - F.sin(d) * F.sin(new))
    return F.struct(F.pmod(ra + F.degrees(turn), F.lit(360.0)).alias("ra"), F.degrees(new).alias("dec"))


def nfw_density(radius: Column, scale: float, core: float, norm: float = 1.0) -> Column:
    """Projected density of the profile, constant shape below the core, in three branches around the scale radius."""
    r2 = F.greatest(radius, F.lit(core))
    x = r2 / scale
    inner = (1 - 2 / F.sqrt(1 - x * x) * F.atanh(F.sqrt((1 - x) / (1 + x)))) / (x * x - 1)
    outer = (1 - 2 / F.sqrt(x * x - 1) * F.atan(F.sqrt((x - 1) / (1 + x)))) / (x * x - 1)
    near = 1 / F.lit(3.0) - 2.0 / 5 * (x - 1) + 13.0 / 35 * (x - 1) * (x - 1)
    return norm * 2 * np.pi * radius * F.when(x < 0.999, inner).when(x < 1.001, near).otherwise(outer)


def schechter(x: Column, m: float, alpha: float, amplitude: float = 1.0) -> Column:
    e = F.pow(F.lit(10.0), -0.4 * (x - m))
    return amplitude * F.pow(e, F.lit(alpha + 1)) * F.exp(-e)


def double_schechter(x: Column, m1: float, a1: float, m2: float, a2: float, amplitude: float = 1.0) -> Column:
    return schechter(x, m1, a1, amplitude) + schechter(x, m2, a2, 2 * amplitude)


def schechter_cdf(low: float, high: float, m1: float, a1: float, m2: float, a2: float, n: int = 2001) -> tuple[np.ndarray, np.ndarray]:
    """Grid and cumulative share of the double function between two magnitudes; swap the two for the inverse."""
    x = np.linspace(low, high, n)
    one = lambda m, a, k: k * (e := 10 ** (-0.4 * (x - m))) ** (a + 1) * np.exp(-e)
    y = one(m1, a1, 1) + one(m2, a2, 2)
    total = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(x))])
    return x, total / total[-1]
