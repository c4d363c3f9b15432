"""Geodesy on spheres and ellipsoids as column expressions (Vincenty as an Arrow kernel)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Semi-major axis and flattening in metres; the moon is a sphere.
ELLIPSOIDS = {"wgs84": (6378137.0, 1 / 298.257223563), "earth": (6378137.0, 1 / 298.257223563), "grs80": (6378137.0, 1 / 298.257222101), "moon": (1737400.0, 0.0)}
EARTH_RADIUS_KM = 6371.0
MILES_PER_KM = 0.621371192


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 1.0) -> Column:
    """Great-circle distance of points in degrees, in units of the radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_RADIUS_KM)


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two directions, in degrees."""
    return F.degrees(haversine(dec1, ra1, dec2, ra2))


def vincenty(lat1, lon1, lat2, lon2, planet: str = "wgs84", miles: bool = False) -> np.ndarray:
    """Geodesic distance in kilometres to six decimals; NaN where 200 rounds don't converge to 1e-12."""
    a, f = ELLIPSOIDS[planet]
    b = a * (1 - f)
    p1, p2 = np.radians(np.asarray(lat1, float)), np.radians(np.asarray(lat2, float))
    delta = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, done = delta.copy(), np.zeros(delta.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
            cos_s = s1 * s2 + c1 * c2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sin_l / np.where(sin_s == 0, 1.0, sin_s))
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2_a == 0, 1.0, cos2_a))
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = delta + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            done |= np.abs(new - lam) < 1e-12
            lam = np.where(done, lam, new)
            if done.all():
                break
        usq = cos2_a * (a * a - b * b) / (b * b)
        big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
        big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
        turn = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    km = b * big_a * (sigma - turn) / 1000
    same = (np.asarray(lat1) == np.asarray(lat2)) & (np.asarray(lon1) == np.asarray(lon2))
    km = np.where(same, 0.0, np.where(done, km, np.nan)) * (MILES_PER_KM if miles else 1.0)
    return np.round(km, 6)


def vincenty_km(lat1, lon1, lat2, lon2, planet: str = "wgs84", miles: bool = False) -> Column:
    """Vincenty distance of columns, as an Arrow kernel; NULL where it doesn't converge."""

    def run(a, b, c, d):
        km = pd.Series(vincenty(a, b, c, d, planet, miles))
        return km.astype(object).where(km.notna(), None)

    return F.pandas_udf(run, DoubleType(), F.PandasUDFType.SCALAR)(lat1, lon1, lat2, lon2)


def nvector(lat: Column, lon: Column) -> Column:
    """Unit normal of a point in degrees as struct<x, y, z>."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def latlon_of_nvector(n: Column) -> Column:
    return F.struct(F.degrees(F.atan2(n["z"], F.sqrt(n["x"] * n["x"] + n["y"] * n["y"]))).alias("lat"), F.degrees(F.atan2(n["y"], n["x"])).alias("lon"))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing in radians, 0 to 2 pi, by the negated angle's remainder."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    angle = F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.pmod(-angle, F.lit(2 * np.pi))


def pixel_centre(i: Column, j: Column, width: int, height: int) -> tuple[Column, Column]:
    """Longitude and latitude of the centres of a global grid, north first."""
    return (i + 0.5) * (360.0 / width) - 180.0, 90.0 - (j + 0.5) * (180.0 / height)


def cell_area(lon_west: Column, lon_east: Column, lat_south: Column, lat_north: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Area of a cell of the sphere."""
    return radius * radius * F.radians(lon_east - lon_west) * (F.sin(F.radians(lat_north)) - F.sin(F.radians(lat_south)))


def lateral_metres(lat: Column, per_degree: float, planet: str = "earth") -> Column:
    """Metres of 1/per_degree of longitude at a latitude."""
    a, f = ELLIPSOIDS[planet]
    e2, la = f * (2 - f), F.radians(lat)
    return F.cos(la) * a / F.sqrt(1 - e2 * F.pow(F.sin(la), 2)) * (np.pi / 180 / per_degree)


def medial_metres(lat: Column, per_degree: float, planet: str = "earth") -> Column:
    """Metres of 1/per_degree of latitude at a latitude."""
    a, f = ELLIPSOIDS[planet]
    e2, la = f * (2 - f), F.radians(lat)
    return a * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(la), 2), 1.5) * (np.pi / 180 / per_degree)


def wrap_latlon(lat: Column, lon: Column) -> Column:
    """A point past a pole or the date line as struct<lat, lon> in range."""
    turned = F.pmod(lat + 90, F.lit(360.0))
    over = turned > 180
    back = F.when(over, 270 - turned).otherwise(turned - 90)
    return F.struct(back.alias("lat"), (F.pmod(lon + F.when(over, 180).otherwise(0) + 180, F.lit(360.0)) - 180).alias("lon"))


def affine(i: Column, j: Column, x0: float, dx: float, y0: float, dy: float) -> Column:
    """Projected coordinates of a pixel's centre."""
    return F.struct((x0 + (i + 0.5) * dx).alias("x"), (y0 + (j + 0.5) * dy).alias("y"))


def pixel_of(x: Column, y: Column, x0: float, dx: float, y0: float, dy: float) -> Column:
    """The pixel that holds a projected coordinate: the affine map inverted in closed form."""
    return F.struct(F.floor((x - x0) / dx).cast("long").alias("i"), F.floor((y - y0) / dy).cast("long").alias("j"))


def spherical_to_xyz(lat: Column, lon: Column, radius: Column | float = 1.0) -> Column:
    n, r = nvector(lat, lon), radius if isinstance(radius, Column) else F.lit(radius)
    return F.struct((n["x"] * r).alias("x"), (n["y"] * r).alias("y"), (n["z"] * r).alias("z"))


def xyz_to_spherical(p: Column) -> Column:
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    return F.struct(F.degrees(F.asin(p["z"] / r)).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), r.alias("radius"))


def ellipse_radius(major: Column, minor: Column, azimuth: Column, toward: Column) -> Column:
    """Radius of an ellipse (semi-axes, azimuth of the major one) toward a bearing, all angles in radians."""
    a2, b2 = major * major, minor * minor
    return F.sqrt(F.lit(2.0)) * major * minor / F.sqrt((b2 - a2) * F.cos(2 * toward - 2 * azimuth) + a2 + b2)


def ellipse_nodes(lat: Column) -> Column:
    """Number of nodes of an ellipse's outline: more toward the poles."""
    return (100 + 400 / (1 + F.exp(-0.75 * (F.abs(lat) - 85)))).cast("int")


def in_ellipse(lat0: Column, lon0: Column, lat: Column, lon: Column, major: Column, minor: Column, azimuth: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    return haversine(lat0, lon0, lat, lon, radius) <= ellipse_radius(major, minor, azimuth, bearing(lat0, lon0, lat, lon))


def ellipse_outline(lat: float, lon: float, major: float, minor: float, azimuth: float, nodes: int, radius: float = EARTH_RADIUS_KM) -> np.ndarray:
    """Latitudes and longitudes of an ellipse's outline on the sphere (nodes by 2)."""
    t = np.linspace(0, 2 * np.pi, nodes, endpoint=False)
    r = np.sqrt(2) * major * minor / np.sqrt((minor**2 - major**2) * np.cos(2 * t - 2 * azimuth) + major**2 + minor**2) / radius
    p, q = np.radians(lat), np.radians(lon)
    la = np.arcsin(np.sin(p) * np.cos(r) + np.cos(p) * np.sin(r) * np.cos(t))
    lo = q + np.arctan2(np.sin(t) * np.sin(r) * np.cos(p), np.cos(r) - np.sin(p) * np.sin(la))
    return np.stack([np.degrees(la), (np.degrees(lo) + 180) % 360 - 180], axis=1)


def outline_bounds(outline: np.ndarray) -> list[tuple[float, float, float, float]]:
    """South, north, west, east of an outline; two boxes where it crosses the date line, the whole cap where it holds a pole."""
    lat, lon = outline[:, 0], outline[:, 1]
    step = (np.diff(np.append(lon, lon[0])) + 180) % 360 - 180
    if abs(step.sum()) > 180:
        return [(lat.min(), 90.0, -180.0, 180.0)] if lat.mean() > 0 else [(-90.0, lat.max(), -180.0, 180.0)]
    if lon.max() - lon.min() > 180:
        return [(lat.min(), lat.max(), lon[lon > 0].min(), 180.0), (lat.min(), lat.max(), -180.0, lon[lon < 0].max())]
    return [(lat.min(), lat.max(), lon.min(), lon.max())]
