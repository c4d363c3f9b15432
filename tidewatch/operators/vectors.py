"""Vector layers: borders, buffers, overlay (I8 and U2 rows of the survey).

A feature is (feature_id, shell, holes, fields, box); rings are arrays of struct<x, y>.
Overlay and buffers are those of :mod:`overlay`, exact for concave rings with holes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlay
from .overlay import RING, outlines

__all__ = ["borders", "buffer_features", "difference_areas", "effective_size", "intersect_layers", "intersection_areas", "intersection_outlines", "outlines", "subtract_layers", "union_area", "union_areas", "union_layers"]


def borders(features: DataFrame) -> DataFrame:
    """(feature_id, ring, line): the outer and inner rings as closed lines."""
    rings = F.posexplode(F.concat(F.array("shell"), F.coalesce("holes", F.array().cast(f"array<{RING}>")))).alias("ring", "points")
    return features.select("feature_id", rings).select("feature_id", "ring", F.concat("points", F.slice("points", 1, 1)).alias("line"))


def _whole(features: DataFrame) -> DataFrame:
    return features if "holes" in features.columns else features.withColumn("holes", F.array().cast(f"array<{RING}>"))


def intersect_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, fields, shell): convex pieces of the common parts of two layers, with a's fields."""
    return overlay.intersect_layers(_whole(a), _whole(b))


def subtract_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, fields, shell): convex pieces of a's features outside all of b's."""
    return overlay.subtract_layers(_whole(a), _whole(b))


def intersection_areas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, area) of the common parts of two layers."""
    return overlay.intersection_areas(_whole(a), _whole(b))


def intersection_outlines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, part, shell, holes): the rings round the common parts of two layers."""
    return overlay.intersection_outlines(_whole(a), _whole(b))


def difference_areas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, area) of a's features outside all of b's."""
    return overlay.difference_areas(_whole(a), _whole(b))


def union_areas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, area) of the overlay of two layers: common parts, then what only one of them holds (the other's id is null)."""
    return overlay.union_areas(_whole(a), _whole(b))


def buffer_features(features: DataFrame, distance: float, corner: int = 8) -> DataFrame:
    """(feature_id, part, shell, holes, fields): features grown by a distance; ``corner`` points for each quarter of a turn."""
    return overlay.buffer_features(_whole(features), distance, corner)


def union_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, fields, shell): overlay of two layers as convex pieces: common parts, then what only one of them holds (the other's id is null)."""
    return overlay.union_layers(_whole(a), _whole(b))


def union_area(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the area of both layers together, each layer's own features not overlapping."""
    from ..functions.polygons import shoelace

    return union_layers(a, b).agg(F.coalesce(F.sum(F.abs(shoelace(F.col("shell")))), F.lit(0.0)).alias("area"))


def effective_size(x: np.ndarray) -> float:
    """Effective number of independent samples, from the first autocorrelation."""
    x = np.asarray(x, float) - np.mean(x)
    r = float((x[:-1] * x[1:]).sum() / (x * x).sum()) if len(x) > 1 and (x * x).sum() > 0 else 0.0
    return len(x) * (1 - r) / (1 + r) if r < 1 else 1.0
