"""Distances, boxes, cells and unit vectors as Columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0
DISTANCE_THRESHOLD_M = 15.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is null."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_half_widths(lat: Column, metres: float) -> tuple[Column, Column]:
    """(degrees of latitude, degrees of longitude) of the half sides of the search box."""
    return F.lit(metres / METRES_PER_DEGREE), F.lit(metres) / (METRES_PER_DEGREE * F.abs(F.cos(F.radians(lat))))


def cell(degrees: Column, metres: float) -> Column:
    """Index of the square cell, ``metres`` at the equator, that holds a coordinate."""
    return F.floor(degrees / (metres / METRES_PER_DEGREE)).cast("long")


def sphere_cells(lat: Column, lon: Column, metres: float, reach: float = 0.0) -> Column:
    """The cubes of space, ``metres`` wide, that hold a coordinate on the sphere, or any place at most ``reach`` from it
    along each axis: three numbers each. Nothing is special at the poles or the date line."""
    a, b = F.radians(lat), F.radians(lon)
    axes = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    steps = [F.sequence(*[F.floor((x * EARTH_RADIUS_M + s * reach) / metres).cast("long") for s in (-1, 1)]) for x in axes]
    xs, ys, zs = steps
    return F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """n x 3 points of the unit sphere."""
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def chord(metres: float) -> float:
    """Length, on the unit sphere, of the straight line under a great-circle distance."""
    return 2 * math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2))


def haversine_np(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
