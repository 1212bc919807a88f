"""Distances and shapes on a sphere, as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
NAUTICAL_MILE_M = 1852.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sphere_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Cartesian coordinates of a point of the sphere."""
    c = F.cos(F.radians(lat)) * EARTH_RADIUS_M
    return c * F.cos(F.radians(lon)), c * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * EARTH_RADIUS_M


def chord_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Straight-line distance through the sphere; orders points as the great circle does."""
    a, b = sphere_xyz(lon1, lat1), sphere_xyz(lon2, lat2)
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over an array of (lon, lat) structs; the last point joins the first."""

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
        return F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of (x, y) rows, by monotone chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def buffered_hull(lon: np.ndarray, lat: np.ndarray, radius_m: float, per_quadrant: int = 8) -> tuple[list[tuple[float, float]], float]:
    """Ring (lon, lat) and area in square km of the hull widened by ``radius_m``, in a local plane."""
    lon0, lat0 = float(lon.mean()), float(lat.mean())
    k = math.pi / 180 * EARTH_RADIUS_M
    hull = convex_hull(np.stack([(lon - lon0) * k * math.cos(math.radians(lat0)), (lat - lat0) * k], 1))
    following = np.roll(hull, -1, axis=0)
    area = 0.5 * abs(float((hull[:, 0] * following[:, 1] - hull[:, 1] * following[:, 0]).sum())) if len(hull) > 2 else 0.0
    border = float(np.hypot(*(following - hull).T).sum()) if len(hull) > 1 else 0.0
    angles = np.arange(4 * per_quadrant) * (math.pi / 2 / per_quadrant)
    circle = np.stack([np.cos(angles), np.sin(angles)], 1) * radius_m
    ring = convex_hull((hull[:, None] + circle[None]).reshape(-1, 2))
    out = [(lon0 + x / (k * math.cos(math.radians(lat0))), lat0 + y / k) for x, y in ring.tolist()]
    return out, (area + border * radius_m + math.pi * radius_m**2) / 1e6
