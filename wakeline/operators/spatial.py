"""Joins of points with places, by grid cells; cells bound the work, distances decide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.geo import EARTH_RADIUS_M, buffered_hull, haversine_m, sphere_xyz

#: Places up to this many rows are sent to every executor; the count is checked.
MOST_BROADCAST = 200_000
PER_ARRAY = 2_000
#: Radius of the finest cells of a place index, and pairs of point and place that it holds at once.
FINEST_M, MOST_PAIRS = 1_000.0, 1_000_000


def small(df: DataFrame) -> DataFrame:
    """Hints a broadcast only where the row count shows that it is one."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def place_map(places: DataFrame) -> dict:
    """{place_id: (lon, lat)} on the driver; MOST_BROADCAST places at most."""
    rows = places.select("place_id", "place_lon", "place_lat").limit(MOST_BROADCAST + 1).collect()
    if len(rows) > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} places")
    return {r.place_id: (r.place_lon, r.place_lat) for r in rows}


def _bands(lat: Column, step: float) -> Column:
    return F.floor(lat / step)


def _columns_of(band: Column, step: float) -> Column:
    """Cells around the globe in a band of latitude; each is as wide as the radius can reach anywhere in it or next to it."""
    highest = F.least(F.lit(90.0), F.greatest(F.abs(band * step), F.abs((band + 1) * step)) + step)
    reach = F.lit(math.sin(math.radians(step) / 2)) / F.greatest(F.cos(F.radians(highest)), F.lit(1e-12))
    return F.when(reach >= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(180.0) / F.degrees(F.asin(F.least(reach, F.lit(1.0)))))))


def _column(lon: Column, columns: Column) -> Column:
    """The cell of a longitude; -180 and 180 are one place."""
    return F.pmod(F.floor((lon + 180.0) / 360.0 * columns), columns)


def _cell(lon: Column, lat: Column, radius_m: float) -> Column:
    """The cell (x, y) of a point."""
    step = math.degrees(radius_m / EARTH_RADIUS_M)
    band = _bands(lat, step)
    return F.struct(_column(lon, _columns_of(band, step)).cast("long").alias("x"), band.cast("long").alias("y"))


def _reached(lon: Column, lat: Column, radius_m: float) -> Column:
    """The cells that a circle around a point can reach."""
    step = math.degrees(radius_m / EARTH_RADIUS_M)

    def in_band(y: Column) -> Column:
        n = _columns_of(y, step)
        x = _column(lon, n)
        return F.transform(F.array(x - 1, x, x + 1), lambda c: F.struct(F.pmod(c, n).cast("long").alias("x"), y.cast("long").alias("y")))

    band = _bands(lat, step)
    return F.array_distinct(F.flatten(F.transform(F.array(band - 1, band, band + 1), in_band)))


def within_radius(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Every pair of a point (lon, lat) and a place (place_id, place_lon, place_lat) within the radius, with ``distance_m``.

    Places are copied to the cells their radius can reach and met by an equi-join.
    Cells are bands of latitude cut into equal parts of the whole circle, so pairs
    across longitude 180 and near the poles meet too.
    """
    near = places.withColumn("_cell", F.explode(_reached(F.col("place_lon"), F.col("place_lat"), radius_m)))
    met = points.withColumn("_cell", _cell(F.col("lon"), F.col("lat"), radius_m)).join(small(near), "_cell").drop("_cell")
    met = met.withColumn("distance_m", haversine_m(F.col("lon"), F.col("lat"), F.col("place_lon"), F.col("place_lat")))
    return met.where(F.col("distance_m") <= radius_m)


def near_any(points: DataFrame, places: DataFrame, radius_m: float, name: str) -> DataFrame:
    """Points with a column ``name``: whether any place is within the radius.

    Cubes as wide as twice the radius hold the places; each is copied to the eight that
    its radius reaches, and a point meets those of its own cube. Straight lines sort out
    most of them, the distance decides. Nothing but the places moves, up to
    ``MOST_BROADCAST`` of them. Without coordinates nothing is near.
    """
    reach = radius_m * (1 + 1e-6)  # more than rounding can move a point
    side = max(2 * reach, 100.0)
    n = int(EARTH_RADIUS_M / side) + 3
    code = lambda cube: ((cube[0] + n) * (2 * n) + cube[1] + n) * (2 * n) + cube[2] + n
    xyz = lambda lon, lat, to: [c.alias(f"{to}_{k}") for k, c in enumerate(sphere_xyz(F.col(lon), F.col(lat)))]
    there = places.select(F.col("place_lon").cast("double").alias("_to_lon"), F.col("place_lat").cast("double").alias("_to_lat"))
    there = there.where((F.abs("_to_lon") < float("inf")) & (F.abs("_to_lat") < float("inf"))).distinct()
    few = there.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    there = there.select("*", *xyz("_to_lon", "_to_lat", "_to"))
    low = [F.floor((F.col(f"_to_{k}") - reach) / side) for k in range(3)]
    cubes = there.select("*", F.explode(F.array(*[code([c + (i >> k & 1) for k, c in enumerate(low)]) for i in range(8)])).alias("_to_cube"))
    at = points.select("*", F.col("lon").alias("_at_lon"), F.col("lat").alias("_at_lat"), *xyz("lon", "lat", "_at"))
    at = at.withColumn("_at_cube", code([F.floor(F.col(f"_at_{k}") / side) for k in range(3)]))
    mine = lambda c: F.col(f"_at_{c}").outer()
    square = lambda k: (F.col(f"_to_{k}") - mine(k)) * (F.col(f"_to_{k}") - mine(k))
    met = (F.col("_to_cube") == mine("cube")) & (square(0) + square(1) + square(2) <= reach * reach) & (haversine_m(mine("lon"), mine("lat"), F.col("_to_lon"), F.col("_to_lat")) <= radius_m)
    return at.select(*points.columns, (F.broadcast(cubes) if few else cubes).where(met).exists().alias(name))


def nearest_within(points: DataFrame, key: str, places: DataFrame, radius_m: float) -> DataFrame:
    """(key, place_id, distance_m) of the nearest place, NULL where none is within the radius."""
    best = within_radius(points.select(key, "lon", "lat"), places, radius_m).groupBy(key).agg(F.min(F.struct("distance_m", "place_id")).alias("b"))
    return points.select(key).join(best, key, "left").select(key, F.col("b.place_id").alias("place_id"), F.col("b.distance_m").alias("distance_m"))


class PlaceIndex:
    """Nearest of up to ``MOST_BROADCAST`` places, for arrays of points.

    Places lie in cubes of twice a radius, copied to the eight which their radius
    reaches, so a point's cube holds every place within the radius. Points without one
    so near go on to cubes of twice the size, up to the whole globe; a level is made
    when the first point needs it.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray) -> None:
        """Among places of one distance the first is the nearest."""
        self.lon, self.lat = lon, lat
        self._levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _radius(level: int) -> float:
        return FINEST_M * 2.0**level

    @staticmethod
    def _xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Coordinates from 0 up to the diameter."""
        x, y = np.radians(lon), np.radians(lat)
        return (np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)]) + 1) * EARTH_RADIUS_M

    @staticmethod
    def _code(cube: np.ndarray, side: float) -> np.ndarray:
        n = int(2 * EARTH_RADIUS_M / side) + 4
        return ((cube[0] + 1) * n + cube[1] + 1) * n + cube[2] + 1

    def _level(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cubes' codes, where each one's places begin, and the places by cube and number."""
        if level not in self._levels:
            radius = self._radius(level)
            low = np.floor((self._xyz(self.lon, self.lat) - radius) / (2 * radius)).astype(np.int64)
            codes = np.concatenate([self._code(low + np.array([[i & 1], [i >> 1 & 1], [i >> 2]]), 2 * radius) for i in range(8)])
            order = np.lexsort((np.arange(len(codes)) % len(self.lon), codes))
            cubes, begin = np.unique(codes[order], return_index=True)
            self._levels[level] = cubes, np.append(begin, len(order)), (order % len(self.lon)).astype(np.int32)
        return self._levels[level]

    def _best(self, lon: np.ndarray, lat: np.ndarray, begin: np.ndarray, n: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of the nearest of each point's ``n`` members from ``begin`` on."""
        first = np.cumsum(n) - n
        at = members[np.arange(n.sum()) + np.repeat(begin - first, n)]
        y, x = np.radians(self.lat[at] - np.repeat(lat, n)), np.radians(self.lon[at] - np.repeat(lon, n))
        h = np.sin(y / 2) ** 2 + np.repeat(np.cos(np.radians(lat)), n) * np.cos(np.radians(self.lat[at])) * np.sin(x / 2) ** 2
        d = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        least = np.minimum.reduceat(d, first)
        hits = np.flatnonzero(d == np.repeat(least, n))
        return at[hits[np.searchsorted(hits, first)]], least

    def nearest(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The number of each point's nearest place; points are finite."""
        out, left, level = np.zeros(len(lon), np.int64), np.arange(len(lon)), 0
        xyz = self._xyz(lon, lat)
        while len(left):
            radius = self._radius(level)
            cubes, begins, members = self._level(level)
            code = self._code(np.floor(xyz[:, left] / (2 * radius)).astype(np.int64), 2 * radius)
            i = np.minimum(np.searchsorted(cubes, code), len(cubes) - 1)
            met = np.flatnonzero(cubes[i] == code)
            n = (begins[i + 1] - begins[i])[met]
            done = np.zeros(len(left), bool)
            part = np.cumsum(n) // MOST_PAIRS
            for a, b in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
                rows = left[met[a:b]]
                best, distance = self._best(lon[rows], lat[rows], begins[i[met[a:b]]], n[a:b], members)
                sure = (distance <= radius * (1 - 1e-9)) | (radius > 2 * EARTH_RADIUS_M)
                out[rows[sure]] = best[sure]
                done[met[a:b][sure]] = True
            left, level = left[~done], level + 1
        return out


def nearest_place(points: DataFrame, places: DataFrame, near_m: float = 20_000.0) -> DataFrame:
    """Points with the nearest place at any distance; (distance, place_id) breaks ties.

    Up to ``MOST_BROADCAST`` places travel as an index; of more, the cells are joined.
    Places without coordinates have no distance and take no part.
    """
    finite = lambda c: F.abs(c) < float("inf")
    places = places.where(finite("place_lon") & finite("place_lat")).select("place_id", F.col("place_lon").cast("double").alias("place_lon"), F.col("place_lat").cast("double").alias("place_lat"))
    known = places.limit(MOST_BROADCAST + 1).toArrow()
    if not 0 < len(known) <= MOST_BROADCAST:
        return _nearest_by_cells(points, places, near_m)
    known = known.sort_by("place_id").combine_chunks()
    shipped = points.sparkSession.sparkContext.broadcast((known, PlaceIndex(known.column("place_lon").to_numpy(), known.column("place_lat").to_numpy())))

    def nearest(lon: pa.Array, lat: pa.Array) -> pa.Array:
        known, index = shipped.value
        x, y = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (lon, lat))
        number, there = np.zeros(len(x), np.int64), np.isfinite(x) & np.isfinite(y)
        number[there] = index.nearest(x[there], y[there])
        rows = pa.array(number, mask=np.asarray(lon.is_null()) | np.asarray(lat.is_null()))
        return pa.StructArray.from_arrays([c.chunk(0).take(rows) for c in known.columns], known.column_names)

    best = F.arrow_udf(nearest, T.StructType([T.StructField(f.name, f.dataType) for f in places.schema]))(F.col("lon").cast("double"), F.col("lat").cast("double"))
    found = points.withColumn("_best", best)
    distance = F.when(F.col("_best.place_lon").isNotNull(), haversine_m(F.col("lon"), F.col("lat"), F.col("_best.place_lon"), F.col("_best.place_lat")))
    return found.select(*points.columns, F.col("_best.place_id").alias("place_id"), distance.alias("distance_m"))


def _nearest_by_cells(points: DataFrame, places: DataFrame, near_m: float) -> DataFrame:
    """The same for any number of places.

    A cell's array holds every place within ``near_m`` of a point inside, so a
    minimum within that is the nearest of all. Only points without one are compared
    with all places, in arrays of ``PER_ARRAY`` places dealt by hash.
    """
    place = F.struct("place_id", "place_lon", "place_lat")
    best = lambda c: F.array_min(F.transform(c, lambda p: F.struct(haversine_m(F.col("lon"), F.col("lat"), p["place_lon"], p["place_lat"]).alias("d"), p["place_id"].alias("id"))))
    cells = places.withColumn("_cell", F.explode(_reached(F.col("place_lon"), F.col("place_lat"), near_m))).groupBy("_cell").agg(F.collect_list(place).alias("_near"))
    found = points.withColumn("_cell", _cell(F.col("lon"), F.col("lat"), near_m)).join(small(cells), "_cell", "left").withColumn("_best", best(F.col("_near"))).drop("_cell", "_near")
    near = F.coalesce(F.col("_best.d") <= near_m, F.lit(False))
    n_arrays = max(1, -(-places.count() // PER_ARRAY))
    arrays = places.groupBy(F.pmod(F.xxhash64("place_id", "place_lon", "place_lat"), F.lit(n_arrays)).alias("_part")).agg(F.collect_list(place).alias("_all")).drop("_part")
    keys = ["lon", "lat"]
    far = found.where(~near & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(*keys).distinct()
    farthest = far.join(small(arrays), F.lit(True)).select(*keys, best(F.col("_all")).alias("_far")).groupBy(*keys).agg(F.min("_far").alias("_far"))
    joined = found.join(farthest, keys, "left").withColumn("_best", F.when(near, F.col("_best")).otherwise(F.col("_far")))
    return joined.select(*points.columns, F.col("_best.id").alias("place_id"), F.col("_best.d").alias("distance_m"))


def geofences(points: DataFrame, key: str, buffer_nm: float = 1.5) -> DataFrame:
    """(key, n_points, area_sq_km, ring) of the buffered convex hull of each place's points."""

    def fence(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring, area = buffered_hull(pdf.lon.to_numpy(), pdf.lat.to_numpy(), buffer_nm * 1852.0)
        return pd.DataFrame({key: [keys[0]], "n_points": [len(pdf)], "area_sq_km": [round(area, 2)], "ring": [[{"lon": x, "lat": y} for x, y in ring]]})

    return points.select(key, "lon", "lat").groupBy(key).applyInPandas(fence, f"{key} long, n_points long, area_sq_km double, ring array<struct<lon:double,lat:double>>")
