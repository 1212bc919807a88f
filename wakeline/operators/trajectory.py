"""Tracks: buckets, validity, speed jumps, smoothing, simplification, sessions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_RADIUS_M

KNOTS = 1.94384
METRES_PER_DEGREE = 111_111.0
MOORED = ("1", "5", "Anchored", "Moored")


def valid_coordinates(lon: Column, lat: Column) -> Column:
    """Strictly inside the globe; a longitude of exactly 0 counts as no fix."""
    return (lon != 0) & (lat > -90) & (lat < 90) & (lon > -180) & (lon < 180)


def bucket(ts: Column | str, minutes: int = 10) -> Column:
    return F.window(ts, f"{minutes} minutes").start


def last_in_bucket(df: DataFrame, minutes: int = 10, average_speed: bool = False) -> DataFrame:
    """One row a vessel and bucket: the last values by time, nulls included; optionally the mean speed to one decimal."""
    values = ["lon", "lat", "sog", "nav_status", "destination", "draught"]
    aggs = [F.max_by(F.struct("ts", *values), "ts").alias("l")]
    if average_speed:
        aggs.append(F.round(F.avg("sog"), 1).alias("avg_sog"))
    out = df.withColumn("bucket", bucket("ts", minutes)).groupBy("mmsi", "bucket").agg(*aggs)
    return out.select("mmsi", "bucket", F.col("l.ts").alias("ts"), *[F.col(f"l.{c}").alias(c) for c in values], *(["avg_sog"] if average_speed else []))


def median_filter5(df: DataFrame, columns: tuple[str, ...] = ("lon", "lat"), edge: str = "zero") -> DataFrame:
    """Median of five by time within a vessel; beyond the ends zeros stand (``edge="nearest"``: the end value). Needs five points."""
    w = Window.partitionBy("mmsi").orderBy("ts")
    n = F.count("*").over(Window.partitionBy("mmsi"))

    def smooth(c: str) -> Column:
        pad = lambda v, e: v if edge == "zero" else F.coalesce(v, e)
        missing = F.lit(0.0) if edge == "zero" else F.lit(None).cast("double")
        first, last = F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(c).over(w.rowsBetween(0, Window.unboundedFollowing))
        near = [F.lag(c, k).over(w) for k in (2, 1)] + [F.col(c)] + [F.lead(c, k).over(w) for k in (1, 2)]
        near = [F.coalesce(x, missing) if edge == "zero" else pad(x, first if i < 2 else last) for i, x in enumerate(near)]
        return F.when(n >= 5, F.element_at(F.array_sort(F.array(*near)), 3)).otherwise(F.col(c))

    return df.select(*[smooth(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def _haversine(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(a))


def keep_plausible(ts: np.ndarray, lon: np.ndarray, lat: np.ndarray, most_knots: float = 50.0) -> np.ndarray:
    """Positions kept: the first, then each later one reached from the last kept at a plausible speed."""
    kept: list[int] = []
    for i in range(len(ts)):
        if kept:
            j = kept[-1]
            dt = (ts[i] - ts[j]) / 1e9
            if dt <= 0 or _haversine(lon[j], lat[j], lon[i], lat[i]) / dt * KNOTS > most_knots:
                continue
        kept.append(i)
    return np.array(kept, int)


def drop_speed_jumps(df: DataFrame, most_knots: float = 50.0) -> DataFrame:
    """Valid points without implausible jumps; a vessel's points are read once, in time order."""
    kept = [c for c in df.columns]

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        return pdf.iloc[keep_plausible(pdf.ts.to_numpy("datetime64[ns]").astype(np.int64), pdf.lon.to_numpy(), pdf.lat.to_numpy(), most_knots)][kept]

    return df.where(valid_coordinates(F.col("lon"), F.col("lat"))).groupBy("mmsi").applyInPandas(clean, df.schema)


def simplified(lat: np.ndarray, lon: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Positions that Douglas-Peucker keeps, with planar degrees; an explicit stack replaces recursion."""
    n = len(lat)
    if n < 3:
        return np.arange(n)
    limit = tolerance_m / METRES_PER_DEGREE
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        y, x = lat[a + 1 : b] - lat[a], lon[a + 1 : b] - lon[a]
        dy, dx = lat[b] - lat[a], lon[b] - lon[a]
        length = math.hypot(dx, dy)
        d = np.hypot(x, y) if length == 0 else np.abs(dx * y - dy * x) / length
        k = int(d.argmax())
        if d[k] > limit:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def tracks(df: DataFrame, tolerance_m: float = 100.0, most_knots: float = 50.0) -> DataFrame:
    """Display tracks: mean-speed buckets, no jumps, smoothed, simplified; vessels of under two points drop out."""
    rows = last_in_bucket(df, average_speed=True).select(
        "mmsi", F.col("bucket").alias("ts"), "lon", "lat", F.coalesce("avg_sog", F.lit(0.0)).alias("sog"),
        F.coalesce(F.nullif("nav_status", F.lit("")), F.lit("Unknown")).alias("nav_status"),
        F.coalesce(F.nullif("destination", F.lit("")), F.lit("None")).alias("destination"), F.coalesce("draught", F.lit(0.0)).alias("draught"),
    )
    smooth = median_filter5(drop_speed_jumps(rows, most_knots))

    def simplify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = pdf.iloc[simplified(pdf.lat.to_numpy(), pdf.lon.to_numpy(), tolerance_m)]
        return out if len(out) >= 2 else out.iloc[:0]

    return smooth.groupBy("mmsi").applyInPandas(simplify, smooth.schema)


def sessions(df: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """``grp_id`` per vessel: a gap of more than ``gap_minutes`` opens a new group."""
    w = Window.partitionBy("mmsi").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) > F.expr(f"interval '{gap_minutes}' minute"), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("grp_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stop_candidates(df: DataFrame, moored: tuple[str, ...] = MOORED) -> DataFrame:
    return df.where(((F.col("sog") < 1.0) | F.col("nav_status").isin(*moored)) & (F.minute("ts") % 10 == 0))


def stops(df: DataFrame, least_minutes: int = 30) -> DataFrame:
    """Stops of at least ``least_minutes`` among session groups, with draught figures that leave zeros out."""
    drawn = F.nullif("draught", F.lit(0.0))
    out = sessions(stop_candidates(df)).groupBy("mmsi", "grp_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        F.min(drawn).alias("min_draught"), F.avg(drawn).alias("avg_draught"), F.max("draught").alias("max_draught"),
    )
    return out.where(F.col("end_time") - F.col("start_time") >= F.expr(f"interval '{least_minutes}' minute"))


def gap_hours(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("mmsi").orderBy("ts")
    return df.withColumn("gap_hours", F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 3.6e9, 3))
