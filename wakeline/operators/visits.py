"""Port visits: state of each point, the visit automaton, voyages between visits."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_m, point_in_ring
from wakeline.operators.spatial import near_any, nearest_place, place_map, small
from wakeline.operators.trajectory import drop_speed_jumps, last_in_bucket, median_filter5

PORT_RADIUS_M, BUFFER_M = 5000.0, 7500.0
GAP_H, MOST_GAP_H, LEAST_STAY_H = 12.0, 48.0, 1.0
# How a vessel at rest is reported.
AT_REST = ("Moored", "At anchor", "1", "5")
VISIT_DDL = "mmsi long, port_id long, arrival_time timestamp_ntz, departure_time timestamp_ntz, stay_duration_hours double, draught_m double, declared_destination string, n_positions long"


def state(sog: Column, nav_status: Column, in_port: Column) -> Column:
    """Speed decides first; an unknown speed counts as 0, and a status only helps a slow vessel."""
    knots = F.coalesce(sog, F.lit(0.0))
    stays = (knots < 1.0) & (F.coalesce(in_port, F.lit(False)) | F.coalesce(nav_status.isin(*AT_REST), F.lit(False)))
    return F.when(knots > 3.0, "UNDERWAY").when(stays, "STOPPED_IN_PORT").otherwise("TRANSITING")


def last_destination(df: DataFrame) -> DataFrame:
    """``last_destination``: the latest non-blank destination at or before each point."""
    w = Window.partitionBy("mmsi").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_destination", F.last(F.nullif(F.trim("destination"), F.lit("")), ignorenulls=True).over(w))


def upper_median(counts: dict[float, int]) -> float | None:
    """Of values with their counts; what an open visit holds is as many values as it met."""
    after = sum(counts.values()) // 2
    for value in sorted(counts):
        after -= counts[value]
        if after < 0:
            return value
    return None


#: A visit closes where a count exceeds its limit and all flags of one of the groups hold; counters are whole numbers.
CLOSING = (
    ("gap", MOST_GAP_H, ((),)),
    ("gap", GAP_H, (("moved",), ("far",))),
    ("away", 2, ((),)),
    ("underway", 2, (("outside",),)),
    ("moving", 1, (("moved", "outside"),)),
)


@dataclass
class Automaton:
    """The visit rules, one point at a time; ``open`` survives between batches of a stream."""

    ports: dict[int, tuple[float, float]]
    open: dict | None = None
    underway: int = 0
    away: int = 0
    previous: object = None
    done: list[dict] = field(default_factory=list)

    def _finish(self, end) -> None:
        visit, hours = self.open, (end - self.open["arrival"]).total_seconds() / 3600
        if hours >= LEAST_STAY_H:
            self.done.append({"port_id": visit["port"], "arrival_time": visit["arrival"], "departure_time": end, "stay_duration_hours": hours, "draught_m": upper_median(visit["draughts"]), "declared_destination": visit["destination"], "n_positions": visit["n"]})
        self.open = None

    def step(self, ts, port: int, in_port: bool, what: str, meters_to, draught, destination) -> None:
        """``meters_to(port)`` is the point's distance to a port."""
        if self.open:
            gap = (ts - self.previous).total_seconds() / 3600
            far = meters_to(self.open["port"]) > BUFFER_M
            if not far:
                port = self.open["port"]
            self.underway = self.underway + 1 if what == "UNDERWAY" else 0 if what == "STOPPED_IN_PORT" else max(0, self.underway - 1)
            self.away = self.away + 1 if far else 0
            seen = {"gap": gap, "underway": self.underway, "away": self.away, "moving": max(self.underway, self.away), "moved": port != self.open["port"], "far": far, "outside": not in_port}
            if any(seen[count] > most and any(all(seen[flag] for flag in flags) for flags in among) for count, most, among in CLOSING):
                self._finish(self.open["last"])
                self.underway = self.away = 0
            else:
                self._append(ts, draught)
        if not self.open and what == "STOPPED_IN_PORT" and in_port:
            self.open = {"port": port, "arrival": ts, "last": ts, "draughts": {}, "n": 0, "destination": destination}
            self._append(ts, draught)
            self.underway = self.away = 0
        self.previous = ts

    def _append(self, ts, draught) -> None:
        self.open["last"] = ts
        self.open["n"] += 1
        if draught is not None and draught == draught and draught > 0:
            self.open["draughts"][draught] = self.open["draughts"].get(draught, 0) + 1

    def close(self) -> None:
        if self.open:
            self._finish(self.previous)


def located(points: DataFrame, places: DataFrame, fences: DataFrame | None = None) -> DataFrame:
    """Points with the nearest port and ``in_port``: within the radius, and inside the port's ring where ``fences`` (place_id, ring) has one."""
    near = nearest_place(points, places).withColumn("in_port", F.col("distance_m") <= PORT_RADIUS_M)
    if fences is None:
        return near
    inside = point_in_ring(F.col("lon"), F.col("lat"), F.col("ring"))
    return near.join(small(fences.select("place_id", "ring")), "place_id", "left").withColumn("in_port", F.col("in_port") & (F.col("ring").isNull() | inside)).drop("ring")


def classified(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points with ``in_port``, whether any port is within the radius, and ``state``."""
    near = near_any(points, places, PORT_RADIUS_M, "in_port")
    return near.withColumn("state", state(F.col("sog"), F.col("nav_status"), F.col("in_port")))


def prepared_points(positions: DataFrame, places: DataFrame, fences: DataFrame | None = None) -> DataFrame:
    """Bucketed, cleaned, smoothed points with nearest port, state and last destination."""
    smooth = median_filter5(drop_speed_jumps(last_in_bucket(positions).drop("bucket")))
    near = located(smooth, places, fences)
    return last_destination(near.withColumn("state", state(F.col("sog"), F.col("nav_status"), F.col("in_port"))))


def port_visits(positions: DataFrame, places: DataFrame, fences: DataFrame | None = None) -> DataFrame:
    """Visits of every vessel; the ports, whose number is checked, travel with the tasks."""
    where = place_map(places)
    columns = ["ts", "place_id", "in_port", "state", "lon", "lat", "draught", "last_destination"]

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from wakeline.operators.trajectory import _haversine

        automaton = Automaton(where)
        for ts, port, in_port, what, lon, lat, draught, destination in pdf.sort_values("ts")[columns].itertuples(index=False):
            automaton.step(ts, port, in_port, what, lambda p: _haversine(lon, lat, *where[p]), draught, destination)  # noqa: B023
        automaton.close()
        out = pd.DataFrame(automaton.done, columns=["port_id", "arrival_time", "departure_time", "stay_duration_hours", "draught_m", "declared_destination", "n_positions"])
        out.insert(0, "mmsi", keys[0])
        return out

    return prepared_points(positions, places, fences).select("mmsi", *columns).groupBy("mmsi").applyInPandas(run, VISIT_DDL)


def voyages(visits: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Consecutive visits of a vessel, dropped after pairing where the next begins before this one ends."""
    w = Window.partitionBy("mmsi").orderBy("arrival_time", *(ties or ["port_id"]))
    following = F.lead(F.struct("port_id", "arrival_time", "draught_m")).over(w)
    paired = visits.withColumn("_next", following).where(F.col("_next").isNotNull() & (F.col("departure_time") < F.col("_next.arrival_time")))
    hours = (F.unix_micros(F.col("_next.arrival_time").cast("timestamp")) - F.unix_micros(F.col("departure_time").cast("timestamp"))) / 3.6e9
    return paired.select(
        "mmsi", F.col("port_id").alias("origin_port_id"), F.col("_next.port_id").alias("destination_port_id"), "departure_time",
        F.col("_next.arrival_time").alias("arrival_time"), hours.alias("voyage_duration_hours"), F.col("draught_m").alias("draught_at_origin_m"),
        F.col("_next.draught_m").alias("draught_at_dest_m"), "ship_type" if "ship_type" in visits.columns else F.lit(None).cast("string").alias("ship_type"),
    )


def trips_from_stops(stops: DataFrame, places: DataFrame, radius_m: float = 1000.0, least_m: float = 100_000.0) -> DataFrame:
    """Stops matched to ports and paired in time; pairs of one port and short pairs drop out."""
    from wakeline.operators.spatial import within_radius

    w = Window.partitionBy("mmsi").orderBy("start_time", "place_id")
    at = within_radius(stops, places, radius_m)
    paired = at.withColumn("_next", F.lead(F.struct("place_id", "lon", "lat", "min_draught", "avg_draught", "max_draught", "start_time")).over(w))
    distance = haversine_m(F.col("lon"), F.col("lat"), F.col("_next.lon"), F.col("_next.lat"))
    out = paired.where(F.col("_next").isNotNull() & (F.col("place_id") != F.col("_next.place_id"))).withColumn("distance_m", distance).where(F.col("distance_m") > least_m)
    return out.select("mmsi", F.col("place_id").alias("origin_id"), F.col("_next.place_id").alias("dest_id"), "start_time", F.col("max_draught").alias("o_max"), F.col("_next.max_draught").alias("d_max"), "distance_m")
