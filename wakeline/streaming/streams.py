"""Structured Streaming twins: buckets, sessions, incremental visits, idempotent writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.operators.relational import insert_absent
from wakeline.operators.spatial import place_map
from wakeline.operators.trajectory import _haversine
from wakeline.operators.visits import VISIT_DDL, Automaton
from wakeline.sources.shared import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; each file is taken once, as the checkpoint records."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")


def bucket_stream(events: DataFrame) -> DataFrame:
    """Last value and count of every user and ten minutes."""
    w = F.window("at", "10 minutes")
    out = events.groupBy(F.col("user_id").alias("mmsi"), w).agg(F.max_by("event_id", F.struct("at", "event_id")).alias("last_event"), F.count("*").alias("n"))
    return out.select("mmsi", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "last_event", "n")


def session_stream(events: DataFrame, gap: str = "30 minutes 1 microsecond") -> DataFrame:
    """Sessions that a gap of over 30 minutes ends; the extra microsecond keeps a gap of exactly 30 inside."""
    out = events.groupBy(F.col("user_id").alias("mmsi"), F.session_window("at", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return out.select("mmsi", "n", "start_time", "end_time")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and gives its result table, written to the shared folder.

    A batch writes to a path of its own number, so one that is run again replaces
    itself; in complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    path, done = shared_path(spark, "stream"), set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.add(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    numbers = [max(done)] if mode == "complete" else sorted(done)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in numbers])


def insert_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str | None = None, time: str | None = None):
    """Appends rows whose key the target does not hold yet; replays of a batch add nothing.

    With ``time``, only the target's rows in the batch's range of it are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = insert_absent(spark.read.parquet(path), fresh, keys, time)
        except AnalysisException as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, "insert-checkpoint")).trigger(availableNow=True).start()


def incremental_visits(points: DataFrame, places: DataFrame, final: bool = False) -> DataFrame:
    """Visits closed so far; the open visit and its counters are the state of a vessel.

    ``points`` is a stream of prepared points (place_id, in_port, state, ...). With
    ``final`` a visit still open at the end of a batch is closed.
    """
    where = place_map(places)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        machine = Automaton(where)
        if state.exists:
            machine.open, machine.underway, machine.away, machine.previous = pickle.loads(state.get[0])
        rows = pd.concat(list(batches)).sort_values("ts")
        for r in rows.itertuples(index=False):
            if machine.previous is not None and r.ts <= machine.previous:
                continue  # late or repeated
            machine.step(r.ts, r.place_id, r.in_port, r.state, lambda p: _haversine(r.lon, r.lat, *where[p]), r.draught, r.last_destination)  # noqa: B023
        if final:
            machine.close()
        state.update((pickle.dumps((machine.open, machine.underway, machine.away, machine.previous)),))
        out = pd.DataFrame(machine.done, columns=["port_id", "arrival_time", "departure_time", "stay_duration_hours", "draught_m", "declared_destination", "n_positions"])
        out.insert(0, "mmsi", key[0])
        yield out

    return points.groupBy("mmsi").applyInPandasWithState(step, VISIT_DDL, "machine binary", "append", GroupStateTimeout.NoTimeout)


def visits_of(points: DataFrame, places: DataFrame) -> DataFrame:
    """The visits of a bounded set of points, taken through the stream."""
    folder = shared_path(points.sparkSession, "points")
    points.select("mmsi", "ts", "place_id", "in_port", "state", "lon", "lat", "draught", "last_destination").write.parquet(folder)
    stream = points.sparkSession.readStream.schema(points.sparkSession.read.parquet(folder).schema).parquet(folder)
    return run_to_end(incremental_visits(stream, places, final=True), "append")
