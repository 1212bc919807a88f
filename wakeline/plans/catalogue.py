"""Named queries over the adapter views. Their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions import geo, stats, text
from wakeline.operators import aggregates as agg
from wakeline.operators import ml, relational, spatial, trajectory
from wakeline.operators import visits as visit_ops
from wakeline.sources import adapters as a
from wakeline.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def places(ports: DataFrame) -> DataFrame:
    return ports.select(F.col("port_id").alias("place_id"), F.col("lon").alias("place_lon"), F.col("lat").alias("place_lat"))


# Cleaning, de-duplication, upserts


@query
def clean_events_cast(spark, d):
    e = a.table(spark, d, "events")
    raw = F.replace(F.format_string("%.2f", F.col("value")), F.lit("."), F.lit(","))
    return e.select("event_id", relational.number(raw).alias("value"), relational.day_first_timestamp(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz").alias("ts"), relational.number(F.lit("n/a")).alias("bad"), F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("event_type"))


@query
def quarantine_split(spark, d):
    e = a.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    good, bad = relational.quarantine(e, (F.col("k") >= 10) & (F.col("value") > 1))
    return good.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("part", F.lit("good")).unionByName(bad.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("part", F.lit("bad")))


@query
def dedupe_first(spark, d):
    v = a.visits(spark, d)
    return relational.first_per_key(v, ["mmsi", "port_id", "arrival_time"], [F.col("order_key"), F.col("line_number"), F.col("part_key")]).select("mmsi", "port_id", "arrival_time", "order_key", "line_number", "stay_duration_hours")


@query
def distinct_on_latest(spark, d):
    e = a.table(spark, d, "events")
    return relational.latest_per_key(e.select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id")


@query
def anti_join_insert(spark, d):
    e = a.table(spark, d, "events").select(F.col("user_id").alias("mmsi"), "ts", "event_id")
    return relational.insert_absent(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0"), ["mmsi", "ts"], "ts").select("mmsi", "event_id")


@query
def vessel_upsert(spark, d):
    c = a.table(spark, d, "customer")
    stored = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"))
    staged = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("mmsi"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("name"), F.lit(2).alias("first_seen"), F.lit(2).alias("last_seen"))
    return relational.upsert(stored, staged, "mmsi", keep_old=("first_seen",), take_new=("last_seen",))


@query
def ledger_skip(spark, d):
    days = a.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("file_path")).distinct()
    return readers.unread_files(days, days.where(F.dayofmonth(F.to_date("file_path")) <= 10))


# Relational joins


@query
def visits_with_ports(spark, d):
    v = a.visits(spark, d)
    return v.groupBy("port_id", "port_name", "un_locode").agg(F.count("*").alias("n"), F.round(F.sum("stay_duration_hours"), 3).alias("hours"))


def _linked_terminals(spark, d):
    t = a.terminals(spark, d)
    link = spatial.nearest_within(t.select(F.col("id").alias("key"), "lon", "lat"), "key", places(a.ports(spark, d)), 10_000.0)
    return t.join(link, t.id == link.key).drop("key")


@query
def terminal_nearest_port(spark, d):
    return _linked_terminals(spark, d).select("id", F.col("place_id").alias("port_id"), F.round("distance_m", 3).alias("distance_m"))


@query
def ports_terminal_counts(spark, d):
    t = _linked_terminals(spark, d)
    return a.ports(spark, d).join(t.select("place_id", "id"), F.col("port_id") == F.col("place_id"), "left").groupBy("port_id", "name").agg(F.count("id").alias("n_terminals"))


@query
def terminals_with_parent(spark, d):
    p = a.ports(spark, d).select("port_id", F.col("name").alias("port_name"), "un_locode")
    return _linked_terminals(spark, d).join(p, F.col("place_id") == F.col("port_id"), "left").select("id", "name", "port_id", "port_name", "un_locode")


@query
def top_ports_by_terminals(spark, d):
    return ports_terminal_counts(spark, d).where("n_terminals > 0").orderBy(F.desc("n_terminals"), "port_id").limit(20)


@query
def union_port_points(spark, d):
    ports, t = a.ports(spark, d), _linked_terminals(spark, d)
    points = ports.select("port_id", "lon", "lat").unionByName(t.where("place_id is not null").select(F.col("place_id").alias("port_id"), "lon", "lat"))
    return points.groupBy("port_id").agg(F.count("*").alias("n_points"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query
def geofence_area(spark, d):
    ports, t = a.ports(spark, d), _linked_terminals(spark, d)
    points = ports.select("port_id", "lon", "lat").unionByName(t.where("place_id is not null").select(F.col("place_id").alias("port_id"), "lon", "lat"))
    return spatial.geofences(points, "port_id").select("port_id", "n_points", "area_sq_km", F.size("ring").alias("ring_points"))


@query
def stop_port_radius(spark, d):
    s = trajectory.stops(a.positions(spark, d))
    return spatial.within_radius(s, places(a.ports(spark, d)), 1000.0).select("mmsi", "start_time", F.col("place_id").alias("port_id"), F.round("distance_m", 3).alias("distance_m"))


def _nearest_port(spark, d, p):
    return spatial.nearest_place(p, places(a.ports(spark, d))).groupBy(F.col("place_id").alias("port_id")).agg(F.count("*").alias("n"), F.round(F.max("distance_m"), 3).alias("farthest_m"))


@query
def nearest_port_unbounded(spark, d):
    return _nearest_port(spark, d, a.positions(spark, d))


def _in_fence(spark, d, p):
    port = a.ports(spark, d)
    x, y = F.col("lon"), F.col("lat")
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    fence = port.select(F.col("port_id").alias("place_id"), F.col("lon").alias("place_lon"), F.col("lat").alias("place_lat"), F.array(corner(-0.00121, -0.00071), corner(0.00121, -0.00071), corner(0.0, 0.00123)).alias("ring"))
    near = spatial.within_radius(p, fence, 5000.0)
    return near.groupBy(F.col("place_id").alias("port_id")).agg(F.count("*").alias("near"), F.count_if(geo.point_in_ring(x, y, F.col("ring"))).alias("inside"))


@query
def point_in_fence(spark, d):
    return _in_fence(spark, d, a.positions(spark, d))


# Tracks


@query
def bucket_last_10m(spark, d):
    p = trajectory.last_in_bucket(a.positions(spark, d))
    return p.select("mmsi", "bucket", "ts", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "sog", "nav_status", "destination", "draught")


@query
def bucket_avg_last_10m(spark, d):
    p = trajectory.last_in_bucket(a.positions(spark, d), average_speed=True)
    return p.select("mmsi", "bucket", "avg_sog", F.coalesce("nav_status", F.lit("Unknown")).alias("nav_status"), "draught")


@query
def vessel_watermark(spark, d):
    return a.visits(spark, d).groupBy("mmsi").agg(F.max("departure_time").alias("last_departure"))


@query
def stop_sessions(spark, d):
    s = trajectory.sessions(trajectory.stop_candidates(a.positions(spark, d)))
    return s.groupBy("mmsi", "grp_id").agg(F.count("*").alias("n"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))


@query
def stop_aggregates(spark, d):
    s = trajectory.stops(a.positions(spark, d))
    return s.select("mmsi", "grp_id", "start_time", "end_time", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "min_draught", "avg_draught", "max_draught")])


def _trips(spark, d):
    return visit_ops.trips_from_stops(trajectory.stops(a.positions(spark, d)), places(a.ports(spark, d)))


@query
def od_trips(spark, d):
    t = _trips(spark, d)
    return t.groupBy("origin_id", "dest_id").agg(F.count("*").alias("trips"), F.countDistinct("mmsi").alias("vessels"), F.round(F.avg("distance_m"), 3).alias("mean_distance_m"), F.max("d_max").alias("max_draught"))


@query
def voyages_from_visits(spark, d):
    v = visit_ops.voyages(a.visits(spark, d), ["departure_time", "port_id", "order_key", "line_number", "part_key"])
    return v.select("mmsi", "origin_port_id", "destination_port_id", "departure_time", "arrival_time", F.round("voyage_duration_hours", 6).alias("voyage_duration_hours"))


@query
def median_filter5(spark, d):
    p = trajectory.median_filter5(a.positions(spark, d))
    return p.select("mmsi", "ts", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query
def state_classify(spark, d):
    p = visit_ops.classified(a.positions(spark, d), places(a.ports(spark, d)))
    return p.groupBy("state", "nav_status").agg(F.count("*").alias("n"))


@query
def last_destination_before(spark, d):
    p = visit_ops.last_destination(a.positions(spark, d))
    return p.groupBy("mmsi", "last_destination").agg(F.count("*").alias("n"))


@query
def speed_jump_filter(spark, d):
    return trajectory.drop_speed_jumps(a.positions(spark, d)).groupBy("mmsi").agg(F.count("*").alias("kept"))


@query
def simplify_track(spark, d):
    p = trajectory.tracks(a.positions(spark, d))
    return p.groupBy("mmsi").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def tracker_tracks(spark, d):
    p = trajectory.tracks(a.positions(spark, d))
    point = F.struct("ts", "lat", "lon", "sog", "nav_status", "destination", "draught")
    return p.groupBy("mmsi").agg(F.to_json(F.array_sort(F.collect_list(point))).alias("track"))


@query
def port_visits_state_machine(spark, d):
    return visit_ops.port_visits(a.positions(spark, d), places(a.ports(spark, d)))


@query
def track_gaps(spark, d):
    return trajectory.gap_hours(a.positions(spark, d)).groupBy("mmsi").agg(F.max("gap_hours").alias("max_gap_hours"), F.count_if(F.col("gap_hours") > 12).alias("long_gaps"))


# Routes


def _voyages(spark, d):
    return visit_ops.voyages(a.visits(spark, d), ["departure_time", "port_id", "order_key", "line_number", "part_key"])


@query
def route_stats_v1(spark, d):
    return agg.routes(_voyages(spark, d), None)


@query
def route_stats_v2(spark, d):
    return agg.routes(_voyages(spark, d), 0.0)


@query
def port_rollup_v2(spark, d):
    return agg.port_rollup(agg.routes(_voyages(spark, d)))


@query
def vessel_rollup_v2(spark, d):
    return agg.vessel_rollup(agg.route_vessels(_voyages(spark, d)))


@query
def top_destinations(spark, d):
    return agg.destinations_per_origin(agg.routes(_voyages(spark, d)), 1, 500)


@query
def search_routes(spark, d):
    r = agg.routes(_voyages(spark, d))
    p = a.ports(spark, d).select("port_id", "name", "un_locode")
    o, t = p.select(*[F.col(c).alias(f"o_{c}") for c in p.columns]), p.select(*[F.col(c).alias(f"d_{c}") for c in p.columns])
    j = r.join(spatial.small(o), F.col("origin_port_id") == F.col("o_port_id")).join(spatial.small(t), F.col("destination_port_id") == F.col("d_port_id"))
    return j.where(F.col("trips").between(2, 100) & relational.any_contains("0007", F.col("o_name"), F.col("d_name"), F.col("o_un_locode"), F.col("d_un_locode"))).select("origin_port_id", "destination_port_id", "trips")


@query
def search_ports(spark, d):
    return a.ports(spark, d).where(relational.any_contains("nation_1", F.col("name"), F.col("country_code"), F.col("un_locode"))).select("port_id", "name", "country_code")


@query
def hit_counts(spark, d):
    p, v = a.ports(spark, d), a.vessels(spark, d)
    ports = p.agg(F.count_if(relational.any_contains("9", F.col("name"), F.col("un_locode"))).alias("hits")).withColumn("kind", F.lit("ports"))
    return ports.unionByName(v.agg(F.count_if(relational.any_contains("build", F.col("name"), F.col("ship_type"))).alias("hits")).withColumn("kind", F.lit("vessels")))


@query
def route_style(spark, d):
    r = agg.routes(_voyages(spark, d))
    most = r.agg(F.greatest(F.max("trips"), F.lit(100)).alias("most"))
    return r.crossJoin(F.broadcast(most)).select("origin_port_id", "destination_port_id", F.round(stats.traffic_level(F.col("trips"), F.col("most")), 6).alias("level"), F.round(2 + 3 * F.sqrt(F.col("trips")), 6).alias("radius"))


# Stays and features


@query
def stay_stats_global(spark, d):
    return agg.stay_stats(a.visits(spark, d).where("stay_duration_hours >= 1").withColumn("scope", F.lit("all")), ["scope"])


@query
def stay_stats_by_type(spark, d):
    return agg.stay_stats(a.visits(spark, d).where("stay_duration_hours >= 1 and trim(coalesce(ship_type, '')) <> ''"), ["ship_type"], 100)


@query
def stay_stats_by_port(spark, d):
    v = a.visits(spark, d).withColumn("group_key", F.when(F.col("un_locode") != "N/A", F.col("un_locode")).otherwise(F.concat(F.lit("PORT_"), "port_id")))
    return agg.stay_stats(v, ["group_key"])


@query
def stay_histogram(spark, d):
    return agg.duration_histogram(a.visits(spark, d))


def stays(spark, d):
    """Visits of an hour or more, which features are made of."""
    return a.visits(spark, d).where("stay_duration_hours >= 1")


for _name in ("volume", "stay", "ship_type", "size", "temporal", "seasonal", "flow"):
    QUERIES[f"feat_{_name}"] = lambda spark, d, f=getattr(agg, f"{_name}_features"): f(stays(spark, d))


@query
def feature_matrix(spark, d):
    return agg.feature_matrix(stays(spark, d), a.ports(spark, d))


@query
def coverage_report(spark, d):
    return relational.null_coverage(a.visits(spark, d).select("mmsi", "ship_type", "declared_destination", "draught_m", "length_m"))


@query
def wpi_encode(spark, d):
    p = a.table(spark, d, "part")
    size = F.element_at(F.array(F.lit("Very Small"), F.lit("Small"), F.lit("Medium"), F.lit("Large"), F.lit("?")), (F.col("p_size") % 5 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit("Yes"), F.lit("No"), F.lit("Unknown"), F.lit(" yes ")), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", ml.ordinal(size, ["Very Small", "Small", "Medium", "Large"], 1).alias("harbor_size"), ml.yes_no(flag).alias("facility"))


@query
def draught_utilization(spark, d):
    from wakeline.operators import reports

    return reports.port_matrix(stays(spark, d), a.ports(spark, d), a.port_index(spark, d), 1).select("un_locode", F.round("draught_utilization", 6).alias("draught_utilization"))


# Destinations


@query
def dest_normalize(spark, d):
    t = F.concat(F.substring("n_name", 1, 2), F.lit(" "), F.lpad((F.col("n_nationkey") + 100).cast("string"), 3, "0"))
    return a.table(spark, d, "nation").select("n_nationkey", text.normalize_locode(F.lower(t)).alias("locode"), text.normalize_locode(F.col("n_name")).alias("name"))


@query
def dest_candidates(spark, d):
    n = a.table(spark, d, "nation")
    raw = F.concat(F.lit("route "), F.lit("DKFDH->"), F.substring("n_name", 1, 2), F.lit(" "), (F.col("n_nationkey") + 100).cast("string"), F.lit(" /AREA"))
    return n.select("n_nationkey", F.array_join(text.destination_candidates(raw), "|").alias("candidates"))


@query
def dest_clean(spark, d):
    p = a.table(spark, d, "part")
    return p.select("p_partkey", text.clean_name(F.concat(F.lit("Ø-"), "p_name", F.lit(" havn, dk (ferry)"))).alias("cleaned"))


@query
def dest_garbage(spark, d):
    v = a.visits(spark, d).where("declared_destination is not null")
    return v.groupBy("declared_destination").agg(F.count("*").alias("n")).withColumn("garbage", text.is_garbage(F.col("declared_destination")))


@query
def dest_exact_match(spark, d):
    v = a.visits(spark, d).where("declared_destination is not null")
    hit = text.exact_match(text.destination_candidates(F.col("declared_destination")), F.col("un_locode"))
    return v.groupBy("port_id").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


def _matched(spark, d, fuzzy=False):
    return agg.match_status(a.visits(spark, d).where("trim(coalesce(declared_destination, '')) <> ''"), fuzzy)


@query
def dest_match_status(spark, d):
    return agg.match_rates(_matched(spark, d).withColumn("scope", F.lit("all")), ["scope"])


@query
def dest_match_fuzzy(spark, d):
    return agg.match_rates(_matched(spark, d, True), ["un_locode"])


@query
def dest_accuracy_by_type(spark, d):
    return agg.match_rates(_matched(spark, d).where("ship_type is not null"), ["ship_type"], 50)


@query
def dest_accuracy_by_locode(spark, d):
    return agg.match_rates(_matched(spark, d), ["un_locode"], 9)


@query
def dest_top_pairs(spark, d):
    pair = F.concat(F.coalesce("un_locode", F.lit("?")), F.lit(" -> "), F.col("declared_destination"))
    return _matched(spark, d).where("match_status = 'MISMATCH'").groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(50)


@query
def dest_confusion(spark, d):
    return agg.confusion(a.visits(spark, d), "port_name", "declared_destination")


@query
def top_vessels_per_type(spark, d):
    v = a.visits(spark, d)
    both = v.select("mmsi", "ship_type", F.col("arrival_time").alias("at")).unionByName(_voyages(spark, d).select("mmsi", "ship_type", F.col("departure_time").alias("at")))
    return agg.top_vessels_per_type(both.groupBy("mmsi").agg(F.count("*").alias("n"), F.min_by("ship_type", F.struct("at", "ship_type")).alias("ship_type")))


# Views of the map and the dashboards


@query
def track_prefix(spark, d):
    w = Window.partitionBy("mmsi").orderBy("ts")
    return a.positions(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 20").groupBy("mmsi").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query
def observed_span(spark, d):
    e = a.table(spark, d, "events").groupBy(F.col("user_id").alias("mmsi")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return e.where(F.col("last_seen") - F.col("first_seen") > F.expr("interval '3' day")).orderBy(F.desc(F.col("last_seen") - F.col("first_seen")), "mmsi").limit(50)


@query
def vessels_anywhere(spark, d):
    return a.visits(spark, d).select("mmsi").union(a.positions(spark, d).select("mmsi")).distinct()


@query
def arrivals_by_hour(spark, d):
    counts = a.visits(spark, d).groupBy(F.hour("arrival_time").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query
def draught_bars(spark, d):
    r = agg.routes(_voyages(spark, d), 0.0)
    return r.select("origin_port_id", "destination_port_id", F.round(F.least(F.lit(100.0), F.col("avg_draught") / 15.0 * 100), 6).alias("avg_pct"), F.round(F.least(F.lit(100.0), F.col("max_draught") / 15.0 * 100), 6).alias("max_pct"))


@query
def route_ids(spark, d):
    r = agg.routes(_voyages(spark, d)).select(F.concat_ws("_", "origin_port_id", "destination_port_id").alias("route_id"), "trips")
    return r.select("route_id", F.split_part("route_id", F.lit("_"), F.lit(1)).cast("long").alias("origin_id"), F.split_part("route_id", F.lit("_"), F.lit(2)).cast("long").alias("dest_id"), "trips")


@query
def destination_port_fallback(spark, d):
    p = a.ports(spark, d)
    by_code = p.groupBy("un_locode").agg(F.min("port_id").alias("code_id"))
    by_name = p.select(F.lower("name").alias("lower_name"), F.col("port_id").alias("name_id"))
    names = a.visits(spark, d).where("declared_destination is not null").groupBy("declared_destination").agg(F.count("*").alias("n"))
    out = names.join(by_code, F.col("declared_destination") == F.col("un_locode"), "left").join(by_name, F.lower("declared_destination") == F.col("lower_name"), "left")
    return out.select("declared_destination", "n", F.coalesce("code_id", "name_id").alias("port_id"))


@query
def known_destinations(spark, d):
    return a.visits(spark, d).groupBy(relational.is_known(F.col("declared_destination")).alias("known")).agg(F.count("*").alias("n"))


@query
def feature_labels(spark, d):
    f = spark.createDataFrame([(x,) for x in agg.size_features(a.visits(spark, d)).columns], "feature string")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("feature", "^pct_", ""), "_[mh]$", ""), "_int$", "")
    return f.select("feature", F.initcap(F.replace(clean, F.lit("_"), F.lit(" "))).alias("label"))


@query
def chord_distances(spark, d):
    p = a.ports(spark, d)
    o = p.where("port_id = 0").select(F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    return p.crossJoin(F.broadcast(o)).select("port_id", F.round(geo.chord_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), 3).alias("chord_m"))


@query
def route_payloads(spark, d):
    v = _voyages(spark, d)
    return sinks.route_payload(agg.routes(v), agg.route_vessels(v), a.ports(spark, d))


@query
def json_safe(spark, d):
    e = a.table(spark, d, "events")
    odd = e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return sinks.finite(odd)


# Machine learning


def _features(spark, d, k=6):
    e = a.table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(k)])


@query
def corr_matrix(spark, d):
    return ml.correlations(_features(spark, d), [f"f{i}" for i in range(6)])


@query
def clr_transform(spark, d):
    return ml.centred_log_ratio(_features(spark, d).select("vec_id", *[F.greatest(F.col(f"f{i}") * 100, F.lit(0.0)).alias(f"f{i}") for i in range(4)]), [f"f{i}" for i in range(4)])


@query
def robust_scale(spark, d):
    return ml.robust_scale(_features(spark, d).drop("label"), [f"f{i}" for i in range(6)])


@query
def cluster_names_from_labels(spark, d):
    return ml.cluster_names(_features(spark, d), "label", [f"f{i}" for i in range(6)])


@query
def group_compare(spark, d):
    return ml.group_means(_features(spark, d), "label", [f"f{i}" for i in range(6)])


@query
def crosstab_margins(spark, d):
    f = _features(spark, d).select(F.col("label"), F.when(F.col("f0") > 0, "hi").otherwise("lo").alias("side"))
    return agg.crosstab_with_margins(f, "label", "side")


@query
def kmeans_labels(spark, d):
    x = ml.matrix(_features(spark, d), "vec_id", [f"f{i}" for i in range(6)])
    return ml.kmeans(x, 4)


@query
def pca_coords(spark, d):
    return ml.pca(ml.matrix(_features(spark, d), "vec_id", [f"f{i}" for i in range(6)]), 0.85)


@query
def k_selection(spark, d):
    return ml.select_k(ml.whole(_features(spark, d), "vec_id", [f"f{i}" for i in range(6)]), spark)


@query
def dbscan_labels(spark, d):
    return ml.dbscan_frame(ml.whole(_features(spark, d), "vec_id", [f"f{i}" for i in range(6)]), spark)


@query
def hopkins(spark, d):
    return ml.hopkins_frame(ml.whole(_features(spark, d), "vec_id", [f"f{i}" for i in range(6)]), spark)


@query
def yeo_johnson(spark, d):
    return ml.yeo_johnson(_features(spark, d), "vec_id", ["f0", "f1"])


@query
def knn_impute(spark, d):
    holes = _features(spark, d).select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("f0")).alias("f0"), "f1", "f2")
    return ml.knn_impute_frame(ml.whole(holes, "vec_id", ["f0", "f1", "f2"]), spark)


# Streaming, run to the end of a bounded input


@query
def stream_bucket_10m(spark, d):
    from wakeline.streaming import streams

    return streams.run_to_end(streams.bucket_stream(streams.event_stream(spark, d)), "complete")


@query
def stream_sessions(spark, d):
    from wakeline.streaming import streams

    return streams.run_to_end(streams.session_stream(streams.event_stream(spark, d)), "complete")


@query
def stream_visits(spark, d):
    from wakeline.streaming import streams

    points = visit_ops.prepared_points(a.positions(spark, d), places(a.ports(spark, d)))
    return streams.visits_of(points, places(a.ports(spark, d)))

