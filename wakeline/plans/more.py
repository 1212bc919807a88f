"""Further queries, each with its SQL twin beside it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wakeline.functions import styles, text
from wakeline.operators import aggregates as agg
from wakeline.operators import profiles, relational, reports, spatial, trajectory
from wakeline.operators import visits as visit_ops
from wakeline.plans import catalogue as c
from wakeline.plans import oracles as o
from wakeline.sources import adapters as a
from wakeline.sources import readers, sinks
from wakeline.sources.shared import shared_path


def query(sql: str | None = None):
    def add(f):
        c.QUERIES[f.__name__] = f
        if sql:
            o.ORACLE_SQL[f.__name__] = sql
        return f

    return add


_POS = o._with(o.PORTS, o.POSITIONS)
_VIS = o._with(o.PORTS, o.VISITS)
_VOY = o._with(o.PORTS, o.VISITS, o.VOYAGES)
_TRIPS = o.ORACLE_SQL["od_trips"].rsplit("select port_id as origin_id", 1)[0] + """, drawn as (
  select mmsi, port_id as origin_id, dest_id, max_draught as o_max, d_max, greatest(coalesce(max_draught, 0), coalesce(d_max, 0)) as draught from trips where distance_m > 100000)
"""
_FIGURES = "round(min({0}), 2) as min_draught, round(avg({0}), 6) as avg_draught, round(max({0}), 2) as max_draught"


# Rows by time and key


@query(_POS + "select mmsi, ts, min(ts) over (partition by mmsi) as first_seen, max(ts) over (partition by mmsi) as last_seen from positions")
def vessel_seen_span(spark, d):
    w = Window.partitionBy("mmsi")
    return a.positions(spark, d).select("mmsi", "ts", F.min("ts").over(w).alias("first_seen"), F.max("ts").over(w).alias("last_seen"))


@query(_POS + "select mmsi, count(*) as n, max(ts) as last_ts from positions where mmsi in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1")
def positions_of_keys(spark, d):
    keys = a.vessels(spark, d).where("ship_type = 'BUILDING'").select("mmsi")
    return a.positions(spark, d).join(keys, "mmsi", "left_semi").groupBy("mmsi").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(_POS + ", marks as (select mmsi, min(ts) + interval 2 day as seen_until from positions where sog > 3 group by 1) select p.mmsi, count(*) as n, min(ts) as first_new from positions p left join marks m on m.mmsi = p.mmsi where seen_until is null or ts > seen_until group by 1")
def positions_after_watermark(spark, d):
    p = a.positions(spark, d)
    marks = p.where("sog > 3").groupBy("mmsi").agg((F.min("ts") + F.expr("interval '2' day")).alias("seen_until"))
    return reports.after_watermark(p, marks, "mmsi", "ts", "seen_until").groupBy("mmsi").agg(F.count("*").alias("n"), F.min("ts").alias("first_new"))


@query(_POS + "select mmsi, count(*) as n from positions where ts > (select max(ts) from positions) - interval 7 day group by 1")
def recent_positions(spark, d):
    return reports.recent(a.positions(spark, d), "ts", 7).groupBy("mmsi").agg(F.count("*").alias("n"))


@query(_POS + "select p.mmsi, p.ship_type, first_seen, last_seen from (select user_id as mmsi, min(ts) as first_seen, max(ts) as last_seen from events group by 1) e join (select distinct mmsi, ship_type from (" + _VIS + "select * from visits)) p using (mmsi) where ship_type in ('Cargo', 'Tanker') and last_seen - first_seen > interval 3 day")
def target_vessels(spark, d):
    seen = a.table(spark, d, "events").groupBy(F.col("user_id").alias("mmsi")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    types = a.visits(spark, d).select("mmsi", "ship_type").distinct().where(F.col("ship_type").isin("Cargo", "Tanker"))
    return types.join(seen, "mmsi").where(F.col("last_seen") - F.col("first_seen") > F.expr("interval '3' day"))


@query("select c_custkey::varchar as mmsi from customer order by c_custkey desc")
def vessels_by_number(spark, d):
    return a.vessels(spark, d).select(F.col("mmsi").cast("string").alias("mmsi")).orderBy(F.desc(F.col("mmsi").cast("long")))


@query(o._with(o.PORTS) + "select port_id, name, un_locode from ports order by name, port_id")
def ports_by_name(spark, d):
    return a.ports(spark, d).select("port_id", "name", "un_locode").orderBy("name", "port_id")


@query("select 'events' as tbl, (select count(*) from events) > 0 as filled union all select 'none', false")
def table_guards(spark, d):
    e = a.table(spark, d, "events")
    return spark.createDataFrame([("events", reports.has_rows(e)), ("none", reports.has_rows(e.where("event_id < -1")))], "tbl string, filled boolean")


# Inserts and files


@query(_VIS + "select distinct mmsi, port_id, arrival_time from visits v where line_number >= 2 and not exists (select 1 from visits s where s.line_number < 3 and s.mmsi = v.mmsi and s.port_id = v.port_id and s.arrival_time = v.arrival_time)")
def visit_insert_ignore(spark, d):
    v, keys = a.visits(spark, d), ["mmsi", "port_id", "arrival_time"]
    staged = v.where("line_number >= 2").select(*keys).dropDuplicates(keys)
    return relational.insert_absent(v.where("line_number < 3").select(*keys), staged, keys, "arrival_time")


@query("select s_nationkey as wpi_number, min(s_suppkey) as port_id from supplier where s_nationkey not in (select s_nationkey from supplier where s_suppkey < 3) group by 1")
def port_insert_ignore(spark, d):
    p = a.table(spark, d, "supplier").select(F.col("s_nationkey").alias("wpi_number"), F.col("s_suppkey").alias("port_id"))
    return reports.insert_first(p.where("port_id < 3"), p, "wpi_number", [F.col("port_id")])


@query(_VOY + "select 'visits' as part, count(*) as n from visits union all select 'voyages', count(*) from voyages union all select 'metadata', 1")
def run_output(spark, d):
    path, v = shared_path(spark, "run"), a.visits(spark, d)
    sinks.write_run(v, c._voyages(spark, d), path, "2025-01-01T00:00:00Z")
    kinds = {"visits": "mmsi long, port_id long", "voyages": "mmsi long", "metadata": "visits long"}
    parts = [readers.json_lines(spark, f"{path}/{k}", s).agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, s in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_VOY + "select 'routes' as part, (select count(*) from route_rows) as n union all select 'ports', (select count(distinct p) from (select origin_port_id as p from route_rows union all select destination_port_id from route_rows)) union all select 'vessels', (select count(distinct mmsi) from voyages) union all select 'wpi_ports', (select count(*) from ports) union all select 'terminals', (select count(*) from part) union all select 'geofences', (select count(*) from ports) union all select 'stats', 1")
def route_map_documents(spark, d):
    ports, voyages = a.ports(spark, d), c._voyages(spark, d)
    ring = F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.0, 0.01))])
    docs = sinks.route_map(agg.routes(voyages), agg.route_vessels(voyages), ports, a.terminals(spark, d), ports.select("port_id", ring.alias("ring")), "2025-01-01T00:00:00Z")
    path = shared_path(spark, "route-map")
    sinks.write_route_map(docs, path)
    parts = [spark.read.text(f"{path}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in docs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(o.ORACLE_SQL["ports_by_name"].replace("select port_id, name, un_locode from ports order by name, port_id", "select port_id, name, un_locode, round(lon, 3) as lon from ports"))
def geojson_round_trip(spark, d):
    """Ports as one FeatureCollection a part, read again."""
    p, path = a.ports(spark, d), shared_path(spark, "collection")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    sinks.feature_collection(p.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("port_id", "name", "un_locode").alias("properties"), point.alias("geometry"))).alias("feature")), path)
    kind = "struct<features:array<struct<properties:struct<port_id:long,name:string,un_locode:string>,geometry:struct<coordinates:array<double>>>>>"
    rows = spark.read.text(path).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    return rows.select("f.properties.*", F.round(F.col("f.geometry.coordinates")[0], 3).alias("lon"))


@query("select * from (" + o.ORACLE_SQL["feat_temporal"] + ")")
def csv_round_trip(spark, d):
    path = shared_path(spark, "matrix")
    sinks.write_csv(agg.temporal_features(c.stays(spark, d)), path)
    return spark.read.csv(path, header=True, schema="un_locode string, night_visit_ratio double, weekend_visit_ratio double, peak_hour_entropy double")


@query(_POS + "select ts as timestamp, mmsi, round(lon, 4) as longitude, round(lat, 4) as latitude, sog as speed_over_ground, nav_status as navigational_status, 'POINT(' || printf('%.4f', lon) || ' ' || printf('%.4f', lat) || ')' as position from positions")
def position_file(spark, d):
    """Positions written as a raw file of decimal commas and day-first times, read and cleaned."""
    path, p = shared_path(spark, "raw"), a.positions(spark, d)
    comma = lambda x, n: F.regexp_replace(F.format_string(f"%.{n}f", F.col(x)), r"\.", ",")
    own = {"# Timestamp": F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), "MMSI": F.col("mmsi").cast("string"), "Longitude": comma("lon", 4), "Latitude": comma("lat", 4), "SOG": comma("sog", 1), "Navigational status": F.concat(F.lit(" "), "nav_status"), "IMO": F.lit("Unknown"), "Draught": F.lit("n/a")}
    p.select(*[own.get(x, F.lit(None).cast("string")).alias(x) for x in readers.RAW_COLUMNS]).write.csv(path, header=True, quoteAll=True)
    clean = readers.clean_positions(readers.position_csv(spark, path))
    point = F.concat(F.lit("POINT("), F.format_string("%.4f", "longitude"), F.lit(" "), F.format_string("%.4f", "latitude"), F.lit(")"))
    return clean.where("draught_m is null and imo = 'Unknown'").select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "mmsi", "longitude", "latitude", "speed_over_ground", "navigational_status", point.alias("position"))


@query("select s_suppkey::varchar as wpi_number, trim(s_name) as name, nullif(s_suppkey % 3, 0)::double as depth, 54.0::double + s_suppkey % 7 as latitude from supplier where s_suppkey % 5 <> 0")
def port_file(spark, d):
    """A port file with blank names, zero depths and zero latitudes, read by its header."""
    path, s = shared_path(spark, "ports"), a.table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit(" "), "s_name")).otherwise(" ")
    cells = [F.col("s_suppkey").alias("World Port Index Number"), name.alias("Main Port Name"), (F.col("s_suppkey") % 3).alias("Channel Depth"), (F.col("s_suppkey") % 7 + 54).alias("Latitude"), F.lit(0).alias("Longitude"), F.lit("x").alias("Other")]
    s.select(*[x.cast("string") for x in cells]).write.csv(path, header=True, quoteAll=True)
    names = {"World Port Index Number": "wpi_number", "Main Port Name": "name", "Channel Depth": "depth", "Latitude": "latitude", "Longitude": "longitude", "Not there": "none"}
    return readers.port_csv(spark, path, names, {"depth", "latitude", "longitude"}).drop("longitude")


@query("select case p_partkey % 3 when 0 then p_name when 1 then 'en ' || p_name else 'Unknown' end as name, 9.0::double + (p_partkey % 97) * 0.05::double as lon, 54.0::double + (p_partkey % 53) * 0.01::double as lat from part where p_partkey % 11 <> 0")
def terminal_file(spark, d):
    """A GeoJSON document of points, some without coordinates, some without a name."""
    path, t = shared_path(spark, "terminals"), a.terminals(spark, d)
    kind = F.col("id") % 3
    names = F.struct(F.when(kind == 0, F.col("name")).otherwise("").alias("name"), F.when(kind == 1, F.concat(F.lit("en "), "name")).alias("name:en"))
    at = F.when(F.col("id") % 11 != 0, F.array("lon", "lat")).otherwise(F.array("lon"))
    point = F.struct(F.lit("Point").alias("type"), at.alias("coordinates"))
    sinks.feature_collection(t.select(F.to_json(F.struct(F.lit("Feature").alias("type"), names.alias("properties"), point.alias("geometry"))).alias("feature")), path)
    return readers.terminals_geojson(spark, path)


@query("select user_id as mmsi, event_id from events where event_id % 4 <> 0")
def broken_lines(spark, d):
    """JSON lines of which some are cut off or blank."""
    path, e = shared_path(spark, "lines"), a.table(spark, d, "events")
    whole = F.to_json(F.struct(F.col("user_id").alias("mmsi"), "event_id"))
    e.select(F.when(F.col("event_id") % 4 != 0, whole).when(F.col("event_id") % 8 == 0, F.substring(whole, 1, 9)).otherwise("  ").alias("value")).write.text(path)
    return readers.json_lines(spark, path, "mmsi long, event_id long")


@query("select user_id as mmsi, count(*) as n from events where event_id % 4 <> 0 group by 1")
def resumed_keys(spark, d):
    """Distinct keys of what a run has written already, whatever broke off."""
    return broken_lines(spark, d).groupBy("mmsi").agg(F.count("*").alias("n"))


# Times


@query("select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate + to_hours((o_orderkey % 24)::int) end as parsed from orders")
def eta_of_first_format(spark, d):
    """Day-first texts, with others among them that the first one's format does not fit."""
    at = F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)")
    t = F.when(F.col("o_orderkey") % 5 != 0, F.date_format(at, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    rows = a.table(spark, d, "orders").select("o_orderkey", t.alias("eta"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 10**12).alias("place"))
    return reports.first_format_timestamp(rows, "eta", "place").select("o_orderkey", F.col("parsed").cast("timestamp_ntz").alias("parsed"))


@query("select event_id, case when event_id % 3 <> 0 then date_trunc('second', ts) end as parsed from events")
def iso_times(spark, d):
    e = a.table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    t = F.when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 2, iso).otherwise("not a time")
    return e.select("event_id", reports.iso_timestamp(t).cast("timestamp_ntz").alias("parsed"))


@query("select event_id, case when event_id % 6 <> 5 then date_trunc('second', ts) end as parsed from events")
def guessed_times(spark, d):
    e = a.table(spark, d, "events")
    forms = [F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.date_format("ts", "yyyyMMddHHmmss"), F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.lit("None")]
    t = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return reports.guessed_timestamp(e.select("event_id", t.alias("raw")), "raw").select("event_id", F.col("parsed").cast("timestamp_ntz").alias("parsed"))


# Trips


@query(_TRIPS + f"select origin_id, dest_id, mmsi, trips, min_draught, avg_draught, max_draught, row_number() over (partition by origin_id, dest_id order by trips desc, mmsi)::int as rank from (select origin_id, dest_id, mmsi, count(*) as trips, {_FIGURES.format('draught')} from drawn where draught > 0 group by 1, 2, 3)")
def trip_vessels(spark, d):
    return reports.trip_vessels(c._trips(spark, d))


@query(_TRIPS + f"select port_id, count(*) as total_visits, {_FIGURES.format('x')} from (select origin_id as port_id, o_max as x from drawn union all select dest_id, d_max from drawn) where x > 0 group by 1")
def trip_ports(spark, d):
    return reports.trip_ports(c._trips(spark, d))


@query(_TRIPS + f"select mmsi, count(*) as trips, {_FIGURES.format('draught')} from drawn where draught > 0 group by 1")
def trip_totals(spark, d):
    return reports.trip_totals(c._trips(spark, d))


@query(_TRIPS + "select (select count(*) from (select distinct origin_id, dest_id from drawn)) as routes, (select count(*) from drawn) as trips, (select count(distinct p) from (select origin_id as p from drawn union all select dest_id from drawn)) as ports, (select count(distinct mmsi) from drawn where draught > 0) as vessels")
def trip_metadata(spark, d):
    return reports.trip_metadata(c._trips(spark, d))


@query(_VOY + "select r.origin_port_id, r.destination_port_id, r.mmsi, coalesce(c_name, 'MMSI ' || r.mmsi) as name, r.trips from (select origin_port_id, destination_port_id, mmsi, count(*) as trips from voyages group by all) r left join (select * from customer where c_mktsegment <> 'BUILDING') on c_custkey = r.mmsi")
def route_vessel_names(spark, d):
    known = a.vessels(spark, d).where("ship_type <> 'BUILDING'").select("mmsi", F.col("name").alias("_name"))
    rows = agg.route_vessels(c._voyages(spark, d)).select("origin_port_id", "destination_port_id", "mmsi", "trips")
    return rows.join(known, "mmsi", "left").select(*rows.columns, F.coalesce("_name", F.concat(F.lit("MMSI "), F.col("mmsi").cast("string"))).alias("name"))


@query(_VOY + ", hit as (select distinct origin_port_id, destination_port_id from voyages join customer on c_custkey = mmsi where lower(c_name) like '%00012%' or lower(c_mktsegment) like '%00012%' or mmsi::varchar like '%00012%') select r.origin_port_id, r.destination_port_id, trips from route_rows r left join hit h on h.origin_port_id = r.origin_port_id and h.destination_port_id = r.destination_port_id join ports p on p.port_id = r.origin_port_id join ports q on q.port_id = r.destination_port_id where trips >= 1 and (h.origin_port_id is not null or p.name like '%00012%' or q.name like '%00012%' or p.un_locode like '%00012%' or q.un_locode like '%00012%')")
def search_routes_and_vessels(spark, d):
    """Routes by the names of both ports or by any vessel on them."""
    word, key = "00012", ["origin_port_id", "destination_port_id"]
    v, voyages = a.vessels(spark, d), c._voyages(spark, d).select(*key, "mmsi")
    hit = voyages.join(v.where(relational.any_contains(word, F.col("name"), F.col("ship_type"), F.col("mmsi"))).select("mmsi"), "mmsi", "left_semi").select(*key).distinct().withColumn("_hit", F.lit(True))
    p = a.ports(spark, d).select("port_id", relational.any_contains(word, F.col("name"), F.col("un_locode")).alias("_named"))
    side = lambda s: p.select(F.col("port_id").alias(f"{s}_port_id"), F.col("_named").alias(f"_{s}"))
    rows = agg.routes(c._voyages(spark, d)).select(*key, "trips").join(side("origin"), "origin_port_id").join(side("destination"), "destination_port_id").join(hit, key, "left")
    return rows.where(F.coalesce("_hit", F.lit(False)) | F.col("_origin") | F.col("_destination")).select(*key, "trips")


@query(o._with(o.PORTS) + "select 'ports' as kind, count(*) filter (lower(name) like '%01%' or lower(un_locode) like '%01%') as hits from ports union all select 'terminals', count(*) filter (lower(p_name) like '%01%') from part union all select 'vessels', count(*) filter (lower(c_name) like '%01%' or c_custkey::varchar like '%01%') from customer")
def search_everything(spark, d):
    tables = {"ports": (a.ports(spark, d), ["name", "un_locode"]), "terminals": (a.terminals(spark, d), ["name"]), "vessels": (a.vessels(spark, d), ["name", "mmsi"])}
    parts = [df.agg(F.count_if(relational.any_contains("01", *map(F.col, names))).alias("hits")).select(F.lit(k).alias("kind"), "hits") for k, (df, names) in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Visits, ports and destinations


@query(_VIS + ", k as (select *, un_locode as group_key from visits where stay_duration_hours >= 1) select group_key, coalesce(ship_type, 'Unknown') as ship_type, count(*) as n, round(avg(stay_duration_hours), 6) as mean_h, round(quantile_cont(stay_duration_hours, 0.5), 6) as median_h, arg_min(port_name, (arrival_time, port_id)) as port_name from k group by 1, 2")
def stay_stats_by_port_and_type(spark, d):
    key = styles.place_label(F.col("un_locode"), F.concat(F.lit("PORT_"), F.col("port_id").cast("string")))
    v = c.stays(spark, d).select(key.alias("group_key"), F.coalesce("ship_type", F.lit("Unknown")).alias("ship_type"), "stay_duration_hours", "port_name", "arrival_time", "port_id")
    h = "stay_duration_hours"
    return v.groupBy("group_key", "ship_type").agg(F.count("*").alias("n"), F.round(F.avg(h), 6).alias("mean_h"), F.round(F.percentile(h, F.lit(0.5)), 6).alias("median_h"), F.min_by("port_name", F.struct("arrival_time", "port_id")).alias("port_name"))


_PAIR = "'DECLARED: ''' || declared_destination || ''' -> ACTUAL: ''' || port_name || ''' [' || coalesce(un_locode, '?') || ']'"
for _status in ("MATCH", "MISMATCH", "GARBAGE"):
    _what = "declared_destination" if _status == "GARBAGE" else _PAIR

    def _top(spark, d, status=_status):
        pair = F.format_string("DECLARED: '%s' -> ACTUAL: '%s' [%s]", "declared_destination", "port_name", F.coalesce("un_locode", F.lit("?")))
        what = F.col("declared_destination") if status == "GARBAGE" else pair
        return c._matched(spark, d).where(F.col("match_status") == status).groupBy(what.alias("what")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "what").limit(50)

    c.QUERIES[f"dest_top_{_status.lower()}"] = _top
    o.ORACLE_SQL[f"dest_top_{_status.lower()}"] = o._with(o.PORTS, o.VISITS, o.MATCHED) + f"select {_what} as what, count(*) as n from matched where match_status = '{_status}' group by 1 order by n desc, what limit 50"


_PICK = lambda words, by: f"([{', '.join(words)}])[({by}) % {len(words)} + 1]"
_INDEX = "port_index as (select *, " + _PICK(["1.0::double", "2.0::double", "3.0::double", "4.0::double", "null"], "port_id") + " as harbor_size_int, " + _PICK(["0.0::double", "1.0::double", "2.0::double", "3.0::double", "4.0::double", "null"], "port_id") + " as shelter_afforded_int, port_id % 9 + 0.5::double as channel_depth_m, port_id % 7 + 0.5::double as anchorage_depth_m, port_id % 5 + 0.5::double as cargo_pier_depth_m, (port_id % 6) * 2.0::double as max_vessel_draft_m, " + ", ".join(
    _PICK(["1.0::double", "0.0::double", "null", "1.0::double", "null"], f"port_id + {i}") + f" as {f}_bin" for i, f in enumerate(a.PORT_FLAGS)
) + " from ports)"
_CODED = "harbor_size_int, shelter_afforded_int, channel_depth_m, anchorage_depth_m, cargo_pier_depth_m, max_vessel_draft_m, lon as longitude, lat as latitude, " + ", ".join(f"{f}_bin" for f in a.PORT_FLAGS)


@query(o._with(o.PORTS, _INDEX) + f"select port_id, un_locode, name as port_name, country_code, {_CODED} from port_index")
def port_attributes(spark, d):
    return reports.encoded_ports(a.port_index(spark, d))


@query("select m.*, p.* exclude (code), m.p90_draught_m / nullif(p.max_vessel_draft_m, 0) as draught_utilization from (" + o.ORACLE_SQL["feature_matrix"] + ") m left join (select port_id as port_id_wpi, un_locode as code, name as port_name_wpi, country_code as country_code_wpi, " + _CODED + " from (" + o._with(o.PORTS, _INDEX) + "select * from port_index qualify row_number() over (partition by un_locode order by port_id) = 1)) p on p.code = m.un_locode")
def feature_matrix_with_ports(spark, d):
    return reports.port_matrix(c.stays(spark, d), a.ports(spark, d), a.port_index(spark, d))


@query("select un_locode, total_visits from (" + o.ORACLE_SQL["feature_matrix"] + ") order by total_visits desc, un_locode")
def ports_by_visits(spark, d):
    return agg.feature_matrix(c.stays(spark, d), a.ports(spark, d)).select("un_locode", "total_visits").orderBy(F.desc("total_visits"), "un_locode")


@query(o._with(o.PORTS, o.TERMINALS, o.LINKED, _INDEX.replace("from ports)", "from ports where port_id is not null)")) + "select i.port_id, i.name, i.un_locode, i.country_code, i.harbor_size_int, i.max_vessel_draft_m, (select count(*) from linked l where l.port_id = i.port_id) as terminal_count from port_index i")
def geofence_properties(spark, d):
    counts = c._linked_terminals(spark, d).groupBy("place_id").agg(F.count("*").alias("terminal_count"))
    coded = reports.encoded_ports(a.port_index(spark, d))
    joined = coded.join(counts, F.col("port_id") == F.col("place_id"), "left")
    return joined.select("port_id", F.col("port_name").alias("name"), "un_locode", "country_code", "harbor_size_int", "max_vessel_draft_m", F.coalesce("terminal_count", F.lit(0)).alias("terminal_count"))


@query(_POS + ", near as (select x.mmsi, x.ts, min((" + o._haversine("x.lon", "x.lat", "p.lon", "p.lat") + ", p.port_id)) as m from (select * from positions where sog < 1) x cross join ports p group by 1, 2) select distinct m[2] as port_id from near")
def nearest_port_ids(spark, d):
    return spatial.nearest_place(a.positions(spark, d).where("sog < 1"), c.places(a.ports(spark, d))).select(F.col("place_id").alias("port_id")).distinct()


@query(o._with(o.PORTS) + "select port_id, case when port_id % 3 = 0 then name else un_locode end as label from ports")
def place_labels(spark, d):
    code = F.when(F.col("port_id") % 3 != 0, F.col("un_locode")).when(F.col("port_id") % 2 == 0, F.lit("N/A"))
    return a.ports(spark, d).select("port_id", styles.place_label(code, F.col("name")).alias("label"))


def _fences(spark, d):
    ports, t = a.ports(spark, d), c._linked_terminals(spark, d)
    points = ports.select("port_id", "lon", "lat").unionByName(t.where("place_id is not null").select(F.col("place_id").alias("port_id"), "lon", "lat"))
    return spatial.geofences(points, "port_id", 0.2).select(F.col("port_id").alias("place_id"), "ring")


@query()
def port_visits_fenced(spark, d):
    """Visits where a port's fence, not the radius, says what is in port."""
    return visit_ops.port_visits(a.positions(spark, d), c.places(a.ports(spark, d)), _fences(spark, d))


# Texts, colours and numbers


@query("select n_nationkey, case when n_nationkey % 2 = 0 then n_name else n_name || ' coast' end as region, 'Sea of ' || n_name as water from nation")
def region_water(spark, d):
    n = a.table(spark, d, "nation")
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("  --  Europe -- 1"))).otherwise(F.concat("n_name", F.lit("   coast")))
    return n.select("n_nationkey", styles.region(raw).alias("region"), styles.water(F.concat(F.lit(" Sea of "), "n_name", F.lit(" ; Ocean"))).alias("water"))


@query(_VIS + "select port_id, case when n * 100 >= 100000 then printf('%.0f', n / 10.0::double) || 'k' when n * 100 >= 10000 then regexp_replace(printf('%.1f', n / 10.0::double), '\\.0$', '') || 'k' else format('{:,}', n * 100) end as visits, printf('%.1f m', n / 8.0::double + 0.01) as metres from (select port_id, count(*) as n from visits group by 1)")
def number_labels(spark, d):
    n = a.visits(spark, d).groupBy("port_id").agg(F.count("*").alias("n"))
    return n.select("port_id", styles.compact(F.col("n") * 100).alias("visits"), styles.feature_text(F.lit("depth_m"), F.col("n") / 8.0 + 0.01).alias("metres"))


_LABELLED = ["pct_cargo", "median_stay_h", "mean_length_m", "harbor_size_int", "visits_per_week", "peak_hour_entropy", "total_visits"]


@query(" union all ".join(f"select '{x}' as feature, '{y}' as label, '{z}' as shown" for x, y, z in zip(_LABELLED, ["Cargo", "Median stay", "Mean length", "Harbor size", "Visits per week", "Peak hour entropy", "Total visits"], ["1234.5%", "1234.5 h", "1234.5 m", "1234", "1,234", "1,234", "1,234"], strict=True)))
def feature_captions(spark, d):
    f = spark.createDataFrame([(x, 1234.46) for x in _LABELLED], "feature string, v double")
    return f.select("feature", styles.feature_label(F.col("feature")).alias("label"), styles.feature_text(F.col("feature"), F.col("v")).alias("shown"))


def _rgb(colours, t: str) -> str:
    last = len(colours) - 1
    at = f"least({last - 1}, floor({t} * {last}))"
    pick = lambda i, k: f"([{', '.join(str(float(x[i])) + '::double' for x in colours)}])[({at})::int + {k}]"
    return "'rgb(' || " + " || ',' || ".join(f"floor({pick(i, 1)} + ({pick(i, 2)} - {pick(i, 1)}) * ({t} * {last} - {at}) + 0.5)::bigint" for i in range(3)) + " || ')'"


_T = "least(1.0::double, greatest(0.0::double, log10(greatest(trips, 1)::double) / log10(10000.0::double)))"


@query(_VOY + f"select origin_port_id, destination_port_id, {_rgb(styles.TRAFFIC_RGB, _T)} as colour, round(1 + {_T} * 2.5, 6) as weight, case when coalesce(max_draught, 0) > 10 then '#ef4444' when max_draught > 7 then '#f97316' when max_draught > 5 then '#eab308' when max_draught > 0 then '#22c55e' else '#64748b' end as draught_colour from route_rows")
def route_colours(spark, d):
    r = agg.routes(c._voyages(spark, d))
    return r.select("origin_port_id", "destination_port_id", styles.traffic_colour(F.col("trips")).alias("colour"), F.round(styles.traffic_weight(F.col("trips")), 6).alias("weight"), styles.stepped(F.col("max_draught"), styles.DRAUGHT_COLOURS, styles.NO_DRAUGHT).alias("draught_colour"))


@query(_VIS + "select port_id, case when n > 100 then '#3b82f6' when n > 50 then '#60a5fa' when n > 20 then '#93c5fd' else '#cbd5e1' end as colour from (select port_id, count(*) as n from visits group by 1)")
def port_colours(spark, d):
    n = a.visits(spark, d).groupBy("port_id").agg(F.count("*").alias("n"))
    return n.select("port_id", styles.stepped(F.col("n"), styles.VISIT_COLOURS, styles.FEW_VISITS).alias("colour"))


_GAP = "least(1.0::double, h / 48)"


@query(_POS + ", g as (select mmsi, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by mmsi order by ts))) / 3.6e9::double, 3) as h from positions) select mmsi, " + _rgb(styles.GAP_RGB, _GAP) + " as colour, count(*) as n from g where h is not null group by 1, 2")
def track_gap_colours(spark, d):
    g = trajectory.gap_hours(a.positions(spark, d)).where("gap_hours is not null")
    return g.groupBy("mmsi", styles.gap_colour(F.col("gap_hours")).alias("colour")).agg(F.count("*").alias("n"))


# Nested values


@query("select event_id, '{\"id\":' || event_id || ',\"list\":[' || event_id % 10 || '.0,null],\"by_key\":{\"' || event_id % 3 || '\":null,\"9\":' || event_id % 10 || '.0}}' as body from events")
def nested_json(spark, d):
    v = (F.col("event_id") % 10).cast("double")
    odd = a.table(spark, d, "events").select("event_id", F.struct(F.col("event_id").alias("id"), F.array(v, F.lit(float("nan"))).alias("list"), F.create_map(F.col("event_id") % 3, F.lit(float("inf")), F.lit(9).cast("long"), v).alias("by_key")).alias("s"))
    return sinks.finite(odd).select("event_id", F.to_json("s").alias("body"))


@query("select c_mktsegment as ship_type, count(*)::int as n_keys, min(c_custkey)::varchar as first_key from customer group by 1")
def vessels_by_key(spark, d):
    """Vessels re-keyed by their id as text, counted by their keys."""
    docs = sinks.keyed_documents(a.vessels(spark, d), "mmsi").withColumn("ship_type", F.get_json_object("body", "$.ship_type"))
    return docs.groupBy("ship_type").agg(F.count_distinct("key").cast("int").alias("n_keys"), F.min(F.col("key").cast("long")).cast("string").alias("first_key"))


@query("select event_id, event_type as kind from events where event_id % 4 <> 1")
def ragged_records(spark, d):
    """Records of three fields; longer and shorter ones drop out."""
    line = F.concat_ws(";", F.col("event_id").cast("string"), "event_type", F.lit("x"))
    rows = a.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 1, line).when(F.col("event_id") % 8 == 1, F.concat(line, F.lit(";y"))).otherwise("z").alias("line"))
    return reports.whole_records(rows, "line", ";", 3).select("event_id", F.col("fields")[1].alias("kind"))


# Features and profiles

_F = o._F


@query(o._with(o.FEATURES) + ", m as (select label, " + ", ".join(f"avg({x}) as m_{x}" for x in _F) + " from features group by 1), e as (" + " union all ".join(f"select vec_id, '{x}' as feature, {x} as own, m_{x} as mean from features join m using (label)" for x in _F) + ") select vec_id, feature, round(abs(own - mean), 6) as spread, case when abs(own - mean) < greatest(0.05::double * abs(case when mean = 0 then 1 else mean end), 0.05::double) then 'same' when own > mean then 'up' else 'down' end as dir from e")
def profile_compare(spark, d):
    return reports.compared(c._features(spark, d), "vec_id", "label", _F)


@query(o._with(o.FEATURES) + " union all ".join(f"select '{x}' as feature, round(avg(pow({x} - (select avg({x}) from features), 3)) / pow(avg(pow({x} - (select avg({x}) from features), 2)), 1.5), 6) as skewness, abs(avg(pow({x} - (select avg({x}) from features), 3)) / pow(avg(pow({x} - (select avg({x}) from features), 2)), 1.5)) > 0.75 as skewed from features" for x in _F))
def skewed_columns(spark, d):
    return reports.skewness_of(c._features(spark, d), _F).withColumn("skewness", F.round("skewness", 6))


_SHOWN = ["pct_cargo", "pct_tanker", "median_stay_h", "visits_per_week"]


@query("with m as (" + o.ORACLE_SQL["feature_matrix"] + ") " + " union all ".join(f"select un_locode, '{x}' as feature, round({x}::double, 2) as value, {f'round_even({x} / 100.0::double * total_visits, 0)::bigint' if x.startswith('pct_') else 'null::bigint'} as visits from m" for x in _SHOWN))
def dashboard_features(spark, d):
    return reports.dashboard_features(agg.feature_matrix(c.stays(spark, d), a.ports(spark, d)), _SHOWN)


@query()
def port_profiles(spark, d):
    return profiles.port_profiles(reports.port_matrix(c.stays(spark, d), a.ports(spark, d), a.port_index(spark, d)))


@query()
def profile_summary(spark, d):
    return profiles.profile_summary(port_profiles(spark, d))


@query("select n_nationkey, case n_nationkey % 4 when 0 then 'O ' || x when 1 then x || ' DENMARK' when 2 then 'AA ' || x else x end as cleaned from (select n_nationkey, replace(upper(n_name), '_', ' ') as x from nation)")
def clean_names(spark, d):
    raw = F.element_at(F.array(F.concat(F.lit("ø-"), "n_name"), F.concat("n_name", F.lit(" port, dk")), F.concat(F.lit("Å "), "n_name", F.lit(" RO RO")), F.concat(F.lit("Havn "), "n_name")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return a.table(spark, d, "nation").select("n_nationkey", text.clean_name(raw).alias("cleaned"))
