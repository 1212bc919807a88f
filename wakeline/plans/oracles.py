"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

_TYPES = "['Cargo','Tanker','Passenger','Fishing','Tug','HSC','Dredging','Sailing','Towing','Pilot','SAR','Other','Undefined']"
_EARTH = "6371000.0"


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * {_EARTH} * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


PORTS = """ports as (
  select s_suppkey as port_id, s_name as name, n_name as country_code,
         'N' || lpad(n_nationkey::varchar, 2, '0') || lpad((s_suppkey % 100)::varchar, 2, '0') as un_locode,
         9.0::double + (s_suppkey % 10) * 0.5::double as lon, 54.0::double + (s_suppkey // 10) * 0.05::double as lat
  from supplier join nation on s_nationkey = n_nationkey)"""
TERMINALS = """terminals as (
  select p_partkey as id, p_name as name, 9.0::double + (p_partkey % 97) * 0.05::double as lon, 54.0::double + (p_partkey % 53) * 0.01::double as lat from part)"""
POSITIONS = """hourly as (
  select user_id as mmsi, date_trunc('hour', ts) as hour, min(event_id) as event_id, arg_min(event_type, event_id) as event_type, arg_min(props, event_id) as props
  from events group by 1, 2
), placed as (
  select h.*, p.name as port_name, p.un_locode, p.lon as port_lon, p.lat as port_lat
  from hourly h join ports p on p.port_id = (h.mmsi * 7 + (date_diff('day', date '2024-01-01', h.hour::date) // 3) * 17) % (select count(*) from supplier)
), positions as (
  select mmsi, hour + k * interval 5 minute as ts, case when event_id % 5 = 0 then 8.0::double else 0.3::double end as sog,
         port_lon + ((event_id + k) % 7 - 3) * 0.0005::double + case when event_id % 5 = 0 then 0.2::double else 0.0::double end as lon,
         port_lat + ((event_id + k) % 5 - 2) * 0.0005::double as lat,
         case event_type when 'view' then 'Moored' when 'click' then 'At anchor' when 'purchase' then '1' when 'signup' then '5' end as nav_status,
         (props->>'$.k')::double / 10.0::double as draught,
         case event_id % 3 when 0 then port_name when 1 then '' else un_locode end as destination
  from placed cross join range(12) r(k))"""
VISITS = f"""visits as (
  select o_custkey as mmsi, port_id, name as port_name, un_locode, country_code,
         o_orderdate + to_hours((o_orderkey * 7 % 24)::int) as arrival_time,
         o_orderdate + to_hours((o_orderkey * 7 % 24)::int) + to_minutes((l_quantity * l_linenumber / 2.0::double * 60)::int) as departure_time,
         l_quantity * l_linenumber / 2.0::double as stay_duration_hours,
         case when o_custkey % 14 < 13 then {_TYPES}[(o_custkey % 14) + 1] end as ship_type,
         5.0::double * p_size + 5 as length_m, l_tax * 100 + 0.0::double as draught_m,
         case l_partkey % 6 when 0 then name when 1 then un_locode when 2 then country_code when 3 then 'FOR ORDERS' when 4 then '' end as declared_destination,
         l_orderkey as order_key, l_linenumber as line_number, l_partkey as part_key
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join ports on l_suppkey = port_id)"""
#: Visits of an hour or more, which features are made of.
STAYS = VISITS.replace("visits as (", "all_visits as (", 1) + ", visits as (select * from all_visits where stay_duration_hours >= 1)"
LINKED = f"""near as (
  select t.id, p.port_id, {_haversine('t.lon', 't.lat', 'p.lon', 'p.lat')} as distance_m from terminals t join ports p on abs(t.lat - p.lat) < 0.2
), linked as (
  select t.*, n.port_id, n.distance_m from terminals t left join (
    select id, arg_min(port_id, (distance_m, port_id)) as port_id, min(distance_m) as distance_m from near where distance_m <= 10000 group by 1) n using (id))"""
STOPS = """candidates as (
  select * from positions where (sog < 1.0 or nav_status in ('1', '5', 'Anchored', 'Moored')) and minute(ts) % 10 = 0
), flagged as (
  select *, case when ts - lag(ts) over (partition by mmsi order by ts) > interval 30 minute then 1 else 0 end as is_new from candidates
), grouped as (
  select *, sum(is_new) over (partition by mmsi order by ts rows unbounded preceding)::bigint as grp_id from flagged
), stops as (
  select mmsi, grp_id, min(ts) as start_time, max(ts) as end_time, avg(lon) as lon, avg(lat) as lat,
         min(nullif(draught, 0)) as min_draught, avg(nullif(draught, 0)) as avg_draught, max(draught) as max_draught
  from grouped group by 1, 2 having max(ts) - min(ts) >= interval 30 minute)"""
BUCKETS = """buckets as (
  select mmsi, time_bucket(interval '10 minutes', ts) as bucket, max(ts) as ts, arg_max(lon, ts) as lon, arg_max(lat, ts) as lat, arg_max(sog, ts) as sog,
         arg_max_null(nav_status, ts) as nav_status, arg_max_null(destination, ts) as destination, arg_max_null(draught, ts) as draught, round(avg(sog), 1) as avg_sog
  from positions group by 1, 2)"""
VOYAGES = """voyages as (
  select mmsi, port_id as origin_port_id, next.port_id as destination_port_id, departure_time, next.arrival_time as arrival_time,
         (epoch_us(next.arrival_time) - epoch_us(departure_time)) / 3.6e9::double as voyage_duration_hours, next.draught_m as draught_at_dest_m, ship_type
  from (select *, lead({'port_id': port_id, 'arrival_time': arrival_time, 'draught_m': draught_m})
                  over (partition by mmsi order by arrival_time, departure_time, port_id, order_key, line_number, part_key) as next from visits)
  where next is not null and departure_time < next.arrival_time
), route_rows as (
  select origin_port_id, destination_port_id, count(*) as trips, count(distinct mmsi) as vessels,
         round(min(nullif(draught_at_dest_m, 0)), 2) as min_draught, round(avg(nullif(draught_at_dest_m, 0)), 2) as avg_draught, round(max(nullif(draught_at_dest_m, 0)), 2) as max_draught
  from voyages group by 1, 2)"""
_NAME = "trim(regexp_replace(regexp_replace({}, '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
MATCHED = f"""matched as (
  select *, case when trim(declared_destination) = '' or regexp_replace(upper(declared_destination), '[^A-Z]', '', 'g') = '' or regexp_matches(upper(declared_destination), '^ORDER|FOR ORDER|TBA|^UNKNOWN|^NONE$') then 'GARBAGE'
                 when upper(trim(declared_destination)) = un_locode or upper(trim(declared_destination)) = substr(un_locode, 3, 3)
                   or {_NAME.format('upper(trim(declared_destination))')} = {_NAME.format('upper(port_name)')} then 'MATCH'
                 else 'MISMATCH' end as match_status
  from visits where trim(coalesce(declared_destination, '')) <> '')"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _stay(source: str, key: str, least: int = 0) -> str:
    q = ", ".join(f"round(quantile_cont(stay_duration_hours, {p / 100}), 6) as p{p}_h" for p in (25, 50, 75, 90, 95, 99))
    return f"""select {key}, count(*) as n, round(avg(stay_duration_hours), 6) as mean_h, round(stddev_samp(stay_duration_hours), 6) as std_h,
      round(min(stay_duration_hours), 6) as min_h, round(max(stay_duration_hours), 6) as max_h, {q} from {source} group by 1 having count(*) > {least}"""


def _entropy(source: str, value: str, base: str, single: str) -> str:
    return f"""(select un_locode, case when {base} = 1 then {single} else -sum(n / t * ln(n / t)) / ln({base}) end as entropy from (
      select *, sum(n) over (partition by un_locode) as t, count(*) over (partition by un_locode) as k from (
        select un_locode, {value} as value, count(*)::double as n from {source} group by 1, 2)) group by un_locode, k)"""


def _spread(value: str, name: str, quantiles: bool = True) -> str:
    q = lambda x: f"quantile_cont({value}, {x})"
    out = [(q(0.5), f"median_{name}"), (f"avg({value})", f"mean_{name}"), (f"stddev_samp({value})", f"std_{name}")]
    out += [(q(0.25), f"p25_{name}"), (q(0.75), f"p75_{name}")] if quantiles else []
    return ", ".join(f"round({e}, 6) as {n}" for e, n in [*out, (f"{q(0.75)} - {q(0.25)}", f"iqr_{name}")])


_NORMAL = f"case when trim(ship_type) in ({_TYPES[1:-1].replace(chr(39) + ',' + chr(39) + 'Undefined', '')}) then trim(ship_type) else 'Other' end"
_TYPE_LIST = [t.strip("'") for t in _TYPES[1:-1].split(",")][:-1]
_RATES = "count(*) as n, count(*) filter (match_status = 'MATCH') as matches, count(*) filter (match_status = 'MISMATCH') as mismatches, count(*) filter (match_status = 'GARBAGE') as garbage, round(count(*) filter (match_status = 'MATCH') * 100.0::double / count(*), 2) as match_pct"
_F = [f"f{i}" for i in range(6)]
FEATURES = "features as (select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as f{i}" for i in range(6)) + " from embeddings)"
_MONTHLY = "(select un_locode, strftime(arrival_time, '%Y-%m') as month, count(*) as n from visits group by 1, 2)"

ORACLE_SQL: dict[str, str] = {
    "clean_events_cast": "select event_id, value, date_trunc('second', ts) as ts, null::double as bad, event_type from events",
    "quarantine_split": """with e as (select *, coalesce((props->>'$.k')::int >= 10 and value > 1, false) as ok from events)
      select event_type, count(*) as n, case when ok then 'good' else 'bad' end as part from e group by event_type, ok""",
    "dedupe_first": _with(PORTS, VISITS) + "select mmsi, port_id, arrival_time, order_key, line_number, stay_duration_hours from visits qualify row_number() over (partition by mmsi, port_id, arrival_time order by order_key, line_number, part_key) = 1",
    "distinct_on_latest": "select distinct on (user_id) user_id, event_id, ts, event_type from events order by user_id, ts desc, event_id desc",
    "anti_join_insert": "select user_id as mmsi, event_id from events e where event_id % 2 = 0 and not exists (select 1 from events s where s.event_id % 3 <> 0 and s.user_id = e.user_id and s.ts = e.ts)",
    "vessel_upsert": """with s as (select c_custkey as mmsi, c_name as name from customer where c_custkey % 3 <> 0), t as (select c_custkey as mmsi, case when c_custkey % 4 = 0 then c_mktsegment end as name from customer where c_custkey % 2 = 0)
      select coalesce(t.mmsi, s.mmsi) as mmsi, coalesce(t.name, s.name) as name, case when s.mmsi is not null then 1 else 2 end::int as first_seen, case when t.mmsi is not null then 2 else 1 end::int as last_seen from s full join t on s.mmsi = t.mmsi""",
    "ledger_skip": "select distinct strftime(ts, '%Y-%m-%d') as file_path from events where day(ts) > 10",
    "visits_with_ports": _with(PORTS, VISITS) + "select port_id, port_name, un_locode, count(*) as n, round(sum(stay_duration_hours), 3) as hours from visits group by all",
    "terminal_nearest_port": _with(PORTS, TERMINALS, LINKED) + "select id, port_id, round(distance_m, 3) as distance_m from linked",
    "ports_terminal_counts": _with(PORTS, TERMINALS, LINKED) + "select p.port_id, p.name, count(l.id) as n_terminals from ports p left join linked l on l.port_id = p.port_id group by all",
    "terminals_with_parent": _with(PORTS, TERMINALS, LINKED) + "select l.id, l.name, l.port_id, p.name as port_name, p.un_locode from linked l left join ports p on l.port_id = p.port_id",
    "top_ports_by_terminals": _with(PORTS, TERMINALS, LINKED) + "select p.port_id, p.name, count(l.id) as n_terminals from ports p join linked l on l.port_id = p.port_id group by all order by n_terminals desc, port_id limit 20",
    "union_port_points": _with(PORTS, TERMINALS, LINKED) + "select port_id, count(*) as n_points, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat from (select port_id, lon, lat from ports union all select port_id, lon, lat from linked where port_id is not null) group by 1",
    "stop_port_radius": _with(PORTS, POSITIONS, STOPS) + f"select mmsi, start_time, port_id, round({_haversine('s.lon', 's.lat', 'p.lon', 'p.lat')}, 3) as distance_m from stops s join ports p on {_haversine('s.lon', 's.lat', 'p.lon', 'p.lat')} <= 1000",
    "nearest_port_unbounded": _with(PORTS, POSITIONS) + f""", near as (select x.mmsi, x.ts, min(({_haversine('x.lon', 'x.lat', 'p.lon', 'p.lat')}, p.port_id)) as m from positions x cross join ports p group by 1, 2)
      select m[2] as port_id, count(*) as n, round(max(m[1]), 3) as farthest_m from near group by 1""",
    "point_in_fence": _with(PORTS, POSITIONS) + f""", near as (select x.lon - p.lon as x, x.lat - p.lat as y, p.port_id from positions x join ports p on {_haversine('x.lon', 'x.lat', 'p.lon', 'p.lat')} <= 5000)
      select port_id, count(*) as near, count(*) filter (((-0.00071 > y) <> (0.00123 > y) and x < (0.0 + 0.00121) * (y + 0.00071) / (0.00123 + 0.00071) - 0.00121)
        <> ((0.00123 > y) <> (-0.00071 > y) and x < (0.00121 - 0.0) * (y - 0.00123) / (-0.00071 - 0.00123) + 0.0)) as inside from near group by 1""",
    "bucket_last_10m": _with(PORTS, POSITIONS, BUCKETS) + "select mmsi, bucket, ts, round(lon, 6) as lon, round(lat, 6) as lat, sog, nav_status, destination, draught from buckets",
    "bucket_avg_last_10m": _with(PORTS, POSITIONS, BUCKETS) + "select mmsi, bucket, avg_sog, coalesce(nav_status, 'Unknown') as nav_status, draught from buckets",
    "vessel_watermark": _with(PORTS, VISITS) + "select mmsi, max(departure_time) as last_departure from visits group by 1",
    "stop_sessions": _with(PORTS, POSITIONS, STOPS) + "select mmsi, grp_id, count(*) as n, min(ts) as start_time, max(ts) as end_time from grouped group by 1, 2",
    "stop_aggregates": _with(PORTS, POSITIONS, STOPS) + "select mmsi, grp_id, start_time, end_time, " + ", ".join(f"round({c}, 6) as {c}" for c in ("lon", "lat", "min_draught", "avg_draught", "max_draught")) + " from stops",
    "od_trips": _with(PORTS, POSITIONS, STOPS) + f""", at_port as (select s.*, p.port_id from stops s join ports p on {_haversine('s.lon', 's.lat', 'p.lon', 'p.lat')} <= 1000
      ), paired as (select *, lead(port_id) over w as dest_id, lead(lon) over w as next_lon, lead(lat) over w as next_lat, lead(max_draught) over w as d_max from at_port window w as (partition by mmsi order by start_time, port_id)
      ), trips as (select *, {_haversine('lon', 'lat', 'next_lon', 'next_lat')} as distance_m from paired where dest_id is not null and dest_id <> port_id)
      select port_id as origin_id, dest_id, count(*) as trips, count(distinct mmsi) as vessels, round(avg(distance_m), 3) as mean_distance_m, max(d_max) as max_draught from trips where distance_m > 100000 group by 1, 2""",
    "voyages_from_visits": _with(PORTS, VISITS, VOYAGES) + "select mmsi, origin_port_id, destination_port_id, departure_time, arrival_time, round(voyage_duration_hours, 6) as voyage_duration_hours from voyages",
    "median_filter5": _with(PORTS, POSITIONS) + ", n as (select *, count(*) over (partition by mmsi) as c from positions) select mmsi, ts, " + ", ".join(
        f"round(case when c >= 5 then list_sort([coalesce(lag({x}, 2) over w, 0.0), coalesce(lag({x}) over w, 0.0), {x}, coalesce(lead({x}) over w, 0.0), coalesce(lead({x}, 2) over w, 0.0)])[3] else {x} end, 6) as {x}" for x in ("lon", "lat")
    ) + " from n window w as (partition by mmsi order by ts)",
    "state_classify": _with(PORTS, POSITIONS) + f""", near as (select x.mmsi, x.ts, any_value(x.sog) as sog, any_value(x.nav_status) as nav_status, min({_haversine('x.lon', 'x.lat', 'p.lon', 'p.lat')}) as m from positions x cross join ports p group by 1, 2)
      select case when coalesce(sog, 0) > 3 then 'UNDERWAY' when m <= 5000 and coalesce(sog, 0) < 1 then 'STOPPED_IN_PORT' when nav_status in ('Moored', 'At anchor', '1', '5') and coalesce(sog, 0) < 1 then 'STOPPED_IN_PORT' else 'TRANSITING' end as state, nav_status, count(*) as n from near group by 1, 2""",
    "last_destination_before": _with(PORTS, POSITIONS) + ", l as (select mmsi, last_value(nullif(trim(destination), '') ignore nulls) over (partition by mmsi order by ts rows unbounded preceding) as last_destination from positions) select mmsi, last_destination, count(*) as n from l group by 1, 2",
    "track_gaps": _with(PORTS, POSITIONS) + ", g as (select mmsi, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by mmsi order by ts))) / 3.6e9::double, 3) as h from positions) select mmsi, max(h) as max_gap_hours, count(*) filter (h > 12) as long_gaps from g group by 1",
    "route_stats_v1": _with(PORTS, VISITS, VOYAGES) + "select * from route_rows",
    "route_stats_v2": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id, destination_port_id, trips, vessels, coalesce(min_draught, 0) as min_draught, coalesce(avg_draught, 0) as avg_draught, coalesce(max_draught, 0) as max_draught from route_rows",
    "port_rollup_v2": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id as port_id, sum(trips)::bigint as outgoing_trips, count(*) as routes, coalesce(round(min(nullif(coalesce(max_draught, 0), 0)), 2), 0) as min_draught, coalesce(round(avg(nullif(coalesce(max_draught, 0), 0)), 2), 0) as avg_draught, coalesce(round(max(nullif(coalesce(max_draught, 0), 0)), 2), 0) as max_draught from route_rows group by 1",
    "vessel_rollup_v2": _with(PORTS, VISITS, VOYAGES) + ", r as (select mmsi, count(*) as trips, coalesce(round(max(nullif(draught_at_dest_m, 0)), 2), 0) as m from voyages group by mmsi, origin_port_id, destination_port_id) select mmsi, sum(trips)::bigint as trips, round(min(m), 2) as min_draught, round(avg(m), 2) as avg_draught, round(max(m), 2) as max_draught from r group by 1",
    "top_destinations": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id, row_number() over (partition by origin_port_id order by trips desc, destination_port_id)::int as rank, destination_port_id, trips, round(trips * 100.0::double / max(trips) over (partition by origin_port_id), 2) as bar_pct from route_rows where trips between 1 and 500 qualify rank <= 10",
    "search_routes": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id, destination_port_id, trips from route_rows r join ports o on o.port_id = origin_port_id join ports d on d.port_id = destination_port_id where trips between 2 and 100 and (o.name || '|' || d.name || '|' || o.un_locode || '|' || d.un_locode) like '%0007%'",
    "search_ports": _with(PORTS) + "select port_id, name, country_code from ports where lower(name) like '%nation\\_1%' escape '\\' or lower(country_code) like '%nation\\_1%' escape '\\' or lower(un_locode) like '%nation\\_1%' escape '\\'",
    "hit_counts": _with(PORTS) + "select count(*) filter (name like '%9%' or un_locode like '%9%') as hits, 'ports' as kind from ports union all select count(*) filter (lower(c_name) like '%build%' or lower(c_mktsegment) like '%build%'), 'vessels' from customer",
    "route_style": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id, destination_port_id, round(least(1.0, greatest(0.0, log10(trips + 1) / log10((select greatest(max(trips), 100) from route_rows) + 1))), 6) as level, round(2 + 3 * sqrt(trips), 6) as radius from route_rows",
    "stay_stats_global": _with(PORTS, VISITS) + _stay("(select *, 'all' as scope from visits where stay_duration_hours >= 1)", "scope"),
    "stay_stats_by_type": _with(PORTS, VISITS) + _stay("(select * from visits where stay_duration_hours >= 1 and trim(coalesce(ship_type, '')) <> '')", "ship_type", 100),
    "stay_stats_by_port": _with(PORTS, VISITS) + _stay("(select *, un_locode as group_key from visits)", "group_key"),
    "stay_histogram": _with(PORTS, VISITS) + """, b as (select unnest(range(12))::int as bin, unnest(['<2h','2-4h','4-6h','6-8h','8-12h','12-18h','18-24h','24-36h','36-48h','48-72h','72-168h','>7d']) as label
      ), c as (select len(list_filter([2,4,6,8,12,18,24,36,48,72,168], lambda e: stay_duration_hours >= e))::int as bin, count(*) as n from visits group by 1)
      select b.bin, label, coalesce(n, 0) as n, round(coalesce(n, 0) * 100.0::double / sum(coalesce(n, 0)) over (), 2) as pct from b left join c on b.bin = c.bin""",
    "feat_volume": _with(PORTS, STAYS) + """, s as (select floor((epoch_us(max(arrival_time)) - epoch_us(min(arrival_time))) / 86400000000.0::double) as days from visits)
      select un_locode, count(*) as total_visits, count(distinct mmsi) as unique_vessels, round(count(*) / greatest(any_value(days) / 7.0::double, 1), 6) as visits_per_week, round(count(*) / greatest(any_value(days), 1), 6) as avg_vessels_per_day,
             round(1.0 - count(distinct mmsi) / count(*)::double, 6) as repeat_visitor_ratio, round(count(*)::double / count(distinct mmsi), 6) as avg_visits_per_vessel from visits, s group by 1""",
    "feat_stay": _with(PORTS, STAYS) + f"select un_locode, {_spread('stay_duration_hours', 'stay_h')}, round(avg(case when stay_duration_hours < 4 then 1.0::double else 0 end) * 100, 6) as pct_short_stay, round(avg(case when stay_duration_hours > 48 then 1.0::double else 0 end) * 100, 6) as pct_long_stay from visits group by 1",
    "feat_ship_type": _with(PORTS, STAYS, f"typed as (select un_locode, {_NORMAL} as t from visits)", "wide as (select un_locode, " + ", ".join(f"count(*) filter (t = '{t}') as c_{t}" for t in _TYPE_LIST) + ", count(*) as n from typed group by 1)")
    + "select w.un_locode, " + ", ".join(f"round(c_{t} * 100.0::double / n, 6) as pct_{t.lower()}" for t in _TYPE_LIST)
    + ", case " + " ".join(f"when c_{t} = greatest({', '.join('c_' + u for u in _TYPE_LIST)}) then '{t}'" for t in _TYPE_LIST) + f" end as dominant_ship_type, round(e.entropy, 6) as ship_type_entropy from wide w join {_entropy('typed', 't', 'k', 'null')} e using (un_locode)",
    "feat_size": _with(PORTS, STAYS) + f"select un_locode, {_spread('length_m', 'length_m')}, round(quantile_cont(length_m, 0.9), 6) as p90_length_m, {_spread('draught_m', 'draught_m', False)}, round(quantile_cont(draught_m, 0.9), 6) as p90_draught_m from visits where (length_m is null or length_m > 10) and (draught_m is null or draught_m > 0) group by 1",
    "feat_temporal": _with(PORTS, STAYS) + f"""select a.un_locode, a.night_visit_ratio, a.weekend_visit_ratio, round(e.entropy, 6) as peak_hour_entropy from (
      select un_locode, round(avg(case when hour(arrival_time) >= 22 or hour(arrival_time) < 6 then 1.0::double else 0 end) * 100, 6) as night_visit_ratio, round(avg(case when isodow(arrival_time) >= 6 then 1.0::double else 0 end) * 100, 6) as weekend_visit_ratio from visits group by 1) a
      join {_entropy('visits', 'hour(arrival_time)', '24', '0')} e using (un_locode)""",
    "feat_seasonal": _with(PORTS, STAYS) + f"select un_locode, round(case when count(*) >= 2 then stddev_samp(n) / avg(n) end, 6) as seasonal_cv, case when count(*) >= 2 then arg_min(month, (-n, month)) end as busiest_month from {_MONTHLY} group by 1",
    "feat_flow": _with(PORTS, STAYS, "d as (select *, lower(declared_destination) as t from visits where declared_destination is not null)") + f"""select v.un_locode, round(e.entropy, 6) as destination_diversity, s.match_rate, s.intra_country_ratio from (select distinct un_locode from visits) v
      left join (select un_locode, round(avg(case when contains(t, lower(port_name)) or (length(port_name) > 5 and contains(t, lower(port_name[1:5]))) then 1.0::double else 0 end) * 100, 6) as match_rate,
                        round(avg(case when contains(t, lower(country_code)) then 1.0::double else 0 end) * 100, 6) as intra_country_ratio from d group by 1) s using (un_locode)
      left join {_entropy('d', 'declared_destination', 'k', '0.0')} e using (un_locode)""",
    "coverage_report": _with(PORTS, VISITS) + " union all ".join(f"select '{c}' as feature, count(*) - count({c}) as n_null, round((count(*) - count({c})) * 100.0::double / count(*), 2) as pct_null from visits" for c in ("mmsi", "ship_type", "declared_destination", "draught_m", "length_m")),
    "wpi_encode": "select p_partkey, case p_size % 5 when 4 then null else (p_size % 5 + 1)::double end as harbor_size, case p_size % 4 when 0 then 1.0::double when 1 then 0.0::double when 3 then 1.0::double end as facility from part",
    "dest_normalize": "select n_nationkey, case when regexp_matches(n_name[1:2], '^[A-Z]{2}$') then n_name[1:2] || lpad((n_nationkey + 100)::varchar, 3, '0') end as locode, upper(trim(n_name)) as name from nation",
    "dest_garbage": _with(PORTS, VISITS) + "select declared_destination, count(*) as n, regexp_replace(upper(declared_destination), '[^A-Z]', '', 'g') = '' or regexp_matches(upper(declared_destination), 'FOR ORDER') as garbage from visits where declared_destination is not null group by 1",
    "dest_exact_match": _with(PORTS, VISITS) + "select port_id, count(*) filter (declared_destination = un_locode or declared_destination = substr(un_locode, 3, 3)) as hits, count(*) as n from visits where declared_destination is not null group by 1",
    "dest_match_status": _with(PORTS, VISITS, MATCHED) + f"select 'all' as scope, {_RATES} from matched",
    "dest_accuracy_by_type": _with(PORTS, VISITS, MATCHED) + f"select ship_type, {_RATES} from matched where ship_type is not null group by 1 having count(*) > 50",
    "dest_accuracy_by_locode": _with(PORTS, VISITS, MATCHED) + f"select un_locode, {_RATES} from matched group by 1 having count(*) > 9",
    "dest_top_pairs": _with(PORTS, VISITS, MATCHED) + "select coalesce(un_locode, '?') || ' -> ' || declared_destination as pair, count(*) as n from matched where match_status = 'MISMATCH' group by 1 order by n desc, pair limit 50",
    "dest_confusion": _with(PORTS, VISITS) + """, top as (select port_name as actual from visits group by 1 order by count(*) desc, 1 limit 15
      ), inside as (select port_name as actual, declared_destination as declared from visits join top on port_name = actual where declared_destination is not null
      ), second as (select declared from inside group by 1 order by count(*) desc, 1 limit 15)
      select t.actual, s.declared, count(i.actual) as n from top t cross join second s left join inside i on i.actual = t.actual and i.declared = s.declared group by 1, 2""",
    "top_vessels_per_type": _with(PORTS, VISITS, VOYAGES) + """, act as (select mmsi, coalesce(arg_min(ship_type, seen_at), 'Unknown') as ship_type, count(*) as n from (select mmsi, ship_type, arrival_time as seen_at from visits union all select mmsi, ship_type, departure_time from voyages) group by 1)
      select ship_type, row_number() over (partition by ship_type order by n desc, mmsi)::int as rank, mmsi, n from act qualify rank <= case when regexp_matches(lower(ship_type), 'tanker|cargo') then 4 else 2 end""",
    "corr_matrix": _with(FEATURES) + " union all ".join(f"select '{x}' as a, '{y}' as b, round(corr({x}, {y}), 3) as corr from features" for x in _F for y in _F),
    "clr_transform": _with(FEATURES, "x as (select vec_id, " + ", ".join(f"case when f{i} * 100 <= 0 then 0.01 else f{i} * 100 end as f{i}" for i in range(4)) + " from features)", "y as (select vec_id, " + ", ".join(f"ln(f{i} / (f0 + f1 + f2 + f3)) as f{i}" for i in range(4)) + " from x)")
    + "select vec_id, " + ", ".join(f"round(f{i} - (f0 + f1 + f2 + f3) / 4, 6) as f{i}" for i in range(4)) + " from y",
    "robust_scale": _with(FEATURES, "q as (select " + ", ".join(f"quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as i_{c}" for c in _F) + " from features)")
    + "select vec_id, " + ", ".join(f"round(({c} - m_{c}) / case when i_{c} = 0 then 1 else i_{c} end, 6) as {c}" for c in _F) + " from features, q",
    "group_compare": _with(FEATURES) + " union all ".join(f"select label, '{c}' as feature, round(avg({c}), 6) as mean, round((select avg({c}) from features), 6) as overall, round(avg({c}) - (select avg({c}) from features), 6) as delta from features group by label" for c in _F),
    "cluster_names_from_labels": _with(FEATURES, "z as (" + " union all ".join(f"select label, '{c}' as feature, {i} as o, (avg({c}) - (select avg({c}) from features)) / (select stddev_pop({c}) from features) as z from features group by label" for i, c in enumerate(_F)) + ")")
    + "select label, arg_max(feature, (round(abs(z), 6), -o)) as feature, arg_max(case when z > 0 then 'High' else 'Low' end, (round(abs(z), 6), -o)) as direction from z group by 1",
    "crosstab_margins": _with(FEATURES, "s as (select label::varchar as label, case when f0 > 0 then 'hi' else 'lo' end as side from features)") + "select coalesce(label, 'Total') as label, coalesce(side, 'Total') as side, count(*) as n from s group by cube (label, side)",
    "stream_bucket_10m": "select user_id as mmsi, time_bucket(interval '10 minutes', ts) as bucket, arg_max(event_id, (ts, event_id)) as last_event, count(*) as n from events group by 1, 2",
    "stream_sessions": """with f as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as is_new from events window w as (partition by user_id order by ts)
      ), g as (select *, sum(is_new) over (partition by user_id order by ts rows unbounded preceding) as grp from f)
      select user_id as mmsi, count(*) as n, min(ts) as start_time, max(ts) as end_time from g group by user_id, grp""",
}

ORACLE_SQL["feature_matrix"] = (
    "select * from (" + ORACLE_SQL["feat_volume"] + ") v "
    + " ".join(f"left join ({ORACLE_SQL['feat_' + b]}) using (un_locode)" for b in ("stay", "ship_type", "size", "temporal", "seasonal", "flow"))
    + " left join (select un_locode, min(port_id) as port_id, arg_min(name, port_id) as port_name, arg_min(country_code, port_id) as country_code from (" + _with(PORTS) + "select * from ports) group by 1) using (un_locode) where total_visits >= 20"
)
ORACLE_SQL["draught_utilization"] = "select un_locode, round(p90_draught_m / nullif(draft, 0), 6) as draught_utilization from (" + ORACLE_SQL["feat_volume"] + ") left join (" + ORACLE_SQL["feat_size"] + ") using (un_locode) left join (" + _with(PORTS) + "select un_locode, arg_min((port_id % 6) * 2.0::double, port_id) as draft from ports group by 1) using (un_locode)"

ORACLE_SQL |= {
    "track_prefix": _with(PORTS, POSITIONS) + "select mmsi, max(ts) as last_ts, count(*) as n from (select * from positions qualify row_number() over (partition by mmsi order by ts) <= 20) group by 1",
    "observed_span": "select user_id as mmsi, min(ts) as first_seen, max(ts) as last_seen from events group by 1 having max(ts) - min(ts) > interval 3 day order by max(ts) - min(ts) desc, mmsi limit 50",
    "vessels_anywhere": "select o_custkey as mmsi from orders join lineitem on o_orderkey = l_orderkey union select user_id from events",
    "arrivals_by_hour": _with(PORTS, VISITS) + "select h::int as hour, count(arrival_time) as n from range(24) r(h) left join visits on hour(arrival_time) = h group by 1",
    "draught_bars": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id, destination_port_id, round(least(100.0, coalesce(avg_draught, 0) / 15.0::double * 100), 6) as avg_pct, round(least(100.0, coalesce(max_draught, 0) / 15.0::double * 100), 6) as max_pct from route_rows",
    "route_ids": _with(PORTS, VISITS, VOYAGES) + "select origin_port_id || '_' || destination_port_id as route_id, origin_port_id as origin_id, destination_port_id as dest_id, trips from route_rows",
    "destination_port_fallback": _with(PORTS, VISITS) + """select declared_destination, n, coalesce((select min(port_id) from ports where un_locode = declared_destination), (select min(port_id) from ports where lower(name) = lower(declared_destination))) as port_id
      from (select declared_destination, count(*) as n from visits where declared_destination is not null group by 1)""",
    "known_destinations": _with(PORTS, VISITS) + "select coalesce(lower(trim(declared_destination)), '') not in ('', '—', '-', 'unknown', 'no-code', 'no-locode') as known, count(*) as n from visits group by 1",
    "chord_distances": _with(PORTS) + f""", c as (select port_id, {_EARTH} * cos(radians(lat)) * cos(radians(lon)) as x, {_EARTH} * cos(radians(lat)) * sin(radians(lon)) as y, {_EARTH} * sin(radians(lat)) as z from ports)
      select a.port_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 3) as chord_m from c a, c b where b.port_id = 0""",
    "json_safe": "select event_id, case when event_id % 5 > 1 then value end as value from events",
    "dest_clean": "select p_partkey, 'O ' || upper(p_name) || ' DENMARK' as cleaned from part",
}

_SIZES = [f"{s}_{n}" for n, stats in (("length_m", ("median", "mean", "std", "p25", "p75", "iqr", "p90")), ("draught_m", ("median", "mean", "std", "iqr", "p90"))) for s in stats]
ORACLE_SQL |= {
    "dest_candidates": "select n_nationkey, array_to_string(list_sort(list_distinct(['ROUTE DKFDH->' || x || ' /AREA', 'DKFDH->' || x || ' /AREA', x, replace(x, ' ', '')])), '|') as candidates from (select n_nationkey, upper(n_name[1:2]) || ' ' || (n_nationkey + 100) as x from nation)",
    "feature_labels": " union all ".join(f"select '{c}' as feature, '{label}' as label" for c, label in [("un_locode", "Un Locode"), *[(c, c[:-2].replace("_", " ").title()) for c in _SIZES]]),
}
