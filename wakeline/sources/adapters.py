"""Domain tables (ports, positions, visits, vessels, terminals) as views over star-schema tables.

The formulas are integer or affine, so any engine computes the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ship types that are counted on their own, the rest being Other.
SHIP_TYPES = ["Cargo", "Tanker", "Passenger", "Fishing", "Tug", "HSC", "Dredging", "Sailing", "Towing", "Pilot", "SAR", "Other"]

# The Yes or No columns of the port index.
PORT_FLAGS = [
    "facility_ro_ro", "facility_solid_bulk", "facility_liquid_bulk", "facility_container", "facility_breakbulk", "facility_oil_terminal", "facility_lng_terminal",
    "cranes_fixed", "cranes_mobile", "cranes_floating", "cranes_container", "lifts_100plus_tons", "lifts_50_100_tons", "services_ice_breaking", "services_diving",
    "pilotage_compulsory", "tugs_assistance", "restriction_ice", "restriction_tide", "restriction_heavy_swell", "supplies_fuel_oil", "supplies_diesel_oil", "supplies_potable_water",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(
        "s_suppkey as port_id", "s_name as name", "n_name as country_code",
        "concat('N', lpad(cast(n_nationkey as string), 2, '0'), lpad(cast(s_suppkey % 100 as string), 2, '0')) as un_locode",
        "9.0D + (s_suppkey % 10) * 0.5D as lon", "54.0D + (s_suppkey div 10) * 0.05D as lat",
    )


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name", "9.0D + (p_partkey % 97) * 0.05D as lon", "54.0D + (p_partkey % 53) * 0.01D as lat")


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as mmsi", "c_name as name", "c_mktsegment as ship_type")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve five-minute points for each hour in which a vessel has an event."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.expr("date_trunc('HOUR', ts)"))
    first = events.groupBy(F.col("user_id").alias("mmsi"), "hour").agg(F.min_by(F.struct("event_id", "event_type", "props"), "event_id").alias("e"))
    p = ports(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    keyed = first.crossJoin(F.broadcast(n)).withColumn("at_port", F.expr("(mmsi * 7 + (datediff(hour, timestamp_ntz'2024-01-01 00:00:00') div 3) * 17) % n"))
    joined = keyed.join(p.select("port_id", F.col("name").alias("port_name"), "un_locode", F.col("lon").alias("port_lon"), F.col("lat").alias("port_lat")), keyed.at_port == p.port_id)
    each = joined.withColumn("k", F.explode(F.expr("sequence(0, 11)")))
    return each.selectExpr(
        "mmsi", "hour + k * interval '5' minute as ts",
        "case when e.event_id % 5 = 0 then 8.0D else 0.3D end as sog",
        "port_lon + ((e.event_id + k) % 7 - 3) * 0.0005D + case when e.event_id % 5 = 0 then 0.2D else 0.0D end as lon",
        "port_lat + ((e.event_id + k) % 5 - 2) * 0.0005D as lat",
        "case e.event_type when 'view' then 'Moored' when 'click' then 'At anchor' when 'purchase' then '1' when 'signup' then '5' end as nav_status",
        "cast(get_json_object(e.props, '$.k') as double) / 10.0D as draught",
        "case e.event_id % 3 when 0 then port_name when 1 then '' else un_locode end as destination",
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    port = ports(spark, sf_dir).withColumnRenamed("name", "port_name")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).join(port, l.l_suppkey == port.port_id)
    base = joined.withColumn("arrival_time", F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey * 7 % 24 as int), 0, 0)")).withColumn("stay", F.expr("l_quantity * l_linenumber / 2.0D"))
    types = ", ".join(f"'{t}'" for t in [*SHIP_TYPES, "Undefined"])
    return base.selectExpr(
        "o_custkey as mmsi", "port_id", "port_name", "un_locode", "country_code", "arrival_time",
        "arrival_time + make_dt_interval(0, 0, cast(stay * 60 as int), 0) as departure_time",
        "stay as stay_duration_hours",
        f"case when o_custkey % 14 < 13 then element_at(array({types}), cast(o_custkey % 14 as int) + 1) end as ship_type",
        "5.0D * p_size + 5 as length_m", "l_tax * 100 + 0.0D as draught_m",
        "case l_partkey % 6 when 0 then port_name when 1 then un_locode when 2 then country_code when 3 then 'FOR ORDERS' when 4 then '' end as declared_destination",
        "l_orderkey as order_key", "l_linenumber as line_number", "l_partkey as part_key",
    )


def port_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port attributes as a port index gives them: words for sizes and shelter, Yes or No flags, depths and limits."""
    own = ports(spark, sf_dir).withColumnRenamed("name", "port_name").withColumnRenamed("lon", "longitude").withColumnRenamed("lat", "latitude")
    pick = lambda words, by: f"element_at(array({', '.join(words)}), cast({by} % {len(words)} as int) + 1)"
    flags = [pick(["'Yes'", "'No'", "'Unknown'", "' yes '", "null"], f"(port_id + {i})") + f" as {c}" for i, c in enumerate(PORT_FLAGS)]
    return own.selectExpr(
        "*", pick(["'Very Small'", "'Small'", "'Medium'", "'Large'", "'?'"], "port_id") + " as harbor_size", pick(["'None'", "'Poor'", "'Fair'", "'Good'", "'Excellent'", "null"], "port_id") + " as shelter_afforded",
        "'Coastal' as harbor_type", "port_id % 9 + 0.5D as channel_depth_m", "port_id % 7 + 0.5D as anchorage_depth_m", "port_id % 5 + 0.5D as cargo_pier_depth_m", "(port_id % 6) * 2.0D as max_vessel_draft_m", *flags,
    )
