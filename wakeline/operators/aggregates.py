"""Route, stay-duration, feature-matrix and destination aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.stats import entropy_by, quantile, share
from wakeline.functions.text import FLOW_COUNTRY_NAMES, clean_name, destination_candidates, exact_match, fuzzy_score, is_garbage, MATCH_THRESHOLD, may_reach
from wakeline.sources.adapters import SHIP_TYPES

# Edges and names of the stay-duration bins.
BIN_EDGES = [0, 2, 4, 6, 8, 12, 18, 24, 36, 48, 72, 168]
BIN_NAMES = ["<2h", "2-4h", "4-6h", "6-8h", "8-12h", "12-18h", "18-24h", "24-36h", "36-48h", "48-72h", "72-168h", ">7d"]


def draught_stats(value: Column, empty: float | None = None) -> list[Column]:
    """Rounded min, mean and max without nulls and zeros; ``empty`` where none is left."""
    v = F.nullif(value, F.lit(0.0))
    out = [(F.min(v), "min_draught"), (F.avg(v), "avg_draught"), (F.max(v), "max_draught")]
    return [(F.round(c, 2) if empty is None else F.coalesce(F.round(c, 2), F.lit(empty))).alias(n) for c, n in out]


def routes(voyages: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Trips, vessels and destination draughts per origin and destination."""
    return voyages.groupBy("origin_port_id", "destination_port_id").agg(F.count("*").alias("trips"), F.countDistinct("mmsi").alias("vessels"), *draught_stats(F.col("draught_at_dest_m"), empty))


def route_vessels(voyages: DataFrame) -> DataFrame:
    """Per route and vessel: trips, type of the first voyage, draughts."""
    first = F.min_by("ship_type", F.struct("departure_time", "arrival_time")).alias("ship_type")
    return voyages.groupBy("origin_port_id", "destination_port_id", "mmsi").agg(F.count("*").alias("trips"), first, *draught_stats(F.col("draught_at_dest_m"), 0.0))


def port_rollup(route_rows: DataFrame) -> DataFrame:
    """Outgoing trips of a port, and figures over the maxima of its routes."""
    out = route_rows.groupBy(F.col("origin_port_id").alias("port_id")).agg(F.sum("trips").alias("outgoing_trips"), F.count("*").alias("routes"), *draught_stats(F.col("max_draught"), 0.0))
    return out


def vessel_rollup(vessel_rows: DataFrame) -> DataFrame:
    """Trips of a vessel over all routes; maxima of 0 count here."""
    m = F.col("max_draught")
    return vessel_rows.groupBy("mmsi").agg(F.sum("trips").alias("trips"), F.round(F.min(m), 2).alias("min_draught"), F.round(F.avg(m), 2).alias("avg_draught"), F.round(F.max(m), 2).alias("max_draught"))


def destinations_per_origin(route_rows: DataFrame, least: int, most: int, k: int = 10) -> DataFrame:
    """The k destinations of most trips an origin, with the share of its largest."""
    w = Window.partitionBy("origin_port_id")
    kept = route_rows.where(F.col("trips").between(least, most))
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("trips"), "destination_port_id"))).withColumn("bar_pct", F.round(F.col("trips") * 100.0 / F.max("trips").over(w), 2))
    return ranked.where(F.col("rank") <= k).select("origin_port_id", "rank", "destination_port_id", "trips", "bar_pct")


def duration_histogram(visits: DataFrame) -> DataFrame:
    """Left-closed bins of stay hours with counts and percent; empty bins are there."""
    h = F.col("stay_duration_hours")
    number = sum((F.when(h >= e, 1).otherwise(0) for e in BIN_EDGES[1:]), F.lit(0))
    counts = visits.where(h.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    bins = visits.sparkSession.createDataFrame(list(enumerate(BIN_NAMES)), "bin int, label string")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())
    return bins.join(counts, "bin", "left").select("bin", "label", n.alias("n"), F.round(n * 100.0 / total, 2).alias("pct"))


def stay_stats(visits: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    h = "stay_duration_hours"
    q = F.percentile(h, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    out = visits.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(h).alias("mean_h"), F.stddev_samp(h).alias("std_h"), F.min(h).alias("min_h"), F.max(h).alias("max_h"), q.alias("q")).where(F.col("n") > least)
    named = [F.round(F.element_at("q", i + 1), 6).alias(f"p{p}_h") for i, p in enumerate((25, 50, 75, 90, 95, 99))]
    return out.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("mean_h", "std_h", "min_h", "max_h")], *named)


def normal_type(ship_type: Column) -> Column:
    t = F.trim(ship_type)
    return F.when(t.isin(*SHIP_TYPES), t).otherwise("Other")


def volume_features(v: DataFrame) -> DataFrame:
    span = v.agg(((F.unix_micros(F.max("arrival_time").cast("timestamp")) - F.unix_micros(F.min("arrival_time").cast("timestamp"))) / 86_400_000_000).alias("d")).select(F.floor("d").alias("days"))
    out = v.groupBy("un_locode").agg(F.count("*").alias("total_visits"), F.countDistinct("mmsi").alias("unique_vessels")).crossJoin(F.broadcast(span))
    n, u = F.col("total_visits"), F.col("unique_vessels")
    return out.select("un_locode", "total_visits", "unique_vessels", F.round(n / F.greatest(F.col("days") / 7.0, F.lit(1.0)), 6).alias("visits_per_week"), F.round(n / F.greatest(F.col("days"), F.lit(1)), 6).alias("avg_vessels_per_day"), F.round(1.0 - u / n, 6).alias("repeat_visitor_ratio"), F.round(n / u, 6).alias("avg_visits_per_vessel"))


def _spread(value: str, name: str, quantiles: bool = True) -> list[Column]:
    q = lambda x: quantile(value, x)
    out = [(q(0.5), f"median_{name}"), (F.avg(value), f"mean_{name}"), (F.stddev_samp(value), f"std_{name}")]
    if quantiles:
        out += [(q(0.25), f"p25_{name}"), (q(0.75), f"p75_{name}")]
    return [F.round(c, 6).alias(n) for c, n in [*out, (q(0.75) - q(0.25), f"iqr_{name}")]]


def stay_features(v: DataFrame) -> DataFrame:
    h = F.col("stay_duration_hours")
    return v.where(h.isNotNull()).groupBy("un_locode").agg(*_spread("stay_duration_hours", "stay_h"), F.round(share(h < 4), 6).alias("pct_short_stay"), F.round(share(h > 48), 6).alias("pct_long_stay"))


def ship_type_features(v: DataFrame) -> DataFrame:
    """Percentages over the fixed types, the first largest, and the entropy (NULL for a single type)."""
    typed = v.withColumn("_type", normal_type(F.col("ship_type")))
    wide = typed.groupBy("un_locode").agg(*[F.count_if(F.col("_type") == t).alias(f"_{t}") for t in SHIP_TYPES], F.count("*").alias("_n"))
    most = F.greatest(*[F.col(f"_{t}") for t in SHIP_TYPES])
    dominant = F.coalesce(*[F.when(F.col(f"_{t}") == most, t) for t in SHIP_TYPES])
    entropy = entropy_by(typed, "un_locode", "_type", one_value=None)
    return wide.join(entropy, "un_locode").select("un_locode", *[F.round(F.col(f"_{t}") * 100.0 / F.col("_n"), 6).alias(f"pct_{t.lower()}") for t in SHIP_TYPES], dominant.alias("dominant_ship_type"), F.round("entropy", 6).alias("ship_type_entropy"))


def size_features(v: DataFrame) -> DataFrame:
    ok = (F.col("length_m").isNull() | (F.col("length_m") > 10)) & (F.col("draught_m").isNull() | (F.col("draught_m") > 0))
    return v.where(ok).groupBy("un_locode").agg(*_spread("length_m", "length_m"), F.round(quantile("length_m", 0.9), 6).alias("p90_length_m"), *_spread("draught_m", "draught_m", False), F.round(quantile("draught_m", 0.9), 6).alias("p90_draught_m"))


def temporal_features(v: DataFrame) -> DataFrame:
    hour = F.hour("arrival_time")
    shares = v.groupBy("un_locode").agg(F.round(share((hour >= 22) | (hour < 6)), 6).alias("night_visit_ratio"), F.round(share(F.weekday("arrival_time") >= 5), 6).alias("weekend_visit_ratio"))
    entropy = entropy_by(v.withColumn("_hour", hour), "un_locode", "_hour", base=24.0)
    return shares.join(entropy, "un_locode").select("un_locode", "night_visit_ratio", "weekend_visit_ratio", F.round("entropy", 6).alias("peak_hour_entropy"))


def seasonal_features(v: DataFrame) -> DataFrame:
    """Variation of monthly counts over observed months, and the (first) busiest; NULL under two months."""
    monthly = v.groupBy("un_locode", F.date_format("arrival_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    out = monthly.groupBy("un_locode").agg(F.count("*").alias("m"), F.stddev_samp("n").alias("s"), F.avg("n").alias("a"), F.min(F.struct(-F.col("n"), "month")).alias("b"))
    two = F.col("m") >= 2
    return out.select("un_locode", F.round(F.when(two, F.col("s") / F.col("a")), 6).alias("seasonal_cv"), F.when(two, F.col("b.month")).alias("busiest_month"))


def flow_features(v: DataFrame) -> DataFrame:
    dest = v.where(F.col("declared_destination").isNotNull())
    d, name, country = F.lower("declared_destination"), F.lower("port_name"), F.lower("country_code")
    to_name = F.create_map(*[F.lit(x) for p in FLOW_COUNTRY_NAMES.items() for x in p])[country]
    own = F.contains(d, name) | ((F.length(name) > 5) & F.contains(d, F.substring(name, 1, 5)))
    intra = F.contains(d, country) | F.coalesce(F.contains(d, to_name), F.lit(False))
    shares = dest.groupBy("un_locode").agg(F.round(share(own), 6).alias("match_rate"), F.round(share(intra), 6).alias("intra_country_ratio"))
    entropy = entropy_by(dest, "un_locode", "declared_destination")
    return v.select("un_locode").distinct().join(shares, "un_locode", "left").join(entropy, "un_locode", "left").select("un_locode", F.round("entropy", 6).alias("destination_diversity"), "match_rate", "intra_country_ratio")


def feature_matrix(v: DataFrame, ports: DataFrame, least_visits: int = 20) -> DataFrame:
    """All feature blocks per locode, one port each (the smallest id), small ports dropped. Blocks share the key, so joins reuse its partitioning."""
    own = ports.groupBy("un_locode").agg(F.min(F.struct("port_id", F.col("name").alias("port_name"), "country_code")).alias("p"))
    out = volume_features(v)
    for block in (stay_features, ship_type_features, size_features, temporal_features, seasonal_features, flow_features):
        out = out.join(block(v), "un_locode", "left")
    return out.where(F.col("total_visits") >= least_visits).join(own, "un_locode", "left").select(*out.columns, "p.port_id", "p.port_name", "p.country_code")


def match_status(v: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``match_status`` GARBAGE, MATCH or MISMATCH; exact rules first, similarity for the rest.

    Decided once for each distinct destination, port name, other name (``alt_name``,
    where there is one) and locode, and joined back. A name that cleans to nothing
    matches nothing.
    """
    key = ["declared_destination", "port_name", "un_locode", *(["alt_name"] if "alt_name" in v.columns else [])]
    declared = F.trim("declared_destination")
    names = F.array_distinct(F.filter(F.array(*[clean_name(F.col(c)) for c in key[1::2]]), lambda x: x != ""))
    pairs = v.select(*key).distinct().withColumn("_cands", destination_candidates(declared)).withColumn("_names", names)
    cleaned = F.array_distinct(F.filter(F.transform("_cands", clean_name), lambda x: x != ""))
    first = F.when((declared == "") | is_garbage(declared) | (F.size("_cands") == 0), "GARBAGE").when(exact_match(F.col("_cands"), F.col("un_locode")) | F.arrays_overlap(cleaned, F.col("_names")), "MATCH")
    pairs = pairs.withColumn("_clean", cleaned).withColumn("match_status", first)
    if fuzzy:
        open_ = pairs.where(F.col("match_status").isNull()).select(F.explode("_clean").alias("_c"), "_names").select("_c", F.explode("_names").alias("_n")).distinct()
        scored = open_.where(may_reach(F.col("_c"), F.col("_n"), MATCH_THRESHOLD)).withColumn("_s", fuzzy_score(F.col("_c"), F.col("_n"))).where(F.col("_s") >= MATCH_THRESHOLD)
        hits = pairs.where(F.col("match_status").isNull()).select(*key, F.explode("_clean").alias("_c"), "_names").select(*key, "_c", F.explode("_names").alias("_n")).join(scored, ["_c", "_n"]).select(*key).distinct()
        pairs = _join_nulls(pairs, hits.withColumn("_hit", F.lit(True)), key).withColumn("match_status", F.coalesce("match_status", F.when(F.col("_hit"), "MATCH")))
    return _join_nulls(v, pairs.select(*key, F.coalesce("match_status", F.lit("MISMATCH")).alias("match_status")), key)


def _join_nulls(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join on a key in which nulls are equal; the right side has one row a key."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in key], *[c for c in right.columns if c not in key])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in key]
    return left.join(named, same, "left").drop(*[f"_r_{c}" for c in key])


def match_rates(rows: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    count = lambda s: F.count_if(F.col("match_status") == s)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), count("MATCH").alias("matches"), count("MISMATCH").alias("mismatches"), count("GARBAGE").alias("garbage"))
    return out.where(F.col("n") > least).withColumn("match_pct", F.round(F.col("matches") * 100.0 / F.col("n"), 2))


def confusion(rows: DataFrame, actual: str, declared: str, k: int = 15) -> DataFrame:
    """(actual, declared, n) over the k most frequent actual values and, among them, declared ones; zeros are there."""
    top = rows.groupBy(actual).count().orderBy(F.desc("count"), actual).limit(k).select(actual)
    inside = rows.where(F.col(declared).isNotNull()).join(F.broadcast(top), actual)
    top_declared = inside.groupBy(declared).count().orderBy(F.desc("count"), declared).limit(k).select(declared)
    counts = inside.join(F.broadcast(top_declared), declared).groupBy(actual, declared).agg(F.count("*").alias("n"))
    every = top.crossJoin(F.broadcast(top_declared))  # k x k names
    return every.join(counts, [actual, declared], "left").select(F.col(actual).alias("actual"), F.col(declared).alias("declared"), F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_with_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of values with margins named Total; rows with a null on either side are left out."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
    counted = known.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return counted.select(F.when(F.col("_a") == 1, "Total").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "Total").otherwise(F.col(b)).alias(b), "n")


def top_vessels_per_type(activity: DataFrame) -> DataFrame:
    """Per ship type the vessels of most activity: four of tankers and cargo, two of others."""
    t = F.coalesce("ship_type", F.lit("Unknown"))
    ranked = activity.withColumn("ship_type", t).withColumn("rank", F.row_number().over(Window.partitionBy("ship_type").orderBy(F.desc("n"), "mmsi")))
    limit = F.when(F.lower("ship_type").rlike("tanker|cargo"), 4).otherwise(2)
    return ranked.where(F.col("rank") <= limit).select("ship_type", "rank", "mmsi", "n")
