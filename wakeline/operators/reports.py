"""Trip reports, port attributes, comparisons and cleaning rules behind the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import ml
from wakeline.operators.aggregates import feature_matrix
from wakeline.sources.adapters import PORT_FLAGS

# The words of the ordered scales.
HARBOR_SIZES = ["Very Small", "Small", "Medium", "Large"]
SHELTERS = ["None", "Poor", "Fair", "Good", "Excellent"]
PORT_NUMBERS = ["channel_depth_m", "anchorage_depth_m", "cargo_pier_depth_m", "max_vessel_draft_m"]


def encoded_ports(index: DataFrame) -> DataFrame:
    """Port attributes as numbers: ordered scales, flags as 1, 0 or NULL; other texts are left out."""
    flags = [ml.yes_no(F.col(c)).alias(f"{c}_bin") for c in PORT_FLAGS if c in index.columns]
    scales = [ml.ordinal(F.col("harbor_size"), HARBOR_SIZES, 1).alias("harbor_size_int"), ml.ordinal(F.col("shelter_afforded"), SHELTERS, 0).alias("shelter_afforded_int")]
    return index.select("port_id", "un_locode", "port_name", "country_code", *scales, *PORT_NUMBERS, "longitude", "latitude", *flags)


def port_matrix(visits: DataFrame, ports: DataFrame, index: DataFrame, least_visits: int = 20) -> DataFrame:
    """The feature matrix with encoded port attributes, one port a locode (the smallest id), and ``draught_utilization``."""
    blocks = feature_matrix(visits, ports, least_visits)
    coded = encoded_ports(index)
    rest = [c for c in coded.columns if c != "un_locode"]
    own = coded.groupBy("un_locode").agg(F.min(F.struct(*rest)).alias("p"))
    joined = blocks.join(own, "un_locode", "left")
    named = [F.col(f"p.{c}").alias(f"{c}_wpi" if c in blocks.columns else c) for c in rest]
    return joined.select(*blocks.columns, *named).withColumn("draught_utilization", F.try_divide("p90_draught_m", F.nullif("max_vessel_draft_m", F.lit(0.0))))


def _drawn(trips: DataFrame) -> DataFrame:
    """Trips with the larger draught of both ends; 0 where neither has one."""
    return trips.withColumn("draught", F.greatest(F.coalesce("o_max", F.lit(0.0)), F.coalesce("d_max", F.lit(0.0))))


def _figures(c: str) -> list[Column]:
    return [F.round(f(c), places).alias(f"{n}_draught") for n, f, places in (("min", F.min, 2), ("avg", F.avg, 6), ("max", F.max, 2))]


def trip_vessels(trips: DataFrame) -> DataFrame:
    """Per route the vessels of trips with a draught, ranked by such trips."""
    rows = _drawn(trips).where("draught > 0").groupBy("origin_id", "dest_id", "mmsi").agg(F.count("*").alias("trips"), *_figures("draught"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("origin_id", "dest_id").orderBy(F.desc("trips"), "mmsi")))


def trip_ports(trips: DataFrame) -> DataFrame:
    """Per port the number of draughts at its end of trips, and their figures; zeros and nulls do not count."""
    ends = trips.select(F.explode(F.array(F.struct(F.col("origin_id").alias("port_id"), F.col("o_max").alias("draught")), F.struct(F.col("dest_id").alias("port_id"), F.col("d_max").alias("draught")))).alias("e")).select("e.*")
    return ends.where("draught > 0").groupBy("port_id").agg(F.count("*").alias("total_visits"), *_figures("draught"))


def trip_totals(trips: DataFrame) -> DataFrame:
    """Per vessel the trips with a draught, and their figures."""
    return _drawn(trips).where("draught > 0").groupBy("mmsi").agg(F.count("*").alias("trips"), *_figures("draught"))


def trip_metadata(trips: DataFrame) -> DataFrame:
    """One row: routes, ports, vessels (with a draught) and trips."""
    drawn = _drawn(trips)
    routes = drawn.groupBy("origin_id", "dest_id").agg(F.count("*").alias("trips")).agg(F.count("*").alias("routes"), F.coalesce(F.sum("trips"), F.lit(0)).alias("trips"))
    ports = drawn.select(F.explode(F.array("origin_id", "dest_id")).alias("p")).distinct().agg(F.count("*").alias("ports"))
    vessels = drawn.where("draught > 0").select("mmsi").distinct().agg(F.count("*").alias("vessels"))
    return routes.crossJoin(F.broadcast(ports)).crossJoin(F.broadcast(vessels))  # single rows


def compared(df: DataFrame, key: str, group: str, columns: list[str]) -> DataFrame:
    """(key, feature, spread, dir): each value against its group's mean; small differences are ``same``. Nulls are left out."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("own"), F.col(f"m_{c}").alias("mean")) for c in columns])
    each = df.join(means, group).select(key, F.explode(cells).alias("c")).select(key, "c.*").where("own is not null and mean is not null")
    least = F.when(F.col("feature").startswith("pct_"), 0.5).otherwise(F.greatest(0.05 * F.abs(F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))), F.lit(0.05)))
    d = F.col("own") - F.col("mean")
    return each.select(key, "feature", F.round(F.abs(d), 6).alias("spread"), F.when(F.abs(d) < least, "same").when(d > 0, "up").otherwise("down").alias("dir"))


def skewness_of(df: DataFrame, columns: list[str], most: float = 0.75) -> DataFrame:
    """(feature, skewness, skewed): population skewness without nulls; skewed beyond ``most`` either way."""
    return ml._long(df.agg(*[F.skewness(c).alias(c) for c in columns]), [(c, F.col(c)) for c in columns], ("feature", "skewness")).withColumn("skewed", F.abs("skewness") > most)


def dashboard_features(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """(un_locode, feature, value, visits): values to two places, and for shares the visits that they stand for."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"), F.lit(c.startswith("pct_")).alias("share")) for c in columns])
    each = matrix.select("un_locode", "total_visits", F.explode(cells).alias("c")).select("un_locode", "total_visits", "c.*")
    return each.select("un_locode", "feature", F.round("v", 2).alias("value"), F.when(F.col("share"), F.bround(F.col("v") / 100.0 * F.col("total_visits")).cast("long")).alias("visits"))


def insert_first(stored: DataFrame, staged: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Staged rows of new keys, the first of each by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return staged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(stored.select(key), key, "left_anti")


def after_watermark(rows: DataFrame, marks: DataFrame, key: str, time: str, mark: str) -> DataFrame:
    """Rows later than their key's watermark; keys without one are all new."""
    return rows.join(marks.select(key, mark), key, "left").where(F.col(mark).isNull() | (F.col(time) > F.col(mark))).drop(mark)


def recent(rows: DataFrame, time: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows of the last days before ``now``, or else before the newest row."""
    if now is not None:
        return rows.where(F.col(time) > now - F.make_dt_interval(F.lit(days)))
    newest = F.broadcast(rows.agg(F.max(time).alias("_newest")))  # a single row
    return rows.crossJoin(newest).where(F.col(time) > F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def whole_records(df: DataFrame, text: str, separator: str, n: int) -> DataFrame:
    """``fields`` of the rows whose text has exactly ``n`` of them."""
    return df.withColumn("fields", F.split(F.col(text), separator, -1)).where(F.size("fields") == n)


def first_format_timestamp(df: DataFrame, text: str, order: str, formats: tuple[str, ...] = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")) -> DataFrame:
    """``parsed``: texts in the format of the first one (by ``order``) that is there; other texts are NULL."""
    first = F.broadcast(df.where(F.trim(text) != "").agg(F.min_by(F.trim(text), order).alias("_first")))  # a single row
    fits = [F.when(F.try_to_timestamp("_first", F.lit(f)).isNotNull(), F.try_to_timestamp(F.trim(text), F.lit(f))) for f in formats]
    which = F.coalesce(*[F.when(F.try_to_timestamp("_first", F.lit(f)).isNotNull(), F.lit(i)) for i, f in enumerate(formats)])
    parsed = F.coalesce(*[F.when(which == i, c) for i, c in enumerate(fits)])
    return df.crossJoin(first).withColumn("parsed", parsed).drop("_first")


def iso_timestamp(text: Column) -> Column:
    """ISO texts with or without a zone, ``Z`` included; NULL where they are none."""
    return F.regexp_replace(F.trim(text), "[Zz]$", "+00:00").try_cast("timestamp")


def guessed_timestamp(df: DataFrame, text: str) -> DataFrame:
    """``parsed`` from texts of unknown format.

    8 and 14 digits are compact dates; other digits are epoch seconds, or
    milliseconds where the column's median has more than 10 of them. Slashed dates
    are day-first or month-first as more of the column's values allow, day-first on
    a tie. Null words are NULL.
    """
    t = F.trim(text)
    there = F.when(~F.lower(t).isin("", "nan", "none", "null", "0", "0000-00-00 00:00:00"), t)
    compact, digits = there.rlike(r"^(\d{8}|\d{14})$"), there.rlike(r"^\d+$")
    parse = lambda *formats: F.coalesce(*[F.try_to_timestamp(there, F.lit(f)) for f in formats])
    day, month = parse("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"), parse("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")
    votes = df.agg((F.count(day) >= F.count(month)).alias("_day"), (F.coalesce(F.percentile(F.when(digits & ~compact, F.length(there)), F.lit(0.5)), F.lit(0)) > 10).alias("_millis"))
    number = there.try_cast("long")
    parsed = (
        F.when(compact, parse("yyyyMMddHHmmss", "yyyyMMdd")).when(digits, F.when(F.col("_millis"), F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number)))
        .otherwise(F.coalesce(F.when(F.col("_day"), day).otherwise(month), there.try_cast("timestamp")))
    )
    return df.crossJoin(F.broadcast(votes)).withColumn("parsed", parsed).drop("_day", "_millis")  # votes: a single row


def has_rows(df: DataFrame) -> bool:
    """Whether a table has any row; reads one at most."""
    return not df.limit(1).isEmpty()
