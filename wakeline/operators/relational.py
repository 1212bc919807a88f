"""Row-level cleaning, de-duplication, upserts and latest-row operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column, kind: str = "double") -> Column:
    """A number written with a decimal comma or point; NULL where it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast(kind)


def day_first_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("dd/MM/yyyy HH:mm:ss"))


def lenient_timestamp(text: Column, formats: tuple[str, ...] = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyyyMMdd")) -> Column:
    """First format that fits; whole numbers count as epoch seconds (10 digits) or milliseconds (13)."""
    t = F.trim(text)
    epoch = F.when(t.rlike(r"^\d{10}$"), F.timestamp_seconds(t.try_cast("long"))).when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(t, F.lit(f)) for f in formats], t.try_cast("timestamp"))


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold and rows that do not (or are unknown)."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """Newest row of each key, nulls last: a grouped maximum, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), F.col(tie))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def insert_absent(stored: DataFrame, staged: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """Staged rows whose key is not stored; the staged time range bounds the stored scan, so partitions prune."""
    seen = stored.select(*keys)
    if time:
        low, high = staged.agg(F.min(time), F.max(time)).first()
        seen = seen.where(F.col(time).between(low, high)) if low is not None else seen.limit(0)
    return staged.join(seen, keys, "left_anti")


def upsert(stored: DataFrame, staged: DataFrame, key: str, keep_old: tuple[str, ...] = (), take_new: tuple[str, ...] = ()) -> DataFrame:
    """Per column the staged value unless null; ``keep_old`` is never changed, ``take_new`` always is."""
    s, t = stored.alias("s"), staged.alias("t")
    joined = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")

    def pick(c: str) -> Column:
        old, new = F.col(f"s.{c}"), F.col(f"t.{c}")
        if c in keep_old:
            return F.when(F.col(f"s.{key}").isNotNull(), old).otherwise(new)
        return F.when(F.col(f"t.{key}").isNotNull(), new).otherwise(old) if c in take_new else F.coalesce(new, old)

    return joined.select(*[pick(c).alias(c) for c in stored.columns])


def null_coverage(df: DataFrame) -> DataFrame:
    """(feature, n_null, pct_null) of every column, in one pass."""
    total = F.count("*")
    counted = df.agg(total.alias("_t"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_null")) for c in df.columns]))
    return counted.select("_t", entries.alias("e")).select("e.feature", "e.n_null", F.round(F.col("e.n_null") * 100.0 / F.col("_t"), 2).alias("pct_null"))


def any_contains(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search over several columns."""
    q = F.lit(query.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c.cast("string")), q), F.lit(False)) for c in columns])


def is_known(text: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "—", "-", "unknown", "no-code", "no-locode")
