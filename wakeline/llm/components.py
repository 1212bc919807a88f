"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, discard, materialise


def _salted(edges: DataFrame, by: str) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _on_every_salt(least: DataFrame) -> DataFrame:
    return least.select(F.col("v").alias("_v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root): the smallest id reachable, for every id in ``edges`` (a, b) that is not itself the smallest.

    Each round is two grouped minima and two joins of edges with a vertex. Minima are
    combined map-side. Only a vertex with larger and smaller neighbours moves its larger
    ones, and only one with several smaller neighbours joins them; it stands on every
    salt, so that its edges are dealt over ``SALTS`` tasks. Rounds are written to the
    shared folder; they end when the edge set no longer changes.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct().select(F.col("u").alias("v"), F.col("v").alias("root")), "edges")
    before = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now
        before = mark
        least = now.groupBy("v").agg(F.min("root").alias("m"))
        between = now.select(F.col("root").alias("v")).distinct().join(least, "v")
        large = _salted(now, "v").join(_on_every_salt(between), (F.col("root") == F.col("_v")) & (F.col("salt") == F.col("_salt")), "left")
        large = large.select("v", F.coalesce("m", "root").alias("root")).distinct()
        least = large.groupBy("v").agg(F.min("root").alias("m"), F.count("*").alias("n"))
        small = _salted(large, "root").join(_on_every_salt(least.where("n > 1")), (F.col("v") == F.col("_v")) & (F.col("salt") == F.col("_salt")))
        small = small.where("root <> m").select(F.col("root").alias("v"), F.col("m").alias("root"))
        past, now = now, materialise(small.unionByName(least.select("v", F.col("m").alias("root"))).distinct(), "edges")
        discard(past)
    raise RuntimeError("components did not settle")
