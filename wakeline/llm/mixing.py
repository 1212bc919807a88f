"""Mixing sources to target weights, in fixed-length blocks of words.

1. Sizes and targets. Words are counted once; sources, by code point with null
   last, weigh 3, 1, 2, repeating, and share 150 % of all words. Targets stop at
   twice their source; the excess is shared anew. With sources ordered by cap per
   unit of weight the capped ones are a prefix, so running sums settle it.
2. Packing. A source's documents stand in a pseudorandom order one after the
   other and are cut into blocks of ``BLOCK`` words. Offsets are running sums in
   two levels, (source, chunk) and chunk totals, so no task holds a source.
3. Shards. Output is dealt into shards; each slot of a shard draws its source
   with probability proportional to the targets, which makes the source counts of
   a shard multinomial. Running sums over shards number each source's slots; a
   last shard settles what chance left over or short, so that every source fills
   its quota of slots.
4. Permutation. Slot j of a source reads block ``perm(j mod n)`` of pass
   ``j div n``, a swap-or-not shuffle of the n block indices seeded by source and
   pass. Slots and blocks meet in one equi-join on (source, index).

A document can be taken twice at most, as quotas are two passes at most. All
draws are hashes, so reruns agree.

Defined results: null or empty texts have size 0 and are never taken; a null
source is a source of its own; identical rows are separate documents; an empty
table gives no rows. The table of sources (one row a source) is broadcast only
where Spark's measured file size allows it. Natively built: no Python on executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, materialise, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK = 64
#: Slots a shard holds at least; shards number MOST_SHARDS at most.
SHARD = 4096
MOST_SHARDS = 100_000
SLOTS_A_TASK = 1_000_000
ROUNDS = 16
CELLS = 4096


@dataclass
class Mix:
    rows: DataFrame  # doc_id, row, source, k, size
    sources: DataFrame  # source, k, source_size, target, blocks, quota, low
    placed: DataFrame  # doc_id, row, k, size, start: documents with words
    slots: DataFrame  # shard, k, block


def targets(rows: DataFrame) -> DataFrame:
    """(source, k, source_size, target): k numbers the sources from 1."""
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("k", F.row_number().over(every))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("k") - 1, F.lit(len(WEIGHTS))) + 1).cast("double")
    total = total.withColumn("w", weight).withColumn("cap", (MOST_TIMES * F.col("source_size")).cast("double"))
    order = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), "k")
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    pool = SHARE * F.sum("source_size").over(Window.partitionBy())
    level = (pool - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    total = total.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    total = total.withColumn("capped", F.min("capped").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "k", "level"))).over(Window.partitionBy())["level"]
    return total.select("source", "k", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("w")).alias("target"))


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """Swap-or-not: a pseudorandom bijection of 0..n-1 for any n."""

    def swap(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(r, F.lit("key"), *seed), n)
        other = F.pmod(key - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.lit("bit"), F.greatest(x, other), *seed), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), index.cast("long"), swap)


def plan(docs: DataFrame) -> Mix:
    spark = docs.sparkSession
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"), row.alias("row"))
    sized = materialise(sized, "mix-sizes")
    n_rows = sized.count()
    s = F.col("source_size")
    again = F.floor(F.col("target") / F.nullif(s, F.lit(0)))  # whole passes
    blocks = F.ceil(s / BLOCK).cast("long")
    part = F.least(F.round((F.col("target") - again * s) / BLOCK).cast("long"), F.col("blocks"))
    sources = targets(sized).withColumn("blocks", blocks)
    sources = sources.withColumn("quota", F.coalesce(F.least(again * F.col("blocks") + part, MOST_TIMES * F.col("blocks")), F.lit(0)).cast("long"))
    low = F.sum("quota").over(Window.partitionBy().orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota")
    sources = materialise(sources.withColumn("low", low), "mix-sources")
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0

    rows = sized.join(sources.select(F.col("source").alias("_source"), "k"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chunks = max(1, math.isqrt(n_rows))
    chunked = rows.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row", F.lit("chunk")), F.lit(chunks)))
    inside = Window.partitionBy("k", "chunk").orderBy(F.xxhash64("row", "doc_id"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    bases = chunked.groupBy("k", "chunk").agg(F.sum("size").alias("n")).withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    placed = chunked.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(bases, ["k", "chunk"])
    placed = materialise(placed.select("doc_id", "row", "k", "size", (F.col("start") + F.col("base")).alias("start")), "mix-placed")
    return Mix(rows, sources, placed, slots(spark, sources, n_slots))


def slots(spark, sources: DataFrame, n_slots: int) -> DataFrame:
    """(shard, k, block): which block each slot of each shard reads."""
    shard = max(SHARD, math.ceil(n_slots / MOST_SHARDS))
    last = math.ceil(n_slots / shard)
    width = max(1, math.ceil(n_slots / CELLS))
    span = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("quota") - 1) / width))
    cells = sources.where("quota > 0").select("k", "low", (F.col("low") + F.col("quota")).alias("high"), F.explode(span).alias("cell"))
    drawn = spark.range(n_slots).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit("source")), F.lit(max(1, n_slots))).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= low and u < high")
    counts = drawn.groupBy("shard", "k").agg(F.count("*").alias("n"))
    settle = sources.where("quota > 0").select(F.lit(last).cast("long").alias("shard"), "k", F.col("quota").alias("n"))
    by_shard = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counts.unionByName(settle).withColumn("from", F.sum("n").over(by_shard) - F.col("n"))
    numbered = numbered.join(sources.select("k", "quota", "blocks"), "k").withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota")))
    # Few rows, from windows over few rows: dealt out before each becomes its slots.
    spread = max(spark.sparkContext.defaultParallelism, math.ceil(n_slots / SLOTS_A_TASK))
    each = numbered.where("to > from").repartition(spread, "k", "shard").select("shard", "k", "blocks", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("j"))
    turn = F.floor(F.col("j") / F.col("blocks"))
    return each.select("shard", "k", permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("k"), turn).alias("block"))


def _taken_blocks(mix: Mix) -> DataFrame:
    """(k, start, block, words, times): the part of each taken block that a document holds."""
    times = mix.slots.groupBy("k", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    pieces = mix.placed.select("k", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    words = F.least(end, (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    return pieces.withColumn("words", words).join(times, ["k", "block"]).select("k", "start", "block", "words", "times")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    mix = plan(docs)
    words = _taken_blocks(mix).groupBy("k", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    placed = mix.placed.join(words, ["k", "start"], "left")
    nothing = mix.rows.where("size = 0").select("doc_id", "k", "size", F.lit(None).cast("long").alias("taken"))
    every = placed.select("doc_id", "k", "size", "taken").unionByName(nothing)
    return every.join(mix.sources.select("k", "source_size", "target"), "k").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for the words of a document taken once or more, one more for those taken twice.

    A whole text stays as it is; of a text taken in part the words taken are joined by blanks.
    """
    mix = plan(docs)
    times = F.sort_array(F.collect_list(F.struct("block", "words", "times")))
    parts = _taken_blocks(mix).groupBy("k", "start").agg(times.alias("parts")).join(mix.placed, ["k", "start"])
    parts = parts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "size", "parts")).alias("own"))
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "own")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row.alias("_row")).withColumn("_id", F.col("_doc.doc_id"))
    texts = texts.groupBy("_id", "_row").agg(F.first("_doc").alias("_doc"))
    joined = texts.join(parts, (texts["_row"] == parts["_row"]) & texts["_id"].eqNullSafe(parts["_id"])).select("_doc", F.explode("own").alias("o"))
    copy = joined.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("kept", F.filter("o.parts", lambda p: p["times"] >= F.col("turn"))).where("size(kept) > 0")
    copy = copy.withColumn("n", F.aggregate("kept", F.lit(0).cast("long"), lambda s, p: s + p["words"]))
    part = bind(
        words_of(F.col("_doc.text")),
        lambda w: F.flatten(F.transform("kept", lambda p: F.slice(w, (F.greatest(F.lit(0), p["block"] * BLOCK - F.col("o.start")) + 1).cast("int"), p["words"].cast("int")))),
    )
    text = F.when(F.col("n") == F.col("o.size"), F.col("_doc.text")).otherwise(F.array_join(part, " "))
    out = copy.withColumn("_text", text)
    special = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[special.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
