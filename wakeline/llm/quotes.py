"""Quotation linking: messages without their quotes, each under the message that it answers.

A line's quote level is the number of ``>`` at its begin (blanks between them are
allowed). Neighbouring quoted lines of one level are a passage. Passages, and their
lines of three words or more, are normalised (lower case, single blanks) and
hashed to 128 bits, and joined to the hashes of what messages say themselves: whole
bodies, paragraphs, lines. The original is the earliest message of the same
conversation before the quoting one, or else the earliest of any conversation. The
outermost linked passage that is from the conversation decides what a message
replies to; without one it is the turn before. Depth in the reply tree, counted by
pointer doubling, and then the turn order a conversation.

Both indexes have one row a key, made by grouped minima, so a passage that very
many messages share is combined map-side and met by a join that Spark can split;
no conversation is gathered in one task.

Defined results: a null text stays null and quotes nothing; attribution lines
("On ... wrote:") before a quote go with it; a message of quotes only has an empty
text; rows that repeat conv_id and turn share one place in the tree; null conv_id
or turn means no links and depth 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, discard, materialise

LEAST_WORDS = 3
PARTS = 32
SPAN = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:\s*>)+)", 1), r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _hashes(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _own_text(lines: Column) -> Column:
    """The lines outside quotes, without attribution lines right before a quote."""

    def said(all_lines: Column) -> Column:
        before_quote = lambda i: _level(F.coalesce(F.get(all_lines, i + 1), F.lit(""))) > 0
        return F.filter(all_lines, lambda x, i: (_level(x) == 0) & ~(x.rlike(r"(?i)^\s*on .+ wrote:\s*$") & before_quote(i)))

    return F.regexp_replace(F.array_join(bind(lines, said), "\n"), r"^\n+|\n+$", "")


def parse(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, own, quoted): own text, and (at, level, line) of the quoted lines."""
    lines = F.split("text", "\n", -1)
    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("at"), _level(x).alias("level"), F.regexp_replace(x, r"^(?:\s*>)+\s?", "").alias("line")))
    quoted = F.when(F.contains("text", F.lit(">")), F.filter(marked, lambda s: s["level"] > 0)).otherwise(F.array().cast("array<struct<at:int,level:int,line:string>>"))
    own = F.when(F.contains("text", F.lit(">")), _own_text(lines)).otherwise(F.col("text"))
    return rows.select("row", "conv_id", "turn", "role", own.alias("own"), F.coalesce(quoted, F.array().cast("array<struct<at:int,level:int,line:string>>")).alias("quoted"))


def passages(parsed: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, at, h): each quoted passage, whole and by line."""
    each = parsed.where("size(quoted) > 0 and conv_id is not null and turn is not null").select("row", "conv_id", "turn", F.inline("quoted"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("row", "level").orderBy("at"))
    runs = each.withColumn("run", run).groupBy("row", "conv_id", "turn", "level", "run").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    whole = _normal(F.array_join(F.transform("lines", lambda s: s["line"]), " "))
    parts = F.transform("lines", lambda s: _normal(s["line"]))
    units = F.array_distinct(F.concat(F.array(whole), F.filter(parts, lambda x: F.size(F.split(x, " ")) >= LEAST_WORDS)))
    out = runs.select("row", "conv_id", "turn", "level", F.col("first").alias("at"), F.explode(F.filter(units, lambda x: x != "")).alias("unit"))
    return out.withColumn("h", _hashes(F.col("unit"))).drop("unit")


def originals(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, h): what each message says itself."""
    whole = _normal(F.col("own"))
    paragraphs = F.transform(F.split("own", r"\n\s*\n"), _normal)
    lines = F.filter(F.transform(F.split("own", "\n"), _normal), lambda x: F.size(F.split(x, " ")) >= LEAST_WORDS)
    units = F.array_distinct(F.filter(F.concat(F.array(whole), paragraphs, lines), lambda x: x != ""))
    said = parsed.where("own is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units).alias("unit"))
    return said.withColumn("h", _hashes(F.col("unit"))).drop("unit")


def link(parsed: DataFrame) -> DataFrame:
    """(row, level, at, orig_conv, orig_turn): the original of each quoted passage that has one."""
    quoted, said = passages(parsed), materialise(originals(parsed), "said")
    inside = said.groupBy("conv_id", "h").agg(F.min("turn").alias("in_turn"))
    anywhere = said.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    met = quoted.join(inside, ["conv_id", "h"], "left").join(anywhere, "h", "left")
    near = F.when(F.col("in_turn") < F.col("turn"), F.struct(F.col("conv_id"), F.col("in_turn").alias("turn")))
    own = F.col("first.conv_id") == F.col("conv_id")
    # The earliest of the other conversations, where a conversation quotes what it is itself the first to say. In parts, so that a common passage is not one task's.
    asked = met.where(near.isNull() & own).select("h", F.col("conv_id").alias("own_conv")).distinct()
    part = F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)).cast("int")
    others = said.withColumn("part", part).join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["h", "part"]).where("conv_id <> own_conv")
    second = others.groupBy("h", "part").agg(F.min(F.struct("conv_id", "turn")).alias("s")).groupBy("h").agg(F.min("s").alias("second"))
    met = met.join(second, "h", "left")
    far = F.when(own, F.col("second")).otherwise(F.col("first"))
    found = met.withColumn("o", F.coalesce(near, far)).where("o is not null")
    best = F.min(F.struct((F.col("o.conv_id") != F.col("conv_id")).alias("other"), F.col("o.conv_id").alias("conv_id"), F.col("o.turn").alias("turn")))
    return found.groupBy("row", "level", "at").agg(best.alias("b")).select("row", "level", "at", F.col("b.conv_id").alias("orig_conv"), F.col("b.turn").alias("orig_turn"))


def _with_prior(placed: DataFrame) -> DataFrame:
    """``placed`` with the next smaller turn of its conversation: within spans of ``SPAN`` turns, then from the span before."""
    spanned = placed.withColumn("span", F.floor(F.col("turn") / SPAN))
    last = spanned.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    last = last.select("conv_id", "span", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")).alias("last"))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn"))
    return spanned.withColumn("inside", inside).join(last, ["conv_id", "span"]).withColumn("prior", F.coalesce("inside", "last")).drop("span", "inside", "last")


def _depths(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, depth) from (conv_id, turn, up), ``up`` being an earlier turn or null; by pointer doubling."""
    now = materialise(nodes.select("conv_id", "turn", F.col("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "depths")
    while not now.where("up is not null").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moving = now.where("up is not null").join(above, ["conv_id", "up"], "left")
        moved = moving.select("conv_id", "turn", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        past, now = now, materialise(now.where("up is null").unionByName(moved), "depths")
        discard(past)
    return now.drop("up")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, depth, reply_turn, n_quoted, n_linked, linked, text): sort by conv_id, depth, turn to read."""
    parsed = materialise(parse(messages), "messages")
    links = materialise(link(parsed), "links")
    per_row = links.groupBy("row").agg(F.count("*").alias("n_linked"), F.array_sort(F.collect_set(F.struct("orig_conv", "orig_turn"))).alias("linked"))
    own = links.join(parsed.select("row", "conv_id"), "row").where("orig_conv = conv_id").groupBy("row").agg(F.min(F.struct("level", "at", "orig_turn")).alias("first"))
    rows = parsed.join(own.select("row", F.col("first.orig_turn").alias("quoted_turn")), "row", "left").join(per_row, "row", "left")
    placed = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("quoted_turn").alias("quoted_turn"))
    nodes = _with_prior(placed).select("conv_id", "turn", F.coalesce("quoted_turn", "prior").alias("up"))
    nodes = materialise(nodes, "replies")
    tree = nodes.join(_depths(nodes), ["conv_id", "turn"])
    runs = F.size(F.filter(F.transform("quoted", lambda s, i: (i == 0) | (F.get(F.col("quoted"), i - 1)["at"] + 1 != s["at"]) | (F.get(F.col("quoted"), i - 1)["level"] != s["level"])), lambda x: x))
    out = rows.join(tree, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.col("up").alias("reply_turn"), runs.cast("int").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), F.coalesce("linked", F.array().cast("array<struct<orig_conv:long,orig_turn:long>>")).alias("linked"), F.col("own").alias("text"),
    )
