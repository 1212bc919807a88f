"""Line dedup: three-line windows that repeat anywhere in the corpus keep their first occurrence only.

A window is three consecutive lines that hold a word (blank lines between them
are skipped). Windows are hashed to 128 bits; the first occurrence of a hash, by
document and position, stays, and every later one is removed: its lines, and
blank lines between them. Overlapping and touching removed windows are merged
into runs before the text is cut, so a repeated passage goes as a whole. Each
removed line still stands in the earlier document its window was first found in.

Work by plan: one grouped minimum over window hashes with map-side combine; one
equi-join of the windows with the repeated hashes, which Spark splits where a
hash is hot, as the repeated side has one row a hash; one join of the removed
positions, grouped by document, with the texts.

Defined results: null texts stay null; texts under three worded lines are left;
rows that repeat both doc_id and text count as one document and are cut alike;
rows with one doc_id and other texts are cut apart; a text may become empty.
Columns besides ``doc_id`` and ``text`` pass through, ``n_chars`` is recounted
where present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, bind

LINES = 3


def _worded(line: Column) -> Column:
    return F.length(F.translate(line, SEPARATORS, "")) > 0


def _positions(lines: Column) -> Column:
    """0-based positions of the lines that hold a word."""
    return F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: _worded(s["x"])), lambda s: s["i"])


def windows(docs: DataFrame) -> DataFrame:
    """(doc, h1, h2, w, a, b): each window's hashes, number, first and last line position."""
    t = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("doc"), F.split("text", "\n", -1).alias("_lines")).where("_lines is not null")
    t = t.withColumn("_at", _positions(F.col("_lines"))).where(F.size("_at") >= LINES)
    line = lambda k: F.get(F.col("_lines"), F.get(F.col("_at"), k))
    each = F.transform(
        F.sequence(F.lit(0), F.size("_at") - LINES),
        lambda k: F.struct(
            k.alias("w"),
            F.xxhash64(*[line(k + j) for j in range(LINES)]).alias("h1"),
            F.xxhash64(F.lit(1), *[line(k + j) for j in range(LINES)]).alias("h2"),
            F.get(F.col("_at"), k).alias("a"),
            F.get(F.col("_at"), k + LINES - 1).alias("b"),
        ),
    )
    return t.select("doc", F.inline(each)).select("doc", "h1", "h2", "w", "a", "b")


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc, n_windows, runs): merged runs of line positions that later occurrences cover."""
    found = windows(docs)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "w")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(F.struct("doc", "w") != F.col("first"))
    spans = later.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    s = F.col("spans")
    opens = lambda r, x, i: F.coalesce(x["a"] > F.get(r, i - 1)["b"], F.lit(True))
    closes = lambda r, x, i: F.coalesce(F.get(r, i + 1)["a"] > x["b"], F.lit(True))
    starts = bind(s, lambda r: F.transform(F.filter(r, lambda x, i: opens(r, x, i)), lambda x: x["a"]))
    ends = bind(s, lambda r: F.transform(F.filter(r, lambda x, i: closes(r, x, i)), lambda x: x["b"]))
    return spans.select("doc", F.size("spans").alias("n_windows"), F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("runs"))


def _cut(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again."""
    start = lambda r, i: F.coalesce(F.get(r, i - 1)["b"] + 1, F.lit(0))
    end = lambda r, i: F.coalesce(F.get(r, i)["a"], F.size(lines))
    kept = bind(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: F.slice(lines, start(r, i) + 1, end(r, i) - start(r, i)))))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences cut from ``text``, and ``n_removed`` lines and ``removed`` runs beside it."""
    names = [c for c in docs.columns if c not in ("n_removed", "removed", "_doc")]
    runs = removed_runs(docs).select(F.col("doc").alias("_doc"), "runs")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t")).alias("_key"))
    joined = keyed.join(runs, (F.col("_key.t") == F.col("_doc.t")) & F.col("_key.id").eqNullSafe(F.col("_doc.id")), "left")
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(_cut(F.split("text", "\n", -1), F.col("runs")))
    n = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"] + 1), F.lit(0).cast("long"))
    removed = F.coalesce(F.col("runs"), F.array().cast("array<struct<a:int,b:int>>"))
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in names], n.alias("n_removed"), removed.alias("removed"))


ORACLE_SQL = """
with line as (
  select doc_id, pos - 1 as pos, line from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
    from documents where text is not null)
), worded as (
  select doc_id, pos, line, row_number() over (partition by doc_id order by pos) - 1 as k
  from line where length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0
), win as (
  select doc_id, k, line as l1, lead(line) over d as l2, lead(line, 2) over d as l3, pos as a, lead(pos, 2) over d as b
  from worded window d as (partition by doc_id order by k)
), later as (
  select doc_id, a, b from win where b is not null
  qualify row_number() over (partition by l1, l2, l3 order by doc_id, k) > 1
), cut as (
  select distinct line.doc_id, line.pos from line join later on line.doc_id = later.doc_id and line.pos between later.a and later.b
), rest as (
  select line.doc_id, string_agg(line.line, chr(10) order by line.pos) as text
  from line left join cut on line.doc_id = cut.doc_id and line.pos = cut.pos where cut.pos is null group by 1
), gone as (select doc_id, count(*) as n from cut group by 1)
select d.doc_id, coalesce(gone.n, 0)::bigint as n_removed, case when d.text is null then null else coalesce(rest.text, '') end as text
from documents d left join rest on d.doc_id = rest.doc_id left join gone on d.doc_id = gone.doc_id
"""
