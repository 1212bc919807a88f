"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, floor(1024 x). Pivots (a bounded sample of rows, by hash)
divide data and queries into cells; a cell's summary is its size, its radius around
the pivot and its largest norm. Queries are grouped by cells, neighbouring cells
together up to ``GROUP`` queries, and a cell of more in turns.

A query's exact scores with the pivots give a score that its k best certainly
reach. As every x of a cell with pivot p obeys ``q.x <= q.p + |q| |x - p|`` and
``q.x <= |q| |x|``, that score bounds from below how far from p, and how long, an x
must be to matter to q; the least of these over a group's queries are the group's
bounds for the cell. Vectors are copied only to the groups whose bounds they pass.
A group's vectors are dealt by hash into slabs of bounded size, so a cell of very
many or equal vectors is no task's alone; each slab meets the group's queries in
one matrix product and sends on at most k rows a query, none below the score its
pivots gave it; a window picks the final k. Where vectors have no clusters (say,
random directions) the bounds keep everything, and each group reads every vector
once.

Scores are exact: products run in float64 while no sum can pass 2**53, in Python
integers otherwise; a score beyond 64 bits is given as the nearest long.

Defined results: vectors that are null, or hold null or non-finite components,
and null ids take no part; an empty vector has score 0 with all; shorter vectors
are padded with zeros; a query's own row is no candidate, another row of the same
id is; ties go to the smaller vec_id; with fewer than k candidates all are given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

SCALE = 1024
MOST_PIVOTS = 256
#: Queries of a group, bytes of a slab; slabs a group at least, where a slab has LEAST_SLAB vectors.
GROUP, SLAB_BYTES, SLABS, LEAST_SLAB = 4096, 1 << 25, 8, 256
#: Scores a task holds at a time.
MOST_SCORES = 1 << 22
_LONG = (-(1 << 63), (1 << 63) - 1)


def integers(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): usable rows, ``v`` the scaled integers as float64 (which holds them exactly)."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, x in enumerate(batch.column(2)):
                x = x.values
                if x is not None and batch.column(1)[i].is_valid and not x.null_count:
                    with np.errstate(over="ignore", invalid="ignore"):
                        v = np.floor(SCALE * x.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(v).all():
                        keep.append(i)
                        out.append(v.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["row", "vec_id", "v"])

    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.mapInArrow(scale, "row long, vec_id long, v binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        v = np.frombuffer(v.as_buffer(), np.float64)
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(x) for x in r] for r in m]
    rows, columns = whole(a), whole(b)
    return np.array([[min(max(sum(x * y for x, y in zip(r, c, strict=True)), _LONG[0]), _LONG[1]) for c in columns] for r in rows], np.int64).reshape(len(rows), len(columns))


def _in_cells(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        for batch in batches:
            x = _matrix(batch.column(2), size)
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.nan_to_num((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), nan=np.inf)
                cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
                distance = np.sqrt(((x - p[cell]) ** 2).sum(1))
                norm = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(distance), pa.array(norm)], names=["row", "vec_id", "v", "cell", "distance", "norm"])

    return vectors.mapInArrow(assign, "row long, vec_id long, v binary, cell long, distance double, norm double")


def _grouped(pivots: np.ndarray, cells: np.ndarray, n_queries: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """Group of each cell with queries, and turns of each group. Cells stand along the pivots' first axis."""
    centred = pivots - pivots.mean(0)
    with np.errstate(over="ignore", invalid="ignore"):
        axis = np.linalg.svd(np.nan_to_num(centred / max(float(np.abs(centred).max(initial=0)), 1.0)), full_matrices=False)[2][0]
    group_of, turns, held = {}, {}, 0
    for i in np.argsort(pivots[cells] @ axis, kind="stable").tolist():
        if not n_queries[i]:
            continue
        if not turns or held + n_queries[i] > GROUP:
            turns[len(turns)], held = 1, 0
        held += int(n_queries[i])
        group_of[int(cells[i])] = len(turns) - 1
        turns[len(turns) - 1] = -(-held // GROUP)
    return group_of, turns


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (of ``vec_id``) holds, against all rows."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = materialise(integers(embeddings), "vectors")
    n, n_queries, size = vectors.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.length("v") / 8), F.lit(0)).cast("int")).first()
    size = max(1, size)
    # TopK: MOST_PIVOTS rows reach the driver.
    drawn = vectors.orderBy(F.xxhash64("vec_id", "row"), "row").limit(min(MOST_PIVOTS, math.isqrt(n) + 1)).select("row", "v").toArrow()
    sample = _matrix(drawn.column("v").combine_chunks(), size) if n else np.zeros((0, size))
    sample_rows, pivots = drawn.column("row").to_numpy(), np.unique(sample, axis=0) if n else np.zeros((1, size))
    placed = materialise(_in_cells(vectors, pivots, size), "cells")
    summary = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.count_if(is_query).alias("asked")).toArrow().to_pydict()
    cells = np.array(summary["cell"], np.int64)
    radius, norms = np.array(summary["radius"], float), np.array(summary["norm"], float)
    group_of, turns = _grouped(pivots, cells, np.array(summary["asked"], np.int64))
    slabs = max(1, math.ceil(n * size * 8 / SLAB_BYTES), min(SLABS, n // LEAST_SLAB))
    shipped = spark.sparkContext.broadcast((pivots, sample, sample_rows, cells, radius, norms, group_of, turns))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries with their group, turn and certain score; and rows (group, cell, far, long) of a batch's bounds."""
        pivots, sample, sample_rows, cells, radius, norms, group_of, turns = shipped.value
        for batch in batches:
            q, rows = _matrix(batch.column(2), size), batch.column(0).to_numpy()
            group = np.array([group_of[c] for c in batch.column(3).to_pylist()], np.int64)
            turn = rows % np.array([turns[g] for g in group.tolist()], np.int64)
            scores = _products(q, sample).astype(float)
            scores[rows[:, None] == sample_rows] = -np.inf
            least = -np.sort(-scores, axis=1)[:, k - 1] if len(sample) >= k else np.full(len(q), -np.inf)
            sure = np.where(np.isfinite(least), least - np.abs(least) * 1e-9 - 1, _LONG[0] * 2.0)
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (group, turn)], batch.column(0), batch.column(1), batch.column(2), pa.array(sure), pa.nulls(len(q), pa.int64()), *[pa.nulls(len(q), pa.float64())] * 2], schema=bounds)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                length, middle = np.sqrt((q * q).sum(1))[:, None], q @ pivots[cells].T
                slack = 1 + 1e-9 * length * (norms + radius)
                far = np.where(length > 0, (least[:, None] - middle - slack) / length, -np.inf)
                long = np.where(length > 0, (least[:, None] - slack) / length, -np.inf)
                far, long = (np.where(np.isnan(x), -np.inf, x) for x in (far, long))
                needed = ~((far > radius) | (long > norms))
            for g in np.unique(group).tolist():
                own = needed & (group == g)[:, None]
                at = np.flatnonzero(own.any(0))
                least_far, least_long = (np.where(own, x, np.inf).min(0)[at] for x in (far, long))
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g)), *[pa.nulls(m, t) for t in bounds.types[1:6]], pa.array(cells[at]), pa.array(least_far), pa.array(least_long)], schema=bounds)

    bounds = pa.schema([("grp", pa.int64()), ("turn", pa.int64()), ("row", pa.int64()), ("query_id", pa.int64()), ("v", pa.binary()), ("sure", pa.float64()), ("cell", pa.int64()), ("far", pa.float64()), ("long", pa.float64())])
    asked = placed.where(is_query).select("row", "vec_id", "v", "cell").mapInArrow(bound, "grp long, turn long, row long, query_id long, v binary, sure double, cell long, far double, long double")
    asked = materialise(asked, "asked")
    # At most cells x groups of cells, both within MOST_PIVOTS.
    needs = F.broadcast(asked.where("cell is not null").groupBy("grp", "cell").agg(F.min("far").alias("far"), F.min("long").alias("long")))
    n_turns = F.broadcast(spark.createDataFrame(list(turns.items()), "grp long, turns long"))
    part = F.pmod(F.xxhash64("row"), F.lit(slabs))
    data = placed.join(needs, "cell").where("not (distance < far) and not (norm < long)").join(n_turns, "grp")
    data = data.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), part.alias("part"), "row", "vec_id", "v")
    queries = asked.where("row is not null").select(F.col("grp").alias("q_grp"), F.col("turn").alias("q_turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("q_part"), "row", "query_id", "v", "sure")

    def solve(x: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(x) and len(q):
            ids, rows, m = x.column("vec_id").to_numpy(), x.column("row").to_numpy(), _matrix(x.column("v").combine_chunks(), size)
            step = max(1, MOST_SCORES // len(x))
            for a in range(0, len(q), step):
                some = q.slice(a, step)
                scores = _products(_matrix(some.column("v").combine_chunks(), size), m)
                for s, row, query, sure in zip(scores, some.column("row").to_pylist(), some.column("query_id").to_pylist(), some.column("sure").to_pylist(), strict=True):
                    other = np.flatnonzero((rows != row) & (s >= sure))
                    if len(other) > k:
                        cut = np.partition(s[other], len(other) - k)[len(other) - k]
                        other = other[s[other] >= cut]
                    best = other[np.lexsort((ids[other], -s[other].astype(object) if s[other].min(initial=0) == _LONG[0] else -s[other]))][:k]
                    for column, values in zip(out, (np.full(len(best), row), np.full(len(best), query), ids[best], s[best]), strict=True):
                        column.append(values)
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), arrays, strict=True)))

    found = data.groupBy("grp", "turn", "part").cogroup(queries.groupBy("q_grp", "q_turn", "q_part")).applyInArrow(solve, "row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)
select q.vec_id as query_id,
       (row_number() over (partition by q.vec_id order by list_inner_product(q.e, x.e) desc, x.vec_id))::int as rank,
       x.vec_id, list_inner_product(q.e, x.e)::bigint as score
from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0
qualify rank <= 10
"""
