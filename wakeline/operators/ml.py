"""Feature transforms and clustering.

Column-wise transforms run distributed. Clustering diagnostics and imputation need
pairwise distances of all rows: the key and features of every row (``whole``) are
sent to the workers, and each computes distances of blocks of rows to all rows, of
``BLOCK`` cells at most. Work grows with the square of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4_000_000
#: Spark jobs that run side by side.
JOBS = 8


def ordinal(value: Column, names: list[str], start: int) -> Column:
    return F.coalesce(*[F.when(F.trim(value) == n, float(i)) for i, n in enumerate(names, start)])


def yes_no(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "y", "true", "1"), 1.0).when(v.isin("no", "n", "false", "0"), 0.0)


def _long(df: DataFrame, entries: list[tuple[str, Column]], names: tuple[str, str] = ("feature", "value")) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias(names[0]), c.alias(names[1])) for n, c in entries])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair, complete pairs only, to three places; one pass."""
    pairs = [(x, y) for x in columns for y in columns]
    row = df.agg(*[F.round(F.corr(x, y), 3).alias(f"{x}|{y}") for x, y in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("corr")) for x, y in pairs])).alias("c")).select("c.*")


def centred_log_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zeros become 0.01, rows are closed to 1, logs are centred."""
    x = [F.when(F.col(c) == 0, 0.01).otherwise(F.col(c)) for c in columns]
    total = sum(x[1:], x[0])
    logs = [F.log(v / total) for v in x]
    mean = sum(logs[1:], logs[0]) / len(logs)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[F.round(v - mean, 6).alias(c) for v, c in zip(logs, columns, strict=True)])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quartiles; an IQR of 0 counts as 1."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}") for c in columns])
    iqr = lambda c: F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]
    scaled = [F.round((F.col(c) - F.col(f"q_{c}")[1]) / F.when(iqr(c) == 0, 1.0).otherwise(iqr(c)), 6).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(q)).select(*[c for c in df.columns if c not in columns], *scaled)


def group_means(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, feature, mean, overall, delta): group means, null skipped, against the whole."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])
    overall = df.agg(*[F.avg(c).alias(f"all_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"), F.col(f"all_{c}").alias("overall")) for c in columns])
    out = means.crossJoin(F.broadcast(overall)).select(group, F.explode(cells).alias("c")).select(group, "c.*")
    return out.select(group, "feature", F.round("mean", 6).alias("mean"), F.round("overall", 6).alias("overall"), F.round(F.col("mean") - F.col("overall"), 6).alias("delta"))


def cluster_names(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, feature, direction): the feature whose mean z-score deviates most in each cluster."""
    scale = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns]).crossJoin(F.broadcast(scale))
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns}
    cells = F.array(*[F.struct(F.round(F.abs(z[c]), 6).alias("size"), F.lit(-i).alias("order"), F.lit(c).alias("feature"), (z[c] > 0).alias("up")) for i, c in enumerate(columns)])
    return means.select(group, F.array_max(cells).alias("b")).select(group, F.col("b.feature").alias("feature"), F.when(F.col("b.up"), "High").otherwise("Low").alias("direction"))


def matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df).select(key, "features")


def kmeans(x: DataFrame, k: int, tries: int = 20, seed: int = 42) -> DataFrame:
    """Labels of the best of several k-means++ starts by inertia."""
    fit = lambda i: KMeans(k=k, seed=seed + i, initMode="k-means||").fit(x)
    with ThreadPoolExecutor(JOBS) as pool:
        models = list(pool.map(fit, range(tries)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).withColumnRenamed("prediction", "cluster").drop("features")


def pca(x: DataFrame, least_variance: float) -> DataFrame:
    """(key, coords, n_components): the fewest components that reach the variance share."""
    size = len(x.first()["features"])
    model = PCA(k=size, inputCol="features", outputCol="coords").fit(x)
    kept = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), least_variance - 1e-12)) + 1
    key = x.columns[0]
    return model.transform(x).select(key, F.slice(vector_to_array("coords"), 1, kept).alias("coords"), F.lit(kept).alias("n_components"))


def yeo_johnson_lambda(x: np.ndarray) -> float:
    """Maximum-likelihood power, by golden section on [-4, 4]."""

    def loss(p: float) -> float:
        y = yeo_johnson_values(x, p)
        return len(x) / 2 * math.log(max(float(y.var()), 1e-300)) - (p - 1) * float((np.sign(x) * np.log1p(np.abs(x))).sum())

    a, b, g = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def yeo_johnson_values(x: np.ndarray, p: float) -> np.ndarray:
    out, up = np.empty_like(x), x >= 0
    out[up] = np.log1p(x[up]) if abs(p) < 1e-9 else ((x[up] + 1) ** p - 1) / p
    out[~up] = -np.log1p(-x[~up]) if abs(p - 2) < 1e-9 else -((1 - x[~up]) ** (2 - p) - 1) / (2 - p)
    return out


def yeo_johnson_lambdas(df: DataFrame, columns: list[str], points: int = 33, passes: int = 11) -> list[float]:
    """Maximum-likelihood powers over all rows: in each pass, moments at ``points`` powers by partition, and then the neighbourhood of the best."""
    brackets = [(-4.0, 4.0)] * len(columns)
    for _ in range(passes):
        grids = [np.linspace(*x, points) for x in brackets]

        def moments(batches: Iterator[pd.DataFrame], grids=grids) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(grids), points, 4))
            for batch in batches:
                for c, grid in enumerate(grids):
                    x = batch.iloc[:, c].dropna().to_numpy(float)
                    if len(x):
                        logs = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                        for i, p in enumerate(grid):
                            y = yeo_johnson_values(x, p)
                            total[c, i] = _merged(total[c, i], np.array([len(x), y.mean(), ((y - y.mean()) ** 2).sum(), logs]))
            yield pd.DataFrame({"cells": [total.ravel().tolist()]})

        total = np.zeros((len(columns), points, 4))
        for r in df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(moments, "cells array<double>").toLocalIterator():
            part = np.array(r["cells"]).reshape(total.shape)
            for at in np.ndindex(total.shape[:2]):
                total[at] = _merged(total[at], part[at])
        for c, grid in enumerate(grids):
            n, _, squares, logs = total[c].T
            i = int((n / 2 * np.log(np.maximum(squares / np.maximum(n, 1), 1e-300)) - (grid - 1) * logs).argmin())
            brackets[c] = (float(grid[max(i - 1, 0)]), float(grid[min(i + 1, points - 1)]))
    return [(a + b) / 2 for a, b in brackets]


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, mean, squares about it, sum) of two sets together."""
    n, step = x[0] + y[0], y[1] - x[1]
    if not n:
        return x
    return np.array([n, x[1] + step * y[0] / n, x[2] + y[2] + step * step * x[0] * y[0] / n, x[3] + y[3]])


def yeo_johnson(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Powers fitted on all rows, applied as column expressions."""
    out = [F.col(key)]
    for c, p in zip(columns, yeo_johnson_lambdas(df, columns), strict=True):
        x = F.col(c)
        up = F.log1p(x) if abs(p) < 1e-9 else (F.pow(x + 1, F.lit(p)) - 1) / p
        down = -F.log1p(-x) if abs(p - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - p)) - 1) / (2 - p)
        out.append(F.when(x >= 0, up).otherwise(down).alias(c))
    return df.select(*out)


def whole(df: DataFrame, key: str, columns: list[str]) -> pd.DataFrame:
    """Every row, in key order."""
    return df.select(key, *columns).toArrow().to_pandas().sort_values(key, ignore_index=True)


def _blocks(n: int, width: int) -> list[tuple[int, int]]:
    """Ranges of n rows that have at most BLOCK cells with ``width`` others."""
    rows = max(1, BLOCK // max(width, 1))
    return [(a, min(a + rows, n)) for a in range(0, n, rows)]


def _by_block(spark: SparkSession | None, n: int, width: int, work: Callable, *shared) -> list:
    """work(begin, end, *shared) of every block, in order, on the workers where there is a session."""
    blocks = _blocks(n, width)
    if spark is None or len(blocks) < 2:
        return [work(a, b, *shared) for a, b in blocks]
    context = spark.sparkContext
    sent = context.broadcast(shared)
    return context.parallelize(blocks, min(len(blocks), 4 * context.defaultParallelism)).map(lambda c: work(*c, *sent.value)).collect()


def nearest(points: np.ndarray, x: np.ndarray, k: int, spark: SparkSession | None = None) -> np.ndarray:
    """The k-th smallest distance, from 0, of each point to the rows of x."""
    work = lambda a, b, points, x: np.partition(_distances(points[a:b], x), k, 1)[:, k]
    return np.concatenate(_by_block(spark, len(points), len(x), work, points, x))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def lloyd(x: np.ndarray, k: int, tries: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Best of several k-means++ starts: labels, centres, inertia."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(tries):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = _distances(x, centres).min(1) ** 2
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else 0]])
        for _ in range(100):
            labels = _distances(x, centres).argmin(1)
            moved = np.array([x[labels == i].mean(0) if (labels == i).any() else centres[i] for i in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        inertia = float((_distances(x, centres).min(1) ** 2).sum())
        if best is None or inertia < best[2]:
            best = (labels, centres, inertia)
    return best


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    own = np.unique(labels)
    return _silhouette(np.stack([d[:, labels == c].sum(1) for c in own], 1), labels)


def _silhouette(sums: np.ndarray, labels: np.ndarray) -> float:
    """From each row's sums of distances to the clusters, in the order of their labels."""
    own = np.unique(labels)
    if len(own) < 2:
        return 0.0
    sizes = np.array([(labels == c).sum() for c in own])
    at = np.searchsorted(own, labels)
    a = sums[np.arange(len(sums)), at] / np.maximum(sizes[at] - 1, 1)
    other = sums / sizes
    other[np.arange(len(sums)), at] = np.inf
    b = other.min(1)
    s = np.where(sizes[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def _cluster_sums(x: np.ndarray, labels: list[np.ndarray], spark: SparkSession) -> list[np.ndarray]:
    """For each labelling, each row's sums of distances to the clusters."""
    flags = [(v[:, None] == np.unique(v)).astype(float) for v in labels]
    cuts = np.cumsum([f.shape[1] for f in flags])[:-1]
    work = lambda a, b, x, flags: _distances(x[a:b], x) @ flags
    return np.split(np.vstack(_by_block(spark, len(x), len(x), work, x, np.hstack(flags))), cuts, axis=1)


def davies_bouldin(x: np.ndarray, labels: np.ndarray, centres: np.ndarray) -> float:
    s = np.array([np.linalg.norm(x[labels == i] - c, axis=1).mean() if (labels == i).any() else 0 for i, c in enumerate(centres)])
    d = _distances(centres, centres)
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s) / d).max(1).mean())


def gap(x: np.ndarray, k: int, inertia: float, references: int = 10, seed: int = 42) -> tuple[float, float]:
    rng = np.random.default_rng(seed)
    logs = np.log([lloyd(rng.uniform(x.min(0), x.max(0), x.shape), k, 2, seed)[2] for _ in range(references)])
    return float(logs.mean() - math.log(inertia)), float(logs.std() * math.sqrt(1 + 1 / references))


def select_k(s: pd.DataFrame, spark: SparkSession, ks: range = range(2, 9)) -> DataFrame:
    """(k, wcss, silhouette, davies_bouldin, gap, chosen): majority of the three indices, silhouette on a tie."""
    x = s.iloc[:, 1:].to_numpy(float)
    context = spark.sparkContext
    sent = context.broadcast(x)

    def fit(k: int) -> tuple:
        labels, centres, inertia = lloyd(sent.value, k, 20)
        return labels, inertia, davies_bouldin(sent.value, labels, centres), *gap(sent.value, k, inertia, 10)

    fits = context.parallelize(ks, len(ks)).map(fit).collect()
    sums = _cluster_sums(x, [f[0] for f in fits], spark)
    rows = [(k, inertia, _silhouette(m, labels), davies, g, e) for k, (labels, inertia, davies, g, e), m in zip(ks, fits, sums, strict=True)]
    by_gap = next((rows[i][0] for i in range(len(rows) - 1) if rows[i][4] >= rows[i + 1][4] - rows[i + 1][5]), rows[-1][0])
    votes = [max(rows, key=lambda r: r[2])[0], min(rows, key=lambda r: r[3])[0], by_gap]
    chosen = max(votes, key=lambda v: (votes.count(v), v == votes[0]))
    return spark.createDataFrame([(*r[:5], r[0] == chosen) for r in rows], "k int, wcss double, silhouette double, davies_bouldin double, gap double, chosen boolean")


def knee(values: np.ndarray) -> int | None:
    """Position of the knee of a convex falling curve: the largest gap below its chord."""
    if len(values) < 3 or values[0] == values[-1]:
        return None
    x, y = np.linspace(0, 1, len(values)), (values - values.min()) / (values.max() - values.min())
    return int((1 - x - y).argmax())


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    near = _distances(x, x) <= eps
    core = near.sum(1) >= least
    labels, found = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] < 0 and core[i]:
            todo = [i]
            labels[i] = found
            while todo:
                j = todo.pop()
                if core[j]:
                    new = np.flatnonzero(near[j] & (labels < 0))
                    labels[new] = found
                    todo += new.tolist()
            found += 1
    return labels


def dbscan_blocks(x: np.ndarray, eps: float, least: int, spark: SparkSession | None = None) -> np.ndarray:
    """Labels as ``dbscan`` gives, without all distances at once."""
    n = len(x)
    count = lambda a, b, x: (_distances(x[a:b], x) <= eps).sum(1)
    core = np.concatenate(_by_block(spark, n, n, count, x)) >= least
    at = np.flatnonzero(core)
    labels, found = np.full(n, -1), 0
    while len(at):
        edge, at = at[:1], at[1:]
        while len(edge):
            labels[edge] = found
            met = np.zeros(len(at), bool)
            for a, b in _blocks(len(edge), len(at)):
                open_ = np.flatnonzero(~met)
                met[open_] = (_distances(x[edge[a:b]], x[at[open_]]) <= eps).any(0)
            edge, at = at[met], at[~met]
        found += 1
    rest, inner = np.flatnonzero(~core), np.flatnonzero(core)
    if len(rest) and len(inner):
        first = lambda a, b, rest, x, own: np.where(_distances(rest[a:b], x) <= eps, own, found).min(1)
        border = np.concatenate(_by_block(spark, len(rest), len(inner), first, x[rest], x[inner], labels[inner]))
        labels[rest] = np.where(border == found, -1, border)
    return labels


def dbscan_frame(s: pd.DataFrame, spark: SparkSession) -> DataFrame:
    """(key, cluster, eps): eps at the knee of the sorted distances to the (D+1)th neighbour, else their median."""
    x = s.iloc[:, 1:].to_numpy(float)
    least = x.shape[1] + 1
    far = np.sort(nearest(x, x, min(least, len(x) - 1), spark))[::-1]
    at = knee(far)
    eps = float(far[at] if at is not None else np.median(far))
    return spark.createDataFrame([(int(k), int(c), eps) for k, c in zip(s.iloc[:, 0], dbscan_blocks(x, eps, least, spark), strict=True)], f"{s.columns[0]} long, cluster int, eps double")


def hopkins_statistic(x: np.ndarray, seed: int = 42, spark: SparkSession | None = None) -> float:
    rng = np.random.default_rng(seed)
    m = max(1, len(x) // 10)
    if len(x) < 3:
        return 0.5
    u = nearest(rng.uniform(x.min(0), x.max(0), (m, x.shape[1])), x, 0, spark).sum()
    w = nearest(x[rng.choice(len(x), m, replace=False)], x, 1, spark).sum()
    return float(u / (u + w)) if u + w else 0.5


def hopkins_frame(s: pd.DataFrame, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(hopkins_statistic(s.iloc[:, 1:].to_numpy(float), spark=spark),)], "hopkins double")


def knn_impute(x: np.ndarray, k: int = 5, spark: SparkSession | None = None) -> np.ndarray:
    """Distance-weighted mean of the k nearest rows that have the value; exact matches take all."""
    scale = np.nanpercentile(x, 75, 0) - np.nanpercentile(x, 25, 0)
    z = (x - np.nanmedian(x, 0)) / np.where(scale == 0, 1, scale)
    holes, out = np.flatnonzero(np.isnan(x).any(1)), x.copy()
    if len(holes):
        work = lambda a, b, holes, x, z: _imputed(holes[a:b], x, z, k)
        out[holes] = np.vstack(_by_block(spark, len(holes), len(x), work, holes, x, z))
    return out


def _imputed(rows: np.ndarray, x: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
    there, filled, out = ~np.isnan(z), np.nan_to_num(z), x[rows]
    own, f = there[rows], filled[rows]
    shared = own.astype(float) @ there.T.astype(float)
    sq = (f**2) @ there.T + own @ (filled**2).T - 2 * f @ filled.T
    d = np.sqrt(np.where(shared > 0, np.maximum(sq, 0) * x.shape[1] / np.maximum(shared, 1), np.inf))
    for i, j in zip(*np.nonzero(~own), strict=True):
        donors = np.flatnonzero(there[:, j] & np.isfinite(d[i]))
        if not len(donors):
            out[i, j] = np.nanmean(x[:, j])
            continue
        far = d[i, donors]
        if len(donors) > k:
            donors = donors[far <= np.partition(far, k - 1)[k - 1]]
        near = donors[np.argsort(d[i, donors], kind="stable")[:k]]
        w = (d[i, near] == 0).astype(float) if (d[i, near] == 0).any() else 1 / d[i, near]
        out[i, j] = (x[near, j] * w).sum() / w.sum()
    return out


def knn_impute_frame(s: pd.DataFrame, spark: SparkSession) -> DataFrame:
    out = s.copy()
    out.iloc[:, 1:] = knn_impute(s.iloc[:, 1:].to_numpy(float), spark=spark)
    return spark.createDataFrame(out)
