"""Profiles of ports: per profile a transform, components, clusters and what density clustering says of them.

The matrix has one row a port, so a profile is fitted in one task from the rows of
its columns; profiles run side by side. The number of ports is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import ml

# Each profile's features and power transform.
PROFILES = {
    "fleet_mix": (["pct_cargo", "pct_tanker", "pct_passenger", "pct_fishing", "pct_hsc", "pct_sailing", "pct_tug", "pct_dredging", "pct_towing", "pct_pilot", "pct_sar", "pct_other"], "clr"),
    "operations": (["median_stay_h", "iqr_stay_h", "pct_short_stay", "pct_long_stay", "repeat_visitor_ratio", "avg_visits_per_vessel"], "yeo_johnson"),
    "scale": (["mean_length_m", "median_length_m", "mean_draught_m", "median_draught_m"], "yeo_johnson"),
    "infrastructure": (["harbor_size_int", "shelter_afforded_int", "channel_depth_m", "anchorage_depth_m", "cargo_pier_depth_m"], None),
    "temporal": (["night_visit_ratio", "weekend_visit_ratio", "peak_hour_entropy", "seasonal_cv"], "yeo_johnson"),
    "connectivity": (["destination_diversity", "intra_country_ratio", "total_visits", "unique_vessels", "visits_per_week"], "yeo_johnson"),
}
LEAST_VARIANCE = 0.85
MOST_PORTS = 20_000
KS = range(2, 9)


def steps(profile: str) -> tuple[list[str], str | None]:
    """Features and transform of a profile; an unknown one is an error."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; there are {sorted(PROFILES)}")
    return PROFILES[profile]


def prepared(x: np.ndarray, transform: str | None) -> np.ndarray:
    """Imputed, transformed and robustly scaled columns; a column without any value is 0."""
    x = ml.knn_impute(np.where(np.isnan(x).all(0), 0.0, x))
    if transform == "clr":
        x = np.where(x == 0, 0.01, x)
        logs = np.log(x / x.sum(1, keepdims=True))
        x = logs - logs.mean(1, keepdims=True)
    elif transform == "yeo_johnson":
        x = np.stack([ml.yeo_johnson_values(c, ml.yeo_johnson_lambda(c)) if c.std() else c for c in x.T], 1)
    low, middle, high = np.percentile(x, [25, 50, 75], axis=0)
    return (x - middle) / np.where(high == low, 1, high - low)


def components(x: np.ndarray, least_variance: float | None = None, n: int | None = None) -> np.ndarray:
    """Principal coordinates: the fewest that reach a share of the variance, or ``n``; each axis points to its largest weight."""
    centred = x - x.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    if n is None:
        shares = np.cumsum(s**2) / max(float((s**2).sum()), 1e-300)
        n = int(np.searchsorted(shares, least_variance - 1e-12)) + 1
    return centred @ axes[:n].T


def choose_k(x: np.ndarray, seed: int = 42) -> tuple[int, np.ndarray, float, float]:
    """k, labels, silhouette and Davies-Bouldin of the majority of three indices; silhouette decides a three-way tie."""
    d, rows = ml._distances(x, x), []
    for k in KS:
        if k >= len(x):
            break
        labels, centres, inertia = ml.lloyd(x, k, 20, seed)
        rows.append((k, labels, ml.silhouette(d, labels), ml.davies_bouldin(x, labels, centres), *ml.gap(x, k, max(inertia, 1e-300), 10, seed)))
    by_gap = next((a for a, b in zip(rows, rows[1:], strict=False) if a[4] >= b[4] - b[5]), rows[-1])
    votes = [max(rows, key=lambda r: r[2])[0], min(rows, key=lambda r: r[3])[0], by_gap[0]]
    k = max(votes, key=lambda v: (votes.count(v), v == votes[0]))
    return next(r[:4] for r in rows if r[0] == k)


def profiled(rows: pd.DataFrame, profile: str) -> pd.DataFrame:
    """One row a port: cluster, density cluster (-1: noise), forced, three coordinates, and the profile's figures."""
    columns, transform = steps(profile)
    x = prepared(rows[columns].to_numpy(float), transform)
    out = pd.DataFrame({"profile": profile, "un_locode": rows.un_locode, "n_components": 0, "k": 1, "cluster": 0, "density_cluster": -1})
    coords, k, sil, dbi, hopkins = np.zeros((len(x), 0)), 1, 0.0, 0.0, 0.5
    if len(x) > 2:
        coords = components(x, LEAST_VARIANCE)
        k, labels, sil, dbi = choose_k(coords)
        hopkins = ml.hopkins_statistic(x)
        least = coords.shape[1] + 1
        far = np.sort(ml.nearest(coords, coords, min(least, len(x) - 1)))[::-1]
        at = ml.knee(far)
        out["cluster"], out["density_cluster"] = labels, ml.dbscan_blocks(coords, float(far[at] if at is not None else np.median(far)), least)
        out["n_components"], out["k"] = coords.shape[1], k
    three = components(x, n=3) if len(x) > 1 else np.zeros((len(x), 0))
    for i, c in enumerate("xyz"):
        out[c] = three[:, i] if three.shape[1] > i else 0.0
    out["forced"] = (out.density_cluster == -1) & (out.cluster >= 0)
    out["silhouette"], out["davies_bouldin"], out["hopkins"] = sil, dbi if math.isfinite(dbi) else 0.0, hopkins
    return out


PROFILE_DDL = "profile string, un_locode string, n_components int, k int, cluster int, density_cluster int, x double, y double, z double, forced boolean, silhouette double, davies_bouldin double, hopkins double"


def port_profiles(matrix: DataFrame) -> DataFrame:
    """All six profiles of a port matrix, a row for each profile and port; columns that the matrix lacks count as missing values."""
    names = sorted({c for columns, _ in PROFILES.values() for c in columns})
    rows = matrix.select("un_locode", *[(F.col(c) if c in matrix.columns else F.lit(None)).cast("double").alias(c) for c in names])
    if rows.limit(MOST_PORTS + 1).count() > MOST_PORTS:
        raise ValueError(f"more than {MOST_PORTS} ports")
    each = rows.withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES))))
    run = lambda key, pdf: profiled(pdf.sort_values("un_locode", ignore_index=True), key[0])
    return each.groupBy("profile").applyInPandas(run, PROFILE_DDL)


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Per profile: k, density clusters, noise, its share and the assignments that k-means forces on it."""
    noise = F.count_if(F.col("density_cluster") == -1)
    clusters = F.count_distinct(F.when(F.col("density_cluster") >= 0, F.col("density_cluster")))
    figures = [F.round(F.first(c), n).alias(c) for c, n in (("silhouette", 3), ("davies_bouldin", 3), ("hopkins", 4))]
    return profiles.groupBy("profile").agg(F.first("k").alias("k"), F.first("n_components").alias("n_components"), clusters.alias("density_clusters"), noise.alias("noise"), noise_percent(noise, F.count("*")).alias("noise_pct"), F.count_if("forced").alias("forced"), *figures)


def noise_percent(noise, total):
    return F.round(F.coalesce(noise * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), 1)
