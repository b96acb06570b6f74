"""The engine against literal fixtures, plain Python geometry, and itself by other strategies and partition counts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmap.functions import scalars as S
from quillmap.operators import aggregates as A, evidence as E, geometry as G, joins as J, learned as L, models as M, raster as R, splits as P, validation as V, windows as W


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, px double, py double")


def ring(fid, corners, part=0, ring=0):
    return [(fid, part, ring, k, float(x), float(y)) for k, (x, y) in enumerate([*corners, corners[0]])]


VERTEX = "fid long, part_index int, ring_index int, vertex_index int, x double, y double"
SEGMENT = "fid long, ax double, ay double, bx double, by double"


# Geometry.


def square(x, y, half):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]


def test_boundary_rules(spark):
    v = spark.createDataFrame(ring(1, square(5, 5, 5)) + ring(1, square(5, 5, 1), ring=1) + ring(2, square(20, 5, 5)), VERTEX)
    p = points(spark, [(1, 2.0, 2.0), (2, 0.0, 5.0), (3, 5.0, 5.0), (4, 4.0, 5.0), (5, 10.0, 5.0), (6, 20.0, 5.0), (7, 50.0, 50.0), (8, 0.0, 0.0)])
    of = lambda rule: {(r["id"], r["fid"]) for r in G.point_in_polygon(p, v, rule, cell=7.0).collect()}
    assert of("within") == {(1, 1), (6, 2)}
    assert of("covers") == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 2), (8, 1)}
    assert of("parity") >= of("within") and of("parity") <= of("covers") and (2, 1) in of("parity") and (5, 1) not in of("parity")
    first = {r["id"]: r["fid"] for r in G.first_polygon(p, v).collect()}
    assert first[7] == -1 and first[1] == 1


def test_membership_counts_matches(spark):
    v = spark.createDataFrame(ring(1, square(0, 0, 5)) + ring(2, square(1, 0, 5)), VERTEX)
    zones = spark.createDataFrame([(1, "A"), (2, "X")], "fid long, zone string")
    got = {r["id"]: (r["fid"], r["zone"], r["matched"], r["matches"]) for r in G.membership(points(spark, [(1, 0.0, 0.0), (2, 30.0, 0.0)]), v, zones).collect()}
    assert got == {1: (1, "A", True, 2), 2: (None, None, False, 0)}


def plain_distance(px, py, ax, ay, bx, by):
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0 if n == 0 else max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n))
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def plain_nearest(ps, ss):
    out = {}
    for i, px, py in ps:
        each = {}
        for f, *s in ss:
            each[f] = min(each.get(f, math.inf), plain_distance(px, py, *s))
        m = min(each.values())
        tied = sorted(f for f, d in each.items() if d <= m + 1e-6)
        out[i] = (tied[0], round(each[tied[0]], 6), len(tied))
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_matches_brute_force(spark, strategy, seed):
    r = random.Random(seed)
    ps = [(i, float(r.randrange(-200, 200)), float(r.randrange(-200, 200))) for i in range(150)] + [(500, 5000.0, 0.0)]
    ss = []
    for f in range(60):
        x, y = r.randrange(-100, 100), r.randrange(-100, 100)
        for _ in range(r.randrange(1, 4)):
            ss.append((f, float(x), float(y), float(x := x + r.choice([0, 5, -7, 60])), float(y := y + r.choice([0, 3, -9]))))
    got = G.nearest(points(spark, ps), spark.createDataFrame(ss, SEGMENT), strategy)
    assert {x["id"]: (x["fid"], round(x["distance"], 6), x["ties"]) for x in got.collect()} == plain_nearest(ps, ss)


def test_nearest_ties_and_zero(spark):
    ss = spark.createDataFrame([(7, -1.0, -5.0, -1.0, 5.0), (3, 1.0, -5.0, 1.0, 5.0)], SEGMENT)
    p = points(spark, [(1, 0.0, 0.0), (2, 9.0, 0.0)])
    zero = spark.createDataFrame([(2, 9)], "id long, fid long")
    for strategy in ("broadcast", "grid"):
        got = {r["id"]: (r["fid"], r["distance"], r["ties"]) for r in G.nearest(p, ss, strategy, zero=zero).collect()}
        assert got == {1: (3, 1.0, 2), 2: (9, 0.0, 1)}
    assert G.nearest(p, ss.limit(0), "grid").count() == 0


def test_nearest_does_not_depend_on_partitions(spark):
    r = random.Random(4)
    ps = points(spark, [(i, r.random() * 90, r.random() * 90) for i in range(200)])
    ss = spark.createDataFrame([(f, *(r.random() * 100 for _ in range(4))) for f in range(80)], SEGMENT)
    one = sorted(map(tuple, G.nearest(ps.repartition(1), ss.repartition(1), "grid").collect()))
    assert one == sorted(map(tuple, G.nearest(ps.repartition(7), ss.repartition(5), "grid", cell=3.0).collect()))


def test_segments_split_and_area(spark):
    v = spark.createDataFrame(ring(1, [(0, 0), (6000, 0), (6000, 100), (0, 100)]) + ring(1, [(10, 10), (20, 10), (20, 20), (10, 20)], ring=1), VERTEX)
    s = W.segments(v)
    assert s.count() == 8
    pieces = G.split_segments(s, 25.0)
    assert pieces.where("ring_index = 0 and seg = 0").count() == 240
    assert pieces.agg(F.round(F.sum(S.segment_length(*map(F.col, ("ax", "ay", "bx", "by")))), 6)).first()[0] == 12240.0
    assert G.ring_area(v).first()["area"] == 599900.0
    assert G.split_segments(s, 0.0).count() == 8
    assert sorted(map(tuple, G.flatten(G.pack(v)).collect())) == sorted(map(tuple, v.collect()))


def test_hull_distance(spark):
    r = random.Random(2)
    rows = [(i, r.random(), r.random()) for i in range(300)] + [(1000, 0.0, 0.0), (1001, 1.0, 0.0), (1002, 1.0, 1.0), (1003, 0.0, 1.0)]
    got = {x["id"]: x["hull_distance"] for x in G.hull_distance(points(spark, rows)).collect()}
    for i, x, y in rows:
        assert got[i] == pytest.approx(min(x, y, 1 - x, 1 - y), abs=1e-9)


# Joins.


def test_one_to_one_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (2,)], "k long")
    assert J.one_to_one(a, b, "k").count() == 2
    for bad in ([(1,)], [(1,), (2,), (2,)], [(1,), (3,)]):
        with pytest.raises(J.RowsLost):
            J.one_to_one(a, spark.createDataFrame(bad, "k long"), "k")
    with pytest.raises(J.RowsLost):
        J.ids_present(a, [1, 9], "k")


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", None)], "k long, s string, d double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-9), (2, None, 3.0), (4, "q", 1.0)], "k long, s string, d double")
    s = J.agreement(J.compare(a, b, "k", ["s"], {"d": 1e-6})).first()
    assert (s["union_rows"], s["both_rows"], s["reference_only_rows"], s["candidate_only_rows"], s["agree_s"], s["agree_d"], s["full_agreement"]) == (4, 2, 1, 1, 2, 1, 1)


def test_knn_and_radius_pairs(spark):
    r = random.Random(3)
    rows = [(i, float(r.randrange(50)), float(r.randrange(50))) for i in range(120)] + [(900, 4000.0, 4000.0)]
    got = {}
    for x in J.knn(points(spark, rows), 4, 5.0).collect():
        got.setdefault(x["id"], []).append((round(x["distance"], 9), x["other"]))
    for i, x, y in rows:
        assert sorted(got[i]) == sorted((round(math.hypot(x - u, y - v), 9), j) for j, u, v in rows)[:4]
    pairs = {(x["a"], x["b"]) for x in J.radius_pairs(points(spark, rows), 6.0).collect()}
    assert pairs == {(i, j) for i, x, y in rows for j, u, v in rows if i < j and math.hypot(x - u, y - v) < 6}


def test_other_class_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 3.0, 0.0, "b"), (3, 1.0, 0.0, "a")], "id long, px double, py double, cls string")
    assert {r["id"]: r["distance"] for r in J.other_class_distance(df).collect()} == {1: 3.0, 2: 2.0, 3: 2.0}
    assert {r["distance"] for r in J.other_class_distance(df.where("cls = 'a'")).collect()} == {math.inf}


# Windows and scoring.


def test_percentiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 5.0), (4, 9.0)], "id long, v double")
    want = {1: 62.5, 2: 25.0, 3: 62.5, 4: 100.0}
    assert {r["id"]: r["p"] for r in df.withColumn("p", W.percentile_avg(F.col("v"))).collect()} == want
    for n in (1, 3):
        assert {r["id"]: r["p"] for r in W.with_percentile(df.repartition(n), "v", "p", scale=True).collect()} == want
    flat = df.withColumn("v", F.lit(3.0))
    assert {r["p"] for r in W.with_percentile(flat, "v", "p", scale=True).collect()} == {50.0}
    assert {r["p"] for r in flat.withColumn("p", W.percentile_avg(F.col("v"))).collect()} == {50.0}
    down = {r["id"]: r["p"] for r in W.with_percentile(df, "v", "p", higher=False, scale=True).collect()}
    assert down == {r["id"]: r["p"] for r in df.withColumn("p", W.percentile_avg(F.col("v"), higher=False)).collect()}


def test_global_ranks_by_parts_match_windows(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, float(r.randrange(60)) if r.random() < 0.7 else r.random()) for i in range(1000)], "id long, v double")
    for f, args in ((W.with_rank_average, ("v", "r")), (W.with_ordinal, ("v", "id", "r"))):
        a, b = ({x["id"]: x["r"] for x in f(df.repartition(5), *args, scale=s).collect()} for s in (True, False))
        assert a == b
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    assert W.quantiles(df, "v", qs, scale=True) == pytest.approx(W.quantiles(df, "v", qs, scale=False), abs=1e-12)
    assert W.quantiles(df.limit(0), "v", [0.5], scale=True) == W.quantiles(df.limit(0), "v", [0.5], scale=False) == [None]


def scoring(spark, **change):
    rows = [(i, True, z != "X", z, d, e, r) for i, z, d, e, r in (("A", "X", 1000.0, 200.0, 10.0), ("B", "AO", 500.0, 150.0, 5.0), ("C", "A", 250.0, 125.0, 0.0), ("D", "AE", 100.0, 100.0, -5.0), ("E", "VE", 0.0, 75.0, -10.0))]
    df = spark.createDataFrame(rows, "property_id string, matched boolean, is_sfha boolean, zone string, distance_m double, elevation_m double, relative_m double")
    return df.withColumns({k: F.when(F.col("property_id") == "C", F.lit(v)).otherwise(F.col(k)) for k, v in change.items()})


def test_exposure_index(spark):
    got = {r["property_id"]: r for r in E.exposure_index(scoring(spark)).collect()}
    assert [got[k]["exposure_percentile"] for k in "ABCDE"] == [20.0, 40.0, 60.0, 80.0, 100.0]
    assert got["E"]["exposure_index"] == 100.0 and got["A"]["exposure_index"] == pytest.approx(0.4 * 10 + 0.6 * 20)
    again = {r["property_id"]: r for r in E.exposure_index(scoring(spark).repartition(4), scale=True, validate=False).collect()}
    assert again == got
    trace = E.property_trace(E.exposure_index(scoring(spark)), E.exposure_index(scoring(spark)).drop("exposure_index"), "B").collect()
    assert len(trace) == 4 and all(r["adds_up"] for r in trace)


@pytest.mark.parametrize("change", [{"zone": "ZZ"}, {"distance_m": -1.0}, {"distance_m": float("nan")}, {"elevation_m": float("inf")}, {"matched": False}])
def test_scoring_rules_raise(spark, change):
    with pytest.raises(V.Violation):
        E.exposure_index(scoring(spark, **change))


def test_unknown_zone_raises_without_validation(spark):
    with pytest.raises(Exception, match="unknown zone"):
        E.exposure_index(scoring(spark, zone="ZZ"), validate=False).collect()
    with pytest.raises(ValueError):
        E.exposure_index(scoring(spark), {**S.WEIGHTS, "water": 0.9})


def test_booleans(spark):
    df = spark.createDataFrame([(" Yes ",), ("f",), (None,), ("maybe",)], "s string")
    assert [r[0] for r in df.select(S.lenient_bool(F.col("s"))).collect()] == [True, False, None, None]
    assert [r[0] for r in df.select(S.native_bool(F.col("s"))).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        df.select(S.strict_bool(F.col("s"))).collect()


def test_projections(spark):
    """Published control: the meridian of the zone is at 500 km east, and the equator at 0 north."""
    df = spark.createDataFrame([(-75.0, 0.0), (-77.6, 43.15)], "lon double, lat double")
    (e0, n0), (e1, n1) = (tuple(r) for r in df.select(*S.utm(F.col("lon"), F.col("lat"))).collect())
    assert (e0, n0) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert e1 == pytest.approx(288600, abs=300) and n1 == pytest.approx(4780600, abs=400)
    x, y = df.select(*S.web_mercator(F.col("lon"), F.col("lat"))).collect()[1]
    assert x == pytest.approx(-8638392.4, abs=1) and y == pytest.approx(5333200, abs=2000)
    back = df.select(*S.from_web_mercator(*S.web_mercator(F.col("lon"), F.col("lat")))).collect()[1]
    assert tuple(back) == pytest.approx((-77.6, 43.15), abs=1e-9)


def test_hilbert_curve_is_a_walk_and_nests(spark):
    for bits in (1, 2, 3, 4):
        n = 1 << bits
        cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
        got = sorted((r["k"], r["x"], r["y"]) for r in cells.withColumn("k", S.hilbert_key(F.col("x"), F.col("y"), bits)).collect())
        assert [g[0] for g in got] == list(range(n * n))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))
    low, high = spark.range(1).select(*L.square_key_range(F.lit(5).cast("long"), F.lit(9).cast("long"), 4, 2)).first()
    assert high - low == 16


# Rasters.

GRID = R.Grid(0.0, 70.0, 10.0, 10.0, 7, 7)


def dem(spark, f=lambda r, c: float(7 * r + c)):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(7) for c in range(7)], "cell_row long, cell_col long, z double")


def test_terrain(spark):
    got = R.terrain_evidence(points(spark, [(1, 35.0, 35.0), (2, 5.0, 65.0)]), dem(spark), GRID, 15.0)
    got = {r["id"]: r for r in got.collect()}
    assert (got[1]["elevation"], got[1]["local_mean"], got[1]["relative"]) == (24.0, 24.0, 0.0)
    assert got[2]["elevation"] == 0.0 and got[2]["local_mean"] == 8.0 and got[2]["slope"] is None
    plane = R.Grid(0.0, 7.0, 1.0, 1.0, 7, 7)
    assert R.slope(dem(spark, lambda r, c: float(c)), plane).where("cell_row = 3 and cell_col = 3").first()["slope"] == pytest.approx(45.0)
    with pytest.raises(R.OutsideRaster):
        R.terrain_evidence(points(spark, [(1, 75.0, 35.0)]), dem(spark), GRID, 15.0)
    with pytest.raises(R.OutsideRaster):
        R.terrain_evidence(points(spark, [(1, 35.0, 35.0)]), dem(spark, lambda r, c: -9999.0 if (r, c) == (3, 3) else 1.0), GRID, 15.0)
    whole = {(r["cell_row"], r["cell_col"]): r["local_mean"] for r in R.focal_mean(dem(spark), GRID, 2).collect()}
    assert whole[(3, 3)] == 24.0 and whole[(0, 0)] == 8.0


# Aggregates.


def test_spearman_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert A.spearman(df, "a", "b").first()["rho"] is None


def test_variogram_of_a_linear_field(spark):
    rows = [(i * 20 + j, float(i), float(j), 2.0 * i) for i in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, "id long, px double, py double, v double")
    line = df.where("py = 0")
    v = {r["bin"]: r for r in A.variogram_bins(J.radius_pairs(line, 5.5, carry=("v",)), line, 1.0, 8).collect()}
    assert [v[k]["semivariance"] for k in (1, 2, 3)] == [2.0, 8.0, 18.0] and v[7]["pair_count"] == 0


def test_empty_bins_keep_a_row(spark):
    df = spark.createDataFrame([(1, 50.0, 2.0, 1.0)], "id long, distance_m double, label double, pred double")
    got = {r["bin"]: r["n"] for r in A.bin_residuals(df).collect()}
    assert len(got) == 9 and got[0] == 1 and sum(got.values()) == 1


def test_tail_excludes_the_boundary(spark):
    w = spark.createDataFrame([("baseline", "baseline"), ("b", "structured")], "scenario string, family string")
    df = w.crossJoin(spark.range(10).withColumnRenamed("id", "property_id")).withColumn("percentile", (F.col("property_id") + 1) * 10.0)
    got = {r["scenario"]: r for r in A.scenario_compare(df).collect()}
    assert got["b"]["top_10pct_jaccard"] == 1.0 and got["b"]["rho"] == 1.0
    assert (got["b"]["top_10pct_baseline_count"], got["b"]["top_5pct_retained_count"]) == (1, 1)


def compared(spark, *rows):
    return spark.createDataFrame([(n, f, r, o) for n, f, r, o in rows], "scenario string, family string, rho double, top_10pct_overlap_of_smaller double")


@pytest.mark.parametrize("rho, overlap, want", [(0.95, 0.80, "stable"), (0.96, 0.79, "moderately_sensitive"), (0.85, 0.60, "moderately_sensitive"), (0.84, 0.9, "highly_sensitive")])
def test_verdict_is_that_of_the_worst_plausible_scenario(spark, rho, overlap, want):
    c = compared(spark, ("baseline", "baseline", 1.0, 1.0), ("equal", "structured", rho, 0.99), ("p", "perturbation", 0.99, overlap), ("zone_only", "reference_corner", 0.1, 0.1))
    v = A.stability_verdict(c).first()
    assert (v["verdict"], v["rho_scenario"], v["tail_scenario"]) == (want, "equal", "p")
    with pytest.raises(Exception, match="no plausible scenario"):
        A.stability_verdict(compared(spark, ("baseline", "baseline", 1.0, 1.0))).collect()


def test_forty_scenarios_on_the_simplex():
    rows = M.scenarios({"zone": 0.40, "water": 0.35, "terrain_absolute": 0.15, "terrain_relative": 0.10})
    assert len(rows) == len({r[0] for r in rows}) == 40 and all(abs(sum(r[2:]) - 1) < 1e-12 for r in rows)
    by = {r[0]: r[2:] for r in rows}
    assert by["zone_emphasized"] == pytest.approx((0.8 / 1.4, 0.35 / 1.4, 0.15 / 1.4, 0.1 / 1.4))
    assert by["terrain_family_deemphasized"] == pytest.approx((0.4 / 0.875, 0.35 / 0.875, 0.075 / 0.875, 0.05 / 0.875))
    assert by["water_only"] == (0, 1, 0, 0) and sum(r[1] == "perturbation" for r in rows) == 24
    assert M.scenarios({"a": 0.5, "b": 0.5}, draws=0)[0][2:] == (0.5, 0.5)


def verdict_tables(spark, far=7.0, rho=-0.40, minority=45.0, rival=0.10):
    majority, n = 6.0, (9000, 1000)
    sse = (majority**2 * n[0], minority**2 * n[1])
    classes = spark.createDataFrame([(v, k, m, k / 10000, s / sum(sse)) for v, k, m, s in zip(("X", "AE"), n, (majority, minority), sse)], "cls string, n long, rmse double, row_share double, sse_share double")
    bins = spark.createDataFrame([(0, 0.0, 500, 15.0), (1, 100.0, 500, 9.0), (2, 3000.0, 500, far), (3, 50.0, 0, None)], "bin int, lower_m double, n long, mean_abs double")
    ranking = spark.createDataFrame([("boundary", rho), ("roughness", rival), ("label", 0.05)], "candidate string, within_rho double")
    return classes, bins, ranking


@pytest.mark.parametrize("change, clauses, verdict", [
    ({}, (True, True, True), "CONFIRMED"), ({"far": 18.0}, (True, True, False), "REFUTED"), ({"rho": 0.40}, (True, False, True), "REFUTED"), ({"rho": -0.04, "rival": 0.01}, (True, False, True), "REFUTED"),
    ({"rho": -0.15, "rival": -0.30}, (True, False, True), "REFUTED"), ({"minority": 3.0}, (False, True, True), "REFUTED"),
])
def test_prediction_verdict(spark, change, clauses, verdict):
    v = E.prediction_verdict(*verdict_tables(spark, **change), "X", "boundary").first()
    assert (v["class_effect"], v["proximity_effect"], v["small_elsewhere"], v["verdict"]) == (*clauses, verdict)
    assert v["strongest"] == {-0.15: "roughness", -0.04: "label"}.get(change.get("rho"), "boundary")
    classes, bins, ranking = verdict_tables(spark)
    with pytest.raises(Exception, match="no minority or no majority"):
        E.prediction_verdict(classes.where("cls = 'X'"), bins, ranking, "X", "boundary").collect()


def test_counters_and_the_gate(spark):
    kind = "property_id long, distance double, entries_scanned long, n_disk_r long, n_true_r long, n_disk_infl long, n_disk_unc long"
    good = spark.createDataFrame([(k, float(k), 20, 0, 2, 10, 12) for k in range(100)], kind)
    one = A.counter_invariants(good).first()
    assert one["ordering_holds"] and one["n_disk_unc_lt_n_disk_infl"] == 0
    bad = A.counter_invariants(good.unionByName(spark.createDataFrame([(900, 1.0, 9, 3, 0, 10, 0)], kind))).first()
    assert not bad["ordering_holds"] and [bad[c] for c in ("n_disk_r_gt_n_true_r", "n_true_r_lt_1", "n_true_r_gt_n_disk_infl", "n_disk_infl_gt_n_decomp", "n_disk_unc_lt_n_disk_infl")] == [1, 1, 0, 1, 1]
    assert A.counter_invariants(good.withColumn("n_disk_unc", F.lit(0))).first()["n_disk_unc_lt_n_disk_infl"] is None
    assert E.inflation_gate(good).first()["verdict"] == "disk_predicate_stays_off"
    assert E.inflation_gate(good.withColumn("entries_scanned", F.lit(40))).first()["verdict"] == "enable_disk_predicate"
    assert E.inflation_gate(good.limit(0)).first()["verdict"] == "undetermined"
    deciles = A.decile_profile(good, "distance", "property_id").collect()
    assert sorted(d["decile"] for d in deciles) == list(range(1, 11)) and all(d["n"] == 10 and d["inflation_capped"] == 5.0 and d["box_vs_disk"] == 2.0 for d in deciles)


def test_decomposition_and_gates(spark):
    cells = spark.createDataFrame([("w", "tree", 60.0, 9400.0), ("w", "curve", 66.0, 11000.0), ("w", "odd", 10.0, 9000.0), ("other", "curve", 5.0, 3.0)], "workload string, algorithm string, us double, checks double")
    got = {r["algorithm"]: r for r in A.decomposition(cells, ["workload"], "tree", "us", "checks").collect()}
    assert len(got) == 3 and got["tree"]["search"] == pytest.approx(0.36) and got["tree"]["search_share"] == pytest.approx(0.006)
    assert got["curve"]["verification"] == pytest.approx(11000 * 60 * 0.994 / 9400) and not got["odd"]["physical"]
    runs = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    assert A.benchmark_cells(runs, ["k"], "v").first()["median_standard_error"] == pytest.approx(1.253 * 1.2909944487358056 / 2)
    gaps = spark.createDataFrame([(10.0, 1), (80.0, 2)], "d double, b int")
    assert not A.gate_report(gaps.limit(0), "d", 5.0).first()["passed"]
    g = A.gate_report(gaps, "d", 50.0, "b").first()
    assert (g["violations"], g["violation_fraction"], g["min_blocks"], g["grid_violations"], g["passed"]) == (1, 0.5, 1, 1, False)


def test_knn_of_far_and_of_few_points(spark):
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0), (3, 0.0, 1e6)], "id long, px double, py double")
    for cell in (1.0, None):
        got = {(r["id"], r["other"]): r["distance"] for r in J.knn(far, 2, cell).collect()}
        assert len(got) == 6 and got[2, 1] == got[3, 1] == 1e6 and (1, 2) in got
    assert J.knn(far, 9).count() == 9 and J.knn(far.limit(0), 3).count() == 0
    same = spark.createDataFrame([(k, 5.0, 5.0) for k in range(4)], "id long, px double, py double")
    assert J.knn(same, 2).count() == 8


# Splits, learned index, models.


def test_folds_and_masks(spark):
    r = random.Random(1)
    p = points(spark, [(i, r.random() * 8000, r.random() * 8000) for i in range(300)])
    f = P.spatial_kfold(p, 1000.0, 4, 3)
    mask = {x["id"]: (x["fold"], x["dropped_mask"]) for x in P.dropped_mask(f, 4, 300.0).collect()}
    at = {x["id"]: (x["px"], x["py"]) for x in p.collect()}
    for i, (fold, m) in mask.items():
        for k in range(4):
            held = [j for j, (g, _) in mask.items() if g in (k, (k + 1) % 4)]
            near = min(math.dist(at[i], at[j]) for j in held if j != i) < 300
            assert bool(m >> k & 1) == (fold not in (k, (k + 1) % 4) and near)
    u = P.digest_uniform(f, 3).collect()
    assert all(0 <= x["u"] < 1 for x in u) and len({x["u"] for x in u}) == len(u)


def test_learned_index_holds_every_key(spark):
    r = random.Random(6)
    keys = spark.createDataFrame([(int(r.lognormvariate(8, 2)),) for _ in range(3000)], "key long")
    pos = L.positions(keys)
    assert {x["key"]: x["pos"] for x in pos.collect()} == {k: sum(y < k for (y,) in [tuple(z) for z in keys.collect()]) for (k,) in {tuple(z) for z in keys.limit(40).collect()}} | {x["key"]: x["pos"] for x in pos.collect()}
    for leaves in (1, 8, 300):
        root, table = L.train_rmi(pos, leaves)
        assert L.verify_rmi(pos, root, table, leaves).first()["outside"] == 0 and table.count() == leaves


def test_network_gradient_and_round_trip():
    import numpy as np

    net = M.Network(2, [5, 4], 1, frequencies=3)
    r = np.random.default_rng(0)
    z, y = net.features(r.normal(size=(7, 2))), r.normal(size=7)
    loss = lambda: float(((net.forward(z)[-1][:, 0] - y) ** 2).mean())
    params = [p for pair in zip(net.w, net.c) for p in pair]
    for p, g in zip(params, net.gradient(z, y)):
        at = tuple(int(r.integers(0, s)) for s in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert (M.Network.from_arrays(net.to_arrays()).predict(z[:, :2]) == net.predict(z[:, :2])).all()


def test_fits(spark):
    import numpy as np

    rows = [(float(x), float(x * x), 3.0 + 2 * x - x * x) for x in range(10)]
    fit = M.ols_multi(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    assert (fit["intercept"], fit["a"], fit["b"], fit["r2"]) == pytest.approx((3, 2, -1, 1))
    h = np.arange(1, 40) * 50.0
    assert M.exponential_fit(h, 2 + 5 * (1 - np.exp(-h / 300)), np.ones_like(h)) == pytest.approx((2, 5, 300), rel=1e-4)
    grid = spark.createDataFrame([(float(x * 100), float(y * 100), 1.0 + x - 2 * y + x * y * 0.1) for x in range(8) for y in range(8)], "px double, py double, v double")
    out, r2 = M.poly_detrend(grid, "v")
    assert r2 == pytest.approx(1.0) and out.agg(F.max(F.abs("residual"))).first()[0] < 1e-6


# Validation and files.


def test_violations_name_the_least_examples(spark):
    df = spark.createDataFrame([(i, float(i - 3)) for i in range(30)], "id long, v double")
    got = {r["check"]: r for r in V.violations(df, [V.non_negative("v"), V.finite("v"), V.in_range("v", 0, 5, warn=True)], "id").collect()}
    assert got["v_negative"]["status"] == "FAIL" and got["v_negative"]["examples"] == ["0", "1", "2"]
    assert got["v_not_finite"]["status"] == "PASS" and got["v_out_of_range"]["status"] == "WARN" and len(got["v_out_of_range"]["examples"]) == 10
    with pytest.raises(V.Violation, match="v_negative: 3 rows"):
        V.enforce(df, [V.non_negative("v")], "id")


def test_ring_rules(spark):
    rows = ring(1, square(0, 0, 1)) + ring(2, square(0, 0, 1))[:-1] + ring(3, [(0, 0), (1, 1)]) + [(4, 0, 0, 0, 0.0, 0.0), (4, 0, 0, 2, 1.0, 0.0)]
    got = {r["fid"]: r["ok"] for r in V.ring_report(spark.createDataFrame(rows, VERTEX)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert V.without_exterior(spark.createDataFrame(ring(5, square(0, 0, 1), ring=1), VERTEX)).count() == 1


def test_audit_and_roll_up(spark):
    index = E.exposure_index(scoring(spark))
    checks, status = E.audit(index, scoring(spark))
    assert status.first()["status"] in ("PASS", "WARN")
    bad, status = E.audit(index.where("property_id <> 'B'").withColumn("exposure_index", F.col("exposure_index") + 1), scoring(spark))
    assert status.first()["status"] == "FAIL"
    assert {r["check"] for r in bad.where("status = 'FAIL'").collect()} >= {"index_not_reproduced", "population_left_only"}


def test_files(spark, tmp_path):
    from quillmap.sources import files

    (tmp_path / "a.csv").write_text('id,"name",v\n1,"x, ""y""",2.5\n2,,\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "v double, name string, id long")
    assert sorted(map(tuple, df.collect()), key=lambda r: r[2]) == [(2.5, 'x, "y"', 1), (None, None, 2)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), "lost double")
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"zone":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[5,6]}}]}')
    f = files.read_geojson(spark, str(tmp_path / "g.json"))
    v = files.geojson_vertices(f).collect()
    assert len(v) == 5 and [(r["x"], r["y"]) for r in v if r["fid"] == 1] == [(5.0, 6.0)] and f.first()["properties"] == {"zone": "A"}
    leaves = [(1.5, -2.0, -3, 4), (0.0, 9.0, 0, 0)]
    assert files.unpack_model(files.pack_model((0.5, 1.0), leaves)) == ((0.5, 1.0), leaves)
    (tmp_path / "keys.bin").write_bytes((2**64 - 1).to_bytes(8, "little") + (7).to_bytes(8, "little"))
    assert [int(r["key"]) for r in files.read_keys(spark, str(tmp_path / "keys.bin")).collect()] == [2**64 - 1, 7]
    plan, done = spark.createDataFrame([(1,), (2,)], "run long"), spark.createDataFrame([(1,)], "run long")
    files.append_runs(done, str(tmp_path / "log"))
    assert [r["run"] for r in files.pending(plan, files.read_run_log(spark, str(tmp_path / "log"), "run long"), ["run"]).collect()] == [2]
    files.write_csv(spark.createDataFrame([(2, 0.1), (1, 1 / 3)], "id long, v double"), str(tmp_path / "out"), "id", 12)
    assert next((tmp_path / "out").glob("part-*")).read_text() == "id,v\n1,0.333333333333\n2,0.100000000000\n"


def test_streaming_points(spark, tmp_path):
    from quillmap.streaming.points import stream_evidence

    src = points(spark, [(1, 0.5, 0.5), (2, 9.0, 9.0)])
    src.write.parquet(str(tmp_path / "in"))
    v = spark.createDataFrame(ring(1, square(0.5, 0.5, 0.5)), VERTEX)
    got = []
    q = stream_evidence(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), W.segments(v).drop("part_index", "ring_index", "seg"), v, spark.createDataFrame([(1, "A")], "fid long, zone string"), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r["id"]: (r["matched"], r["near_fid"]) for r in got} == {1: (True, 1), 2: (False, 1)}


# Plans.


def test_filters_and_columns_reach_the_scan(spark):
    from quillmap.plans.catalog import QUERIES

    plan = QUERIES["src_csv"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan and "o_comment" not in plan
    plan = QUERIES["J3b_join_nearest_feature_bvh"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_and_queries_import():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 180 and set(entry.oracle_sql()) <= set(names)
