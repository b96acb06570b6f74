"""What larger tables need: pairs that aren't broadcast, gathered in one task or listed in cells they don't pass."""

import math
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillmap.operators import aggregates as A, geometry as G, joins as J, raster as R, splits as P
from quillmap.plans.catalog import QUERIES
from test_engine import SEGMENT, plain_nearest, points

SF = "/root/testdata/sf0.001"
POINT = "id long, px double, py double, v double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scattered(seed, n, side):
    r = random.Random(seed)
    return [(i, float(r.randrange(-side, side)), r.uniform(-side, side), r.uniform(-9, 9)) for i in range(n)]


def test_terrain_windows_are_not_broadcast(spark):
    """A window of cells a point is many times the points, whose file is small enough that a plan would broadcast them."""
    assert "BroadcastHashJoin" not in plan(QUERIES["P3_terrain_evidence"](spark, SF))


def test_terrain_of_points_that_share_cells(spark):
    cells = spark.createDataFrame([(r, c, float(r * c % 7)) for r in range(9) for c in range(9)], "cell_row long, cell_col long, z double")
    got = R.terrain_evidence(points(spark, [(1, 35.0, 35.0), (2, 36.0, 36.0), (3, 85.0, 5.0)]), cells, R.Grid(0.0, 90.0, 10.0, 10.0, 9, 9), 15.0).collect()
    rows = {r["id"]: tuple(r)[1:] for r in got}
    assert len(got) == 3 and rows[1] == rows[2] and rows[3][3] is None
    want = [float(r * c % 7) for r in range(3, 8) for c in range(1, 6)]
    assert rows[1][0] == float(5 * 3 % 7) and rows[1][1] == pytest.approx(sum(want) / 25)


def test_any_within_matches_brute_force(spark):
    ps, os_ = scattered(1, 300, 900), scattered(2, 60, 900)
    os_ += [(500 + k, 2000.0 + 30 * k, 0.0, 0.0) for k in range(3)]
    ps += [(900, 1800.0, 0.0, 0.0), (901, 1800.5, 0.0, 0.0), (902, 2000.0, 0.0, 0.0)]  # 200 away counts no more
    got = {r["id"] for r in J.any_within(spark.createDataFrame(ps, POINT), spark.createDataFrame(os_, POINT), 200.0).collect()}
    assert got == {p[0] for p in ps if any(math.dist(p[1:3], o[1:3]) < 200 for o in os_)} and 900 not in got and {901, 902} <= got


def test_a_split_searches_no_further_than_its_buffer(spark, monkeypatch):
    monkeypatch.setattr(P, "nearest_point", None)
    s = P.buffered_split(spark.createDataFrame(scattered(3, 200, 2000), POINT), 800.0, 250.0, 7)
    rows = [(r["px"], r["py"], r["split"]) for r in s.collect()]
    held = [r[:2] for r in rows if r[2] in ("validation", "test")]
    assert len(rows) == 200 and all((x == "dropped") == any(math.dist((a, b), h) < 250 for h in held) for a, b, x in rows if x in ("train", "dropped"))


def test_radius_pairs_meet_once_and_are_not_broadcast(spark):
    rows = scattered(6, 250, 60)
    got = sorted((r["a"], r["b"], r["v1"], r["v2"], r["d"]) for r in J.radius_pairs(spark.createDataFrame(rows, POINT), 11.0, carry=("v",)).collect())
    want = sorted((p[0], q[0], p[3], q[3]) for p in rows for q in rows if p[0] < q[0] and math.dist(p[1:3], q[1:3]) < 11)
    assert [g[:4] for g in got] == want and all(g[4] == pytest.approx(math.dist(rows[g[0]][1:3], rows[g[1]][1:3])) for g in got)
    assert "BroadcastHashJoin" not in plan(QUERIES["J11_join_radius_pairs"](spark, SF))


def test_a_mask_searches_no_further_than_its_buffer(spark, monkeypatch):
    monkeypatch.setattr(P, "nearest_point", None)
    f = P.spatial_kfold(spark.createDataFrame(scattered(5, 150, 2000), POINT), 800.0, 3, 7)
    at = {r["id"]: (r["px"], r["py"], r["fold"]) for r in f.collect()}
    for r in P.dropped_mask(f, 3, 200.0).collect():
        x, y, fold = at[r["id"]]
        assert r["dropped_mask"] == sum(1 << k for k in range(3) if fold not in (k, (k + 1) % 3) and any(o[2] in (k, (k + 1) % 3) and math.dist((x, y), o[:2]) < 200 for o in at.values()))


def test_lag_sums_match_all_pairs(spark):
    rows = scattered(7, 300, 90) + [(7, 1.0, 1.0, 2.0), (400, 3.0, 3.0, None), (401, None, 3.0, 1.0)]  # an id twice, no value, no place
    width, bins, want = 6.0, 5, {}
    for p in rows:
        for q in rows:
            if p[0] < q[0] and None not in (p[1], q[1]) and (d := math.dist(p[1:3], q[1:3])) < width * bins:
                n, s = want.get(int(d // width), (0, 0.0))
                want[int(d // width)] = n + 1, s + ((p[3] - q[3]) ** 2 if None not in (p[3], q[3]) else 0)
    got = {r["bin"]: (r["pair_count"], r["squares"]) for r in J.lag_sums(spark.createDataFrame(rows, POINT), width, bins).collect()}
    assert set(got) == set(range(bins)) and all(got[k][0] == n and got[k][1] == pytest.approx(s) for k, (n, s) in want.items())


def test_variogram_of_sums_is_that_of_pairs(spark):
    df = spark.createDataFrame(scattered(8, 200, 50), POINT)
    pairs = A.variogram_bins(J.radius_pairs(df, 20.0, carry=("v",)), df, 4.0, 5).orderBy("bin").collect()
    assert A.variogram_of(J.lag_sums(df, 4.0, 5), df, 4.0, 5).orderBy("bin").collect() == pairs


def test_the_fit_takes_sums_of_tiles(spark, monkeypatch):
    """The model's variogram is made of sums; no pair leaves a task."""
    monkeypatch.setattr(J, "radius_pairs", None)
    assert QUERIES["agg_exp_fit"](spark, SF).count() == 1


def test_pairs_of_points_and_boxes_are_made_by_many_tasks(spark):
    """The points are one small file; all pairs came from one task."""
    assert QUERIES["fn_bbox_dist2"](spark, SF).rdd.getNumPartitions() >= 8


def test_broadcast_search_is_dealt_to_many_tasks(spark, tmp_path):
    """Points in one file would meet all segments in one task."""
    ps = [(i, float(i % 7), float(i % 5)) for i in range(40)]
    points(spark, ps).coalesce(1).write.parquet(f"{tmp_path}/p")
    ss = [(f, float(f % 6), float(f % 4), float(f % 6), float(f % 4)) for f in range(30)]
    got = G.nearest(spark.read.parquet(f"{tmp_path}/p"), spark.createDataFrame(ss, SEGMENT), "broadcast")
    assert "REPARTITION_BY_NUM" in plan(got)
    assert {x["id"]: (x["fid"], round(x["distance"], 6), x["ties"]) for x in got.collect()} == plain_nearest(ps, ss)


def test_broadcast_search_makes_no_pairs(spark):
    """All pairs of points and segments were grouped through the shuffle; only ties leave the search now."""
    r = random.Random(12)
    ss = [(f % 90, x, y, x + r.choice([0.0, 0.0, 30.0]), y) for f in range(400) for x, y in [(float(r.randrange(300)), float(r.randrange(300)))]]
    ps = [(i, float(r.randrange(300)), float(r.randrange(300))) for i in range(300)]
    want = {k: (str(f), d, n) for k, (f, d, n) in plain_nearest(ps, [(f + 10, *s) for f, *s in ss]).items()}  # two digits sort as text does
    segments = spark.createDataFrame([(str(f + 10), *s) for f, *s in ss] + [("00", None, 1.0, 1.0, 1.0), ("01", math.nan, 1.0, 1.0, 1.0)], "fid string, ax double, ay double, bx double, by double")
    got = G.nearest(points(spark, ps + [(900, None, 1.0), (901, 5.0, math.nan)]), segments, "broadcast")
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert {x["id"]: (x["fid"], round(x["distance"], 6), x["ties"]) for x in got.collect()} == want
    assert G.nearest(points(spark, ps), segments.limit(0), "broadcast").count() == 0


def test_broadcast_search_agrees_with_the_grid_to_the_last_bit(spark):
    r = random.Random(13)
    ss = spark.createDataFrame([(f % 70, *(r.uniform(0, 50) for _ in range(4))) for f in range(150)], SEGMENT)
    ps = points(spark, [(i, r.uniform(-9, 60), r.uniform(-9, 60)) for i in range(300)])
    assert sorted(map(tuple, G.nearest(ps, ss, "broadcast").collect())) == sorted(map(tuple, G.nearest(ps, ss, "grid", cell=5.0).collect()))


def test_broadcast_search_holds_few_ties(monkeypatch):
    """All features at one place tie with every point; they leave as they come."""
    monkeypatch.setattr(G, "TILE_TIES", 100)
    at = [[5.0] * 50] * 4
    run = G._all_nearest(SimpleNamespace(value=pa.table([list(range(50)), *at], names=["fid", "ax", "ay", "bx", "by"])))
    out = list(run(iter([pa.record_batch([list(range(70)), [float(k) for k in range(70)], [5.0] * 70], names=["id", "px", "py"])])))
    assert len(out) == 5 and max(map(len, out)) == 16 * 50
    rows = {(i, f): d for b in out for i, f, d in zip(*(c.to_pylist() for c in b.columns))}
    assert rows == {(i, f): abs(i - 5.0) for i in range(70) for f in range(50)}


def test_dense_long_segments_meet_points_in_tiles(spark, monkeypatch):
    """Segments much longer than they are apart: pairs of points and features aren't grouped, and all answers hold."""
    r = random.Random(11)
    ss = [(f % 150, x, y, x + r.uniform(0, 120), y + r.uniform(-120, 120)) for f, x, y in ((f, r.uniform(0, 500), r.uniform(0, 500)) for f in range(3000))]
    ss += [(900, 100.0, 100.0, 100.0, 100.0), (901, 100.0, 100.0, 100.0, 100.0), (902, 102.0, 100.0, 102.0, 100.0)]
    ps = [(i, r.uniform(0, 500), r.uniform(0, 500)) for i in range(200)] + [(900, 100.0, 100.0), (901, 101.0, 100.0), (902, -300.0, 250.0)]
    want = plain_nearest(ps, ss)
    monkeypatch.setattr(G, "TILE_TIES", 20)
    segments = spark.createDataFrame(ss, SEGMENT)
    far = G.nearest(points(spark, ps[-1:] + ps[:9]), segments, "grid").collect()  # one point is settled by no tile
    monkeypatch.setattr(G, "settle", None)
    got = G.nearest(points(spark, ps[:-1]), segments, "grid").collect()
    assert len(got) == len(ps) - 1 and len(far) == 10
    got += far
    for x in got:
        fid, distance, ties = want[x["id"]]
        assert (x["fid"], x["ties"]) == (fid, ties) and x["distance"] == pytest.approx(distance, abs=2e-6), x
