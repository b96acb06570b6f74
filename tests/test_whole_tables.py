"""Registered queries answer for their whole tables."""

import pytest

from quillmap.operators import windows as W
from quillmap.plans.catalog import QUERIES
from quillmap.plans.fixtures import Tables

from test_engine import plain_nearest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J3c_join_nearest_segment", "J3d_join_nearest_hilbert"])
def test_nearest_joins_answer_every_point(spark, name, tmp_path):
    """Against brute force on a small fixture, with ids on both sides of 200."""
    customers = [(k, float(k), "A") for k in (0, 7, 150, 199, 200, 201, 350, 999, 5000)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(k, k % 6, k) for k in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, ts long").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    ps = [(r["id"], r["x"], r["y"]) for r in t("fx_points").collect()]
    ss = [tuple(r) for r in W.segments(t("fx_line_vertices")).select("fid", "ax", "ay", "bx", "by").collect()]
    want = plain_nearest(ps, ss)
    got = {r["id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {c[0] for c in customers}
    for i, r in got.items():
        assert r["fid"] == want[i][0] and r["distance"] == pytest.approx(want[i][1], abs=2e-6) and r["ties"] == want[i][2], i


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("W8_win_duplicate_mask", "SELECT count(*) FROM lineitem"),
        ("fn_strict_bool", "SELECT count(*) FROM lineitem WHERE l_linestatus IN ('F', 'O')"),
        ("fn_bbox_dist2", "SELECT (SELECT count(*) FROM fx_points) * (SELECT count(*) FROM fx_poly_centres)"),
        ("fn_key_values", "SELECT count(*) FROM orders"),
        ("sink_jsonl", "SELECT count(*) FROM orders"),
    ],
)
def test_no_prefix_of_ids(spark, name, rows):
    assert QUERIES[name](spark, SF).count() == Tables(spark, SF).sql(rows).first()[0]


def test_pending_runs_cover_the_table(spark):
    """What is planned and has no record: done and pending together are all orders."""
    keys = {r[0] for r in Tables(spark, SF)("orders").select("o_orderkey").collect()}
    pending = {r[0] for r in QUERIES["src_pending_runs"](spark, SF).collect()}
    assert pending == {k for k in keys if k % 2}


def test_duplicate_mask_keeps_high_keys(spark, tmp_path):
    rows = [(1, 1, 0, 0), (1999, 1, 0, 0), (2000, 1, 0, 0), (90_000, 1, 0, 0), (90_000, 1, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["l_orderkey"], r["dup"]) for r in QUERIES["W8_win_duplicate_mask"](spark, str(tmp_path)).collect())
    assert got == [(1, False), (1999, False), (2000, False), (90_000, True), (90_000, True)]


def test_derived_inputs_take_all_rows(spark):
    t = Tables(spark, SF)
    n = lambda sql: t.sql(sql).first()[0]
    assert n("SELECT count(*) FROM fx_line_vertices") == n("SELECT count(*) FROM events")
    assert n("SELECT count(DISTINCT fid) FROM fx_poly_vertices") == n("SELECT count(*) FROM fx_poly_centres") == n("SELECT count(*) FROM part")
    # Squares of up to 300 around distinct lattice points 1,000 apart are disjoint.
    assert n("SELECT count(*) FROM (SELECT DISTINCT cx, cy FROM fx_poly_centres) c") == n("SELECT count(*) FROM part")


def test_the_raster_follows_its_table(spark, tmp_path):
    from quillmap.plans.q_aggregates import grid

    for rows in (400, 1600):
        folder = f"{tmp_path}/{rows}"
        spark.range(rows).withColumnRenamed("id", "c_custkey").write.parquet(f"{folder}/customer.parquet")
        t = Tables(spark, folder)
        g, side = grid(t), 8 * round(rows**0.5)
        assert (g.rows, g.cols) == (side, side) and t("fx_dem").count() == side * side


def test_feature_collections_come_back_from_several_files(spark):
    """The parts of sf0.01 fill more than one file; no feature is lost or mistaken for another."""
    sf = "/root/testdata/sf0.01"
    assert QUERIES["src_geojson"](spark, sf).exceptAll(Tables(spark, sf).sql("SELECT fid, 0 AS part_index, ring_index, vertex_index, x, y FROM fx_poly_vertices")).isEmpty()
    assert QUERIES["src_geojson"](spark, sf).count() == Tables(spark, sf)("fx_poly_vertices").count()
