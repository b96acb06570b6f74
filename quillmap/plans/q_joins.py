"""Queries of joins: equi, spatial, nearest, neighbour and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, geometry as G, joins as J, splits as P, windows as W
from .q_basic import D2, LINES, POINTS, POLYS, points
from .registry import query

col = F.col


def sites(t):
    return t("fx_sites")


def site_segments(t):
    return sites(t).select(col("sid").alias("fid"), col("sx").alias("ax"), col("sy").alias("ay"), col("sx").alias("bx"), col("sy").alias("by"))


@query("J1_join_one_to_one", "SELECT s.property_id, s.zone, c.label FROM fx_scoring s JOIN fx_candidate c ON s.property_id = c.property_id WHERE s.property_id % 17 <> 0")
def _(t):
    return J.one_to_one(t("fx_scoring").where("property_id % 17 <> 0").select("property_id", "zone"), t("fx_candidate").select("property_id", "label"), "property_id")


_RINGS = f"""SELECT id, fid, part_index, ring_index, sum(CASE WHEN ((ay > py) <> (by > py)) AND px < (bx-ax)*(py-ay)/nullif(by-ay, 0)+ax THEN 1 ELSE 0 END) % 2 = 1 AS odd, min({D2}) <= 1e-18 AS edge
FROM {POINTS} p JOIN {POLYS} s ON true GROUP BY id, fid, part_index, ring_index"""
_PARTS = f"SELECT id, fid, part_index, bool_or(odd AND ring_index = 0) AS outside, bool_or(odd AND ring_index > 0) AS hole, bool_or(edge) AS edge FROM ({_RINGS}) GROUP BY id, fid, part_index"


@query("pred_in_ring", f"SELECT id, fid, ring_index FROM ({_RINGS}) WHERE odd")
def _(t):
    return G.ring_flags(points(t), t("fx_poly_vertices")).where("odd").select("id", "fid", "ring_index")


@query("pred_in_polygon", f"SELECT DISTINCT id, fid FROM ({_PARTS}) WHERE outside AND NOT hole")
def _(t):
    return G.point_in_polygon(points(t), t("fx_poly_vertices"), "parity")


@query("fn_ring_eval", f"SELECT id, fid, ring_index, odd, edge FROM ({_RINGS}) WHERE odd OR edge")
def _(t):
    return G.ring_flags(points(t), t("fx_poly_vertices")).where("odd or edge").select("id", "fid", "ring_index", "odd", "edge")


@query("pred_covers", f"SELECT DISTINCT id, fid FROM ({_PARTS}) WHERE (outside AND NOT hole) OR edge")
def _(t):
    return G.point_in_polygon(points(t), t("fx_poly_vertices"), "covers")


@query("J2_join_point_in_polygon", f"SELECT p.id, m.fid, z.zone, m.fid IS NOT NULL AS matched FROM fx_points p LEFT JOIN (SELECT DISTINCT id, fid FROM ({_PARTS}) WHERE outside AND NOT hole AND NOT edge) m ON p.id = m.id LEFT JOIN (SELECT DISTINCT fid, zone FROM fx_poly_vertices) z ON m.fid = z.fid")
def _(t):
    v = t("fx_poly_vertices")
    return G.membership(points(t), v, v.select("fid", "zone").distinct()).select("id", "fid", "zone", "matched")


@query("J2b_join_pip_first", f"SELECT p.id, coalesce(min(m.fid), -1) AS fid FROM fx_points p LEFT JOIN (SELECT id, fid FROM ({_PARTS}) WHERE outside AND NOT hole) m ON p.id = m.id GROUP BY p.id")
def _(t):
    return G.first_polygon(points(t), t("fx_poly_vertices"))


def _nearest_sql(points: str, segments: str) -> str:
    return f"""SELECT id, min(fid) AS fid, round(arg_min(d, fid), 6) AS distance, count(*) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM
(SELECT id, fid, sqrt(min({D2})) AS d FROM {points} p JOIN {segments} s ON true GROUP BY id, fid)) WHERE d <= m + 1e-6 GROUP BY id"""


SITES = "(SELECT sid AS fid, sx AS ax, sy AS ay, sx AS bx, sy AS by FROM fx_sites)"


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 6))


@query("J3_join_nearest", _nearest_sql(POINTS, SITES))
def _(t):
    return _rounded(G.nearest(points(t), site_segments(t)))


@query("J3b_join_nearest_feature_bvh", _nearest_sql(POINTS, SITES))
def _(t):
    return _rounded(G.nearest(points(t), site_segments(t), "grid"))


@query("J3c_join_nearest_segment", _nearest_sql(POINTS, LINES))
def _(t):
    return _rounded(G.nearest(points(t), G.split_segments(W.segments(t("fx_line_vertices")), 25.0), "grid"))


@query("J3d_join_nearest_hilbert", _nearest_sql(POINTS, LINES))
def _(t):
    """Points in curve order, so that a task's points are near each other and meet the same cells."""
    from ..operators.learned import curve_keys, in_key_order

    near = in_key_order(curve_keys(points(t), 10, "px", "py")).select("id", "px", "py")
    return _rounded(G.nearest(near, W.segments(t("fx_line_vertices")), "grid"))


@query("fn_feature_dist", f"""SELECT id, min(fid) AS fid, round(arg_min(d, fid), 6) AS distance, count(*) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY id) AS m FROM
(SELECT id, fid, min(d) AS d FROM (SELECT id, fid, sqrt(min({D2})) AS d FROM {POINTS} p JOIN {POLYS} s ON true GROUP BY id, fid UNION ALL SELECT id, fid, CAST(0 AS DOUBLE) FROM ({_PARTS}) WHERE outside AND NOT hole) GROUP BY id, fid)) WHERE d <= m + 1e-6 GROUP BY id""")
def _(t):
    """Lines by their segments; polygons are at distance 0 from what they hold."""
    p, v = points(t), t("fx_poly_vertices")
    return _rounded(G.nearest(p, W.segments(v), zero=G.point_in_polygon(p, v, "parity")))


@query("pred_intersects", f"SELECT DISTINCT id, fid FROM {POINTS} p JOIN {LINES} s ON true WHERE {D2} <= CAST(10000 AS DOUBLE)")
def _(t):
    return G.buffered_intersects(points(t), W.segments(t("fx_line_vertices")), 100.0)


_COMPARE = "SELECT coalesce(o.o_orderkey, c.property_id) AS k, CASE WHEN o.o_orderkey IS NULL THEN 'candidate_only' WHEN c.property_id IS NULL THEN 'reference_only' ELSE 'both' END AS side, o.o_orderkey IS NOT NULL AND c.property_id IS NOT NULL AS b, o.o_orderpriority IS NOT DISTINCT FROM c.label AS same, coalesce(abs(o.o_totalprice - c.distance_m) <= 1e-6, false) AS near FROM orders o FULL JOIN fx_candidate c ON o.o_orderkey = c.property_id"


def compared(t):
    a = t("orders").select(col("o_orderkey").alias("k"), col("o_orderpriority").alias("label"), col("o_totalprice").alias("distance_m"))
    return J.compare(a, t("fx_candidate").withColumnRenamed("property_id", "k"), "k", ["label"], {"distance_m": 1e-6})


@query("J4_join_full_outer_compare", f"SELECT k, side, b AND same AS agree_label, b AND near AS agree_distance_m FROM ({_COMPARE})")
def _(t):
    return compared(t).select("k", "side", "agree_label", "agree_distance_m")


@query("agg_agreement", f"SELECT count(*) AS union_rows, count(*) FILTER (WHERE side = 'both') AS both_rows, count(*) FILTER (WHERE side = 'reference_only') AS reference_only_rows, count(*) FILTER (WHERE side = 'candidate_only') AS candidate_only_rows, count(*) FILTER (WHERE b AND same) AS agree_label, count(*) FILTER (WHERE b AND near) AS agree_distance_m, count(*) FILTER (WHERE b AND same AND near) AS full_agreement FROM ({_COMPARE})")
def _(t):
    return J.agreement(compared(t))


@query("V_full_agreement", f"SELECT count(*) AS union_rows, count(*) FILTER (WHERE b AND same AND near) AS full_agreement, count(*) > 0 AND count(*) FILTER (WHERE NOT (b AND same AND near)) = 0 AS ok FROM ({_COMPARE})")
def _(t):
    from ..operators.validation import full_agreement

    return full_agreement(J.agreement(compared(t))).select("union_rows", "full_agreement", "ok")


@query("J5_join_left_enrich", "SELECT o.o_orderkey, c.label FROM orders o LEFT JOIN fx_candidate c ON o.o_orderkey = c.property_id")
def _(t):
    c = t("fx_candidate").select(col("property_id").alias("o_orderkey"), "label")
    return t("orders").select("o_orderkey").join(c, "o_orderkey", "left")


@query("J6_join_anti_extension", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT property_id FROM fx_candidate) ORDER BY 1 LIMIT 50")
def _(t):
    return J.extension(t("orders").select("o_orderkey"), t("fx_candidate").select(col("property_id").alias("o_orderkey")), "o_orderkey", 50)


@query("J7_membership", "SELECT 'left_only' AS side, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT property_id FROM fx_candidate) UNION ALL SELECT 'right_only', count(*) FROM fx_candidate WHERE property_id NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return J.set_difference(t("orders").select(col("o_orderkey").alias("k")), t("fx_candidate").select(col("property_id").alias("k")), "k").select("side", "n")


@query("J8_join_overlap_drift", "SELECT o.o_orderkey AS k, abs(o.o_totalprice - c.distance_m) AS dx, abs(o.o_totalprice - c.distance_m) <= 0.1 AS within FROM orders o JOIN fx_candidate c ON o.o_orderkey = c.property_id")
def _(t):
    a = t("orders").select(col("o_orderkey").alias("k"), col("o_totalprice").alias("x"), F.lit(0.0).alias("y"))
    b = t("fx_candidate").select(col("property_id").alias("k"), col("distance_m").alias("x"), F.lit(0.0).alias("y"))
    return J.overlap_drift(a, b, "k", "x", "y", 0.1).select("k", "dx", "within")


_NEAREST_SITE = "SELECT id, sid, sv, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS k FROM (SELECT p.id, s.sid, s.sv, sqrt((px-sx)*(px-sx)+(py-sy)*(py-sy)) AS d FROM {p} p, fx_sites s)) WHERE k = 1"


@query("J9_join_nearest_point", _NEAREST_SITE.format(p=POINTS))
def _(t):
    return _rounded(J.nearest_point(points(t), sites(t), carry=("sv",)))


@query("J10_join_knn", f"SELECT id, other, round(d, 6) AS distance, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM (SELECT p.id, q.id AS other, sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py)) AS d FROM {POINTS} p, {POINTS} q)) WHERE k <= 9")
def _(t):
    return _rounded(J.knn(points(t), 9))


@query("J10_local_range", f"SELECT id, round(max(v) - min(v), 9) AS local_range FROM (SELECT p.id, q.v, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py)), q.id) AS k FROM {POINTS} p, {POINTS} q) WHERE k <= 9 GROUP BY id")
def _(t):
    v = t("fx_points").select(col("id").alias("other"), "v")
    return J.knn(points(t), 9).join(v, "other").groupBy("id").agg(F.round(F.max("v") - F.min("v"), 9).alias("local_range"))


_PAIRS = f"SELECT p.id AS a, q.id AS b, sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py)) AS d, p.v AS v1, q.v AS v2 FROM {POINTS} p JOIN {POINTS} q ON p.id < q.id"


@query("J11_join_radius_pairs", f"SELECT a, b, round(d, 6) AS d FROM ({_PAIRS}) WHERE d < 300")
def _(t):
    return J.radius_pairs(points(t), 300.0).select("a", "b", S.round_half_up(col("d"), 6).alias("d"))


@query("J12_join_all_pairs", f"SELECT a, b, round(d, 6) AS d FROM ({_PAIRS}) WHERE a IN (SELECT id FROM fx_points ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 60) AND b IN (SELECT id FROM fx_points ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 60)")
def _(t):
    return J.sample_pairs(points(t), 60).select("a", "b", F.round("d", 6).alias("d"))


@query("J13_join_other_class_nearest", f"SELECT p.id, round(min(sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py))), 6) AS distance FROM {POINTS} p JOIN {POINTS} q ON p.cls <> q.cls GROUP BY p.id")
def _(t):
    return _rounded(J.other_class_distance(points(t)))


@query("J14_block_chebyshev_min", "WITH b AS (SELECT DISTINCT CAST(floor(x/800) AS BIGINT) AS block_i, CAST(floor(y/800) AS BIGINT) AS block_j, id % 3 = 0 AS train FROM fx_points) SELECT a.block_i, a.block_j, min(greatest(abs(a.block_i-t.block_i), abs(a.block_j-t.block_j))) AS separation FROM (SELECT DISTINCT block_i, block_j FROM b WHERE NOT train) a, (SELECT DISTINCT block_i, block_j FROM b WHERE train) t GROUP BY 1, 2")
def _(t):
    b = P.with_blocks(t("fx_points"), 800.0, "x", "y")
    return J.block_chebyshev(b.where("id % 3 <> 0"), b.where("id % 3 = 0"))


@query("J15_pair_within_group", "SELECT workload, seed_window, median(computation_seconds) FILTER (WHERE algorithm = 'hilbert_binary') AS control, median(computation_seconds) FILTER (WHERE algorithm = 'hilbert_rmi') AS other, round(median(computation_seconds) FILTER (WHERE algorithm = 'hilbert_rmi') / median(computation_seconds) FILTER (WHERE algorithm = 'hilbert_binary'), 9) AS ratio FROM fx_runs GROUP BY workload, seed_window HAVING count(DISTINCT algorithm) = 2")
def _(t):
    return J.pair_within(t("fx_runs"), ["workload", "seed_window"], "algorithm", "hilbert_binary", "hilbert_rmi", col("computation_seconds")).withColumn("ratio", F.round("ratio", 9))


@query("cross_holdout_separation", f"SELECT round(min(sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py))), 6) AS separation FROM {POINTS} p JOIN {POINTS} q ON p.id % 5 = 0 AND q.id % 5 = 1")
def _(t):
    return P.min_separation(points(t).where("id % 5 = 0"), points(t).where("id % 5 = 1")).withColumn("separation", F.round("separation", 6))


@query("min_separation", f"SELECT round(min(sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py))), 6) AS separation FROM {POINTS} p JOIN {POINTS} q ON p.id % 7 = 0 AND q.id % 7 <> 0")
def _(t):
    return P.min_separation(points(t).where("id % 7 = 0"), points(t).where("id % 7 <> 0")).withColumn("separation", F.round("separation", 6))


@query("hilbert_verify", f"SELECT count(*) AS points, count(*) FILTER (WHERE ties > 1) AS tied FROM ({_nearest_sql(POINTS, SITES)})")
def _(t):
    """Both strategies give the same rows: the counts are those of what agrees."""
    a, b = G.nearest(points(t), site_segments(t), "broadcast"), G.nearest(points(t), site_segments(t), "grid")
    return a.join(b, ["id", "fid", "distance", "ties"]).agg(F.count("*").alias("points"), F.count_if(col("ties") > 1).alias("tied"))


@query("geom_convex_hull_distance")
def _(t):
    return G.hull_distance(points(t)).withColumn("hull_distance", F.round("hull_distance", 6))
