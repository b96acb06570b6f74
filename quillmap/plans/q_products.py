"""Queries of validation, composite products, splits, models and the learned index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, evidence as E, geometry as G, joins as J, learned as L, models as M, raster as R, splits as P, validation as V, windows as W
from .q_aggregates import _BINNED, _CLASSES, _RANKED, _cells, _rank, grid, variogram
from .q_basic import LINES, POINTS, points
from .q_joins import SITES, _nearest_sql, site_segments
from .registry import query

col = F.col

_ZONE = "CAST(CASE zone WHEN 'X' THEN 10 WHEN 'AO' THEN 80 WHEN 'A' THEN 90 WHEN 'AE' THEN 95 WHEN 'VE' THEN 100 END AS DOUBLE)"
_COMPONENTS = f"SELECT property_id, elevation_m, {_ZONE} AS c_zone, 100 * {_rank('-distance_m')} / count(*) OVER () AS c_water, 100 * {_rank('-elevation_m')} / count(*) OVER () AS c_abs, 100 * {_rank('-relative_m')} / count(*) OVER () AS c_rel FROM fx_scoring"
_SUM = "round(CAST({a} AS DOUBLE)*c_zone + CAST({b} AS DOUBLE)*c_water + CAST({c} AS DOUBLE)*c_abs + CAST({d} AS DOUBLE)*c_rel, 9)"
_INDEX = f"SELECT *, 100 * {_rank('exposure_index')} / count(*) OVER () AS exposure_percentile, '1.0' AS policy FROM (SELECT *, {_SUM.format(a=0.4, b=0.35, c=0.15, d=0.1)} AS exposure_index FROM ({_COMPONENTS}))"
_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("c_zone", "c_water", "c_abs", "c_rel", "exposure_index", "exposure_percentile"))


def _round6(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("P1_exposure_index", f"SELECT property_id, {_R}, policy FROM ({_INDEX})")
def _(t):
    return _round6(E.exposure_index(t("fx_scoring")), *E.INDEX[1:7])


@query("P1_exposure_index_scalable", f"SELECT property_id, {_R}, policy FROM ({_INDEX})")
def _(t):
    """All four global ranks by range partitions."""
    return _round6(E.exposure_index(t("fx_scoring"), validate=False, scale=True), *E.INDEX[1:7])


@query("fn_composite", f"SELECT property_id, round({_SUM.format(a=0.4, b=0.35, c=0.15, d=0.1)}, 6) AS v FROM ({_COMPONENTS})")
def _(t):
    c = E.component_scores(t("fx_scoring"))
    return c.select("property_id", F.round(S.composite(col("c_zone"), col("c_water"), col("c_abs"), col("c_rel")), 6).alias("v"))


for _name, _source in (("score_water", "distance_m"), ("score_terrain_abs", "elevation_m"), ("score_terrain_rel", "relative_m")):

    def _score(t, c=_source):
        return t("fx_scoring").select("property_id", F.round(W.percentile_avg(col(c), higher=False), 9).alias("score"))

    query(_name, f"SELECT property_id, round(100 * {_rank('-' + _source)} / count(*) OVER (), 9) AS score FROM fx_scoring")(_score)


@query("agg_index_variance_share", " UNION ALL ".join(f"SELECT '{c}' AS component, round(covar_samp(CAST({w} AS DOUBLE) * {c}, exposure_index) / var_samp(exposure_index), 9) AS share FROM ({_INDEX})" for c, w in (("c_zone", 0.4), ("c_water", 0.35), ("c_abs", 0.15), ("c_rel", 0.1))))
def _(t):
    return A.variance_share(E.exposure_index(t("fx_scoring"), validate=False), {"c_zone": 0.4, "c_water": 0.35, "c_abs": 0.15, "c_rel": 0.1}, "exposure_index").select("component", "share")


@query("flt_shortlist", f"SELECT property_id, round(exposure_percentile, 6) AS exposure_percentile FROM ({_INDEX}) WHERE exposure_percentile >= 95 ORDER BY ({_rank('exposure_index')}) DESC, property_id LIMIT 40")
def _(t):
    return _round6(E.shortlist(E.exposure_index(t("fx_scoring"), validate=False), 95.0, 40).select("property_id", "exposure_percentile"), "exposure_percentile")


@query("P2_property_evidence", f"SELECT p.id AS property_id, p.px, m.fid AS polygon, n.distance, n.ties FROM {POINTS} p JOIN (SELECT p.id, m.fid FROM fx_points p LEFT JOIN (SELECT id, fid FROM fx_points, fx_poly_centres WHERE x > cx - half AND x < cx + half AND y > cy - half AND y < cy + half) m ON p.id = m.id) m ON p.id = m.id JOIN ({_nearest_sql(POINTS, SITES)}) n ON p.id = n.id")
def _(t):
    p, v = points(t), t("fx_poly_vertices").where("ring_index = 0")
    m = G.membership(p, v, v.select("fid").distinct()).select(col("id").alias("property_id"), col("fid").alias("polygon"))
    n = G.nearest(p, site_segments(t)).select(col("id").alias("property_id"), F.round("distance", 6).alias("distance"), "ties")
    return E.property_evidence(p.select(col("id").alias("property_id"), "px"), m, n)


_INSIDE = "(SELECT id, CAST(floor((10100 - y) / 100) AS BIGINT) AS r, CAST(floor(x / 100) AS BIGINT) AS c FROM fx_points WHERE x < 10000 AND y > 100 AND y < 10000)"
_N9 = {(i, j): f"max(CASE WHEN d.cell_row = p.r + {i} AND d.cell_col = p.c + {j} THEN d.z END)" for i in (-1, 0, 1) for j in (-1, 0, 1)}


@query("P3_terrain_evidence", f"""SELECT id, elevation, round(local_mean, 9) AS local_mean, round(elevation - local_mean, 9) AS relative FROM
(SELECT p.id, max(CASE WHEN d.cell_row = p.r AND d.cell_col = p.c AND d.z <> -9999 THEN d.z END) AS elevation, avg(CASE WHEN d.z <> -9999 THEN d.z END) AS local_mean FROM {_INSIDE} p JOIN fx_dem d ON d.cell_row BETWEEN p.r - 2 AND p.r + 2 AND d.cell_col BETWEEN p.c - 2 AND p.c + 2 GROUP BY p.id)""")
def _(t):
    p = points(t).where("px < 10000 and py > 100 and py < 10000")
    out = R.terrain_evidence(p, t("fx_dem"), grid(t), 150.0, check=False)
    return out.select("id", "elevation", F.round("local_mean", 9).alias("local_mean"), F.round("relative", 9).alias("relative"))


_SCORED = f"SELECT scenario, family, property_id, exposure AS idx, 100 * {_rank('exposure', 'scenario')} / count(*) OVER (PARTITION BY scenario) AS percentile FROM (SELECT w.scenario, w.family, c.property_id, round(w_zone*c_zone + w_water*c_water + w_abs*c_abs + w_rel*c_rel, 9) AS exposure FROM ({_COMPONENTS}) c, fx_weights w)"


@query("P4_score_scenarios", f"SELECT scenario, property_id, round(idx, 9) AS index, round(percentile, 6) AS percentile FROM ({_SCORED})")
def _(t):
    scored, _, _ = E.sensitivity(t("fx_scoring"), t("fx_weights"))
    return _round6(scored, "percentile").select("scenario", "property_id", "index", "percentile")


def _tail(at: int, name: str) -> str:
    a, b = f"count(*) FILTER (WHERE b.percentile > {at})", f"count(*) FILTER (WHERE s.percentile > {at})"
    both, either = f"count(*) FILTER (WHERE s.percentile > {at} AND b.percentile > {at})", f"count(*) FILTER (WHERE s.percentile > {at} OR b.percentile > {at})"
    return f"{a} AS {name}_baseline_count, {b} AS {name}_scenario_count, {both} AS {name}_retained_count, round({both} / CAST(nullif({either}, 0) AS DOUBLE), 9) AS {name}_jaccard, round({both} / CAST(nullif(least({a}, {b}), 0) AS DOUBLE), 9) AS {name}_overlap_of_smaller"


_COMPARED = f"""SELECT s.scenario, s.family, round(corr(s.percentile, b.percentile), 9) AS rho, round(median(abs(s.percentile - b.percentile)), 9) AS median_shift, round(avg(abs(s.percentile - b.percentile)), 9) AS mean_shift, round(quantile_cont(abs(s.percentile - b.percentile), 0.95), 9) AS p95_shift, round(max(abs(s.percentile - b.percentile)), 9) AS max_shift,
 count(*) FILTER (WHERE abs(s.percentile - b.percentile) > 10) AS over_10, count(*) FILTER (WHERE abs(s.percentile - b.percentile) > 25) AS over_25, {_tail(90, "top_10pct")}, {_tail(95, "top_5pct")} FROM sc s JOIN (SELECT * FROM sc WHERE scenario = 'baseline') b ON s.property_id = b.property_id GROUP BY s.scenario, s.family"""


@query("agg_scenario_compare", f"WITH sc AS ({_SCORED}) {_COMPARED}")
def _(t):
    return E.sensitivity(t("fx_scoring"), t("fx_weights"))[1]


@query("agg_stability_verdict", f"WITH sc AS ({_SCORED}) SELECT min(rho) AS min_rho, arg_min(scenario, (rho, scenario)) AS rho_scenario, min(o) AS min_tail, arg_min(scenario, (o, scenario)) AS tail_scenario, CASE WHEN min(rho) >= 0.95 AND min(o) >= 0.8 THEN 'stable' WHEN min(rho) >= 0.85 AND min(o) >= 0.6 THEN 'moderately_sensitive' ELSE 'highly_sensitive' END AS verdict FROM (SELECT *, top_10pct_overlap_of_smaller AS o FROM ({_COMPARED})) WHERE scenario <> 'baseline' AND family IN ('structured', 'perturbation')")
def _(t):
    return E.sensitivity(t("fx_scoring"), t("fx_weights"))[2]


@query("agg_row_variability", f"SELECT property_id, round(min(percentile), 6) AS min, round(max(percentile), 6) AS max, round(round(avg(percentile), 9), 6) AS mean, round(round(stddev_samp(percentile), 9), 6) AS std, round(round(max(percentile) - min(percentile), 9), 6) AS range FROM ({_SCORED}) GROUP BY property_id")
def _(t):
    return _round6(A.row_variability(E.sensitivity(t("fx_scoring"), t("fx_weights"))[0]), "min", "max", "mean", "std", "range")


@query("P5_supervised_dataset", "SELECT id, x AS px, y AS py, v AS label FROM fx_points")
def _(t):
    return E.supervised_dataset(t("fx_points").select("id", col("v").alias("label")), points(t).select("id", "px", "py"))


_H = "CAST('0x' || substr(md5(concat_ws(':', {p})), 1, 13) AS BIGINT)"
_SPLIT = f"SELECT id, px, py, CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, px, py, {_H.format(p='7, CAST(floor(px/800) AS BIGINT), CAST(floor(py/800) AS BIGINT)')} / CAST(4503599627370496 AS DOUBLE) AS u FROM {POINTS})"


@query("P6_spatial_split", f"WITH s AS ({_SPLIT}) SELECT id, CASE WHEN split = 'train' AND EXISTS (SELECT 1 FROM s h WHERE h.split <> 'train' AND sqrt((h.px-s.px)*(h.px-s.px)+(h.py-s.py)*(h.py-s.py)) < 250) THEN 'dropped' ELSE split END AS split FROM s")
def _(t):
    return P.buffered_split(points(t), 800.0, 250.0, 7).select("id", "split")


_FOLD = f"SELECT id, px, py, CAST({_H.format(p='7, CAST(floor(px/800) AS BIGINT), CAST(floor(py/800) AS BIGINT)')} % 3 AS INT) AS fold FROM {POINTS}"


@query("P7_spatial_kfold", f"WITH f AS ({_FOLD}) SELECT id, fold, CAST(" + " + ".join(f"CASE WHEN fold <> {k} AND fold <> {(k + 1) % 3} AND EXISTS (SELECT 1 FROM f h WHERE h.fold IN ({k}, {(k + 1) % 3}) AND sqrt((h.px-f.px)*(h.px-f.px)+(h.py-f.py)*(h.py-f.py)) < 200) THEN {1 << k} ELSE 0 END" for k in range(3)) + " AS BIGINT) AS dropped_mask FROM f")
def _(t):
    return P.dropped_mask(P.spatial_kfold(points(t), 800.0, 3, 7), 3, 200.0)


@query("P8_split_builder", f"SELECT split, count(*) AS n, min(px) AS minx, max(px) AS maxx FROM ({_SPLIT}) WHERE px BETWEEN 0 AND 20000 GROUP BY split")
def _(t):
    s = V.enforce(P.spatial_split(points(t), 800.0, 7), [V.in_range("px", 0, 20000), V.in_range("py", 0, 20000)], "id")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("px").alias("minx"), F.max("px").alias("maxx"))


_OFF = f"SELECT property_id, exposure_index + CASE WHEN property_id = 9 THEN 120 ELSE 0 END AS v, exposure_index AS again FROM ({_INDEX}) WHERE property_id <> 5"


@query("P9_audit", f"WITH i AS ({_OFF}) SELECT 'FAIL' AS status, count(*) AS n FROM (SELECT count(*) AS bad FROM i WHERE v NOT BETWEEN 0 AND 100 UNION ALL SELECT count(*) FROM i WHERE abs(v - again) > 1e-6 UNION ALL SELECT count(*) FROM fx_scoring WHERE property_id NOT IN (SELECT property_id FROM i) UNION ALL SELECT count(*) FROM i WHERE property_id NOT IN (SELECT property_id FROM fx_scoring)) WHERE bad > 0")
def _(t):
    """An index with a lost row and a stored value off: two derivation or population checks fail, and the plausibility one warns or passes."""
    index = E.exposure_index(t("fx_scoring"), validate=False).where("property_id <> 5").withColumn("exposure_index", col("exposure_index") + F.when(col("property_id") == 9, 120.0).otherwise(0.0))
    checks, _ = E.audit(index, t("fx_scoring"))
    return V.status_counts(checks).where("status = 'FAIL'")


_MAJORITY = "(SELECT cls FROM fx_predictions GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 1)"
_VERDICT = f"""WITH c AS (SELECT *, rmse * rmse * n AS sse, cls = {_MAJORITY} AS major FROM ({_CLASSES})),
a AS (SELECT sqrt(sum(sse) FILTER (WHERE NOT major) / sum(n) FILTER (WHERE NOT major)) AS minority_rmse, max(rmse) FILTER (WHERE major) AS majority_rmse, sum(row_share) FILTER (WHERE NOT major) AS minority_row_share, sum(sse_share) FILTER (WHERE NOT major) AS minority_sse_share FROM c),
b AS (SELECT max(mean_abs) FILTER (WHERE lower_m = 3000) AS far, min(mean_abs) FILTER (WHERE lower_m < 3000) AS inner_least FROM ({_BINNED.replace("WHERE distance_m NOT BETWEEN 500 AND 750", f"WHERE cls = {_MAJORITY}")}) WHERE n > 0),
r AS (SELECT max(within_rho) FILTER (WHERE candidate = 'distance_m') AS rho, arg_max(candidate, (abs(within_rho), candidate = 'distance_m')) AS strongest FROM ({_RANKED}))
SELECT round(minority_rmse, 6) AS minority_rmse, round(majority_rmse, 6) AS majority_rmse, round(far, 6) AS far_mean_abs, round(inner_least, 6) AS least_inner_mean_abs, round(rho, 6) AS boundary_rho, strongest,
 minority_rmse > majority_rmse AND minority_sse_share > minority_row_share AS class_effect, rho < 0 AND abs(rho) >= 0.1 AND strongest = 'distance_m' AS proximity_effect, far <= inner_least AS small_elsewhere,
 CASE WHEN minority_rmse > majority_rmse AND minority_sse_share > minority_row_share AND rho < 0 AND abs(rho) >= 0.1 AND strongest = 'distance_m' AND far <= inner_least THEN 'CONFIRMED' ELSE 'REFUTED' END AS verdict FROM a, b, r"""


@query("P10_prediction_verdict", _VERDICT)
def _(t):
    p = t("fx_predictions")
    major = A.majority(p, "cls").first()["value"]
    ranked = A.competitor_ranking(p.withColumn("distance_m", F.when(col("distance_m") < 4900, col("distance_m"))), ["distance_m", "x"], "pred", "label", strata=4)
    out = E.prediction_verdict(A.class_decomposition(p), A.bin_residuals(p.where(col("cls") == major)), ranked, major, "distance_m")
    return _round6(out, "minority_rmse", "majority_rmse", "far_mean_abs", "least_inner_mean_abs", "boundary_rho").drop("minority_row_share", "minority_sse_share")


_PARTS = " UNION ALL ".join(f"SELECT property_id, true AS adds_up, '{c}' AS component, round({c}, 6) AS score, CAST({w} AS DOUBLE) AS weight, round(CAST({w} AS DOUBLE) * {c}, 6) AS contribution FROM ({_INDEX}) WHERE property_id = 42" for c, w in (("c_zone", 0.4), ("c_water", 0.35), ("c_abs", 0.15), ("c_rel", 0.1)))


@query("P14_property_trace", _PARTS)
def _(t):
    index = E.exposure_index(t("fx_scoring"), validate=False)
    return _round6(E.property_trace(index.select("property_id", "exposure_index"), index.select("property_id", "c_zone", "c_water", "c_abs", "c_rel"), 42), "score", "contribution")


@query("P13_partition_inputs", f"SELECT k, role, count(*) AS n, round(avg(v), 6) AS mean_label FROM (SELECT f.id, p.v, k, CASE WHEN f.fold = k THEN 'test' WHEN f.fold = (k + 1) % 3 THEN 'validation' ELSE 'train' END AS role FROM ({_FOLD}) f JOIN fx_points p ON f.id = p.id, (VALUES (0), (1), (2)) AS r(k)) GROUP BY k, role")
def _(t):
    r = P.roles(P.spatial_kfold(points(t), 800.0, 3, 7), 3)
    j = r.join(t("fx_points").select("id", "v"), "id")
    return j.groupBy("k", "role").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_label"))


@query("P15_ladder_analysis", f"SELECT a.workload, a.algorithm, b.algorithm AS next_algorithm, round(a.median / b.median, 9) AS speedup, CASE WHEN a.min / nullif(b.max, 0) > 1 THEN 'A SLOWER' WHEN a.max / nullif(b.min, 0) < 1 THEN 'A FASTER' ELSE 'NOT RESOLVED' END AS verdict FROM ({_cells('workload, algorithm')}) a JOIN ({_cells('workload, algorithm')}) b ON a.workload = b.workload AND a.algorithm = 'hilbert_binary' AND b.algorithm = 'hilbert_rmi'")
def _(t):
    return E.ladder(t("fx_runs"), ["hilbert_binary", "hilbert_rmi"])


@query("P16_pipeline_cost", "SELECT algorithm, round(regr_slope(s, n), 9) AS slope, round(regr_intercept(s, n), 6) AS intercept, count(*) AS n FROM (SELECT algorithm, seed_window, sum(computation_seconds) AS s, count(*) AS n FROM fx_runs GROUP BY ALL) GROUP BY algorithm")
def _(t):
    g = t("fx_runs").groupBy("algorithm", "seed_window").agg(F.sum("computation_seconds").alias("s"), F.count("*").cast("double").alias("n"))
    return A.ols_line(g, "n", "s", "algorithm").select("algorithm", "slope", "intercept", "n")


@query("agg_majority_by_segment", "SELECT o_custkey, value, n FROM (SELECT o_custkey, o_orderpriority AS value, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def _(t):
    return A.majority(t("orders"), "o_orderpriority", "o_custkey").select("o_custkey", "value", "n")


# Learned index.

_POS = "SELECT key, min(pos) AS pos FROM (SELECT o_custkey AS key, rank() OVER (ORDER BY o_custkey) - 1 AS pos FROM orders) GROUP BY key"
_T = f"SELECT key, pos, (key - lo) * (1 / CAST(hi - lo AS DOUBLE)) AS t FROM ({_POS}), (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders)"


def keys(t):
    return L.positions(t("orders").select(col("o_custkey").alias("key")))


@query("rmi_root", f"SELECT round(regr_slope(pos, t), 3) AS a, round(regr_intercept(pos, t), 3) AS b, count(*) AS keys FROM ({_T})")
def _(t):
    root, _ = L.train_rmi(keys(t), 16)
    return root.crossJoin(keys(t).agg(F.count("*").alias("keys"))).select(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "keys")


@query("P11_rmi_train_verify", "SELECT count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS outside FROM orders")
def _(t):
    """Every key lies within its leaf's bounds."""
    pos = keys(t)
    root, leaves = L.train_rmi(pos, 16)
    return L.verify_rmi(pos, root, leaves, 16).select("keys", "outside")


@query("rmi_leaf_bounds", f"SELECT count(*) AS leaves, sum(keys) AS keys, CAST(0 AS BIGINT) AS crossed FROM (SELECT unnest(range(16)) AS leaf) l JOIN (SELECT count(*) / 16.0 AS keys FROM ({_POS})) k ON true")
def _(t):
    _, leaves = L.train_rmi(keys(t), 16)
    return leaves.agg(F.count("*").alias("leaves"), F.sum("keys").cast("double").alias("keys"), F.count_if(col("err_min") > col("err_max")).alias("crossed"))


@query("rmi_predict", f"SELECT key, pos, true AS held FROM ({_POS})")
def _(t):
    pos = keys(t).select("key", "pos")
    root, leaves = L.train_rmi(pos, 16)
    p = L.predict_rmi(pos, root, leaves, 16)
    return p.select("key", col("pos").cast("long").alias("pos"), col("pos").between(col("low"), col("high")).alias("held"))


@query("rmi_equi_depth", f"SELECT CAST(least(floor(pos * 16 / n), 15) AS INT) AS leaf, min(key) AS first, max(key) AS last, count(*) AS keys FROM (SELECT key, rank() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS key FROM orders)) GROUP BY 1")
def _(t):
    distinct = t("orders").select(col("o_custkey").alias("key")).distinct()
    return L.equi_depth_leaves(L.positions(distinct), 16)


# Models: fitted on the driver or in a group's task, so SQL can't give their rows.


@query("agg_ols_multi")
def _(t):
    fit = M.ols_multi(t("fx_predictions"), ["distance_m", "x", "y"], "label")
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in fit.items()], "term string, value double")


@query("agg_poly_detrend")
def _(t):
    out, r2 = M.poly_detrend(points(t), "v")
    return out.select("id", F.round("trend", 4).alias("trend"), F.round("residual", 4).alias("residual"), F.lit(round(r2, 6)).alias("r2"))


@query("agg_exp_fit")
def _(t):
    v = variogram(t).orderBy("bin").collect()  # ten rows
    fit = M.exponential_fit([r["lag"] for r in v], [r["semivariance"] for r in v], [r["pair_count"] for r in v])
    return t.spark.createDataFrame([tuple(round(x, 3) for x in fit)], "nugget double, sill double, range double")


@query("agg_cluster_bootstrap")
def _(t):
    e = t("fx_predictions").withColumns({"e": F.abs(col("pred") - col("label")), "cluster": F.floor(col("x") / 2500) * 10 + F.floor(col("y") / 2500)})
    out = M.cluster_bootstrap(e, "cluster", "cls", "e", 200, 11)
    return out.select("cls", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("fn_dirichlet_weights")
def _(t):
    rows = [tuple(round(v, 9) for v in w.values()) for w in M.dirichlet_weights(24, S.WEIGHTS, 50.0)]
    return t.spark.createDataFrame(rows, "w_zone double, w_water double, w_abs double, w_rel double")


@query("P12_surrogate_train_run")
def _(t):
    folded = P.spatial_kfold(points(t), 2000.0, 3, 7)
    r = P.roles(folded, 3).join(points(t).select("id", "px", "py"), "id").withColumn("label", F.sin(col("px") / 2000) + F.cos(col("py") / 2500))
    r = r.select(F.lit(1).alias("seed"), col("k").alias("fold"), "role", "px", "py", "label")
    out = M.train_surrogate(r, M.Normalizer.of(points(t)), [32, 32])
    return out.select("seed", "fold", "n_train", (col("rmse") < col("constant_rmse")).alias("beats_constant"))


@query("coordinate_normalizer", "SELECT id, round((x - (lx + hx) / 2) / (greatest(hx - lx, hy - ly) / 2), 9) AS nx, round((y - (ly + hy) / 2) / (greatest(hx - lx, hy - ly) / 2), 9) AS ny FROM fx_points, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM fx_points)")
def _(t):
    nx, ny = M.Normalizer.of(points(t))(col("px"), col("py"))
    return points(t).select("id", F.round(nx, 9).alias("nx"), F.round(ny, 9).alias("ny"))


# Validation: (check, status, n) by the same conditions in SQL.


def _rule_sql(name: str, table: str, bad: str, level: str = "FAIL") -> str:
    return f"SELECT '{name}' AS \"check\", CASE WHEN count(*) FILTER (WHERE {bad}) > 0 THEN '{level}' ELSE 'PASS' END AS status, count(*) FILTER (WHERE {bad}) AS n FROM {table}"


def _rules(name: str, table: str, id_col: str, rules: list, sql: list[tuple]):
    def run(t):
        return V.violations(t(table), rules(t), id_col).select("check", "status", "n")

    query(name, " UNION ALL ".join(_rule_sql(n, table, bad, *level) for n, bad, *level in sql))(run)


_rules("V_finite", "fx_scoring", "property_id", lambda t: [V.finite("distance_m")], [("distance_m_not_finite", "distance_m IS NULL OR isnan(distance_m) OR isinf(distance_m)")])
_rules("V_nonneg", "fx_scoring", "property_id", lambda t: [V.non_negative("relative_m")], [("relative_m_negative", "relative_m < 0")])
_rules("V_lt_buffer", "fx_scoring", "property_id", lambda t: [V.below("distance_m", 300000.0)], [("distance_m_not_below_limit", "distance_m >= 300000")])
_rules("V_unknown_zone", "fx_scoring", "property_id", lambda t: [V.known_zone("zone", "matched", ["X", "AO", "A", "AE"])], [("unknown_zone", "matched AND zone NOT IN ('X', 'AO', 'A', 'AE')")])
_rules("V_sfha_implies_match", "fx_scoring", "property_id", lambda t: [V.sfha_matched("is_sfha", "matched")], [("sfha_without_match", "is_sfha AND NOT matched")])
_rules("V_range_0_100", "fx_scoring", "property_id", lambda t: [V.in_range("relative_m", 0, 100)], [("relative_m_out_of_range", "NOT relative_m BETWEEN 0 AND 100")])
_rules("V_plausibility", "fx_scoring", "property_id", lambda t: [V.in_range("elevation_m", 70, 400, warn=True)], [("elevation_m_out_of_range", "NOT elevation_m BETWEEN 70 AND 400", "WARN")])
_rules("V_derivation", "fx_predictions", "id", lambda t: [V.derivation("pred", col("label") + (col("id") % 41 - 20), 1e-6)], [("pred_not_reproduced", "abs(pred - (label + (id % 41 - 20))) > 1e-6")])
_rules("V_ids", "lineitem", "l_orderkey", lambda t: V.id_rules("l_orderkey"), [("null_id", "l_orderkey IS NULL"), ("blank_id", "trim(CAST(l_orderkey AS VARCHAR)) = ''"), ("duplicate_id", "l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")])
_rules("V_points", "fx_points", "id", lambda t: [V.finite("x"), V.finite("y"), *V.id_rules("id")], [("x_not_finite", "x IS NULL OR isnan(x) OR isinf(x)"), ("y_not_finite", "y IS NULL OR isnan(y) OR isinf(y)"), ("null_id", "id IS NULL"), ("blank_id", "trim(CAST(id AS VARCHAR)) = ''"), ("duplicate_id", "false")])


@query("V_nulls", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'PASS' ELSE '{'WARN' if c == 'label' else 'FAIL'}' END AS status FROM fx_candidate" for c in ("property_id", "distance_m", "label")))
def _(t):
    return V.null_report(t("fx_candidate"), ["label"])


@query("V_one_crs", "SELECT 'zone_single' AS \"check\", 'FAIL' AS status, count(DISTINCT zone) AS n FROM fx_scoring")
def _(t):
    return V.one_value(t("fx_scoring"), "zone", "X").select("check", "status", "n")


@query("V_sorted", "SELECT id, v, previous FROM (SELECT id, v, lag(v) OVER (ORDER BY id) AS previous FROM fx_points) WHERE v < previous")
def _(t):
    return V.not_sorted(t("fx_points"), "id", "v")


@query("V_ring", "SELECT fid, part_index, ring_index, count(*) AS vertices, arg_min(x, vertex_index) = arg_max(x, vertex_index) AND arg_min(y, vertex_index) = arg_max(y, vertex_index) AS closed, min(vertex_index) = 0 AND max(vertex_index) = count(*) - 1 AS contiguous, min(vertex_index) = 0 AND max(vertex_index) = count(*) - 1 AND count(*) >= 4 AND arg_min(x, vertex_index) = arg_max(x, vertex_index) AND arg_min(y, vertex_index) = arg_max(y, vertex_index) AS ok FROM fx_poly_vertices WHERE vertex_index < 4 OR fid % 40 = 0 GROUP BY 1, 2, 3")
def _(t):
    return V.ring_report(t("fx_poly_vertices").where("vertex_index < 4 or fid % 40 = 0"))


@query("V_reference_alignment", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT property_id FROM fx_candidate)")
def _(t):
    return t("orders").select("o_orderkey").join(t("fx_candidate").select(col("property_id").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("V_constant_counter", "SELECT workload, count(DISTINCT property_count) = 1 AS property_count_consistent, count(DISTINCT seed_window) = 1 AS seed_window_consistent FROM fx_runs GROUP BY workload")
def _(t):
    return V.consistent(t("fx_runs"), ["property_count", "seed_window"], "workload")


@query("unique_id_field", "SELECT 'c_nationkey' AS field, count(*) AS rows, count(c_nationkey) AS present, count(DISTINCT c_nationkey) AS n_distinct, count(*) = count(c_nationkey) AND count(*) = count(DISTINCT c_nationkey) AS usable FROM customer UNION ALL SELECT 'c_custkey', count(*), count(c_custkey), count(DISTINCT c_custkey), count(*) = count(c_custkey) AND count(*) = count(DISTINCT c_custkey) FROM customer")
def _(t):
    return V.unique_id_field(t("customer"), ["OBJECTID", "c_nationkey", "c_custkey"])[1]


@query("V_status_counts", "SELECT status, count(*) AS n FROM (" + _rule_sql("a", "fx_scoring", "relative_m < 0") + " UNION ALL " + _rule_sql("b", "fx_scoring", "distance_m < 0") + ") GROUP BY status")
def _(t):
    return V.status_counts(V.violations(t("fx_scoring"), [V.non_negative("relative_m"), V.non_negative("distance_m")], "property_id"))


@query("expected_digest", "SELECT l.id, l.digest FROM (SELECT id, sha256(cls) AS digest FROM fx_points) l WHERE l.id % 10 = 0")
def _(t):
    d = t("fx_points").select("id", F.sha2("cls", 256).alias("digest"))
    expected = d.withColumn("digest", F.when(col("id") % 10 == 0, F.lit("other")).otherwise(col("digest")))
    return V.digests(d, expected, "id", "digest")


@query("fold_predictions", "SELECT id, count(*) AS times FROM (SELECT id FROM fx_predictions WHERE seed = 1 UNION ALL SELECT id FROM fx_predictions WHERE id % 100 = 1) GROUP BY id HAVING count(*) > 1")
def _(t):
    """Rows that more than one fold predicts: there must be none."""
    p = t("fx_predictions")
    return p.where("seed = 1").select("id").unionByName(p.where("id % 100 = 1").select("id")).groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


@query("prepare_results", "SELECT CAST(o_orderkey AS VARCHAR) AS property_id, upper(trim(o_orderpriority)) AS zone FROM orders WHERE o_orderkey IN (SELECT property_id FROM fx_candidate)")
def _(t):
    """Both sides of a comparison by the same names and forms, kept to what the candidate has."""
    o = t("orders").select(col("o_orderkey").cast("string").alias("property_id"), F.upper(S.normalize_string(col("o_orderpriority"))).alias("zone"))
    return o.join(t("fx_candidate").select(col("property_id").cast("string").alias("property_id")), "property_id", "left_semi")


@query("entry_nearest_exposure", f"SELECT n.id, n.fid, n.distance, n.ties, round(100 * {_rank('-n.distance')} / count(*) OVER (), 6) AS water_percentile FROM ({_nearest_sql(POINTS, SITES)}) n")
def _(t):
    """The flagship: the exact nearest site of each point, and the exposure percentile of its distance."""
    n = G.nearest(points(t), site_segments(t)).withColumn("distance", F.round("distance", 6))
    return n.withColumn("water_percentile", F.round(W.percentile_avg(col("distance"), higher=False), 6))
