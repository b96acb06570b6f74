"""Queries of aggregates, windows and rasters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import aggregates as A, joins as J, raster as R, splits as P, windows as W
from ..operators.evidence import clean_runs, inflation_gate
from .fixtures import SIDE
from .q_basic import POINTS, points
from .q_joins import _NEAREST_SITE, sites
from .registry import query

col = F.col


def grid(t) -> R.Grid:
    """The placement of fx_dem, whose side follows its table."""
    side = t.sql(SIDE).first()[0]
    return R.Grid(0.0, 10100.0, 100.0, 100.0, side, side)


@query("agg_summary_stats", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean, median(o_totalprice) AS median, count(*) FILTER (WHERE o_totalprice = 0) AS n_zero FROM orders")
def _(t):
    return A.summary(t("orders"), "o_totalprice", id_col="o_orderkey")


@query("agg_value_counts", "SELECT coalesce(label, '<missing>') AS value, count(*) AS n FROM fx_candidate GROUP BY 1")
def _(t):
    return A.value_counts(t("fx_candidate"), "label")


@query("agg_multi_key_counts", "SELECT matched, zone, is_sfha, count(*) AS n FROM fx_scoring GROUP BY ALL")
def _(t):
    return A.multi_counts(t("fx_scoring"), "matched", "zone", "is_sfha")


@query("agg_numeric_domain", "SELECT count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls, count(DISTINCT v) AS n_unique, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, median(v) AS median, count(*) FILTER (WHERE v = 0) AS zeros FROM (SELECT TRY_CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS v FROM orders)")
def _(t):
    return A.numeric_domain(t("orders").select(F.when(col("o_orderkey") % 10 == 0, col("o_orderpriority")).otherwise(col("o_custkey").cast("string")).alias("v")), "v")


@query("agg_describe_component", "SELECT count(relative_m) AS n, min(relative_m) AS min, max(relative_m) AS max, round(avg(relative_m), 9) AS mean, median(relative_m) AS median, round(stddev_samp(relative_m), 9) AS std, count(relative_m) - count(DISTINCT relative_m) AS tied FROM fx_scoring")
def _(t):
    return A.describe_component(t("fx_scoring"), "relative_m")


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct FROM fx_candidate" for c in ("property_id", "distance_m", "label")))
def _(t):
    return A.profile(t("fx_candidate"))


def _rank(c: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    comma = f"{by}, " if by else ""
    return f"(rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {comma}{c}) - 1) / CAST(2 AS DOUBLE))"


@query("agg_spearman", f"SELECT round(corr(ra, rb), 9) AS rho, count(*) AS n FROM (SELECT {_rank('distance_m')} AS ra, {_rank('relative_m')} AS rb FROM fx_scoring)")
def _(t):
    return A.spearman(t("fx_scoring"), "distance_m", "relative_m")


_COLS = ["distance_m", "elevation_m", "relative_m"]
_RANKED = "SELECT " + ", ".join(f"{_rank(c)} AS {c}" for c in _COLS) + " FROM fx_scoring"


@query("agg_spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS rho FROM ({_RANKED})" for a, b in combinations(_COLS, 2)))
def _(t):
    return A.spearman_matrix(t("fx_scoring"), _COLS)


_SHARE = "SELECT *, CAST(0.5 AS DOUBLE) * distance_m + CAST(3 AS DOUBLE) * elevation_m + CAST(2 AS DOUBLE) * relative_m AS idx FROM fx_scoring"


@query("agg_variance_share", " UNION ALL ".join(f"SELECT '{c}' AS component, round(covar_samp(CAST({w} AS DOUBLE) * {c}, idx) / var_samp(idx), 9) AS share, round(stddev_samp({c}), 5) AS std, round(stddev_samp(CAST({w} AS DOUBLE) * {c}), 5) AS weighted_std, round(corr(rc, ri), 9) AS rho FROM (SELECT *, {_rank(c)} AS rc, {_rank('idx')} AS ri FROM ({_SHARE}))" for c, w in zip(_COLS, (0.5, 3, 2))))
def _(t):
    df = t("fx_scoring").withColumn("idx", F.lit(0.5) * col("distance_m") + F.lit(3.0) * col("elevation_m") + F.lit(2.0) * col("relative_m"))
    return A.variance_share(df, dict(zip(_COLS, (0.5, 3.0, 2.0))), "idx")


_FLAGS = "SELECT " + ", ".join(f"{c} >= (SELECT quantile_cont({c}, 0.9) FROM fx_scoring) AS {c}" for c in _COLS) + " FROM fx_scoring"


@query("agg_tail_overlap_quantile", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} AND {b}) AS intersection, count(*) FILTER (WHERE {a} OR {b}) AS \"union\", round(count(*) FILTER (WHERE {a} AND {b}) / CAST(count(*) FILTER (WHERE {a} OR {b}) AS DOUBLE), 9) AS jaccard, round(count(*) FILTER (WHERE {a} AND {b}) / CAST(least(count(*) FILTER (WHERE {a}), count(*) FILTER (WHERE {b})) AS DOUBLE), 9) AS of_smaller, greatest(count(*) FILTER (WHERE {a}), count(*) FILTER (WHERE {b})) > ceil(CAST(0.1 AS DOUBLE) * count(*)) AS tie_inflated FROM ({_FLAGS})" for a, b in combinations(_COLS, 2)))
def _(t):
    return A.tail_overlap(t("fx_scoring"), _COLS, 0.1)


@query("agg_ratio_distribution", "SELECT round(sum(n_disk_infl) / CAST(sum(n_disk_r) AS DOUBLE), 9) AS of_sums, count(*) FILTER (WHERE n_disk_r = 0) AS zero_denominators, round(avg(r), 9) AS mean, round(quantile_cont(r, 0.5), 9) AS p50, round(quantile_cont(r, 0.9), 9) AS p90, round(quantile_cont(r, 0.99), 9) AS p99, round(quantile_cont(r, 0.999), 9) AS p999, round(max(r), 9) AS max FROM (SELECT *, n_disk_infl / nullif(CAST(n_disk_r AS DOUBLE), 0) AS r FROM fx_counters)")
def _(t):
    return A.ratio_distribution(t("fx_counters"), "n_disk_infl", "n_disk_r")


@query("P17_hilbert_inflation", "SELECT round(sum(entries_scanned) / CAST(sum(n_disk_infl) AS DOUBLE), 9) AS of_sums, round(quantile_cont(r, 0.99), 9) AS p99, round(max(r), 9) AS max, CASE WHEN quantile_cont(r, 0.99) <= 3 THEN 'disk_predicate_stays_off' ELSE 'enable_disk_predicate' END AS verdict FROM (SELECT *, entries_scanned / nullif(CAST(n_disk_infl AS DOUBLE), 0) AS r FROM fx_counters)")
def _(t):
    return inflation_gate(t("fx_counters"))



_BROKEN = {"n_disk_r_gt_n_true_r": "n_disk_r > n_true_r", "n_true_r_lt_1": "n_true_r < 1", "n_true_r_gt_n_disk_infl": "n_true_r > n_disk_infl", "n_disk_infl_gt_n_decomp": "n_disk_infl > entries_scanned", "n_disk_unc_lt_n_disk_infl": "n_disk_unc < n_disk_infl"}


@query("agg_counter_invariants", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _BROKEN.items()) + f", count(*) FILTER (WHERE {' OR '.join(_BROKEN.values())}) = 0 AS ordering_holds FROM fx_counters")
def _(t):
    return A.counter_invariants(t("fx_counters"))



@query("agg_decile_profile", "SELECT decile, count(*) AS n, min(distance) AS min, max(distance) AS max, " + ", ".join(f"round(avg({c}), 9) AS mean_{c}" for c in ("n_true_r", "n_disk_infl", "n_disk_unc")) + ", " + ", ".join(f"round(sum({x}) / CAST(sum({y}) AS DOUBLE), 9) AS {z}" for x, y, z in (("n_disk_infl", "n_true_r", "inflation_capped"), ("n_disk_unc", "n_true_r", "inflation_uncapped"), ("entries_scanned", "n_disk_infl", "box_vs_disk"))) + " FROM (SELECT *, CAST(greatest(1, (10 * (row_number() OVER (ORDER BY distance, property_id) - 1) + count(*) OVER () - 2) // (count(*) OVER () - 1)) AS INT) AS decile FROM fx_counters) GROUP BY decile")
def _(t):
    return A.decile_profile(t("fx_counters"), "distance", "property_id")



_E = "(pred - label)"
_STATS = f"""count(label) AS n, round(avg(abs{_E}), 9) AS mean_abs, round(median(abs{_E}), 9) AS median_abs, round(quantile_cont(abs{_E}, 0.9), 9) AS p90_abs, round(avg{_E}, 9) AS mean_signed, round(sqrt(avg({_E}*{_E})), 9) AS rmse"""
_MORE = f"""round(avg(CASE WHEN {_E} < 0 THEN CAST(1 AS DOUBLE) WHEN {_E} >= 0 THEN 0 END), 9) AS under_fraction, round(avg(label), 9) AS label_mean, round(avg(pred), 9) AS pred_mean, round(stddev_pop(label), 9) AS label_std, round(stddev_pop(pred), 9) AS pred_std"""
_BIN = "CASE " + " ".join(f"WHEN distance_m >= {e} THEN {i}" for i, e in reversed(list(enumerate(A.DISTANCE_BINS)))) + " END"
_BINNED = f"SELECT b.bin, CAST(b.lower_m AS DOUBLE) AS lower_m, {_STATS}, {_MORE} FROM (VALUES " + ", ".join(f"({i}, {e})" for i, e in enumerate(A.DISTANCE_BINS)) + f") AS b(bin, lower_m) LEFT JOIN (SELECT *, {_BIN} AS k FROM fx_predictions WHERE distance_m NOT BETWEEN 500 AND 750) p ON p.k = b.bin GROUP BY b.bin, b.lower_m"


def binned(t):
    return A.bin_residuals(t("fx_predictions").where(~col("distance_m").between(500, 750)))


@query("agg_bin_residuals", _BINNED)
def _(t):
    return binned(t)


@query("agg_label_recovery", f"SELECT round((max(pred_mean) - min(pred_mean)) / (max(label_mean) - min(label_mean)), 9) AS recovery, count(*) AS occupied FROM ({_BINNED}) WHERE n > 0")
def _(t):
    return A.label_recovery(binned(t))


_CLASSES = f"SELECT cls, {_STATS}, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS row_share, round(sum({_E}*{_E}) / sum(sum({_E}*{_E})) OVER (), 9) AS sse_share FROM fx_predictions GROUP BY cls"


@query("agg_class_decomposition", _CLASSES)
def _(t):
    return A.class_decomposition(t("fx_predictions"))


_EDGES = "[quantile_cont(label, 0), quantile_cont(label, 0.25), quantile_cont(label, 0.5), quantile_cont(label, 0.75), quantile_cont(label, 1)]"
_STRATUM = "CAST(greatest(len(list_filter(edges, lambda e: e < label)) - 1, 0) AS INT)"


@query("agg_stratified_pivot", "SELECT stratum, " + ", ".join(f"round(avg(abs{_E}) FILTER (WHERE k = {i}), 9) AS b{i}, count(*) FILTER (WHERE k = {i}) AS n{i}" for i in range(3)) + f" FROM (SELECT *, {_STRATUM} AS stratum, CASE WHEN distance_m >= 2000 THEN 2 WHEN distance_m >= 500 THEN 1 WHEN distance_m >= 0 THEN 0 END AS k FROM fx_predictions, (SELECT {_EDGES} AS edges FROM fx_predictions)) GROUP BY stratum")
def _(t):
    return A.stratified_pivot(t("fx_predictions"), 4, [0, 500, 2000])


@query("agg_majority_class", "SELECT c_mktsegment AS value, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, value LIMIT 1")
def _(t):
    return A.majority(t("customer"), "c_mktsegment")


def _competitor(c: str) -> str:
    inside = f"SELECT stratum, corr(ra, rb) AS rho, count(*) AS n FROM (SELECT stratum, {_rank(c, 'stratum')} AS ra, {_rank('pred', 'stratum')} AS rb FROM s WHERE {c} IS NOT NULL) GROUP BY stratum HAVING count(*) >= 30"
    five = ", ".join(f"(SELECT quantile_cont({c}, {q}) FROM s) AS {n}" for q, n in ((0, "min"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (1, "max")))
    return f"SELECT '{c}' AS candidate, (SELECT count({c}) FROM s) AS n_finite, (SELECT round(corr(ra, rb), 9) FROM (SELECT {_rank(c)} AS ra, {_rank('pred')} AS rb FROM s WHERE {c} IS NOT NULL)) AS marginal_rho, round(sum(round(rho, 9) * n) / sum(n), 9) AS within_rho, count(*) AS strata_used, {five} FROM ({inside})"


_RANKING = "SELECT * EXCLUDE (distance_m), CASE WHEN distance_m < 4900 THEN distance_m END AS distance_m FROM fx_predictions"
_RANKED = f"WITH s AS (SELECT *, {_STRATUM} AS stratum FROM ({_RANKING}), (SELECT {_EDGES} AS edges FROM fx_predictions)) " + _competitor("distance_m") + " UNION ALL " + _competitor("x")


@query("agg_competitor_ranking", _RANKED)
def _(t):
    """Some distances are infinite: those rows don't count for that candidate."""
    d = t("fx_predictions").withColumn("distance_m", F.when(col("distance_m") < 4900, col("distance_m")).otherwise(float("inf")))
    return A.competitor_ranking(d, ["distance_m", "x"], "pred", "label", strata=4)


_METRICS = f"count(*) AS n, round(sqrt(avg({_E}*{_E})), 9) AS rmse, round(avg(abs{_E}), 9) AS mae, round(max(abs{_E}), 9) AS max_abs, round(1 - avg({_E}*{_E}) / var_pop(label), 9) AS r2, round(avg(label), 9) AS label_mean, round(avg(pred), 9) AS pred_mean, round(stddev_pop(label), 9) AS label_std, round(stddev_pop(pred), 9) AS pred_std, round(var_pop(pred) / var_pop(label), 9) AS variance_ratio"


@query("agg_regression_metrics", f"SELECT seed, {_METRICS} FROM fx_predictions GROUP BY seed")
def _(t):
    return A.regression_metrics(t("fx_predictions"), "seed")


@query("agg_nn_baseline_metrics", f"SELECT {_METRICS}, round(avg(distance), 6) AS mean_distance FROM (SELECT n.distance, n.sv AS pred, p.v AS label FROM ({_NEAREST_SITE.format(p=POINTS)}) n JOIN fx_points p ON n.id = p.id)")
def _(t):
    n = J.nearest_point(points(t), sites(t), carry=("sv",)).join(t("fx_points").select("id", col("v").alias("label")), "id").withColumnRenamed("sv", "pred")
    return A.regression_metrics(n).crossJoin(n.agg(F.round(F.avg(F.round("distance", 6)), 6).alias("mean_distance")))


_GATE = f"SELECT n.distance, p.x, greatest(abs(floor(p.x / 500) - floor(s.sx / 500)), abs(floor(p.y / 500) - floor(s.sy / 500))) AS blocks FROM ({_NEAREST_SITE.format(p=POINTS)}) n JOIN fx_points p ON n.id = p.id JOIN fx_sites s ON n.sid = s.sid"


@query("agg_gate_report", "SELECT count(*) AS n, round(min(distance), 9) AS min, " + ", ".join(f"round(quantile_cont(distance, {q / 100}), 9) AS p{q}" for q in (0, 1, 5, 25, 50, 75, 95, 100)) + f", count(*) FILTER (WHERE distance < 50) AS violations, round(count(*) FILTER (WHERE distance < 50) / CAST(count(*) AS DOUBLE), 9) AS violation_fraction, CAST(min(blocks) AS BIGINT) AS min_blocks, count(*) FILTER (WHERE blocks <= 1) AS grid_violations, count(*) > 0 AND count(*) FILTER (WHERE distance < 50) = 0 AS passed FROM ({_GATE})")
def _(t):
    n = J.nearest_point(points(t), sites(t), carry=("sx", "sy")).join(t("fx_points").select("id", "x", "y"), "id")
    gap = [F.abs(F.floor(col(a) / 500) - F.floor(col(b) / 500)) for a, b in (("x", "sx"), ("y", "sy"))]
    return A.gate_report(n.select(F.round("distance", 6).alias("distance"), F.greatest(*gap).cast("long").alias("blocks")), "distance", 50.0, "blocks")


_AMB = "SELECT o_totalprice / CAST(100000 AS DOUBLE) AS label, o_custkey AS x, o_orderpriority AS y FROM orders"


@query("agg_label_ambiguity", f"SELECT count(*) AS n, count(*) FILTER (WHERE k > 1) AS duplicate_rows, count(*) FILTER (WHERE u) AS ambiguous_rows, round(avg(r*r), 9) AS irreducible_mse, round(sqrt(avg(r*r)), 9) AS irreducible_rmse FROM (SELECT label - avg(label) OVER w AS r, count(*) OVER w AS k, min(label) OVER w <> max(label) OVER w AS u FROM ({_AMB}) WINDOW w AS (PARTITION BY x, y))")
def _(t):
    return A.label_ambiguity(t("orders").select((col("o_totalprice") / 100000.0).alias("label"), col("o_custkey").alias("x"), col("o_orderpriority").alias("y")), "label", "x", "y")


@query("agg_duplicate_coords", f"SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS distinct_pairs, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS duplicate_rows FROM (SELECT x, y, count(*) AS k FROM ({_AMB}) GROUP BY x, y)")
def _(t):
    return A.duplicate_coordinates(t("orders").select(col("o_custkey").alias("x"), col("o_orderpriority").alias("y")), "x", "y")


_SEEDS = f"SELECT seed, unnest(['rmse', 'mae']) AS metric, unnest([sqrt(avg({_E}*{_E})), avg(abs{_E})]) AS value FROM fx_predictions GROUP BY seed"


@query("agg_seed_stability", f"SELECT metric, count(*) AS seeds, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(min(value), 9) AS min, round(max(value), 9) AS max, round(max(value) - min(value), 9) AS range FROM ({_SEEDS}) GROUP BY metric")
def _(t):
    e = col("pred") - col("label")
    m = t("fx_predictions").groupBy("seed").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return A.seed_stability(m.unpivot("seed", ["rmse", "mae"], "metric", "value")).withColumns({c: F.round(c, 9) for c in ("min", "max")})


_P = f"SELECT sqrt((p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py)) AS d, p.v AS v1, q.v AS v2 FROM {POINTS} p JOIN {POINTS} q ON p.id < q.id"
_VARIOGRAM = f"""SELECT b.bin, (b.bin + CAST(0.5 AS DOUBLE)) * 60 AS lag, coalesce(g.k, 0) AS pair_count, round(g.g, 6) AS semivariance, round(g.g / s.sill, 9) AS over_sill
FROM (SELECT CAST(unnest(range(10)) AS INT) AS bin) b LEFT JOIN (SELECT CAST(floor(d / 60) AS INT) AS bin, count(*) AS k, sum((v1-v2)*(v1-v2)) / 2 / count(*) AS g FROM ({_P}) WHERE d < 600 GROUP BY 1) g ON b.bin = g.bin, (SELECT var_samp(v) AS sill FROM fx_points) s"""


def variogram(t):
    return A.variogram_of(J.lag_sums(points(t), 60.0, 10), t("fx_points"), 60.0, 10)


@query("agg_variogram_bins", _VARIOGRAM)
def _(t):
    return variogram(t)


@query("agg_first_lag_at_ratio", f"SELECT min(lag) FILTER (WHERE pair_count > 0 AND over_sill >= 0.95) AS lag FROM ({_VARIOGRAM})")
def _(t):
    return A.first_lag_at(variogram(t), 0.95)


@query("agg_ols_through_origin", "SELECT workload, round(sum(seed_window * computation_seconds) / nullif(CAST(sum(seed_window * seed_window) AS DOUBLE), 0), 9) AS slope, count(*) AS n FROM fx_runs GROUP BY workload")
def _(t):
    return A.ols_through_origin(t("fx_runs"), "seed_window", "computation_seconds", "workload")


@query("agg_ols_line", "SELECT workload, round(regr_slope(computation_seconds, seed_window), 9) AS slope, round(regr_intercept(computation_seconds, seed_window), 6) AS intercept, round(1 - regr_r2(computation_seconds, seed_window), 9) AS residual_fraction, count(*) AS n FROM fx_runs GROUP BY workload")
def _(t):
    return A.ols_line(t("fx_runs"), "seed_window", "computation_seconds", "workload")


def _cells(keys: str) -> str:
    return f"SELECT {keys}, count(*) AS n, min(computation_seconds) AS min, median(computation_seconds) AS median, max(computation_seconds) AS max, round((max(computation_seconds) - min(computation_seconds)) / median(computation_seconds), 9) AS spread, round(stddev_samp(computation_seconds), 9) AS std, round(CAST(1.253 AS DOUBLE) * stddev_samp(computation_seconds) / sqrt(count(*)), 9) AS median_standard_error FROM fx_runs GROUP BY {keys}"


@query("agg_benchmark_cells", f"SELECT *, true AS property_count_constant FROM ({_cells('workload, algorithm, seed_window')})")
def _(t):
    return A.benchmark_cells(t("fx_runs"), ["workload", "algorithm", "seed_window"], "computation_seconds", ["property_count"])


@query("agg_cap_sweep", f"SELECT c.algorithm, c.seed_window, c.n, c.median, round(c.median / b.median, 9) AS ratio FROM ({_cells('algorithm, seed_window')}) c LEFT JOIN ({_cells('algorithm, seed_window')}) b ON c.algorithm = b.algorithm AND b.seed_window = 0")
def _(t):
    return A.cap_sweep(A.benchmark_cells(t("fx_runs"), ["algorithm", "seed_window"], "computation_seconds"), "seed_window", 0)


@query("agg_memory_table", "SELECT g.workload, g.algorithm, round(g.total, 9) AS total, round(g.total - coalesce(b.total, 0), 9) AS over_baseline FROM (SELECT workload, algorithm, sum(computation_seconds) AS total FROM fx_runs GROUP BY ALL) g LEFT JOIN (SELECT workload, sum(computation_seconds) AS total FROM fx_runs WHERE algorithm = 'hilbert_binary' GROUP BY ALL) b ON g.workload = b.workload")
def _(t):
    return A.memory_table(t("fx_runs"), ["workload"], "computation_seconds", "algorithm", "hilbert_binary")


@query("agg_decomposition", f"WITH c AS (SELECT workload, algorithm, median, n AS checks FROM ({_cells('workload, algorithm')})), a AS (SELECT workload, median * (1.0 - CAST(0.006 AS DOUBLE)) / checks AS k FROM c WHERE algorithm = 'hilbert_binary') SELECT c.workload, c.algorithm, c.median, c.checks, round(k, 9) AS per_check, round(checks * k, 9) AS verification, round(median - checks * k, 9) AS search, round((median - checks * k) / median, 9) AS search_share, median - checks * k >= 0 AS physical FROM c JOIN a ON c.workload = a.workload")
def _(t):
    cells = A.benchmark_cells(t("fx_runs"), ["workload", "algorithm"], "computation_seconds").select("workload", "algorithm", "median", col("n").alias("checks"))
    return A.decomposition(cells, ["workload"], "hilbert_binary", "median", "checks")



@query("timing_result_stats", "SELECT algorithm, median(computation_seconds) AS median, min(computation_seconds) AS min, max(computation_seconds) AS max, round(avg(computation_seconds), 9) AS mean, round(stddev_samp(computation_seconds), 9) AS std, round((max(computation_seconds) - min(computation_seconds)) / median(computation_seconds), 9) AS relative_spread FROM fx_runs GROUP BY algorithm")
def _(t):
    return A.timing_result(t("fx_runs"), "computation_seconds", "algorithm")


_VERDICT = "CASE WHEN {a}.min / nullif({b}.max, 0) > 1 THEN 'A SLOWER' WHEN {a}.max / nullif({b}.min, 0) < 1 THEN 'A FASTER' ELSE 'NOT RESOLVED' END"


@query("batch_tables", f"SELECT c.algorithm, c.seed_window, round(c.median / b.median, 9) AS ratio, {_VERDICT.format(a='c', b='b')} AS verdict FROM ({_cells('algorithm, seed_window')}) c JOIN ({_cells('algorithm, seed_window')}) b ON c.algorithm = b.algorithm AND b.seed_window = 2")
def _(t):
    return A.against_reference(A.benchmark_cells(t("fx_runs"), ["algorithm", "seed_window"], "computation_seconds"), "seed_window", 2, ["algorithm"])


@query("agg_load_runs", "SELECT workload, mode, count(*) AS n FROM (SELECT workload, CASE WHEN seed_window = 1 THEN 'split' ELSE 'original' END AS mode FROM fx_runs WHERE NOT seed_window = 0) GROUP BY ALL")
def _(t):
    runs = t("fx_runs").withColumns({"warmup": col("seed_window") == 0, "mode": F.when(col("seed_window") == 1, "split").when(col("seed_window") == 2, " ")})
    return clean_runs(runs).groupBy("workload", "mode").agg(F.count("*").alias("n"))


@query("agg_query_stats_merge", "SELECT workload, round(a, 9) AS a, round(b, 9) AS b, abs(a - b) <= 1e-6 AS agree FROM (SELECT workload, sum(computation_seconds) AS a, sum(computation_seconds) + CASE workload WHEN 'A' THEN 1 ELSE 0 END AS b FROM fx_runs GROUP BY workload)")
def _(t):
    a = t("fx_runs").groupBy("workload").agg(F.sum("computation_seconds").alias("a"))
    b = a.select("workload", (col("a") + F.when(col("workload") == "A", 1).otherwise(0)).alias("b"))
    return a.join(b, "workload").select("workload", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), (F.abs(col("a") - col("b")) <= 1e-6).alias("agree"))


@query("agg_query_stats", "SELECT count(*) AS n, CAST(sum(entries_scanned) AS BIGINT) AS entries, round(avg(CASE WHEN seed_probes > 50 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS window_missed, round(avg(distance), 6) AS mean_distance, max(distance) AS max_distance FROM fx_counters")
def _(t):
    return t("fx_counters").agg(F.count("*").alias("n"), F.sum("entries_scanned").alias("entries"), F.round(F.avg(F.when(col("seed_probes") > 50, 1.0).otherwise(0.0)), 9).alias("window_missed"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.max("distance").alias("max_distance"))


@query("agg_seed_error", "SELECT count(*) AS n, count(*) FILTER (WHERE e = 0) AS exact, count(*) FILTER (WHERE abs(e) <= 8) AS within, round(avg(e), 9) AS mean_signed, round(avg(abs(e)), 9) AS mean_abs, round(quantile_cont(abs(e), 0.5), 9) AS p50, round(quantile_cont(abs(e), 0.9), 9) AS p90, round(quantile_cont(abs(e), 0.99), 9) AS p99, round(quantile_cont(abs(e), 0.999), 9) AS p999, max(abs(e)) AS max_abs FROM (SELECT seed_probes - n_disk_r AS e FROM fx_counters)")
def _(t):
    return A.seed_error(t("fx_counters"), "seed_probes", "n_disk_r", 8)


@query("W1_win_percentile_avg", f"SELECT property_id, round(100 * {_rank('relative_m')} / count(*) OVER (), 9) AS pct FROM fx_scoring")
def _(t):
    return t("fx_scoring").select("property_id", F.round(W.percentile_avg(col("relative_m")), 9).alias("pct"))


@query("W1_win_percentile_scalable", f"SELECT property_id, round(100 * {_rank('-relative_m')} / count(*) OVER (), 9) AS pct FROM fx_scoring")
def _(t):
    """By range partitions and offsets, without one task that sorts all."""
    return W.with_percentile(t("fx_scoring").select("property_id", "relative_m"), "relative_m", "pct", higher=False, scale=True).select("property_id", F.round("pct", 9).alias("pct"))


@query("W2_win_rank_average", f"SELECT property_id, {_rank('relative_m')} AS r FROM fx_scoring")
def _(t):
    return W.with_rank_average(t("fx_scoring").select("property_id", "relative_m"), "relative_m", "r", scale=True).select("property_id", "r")


@query("W3_win_rank_first", "SELECT property_id, row_number() OVER (ORDER BY relative_m, property_id) AS r FROM fx_scoring")
def _(t):
    return W.with_ordinal(t("fx_scoring").select("property_id", "relative_m"), "relative_m", "property_id", "r", scale=True).select("property_id", "r")


@query("W4_win_qcut", f"SELECT id, {_STRATUM} AS bin FROM fx_predictions, (SELECT {_EDGES} AS edges FROM fx_predictions)")
def _(t):
    return W.qcut(t("fx_predictions").select("id", "label"), "label", 4, "bin").select("id", "bin")


@query("W5_win_cut", f"SELECT id, {_BIN} AS bin FROM fx_predictions")
def _(t):
    return t("fx_predictions").select("id", W.cut(col("distance_m"), A.DISTANCE_BINS).alias("bin"))


@query("W6_win_lead_segment", "SELECT fid, seg, ax, ay, bx, by FROM (SELECT fid, vertex_index AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM fx_line_vertices WINDOW w AS (PARTITION BY fid, part_index, ring_index ORDER BY vertex_index)) WHERE bx IS NOT NULL")
def _(t):
    return W.segments(t("fx_line_vertices")).select("fid", "seg", "ax", "ay", "bx", "by")


@query("W7_win_contiguity", "SELECT fid, part_index, ring_index, count(*) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY fid, part_index, ring_index ORDER BY vertex_index) - 1 AS k FROM fx_line_vertices WHERE vertex_index <> 2 OR fid % 3 <> 0) WHERE k <> vertex_index GROUP BY 1, 2, 3")
def _(t):
    return W.not_contiguous(t("fx_line_vertices").where("vertex_index <> 2 or fid % 3 <> 0"))


@query("W8_win_duplicate_mask", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", W.duplicated("l_orderkey", "l_linenumber").alias("dup"))


@query("W9_win_group_residual", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS r FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.round(W.group_residual("o_totalprice", "o_custkey"), 6).alias("r"))


_Z = "CASE WHEN z <> -9999 THEN z END"


@query("W10_win_focal_mean", f"SELECT a.cell_row, a.cell_col, round(avg({_Z.replace('z', 'b.z')}), 9) AS local_mean FROM fx_dem a JOIN fx_dem b ON b.cell_row BETWEEN a.cell_row - 2 AND a.cell_row + 2 AND b.cell_col BETWEEN a.cell_col - 2 AND a.cell_col + 2 GROUP BY ALL")
def _(t):
    return R.focal_mean(t("fx_dem"), grid(t), 2).select("cell_row", "cell_col", F.round("local_mean", 9).alias("local_mean"))


_N = {(i, j): f"max(CASE WHEN b.cell_row = a.cell_row + {i} AND b.cell_col = a.cell_col + {j} THEN b.z END)" for i in (-1, 0, 1) for j in (-1, 0, 1)}
_DX = f"(({_N[-1, 1]} + 2*{_N[0, 1]} + {_N[1, 1]}) - ({_N[-1, -1]} + 2*{_N[0, -1]} + {_N[1, -1]})) / CAST(800 AS DOUBLE)"
_DY = f"(({_N[1, -1]} + 2*{_N[1, 0]} + {_N[1, 1]}) - ({_N[-1, -1]} + 2*{_N[-1, 0]} + {_N[-1, 1]})) / CAST(800 AS DOUBLE)"
_SLOPE = f"SELECT a.cell_row, a.cell_col, round(CASE WHEN count(*) FILTER (WHERE b.z <> -9999) = 9 THEN degrees(atan(sqrt(({_DX})*({_DX}) + ({_DY})*({_DY})))) END, 9) AS slope FROM fx_dem a JOIN fx_dem b ON b.cell_row BETWEEN a.cell_row - 1 AND a.cell_row + 1 AND b.cell_col BETWEEN a.cell_col - 1 AND a.cell_col + 1 GROUP BY a.cell_row, a.cell_col"


@query("W11_win_focal_slope", _SLOPE)
def _(t):
    return R.slope(t("fx_dem"), grid(t)).select("cell_row", "cell_col", F.round("slope", 9).alias("slope"))


@query("W12_win_lower_bound", "SELECT o_custkey, min(pos) AS pos, count(*) AS run FROM (SELECT o_custkey, rank() OVER (ORDER BY o_custkey) - 1 AS pos FROM orders) GROUP BY o_custkey")
def _(t):
    from ..operators.learned import positions

    return positions(t("orders").select("o_custkey"), "o_custkey").select("o_custkey", col("pos").cast("long").alias("pos"), "run")


@query("W13_win_schedule_rotation", "SELECT r.k AS repetition, CAST(p.k AS INT) AS position, (p.k + r.k) % 5 AS cell FROM (SELECT unnest(range(7)) AS k) r, (SELECT unnest(range(5)) AS k) p")
def _(t):
    return W.schedule(t.spark, 5, 7)


@query("raster_reproject", "SELECT t.r AS cell_row, t.c AS cell_col, coalesce(d.z, -9999) AS z FROM (SELECT a.k AS r, b.k AS c FROM (SELECT unnest(range(50)) AS k) a, (SELECT unnest(range(50)) AS k) b) t LEFT JOIN fx_dem d ON d.cell_row = CAST(floor((10100 - (10000 - (t.r + 0.5) * 150)) / 100) AS BIGINT) AND d.cell_col = CAST(floor((50 + (t.c + 0.5) * 150) / 100) AS BIGINT)")
def _(t):
    target = R.Grid(50.0, 10000.0, 150.0, 150.0, 50, 50)
    return R.resample_nearest(t("fx_dem"), grid(t), target, lambda x, y: (x, y))


@query("blocks_per_fold", "SELECT CAST(fold AS INT) AS fold, count(DISTINCT (i, j)) AS blocks, count(*) AS rows FROM (SELECT i, j, CAST('0x' || substr(md5(concat_ws(':', 7, i, j)), 1, 13) AS BIGINT) % 5 AS fold FROM (SELECT CAST(floor(x/800) AS BIGINT) AS i, CAST(floor(y/800) AS BIGINT) AS j FROM fx_points)) GROUP BY fold")
def _(t):
    return P.blocks_per_fold(P.spatial_kfold(points(t), 800.0, 5, 7))
