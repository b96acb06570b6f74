"""Aggregates: summaries, rank correlation, tails, residual tables, variograms, fits and run statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import lit
from .windows import cut, percentile_avg, quantile_edges, quantiles, rank_average, with_ordinal, with_rank_average

MISSING = "<missing>"


def r9(c: Column) -> Column:
    """Rounded to 9 places: sums taken in another order differ beyond."""
    return F.round(c, 9)


def corr(a: str, b: str) -> Column:
    """Pearson's, null where a side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), lit(0))


def summary(df: DataFrame, value: str, ties: str | None = None, id_col: str = "id") -> DataFrame:
    v = F.col(value)
    out = [F.count("*").alias("n"), F.count_distinct(id_col).alias("n_ids"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.percentile(v, 0.5).alias("median"), F.count_if(v == 0).alias("n_zero")]
    return df.agg(*out, *([F.count_if(F.col(ties) > 1).alias("n_tied")] if ties else []))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")).agg(F.count("*").alias("n"))


def multi_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def numeric_domain(df: DataFrame, c: str) -> DataFrame:
    """Of a text or number column read as numbers; what isn't one counts as null."""
    v = F.col(c).try_cast("double")
    return df.select(v.alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("n_unique"), F.min("v").alias("min"), F.max("v").alias("max"), r9(F.avg("v")).alias("mean"), F.percentile("v", 0.5).alias("median"), F.count_if(F.col("v") == 0).alias("zeros"))


def describe_component(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), r9(F.avg(c)).alias("mean"), F.percentile(c, 0.5).alias("median"), r9(F.stddev_samp(c)).alias("std"), (F.count(c) - F.count_distinct(c)).alias("tied"))


def profile(df: DataFrame) -> DataFrame:
    """(column, nulls, distinct) of every column, in one pass."""
    one = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("n_distinct")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["nulls"].alias("nulls"), F.col(c)["n_distinct"].alias("n_distinct")) for c in df.columns])).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson of the average ranks; null where a side is constant."""
    if by:
        keys = [F.col(k) for k in by]
        ranked = df.withColumns({"ra": rank_average(F.col(a), *keys), "rb": rank_average(F.col(b), *keys)})
    else:
        ranked = with_rank_average(with_rank_average(df.select(a, b), a, "ra"), b, "rb")
    varied = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return ranked.groupBy(*by).agg(F.when(varied, r9(corr("ra", "rb"))).alias("rho"), F.count("*").alias("n"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    ranked = df.select(*columns)
    for c in columns:
        ranked = with_rank_average(ranked, c, f"r_{c}")
    one = ranked.agg(*[r9(corr(f"r_{a}", f"r_{b}")).alias(f"{a}|{b}") for a, b in combinations(columns, 2)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a, b in combinations(columns, 2)])).alias("x")).select("x.*")


def variance_share(df: DataFrame, weights: dict[str, float], index: str) -> DataFrame:
    """cov(w C, I) / var(I), the spread of C and of w C, and the rank correlation, a row a component."""
    ranked = with_rank_average(df.select(index, *weights), index, "__ri")
    for c in weights:
        ranked = with_rank_average(ranked, c, f"__r_{c}")
    var = F.nullif(F.var_samp(index), lit(0))
    parts = [F.struct(F.lit(c).alias("component"), r9(F.covar_samp(lit(w) * F.col(c), index) / var).alias("share"), F.round(F.stddev_samp(c), 5).alias("std"), F.round(F.stddev_samp(lit(w) * F.col(c)), 5).alias("weighted_std"), r9(corr(f"__r_{c}", "__ri")).alias("rho")) for c, w in weights.items()]
    return ranked.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def tail_overlap(df: DataFrame, columns: list[str], fraction: float) -> DataFrame:
    """Pairwise overlap of the rows at or above each column's interpolated quantile."""
    flags = df.select(*[(F.col(c) >= F.lit(quantiles(df, c, [1 - fraction])[0])).alias(c) for c in columns])
    one = flags.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(f"n_{c}") for c in columns], *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in combinations(columns, 2)])

    def row(a: str, b: str) -> Column:
        both, na, nb = F.col(f"{a}|{b}"), F.col(f"n_{a}"), F.col(f"n_{b}")
        inflated = F.greatest(na, nb) > F.ceil(F.lit(fraction) * F.col("rows"))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both.alias("intersection"), (na + nb - both).alias("union"), r9(both / (na + nb - both)).alias("jaccard"), r9(both / F.least(na, nb)).alias("of_smaller"), inflated.alias("tie_inflated"))

    return one.select(F.explode(F.array(*[row(a, b) for a, b in combinations(columns, 2)])).alias("x")).select("x.*")


def score_scenarios(components: DataFrame, weights: DataFrame, id_col: str = "property_id") -> DataFrame:
    """(scenario, id, index, percentile) in long form; the scenario table is broadcast, it has a row a scenario."""
    w = F.broadcast(weights)
    index = F.round(F.col("w_zone") * F.col("c_zone") + F.col("w_water") * F.col("c_water") + F.col("w_abs") * F.col("c_abs") + F.col("w_rel") * F.col("c_rel"), 9)
    long = components.crossJoin(w).select("scenario", "family", id_col, index.alias("index"))
    return long.withColumn("percentile", percentile_avg(F.col("index"), F.col("scenario")))


#: The tails in which rankings are compared, as parts of all rows.
TAILS = (0.10, 0.05)


def _tail_columns(fraction: float) -> list[Column]:
    """Rows strictly above the threshold: of the baseline, the scenario and both, their Jaccard and the part of the smaller."""
    edge, name = lit(100.0 * (1.0 - fraction)), f"top_{round(fraction * 100)}pct"
    a, b = F.col("base") > edge, F.col("percentile") > edge
    na, nb, both = F.count_if(a), F.count_if(b), F.count_if(a & b)
    none = F.lit(0)
    return [na.alias(f"{name}_baseline_count"), nb.alias(f"{name}_scenario_count"), both.alias(f"{name}_retained_count"), r9(both / F.nullif(na + nb - both, none)).alias(f"{name}_jaccard"), r9(both / F.nullif(F.least(na, nb), none)).alias(f"{name}_overlap_of_smaller")]


def scenario_compare(scored: DataFrame, baseline: str = "baseline", tails: tuple[float, ...] = TAILS, id_col: str = "property_id") -> DataFrame:
    """Each scenario against the baseline: rank correlation, shifts of percentiles, and how far the tails agree."""
    b = scored.where(F.col("scenario") == baseline).select(id_col, F.col("percentile").alias("base"))
    j = scored.join(b, id_col).withColumn("shift", F.abs(F.col("percentile") - F.col("base")))
    return j.groupBy("scenario", "family").agg(
        F.when((F.min("percentile") != F.max("percentile")) & (F.min("base") != F.max("base")), r9(corr("percentile", "base"))).alias("rho"),
        r9(F.percentile("shift", 0.5)).alias("median_shift"), r9(F.avg("shift")).alias("mean_shift"), r9(F.percentile("shift", 0.95)).alias("p95_shift"), r9(F.max("shift")).alias("max_shift"),
        F.count_if(F.col("shift") > 10).alias("over_10"), F.count_if(F.col("shift") > 25).alias("over_25"),
        *[c for f in tails for c in _tail_columns(f)],
    )


#: Rank correlation and tail overlap from which an index counts as stable, and as moderately sensitive; and
#: the families of scenarios that someone might choose, to which the verdict looks.
STABLE, MODERATE = (0.95, 0.80), (0.85, 0.60)
PLAUSIBLE = ("baseline", "structured", "perturbation")


def stability_verdict(compared: DataFrame, baseline: str = "baseline") -> DataFrame:
    """The worst plausible scenario decides, by rank correlation and by the part of the smaller top tenth that is kept."""
    rho, tail = F.col("rho"), F.col("top_10pct_overlap_of_smaller")

    def least(c: Column) -> Column:
        return F.min_by("scenario", F.when(c.isNotNull(), F.struct(c, F.col("scenario"))))

    worst = compared.where(F.col("family").isin(*PLAUSIBLE) & (F.col("scenario") != baseline)).agg(F.min(rho).alias("min_rho"), least(rho).alias("rho_scenario"), F.min(tail).alias("min_tail"), least(tail).alias("tail_scenario"))
    meets = lambda t: (F.col("min_rho") >= t[0]) & (F.col("min_tail") >= t[1])
    missing = F.col("min_rho").isNull() | F.col("min_tail").isNull()
    return worst.withColumn("verdict", F.when(missing, F.raise_error(F.lit("no plausible scenario can be measured"))).when(meets(STABLE), "stable").when(meets(MODERATE), "moderately_sensitive").otherwise("highly_sensitive"))


def row_variability(scored: DataFrame, id_col: str = "property_id") -> DataFrame:
    return scored.groupBy(id_col).agg(F.min("percentile").alias("min"), F.max("percentile").alias("max"), r9(F.avg("percentile")).alias("mean"), r9(F.stddev_samp("percentile")).alias("std"), r9(F.max("percentile") - F.min("percentile")).alias("range"))


def ratio_distribution(df: DataFrame, num: str, den: str) -> DataFrame:
    ratio = F.col(num) / F.nullif(F.col(den), F.lit(0).cast(df.schema[den].dataType))
    p = F.percentile(ratio, F.array(*map(F.lit, (0.5, 0.9, 0.99, 0.999))))
    one = df.agg(r9(F.sum(num) / F.sum(den)).alias("of_sums"), F.count_if(F.col(den) == 0).alias("zero_denominators"), r9(F.avg(ratio)).alias("mean"), p.alias("p"), r9(F.max(ratio)).alias("max"))
    return one.select("of_sums", "zero_denominators", "mean", *[r9(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99", "p999"))], "max")


def counter_invariants(df: DataFrame) -> DataFrame:
    """How many rows break what holds of each search's counters, and whether none does.

    The disc of the answer's radius admits no more than the true radius does, that at least one, the inflated disc no
    less than that, and the scan no less than the inflated disc; the uncapped disc, where it was measured at all, no less.
    """
    c = F.col
    broken = {
        "n_disk_r_gt_n_true_r": c("n_disk_r") > c("n_true_r"), "n_true_r_lt_1": c("n_true_r") < 1, "n_true_r_gt_n_disk_infl": c("n_true_r") > c("n_disk_infl"), "n_disk_infl_gt_n_decomp": c("n_disk_infl") > c("entries_scanned"),
    }
    measured = F.max(F.coalesce(c("n_disk_unc"), F.lit(0))) > 0
    one = df.agg(*[F.count_if(x).alias(n) for n, x in broken.items()], F.when(measured, F.count_if(c("n_disk_unc") < c("n_disk_infl"))).alias("n_disk_unc_lt_n_disk_infl"))
    total = sum((c(n) for n in broken), F.coalesce("n_disk_unc_lt_n_disk_infl", F.lit(0)))
    return one.withColumn("ordering_holds", total == 0)


def decile_profile(df: DataFrame, by: str, id_col: str) -> DataFrame:
    """Deciles 1 to 10 by ordinal rank of ``by``, cut at interpolated quantiles of the ranks: sizes, ends, mean counters and three ratios of sums."""
    n = df.count()
    up = F.ceil((F.col("__k") - 1) * 10 / F.lit(max(n - 1, 1)))
    d = with_ordinal(df, by, id_col, "__k").withColumn("decile", F.greatest(F.lit(1), up).cast("int"))
    ratio = lambda a, b: r9(F.sum(a) / F.nullif(F.sum(b), F.lit(0)))
    return d.groupBy("decile").agg(
        F.count("*").alias("n"), F.min(by).alias("min"), F.max(by).alias("max"), *[r9(F.avg(c)).alias(f"mean_{c}") for c in ("n_true_r", "n_disk_infl", "n_disk_unc")],
        ratio("n_disk_infl", "n_true_r").alias("inflation_capped"), ratio("n_disk_unc", "n_true_r").alias("inflation_uncapped"), ratio("entries_scanned", "n_disk_infl").alias("box_vs_disk"),
    )


#: Lower ends of the nine distance bins, in metres; the last is open.
DISTANCE_BINS = [0, 100, 250, 500, 750, 1000, 1500, 2000, 3000]


def _residual_stats(prefix: tuple[Column, ...] = ()) -> list[Column]:
    e = F.col("pred") - F.col("label")
    return [
        F.count("label").alias("n"), r9(F.avg(F.abs(e))).alias("mean_abs"), r9(F.percentile(F.abs(e), 0.5)).alias("median_abs"), r9(F.percentile(F.abs(e), 0.9)).alias("p90_abs"), r9(F.avg(e)).alias("mean_signed"), r9(F.sqrt(F.avg(e * e))).alias("rmse"),
        r9(F.avg(F.when(e < 0, 1.0).when(e >= 0, 0.0))).alias("under_fraction"), r9(F.avg("label")).alias("label_mean"), r9(F.avg("pred")).alias("pred_mean"), r9(F.stddev_pop("label")).alias("label_std"), r9(F.stddev_pop("pred")).alias("pred_std"),
    ]


def bin_residuals(df: DataFrame, by: str = "distance_m", edges: list[float] = DISTANCE_BINS) -> DataFrame:
    """Residual statistics of half-open bins; empty bins keep a row with n = 0."""
    bins = df.sparkSession.createDataFrame([(i, float(a)) for i, a in enumerate(edges)], "bin int, lower_m double")
    # Rows are aggregated first; what is joined to the few bins has a row a bin.
    binned = df.withColumn("bin", cut(F.col(by), edges)).where("bin is not null").groupBy("bin").agg(*_residual_stats())
    return bins.join(F.broadcast(binned), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_decomposition(df: DataFrame, cls: str = "cls") -> DataFrame:
    e2 = (F.col("pred") - F.col("label")) ** 2
    g = df.groupBy(cls).agg(*_residual_stats()[:6], F.sum(e2).alias("sse"))
    w = Window.partitionBy()
    return g.select(cls, "n", "mean_abs", "median_abs", "p90_abs", "mean_signed", "rmse", r9(F.col("n") / F.sum("n").over(w)).alias("row_share"), r9(F.col("sse") / F.sum("sse").over(w)).alias("sse_share"))


def stratified_pivot(df: DataFrame, q: int, edges: list[float], label: str = "label", by: str = "distance_m") -> DataFrame:
    """Mean absolute residual by label quantile (rows) and distance bin (columns b0..)."""
    cuts = quantile_edges(df, label, q)
    stratum = F.greatest(F.size(F.filter("edges", lambda x: x < F.col(label))) - 1, F.lit(0)).cast("int")
    d = df.crossJoin(F.broadcast(cuts)).withColumns({"stratum": stratum, "bin": cut(F.col(by), edges)})
    e = F.abs(F.col("pred") - F.col("label"))
    return d.groupBy("stratum").agg(*[r9(F.avg(F.when(F.col("bin") == i, e))).alias(f"b{i}") for i in range(len(edges))], *[F.count_if(F.col("bin") == i).alias(f"n{i}") for i in range(len(edges))])


def majority(df: DataFrame, c: str, *by: str) -> DataFrame:
    """The commonest value, the least of equally common ones, with its count and share."""
    n = df.groupBy(*by, c).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias("value"), F.max("n").alias("n"), r9(F.max("n") / F.sum("n")).alias("share"))


def competitor_ranking(df: DataFrame, candidates: list[str], target: str, label: str, strata: int = 10, least: int = 30) -> DataFrame:
    """Rank correlation of each candidate with the target: overall, and as the mean over label quantiles weighed by their rows; small ones are skipped.

    Rows without a finite value of a candidate don't count for it; its five-number spread shows whether it could rank at all.
    """
    cuts = quantile_edges(df, label, strata)
    stratum = F.greatest(F.size(F.filter("edges", lambda x: x < F.col(label))) - 1, F.lit(0)).cast("int")
    d = df.crossJoin(F.broadcast(cuts)).withColumn("stratum", stratum).drop("edges")
    out = None
    whole_table = d
    for c in candidates:
        v = F.col(c).cast("double")
        d = whole_table.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        spread = quantiles(d, c, [0.0, 0.25, 0.5, 0.75, 1.0])
        five = [lit(x).alias(n) if x is not None else F.lit(None).cast("double").alias(n) for n, x in zip(("min", "p25", "median", "p75", "max"), spread)]
        whole = spearman(d, c, target).select(F.col("rho").alias("marginal_rho"))
        inside = spearman(d, c, target, "stratum").where((F.col("n") >= least) & F.col("rho").isNotNull())
        within = inside.agg(r9(F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("within_rho"), F.count("*").alias("strata_used"))
        row = whole.crossJoin(within).crossJoin(d.agg(F.count("*").alias("n_finite"))).select(F.lit(c).alias("candidate"), "n_finite", "marginal_rho", "within_rho", "strata_used", *five)
        out = row if out is None else out.unionByName(row)
    return out


def label_recovery(binned: DataFrame) -> DataFrame:
    """Range of the bins' mean predictions over that of their mean labels; needs two occupied bins."""
    b = binned.where("n > 0")
    return b.agg(F.when(F.count("*") >= 2, r9((F.max("pred_mean") - F.min("pred_mean")) / F.nullif(F.max("label_mean") - F.min("label_mean"), lit(0)))).alias("recovery"), F.count("*").alias("occupied"))


def regression_metrics(df: DataFrame, *by: str) -> DataFrame:
    e = F.col("pred") - F.col("label")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), r9(F.sqrt(F.avg(e * e))).alias("rmse"), r9(F.avg(F.abs(e))).alias("mae"), r9(F.max(F.abs(e))).alias("max_abs"),
        r9(1 - F.avg(e * e) / F.nullif(F.var_pop("label"), lit(0))).alias("r2"), r9(F.avg("label")).alias("label_mean"), r9(F.avg("pred")).alias("pred_mean"), r9(F.stddev_pop("label")).alias("label_std"), r9(F.stddev_pop("pred")).alias("pred_std"),
        r9(F.var_pop("pred") / F.nullif(F.var_pop("label"), lit(0))).alias("variance_ratio"),
    )


def gate_report(separations: DataFrame, c: str, criterion: float, blocks: str | None = None) -> DataFrame:
    """Percentiles of separations and whether none is under the criterion; without any, the gate isn't passed.

    ``blocks``: a column of distances in blocks; of those, at most 1 breaks the grid's rule, which is counted beside.
    """
    grid = [F.min(blocks).alias("min_blocks"), F.count_if(F.col(blocks) <= 1).alias("grid_violations")] if blocks else []
    p = F.percentile(c, F.array(*[F.lit(x / 100) for x in (0, 1, 5, 25, 50, 75, 95, 100)]))
    one = separations.agg(F.count("*").alias("n"), F.min(c).alias("min"), p.alias("p"), F.count_if(F.col(c) < criterion).alias("violations"), *grid)
    fraction = r9(F.coalesce(F.col("violations") / F.nullif(F.col("n"), F.lit(0)), lit(0))).alias("violation_fraction")
    return one.select("n", r9(F.col("min")).alias("min"), *[r9(F.col("p")[i]).alias(f"p{x}") for i, x in enumerate((0, 1, 5, 25, 50, 75, 95, 100))], "violations", fraction, *(("min_blocks", "grid_violations") if blocks else ()), ((F.col("n") > 0) & (F.col("violations") == 0)).alias("passed"))


def label_ambiguity(df: DataFrame, label: str, *at: str) -> DataFrame:
    """What no function of the coordinates can fit: rows at one place with different labels."""
    w = Window.partitionBy(*at)
    d = df.withColumns({"r": F.col(label) - F.avg(label).over(w), "k": F.count("*").over(w), "u": F.min(label).over(w) != F.max(label).over(w)})
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("duplicate_rows"), F.count_if("u").alias("ambiguous_rows"), r9(F.avg(F.col("r") * F.col("r"))).alias("irreducible_mse"), r9(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("irreducible_rmse"))


def duplicate_coordinates(df: DataFrame, *at: str) -> DataFrame:
    g = df.groupBy(*at).agg(F.count("*").alias("k"))
    return g.agg(F.sum("k").alias("n"), F.count("*").alias("distinct_pairs"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).cast("long").alias("duplicate_rows"))


def seed_stability(long: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return long.groupBy(metric).agg(F.count("*").alias("seeds"), r9(F.avg(value)).alias("mean"), r9(F.stddev_samp(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), r9(F.max(value) - F.min(value)).alias("range"))


def variogram_bins(pairs: DataFrame, values: DataFrame, width: float, bins: int, value: str = "v") -> DataFrame:
    """Semivariance of each lag bin of pairs (d, v1, v2), over the sill of all values; bins without pairs keep a row."""
    k = F.floor(F.col("d") / lit(width)).cast("int")
    sums = pairs.withColumn("bin", k).where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("pair_count"), F.sum((F.col(f"{value}1") - F.col(f"{value}2")) ** 2).alias("squares"))
    return variogram_of(sums, values, width, bins, value)


def variogram_of(sums: DataFrame, values: DataFrame, width: float, bins: int, value: str = "v") -> DataFrame:
    """The same from each bin's sums (bin, pair_count, squares)."""
    g = sums.where("pair_count > 0").select("bin", "pair_count", (F.col("squares") / 2 / F.col("pair_count")).alias("g"))
    all_bins = sums.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    sill = values.agg(F.var_samp(value).alias("sill"))
    out = F.broadcast(all_bins).join(g, "bin", "left").crossJoin(F.broadcast(sill))
    return out.select("bin", ((F.col("bin") + lit(0.5)) * lit(width)).alias("lag"), F.coalesce("pair_count", F.lit(0).cast("long")).alias("pair_count"), F.round("g", 6).alias("semivariance"), r9(F.col("g") / F.nullif(F.col("sill"), lit(0))).alias("over_sill"))


def first_lag_at(variogram: DataFrame, ratio: float) -> DataFrame:
    return variogram.agg(F.min(F.when((F.col("pair_count") > 0) & (F.col("over_sill") >= ratio), F.col("lag"))).alias("lag"))


def ols_through_origin(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(r9(F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), lit(0))).alias("slope"), F.count("*").alias("n"))


def ols_line(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Slope, intercept and the part of the variation left; null under three points."""
    enough = F.count("*") >= 3
    return df.groupBy(*by).agg(F.when(enough, r9(F.regr_slope(y, x))).alias("slope"), F.when(enough, F.round(F.regr_intercept(y, x), 6)).alias("intercept"), F.when(enough, r9(1 - F.regr_r2(y, x))).alias("residual_fraction"), F.count("*").alias("n"))


#: Fixed value: the median's standard error next to the mean's, for normal spread.
MEDIAN_ERROR = 1.253


def benchmark_cells(runs: DataFrame, keys: list[str], value: str, constant: list[str] = ()) -> DataFrame:
    """Statistics of each cell of runs; ``constant`` counters must not vary within a cell."""
    v = F.col(value)
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.max(v).alias("max"), r9((F.max(v) - F.min(v)) / F.nullif(F.percentile(v, 0.5), lit(0))).alias("spread"), r9(F.stddev_samp(v)).alias("std"),
        r9(lit(MEDIAN_ERROR) * F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("median_standard_error"), *[(F.count_distinct(c) <= 1).alias(f"{c}_constant") for c in constant],
    )


def cap_sweep(cells: DataFrame, key: str, baseline: int) -> DataFrame:
    """Each cap's median over the baseline cap's."""
    b = cells.where(F.col(key) == baseline).select("algorithm", F.col("median").alias("base"))
    return cells.join(F.broadcast(b), "algorithm", "left").select("algorithm", key, "n", "median", r9(F.col("median") / F.nullif(F.col("base"), lit(0))).alias("ratio"))


def memory_table(parts: DataFrame, keys: list[str], value: str, kind: str, baseline: str) -> DataFrame:
    """Sum of the structures' bytes by cell, less the workload's baseline."""
    g = parts.groupBy(*keys, kind).agg(F.sum(value).alias("total"))
    b = g.where(F.col(kind) == baseline).select(*keys, F.col("total").alias("base"))
    return g.join(b, keys, "left").select(*keys, kind, r9(F.col("total")).alias("total"), r9(F.col("total") - F.coalesce("base", lit(0))).alias("over_baseline"))


#: Fixed value: the part of its time that the calibrating algorithm searches, the rest it verifies.
SEARCH_FRACTION = 0.006


def decomposition(cells: DataFrame, on: list[str], anchor: str, time: str, checks: str, fraction: float = SEARCH_FRACTION) -> DataFrame:
    """Time split into verification and search: the anchor's cell of each group gives the cost of a check, all cells are split by it.

    A negative search cost means that the cost can't be applied to that cell: it is given, and marked. Groups without
    the anchor and cells without checks can't be split and are left out. Of two anchors in a group the first by time counts.
    """
    usable = cells.where(F.col(checks) > 0)
    cost = usable.where(F.col("algorithm") == anchor).groupBy(*on).agg(F.min(F.col(time) * lit(1.0 - fraction) / F.col(checks)).alias("per_check"))
    c = usable.join(F.broadcast(cost), on)
    verify = F.col(checks) * F.col("per_check")
    search = F.col(time) - verify
    return c.select(*cells.columns, r9(F.col("per_check")).alias("per_check"), r9(verify).alias("verification"), r9(search).alias("search"), r9(search / F.nullif(F.col(time), lit(0))).alias("search_share"), (search >= 0).alias("physical"))


def timing_result(df: DataFrame, value: str, *by: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), r9(F.avg(v)).alias("mean"), r9(F.stddev_samp(v)).alias("std"), r9((F.max(v) - F.min(v)) / F.nullif(F.percentile(v, 0.5), lit(0))).alias("relative_spread"))


def against_reference(cells: DataFrame, key: str, reference, on: list[str]) -> DataFrame:
    """Each cell's median interval against the reference cell's: ratio and whether it is resolved."""
    from ..functions.scalars import resolved_comparison

    b = cells.where(F.col(key) == reference).select(*on, F.col("median").alias("m0"), F.col("min").alias("lo0"), F.col("max").alias("hi0"))
    j = cells.join(F.broadcast(b), on)
    return j.select(*on, key, r9(F.col("median") / F.nullif(F.col("m0"), lit(0))).alias("ratio"), resolved_comparison(F.col("min"), F.col("max"), F.nullif(F.col("lo0"), lit(0)), F.nullif(F.col("hi0"), lit(0))).alias("verdict"))


def seed_error(df: DataFrame, predicted: str, actual: str, window: int) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    p = F.percentile(F.abs(e), F.array(*map(F.lit, (0.5, 0.9, 0.99, 0.999))))
    one = df.agg(F.count("*").alias("n"), F.count_if(e == 0).alias("exact"), F.count_if(F.abs(e) <= window).alias("within"), r9(F.avg(e)).alias("mean_signed"), r9(F.avg(F.abs(e))).alias("mean_abs"), p.alias("p"), F.max(F.abs(e)).alias("max_abs"))
    return one.select("n", "exact", "within", "mean_signed", "mean_abs", *[r9(F.col("p")[i]).alias(x) for i, x in enumerate(("p50", "p90", "p99", "p999"))], "max_abs")


def residual_table(df: DataFrame) -> DataFrame:
    """Absolute and signed residual of each row, worst first."""
    e = F.col("pred") - F.col("label")
    return df.withColumns({"residual": e, "abs_residual": F.abs(e)}).orderBy(F.desc("abs_residual"), "id")
