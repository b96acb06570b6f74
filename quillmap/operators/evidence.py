"""The composite products: exposure index, evidence integration, sensitivity, audits, verdicts and run analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import WEIGHTS, composite, lit, zone_score
from . import aggregates as agg
from . import joins
from .models import check_weights
from .validation import FAIL, PASS, Rule, enforce, finite, in_range, known_zone, non_negative, require_columns, roll_up, sfha_matched, violations
from .windows import GLOBAL_RANK_ROWS, percentile_avg, with_percentile

POLICY = "1.0"
INPUT = ["property_id", "matched", "is_sfha", "zone", "distance_m", "elevation_m", "relative_m"]
INDEX = ["property_id", "c_zone", "c_water", "c_abs", "c_rel", "exposure_index", "exposure_percentile", "policy"]

#: Component scorers by name; a caller may add its own.
SCORERS: dict[str, Callable[[], Column]] = {
    "c_zone": lambda: zone_score(F.col("zone"), F.col("matched")),
    "c_water": lambda: percentile_avg(F.col("distance_m"), higher=False),
    "c_abs": lambda: percentile_avg(F.col("elevation_m"), higher=False),
    "c_rel": lambda: percentile_avg(F.col("relative_m"), higher=False),
}
_RANKED = {"c_water": "distance_m", "c_abs": "elevation_m", "c_rel": "relative_m"}


def scoring_rules() -> list[Rule]:
    return [finite("distance_m"), non_negative("distance_m"), finite("elevation_m"), finite("relative_m"), known_zone("zone", "matched", ["X", "AO", "A", "AE", "VE"]), sfha_matched("is_sfha", "matched")]


def component_scores(df: DataFrame, scale: bool | None = None) -> DataFrame:
    """The four components; a large table is ranked by range parts in place of one sorted task a component."""
    if not (df.count() > GLOBAL_RANK_ROWS if scale is None else scale):
        return df.withColumns({n: f() for n, f in SCORERS.items()})
    out = df.withColumn("c_zone", SCORERS["c_zone"]())
    for name, source in _RANKED.items():
        out = with_percentile(out, source, name, higher=False, scale=True)
    return out


def exposure_index(df: DataFrame, weights: dict[str, float] | None = None, validate: bool = True, scale: bool | None = None) -> DataFrame:
    """Score, weigh, round and rank. ``validate`` costs one action; without it an unknown zone still raises as it is met."""
    weights = check_weights(weights or WEIGHTS, set(WEIGHTS))
    require_columns(df, INPUT)
    if validate:
        enforce(df, scoring_rules(), "property_id")
    c = component_scores(df, scale).withColumn("exposure_index", composite(F.col("c_zone"), F.col("c_water"), F.col("c_abs"), F.col("c_rel"), weights))
    c = with_percentile(c, "exposure_index", "exposure_percentile", scale=scale)
    return c.select("property_id", "c_zone", "c_water", "c_abs", "c_rel", "exposure_index", "exposure_percentile", F.lit(POLICY).alias("policy"))


def property_evidence(points: DataFrame, membership: DataFrame, nearest: DataFrame, tolerance: float = 1e-7, check: bool = True) -> DataFrame:
    """One row a property from three tables with the same ids; coordinates that the tables repeat may drift by ``tolerance`` at most."""
    out = joins.one_to_one(joins.one_to_one(points, membership, "property_id", check), nearest, "property_id", check)
    if check and {"lon", "lat", "lon_seen", "lat_seen"} <= set(out.columns):
        out = enforce(out, [Rule("coordinate_drift", (F.abs(F.col("lon") - F.col("lon_seen")) > tolerance) | (F.abs(F.col("lat") - F.col("lat_seen")) > tolerance))], "property_id")
    return out


def property_trace(index: DataFrame, components: DataFrame, property_id, tolerance: float = 1e-6) -> DataFrame:
    """(component, score, weight, contribution) of one property, and whether they add up to its stored index."""
    row = index.where(F.col("property_id") == property_id).select("property_id", "exposure_index").join(components, "property_id")
    names = {"c_zone": "zone", "c_water": "water", "c_abs": "terrain_absolute", "c_rel": "terrain_relative"}
    total = sum((lit(WEIGHTS[w]) * F.col(c) for c, w in names.items()), lit(0))
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("score"), lit(WEIGHTS[w]).alias("weight"), F.round(lit(WEIGHTS[w]) * F.col(c), 9).alias("contribution")) for c, w in names.items()])
    return row.select("property_id", (F.abs(total - F.col("exposure_index")) <= tolerance).alias("adds_up"), F.explode(parts).alias("p")).select("property_id", "adds_up", "p.*")


def shortlist(index: DataFrame, floor: float, k: int, name: str | None = None) -> DataFrame:
    """The k highest percentiles at or above the floor, ties by id; rows with a blank name are left out."""
    out = index.where(F.col("exposure_percentile") >= floor)
    if name:
        out = out.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    return out.orderBy(F.desc("exposure_percentile"), "property_id").limit(k)


def sensitivity(df: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, compared, verdict): components are made once and crossed with the scenarios."""
    scored = agg.score_scenarios(component_scores(df).select("property_id", "c_zone", "c_water", "c_abs", "c_rel"), weights)
    compared = agg.scenario_compare(scored)
    return scored, compared, agg.stability_verdict(compared)


def audit(index: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, roll-up) of an index against its inputs: ranges, derivations, plausibility, population."""
    again = component_scores(source).withColumn("__again", composite(F.col("c_zone"), F.col("c_water"), F.col("c_abs"), F.col("c_rel"))).select("property_id", "__again", "elevation_m")
    j = index.join(again, "property_id", "left")
    rules = [
        *[in_range(c, 0.0, 100.0) for c in ("c_zone", "c_water", "c_abs", "c_rel", "exposure_index", "exposure_percentile")], Rule("index_not_reproduced", F.coalesce(F.abs(F.col("exposure_index") - F.col("__again")) > 1e-6, F.lit(True))),
        Rule("elevation_plausible", ~F.col("elevation_m").between(70, 400), warn=True),
    ]
    checks = violations(j, rules, "property_id")
    lost = joins.set_difference(source, index, "property_id").select(F.concat(F.lit("population_"), F.col("side")).alias("check"), F.when(F.col("n") == 0, PASS).otherwise(FAIL).alias("status"), "n", F.transform("examples", lambda x: x.cast("string")).alias("examples"))
    checks = checks.unionByName(lost)
    return checks, roll_up(checks)


def supervised_dataset(labels: DataFrame, coordinates: DataFrame, check: bool = True) -> DataFrame:
    """(id, px, py, label): labels joined one to one to coordinates, in id order."""
    return joins.one_to_one(labels, coordinates, "id", check).select("id", "px", "py", "label").orderBy("id")


#: Fixed value: the rank correlation from which a candidate counts as an effect.
RHO_FLOOR = 0.10


def prediction_verdict(classes: DataFrame, bins: DataFrame, ranking: DataFrame, majority, boundary: str, cls: str = "cls", floor: float = RHO_FLOOR) -> DataFrame:
    """Three clauses decided apart, and their conjunction.

    ``class_effect``: the minority classes' rmse is above the majority's and their share of the squared error above their
    share of rows. ``proximity_effect``: of all candidates, by the size of their correlation within labels, the boundary
    distance is the strongest, negative, and at least the floor. ``small_elsewhere``: the open far bin's mean error isn't
    above the least of the inner bins; ``bins`` are those of the majority class. No majority or no minority is an error.
    """
    rest = F.col(cls) != F.lit(majority)
    sse = F.col("rmse") * F.col("rmse") * F.col("n")
    a = classes.agg(
        F.sqrt(F.sum(F.when(rest, sse)) / F.sum(F.when(rest, F.col("n")))).alias("minority_rmse"), F.max(F.when(~rest, F.col("rmse"))).alias("majority_rmse"),
        F.sum(F.when(rest, F.col("row_share"))).alias("minority_row_share"), F.sum(F.when(rest, F.col("sse_share"))).alias("minority_sse_share"),
    )
    lacking = F.col("minority_rmse").isNull() | F.col("majority_rmse").isNull()
    a = a.withColumn("class_effect", F.when(lacking, F.raise_error(F.lit("the classes have no minority or no majority")).cast("boolean")).otherwise((F.col("minority_rmse") > F.col("majority_rmse")) & (F.col("minority_sse_share") > F.col("minority_row_share"))))
    last = bins.agg(F.max("lower_m").alias("last"))
    b = bins.crossJoin(F.broadcast(last)).where("n > 0").agg(F.max(F.when(F.col("lower_m") == F.col("last"), F.col("mean_abs"))).alias("far_mean_abs"), F.min(F.when(F.col("lower_m") < F.col("last"), F.col("mean_abs"))).alias("least_inner_mean_abs"))
    size = F.abs(F.col("within_rho"))
    r = ranking.agg(F.max(F.when(F.col("candidate") == boundary, F.col("within_rho"))).alias("boundary_rho"), F.max_by("candidate", F.struct(F.coalesce(size, lit(-1)), F.col("candidate") == boundary)).alias("strongest"))
    out = a.crossJoin(b).crossJoin(r)
    near = (F.col("boundary_rho") < 0) & (F.abs(F.col("boundary_rho")) >= lit(floor)) & (F.col("strongest") == boundary)
    out = out.withColumns({"proximity_effect": F.coalesce(near, F.lit(False)), "small_elsewhere": F.coalesce(F.col("far_mean_abs") <= F.col("least_inner_mean_abs"), F.lit(False))})
    every = F.col("class_effect") & F.col("proximity_effect") & F.col("small_elsewhere")
    return out.withColumn("verdict", F.when(every, "CONFIRMED").otherwise("REFUTED"))


def clean_runs(runs: DataFrame, mode: str = "mode", default: str = "original", modes: tuple[str, ...] = ("original", "split")) -> DataFrame:
    """Runs without warm-ups; a blank mode is the default, an unknown one raises as it is met."""
    m = F.coalesce(F.nullif(F.trim(mode), F.lit("")), F.lit(default))
    known = F.when(m.isin(*modes), m).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), m)))
    return runs.where(~F.coalesce(F.col("warmup"), F.lit(False))).withColumn(mode, known)


def ladder(runs: DataFrame, order: list[str]) -> DataFrame:
    """Adjacent algorithms of each workload: the ratio of medians and whether their intervals part."""
    from ..functions.scalars import resolved_comparison

    cells = agg.benchmark_cells(runs, ["workload", "algorithm"], "computation_seconds")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("algorithm"))
    c = cells.withColumn("place", place).where("place > 0")
    n = c.select("workload", (F.col("place") - 1).alias("place"), F.col("algorithm").alias("next_algorithm"), F.col("median").alias("next_median"), F.col("min").alias("next_min"), F.col("max").alias("next_max"))
    j = c.join(n, ["workload", "place"])
    return j.select("workload", "algorithm", "next_algorithm", F.round(F.col("median") / F.nullif(F.col("next_median"), lit(0)), 9).alias("speedup"), resolved_comparison(F.col("min"), F.col("max"), F.nullif(F.col("next_min"), lit(0)), F.nullif(F.col("next_max"), lit(0))).alias("verdict"))


def nesting(samples: list[DataFrame], on: str) -> DataFrame:
    """(smaller, lost): how many ids of each sample the next larger one lacks; none may."""
    out = None
    for k, (a, b) in enumerate(zip(samples, samples[1:])):
        row = a.select(on).join(b.select(on), on, "left_anti").agg(F.count("*").alias("lost")).select(F.lit(k).alias("smaller"), "lost")
        out = row if out is None else out.unionByName(row)
    return out


def inflation_gate(counters: DataFrame, limit: float = 3.0) -> DataFrame:
    """How far the box over-covers the inflated disc: scanned entries over the disc's, decided by the 99th percentile of rows."""
    verdict = F.when(F.col("p99").isNull(), "undetermined").when(F.col("p99") <= limit, "disk_predicate_stays_off").otherwise("enable_disk_predicate")
    return agg.ratio_distribution(counters, "entries_scanned", "n_disk_infl").select("of_sums", "p99", "max", verdict.alias("verdict"))
