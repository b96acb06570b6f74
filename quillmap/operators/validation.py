"""Validation: what breaks a rule is a row (check, status, n, examples); ``enforce`` raises on it, in one action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import with_ordinal


PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


class Violation(ValueError):
    """A table breaks a rule that must hold."""


def require_columns(df: DataFrame, columns: list[str]) -> None:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise Violation(f"missing columns: {lost}")


def schema_report(df: DataFrame, columns: list[str]) -> list[tuple[str, str, str]]:
    """(check, status, detail): missing columns fail, extra ones warn."""
    lost, more = [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]
    return [("missing_columns", FAIL if lost else PASS, ",".join(lost)), ("extra_columns", WARN if more else PASS, ",".join(more))]


@dataclass(frozen=True)
class Rule:
    """A named condition that marks bad rows; ``warn`` rules don't fail."""

    name: str
    bad: Column
    warn: bool = False


def violations(df: DataFrame, rules: list[Rule], id_col: str, examples: int = 10) -> DataFrame:
    """(check, status, n, examples) of each rule, all in one pass; the examples are the least ids."""
    flags = df.select(F.col(id_col).cast("string").alias("id"), *[F.coalesce(r.bad, F.lit(False)).alias(f"b{k}") for k, r in enumerate(rules)])
    checks = [F.struct(F.lit(r.name).alias("check"), F.lit(WARN if r.warn else FAIL).alias("level"), F.col(f"b{k}").alias("bad")) for k, r in enumerate(rules)]
    long = flags.select("id", F.explode(F.array(*checks)).alias("c")).select("id", "c.*")
    bad = long.where("bad")
    first = bad.withColumn("k", F.row_number().over(Window.partitionBy("check").orderBy("id"))).where(F.col("k") <= examples).groupBy("check").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    n = long.groupBy("check").agg(F.count_if("bad").alias("n"), F.first("level").alias("level"))
    none = F.array().cast("array<string>")
    return n.join(first, "check", "left").select("check", F.when(F.col("n") > 0, F.col("level")).otherwise(PASS).alias("status"), "n", F.coalesce("examples", none).alias("examples"))


def enforce(df: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """The table itself if no rule that fails is broken, else an error that names examples."""
    bad = violations(df, rules, id_col).where(F.col("status") == FAIL).collect()
    if bad:
        raise Violation("; ".join(f"{r['check']}: {r['n']} rows, such as {r['examples']}" for r in bad))
    return df


def id_rules(c: str) -> list[Rule]:
    v = F.col(c)
    blank = F.trim(v.cast("string")) == ""
    return [Rule("null_id", v.isNull()), Rule("blank_id", blank), Rule("duplicate_id", v.isNotNull() & (F.count("*").over(Window.partitionBy(c)) > 1))]


def finite(c: str) -> Rule:
    v = F.col(c)
    return Rule(f"{c}_not_finite", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def non_negative(c: str) -> Rule:
    return Rule(f"{c}_negative", F.col(c) < 0)


def below(c: str, limit: float) -> Rule:
    return Rule(f"{c}_not_below_limit", F.col(c) >= limit)


def in_range(c: str, low: float, high: float, warn: bool = False) -> Rule:
    return Rule(f"{c}_out_of_range", ~F.col(c).between(low, high), warn)


def known_zone(zone: str, matched: str, zones: list[str]) -> Rule:
    return Rule("unknown_zone", F.col(matched) & ~F.coalesce(F.upper(F.trim(zone)).isin(*zones), F.lit(False)))


def sfha_matched(sfha: str, matched: str) -> Rule:
    return Rule("sfha_without_match", F.col(sfha) & ~F.col(matched))


def derivation(stored: str, computed: Column, tolerance: float) -> Rule:
    return Rule(f"{stored}_not_reproduced", F.coalesce(F.abs(F.col(stored) - computed) > tolerance, F.lit(True)))


def one_value(df: DataFrame, c: str, expected=None) -> DataFrame:
    """(check, status, n, examples): a column must hold one value, the expected one."""
    one = df.agg(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias("values"), F.count_if(F.col(c).isNull()).alias("nulls"))
    ok = (F.size("values") == 1) & (F.col("nulls") == 0)
    if expected is not None:
        ok = ok & (F.col("values")[0] == str(expected))
    return one.select(F.lit(f"{c}_single").alias("check"), F.when(ok, PASS).otherwise(FAIL).alias("status"), F.size("values").cast("long").alias("n"), F.slice("values", 1, 10).alias("examples"))


def null_report(df: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """Nulls by column: none passes, allowed ones warn, others fail."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.when(F.col(c) == 0, PASS).when(F.lit(c in allowed), WARN).otherwise(FAIL).alias("status")) for c in df.columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def not_sorted(df: DataFrame, position: str, key: str) -> DataFrame:
    """Rows whose key is below the one before, by their stored position; each row meets its neighbour by an equi-join."""
    o = with_ordinal(df.select(position, key), position, key, "__k")
    prev = o.select((F.col("__k") + 1).alias("__k"), F.col(key).alias("previous"))
    return o.join(prev, "__k").where(F.col(key) < F.col("previous")).select(position, key, "previous")


def ring_report(vertices: DataFrame, fid: str = "fid", kind: str | None = None) -> DataFrame:
    """(fid, part, ring, vertices, closed, contiguous, ok): rings need four vertices, equal ends and numbers 0..n-1; lines two."""
    keys = [fid, "part_index", "ring_index"]
    v = F.struct("vertex_index", "x", "y")
    g = vertices.groupBy(*keys).agg(F.count("*").alias("vertices"), F.min(v).alias("a"), F.max(v).alias("z"), F.count_distinct("vertex_index").alias("numbers"), *([F.first(kind).alias("kind")] if kind else []))
    closed = (F.col("a.x") == F.col("z.x")) & (F.col("a.y") == F.col("z.y"))
    contiguous = (F.col("a.vertex_index") == 0) & (F.col("z.vertex_index") == F.col("vertices") - 1) & (F.col("numbers") == F.col("vertices"))
    line = (F.col("kind") == "line") if kind else F.lit(False)
    ok = contiguous & F.when(line, F.col("vertices") >= 2).otherwise((F.col("vertices") >= 4) & closed)
    return g.select(*keys, "vertices", closed.alias("closed"), contiguous.alias("contiguous"), ok.alias("ok"))


def without_exterior(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    """Parts that have rings but no ring 0."""
    return vertices.groupBy(fid, "part_index").agg(F.min("ring_index").alias("first")).where("first <> 0").select(fid, "part_index")


def full_agreement(summary: DataFrame) -> DataFrame:
    """Whether a comparison's rows are all on both sides, agree in every field, and are any at all."""
    return summary.withColumn("ok", (F.col("union_rows") > 0) & (F.col("both_rows") == F.col("union_rows")) & (F.col("full_agreement") == F.col("union_rows")))


def unique_id_field(df: DataFrame, candidates: list[str]) -> tuple[str | None, DataFrame]:
    """The first candidate that is complete and unique, and what each one lacks."""
    here = [c for c in candidates if c in df.columns]
    one = df.agg(F.count("*").alias("rows"), *[F.struct(F.count(c).alias("present"), F.count_distinct(c).alias("distinct")).alias(c) for c in here])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col("rows"), F.col(c)["present"].alias("present"), F.col(c)["distinct"].alias("n_distinct")) for c in here])
    report = one.select(F.explode(rows).alias("x")).select("x.*").withColumn("usable", (F.col("rows") == F.col("present")) & (F.col("rows") == F.col("n_distinct")))
    good = {r["field"] for r in report.where("usable").collect()}
    return next((c for c in here if c in good), None), report


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def roll_up(checks: DataFrame) -> DataFrame:
    """FAIL if any fails, else WARN if any warns, else PASS."""
    return checks.agg(F.when(F.count_if(F.col("status") == FAIL) > 0, FAIL).when(F.count_if(F.col("status") == WARN) > 0, WARN).otherwise(PASS).alias("status"), F.count("*").alias("checks"))


def consistent(df: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Whether integer counters agree over all runs of a cell."""
    return df.groupBy(*by).agg(*[(F.count_distinct(m) == 1).alias(f"{m}_consistent") for m in metrics])


def digests(df: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest isn't the one expected for their workload."""
    return df.join(expected.select(key, digest), [key, digest], "left_anti")


