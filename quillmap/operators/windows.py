"""Ranks, bins, neighbours and focal windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import folder

def percentile_avg(c: Column, *by: Column, higher: bool = True) -> Column:
    """Average-rank percentile in (0, 100]; 50 where all values are equal. ``higher``: larger values rank higher."""
    v = c if higher else -c
    part = Window.partitionBy(*by)
    rank = F.rank().over(part.orderBy(v)) + (F.count("*").over(Window.partitionBy(*by, v)) - 1) / F.lit(2.0)
    return F.when(F.min(v).over(part) == F.max(v).over(part), F.lit(50.0)).otherwise(F.lit(100.0) * rank / F.count("*").over(part))


def rank_average(c: Column, *by: Column) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)


def rank_first(c: Column, tie: Column, *by: Column) -> Column:
    """Ordinal rank; equal values in the order of ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(c, tie))


#: Rows up to which one sorted task ranks a whole table; beyond it, or where asked, ranks go by range parts.
GLOBAL_RANK_ROWS = 2_000_000


def _by_parts(df: DataFrame, scale: bool | None) -> bool:
    return df.count() > GLOBAL_RANK_ROWS if scale is None else scale


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, run, pos, all): each distinct key in order, how many rows have it, how many are smaller, and how many there are.

    Keys are counted, dealt by range and written with the number of their part; sums run within parts, and the parts'
    offsets, one row each, come back by a broadcast join. No task sorts the whole table. It is written because a range
    exchange that ran twice could cut elsewhere.
    """
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count("*").alias("run"))
    path = folder(spark, "ranged")
    counts.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(counts.withColumn("__p", F.lit(0)).schema).parquet(path)
    sizes = ranged.groupBy("__p").agg(F.sum("run").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__p", before.alias("__b"), F.sum("__n").over(Window.partitionBy()).alias("all")))
    inside = F.sum("run").over(Window.partitionBy("__p").orderBy(*keys)) - F.col("run")
    return ranged.withColumn("__i", inside).join(offsets, "__p").select(*keys, "run", (F.col("__b") + F.col("__i")).cast("long").alias("pos"), "all")


def with_rank_average(df: DataFrame, c: str, out: str, scale: bool | None = None) -> DataFrame:
    """``rank_average`` over the whole table; of a large one without one sorted task."""
    if not _by_parts(df, scale):
        return df.withColumn(out, rank_average(F.col(c)))
    ranks = placed(df.select(F.col(c).alias("__v")), "__v")
    ranks = ranks.select("__v", (F.col("pos") + 1 + (F.col("run") - 1) / F.lit(2.0)).alias(out))
    return df.withColumn("__v", F.col(c)).join(ranks, "__v").drop("__v")


def with_percentile(df: DataFrame, c: str, out: str, higher: bool = True, scale: bool | None = None) -> DataFrame:
    """``percentile_avg`` over the whole table; of a large one without one sorted task."""
    if not _by_parts(df, scale):
        return df.withColumn(out, percentile_avg(F.col(c), higher=higher))
    v = F.col(c) if higher else -F.col(c)
    ranks = placed(df.select(v.alias("__v")), "__v")
    pct = F.lit(100.0) * (F.col("pos") + 1 + (F.col("run") - 1) / F.lit(2.0)) / F.col("all")
    ranks = ranks.select("__v", F.when(F.col("run") == F.col("all"), F.lit(50.0)).otherwise(pct).alias(out))
    return df.withColumn("__v", v).join(ranks, "__v").drop("__v")


def with_ordinal(df: DataFrame, c: str, tie: str, out: str, scale: bool | None = None) -> DataFrame:
    """``rank_first`` over the whole table; of a large one without one sorted task. (c, tie) must be unique."""
    if not _by_parts(df, scale):
        return df.withColumn(out, rank_first(F.col(c), F.col(tie)))
    ranks = placed(df.select(F.col(c).alias("__v"), F.col(tie).alias("__t")), "__v", "__t")
    ranks = ranks.select("__v", "__t", (F.col("pos") + 1).alias(out))
    return df.withColumns({"__v": F.col(c), "__t": F.col(tie)}).join(ranks, ["__v", "__t"]).drop("__v", "__t")


def quantiles(df: DataFrame, c: str, qs: list[float], scale: bool | None = None) -> list[float | None]:
    """Exact interpolated quantiles. Of the placed values only those at the wanted ranks come to the driver, two a quantile.

    ``percentile`` gives the same but gathers all distinct values in one aggregation buffer, so it is for small tables.
    """
    if not _by_parts(df, scale):
        got = df.agg(F.percentile(c, F.array(*[F.lit(float(q)) for q in qs]))).first()[0]
        return list(got) if got is not None else [None] * len(qs)
    values = placed(df.select(F.col(c).cast("double").alias("v")).where("v is not null"), "v")
    n = values.select("all").first()
    if n is None:
        return [None] * len(qs)
    at = [(n[0] - 1) * q for q in qs]
    ranks = sorted({k for x in at for k in (int(x), min(int(x) + 1, n[0] - 1))})
    hits = values.select("v", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in ranks]), lambda k: (k >= F.col("pos")) & (k < F.col("pos") + F.col("run")))).alias("k"))
    value = {r["k"]: r["v"] for r in hits.collect()}
    return [value[int(x)] + (value[min(int(x) + 1, n[0] - 1)] - value[int(x)]) * (x - int(x)) for x in at]


def quantile_edges(df: DataFrame, c: str, q: int) -> DataFrame:
    """One row: the interpolated quantile edges as an array, duplicates dropped."""
    edges = sorted(set(e for e in quantiles(df, c, [i / q for i in range(q + 1)]) if e is not None))
    return df.sparkSession.range(1).select(F.array(*[F.lit(e) for e in edges]).cast("array<double>").alias("edges"))


def qcut(df: DataFrame, c: str, q: int, out: str) -> DataFrame:
    """Quantile bin from 0, closed on the right; the least value belongs to the first bin. One broadcast row of edges."""
    edges = quantile_edges(df, c, q)
    n = F.size(F.filter("edges", lambda e: e < F.col(c)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.greatest(n - 1, F.lit(0)).cast("int")).drop("edges")


def cut(c: Column, edges: list[float]) -> Column:
    """Bin of half-open [edge, next edge); the last one is open above; null below the first."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        out = F.when(c >= F.lit(float(low)), F.lit(i)).otherwise(out)
    return out


def segments(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    """Consecutive vertices of each ring as (fid, part_index, ring_index, seg, ax, ay, bx, by)."""
    w = Window.partitionBy(fid, "part_index", "ring_index").orderBy("vertex_index")
    return vertices.select(fid, "part_index", "ring_index", F.col("vertex_index").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")


def not_contiguous(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    """Rings whose vertex numbers aren't 0..n-1."""
    w = Window.partitionBy(fid, "part_index", "ring_index").orderBy("vertex_index")
    return vertices.withColumn("place", F.row_number().over(w) - 1).groupBy(fid, "part_index", "ring_index").agg(F.count_if(F.col("place") != F.col("vertex_index")).alias("bad")).where("bad > 0")


def duplicated(*keys: str) -> Column:
    """Whether other rows have the same key."""
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def group_residual(c: str, *by: str) -> Column:
    return F.col(c) - F.avg(c).over(Window.partitionBy(*by))


def lower_bound(key: str, *by: str) -> Column:
    """How many rows have a smaller key."""
    return F.rank().over(Window.partitionBy(*by).orderBy(key)) - 1


def schedule(spark, cells: int, repetitions: int) -> DataFrame:
    """(repetition, position, cell): each repetition runs all cells, begun one cell later each time."""
    reps = spark.range(repetitions).withColumnRenamed("id", "repetition")
    return reps.select("repetition", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("position")).withColumn("cell", F.pmod(F.col("position") + F.col("repetition"), F.lit(cells)))
