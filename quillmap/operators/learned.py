"""Curve order and the learned index over it: a linear root that picks a leaf, linear leaves, and their error bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import grid_normalize, hilbert_key, key_normalize, lit
from .windows import placed


def curve_keys(points: DataFrame, bits: int, x: str = "px", y: str = "py") -> DataFrame:
    """Points with cx, cy and their Hilbert key over the bounds of all; bounds are one broadcast row."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    p = points.crossJoin(F.broadcast(box)).withColumns({"cx": grid_normalize(F.col(x), F.col("x0"), F.col("x1"), bits), "cy": grid_normalize(F.col(y), F.col("y0"), F.col("y1"), bits)})
    return p.withColumn("key", hilbert_key(F.col("cx"), F.col("cy"), bits)).drop("x0", "x1", "y0", "y1")


def in_key_order(keyed: DataFrame, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Ranges of the curve as partitions, sorted within by key, then id."""
    r = keyed.repartitionByRange(partitions, "key", id_col) if partitions else keyed.repartitionByRange("key", id_col)
    return r.sortWithinPartitions("key", id_col)


def distinct_cells(points: DataFrame, orders: list[int], x: str = "px", y: str = "py") -> DataFrame:
    """(bits, cells) for each order: how many cells hold a point."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    p = points.crossJoin(F.broadcast(box))
    cells = F.array(*[F.struct(F.lit(b).alias("bits"), grid_normalize(F.col(x), F.col("x0"), F.col("x1"), b).alias("cx"), grid_normalize(F.col(y), F.col("y0"), F.col("y1"), b).alias("cy")) for b in orders])
    return p.select(F.explode(cells).alias("c")).select("c.*").distinct().groupBy("bits").agg(F.count("*").alias("cells"))


def square_key_range(cx, cy, bits: int, k: int):
    """(first, past the last) key of the aligned block of 2**k cells a side that holds a cell."""
    key = hilbert_key(F.call_function("shiftright", cx, F.lit(k)), F.call_function("shiftright", cy, F.lit(k)), bits - k)
    return key * (1 << 2 * k), (key + 1) * (1 << 2 * k)


def positions(keyed: DataFrame, key: str = "key") -> DataFrame:
    """(key, pos, run): each distinct key, how many rows have a smaller one, and how many have it."""
    return placed(keyed.select(key), key).select(key, "pos", "run")


def train_rmi(pos: DataFrame, leaves: int) -> tuple[DataFrame, DataFrame]:
    """(root, leaf table) of positions (key, pos): least squares at the root over normalised keys, then in each leaf.

    A leaf without keys predicts the boundary: the position that the leaf before it ends at, with no error.
    """
    ends = pos.agg(F.min("key").alias("kmin"), F.max("key").alias("kmax"), F.max("pos").alias("n"))
    t = pos.crossJoin(F.broadcast(ends)).withColumn("t", F.coalesce(key_normalize(F.col("key"), F.col("kmin"), F.col("kmax")), lit(0)))
    root = t.agg(F.coalesce(F.regr_slope("pos", "t"), lit(0)).alias("a"), F.coalesce(F.regr_intercept("pos", "t"), lit(0)).alias("b"), F.first("kmin").alias("kmin"), F.first("kmax").alias("kmax"), (F.max("n") + 1).alias("n"))
    placed = t.select("key", "pos", "t").crossJoin(F.broadcast(root.select("a", "b", "n"))).withColumn("leaf", _leaf(leaves))
    fit = placed.groupBy("leaf").agg(F.count("*").alias("keys"), F.coalesce(F.regr_slope("pos", "t"), lit(0)).alias("la"), F.coalesce(F.regr_intercept("pos", "t"), F.avg("pos")).alias("lb"), F.max("pos").alias("last"))
    err = placed.join(F.broadcast(fit), "leaf").withColumn("e", F.col("pos") - _predict())
    bounds = err.groupBy("leaf").agg(F.min("e").alias("err_min"), F.max("e").alias("err_max"))
    every = pos.sparkSession.range(leaves).select(F.col("id").cast("int").alias("leaf"))
    all_leaves = every.join(fit.join(bounds, "leaf"), "leaf", "left")
    back = F.last("last", ignorenulls=True).over(Window.orderBy("leaf"))
    out = all_leaves.select("leaf", F.coalesce("keys", F.lit(0)).cast("long").alias("keys"), F.coalesce("la", lit(0)).alias("la"), F.coalesce("lb", (F.coalesce(back, F.lit(-1)) + 1).cast("double")).alias("lb"), F.coalesce("err_min", F.lit(0)).cast("long").alias("err_min"), F.coalesce("err_max", F.lit(0)).cast("long").alias("err_max"))
    return root, out


def _leaf(leaves: int):
    """The root's floor, then within the leaves."""
    return F.least(F.greatest(F.floor((F.col("a") * F.col("t") + F.col("b")) * lit(leaves) / F.col("n")), F.lit(0)), F.lit(leaves - 1)).cast("int")


def _predict():
    """The leaf's value within the positions, then its floor."""
    return F.floor(F.least(F.greatest(F.col("la") * F.col("t") + F.col("lb"), lit(0)), F.col("n").cast("double") - 1)).cast("long")


def predict_rmi(keys: DataFrame, root: DataFrame, leaf_table: DataFrame, leaves: int) -> DataFrame:
    """(key, leaf, predicted, low, high): the predicted position and the bounds that hold the true one."""
    t = keys.crossJoin(F.broadcast(root)).withColumn("t", F.coalesce(key_normalize(F.col("key"), F.col("kmin"), F.col("kmax")), lit(0))).withColumn("leaf", _leaf(leaves))
    j = t.join(F.broadcast(leaf_table), "leaf").withColumn("predicted", _predict())
    return j.select(*keys.columns, "leaf", "predicted", (F.col("predicted") + F.col("err_min")).alias("low"), (F.col("predicted") + F.col("err_max")).alias("high"))


def verify_rmi(pos: DataFrame, root: DataFrame, leaf_table: DataFrame, leaves: int) -> DataFrame:
    """One row: keys, how many lie outside their bounds (none may), and the widths of the last mile."""
    p = predict_rmi(pos.select("key", "pos"), root, leaf_table, leaves).withColumn("width", F.col("high") - F.col("low") + 1)
    return p.agg(F.count("*").alias("keys"), F.count_if(~F.col("pos").between(F.col("low"), F.col("high"))).alias("outside"), F.max("width").alias("max_width"), F.percentile("width", 0.5).alias("median_width"), F.max(F.when(F.col("width") <= 1, 0).otherwise(F.length(F.bin(F.col("width") - 1)))).alias("max_probes"))


def equi_depth_leaves(pos: DataFrame, leaves: int) -> DataFrame:
    """The alternative: leaves of equally many keys, by ordinal rank; (leaf, first, last, keys)."""
    n = pos.count()
    rank = F.floor(F.col("pos") * leaves / F.lit(max(n, 1)))
    return pos.withColumn("leaf", F.least(rank, F.lit(leaves - 1)).cast("int")).groupBy("leaf").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("keys"))


def leaf_boundaries(root: DataFrame, leaves: int) -> list[int]:
    """The first key of each leaf by bisection over the root's line; keys from the last boundary on belong to the last leaf."""
    r = root.first()
    if r is None or r["kmin"] is None:
        return []
    span, out = r["kmax"] - r["kmin"], []

    def leaf(key: int) -> int:
        t = (float(key) - float(r["kmin"])) * (1.0 / span) if span else 0.0
        return min(max(int((r["a"] * t + r["b"]) * leaves // r["n"]), 0), leaves - 1)

    for k in range(leaves):
        low, high = r["kmin"], r["kmax"] + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if leaf(mid) < k else (low, mid)
        out.append(low)
    return out
