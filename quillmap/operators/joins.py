"""Joins with the checks that go with them, and neighbour joins between points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import dist2, lit
from ..sources.scratch import round_table, spread
from .geometry import nearest


class RowsLost(ValueError):
    """A one-to-one join met repeated or unmatched keys."""


def one_to_one(a: DataFrame, b: DataFrame, on: str, check: bool = True) -> DataFrame:
    """Inner join of two tables with the same unique keys; one pass over both finds repeated and lonely ones."""
    if check:
        keys = a.select(on, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(on, F.lit(0).alias("a"), F.lit(1).alias("b")))
        bad = keys.groupBy(on).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 1 or b <> 1").limit(10).collect()
        if bad:
            raise RowsLost(f"keys that aren't once on each side: {[tuple(r) for r in bad]}")
    return a.join(b, on)


def compare(reference: DataFrame, candidate: DataFrame, on: str, exact: list[str] = (), close: dict[str, float] | None = None) -> DataFrame:
    """Full outer comparison, a row a key: side, and per field whether it agrees (null-safe, or within a tolerance)."""
    close = close or {}
    fields = [*exact, *close]
    a = reference.select(on, F.lit(True).alias("__a"), *[F.col(c).alias(f"ref_{c}") for c in fields])
    b = candidate.select(on, F.lit(True).alias("__b"), *[F.col(c).alias(f"cand_{c}") for c in fields])
    out = a.join(b, on, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    side = F.when(both, "both").when(F.col("__a").isNotNull(), "reference_only").otherwise("candidate_only")
    agree = {f"agree_{c}": both & F.col(f"ref_{c}").eqNullSafe(F.col(f"cand_{c}")) for c in exact}
    agree |= {f"agree_{c}": both & F.coalesce(F.abs(F.col(f"ref_{c}") - F.col(f"cand_{c}")) <= tol, F.col(f"ref_{c}").isNull() & F.col(f"cand_{c}").isNull()) for c, tol in close.items()}
    return out.withColumns({"side": side, **agree}).drop("__a", "__b")


def agreement(compared: DataFrame) -> DataFrame:
    """One row: how many keys are on which side, and how many agree in each field and in all."""
    flags = [c for c in compared.columns if c.startswith("agree_")]
    every = F.lit(True)
    for c in flags:
        every = every & F.col(c)
    return compared.agg(
        F.count("*").alias("union_rows"), *[F.count_if(F.col("side") == s).alias(f"{s}_rows") for s in ("both", "reference_only", "candidate_only")], *[F.count_if(c).alias(c) for c in flags], F.count_if(every).alias("full_agreement")
    )


def set_difference(a: DataFrame, b: DataFrame, on: str, examples: int = 10) -> DataFrame:
    """Two rows (side, n, examples): keys only on the left, only on the right, with the first few of each."""

    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        only = x.select(on).distinct().join(y.select(on), on, "left_anti")
        first = only.orderBy(on).limit(examples).agg(F.sort_array(F.collect_list(on)).alias("examples"))
        return only.agg(F.count("*").alias("n")).crossJoin(first).select(F.lit(name).alias("side"), "n", "examples")

    return side(a, b, "left_only").unionByName(side(b, a, "right_only"))


def extension(remote: DataFrame, known: DataFrame, on: str, n: int) -> DataFrame:
    """The first n rows, by key, that aren't known yet."""
    return remote.join(known.select(on), on, "left_anti").orderBy(on).limit(n)


def overlap_drift(a: DataFrame, b: DataFrame, on: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Rows of both tables with the coordinates' drift and whether it is within tolerance on both axes."""
    j = a.select(on, F.col(x).alias("x1"), F.col(y).alias("y1")).join(b.select(on, F.col(x).alias("x2"), F.col(y).alias("y2")), on)
    return j.select(on, F.abs(F.col("x1") - F.col("x2")).alias("dx"), F.abs(F.col("y1") - F.col("y2")).alias("dy")).withColumn("within", (F.col("dx") <= tolerance) & (F.col("dy") <= tolerance))


def ids_present(df: DataFrame, ids: list, on: str) -> DataFrame:
    """Rows whose key is in the list; raises if any of it is absent."""
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], [on]).select(F.col(on).cast(df.schema[on].dataType))
    lost = wanted.join(df.select(on), on, "left_anti").limit(10).collect()
    if lost:
        raise RowsLost(f"ids that aren't there: {[r[0] for r in lost]}")
    return df.join(F.broadcast(wanted), on, "left_semi")


def _as_segments(sites: DataFrame, sid: str, x: str, y: str) -> DataFrame:
    return sites.select(F.col(sid).alias("fid"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(x).alias("bx"), F.col(y).alias("by"))


def nearest_point(points: DataFrame, sites: DataFrame, sid: str = "sid", x: str = "sx", y: str = "sy", carry: tuple[str, ...] = (), strategy: str = "auto") -> DataFrame:
    """The nearest site of each point, equal distances by the least id, with the columns to carry over."""
    best = nearest(points, _as_segments(sites, sid, x, y), strategy).select("id", F.col("fid").alias(sid), "distance")
    return best.join(sites.select(sid, *carry), sid) if carry else best


def knn(points: DataFrame, k: int, cell: float | None = None, id_col: str = "id", x: str = "px", y: str = "py") -> DataFrame:
    """(id, other, distance, place) of the k nearest rows of the same table, itself included; equal distances by id.

    Grids that coarsen, as for the nearest feature: a point is settled when its k-th neighbour is nearer than the border of
    the nine cells around it, or once these hold all rows, as they do in the last round; so a table of fewer than k rows
    gives all of them. Without a ``cell`` it is such that about two cells hold k rows. Rounds are written, so no lineage grows.
    """
    todo = points.select(id_col, x, y)
    box = points.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))).first()
    extent = (box[1] - box[0], box[3] - box[2]) if box[4] else (0.0, 0.0)
    size = float(cell or max((extent[0] * extent[1] * k / max(2 * box[4], 1)) ** 0.5, max(extent) * k / max(2 * box[4], 1), 1e-9))
    o = points.select(F.col(id_col).alias("other"), F.col(x).alias("ox"), F.col(y).alias("oy"))
    done = None
    while True:
        last = size > max(extent)  # whatever a cell's origin, all rows are then in the nine cells around each
        i, j = F.floor(F.col(x) / lit(size)).cast("long"), F.floor(F.col(y) / lit(size)).cast("long")
        around = todo.select("*", F.explode(F.sequence(i - 1, i + 1)).alias("ci"), j.alias("__j")).select("*", F.explode(F.sequence(F.col("__j") - 1, F.col("__j") + 1)).alias("cj")).drop("__j")
        cells = o.withColumns({"ci": F.floor(F.col("ox") / lit(size)).cast("long"), "cj": F.floor(F.col("oy") / lit(size)).cast("long")})
        pairs = around.join(cells, ["ci", "cj"]).select(id_col, x, y, F.sqrt(dist2(F.col(x), F.col(y), F.col("ox"), F.col("oy"))).alias("distance"), "other")
        ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "other"))).where(F.col("place") <= k)
        mod = lambda c: F.pmod(F.col(c), lit(size))
        border = F.least(mod(x) + lit(size), 2 * lit(size) - mod(x), mod(y) + lit(size), 2 * lit(size) - mod(y))
        # Only the k kept rows of a point are looked at again, where the ranking put them.
        kth = F.max(F.when((F.col("place") == k) & (F.col("distance") < border), F.lit(1))).over(Window.partitionBy(id_col))
        found = round_table(ranked.withColumn("ok", F.lit(last) | kth.isNotNull()), "knn")
        part = found.where("ok").select(id_col, "other", "distance", "place")
        done = part if done is None else done.unionByName(part)
        todo = found.where(~F.col("ok") & (F.col("place") == 1)).select(id_col, x, y)
        if last or todo.isEmpty():
            return done
        size *= 2


def radius_pairs(points: DataFrame, radius: float, id_col: str = "id", x: str = "px", y: str = "py", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each pair (a < b) of rows less than ``radius`` apart: cells of half the radius, each two of which meet once.

    Both sides are dealt by the cell: plans take the copies that go to other cells for no more than the rows, and would broadcast them.
    """
    size = radius / 2
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) >= (0, 0)]
    cell = lambda c: F.floor(F.col(c) / lit(size)).cast("long")
    rows = points.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(f"c_{c}") for c in carry], cell(x).alias("ci"), cell(y).alias("cj"))
    cols = ["id", "x", "y", *[f"c_{c}" for c in carry]]
    p = rows.select(*[F.col(c).alias(f"p_{c}") for c in cols], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])).alias("o"), "ci", "cj")
    p = p.select(*[f"p_{c}" for c in cols], ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"), (F.col("ci") + F.col("o.i")).alias("ci"), (F.col("cj") + F.col("o.j")).alias("cj"))
    q = rows.select(*[F.col(c).alias(f"q_{c}") for c in cols], "ci", "cj")
    near = dist2(F.col("p_x"), F.col("p_y"), F.col("q_x"), F.col("q_y"))
    first = F.col("p_id") < F.col("q_id")
    j = spread(p, "ci", "cj").hint("merge").join(spread(q, "ci", "cj"), ["ci", "cj"]).where((first | ~F.col("own") & (F.col("p_id") > F.col("q_id"))) & (F.sqrt(near) < radius))
    side = lambda c, k: F.when(first if k == 1 else ~first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}"))
    names = {"x": "x", "y": "y"} | {f"c_{c}": c for c in carry}
    return j.select(*[side("id", k).alias("ab"[k - 1]) if c is None else side(c, k).alias(f"{names[c]}{k}") for k in (1, 2) for c in (None, *names)], F.sqrt(near).alias("d"))


#: Pairs that ``lag_sums`` compares at once.
PAIRS_AT_ONCE = 1 << 16


def lag_sums(points: DataFrame, width: float, bins: int, value: str = "v", id_col: str = "id", x: str = "px", y: str = "py") -> DataFrame:
    """(bin, pair_count, squares): of all pairs (a < b) with floor(distance / width) below ``bins``, their number and the sum of (v1 - v2)^2.

    Square tiles as wide as the largest lag: a tile's rows meet each other and the rows of four of the tiles around it, so
    each pair of tiles meets once. Only sums leave a tile.
    """
    reach = width * bins
    cell = lambda c: F.floor(F.col(c) / lit(reach)).cast("long")
    known = points.where(F.col(id_col).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1))])).alias("o")
    rows = known.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v"), to)
    rows = rows.select("id", "x", "y", "v", (cell("x") + F.col("o.i")).alias("ci"), (cell("y") + F.col("o.j")).alias("cj"), ((F.col("o.i") != 0) | (F.col("o.j") != 0)).alias("guest"))
    tiles = spread(rows, "ci", "cj").sortWithinPartitions("ci", "cj")
    sums = tiles.mapInArrow(_tile_sums(width, bins), "bin int, pair_count long, squares double")
    return sums.groupBy("bin").agg(F.sum("pair_count").alias("pair_count"), F.sum("squares").alias("squares"))


def _tile_sums(width: float, bins: int):
    """Sums of the tiles in rows sorted by (ci, cj); a tile is gathered."""

    def of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, guest, xs, ys, vs = (np.concatenate(c) for c in zip(*parts))
        count, squares = np.zeros(bins, dtype=np.int64), np.zeros(bins)
        # Homes before guests, each in order of x.
        order = np.lexsort((xs, guest))
        ids, xs, ys, vs = ids[order], xs[order], ys[order], vs[order]
        n, reach = int(np.count_nonzero(~guest)), width * bins
        homes, guests = xs[:n], xs[n:]
        again = len(np.unique(ids)) < len(ids)
        at = 0
        while at < n:
            # A few homes at a time against the homes after them and the guests, as far as x reaches.
            end = min(n, at + max(1, PAIRS_AT_ONCE // (len(ids) + 1)))
            low, high = homes[at] - reach, homes[end - 1] + reach
            spans = [slice(at + 1, int(np.searchsorted(homes, high, side="right"))), slice(n + int(np.searchsorted(guests, low)), n + int(np.searchsorted(guests, high, side="right")))]
            for own, span in enumerate(spans):
                if span.stop <= span.start:
                    continue
                dx, dy = xs[at:end, None] - xs[span], ys[at:end, None] - ys[span]
                d = np.sqrt(dx * dx + dy * dy)
                near = d < reach
                if not own:  # the later ones of the homes only
                    near &= np.arange(span.start, span.stop) > np.arange(at, end)[:, None]
                if again:
                    near &= ids[at:end, None] != ids[span]
                k = (d[near] / width).astype(np.int64)
                w = (vs[at:end, None] - vs[span])[near]
                w = np.nan_to_num(w * w, nan=0.0, posinf=np.inf) if np.isnan(w).any() else w * w
                count += np.bincount(k, minlength=bins + 1)[:bins]
                squares += np.bincount(k, weights=w, minlength=bins + 1)[:bins]
            at = end
        return count, squares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, squares = np.zeros(bins, dtype=np.int64), np.zeros(bins)
        key, parts = None, []
        for batch in batches:
            id_, x, y, v, ci, cj, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x", "y", "v", "ci", "cj", "guest"))
            cuts = [0, *(np.flatnonzero((np.diff(ci) != 0) | (np.diff(cj) != 0)) + 1).tolist(), len(ci)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != (ci[a], cj[a]):
                    if parts:
                        c, q = of(parts)
                        count, squares = count + c, squares + q
                    key, parts = (ci[a], cj[a]), []
                parts.append((id_[a:b], guest[a:b].astype(bool), x[a:b], y[a:b], v[a:b].astype(float)))
        if parts:
            c, q = of(parts)
            count, squares = count + c, squares + q
        yield pa.RecordBatch.from_arrays([pa.array(range(bins), pa.int32()), pa.array(count), pa.array(squares)], ["bin", "pair_count", "squares"])

    return run


def any_within(points: DataFrame, others: DataFrame, radius: float, id_col: str = "id", x: str = "px", y: str = "py") -> DataFrame:
    """Distinct ids of the points with one of ``others`` less than ``radius`` away.

    Cells of a quarter of the radius: what lies in cells that are less than the radius apart at their far corners is
    within it, and only points that no such cell settles are compared with others, those of cells whose near corners are
    less than the radius apart. Many others in a cell count once.
    """
    size = radius / 4
    cell = lambda c: F.floor(F.col(c) / lit(size)).cast("long")
    ring = range(-5, 6)
    # Squared distances of the corners, in cells; a little less sure than they are, for rounding.
    gaps = [(i, j, (abs(i) + 1) ** 2 + (abs(j) + 1) ** 2 < 16 - 1e-6) for i in ring for j in ring if max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= 16]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(sure).alias("sure")) for i, j, sure in gaps])
    p = points.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("ci"), cell(y).alias("cj")).where("x is not null and y is not null")
    o = others.select(F.col(x).alias("ox"), F.col(y).alias("oy"), cell(x).alias("oi"), cell(y).alias("oj")).where("ox is not null and oy is not null")
    p, o = round_table(p, "points"), round_table(o, "others")
    met = o.select("oi", "oj").distinct().select("oi", "oj", F.explode(offsets).alias("o"))
    met = met.select("oi", "oj", (F.col("oi") + F.col("o.i")).alias("ci"), (F.col("oj") + F.col("o.j")).alias("cj"), F.col("o.sure").alias("sure"))
    met = met.hint("merge").join(p.select("ci", "cj").distinct(), ["ci", "cj"])
    met = round_table(met.withColumn("settled", F.max("sure").over(Window.partitionBy("ci", "cj"))), "cells")
    settled = p.hint("merge").join(met.where("settled").select("ci", "cj").distinct(), ["ci", "cj"]).select("id")
    open_ = p.hint("merge").join(met.where("not settled").select("ci", "cj", "oi", "oj"), ["ci", "cj"])
    open_ = spread(open_.select("id", "x", "y", "oi", "oj"), "oi", "oj").hint("merge").join(spread(o, "oi", "oj"), ["oi", "oj"])
    return settled.unionByName(open_.where(F.sqrt(dist2(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))) < lit(radius)).select("id")).distinct().withColumnRenamed("id", id_col)


def sample_pairs(points: DataFrame, n: int, id_col: str = "id", x: str = "px", y: str = "py", carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (a < b) of a sample of at most n rows, those with the least md5 of their id; both sides are so bounded."""
    s = points.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)
    a = s.select(F.col(id_col).alias("a"), F.col(x).alias("x1"), F.col(y).alias("y1"), *[F.col(c).alias(f"{c}1") for c in carry])
    b = s.select(F.col(id_col).alias("b"), F.col(x).alias("x2"), F.col(y).alias("y2"), *[F.col(c).alias(f"{c}2") for c in carry])
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("d", F.sqrt(dist2(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))


def other_class_distance(points: DataFrame, cls: str = "cls", strategy: str = "auto") -> DataFrame:
    """Distance of each point to the nearest one of another class; infinite if there is one class only.

    For each class, a nearest join with the rest: as many joins as classes, which must be few.
    """
    out = None
    for (c,) in points.select(cls).distinct().orderBy(cls).collect():
        mine, rest = points.where(F.col(cls).eqNullSafe(F.lit(c))), points.where(~F.col(cls).eqNullSafe(F.lit(c)))
        part = mine.select("id").join(nearest(mine, _as_segments(rest, "id", "px", "py"), strategy).select("id", "distance"), "id", "left")
        out = part if out is None else out.unionByName(part)
    return out.select("id", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def block_chebyshev(blocks: DataFrame, train: DataFrame) -> DataFrame:
    """For each distinct block (block_i, block_j), the least of max(|di|, |dj|) to a distinct training block; blocks, not points, are joined."""
    b, t = blocks.select("block_i", "block_j").distinct(), train.select(F.col("block_i").alias("ti"), F.col("block_j").alias("tj")).distinct()
    gap = F.greatest(F.abs(F.col("block_i") - F.col("ti")), F.abs(F.col("block_j") - F.col("tj")))
    return b.crossJoin(F.broadcast(t)).groupBy("block_i", "block_j").agg(F.min(gap).alias("separation"))


def pair_within(runs: DataFrame, keys: list[str], kind: str, control: str, other: str, value: Column) -> DataFrame:
    """Control and other runs of the same cell side by side, one aggregation, no self-join."""
    agg = runs.groupBy(*keys).agg(F.median(F.when(F.col(kind) == control, value)).alias("control"), F.median(F.when(F.col(kind) == other, value)).alias("other"))
    return agg.where("control is not null and other is not null").withColumn("ratio", F.col("other") / F.col("control"))
