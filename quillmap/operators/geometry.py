"""Rings, polygons and lines as flat vertex and segment tables, and the spatial joins over them.

Nothing is a theta join: points and boxes meet in grid cells by an equi-join, and exact predicates follow. The nearest
feature is searched in grids that coarsen from round to round, nine cells a point each time, and only what isn't settled
goes on; a point is settled once its best distance, with the tolerance, is less than its distance to the border of the
searched block, for then all that is nearer or ties lies within. Segments that are dense and longer than a cell would give
each point thousands of pairs; points and segments then meet in tiles, and only the nearest features leave a tile. Segments
that are broadcast meet all points where these are, and only the nearest features leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import bbox_contains, crosses, interpolate, lit, point_segment_dist2, segment_length, split_pieces
from ..sources.scratch import round_table, spread
from .windows import segments

TIE = 1e-6
#: Point-segment pairs up to which one broadcast join is the better plan.
BROADCAST_PAIRS = 2_000_000
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000
BOUNDARY2 = 1e-18
#: Segments are searched in tiles if they are, on average, so many times longer than cells of two would be wide.
LONG = 2
#: Points of a tile that are compared at once, segments that bound their distances first, and kept ties that are thinned out.
TILE_POINTS, TILE_FIRST, TILE_TIES = 16, 32, 1 << 18
P, A, B = ("px", "py"), ("ax", "ay"), ("bx", "by")


def _cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def bounds(vertices: DataFrame, *by: str) -> DataFrame:
    return vertices.groupBy(*by).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def envelope(points: DataFrame, buffer: float, x: str = "px", y: str = "py") -> DataFrame:
    """The box of all points, widened by the buffer."""
    return points.agg((F.min(x) - lit(buffer)).alias("minx"), (F.min(y) - lit(buffer)).alias("miny"), (F.max(x) + lit(buffer)).alias("maxx"), (F.max(y) + lit(buffer)).alias("maxy"))


def in_box(vertices: DataFrame, box: DataFrame, fid: str = "fid") -> DataFrame:
    """Features whose bounds meet the box."""
    b = bounds(vertices, fid)
    o = F.broadcast(box.toDF("x0", "y0", "x1", "y1"))
    return b.crossJoin(o).where("minx <= x1 and maxx >= x0 and miny <= y1 and maxy >= y0").select(fid)


def ring_area(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    """Shoelace area of each feature: outer rings less holes."""
    s = segments(vertices, fid)
    ring = s.groupBy(fid, "part_index", "ring_index").agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2).alias("area"))
    return ring.groupBy(fid).agg(F.sum(F.when(F.col("ring_index") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area"))


def ring_flags(points: DataFrame, vertices: DataFrame, cell: float = 1000.0, point_id: str = "id", fid: str = "fid") -> DataFrame:
    """(id, fid, part, ring, odd, edge) of the rings whose feature's box holds the point, and that have a segment at its height."""
    box = bounds(vertices, fid, "part_index")
    i0, i1, j0, j1 = ((F.floor(F.col(c) / lit(cell)).cast("long")) for c in ("minx", "maxx", "miny", "maxy"))
    cells = box.select("*", F.explode(F.sequence(i0, i1)).alias("ci")).select("*", F.explode(F.sequence(j0, j1)).alias("cj"))
    p = points.select(point_id, "px", "py", F.floor(F.col("px") / lit(cell)).cast("long").alias("ci"), F.floor(F.col("py") / lit(cell)).cast("long").alias("cj"))
    near = p.join(cells, ["ci", "cj"]).where(bbox_contains(*_cols(*P, "minx", "miny", "maxx", "maxy"))).select(point_id, "px", "py", fid, "part_index")
    s = segments(vertices, fid).withColumns({"low": F.least("ay", "by"), "high": F.greatest("ay", "by")})
    rows = near.join(s, [fid, "part_index"]).where("py between low and high")
    return rows.groupBy(point_id, fid, "part_index", "ring_index").agg(
        (F.sum(crosses(*_cols(*P, *A, *B)).cast("int")) % 2 == 1).alias("odd"), (F.min(point_segment_dist2(*_cols(*P, *A, *B))) <= BOUNDARY2).alias("edge")
    )


def _parts(points: DataFrame, vertices: DataFrame, cell: float, point_id: str, fid: str) -> DataFrame:
    flags = ring_flags(points, vertices, cell, point_id, fid)
    outer = F.col("ring_index") == 0
    return flags.groupBy(point_id, fid, "part_index").agg(
        F.coalesce(F.bool_or(F.when(outer, F.col("odd"))), F.lit(False)).alias("outer"), F.coalesce(F.bool_or(F.when(~outer, F.col("odd"))), F.lit(False)).alias("hole"), F.bool_or("edge").alias("edge")
    )


def point_in_polygon(points: DataFrame, vertices: DataFrame, rule: str = "within", cell: float = 1000.0, point_id: str = "id", fid: str = "fid") -> DataFrame:
    """Distinct (id, fid) matches. ``within``: inside and on no boundary; ``parity``: the bare half-open rule; ``covers``: inside or on a boundary."""
    inside = F.col("outer") & ~F.col("hole")
    test = {"within": inside & ~F.col("edge"), "parity": inside, "covers": inside | F.col("edge")}[rule]
    return _parts(points, vertices, cell, point_id, fid).where(test).select(point_id, fid).distinct()


def membership(points: DataFrame, vertices: DataFrame, attributes: DataFrame, point_id: str = "id", fid: str = "fid", **kw) -> DataFrame:
    """Every point with its polygon's attributes and ``matched``; ``matches`` over 1 is the caller's error to raise."""
    hits = point_in_polygon(points, vertices, point_id=point_id, fid=fid, **kw)
    one = hits.groupBy(point_id).agg(F.min(fid).alias(fid), F.count("*").alias("matches"))
    out = points.join(one, point_id, "left").join(attributes, fid, "left")
    return out.withColumns({"matched": F.col(fid).isNotNull(), "matches": F.coalesce("matches", F.lit(0).cast("long"))})


def first_polygon(points: DataFrame, vertices: DataFrame, point_id: str = "id", fid: str = "fid", **kw) -> DataFrame:
    """The least feature that holds each point by bare parity; -1 for none."""
    one = point_in_polygon(points, vertices, "parity", point_id=point_id, fid=fid, **kw).groupBy(point_id).agg(F.min(fid).alias("first"))
    return points.select(point_id).join(one, point_id, "left").select(point_id, F.coalesce("first", F.lit(-1).cast("long")).alias(fid))


def split_segments(s: DataFrame, cap: float) -> DataFrame:
    """Segments in equal pieces of at most ``cap``; column ``piece`` from 0."""
    n = split_pieces(segment_length(*_cols(*A, *B)), cap)
    s = s.withColumn("pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    at = {c: interpolate(F.col(f"a{c[1]}"), F.col(f"b{c[1]}"), F.col("piece") + int(c[0] == "b"), F.col("pieces")) for c in ("ax", "ay", "bx", "by")}
    return s.withColumns(at)


def segment_stats(s: DataFrame, cap: float) -> DataFrame:
    """Count, total and longest length, tails, and the pieces that a cap makes."""
    n = s.withColumn("length", segment_length(*_cols(*A, *B)))
    return n.agg(
        F.count("*").alias("segments"), F.round(F.sum("length"), 6).alias("total_length"), F.round(F.max("length"), 6).alias("max_length"),
        *[F.count_if(F.col("length") > t).alias(f"over_{t}") for t in (100, 200, 500, 1000)], F.sum(split_pieces(F.col("length"), cap)).cast("long").alias("pieces"),
    )


def settle(candidates: DataFrame, point_id: str = "id", fid: str = "fid", d2: str = "d2") -> DataFrame:
    """(id, fid, distance, ties) from candidate rows (id, fid, d2): the least feature within TIE of the least distance."""
    each = candidates.repartition(point_id).groupBy(point_id, fid).agg(F.sqrt(F.min(d2)).alias("d"))
    best = each.withColumn("m", F.min("d").over(Window.partitionBy(point_id))).where(F.col("d") <= F.col("m") + TIE)
    return best.groupBy(point_id).agg(F.min(F.struct(fid, "d")).alias("w"), F.count("*").alias("ties"), F.first("m").alias("best")).select(point_id, F.col(f"w.{fid}").alias(fid), F.col("w.d").alias("distance"), "ties", "best")


def _cells(s: DataFrame, size: float) -> DataFrame:
    lo = lambda a, b: F.floor(F.least(a, b) / lit(size)).cast("long")
    hi = lambda a, b: F.floor(F.greatest(a, b) / lit(size)).cast("long")
    return s.select("*", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx"))).alias("ci")).select("*", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))).alias("cj"))


def nearest(points: DataFrame, s: DataFrame, strategy: str = "auto", cell: float | None = None, zero: DataFrame | None = None, point_id: str = "id", fid: str = "fid") -> DataFrame:
    """Exact nearest feature of each point (id, px, py) among segments (fid, ax, ay, bx, by).

    Returns (id, fid, distance, ties): features within 1e-6 of the least distance tie, the least fid of them is named,
    with its own distance. ``zero``: (id, fid) pairs at distance 0, points inside polygons. ``strategy``: broadcast, grid
    or auto, which counts both sides and broadcasts only a bounded one.
    """
    p, s = points.select(point_id, "px", "py"), s.select(fid, *A, *B)
    d2 = point_segment_dist2(*_cols(*P, *A, *B)).alias("d2")
    zeros = zero.select(point_id, fid, lit(0).alias("d2")) if zero is not None else None
    if strategy == "auto":
        n = s.count()
        strategy = "broadcast" if n <= BROADCAST_ROWS and n * p.count() <= BROADCAST_PAIRS else "grid"
    if strategy == "broadcast":
        near = _nearest_of_all(p, s, point_id, fid)
        return settle(near.unionByName(zeros) if zeros is not None else near, point_id, fid).drop("best")
    box = s.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by")), F.count("*"), F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))), F.count(fid)).first()
    if not box[4]:
        return settle(p.select(point_id, F.lit(None).cast(s.schema[fid].dataType).alias(fid), lit(0).alias("d2")).limit(0), point_id, fid).drop("best")
    far = p.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    extent = max(box[2], far[2] or box[2]) - min(box[0], far[0] or box[0]), max(box[3], far[3] or box[3]) - min(box[1], far[1] or box[1])
    # About two segments a cell, and none much longer than a cell.
    fine = (extent[0] * extent[1] * 2 / box[4]) ** 0.5
    size = cell or max(fine, 2 * (box[5] or 0), 1e-9)
    whole = all(d.schema[c].dataType.typeName() in ("long", "integer") for d, c in ((p, point_id), (s, fid))) and box[6] == box[4]
    tiled = cell is None and zeros is None and whole and (box[5] or 0) > LONG * fine and far[0] is not None and far[1] is not None
    todo, done = p, None
    while True:
        last = size >= max(extent) + 1
        if tiled and not last:
            got = round_table(_in_tiles(todo, s, 2 * size, far, done is not None, point_id, fid), "nearest")
            part = got.where("__settled").select(point_id, fid, "distance", "ties")
            done = part if done is None else done.unionByName(part)
            todo = got.where(~F.col("__settled")).select(point_id, "px", "py")
            if todo.isEmpty():
                return done
            size *= 2
            continue
        i, j = F.floor(F.col("px") / lit(size)).cast("long"), F.floor(F.col("py") / lit(size)).cast("long")
        around = todo.withColumns({"i": i, "j": j, "border": F.least(F.col("px") - (i - 1) * lit(size), (i + 2) * lit(size) - F.col("px"), F.col("py") - (j - 1) * lit(size), (j + 2) * lit(size) - F.col("py"))})
        around = around.select("*", F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("ci")).select("*", F.explode(F.sequence(F.col("j") - 1, F.col("j") + 1)).alias("cj"))
        found = around.join(_cells(s, size), ["ci", "cj"]).groupBy(point_id, fid).agg(F.min(d2).alias("d2"))
        if zeros is not None:
            found = found.unionByName(zeros)
        best = settle(found, point_id, fid)
        got = todo.join(best, point_id, "left")
        border = F.least(F.pmod(F.col("px"), lit(size)) + lit(size), 2 * lit(size) - F.pmod(F.col("px"), lit(size)), F.pmod(F.col("py"), lit(size)) + lit(size), 2 * lit(size) - F.pmod(F.col("py"), lit(size)))
        settled = F.lit(True) if last else F.col("best").isNotNull() & (F.col("best") + TIE < border)
        got = round_table(got.withColumn("__settled", F.coalesce(settled, F.lit(False))), "nearest")
        part = got.where("__settled").select(point_id, fid, "distance", "ties")
        done = part if done is None else done.unionByName(part)
        todo = got.where(~F.col("__settled")).select(point_id, "px", "py")
        if last or todo.isEmpty():
            return done
        size *= 2


def _nearest_of_all(points: DataFrame, s: DataFrame, point_id: str, fid: str) -> DataFrame:
    """(id, fid, d2) of each point's features within TIE of its least distance: all segments go to all tasks, pairs to none.

    Rows without finite coordinates have no distance.
    """
    known = lambda df, key, *at: df.where(" and ".join(f"abs({c}) < double('infinity')" for c in at)).select(key, *[F.col(c).cast("double").alias(c) for c in at])
    sent = points.sparkSession.sparkContext.broadcast(known(s, fid, *A, *B).toArrow())
    out = StructType([points.schema[point_id], s.schema[fid], StructField("d", DoubleType())])
    near = known(spread(points, point_id), point_id, *P).mapInArrow(_all_nearest(sent), out)
    return near.select(point_id, fid, (F.col("d") * F.col("d")).alias("d2"))  # whose root is d again, to the last bit


def _in_tiles(points: DataFrame, s: DataFrame, size: float, far, few: bool, point_id: str, fid: str) -> DataFrame:
    """Each point with its nearest feature in its tile and an eighth around it, and whether that settles it.

    ``far`` is the box that holds the points; ``few``: most tiles hold none, so segments elsewhere aren't moved.
    """
    halo = size / 8
    at = lambda c: F.floor(c / lit(size)).cast("long")
    here = points.where("px is not null and py is not null").select(at(F.col("px")).alias("ci"), at(F.col("py")).alias("cj"), F.lit(False).alias("segment"), F.col(point_id).cast("long").alias("k"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("px").alias("bx"), F.col("py").alias("by"))
    low = lambda a, b, m: F.greatest(at(F.least(a, b) - lit(halo)), at(lit(m)))
    high = lambda a, b, m: F.least(at(F.greatest(a, b) + lit(halo)), at(lit(m)))
    known = s.where(" and ".join(f"{c} is not null" for c in (*A, *B)))
    tiles = known.withColumns({"i0": low("ax", "bx", far[0]), "i1": high("ax", "bx", far[2]), "j0": low("ay", "by", far[1]), "j1": high("ay", "by", far[3])}).where("i0 <= i1 and j0 <= j1")
    tiles = tiles.select("*", F.explode(F.sequence("i0", "i1")).alias("ci")).select("*", F.explode(F.sequence("j0", "j1")).alias("cj"))
    tiles = tiles.select("ci", "cj", F.lit(True).alias("segment"), F.col(fid).cast("long").alias("k"), *A, *B)
    if few:
        tiles = tiles.join(here.select("ci", "cj").distinct(), ["ci", "cj"], "left_semi")
    rows = spread(here.unionByName(tiles), "ci", "cj").sortWithinPartitions("ci", "cj", "segment")
    found = rows.mapInArrow(_tile_nearest(size, halo), "k long, px double, py double, f long, distance double, ties long, __settled boolean")
    kinds = points.schema[point_id].dataType, s.schema[fid].dataType
    out = found.select(F.col("k").cast(kinds[0]).alias(point_id), "px", "py", F.col("f").cast(kinds[1]).alias(fid), "distance", "ties", "__settled")
    lost = points.where("px is null or py is null").select(point_id, "px", "py", F.lit(None).cast(kinds[1]).alias(fid), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("ties"), F.lit(False).alias("__settled"))
    return out.unionByName(lost)


def _distances(px, py, ax, ay, bx, by) -> np.ndarray:
    """``point_segment_dist2`` of points, a row each, and segments, a column each; its root."""
    px, py, dx, dy = px[:, None], py[:, None], bx - ax, by - ay
    n = dx * dx + dy * dy
    t = np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / np.where(n == 0, 1.0, n)))
    cx, cy = px - (ax + t * dx), py - (ay + t * dy)
    return np.sqrt(cx * cx + cy * cy)


def _boxes(ax, ay, bx, by) -> tuple[np.ndarray, ...]:
    return np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)


class _Tile:
    """Points of a tile, and the nearest features of each in the segments that pass by; those aren't kept."""

    def __init__(self):
        self.parts, self.best, self.ties, self.kept = [], None, [], 0

    def begin(self) -> None:
        k, x, y = (np.concatenate(c) for c in zip(*self.parts))
        # Strips of x, each in order of y, so that points compared at once are near each other.
        strip = np.empty(len(k), dtype=np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(k)) // max(1, int((len(k) * TILE_POINTS) ** 0.5))
        order = np.lexsort((y, strip))
        self.k, self.x, self.y, self.best = k[order], x[order], y[order], np.full(len(k), np.inf)

    def meet(self, fid, ax, ay, bx, by) -> None:
        if self.best is None:
            self.begin()
        box = _boxes(ax, ay, bx, by)
        for at in range(0, len(self.k), TILE_POINTS):
            self.compare(at, box, fid, ax, ay, bx, by)
            if self.kept > TILE_TIES:
                self.ties = [self.thinned()]
                self.kept = -len(self.ties[0][0])  # so many more before the next time

    def compare(self, at: int, box, fid, ax, ay, bx, by) -> None:
        """The points from ``at`` on, TILE_POINTS of them, with all the segments."""
        own = slice(at, at + TILE_POINTS)
        x0, x1, y0, y1 = box
        px, py, best = self.x[own], self.y[own], self.best[own]
        gx, gy = np.maximum(0.0, np.maximum(x0 - px.max(), px.min() - x1)), np.maximum(0.0, np.maximum(y0 - py.max(), py.min() - y1))
        gap = gx * gx + gy * gy
        if np.isinf(best).any():
            first = np.argpartition(np.abs(ax + bx - 2 * px.mean()) + np.abs(ay + by - 2 * py.mean()), TILE_FIRST)[:TILE_FIRST] if len(fid) > TILE_FIRST else np.arange(len(fid))
            best = np.minimum(best, _distances(px, py, ax[first], ay[first], bx[first], by[first]).min(axis=1))
        near = np.flatnonzero(gap <= (best.max() + 2 * TIE) ** 2 * (1 + 1e-9))
        if len(near):
            d = _distances(px, py, ax[near], ay[near], bx[near], by[near])
            self.best[own] = best = np.minimum(best, d.min(axis=1))
            i, j = np.nonzero(d <= best[:, None] + TIE)
            self.ties.append((i + at, fid[near[j]], d[i, j]))
            self.kept += len(i)

    def thinned(self) -> tuple[np.ndarray, ...]:
        """The ties (point, fid, distance) by point and fid, a feature once with its least distance."""
        i, f, d = (np.concatenate(c) for c in zip(*self.ties))
        on = d <= self.best[i] + TIE
        i, f, d = i[on], f[on], d[on]
        order = np.lexsort((d, f, i))
        i, f, d = i[order], f[order], d[order]
        first = np.ones(len(i), dtype=bool)
        first[1:] = (i[1:] != i[:-1]) | (f[1:] != f[:-1])
        return i[first], f[first], d[first]

    def rows(self, ci: int, cj: int, size: float, halo: float) -> pa.RecordBatch:
        if self.best is None:
            self.begin()
        f, d, n = np.zeros(len(self.k), dtype=np.int64), np.zeros(len(self.k)), np.zeros(len(self.k), dtype=np.int64)
        if self.ties:
            i, fids, ds = self.thinned()
            n = np.bincount(i, minlength=len(self.k))
            least, where = np.unique(i, return_index=True)
            f[least], d[least] = fids[where], ds[where]
        border = halo + np.minimum(np.minimum(self.x - ci * size, (ci + 1) * size - self.x), np.minimum(self.y - cj * size, (cj + 1) * size - self.y))
        settled = (n > 0) & (self.best + TIE < border)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.k, self.x, self.y, f, d, n, settled)], ["k", "px", "py", "f", "distance", "ties", "__settled"])


def _tile_nearest(size: float, halo: float):
    """Rows sorted by (ci, cj, segment): a tile's points are gathered, its segments pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            ci, cj, seg, k, ax, ay, bx, by = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ci", "cj", "segment", "k", *A, *B))
            seg = seg.astype(bool)
            cuts = [0, *(np.flatnonzero((np.diff(ci) != 0) | (np.diff(cj) != 0) | (seg[1:] != seg[:-1])) + 1).tolist(), len(ci)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != (ci[a], cj[a]):
                    if tile is not None and tile.parts:
                        yield tile.rows(*key, size, halo)
                    key, tile = (ci[a], cj[a]), _Tile()
                if not seg[a]:
                    tile.parts.append((k[a:b], ax[a:b], ay[a:b]))
                elif tile.parts:
                    tile.meet(k[a:b], ax[a:b], ay[a:b], bx[a:b], by[a:b])
        if tile is not None and tile.parts:
            yield tile.rows(*key, size, halo)

    return run


def _all_nearest(sent: Broadcast):
    """Rows (id, px, py) to (id, fid, d): the ties of a few points are held, none of their other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if not len(table):
            return
        features = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        fid, at = features.indices.to_numpy(), [c.to_numpy() for c in table.columns[1:]]
        box = _boxes(*at)
        for batch in batches:
            tile = _Tile()
            tile.parts.append((np.arange(len(batch)), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            tile.begin()
            for k in range(0, len(batch), TILE_POINTS):
                tile.compare(k, box, fid, *at)
                if tile.ties and (tile.kept > TILE_TIES or k + TILE_POINTS >= len(batch)):
                    i, f, d = tile.thinned()
                    tile.ties, tile.kept = [], 0
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tile.k[i])), features.dictionary.take(pa.array(f)), pa.array(d)], [batch.schema.names[0], table.column_names[0], "d"])

    return run


def buffered_intersects(points: DataFrame, s: DataFrame, buffer: float, **kw) -> DataFrame:
    """(id, fid) of the features at most ``buffer`` away from a point: the exact distance in place of a polygonal buffer."""
    size = buffer if buffer > 0 else 1.0
    i, j = F.floor(F.col("px") / lit(size)).cast("long"), F.floor(F.col("py") / lit(size)).cast("long")
    around = points.select("id", "px", "py", F.explode(F.sequence(i - 1, i + 1)).alias("ci"), j.alias("j")).select("*", F.explode(F.sequence(F.col("j") - 1, F.col("j") + 1)).alias("cj"))
    d2 = point_segment_dist2(*_cols(*P, *A, *B))
    return around.join(_cells(s, size), ["ci", "cj"]).where(d2 <= lit(buffer * buffer)).select("id", "fid").distinct()


def pack(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    """Nested parts of rings of vertices, a row a feature."""
    ring = vertices.groupBy(fid, "part_index", "ring_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_index", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))
    part = ring.groupBy(fid, "part_index").agg(F.array_sort(F.collect_list(F.struct("ring_index", "vertices"))).alias("rings"))
    return part.groupBy(fid).agg(F.array_sort(F.collect_list(F.struct("part_index", "rings"))).alias("parts"))


def flatten(features: DataFrame, fid: str = "fid") -> DataFrame:
    """Back to a row a vertex."""
    part = features.select(fid, F.explode("parts").alias("p")).select(fid, F.col("p.part_index").alias("part_index"), F.explode("p.rings").alias("r"))
    return part.select(fid, "part_index", F.col("r.ring_index").alias("ring_index"), F.posexplode("r.vertices").alias("vertex_index", "v")).select(fid, "part_index", "ring_index", "vertex_index", "v.x", "v.y")


def convex_hull(points: DataFrame, x: str = "px", y: str = "py") -> list[tuple[float, float]]:
    """The hull's corners, counter-clockwise. Each of 64 directions' extreme points prune the rest before the driver's chain."""
    from math import cos, pi, sin

    dirs = [(cos(2 * pi * k / 64), sin(2 * pi * k / 64)) for k in range(64)]
    ends = points.agg(*[F.max_by(F.struct(x, y), lit(a) * F.col(x) + lit(b) * F.col(y)).alias(f"d{k}") for k, (a, b) in enumerate(dirs)]).first()
    inner = _chain([(e[0], e[1]) for e in ends if e is not None])
    rest = points.select(x, y)
    if len(inner) >= 3:  # what lies well inside the inner polygon can't be a corner
        keep = F.lit(False)
        for (ax, ay), (bx, by) in zip(inner, inner[1:] + inner[:1]):
            keep = keep | ((lit(bx - ax) * (F.col(y) - lit(ay)) - lit(by - ay) * (F.col(x) - lit(ax))) <= 1e-9)
        rest = rest.where(keep)
    return _chain([(r[0], r[1]) for r in rest.distinct().collect()])


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull_distance(points: DataFrame, point_id: str = "id") -> DataFrame:
    """Distance of each point to the boundary of the convex hull of all; the hull's corners are a bounded literal."""
    hull = convex_hull(points)
    ds = [point_segment_dist2(F.col("px"), F.col("py"), lit(a), lit(b), lit(c), lit(d)) for (a, b), (c, d) in zip(hull, hull[1:] + hull[:1])]
    best = ds[0] if len(ds) == 1 else F.least(*ds) if ds else lit(0)
    return points.select(point_id, F.sqrt(best).alias("hull_distance"))


def bbox_diagonal(vertices: DataFrame, fid: str = "fid") -> DataFrame:
    return bounds(vertices, fid).select(fid, F.sqrt((F.col("maxx") - F.col("minx")) ** 2 + (F.col("maxy") - F.col("miny")) ** 2).alias("diagonal"))
