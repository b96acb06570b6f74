"""Scalar expressions as Columns: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, functions as F

D = "double"
#: Scores of the flood zones, and the weights of the composite.
ZONE_SCORES = {"X": 10.0, "AO": 80.0, "A": 90.0, "AE": 95.0, "VE": 100.0}
WEIGHTS = {"zone": 0.40, "water": 0.35, "terrain_absolute": 0.15, "terrain_relative": 0.10}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


def lit(x: float) -> Column:
    return F.lit(float(x))


def round_half_up(c: Column, places: int) -> Column:
    """A double of 0 or more, rounded in binary arithmetic as DuckDB does; Spark's own goes through decimals, at many times the cost."""
    return F.floor(c * lit(10**places) + lit(0.5)).cast("double") / lit(10**places)


def normalize_string(c: Column) -> Column:
    """Without white space at its ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def strict_bool(c: Column) -> Column:
    """True or false by the vocabulary; any other text raises; null stays null."""
    t = F.lower(normalize_string(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def lenient_bool(c: Column) -> Column:
    """As ``strict_bool`` but null for any other text."""
    t = F.lower(normalize_string(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def native_bool(c: Column) -> Column:
    """T, TRUE, Y, YES and 1 in either case are true, everything else false, as the native readers have it."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin("T", "TRUE", "Y", "YES", "1"), F.lit(False))


def csv_escape(c: Column) -> Column:
    """Quoted, with doubled quotes, where the text holds a comma, quote or line end."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def canonical_id(cls: Column, source_id: Column) -> Column:
    return F.concat_ws(":", cls, source_id.cast("string"))


def nullable_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def zone_score(zone: Column, matched: Column) -> Column:
    """0 where unmatched, the zone's score, or an error for an unknown zone."""
    z = F.upper(normalize_string(zone))
    out = F.when(~matched, lit(0))
    for name, score in ZONE_SCORES.items():
        out = out.when(z == name, lit(score))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown zone: "), F.coalesce(z, F.lit("null")))).cast(D))


def composite(zone: Column, water: Column, absolute: Column, relative: Column, w: dict | None = None) -> Column:
    """The weighted sum, terms in this order, rounded to 9 places before it is ranked."""
    w = w or WEIGHTS
    k = {n: (v if isinstance(v, Column) else lit(v)) for n, v in w.items()}
    return F.round(k["zone"] * zone + k["water"] * water + k["terrain_absolute"] * absolute + k["terrain_relative"] * relative, 9)


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def point_segment_dist2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment; of zero length, from its point."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.greatest(lit(0), F.least(lit(1), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, lit(0))))
    cx, cy = ax + t * dx, ay + t * dy
    return F.when(n == 0, dist2(px, py, ax, ay)).otherwise(dist2(px, py, cx, cy))


def crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the ray from the point to the right crosses the segment; half-open in y."""
    x = (bx - ax) * (py - ay) / F.nullif(by - ay, lit(0)) + ax
    return F.coalesce(((ay > py) != (by > py)) & (px < x), F.lit(False))


def bbox_dist2(px: Column, py: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A lower bound for all that lies in the box: 0 inside it."""
    dx, dy = F.greatest(minx - px, lit(0), px - maxx), F.greatest(miny - py, lit(0), py - maxy)
    return dx * dx + dy * dy


def bbox_contains(px: Column, py: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return px.between(minx, maxx) & py.between(miny, maxy)


def segment_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(dist2(ax, ay, bx, by))


def split_pieces(length: Column, cap: float) -> Column:
    """Equal pieces that no cap exceeds: one where the cap is 0 or less, or the length is within it or not finite."""
    whole = (length <= cap) | F.isnan(length) | (length == float("inf"))
    return F.lit(1).cast("int") if cap <= 0 else F.when(whole, 1).otherwise(F.ceil(length / lit(cap))).cast("int")


def interpolate(a: Column, b: Column, piece: Column, pieces: Column) -> Column:
    """Where a piece begins between a and b; the last end is b itself."""
    return F.when(piece >= pieces, b).otherwise(a + (b - a) * (piece.cast(D) / pieces.cast(D)))


def block_id(v: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((v - lit(origin)) / lit(size)).cast("long")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of the parts joined by ':'; the same in any engine and row order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long").cast(D) / lit(2**52)


def hash_fold(k: int, *parts: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long"), F.lit(k)).cast("int")


def split_label(u: Column, train: float = 0.70, val: float = 0.85) -> Column:
    return F.when(u < train, "train").when(u < val, "validation").otherwise("test")


def role(fold: Column, k: Column, folds: int) -> Column:
    """A block's role in round k: its own fold tests, the next one's validates."""
    return F.when(fold == k, "test").when(fold == (k + 1) % folds, "validation").otherwise("train")


def mask_bit(k: Column) -> Column:
    """2**k as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def has_bit(mask: Column, k: Column | int) -> Column:
    return F.getbit(mask, F.lit(k) if isinstance(k, int) else k.cast("int")) == 1


def grid_normalize(v: Column, low: float | Column, high: float | Column, bits: int) -> Column:
    """The cell of 2**bits along one axis; the ends belong to the first and last cell."""
    low, high = (x if isinstance(x, Column) else lit(x) for x in (low, high))
    top = (1 << bits) - 1
    cell = F.floor((v - low) * (lit(1 << bits) / F.nullif(high - low, lit(0)))).cast("long")
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def hilbert_key(x: Column, y: Column, bits: int) -> Column:
    """Position of a cell along the Hilbert curve of ``bits`` bits an axis; up to 31 fit a long."""
    init = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = mask_bit(k)
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        d = s["d"] + side * side * (F.lit(3) * rx).bitwiseXOR(ry)
        # Turn the quarter so that the curve goes on: swapped if ry is 0, and then mirrored if rx is 1.
        low = side - 1
        mx = F.when((ry == 0) & (rx == 1), low - s["x"].bitwiseAND(low)).otherwise(s["x"].bitwiseAND(low))
        my = F.when((ry == 0) & (rx == 1), low - s["y"].bitwiseAND(low)).otherwise(s["y"].bitwiseAND(low))
        return F.struct(d.alias("d"), F.when(ry == 0, my).otherwise(mx).alias("x"), F.when(ry == 0, mx).otherwise(my).alias("y"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), init, step, lambda s: s["d"])


def affine_cell(x: Column, y: Column, x0: float, y0: float, width: float, height: float) -> tuple[Column, Column]:
    """(row, column) of the cell that holds a point; the origin is the upper left corner."""
    return F.floor((lit(y0) - y) / lit(height)).cast("long"), F.floor((x - lit(x0)) / lit(width)).cast("long")


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n.cast("long") - 1))).cast("int")


def key_normalize(k: Column, low: Column, high: Column) -> Column:
    return (k.cast(D) - low.cast(D)) * (lit(1) / F.nullif((high - low).cast(D), lit(0)))


def to_numeric(c: Column) -> Column:
    """A double; other text raises."""
    return c.cast(D)


def to_numeric_or_null(c: Column) -> Column:
    return c.try_cast(D)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 from degrees."""
    r = lit(6378137.0)
    return r * F.radians(lon), r * F.log(F.tan(lit(pi / 4) + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = lit(6378137.0)
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - lit(pi / 2))


#: Semi-major axis and flattening of GRS 80.
_A, _F = 6378137.0, 1 / 298.257222101


def utm(lon: Column, lat: Column, zone: int = 18) -> tuple[Column, Column]:
    """Transverse Mercator by the series of Krüger to the sixth order; zone 18 on GRS 80 is EPSG:26918."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    e = sqrt(_F * (2 - _F))
    phi, lam = F.radians(lat), F.radians(lon - lit(6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - lit(e) * F.atanh(lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996 * radius
    return lit(500000.0) + lit(k) * east, lit(k) * north


def split_annotation(c: Column) -> tuple[Column, Column]:
    """('value', 'annotation') of ``value (annotation)``; the annotation is null without one."""
    pattern = r"^\s*(.*?)\s*(?:\(([^()]*)\))?\s*$"
    return F.regexp_extract(c, pattern, 1), F.nullif(F.regexp_extract(c, pattern, 2), F.lit(""))


def resolved_comparison(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> Column:
    """Whether a ratio's interval [min a / max b, max a / min b] leaves 1 out."""
    low, high = min_a / max_b, max_a / min_b
    return F.when(low > 1, "A SLOWER").when(high < 1, "A FASTER").otherwise("NOT RESOLVED")


def fourier(x: Column, y: Column, rows: list[tuple[float, float]]) -> Column:
    """[x, y, cos(2 pi B p)..., sin(2 pi B p)...] for the rows of B."""
    angles = [lit(2 * pi) * (lit(a) * x + lit(b) * y) for a, b in rows]
    return F.array(x, y, *[F.cos(t) for t in angles], *[F.sin(t) for t in angles])


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 1e-9) -> Column:
    """Whether the point lies on the segment, within the tolerance."""
    return point_segment_dist2(px, py, ax, ay, bx, by) <= lit(tolerance * tolerance)
