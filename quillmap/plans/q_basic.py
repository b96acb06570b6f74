"""Queries of sources, projections, filters, scalar functions, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G, joins as J, validation as V, windows as W
from ..operators.learned import curve_keys, square_key_range
from ..operators.splits import with_blocks
from ..sources.scratch import spread
from .registry import query

lit, col = S.lit, F.col


@query("src_csv", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 0")
def _(t):
    """The columns and filter that a typed scan is given reach the reader."""
    return t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority").where(col("o_totalprice") > 0)


@query("src_cpp_csv", "SELECT fid, count(*) AS vertices FROM fx_line_vertices GROUP BY fid HAVING min(vertex_index) = 0 AND max(vertex_index) = count(*) - 1")
def _(t):
    return V.ring_report(t("fx_line_vertices")).where("contiguous").groupBy("fid").agg(F.sum("vertices").cast("long").alias("vertices"))


@query("src_raster", "SELECT cell_row, cell_col, z FROM fx_dem WHERE cell_row BETWEEN 40 AND 60")
def _(t):
    return t("fx_dem").where(col("cell_row").between(40, 60))


@query("sink_vertices", "SELECT fid, part_index, ring_index, vertex_index, x, y FROM fx_poly_vertices")
def _(t):
    return G.flatten(G.pack(t("fx_poly_vertices")))


@query("proj_reproject", "SELECT id, round(6378137.0 * radians(x / 100 - 120), 6) AS mx, round(CAST(6378137.0 AS DOUBLE) * ln(tan(pi() / 4 + radians(y / 200 - 20) / 2)), 5) AS my FROM fx_points")
def _(t):
    x, y = S.web_mercator(col("x") / 100 - 120, col("y") / 200 - 20)
    return t("fx_points").select("id", F.round(x, 6).alias("mx"), F.round(y, 5).alias("my"))


@query("proj_rename_select", "SELECT id AS property_id, x AS projected_x, y AS projected_y FROM fx_points")
def _(t):
    return t("fx_points").select(col("id").alias("property_id"), col("x").alias("projected_x"), col("y").alias("projected_y"))


@query("proj_canonical_id", "SELECT id, cls || ':' || CAST(id AS VARCHAR) AS canonical FROM fx_points")
def _(t):
    return t("fx_points").select("id", S.canonical_id(col("cls"), col("id")).alias("canonical"))


@query("proj_zone_canon", "SELECT property_id, nullif(trim(label), '') AS zone FROM fx_candidate")
def _(t):
    from ..sources.files import first_field

    df = t("fx_candidate")
    return df.select("property_id", S.normalize_string(col(first_field(df, ["FLD_ZONE", "zone", "Label"]))).alias("zone"))


@query("flt_type_domain", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return t("customer").select("c_custkey", "c_mktsegment").where(col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query("flt_null_geom", "SELECT count(*) FILTER (WHERE label IS NULL) AS dropped, count(label) AS kept FROM fx_candidate")
def _(t):
    return t("fx_candidate").agg(F.count_if(col("label").isNull()).alias("dropped"), F.count("label").alias("kept"))


@query("flt_bbox", "SELECT fid FROM fx_poly_vertices GROUP BY fid HAVING min(x) <= 5000 AND max(x) >= 1000 AND min(y) <= 4000 AND max(y) >= 500")
def _(t):
    box = t.spark.createDataFrame([(1000.0, 500.0, 5000.0, 4000.0)], "minx double, miny double, maxx double, maxy double")
    return G.in_box(t("fx_poly_vertices"), box)


@query("flt_envelope", "SELECT min(x) - CAST(250 AS DOUBLE) AS minx, min(y) - CAST(250 AS DOUBLE) AS miny, max(x) + CAST(250 AS DOUBLE) AS maxx, max(y) + CAST(250 AS DOUBLE) AS maxy FROM fx_points")
def _(t):
    return G.envelope(t("fx_points"), 250.0, "x", "y")


@query("flt_scope", "SELECT DISTINCT v.fid FROM fx_line_vertices v WHERE v.fid IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def _(t):
    seen = t("events").where(col("event_id") % 50 == 0).select(col("user_id").alias("fid"))
    return t("fx_line_vertices").select("fid").distinct().join(seen, "fid", "left_semi")


@query("flt_ids", "SELECT id, x, y FROM fx_points WHERE id IN (1, 5, 7, 100)")
def _(t):
    return J.ids_present(t("fx_points").select("id", "x", "y"), [1, 5, 7, 100], "id")


@query("pred_bbox_contains", "SELECT p.id, c.fid FROM fx_points p JOIN fx_poly_centres c ON p.x BETWEEN c.cx - c.half AND c.cx + c.half AND p.y BETWEEN c.cy - c.half AND c.cy + c.half")
def _(t):
    c = t("fx_poly_centres").withColumns({"minx": col("cx") - col("half"), "maxx": col("cx") + col("half"), "miny": col("cy") - col("half"), "maxy": col("cy") + col("half")})
    cells = c.select("*", F.explode(F.sequence(F.floor(col("minx") / 1000), F.floor(col("maxx") / 1000))).alias("ci")).select("*", F.explode(F.sequence(F.floor(col("miny") / 1000), F.floor(col("maxy") / 1000))).alias("cj"))
    p = t("fx_points").withColumns({"ci": F.floor(col("x") / 1000), "cj": F.floor(col("y") / 1000)})
    return p.join(cells, ["ci", "cj"]).where(S.bbox_contains(*map(col, ("x", "y", "minx", "miny", "maxx", "maxy")))).select("id", "fid")


_SEGMENTS = "SELECT fid, part_index, ring_index, vertex_index AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM {v} WINDOW w AS (PARTITION BY fid, part_index, ring_index ORDER BY vertex_index)"
LINES = f"(SELECT * FROM ({_SEGMENTS.format(v='fx_line_vertices')}) WHERE bx IS NOT NULL)"
POLYS = f"(SELECT * FROM ({_SEGMENTS.format(v='fx_poly_vertices')}) WHERE bx IS NOT NULL)"
D2 = """CASE WHEN (bx-ax)*(bx-ax)+(by-ay)*(by-ay) = 0 THEN (px-ax)*(px-ax)+(py-ay)*(py-ay) ELSE
 (px-(ax+greatest(CAST(0 AS DOUBLE),least(CAST(1 AS DOUBLE),((px-ax)*(bx-ax)+(py-ay)*(by-ay))/nullif((bx-ax)*(bx-ax)+(by-ay)*(by-ay),0)))*(bx-ax)))*(px-(ax+greatest(CAST(0 AS DOUBLE),least(CAST(1 AS DOUBLE),((px-ax)*(bx-ax)+(py-ay)*(by-ay))/nullif((bx-ax)*(bx-ax)+(by-ay)*(by-ay),0)))*(bx-ax)))
 +(py-(ay+greatest(CAST(0 AS DOUBLE),least(CAST(1 AS DOUBLE),((px-ax)*(bx-ax)+(py-ay)*(by-ay))/nullif((bx-ax)*(bx-ax)+(by-ay)*(by-ay),0)))*(by-ay)))*(py-(ay+greatest(CAST(0 AS DOUBLE),least(CAST(1 AS DOUBLE),((px-ax)*(bx-ax)+(py-ay)*(by-ay))/nullif((bx-ax)*(bx-ax)+(by-ay)*(by-ay),0)))*(by-ay))) END"""


def points(t):
    return t("fx_points").select("id", col("x").alias("px"), col("y").alias("py"), "v", "cls")


POINTS = "(SELECT id, x AS px, y AS py, v, cls FROM fx_points)"


@query("fn_point_segment_dist2", f"SELECT id, fid, seg, round({D2}, 6) AS d2 FROM {POINTS} p JOIN {LINES} s ON p.id = s.fid")
def _(t):
    j = points(t).join(W.segments(t("fx_line_vertices")), col("id") == col("fid"))
    return j.select("id", "fid", "seg", F.round(S.point_segment_dist2(*map(col, ("px", "py", "ax", "ay", "bx", "by"))), 6).alias("d2"))


@query("fn_segment_length", f"SELECT fid, seg, round(sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)), 9) AS length FROM {LINES}")
def _(t):
    return W.segments(t("fx_line_vertices")).select("fid", "seg", F.round(S.segment_length(*map(col, ("ax", "ay", "bx", "by"))), 9).alias("length"))


@query("fn_split_pieces", f"""SELECT fid, seg, piece, round(ax + (bx-ax)*(CAST(piece AS DOUBLE)/n), 6) AS sx, round(CASE WHEN piece+1 >= n THEN bx ELSE ax + (bx-ax)*(CAST(piece+1 AS DOUBLE)/n) END, 6) AS ex
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS piece FROM (SELECT *, CASE WHEN len <= 25 THEN 1 ELSE CAST(ceil(len/25) AS INT) END AS n FROM (SELECT *, sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)) AS len FROM {LINES})))""")
def _(t):
    s = G.split_segments(W.segments(t("fx_line_vertices")), 25.0)
    return s.select("fid", "seg", col("piece").cast("long").alias("piece"), F.round("ax", 6).alias("sx"), F.round("bx", 6).alias("ex"))


@query("agg_segment_stats", f"""SELECT count(*) AS segments, round(sum(len), 6) AS total_length, round(max(len), 6) AS max_length, count(*) FILTER (WHERE len > 100) AS over_100, count(*) FILTER (WHERE len > 200) AS over_200,
 count(*) FILTER (WHERE len > 500) AS over_500, count(*) FILTER (WHERE len > 1000) AS over_1000, CAST(sum(CASE WHEN len <= 25 THEN 1 ELSE ceil(len/25) END) AS BIGINT) AS pieces FROM (SELECT sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)) AS len FROM {LINES})""")
def _(t):
    return G.segment_stats(W.segments(t("fx_line_vertices")), 25.0)


@query("fn_bounds", "SELECT fid, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM fx_poly_vertices GROUP BY fid")
def _(t):
    return G.bounds(t("fx_poly_vertices"), "fid")


@query("fn_bbox_dist2", """SELECT id, fid, power(greatest(cx-half-x, 0, x-cx-half), 2) + power(greatest(cy-half-y, 0, y-cy-half), 2) AS d2 FROM fx_points, fx_poly_centres""")
def _(t):
    j = spread(t("fx_points"), "id").crossJoin(F.broadcast(t("fx_poly_centres")))  # all pairs are the result
    return j.select("id", "fid", S.bbox_dist2(col("x"), col("y"), col("cx") - col("half"), col("cy") - col("half"), col("cx") + col("half"), col("cy") + col("half")).alias("d2"))


@query("bbox_diagonal", "SELECT fid, round(sqrt(power(max(x)-min(x),2)+power(max(y)-min(y),2)), 9) AS diagonal FROM fx_poly_vertices GROUP BY fid")
def _(t):
    return G.bbox_diagonal(t("fx_poly_vertices")).withColumn("diagonal", F.round("diagonal", 9))


@query("agg_study_area_stats", f"SELECT fid, sum(CASE WHEN ring_index = 0 THEN a ELSE -a END) AS area FROM (SELECT fid, ring_index, abs(sum(ax*by-bx*ay))/2 AS a FROM {POLYS} GROUP BY fid, part_index, ring_index) GROUP BY fid")
def _(t):
    return G.ring_area(t("fx_poly_vertices"))


@query("fn_grid_normalize", "SELECT id, CAST(least(greatest(floor(x * (CAST(1024 AS DOUBLE)/10007)), 0), 1023) AS BIGINT) AS cx FROM fx_points")
def _(t):
    return t("fx_points").select("id", S.grid_normalize(col("x"), 0.0, 10007.0, 10).alias("cx"))


def _hilbert_sql(bits: int, cx: str, cy: str) -> str:
    """The curve's position, unrolled a bit a step."""
    sql = f"SELECT *, {cx} AS hx, {cy} AS hy, CAST(0 AS BIGINT) AS d FROM fx_points"
    for k in range(bits - 1, -1, -1):
        s = 1 << k
        sql = f"SELECT * EXCLUDE (hx, hy, d, rx, ry), d + {s * s} * xor(3*rx, ry) AS d, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - (hy & {s - 1}) ELSE hy & {s - 1} END ELSE hx & {s - 1} END AS hx, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - (hx & {s - 1}) ELSE hx & {s - 1} END ELSE hy & {s - 1} END AS hy FROM (SELECT *, CASE WHEN hx & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN hy & {s} > 0 THEN 1 ELSE 0 END AS ry FROM ({sql}))"
    return sql


_CELL = "CAST(least(greatest(floor(({c} - (SELECT min({c}) FROM fx_points)) * (CAST({n} AS DOUBLE) / ((SELECT max({c}) FROM fx_points) - (SELECT min({c}) FROM fx_points)))), 0), {m}) AS BIGINT)"
_CX, _CY = (_CELL.format(c=c, n=64, m=63) for c in "xy")


@query("fn_hilbert_xy2d", f"SELECT id, d AS key FROM ({_hilbert_sql(6, _CX, _CY)})")
def _(t):
    return curve_keys(t("fx_points"), 6, "x", "y").select("id", "key")


@query("sort_index_key_order", f"SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM ({_hilbert_sql(6, _CX, _CY)})")
def _(t):
    k = curve_keys(t("fx_points"), 6, "x", "y").select("id", "key")
    return W.with_ordinal(k, "key", "id", "n", scale=True).select("id", (col("n") - 1).alias("pos"))


@query("fn_square_key_range", f"SELECT id, CAST(floor(d / 16) * 16 AS BIGINT) AS low, CAST(floor(d / 16) * 16 + 16 AS BIGINT) AS high FROM ({_hilbert_sql(6, _CX, _CY)})")
def _(t):
    k = curve_keys(t("fx_points"), 6, "x", "y")
    low = (F.floor(col("key") / 16) * 16).cast("long")
    return k.select("id", low.alias("low"), (low + 16).alias("high"))


@query("hilbert_distinct_cells", "SELECT b AS bits, count(DISTINCT (" + _CELL.replace("{n}", "n").replace("{m}", "n - 1").format(c="x") + ", " + _CELL.replace("{n}", "n").replace("{m}", "n - 1").format(c="y") + ")) AS cells FROM fx_points CROSS JOIN (VALUES (2, 4), (4, 16), (6, 64), (8, 256)) AS o(b, n) GROUP BY b")
def _(t):
    from ..operators.learned import distinct_cells

    return distinct_cells(t("fx_points"), [2, 4, 6, 8], "x", "y")


@query("fn_block_id", "SELECT id, CAST(floor(x/800) AS BIGINT) AS block_i, CAST(floor(y/800) AS BIGINT) AS block_j FROM fx_points")
def _(t):
    return with_blocks(t("fx_points"), 800.0, "x", "y").select("id", "block_i", "block_j")


_U = "CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT)"


@query("fn_block_uniform", f"SELECT DISTINCT i AS block_i, j AS block_j, {_U.format(parts='7, i, j')} / CAST(4503599627370496 AS DOUBLE) AS u FROM (SELECT CAST(floor(x/800) AS BIGINT) AS i, CAST(floor(y/800) AS BIGINT) AS j FROM fx_points)")
def _(t):
    b = with_blocks(t("fx_points"), 800.0, "x", "y").select("block_i", "block_j").distinct()
    return b.withColumn("u", S.hash_uniform(F.lit(7), col("block_i"), col("block_j")))


@query("fn_block_uniform_digest")
def _(t):
    from ..operators.splits import digest_uniform

    return digest_uniform(with_blocks(t("fx_points"), 800.0, "x", "y"), 7)


@query("fn_block_fold", f"SELECT DISTINCT i AS block_i, j AS block_j, CAST({_U.format(parts='7, i, j')} % 5 AS INT) AS fold FROM (SELECT CAST(floor(x/800) AS BIGINT) AS i, CAST(floor(y/800) AS BIGINT) AS j FROM fx_points)")
def _(t):
    b = with_blocks(t("fx_points"), 800.0, "x", "y").select("block_i", "block_j").distinct()
    return b.withColumn("fold", S.hash_fold(5, F.lit(7), col("block_i"), col("block_j")))


@query("fn_label_for_uniform", f"SELECT id, CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, {_U.format(parts='3, id')} / CAST(4503599627370496 AS DOUBLE) AS u FROM fx_points)")
def _(t):
    return t("fx_points").select("id", S.split_label(S.hash_uniform(F.lit(3), col("id"))).alias("split"))


@query("random_split_iid", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT {_U.format(parts='11, o_orderkey')} / CAST(4503599627370496 AS DOUBLE) AS u FROM orders)) GROUP BY split")
def _(t):
    return t("orders").select(S.split_label(S.hash_uniform(F.lit(11), col("o_orderkey"))).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("fn_roles", "SELECT id, k, CASE WHEN id % 5 = k THEN 'test' WHEN id % 5 = (k + 1) % 5 THEN 'validation' ELSE 'train' END AS role FROM fx_points, (VALUES (0),(1),(2),(3),(4)) AS f(k)")
def _(t):
    from ..operators.splits import roles

    return roles(t("fx_points").withColumn("fold", col("id") % 5), 5)


@query("fn_drop_mask", "SELECT fold, CAST(sum(m) AS BIGINT) AS mask, max(m) >= 8 AS has_3 FROM (SELECT DISTINCT c_nationkey AS fold, CAST(power(2, c_custkey % 5) AS BIGINT) AS m FROM customer) GROUP BY fold")
def _(t):
    m = t("customer").groupBy(col("c_nationkey").alias("fold")).agg(F.bit_or(S.mask_bit(col("c_custkey") % 5)).alias("mask"))
    return m.withColumn("has_3", S.has_bit(col("mask"), 3) | S.has_bit(col("mask"), 4))


@query("fn_zone_score", "SELECT property_id, CAST(CASE zone WHEN 'X' THEN 10 WHEN 'AO' THEN 80 WHEN 'A' THEN 90 WHEN 'AE' THEN 95 WHEN 'VE' THEN 100 END AS DOUBLE) AS score FROM fx_scoring")
def _(t):
    return t("fx_scoring").select("property_id", S.zone_score(col("zone"), col("matched")).alias("score"))


@query("fn_strict_bool", "SELECT l_orderkey, l_linenumber, l_suppkey, l_linestatus = 'F' AS flag FROM lineitem WHERE l_linestatus IN ('F', 'O')")
def _(t):
    text = F.when(col("l_linestatus") == "F", " Yes ").otherwise("NO")
    return t("lineitem").where(col("l_linestatus").isin("F", "O")).select("l_orderkey", "l_linenumber", "l_suppkey", S.strict_bool(text).alias("flag"))


@query("fn_lenient_bool", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false END AS lenient, false AS native FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def _(t):
    s = col("o_orderstatus")
    return t("orders").where(s.isin("F", "O", "P")).select("o_orderkey", S.lenient_bool(s).alias("lenient"), S.native_bool(s).alias("native"))


@query("fn_normalize_string", "SELECT o_orderkey, nullif(trim(substr(o_orderpriority, 2, 2)), '-') AS a, CASE WHEN o_orderpriority LIKE '% %' THEN o_orderpriority END AS b FROM orders")
def _(t):
    p = col("o_orderpriority")
    return t("orders").select("o_orderkey", F.nullif(S.normalize_string(F.substring(p, 2, 2)), F.lit("-")).alias("a"), F.when(p.contains(" "), S.normalize_string(F.concat(F.lit("\t "), p, F.lit(" \n")))).alias("b"))


@query("fn_csv_escape", """SELECT id, CASE WHEN id % 3 = 0 THEN '"a,' || cls || '"' WHEN id % 3 = 1 THEN '"x""' || cls || '"' ELSE cls END AS escaped FROM fx_points""")
def _(t):
    raw = F.when(col("id") % 3 == 0, F.concat(F.lit("a,"), "cls")).when(col("id") % 3 == 1, F.concat(F.lit('x"'), "cls")).otherwise(col("cls"))
    return t("fx_points").select("id", S.csv_escape(raw).alias("escaped"))


@query("fn_nullable_equal", "SELECT o.o_orderkey, (c.label IS NOT DISTINCT FROM o.o_orderpriority) AS same FROM orders o JOIN fx_candidate c ON o.o_orderkey = c.property_id")
def _(t):
    c = t("fx_candidate")
    return t("orders").join(c, col("o_orderkey") == col("property_id")).select("o_orderkey", S.nullable_equal(col("label"), col("o_orderpriority")).alias("same"))


@query("fn_to_numeric", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS number, TRY_CAST(o_orderstatus AS DOUBLE) AS coerced FROM orders")
def _(t):
    return t("orders").select("o_orderkey", S.to_numeric(F.substring("o_orderpriority", 1, 1)).alias("number"), S.to_numeric_or_null(col("o_orderstatus")).alias("coerced"))


@query("fn_affine_to_cell", "SELECT id, CAST(floor((10100 - y) / 100) AS BIGINT) AS cell_row, CAST(floor(x / 100) AS BIGINT) AS cell_col FROM fx_points")
def _(t):
    r, c = S.affine_cell(col("x"), col("y"), 0.0, 10100.0, 100.0, 100.0)
    return t("fx_points").select("id", r.alias("cell_row"), c.alias("cell_col"))


@query("fn_ceil_log2", "SELECT id, CAST(CASE WHEN id <= 1 THEN 0 ELSE length(ltrim(CAST(bin(id - 1) AS VARCHAR), '0')) END AS INT) AS bits FROM fx_points")
def _(t):
    return t("fx_points").select("id", S.ceil_log2(col("id")).alias("bits"))


@query("fn_key_normalize", "SELECT id, round((CAST(id AS DOUBLE) - lo) * (1 / CAST(hi - lo AS DOUBLE)), 12) AS t FROM fx_points, (SELECT min(id) AS lo, max(id) AS hi FROM fx_points)")
def _(t):
    p = t("fx_points")
    ends = p.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return p.crossJoin(F.broadcast(ends)).select("id", F.round(S.key_normalize(col("id"), col("lo"), col("hi")), 12).alias("t"))


@query("fn_fourier_features")
def _(t):
    f = S.fourier(col("x") / 10007, col("y") / 10009, [(1.0, 0.5), (0.25, 2.0)])
    return t("fx_points").select("id", F.transform(f, lambda v: F.round(v, 9)).alias("features"))


@query("fn_split_annotation", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS value, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS annotation FROM orders")
def _(t):
    k = col("o_custkey").cast("string")
    raw = F.when(col("o_orderkey") % 2 == 0, F.concat(k, F.lit(" ("), "o_orderpriority", F.lit(")"))).otherwise(F.concat(F.lit(" "), k))
    value, note = S.split_annotation(raw)
    return t("orders").select("o_orderkey", value.alias("value"), note.alias("annotation"))


@query("fn_resolved_comparison", "SELECT n_nationkey, CASE WHEN n_nationkey / CAST(12 AS DOUBLE) > 1 THEN 'A SLOWER' WHEN (n_nationkey + 5) / CAST(10 AS DOUBLE) < 1 THEN 'A FASTER' ELSE 'NOT RESOLVED' END AS verdict FROM nation")
def _(t):
    n = col("n_nationkey").cast("double")
    return t("nation").select("n_nationkey", S.resolved_comparison(n, n + 5, lit(10), lit(12)).alias("verdict"))


@query("fn_sha256", "SELECT sha256(cls) AS digest, count(*) AS n FROM fx_points GROUP BY cls")
def _(t):
    return t("fx_points").groupBy("cls").agg(F.count("*").alias("n")).select(F.sha2("cls", 256).alias("digest"), "n")


@query("distinct_referenced_features", "SELECT DISTINCT o_custkey AS feature FROM orders WHERE o_custkey IS NOT NULL")
def _(t):
    return t("orders").select(col("o_custkey").alias("feature")).where("feature is not null").distinct().orderBy("feature")


@query("export_projected_points", "SELECT id AS sample_order, CAST(id AS VARCHAR) AS property_id, x AS projected_x, y AS projected_y FROM fx_points")
def _(t):
    return t("fx_points").select(col("id").alias("sample_order"), col("id").cast("string").alias("property_id"), col("x").alias("projected_x"), col("y").alias("projected_y"))


@query("sort_stable_key", "SELECT id, row_number() OVER (ORDER BY id) AS place FROM fx_points")
def _(t):
    from ..operators.learned import positions

    p = t("fx_points").select("id")
    return p.join(positions(p, "id"), "id").select("id", (col("pos") + 1).cast("long").alias("place"))


@query("topk_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("topk_nsmallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)


@query("sort_abs_desc", "SELECT id, round(pred - label, 9) AS residual FROM fx_predictions ORDER BY abs(pred - label) DESC, id LIMIT 50")
def _(t):
    e = col("pred") - col("label")
    return t("fx_predictions").orderBy(F.desc(F.abs(e)), "id").limit(50).select("id", F.round(e, 9).alias("residual"))


@query("limit_head_examples", "SELECT 'o_over' AS \"check\", 'FAIL' AS status, count(*) FILTER (WHERE o_totalprice > 400000) AS n, (SELECT list(k ORDER BY k) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_totalprice > 400000 ORDER BY k LIMIT 10)) AS examples FROM orders HAVING count(*) FILTER (WHERE o_totalprice > 400000) > 0 UNION ALL SELECT 'o_over', 'PASS', 0, CAST([] AS VARCHAR[]) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return V.violations(t("orders"), [V.Rule("o_over", col("o_totalprice") > 400000)], "o_orderkey")


@query("sample_nested_prefix", "SELECT id, CAST(row_number() OVER (ORDER BY fresh, id) AS INT) AS sample_order FROM (SELECT id, 0 AS fresh FROM fx_points WHERE id < 20 UNION ALL (SELECT id, 1 FROM fx_points WHERE id >= 20 ORDER BY id LIMIT 30))")
def _(t):
    p = t("fx_points").select("id")
    kept = p.where("id < 20")
    both = kept.withColumn("fresh", F.lit(0)).unionByName(J.extension(p, kept, "id", 30).withColumn("fresh", F.lit(1)))
    return both.select("id", F.row_number().over(W.Window.orderBy("fresh", "id")).alias("sample_order"))


@query("sample_choice_seeded", "SELECT id FROM fx_points ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100")
def _(t):
    return t("fx_points").select("id").orderBy(F.md5(col("id").cast("string")), "id").limit(100)


@query("union_layers", "SELECT id AS fid, 'line' AS kind FROM fx_points WHERE id % 2 = 0 UNION ALL SELECT sid, 'polygon' FROM fx_sites")
def _(t):
    return t("fx_points").where("id % 2 = 0").select(col("id").alias("fid"), F.lit("line").alias("kind")).unionByName(t("fx_sites").select(col("sid").alias("fid"), F.lit("polygon").alias("kind")))


_DIFF = "SELECT '{n}' AS side, count(*) AS n, coalesce((SELECT list(k ORDER BY k) FROM (SELECT {k} AS k FROM {a} EXCEPT SELECT {j} FROM {b} ORDER BY 1 LIMIT 10)), []) AS examples FROM (SELECT {k} FROM {a} EXCEPT SELECT {j} FROM {b})"


@query("set_equality", _DIFF.format(n="left_only", k="o_orderkey", a="orders", j="property_id", b="fx_candidate") + " UNION ALL " + _DIFF.format(n="right_only", k="property_id", a="fx_candidate", j="o_orderkey", b="orders"))
def _(t):
    return J.set_difference(t("orders").select(col("o_orderkey").alias("k")), t("fx_candidate").select(col("property_id").alias("k")), "k")


@query("set_intersect_union", "SELECT count(*) FILTER (WHERE a AND b) AS both_n, count(*) FILTER (WHERE a OR b) AS either_n, round(count(*) FILTER (WHERE a AND b) / CAST(count(*) FILTER (WHERE a OR b) AS DOUBLE), 9) AS jaccard FROM (SELECT o_totalprice > 150000 AS a, o_custkey % 2 = 0 AS b FROM orders)")
def _(t):
    f = t("orders").select((col("o_totalprice") > 150000).alias("a"), (col("o_custkey") % 2 == 0).alias("b"))
    both, either = F.count_if(col("a") & col("b")), F.count_if(col("a") | col("b"))
    return f.agg(both.alias("both_n"), either.alias("either_n"), F.round(both / either, 9).alias("jaccard"))


@query("set_nesting", "SELECT 0 AS smaller, count(*) FILTER (WHERE id < 10 AND NOT id < 100) AS lost FROM fx_points UNION ALL SELECT 1, count(*) FILTER (WHERE id < 100 AND NOT id % 3 <> 1) FROM fx_points")
def _(t):
    from ..operators.evidence import nesting

    p = t("fx_points").select("id")
    return nesting([p.where("id < 10"), p.where("id < 100"), p.where("id % 3 <> 1")], "id")


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def _(t):
    return t("orders").select("o_custkey", "o_orderpriority").dropDuplicates()
