"""Queries that write and read again, and the remaining checks and helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G, learned as L, models as M, splits as P, validation as V, windows as W
from ..sources import files
from ..sources.scratch import folder
from .q_basic import D2, POLYS, points
from .q_products import _POS, keys
from .registry import query

col = F.col
_ORDERS = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"


def orders(t):
    return t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("sink_csv", _ORDERS)
def _(t):
    """Doubles keep their 17 digits on the way out and back."""
    path = folder(t.spark, "csv")
    files.write_csv(orders(t), path, "o_orderkey")
    return files.read_csv(t.spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("sink_jsonl", _ORDERS)
def _(t):
    path = folder(t.spark, "runs")
    for part in (col("o_orderkey") % 2 == 0, col("o_orderkey") % 2 != 0):
        files.append_runs(orders(t).where(part), path)
    return files.read_run_log(t.spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("src_pending_runs", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 <> 0")
def _(t):
    o = orders(t).select("o_orderkey")
    return files.pending(o, o.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@query("sink_geo_atomic", "SELECT fid, part_index, ring_index, vertex_index, x, y FROM fx_line_vertices")
def _(t):
    path = folder(t.spark, "vertices")
    files.write_vertices(t("fx_line_vertices"), path)
    return t.spark.read.parquet(path)


@query("src_geojson", "SELECT fid, 0 AS part_index, ring_index, vertex_index, x, y FROM fx_poly_vertices")
def _(t):
    """Polygons written as feature collections, a file for each block of 1,000 keys, and read back."""
    rings = F.transform("parts", lambda p: F.transform(p["rings"], lambda r: F.transform(r["vertices"], lambda v: F.array(v["x"], v["y"]))))[0]
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("fid"), col("fid").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    whole = G.pack(t("fx_poly_vertices")).groupBy(F.floor(col("fid") / 1000).alias("block")).agg(F.collect_list(feature).alias("features")).select("block", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    path = folder(t.spark, "geojson")
    whole.repartition("block").write.partitionBy("block").text(path)
    f = files.read_geojson(t.spark, path)
    return files.geojson_vertices(f.withColumn("fid", col("properties")["fid"].cast("long"))).select("fid", "part_index", "ring_index", "vertex_index", "x", "y")


@query("src_rest_layer", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 2, 3) AND p_partkey BETWEEN 100 AND 900")
def _(t):
    """A landed layer: type and envelope filters reach the scan."""
    return t("part").select("p_partkey", "p_size").where(col("p_size").isin(1, 2, 3) & col("p_partkey").between(100, 900))


@query("src_rest_points", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS sample_order FROM customer")
def _(t):
    """Landed points in the order of their object ids."""
    k = t("customer").select("c_custkey")
    return k.join(L.positions(k, "c_custkey"), "c_custkey").select("c_custkey", col("pos").cast("long").alias("sample_order"))


@query("src_county", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def _(t):
    return t("nation").select("n_nationkey", "n_name").where("n_nationkey = 7")


@query("sink_manifest")
def _(t):
    """Digest and size of each file of a table."""
    return files.file_digests(t.spark, f"{t.sf_dir}/nation.parquet").select("length", "sha256")


@query("fn_key_values", "SELECT o_orderkey, 'entries scanned' AS key, CAST(o_custkey AS VARCHAR) AS value, 'total' AS annotation FROM orders")
def _(t):
    lines = t("orders").select("o_orderkey", F.concat(F.lit("entries scanned: "), col("o_custkey").cast("string"), F.lit(" (total)")).alias("value"))
    parsed = files.key_values(lines.select(F.concat_ws(":", F.concat_ws("|", col("o_orderkey").cast("string"), F.substring_index("value", ":", 1)), F.substring_index("value", ":", -1)).alias("value")))
    return parsed.select(F.substring_index("key", "|", 1).cast("long").alias("o_orderkey"), F.substring_index("key", "|", -1).alias("key"), "value", "annotation")


@query("pred_on_segment", f"SELECT id, fid, ring_index, seg FROM (SELECT id, x AS px, y AS py FROM fx_points) p JOIN {POLYS} s ON px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by) AND greatest(ay, by) WHERE {D2} <= 1e-18")
def _(t):
    """Points on an edge; edges and points meet in cells."""
    s = G._cells(W.segments(t("fx_poly_vertices")), 500.0)
    p = points(t).select("id", "px", "py", F.floor(col("px") / 500).alias("ci"), F.floor(col("py") / 500).alias("cj"))
    return p.join(s, ["ci", "cj"]).where(S.on_segment(*map(col, ("px", "py", "ax", "ay", "bx", "by")))).select("id", "fid", "ring_index", "seg")


@query("fn_rmi_predict", f"SELECT count(*) AS keys, true AS bounded FROM ({_POS})")
def _(t):
    pos = keys(t).select("key", "pos")
    root, leaves = L.train_rmi(pos, 64)
    p = L.predict_rmi(pos, root, leaves, 64)
    return p.agg(F.count("*").alias("keys"), F.bool_and(col("predicted") >= 0).alias("bounded"))


@query("rmi_verify", f"SELECT count(*) AS keys, CAST(0 AS BIGINT) AS outside, true AS narrow FROM ({_POS})")
def _(t):
    pos = keys(t)
    root, leaves = L.train_rmi(pos, 64)
    return L.verify_rmi(pos, root, leaves, 64).select("keys", "outside", (col("max_width") < col("keys")).alias("narrow"))


@query("rmi_leaf_boundaries")
def _(t):
    root, _ = L.train_rmi(keys(t), 16)
    return t.spark.createDataFrame(list(enumerate(L.leaf_boundaries(root, 16))), "leaf int, first_key long")


@query("consistent_metric", "SELECT algorithm, count(DISTINCT property_count) = 1 AS property_count_consistent FROM fx_runs GROUP BY algorithm")
def _(t):
    return V.consistent(t("fx_runs"), ["property_count"], "algorithm")


@query("fn_derived_seed")
def _(t):
    return t.spark.createDataFrame([(k, P.derived_seed(7, "fold", k)) for k in range(5)], "fold int, seed long")


@query("V_schema", "SELECT * FROM (VALUES ('missing_columns', 'FAIL', 'c_lost'), ('extra_columns', 'WARN', 'c_name,c_nationkey,c_acctbal,c_mktsegment')) AS v(\"check\", status, detail)")
def _(t):
    return t.spark.createDataFrame(V.schema_report(t("customer"), ["c_custkey", "c_lost"]), "check string, status string, detail string")


@query("V_require_columns", "SELECT 'missing columns: [''c_lost'']' AS message")
def _(t):
    try:
        V.require_columns(t("customer"), ["c_custkey", "c_lost"])
        return t.spark.createDataFrame([("none",)], "message string")
    except V.Violation as e:
        return t.spark.createDataFrame([(str(e),)], "message string")


@query("validate_weights", "SELECT * FROM (VALUES ('sum', false), ('names', false), ('good', true)) AS v(name, ok)")
def _(t):
    def ok(w):
        try:
            return bool(M.check_weights(w, set(S.WEIGHTS)))
        except ValueError:
            return False

    cases = {"sum": {**S.WEIGHTS, "water": 0.9}, "names": {"zone": 1.0}, "good": S.WEIGHTS}
    return t.spark.createDataFrame([(k, ok(w)) for k, w in cases.items()], "name string, ok boolean")


@query("V_single_geometry", "SELECT count(*) AS features, bool_and(n = 1) AS single FROM (SELECT fid, count(DISTINCT part_index) AS n FROM fx_poly_vertices GROUP BY fid)")
def _(t):
    one = t("fx_poly_vertices").groupBy("fid").agg(F.count_distinct("part_index").alias("n"))
    return one.agg(F.count("*").alias("features"), F.bool_and(col("n") == 1).alias("single"))


@query("V_baseline_output", "SELECT 'matched_without_id' AS \"check\", 'PASS' AS status, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'sfha_differs', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM fx_scoring WHERE is_sfha <> (zone <> 'X') OR property_id % 1000 = 3")
def _(t):
    df = t("fx_scoring").withColumn("twin", F.when(col("property_id") % 1000 == 3, ~col("is_sfha")).otherwise(col("is_sfha")))
    rules = [V.Rule("matched_without_id", col("matched") & col("property_id").isNull()), V.Rule("sfha_differs", ~col("is_sfha").eqNullSafe(col("twin")))]
    return V.violations(df, rules, "property_id").select("check", "status", "n")


@query("V_checksum", "SELECT count(*) AS rows, count(DISTINCT sha256(CAST(o_orderkey AS VARCHAR) || o_orderpriority)) AS digests FROM orders")
def _(t):
    d = t("orders").select(F.sha2(F.concat(col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("d"))
    return d.agg(F.count("*").alias("rows"), F.count_distinct("d").alias("digests"))
