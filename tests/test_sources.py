"""The paged source against a local service that fails at first, and files that are written and read again."""

import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quillmap.sources import rest


@pytest.fixture()
def service():
    state = {"calls": 0, "fail": 1, "status": 503}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            state["calls"] += 1
            if state["fail"] > 0:
                state["fail"] -= 1
                self.send_response(state["status"])
                self.end_headers()
                return
            q = parse_qs(urlparse(self.path).query)
            if "returnIdsOnly" in q:
                answer = {"objectIds": [5, 3, 1, 2, 4, 3]}
            else:
                answer = {"features": [{"attributes": {"OBJECTID": int(i), "NAME": f"n{i}"}, "geometry": {"x": float(i), "y": -1.0}} for i in q["objectIds"][0].split(",")]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", state
    server.shutdown()


def test_paged_features(spark, service):
    url, _ = service
    spark.dataSource.register(rest.PagedFeatures)
    df = spark.read.format("paged_features").schema("objectid long, name string, x double").option("url", url).option("page", 2).option("pause", 0).load()
    assert sorted(map(tuple, df.collect())) == [(i, f"n{i}", float(i)) for i in range(1, 6)]


def test_only_passing_failures_are_tried_again(service):
    url, state = service
    state["status"] = 404
    with pytest.raises(Exception, match="404"):
        rest.ask(url, {"returnIdsOnly": "true"}, pause=0)
    assert state["calls"] == 1
    state |= {"fail": 9, "status": 500, "calls": 0}
    with pytest.raises(Exception, match="500"):
        rest.ask(url, {"returnIdsOnly": "true"}, attempts=3, pause=0)
    assert state["calls"] == 3


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert rest.read_config(str(tmp_path / "c.json")) == {"a": [1]}


def test_all_oracles_agree_on_a_sample_of_queries(spark):
    """The full comparison runs in the driver; this holds a few of each kind."""
    import duckdb

    from quillmap.plans.catalog import ORACLE_SQL, QUERIES
    from quillmap.plans.fixtures import TABLES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    norm = lambda v: [norm(x) for x in v] if isinstance(v, (list, tuple)) else v
    for name in ("J3_join_nearest", "J3b_join_nearest_feature_bvh", "J2_join_point_in_polygon", "P1_exposure_index", "agg_bin_residuals", "W4_win_qcut", "sink_csv", "src_geojson", "V_ring", "fn_hilbert_xy2d"):
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(map(repr, (norm(tuple(r)) for r in df.select(cols).collect())))
        want = sorted(map(repr, (norm(tuple(r)) for r in con.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE_SQL[name]})').fetchall())))
        assert got == want, name


def gpkg_bytes():
    """A GeoPackage by hand: a layer of lines and polygons, one row without a geometry."""
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT, z INT, m INT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('water', 'geom', 'GEOMETRY', 5070, 0, 0)")
    db.execute("CREATE TABLE water (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, kind INT)")
    head = b"GP\0" + bytes([0b0000_0011]) + struct.pack("<i4d", 5070, 0, 9, 0, 9)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 3, 4)
    ring = lambda *v: struct.pack(f"<I{len(v)}d", len(v) // 2, *v)
    polygon = struct.pack("<BII", 1, 3, 2) + ring(0, 0, 9, 0, 9, 9, 0, 9, 0, 0) + ring(1, 1, 2, 1, 2, 2, 1, 1)
    high = struct.pack(">BII", 0, 1002, 2) + struct.pack(">6d", 1, 2, 77, 3, 4, 77)
    db.executemany("INSERT INTO water VALUES (?, ?, ?, ?)", [(4, head + line, "a", 1), (7, head + struct.pack("<BII", 1, 6, 1) + polygon, None, 2), (9, None, "none", 3), (11, b"GP\0\1" + struct.pack("<i", 5070) + high, "z", 4)])
    return db.serialize()


def shp_bytes():
    """A polygon with a hole and a null shape by hand, with attributes."""
    outer, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    body = struct.pack("<I4d2I2I", 5, 0, 0, 9, 9, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in outer + hole)
    records = struct.pack(">2I", 1, len(body) // 2) + body + struct.pack(">2I", 2, 2) + struct.pack("<I", 0)
    field = lambda n, size: n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15)
    dbf = struct.pack("<4BIHH", 3, 0, 0, 0, 2, 32 + 64 + 1, 1 + 6 + 2) + bytes(20) + field(b"ZONE", 6) + field(b"SF", 2) + b"\r" + b" AE    T" + b" " + b" X     " + b"  "
    return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, 50) + struct.pack("<2I8d", 1000, 5, *[0.0] * 8) + records, dbf


def test_geopackage(spark, tmp_path):
    from quillmap.operators import geometry as G
    from quillmap.sources import vector

    (tmp_path / "a.gpkg").write_bytes(gpkg_bytes())
    df = vector.read_gpkg(spark, str(tmp_path / "a.gpkg"), "water")
    got = {r["fid"]: r for r in df.collect()}
    assert {k: (r["kind"], r["srs"], r["properties"]["name"], r["properties"]["kind"]) for k, r in got.items()} == {4: ("LineString", 5070, "a", "1"), 7: ("MultiPolygon", 5070, None, "2"), 9: (None, 5070, "none", "3"), 11: ("LineString", 5070, "z", "4")}
    v = sorted(map(tuple, G.flatten(df).collect()))
    assert len(v) == 2 + 9 + 2 and v[0] == (4, 0, 0, 0, 0.0, 0.0) and v[-1] == (11, 0, 0, 1, 3.0, 4.0) and (7, 0, 1, 1, 2.0, 1.0) in v
    with pytest.raises(Exception, match="no layer"):
        vector.read_gpkg(spark, str(tmp_path / "a.gpkg"), "land").collect()
    with pytest.raises(ValueError, match="coordinate systems"):
        vector.one_srs(df, df.withColumn("srs", F.lit(4326)))
    assert vector.one_srs(df, df).count() == 8


def test_shapefile(spark, tmp_path):
    from quillmap.sources import vector

    shp, dbf = shp_bytes()
    (tmp_path / "z.shp").write_bytes(shp)
    (tmp_path / "z.dbf").write_bytes(dbf)
    a, b = sorted(vector.read_shp(spark, str(tmp_path / "z.shp")).collect(), key=lambda r: r["fid"])
    assert (a["kind"], a["properties"]["ZONE"], [len(r["vertices"]) for r in a["parts"][0]["rings"]]) == ("MultiPolygon", "AE", [5, 4])
    assert (b["kind"], b["properties"]["ZONE"], b["properties"]["SF"], b["parts"]) == (None, "X", None, [])
    with pytest.raises(ValueError):
        list(vector.shp_features(b"nope"))
