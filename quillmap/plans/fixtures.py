"""Derived inputs: geometry, scoring inputs, raster cells and run records made from the star-schema tables.

Each is one portable SQL text, which Spark runs over the parquet tables and DuckDB as a common table expression, so both
engines read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import WEIGHTS
from ..operators.models import scenarios

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Cells of the raster down and across: about 64 cells a customer.
SIDE = "SELECT 8*CAST(ceil(sqrt(count(*))) AS BIGINT) FROM customer"



def _weights() -> str:
    """The 40 scenarios around the default weights, as literals, so that both engines read the same numbers."""
    rows = ",\n  ".join(f"('{name}', '{family}', " + ", ".join(f"CAST('{w!r}' AS DOUBLE)" for w in weights) + ")" for name, family, *weights in scenarios(WEIGHTS))
    return f"\nSELECT * FROM (VALUES {rows}) AS w(scenario, family, w_zone, w_water, w_abs, w_rel)"


VIEWS = {
    "fx_points": """
SELECT c_custkey AS id, CAST(c_custkey*7919 % 10007 AS DOUBLE) AS x, CAST(c_custkey*104729 % 10009 AS DOUBLE) AS y,
       c_acctbal AS v, c_mktsegment AS cls
FROM customer""",
    "fx_sites": """
SELECT s_suppkey AS sid, CAST(s_suppkey*6151 % 10007 AS DOUBLE) AS sx, CAST(s_suppkey*3571 % 10009 AS DOUBLE) AS sy,
       s_acctbal AS sv
FROM supplier""",
    "fx_line_vertices": """
SELECT user_id AS fid, 0 AS part_index, 0 AS ring_index, CAST(rn - 1 AS INT) AS vertex_index,
       CAST(user_id*6151 % 10007 AS DOUBLE) + CAST((rn - 1)*40 AS DOUBLE) AS x,
       CAST(user_id*3571 % 10009 AS DOUBLE) + CAST(event_id % 97 AS DOUBLE) AS y
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t""",
    "fx_poly_vertices": """
SELECT p_partkey AS fid, 0 AS part_index, r.ring_index, c.k AS vertex_index,
       CAST(500 + 1000*(p_partkey % n.side) AS DOUBLE)
         + dx*CAST((100 + 4*p_size)/(1 + r.ring_index) AS DOUBLE) AS x,
       CAST(500 + 1000*CAST(floor(p_partkey/n.side) AS BIGINT) AS DOUBLE)
         + dy*CAST((100 + 4*p_size)/(1 + r.ring_index) AS DOUBLE) AS y,
       CASE p_size % 5 WHEN 0 THEN 'X' WHEN 1 THEN 'AO' WHEN 2 THEN 'A' WHEN 3 THEN 'AE' ELSE 'VE' END AS zone
FROM part p CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part) n
CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1),(4,-1,-1)) AS c(k,dx,dy)
CROSS JOIN (VALUES (0),(1)) AS r(ring_index)
WHERE r.ring_index = 0 OR p_size % 5 = 0""",
    "fx_poly_centres": """
SELECT p_partkey AS fid, CAST(500 + 1000*(p_partkey % n.side) AS DOUBLE) AS cx,
       CAST(500 + 1000*CAST(floor(p_partkey/n.side) AS BIGINT) AS DOUBLE) AS cy, CAST(100 + 4*p_size AS DOUBLE) AS half
FROM part CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part) n""",
    "fx_scoring": """
SELECT o_orderkey AS property_id, true AS matched, o_orderpriority <> '5-LOW' AS is_sfha,
       CASE o_orderpriority WHEN '5-LOW' THEN 'X' WHEN '4-NOT SPECIFIED' THEN 'AO' WHEN '3-MEDIUM' THEN 'A'
            WHEN '2-HIGH' THEN 'AE' ELSE 'VE' END AS zone,
       o_totalprice AS distance_m, CAST(o_custkey AS DOUBLE) AS elevation_m,
       CAST(o_orderkey % 101 - 50 AS DOUBLE) AS relative_m
FROM orders""",
    "fx_dem": f"""
SELECT r.c_custkey AS cell_row, c.c_custkey AS cell_col,
       CASE WHEN (r.c_custkey*7 + c.c_custkey) % 997 = 0 THEN CAST(-9999 AS DOUBLE)
            ELSE CAST((r.c_custkey*37 + c.c_custkey*53) % 211 AS DOUBLE) END AS z
FROM (SELECT c_custkey FROM customer WHERE c_custkey < ({SIDE})) r
CROSS JOIN (SELECT c_custkey FROM customer WHERE c_custkey < ({SIDE})) c""",
    "fx_candidate": """
SELECT o_orderkey AS property_id,
       o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS distance_m,
       CASE WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE o_orderpriority END AS label
FROM orders WHERE o_orderkey % 17 <> 0""",
    "fx_runs": """
SELECT l_returnflag AS workload, CASE l_linestatus WHEN 'F' THEN 'hilbert_binary' ELSE 'hilbert_rmi' END AS algorithm,
       CAST(l_suppkey % 5 AS INT) AS seed_window, l_quantity AS computation_seconds, CAST(1000 AS BIGINT) AS property_count
FROM lineitem""",
    # Counters of a search: scanned entries, and the boxes and discs that bounded them.
    "fx_counters": """
SELECT o_orderkey AS property_id, o_totalprice AS distance, CAST(o_orderkey % 97 + 60 AS BIGINT) AS entries_scanned,
       CAST(o_orderkey % 23 AS BIGINT) AS n_true_r, CAST(o_orderkey % 23 + o_custkey % 7 AS BIGINT) AS n_disk_r,
       CAST(o_orderkey % 23 + o_custkey % 7 + o_orderkey % 11 AS BIGINT) AS n_disk_infl,
       CAST(o_orderkey % 23 + o_custkey % 7 + o_orderkey % 11 + o_custkey % 5 - 1 AS BIGINT) AS n_disk_unc, CAST(o_custkey % 64 AS BIGINT) AS seed_probes
FROM orders""",
    # Predictions against labels, with a place in the plane and a class.
    "fx_predictions": """
SELECT o_orderkey AS id, CAST(o_orderkey*7919 % 10007 AS DOUBLE) AS x, CAST(o_orderkey*104729 % 10009 AS DOUBLE) AS y,
       o_totalprice / CAST(1000 AS DOUBLE) AS label, o_totalprice / CAST(1000 AS DOUBLE) + CAST(o_orderkey % 41 - 20 AS DOUBLE) AS pred,
       CAST(o_custkey*13 % 5000 AS DOUBLE) AS distance_m, o_orderpriority AS cls, CAST(o_orderkey % 3 AS INT) AS seed
FROM orders""",
    # Weight scenarios of a composite of four components.
    "fx_weights": _weights(),
}


def needed(sql: str) -> list[str]:
    """The derived inputs that a text names, those they name included, in order."""
    out: list[str] = []
    for name, text in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in needed(text) if x not in out] + [name]
    return list(dict.fromkeys(out))


def with_views(sql: str) -> str:
    """The text as one statement, the inputs that it names defined before it."""
    views = needed(sql)
    if not views:
        return sql
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


class Tables:
    """The tables of a folder and the inputs derived from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run a text over the tables and derived inputs, without registering any view."""
        text = with_views(text)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b{t}\b(?!\s*\()", f"{{{t}}}", text)
        return self.spark.sql(text, **{t: self(t) for t in used})
