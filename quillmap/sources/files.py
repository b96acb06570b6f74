"""Readers and writers. Readers take declared schemas, so nothing is inferred and a bad row fails the read."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

GEOJSON = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def read_csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Typed, quote-aware, header-mapped; a row that doesn't fit fails. Columns are taken by name, in any order."""
    df = spark.read.csv(path, header=True, mode="FAILFAST", quote='"', escape='"', inferSchema=False)
    names = {c.lstrip("﻿").strip().lower(): c for c in df.columns}
    out = []
    for field in schema.split(","):
        name, kind = field.split()
        if name.lower() not in names:
            raise ValueError(f"{path} has no column {name}")
        c = F.col(f"`{names[name.lower()]}`")
        out.append((c if kind == "string" else F.nullif(F.trim(c), F.lit("")).cast(kind)).alias((rename or {}).get(name, name)))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, key: str, decimals: int | None = None) -> None:
    """One file in key order; doubles with all 17 digits, or so many decimals."""
    pattern = f"%.{decimals}f" if decimals is not None else "%.17g"
    cols = [F.format_string(pattern, F.col(c)).alias(c) if k == "double" and decimals is not None else F.col(c) for c, k in df.dtypes]
    df.orderBy(key).select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(fid, properties, kind, coordinates): a row a feature; coordinates as JSON text, read by ``geojson_vertices``."""
    raw = spark.read.schema(GEOJSON).json(path, multiLine=True)
    return raw.select(F.posexplode("features").alias("fid", "f")).select(F.col("fid").cast("long").alias("fid"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def geojson_vertices(features: DataFrame) -> DataFrame:
    """Flat vertices of points, lines and polygons and their multiples, by parsing each kind's coordinates."""
    ring = "array<array<double>>"
    kinds = {"Point": ("array<double>", lambda c: F.array(F.array(F.array(c)))), "LineString": (ring, lambda c: F.array(F.array(c))), "MultiLineString": (f"array<{ring}>", lambda c: F.transform(c, lambda x: F.array(x))), "Polygon": (f"array<{ring}>", lambda c: F.array(c)), "MultiPolygon": (f"array<array<{ring}>>", lambda c: c)}
    parts = F.lit(None).cast(f"array<array<{ring}>>")
    for kind, (schema, nest) in kinds.items():
        wrapped = F.from_json(F.concat(F.lit('{"c":'), F.col("coordinates"), F.lit("}")), f"c {schema}")["c"]
        parts = F.when(F.col("kind") == kind, nest(wrapped)).otherwise(parts)
    p = features.select("fid", F.posexplode(parts).alias("part_index", "p")).select("fid", "part_index", F.posexplode("p").alias("ring_index", "r"))
    return p.select("fid", "part_index", "ring_index", F.posexplode("r").alias("vertex_index", "v")).select("fid", "part_index", "ring_index", "vertex_index", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def write_vertices(vertices: DataFrame, path: str) -> None:
    """Vertices by feature, parts, rings and numbers in order within each file, for row-group pruning by fid."""
    vertices.repartitionByRange("fid").sortWithinPartitions("fid", "part_index", "ring_index", "vertex_index").write.mode("overwrite").parquet(path)


def read_run_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ragged JSON lines; fields that a run lacks are null."""
    return spark.read.schema(schema).json(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Append-only: each write adds files, none is rewritten, so an interrupted session resumes."""
    df.write.mode("append").json(path)


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs without a record."""
    return plan.join(done.select(*keys), keys, "left_anti")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(position, key) of little-endian unsigned 64-bit dumps; keys as decimals, for no long holds them all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.content:
                keys = np.frombuffer(raw, dtype="<u8")
                yield pd.DataFrame({"position": np.arange(len(keys)), "key": [str(k) for k in keys]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, key string").select("position", F.col("key").cast("decimal(20,0)").alias("key"))


def pack_model(root: tuple[float, float], leaves: list[tuple[float, float, int, int]]) -> bytes:
    """A learned index as bytes: root, number of leaves, then slope, intercept and bounds of each."""
    return struct.pack("<ddI", *root, len(leaves)) + b"".join(struct.pack("<ddii", *x) for x in leaves)


def unpack_model(raw: bytes) -> tuple[tuple[float, float], list[tuple[float, float, int, int]]]:
    a, b, n = struct.unpack_from("<ddI", raw)
    return (a, b), [struct.unpack_from("<ddii", raw, 20 + 24 * k) for k in range(n)]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(name: str, digests: list[tuple[str, str]], facts: dict) -> str:
    """Provenance as JSON text: what was read, with digests, and what came out."""
    return json.dumps({"product": name, "inputs": [{"file": PurePosixPath(p).name, "sha256": d} for p, d in sorted(digests)], **facts}, indent=1, sort_keys=True)


def read_cells(spark: SparkSession, path: str, row_from: int | None = None, row_to: int | None = None) -> DataFrame:
    """A raster's cell table, or a band of its rows: the filter reaches the Parquet scan."""
    df = spark.read.parquet(path)
    if row_from is not None:
        df = df.where(F.col("cell_row") >= row_from)
    return df.where(F.col("cell_row") <= row_to) if row_to is not None else df


def first_field(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate columns that is there, case ignored."""
    names = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in names:
            return names[c.lower()]
    raise ValueError(f"none of {candidates} in {df.columns}")


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value, annotation) of lines like ``entries scanned: 123 (total)``."""
    from ..functions.scalars import split_annotation

    kv = lines.where(F.col(column).contains(":")).select(F.trim(F.substring_index(column, ":", 1)).alias("key"), F.trim(F.expr(f"substr({column}, instr({column}, ':') + 1)")).alias("rest"))
    value, note = split_annotation(F.col("rest"))
    return kv.select("key", value.alias("value"), note.alias("annotation"))
