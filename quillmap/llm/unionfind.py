"""Distributed union-find: connected components of a link table, without any group on one task or the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Table, written

#: Links that a task contracts at once, some 100 bytes each while it does.
BLOCK = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these links connect it with) of each node but the least ones: hooking and pointer jumping."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(ids)))
    return ids[low], ids[root[low]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes: each task's, in blocks, as stars. Never more links than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def cut() -> pa.RecordBatch:
            u, v = contract(*map(np.concatenate, zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)))
                if sum(len(x) for x, _ in held) >= BLOCK:
                    yield cut()
        if held:
            yield cut()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> Table:
    """(id, component): the least id reachable, for each id that some link touches.

    Tasks contract the links they hold to stars, which takes no shuffle. What is left is contracted by one task if it is
    at most a block of links; beyond that large-star and small-star rounds (Kiveris et al., 2014) go on, contracting
    between them, until all are stars. Every round is written to the shared folder. Links may repeat and may join an id
    with itself; nulls and self-links are dropped. No links gives an empty table.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(_contracted(links.where(u.isNotNull() & v.isNotNull() & (u != v)).select(u.alias("u"), v.alias("v"))), "links")
    while edges.df.count() > BLOCK and not _stars(edges.df):
        large = _large_star(edges)
        small = _small_star(large)
        new = written(_contracted(small.df), "links")
        for table in (edges, large, small):
            table.drop()
        edges = new
    # One block in one task; more than that are stars by now, whose repetitions go.
    last = edges.df.distinct() if edges.df.count() > BLOCK else _contracted(edges.df.coalesce(1))
    stars = written(last, "stars")
    edges.drop()
    roots = stars.df.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = written(stars.df.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    stars.drop()
    return out


def _stars(e: DataFrame) -> bool:
    """Whether each node below has one node above, that has none above itself."""
    ends = e.distinct().select(F.col("u").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("top"))
    ends = ends.unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("top")))
    return ends.groupBy("id").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1 or n = 1 and top = 1").isEmpty()


def _with_least(e: DataFrame) -> tuple[DataFrame, Table]:
    """``e`` (u, v) with m, the least v of its u.

    The minima are written first: both sides of the join are then dealt anew, and a u with very many rows is split.
    """
    low = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    return e.join(low.df, "u"), low


def _large_star(edges: Table) -> Table:
    """Neighbours above a node move to the least of the node and its neighbours."""
    e = edges.df
    both, low = _with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    out = written(both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
    low.drop()
    return out


def _small_star(edges: Table) -> Table:
    """Neighbours below a node, and the node itself, move to the least of them."""
    below, low = _with_least(edges.df)
    moved = below.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(low.df.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "small")
    low.drop()
    return out
