"""Spatial splits and folds: blocks draw, points follow, and what is too near to the held-out rows is dropped."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import block_id, hash_fold, hash_uniform, mask_bit, role, split_label
from .joins import any_within, nearest_point


def with_blocks(points: DataFrame, size: float, x: str = "px", y: str = "py") -> DataFrame:
    return points.withColumns({"block_i": block_id(F.col(x), size), "block_j": block_id(F.col(y), size)})


def digest_uniform(blocks: DataFrame, seed: int, namespace: str = "") -> DataFrame:
    """(block_i, block_j, u) of distinct blocks: the top 53 bits of blake2b-64 of '{seed}:{namespace}{i}:{j}' as a number in [0, 1)."""

    @F.pandas_udf("double")
    def draw(i: pd.Series, j: pd.Series) -> pd.Series:
        one = lambda a, b: int.from_bytes(hashlib.blake2b(f"{seed}:{namespace}{a}:{b}".encode(), digest_size=8).digest(), "big")
        return pd.Series([(one(a, b) >> 11) / 2**53 for a, b in zip(i, j)], dtype=float)

    return blocks.select("block_i", "block_j").distinct().withColumn("u", draw("block_i", "block_j"))


def digest_fold(blocks: DataFrame, seed: int, folds: int, namespace: str = "fold:") -> DataFrame:
    """(block_i, block_j, fold) by the same digest, modulo the number of folds."""

    @F.pandas_udf("int")
    def draw(i: pd.Series, j: pd.Series) -> pd.Series:
        one = lambda a, b: int.from_bytes(hashlib.blake2b(f"{seed}:{namespace}{a}:{b}".encode(), digest_size=8).digest(), "big")
        return pd.Series([one(a, b) % folds for a, b in zip(i, j)], dtype="int32")

    return blocks.select("block_i", "block_j").distinct().withColumn("fold", draw("block_i", "block_j"))


def spatial_split(points: DataFrame, size: float, seed: int, train: float = 0.70, val: float = 0.85, digest: bool = False) -> DataFrame:
    """Points (id, px, py) with their block and ``split``; a block is drawn once, whatever its rows."""
    p = with_blocks(points, size)
    if digest:
        u = digest_uniform(p, seed)
    else:
        u = p.select("block_i", "block_j").distinct().withColumn("u", hash_uniform(F.lit(seed), F.col("block_i"), F.col("block_j")))
    return p.join(u, ["block_i", "block_j"]).withColumn("split", split_label(F.col("u"), train, val)).drop("u")


def drop_near(train: DataFrame, held: DataFrame, buffer: float) -> DataFrame:
    """Training rows at least ``buffer`` from every held-out row."""
    return train.join(any_within(train, held, buffer).hint("merge"), "id", "left_anti")


def buffered_split(points: DataFrame, size: float, buffer: float, seed: int) -> DataFrame:
    """The split with training rows near the held-out ones marked 'dropped'."""
    s = spatial_split(points, size, seed)
    held, train = s.where("split <> 'train'"), s.where("split = 'train'")
    near = any_within(train, held, buffer).withColumn("__near", F.lit(True))
    return s.join(near.hint("merge"), "id", "left").withColumn("split", F.when((F.col("split") == "train") & F.col("__near"), "dropped").otherwise(F.col("split"))).drop("__near")


def min_separation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the least distance from a row of ``a`` to one of ``b``."""
    return nearest_point(a, b.select(F.col("id").alias("sid"), F.col("px").alias("sx"), F.col("py").alias("sy"))).agg(F.min("distance").alias("separation"))


def spatial_kfold(points: DataFrame, size: float, folds: int, seed: int) -> DataFrame:
    """Points with their block and fold."""
    p = with_blocks(points, size)
    f = p.select("block_i", "block_j").distinct().withColumn("fold", hash_fold(folds, F.lit(seed), F.col("block_i"), F.col("block_j")))
    return p.join(f, ["block_i", "block_j"])


def roles(folded: DataFrame, folds: int) -> DataFrame:
    """(id, k, role) of every round."""
    return folded.select("id", "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("k")).select("id", "k", role(F.col("fold"), F.col("k"), folds).alias("role"))


def dropped_mask(folded: DataFrame, folds: int, buffer: float) -> DataFrame:
    """(id, fold, dropped_mask): bit k is set where the row trains in round k but is too near to that round's held-out rows."""
    out = folded.select("id", "fold")
    mask = F.lit(0).cast("long")
    for k in range(folds):
        r = folded.withColumn("role", role(F.col("fold"), F.lit(k), folds))
        train, held = r.where("role = 'train'"), r.where("role <> 'train'")
        out = out.join(any_within(train, held, buffer).withColumn(f"d{k}", F.lit(True)).hint("merge"), "id", "left")
        mask = mask.bitwiseOR(F.when(F.col(f"d{k}").isNotNull(), mask_bit(F.lit(k))).otherwise(F.lit(0).cast("long")))
    return out.select("id", "fold", mask.alias("dropped_mask"))


def blocks_per_fold(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold").agg(F.count_distinct("block_i", "block_j").alias("blocks"), F.count("*").alias("rows"))


def derived_seed(seed: int, *parts) -> int:
    """A seed for a part of a run: half of the blake2b-64 number of 'seed:part:...'."""
    text = ":".join(map(str, (seed, *parts)))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") >> 1
