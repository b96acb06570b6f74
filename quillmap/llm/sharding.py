"""K-d tree partitioning: weighted median splits along the widest metadata dimension, with DataFrame functions only.

Points are groups of equal texts, weighed by their bytes, so equal texts share a shard; a group heavier than 1/32 of the
target is cut into lighter points by a hash of the id, or no balance could be met. A median is found by histograms of
2**16 bins of the order key, digit by digit: each pass sends the driver one row a node, and the number of nodes is
bounded by total / target.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Shield, Table, written

HEAVY = 32
#: Distinct values of a metadata column up to which their ranks are broadcast.
FEW_VALUES = 100_000
#: Rows that one task numbers.
SLOT_ROWS = 100_000


def value_ranks(docs: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values of a column in order, numbered from 1; null isn't among them.

    They are sorted by range partitions; a row a partition tells where its numbers begin.
    """
    values = docs.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    placed = written(values.orderBy("value").withColumn("at", F.monotonically_increasing_id()), "values").df
    part = placed.select("value", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row"))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    begin = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    return written(part.join(F.broadcast(begin), "part").select("value", (F.col("begin") + F.col("row") + 1).cast("long").alias("rank")), "ranks").df


def _median(points: DataFrame, nodes: list[dict], digits: list[tuple[str, int]]) -> None:
    """Set each node's cut (c1, c2, left): rows below (c1, c2), or at it if left, go to the left child."""
    spark = points.sparkSession
    for n in nodes:
        n |= {"c1": 0, "c2": 0, "before": 0}
    for code, shift in digits:
        rows = [(n["node"], n["dim"], n["c1"], n["c2"], n["before"], n["goal"]) for n in nodes]
        state = spark.createDataFrame(rows, "node long, dim int, c1 long, c2 long, before long, goal double")
        p = points.join(F.broadcast(state), "node").withColumn("x", F.element_at("xs", F.col("dim") + 1))
        mine = F.col("x" if code == "c1" else "tie")
        inside = F.shiftright(mine, shift + 16) == F.shiftright(F.col(code), shift + 16)
        if code == "c2":
            inside = inside & (F.col("x") == F.col("c1"))
        bins = p.where(inside).groupBy("node", "before", "goal", F.shiftright(mine, shift).bitwiseAND(0xFFFF).alias("bin")).agg(F.sum("w").alias("mass"))
        start = F.col("before") + F.sum("mass").over(Window.partitionBy("node").orderBy("bin")) - F.col("mass")
        found = bins.withColumn("start", start).where(F.col("start") <= F.col("goal")).groupBy("node").agg(F.max(F.struct("bin", "start", "mass")).alias("m"))
        got = {r["node"]: r["m"] for r in found.collect()}  # a row a node
        for n in nodes:
            m = got[n["node"]]
            n[code] |= m["bin"] << shift
            n |= {"before": m["start"], "left": m["start"] + m["mass"] - n["goal"] <= n["goal"] - m["start"]}


def kd_shards(docs: DataFrame, dims: list[Column | str], n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", heavy_part: int = HEAVY) -> DataFrame:
    """``docs`` with __size (UTF-8 bytes plus 1), __shard from 0, __slot, gapless from 0 in each shard, and __parts.

    ``dims`` are columns of non-negative longs under 2**48, or names of columns that count by the rank of their value as
    a string, null first. Groups of equal texts heavier than 1/``heavy_part`` of a shard are cut in __parts parts, that
    may go to different shards; all other groups have __parts 1 and stay whole. A node is split along the dimension whose extent in it, as a
    part of the whole extent, is widest (the first of equals), at the weighted median that gives both sides their share
    of the leaves. Give the number of leaves or the bytes that a leaf is to reach. Null texts weigh 1 and are one
    group; repeated rows get slots of their own; an empty table gives an empty result. Other columns pass through, whatever their names;
    those named like the added ones are replaced.
    """
    spark = docs.sparkSession
    shield = Shield(docs, ("__gid", "__salt", "__sub", "__start", "__bucket", "value", *(f"__rank{i}" for i in range(len(dims)))), ("__size", "__shard", "__slot", "__parts"))
    docs, text = shield.df, F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    tagged = docs.withColumns({"__size": size, "__gid": F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), "__salt": F.xxhash64(F.col(id_col).cast("string"), F.lit(5))})
    ranked, xs = tagged, []
    for i, d in enumerate(dims):
        if isinstance(d, str):  # a value may hold a third of all rows: few values are broadcast
            ranks = value_ranks(docs, d)
            ranks = F.broadcast(ranks) if ranks.count() <= FEW_VALUES else ranks
            ranked = ranked.join(ranks.withColumnRenamed("rank", f"__rank{i}"), F.col(d).cast("string") == ranks["value"], "left").drop(ranks["value"])
            xs.append(F.coalesce(f"__rank{i}", F.lit(0).cast("long")))
        else:
            xs.append(d.cast("long"))
    xs = F.array(*xs)
    rows = written(ranked.select(F.col("__gid").alias("gid"), F.col("__salt").alias("salt"), F.col("__size").alias("size"), xs.alias("xs")), "rows")
    total, n_rows = rows.df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = n_shards or max(1, ceil(total / (target_bytes or 1)))
    light = max(1, total / leaves / heavy_part)
    # At most heavy_part * leaves groups are heavier than light.
    heavy = rows.df.groupBy("gid").agg(F.sum("size").alias("w")).where(F.col("w") > light).select("gid", F.ceil(F.col("w") / F.lit(light)).cast("long").alias("parts"))
    heavy = written(heavy, "heavy").df

    def parted(df: DataFrame, gid: str, salt: str, out: str) -> DataFrame:
        h = F.broadcast(heavy.select(F.col("gid").alias(gid), "parts"))
        return df.join(h, gid, "left").withColumns({out: F.coalesce(F.pmod(F.col(salt), F.col("parts")), F.lit(0)).bitwiseAND(0xFFFF), "parts": F.coalesce("parts", F.lit(1).cast("long"))})

    points = parted(rows.df, "gid", "salt", "sub").groupBy("gid", "sub").agg(F.sum("size").alias("w"), F.min("xs").alias("xs"))
    tie = F.shiftrightunsigned("gid", 32) * 65536 + F.col("sub")
    table: Table = written(points.select("gid", "sub", "w", "xs", tie.alias("tie"), F.lit(1).cast("long").alias("node")), "points")
    todo, first, extent = {1: (0, leaves)}, {}, None
    while any(k > 1 for _, k in todo.values()) and total:
        aggs = [F.sum("w").alias("w")] + [f(F.element_at("xs", i + 1)).alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in table.df.groupBy("node").agg(*aggs).collect()}  # a row a node
        extent = extent or [max(1, stats[1][f"hi{i}"] - stats[1][f"lo{i}"]) for i in range(len(dims))]
        nodes, after = [], {}
        for node, (shard, k) in todo.items():
            if k == 1 or node not in stats:
                first[node] = shard
                continue
            r = stats[node]
            wide = [(r[f"hi{i}"] - r[f"lo{i}"]) / extent[i] for i in range(len(dims))]
            nodes.append({"node": node, "dim": wide.index(max(wide)), "goal": r["w"] * (k // 2) / k})
            after |= {2 * node: (shard, k // 2), 2 * node + 1: (shard + k // 2, k - k // 2)}
        if nodes:
            _median(table.df, nodes, [("c1", 32), ("c1", 16), ("c1", 0), ("c2", 32), ("c2", 16), ("c2", 0)])
            cut = spark.createDataFrame([(n["node"], n["dim"], n["c1"], n["c2"], n["left"]) for n in nodes], "node long, dim int, c1 long, c2 long, atleft boolean")
            p = table.df.join(F.broadcast(cut), "node", "left")
            x = F.element_at("xs", F.coalesce(F.col("dim"), F.lit(0)) + 1)
            left = (x < F.col("c1")) | (x == F.col("c1")) & ((F.col("tie") < F.col("c2")) | (F.col("tie") == F.col("c2")) & F.col("atleft"))
            node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
            new = written(p.select("gid", "sub", "w", "xs", "tie", node.alias("node")), "points")
            table.drop()
            table = new
        todo = after
    first |= {node: shard for node, (shard, _) in todo.items()}
    names = F.broadcast(spark.createDataFrame(list(first.items()), "node long, shard int"))
    placed = table.df.join(names, "node").select(F.col("gid").alias("__gid"), F.col("sub").alias("__sub"), F.col("shard").alias("__shard"))
    keys = parted(rows.df.groupBy("gid", "salt").agg(F.count("*").alias("n")).select(F.col("gid").alias("__gid"), F.col("salt").alias("__salt"), "n"), "__gid", "__salt", "__sub")
    slots = written(_slots(keys.join(placed, ["__gid", "__sub"]), n_rows), "slots")
    for t in (rows, table):
        t.drop()
    # The texts are dealt once: rows of one id and text are few and number themselves where the join put them.
    copy = F.row_number().over(Window.partitionBy("__gid", "__salt").orderBy(id_col))
    out = tagged.join(slots.df, ["__gid", "__salt"])
    return shield.restored(out.withColumn("__slot", F.col("__start") + copy - 1).drop("__gid", "__salt", "__start"))


def _slots(keys: DataFrame, n_rows: int) -> DataFrame:
    """(gid, salt, shard, parts, start): where the numbers of each key's n rows begin in its shard, by hashed buckets and their offsets."""
    buckets = max(1, n_rows // SLOT_ROWS)
    keys = keys.withColumn("__bucket", F.pmod(F.xxhash64("__salt", "__gid"), F.lit(buckets)))
    sums = keys.groupBy("__shard", "__bucket").agg(F.sum("n").alias("all"))
    offset = sums.select("__shard", "__bucket", (F.sum("all").over(Window.partitionBy("__shard").orderBy("__bucket")) - F.col("all")).alias("__offset"))
    inside = F.sum("n").over(Window.partitionBy("__shard", "__bucket").orderBy("__salt", "__gid")) - F.col("n")
    return keys.join(offset, ["__shard", "__bucket"]).select("__gid", "__salt", "__shard", F.col("parts").alias("__parts"), (F.col("__offset") + inside).alias("__start"))
