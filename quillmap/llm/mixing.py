"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. The per-source table has one row a source; documents are never gathered: the fractional
repetition is cut at a seeded hash key that two histogram passes find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Shield, written

#: Words: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which the per-source table, some 60 bytes a row, is broadcast.
FEW_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): ``share`` of all sizes by weight, none above max_epochs times its size.

    The limit of resharing the excess by weight is the level at which sum(least(level * weight, cap)) meets the total;
    in order of cap / weight, the sources before some place are clamped and the rest share what is left.
    """
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sources.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    s = s.withColumns({"total": F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()), "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("weight").over(after)})
    s = s.withColumn("level", (F.col("total") - F.col("clamped")) / F.col("left"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(Window.partitionBy())["level"])
    cap = F.col("cap").cast("double")
    return s.withColumn("target", F.when(F.col("level").isNull(), cap).otherwise(F.least(F.col("level") * F.col("weight"), cap))).drop("cap", "total", "clamped", "left", "level")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with __size, __source_size, __target and __reps, the times that the mix takes the document.

    Sources in code point order, null last, weigh ``weights`` in turn. A document's size is its number of words (null:
    0). It is taken floor(target / source size) times, and once more if its key, the first 32 bits of md5(seed + id), is
    at or below the source's cut: the greatest key whose middle, in the order of keys, lies within what is left of the
    target. So each source meets its target to about half a document. Rows with one id (or null ids, that share the
    empty key) are taken alike. A source without words has target 0 and its documents stay out. Other columns pass
    through, those named like the added ones are replaced; an empty table gives an empty result.
    """
    shield = Shield(docs, ("__key", "__source", "__whole", "__cut", "__n"), ("__size", "__source_size", "__target", "__reps"))
    docs = shield.df
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    sized = docs.withColumns({"__size": word_count(F.col(text_col)), "__key": key})
    narrow = written(sized.select(F.col(source_col).alias("source"), F.col("__key").alias("key"), F.col("__size").alias("size")), "sizes").df
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", place)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    plan = water_fill(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan.select("source", "source_size", "target", "whole", "want"), "plan").df
    # A source may hold a third of all rows: what has a row a source is broadcast as long as that is few rows.
    near = F.broadcast if plan.count() <= FEW_SOURCES else (lambda df: df)

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    # The bin of 2**16 keys that holds the cut, then the cut in it.
    coarse = narrow.groupBy("source", F.shiftright("key", 16).alias("bin")).agg(F.sum("size").alias("mass"))
    run = Window.partitionBy("source").orderBy("bin")
    coarse = coarse.withColumn("before", F.sum("mass").over(run) - F.col("mass"))
    hit = coarse.join(plan, same(coarse, plan)).where("want > 0 and before <= want").groupBy(plan["source"].alias("source")).agg(F.max(F.struct("bin", "before")).alias("m"), F.max("want").alias("want"))
    hit = hit.select("source", "want", "m.bin", "m.before")
    hit = near(hit)
    fine = narrow.join(hit, same(narrow, hit) & (F.shiftright(narrow["key"], 16) == hit["bin"])).groupBy(narrow["source"], "key").agg(F.sum("size").alias("mass"), F.max("before").alias("before"), F.max("want").alias("want"), F.max("bin").alias("bin"))
    at = F.col("before") + F.sum("mass").over(Window.partitionBy("source").orderBy("key")) - F.col("mass")
    fine = fine.withColumn("middle", at + F.col("mass") / 2)
    # Where no key of the bin is in, all keys of the bins before it are.
    cuts = fine.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("want"), F.col("key"))), F.max("bin") * 65536 - 1).alias("cut"))
    plan = plan.join(cuts, same(plan, cuts), "left").select(plan["source"].alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.coalesce("cut", F.lit(-1)).alias("__cut"))
    plan = near(written(plan, "cuts").df)
    out = sized.join(plan, sized[source_col].eqNullSafe(plan["__source"]))
    reps = F.col("__whole") + F.when(F.col("__key") <= F.col("__cut"), 1).otherwise(0)
    out = out.withColumn("__reps", F.when(F.col("__source_size") > 0, reps).otherwise(0).cast("long")).drop("__key", "__source", "__whole", "__cut")
    return shield.restored(out)


def materialised(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, without the columns that ``mix_sources`` adds."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("__reps").cast("int"))).alias("__size")
    return mixed.where("__reps > 0").select(*[c for c in mixed.columns if c not in ("__size", "__source_size", "__target", "__reps")], times).drop("__size")
