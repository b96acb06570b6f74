"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, union-find.

Lines are compared in lower case, with runs of white space as one blank. A line's signature has 32 minima in 8 bands of
4, so lines of similarity 0.8 meet in some band with probability 0.985, those of 0.9 with more than 0.9999. Lines of under
160 shingles take 32 independent minima; those of 102 and more (also) one minimum for each of 32 bins of one hash, empty
bins filled from the next one; so similar lines always have one kind in common. What meets is verified exactly and
connected as in the n-gram join, without all pairs of a bucket: lines are short, so they go to the tiles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .ngram_join import Jaccard, connect
from .store import Shield, may_hold, written
from .textkit import CHUNK, U64, mix
from .unionfind import components

SHINGLE = 7
BANDS, ROWS = 8, 4
RULE = Jaccard(width=1, num=80, den=100)
#: Under FEW shingles independent minima; from MANY on binned ones.
FEW, MANY = 160, 102
#: Odd numbers: multiplied by one, the mixed hashes take another order.
_salts = mix(np.arange(BANDS * ROWS, dtype=U64), 61) | U64(1)


def normal(text: str) -> list[bytes]:
    """The lines of a text as they are compared."""
    raw = text.lower().encode()
    if any(c in raw for c in (b"\t", b"\r", b"\x0b", b"\x0c")):
        return [b" ".join(x.split()) for x in raw.split(b"\n")]
    return [b" ".join(x.split()) if b"  " in x else x.strip() for x in raw.split(b"\n")]


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a hash for each run of SHINGLE bytes, line after line, and where each line's begin, with the end.

    A line of fewer bytes is one shingle; the lines aren't empty. Seven bytes fit a 64-bit number, so different shingles
    have different hashes.
    """
    size = np.array([len(x) for x in lines], dtype=np.int64)
    data = np.frombuffer(b"".join(lines) + bytes(8), dtype=np.uint8)
    value = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,)) & U64((1 << 8 * SHINGLE) - 1)
    end = np.cumsum(size)
    keep = np.ones(len(value), dtype=bool)
    long = size >= SHINGLE
    keep[(end[long][:, None] - np.arange(1, SHINGLE)[None, :]).ravel()] = False
    for k in np.flatnonzero(~long):  # the whole line, told from longer ones by its length
        at, n = int(end[k] - size[k]), int(size[k])
        value[at] = (int(value[at]) & (1 << 8 * n) - 1) | n << 8 * SHINGLE
        keep[at + 1 : at + n] = False
    return mix(value[keep], 67), np.concatenate([[0], np.cumsum(np.where(long, size - SHINGLE + 1, 1))])


def _bands(minima: np.ndarray, kind: int) -> np.ndarray:
    m = minima.reshape(-1, BANDS, ROWS)
    h = np.repeat(U64(kind) + np.arange(BANDS, dtype=U64)[None, :] * U64(977), len(m), axis=0)
    for i in range(ROWS):
        h = mix(h * U64(3) + m[:, :, i], 71 + i)
    return h


def band_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, count): the band keys of the lines, line after line, and how many each has."""
    h, first = shingle_hashes(lines)
    n, k = np.diff(first), BANDS * ROWS
    kinds = (n < FEW).astype(np.int64), (n >= MANY).astype(np.int64)
    count = BANDS * (kinds[0] + kinds[1])
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=U64)
    for kind, own in enumerate(kinds):
        rows = np.flatnonzero(own)
        if not len(rows):
            continue
        size = n[rows]
        begin = np.cumsum(size) - size
        mine = h[np.arange(size.sum()) + np.repeat(first[rows] - begin, size)]
        if kind == 0:
            minima = np.stack([np.minimum.reduceat(mine * s, begin) for s in _salts], axis=1)
        else:
            minima = np.full(len(rows) * k, ~U64(0), dtype=U64)
            np.minimum.at(minima, np.repeat(np.arange(len(rows)) * k, size) + (mine >> U64(59)).astype(np.int64), mine & U64((1 << 59) - 1))
            minima = minima.reshape(-1, k)
            for _ in range(1, k):
                empty = minima == ~U64(0)
                if not empty.any():
                    break
                minima = np.where(empty, np.roll(minima, -1, axis=1), minima)
        place = at[rows] + (BANDS * kinds[0][rows] if kind else 0)
        out[place[:, None] + np.arange(BANDS)[None, :]] = _bands(minima, kind + 1)
    return out, count


def _line_ids(lines: list[bytes]) -> list[int]:
    import xxhash

    return [x - (1 << 64) if x >= 1 << 63 else x for x in map(xxhash.xxh3_64_intdigest, lines)]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line, id, size, keys) of the lines that aren't blank; keys only where a partition first meets the line."""
    seen: set[int] = set()
    rows: list[tuple[int, int, int, int]] = []
    fresh: list[tuple[int, bytes]] = []
    size = 0

    def cut() -> pa.RecordBatch:
        nonlocal rows, fresh, size
        size_of = np.zeros(len(rows) + 1, dtype=np.int32)
        keys = np.zeros(0, dtype=U64)
        if fresh:
            keys, count = band_keys([x for _, x in fresh])
            size_of[[k + 1 for k, _ in fresh]] = count
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size_of, dtype=np.int32)), pa.array(keys.view(np.int64)))
        doc, line, i, n = zip(*rows)
        rows, fresh, size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int32()), lists], ["doc_id", "line", "id", "size", "keys"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = normal(text)
            at = [k for k, x in enumerate(lines) if x]
            for k, i in zip(at, _line_ids([lines[k] for k in at])):
                if i not in seen:
                    seen.add(i)
                    fresh.append((len(rows), lines[k]))
                    size += len(lines[k])
                rows.append((doc, k, i, len(lines[k])))
                if size > CHUNK or len(rows) > 20_000:
                    yield cut()
    if rows:
        yield cut()


def _distinct(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    h, first = shingle_hashes(lines)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]


def _sets(wanted):
    """(id, line) of the lines whose id the filter lets pass: the line is an eighth of its hashes' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                lines = [x for text in whole.column(0).slice(start, 1_000).to_pylist() for x in normal(text) if x]
                ids = _line_ids(lines)
                out = []
                for k in np.flatnonzero(may_hold(wanted.value, np.array(ids, dtype=np.int64))):
                    if ids[k] not in seen:
                        seen.add(ids[k])
                        out.append((ids[k], lines[k]))
                if out:
                    yield _set_batch(out)

    return run


def _set_batch(rows: list) -> pa.RecordBatch:
    i, h = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(h, pa.binary())], ["id", "h"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dropped): of each document that loses lines, the numbers of those that go, from 0.

    Of every component of equal and similar lines the occurrence with the least (document, line) stays. Lines end at \\n.
    Blank lines always stay. Null texts have no lines, null ids aren't compared. Rows with one id are one document.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines = written(base.mapInArrow(_profile, "doc_id long, line int, id long, size int, keys array<long>"), "lines")
    by_key = Window.partitionBy("sig")
    sigs = lines.df.select(F.explode("keys").alias("sig"), "id", "size")
    shared = sigs.withColumns({"leader": F.min("id").over(by_key), "last": F.max("id").over(by_key)}).where("leader < last").select("sig", "id", "leader", "size")
    shared = written(shared.distinct(), "shared")
    links = connect(lambda wanted: base.select("text").mapInArrow(_sets(wanted), "id long, h binary"), shared, RULE, _distinct, inside=True)
    comp = components(links)
    shared.drop()
    # Only lines that occur twice or are like another can go; the rest is left out before their occurrences are compared.
    several = lines.df.groupBy("id").count().where("count > 1").select("id").union(comp.df.select("id"))
    some = written(lines.df.select("doc_id", "line", "id").join(several, "id", "left_semi"), "occurrences").df
    first = some.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    first = first.join(comp.df, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    first = written(first, "first").df
    keep = first.groupBy("component").agg(F.min("first").alias("keep"))
    keep = written(first.select("id", "component").join(keep, "component").select("id", "keep"), "keep").df
    gone = some.join(keep, "id").where(F.struct("doc_id", "line") != F.col("keep"))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text without the lines that go; a document that loses all lines has an empty text."""
    shield = Shield(docs, ("__id", "__dropped"))
    docs = shield.df
    gone = dropped_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped"))
    # The lines' numbers less those that go, in order: linear in a long document, where a search a line would not be.
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped")))
    kept = F.transform(left, lambda i: F.get(lines, i))
    out = docs.join(gone, F.col(id_col) == F.col("__id"), "left")
    return shield.restored(out.withColumn(text_col, F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop("__id", "__dropped"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for each row: the numbers of the lines that go, in order."""
    gone = dropped_lines(docs, id_col, text_col).withColumnRenamed("doc_id", "__id")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = base.join(gone, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))
