"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m characters that occurs in a document with at most e = floor(rate * m) edits shares at least
m + 1 - q * (e + 1) q-grams with it, all within a band of e + 1 neighbouring diagonals (document position less item
position). Each item takes the longest q up to the given one for which that is at least 1, so every item has its full
budget of edits, however short. Every document's q-grams are looked up in the items' indexes, one for each q, and counted
in bands of twice an item's step e + 1, a step apart, so that each such run of diagonals lies within some band. Bands
that meet the count are verified by banded alignment of the whole item. Texts are compared in lower case with runs of
white space as one blank.

Items come to the tasks in blocks of bounded size, one pass over the documents a block, whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import trim, worker_store
from .textkit import CHUNK, U64, mix

Q = 8
RATE = 0.1
#: Characters of items in one broadcast block.
BLOCK_CHARS = 8_000_000
_blank = re.compile(r"\s+")
#: Characters of a document that are looked at at once; the next piece repeats as many as an item and its edits may take.
PIECE = CHUNK


def normal(text: str) -> str:
    return _blank.sub(" ", text.lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = h * U64(0x100000001B3) + codes[i : i + n]
    return mix(h, 41)


def indexes(items: list[tuple[int, str]], q: int, rate: float) -> list[Index]:
    """An index for each length of q-gram that some items take: the longest up to ``q`` that the lemma allows."""
    by: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for i, text in items:
        codes = _codes(normal(text))
        e = int(rate * len(codes))
        if len(codes):
            by.setdefault(max(1, min(q, len(codes) // (e + 1))), []).append((i, codes, e))
    return [Index(rows, own) for own, rows in sorted(by.items())]


class Index:
    """The q-grams of items that take q-grams of one length, and what each item asks for."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], q: int):
        self.q, self.ids, self.codes = q, [i for i, _, _ in items], [c for _, c, _ in items]
        self.edits = np.array([e for _, _, e in items], dtype=np.int64)
        self.size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.least = np.maximum(1, self.size + 1 - q * (self.edits + 1))
        self.step = self.edits + 1
        hashes = [_grams(c, q) for c in self.codes]
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], owner[order], place[order]
        self.keys, self.first = np.unique(h, return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bits = max(16, min(26, int(len(self.keys) * 16).bit_length()))
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[(self.keys >> U64(64 - self.bits)).astype(np.int64)] = True

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of twice the item's step of diagonals that share enough q-grams."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[(h >> U64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return none
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        if not len(at):
            return none
        times = self.count[k]
        row = np.repeat(np.arange(len(at)), times)
        j = self.first[k][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        item, diagonal = self.owner[j], at[row] - self.place[j]
        # Each q-gram place of an item counts once in a band, however often the text repeats it.
        lane = diagonal // self.step[item]
        key = np.concatenate([(item << 40) + lane + (1 << 20), (item << 40) + lane - 1 + (1 << 20)])
        low = int(self.least.min())
        u, back, n = np.unique(key, return_inverse=True, return_counts=True)
        rich = n >= np.maximum(low, self.least[u >> 40])
        if not rich.any():
            return none
        keep = rich[back]
        pair = np.unique(np.stack([key[keep], np.tile(self.place[j], 2)[keep]]), axis=1)
        u, n = np.unique(pair[0], return_counts=True)
        item = u >> 40
        good = n >= self.least[item]
        return item[good], ((u & ((1 << 40) - 1)) - (1 << 20))[good] * self.step[item[good]]

    def align(self, codes: np.ndarray, item: int, diagonal: int) -> tuple[int, int]:
        """(edits, end) of the item's best alignment with the text on diagonals from ``diagonal`` on, twice its step of them."""
        pattern, e = self.codes[item], int(self.edits[item])
        start, width = diagonal - e, 2 * int(self.step[item]) + 2 * e
        far = len(pattern) + width + 1
        lane = np.arange(width)
        text = np.full(len(pattern) + width, -1, dtype=np.int64)
        a, b = max(0, start), min(len(codes), start + len(text))
        if b > a:
            text[a - start : b - start] = codes[a:b]
        # Cell (i, d): i characters of the item against the text up to start + i + d.
        row = np.where((start + lane >= 0) & (start + lane <= len(codes)), 0, far)
        for i, c in enumerate(pattern):
            new = row + (text[i : i + width] != c)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - lane) + lane
        best = int(np.argmin(row))
        return int(row[best]), start + len(pattern) + best


def find(found_in: list[Index], text: str) -> list[tuple[int, int, int]]:
    """(item id, edits, end in the normal text) of the items that occur; the best place of each."""
    codes = _codes(normal(text))
    return sorted(hit for index in found_in for hit in _find(index, codes))


def _find(index: Index, codes: np.ndarray) -> list[tuple[int, int, int]]:
    found: dict[int, tuple[int, int]] = {}
    overlap = int((index.size + 2 * index.edits + 2 * index.step).max(initial=0)) + index.q
    for at in range(0, max(1, len(codes) - overlap), PIECE):
        piece = codes[at : at + PIECE + overlap]
        for item, diagonal in zip(*index.bands(piece)):
            edits, end = index.align(piece, int(item), int(diagonal))
            if edits <= index.edits[item] and (int(item) not in found or edits < found[int(item)][0]):
                found[int(item)] = edits, at + end
    return [(index.ids[k], *v) for k, v in found.items()]


#: The indexes of the blocks that a worker has met, by broadcast: the tasks of one worker share them. At most two are kept.
_known: dict[int, tuple[list, list[Index]]] = worker_store()


def _indexes(shared, q: int, rate: float) -> list[Index]:
    block = shared.value  # one object for each broadcast and worker
    if id(block) not in _known:
        while len(_known) > 1:
            _known.pop(next(iter(_known)))
        _known[id(block)] = block, indexes(block, q, rate)  # the block stays, so its id is no other's
    return _known[id(block)][1]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():  # one block on the driver at a time
        if row[1] is None or not row[1].strip():
            continue
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, end): the items that occur in each document with at most rate * length edits.

    Null and empty texts contain nothing, null and blank items occur nowhere. Items under 1 / rate
    characters allow no edits, so a very short one occurs in many texts. Repeated rows give repeated results. ``end`` counts characters of the normal text. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, edits int, end long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string"))):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trim()
            index = _indexes(shared, q, rate)
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in find(index, text)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "edits", "end"])

        out = out.unionByName(base.mapInArrow(run, schema))
    return out
