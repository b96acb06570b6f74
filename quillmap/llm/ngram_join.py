"""N-gram Jaccard self-join: rare shingles find candidates, hashed bitmaps bound their overlap, sorted arrays are intersected.

How a link can't be lost, for sets of distinct word shingles and a threshold g = num/den:

* A set of n shingles shares at least c = ceil(g n) of them with each set that it links with. So a set of which more than
  n - c shingles occur nowhere else links with nothing. A screen counts those in a piece of the hash space, twice as
  wide as 1 - g, which suffices for most texts that have no near copy; whoever it drops needn't be counted any further.
* The shingles of the others are all dealt by their value, their signatures. A set that shares fewer than c with any
  others drops out, and the c - 1 most shared ones of the rest aren't needed: the rarest shingle that two linked sets
  share is among what both keep. That rids the search of common passages.
* Sets with a kept signature in common are candidates. Each is first compared with the leader (the least id of a
  signature's sets) that it shares most signatures with. What stays apart meets at the leaders as parity bitmaps, in
  tiles of bounded size: differing bits bound the overlap from above. The few pairs that pass are intersected as
  sorted arrays. A tile proposes some forests of such pairs, so at most a fixed number for each member; in tiles that
  had more, and are still apart, the members then meet once again with their sets, and all that pass are intersected.

Only connection is asked for, so a group of thousands of copies costs about one comparison a member, never all pairs.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .store import Table, forget, id_filter, may_hold, without_ids, written
from .textkit import U64, mix, shingle_sets
from .unionfind import components

#: Members of one block of a tile, of about 100 bytes each; two blocks at a time in a task.
BLOCK_ROWS = 8_192
#: Bytes of sets that members of one block bring, where they bring them.
BLOCK_BYTES = 1 << 22
#: Forests of pairs that a tile of bitmaps proposes; tiles that had more are gone through with the sets themselves.
FORESTS = 16
#: So many times wider are bitmaps where the sets are at hand too and the bitmaps needn't travel.
WIDER = 8
#: Words of bitmaps that are compared at once, 8 bytes each.
BOUND_WORDS = 1 << 17
#: Passes in which the signatures are dealt if the screen drops nothing, a piece of the hash space each; what one has dealt is gone from disk before the next.
PASSES = 4
#: Members that one copy of a leader's set is compared with.
STAR_ROWS = 1_000


@dataclass(frozen=True)
class Jaccard:
    """Shingles of ``width`` words, linked when den * intersection >= num * union."""

    width: int = 5
    num: int = 80
    den: int = 100

    def linked(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)

    def least_overlap(self, a, b):
        """The smallest intersection that links sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least_shared(self, n):
        """The smallest intersection of a set of n shingles with any that it links with."""
        return -(-self.num * n // self.den)


@lru_cache(maxsize=4096)
def _band(n: int, rule: Jaccard) -> tuple[int, int, int]:
    """Number, least and greatest size of the band that holds size n. Bands widen by a quarter."""
    low, i = 1, 0
    while True:
        high = max(low, low * 5 // 4)
        if n <= high:
            return i, low, high
        low, i = high + 1, i + 1


@lru_cache(maxsize=4096)
def _parts(high: int, rule: Jaccard) -> tuple[int, int]:
    """k, the greatest symmetric difference of a linked pair of sizes up to ``high``; m, the number of parts."""
    k = (rule.den - rule.num) * 2 * high // (rule.den + rule.num)
    m = k + 1
    for _ in range(4):  # room for parts with under two shingles, three standard deviations
        mean = 0.85 * high / m
        p = exp(-mean) * (1 + mean)
        m = k + 1 + ceil(m * p + 3 * sqrt(m * p))
    return k, m


def _tiles(n: int, rule: Jaccard) -> list[tuple[int, int, int]]:
    """(tile, k, m) for a set of n shingles: its own band's, and the next one's if a linked set can stand there."""
    i, _, high = _band(n, rule)
    out = [(i, *_parts(high, rule))]
    if n * rule.den // rule.num > high:
        j, _, above = _band(high + 1, rule)
        out.append((j, *_parts(above, rule)))
    return out


def signatures(h: np.ndarray, rule: Jaccard) -> list[tuple[int, int, np.ndarray]]:
    """(0, c, signatures) of a sorted set of shingle hashes: all of them, of which it shares c with each set that it links with."""
    c = rule.least_shared(len(h))
    # Otherwise only equal sets link, and those are one class.
    return [(0, c, h)] if c < len(h) or len(h) * rule.den // rule.num > len(h) else []


def piece(h: np.ndarray, low: int, high: int) -> np.ndarray:
    """The hashes from ``low`` to below ``high``, at most 2**64, of a sorted array."""
    return h[int(np.searchsorted(h, U64(low))) : int(np.searchsorted(h, U64(high))) if high < 1 << 64 else len(h)]


def set_keys(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys; equal sets, and no others but by a collision of 128 bits, have equal keys."""
    with np.errstate(over="ignore"):
        a, b = mix(h, 21).sum(dtype=U64), mix(h, 22).sum(dtype=U64)
    return int(np.int64(mix(np.array([a]) + U64(len(h)), 23).view(np.int64)[0])), int(np.array([b]).view(np.int64)[0])


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap as 64-bit words: each differing bit of two of them needs a shingle that only one set has."""
    on = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(on).view(U64)


def overlap_bound(a: np.ndarray, n: int, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds on the overlap of one set with many, from bitmaps of equal width."""
    step = max(1, BOUND_WORDS // len(a))
    differ = [np.bitwise_count(a ^ b[at : at + step]).sum(axis=1, dtype=np.int32) for at in range(0, len(b), step)]
    return (n + sizes - np.concatenate([np.zeros(0, np.int32), *differ])) // 2


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _texts(column: pa.Array) -> list[bytes | None]:
    return [None if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array((np.concatenate(rows) if rows else np.zeros(0, U64)).view(np.int64)))


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that memory doesn't follow the rows of a batch."""
    size = np.cumsum(np.frombuffer(pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), dtype=np.int64)) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _profile(rule: Jaccard):
    """(id, n, k1, k2) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in _slices(whole, "text"):
                sets = shingle_sets(_texts(batch.column("text")), rule.width)
                keys = [set_keys(h) for h in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["id", "n", "k1", "k2"])

    return run


def _passing(whole: pa.RecordBatch, filter_, want: bool) -> pa.RecordBatch:
    ids = whole.column("id")
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    on = may_hold(filter_.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
    return whole.filter(pa.array((on if want else ~on) & valid))


def _signed(rule: Jaccard, filters: list, low: int, high: int):
    """(id, c, sigs) with a piece of the signatures, of the texts whose id each filter lets pass, or denies, as it is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for filter_, want in filters:
                whole = _passing(whole, filter_, want)
            for batch in _slices(whole, "text"):
                sets = shingle_sets(_texts(batch.column("text")), rule.width)
                rows = [(i, c, piece(sigs, low, high)) for i, h in zip(batch.column("id").to_pylist(), sets) for _, c, sigs in signatures(h, rule)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), _lists([r[2] for r in rows])], ["id", "c", "sigs"])

    return run


def _packed(rule: Jaccard, filter_):
    """(id, h, n, bits) of the texts whose id the filter lets pass, an id once a task: the packed text, a third of its hashes' size, the size of its set and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        for whole in batches:
            whole = _passing(whole, filter_, True)
            new = []
            for i in whole.column("id").to_pylist():
                new.append(i not in seen)
                seen.add(i)
            for batch in _slices(whole.filter(pa.array(new, pa.bool_())), "text"):
                texts = _texts(batch.column("text"))
                sets = shingle_sets(texts, rule.width)
                bits = [bitmap(h, width_of(len(h), rule)).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([zlib.compress(t or b"", 1) for t in texts], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array(bits, pa.binary())], ["id", "h", "n", "bits"])

    return run


def _unpacked(width: int, packed: list[bytes]) -> list[np.ndarray]:
    return shingle_sets([zlib.decompress(raw) for raw in packed], width)


def _decoded(packed: list[bytes], decode: Callable, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sets of packed texts, decoded a megabyte at a time."""
    at = 0
    while at < len(packed):
        end, size = at, 0
        while end < len(packed) and (end == at or size < most):
            size += len(packed[end])
            end += 1
        yield from decode(packed[at:end])
        at = end


def _star(rule: Jaccard, decode: Callable):
    """Rows sorted by (leader, part, role): the leader's set first, then its members', one at a time. Says of each pair whether it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, None
        for batch in batches:
            found = []
            sets = _decoded(batch.column("h").to_pylist(), decode)
            for leader, part, role, i, h in zip(*(batch.column(c).to_pylist() for c in ("leader", "part", "role", "id")), sets):
                if role == 0:
                    held, group = h, (leader, part)
                    continue
                assert group == (leader, part)
                need = rule.least_overlap(len(h), len(held))
                found.append((i, leader, min(len(h), len(held)) >= need and intersection(h, held) >= need))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    return run


def width_of(n: int, rule: Jaccard) -> int:
    """Bits of the bitmap of n shingles: four for each that a linked set may differ in, a power of two."""
    return max(64, 1 << (4 * max(1, _parts(max(1, n * rule.den // rule.num), rule)[0])).bit_length())


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps narrowed to so many 64-bit words: halves laid over each other."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _meeting(rule: Jaccard, lab: np.ndarray, n: np.ndarray, bits: list[np.ndarray], block: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): for each member of a tile, in order of size, the later ones whose bitmap and size let them link.

    Only members with another label are given; labels may change while this runs. ``block``: only pairs of two blocks.
    """
    words = np.array([len(b) for b in bits])
    for w in np.unique(words):
        xs = np.flatnonzero(words == w)
        top = int(np.searchsorted(n, n[xs[-1]] * rule.den // rule.num, side="right"))
        # Wider bitmaps belong to larger sets; all that a set of this width can link with, at this width, a column each.
        maps = np.empty((w, top - xs[0]), dtype=U64)
        for y in range(xs[0], top):
            maps[:, y - xs[0]] = folded(bits[y][None, :], w)[0]
        size = n[xs[0] : top]
        for x in xs:
            high = int(np.searchsorted(n, n[x] * rule.den // rule.num, side="right"))
            apart = lab[x + 1 : high] != lab[x]
            if block is not None:
                apart &= block[x + 1 : high] != block[x]
            ys = np.flatnonzero(apart)
            if len(ys):
                # Columns next to each other are compared where they lie, unless few of them count.
                cols = slice(x + 1 - xs[0], high - xs[0]) if 4 * len(ys) > len(apart) else ys + (x + 1 - xs[0])
                bound = overlap_bound(maps[:, x - xs[0]], int(n[x]), maps[:, cols].T, size[cols])
                passing = bound >= rule.least_overlap(int(n[x]), size[cols])
                ys = np.flatnonzero(passing & apart) if isinstance(cols, slice) else ys[passing]
                if len(ys):
                    yield int(x), ys + x + 1


class _Forests:
    """Edge-disjoint forests: a pair goes to the first one that doesn't connect it yet. What a later forest connects, each before it does."""

    def __init__(self, many: int):
        self.parents: list[dict[int, int]] = [{} for _ in range(many)]

    def _root(self, parent: dict[int, int], x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def takes(self, a: int, b: int) -> int:
        """The forest that now holds the pair, which the last one doesn't connect."""
        low, high = 0, len(self.parents) - 1
        while low < high:
            mid = (low + high) // 2
            if self._root(self.parents[mid], a) == self._root(self.parents[mid], b):
                low = mid + 1
            else:
                high = mid
        r, t = self._root(self.parents[low], a), self._root(self.parents[low], b)
        self.parents[low][max(r, t)] = min(r, t)
        return low


def _sorted_tile(rows: list) -> tuple[np.ndarray, ...]:
    ids, comp, block, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    order = np.lexsort((ids, n))
    return order, ids[order], comp[order], block[order], n[order]


def _proposed(rule: Jaccard, rows: list, between: bool, many: int) -> tuple[list[tuple[int, int]], bool]:
    """(pairs, cut): of a tile's pairs that may link, ``many`` forests over the components, so at most ``many`` a member.

    If all of the first forest link, all that may link here is connected. ``cut`` says that pairs may have been left out:
    what the last forest connects isn't compared any more.
    """
    order, ids, comp, block, n = _sorted_tile(rows)
    forests, lab, out, cut = _Forests(many), comp.copy(), [], False
    for x, ys in _meeting(rule, lab, n, [np.frombuffer(rows[k][4], dtype=U64) for k in order], block if between else None):
        for y in ys:
            if lab[x] == lab[y]:
                continue
            out.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))))
            if forests.takes(int(comp[x]), int(comp[y])) == many - 1:
                cut = True
                lab[lab == max(lab[x], lab[y])] = min(lab[x], lab[y])
    return out, cut


def _proven(rule: Jaccard, rows: list, between: bool) -> list[tuple[int, int]]:
    """Links that connect all that is linked in a tile: pairs that may link are intersected until their components are one."""
    order, ids, comp, block, n = _sorted_tile(rows)
    sets = [rows[k][4] for k in order]
    lab, out = comp.copy(), []
    for x, ys in _meeting(rule, lab, n, [bitmap(h, WIDER * width_of(len(h), rule)) for h in sets], block if between else None):
        for y in ys:
            if lab[x] == lab[y]:
                continue
            if intersection(sets[x], sets[y]) >= rule.least_overlap(int(n[x]), int(n[y])):
                out.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))))
                lab[lab == max(lab[x], lab[y])] = min(lab[x], lab[y])
    return out


def _tiled(rule: Jaccard, decode: Callable, inside: bool):
    """Rows sorted by (leader, i, j): a tile's members are gathered, which are bounded, and compared.

    (id, leader, cut): pairs, and a row with only the tile's leader where some were cut. ``inside``: members bring their
    sets in place of bitmaps, and the pairs are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, rows = None, []

        def done() -> list[tuple[int | None, int, bool]]:
            if len(rows) < 2:
                return []
            if inside:
                sets = list(_decoded([r[4] for r in rows], decode))
                return [(a, b, False) for a, b in _proven(rule, [[r[0], r[1], r[2], len(h), h] for r, h in zip(rows, sets)], key[1] != key[2])]
            pairs, cut = _proposed(rule, rows, key[1] != key[2], FORESTS)
            return [(a, b, False) for a, b in pairs] + ([(None, key[0], True)] if cut else [])

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["id", "leader", "cut"])

        for batch in batches:
            found = []
            for leader, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "id", "comp", "block", "n", "bits"))):
                if key != (leader, i, j):
                    found += done() if key else []
                    key, rows = (leader, i, j), []
                rows.append(row)
            yield batch_of(found)
        yield batch_of(done() if key else [])

    return run


def jaccard_components(docs: DataFrame, rule: Jaccard, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII white space. class_id is the least id with an equal set, component_id
    the least id that links reach. An id names one text: rows with one id count as one document. Null texts and texts without words have an empty set: n_shingles 0, linked with
    nothing, class and component are the row's own id. Repeated rows give repeated result rows. Rows with a null id are
    returned; they take part through equal sets only, and a set that only they have gives null. Other columns of
    ``docs`` aren't read. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = written(base.mapInArrow(_profile(rule), "id long, n long, k1 long, k2 long"), "profile")
    keyed = profile.df.where("n > 0")
    classes = written(keyed.groupBy("k1", "k2", "n").agg(F.min("id").alias("class_id")), "classes")
    # Both sides are read from files, so a class with very many rows is split between tasks as they are dealt.
    classed = written(keyed.join(classes.df, ["k1", "k2", "n"]).select("id", "n", "class_id"), "classed")
    # Each class is signed once, by the row of its least id. Ids that the filter denies are such rows for sure; only the
    # others are looked up, so no signature moves before it is dealt by its value.
    copies = written(classed.df.where("id <> class_id").select("id").union(keyed.groupBy("id").count().where("count > 1").select("id")), "copies")
    filter_ = id_filter(copies.df)
    near = written(_screened(base, rule, filter_, classed.df.where("id = class_id").groupBy("id").agg(F.max("n").alias("n"))), "near")
    near_filter, ids = id_filter(near.df), near.df.select("id")
    total, left = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (classes.df, near.df))
    many = max(1, -(-PASSES * left // max(1, total)))
    cuts = [(k << 64) // many for k in range(many + 1)]
    parts = [written(_often(_dealt(base, rule, filter_, [(near_filter, True)], ids, low, high)), "often") for low, high in zip(cuts, cuts[1:])]
    own = Window.partitionBy("id")
    often = _all([p.df for p in parts]).withColumns({"found": F.count("*").over(own), "place": F.row_number().over(own.orderBy(F.desc("often"), "sig"))})
    shared = written(often.where("found >= c and place >= c").select("sig", "id", "leader"), "shared")
    for table in parts:
        table.drop()
    links = connect(lambda wanted: base.mapInArrow(_packed(rule, wanted), "id long, h binary, n long, bits binary"), shared, rule, partial(_unpacked, rule.width))
    comp = components(links)
    for table in (shared, near, classes, copies):
        table.drop()
    full = classed.df.join(comp.df.withColumnRenamed("id", "class_id"), "class_id", "left").select("id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    none = profile.df.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return full.unionByName(none)


def _dealt(base: DataFrame, rule: Jaccard, copies, filters: list, firsts: DataFrame, low: int, high: int) -> DataFrame:
    """(id, c, sig): a piece of the signatures of the ids in ``firsts``, each once, and maybe of others that are first in their class too."""
    kind = "id long, c int, sigs array<long>"
    sure = base.mapInArrow(_signed(rule, [(copies, False), *filters], low, high), kind)
    some = base.mapInArrow(_signed(rule, [(copies, True), *filters], low, high), kind).join(firsts, "id", "left_semi").dropDuplicates(["id"])
    return sure.unionByName(some).select("id", "c", F.explode("sigs").alias("sig"))


def _screened(base: DataFrame, rule: Jaccard, copies, firsts: DataFrame) -> DataFrame:
    """Of ``firsts`` (id, n) those that may link: not more of their shingles in a piece of the hash space occur once than a link allows."""
    high = min(1 << 64, (1 << 65) * (rule.den - rule.num) // rule.den)
    sigs = _dealt(base, rule, copies, [], firsts.select("id"), 0, high).select("id", "sig")
    # Most occur once, so nothing is counted before they are dealt.
    alone = sigs.repartition("sig").groupBy("sig").agg(F.count("*").alias("often"), F.min("id").alias("id")).where("often = 1").groupBy("id").agg(F.count("*").alias("alone"))
    least = F.expr(f"(n * {rule.num} + {rule.den - 1}) div {rule.den}")
    return firsts.join(alone, "id", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("n") - least).select("id", "n")


def _often(sigs: DataFrame) -> DataFrame:
    """(id, c, sig, often, leader): the signatures that several classes have."""
    by_sig = Window.partitionBy("sig")
    return sigs.withColumns({"often": F.count("*").over(by_sig), "leader": F.min("id").over(by_sig)}).where("often > 1")


def one_of_each(docs: DataFrame, rule: Jaccard, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least id. Documents without words stay, rows without an id too."""
    found = written(jaccard_components(docs, rule, id_col, text_col).select("id", "component_id"), "found")
    known = found.df.where("id is not null")
    gone = written(known.where("id <> component_id").select("id").distinct(), "gone")
    twice = written(known.groupBy("id").count().where("count > 1").select("id"), "twice")
    found.drop()
    return without_ids(docs, gone.df, id_col, twice.df)


def connect(sets_of: Callable, shared: Table, rule: Jaccard, decode: Callable, inside: bool = False) -> DataFrame:
    """Links (a, b) that connect all that is linked, from the table (sig, id, leader) of shared signatures.

    ``sets_of`` takes a broadcast id filter and gives (id, h), at least for the ids that pass; it may repeat a row in
    another task. It may add (n, bits), the size and bitmap of each set. ``decode`` makes of a list of such bytes h the
    sorted distinct 64-bit shingle hashes of each. ``inside``: the members of a tile bring h itself and are intersected
    there, which is best where h is hardly larger than a bitmap; ``shared`` then has a column size, the bytes of h. Else tiles propose pairs from bitmaps first, at most
    FORESTS for each member, and only those that had more and aren't one component then bring h.
    """
    ids = shared.df.select("id").union(shared.df.select("leader")).distinct()
    sets = written(sets_of(id_filter(ids)), "sets")

    # First against the one leader with most signatures in common. Dealt by id once, both counts follow.
    pairs = shared.df.where("id > leader").select("id", "leader").repartition("id").groupBy("id", "leader").count()
    pairs = pairs.groupBy("id").agg(F.min_by("leader", F.struct(-F.col("count"), F.col("leader"))).alias("leader"))
    links = [_verified(written(pairs, "pairs").df, sets, rule, decode).where("linked").select("a", "b")]

    # Then whatever shares a signature and isn't connected: those with signatures of one leader meet there.
    met = written(shared.df.select("leader", "id", *["size"] * inside).distinct(), "met")
    leaders = None
    if not inside:
        found = _meet(met.df, links, sets, rule, decode, False)
        links.append(_verified(found.df.where("not cut").select("id", "leader").distinct(), sets, rule, decode).where("linked").select("a", "b"))
        leaders = found.df.where("cut").select("leader").distinct()
    if inside or not leaders.isEmpty():
        sizes = sets.df.select("id", F.octet_length("h").alias("size")).dropDuplicates(["id"])
        rest = met.df if inside else met.df.join(leaders, "leader", "left_semi").join(sizes, "id")
        links.append(_meet(rest, links, sets, rule, decode, True).df.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    for table in (sets, met):
        table.drop()
    return _all(links)


def _meet(met: DataFrame, links: list[DataFrame], sets: Table, rule: Jaccard, decode: Callable, inside: bool) -> Table:
    """What ``_tiled`` finds where the members (leader, id, with size if ``inside``) of a leader meet, unless ``links`` make them one component."""
    comp = components(_all(links))
    size = F.col("size") if inside else F.lit(0)
    known = written(met.join(comp.df, "id", "left").select("leader", "id", size.cast("long").alias("size"), F.coalesce("component", "id").alias("comp")), "known")
    mixed = known.df.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    blocks = F.ceil(F.greatest(F.col("rows") / F.lit(BLOCK_ROWS), F.col("size") / F.lit(BLOCK_BYTES))).cast("int")
    mixed = written(mixed.select("leader", blocks.alias("blocks")), "mixed")
    member = known.df.join(mixed.df, "leader").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q")).select("leader", F.least("block", "q").alias("i"), F.greatest("block", "q").alias("j"), "id", "comp", "block")
    tiles = written(tiles, "tiles")
    what = [F.lit(0).cast("long").alias("n"), F.col("h").alias("bits")] if inside else ["n", "bits"]
    maps = sets.df.join(tiles.df.select("id").distinct(), "id", "left_semi").select("id", *what).dropDuplicates(["id"])
    rows = tiles.df.join(maps, "id").select("leader", "i", "j", "id", "comp", "block", "n", "bits")
    rows = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    found = written(rows.mapInArrow(_tiled(rule, decode, inside), "id long, leader long, cut boolean"), "found")
    for table in (comp, known, mixed, tiles):
        table.drop()
    return found


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _verified(pairs: DataFrame, sets: Table, rule: Jaccard, decode: Callable) -> DataFrame:
    """(a, b, linked) of pairs (id, leader): sets are intersected, a leader's with its members' as they pass by."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(STAR_ROWS)).cast("int").alias("parts"))
    members = pairs.join(sizes, "leader").select("id", "leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    leaders = sizes.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    # Roles are narrow; the sets move once to their ids and once to their leaders.
    star = leaders.unionByName(members).join(sets.df.select("id", "h"), "id").repartition("leader", "part").sortWithinPartitions("leader", "part", "role")
    return written(star.mapInArrow(_star(rule, decode), "a long, b long, linked boolean"), "verified").df
