"""The n-gram join against brute force: sets, links and components."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmap.llm.ngram_join import Jaccard, _parts, _tiles, bitmap, jaccard_components, one_of_each, overlap_bound, signatures
from quillmap.llm.textkit import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def sets(text, width):
    w = WORD.findall((text or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    s = {i: sets(t, rule.width) for i, t in rows}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and rule.linked(len(s[a] & s[b]), len(s[a]), len(s[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed, families, size):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for f in range(families):
        base = r.choices(vocabulary, k=r.choice([1, 2, 4, 9, 11, 25, 60, 150, 400]))
        if f % 3 == 0:
            base = base + passage
        for _ in range(size):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                if not text:
                    break
                at = r.randrange(len(text))
                text[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [text[at], r.choice(vocabulary)]])
            rows.append((len(rows), r.choice([" ", "\n", "\t"]).join(text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [Jaccard(3, 90, 100), Jaccard(5, 80, 100)])
def test_components_match_brute_force(spark, rule):
    rows = corpus(rule.num, 27, 14)
    want = brute(rows, rule)
    assert sum(i != c for i, (_, c) in want.items()) > 40
    got = jaccard_components(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), rule)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("rule", [Jaccard(3, 90, 100), Jaccard(5, 80, 100)])
def test_linked_sets_share_a_signature(rule):
    """The guarantee itself, over many sizes, without Spark."""
    r = random.Random(1)
    for n in (9, 10, 11, 12, 19, 20, 24, 25, 31, 57, 100, 257, 900):
        for _ in range(40):
            base = [f"{r.random()}" for _ in range(n)]
            other = list(base)
            while True:  # as different as the rule allows
                trial = list(other)
                if r.random() < 0.5 and len(trial) > 1:
                    trial.pop(r.randrange(len(trial)))
                else:
                    trial[r.randrange(len(trial))] = f"{r.random()}"
                a, b = (set(x) for x in (base, trial))
                if not rule.linked(len(a & b), len(a), len(b)):
                    break
                other = trial
            one = Jaccard(1, rule.num, rule.den)
            h, g = shingle_sets([" ".join(base).encode(), " ".join(other).encode()], 1)
            if set(h.tolist()) != set(g.tolist()):
                a, b = ({(x, c) for _, c, found in signatures(s, one) for x in found.tolist()} for s in (h, g))
                both = {x for x, _ in a} & {x for x, _ in b}
                # In the tile that both are in they share as many as either promises.
                promised = [max(c for x, c in own if x in both) for own in (a, b) if both]
                assert both and len(both) >= max(promised), (n, len(h), len(g), promised)


def test_bitmap_bounds_the_overlap_from_above():
    h, g = shingle_sets([b" ".join(b"%d" % i for i in range(500)), b" ".join(b"%d" % i for i in range(60, 530))], 1)
    for bits in (64, 256, 4096):
        bound = overlap_bound(bitmap(h, bits), len(h), bitmap(g, bits)[None, :], __import__("numpy").array([len(g)]))[0]
        assert bound >= 440
    assert bound < 455
    assert _parts(100, Jaccard(3, 90, 100))[0] == 10 and len(_tiles(100, Jaccard(3, 90, 100))) in (1, 2)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (5, "A"), (6, "a b c d"), (7, "A b c"), (8, long), (9, long + " x"), (None, "a b c d"), (None, "solo text of a nameless row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "h": F.lit("x"), "sig": F.lit(2), "id": F.lit("clash")})
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(df, Jaccard(3, 90, 100)).collect())
    assert [g for g in got if g[0] >= 0] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 2, 6), (7, 1, 7), (8, 29998, 8), (9, 29999, 8)]
    assert sorted(x[1:] for x in got if x[0] < 0)[0][0] == 2
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in one_of_each(df, Jaccard(3, 90, 100)).collect())
    assert kept == [-1, -1, 1, 2, 3, 4, 6, 7, 8]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA), Jaccard()).count() == 0


def test_giant_family_of_near_copies(spark):
    """Hundreds of copies that each differ from the base, with tiles forced small."""
    from quillmap.llm import ngram_join

    r = random.Random(5)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = f"x{r.random()}"
        rows.append((i, " ".join(t)))
    rule = Jaccard(3, 90, 100)
    want = brute(rows, rule)
    held = ngram_join.BLOCK_ROWS, ngram_join.FORESTS, ngram_join.STAR_ROWS
    ngram_join.BLOCK_ROWS, ngram_join.FORESTS, ngram_join.STAR_ROWS = 40, 1, 7
    try:
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rule)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    finally:
        ngram_join.BLOCK_ROWS, ngram_join.FORESTS, ngram_join.STAR_ROWS = held


def test_texts_around_one_passage_do_not_meet(spark, monkeypatch):
    """Seven tenths of each text are a passage that all have; too few for a link, so none is a candidate."""
    from quillmap.llm import ngram_join

    met = {}

    def seen(df, name, written=ngram_join.written):
        table = written(df, name)
        met[name] = met.get(name, 0) + table.df.count()
        return table

    monkeypatch.setattr(ngram_join, "written", seen)
    r = random.Random(9)
    passage = [f"p{k}" for k in range(210)]
    rows = [(i, " ".join(passage + [f"x{r.random()}" for _ in range(90)])) for i in range(60)]
    rows += [(100, rows[0][1] + " end"), (101, rows[1][1].replace("p7 ", "q7 "))]  # two links among them
    rule = Jaccard(5, 80, 100)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rule)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, rule)
    assert met["shared"] < 1000 and met["sets"] == 4 and met["tiles"] <= 4
