"""The pipeline's stages, each against a brute-force version on its own input."""

import re
import zlib

import pytest

from quillmap.llm import decontam, mixing, toxicity
from quillmap.llm.ngram_join import Jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = WORD.findall((text or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_toxicity(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(d["doc_id"], d["text"]) for d in docs if d["doc_id"] in labels and zlib.crc32(str(d["doc_id"]).encode()) % 5]
    model = toxicity.train([t for _, t in sorted(known)], [labels[i] for i, _ in sorted(known)])
    return [d for d, (s, _) in zip(docs, toxicity.Scorer(model)([d["text"] for d in docs])) if s < 0.5]


def brute_near(spark, docs):
    rule, s = Jaccard(5, 80, 100), {d["doc_id"]: shingles(d["text"]) for d in docs}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for i in sorted(s):
        near = {}
        for x in s[i]:
            for j in held.get(x, ()):
                near[j] = near.get(j, 0) + 1
            held.setdefault(x, []).append(i)
        for j, n in near.items():
            if rule.linked(n, len(s[i]), len(s[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def brute_leaks(spark, docs):
    items = [(r["item_id"], decontam.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return [d for d in docs if not any(t in decontam.normal(d["text"]) for _, t in items)]


def test_each_stage(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns = df.columns
    brute = [brute_toxicity, brute_near, brute_leaks]
    key = lambda rows: sorted((r["doc_id"], r["text"], r["source"], r["lang"], r["n_chars"]) for r in rows)
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        docs = df.collect()
        df = stage(spark, df, SF).cache()
        assert df.columns == columns and key(df.collect()) == key(plain(spark, docs)), name
        assert df.count() < len(docs)
    # The mix: copies of input rows, as often as the operator says, near the targets.
    before = df
    plan = mixing.mix_sources(before).collect()
    df = corpus_pipeline.STAGES[3][1](spark, before, SF).cache()
    assert df.columns == columns and key(df.collect()) == key([r for r in plan for _ in range(r["__reps"])])
    want = {r["source"]: r["__target"] for r in plan}
    got = dict.fromkeys(want, 0)
    for r in df.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(r["__size"] for r in plan)
    assert all(abs(got[s] - want[s]) <= longest for s in want)
    # Shards: all rows, near equal bytes, slots without gaps.
    out = corpus_pipeline.STAGES[4][1](spark, df, SF).collect()
    assert key(out) == key(df.collect())
    size = {}
    for r in out:
        size.setdefault(r["shard"], []).append((r["slot"], len(r["text"].encode()) + 1))
    assert sorted(size) == list(range(8)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in size.values())
    sums = [sum(n for _, n in v) for v in size.values()]
    assert max(sums) < 1.1 * min(sums)


def test_run_and_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (None, "a b", "en", None, 3), (4, " ".join(["long"] * 40_000), "en", "t", 200_000)], docs.schema)
    odd.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {3, 4} and sorted({r["shard"] for r in out})[-1] <= 7
