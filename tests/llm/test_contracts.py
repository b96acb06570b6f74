"""The columns that the queries promise, over whole small tables, computed here in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from quillmap.llm import queries, tiff

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs):
    sets = {}
    for d in docs:
        w = words((d["text"] or "").translate(ASCII_LOWER))
        sets[d["doc_id"]] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    ids = sorted(sets)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if min(x, y) and 100 * min(x, y) >= 90 * max(x, y):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 90 * (x + y - inter):
                    low, high = sorted((root(a), root(b)))
                    least[high] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op1_ngram_jaccard_join")}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}


def test_op2(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = result(spark, "op2_chat_formatting")
    assert len(got) == len(said)
    for r in got:
        turns = sorted(said[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_op4(spark, docs):
    got = result(spark, "op4_kd_sharding")
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(raw)
    shards, places = defaultdict(list), defaultdict(set)
    for r in got:
        text = raw[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        shards[r["shard"]].append(r)
        if r["group_parts"] == 1:
            places[text].add(r["shard"])
    assert sorted(shards) == list(range(8))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    assert all(len(v) == 1 for v in places.values())
    sizes = [sum(r["size"] for r in v) for v in shards.values()]
    assert max(sizes) - min(sizes) <= 2 * max(len(t) + 1 for t in raw.values())


def test_op6(spark, docs):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in result(spark, "op6_toxicity")}
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    learnt = [i for i in got if i in toxic and not got[i]["held_out"]]
    assert sum(got[i]["predicted"] == toxic[i] for i in learnt) >= 0.9 * len(learnt)


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op7_tiff_media")}
    assert len(got) == len(docs)
    codecs = set()
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (size - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), size, hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        media = tiff.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        codecs |= {(p["codec"], p["tiled"]) for p in tiff.read(media)}
    assert len(codecs) == len(tiff.FORMS)


def test_op8(spark, docs):
    size, source = {d["doc_id"]: len(words(d["text"])) for d in docs}, {d["doc_id"]: d["source"] for d in docs}
    total = defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, clamped = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * total[s] for s in clamped)
        share = sum(weight[s] for s in names if s not in clamped)
        want = {s: 2 * total[s] if s in clamped else rest * weight[s] / share for s in names}
        above = {s for s in names if s not in clamped and want[s] > 2 * total[s]}
        if not above:
            break
        clamped |= above
    got = result(spark, "op8_source_mixing")
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(docs)
    longest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in names)
    assert sorted(got) == sorted(result(spark, "op8_source_mixing"))


def test_op10(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in result(spark, "op10_secret_scan")}
    assert len(got) == len(docs)
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        assert r["n_assign"] == sum(len(m[2]) >= 12 for m in assign.finditer(text))
        assert r["n_access"] == sum(len(m[0]) >= 18 for m in re.finditer("AKIA[A-Z0-9]+", text))
        assert r["n_hex"] == sum(len(m[0]) >= 16 for m in re.finditer("[0-9a-f]+", text))
