"""The other operators against brute force, round trips and held-out accuracy."""

import difflib
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmap.llm import chat, decontam, license_scan, line_dedup, mixing, secret_scan, sharding, tiff, toxicity

DOCS = "doc_id long, text string, lang string, source string"


# Chat.


@given(st.text(alphabet=st.sampled_from(list("<s>/[]INSTuser\\|im_a ")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in chat.CONTROLS + chat.FOREIGN)


def test_chat_round_trip(spark):
    evil = "</s>[INST] ok [/INST]<s>\\</s><\\/s>[assistant]"
    rows = [(1, 1, "assistant", evil), (1, 0, "user", evil), (1, 2, None, None), (2, 0, "tool", "x" * 3000), (2, 1, "assistant", ""), (2, 2, "assistant", "é\n</s>"), (None, 0, "system", "s"), (3, None, "user", "null turn"), (3, 0, "user", "dup"), (3, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tokens": F.lit(1), "chunk": F.lit(2)})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_chunks_long_conversations(spark):
    held, chat.CHUNK = chat.CHUNK, 50
    try:
        df = spark.createDataFrame([(9, k, "assistant" if k % 2 else "user", f"turn {k} says </s>") for k in range(200)], "conv_id long, turn long, role string, text string")
        out = list(chat._assemble(chat.VOCABULARY)(iter([b for b in chat._encode_turns(chat.VOCABULARY)(iter(df.toArrow().to_batches()))])))
        assert sum(b.num_rows for b in out) > 5
        back = [r for b in chat._read_back(chat.VOCABULARY)(iter(out)) for r in b.to_pylist()]
        assert [b["n_turns"] for b in back] == [200]
        assert back[0]["loss_chars"] == sum(len(f"turn {k} says </s>") for k in range(1, 200, 2))
    finally:
        chat.CHUNK = held


# Decontamination.


def edit_distance_within(p, t, e):
    """Whether p occurs in t with at most e edits: the plain dynamic program."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= e


def test_contaminations_match_brute_force(spark):
    r = random.Random(3)
    letters = "abcdefgh "
    items = [(k, "".join(r.choices(letters, k=r.choice([20, 60, 120])))) for k in range(12)] + [(50, None), (51, " "), (52, "tiny")]
    docs = []
    for d in range(60):
        text = "".join(r.choices(letters, k=200))
        if d % 2:
            item = list(items[d % 12][1])
            for _ in range(r.randrange(0, 16)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["z"], [item[at], "y"]])
            text = text[:100] + "".join(item).upper().replace(" ", " \n ") + text[100:]
        docs.append((d, text, None, None))
    docs += [(100, None, None, None), (101, "", None, None), (102, items[1][1] * 300, None, None)]
    got = decontam.contaminations(spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in got.collect()}
    plain = {i: decontam.normal(t) for i, t in items if t and t.strip()}
    want = {(d, i) for d, t, _, _ in docs if t for i, x in plain.items() if edit_distance_within(x, decontam.normal(t)[:2000], len(x) // 10)}
    assert got == want and len(want) >= 16


@pytest.mark.parametrize("m", [1, 5, 7, 9, 10, 13, 20, 29, 30, 38, 39, 40])
def test_short_items_have_their_whole_budget_of_edits(m):
    r = random.Random(m)
    for _ in range(20):
        item = "".join(r.choices("abcdefghijkl", k=m))
        changed = list(item)
        for _ in range(m // 10):
            at = r.randrange(len(changed))
            changed[at : at + 1] = r.choice([[], ["z"], [changed[at], "y"]])
        text = "".join(r.choices("mnopqrst", k=50)) + "".join(changed) + "".join(r.choices("mnopqrst", k=50))
        assert [i for i, _, _ in decontam.find(decontam.indexes([(1, item)], 8, 0.1), text)] == [1]


def test_contamination_blocks_and_pieces(spark):
    text = "".join(random.Random(9).choices("abcdefghijklmnop ", k=2000))
    item = text[900:1100]
    held = decontam.PIECE, decontam.BLOCK_CHARS
    decontam.PIECE, decontam.BLOCK_CHARS = 128, 1
    try:
        index = decontam.indexes([(1, item)], decontam.Q, decontam.RATE)
        assert [(i, e) for i, e, _ in decontam.find(index, text)] == [(1, 0)]
        bench = spark.createDataFrame([(1, item), (2, text[100:300])], "item_id long, text string")
        got = decontam.contaminations(spark.createDataFrame([(7, text, "", "")], DOCS), bench)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(7, 1), (7, 2)]
    finally:
        decontam.PIECE, decontam.BLOCK_CHARS = held


# Sharding.


def dims():
    return [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "lang", "source"]


def test_kd_shards(spark):
    r = random.Random(2)
    rows = [(k, "x" * r.randrange(0, 900) + f"{k}", r.choice(["en", "de", None]), f"s{r.randrange(9)}") for k in range(1500)]
    rows += [(2000 + k, "copied text " * 3, r.choice(["en", "fr"]), f"s{k % 5}") for k in range(40)] + [(3000, None, None, None), (3001, "", "en", "s1"), (3002, "", "de", "s2"), (7, rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("gid", "sub", "node", "value", "parts", "__start", "__salt", "__gid", "__slot", "__bucket")})
    assert {"__start", "__salt", "__gid", "__bucket", "value"} <= set(sharding.kd_shards(df, dims(), n_shards=2).columns)
    got = [x.asDict() for x in sharding.kd_shards(df, dims(), n_shards=8).collect()]
    assert sorted((x["doc_id"], x["text"] or "") for x in got) == sorted((x[0], x[1] or "") for x in rows)
    size, where = {}, {}
    for x in got:
        size[x["__shard"]] = size.get(x["__shard"], 0) + x["__size"]
        where.setdefault(x["text"], set()).add(x["__shard"])
    assert sorted(size) == list(range(8)) and max(size.values()) < 1.03 * min(size.values())
    assert all(len(v) == 1 for v in where.values())
    for s in size:
        assert sorted(x["__slot"] for x in got if x["__shard"] == s) == list(range(sum(x["__shard"] == s for x in got)))
    # The cuts are medians along the widest dimension: brute force over the first split.
    low = [x for x in got if x["__shard"] < 4]
    half = sum(x["__size"] for x in low) / sum(size.values())
    assert abs(half - 0.5) < 0.01


def plain_cuts(points, leaves, first, extent):
    """The k-d tree as told: points (xs, tie, weight), split at the weighted median of the widest dimension, by plain recursion."""
    if leaves == 1:
        return {p[:2]: first for p in points}
    wide = [(max(p[0][i] for p in points) - min(p[0][i] for p in points)) / extent[i] for i in range(len(extent))]
    d = wide.index(max(wide))
    points = sorted(points, key=lambda p: (p[0][d], p[1]))
    goal, run, cut = sum(p[2] for p in points) * (leaves // 2) / leaves, 0, 0
    while run + points[cut][2] <= goal:
        run += points[cut][2]
        cut += 1
    if run + points[cut][2] - goal <= goal - run:
        cut += 1
    return plain_cuts(points[:cut], leaves // 2, first, extent) | plain_cuts(points[cut:], leaves - leaves // 2, first + leaves // 2, extent)


def test_kd_tree_matches_plain_recursion(spark):
    r = random.Random(12)
    rows = [(k, f"{k} " + "x" * r.randrange(0, 500), r.choice(["en", "de", None]), f"https://example.org/source/{r.randrange(40):03d}") for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x["__shard"] for x in sharding.kd_shards(df, dims(), n_shards=5).collect()}
    assert sorted(x["rank"] for x in sharding.value_ranks(df, "source").collect()) == list(range(1, 1 + len({x[3] for x in rows})))
    ties = {x[0]: x[1] for x in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()), 32) * 65536).collect()}
    rank = lambda j: {v: i for i, v in enumerate(sorted({x[j] for x in rows if x[j]}), 1)} | {None: 0}
    lang, source = rank(2), rank(3)
    points = [((len(t), lang[a], source[s]), ties[i], len(t) + 1) for i, t, a, s in rows]
    extent = [max(1, max(p[0][i] for p in points) - min(p[0][i] for p in points)) for i in range(3)]
    want = plain_cuts(points, 5, 0, extent)
    assert got == {row[0]: want[p[:2]] for row, p in zip(rows, points)}
    # Sources that share a long prefix are still told apart.
    where = {}
    for row in rows:
        where.setdefault(row[3], set()).add(got[row[0]])
    assert any(len(v) < 5 for v in where.values())


def test_kd_heavy_group_and_target_bytes(spark):
    rows = [(k, "hot " * 50, "en", "s") for k in range(600)] + [(1000 + k, f"cold {k} " * 10, "en", "s") for k in range(600)]
    got = sharding.kd_shards(spark.createDataFrame(rows, DOCS), dims(), n_shards=4).groupBy("__shard").agg(F.sum("__size")).collect()
    sizes = [x[1] for x in got]
    assert len(sizes) == 4 and max(sizes) < 1.1 * min(sizes)
    many = sharding.kd_shards(spark.createDataFrame(rows, DOCS), dims(), target_bytes=20_000).select("__shard").distinct().count()
    total = sum(len(x[1]) + 1 for x in rows)
    assert many == -(-total // 20_000)
    assert sharding.kd_shards(spark.createDataFrame([], DOCS), dims(), n_shards=8).count() == 0


# Licenses.


def test_license_notices_are_found_and_clean_text_is_left_alone():
    index = license_scan.Index([(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts])
    r = random.Random(4)
    noise = lambda n: " ".join("".join(r.choices("abcdeghiklmnoprstu", k=5)) for _ in range(n))
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            before = noise(40) + "\n"
            text = before + "# " + t.upper().replace(" ", "  ") + ".\n" + noise(30)
            found = license_scan.scan(index, text)
            assert name in [f[0] for f in found], (name, t)
            start, end = next((f[2], f[3]) for f in found if f[0] == name)
            got, want = (re.findall(r"\w+", x.lower()) for x in (text[start:end], t))
            assert difflib.SequenceMatcher(None, got, want, autojunk=False).ratio() > 0.9
    assert license_scan.scan(index, noise(500)) == []
    words = license_scan.TEMPLATES["MIT"][-1].split()
    for k in (7, 19, 33):
        words[k] = "changed"
    assert [f[0] for f in license_scan.scan(index, " ".join(words))] == ["MIT"]


def test_license_report(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0.", "", ""), (2, None, "", ""), (3, "", "", ""), (4, "é " * 50_000 + "Licensed under the Apache License, Version 2.0", "", ""), (4, "x", "", "")]
    got = sorted((r["doc_id"], r["licenses"], r["spans"]) for r in license_scan.license_report(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1))).collect())
    assert got == [(1, "CC-BY-NC-4.0", "CC-BY-NC-4.0:0:27"), (2, "", ""), (3, "", ""), (4, "", ""), (4, "Apache-2.0", "Apache-2.0:100000:100046")]


# Toxicity.


def kernel_plain(s, t):
    """All common subsequences of three bytes, weighed by the bytes they span."""
    total = 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                for a in range(len(t)):
                    for b in range(a + 1, len(t)):
                        for c in range(b + 1, len(t)):
                            if (s[i], s[j], s[k]) == (t[a], t[b], t[c]):
                                total += toxicity.DECAY ** (k - i + 1 + c - a + 1)
    return total


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=2, max_size=2))
@settings(max_examples=60, deadline=None)
def test_subsequence_kernel(pair):
    rows, _ = toxicity._windows([x.encode() for x in pair])
    got = toxicity.kernel(rows[:1], rows[1:])[0]
    assert got == pytest.approx(kernel_plain(*[x.encode() for x in pair]), rel=1e-9, abs=1e-12)


def toxic_corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["an", "er", "th", "on", "ti", "re", "sh", "le"], k=r.randrange(1, 4)))
    texts, labels = [], []
    for k in range(n):
        words = [word() for _ in range(r.randrange(20, 80))]
        if toxic := k % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["blockhead", "numpty", "dunce"]))
        texts.append(" ".join(words).capitalize() + ".")
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_held_out(spark):
    model = toxicity.train(*toxic_corpus(600, 1))
    texts, labels = toxic_corpus(300, 2)
    got = [int(s >= 0.5) for s, _ in toxicity.Scorer(model)(texts)]
    assert sum(a == b for a, b in zip(got, labels)) > 290
    score = lambda t: toxicity.Scorer(model)([t])[0][0]
    assert score("and the d.u.n.c.e is") > 0.5 and score("and n u m p t y is") > 0.5 and score("the blocckhead") > 0.5
    assert score(None) == score("") < 0.5
    rows = [(k, t, "", "") for k, t in enumerate([*texts, None, "", "an er " * 60_000 + "numpty"])]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)), model).collect()}
    assert [out[k] for k in range(300)] == got and (out[300], out[301], out[302]) == (0, 0, 1)
    kept = toxicity.reject_toxic(spark.createDataFrame(rows, DOCS), model)
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.count() == sum(v == 0 for v in out.values())


def test_insults_with_inserted_letters():
    """Each toxic word with a letter put in at each place: nearly all are found; clean words with one aren't."""
    model = toxicity.train(*toxic_corpus(600, 1))
    scorer = toxicity.Scorer(model)
    score = lambda t: scorer([t])[0][0]
    tried = [w[:k] + c + w[k:] for w in ("blockhead", "numpty", "dunce") for k in range(1, len(w)) for c in "xzk"]
    assert sum(score(f"and {w} is") >= 0.5 for w in tried) >= 0.9 * len(tried)
    assert score("duxnce") > 0.5 and score("du n ce") < 1 and score("nuxmpty") > 0.5
    assert all(score(w) < 0.5 for w in ("therxonan", "anxer", "tixontion"))


def test_units_with_letters_between_all_are_compared():
    """The screen loses no landmark to a letter put between all its letters."""
    model = toxicity.Model([b"blockhead", b"numpty", b"dunce"])
    for k, w in enumerate(model.landmarks):
        assert model.likeness([b"x".join(w[i : i + 1] for i in range(len(w)))])[0, k] > 0


def test_toxicity_without_labels():
    assert toxicity.Scorer(toxicity.train([], []))(["x", None])[0][0] < 0.5
    assert toxicity.train(["a b", "c d"], [1, 1]).landmarks == []


def test_labels_of_held_out_rows_are_not_learnt(spark):
    ids = list(range(200))
    docs = spark.createDataFrame([(i, f"t{i}", "", "") for i in ids], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, _ = toxicity.training_sample(docs, labels)
    assert {int(t[1:]) for t in texts} == {i for i in ids if zlib.crc32(str(i).encode()) % 5}
    assert len(toxicity.training_sample(docs, labels, max_rows=10)[0]) == 10


# TIFF.


@given(st.binary(max_size=3000))
@settings(max_examples=80, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_past_the_widest_code():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("codec", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(codec, predictor, tile):
    r = np.random.default_rng(1)
    images = [r.integers(0, 9, (h, w), dtype=np.uint8) for h, w in ((1, 1), (37, 50), (64, 33))]
    got = list(tiff.read(tiff.write([(i, codec, predictor, tile, 8) for i in images])))
    assert [(g["height"], g["width"], g["pixels"]) for g in got] == [(*i.shape, i.tobytes()) for i in images]


def test_big_endian_sixteen_bit_rgb_by_hand():
    import struct

    image = np.arange(2 * 3 * 3, dtype=">u2").reshape(2, 3, 3) * 1000
    strip = zlib.compress(np.diff(image.astype("u2"), axis=1, prepend=np.zeros((2, 1, 3), "u2")).astype(">u2").tobytes())
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, len(strip)), (317, 3, 2)]
    body = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + struct.pack(">I", 0)
    page = next(tiff.read(struct.pack(">2sHI", b"MM", 42, 8 + len(strip)) + strip + body))
    assert (page["samples"], page["bits"]) == (3, 16) and page["pixels"] == image.astype("u2").tobytes()


def by_hand(order, tags, blocks):
    """A file of one page: tags (tag, type, values), and the blocks whose places and sizes the tags 273/279 or 324/325 name."""
    import struct

    at, places = 8, []
    for b in blocks:
        places.append(at)
        at += len(b)
    names = (324, 325) if any(t == 322 for t, _, _ in tags) else (273, 279)
    tags = sorted([*tags, (names[0], 4, places), (names[1], 4, [len(b) for b in blocks])])
    at += at % 2
    body, extra, after = struct.pack(order + "H", len(tags)), b"", at + 6 + 12 * len(tags)
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, len(values), after + len(extra))
            extra += raw
        else:
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    data = b"".join(blocks)
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + data + b"\0" * (at - 8 - len(data)) + body + struct.pack(order + "I", 0) + extra


def test_forms_of_samples_by_hand():
    page = lambda *a: next(tiff.read(by_hand(*a)))["pixels"]
    size = lambda w, h, bits, n=1: [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * n), (277, 3, [n])]
    # One bit and four bits, rows at whole bytes; the same with the bits of a byte turned round.
    assert page("<", [*size(10, 2, 1), (278, 3, [2])], [b"\xa5\x40\xff\x80"]) == bytes([1, 0, 1, 0, 0, 1, 0, 1, 0, 1] + [1] * 9 + [0])
    assert page("<", [*size(10, 2, 1), (278, 3, [2]), (266, 3, [2])], [b"\xa5\x02\xff\x01"]) == bytes([1, 0, 1, 0, 0, 1, 0, 1, 0, 1] + [1] * 9 + [0])
    assert page(">", [*size(3, 1, 4), (278, 3, [1])], [b"\x1f\x70"]) == bytes([1, 15, 7])
    # Planes one after the other, two strips each, PackBits.
    blocks = [tiff.packbits_encode(bytes([p * 10 + y] * 4)) for p in range(3) for y in range(2)]
    assert page("<", [*size(4, 2, 8, 3), (278, 3, [1]), (284, 3, [2]), (259, 3, [32773])], blocks) == bytes([p * 10 + y for y in range(2) for _ in range(4) for p in range(3)])
    # Floats with their bytes apart and differenced.
    image = np.linspace(-3, 9, 12, dtype="f4").reshape(3, 4)
    apart = image.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    raw = np.diff(apart, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8).tobytes()
    assert page("<", [*size(4, 3, 32), (278, 3, [3]), (317, 3, [3]), (339, 3, [3]), (259, 3, [8])], [zlib.compress(raw)]) == image.tobytes()


def test_files_that_lie_about_their_size_give_an_error_row():
    base = [(256, 4, [4]), (257, 4, [4]), (258, 3, [8]), (277, 3, [1])]
    change = lambda **kw: [t for t in base if t[0] not in [int(k[1:]) for k in kw]] + [(int(k[1:]), 4, v) for k, v in kw.items()]
    block = bytes(16)
    for tags in (change(t256=[0], t278=[4]), change(t278=[2]), change(t322=[0], t323=[16]), change(t256=[1 << 31], t257=[1 << 31], t278=[1 << 31]), change(t277=[0], t278=[4]), change(t258=[8, 16], t278=[4]), change(t259=[7], t278=[4])):
        rows = list(tiff.page_rows([1], [by_hand("<", tags, [block])]))
        assert [r["page"] for r in rows] == [-1] and rows[0]["error"], tags
    for cut in range(0, 60):
        list(tiff.page_rows([1], [by_hand("<", [*base, (278, 4, [4])], [block])[:cut]]))


def test_tiff_pages_of_broken_and_null_files(spark):
    good = tiff.store(tiff.padded(b"hello" * 200_000))
    loop = bytearray(tiff.store(tiff.padded(b"x")))
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = loop[4:8]
    rows = [(1, good), (2, b"nope"), (3, None), (4, b""), (5, good[: len(good) // 2]), (6, bytes(loop))]
    got = tiff.pages(spark.createDataFrame(rows, "id long, media binary").withColumn("page", F.lit(1)))
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append(r)
    assert b"".join(bytes(r["pixels"]) for r in sorted(by[1], key=lambda r: r["page"])) == tiff.padded(b"hello" * 200_000)
    assert len(by[1]) == 7 and 3 not in by and all(by[k][-1]["page"] == -1 and by[k][-1]["error"] for k in (2, 4, 5, 6))


# Mixing.


def filled(sizes, weights, total, most):
    """Water-filling as told: clamp, reshare, again."""
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark):
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.randrange(0, 60)), "", r.choice(["b", "a", "c", "Z", "é", None, "tiny"])) for k in range(900)]
    rows = [x for x in rows if x[3] != "tiny"] + [(5000, "one two", "", "tiny"), (5001, None, "", "none"), (5002, "\x0b\x1c x", "", "a"), rows[0]]
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "cut": F.lit(0), "target": F.lit(0), "__whole": F.lit(7), "__target": F.lit(8), "__n": F.lit(9)})
    assert mixing.materialised(mixing.mix_sources(df)).select("__whole", "__n").distinct().collect() == [(7, 9)]
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x["__target"] == pytest.approx(want[x["source"]]) and x["__source_size"] == sizes[x["source"]] and x["__reps"] in (0, 1, 2)
        taken[x["source"]] += x["__reps"] * x["__size"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = {(x["doc_id"], x["__reps"]) for x in mixing.mix_sources(df.repartition(5)).collect()}
    assert again == {(x["doc_id"], x["__reps"]) for x in got}
    assert mixing.materialised(mixing.mix_sources(df)).count() == sum(x["__reps"] for x in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


# Lines.


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(8)
    line = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    bases = [line(n) for n in (1, 2, 6, 20, 32, 33, 60)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            x = list(r.choice(bases)) if r.random() < 0.6 else list(line(r.randrange(1, 40)))
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x))
        docs.append((d, "\n".join(lines + [""] * r.randrange(0, 2)), "", ""))
    docs += [(90, None, "", ""), (91, "", "", ""), (92, "\n\n", "", ""), (None, bases[3], "", "")]
    occurrences = {}
    for d, t, _, _ in docs:
        if d is not None and t is not None:
            for k, x in enumerate(line_dedup.normal(t)):
                if x:
                    occurrences.setdefault(x, []).append((d, k))
    lines = list(occurrences)
    sets = [{x[i : i + 7] for i in range(max(1, len(x) - 6))} for x in lines]
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    groups = {}
    for k, x in enumerate(lines):
        groups.setdefault(root(k), []).extend(occurrences[x])
    want = {o for g in groups.values() for o in g if o != min(g)}
    df = spark.createDataFrame(docs, DOCS).withColumns({"line": F.lit(1), "id": F.lit(2), "keep": F.lit(3)})
    got = {(r["doc_id"], k) for r in line_dedup.dropped_lines(df).collect() for k in r["dropped"]}
    assert got <= want and len(got) >= 0.97 * len(want) > 40
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df.withColumn("dropped", F.lit(4))).collect()}
    for d, t, _, _ in docs:
        if t is not None and d is not None:
            assert texts[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in got)
    report = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_report(df).collect()}
    assert report[90] == (0, 0) and report[92] == (3, 0)
    assert line_dedup.dedup_report(df.limit(0)).count() == 0


# Secrets.

PATTERNS = [(name, re.compile(pattern if name != "hex" else "[0-9a-f]+"), group, least) for name, pattern, group, least in secret_scan.KINDS]


def base_spans(text):
    return sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secret_spans(spark):
    live, copied = "Zx9q7LmP2vKt8RwY", "EXAMPLEKEYabcdef0123"
    rows = [
        (1, f"é token = '{live}' \U0001f600 AKIA{'A1B2C3D4E5F6G7H8'}", "", "s1"), (2, f"PASSWORD:\"{copied}\"", "", "s1"), (3, f"api_key={copied} apikey :{copied}", "", "s2"), (4, f"passwd={copied}", "", "s3"),
        (5, "token: secret:abcdefghijklmnop", "", "s1"), (6, "token=password=abcdefghijkl AKIASHORT deadbeefdeadbeef0 DEADBEEFDEADBEEF", "", "s2"), (7, None, "", None), (8, "", None, "s9"), (9, "0" * 100_000 + " secret=x", "", "s1"),
    ]
    rows.append(rows[0])
    rows += [(None, "token=nullIdHolder1234567x", "", "s1"), (None, None, "", "s1")]
    rows += [(20 + k, "secret = pastedEverywhere99xyz", f"lang{k}", "s1") for k in range(4)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"kind": F.lit(1), "hash": F.lit(2), "owner": F.lit(3), "id": F.lit(4)})
    got = secret_scan.secret_report(df, "source", F.col("lang")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert sorted(r["n_assign"] for r in got if r["doc_id"] is None) == [0, 1]
    assert all(by[20 + k]["n_copied"] == 1 and by[20 + k]["most_repos"] == 4 and by[20 + k]["most_owners"] == 1 for k in range(4))
    for d, text, _, _ in rows:
        if d is None:
            continue
        b = base_spans(text)
        assert by[d]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{z}" for a, _, z, n in b).encode()).hexdigest(), d
        assert set(f"{n}:{a}:{z}" for a, _, z, n in b) <= set(by[d]["spans"].split(","))
        assert by[d]["n_assign"] == sum(x[3] == "assign" for x in b)
    assert by[1]["n_live"] == 2 and by[2]["n_copied"] == by[4]["n_copied"] == 1 and by[3]["n_copied"] == 2
    assert secret_scan.secret_report(df.limit(0), "source", F.col("lang")).count() == 0
