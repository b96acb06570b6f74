"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

A text is cut into sentences and these into units: words in lower case without digits and punctuation (so gaps of dots or
dashes close), and runs of three and more single letters as one unit (so ``i d i o t`` is one). The kernel of two units is
the gap-weighted subsequence kernel (Lodhi et al., 2002) of subsequences of three bytes, normalised; inserted letters
lower it, they don't end it. Only units that have most of a landmark's letters in order are compared with it. Landmarks are units that stand out in toxic documents, and the commonest clean units that are
like them. A unit's kernel values with the landmarks are mapped by the inverse square root of the landmarks' own kernel
matrix (Nyström) and scored by a linear machine. It is trained on labelled sentences: a sentence is as toxic as its
worst unit, all units of clean documents are clean, and of toxic ones, whose label doesn't say what earned it, the units
that stand out are taken as toxic, in their own spelling and in such as put letters into them. A logistic curve fitted to the documents makes
the score of a document's worst unit a probability; the whole text is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import worker_store

#: Letters in a subsequence, and the decay for each letter it spans.
LETTERS, DECAY = 3, 0.7
#: Kernel values below this count as no likeness.
LEAST = 0.1
#: Units whose greatest value is less are left out of the training: the machine can't tell them from what is like nothing.
MUCH = 0.25
#: A unit is compared with a landmark if it has this part of the landmark's neighbouring letters in order, up to GAP apart:
#: up to GAP - 1 letters between each two neighbours lose none of them.
SCREEN, GAP = 0.6, 3
#: Letters from which a word is also learnt in spellings that hide it, and what each kind of them counts next to the word.
STRETCH, HIDDEN = 4, 2.0
#: Units are compared in windows of so many bytes, half of them shared.
WINDOW = 24
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 128, 64
#: The part of the documents with a unit that must be toxic for it to be a toxic landmark.
PURE = 0.75
#: Bounds of the training sample: labelled rows, those with the least hash of their id, and bytes of a text.
MAX_LABELLED, MAX_TEXT = 6_000, 1 << 16
#: Units that a worker remembers.
MEMORY = 100_000
_drop = bytes(c for c in range(128) if not (97 <= c <= 122 or 65 <= c <= 90 or c in (9, 10, 11, 12, 13, 32)))
_sentence_end = re.compile(rb"[.!?]+\s+|\n+")
_lone = re.compile(rb"(?<![^\s])(?:[a-z]\s+){2,}[a-z](?![^\s])")


def sentences(text: str) -> list[bytes]:
    return [x for x in _sentence_end.split(text.lower().encode()) if x]


def units(raw: bytes) -> list[bytes]:
    """The units of a lower-case sentence or a whole text."""
    data = raw.translate(None, _drop)
    return data.split() + [b"".join(m.group().split()) for m in _lone.finditer(data)]


def _windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes of the words' windows, and the word of each window."""
    rows, owner = [], []
    for k, w in enumerate(words):
        for at in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2):
            rows.append(w[at : at + WINDOW])
            owner.append(k)
    data = np.array(rows, dtype=f"S{WINDOW}").view(np.uint8).reshape(len(rows), WINDOW)
    return data, np.array(owner, dtype=np.int64)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each padded row of ``a`` with the same row of ``b``, not normalised."""
    wa, wb = (max(1, int((x > 0).sum(axis=1).max(initial=1))) for x in (a, b))
    # inner[i, j]: weight of the shorter subsequences that a's first i and b's first j bytes share.
    inner = np.ones((wa + 1, wb + 1, len(a)))
    match = np.ascontiguousarray(((a[:, :wa, None] == b[:, None, :wb]) & (a[:, :wa, None] > 0)).transpose(1, 2, 0)) * (DECAY * DECAY)
    for _ in range(1, LETTERS):
        following = np.zeros_like(inner)
        for i in range(wa):
            hit = match[i] * inner[i, :wb]
            run = np.zeros(len(a))
            for j in range(wb):
                run = DECAY * run + hit[j]
                following[i + 1, j + 1] = DECAY * following[i, j + 1] + run
        inner = following
    return (match * inner[:wa, :wb]).sum(axis=(0, 1))


def _pairs(data: np.ndarray, gap: int = 1) -> np.ndarray:
    """Bytes ``gap`` places apart as numbers, 0 past the end."""
    x = data.astype(np.int64)
    return np.where(x[:, gap:] > 0, x[:, :-gap] * 256 + x[:, gap:], 0)


def stretched(word: bytes) -> list[list[bytes]]:
    """Spellings that hide a word: a letter put in at each place, or doubled; letters after every other one; after each."""
    one = [word[:k] + c + word[k:] for k in range(1, len(word)) for c in (b"x", b"o", word[k - 1 : k])]
    return [one, *([c.join(word[k : k + n] for k in range(0, len(word), n)) for c in (b"x", b"q", b"o", b"z")] for n in (2, 1))]


@dataclass
class Model:
    landmarks: list[bytes] = field(default_factory=list)
    #: Weights of the kernel values: the machine's, after the Nyström map.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    slope: float = 1.0
    shift: float = -2.0

    def __post_init__(self):
        """Landmarks as rows, their norms, and the table of byte pairs that screens units."""
        if not self.landmarks:
            return
        self.rows, _ = _windows(self.landmarks)
        self.norms = kernel(self.rows, self.rows)
        pairs = _pairs(self.rows)
        known = np.unique(pairs[pairs > 0])
        self.place = np.zeros(1 << 16, dtype=np.int64)
        self.place[known] = np.arange(len(known)) + 1
        self.need = np.zeros((len(known) + 1, len(self.landmarks)), dtype=np.float32)
        for k, row in enumerate(pairs):
            self.need[self.place[row[row > 0]], k] = 1
        self.least = np.maximum(1, np.ceil(SCREEN * self.need.sum(axis=0)))

    def likeness(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernel values of each word with each landmark, 0 where below LEAST; the best window of a long word."""
        out = np.zeros((len(words), len(self.landmarks)))
        if not words or not self.landmarks:
            return out
        data, owner = _windows(words)
        has = np.zeros((len(data), len(self.need)), dtype=np.float32)
        for gap in range(1, GAP + 1):
            has[np.arange(len(data))[:, None], self.place[_pairs(data, gap)]] = 1
        has[:, 0] = 0
        row, mark = np.nonzero(has @ self.need >= self.least)
        if len(row):
            some, back = np.unique(row, return_inverse=True)
            own = np.concatenate([kernel(data[some[k : k + 1024]], data[some[k : k + 1024]]) for k in range(0, len(some), 1024)])[back]
            value = np.concatenate([kernel(data[row[k : k + 1024]], self.rows[mark[k : k + 1024]]) for k in range(0, len(row), 1024)])
            value /= np.sqrt(np.maximum(own, 1e-300) * self.norms[mark])
            np.maximum.at(out, (owner[row], mark), np.where((own > 0) & (value >= LEAST), value, 0.0))
        return out

    def alike(self, words: list[bytes], block: int = 2_000) -> tuple[list[bytes], np.ndarray]:
        """The words that are much like some landmark, and their kernel values; in blocks, so memory follows what is found."""
        kept, rows = [], [np.zeros((0, len(self.landmarks)), dtype=np.float32)]
        for at in range(0, len(words), block):
            part = words[at : at + block]
            like = self.likeness(part).astype(np.float32)
            on = np.flatnonzero(like.max(axis=1) >= MUCH)
            kept += [part[k] for k in on]
            rows.append(like[on])
        return kept, np.concatenate(rows)

    def closest(self, words: list[bytes], block: int = 2_000) -> tuple[list[bytes], list[float]]:
        """The words that are like some landmark, and the greatest of their kernel values."""
        kept, best = [], []
        for at in range(0, len(words), block):
            top = self.likeness(words[at : at + block]).max(axis=1)
            on = np.flatnonzero(top)
            kept += [words[at + k] for k in on]
            best += top[on].tolist()
        return kept, best

    def margin(self, like: np.ndarray) -> np.ndarray:
        return like @ self.weights + self.bias if len(self.landmarks) else np.full(len(like), self.bias)

    def probability(self, margin):
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


def _tail(n: int, k: int, p: float) -> float:
    """P(at least k of n) for a binomial of p."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def _holders(docs: list[list[bytes]]) -> tuple[Counter, int]:
    """How many documents hold each unit, and how many there are; sentences met before don't count, so copies add nothing."""
    seen: set[bytes] = set()
    count: Counter = Counter()
    n = 0
    for d in docs:
        new = {s for s in d if s not in seen}
        seen |= new
        count.update({u for s in new for u in units(s) if len(u) >= LETTERS})
        n += bool(new)
    return count, n


def choose_landmarks(a: Counter, na: int, b: Counter, nb: int) -> list[bytes]:
    """Units that more toxic documents hold than chance allows, and hardly any clean one; the clearest first."""
    if not na or not nb:
        return []
    p = na / (na + nb)
    tested = [u for u in a if a[u] >= 3 and len(u) <= WINDOW and a[u] >= PURE * (a[u] + b[u])]
    tails = {u: _tail(a[u] + b[u], a[u], p) for u in tested}
    good = [u for u in tested if tails[u] * len(tested) < 0.05]
    return sorted(good, key=lambda u: (tails[u], -a[u], u))[:TOXIC_LANDMARKS]


def _svm(z: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0, block: int = 4096) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss by primal Newton steps (Chapelle, 2007); the last column is 1, for the bias; c: cost of each row.

    The system is summed up by blocks of rows, so that memory is that of ``z``.
    """
    w = np.zeros(z.shape[1])

    def margins(w: np.ndarray) -> np.ndarray:
        return np.concatenate([z[at : at + block] @ w for at in range(0, len(z), block)])

    def loss(w: np.ndarray) -> float:
        return ridge * w @ w / 2 + float((c * np.maximum(0, 1 - y * margins(w)) ** 2).sum())

    now = loss(w)
    for _ in range(60):
        on = np.flatnonzero(y * margins(w) < 1)
        hess, right = ridge * np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(on), block):
            k = on[at : at + block]
            rows = z[k].astype(float)
            zc = rows * (2 * c[k])[:, None]
            hess += zc.T @ rows
            right += zc.T @ y[k]
        step = np.linalg.solve(hess, right) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) >= now:
            size /= 2
        new = loss(w + size * step)
        if new >= now * (1 - 1e-9):
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def train(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled documents. Without toxic ones, or none that stand out, it finds nothing toxic."""
    cut = [sentences(t) for t in texts]
    toxic = [s for s, y in zip(cut, labels) if y]
    clean = [s for s, y in zip(cut, labels) if not y]
    (a, na), (b, nb) = _holders(toxic), _holders(clean)
    bad = choose_landmarks(a, na, b, nb)
    if not bad:
        return Model()
    near, close = Model(bad).closest(sorted(b))
    close = dict(zip(near, close))
    model = Model(bad + sorted(near, key=lambda u: (-b[u] * close[u] ** 10, u))[:CLEAN_LANDMARKS])
    n = len(model.landmarks)
    gram = np.stack([kernel(model.rows, np.repeat(r[None, :], n, axis=0)) for r in model.rows]) / np.sqrt(model.norms[:, None] * model.norms[None, :])
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    vocabulary, like = model.alike(sorted(set(b).union(*(units(s) for d in toxic for s in d))))
    row = {u: k for k, u in enumerate(vocabulary)}
    bags = [sorted({row[u] for s in d for u in units(s) if u in row}) for d in toxic]
    clean_rows = np.array(sorted(row[u] for u in b if u in row), dtype=np.int64)
    cost = np.array([b[vocabulary[k]] for k in clean_rows], dtype=float)
    zero = np.zeros((1, n))
    marks = {row[u] for u in bad if u in row}
    witness = Counter(k for bag in bags for k in bag if k in marks)
    rows = np.array(sorted(witness), dtype=np.int64)
    # Spellings that hide a word count as much as the word, shared among them; those that clean documents hold are left out.
    hidden = [(s, HIDDEN * min(witness[k], 100) / len(kind)) for k in rows if len(vocabulary[k]) >= STRETCH for kind in stretched(vocabulary[k]) for s in kind if s not in b]
    spelt = model.likeness([s for s, _ in hidden])
    z = np.ones((len(rows) + len(spelt) + len(clean_rows) + 1, n + 1), dtype=np.float32)
    at = 0
    for part in (like[rows], spelt.astype(np.float32), *(like[clean_rows[k : k + 4096]] for k in range(0, len(clean_rows), 4096)), zero.astype(np.float32)):
        z[at : at + len(part), :n] = part @ whiten
        at += len(part)
    y = np.concatenate([np.ones(len(rows) + len(spelt)), -np.ones(len(clean_rows) + 1)])
    w, model.bias = _svm(z, y, np.concatenate([[min(witness[k], 100) for k in rows], [c for _, c in hidden], np.minimum(cost, 100), [100]]))
    model.weights = whiten @ w
    # The logistic curve is fitted to what documents score, by Newton's method, with Platt's targets.
    score = model.margin(like)
    f = [max([model.bias, *(score[k] for k in bag)]) for bag in bags] + [max([model.bias, *(score[row[u]] for s in d for u in units(s) if u in row)]) for d in clean]
    y = np.concatenate([np.ones(len(bags)), np.zeros(len(clean))])
    goal = np.where(y > 0, (len(bags) + 1) / (len(bags) + 2), 1 / (len(clean) + 2))
    theta = np.array([1.0, 0.0])
    design = np.stack([np.array(f), np.ones(len(f))], axis=1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-design @ theta))
        hess = design.T @ (design * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, design.T @ (q - goal) + 1e-3 * (theta - [1, 0])), -1, 1)
    model.slope, model.shift = max(float(theta[0]), 0.1), float(theta[1])
    return model


class Scorer:
    """Scores texts; remembers the margins of units, and which are like no landmark."""

    def __init__(self, model: Model):
        self.model, self.none, self.margins = model, set(), {}

    def __call__(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """(score, number of units beyond the machine's margin) of each text."""
        bags = [set(units((t or "").lower().encode())) for t in texts]
        new = sorted(set().union(*bags) - self.none - self.margins.keys())
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            like = self.model.likeness(part)
            on = like.any(axis=1)
            self.margins |= {u: float(m) for u, m, x in zip(part, self.model.margin(like), on) if x}
            self.none |= {u for u, x in zip(part, on) if not x}
        out = []
        for bag in bags:
            found = [self.margins[u] for u in bag if u in self.margins]
            out.append((float(self.model.probability(max([self.model.bias, *found]))), sum(m > 0 for m in found)))
        if len(self.none) + len(self.margins) > MEMORY:
            self.none, self.margins = set(), {}
        return out


#: The scorer of the model that a worker has met last; the tasks of one worker share what it remembers.
_scorers: dict[int, Scorer] = worker_store()


def _scorer(shared) -> Scorer:
    model = shared.value  # one object for each broadcast and worker
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    return _scorers[id(model)]


def learnable(id_col: Column) -> Column:
    """Rows that labels may be learnt from: crc32(id as text) mod 5 is not 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, max_text: int = MAX_TEXT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_rows`` learnable rows, those with the least hash of their id and up to ``max_text`` bytes. An id that some label calls toxic is toxic."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    ids = ids.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= max_text).join(F.broadcast(ids), "__id").select("__id", "__text", "__y")
    got = sorted({(r[0], r[1], r[2]) for r in rows.collect()})
    return [r[1] for r in got], [r[2] for r in got]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_units) for each row; only the text is looked at. Null and empty texts score as clean."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = scorer(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int32())], ["doc_id", "score", "predicted", "n_units"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_units int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keep = [s < 0.5 for s, _ in scorer(batch.column(text_col).cast(pa.string()).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
