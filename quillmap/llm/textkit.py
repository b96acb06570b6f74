"""Vectorised hashing of words and shingles, shared by the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: ASCII white space: space and \x09-\x0D, as bytes.split() has it.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits for each salt."""
    with np.errstate(over="ignore"):
        h = h + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64), 7)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i mod 2**64 for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _pow = np.full(size, _R, dtype=U64)
        _inv = np.full(size, _RINV, dtype=U64)
        _pow[0] = _inv[0] = U64(1)
        _pow = np.multiply.accumulate(_pow)
        _inv = np.multiply.accumulate(_inv)
    return _pow[:n], _inv[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the unshifted polynomial hash of data[i:j]."""
    p, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def word_spans(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, maximal runs without the bytes marked in ``space``: ASCII white space."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of the text."""
    if len(text) > 4 * CHUNK:  # in pieces that end at white space, so memory doesn't follow the text's length
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            out.append(word_hashes(text[at:end]) if end - at <= 4 * CHUNK else _words(text[at:end]))
            at = end
        return np.concatenate(out)
    return _words(text)


def _words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    start, end = word_spans(data)
    return span_hashes(prefix_hash(data), start, end)


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; fewer words count as one run, none as no run."""
    if not len(words):
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    with np.errstate(over="ignore"):
        h = np.full(n, U64(w), dtype=U64)
        for i in range(w):
            h = mix(h * U64(3) + words[i : i + n], i + 1)
    return h


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, hashed in chunks of several texts."""
    out: list[np.ndarray] = [np.zeros(0, dtype=U64)] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK):
            size += len(texts[end] or b"") + 1
            end += 1
        if end == at + 1:
            out[at] = np.unique(combine(word_hashes(texts[at] or b""), width))
        else:
            part = [t or b"" for t in texts[at:end]]
            data = np.frombuffer(b"\n".join(part), dtype=np.uint8)
            start, stop = word_spans(data)
            words = span_hashes(prefix_hash(data), start, stop)
            ends = np.cumsum([len(t) + 1 for t in part])
            cuts = np.searchsorted(start, ends)
            first = 0
            whole = combine(words, width) if len(words) >= width else None
            for k, last in enumerate(cuts):
                n = last - first
                if n >= width:
                    out[at + k] = np.unique(whole[first : last - width + 1])
                elif n:
                    out[at + k] = np.unique(combine(words[first:last], width))
                first = last
        at = end
    return out
