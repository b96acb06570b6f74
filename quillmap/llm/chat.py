"""Chat formatting at token level: segments are encoded apart, reserved ids spliced in between, masks by prefix sums.

The written form of a conversation is ``<s>`` and, a turn at a time, ``[user]text</s>`` (or [assistant], [system]; any
other role: ``[role]name[/role]text</s>``), each control string one reserved id past the vocabulary. Control strings in a
text get a backslash behind their first character, strings that look so escaped get one more, so texts come back exactly
and never hold a control string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The folder of the public vocabularies; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Control strings; the i-th has the id vocabulary size + i.
CONTROLS = ("<s>", "</s>", "[user]", "[assistant]", "[system]", "[role]", "[/role]")
BOS, EOT, USER, ASSISTANT, SYSTEM, ROLE, ROLE_END = range(len(CONTROLS))
ROLES = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
#: Other families' control strings, escaped alike so that no text can pose as a template.
FOREIGN = ("[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_names = "|".join(re.escape(c[1:]) for c in CONTROLS + FOREIGN)
_plain = re.compile(rf"([<\[])(\\*)(?={_names})")
_escaped = re.compile(rf"([<\[])\\(\\*)(?={_names})")
#: Tokens of one output row; a longer conversation goes on in the next.
CHUNK = 1 << 17
TURN = "conv_id long, turn long, role string, tokens array<int>, marks array<int>"
OUT = "conv_id long, chunk int, last boolean, tokens array<int>, loss_mask array<byte>"


def escape(text: str) -> str:
    return _plain.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2", text)


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode_turns(path: str):
    """Each turn by itself, in any partition: its tokens, and +1 / -1 marks where its loss begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        v = len(enc._mergeable_ranks)
        for batch in batches:
            tokens, marks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                role, body = role or "", enc.encode_ordinary(escape(text or ""))
                head = [v + ROLES[role]] if role in ROLES else [v + ROLE, *enc.encode_ordinary(escape(role)), v + ROLE_END]
                tokens.append([*head, *body, v + EOT])
                delta = [0] * len(tokens[-1])
                if role == "assistant" and body:
                    delta[1], delta[-1] = 1, -1
                marks.append(delta)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(tokens, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))], ["conv_id", "turn", "role", "tokens", "marks"])

    return run


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int8()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "chunk", "last", "tokens", "loss_mask"])


def _assemble(path: str):
    """Turns in order, a conversation at a time; holds one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(encoder(path)._mergeable_ranks)
        conv, began, chunk, level, held, tokens, marks = None, False, 0, 0, 0, [], []

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal chunk, level, held, tokens, marks
            mask = level + np.cumsum(np.concatenate(marks))
            level = int(mask[-1])
            out = _rows([(conv, chunk, last, np.concatenate(tokens).astype(np.int32), mask.astype(np.int8))])
            chunk, held, tokens, marks = chunk + 1, 0, [], []
            return out

        for batch in batches:
            ids, toks, deltas = batch.column("conv_id").to_pylist(), batch.column("tokens"), batch.column("marks")
            for i, c in enumerate(ids):
                if not began or c != conv:
                    if began:
                        yield cut(True)
                    conv, began, chunk, level = c, True, 0, 0
                    tokens, marks = [np.array([v + BOS])], [np.array([0])]
                elif held > CHUNK:
                    yield cut(False)
                tokens.append(toks[i].values.to_numpy())
                held += len(tokens[-1])
                marks.append(deltas[i].values.to_numpy())
        if began:
            yield cut(True)

    return run


def _text(enc, ids: np.ndarray) -> str:
    return enc.decode_bytes(ids.tolist()).decode("utf-8")


def _read_back(path: str):
    """What the tokens say: digests by conversation, of chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        v = len(enc._mergeable_ranks)
        turns = loss = None
        for batch in batches:
            out = []
            for conv, chunk, last, tokens, mask in zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), batch.column("tokens"), batch.column("loss_mask")):
                ids, on = tokens.values.to_numpy(), mask.values.to_numpy()
                if chunk == 0:
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = n_tokens = n_loss = 0
                n_tokens, n_loss = n_tokens + len(ids), n_loss + int(on.sum())
                at = np.flatnonzero(ids >= v)
                segments = [(int(ids[a]) - v, a + 1, b) for a, b in zip(at, [*at[1:], len(ids)])]
                role = ""
                for kind, a, b in segments:
                    written = _text(enc, ids[a:b])
                    chars += len(CONTROLS[kind]) + len(written)
                    if kind == ROLE:
                        role = unescape(written)
                    elif kind in (USER, ASSISTANT, SYSTEM, ROLE_END):
                        role = CONTROLS[kind][1:-1] if kind != ROLE_END else role
                        plain = unescape(written)
                        turns.update(f"{role}\n{plain}\n".encode())
                        n += 1
                    under = on[a:b].astype(bool)
                    if under.any():
                        got = unescape(_text(enc, ids[a:b][under]))
                        loss_chars += len(got)
                        loss.update(got.encode())
                if last:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_tokens, n_loss))
            cols = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"])

    return run


def format_chats(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(conv_id, chunk, last, tokens, loss_mask): the token ids of each conversation and which of them carry loss.

    Turns go by number, then role, then tokens; null numbers first. Null texts and roles are empty, so is the text of a
    turn without tokens. Rows with a null conv_id are one conversation. A repeated row is a turn of its own. Other
    columns aren't read; an empty table gives no rows. Long conversations come in chunks of whole turns.
    """
    turns = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").mapInArrow(_encode_turns(path), TURN)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tokens")
    return ordered.mapInArrow(_assemble(path), OUT)


def read_back(formatted: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Digests of what ``format_chats`` gave, decoded from its tokens; chunks of a conversation must be in order, as it gives them."""
    return formatted.mapInArrow(_read_back(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
