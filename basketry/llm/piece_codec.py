"""Encode texts to pieces of a public SentencePiece vocabulary and back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from basketry.llm import _pieces
from basketry.llm._order import appended, pick
from basketry.llm._text import hashes, runs, tokens

# Longer stretches are worked on one at a time.
LONG = 512
# Bytes of text encoded and decoded at a time by the report.
REPORT_RUN = 1 << 20


def _unknown(score: np.ndarray) -> float:
    return float(score.min()) - 10


def _best_many(p: _pieces.Pieces, a: _pieces.Automaton, text: np.ndarray, length: np.ndarray):
    """Best paths of stretches in falling order of length: for each position the last piece and its bytes."""
    rows, width = text.shape
    best = np.full((width + 1, rows), -np.inf)
    best[0] = 0
    last, size = np.full((width + 1, rows), -1, np.int32), np.zeros((width + 1, rows), np.int32)
    state, begun = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    going = np.searchsorted(-length, -np.arange(1, width + 1), "right")
    tail = (text & 0xC0) == 0x80
    unknown = _unknown(p.score)
    for t in range(1, width + 1):
        n = int(going[t - 1])
        byte = text[:n, t - 1]
        state = a.step[state[:n] * a.letters + a.letter[byte]].astype(np.int64)
        begun = np.where(tail[:n, t - 1], begun[:n], t - 1)
        own = t - begun
        top, piece, took = np.full(n, -np.inf), np.full(n, -1, np.int32), np.zeros(n, np.int32)
        whole = np.zeros(n, bool)
        node = np.where(a.piece[state] >= 0, state, a.output[state])
        at = np.flatnonzero(node)
        node = node[at]
        while len(at):
            ends = a.length[node]
            whole[at[ends == own[at]]] = True
            score = best[t - ends, at] + p.score[a.piece[node]]
            more = score > top[at]
            win = at[more]
            top[win], piece[win], took[win] = score[more], a.piece[node[more]], ends[more]
            node = a.output[node]
            left = node > 0
            at, node = at[left], node[left]
        # A character that is no piece counts as unknown, once all of its bytes are read.
        closes = length[:n] == t
        if t < width:
            closes = closes | ~tail[:n, t]
        at = np.flatnonzero(closes & ~whole)
        if len(at):
            score = best[t - own[at], at] + unknown
            more = score > top[at]
            win = at[more]
            top[win], piece[win], took[win] = score[more], -1, own[win]
        best[t, :n], last[t, :n], size[t, :n] = top, piece, took
    return last, size


def _best_one(p: _pieces.Pieces, a: _pieces.Automaton, text: bytes):
    """The same for one long stretch."""
    n = len(text)
    best, last, size = [0.0] + [float("-inf")] * n, [-1] * (n + 1), [0] * (n + 1)
    state, begun, unknown = 0, 0, _unknown(p.score)
    letter = a.letter.tolist()
    for t in range(1, n + 1):
        byte = text[t - 1]
        state = int(a.step[state * a.letters + letter[byte]])
        if byte & 0xC0 != 0x80:
            begun = t - 1
        node = state if a.piece[state] >= 0 else int(a.output[state])
        whole = False
        while node:
            ends, piece = int(a.length[node]), int(a.piece[node])
            whole |= ends == t - begun
            if (score := best[t - ends] + p.score[piece]) > best[t]:
                best[t], last[t], size[t] = score, piece, ends
            node = int(a.output[node])
        if not whole and (t == n or text[t] & 0xC0 != 0x80) and (score := best[begun] + unknown) > best[t]:
            best[t], last[t], size[t] = score, -1, t - begun
    return np.array(last)[:, None], np.array(size)[:, None]


def _paths(p: _pieces.Pieces, text: np.ndarray, length: np.ndarray, last: np.ndarray, size: np.ndarray):
    """(row, ids) of the best paths; an unknown character gives its bytes' pieces."""
    row, at = np.arange(len(length)), length.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    byte = np.array(p.byte)
    while len(row):
        piece, took = last[at, row], size[at, row]
        known = piece >= 0
        found.append((row[known], at[known], piece[known].astype(np.int64)))
        if not known.all():
            r, e, w = row[~known], at[~known], took[~known]
            for k in range(int(w.max())):
                use = w > k
                place = e[use] - 1 - k
                ids = byte[text[r[use], place]]
                found.append((r[use], place + 1, np.where(ids >= 0, ids, p.unknown)))
        at = at - took
        row, at = row[at > 0], at[at > 0]
    row, at, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, row))
    return row[order], ids[order]


def encode_run(data: np.ndarray, at: np.ndarray, model: str = _pieces.MODEL) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the rows of a run of texts."""
    p, a = _pieces.pieces(model), _pieces.automaton(model)
    text, at = _pieces.normalised(data, at)
    start, end, row = _pieces.units(text, at, a.letter)
    if not len(start):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    sums = tokens(text, np.array([0, len(text)]), lower=False).sums
    _, first, which = np.unique(hashes(sums, start, end), return_index=True, return_inverse=True)
    begin, stop = start[first], end[first]
    length = stop - begin
    owners, ids = [], []
    long = np.flatnonzero(length > LONG)
    for u in long:
        one = text[begin[u] : stop[u]]
        r, i = _paths(p, one[None], length[[u]], *_best_one(p, a, one.tobytes()))
        owners.append(np.full(len(r), u))
        ids.append(i)
    short = np.flatnonzero(length <= LONG)
    for block in _pieces.blocks(length[short]):
        u = short[block]
        rows = _pieces.padded(text, begin[u], stop[u])
        r, i = _paths(p, rows, length[u], *_best_many(p, a, rows, length[u]))
        owners.append(u[r])
        ids.append(i)
    owner, all_ids = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    all_ids = all_ids[order]
    count = np.bincount(owner, minlength=len(first))
    head = np.cumsum(count) - count
    each = count[which]
    total = np.concatenate([[0], np.cumsum(each)])
    flat = all_ids[np.repeat(head[which] - total[:-1], each) + np.arange(total[-1])]
    return flat, total[np.searchsorted(row, np.arange(len(at)))]


@lru_cache(maxsize=4)
def _surfaces(model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that the pieces stand for, end to end, and each one's place and length; specials have none."""
    p = _pieces.pieces(model)
    table = [s.replace(_pieces.SPACE.encode(), b" ") for s in p.surface]
    for b, i in enumerate(p.byte):
        if i >= 0:
            table[i] = bytes([b])
    length = np.array([len(s) for s in table] + [0])
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length, length


def decode_run(ids: np.ndarray, offsets: np.ndarray, model: str = _pieces.MODEL) -> list[str]:
    """Texts of runs of ids: marks are spaces, the first space goes, byte pieces are bytes, specials nothing."""
    flat, head, length = _surfaces(model)
    ids = np.where((ids >= 0) & (ids < len(length) - 1), ids, len(length) - 1)
    each = length[ids]
    total = np.concatenate([[0], np.cumsum(each)])
    out = flat[np.repeat(head[ids] - total[:-1], each) + np.arange(total[-1])].tobytes()
    cuts = total[offsets]
    return [out[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode(docs: DataFrame, model: str = _pieces.MODEL) -> DataFrame:
    """``docs`` with the ids of each text in ``__ids`` (array<int>); null and empty texts have none.

    Spaces become marks and a mark goes before the text. Of all ways to cut it into pieces, the one
    with the greatest sum of the pieces' scores is taken; among equal ones, from the end, the one
    with the longest last piece. A character that is no piece has a score below all and becomes
    its bytes. Every row is encoded on its own, whatever its length, and all other columns pass.

    The automaton reads each byte once and follows output links to the pieces that end there. All
    distinct stretches of a run of texts, cut where no piece can cross, advance a byte at a time.
    ``model`` is a path that exists on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in runs(batch.column("text")):
                ids, offsets = encode_run(data, at, model)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "__ids"])

    return appended(docs, run, "__ids array<int>", "text")


def decode(docs: DataFrame, model: str = _pieces.MODEL) -> DataFrame:
    """``docs`` with the text of ``__ids`` in ``__decoded``; null ids are no ids, ids outside the vocabulary nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__ids").fill_null([])
            flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            texts = decode_run(flat, np.asarray(lists.offsets), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "__decoded"])

    return appended(docs, run, "__decoded string", "__ids")


def codec_report(docs: DataFrame, model: str = _pieces.MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_hash, round_trip): whether decoding gives the text, in which a mark reads as a space.

    Encodes and decodes in one task, so that the ids, several times the size of the texts, stay in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in runs(batch.column(1), REPORT_RUN):
                ids, offsets = encode_run(data, at, model)
                texts = (data[a:b].tobytes().replace(_pieces.SPACE.encode(), b" ").decode() for a, b in zip(at[:-1], at[1:]))
                same = [x == y for x, y in zip(texts, decode_run(ids, offsets, model))]
                packed = ids.astype("<i4").tobytes()
                digest = [xxhash.xxh3_64_intdigest(packed[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_hash", "round_trip"],
                )

    docs = pick(docs, "doc_id", "text")
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_hash long, round_trip boolean"
    return docs.mapInArrow(run, fields)
