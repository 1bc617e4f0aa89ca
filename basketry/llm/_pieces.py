"""A public SentencePiece vocabulary, and the automaton that finds its pieces in UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Pieces(NamedTuple):
    surface: list[bytes]  # of ordinary pieces, else empty
    score: np.ndarray
    byte: list[int]  # id of each byte's piece, or -1
    unknown: int
    size: int


class Automaton(NamedTuple):
    """Aho-Corasick: a state per prefix, transitions filled in along the failure links."""

    step: np.ndarray  # [state * letters + letter] -> state
    letter: np.ndarray  # of each byte; 0 for those in no piece
    letters: int
    piece: np.ndarray  # piece that ends in the state, or -1
    length: np.ndarray  # its bytes
    output: np.ndarray  # next state with a piece on the failure path, or 0
    depth: np.ndarray  # bytes of the state's prefix


@lru_cache(maxsize=4)
def pieces(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file; read once by each process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    surface, byte = [], [-1] * 256
    for i in range(size):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(text[3:5], 16)] = i
        special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        surface.append(b"" if special else text.encode())
    return Pieces(surface, np.array([model.get_score(i) for i in range(size)]), byte, model.unk_id(), size)


def build(surface: list[bytes]) -> Automaton:
    """The automaton of the non-empty byte strings; of equal ones the first counts."""
    used = sorted(set(b"".join(surface)))
    letter = np.zeros(256, np.int64)
    letter[used] = np.arange(1, len(used) + 1)
    letters = len(used) + 1
    children: list[dict[int, int]] = [{}]
    piece, depth = [-1], [0]
    for i, text in enumerate(surface):
        state = 0
        for b in text:
            nxt = children[state].get(b)
            if nxt is None:
                nxt = children[state][b] = len(children)
                children.append({})
                piece.append(-1)
                depth.append(depth[state] + 1)
            state = nxt
        if text and piece[state] < 0:
            piece[state] = i
    n = len(children)
    step = np.zeros((n, letters), np.int32)
    fail, output = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.array(piece) >= 0
    level = [0]
    while level:
        below = []
        for state in level:
            if state:
                step[state] = step[fail[state]]
            for b, child in children[state].items():
                back = int(step[fail[state], letter[b]]) if state else 0
                fail[child] = back
                output[child] = back if ends[back] else output[back]
                below.append(child)
            for b, child in children[state].items():
                step[state, letter[b]] = child
        level = below
    length = np.where(ends, np.array(depth), 0)
    return Automaton(step.ravel(), letter, letters, np.array(piece, np.int64), length, output, np.array(depth))


@lru_cache(maxsize=4)
def automaton(path: str = MODEL) -> Automaton:
    return build(pieces(path).surface)


_MARK = np.frombuffer(SPACE.encode(), np.uint8)


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every space as the space mark, and a mark before every row that is not empty."""
    rows = np.diff(at) > 0
    space = data == 0x20
    width = np.where(space, 3, 1)
    begin = at[:-1][rows]
    width_before = width.copy()
    width_before[begin] += 3  # the mark before the row goes in front of its first byte
    end = np.cumsum(width_before)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    first = end - width
    out[first[~space]] = data[~space]
    for k in range(3):
        out[first[space] + k] = _MARK[k]
        out[first[begin] - 3 + k] = _MARK[k]
    return out, np.concatenate([[0], end])[at] if len(end) else np.zeros(len(at), np.int64)


def units(data: np.ndarray, at: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of stretches no piece runs out of.

    A piece has marks only at its start, so a mark after another character opens a stretch; a byte
    below 128 that is in no piece is a stretch of its own.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    opens = np.zeros(n + 1, bool)
    mark = np.zeros(n + 3, bool)
    mark[:n] = data == _MARK[0]
    mark[: n - 1] &= data[1:] == _MARK[1] if n > 1 else False
    mark[: max(0, n - 2)] &= data[2:] == _MARK[2] if n > 2 else False
    mark[max(0, n - 2) :] = False
    opens[3:n] = mark[3:n] & ~mark[: n - 3]
    opens[: min(3, n)] |= mark[: min(3, n)]
    alone = np.flatnonzero((data < 128) & (letter[data] == 0))
    opens[alone] = True
    opens[alone + 1] = True
    opens[at[:-1]] = True
    start = np.flatnonzero(opens[:n])
    return start, np.append(start[1:], n), np.searchsorted(at, start, "right") - 1


def padded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte stretches as rows of a matrix, zeros behind them."""
    length = end - start
    column = np.arange(int(length.max()))
    inside = column < length[:, None]
    return np.where(inside, data[np.minimum(start[:, None] + column, len(data) - 1)], 0)


def blocks(length: np.ndarray, cells: int = 1 << 19):
    """Rows in order of falling length, cut where a block of rows as long as its first has ``cells`` bytes."""
    order = np.argsort(-length, kind="stable")
    i = 0
    while i < len(order):
        j = min(len(order), i + max(1, cells // int(length[order[i]])))
        yield order[i:j]
        i = j
