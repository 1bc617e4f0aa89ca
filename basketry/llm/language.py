"""Language identification by unigram piece models, summed over all ways to cut a word into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import _pieces
from basketry.llm._order import appended, pick
from basketry.llm._text import LOWER, crc_bucket, hashes, runs, tokens
from basketry.session import materialize

# Learning uses about this many documents of each language, drawn by a hash of the id.
PER_LANGUAGE = 2000
ROUNDS = 3
# Learning cuts a stretch without spaces after so many bytes (at a character); scores sum over whole ones.
LONGEST = 32
# Probability of a character that is no piece, the same in all languages; pseudo-count of a piece.
UNKNOWN, PSEUDO = 1e-9, 0.02
# Values grow by this factor per byte, so that products over LONGEST bytes stay in range; sums are
# scaled anew after so many.
GROWTH, SCALED = 4.0, 16
UNDECIDED = "und"


def parts(data: np.ndarray, at: np.ndarray, letter: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased, marked bytes of the rows, and (start, end, row) of their stretches, cut if ``longest`` is given."""
    text, at = _pieces.normalised(LOWER[data], at)
    start, end, row = _pieces.units(text, at, letter)
    if longest and len(start) and int((end - start).max()) > longest:
        # Cuts every longest - 3 bytes, moved on to where a character starts.
        cuts, step = [], longest - 3
        for s, e in zip(start[end - start > longest], end[end - start > longest]):
            at_cut = np.arange(s + step, e, step)
            for _ in range(3):
                at_cut = at_cut + ((text[np.minimum(at_cut, len(text) - 1)] & 0xC0) == 0x80)
            cuts.append(at_cut[at_cut < e])
        start = np.union1d(start, np.concatenate(cuts))
        end = np.append(start[1:], len(text))
        row = np.searchsorted(at, start, "right") - 1
    return text, start, end, row


def _walk(a: _pieces.Automaton, text: np.ndarray, length: np.ndarray):
    """For each position: (t, stretches, bytes, pieces) of all pieces that end there; piece -1 is an unknown character."""
    rows, width = text.shape
    state, begun = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    going = np.searchsorted(-length, -np.arange(1, width + 1), "right")
    tail = (text & 0xC0) == 0x80
    for t in range(1, width + 1):
        n = int(going[t - 1])
        state = a.step[state[:n] * a.letters + a.letter[text[:n, t - 1]]].astype(np.int64)
        begun = np.where(tail[:n, t - 1], begun[:n], t - 1)
        whole = np.zeros(n, bool)
        node = np.where(a.piece[state] >= 0, state, a.output[state])
        at = np.flatnonzero(node)
        node = node[at]
        while len(at):
            ends = a.length[node]
            whole[at[ends == t - begun[at]]] = True
            yield t, at, ends, a.piece[node]
            node = a.output[node]
            left = node > 0
            at, node = at[left], node[left]
        closes = length[:n] == t
        if t < width:
            closes = closes | ~tail[:n, t]
        at = np.flatnonzero(closes & ~whole)
        if len(at):
            yield t, at, t - begun[at], np.full(len(at), -1)


def log_likelihood(a: _pieces.Automaton, grown: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log probability of each stretch in each language: the forward sum over all its segmentations.

    ``grown`` has a row per piece, and a last one for unknown characters, of probabilities times
    GROWTH to the piece's bytes (an unknown character counts one byte here, the rest below). Rows
    are in order of falling length. Only the sums that a piece can still reach back to are held;
    they are scaled to their greatest every few bytes, so a stretch may have any length.
    """
    rows, width = text.shape
    slots = max(4, int(a.length.max())) + 1
    forward = np.zeros((slots, rows, grown.shape[1]))
    forward[0] = 1
    scale, out = np.zeros((rows, grown.shape[1])), np.empty((rows, grown.shape[1]))
    done, left = 0, rows  # positions worked off, rows not yet at their end

    def advance(t: int) -> None:
        nonlocal done, left
        while done < t:
            going = int(np.searchsorted(-length[:left], -done - 1, "right"))
            if going < left:
                out[going:left] = np.log(forward[done % slots, going:left]) + scale[going:left]
                left = going
            done += 1
            if done % SCALED == 0 and left:
                top = forward[:, :left].max(axis=0)
                forward[:, :left] /= top
                scale[:left] += np.log(top)
            forward[done % slots] = 0

    for t, at, ends, piece in _walk(a, text, length):
        advance(t)
        came = forward[(t - ends) % slots, at] * grown[piece]
        if piece[0] < 0:
            came *= GROWTH ** (ends - 1)[:, None]
        forward[t % slots, at] += came
    advance(width + 1)
    return out - (length * np.log(GROWTH))[:, None]


def expected(a: _pieces.Automaton, grown: np.ndarray, text: np.ndarray, length: np.ndarray, language: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` (pieces x languages) how often each piece is expected in the stretches, by forward and backward sums."""
    rows, width = text.shape
    forward, steps = np.zeros((width + 1, rows)), []
    forward[0] = 1
    for t, at, ends, piece in _walk(a, text, length):
        value = grown[piece, language[at]]
        if piece[0] < 0:
            value = value * GROWTH ** (ends - 1)
        forward[t, at] += forward[t - ends, at] * value
        steps.append((t, at, ends, piece, value))
    total = forward[length, np.arange(rows)]
    backward = np.zeros((width + 1, rows))
    backward[length, np.arange(rows)] = 1
    for t, at, ends, piece, value in reversed(steps):
        through = backward[t, at] * value
        if piece[0] >= 0:
            np.add.at(out, (piece, language[at]), weight[at] * forward[t - ends, at] * through / total[at])
        backward[t - ends, at] += through


def _count_parts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _pieces.automaton(model)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, at in runs(batch.column(1)):
                text, start, end, row = parts(data, at, a.letter, LONGEST)
                if not len(start):
                    continue
                known = sorted(set(names[i:j]))
                language = np.array([known.index(x) for x in names[i:j]])[row]
                sums = tokens(text, np.array([0, len(text)]), lower=False).sums
                code = hashes(sums, start, end)
                order = np.lexsort((code, language))
                new = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (language[order][1:] != language[order][:-1])])
                first = order[new]
                count = np.diff(np.append(np.flatnonzero(new), len(order)))
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([known[k] for k in language[first]]), pa.array([raw[s:e] for s, e in zip(start[first], end[first])], pa.binary()), pa.array(count)],
                    ["lang", "part", "n"],
                )

    return run


def grown_table(probabilities: np.ndarray, p: _pieces.Pieces) -> np.ndarray:
    length = np.array([len(s) for s in p.surface])
    return np.vstack([probabilities * GROWTH ** length[:, None], np.full((1, probabilities.shape[1]), UNKNOWN * GROWTH)])


def _expect(model: str, languages: list[str], probabilities: np.ndarray):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, a = _pieces.pieces(model), _pieces.automaton(model)
        grown, out = grown_table(probabilities, p), np.zeros(probabilities.shape)
        for batch in batches:
            language = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            weight = np.asarray(batch.column(2)).astype(float)
            packed = batch.column(1).to_pylist()
            if not packed:
                continue
            data, length = np.frombuffer(b"".join(packed), np.uint8), np.array([len(x) for x in packed])
            end = np.cumsum(length)
            for block in _pieces.blocks(length):
                rows = _pieces.padded(data, (end - length)[block], end[block])
                expected(a, grown, rows, length[block], language[block], weight[block], out)
        piece, language = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(out[piece, language])], ["piece", "lang", "n"])

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, model: str = _pieces.MODEL) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and the pieces' probabilities in each, from (doc_id, text, lang).

    About ``per_language`` documents of each language, those whose hashed id is below a threshold,
    give counts of their stretches. Expectation maximisation starts from equal probabilities; each
    round returns one number per piece and language.
    """
    held = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in held.groupBy("lang").count().collect()}
    p = _pieces.pieces(model)
    usable = np.array([len(s) > 0 for s in p.surface])
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((p.size, 0))
    # The languages are few (a column of the model each), so that rows are drawn without a join.
    share = F.create_map(*(F.lit(v) for x, n in counts.items() for v in (x, min(1.0, per_language / n))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = held.where(place < share[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(_count_parts(model), "lang string, part binary, n long")
    table = materialize(counted.groupBy("lang", "part").agg(F.sum("n").alias("n")), "parts")
    probabilities = np.where(usable, 1 / usable.sum(), 0.0)[:, None].repeat(len(languages), axis=1)
    for _ in range(rounds):
        found = table.mapInArrow(_expect(model, languages, probabilities), "piece long, lang long, n double")
        total = np.zeros_like(probabilities)
        for r in found.groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            total[r.piece, r.lang] = r.n
        total[usable] += PSEUDO
        probabilities = total / total.sum(axis=0)
    return languages, probabilities


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter: an ASCII one is seen at once, other texts are looked through."""
    upper = LOWER[data]
    ascii_before = np.concatenate([[0], np.cumsum((upper >= 97) & (upper <= 122))])
    other_before = np.concatenate([[0], np.cumsum(data >= 128)])
    out = ascii_before[at[1:]] > ascii_before[at[:-1]]
    for i in np.flatnonzero(~out & (other_before[at[1:]] > other_before[at[:-1]])):
        out[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
    return out


def _score(model: str, languages: list[str], table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, a = _pieces.pieces(model), _pieces.automaton(model)
        grown = grown_table(table.value, p)
        names = np.array([*languages, UNDECIDED], object)
        for batch in batches:
            for i, j, data, at in runs(batch.column("text")):
                n = j - i
                sums = np.zeros((n, len(languages)))
                text, start, end, row = parts(data, at, a.letter)
                if len(start) and languages:
                    running = tokens(text, np.array([0, len(text)]), lower=False).sums
                    _, first, which = np.unique(hashes(running, start, end), return_index=True, return_inverse=True)
                    begin, length = start[first], (end - start)[first]
                    value = np.empty((len(first), len(languages)))
                    for block in _pieces.blocks(length, 1 << 18):
                        value[block] = log_likelihood(a, grown, _pieces.padded(text, begin[block], begin[block] + length[block]), length[block])
                    for k in range(len(languages)):
                        sums[:, k] = np.bincount(row, value[which, k], n)
                use = has_letter(data, at) & bool(languages)
                best, score = np.full(n, len(languages)), np.zeros(n)
                if use.any():
                    chance = np.exp(sums[use] - sums[use].max(axis=1, keepdims=True))
                    best[use] = chance.argmax(axis=1)
                    score[use] = chance.max(axis=1) / chance.sum(axis=1)
                some = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(list(names[best]), pa.string()), pa.array(score)], [*some.schema.names, "__lang", "__score"]
                )

    return run


def identify(docs: DataFrame, languages: list[str], probabilities: np.ndarray, model: str = _pieces.MODEL) -> DataFrame:
    """``docs`` with ``__lang``, the likeliest language of the text, and ``__score``, its posterior.

    Only the text counts. A text is lower-cased (A-Z) and cut into stretches; in each language a
    stretch has the sum of the products of piece probabilities over all its segmentations, and the
    text the product over its stretches; languages are equally likely beforehand, ties go to the
    first by code point. A text that is null or has no letter is ``und`` with score 0, as all texts
    are if no language was learned. The broadcast table has a number per piece and language.
    """
    table = docs.sparkSession.sparkContext.broadcast(probabilities)
    return appended(docs, _score(model, languages, table), "__lang string, __score double", "text")


def language_report(docs: DataFrame, folds: int = 4, held: int = 2, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from the rows whose id does not fall in the held-out fold.

    Rows without an id are not learned from and not held out.
    """
    docs, fold = pick(docs, "doc_id", "text", "lang"), crc_bucket(F.col("doc_id"), folds)
    languages, probabilities = train(docs.where(fold != held), **settings)
    scored = identify(docs.select("doc_id", "text"), languages, probabilities)
    return scored.select(
        "doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score")
    )
