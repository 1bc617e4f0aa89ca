"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._order import appended, pick
from basketry.llm._text import U64, WORD, Tokens, char_offsets, crc_bucket, hashes, mix, runs, shingles, tokens
from basketry.session import materialize

# The fit uses at most this many labelled documents of each class, and this many tagged sequences.
MOST_TOXIC, MOST_CLEAN = 4000, 12000
TOXIC_RUNS, CLEAN_RUNS = 2000, 4000
# Of the clean sequences this share is looked at; the field sees the words of a text in runs of RUN.
CLEAN_SHARE = 0.15
RUN = 64
# Weights are kept by feature hash in 2^BITS places; place 0 is for no feature.
BITS = 18
PREFIXES = (4, 5, 6)
# A word or prefix marks tokens as toxic if it is this much more frequent, beyond chance, in toxic texts.
LIFT, EVIDENCE = 5.0, 30.0
# Of labelled texts that share one of so many MinHashes only one is used.
SKETCHES = 3
STEPS, RATE, DECAY = 60, 0.3, 1e-5


class Field(NamedTuple):
    weight: np.ndarray  # of each feature place, for the toxic state
    bias: float
    change: np.ndarray  # 2 x 2: log weight of going from one state (clean, toxic) to the next
    document: np.ndarray  # of (1, largest marginal, log(1 + expected toxic tokens)), for the document


def _forms(t: Tokens) -> list[np.ndarray]:
    """64-bit values of each token's word and prefixes; 0 where it is not longer than the prefix."""
    out = [hashes(t.sums, t.start, t.end)]
    for k, size in enumerate(PREFIXES):
        long = t.end - t.start > size
        cut = np.zeros(len(t.start), U64)
        cut[long] = mix(hashes(t.sums, t.start[long], t.start[long] + size) + U64(k + 1))
        out.append(cut)
    return out


def _features(t: Tokens, forms: list[np.ndarray]) -> np.ndarray:
    """Places of each token's features: its word and prefixes, and the words before and after it in the text."""
    before, after = np.zeros(len(t.start), U64), np.zeros(len(t.start), U64)
    same = t.row[1:] == t.row[:-1]
    before[1:][same] = mix(forms[0][:-1][same] + U64(101))
    after[:-1][same] = mix(forms[0][1:][same] + U64(202))
    both = np.stack([*forms, before, after], axis=1)
    return np.where(both == 0, 0, (both >> U64(64 - BITS)) | U64(1)).astype(np.int32)


def _runs_of(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each run of at most RUN words of one text."""
    count = np.diff(t.first)
    pieces = -(-count // RUN)
    row = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = t.first[:-1][row] + nth * RUN
    return begin, np.minimum(RUN, t.first[1:][row] - begin)


def _ratios(emission: np.ndarray, length: np.ndarray, change: np.ndarray):
    """Forward and backward odds of the toxic state at each place of padded runs (places x runs)."""
    a = np.exp(change)
    growth = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.ones_like(growth), np.ones_like(growth)
    odds = growth[0]
    forward[0] = odds
    for i in range(1, len(growth)):
        odds = (a[0, 1] + odds * a[1, 1]) / (a[0, 0] + odds * a[1, 0]) * growth[i]
        forward[i] = odds
    for i in range(len(growth) - 2, -1, -1):
        ahead = growth[i + 1] * backward[i + 1]
        value = (a[1, 0] + a[1, 1] * ahead) / (a[0, 0] + a[0, 1] * ahead)
        backward[i] = np.where(i + 1 < length, value, 1.0)
    return growth, forward, backward


def marginals(emission: np.ndarray, begin: np.ndarray, length: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic, given all tokens of its run."""
    out = np.zeros(len(emission))
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), 4096):
        some = order[i : i + 4096]
        size = length[some]
        place = np.arange(int(size[0]))[:, None]
        inside = place < size
        at = np.where(inside, begin[some] + place, 0)
        _, forward, backward = _ratios(np.where(inside, emission[at], 0.0), size, change)
        odds = forward * backward
        out[at[inside]] = (odds / (1 + odds))[inside]
    return out


def fit_field(features: np.ndarray, tags: np.ndarray, length: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights that maximise the likelihood of tagged runs laid end to end, by Adam on the whole set."""
    begin = np.cumsum(length) - length
    place = np.arange(int(length.max()))[:, None]
    inside = place < length
    at = np.where(inside, begin + place, 0)
    size = 1 << BITS
    theta, change = np.zeros(size + 1), np.zeros((2, 2))
    moved = [(np.zeros(size + 1), np.zeros(size + 1)), (np.zeros((2, 2)), np.zeros((2, 2)))]
    seen = np.zeros((2, 2))
    pair = tags[at[:-1]], tags[at[1:]]
    for x in range(2):
        for y in range(2):
            seen[x, y] = ((pair[0] == x) & (pair[1] == y) & inside[1:]).sum()
    flat, total = features.ravel(), float(inside.sum())
    for step in range(1, steps + 1):
        emission = theta[features].sum(axis=1) + theta[size]
        growth, forward, backward = _ratios(np.where(inside, emission[at], 0.0), length, change)
        odds = forward * backward
        error = np.zeros(len(emission))
        error[at[inside]] = (odds / (1 + odds))[inside]
        error -= tags
        gradient = np.append(np.bincount(flat, np.repeat(error, features.shape[1]), size), error.sum())
        gradient[0] = 0
        a, before, ahead = np.exp(change), forward[:-1], growth[1:] * backward[1:]
        joint = np.stack([np.full_like(before, a[0, 0]), a[0, 1] * ahead, before * a[1, 0], before * a[1, 1] * ahead])
        joint = np.where(inside[1:], joint / joint.sum(axis=0), 0.0).sum(axis=(1, 2)).reshape(2, 2)
        for value, slope, (mean, square) in ((theta, gradient, moved[0]), (change, joint - seen, moved[1])):
            slope = slope / total * 1000 + DECAY * value
            mean *= 0.9
            mean += 0.1 * slope
            square *= 0.99
            square += 0.01 * slope * slope
            value -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta[0] = 0
    return theta[:size], float(theta[size]), change


def _summary(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row (1, largest marginal, log(1 + expected toxic tokens)); of a row without words (1, 0, 0)."""
    rows = len(first) - 1
    out = np.zeros((rows, 3))
    out[:, 0] = 1
    held = np.flatnonzero(np.diff(first))
    if len(held):
        out[held, 1] = np.maximum.reduceat(chance, first[:-1][held])
        out[held, 2] = np.log1p(np.add.reduceat(chance, first[:-1][held]))
    return out


def fit_documents(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of the documents' summaries, by Newton steps with a small ridge."""
    theta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + ridge @ theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        theta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return theta


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append MinHashes of the words in fives; copies agree in all of them, near copies in some."""
    for batch in batches:
        for i, j, data, at in runs(batch.column("text")):
            t = tokens(data, at, WORD)
            grams, begin = shingles(hashes(t.sums, t.start, t.end), t.first, 5)
            low = np.zeros((SKETCHES, j - i), U64)
            held = np.flatnonzero(np.diff(begin))
            if len(held):
                for k in range(SKETCHES):
                    low[k, held] = np.minimum.reduceat(mix(grams + U64(k)), begin[:-1][held])
            some = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [*some.columns, *(pa.array(x.view(np.int64)) for x in low)], [*some.schema.names, *(f"s{k}" for k in range(SKETCHES))]
            )


def _forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, documents) for the words and prefixes of each batch."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, at in runs(batch.column(0)):
            t = tokens(data, at, WORD)
            form = np.concatenate(_forms(t))
            row = np.tile(t.row, 1 + len(PREFIXES))[form != 0]
            form = form[form != 0]
            order = np.lexsort((form, row))
            form, row = form[order], row[order]
            new = np.concatenate([[True], (form[1:] != form[:-1]) | (row[1:] != row[:-1])])[: len(form)]
            for kind in (0, 1):
                mine = form[new & (toxic[i:j][row] == kind)]
                names, count = np.unique(mine, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.full(len(names), kind)), pa.array(count)], ["form", "toxic", "n"]
                )


def _tagged(marks: np.ndarray):
    """(toxic, order, features, tags): the runs of toxic texts that hold a marked token, and a share of the clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, at in runs(batch.column(0)):
                t = tokens(data, at, WORD)
                forms = _forms(t)
                tag = np.isin(np.stack(forms), marks).any(axis=0) & (toxic[i:j][t.row] == 1)
                features = _features(t, forms)
                out: list[tuple] = []
                for b, n in zip(*_runs_of(t)):
                    order, kind = int(mix(forms[0][b : b + 1] + U64(n) + forms[0][b + n - 1])[0] >> U64(1)), int(toxic[i + t.row[b]])
                    if tag[b : b + n].any() if kind else order < CLEAN_SHARE * (1 << 63):
                        out.append((kind, order, features[b : b + n].tobytes(), tag[b : b + n].tobytes()))
                columns = list(zip(*out)) if out else [[], [], [], []]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], ["toxic", "order", "features", "tags"])

    return run


def _scores(field):
    """Append score and spans (code point offsets) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = field.value
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            for i, j, data, at in runs(batch.column("text")):
                t = tokens(data, at, WORD)
                features = _features(t, _forms(t))
                emission = np.full(len(features), f.bias)
                for k in range(features.shape[1]):
                    emission += f.weight[features[:, k]]
                chance = marginals(emission, *_runs_of(t), f.change)
                score = 1 / (1 + np.exp(-np.clip(_summary(chance, t.first) @ f.document, -30, 30)))
                hot = np.flatnonzero(chance >= 0.5)
                breaks = np.flatnonzero((np.diff(hot) > 1) | (t.row[hot[1:]] != t.row[hot[:-1]])) + 1 if len(hot) else np.empty(0, np.int64)
                head = hot[np.concatenate([[0], breaks]).astype(np.int64)] if len(hot) else hot
                tail = hot[np.concatenate([breaks - 1, [len(hot) - 1]]).astype(np.int64)] if len(hot) else hot
                top = np.maximum.reduceat(chance[hot], np.concatenate([[0], breaks]).astype(np.int64)) if len(hot) else np.empty(0)
                chars = char_offsets(data) if len(hot) else np.zeros(1, np.int64)
                base = chars[at[t.row[head]]] if len(hot) else 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(t.row[head], np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [
                            pa.array((chars[t.start[head]] - base if len(hot) else head).astype(np.int32)),
                            pa.array((chars[t.end[tail]] - base if len(hot) else head).astype(np.int32)),
                            pa.array(top),
                        ],
                        fields=list(span),
                    ),
                )
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score), lists], [*some.schema.names, "__score", "__spans"])

    return run


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``__score`` (0 to 1) and ``__spans``, the offending stretches as code point offsets.

    Only the text counts, all of it; a null text is empty, and a text without words has the score of
    no toxic token. All other columns pass.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    return appended(docs, _scores(held), "__score double, __spans array<struct<start:int,end:int,score:double>>", "text")


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit the field on documents (doc_id, text) with labels (doc_id, toxic; 1 if any row of an id says so).

    At most MOST_TOXIC and MOST_CLEAN labelled documents are used, in order of a hash of their id, and
    of near copies among them one. Words and prefixes that stand out in the toxic ones (by the
    likelihood ratio of document counts) tag the tokens of toxic documents; runs of tagged tokens,
    at most TOXIC_RUNS and CLEAN_RUNS, fit the field; the documents' summaries of its marginals
    fit the score. Without a toxic document every score is low.
    """
    spark, docs, labels = docs.sparkSession, pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    order = F.xxhash64("doc_id")
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = [known.where(f"toxic = {k}").orderBy(order, "doc_id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    drawn = materialize(drawn[0].union(drawn[1]), "drawn")
    whole = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # At most MOST_TOXIC + MOST_CLEAN rows of two numbers.
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sketches = [f"s{k}" for k in range(SKETCHES)]
    once = texts.select("text", "toxic").mapInArrow(_sketched, "text string, toxic int, " + ", ".join(f"{k} long" for k in sketches))
    for k in sketches:
        once = once.groupBy(k, "toxic").agg(F.min(F.struct("text", *sketches)).alias("one")).select("toxic", "one.*")
    sample = materialize(once.select("text", "toxic"), "sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nothing = Field(np.zeros(1 << BITS), -10.0, np.zeros((2, 2)), np.array([-4.0, 0.0, 0.0]))
    if not n.get(1):
        return nothing
    n1, n0 = float(n[1]), float(n.get(0, 0))
    counted = sample.mapInArrow(_forms_of, "form long, toxic long, n long").groupBy("form").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    share = (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    a_part = F.col("a") * F.log(F.col("a") / (share * n1))
    b_part = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (share * F.lit(n0)))).otherwise(0.0)
    lift = (F.col("a") / F.lit(n1)) / ((F.col("b") + 0.5) / F.lit(n0 + 1))
    marks = counted.where("a > 0").where((2 * (a_part + b_part) >= EVIDENCE) & (lift >= LIFT)).select("form")
    # At most a few forms for each of the sample's documents reach the evidence.
    marks = np.array(sorted(r.form for r in marks.collect()), np.int64).view(U64)
    tagged = materialize(sample.mapInArrow(_tagged(marks), "toxic int, order long, features binary, tags binary"), "tagged")
    rows = [
        r
        for k, most in ((1, TOXIC_RUNS), (0, CLEAN_RUNS))
        for r in tagged.where(f"toxic = {k}").orderBy("order", "features").limit(most).collect()
    ]
    if not rows or not any(r.toxic for r in rows):
        return nothing
    width = 3 + len(PREFIXES)
    features = np.concatenate([np.frombuffer(r.features, np.int32) for r in rows]).reshape(-1, width)
    tags = np.concatenate([np.frombuffer(r.tags, np.uint8) for r in rows]).astype(np.int64)
    weight, bias, change = fit_field(features, tags, np.array([len(r.tags) for r in rows]))
    field = Field(weight, bias, change, np.array([0.0, 1.0, 0.0]))
    held = spark.sparkContext.broadcast(field)
    summaries = sample.mapInArrow(_summaries(held), "toxic int, top double, many double").collect()
    toxic = np.array([r.toxic for r in summaries], float)
    x = np.array([(1.0, r.top, r.many) for r in summaries])
    each = {k: whole.get(k, 0) / n[k] for k in n}
    return field._replace(document=fit_documents(x, toxic, np.array([each[int(k)] for k in toxic])))


def _summaries(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = held.value
        for batch in batches:
            for i, j, data, at in runs(batch.column(0)):
                t = tokens(data, at, WORD)
                features = _features(t, _forms(t))
                chance = marginals(f.weight[features].sum(axis=1) + f.bias, *_runs_of(t), f.change)
                x = _summary(chance, t.first)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(x[:, 1]), pa.array(x[:, 2])], ["toxic", "top", "many"])

    return run


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of ``docs``; labels of the held-out fold are not learned.

    Rows without an id are not learned from and not held out.
    """
    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    field = train(docs, labels.where(crc_bucket(F.col("doc_id"), folds) != held))
    return score(docs, field).select(
        "doc_id",
        F.coalesce(crc_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
        F.col("__spans").alias("spans"),
    )
