"""N-gram language model in an Elias-Fano trie, built and read in shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._elias_fano import EliasFano, encode
from basketry.llm._order import appended, pick
from basketry.llm._store import mapped, write
from basketry.llm._text import U64, crc_bucket, hashes, mix, runs, tokens
from basketry.session import shared_dir
from basketry.sources.versions import qualified

# Subtracted from every count and given to the lower order.
DISCOUNT = 0.75
# Probabilities are stored in steps of 1/16 of log10, in one byte.
STEPS = 16
END = mix(np.array([0x454E44], U64))[0]
TEXT_RUN = 1 << 22
# Each shard tells so many points of its mass, from which the next level's shards are cut.
POINTS = 64
PACK = "shard int, keys binary, ranks binary, counts binary"
TOLD = "shard int, n long, total long, first long, first_n long, first_sum double, last long, last_n long, last_sum double, at binary, part binary"


@dataclass
class Level:
    """Where the n-grams of one order lie: a shard has those whose key is in its range."""

    cuts: np.ndarray  # lower ends of the shards' ranges of (context, word), but for the first
    offset: np.ndarray  # n-grams before each shard
    before: np.ndarray  # of the first context of each shard, its n-grams in the shards before
    context: np.ndarray  # contexts that several shards share, and their whole discounted share
    share: np.ndarray


@dataclass
class Model:
    folder: str
    words: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # words before each shard
    total: int = 0
    levels: dict[int, Level] = field(default_factory=dict)

    @property
    def shards(self) -> int:
        return len(self.words) - 1

    @property
    def distinct(self) -> int:
        return int(self.words[-1])


def quantise(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(probability, 1e-300)) * STEPS), 0, 255).astype(np.uint8)


def _value(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(float) / STEPS)


def _bytes_file(codes: np.ndarray) -> bytes:
    return codes.tobytes() + bytes(-len(codes) % 8)


@lru_cache(maxsize=4096)
def _sequence(path: str) -> EliasFano:
    return EliasFano(mapped(path))


_open: list[str] = []


def _use(model: Model) -> Model:
    """Forget the files of any other model; a worker process may serve several in turn."""
    if _open != [model.folder]:
        _sequence.cache_clear()
        mapped.cache_clear()
        _open[:] = [model.folder]
    return model


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    # Two bytes are sorted by radix.
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    names, at = np.unique(shard[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, at[1:]))


def word_shard(code: np.ndarray, shards: int) -> np.ndarray:
    return ((code >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def find_words(model: Model, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (or -1) and count of each word hash."""
    number, count = np.full(len(code), -1), np.zeros(len(code), np.int64)
    for shard, at in _by_shard(word_shard(code, model.shards)) if model.total else ():
        n = int(model.words[shard + 1] - model.words[shard])
        if not n:
            continue
        known = mapped(f"{model.folder}/1/{shard}.word")
        place = np.minimum(np.searchsorted(known, code[at]), n - 1)
        hit = known[place] == code[at]
        at, place = at[hit], place[hit]
        sums = _sequence(f"{model.folder}/1/{shard}.sums")
        number[at] = model.words[shard] + place
        count[at] = sums.get(place + 1) - sums.get(place)
    return number, count


def find_grams(model: Model, order: int, context: np.ndarray, word: np.ndarray, rank: np.ndarray | None, counts: bool = False):
    """Of n-grams (context number, last word): position in the level or -1, discounted share, share left over, rank, count (up to 255).

    ``word`` picks the shard. The pointers give the context's range; in it a successor search finds
    the word, or in level three its rank among the words that follow the middle word.
    """
    level, folder = model.levels[order], f"{model.folder}/{order}"
    n = len(context)
    position, share, rest, within, count = np.full(n, -1), np.zeros(n), np.ones(n), np.full(n, -1), np.zeros(n, np.int64)
    key = (context.astype(U64) << U64(32)) | np.maximum(word, 0).astype(U64)
    for shard, at in _by_shard(np.searchsorted(level.cuts, key, "right")):
        size = int(level.offset[shard + 1] - level.offset[shard])
        if not size:
            continue
        first = int(level.cuts[shard - 1] >> U64(32)) if shard else 0
        at = at[np.argsort(key[at])]
        local = context[at] - first
        pointers = _sequence(f"{folder}/{shard}.pointers")
        inside = local < pointers.n - 1
        at, local = at[inside], local[inside]
        one, which = np.unique(local, return_inverse=True)
        ends = pointers.get(np.concatenate([one, one + 1]))
        begin, end = ends[: len(one)][which], ends[len(one) :][which]
        rest[at] = _value(mapped(f"{folder}/{shard}.rest").view(np.uint8)[one])[which]
        use = np.flatnonzero((end > begin) & ((word if rank is None else rank)[at] >= 0))
        at, begin, end, which = at[use], begin[use], end[use], which[use]
        words = _sequence(f"{folder}/{shard}.words")
        heads, inverse = np.unique(begin, return_inverse=True)
        base = np.zeros(len(heads), np.int64)
        base[heads > 0] = words.get(heads[heads > 0] - 1)
        wanted = (word if rank is None else rank)[at] + base[inverse]
        place, exact = words.find(wanted, begin, end)
        hit = np.flatnonzero(exact)
        at, place, begin = at[hit], place[hit], begin[hit]
        position[at] = level.offset[shard] + place
        within[at] = place - begin + np.where(context[at] == first, level.before[shard], 0)
        share[at] = _value(mapped(f"{folder}/{shard}.share").view(np.uint8)[place])
        if counts:
            count[at] = mapped(f"{folder}/{shard}.few").view(np.uint8)[place]
    if len(level.context):
        slot = np.minimum(np.searchsorted(level.context, context), len(level.context) - 1)
        split = level.context[slot] == context
        rest[split] = 1 - level.share[slot[split]]
    return position, share, rest, within, count


def sequence(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, an end after each row, and the row of each."""
    t = tokens(data, at)
    rows = len(at) - 1
    code, row = np.full(len(t.start) + rows, END), np.empty(len(t.start) + rows, np.int64)
    place = np.arange(len(t.start)) + t.row
    code[place], row[place] = hashes(t.sums, t.start, t.end), t.row
    row[t.first[1:] + np.arange(rows)] = np.arange(rows)
    return code, row


def _numbers(model: Model, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(code, return_inverse=True)
    number, count = find_words(model, distinct)
    return number[inverse], count[inverse]


def _pairs(model: Model, number: np.ndarray, row: np.ndarray, counts: bool = False):
    """For each token but the first of a row, if the one before is known: its pair's look-up, by distinct pairs."""
    n = len(number)
    out = {k: v for k, v in zip(("position", "share", "rest", "within", "count"), (np.full(n, -1), np.zeros(n), np.ones(n), np.full(n, -1), np.zeros(n, np.int64)))}
    if n > 1 and 2 in model.levels:
        follows = np.flatnonzero((row[1:] == row[:-1]) & (number[:-1] >= 0)) + 1
        key = (number[follows - 1].astype(U64) << U64(32)) | (number[follows] + 1).astype(U64)
        key, inverse = np.unique(key, return_inverse=True)
        found = find_grams(model, 2, (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64) - 1, None, counts)
        for name, value in zip(out, found):
            out[name][follows] = value[inverse]
    return out


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: the shuffle's codec shortens these, but not whole numbers."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers_of(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, ranks: np.ndarray | None = None) -> pa.RecordBatch:
    """A row per shard; the sorted keys as steps from one to the next."""
    names, columns = [], ([], [], [])
    for name, at in _by_shard(shard):
        names.append(name)
        columns[0].append(_planes(np.diff(keys[at].astype(U64), prepend=U64(0))))
        columns[1].append(_planes(ranks[at].astype(np.uint32)) if ranks is not None else b"")
        columns[2].append(_planes(counts[at].astype(np.uint32)))
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["shard", "keys", "ranks", "counts"]
    )


def _count(model: Model, order: int, least: int):
    """The n-grams of each run of texts with their counts, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _use(model)
        for batch in batches:
            for _, _, data, at in runs(batch.column(0), TEXT_RUN):
                code, row = sequence(data, at)
                if order == 1:
                    keys, counts = np.unique(code, return_counts=True)
                    yield _packed(word_shard(keys, model.shards), keys, counts)
                    continue
                number, _ = _numbers(model, code)
                if order == 2:
                    same = row[1:] == row[:-1]
                    key = (number[:-1][same].astype(U64) << U64(32)) | number[1:][same].astype(U64)
                    key, counts = np.unique(key, return_counts=True)
                    yield _packed(np.searchsorted(model.levels[2].cuts, key, "right"), key, counts)
                    continue
                # Three words can only occur so often if both of their pairs do.
                pair = _pairs(model, number, row, counts=least > 1)
                often = pair["count"] >= least if least > 1 else pair["position"] >= 0
                at3 = np.flatnonzero(often[1:] & often[:-1]) + 1
                key = (pair["position"][at3 - 1].astype(U64) << U64(32)) | number[at3].astype(U64)
                order3 = np.argsort(key)
                key = key[order3]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                counts, within = np.diff(np.append(first, len(key))), pair["within"][at3][order3[first]]
                key = key[first]
                yield _packed(np.searchsorted(model.levels[3].cuts, key, "right"), key, counts, within)

    return run


def _gathered(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_numbers_of(x, U64)) for x in group["keys"]])
    counts = np.concatenate([_numbers_of(x, np.uint32) for x in group["counts"]]).astype(np.int64)
    keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    ranks = np.concatenate([_numbers_of(x, np.uint32) for x in group["ranks"]])
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64), ranks[first].astype(np.int64) if len(ranks) else ranks


def _told(shard: int, counts: np.ndarray, name: np.ndarray, ends: tuple = (0, 0, 0.0, 0, 0, 0.0)) -> pd.DataFrame:
    """A shard's row: its size, its ends, and the points that cut its counts into equal parts."""
    running = np.cumsum(counts)
    goal = running[-1] * np.arange(POINTS) / POINTS
    i = np.searchsorted(running, goal, "right")
    part = (goal - (running[i] - counts[i])) / counts[i]
    values = [shard, len(counts), int(running[-1]), *ends, name[i].astype(np.int64).tobytes(), part.tobytes()]
    return pd.DataFrame([values], columns=[x.split()[0] for x in TOLD.split(", ")])


def _build_words(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        keys, counts, _ = _gathered(group)
        write(f"{folder}/1/{shard}.word", keys.tobytes())
        write(f"{folder}/1/{shard}.sums", encode(np.concatenate([[0], np.cumsum(counts)])))
        return _told(shard, counts, np.arange(len(counts)))

    return run


def _build_grams(model: Model, order: int, context_counts, least: int):
    level, folder = model.levels[order], f"{model.folder}/{order}"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _use(model)
        shard = int(group["shard"].iloc[0])
        keys, counts, ranks = _gathered(group)
        first = int(level.cuts[shard - 1] >> U64(32)) if shard else 0
        if order == 3 and least > 1:
            kept = counts >= least
            keys, counts, ranks = keys[kept], counts[kept], ranks[kept]
            if not len(keys):
                return pd.DataFrame(columns=[x.split()[0] for x in TOLD.split(", ")])
        context = (keys >> U64(32)).astype(np.int64)
        word = (keys & U64(0xFFFFFFFF)).astype(np.int64) if order == 2 else ranks
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.append(head, len(context)))
        total = context_counts(model, context[head])
        share = np.maximum(counts - DISCOUNT, 0) / np.repeat(total, size)
        used = np.add.reduceat(share, head)
        # Words of a context are raised by the last value before it, so that the whole is monotone.
        base = np.concatenate([[0], np.cumsum(word[head + size - 1])[:-1]])
        slots = int(context[-1]) - first + 1
        pointers = np.searchsorted(context, np.arange(first, first + slots + 1))
        rest = np.zeros(slots, np.uint8)
        rest[context[head] - first] = quantise(1 - used)
        write(f"{folder}/{shard}.pointers", encode(pointers))
        write(f"{folder}/{shard}.words", encode(word + np.repeat(base, size)))
        write(f"{folder}/{shard}.share", _bytes_file(quantise(share)))
        write(f"{folder}/{shard}.rest", _bytes_file(rest))
        if order == 2:
            write(f"{folder}/{shard}.sums", encode(np.concatenate([[0], np.cumsum(counts)])))
            if least > 1:
                write(f"{folder}/{shard}.few", _bytes_file(np.minimum(counts, 255).astype(np.uint8)))
        ends = (int(context[0]), int(size[0]), float(used[0]), int(context[-1]), int(size[-1]), float(used[-1]))
        return _told(shard, counts, np.arange(len(counts)), ends)

    return run


def _word_totals(model: Model, number: np.ndarray) -> np.ndarray:
    """Counts of words by number."""
    out = np.zeros(len(number), np.int64)
    for shard, at in _by_shard(np.searchsorted(model.words, number, "right") - 1):
        sums, place = _sequence(f"{model.folder}/1/{shard}.sums"), number[at] - model.words[shard]
        out[at] = sums.get(place + 1) - sums.get(place)
    return out


def _pair_totals(model: Model, position: np.ndarray) -> np.ndarray:
    """Counts of pairs by position."""
    out, offset = np.zeros(len(position), np.int64), model.levels[2].offset
    for shard, at in _by_shard(np.searchsorted(offset, position, "right") - 1):
        sums, place = _sequence(f"{model.folder}/2/{shard}.sums"), position[at] - offset[shard]
        out[at] = sums.get(place + 1) - sums.get(place)
    return out


def _cuts(rows: list, offset: np.ndarray, shards: int, distinct: int) -> np.ndarray:
    """Keys that cut the next level into shards of like mass; a context with much mass is cut by its words, too."""
    at = np.concatenate([np.frombuffer(r.at, np.int64) + offset[r.shard] for r in rows])
    part = np.concatenate([np.frombuffer(r.part, np.float64) for r in rows])
    mass = np.cumsum(np.repeat([r.total / POINTS for r in rows], POINTS))
    pick = np.minimum(np.searchsorted(mass, mass[-1] * np.arange(1, shards) / shards), len(at) - 1)
    cuts = (at[pick].astype(U64) << U64(32)) | (part[pick] * distinct).astype(U64)
    return np.unique(cuts)


def _level(rows: list, cuts: np.ndarray) -> Level:
    """What all readers of a level have to know of its shards, a few numbers for each."""
    size, before = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    seen: dict[int, list[tuple[int, int, float]]] = {}
    for r in rows:
        size[r.shard] = r.n
        for context, n, share in {(r.first, r.first_n, r.first_sum), (r.last, r.last_n, r.last_sum)}:
            seen.setdefault(context, []).append((r.shard, n, share))
    for shard in range(1, len(cuts) + 1):
        first = int(cuts[shard - 1] >> U64(32))
        before[shard] = sum(n for s, n, _ in seen.get(first, ()) if s < shard)
    several = sorted(c for c in {int(x >> U64(32)) for x in cuts} if c in seen)
    share = np.array([sum(s for _, _, s in seen[c]) for c in several])
    return Level(cuts, np.concatenate([[0], np.cumsum(size)]), before, np.array(several, np.int64), share)


def train(docs: DataFrame, order: int = 3, shards: int | None = None, least: int = 1) -> Model:
    """Count the n-grams of all texts (column text) and build the trie in the shared folder.

    One pass over the texts for each order. Words are numbered by their place in the order of their
    hashes. A level is cut into ranges of (context, word) of like mass, counted and built by one
    task each; n-grams are first added up in each run of texts, and a frequent context is cut by its
    words, so none is gathered in one task. The driver has a row per shard. Numbers of words and of
    pairs must stay below 2^32. All n-grams are kept, unless ``least`` asks for trigrams from so many
    counts on (at most 255).
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Workers read the folder themselves: name its file system.
    model = Model(f"{qualified(spark, shared_dir(spark))}/basketry/lm-{uuid4().hex}", np.zeros(shards + 1, np.int64))
    texts = pick(docs, "text")

    def built(order_: int, build) -> list:
        packed = texts.mapInArrow(_count(model, order_, least), PACK)
        return sorted(packed.groupBy("shard").applyInPandas(build, TOLD).collect(), key=lambda r: r.shard)

    rows = built(1, _build_words(model.folder))
    size = np.zeros(shards, np.int64)
    for r in rows:
        size[r.shard] = r.n
    model.words, model.total = np.concatenate([[0], np.cumsum(size)]), sum(r.total for r in rows)
    offset = model.words
    for k in range(2, order + 1):
        if not rows:
            break
        if offset[-1] >= 1 << 32:
            raise ValueError("a level has more than 2^32 entries")
        cuts = _cuts(rows, offset, shards, model.distinct)
        model.levels[k] = Level(cuts, np.zeros(len(cuts) + 2, np.int64), np.zeros(len(cuts) + 1, np.int64), np.empty(0, np.int64), np.empty(0))
        rows = built(k, _build_grams(model, k, _word_totals if k == 2 else _pair_totals, least))
        if not rows:
            del model.levels[k]
            break
        model.levels[k] = _level(rows, cuts)
        offset = model.levels[k].offset
    return model


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = _use(held.value)
        total, distinct = model.total, model.distinct
        for batch in batches:
            for i, j, data, at in runs(batch.column("text"), TEXT_RUN):
                n = j - i
                code, row = sequence(data, at)
                number, count = _numbers(model, code)
                base = np.log10((count + 1) / (total + distinct + 1))
                # Shares left over by counted words go in equal parts to all of them and one unknown.
                spread = DISCOUNT * distinct / (distinct + 1) / total if total else 1.0
                one = _value(quantise((np.maximum(count - DISCOUNT, 0) / total if total else 0 * count) + spread))
                pair = _pairs(model, number, row)
                chance = pair["share"] + pair["rest"] * one
                if 3 in model.levels:
                    before = np.concatenate([[-1], pair["position"][:-1]])
                    follows = np.flatnonzero((before >= 0) & (np.concatenate([[-1], row[:-1]]) == row))
                    key = (before[follows].astype(U64) << U64(32)) | (number[follows] + 1).astype(U64)
                    key, inverse = np.unique(key, return_inverse=True)
                    some = np.empty(len(key), np.int64)
                    some[inverse] = follows
                    _, share, rest, _, _ = find_grams(model, 3, before[some], number[some], pair["within"][some])
                    chance[follows] = share[inverse] + rest[inverse] * chance[follows]
                score = np.bincount(row, np.log10(chance), n)
                columns = [
                    np.bincount(row, minlength=n), np.bincount(row, count > 0, n).astype(np.int64), np.bincount(row, base, n), score,
                ]
                some = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, *(pa.array(c) for c in columns)], [*some.schema.names, "__n_tokens", "__n_known", "__base", "__score"]
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__n_tokens``, ``__n_known``, ``__base`` and ``__score`` of each whole text; other columns pass.

    ``__score`` is the log10 probability of the text's tokens and its end, each given the two before
    it: discounted shares of the orders found, the share left over times the lower order's
    probability, and for single words an equal part of what is left for all words and one unknown.
    A null or empty text is its end alone. Tasks map the shards they meet and read them in place;
    only a few numbers per shard are broadcast. Without training texts every score is 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return appended(docs, _score(held), "__n_tokens long, __n_known long, __base double, __score double", "text")


def lm_report(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 3, shards: int | None = None, least: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learned from the rows outside the fold.

    Rows without an id are not learned from and not held out. All trigrams are kept, unless
    ``least`` asks for those from so many counts on.
    """
    docs, fold = pick(docs, "doc_id", "text"), crc_bucket(F.col("doc_id"), folds)
    model = train(docs.where(fold != held), order, shards, least)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        F.col("__n_tokens").alias("n_tokens"),
        F.col("__n_known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("__base").alias("base_score"),
        F.col("__score").alias("score"),
    )
