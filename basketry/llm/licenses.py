"""Find licence texts in documents by the Dice coefficient over word bigrams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._order import appended, pick
from basketry.llm._text import U64, char_offsets, hashes, mix, runs, tokens
from basketry.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
# Words are runs of these bytes, A-Z lower-cased; all else separates.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True
UNITS = ("text", "block", "line")
MATCH = "array<struct<license:string,unit:string,start:int,end:int,dice:double>>"


def bigrams(words: np.ndarray) -> np.ndarray:
    """Hashes of successive words' pairs."""
    with np.errstate(over="ignore"):
        return mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])


class Library:
    """Bigram counts of the templates, in order of size."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        found = []
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            t = tokens(data, np.array([0, len(data)]), ALNUM)
            pairs = bigrams(hashes(t.sums, t.start, t.end)) if len(t.start) > 1 else np.empty(0, U64)
            if len(pairs):
                found.append((len(pairs), name, dict(zip(*(x.tolist() for x in np.unique(pairs, return_counts=True))))))
        found.sort(key=lambda x: x[:2])
        self.size = np.array([x[0] for x in found])
        self.name, self.count = [x[1] for x in found], [x[2] for x in found]
        self.all = np.unique(np.array([k for x in found for k in x[2]], U64))

    def stretches(self, pairs: np.ndarray, row: np.ndarray, found: list[list[tuple[str, int, int]]]) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, name, first pair, last pair, Dice) of the stretches of words that reach the threshold, best first.

        ``row`` is -1 for pairs across two rows. Stretches of a name overlap neither each other nor
        what ``found`` has of it. A stretch shares at least ``need`` pairs and is at most ``wide``
        long, so only hits that are so dense can start one; these are compared with all their ends.
        """
        place = np.minimum(np.searchsorted(self.all, pairs), len(self.all) - 1)
        known = np.flatnonzero((self.all[place] == pairs) & (row >= 0))
        bound = self.threshold / (2 - self.threshold)
        for k, size in enumerate(self.size.tolist()):
            copies = np.array([self.count[k].get(x, 0) for x in self.all.tolist()])
            at = known[copies[place[known]] > 0]
            need, wide = max(1, int(np.ceil(size * bound - 1e-9))), int(size / bound + 1e-9)
            if len(at) < need:
                continue
            ahead = at[need - 1 :]
            starts = np.flatnonzero((ahead - at[: len(ahead)] < wide) & (row[ahead] == row[at[: len(ahead)]]))
            if not len(starts):
                continue
            # Where, among the hits, a pair had been met as often as the template has it; before that, more do not count.
            enough = np.full(len(at), -1)
            order = np.argsort(place[at], kind="stable")
            code = place[at][order]
            back = np.arange(len(at)) - copies[code]
            some = (back >= 0) & (code[back] == code)
            enough[order[some]] = order[back[some]]

            def best(s: int, before: int) -> tuple[float, int, int] | None:
                """The best stretch from hit ``s`` that ends before the pair ``before``: (-Dice, hit, last hit)."""
                end = int(np.searchsorted(at, min(before, at[s] + wide)))
                end = s + int(np.searchsorted(row[at[s:end]], row[at[s]], "right"))
                if end - s < need:
                    return None
                dice = 2.0 * np.cumsum(enough[s:end] < s) / (at[s:end] - at[s] + 1 + size)
                e = int(np.argmax(dice))
                return (-float(dice[e]), s, s + e) if dice[e] >= self.threshold else None

            taken: list[tuple[int, int]] = []
            for a, b in sorted((a, b) for r in np.unique(row[at[starts]]).tolist() for name, a, b in found[r] if name == self.name[k]):
                if taken and a <= taken[-1][1]:
                    a, b = taken[-1][0], max(b, taken.pop()[1])
                taken.append((a, b))
            heap = [x for s in starts.tolist() if (x := best(s, len(pairs)))]
            heapify(heap)
            while heap:
                dice, s, e = heappop(heap)
                a, b = int(at[s]), int(at[e])
                i = bisect_left(taken, (a + 1,))
                if i and taken[i - 1][1] >= a:
                    continue
                if i < len(taken) and taken[i][0] <= b:
                    if shorter := best(s, taken[i][0]):
                        heappush(heap, shorter)
                    continue
                taken.insert(i, (a, b))
                yield int(row[a]), self.name[k], a, b, -dice

    def candidates(self, size: int) -> range:
        """Templates whose size lets a unit of ``size`` bigrams reach the threshold: 2 min / sum >= threshold."""
        if not len(self.size):
            return range(0)
        bound = self.threshold / (2 - self.threshold)
        return range(int(np.searchsorted(self.size, size * bound * (1 - 1e-12))), int(np.searchsorted(self.size, size / bound * (1 + 1e-12), "right")))

    def matches(self, pairs: np.ndarray) -> list[tuple[str, float]]:
        """(name, Dice) of the templates that reach the threshold."""
        near = self.candidates(len(pairs))
        if not len(near):
            return []
        own = list(zip(*(x.tolist() for x in np.unique(pairs, return_counts=True))))
        out = []
        for k in near:
            count = self.count[k]
            dice = 2.0 * sum(min(n, count.get(p, 0)) for p, n in own) / (len(pairs) + int(self.size[k]))
            if dice >= self.threshold:
                out.append((self.name[k], dice))
        return out


def _boundaries(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """For each byte position a number that differs between units."""
    cut = np.zeros(len(data) + 1, np.int64)
    np.add.at(cut, at[1:-1], 1)
    if unit == "line":
        cut[:-1] += data == 10
    elif unit == "block":
        cut[: len(data) - 1] += (data[:-1] == 10) & (data[1:] == 10) if len(data) > 1 else 0
    return np.cumsum(cut)


def _scan(templates: dict[str, str], threshold: float, stretches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(templates, threshold)
        entry = pa.struct([("license", pa.string()), ("unit", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())])
        for batch in batches:
            for i, j, data, at in runs(batch.column("text")):
                out: list[list[dict]] = [[] for _ in range(j - i)]
                t = tokens(data, at, ALNUM)
                if len(t.start) > 1 and len(library.all):
                    words = hashes(t.sums, t.start, t.end)
                    pairs = bigrams(words)
                    place = np.minimum(np.searchsorted(library.all, pairs), len(library.all) - 1)
                    hit = library.all[place] == pairs
                    chars = None
                    places: list[list[tuple[str, int, int]]] = [[] for _ in out]
                    for unit in UNITS:
                        name = _boundaries(data, at, unit)[t.start]
                        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                        last = np.append(first[1:], len(name)) - 1
                        hits = np.concatenate([[0], np.cumsum(hit)])
                        inside, size = hits[last] - hits[first], last - first
                        # Enough bigrams that some template has, for the smallest of them.
                        near = (size > 0) & (2 * inside >= threshold * (size + library.size[0]) - 1e-9)
                        for u in np.flatnonzero(near):
                            a, b = int(first[u]), int(last[u])
                            for license_, dice in library.matches(pairs[a:b]):
                                chars = char_offsets(data) if chars is None else chars
                                row = int(t.row[a])
                                places[row].append((license_, a, b - 1))
                                out[row].append({
                                    "license": license_, "unit": unit, "start": int(chars[t.start[a]] - chars[at[row]]),
                                    "end": int(chars[t.end[b]] - chars[at[row]]), "dice": dice,
                                })
                    if stretches:
                        within = np.where(t.row[1:] == t.row[:-1], t.row[:-1], -1)
                        for row, license_, a, b, dice in library.stretches(pairs, within, places):
                            chars = char_offsets(data) if chars is None else chars
                            out[row].append({
                                "license": license_, "unit": "stretch", "start": int(chars[t.start[a]] - chars[at[row]]),
                                "end": int(chars[t.end[b + 1]] - chars[at[row]]), "dice": dice,
                            })
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.list_(entry))], [*some.schema.names, "__matches"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, stretches: bool = True) -> DataFrame:
    """``docs`` with ``__matches``: the licences found, where (code point offsets), and how alike they are.

    Compared are the whole text, its blocks (parts between empty lines) and its lines, as words of
    ASCII letters and digits in lower case. A unit matches a template if twice the bigrams they
    share, counted with repeats, is at least ``threshold`` of all bigrams of both. Templates whose
    size alone rules that out are not compared, nor units with too few bigrams known to any. A null
    or empty text, and a unit of fewer than two words, matches nothing. Other columns pass.

    Any run of successive words of a text is compared, too (unless ``stretches`` is off), so that a
    licence is found wherever it stands; of those that share a pair of words only the best is listed, and none
    that shares one with a unit that matches the same template.

    The templates are a fixed list that goes with the task; every text is read once, no shuffle.
    """
    return appended(docs, _scan(templates, threshold, stretches), f"__matches {MATCH}", "text")


def license_report(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, stretches: bool = True) -> DataFrame:
    """(doc_id, n_matches, licenses, best_license, best_dice): names joined by commas; null and 0 where none is found."""
    found = scan(pick(docs, "doc_id", "text"), templates, threshold, stretches)
    best = F.expr("element_at(array_sort(transform(__matches, m -> struct(-m.dice as d, m.license as l))), 1)")
    some = F.size("__matches") > 0
    return found.select(
        "doc_id",
        F.size("__matches").cast("long").alias("n_matches"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct("__matches.license")), ",")).alias("licenses"),
        F.when(some, best["l"]).alias("best_license"),
        F.when(some, -best["d"]).otherwise(0.0).alias("best_dice"),
    )
