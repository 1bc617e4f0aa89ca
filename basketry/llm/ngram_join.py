"""Near-duplicate documents: MinHash LSH forest over word n-grams, then exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import _bloom
from basketry.llm._components import connected_components, local_components
from basketry.llm._order import pick
from basketry.llm._text import U64, give_back, hashes, mix, runs, shingles, tokens
from basketry.session import materialize

WIDTH, THRESHOLD = 5, 0.8
# The forest: tries of signatures, the values on a full path, and the share of pairs at the threshold to find.
TREES, DEPTH, RECALL = 32, 8, 0.999
# A tile of the exact check holds about this many documents and n-grams on each side.
TILE_DOCS, TILE_GRAMS = 256, 1 << 20
# Up to this many documents of a tile an n-gram is counted pair by pair, above by matrix products.
RARE = 16

SIGNED = "doc_id long, text_md5 string, grams long, digest binary, labels array<long>"
EDGE = "a long, b long, part int, tree int, label long"


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Prefixes are shortened from ``depth`` until a pair at the threshold shares one with this chance."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def gram_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, and where each row's begin."""
    words = tokens(data, at)
    grams, begin = shingles(hashes(words.sums, words.start, words.end), words.first, width)
    for i, j in zip(begin[:-1], begin[1:]):
        grams[i:j].sort()
    row = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(at)))


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the bins to borrow from, in turn, while it is empty."""
    cells = np.arange(bins * tries, dtype=U64).reshape(tries, bins)
    return (mix(cells + U64(12345)) % U64(bins)).astype(np.int64)


@lru_cache(maxsize=2)
def _turns(bins: int) -> np.ndarray:
    """For each bin the turn of every bin to be borrowed from, once the probes have met none that is filled."""
    drawn = mix(np.arange(bins * bins, dtype=U64).reshape(bins, bins) + U64(0x7475726E73))
    return np.argsort(np.argsort(drawn, axis=1), axis=1).astype(np.int32)


def signatures(grams: np.ndarray, begin: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One-permutation MinHash: labels of ``depth`` bytes, a row of ``trees`` of them per document.

    The smallest hash of each of trees * depth bins counts; an empty bin borrows from bins drawn for
    it in a fixed order, so that two documents agree in a bin with the chance of their Jaccard value.
    """
    bins, docs = trees * depth, len(begin) - 1
    row = np.repeat(np.arange(docs), np.diff(begin))
    cell = row * bins + ((grams >> U64(40)) % U64(bins)).astype(np.int64)
    # Within a document and bin the smallest of the scrambled hashes.
    value = mix(grams)
    low = np.full(docs * bins, ~U64(0))
    np.minimum.at(low, cell, value)
    filled = np.zeros(docs * bins, bool)
    filled[cell] = True
    low, filled = low.reshape(docs, bins), filled.reshape(docs, bins)
    out = (low >> U64(3)).astype(np.uint8)
    at, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for probe in _probes(bins):
        source = probe[bin_]
        found = filled[at, source]
        out[at[found], bin_[found]] = (low[at[found], source[found]] >> U64(3)).astype(np.uint8)
        at, bin_ = at[~found], bin_[~found]
        if not len(at):
            break
    for i in range(0, len(at), 4096):  # few bins are filled: the first of them in an order of all bins drawn for this one
        a, b = at[i : i + 4096], bin_[i : i + 4096]
        source = np.where(filled[a], _turns(bins)[b], bins).argmin(axis=1)
        out[a, b] = (low[a, source] >> U64(3)).astype(np.uint8)
    path = out.reshape(docs, trees, depth)
    label = np.zeros((docs, trees), U64)
    for d in range(depth):
        label = (label << U64(8)) | path[:, :, d].astype(U64)
    return label


def _digests(grams: np.ndarray, begin: np.ndarray) -> pa.Array:
    """128 bits that stand for a set, equal for equal sets; null for none."""
    use = np.flatnonzero(np.diff(begin))
    out: list[bytes | None] = [None] * (len(begin) - 1)
    if len(use):
        with np.errstate(over="ignore"):
            both = np.stack([np.add.reduceat(mix(grams + U64(k)), begin[:-1][use]) for k in (1, 2)], axis=1)
        for d, x in zip(use, both):
            out[d] = x.tobytes()
    return pa.array(out, pa.binary())


def _sign(width: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in runs(batch.column(1)):
                grams, begin = gram_sets(data, at, width)
                count = np.diff(begin)
                ids, md5 = (batch.column(k).slice(i, j - i) for k in (0, 2))
                labels = signatures(grams, begin, trees, depth).astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, trees, dtype=np.int32)), pa.array(labels.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids, md5, pa.array(count), _digests(grams, begin), flat], ["doc_id", "text_md5", "grams", "digest", "labels"]
                )

    return run


def _adjacent(kept: int, depth: int):
    """Tie each row of sorted (tree, label, rep) to the one before it, if their prefixes agree; and tell the ends."""
    shift = U64(8 * (depth - kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, ends = TaskContext.get().partitionId(), None, []
        for batch in batches:
            tree, label, rep = (np.asarray(batch.column(i)) for i in range(3))
            if not len(tree):
                continue
            if last is None:
                ends.append((rep[0], None, part, tree[0], label[0]))
            else:
                tree, label, rep = (np.concatenate([[x], y]) for x, y in zip(last, (tree, label, rep)))
            last = tree[-1], label[-1], rep[-1]
            prefix = label.view(U64) >> shift
            same = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1]) & (rep[1:] != rep[:-1])
            a, b = rep[1:][same], rep[:-1][same]
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.int64())], ["a", "b", "part", "tree", "label"]
            )
        if last is not None:
            ends.append((last[2], None, part, last[0], last[1]))
            columns = [[None if v is None else int(v) for v in x] for x in zip(*ends)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], ["a", "b", "part", "tree", "label"])

    return run


def forest_edges(reps: DataFrame, kept: int, depth: int = DEPTH) -> DataFrame:
    """(a, b): documents that share a prefix of ``kept`` values in some trie, tied in a chain.

    The tries are the sorted order of (tree, label, id). Rows are dealt by ranges of it; since the
    id belongs to it, a very common prefix is split over tasks, too. The first and last row of each
    task come to the driver, two for each task, to tie chains that run over its end.
    """
    flat = reps.select(F.posexplode("labels").alias("tree", "label"), "rep")
    ordered = flat.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    found = materialize(ordered.select("tree", "label", "rep").mapInArrow(_adjacent(kept, depth), EDGE), "forest")
    ends = sorted(
        (r.part, k, r.tree, r.label, r.a) for k, r in enumerate(found.where("part is not null").select("part", "tree", "label", "a").collect())
    )
    by_part: dict[int, list] = {}
    for part, _, tree, label, rep in ends:
        by_part.setdefault(part, []).append((tree, label, rep))
    across, before = [], None
    for part in sorted(by_part):
        first, last = min(by_part[part]), max(by_part[part])
        if before and before[0] == first[0] and (before[1] & _MASK) >> 8 * (depth - kept) == (first[1] & _MASK) >> 8 * (depth - kept):
            across.append((first[2], before[2]))
        before = last
    inside = found.where("part is null").select("a", "b")
    return inside.union(reps.sparkSession.createDataFrame(across, "a long, b long")) if across else inside


_MASK = (1 << 64) - 1


def _sets(width: int, wanted):
    """(digest, grams, set) of the documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = wanted.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(filter_.has(mix(ids.astype(np.int64).view(U64))) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(keep))
            for i, j, data, at in runs(some.column(1)):
                grams, begin = gram_sets(data, at, width)
                packed = [grams[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
                yield pa.RecordBatch.from_arrays(
                    [_digests(grams, begin), pa.array(np.diff(begin)), pa.array(packed, pa.binary())], ["digest", "grams", "set"]
                )

    return run


def id_filter(ids: DataFrame, segments: int = _bloom.SEGMENTS, max_bits: int = _bloom.MAX_BITS) -> _bloom.Segmented:
    """A Bloom filter of the ids in ``ids``' only column, of at most ``max_bits`` bits; built by segments."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = mix(np.asarray(batch.column(0)).astype(np.int64).view(U64))
            which = _bloom.segment_of(found, segments)
            names = np.unique(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), pa.array([found[which == k].tobytes() for k in names], pa.binary())], ["segment", "hashes"]
            )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        found = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        filter_ = np.zeros(_bloom.bits_for(len(found), segments, max_bits) // 8, np.uint8)
        _bloom.add(filter_, found)
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "hashes": [filter_.tobytes()]})

    rows = ids.mapInArrow(pack, "segment int, hashes binary").groupBy("segment").applyInPandas(build, "segment int, hashes binary").collect()
    return _bloom.Segmented({r.segment: bytes(r.hashes) for r in rows}, segments)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` x ``right``, by n-grams that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], gram[shared]
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    held = count[gram]
    rare = held <= RARE
    # Rare ones: every two places of a run of one n-gram, by their distance.
    o, g = owner[rare], gram[rare]
    for step in range(1, RARE):
        if step >= len(o):
            break
        same = g[step:] == g[:-step]
        x, y = o[step:][same], o[:-step][same]
        for p, q in ((x, y), (y, x)):
            use = (row[p] >= 0) & (column[q] >= 0)
            np.add.at(out, (row[p[use]], column[q[use]]), 1)
    # Others: products of 0/1 matrices, a block of n-grams at a time.
    o, g = owner[~rare], gram[~rare]
    if len(g):
        new = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
        block = max(1, (1 << 22) // len(sets))
        for start in range(0, int(new[-1]) + 1, block):
            a, b = np.searchsorted(new, [start, start + block])
            ones = np.zeros((len(sets), block), np.float32)
            ones[o[a:b], new[a:b] - start] = 1
            out += ones[left] @ ones[right].T
    return out


def _verify(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", kind="stable")
        ids, copies, side = (group[k].to_numpy() for k in ("rep", "copies", "right"))
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        within = group["lo"].iloc[0] == group["hi"].iloc[0]
        if within:
            right = left
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(left) and len(right):
            both = intersections(sets, left, right)
            x, y = np.nonzero(both / (size[left][:, None] + size[right][None] - both).astype(np.float64) >= threshold)
            if within:
                x, y = x[x < y], y[x < y]
            p, q = left[x], right[y]
            links += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
            label = local_components(len(ids), p, q)
        give_back()
        return pd.DataFrame({"rep": ids, "root": ids[label], "links": links})

    return run


def _tiles(members: DataFrame, threshold: float) -> DataFrame:
    """Deal each candidate to the tiles of its cluster; (cluster, lo, hi) names a tile.

    A cluster's documents are put in bands by size, such that only the same or the next band can
    reach the threshold, and a band is cut by hash into blocks of bounded size. Blocks are named
    band * 2^20 + number. A cluster that fits one block is one band.
    """
    total = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("grams").alias("all_grams"))
    band = F.floor(F.log(F.col("grams").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("long")
    small = (F.col("docs") <= TILE_DOCS) & (F.col("all_grams") <= TILE_GRAMS)
    banded = members.join(total, "cluster").withColumn("band", F.when(small, F.lit(0)).otherwise(band))
    blocks = banded.groupBy("cluster", "band").agg(
        F.ceil(F.greatest(F.count("*") / TILE_DOCS, F.sum("grams") / TILE_GRAMS)).cast("long").alias("blocks")
    )
    near = blocks.select(F.col("cluster").alias("c"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"), F.col("band").alias("other"), F.col("blocks").alias("others"))
    own = blocks.select("cluster", "band", "blocks")
    met = own.join(near, (F.col("cluster") == F.col("c")) & (F.col("band") == F.col("at"))).groupBy("cluster", "band", "blocks").agg(
        F.collect_list(F.struct("other", "others")).alias("met")
    )
    wide = 1 << 20
    dealt = banded.join(met, ["cluster", "band"]).withColumn("own", F.col("band") * wide + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.expr(f"explode(flatten(transform(met, m -> transform(sequence(0L, m.others - 1), i -> m.other * {wide} + i))))")
    return dealt.select("cluster", "rep", "digest", "grams", "copies", "own", other.alias("with")).select(
        "cluster", "rep", "digest", "grams", "copies", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") > F.col("with")).alias("right")
    )


def _classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_md5, links, first) of every row; ``first`` is (doc_id, text_md5, node) of its class's first row, null without links."""
    spark = docs.sparkSession
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A row is a node of the graphs by a number of its own, so that ids may repeat.
    signed = materialize(source.select("*", F.md5("text").alias("text_md5")).mapInArrow(_sign(width, trees, depth), SIGNED).withColumn("node", F.monotonically_increasing_id()), "signed")
    classes = materialize(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest", "grams")
        .agg(F.min("node").alias("rep"), F.min(F.struct("doc_id", "text_md5", "node")).alias("low"), F.count("*").alias("copies"), F.first("labels").alias("labels")),
        "classes",
    )
    clusters = connected_components(forest_edges(classes.select("rep", "labels"), prefix_depth(threshold, trees, depth, recall), depth))
    members = materialize(
        classes.join(clusters, F.col("rep") == F.col("node")).select("rep", "low", "digest", "grams", "copies", F.col("component").alias("cluster")),
        "members",
    )
    wanted = spark.sparkContext.broadcast(id_filter(members.select("low.doc_id")))
    sets = source.mapInArrow(_sets(width, wanted), "digest binary, grams long, set binary").dropDuplicates(["digest", "grams"])
    tiles = _tiles(members, threshold).join(sets, ["digest", "grams"])
    checked = materialize(tiles.groupBy("cluster", "lo", "hi").applyInPandas(_verify(threshold), "rep long, root long, links long"), "checked")
    components = connected_components(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    tied = materialize(classes.join(components, F.col("rep") == F.col("node")).select("rep", "low", "component"), "tied")
    lowest = tied.groupBy("component").agg(F.min("low").alias("class"))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = materialize(
        classes.select("digest", "grams", "rep", "low", "copies")
        .join(links, "rep", "left")
        .join(tied.join(lowest, "component").select("rep", "class"), "rep", "left")
        .select(
            F.col("digest").alias("d"), F.col("grams").alias("g"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class", "low").alias("first"),
        ),
        "known",
    )
    lookup = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    return (
        signed.select("doc_id", "text_md5", "node", lookup.alias("digest"), "grams")
        .join(known, (F.col("digest") == F.col("d")) & (F.col("grams") == F.col("g")), "left")
        .select("doc_id", "text_md5", "node", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "first")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_links, class_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-space characters, A-Z lower-cased. Two rows link if the Jaccard value of
    their sets of ``width`` successive words is at least ``threshold``; a text of fewer words, but
    some, has one n-gram, all of it. Texts that are null, empty or blank, and rows with a null id,
    link with nothing. n_links counts the other rows linked, copies included; class_id is the
    smallest id reachable by links (null for a null id), kept tells if that is the row's own.

    Rows with one id are separate rows. Documents with equal sets become one class with a count, so a group of copies is one row from
    there on. Classes that share a prefix in the forest are candidates: prefixes are shortened until
    a pair at the threshold is found with chance ``recall``. Candidates that hang together form a
    cluster, whose members all meet in tiles of bounded size, where intersections are counted
    exactly. A tile returns a row per document, its links counted and its ties as a tree, so no
    list of pairs is ever made, and no pair of a tile is left out.
    """
    class_id = F.coalesce("first.doc_id", "doc_id")
    return _classes(docs, threshold, width, trees, depth, recall).select(
        "doc_id", F.col("links").alias("n_links"), class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(False)).alias("kept")
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group of near duplicates; see ``near_duplicates``.

    The row with the smallest id stays, of several with it the one whose text has the smallest MD5,
    of equal ones any. Rows are told apart by id and text, so a row is not lost to another of its id.
    Rows that link with nothing (see there) all stay.
    """
    found = _classes(docs, threshold, width, trees, depth, recall)
    stays = F.col("first").isNull() | (F.col("first.node") == F.col("node"))
    marked = found.groupBy(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5")).agg(
        F.count("*").alias("rows"), F.count_if(stays).alias("left")
    ).where("left < rows and id is not null")
    marked = materialize(marked.select("id", "md5", "left"), "duplicates")
    # The columns travel in a struct, so that their names meet no others.
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).select(F.struct(*names).alias("given"), doc_id.cast("long").alias("doc_id"), F.md5(text).alias("text_md5"))
    same = (F.col("doc_id") == F.col("id")) & (F.col("text_md5") == F.col("md5"))
    kept = rows.join(marked, same, "left_anti").select("given")
    if not (twins := marked.where("left > 0")).isEmpty():
        one = rows.join(twins, same, "left_semi").groupBy("doc_id", "text_md5").agg(F.first("given").alias("given"))
        kept = kept.unionAll(one.select("given"))
    return kept.select(*(F.col(f"given.{name}") for name in names)).toDF(*docs.columns)
