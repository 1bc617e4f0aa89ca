"""Trie of the prefixes that conversations share, found by digests of blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm._order import pick, placed
from basketry.session import materialize

# Turns of a block; blocks of a run in which prefixes are chained.
BLOCK, RUN = 4, 16
# Bytes of a piece of a long list of ids.
PIECE = 16384
# Fixed values of the report: conversations of a hundred borrow up to five turns from the first.
HUNDRED, BORROWED = 100, 5
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _root() -> Column:
    return F.lit(bytearray(32))


def _joined(items: Column) -> Column:
    return F.aggregate(items, F.lit(bytearray()), lambda all_, x: F.concat(all_, x.digest))


def _chain(start: Column, items: Column) -> Column:
    """Digests of the prefixes of ``items``, from the empty one (``start``) to the whole."""
    return F.aggregate(
        items, F.array(start).cast("array<binary>"), lambda done, x: F.concat(done, F.array(digest(F.element_at(done, -1), x.digest)))
    )


def chained(items: DataFrame, last: int, run: int = RUN) -> DataFrame:
    """(conv_id, j, start, end, load): digests of all items before item ``j``, and up to it.

    ``items`` is (conv_id, j, digest, load), j from 0 to ``last`` at most. Items are put into runs of
    ``run``, runs into runs of runs; the prefix before a run is settled first, then those inside it.
    So a long conversation is cut into groups of bounded size, in a number of steps logarithmic in
    its length. Two conversations have the same digest if and only if the items so far are equal.
    """
    item = F.struct("j", "digest", "load")
    runs = items.groupBy("conv_id", F.floor(F.col("j") / run).cast("long").alias("at")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    runs = runs.withColumn("whole", digest(_joined(F.col("items"))))
    if last < run:
        runs = runs.select("*", _root().alias("start"), digest(_root(), F.col("whole")).alias("end"))
    else:
        runs = materialize(runs, "trie-runs")
        above = chained(runs.select("conv_id", F.col("at").alias("j"), F.col("whole").alias("digest"), F.lit(0).alias("load")), last // run, run)
        runs = runs.join(above.select("conv_id", F.col("j").alias("at"), "start", "end"), ["conv_id", "at"])
    steps = runs.select("conv_id", "end", _chain(F.col("start"), F.col("items")).alias("steps"), F.posexplode("items").alias("i", "item"))
    end = F.when(F.col("i") == run - 1, F.col("end")).otherwise(F.col("steps")[F.col("i") + 1])
    return steps.select("conv_id", "item.j", F.col("steps")[F.col("i")].alias("start"), end.alias("end"), "item.load")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, id) rows: each key's ids as text, or its SHA-256 if the key is surely complete.

    A key's rows may go on in the partitions before and behind, so the first and the last one, and
    those whose text is longer than a piece, leave as pieces.
    """
    part, seq, first = TaskContext.get().partitionId(), 0, True
    key, texts, size, cut = None, [], 0, False
    out: list[tuple] = []

    def flush() -> None:
        nonlocal texts, size, seq
        out.append((key, part, seq, ",".join(texts), None))
        texts, size, seq = [], 0, seq + 1

    def batch_of() -> pa.RecordBatch:
        types = [pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "part", "seq", "ids", "sha"])

    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), np.asarray(batch.column(1)).astype(str).tolist()
        for k, i in zip(keys, ids):
            if k != key:
                if key is not None and (first or cut):
                    if texts:
                        flush()
                    first = False
                elif key is not None:
                    out.append((key, None, None, None, hashlib.sha256(",".join(texts).encode()).hexdigest()))
                key, texts, size, cut = k, [], 0, False
            texts.append(i)
            size += len(i) + 1
            if size >= PIECE:
                flush()
                cut = True
        if out:
            yield batch_of()
    if texts:
        flush()
    if out:
        yield batch_of()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha"])


def id_lists(rows: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of each key's ids (binary ``key``, long ``id``), ascending, comma-joined.

    Ids are sorted by ranges of (key, id), so the ids of a frequent key are put together by several
    tasks. A digest of one text can only be computed from front to back; for the few keys that span
    partitions a task reads the texts' pieces in turn and holds one of them.
    """
    sorted_ = rows.select("key", "id").orderBy("key", "id")
    found = materialize(sorted_.mapInArrow(_pieces, "key binary, part int, seq long, ids string, sha string"), "trie-ends")
    pieces = found.where("sha is null").repartition("key").sortWithinPartitions("key", "part", "seq")
    rest = pieces.select("key", "ids").mapInArrow(_hash_pieces, "key binary, sha string")
    return found.where("sha is not null").select("key", "sha").unionAll(rest)


def _nodes(turns: DataFrame, members: DataFrame, block: int, run: int) -> DataFrame:
    """(id, key, parent, depth, n_convs, conv_id, chars, ends) of every node, the root included."""
    turn = F.struct("at", "digest", "chars")
    blocks = turns.groupBy("conv_id", F.floor(F.col("at") / block).cast("long").alias("j")).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    ends = F.col("j") * block + F.size("turns") == F.col("total")
    load = F.struct("turns", ends.alias("ends")).alias("load")
    last = members.agg(F.max("total")).first()[0]
    keyed = chained(blocks.select("conv_id", "j", digest(_joined(F.col("turns"))).alias("digest"), load), max((last or 1) - 1, 0) // block, run)
    keyed = materialize(keyed.select("conv_id", "j", "start", "end", "load.turns", "load.ends"), "trie-blocks")
    # Conversations that agree up to the end of a block are one row from here on.
    distinct = keyed.groupBy("end").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("start").alias("start"), F.first("j").alias("j"), F.first("turns").alias("turns")
    )
    distinct = materialize(distinct, "trie-distinct")
    sole = distinct.groupBy("start").agg(F.count("*").alias("c"), F.first("end").alias("sole")).where("c = 1").select("sole")
    over = members.where("total = 0").select(_root().alias("key"), F.col("conv_id").alias("id"))
    lists = materialize(id_lists(keyed.where("ends").select(F.col("end").alias("key"), F.col("conv_id").alias("id")).unionAll(over)), "trie-lists")
    marked = distinct.join(sole, F.col("end") == F.col("sole"), "left").join(lists, F.col("end") == F.col("key"), "left")
    i, size = F.col("i"), F.size("turns")
    common = [
        (F.col("j") * block + i + 1).alias("depth"), "n", "low", F.col("turn.chars").alias("chars"), F.when(i == size - 1, F.col("sha")).alias("ends")
    ]
    # Without a sibling, a block's turns have one and the same members: their keys are made up.
    inner = F.col("end"), F.encode(i.cast("string"), "utf-8"), F.encode((i - 1).cast("string"), "utf-8")
    straight = marked.where("sole is not null").select("*", F.posexplode("turns").alias("i", "turn")).select(
        F.when(i == size - 1, F.col("end")).otherwise(F.concat(inner[0], inner[1])).alias("key"),
        F.when(i == 0, F.col("start")).otherwise(F.concat(inner[0], inner[2])).alias("parent"), *common,
    )
    # Where blocks diverge, their turns are chained, and those that begin alike are put together.
    diverging = marked.where("sole is null").withColumn("steps", _chain(F.col("start"), F.col("turns")))
    refined = diverging.select("*", F.posexplode("turns").alias("i", "turn")).select(
        F.when(i == block - 1, F.col("end")).otherwise(F.col("steps")[i + 1]).alias("key"), F.col("steps")[i].alias("parent"), *common
    )
    refined = refined.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("low").alias("low"),
        F.first("chars").alias("chars"), F.max("ends").alias("ends"),
    )
    turnless = lists.where(F.col("key") == _root()).first()
    top = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).where("n > 0").select(
        _root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n", "low", F.lit(0).alias("chars"),
        F.lit(turnless.sha if turnless else None).cast("string").alias("ends"),
    )
    every = straight.unionByName(refined).unionByName(top)
    return materialize(every.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")


def _subtree_sums(nodes: DataFrame, *weights: str) -> DataFrame:
    """(id, *weights): what the nodes below each node add up to; nodes (id, up, *weights), up null at the root.

    A node's sum grows by the sums of those 1, 2, 4, ... levels below, pointers jump as far, and only
    nodes that deep take part; so there are as many rounds as the depth has binary digits, and a node
    with very many below it gets a sum combined before the shuffle.
    """
    active = nodes.where("up is not null").select("id", "up", *weights)
    added = []
    while not active.isEmpty():
        add = active.groupBy(F.col("up").alias("id")).agg(*(F.sum(w).alias(w) for w in weights))
        added.append(materialize(add, "trie-sums"))
        grown = added[-1].select("id", *(F.col(w).alias(f"more_{w}") for w in weights))
        ahead = active.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jumped = active.join(ahead, "up").join(grown, "id", "left")
        active = materialize(
            jumped.select("id", F.col("next").alias("up"), *((F.col(w) + F.coalesce(f"more_{w}", F.lit(0))).alias(w) for w in weights)), "trie-active"
        )
    if not added:
        return nodes.select("id", *weights).limit(0)
    return reduce(DataFrame.unionAll, added).groupBy("id").agg(*(F.sum(w).alias(w) for w in weights))


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``members`` is (conv_id, total) and has every conversation once; ``turns`` is (conv_id, at, total,
    digest, chars) with at from 0 to total - 1. A node is a distinct sequence of first turns, the root
    that of none; conversations with equal turns so far are its members, conv_id the least of them.

    Conversations are first put together by the digests of whole blocks of turns and of the prefix
    before; a block's turns are looked at only where blocks diverge behind the same prefix. No loop
    runs over depths: prefixes are chained in runs, subtrees added up by pointer jumping.
    """
    nodes = _nodes(turns, members, block, run)
    top = nodes.where("depth = 0").first()
    if top is None:
        tied = nodes.select("id", F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("above"))
    else:
        # The children of the root, of which there may be very many, need no join.
        tied = nodes.where("depth = 1").select("id", F.lit(top.id).alias("up"), F.lit(top.low).alias("above"))
        named = nodes.select(F.col("key").alias("parent"), F.col("id").alias("up"), F.col("low").alias("above"))
        tied = tied.unionAll(nodes.where("depth > 1").select("id", "parent").join(named, "parent").select("id", "up", "above"))
    tied = materialize(tied, "trie-parents")
    children = tied.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    childless = F.col("n_children").isNull()
    full = nodes.drop("key", "parent").join(tied, "id", "left").join(children, "id", "left").select(
        "id", "up", "above", "depth", "n", "low", "ends", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        childless.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    full = materialize(full, "trie")
    below = _subtree_sums(full, "leaves", "saved").select("id", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    total = {w: F.col(w) + F.coalesce(f"more_{w}", F.lit(0)) for w in ("leaves", "saved")}
    return full.join(below, "id", "left").select(
        F.col("low").alias("conv_id"), F.col("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        total["leaves"].alias("n_leaves"), total["saved"].alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): turns in the order of conversation, turn (null first) and content."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("digest"), F.char_length(text).alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    return placed(materialize(rows, "trie-turns"), order, "trie-order").select("conv_id", "place", "digest", "chars")


def borrowed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members for ``prefix_trie``: each conversation's first turns are another's.

    The first h turns of conversation c - c % 100 (all if it has fewer, none if it is not there), then
    its own behind its first h; h is the CRC-32 of the decimal id modulo 6.
    """
    own = turns.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (BORROWED + 1)).cast("int")
    own = materialize(own.withColumn("h", h), "trie-members")
    lenders = own.where(F.col("conv_id") % HUNDRED == 0).select("conv_id", "start")
    at = F.col("place") - F.col("start")
    heads = turns.join(lenders, "conv_id").where(at < BORROWED).groupBy(F.col("conv_id").alias("lender")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")
    )
    lent = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(array(struct(0L as place, cast('' as binary) as digest, 0 as chars)), 1, 0)"))
    full = own.join(heads, F.col("conv_id") - F.col("conv_id") % HUNDRED == F.col("lender"), "left").withColumn("lent", lent)
    total = F.size("lent") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    full = materialize(full.select("conv_id", "start", "h", "lent", total.cast("long").alias("total")), "trie-members")
    first = full.select("conv_id", "total", F.posexplode("lent").alias("i", "t")).select(
        "conv_id", F.col("i").cast("long").alias("at"), "total", "t.digest", "t.chars"
    )
    rest = turns.join(full.where("total > 0"), "conv_id").where(at >= F.col("h")).select(
        "conv_id", (at - F.col("h") + F.size("lent")).alias("at"), "total", "digest", "chars"
    )
    return first.unionAll(rest), full.select("conv_id", "total")


def trie_report(conversations: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text) with borrowed first turns.

    Columns are found by exact name, others ignored. Null roles and texts count as empty; a null turn
    is first; turns with one number follow by their content's digest, equal ones are separate turns.
    Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root.
    """
    return prefix_trie(*borrowed(ordered_turns(conversations)), block, run)
