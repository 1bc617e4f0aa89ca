"""Merkle manifest of a data set: a tree per group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm._order import pick, placed
from basketry.session import materialize

# Nodes of a run: every so many successive nodes have one parent.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its bytes' number, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, start, lambda node, step: digest(step.left, node, step.right))


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, width, run, hash): parents of nodes (tree, pos, width, node struct with ``at`` and ``hash``)."""
    above = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(
        F.first("width").alias("width"), F.sort_array(F.collect_list("node")).alias("run")
    )
    return above.withColumn("hash", F.sha2(F.array_join("run.hash", ""), 256))


def _step(run: Column, i: Column) -> Column:
    """The siblings of the node at place ``i`` of its run, left and right of it."""
    hashes = run.hash
    return F.struct(
        F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
        F.array_join(F.slice(hashes, i + 2, F.greatest(F.size(hashes) - i - 1, F.lit(0))), "").alias("right"),
    )


def _climb(nodes: DataFrame, widest: int, fanout: int, level: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Build trees upwards from nodes (id, tree, pos, width, height, hash) until each has one node left.

    Returns the links (id, up, height, step), the tops (id, tree, height, hash) and the levels built.
    Each level is written, a run of ``fanout`` nodes is one row of it.
    """
    links, tops, built = [], [], 0
    while True:
        tops.append(nodes.where("width = 1").select("id", "tree", "height", "hash"))
        if widest <= 1:
            return links, reduce(DataFrame.unionAll, tops), built
        built += 1
        level += 1
        node = F.struct(F.col("pos").alias("at"), "hash", "id", "height").alias("node")
        runs = _runs(nodes.where("width > 1").select("tree", "pos", "width", node), fanout)
        name = F.concat_ws("/", F.col("tree").cast("string"), F.lit(str(level)), F.col("pos").cast("string"))
        runs = materialize(runs.select("*", name.alias("id")), "merkle-level")
        each = runs.select("run", F.col("id").alias("up"), F.posexplode("run").alias("i", "node"))
        links.append(each.select("node.id", "up", "node.height", _step(F.col("run"), F.col("i")).alias("step")))
        width = F.ceil(F.col("width") / fanout).cast("long")
        nodes = runs.select("id", "tree", "pos", width.alias("width"), F.lit(level).alias("height"), "hash")
        widest = -(-widest // fanout)


def paths(links: DataFrame, root: str) -> DataFrame:
    """(id, path): the siblings on the way from every node below ``root`` up to it.

    Pointer jumping: a row points to an ancestor and holds the siblings up to it. Every round joins
    the rows with the rows they point to, which doubles the distance. Rows that reached the root
    leave the join, and only nodes high enough to be pointed to are looked at, a share of them that
    falls with fanout to the distance; so the rounds are logarithmic in the height, a frequent key
    occurs only where the other side is small enough for Spark to broadcast it, and every round is
    written.
    """
    up = F.when(F.col("up") != root, F.col("up"))
    now = materialize(links.select("id", up.alias("up"), "height", F.array("step").alias("path")), "merkle-paths")
    done, reach = [now.where("up is null")], 1
    now = now.where("up is not null")
    while not now.isEmpty():
        every = reduce(DataFrame.unionAll, [*done, now]).where(F.col("height") > reach)
        ahead = every.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("rest"))
        joined = now.join(ahead, "up").select("id", F.col("next").alias("up"), "height", F.concat("path", "rest").alias("path"))
        joined = materialize(joined, "merkle-paths")
        done.append(joined.where("up is null"))
        now = joined.where("up is not null")
        reach *= 2
    return reduce(DataFrame.unionAll, done).select("id", "path")


def proved_runs(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, str]:
    """Runs (run, hash, alone, subroot, path) of successive leaves, and the root; see ``manifest``.

    ``run`` holds the leaves' structs (at, hash, doc_id, kept), ``hash`` is their parent's digest, or
    the lone leaf's if it is ``alone`` in its language, ``path`` are the siblings from there on.
    """
    spark = leaves.sparkSession
    rows = materialize(leaves.select("doc_id", "lang", "leaf", "kept", F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "leaf")]
    rows = placed(rows, [*order, "row"], "merkle-order")
    groups = rows.groupBy("lang").agg(F.min("place").alias("start"), F.count("*").alias("width"))
    groups = materialize(placed(groups, ["start"], "merkle-groups").withColumnRenamed("place", "tree"), "merkle-groups")
    trees, widest = groups.agg(F.count("*"), F.max("width")).first()
    named = groups.select(F.col("lang").alias("of"), "start", "width", "tree")
    node = F.struct(F.col("place").alias("at"), F.col("leaf").alias("hash"), "doc_id", "kept").alias("node")
    low = _runs(
        rows.join(named, F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("place") - F.col("start")).alias("pos"), "width", node), fanout
    )
    alone = F.col("width") == 1
    first = F.when(alone, F.col("run")[0].hash).otherwise(F.col("hash"))
    name = F.concat_ws("/", F.col("tree").cast("string"), F.lit("1"), F.col("pos").cast("string"))
    low = materialize(low.withColumn("hash", first).withColumn("id", name), "merkle-runs")
    wide = F.ceil(F.col("width") / fanout).cast("long")
    bottom = low.select("id", "tree", "pos", wide.alias("width"), F.lit(1).alias("height"), "hash")
    links, tops, built = _climb(bottom, -(-(widest or 0) // fanout), fanout, 1)
    tops = materialize(tops, "merkle-subroots")
    # The tree over the languages: its lowest nodes are the subroots.
    over = tops.select("id", F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("width"), "height", "hash")
    more, top, _ = _climb(over, trees, fanout, 1 + built)
    found = top.first()
    root, root_id = (found.hash, found.id) if found else ("", "")
    links += more
    proofs = paths(reduce(DataFrame.unionAll, links), root_id) if links else spark.createDataFrame([], f"id string, path {PROOF}")
    subroots = tops.select("tree", F.col("hash").alias("subroot"))
    path = F.coalesce("path", F.array().cast(PROOF)).alias("path")
    return low.join(proofs, "id", "left").join(subroots, "tree").select("run", "hash", alone.alias("alone"), "subroot", path), root


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, kept, subroot, root, proof) for every row of ``leaves`` (doc_id, lang, leaf, kept).

    A language's leaves ascend by doc_id (null first), equal ids by their digests. While there are
    several nodes, each run of ``fanout`` successive ones becomes the digest of its hex digests; the
    one left is the language's subroot, a lone leaf its own. Subroots, by language (null first, by
    bytes), lead to the root in the same way. ``proof`` lists, level by level, the digests left and
    right of the node in its run; ``fold`` leads back to the root. ``kept`` is any column that comes
    along. An empty table gives no rows.

    Places come from a range shuffle that splits a large language, id or group of equal rows. The
    rows of a run are one row, so that trees and proofs are worked out for an eighth of the rows;
    the leaves meet their run's proof last.
    """
    runs, root = proved_runs(leaves, fanout)
    each = runs.select("*", F.posexplode("run").alias("i", "node"))
    own = F.when(F.col("alone"), F.array().cast(PROOF)).otherwise(F.array(_step(F.col("run"), F.col("i"))).cast(PROOF))
    return each.select(
        "node.doc_id", F.col("node.hash").alias("leaf"), "node.kept", "subroot", F.lit(root).alias("root"), F.concat(own, "path").alias("proof")
    )


def manifest_report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, and whether a copy that was tampered with passes.

    Uses doc_id, source, lang, n_chars and text, found by exact name; others are ignored. Any may be
    null. The copy of a row whose id's CRC-32 is a multiple of three has its text's A-Z lower-cased
    (a null id or text leaves it as it is). Equal rows are separate leaves. ``folded_root`` is worked
    out from the copy's leaf and the original's proof, ``verified`` tells if it is the root.
    """
    fields = [F.col(name) for name in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(hit, leaf(*fields[:-1], F.translate("text", UPPER, LOWER)))
    runs, root = proved_runs(pick(docs, *FIELDS).select("doc_id", "lang", leaf(*fields).alias("leaf"), other.alias("kept")), fanout)
    # What the leaves of a run have in common is worked out once.
    rest = F.array_join(F.transform("path", lambda step: F.concat(step.left, step.right)), "")
    shared = runs.select("*", rest.alias("rest"), fold(F.col("hash"), F.col("path")).alias("base"))
    each = shared.select("*", F.posexplode("run").alias("i", "node"))
    each = each.select("*", F.when(~F.col("alone"), _step(F.col("run"), F.col("i"))).alias("own"))
    left, right = (F.coalesce(f"own.{side}", F.lit("")) for side in ("left", "right"))
    copy = F.coalesce("node.kept", "node.hash")
    parent = F.when(F.col("alone"), copy).otherwise(digest(left, copy, right))
    folded = F.when(F.col("parent") == F.col("hash"), F.col("base")).otherwise(fold(F.col("parent"), F.col("path")))
    return each.select("*", parent.alias("parent")).select(
        "node.doc_id", F.col("node.hash").alias("leaf"), "subroot", F.lit(root).alias("root"),
        digest(left, right, F.col("rest")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"),
    )
