"""Mix documents of many sources to target weights, by hash thresholds and without sorting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm._order import pick, placed
from basketry.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"
# Fixed values of the mix: weights given to the sources in turn, and the most repeats of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
# A draw has 60 bits; every round of histograms looks at the next 12 of them.
DRAW_BITS, STEP_BITS = 60, 12


def _bits(text):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def draw(doc_id, text):
    """A document's place on the line that thresholds cut: 60 bits of an MD5 of its id and text."""
    return _bits(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _again(docs: DataFrame) -> DataFrame:
    """(s, d): sources and draws that several rows have, as rows of one id and text do."""
    return docs.groupBy(F.col("source").alias("s"), F.col("draw").alias("d")).agg(F.count("*").alias("n")).where("n > 1").select("s", "d")


def _told_apart(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` with a draw of its own for every row: equal rows are numbered, which splits a large group of them.

    Which of equal rows has which number does not matter, so that reruns agree.
    """
    if again.isEmpty():
        return docs
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d"))
    alone = docs.join(again, same, "left_anti")
    rows = materialize(docs.join(again, same, "left_semi").select("*", F.monotonically_increasing_id().alias("row__")), "mix-equal")
    rows = placed(rows, ["source", "draw", "row__"], "mix-equal")
    firsts = rows.groupBy(F.col("source").alias("s"), F.col("draw").alias("d")).agg(F.min("place").alias("first__"))
    number = F.col("place") - F.col("first__")
    own = F.when(number > 0, _bits(F.concat_ws("/", F.col("draw").cast("string"), number.cast("string")))).otherwise(F.col("draw"))
    return alone.unionByName(rows.join(firsts, same).withColumn("draw", own).select(*docs.columns))


def sized(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size in words, draw) of every document, and the draws that rows have in common."""
    found = pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        draw(F.col("doc_id"), F.col("text")).alias("draw"),
    )
    found = materialize(found, "words")
    again = materialize(_again(found), "mix-again")
    return _told_apart(found, again), again


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, the number of sources before this one; null is last.

    The order is made by a range shuffle: a row's place is its place in its partition plus the
    sizes of the partitions before, of which there are few.
    """
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), in_part.alias("nth")),
        "sources",
    )
    before, offset = [], 0
    for part, rows in sorted(placed.groupBy("part").count().collect()):
        before.append((part, offset))
        offset += rows
    starts = sources.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(starts, "part").select("source", "source_size", (F.col("before") + F.col("nth")).alias("place"))


def source_targets(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight of all words, none above ``most`` times its source.

    A target is ``level * weight`` for one level common to all, unless that is above the source's
    bound. The level rises with every bound met, so it is found in a few sums over the sources.
    """
    sources = _ranked(words.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(sources.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    bound = most * F.col("source_size")
    level = -1.0
    while True:
        full = (bound < level * F.col("weight")) if level >= 0 else F.lit(False)
        left, share = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(full, bound)), F.lit(0)),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        risen = max(left, 0) / share if share else 0.0
        if risen <= level:
            break
        level = risen
    full = bound < level * F.col("weight")
    return sources.select(
        "source", "source_size", F.when(full, bound.cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target")
    )


def thresholds(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): each document is taken ``whole`` times, once more if draw <= cut.

    Words are summed by source and the leading bits of the draw; the bucket in which a source's
    remaining budget ends is opened alone, by the next bits, until it holds one draw. That draw is
    taken if this comes closer to the budget. A source never has more than 4096 sums at a time.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = targets.select("*", whole.alias("whole")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    # open: leading bits of the bucket where the budget ends; lo, hi: its draws; below: words of all draws before it.
    narrow = words.select(F.col("source").alias("s"), "size", "draw")
    state = materialize(
        plan.select("*", *(F.lit(v).cast("long").alias(k) for k, v in (("open", 0), ("below", 0), ("inside", 0), ("lo", 0), ("hi", 1)))),
        "thresholds",
    )
    for rest in range(DRAW_BITS, 0, -STEP_BITS):
        refined = state.where("lo < hi").select("source", "left", "open", "below")
        within = narrow.join(refined, F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("draw", rest) == F.col("open")))
        sums = within.groupBy("source", F.shiftright("draw", rest - STEP_BITS).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("draw").alias("lo"), F.max("draw").alias("hi"),
            F.first("left").alias("left"), F.first("below").alias("below"),
        )
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            sums.withColumn("upto", F.col("below") + F.sum("words").over(order))
            .where("upto > left")
            .groupBy(F.col("source").alias("s"))
            .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "words", "lo", "hi"), "bucket").alias("end"))
        )
        settled = state.where("lo is null or lo >= hi")
        opened = state.where("lo < hi").join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole", "left", "end.bucket", "end.below", "end.words", "end.lo", "end.hi"
        )
        state = materialize(settled.union(opened), "thresholds")
        if state.where("lo < hi").isEmpty():
            break
    closer = (F.col("below") + F.col("inside") - F.col("left")) < (F.col("left") - F.col("below"))
    cut = F.when(F.col("lo").isNull(), F.lit(-1)).when(closer, F.col("lo")).otherwise(F.col("lo") - 1)
    return state.select("source", "source_size", "target", "whole", cut.cast("long").alias("cut"))


def mix_plan(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its target and what is taken of it; small, written to the shared folder."""
    return materialize(thresholds(words, source_targets(words, weights, most)), "mix")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs``.

    ``docs`` has doc_id, text and source, found by exact name; other columns are ignored. A null or
    empty text has size 0 and is taken 0 words, whatever its copies. A null source is a source of its
    own, the last. The draw depends on the id (which may be null), the text and the number among
    equal rows, so every row has one of its own and reruns agree. An empty table gives an empty result.
    """
    words = materialize(sized(docs)[0], "words")
    plan = mix_plan(words, weights, most).withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("int")
    return words.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; see ``mix``."""
    words, again = sized(docs)
    plan = mix_plan(materialize(words, "words"), weights, most).select(F.col("source").alias("s"), "whole", "cut")
    # The columns travel in a struct, so that their names meet no others.
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text, source = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source"))
    rows = docs.toDF(*names).select(F.struct(*names).alias("given"), source.alias("source"), draw(doc_id, text).alias("draw"))
    copies = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("int")
    taken = _told_apart(rows, again).join(plan, F.col("source").eqNullSafe(F.col("s"))).select("given", F.explode(F.array_repeat(F.lit(1), copies)))
    return taken.select(*(F.col(f"given.{name}") for name in names)).toDF(*docs.columns)
