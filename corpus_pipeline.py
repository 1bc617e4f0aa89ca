"""Clean, de-duplicate, mix and encode the documents: each stage applies one operator to all that is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import line_dedup, mixing, ngram_join, piece_codec, toxicity
from basketry.llm._order import pick, plain
from basketry.llm._ship import ship
from basketry.llm._text import crc_bucket
from basketry.session import materialize


# Rows that pass to a Python worker at a time; with whole texts this bounds its memory and the JVM's buffers.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> None:
    """Send the package to the executors, and let texts travel in small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from all labels but those of the held-out fold."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = toxicity.train(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, field).where("__score < 0.5").drop("__score", "__spans")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; every document stays, ``n_chars`` follows its text."""
    ready(spark)
    docs, names = plain(docs, ("doc_id", "text", "n_chars"), ("__n_lines", "__n_dropped"))
    kept = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("__n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(docs.columns).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, of the smallest id; rows without an id stay."""
    ready(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): every document as piece ids."""
    ready(spark)
    encoded = piece_codec.encode(pick(docs, "doc_id", "source", "text"))
    return encoded.select("doc_id", "source", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("piece_codec", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written and read again as the next one's input."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained stage has no SQL form; the tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None
