"""Every stage of the pipeline against a brute-force version of it."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from basketry.llm import oracle, piece_codec
from basketry.llm._pieces import SPACE
from tests.llm.test_parts import find_roots
from tests.llm.test_texts import lines_of, near_pairs, sentence, toxic_corpus

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def corpus():
    rng = random.Random(12)
    rows, labels = toxic_corpus()
    shared = sentence(rng, 60)
    rows += [(1000 + i, f"{sentence(rng, 30)}\n{shared}\n{sentence(rng, 30)}") for i in range(30)]
    near = sentence(rng, 90, 5000).split()
    rows += [(2000 + i, " ".join(near[:40] + [f"x{i}"] + near[41:])) for i in range(12)]
    rows += [(3000 + i, x) for i, x in enumerate([None, "", " ", "\n\n", "é" * 300, "w " * 4000])] + [(None, sentence(rng, 20))] * 2
    return [(i, x, "en", f"src{rng.choice([0, 0, 0, 1, 2])}" if i != 1000 else None, len(x or "")) for i, x in rows], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given and what it returns."""
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, str(folder))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        kept.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_stages_are_in_order(stages):
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mix_sources", "piece_codec"]


def test_toxic_documents_go_and_others_stay(stages):
    before, after = stages["toxicity"]
    left = Counter(r.doc_id for r in after)
    bad = {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0}
    assert sum(left[i] for i in bad) <= 0.05 * len(bad)
    clean = [r for r in before if r.doc_id not in bad]
    assert sum((Counter(map(repr, clean)) & Counter(map(repr, after))).values()) >= 0.98 * len(clean)


def test_lines_go(stages):
    before, after = stages["line_dedup"]
    want = lines_of([(r.doc_id, r.text) for r in before])
    got = [(r.doc_id, (r.text or "").count("\n") + 1) for r in after]
    assert Counter(i for i, _ in got) == Counter(w[0] for w in want)
    import hashlib

    digests = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in after)
    assert digests == Counter((w[0], w[3]) for w in want)
    assert all(r.n_chars == len(r.text or "") for r in after)


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_join"]
    rows = [(r.doc_id, r.text) for r in before]
    root = find_roots([(rows[a][0], rows[b][0]) for a, b in near_pairs(rows)])
    want = Counter(repr(r) for r in before if root.get(r.doc_id, r.doc_id) == r.doc_id)
    assert Counter(map(repr, after)) == want


def test_mix(stages):
    before, after = stages["mix_sources"]
    connection = duckdb.connect()
    connection.register("documents", pa.table({k: [r[k] for r in before] for k in ("doc_id", "text", "source")}))
    copies = Counter()
    for i, n in connection.sql(f"SELECT doc_id, copies FROM ({oracle.ORACLE['op5_source_mix']})").fetchall():
        copies[i] += n
    assert Counter(r.doc_id for r in after) == +copies


def test_ids_decode_to_the_texts(stages):
    before, after = stages["piece_codec"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    texts = Counter((r.doc_id, (r.text or "").replace(SPACE, " ")) for r in before)
    import numpy as np

    got = Counter()
    for r in after:
        assert r.n_tokens == len(r.ids)
        text, = piece_codec.decode_run(np.array(r.ids, np.int64), np.array([0, len(r.ids)]))
        got[r.doc_id, text] += 1
    assert got == texts


def test_rows_of_one_id(spark):
    rng = random.Random(3)
    near = sentence(rng, 90, 5000)
    other = sentence(rng, 90, 5000)
    rows = [(1, near), (5, near + " x"), (5, other), (9, other), (9, other), (9, other + " y"), (None, near), (None, near), (7, ""), (7, ""), (8, sentence(rng, 50, 5000))]
    rows += [(20, sentence(random.Random(4), 60, 5000))] * 3
    docs = spark.createDataFrame([(i, x, "en", f"s{k}", len(x)) for k, (i, x) in enumerate(rows)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    want = [(1, near), (5, other), (0, near), (0, near), (7, ""), (7, ""), (8, rows[10][1]), (20, rows[-1][1])]
    assert got == sorted(want)
