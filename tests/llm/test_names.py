"""Columns whose names clash with an operator's own, or hold odd characters, change no result."""

import pytest

import corpus_pipeline
from basketry.llm import language, licenses, line_dedup, lm, mixing, ngram_join, piece_codec, toxicity
from tests.llm.test_texts import documents, toxic_corpus

OWN = ("__matches", "__score", "__spans", "__n_lines", "__n_dropped", "__ids", "__lang", "__n_tokens", "__digests", "__gone", "__id", "s", "draw", "node", "first")


@pytest.fixture(scope="module")
def docs(spark):
    rows, labels = toxic_corpus()
    rows = [(i, x, "en" if i % 2 else "de", "src") for i, x in rows[::8]] + [(9000, "a line that two hold\nx", "en", "src"), (9001, "a line that two hold\ny", "en", None)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")


def odd(df):
    return df.selectExpr("7 as DOC_ID", "*", "'other' as TEXT", "'x' as Source", "1 as `a.b`", "2 as `c``d`", *(f"3 as {name}" for name in OWN))


def rows(df):
    return sorted(map(repr, df.collect()))


def same(got, plain):
    """The plain form's columns of ``got``, by place: those of the operator's own come last."""
    assert rows(got) == rows(plain)


def test_reports(docs):
    texts, labels = docs
    for report in (licenses.license_report, line_dedup.line_report, piece_codec.codec_report, mixing.mix, ngram_join.near_duplicates, language.language_report):
        same(report(odd(texts)), report(texts))
    same(lm.lm_report(odd(texts), shards=3), lm.lm_report(texts, shards=3))
    same(toxicity.toxicity_report(odd(texts), labels.selectExpr("*", "1 as TOXIC")), toxicity.toxicity_report(texts, labels))


def test_rows_pass_with_all_columns(docs):
    texts, _ = docs
    wide = odd(texts)
    for keep in (ngram_join.one_of_each, mixing.mixed):
        got = keep(wide)
        assert got.columns == wide.columns
        at = [wide.columns.index(c) for c in texts.columns]
        assert sorted(repr(tuple(r[i] for i in at)) for r in got.collect()) == sorted(repr(tuple(r)) for r in keep(texts).collect())
    got = line_dedup.dedup_lines(wide)
    assert [c for c in wide.columns if c not in ("__n_lines", "__n_dropped")] + ["__n_lines", "__n_dropped"] == got.columns
    coded = piece_codec.decode(piece_codec.encode(wide))
    text, back = coded.columns.index("text"), coded.columns.index("__decoded")
    assert all(r[back] == (r[text] or "") for r in coded.collect())


def test_stages(spark, docs, tmp_path):
    texts, labels = docs
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        wide, plain = (stage(spark, d, str(tmp_path)) for d in (odd(texts), texts))
        if name == "piece_codec":
            same(wide, plain)
        else:
            assert wide.count() == plain.count()
