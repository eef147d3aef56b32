"""Each stage of the pipeline on its own input, and all of them together."""

import corpus_pipeline
import pytest
from plotweave.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string"


def test_stages_keep_the_columns(spark, folder):
    docs = table(spark, folder, "documents")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert 0.7 * count < out.count() < count, name


def test_odd_documents(spark, folder, frame):
    rows = [(1, None, None, None, None, "p"), (None, "", "en", "s", 0, None), (2, "word " * 50_000, "en", "s", 1, "p"), (2, "word " * 50_000, "en", "s", 1, "p")]
    for given in (rows, []):
        docs = frame(given, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_run(spark, folder):
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test-stage")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
        assert p.sequence_tokens <= 2048
    assert all(lengths[p.doc_id] == p.doc_tokens for p in pieces)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert pytest.approx(len(corpus_pipeline.STAGES)) == 5
