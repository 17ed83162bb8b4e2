"""The registered queries of this subpackage on the smallest tables, and the pipeline."""

from __future__ import annotations

import pytest
from oracle import compare
from pyspark.sql import functions as F

from railbird.llm import queries
from railbird.llm.common import stored

Q, O = queries.queries(), queries.oracle_sql()  # noqa: E741


@pytest.mark.parametrize("name", sorted(O))
def test_same_rows(spark, sf, name):
    compare(spark, name, Q[name], O[name], sf)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_one_row_per_row(spark, sf, name):
    t = "embeddings" if name in ("op9_media_copies", "op13_whitening") else "documents"
    rows = 8 if name == "op13_whitening" else 1  # one for each component
    assert Q[name](spark, sf).count() == rows * spark.read.parquet(f"{sf}/{t}.parquet").count()


@pytest.fixture
def labels_only(spark, tmp_path):
    rows = [(i, 0, int(i % 4 == 0)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


EDGES = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "web", 3), (1, "the quick brown fox jumps over the lazy dog", "en", "web", 3), (2, "The quick brown fox jumps over the lazy dog!", "en", "web", 3),
    (3, None, "en", "web", None), (4, "", None, None, 0), (None, "no id at all, write to ann@mail.example.com today", "en", "book", 1), (5, "call +1 (017) 555-7713 " + "word " * 60_000, "en", "book", 1), (6, "!!!", "de", "book", 1),
]


def test_pipeline_edges(spark, labels_only):
    """Nulls, repeats, long texts, an empty table and extra columns with our own names, through every stage."""
    import corpus_pipeline

    ids_before: list = []
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["size", "_source", "key", "kept", "doc", "copies", "id"]
    docs = spark.createDataFrame(EDGES, columns)
    for name in extra:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.coalesce(F.col("source"), F.lit("none"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs.limit(0), docs):
            out = stage(spark, d, labels_only)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[x] == f"{x}-{r.source or 'none'}" for r in got for x in extra), name
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            assert len(got) == len(EDGES)
        elif name == "ngram_jaccard_join":
            assert sorted(ids, key=str) == [1, 3, 4, 5, 6, None]
        elif name == "pii":
            assert {r.doc_id: r.n_chars for r in got}[3] is None and "<EMAIL>" in {r.doc_id: r.text for r in got}[None]
        else:
            assert set(ids) <= set(ids_before) and 1 in ids
        ids_before = ids
        docs = stored(out) if name != "mixing" else docs
    assert corpus_pipeline.STAGES[-1][1](spark, docs, labels_only).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), labels_only).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        if name in ("toxicity", "ngram_jaccard_join"):
            assert docs.count() < before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
        before = docs
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
