"""The pipeline and the registered queries on the smallest tables."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quartzgate.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


ROWS = ["doc_id", "piece", "start", "length", "ids_crc32"]


@pytest.fixture(scope="module")
def staged(spark):
    """(documents before and after each stage, the rows of the last), by hand."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        seen.append(docs.count())
    assert docs.where("length(text) <> n_chars").count() == 0
    return seen, sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select(*ROWS).collect()))


def test_stages_keep_columns_and_take_effect(staged):
    seen, packed = staged
    assert seen[0] > seen[1] == seen[2] > seen[3] == seen[4]
    assert len({r[0] for r in packed}) == seen[4]


def test_run_equals_the_stages(spark, staged):
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, out.select(*ROWS).collect())) == staged[1]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
