"""The stages on the given documents and on odd rows."""

import corpus_pipeline
import pytest
from test_operators import EDGE

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s, *_ in EDGE]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    kept = stage(spark, odd, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == COLUMNS and kept.dtypes == odd.dtypes
    assert kept.count() > 0
    assert stage(spark, odd.where("false"), "").count() == 0


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, sf)
    assert 0 < good.count() < docs.count()
    assert good.join(docs, ["doc_id", "text"]).count() == good.count()
    fewer = corpus_pipeline.without_repeated_lines(spark, good, sf)
    assert fewer.count() == good.count() and fewer.where("n_chars != length(text)").count() == 0
    apart = corpus_pipeline.without_near_duplicates(spark, fewer, sf)
    assert 0 < apart.count() < fewer.count() and apart.select("text").distinct().count() == apart.count()
    counts = corpus_pipeline.token_counts(spark, corpus_pipeline.mixed(spark, apart, sf), sf)
    assert counts.where("n_tokens > 0").count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
