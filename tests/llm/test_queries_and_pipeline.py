import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_pipeline_keeps_columns_and_runs(spark):
    import corpus_pipeline
    from fieldlark.llm.common import stash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        assert docs.count() <= n, name
        n = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert n > 0 and docs.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline
    from fieldlark.llm.common import stash

    schema = "doc_id long, text string, lang string, n_words int, component_id long, items string"
    for rows in ([], [(1, None, None, 1, 2, "a"), (2, "", "en", 1, 2, "b"), (None, "word " * 40, "en", 1, 2, None), (3, "some words that are read " * 30, None, None, None, None), (3, "some words that are read " * 30, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stash(stage(spark, docs, SF))
            assert out.columns == docs.columns and out.count() <= max(1, len(rows))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_near_duplicate_stage_keeps_one_of_repeated_ids(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, "x"), (3, "other words " * 9, "x")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]
