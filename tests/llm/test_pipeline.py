import hashlib

import pytest

import __spark_entry__

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_registered():
    found = __spark_entry__.queries()
    assert found["pipeline"] is pipeline.run
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_stages_keep_columns_and_rows_of_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0.7 * left < docs.count() <= left
        assert docs.select("doc_id").distinct().count() == docs.count()
        left = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == left


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, pipeline.run(spark, SF).collect()))


def test_odd_documents(spark, clashing):
    docs = clashing([(1, None), (2, ""), (None, "kalo mi"), (3, "x y"), (3, "x y"), (4, "w " * 40_000)])
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert len(docs.columns) == 17
    got = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(got) == {1, None, 3, 4} and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    for _, stage in pipeline.STAGES:
        assert stage(spark, clashing([]), SF).count() == 0
