"""The pipeline stage by stage, and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidelag.llm import queries as llm

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def test_stages_on_edges(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(5, 1, 0), (9, 0, 1), (17, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (edges, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(out := f"{tmp_path}/{name}-{start is edges}")
            docs = spark.read.parquet(out)
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
            if name != "encode":
                assert docs.columns == start.columns
            if name == "language":
                assert not ids & {1, 2, 3}
            if name == "exact" and start is edges:
                assert len(ids & {5, 6, 7}) == 1
        assert docs.columns == ["doc_id", "ids"]
        assert (docs.count() > 0) == (start is edges)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(llm.oracle_sql()) <= set(llm.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
