"""The registered queries and the pipeline over the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codequarry.plans.registry import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

ROWS = {"op3": "embeddings", "op10": "pages"}
ANALYSES = {"op11", "op12", "op13"}  # rows of another kind


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit() and n.split("_")[0] not in ANALYSES))
def test_a_row_for_each_row(spark, name):
    table = ROWS.get(name.split("_")[0], "documents")
    got = entry.queries()[name](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "token-ID / binary output"
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).persist()
        assert docs.columns == columns and docs.count() > 0
    got = corpus_pipeline.run(spark, FOLDER).orderBy("start").collect()
    assert len(got) == docs.count()
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, cursor = entry.queries()[name](spark, FOLDER), con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cursor.fetchall())


def test_whitening(spark):
    got = entry.queries()["op12_whitening"](spark, FOLDER)
    assert got.count() == 16 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-8
