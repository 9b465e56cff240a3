import random

import pytest
from pyspark.sql import functions as F

from codequarry.functions.ranking import first_per_key, positions, top_n
from codequarry.session import materialize
from codequarry.sources import tables


def skewed(spark, n=5000):
    """A third of the rows under one key, order values shuffled."""
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.34 else f"k{rng.randrange(200)}" for _ in range(n)]
    order = rng.sample(range(n * 3), n)
    return spark.createDataFrame(list(zip(keys, order)), "k string, o int").repartition(7)


def brute(data):
    by_key = {}
    for k, o in data:
        by_key.setdefault(k, []).append(o)
    return {k: sorted(v) for k, v in by_key.items()}


@pytest.fixture
def many_parts(spark):
    """Small data stays in as many partitions as large data would have."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_positions_with_hot_key(spark, many_parts):
    df = skewed(spark)
    want = sorted((k, o, i + 1) for k, v in brute(df.collect()).items() for i, o in enumerate(v))
    assert sorted(tuple(r) for r in positions(df, ["k"], ["o"]).collect()) == want


def test_positions_split_the_hot_key(spark, many_parts):
    df = skewed(spark)
    spread = df.repartitionByRange("k", "o").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert spread > 1


def test_positions_descending_without_key(spark, many_parts):
    df = skewed(spark, 300)
    got = sorted(positions(df, [], [F.desc("o")], "p").select("p", "o").collect())
    assert [r[1] for r in got] == sorted((r[1] for r in df.collect()), reverse=True)


def test_top_n(spark):
    df = skewed(spark)
    want = sorted((k, o, i + 1) for k, v in brute(df.collect()).items() for i, o in enumerate(v[:3]))
    assert sorted(tuple(r) for r in top_n(df, ["k"], ["o"], 3).collect()) == want


def test_top_n_cuts_before_the_shuffle(spark):
    plan = top_n(skewed(spark), ["k"], ["o"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_first_and_last_per_key(spark):
    df = skewed(spark)
    data = brute(df.collect())
    assert dict(first_per_key(df, ["k"], ["o"]).collect()) == {k: v[0] for k, v in data.items()}
    assert dict(first_per_key(df, ["k"], ["o"], last=True).collect()) == {k: v[-1] for k, v in data.items()}


def test_top_n_beyond_the_threshold(spark, many_parts):
    df = skewed(spark)
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, "2")
    got = top_n(df, ["k"], ["o"], 3)
    spark.conf.unset(key)
    want = sorted((k, o, i + 1) for k, v in brute(df.collect()).items() for i, o in enumerate(v[:3]))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_positions_keep_rows_without_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o int")
    assert {(r["k"], r["o"], r["position"]) for r in positions(df, ["k"], ["o"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 5, 1)}


def test_materialize_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", [1.5])], "i int, s string, v array<float>")
    kept = materialize(df)
    assert kept.dtypes == df.dtypes and kept.collect() == df.collect()


def test_upsert_rules(spark, rows):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, embedding double")
    batch = spark.createDataFrame(
        [(2, "x", 9.0, 0), (2, None, None, 1), (3, "n", None, 0)], "id int, name string, embedding double, at int")
    got = rows(tables.upsert(target, batch, ["id"], ["at"], keep_if_null=["embedding"]))
    # the last row wins, its NULL name overwrites, its NULL embedding does not
    assert got == [(1, "a", 1.0), (2, None, 2.0), (3, "n", None)]


def test_markdown(spark, rows):
    df = spark.createDataFrame([(1, "a|b", None), (2, "c", 3)], "place int, T string, N int")
    lines = [r[1] for r in sorted(tables.to_markdown(df, "place").collect())]
    assert lines == ["| T | N |", "| --- | --- |", "| a|b | None |", "| c | 3 |"]
    assert [r[1] for r in tables.to_markdown(df.limit(0), "place").collect()] == ["No data available."]


def test_write_markdown(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(1, 40)], "place int, T string").repartition(5)
    tables.write_markdown(tables.to_markdown(df, "place"), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    written = "".join(p.read_text() for p in parts).splitlines()
    assert written == ["| T |", "| --- |"] + [f"| {i} |" for i in range(1, 40)]
