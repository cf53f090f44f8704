from pyspark.sql import functions as F

from citeflow.operators import util


def test_spread_only_when_few_splits(spark):
    one = spark.range(100).coalesce(1)
    assert util.spread(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(6)
    assert util.spread(many, 4).rdd.getNumPartitions() == 6


def test_materialize_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    m = util.materialize(df)
    assert sorted(tuple(r) for r in m.collect()) == sorted(tuple(r) for r in df.collect())
    got = sorted(tuple(r) for r in util.latest(m, "k", "o").collect())
    assert got == [("a", 2, "y"), ("b", 1, "z")]


def test_latest_keeps_exactly_one_row(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 2, "z"), ("b", 2, "z"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    for order in ("o", None):
        got = util.latest(df, "k", order).collect()
        assert sorted(str(r["k"]) for r in got) == ["None", "a", "b"]
        assert sorted(map(str, got)) == sorted(map(str, util.latest(df.repartition(5), "k", order).collect()))


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    import pytest
    from citeflow import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(), "x")


def test_global_rank_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    ranked = util.global_rank(df.orderBy(F.desc("v")))
    rows = {r["v"]: r["rank"] for r in ranked.collect()}
    assert all(rows[v] == 1000 - v for v in rows)
