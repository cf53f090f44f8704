import numpy as np

from citeflow.llm import exact_dedup, queries

from . import brute

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def run(df, **kw):
    return sorted(tuple(r) for r in exact_dedup.exact_dedup(df, **kw).collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op7_exact_dedup(spark, SMALL).collect()) == brute.exact_groups(rows)


def test_nulls_empties_case_repeats_and_long(frame):
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "X" * 300_000)]
    assert run(frame(rows, D)) == brute.exact_groups(rows)


def test_hot_group_is_salted(frame):
    rows = [(i, "Same text" if i % 3 == 0 else f"text {i}") for i in range(4000)]
    assert run(frame(rows, D), bucket_keys=300) == brute.exact_groups(rows)


def test_empty_table_and_clashing_columns(frame):
    assert run(frame([], D)) == []
    df = frame([(1, "a", "x", True), (2, "A", "y", None)], D + ", digest string, kept boolean")
    assert [r[:4] for r in run(df)] == [(1, 2, 2, False), (2, 2, 2, True)]


def test_snapshot_split_does_not_matter(frame):
    from pyspark.sql import functions as F
    rows = [(i, f"t{i % 7}") for i in range(100)]
    for old in (F.lit(True), F.lit(False), F.col("doc_id") < 50):
        assert run(frame(rows, D), in_snapshot=old) == brute.exact_groups(rows)


def test_equal_digests_with_other_bytes_are_told_apart(frame, monkeypatch):
    df = frame([(1, "a"), (2, "a"), (3, "b")], D)
    from pyspark.sql import functions as F
    one = F.unhex(F.sha2(F.lit("a"), 256))
    members = df.select("doc_id", one.alias("digest"), F.lit(2).cast("bigint").alias("keep_id"), F.lit(3).cast("bigint").alias("group_size"))
    odd = exact_dedup._mismatches(df, members, 3, "doc_id", "text")
    assert odd.collect() == []  # 3 has not this digest, so it is no member by its own bytes


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(keys).to_bytes())
        assert f.contains(keys).all()
        other = rng.integers(2 ** 63, 2 ** 64, 50_000, dtype=np.uint64)
        if n > 100:
            assert f.contains(other).mean() < 0.01
            assert len(f.table) < 1.4 * n + 3000
