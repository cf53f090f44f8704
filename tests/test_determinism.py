"""Same rows whatever the shuffle partition count (1, 8, 200)."""

import pytest

from citeflow.plans import catalog as cat

from conftest import SMOKE


@pytest.mark.parametrize("name", ["q04_candidate_scores", "q07_ranked_candidates", "q01_term_hits"])
def test_partition_count_invariance(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(tuple(r) for r in cat.QUERIES[name](spark, SMOKE).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
