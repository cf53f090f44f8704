"""Invariants of SURVEY §5 on the provided tables (smallest scale)."""

from pyspark.sql import functions as F

from citeflow.plans import catalog as cat

from conftest import SMOKE


def test_ranking_invariants(spark):
    cl = cat._classified(spark, SMOKE)
    n = cl.count()
    reasons = {r["reason"]: r["candidates"] for r in cat.q05_reject_reasons(spark, SMOKE).collect()}
    assert sum(reasons.values()) == n                      # kept + removed = candidates
    sv = cat.q06_filtered_candidates(spark, SMOKE)
    hist = cat.q08_score_histogram(spark, SMOKE).collect()
    assert sum(r["candidates"] for r in hist) == sv.count()  # histogram sums to survivors
    ranked = cat.q07_ranked_candidates(spark, SMOKE)
    bad = ranked.where((F.col("score") < 1) | (F.col("weighted") > F.col("score") * cat.STANDIN_RANK.boost + 1e-9))
    assert bad.count() == 0                                 # 1 <= score, weighted <= score * boost
    ranks = sorted(r["rank"] for r in ranked.select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))          # ranks are 1..n without gaps
    lists = {}
    for r in cat.q09_threshold_lists(spark, SMOKE).collect():
        lists.setdefault(r["threshold"], set()).add(r["pmid"])
    ts = sorted(lists)
    assert all(lists[b] <= lists[a] for a, b in zip(ts, ts[1:]))  # nested lists


def test_term_invariants(spark):
    hits = {r["term"]: r["papers"] for r in cat.q01_term_hits(spark, SMOKE).collect()}
    total = cat.q12b_corpus_size(spark, SMOKE).collect()[0]["documents"]
    assert all(0 <= v <= total for v in hits.values())      # group count <= documents
    per_pattern = (cat.q02_term_matches(spark, SMOKE).groupBy("term", "pattern")
                   .agg(F.count("*").alias("n")).collect())
    for r in per_pattern:
        assert hits[r["term"]] >= r["n"]                    # group >= any alternative
