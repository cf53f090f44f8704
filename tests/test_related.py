import math

from pyspark.sql import functions as F

from citeflow.config import RankConfig
from citeflow.operators import related as rel

CFG = RankConfig(min_id=100, comparative="tion", assembly="que", pubtype="review",
                 negative="license", positive="the")


def _frames(spark):
    seeds = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 9)], "seed_id long, ord int")
    excl = spark.createDataFrame([(500,), (500,), (50,)], "pmid long")
    edges = spark.createDataFrame([
        (1, 200), (2, 200), (3, 200),        # score 3
        (2, 300), (2, 300),                  # repeated edge counts twice
        (1, 2),                              # candidate is a seed
        (1, 500),                            # excluded
        (1, 99), (1, 100),                   # below / exactly at the cut-off
        (3, 400), (1, 600), (2, 700), (3, 800),
    ], "seed_id long, cand_id long")
    arts = spark.createDataFrame([
        (200, "the population study", "", "Journal Article"),   # comparative, kept
        (300, "", "", ""),                                      # present but empty → no_positive
        (100, "que assembly", "", ""),                          # assembly, not comparative
        (400, "que of the nation", "", ""),                      # assembly rescued by comparative
        (600, "the paper", "", "Review"),                       # pubtype
        (700, "the license", "", ""),                           # negative
    ], "pmid long, title string, abstract string, pubtypes string")
    return seeds, excl, edges, arts


def test_scores_and_seed_order(spark):
    seeds, excl, edges, _ = _frames(spark)
    c = {r["pmid"]: r for r in rel.candidate_scores(edges, seeds, excl, CFG).collect()}
    assert set(c) == {200, 300, 100, 400, 600, 700, 800}
    assert c[200]["score"] == 3 and c[200]["seeds"] == [1, 2, 3]
    assert c[300]["score"] == 2 and c[300]["seeds"] == [2, 2]


def test_limited_seeds_still_filter_with_full_list(spark):
    seeds, excl, edges, _ = _frames(spark)
    cfg = RankConfig(**{**CFG.__dict__, "max_seeds": 1})
    c = {r["pmid"]: r["score"] for r in rel.candidate_scores(edges, seeds, excl, cfg).collect()}
    assert c == {200: 1, 100: 1, 600: 1}   # seed 1 only; 2 (a seed) still excluded


def test_reject_cascade_and_fail_open(spark):
    seeds, excl, edges, arts = _frames(spark)
    cl = rel.classify(rel.candidate_scores(edges, seeds, excl, CFG), arts, CFG)
    r = {x["pmid"]: (x["reason"], x["comparative"]) for x in cl.collect()}
    assert r[200] == ("kept", True)
    assert r[300] == ("no_positive", False)        # empty ≠ absent
    assert r[100] == ("assembly", False)
    assert r[400] == ("kept", True)
    assert r[600] == ("pubtype", False)
    assert r[700] == ("negative", False)
    assert r[800] == ("kept_no_metadata", False)   # absent → kept, no boost
    counts = {x["reason"]: x["candidates"] for x in rel.reject_reasons(cl).collect()}
    assert sum(counts.values()) == cl.count()


def test_weighted_scores_match_python(spark):
    seeds, excl, edges, arts = _frames(spark)
    sv = rel.filtered(rel.classify(rel.candidate_scores(edges, seeds, excl, CFG), arts, CFG))
    got = {r["pmid"]: r["weighted"] for r in rel.weighted(sv, CFG).collect()}
    rows = {r["pmid"]: (r["score"], r["comparative"]) for r in sv.collect()}
    mx, mn = max(rows), min(rows)
    for pmid, (score, comp) in rows.items():
        w = score * (1 - CFG.beta * (((mx - pmid) / (mx - mn)) ** CFG.gamma))
        if comp:
            w *= CFG.boost
        assert math.isclose(got[pmid], w, rel_tol=0, abs_tol=1e-12)


def test_single_candidate_weight_is_score(spark):
    sv = spark.createDataFrame([(7, 4, True)], "pmid long, score long, comparative boolean")
    (r,) = rel.weighted(sv, CFG).collect()
    assert r["weighted"] == 4 * CFG.boost


def test_thresholds_tiers_and_invariants(spark):
    sv = spark.createDataFrame([(i, s, False) for i, s in enumerate([1, 2, 2, 3, 5, 12, 25])],
                               "pmid long, score long, comparative boolean")
    lists = rel.threshold_lists(sv, CFG)
    by_t = {}
    for r in lists.collect():
        by_t.setdefault(r["threshold"], set()).add(r["pmid"])
    assert sorted(by_t) == [2, 3, 5, 10]          # rec = max(2, 25 // 10) = 2, deduplicated
    assert by_t[10] <= by_t[5] <= by_t[3] <= by_t[2]  # nested lists
    t = rel.confidence_tiers(sv, CFG).collect()[0]
    assert (t["recommended"], t["high"], t["medium"], t["low"]) == (2, 6, 0, 3)  # overlap at rec=2
    ex = rel.confidence_tiers(sv, RankConfig(**{**CFG.__dict__, "exclusive_tiers": True})).collect()[0]
    assert ex["low"] == 1
    hist = rel.score_histogram(sv).collect()
    assert sum(r["candidates"] for r in hist) == sv.count()
    s = rel.run_summary(sv).collect()[0]
    assert (s["candidates"], s["max_score"], s["recommended"]) == (7, 25, 2)


def test_ranking_order(spark):
    sv = spark.createDataFrame([(10, 2, False), (20, 2, False), (30, 1, True)],
                               "pmid long, score long, comparative boolean")
    order = [r["pmid"] for r in rel.ranked(sv, CFG).collect()]
    assert order == [20, 10, 30]


def test_pubtype_strict_and_whole_word(spark):
    seeds = spark.createDataFrame([(1, 1)], "seed_id long, ord int")
    excl = spark.createDataFrame([], "pmid long")
    edges = spark.createDataFrame([(1, 200), (1, 300)], "seed_id long, cand_id long")
    arts = spark.createDataFrame([
        (200, "the tion", "", "Journal Article;Commentary"),   # 'Comment' inside a longer type
        (300, "the station", "", "Review"),
    ], "pmid long, title string, abstract string, pubtypes string")
    base = dict(CFG.__dict__)
    base["pubtype"] = "Review|Comment"
    loose = RankConfig(**base)
    strict = RankConfig(**{**base, "pubtype_strict": True})
    c = rel.candidate_scores(edges, seeds, excl, loose)
    r1 = {x["pmid"]: x["reason"] for x in rel.classify(c, arts, loose).collect()}
    r2 = {x["pmid"]: x["reason"] for x in rel.classify(c, arts, strict).collect()}
    assert r1 == {200: "pubtype", 300: "pubtype"}
    assert r2 == {200: "kept", 300: "pubtype"}
    ww = RankConfig(**{**base, "whole_word": True})
    cl = {x["pmid"]: x["comparative"] for x in rel.classify(c, arts, ww).collect()}
    assert cl == {200: True, 300: False}    # 'tion' as a word, not inside 'station'


def test_distinct_edges_option(spark):
    seeds, excl, edges, _ = _frames(spark)
    cfg = RankConfig(**{**CFG.__dict__, "distinct_edges": True})
    c = {r["pmid"]: (r["score"], r["seeds"]) for r in rel.candidate_scores(edges, seeds, excl, cfg).collect()}
    assert c[300] == (1, [2])      # the repeated edge counts once
    assert c[200] == (3, [1, 2, 3])
