"""Remaining traps of SURVEY §2.14: regex alternatives (T5) and empty inputs."""

from citeflow.config import RankConfig, TermConfig
from citeflow.operators import related as rel
from citeflow.operators import terms as tm


def test_regex_alternatives_option(spark):
    corpus = spark.createDataFrame([(1, "SNP-array data"), (2, "snparray"), (3, "nothing")],
                                   "doc_id long, text string")
    groups = [("arr", [r"snp-?array"])]
    lit = {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups).collect()}
    rx = {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups, cfg=TermConfig(regex=True)).collect()}
    assert lit == {"arr": 0} and rx == {"arr": 2}


def test_empty_inputs_give_empty_frames(spark):
    corpus = spark.createDataFrame([], "doc_id long, text string")
    assert tm.term_hits(corpus, []).count() == 0
    assert tm.term_hits(corpus, [("a", ["x"])]).collect()[0]["papers"] == 0
    seeds = spark.createDataFrame([], "seed_id long, ord int")
    excl = spark.createDataFrame([], "pmid long")
    edges = spark.createDataFrame([], "seed_id long, cand_id long")
    arts = spark.createDataFrame([], "pmid long, title string, abstract string, pubtypes string")
    cfg = RankConfig(min_id=0)
    sv = rel.filtered(rel.classify(rel.candidate_scores(edges, seeds, excl, cfg), arts, cfg))
    assert rel.ranked(sv, cfg).count() == 0
    assert rel.threshold_lists(sv, cfg).count() == 0
    s = rel.run_summary(sv).collect()[0]
    assert s["candidates"] == 0 and s["max_score"] is None
