"""Seed expansion → content filter → weights → ranking with the original
default patterns, checked against a plain-Python evaluation of the same rules."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from citeflow import config as C
from citeflow.config import RankConfig
from citeflow.operators import related as rel
from citeflow.operators.util import global_rank

SEEDS = [1000, 1001, 1002, 1003]
EXCL = [2005]
EDGES = [(1000, 2001), (1001, 2001), (1002, 2001), (1000, 2002), (1003, 2002), (1001, 2003),
         (1002, 2004), (1003, 2005), (1000, 1001), (1003, 2006), (1002, 2007), (1001, 2008),
         (1000, 2009), (1003, 2009), (1002, 2010), (1000, 999)]
ARTICLES = {
    2001: ("Whole genome resequencing of maize landraces", "Population diversity and selection.", "Journal Article"),
    2002: ("De novo assembly of a wheat genome", "A chromosome-level reference.", "Journal Article"),
    2003: ("De novo assembly and resequencing", "Structural variant discovery across a population.", "Journal Article"),
    2004: ("WGS of rice", "We used RNA-seq expression data.", "Journal Article"),
    2006: ("Whole-genome sequencing review", "An overview of resequencing.", "Review"),
    2007: ("A target study", "Exome capture panel genotyping.", "Journal Article"),
    2008: ("Phylogeny of grasses", "No sequencing terms.", "Journal Article"),
    2010: ("Pan-genome resequenc ing", "whole genome data", "Journal Article;Comment"),
}   # 2009 has no record (fail-open)


def _python_ranked(cfg: RankConfig):
    include, exclude = set(SEEDS), set(EXCL)
    cands = defaultdict(list)
    for seed in SEEDS:
        for s, c in EDGES:
            if s != seed or c in include or c in exclude or c < cfg.min_id:
                continue
            cands[c].append(seed)
    scores = {c: len(v) for c, v in cands.items()}
    kept, comp = {}, set()
    for c, seeds in cands.items():
        if c not in ARTICLES:
            kept[c] = seeds
            continue
        t, a, pt = ARTICLES[c]
        content = f"{t} {a}".lower()
        pt = pt.lower()
        if re.search(cfg.comparative, content, re.IGNORECASE):
            comp.add(c)
        if re.search(cfg.assembly, content, re.IGNORECASE) and c not in comp:
            continue
        if pt and re.search(cfg.pubtype, pt, re.IGNORECASE):
            continue
        if re.search(cfg.negative, content, re.IGNORECASE):
            continue
        if not re.search(cfg.positive, content, re.IGNORECASE):
            continue
        kept[c] = seeds
    mx, mn = max(kept), min(kept)
    out = []
    for c in kept:
        w = float(scores[c]) if mx == mn else scores[c] * (1 - cfg.beta * (((mx - c) / (mx - mn)) ** cfg.gamma))
        if c in comp:
            w *= cfg.boost
        out.append((c, scores[c], w, ",".join(str(s) for s in kept[c])))
    out.sort(key=lambda r: (-r[2], -r[1], r[0]))
    return out


def test_ranking_matches_python(spark):
    cfg = RankConfig(min_id=1000)
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(SEEDS)], "seed_id long, ord int")
    excl = spark.createDataFrame([(e,) for e in EXCL], "pmid long")
    edges = spark.createDataFrame(EDGES, "seed_id long, cand_id long")
    arts = spark.createDataFrame([(k, *v) for k, v in ARTICLES.items()],
                                 "pmid long, title string, abstract string, pubtypes string")
    cands = rel.candidate_scores(edges, seeds, excl, cfg)
    sv = rel.filtered(rel.classify(cands, arts, cfg))
    got = global_rank(rel.ranked(sv, cfg)).orderBy("rank").select(
        "pmid", "score", "weighted", rel.seeds_text().alias("seeds")).collect()
    want = _python_ranked(cfg)
    assert [(r[0], r[1], r[3]) for r in got] == [(w[0], w[1], w[3]) for w in want]
    for r, w in zip(got, want):
        assert math.isclose(r[2], w[2], rel_tol=0, abs_tol=1e-12)
    assert {r["pmid"] for r in got} >= {2001, 2009}    # comparative keeper, fail-open keeper
