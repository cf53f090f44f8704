import math
import re
from collections import Counter

from pyspark.sql import functions as F

from citeflow.operators.similarity import related_items

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry date elder"), (4, "apple date"),
        (5, "fig grape"), (6, "banana banana fig"), (7, "common apple"), (8, "common")]
SEEDS = [(100, "apple banana"), (200, "cherry fig zzz")]


def brute(k=2):
    toks = {d: Counter(t for t in re.split(r"[^a-z]+", x.lower()) if t) for d, x in DOCS}
    n = len(toks)
    df = Counter(t for c in toks.values() for t in c)
    idf = {t: math.log(n / v) for t, v in df.items() if math.log(n / v) > 0}

    def vec(c):
        return {t: f * idf[t] for t, f in c.items() if t in idf}
    dv = {d: vec(c) for d, c in toks.items()}
    out = {}
    for s, x in SEEDS:
        sv = vec(Counter(t for t in re.split(r"[^a-z]+", x.lower()) if t))
        sn = math.sqrt(sum(w * w for w in sv.values()))
        sims = []
        for d, v in dv.items():
            dot = sum(w * v.get(t, 0.0) for t, w in sv.items())
            if dot > 0:
                sims.append((round(dot / (sn * math.sqrt(sum(w * w for w in v.values()))), 6), d))
        sims.sort(key=lambda p: (-p[0], p[1]))
        out[s] = [d for _, d in sims[:k]]
    return out


import pytest

from citeflow.operators.similarity import tfidf_index


@pytest.mark.parametrize("hot_fraction", [1, 2, 64])   # all cold, mixed, all hot
def test_related_items_brute_force(spark, hot_fraction):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    seeds = spark.createDataFrame(SEEDS, "item_id long, text string")
    index = tfidf_index(docs, hot_fraction=hot_fraction)
    got = {}
    for r in related_items(seeds, docs, k=2, buckets=3, index=index).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == brute(2)


@pytest.mark.parametrize("postings", [0, 1 << 21])   # joined on the token; broadcast
def test_repeated_and_missing_ids(spark, postings):
    """A document in several rows is one document, rows without an id count in the frequencies only; both seed plans agree."""
    split = [(1, "apple banana"), (1, "apple"), *DOCS[1:6], (7, "common"), (7, "apple"), (8, "common"), (9, None), (10, " 12 ")]
    docs = spark.createDataFrame(split, "doc_id long, text string")
    seeds = spark.createDataFrame([*SEEDS, (None, "apple")], "item_id long, text string")
    got = {}
    for r in related_items(seeds, docs, k=2, seed_postings=postings).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == brute(2)
    unnamed = spark.createDataFrame([*split, (None, "apple"), (None, "fig fig")], "doc_id long, text string")
    df = {r["tok"]: r["df"] for r in tfidf_index(unnamed).vocab.collect()}
    assert df["apple"] == 4 and df["fig"] == 3 and df["cherry"] == 2


def test_pairs_stay_in_their_task(spark):
    """Of all (seed, document) pairs only the k best of a seed leave a task; ties go by id, and one row holds a document."""
    from citeflow.operators import similarity as sm
    docs = spark.createDataFrame([(i, f"apple banana w{'xyz'[i % 3]}") for i in range(600)] + [(600, "kiwi")], "doc_id long, text string")
    seeds = spark.createDataFrame([(s, "apple w" + "xyz"[s % 3]) for s in range(30)], "item_id long, text string")
    index = sm.tfidf_index(docs.coalesce(2))
    assert index.bags.count() == index.norms.count() == 601
    sw = sm.term_frequencies(seeds, "item_id", "text").join(index.vocab, "tok").select("item_id", "tok", "idf", (F.col("tf") * F.col("idf")).alias("ws"))
    sn = sw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("ws") * F.col("ws"))).alias("sn"))
    left = sm._best_dots(index, sw, sn, 3, "item_id", "doc_id")
    assert left.count() <= 30 * 3 * max(1, left.rdd.getNumPartitions()) < 30 * 600
    got = {}
    for r in sm.related_items(seeds, docs, k=3, index=index).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == {s: [s % 3, s % 3 + 3, s % 3 + 6] for s in range(30)}
