"""Hot keys: one key holding a large share of the rows must give exact results."""

from pyspark.sql import functions as F

from citeflow.config import RankConfig
from citeflow.operators import crosswalk as xw
from citeflow.operators import extraction as ex
from citeflow.operators import related as rel


def test_hot_id_in_crosswalk(spark):
    ans = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("pmid"),
        (F.lit(100000) - F.col("id")).cast("string").alias("pmcid"),
        (F.lit(100000) - F.col("id")).alias("ord"))
    ids = spark.createDataFrame([("hot",), ("1",)], "id string")
    got = {r["pmid"]: r["pmcid"] for r in xw.crosswalk(ids, ans).collect()}
    assert got == {"hot": str(100000 - 29997), "1": "99999"}


def test_hub_candidate(spark):
    seeds = spark.range(1, 2001).select(F.col("id").alias("seed_id"), F.col("id").cast("int").alias("ord"))
    edges = seeds.select("seed_id", F.lit(99999).cast("long").alias("cand_id")).unionByName(
        seeds.select("seed_id", (F.col("seed_id") + 50000).alias("cand_id")))
    excl = spark.createDataFrame([], "pmid long")
    c = rel.candidate_scores(edges, seeds, excl, RankConfig(min_id=0))
    hub = c.where(F.col("pmid") == 99999).collect()[0]
    assert hub["score"] == 2000 and hub["seeds"] == list(range(1, 2001))
    assert c.count() == 2001


def test_hot_entity(spark):
    df = spark.range(20000).select(F.col("id").alias("k"),
                                   F.array(F.lit("common"), (F.col("id") % 7).cast("string")).alias("e"))
    got = {r["entity"]: r["papers"] for r in ex.entity_frequency(df, "e", "k").collect()}
    assert got["common"] == 20000 and sum(v for k, v in got.items() if k != "common") == 20000
