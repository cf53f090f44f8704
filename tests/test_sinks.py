import glob
import os

from pyspark.sql import functions as F

from citeflow.operators import convert as cv
from citeflow.sources import sinks


def _read_text(pattern):
    out = []
    for f in sorted(glob.glob(pattern)):
        with open(f) as fh:
            out.extend(fh.read().splitlines())
    return out


def test_write_ranked_order_and_format(spark, scratch):
    r = spark.createDataFrame([(5, 2, 1.5, [1, 2]), (6, 3, 1.5, [3]), (7, 1, 2.0, [4])],
                              "pmid long, score long, weighted double, seeds array<long>")
    r = r.withColumn("seeds", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ","))
    sinks.write_ranked(r, f"{scratch}/ranked", single_file=True)
    lines = _read_text(f"{scratch}/ranked/part-*")
    assert lines == ["PMID\tScore\tWeightedScore\tSeeds", "7\t1\t2.000000\t4",
                     "6\t3\t1.500000\t3", "5\t2\t1.500000\t1,2"]


def test_write_threshold_lists(spark, scratch):
    lists = spark.createDataFrame([(2, 9), (2, 3), (3, 9)], "threshold long, pmid long")
    sinks.write_threshold_lists(lists, f"{scratch}/lists")
    assert _read_text(f"{scratch}/lists/threshold=2/part-*") == ["3", "9"]
    assert _read_text(f"{scratch}/lists/threshold=3/part-*") == ["9"]


def test_write_crosswalk_skips_unmapped(spark, scratch):
    x = spark.createDataFrame([("1", "10"), ("2", None), ("3", "")], "pmid string, pmcid string")
    sinks.write_crosswalk(x, f"{scratch}/xw")
    assert _read_text(f"{scratch}/xw/part-*") == ["1\t10"]


def test_write_landed_routes_by_status(spark, scratch):
    d = spark.createDataFrame([("1", "ok"), ("2", "restricted")], "pmcid string, status string")
    sinks.write_landed(d, f"{scratch}/landed")
    assert os.path.isdir(f"{scratch}/landed/status=restricted")
    assert spark.read.parquet(f"{scratch}/landed").count() == 2


def test_converted_paths_and_collisions(spark, scratch):
    docs = spark.createDataFrame([("/w/a.xml", 10, "<p>x</p>"), ("/w/a.html", 10, "<p>y</p>")],
                                 "path string, src_bytes long, content string")
    q = cv.qa(cv.convert(docs), "path", "/w", "/o")
    assert {r["out_path"] for r in q.collect()} == {"/o/./a.md"}
    (c,) = cv.out_path_collisions(q).collect()
    assert c["sources"] == 2
    sinks.write_converted(q.select("out_path", "text"), f"{scratch}/md")
    assert spark.read.parquet(f"{scratch}/md").count() == 2


def test_ranked_file_feeds_id_list(spark, scratch):
    """Hand-off: the ranked table (header) and a threshold list (no header)
    are read back as id lists without losing the first id (T12)."""
    from citeflow.sources import readers as rd
    r = spark.createDataFrame([(11, 3, 2.5, "1,2"), (12, 2, 2.0, "3")],
                              "pmid long, score long, weighted double, seeds string")
    sinks.write_ranked(r, f"{scratch}/ranked", single_file=True)
    ids = [x["id"] for x in rd.id_list(spark, f"{scratch}/ranked", header=True).collect()]
    assert ids == ["11", "12"]
    lists = spark.createDataFrame([(2, 11), (2, 12)], "threshold long, pmid long")
    sinks.write_threshold_lists(lists, f"{scratch}/lists")
    ids = sorted(x["id"] for x in rd.id_list(spark, f"{scratch}/lists/threshold=2", header=False).collect())
    assert ids == ["11", "12"]
