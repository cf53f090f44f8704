from pyspark.sql import functions as F

from citeflow.config import LandConfig
from citeflow.operators import crosswalk as xw
from citeflow.operators import landing as ld


def test_first_answer_wins_and_unmapped(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    ans = spark.createDataFrame([("1", "B", 2), ("1", "A", 1), ("2", "", 1)], "pmid string, pmcid string, ord int")
    x = xw.crosswalk(ids, ans)
    got = {r["pmid"]: r["pmcid"] for r in x.collect()}
    assert got == {"1": "A", "2": None, "3": None}
    assert [tuple(r) for r in xw.mapped(x).collect()] == [("1", "A", "PMCA")]
    assert sorted(r["pmid"] for r in xw.unmapped(x).collect()) == ["2", "3"]
    c = xw.coverage(x).collect()[0]
    assert (c["processed"], c["mapped"]) == (3, 1)


def test_landing_status_and_pending(spark):
    cfg = LandConfig(needle="not allow")
    todo = spark.createDataFrame([("a", "text"), ("b", "we do not allow"), ("c", ""), ("d", "x"), ("e", "y"),
                                  ("a", "text")], "pmcid string, content string")
    landed = spark.createDataFrame([("d", 10), ("e", 0)], "pmcid string, n_bytes long")
    st = {r["pmcid"]: r["status"] for r in ld.land(todo, landed, cfg).collect()}
    assert st == {"a": "ok", "b": "restricted", "c": "failed", "d": "skipped", "e": "ok"}
    counts = {(r["outcome"], r["detail"]): r["n"] for r in ld.status_counts(ld.land(todo, landed, cfg)).collect()}
    assert counts[("failed", None)] == 2 and counts[("failed", "restricted")] == 1
    assert counts[("total", None)] == 5
    assert sorted(r["pmcid"] for r in ld.pending(todo, landed).collect()) == ["a", "b", "c", "e"]


def test_stream_landing_twice_equals_once(spark, scratch):
    from citeflow.streaming import landing_stream as ls
    src_dir = f"{scratch}/src"
    spark.createDataFrame([("1", "a"), ("2", ""), ("3", "restricted: not allow")], "pmcid string, content string") \
        .write.parquet(src_dir)
    schema = spark.read.parquet(src_dir).schema
    cfg = LandConfig(needle="not allow")
    target = f"{scratch}/landed"
    for run in range(2):
        src = spark.readStream.schema(schema).parquet(src_dir)
        ls.run(spark, src, target, f"{scratch}/ckpt{run}", cfg)
    rows = sorted(tuple(r) for r in spark.read.parquet(target).select("pmcid", "status", "content").collect())
    assert rows == [("1", "ok", "a"), ("2", "failed", ""), ("3", "restricted", "restricted: not allow")]


def test_stream_repairs_and_keeps(spark, scratch):
    """Failed and restricted documents are tried again, landed ones are not; other storage errors surface."""
    from citeflow.streaming import landing_stream as ls
    schema = "pmcid string, content string"
    deliveries = [[("1", "a"), ("2", ""), ("3", "not allow"), ("4", "")], [("1", "other"), ("2", "b"), ("3", "free"), ("4", "")],
                  [("2", "not allow"), ("4", "not allow")]]
    for retry, want in ((True, {"1": "a", "2": "b", "3": "free", "4": "not allow"}), (False, {"1": "a", "2": "b", "3": "not allow", "4": "not allow"})):
        target = f"{scratch}/landed-{retry}"
        cfg = LandConfig(needle="not allow", retry_restricted=retry)
        for n, rows in enumerate(deliveries):
            ls.land_batch(spark.createDataFrame(rows, schema), target, cfg)
        got = ld.current(spark.read.schema(ls.SCHEMA).parquet(target))
        assert {r["pmcid"]: r["content"] for r in got.collect()} == want and got.count() == 4
    open(f"{scratch}/file", "w").write("no parquet")
    import pytest
    with pytest.raises(Exception):
        ls.land_batch(spark.createDataFrame(deliveries[0], schema), f"{scratch}/file", LandConfig())


def test_identity_crosswalk(spark):
    ids = spark.createDataFrame([("PMC1",), ("PMC2",)], "id string")
    assert [tuple(r) for r in xw.identity_crosswalk(ids).collect()] == [("PMC1", "PMC1"), ("PMC2", "PMC2")]


def test_restricted_retry_option(spark):
    todo = spark.createDataFrame([("a", "x"), ("b", "y")], "pmcid string, content string")
    landed = spark.createDataFrame([], "pmcid string, n_bytes long")
    restricted = spark.createDataFrame([("b",)], "pmcid string")
    again = sorted(r[0] for r in ld.pending(todo, landed, restricted).collect())
    skip = sorted(r[0] for r in ld.pending(todo, landed, restricted, LandConfig(retry_restricted=False)).collect())
    assert again == ["a", "b"] and skip == ["a"]


def test_bucketed_landed_ids_do_not_move(spark):
    """The kept side has no exchange, whatever its size; rows equal the plain anti join's."""
    from citeflow.operators import landing as ld
    from citeflow.session import shared_dir
    landed = spark.range(5000).selectExpr("cast(id * 2 as string) pmcid", "id % 5 n_bytes")
    todo = spark.range(4000).selectExpr("cast(id as string) pmcid")
    kept = ld.keep_bucketed(landed, shared_dir(spark, "buckets"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ld.pending(todo, kept)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        final = out._jdf.queryExecution().executedPlan().toString()
        landed_side = final[final.index("landed_"):] if "landed_" in final else final
        assert "Join" in plan and "Exchange" not in landed_side and "Bucketed: true" in final
        assert {r.pmcid for r in out.collect()} == {r.pmcid for r in ld.pending(todo, landed).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _moved(df):
    """Column lists of the shuffles of the plan as it ran."""
    import re
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"): plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", final)]


def test_a_landed_text_moves_once(spark, scratch):
    """Whether chosen deliveries are few or many, texts meet one shuffle, and the rows are the same; a null id is an id."""
    rows = [(str(i % 7), "x" * (i % 5)) for i in range(40)] + [(None, "a"), (None, "bb"), (None, "bb"), ("8", None)]
    todo = spark.createDataFrame(rows, "pmcid string, content string")
    todo.write.parquet(f"{scratch}/todo")
    todo = spark.read.parquet(f"{scratch}/todo")
    none = spark.createDataFrame([], "pmcid string, n_bytes long")
    want = {}
    for i, c in rows:
        want[i] = max(want.get(i, ""), c or "")
    best = ld.best_deliveries(todo, LandConfig())
    for out in (ld.land(todo, none, content=True), ld.with_texts(best, todo, few=True), ld.with_texts(best, todo)):
        got = [(r["pmcid"], r["content"]) for r in out.collect()]
        assert dict(got) == want and len(got) == len(want)
        assert len([x for x in _moved(out) if x.startswith(("_i", "coalesce"))]) <= 2  # ids and texts, once each


def test_current_moves_only_ids_that_landed_again(spark, scratch, monkeypatch):
    from citeflow.streaming import landing_stream as ls
    rows = [(str(i), 1, "a", "ok") for i in range(20)] + [("3", 0, "", "failed"), ("4", 9, "no", "restricted"), ("5", 2, "bb", "ok"),
            ("5", 2, "bb", "ok"), (None, 1, "c", "ok"), (None, 2, "dd", "restricted")]
    spark.createDataFrame(rows, "pmcid string, n_bytes long, content string, status string").write.parquet(f"{scratch}/again")
    landings = spark.read.schema(ls.SCHEMA).parquet(f"{scratch}/again")
    want = {str(i): "a" for i in range(20)} | {"5": "bb", None: "c"}
    for few in (1, 100):
        monkeypatch.setattr(ld, "FEW", few)
        out = ld.current(landings)
        got = [(r["pmcid"], r["content"]) for r in out.collect()]
        assert dict(got) == want and len(got) == len(want)
        assert len(_moved(out)) <= (2 if few == 1 else 1)


def test_texts_delivered_once_land_where_they_are(spark, scratch, monkeypatch):
    """No text moves but those of ids delivered more than once; many such ids, or many kept ones, give the same rows."""
    from citeflow.streaming import landing_stream as ls
    first = [(str(i), "x" * (i % 4)) for i in range(30)] + [("3", "long text"), ("4", ""), (None, "a"), (None, "bb"), (None, "bb"), ("n", None)]
    second = [(str(i), "new") for i in range(40)] + [("0", "newer"), ("8", "need"), ("n", "need"), ("n", "need")]
    cfg = LandConfig(needle="need")
    want = {}
    for rows in (first, second):
        best = {}
        for i, c in rows:
            status = "restricted" if "need" in (c or "") else "ok" if c else "failed"
            best[i] = max(best.get(i, (-1,)), (ld.STATUS_ORDER.index(status), len(c or ""), c or "", status))
        for i, b in best.items():
            if i not in want or want[i][0] < 2 and b[0] > want[i][0]:
                want[i] = b
    asked = []
    with_texts = ld.with_texts
    monkeypatch.setattr(ld, "with_texts", lambda chosen, todo, few=False: (asked.append(chosen.count()), with_texts(chosen, todo, few))[1])
    for few in (200_000, 0):
        monkeypatch.setattr(ld, "FEW", few)
        for n, rows in enumerate((first, second)):
            ls.land_batch(spark.createDataFrame(rows, "pmcid string, content string"), f"{scratch}/{few}", cfg)
        got = ld.current(spark.read.schema(ls.SCHEMA).parquet(f"{scratch}/{few}")).collect()
        assert {r["pmcid"]: (r["status"], r["n_bytes"], r["content"]) for r in got} == {i: (b[3], b[1], b[2]) for i, b in want.items()}
        assert len(got) == len(want)
    assert asked[:2] == [3, 3] and asked[2] == 32  # ids "3", "4" and null; "0", "8" and "n"; then every id
    none = ld.best_deliveries(spark.createDataFrame(first, "pmcid string, content string"), cfg).where("_n > 1")
    assert not [x for x in _moved(ld.all_but(none, spark.createDataFrame(first, "pmcid string, content string"), cfg)) if "content" in x or x.startswith("_i")]
