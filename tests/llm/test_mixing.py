from collections import defaultdict

import pytest

from citeflow.llm import mixing, queries

from . import brute

D = "doc_id bigint, text string, source string"
SMALL = "/root/testdata/sf0.001"


def check(rows, out):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += brute.n_words(t)
        longest[s] = max(longest[s], brute.n_words(t))
    target, taken = brute.targets(sizes), defaultdict(int)
    assert len(out) == len(rows)
    of = {r["doc_id"]: r for r in out}
    for i, t, s in rows:
        r = of[i]
        assert r["size"] == brute.n_words(t) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s], abs=1e-6)
        assert r["taken"] in [r["size"] * k for k in range(4)]
    for r in out:
        taken[next(s for i, _, s in rows if i == r["doc_id"])] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(longest.values()) + 1
    return taken


def test_whole_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    one = [r.asDict() for r in queries.op10_mixing(spark, SMALL).collect()]
    check(rows, one)
    two = [r.asDict() for r in queries.op10_mixing(spark, SMALL).collect()]
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_caps_nulls_empties(frame):
    rows = [(i, "w " * (1 + i % 7), "b" if i % 10 else "a") for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "x y z", None), (1003, "  ", "empty"), (1004, "y " * 30_000, "big")]
    check(rows, [r.asDict() for r in mixing.mix(frame(rows, D)).collect()])


def test_ranges_do_not_change_the_cut(frame, monkeypatch):
    rows = [(i, "w " * (1 + i * i % 11), f"s{i % 5}") for i in range(500)]
    df = frame(rows, D)
    one = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert sorted(map(str, mixing.mix(df).collect())) == one


def test_repeated_rows_stay_together(frame):
    rows = [(1, "a b c", "s")] * 5 + [(2, "d e", "s"), (3, "f", "t")]
    out = mixing.mix(frame(rows, D)).collect()
    assert len({r.copies for r in out if r.doc_id == 1}) == 1


def test_empty_and_apply(frame):
    assert mixing.mix(frame([], D)).collect() == []
    rows = [(i, f"word{i} more", "a" if i < 5 else "b", i) for i in range(40)]
    df = frame(rows, D + ", size int")
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = defaultdict(int)
    for r in mixing.apply_mix(df).collect():
        assert r.size == r.doc_id
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in plan.items() if v}
