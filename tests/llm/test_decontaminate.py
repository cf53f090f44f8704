from citeflow.llm import decontaminate, queries

from . import brute

D, B = "doc_id bigint, text string", "item_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def run(docs, bench):
    out = decontaminate.decontaminate(docs, bench)
    rows = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op6_benchmark_decontamination(spark, SMALL).collect())
    assert got == brute.contamination(docs, items)
    assert any(r[-1] for r in got)


def test_edges(frame):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:10])), (2, " ".join(w[5:30])), (3, "Short one"), (4, None), (5, ""), (6, "..."), (7, "a a a a a a a a a a a a"),
             (7, "second text of the same id"), (11, "solo"), (None, "no name item here")]
    docs = [(1, None), (2, ""), (3, " ".join(w)), (4, " ".join(w[1:10])), (5, "x SHORT, one y short-one z"), (6, "a " * 30),
            (7, "pre " + " ".join(w[:10]) + " post"), (8, " ".join(w[7:17]) + " and " + " ".join(w[6:16])), (9, "Solo"), (9, "Solo"), (9, "other"),
            (10, "é" * 5 + " short one"), (11, ("zz " * 9000) + " ".join(w[20:30])), (12, " ".join(w[25:]) + " tail"), (13, "second text of the same id"),
            (None, "short one")]
    got = run(frame(docs, D), frame(items, B))
    want = sorted(brute.contamination([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None]))
    assert [r for r in got if r[0] is not None] == want
    assert [r[2] for r in got if r[0] is None] == [2]


def test_empty_tables(frame):
    assert run(frame([], D), frame([(1, "a b")], B)) == []
    assert [r[2:4] for r in run(frame([(1, "a b")], D), frame([], B))] == [(0, 0)]


def test_drop_and_clashing_columns(frame):
    docs = frame([(1, "one two three", 5), (2, "clean words", None), (3, None, 1)], D + ", th int")
    out = decontaminate.drop_contaminated(docs, frame([(1, "two three")], B))
    assert out.columns == ["doc_id", "text", "th"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
