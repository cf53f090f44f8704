import random

import numpy as np
import pytest

from citeflow.llm import ngram_join, queries
from citeflow.llm.ngram_join import JoinConfig

from . import brute

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def run(df, config=JoinConfig()):
    out = ngram_join.jaccard_join(df, config)
    return sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "n_links").collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op2_ngram_jaccard_join(spark, SMALL).select("doc_id", "n_shingles", "component_id", "n_links")
    want = brute.near_groups(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[3] for r in want)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(w)


@pytest.mark.parametrize("light", [0, 12, 10 ** 6])
def test_edited_copies_for_any_boundary(frame, monkeypatch, light):
    """Sizes around every threshold, small and large sets, a shared passage, and a boundary anywhere."""
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes, scan, c: light)
    rng = random.Random(3)
    rows, passage = [], "one passage that very many of the texts share without any change at all in it"
    for n in (4, 5, 6, 8, 9, 10, 12, 15, 16, 20, 24, 30, 60):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        rows += [(len(rows) + k, edited(rng, base, k % 3)) for k in range(5)]
        rows.append((len(rows), " ".join(base[:-1])))
        rows.append((len(rows), passage + " " + " ".join(base[: n // 2])))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, passage.upper()), (1006, passage)]
    assert run(frame(rows, D)) == brute.near_groups(rows)


def test_long_lists_are_cut_in_blocks(frame):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, base, i % 3)) for i in range(90)] + [(100 + i, "exactly the same text again and again here") for i in range(40)]
    assert run(frame(rows, D), JoinConfig(block=7)) == brute.near_groups(rows)


def test_empty_repeated_clashing_and_long(frame):
    assert run(frame([], D)) == []
    df = frame([(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (2, "A b c d e F", 3, None)], D + ", cid int, component_id string")
    assert run(df) == [(1, 3, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2)]
    long = " ".join(f"t{i}" for i in range(50_000))
    assert run(frame([(5, long), (3, long + " end")], D)) == brute.near_groups([(5, long), (3, long + " end")])


def test_boundary_grows_with_the_cost_of_scanning():
    c = JoinConfig()
    sizes = dict.fromkeys(range(1, 200), 10)
    cuts = [ngram_join.boundary(sizes, scan, c) for scan in (1, 50, 500, 5000)]
    assert cuts == sorted(cuts) and cuts[-1] > cuts[0]
    assert ngram_join.boundary({}, 1.0, c) == 0


def test_sketch_bounds_the_overlap():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 2500)).astype(np.uint64)) for _ in range(120)]
    marks = ngram_join.Sketches([ngram_join.sketch(s) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))
    near = np.array([len(a) <= 2 * len(b) and len(b) <= 2 * len(a) for a, b in ((sets[x], sets[y]) for x, y in zip(i, j))])
    for x, y, d in zip(i[near], j[near], marks.differ(i[near], j[near])):
        assert 2 * len(np.intersect1d(sets[x], sets[y])) <= len(sets[x]) + len(sets[y]) - d
        assert (d == 0) or x != y
    unlike = [d for x, y, d in zip(i, j, marks.differ(i, j)) if x != y]
    assert np.median(unlike) > 100


def test_keep_one(frame):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, 1 if i else 0), i) for i in range(6)] + [(10, None, 1), (11, "", 2), (12, "clean text of its own here", 3),
                                                                         (12, "clean text of its own here", 3)]
    got = ngram_join.keep_one(frame(rows, D + ", keep_n int"))
    assert got.columns == ["doc_id", "text", "keep_n"]
    want = {c for _, _, c, _ in brute.near_groups([r[:2] for r in rows], 5, 80)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_null_ids(frame):
    """Among near copies (here the only bridge between two ids), among exact copies, and in a group without any id."""
    base = [f"w{i}" for i in range(90)]
    left, right = list(base), list(base)
    left[20] = "x1"
    right[70] = "x2"
    lone = [f"v{i}" for i in range(60)]
    other = [*lone[:30], "y", *lone[31:]]
    rows = [(5, " ".join(left)), (None, " ".join(base)), (3, " ".join(right)), (8, "the same words in both"), (None, "the same words in both"),
            (None, " ".join(lone)), (None, " ".join(other)), (None, None), (None, "one of its own kind")]
    config = JoinConfig(percent=86)
    pairs = [(brute.shingles(rows[x][1], 4), brute.shingles(rows[y][1], 4)) for x, y in ((0, 1), (1, 2), (0, 2), (5, 6))]
    assert [100 * len(a & b) >= 86 * len(a | b) for a, b in pairs] == [True, True, False, True]
    found = ngram_join.jaccard_join(frame(rows, D), config).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    want = [(5, 87, 3, 1), (None, 87, 3, 2), (3, 87, 3, 1), (8, 2, 8, 1), (None, 2, 8, 1), (None, 57, None, 1), (None, 57, None, 1),
            (None, 0, None, 0), (None, 2, None, 0)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    kept = [r.text for r in ngram_join.keep_one(frame(rows, D), config).collect()]
    assert len(kept) == 5 and {rows[i][1] for i in (2, 3, 7, 8)} < set(kept) and len(set(kept) & {rows[5][1], rows[6][1]}) == 1
