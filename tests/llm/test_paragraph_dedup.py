import random

from citeflow.llm import paragraph_dedup, queries
from citeflow.llm.paragraph_dedup import ParagraphConfig, recall

from . import brute

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def windows(rows, n):
    count = {}
    for i, t in rows:
        w = brute.word_list(t)
        for g in {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}:
            count.setdefault(g, set()).add(i)
    return count


def sharing(rows, n):
    return {i for ids in windows(rows, n).values() if len(ids) > 1 for i in ids}


def run(df):
    return {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(df).collect()}


def text(rng, n):
    return " ".join(f"w{rng.randrange(10 ** 7)}" for _ in range(n))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op5_substring_dedup(spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert sharing(rows, 51) <= {i for i, r in got.items() if r.repeats}
    left = [(i, r.text) for i, r in got.items()]
    assert not sharing(left, 51)
    for i, t in rows:
        r = got[i]
        assert r.n_words == len(brute.word_list(t)) and (r.text == t) == (r.n_removed == 0)
        assert len(brute.word_list(r.text)) == r.n_words - r.n_removed == r.n_words - sum(s["end"] - s["first"] for s in r.removed_spans)


def test_embedded_passages_and_clean_texts(frame):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randrange(5, 300))) for i in range(40)]
    for k in range(20):
        passage = text(rng, 51 + 3 * k)
        for _ in range(3):
            rows.append((100 + len(rows), text(rng, rng.randrange(80)) + " " + passage + "\n" + text(rng, rng.randrange(80))))
    got = run(frame(rows, D))
    assert {i for i, r in got.items() if r.repeats} == {i for i, _ in rows if i >= 100}
    first = {i for i, _ in rows if i >= 100 and got[i].n_removed == 0}
    assert len(first) == 20  # the first of each three keeps its passage


def test_whole_passages_go(frame):
    """Every copy but the first loses the passage to its last word, from 25 words on and in the midst of a line."""
    rng = random.Random(12)
    rows, around = [], {}
    for n in (25, 26, 30, 49, 50, 51, 60, 80, 130):
        passage = text(rng, n)
        for _ in range(3):
            around[len(rows)] = text(rng, 70), passage, text(rng, 70)
            rows.append((len(rows), " ".join(around[len(rows)])))
    got = run(frame(rows, D))
    for i, (before, passage, after) in around.items():
        assert got[i].n_repeated == len(passage.split())
        assert got[i].text.split() == (before + " " + (passage + " " if i % 3 == 0 else "") + after).split()


def test_copies_that_share_more_with_each_other_than_with_the_first(frame):
    rng = random.Random(13)
    a, b, c = text(rng, 51), text(rng, 9), text(rng, 8)
    rows = [(1, f"{text(rng, 70)} {a} {text(rng, 70)}"), (2, f"{text(rng, 70)} {a} {b} {text(rng, 70)}"),
            (3, f"{text(rng, 70)} {a} {b} {c} {text(rng, 70)}"), (4, f"{text(rng, 70)} {a} {b} {c} {text(rng, 70)}")]
    got = run(frame(rows, D))
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, 51, 60, 68]


def test_one_edit_leaves_no_long_exact_part(frame):
    """A word replaced in the middle: both halves of 25 words or more go."""
    rng = random.Random(14)
    rows = []
    for n in (51, 60, 80):
        passage = text(rng, n).split()
        other = [*passage[: n // 2], "changed", *passage[n // 2 + 1:]]
        rows += [(len(rows) + k, f"{text(rng, 70)} {' '.join(p)} {text(rng, 70)}") for k, p in enumerate((passage, other))]
    got = run(frame(rows, D))
    assert [got[i].n_removed for i in range(6)] == [0, 50, 0, 59, 0, 79]


def test_a_text_that_repeats_itself_keeps_one_window(frame):
    got = run(frame([(1, "again " * 1000), (2, "one two three " * 100)], D))
    assert [len(got[i].text.split()) for i in (1, 2)] == [25, 25]


def test_near_paragraphs_by_exact_similarity(frame):
    rng = random.Random(4)
    base = text(rng, 120).split()
    near, far = list(base), list(base)
    near[60] = "changed"
    for i in range(5, 115, 8):
        far[i] = f"other{i}"
    rows = [(1, "Head line\n" + " ".join(base)), (2, " ".join(near) + "\nTail line"), (3, " ".join(far))]
    assert len(brute.shingles(rows[0][1].split("\n")[1], 5) & brute.shingles(rows[1][1].split("\n")[0], 5)) == 111
    got = run(frame(rows, D))
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 120, 0]
    assert got[2].text.strip() == "Tail line" and not got[3].repeats


def test_edges(frame):
    assert run(frame([], D)) == {}
    long = " ".join(["again"] * 40_000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "short short"), (5, long), (6, "É" * 30 + " " + "ü x " * 30)]
    got = run(frame(rows, D + ""))
    assert got[1].text is None and got[2].text == "" and not got[4].repeats
    assert got[5].n_words == 40_000 and len(got[5].text.split()) == 40_000 - got[5].n_removed
    rng = random.Random(8)
    t = text(rng, 60)
    df = frame([(7, t, "x"), (7, t, "y"), (9, t, None)], D + ", cid string")
    out = sorted((r.doc_id, r.n_removed > 0) for r in paragraph_dedup.paragraph_dedup(df).collect())
    assert out == [(7, False), (7, False), (9, True)]


def test_hot_passage(frame):
    rng = random.Random(6)
    passage = text(rng, 70)
    rows = [(i, text(rng, 10) + " " + passage if i % 3 == 0 else text(rng, 30)) for i in range(1500)]
    got = run(frame(rows, D))
    assert {i for i, r in got.items() if r.repeats} == {i for i in range(1500) if i % 3 == 0}
    assert sum(r.n_removed == 0 for r in got.values() if r.repeats) == 1


def test_bands_are_tuned_for_recall():
    assert recall(ParagraphConfig(), 0.8) > 0.99


def plain(rows):
    """{id: (words in repeats, words cut)} by comparing every line with every line and listing every window of 25 words."""
    words = {i: brute.word_list(t) for i, t in rows}
    repeated, cut = ({i: set() for i in words} for _ in range(2))
    lines = []
    for i, t in sorted(rows):
        at = 0
        for line in (t or "").split("\n"):
            n = len(brute.word_list(line))
            if n >= 5:
                lines.append((i, at, n, frozenset(tuple(words[i][k: k + 5]) for k in range(at, at + n - 4))))
            at += n
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for x, (_, _, _, s) in enumerate(lines):
        for y in {y for g in s for y in by_shingle.get(g, ())}:
            both = len(s & lines[y][3])
            if 100 * both >= 80 * (len(s) + len(lines[y][3]) - both):
                parent[max(find(x), find(y))] = min(find(x), find(y))
        for g in s:
            by_shingle.setdefault(g, []).append(x)
    size = {}
    for x in range(len(lines)):
        size[find(x)] = size.get(find(x), 0) + 1
    for x, (i, at, n, _) in enumerate(lines):
        if size[find(x)] > 1:
            repeated[i].update(range(at, at + n))
            if find(x) != x:  # the root is the first of its cluster
                cut[i].update(range(at, at + n))
    places = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 24):
            places.setdefault(tuple(words[i][k: k + 25]), []).append((i, k))
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                repeated[i].update(range(k, k + 25))
                if (i, k) != found[0]:
                    cut[i].update(range(max(k, found[0][1] + 25) if i == found[0][0] else k, k + 25))
    return {i: (len(repeated[i]), sorted(cut[i])) for i in words}


def cut_words(r):
    return r.n_repeated, [k for s in r.removed_spans for k in range(s["first"], s["end"])]


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: cut_words(r) for r in queries.op5_substring_dedup(spark, SMALL).collect()}
    want = plain(rows)
    assert got == want
    assert any(w[1] for w in want.values())


def test_lines_and_runs_against_brute_force(frame):
    """Copies of copies: texts put together from a few passages, some edited, cut anywhere, in lines of any length."""
    rng = random.Random(21)
    passages = [text(rng, rng.randrange(5, 90)).split() for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                p[rng.randrange(len(p))] = f"e{rng.randrange(10 ** 6)}"
            p = p[rng.choice([0, 0, rng.randrange(len(p))]):]
            parts.append(" ".join(p) + rng.choice([" ", "\n", "\n"]))
        rows.append((i, "".join(parts)))
    want = plain(rows)
    assert {i: cut_words(r) for i, r in run(frame(rows, D)).items()} == want


def test_short_lines(frame):
    """The same line of 16 words in five texts, one with a word more, and lines of four words."""
    rng = random.Random(22)
    line = text(rng, 16)
    rows = [(i, f"{text(rng, 30)}\n{line}\n{text(rng, 30)}\nonly four words here") for i in range(5)] + [(5, f"{text(rng, 8)}\n{line} more")]
    got = run(frame(rows, D))
    assert [got[i].n_removed for i in range(6)] == [0, 16, 16, 16, 16, 17]
    assert {i: cut_words(r) for i, r in got.items()} == plain(rows)


def test_only_spans_that_differ_are_taken_apart(frame, monkeypatch):
    """Whole copies leave no window to compare; an edit leaves those beside it. Of a text only the lines with a neighbour give sets."""
    count, real, real_sets = {}, paragraph_dedup.stored, paragraph_dedup._sets

    def stored(df, purpose):
        count[purpose] = (table := real(df, purpose)).count()
        return table

    def sets(*args):
        count["sets"] = (out := real_sets(*args)).count()
        return out

    monkeypatch.setattr(paragraph_dedup, "stored", stored)
    monkeypatch.setattr(paragraph_dedup, "_sets", sets)
    rng = random.Random(23)
    whole = [text(rng, 300) for _ in range(20)]
    copies = [(i, whole[i % 20]) for i in range(80)]
    assert {i: cut_words(r) for i, r in run(frame(copies, D)).items()} == plain(copies)
    assert count["windows"] == 0 and count["sets"] == 0
    words = whole[0].split()
    line = text(rng, 40)
    edited = copies + [(100, " ".join([*words[:150], "edit", *words[151:]])),
                       (101, "\n".join(text(rng, 20) for _ in range(30)) + "\n" + line), (102, line + " more")]
    assert {i: cut_words(r) for i, r in run(frame(edited, D)).items()} == plain(edited)
    assert 0 < count["windows"] < 200 and count["sets"] <= 4


def test_texts_of_a_period_against_brute_force(frame):
    """Overlapping copies in one text, and the same run in others, shifted and cut."""
    rng = random.Random(24)
    rows = []
    for period in (1, 3, 7, 12, 13, 24, 25, 26, 31):
        unit = text(rng, period).split() * (200 // period)
        rows += [(len(rows), " ".join(unit)), (len(rows) + 1, text(rng, 9) + " " + " ".join(unit[5: 90]) + " " + text(rng, 9)),
                 (len(rows) + 2, text(rng, 30) + "\n" + " ".join(unit[: 41]) + " x " + " ".join(unit[2: 60]))]
    want = plain(rows)
    assert {i: cut_words(r) for i, r in run(frame(rows, D)).items()} == want
