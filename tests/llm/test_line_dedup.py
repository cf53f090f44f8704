import random

from citeflow.llm import line_dedup, queries

from . import brute

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def run(df, run=2):
    return sorted((tuple(r) for r in line_dedup.line_dedup(df, run).collect()), key=lambda r: (r[0] is None, r[:4]))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op3_line_dedup(spark, SMALL).collect()) == brute.repeated_lines(rows, 2)


def test_random_lines_and_run_lengths(frame):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c ", "\td", "", "e\r", "unique %d" % rng.randrange(10 ** 6)]) for _ in range(rng.randrange(15))))
            for i in range(150)] + [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 200_000 + "\n" + "y" * 200_000),
                                    (504, "x" * 200_000 + "\n" + "y" * 200_000 + "\nz")]
    for n in (1, 2, 4):
        assert run(frame(rows, D), n) == brute.repeated_lines(rows, n)


def test_hot_run(frame):
    rows = [(i, f"own {i}\nshared one\nshared two\nlast {i}" if i % 3 == 0 else f"alone {i}\nshared one") for i in range(3000)]
    assert run(frame(rows, D)) == brute.repeated_lines(rows, 2)


def test_empty_repeated_clashing(frame):
    assert run(frame([], D)) == []
    df = frame([(1, "a\nb", 1), (1, "a\nb", 2), (2, "a\nb", 3)], D + ", th int")
    assert [r[:3] for r in run(df)] == [(1, 2, 0), (1, 2, 0), (2, 2, 2)]


def test_lone_lines(frame):
    """A licence line between unique neighbours, texts of one line, the same line within a text, and lines of four words."""
    licence, one = "This file is licensed under the General Public License", " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"own {i}\n{licence} \nlast {i}\nfour words stay here") for i in range(5)] + [(10, one), (11, one), (12, f"\t{one}\r\n{one}")]
    got = run(frame(rows, D))
    assert got == brute.repeated_lines(rows, 2)
    assert [r[2] for r in got] == [0, 1, 1, 1, 1, 0, 1, 2] and [r[4] for r in got][-2:] == ["", ""]
    assert [r[2] for r in sorted(tuple(r) for r in line_dedup.line_dedup(frame(rows, D), 2, 4).collect())] == [0, 2, 2, 2, 2, 0, 1, 2]


def test_null_ids_and_lone_lines(frame):
    text = "one two three four five six"
    got = run(frame([(None, text), (3, text), (2, f"x\n{text}")], D))
    assert got == [(2, 2, 1, "1", "x"), (3, 1, 1, "0", ""), (None, 1, 0, "", text)]
