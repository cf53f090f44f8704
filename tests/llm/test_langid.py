import zlib

from citeflow.llm import langid, queries

SMALL = "/root/testdata/sf0.01"
S = "doc_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, SMALL).collect()
    assert len(got) == len(lang)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97


def substrings(s):
    return {s[i:j] for i in range(len(s)) for j in range(i, len(s) + 1)}


def test_automaton_accepts_exactly_the_substrings():
    word = [3, 1, 3, 1, 1, 2, 3, 1]
    step = langid.suffix_automaton(word)
    have = {tuple(x) for x in map(tuple, [word[i:j] for i in range(9) for j in range(i, 9)])}
    import itertools
    for n in range(1, 5):
        for x in itertools.product([1, 2, 3], repeat=n):
            s = 0
            for c in x:
                s = step[s].get(c, -1) if s >= 0 else -1
            assert (s >= 0) == (x in have)


def greedy(text, sample):
    """Phrases of a greedy parse of the symbols into longest substrings of the sample."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_are_those_of_the_greedy_parse():
    samples = {"aa": "the cat sat on the mat and the dog", "bb": "ein hund und eine katze sind da"}
    m = langid.Model(samples, 1 << 18, 1 << 14)
    parts = {k: langid.symbols(langid.code_points(v), m.table).tobytes() for k, v in samples.items()}
    for t in ("the hat", "und da zzz", "x", "a cat and a dog and the mat", "katze" * 30):
        s = langid.symbols(langid.code_points(t), m.table)[:langid.BLOCK]
        assert m.phrases([s])[0].tolist() == [greedy(s.tobytes(), parts[k]) for k in m.names]


def test_edges(frame):
    train = [(i, t, g) for i in range(40) for t, g in [("the cat and the dog were in the house", "en"), ("der hund und die katze sind im haus", "de")]]
    rows = [(1000, None, None), (1001, "", "en"), (1002, "123 !?", "de"), (1003, "the dog", None), (1004, "die katze " * 20_000, None),
            (1005, "日本語", None), (1006, "the dog", "zz")]
    df = frame([(i * 2 + (g == "de"), t, g) for i, t, g in train] + rows, S).withColumn("score", __import__("pyspark").sql.functions.lit("x"))
    model = langid.fit(df.where("doc_id < 1000"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert [got[i][0] for i in range(1000, 1005)] == ["und", "und", "und", "en", "de"] and got[1000][1] == 0.0
    kept = langid.reject_foreign(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.where("doc_id >= 1000").collect()} == {1003, 1004, 1006}


def test_nothing_learned_and_empty(frame):
    df = frame([(1, "some words", None)], S)
    assert [r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()] == ["und"]
    none = frame([], S)
    assert langid.identify(none, langid.fit(none)).collect() == []


def test_only_learned_rows_are_used(frame):
    """Labels of held-out rows must not matter."""
    rows = [(i, "alpha beta gamma " * 3 if i % 2 else "uno dos tres " * 3, "x" if i % 2 else "y") for i in range(60)]
    wrong = [(i, t, "z" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    a, b = langid.fit(frame(rows, S)), langid.fit(frame(wrong, S))
    assert a.names == b.names == ["x", "y"] and (a.next == b.next).all()


def whole_tables(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_whole_texts_against_a_plain_parse(spark):
    """The prediction of whole texts, block by block, by set lookups in the samples' substrings."""
    rows = [(i, t, g) for i, t, g in whole_tables(spark) if len(t) < 3000][:60]
    samples = {"en": "the cat sat on the mat and the dog ran", "fr": "le chat est sur la table et le chien", "xx": "ok a", "yy": "q"}
    m = langid.Model(samples, 1 << 18, 1 << 14)
    parts = {k: langid.symbols(langid.code_points(v), m.table).tobytes() for k, v in samples.items()}
    want = []
    for _, t, _ in rows:
        s = langid.symbols(langid.code_points(t), m.table)
        blocks = [s[i: i + langid.BLOCK].tobytes() for i in range(0, len(s), langid.BLOCK)]
        cost = [(sum(greedy(b, parts[k]) for b in blocks), k) for k in sorted(parts)]
        want.append((min(cost)[1], min(cost)[0] / len(s), len(s)) if any(c.isalpha() for c in t) else ("und", 1.0, 0))
    assert [(g, r, n) for g, _, r, n in m.predict([t for _, t, _ in rows])] == want
    assert {w[0] for w in want} >= {"en", "fr"}


def test_a_short_label_takes_nothing_over(spark):
    rows = whole_tables(spark)
    learnable = next(i for i in range(10 ** 6, 10 ** 6 + 9) if zlib.crc32(str(i).encode()) % 4 != 2)
    for short in ("a", "ok a", "short line", "une ligne de vingt.."):
        df = spark.createDataFrame([*rows, (learnable, short, "zz")], S).coalesce(4)
        got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
        out = [(i, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
        assert sum(got[i] == g for i, g in out) / len(out) > 0.97
        assert sum(v == "zz" for v in got.values()) <= 2
        assert langid.reject_foreign(df).count() == len(rows) + 1


def test_many_labels_from_few_languages_lose_no_text(spark):
    rows = [(i, t, f"{g}{i % 45}") for i, t, g in whole_tables(spark)]
    df = spark.createDataFrame(rows, S).coalesce(4)
    assert langid.reject_foreign(df).count() == len(rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
    assert sum(got[i][:2] == g[:2] for i, _, g in rows) / len(rows) > 0.97


def test_every_label_is_learned(frame):
    """More labels than any table of a fixed number would hold, one of them in rows of one id and text."""
    import random
    rng = random.Random(2)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(rng.sample(words, 8)), f"l{k:03}") for i in range(8)]
    one = next(i for i in range(10 ** 6, 10 ** 6 + 9) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows += [(one, "only one text of this label", "same")] * 200
    df = frame(rows, S)
    model = langid.fit(df)
    assert len(model.names) == 301
    got = [(r.lang_pred, r.doc_id) for r in langid.identify(df, model).collect()]
    assert sum(p == ("same" if i == one else f"l{i // 1000:03}") for p, i in got) / len(got) > 0.97


def test_text_of_no_language_goes_and_short_words_stay(spark):
    rows = whole_tables(spark)
    more = [(10 ** 6, "日本語の長い文章です。これは学習されていません", None), (10 ** 6 + 1, "A", None), (10 ** 6 + 2, "Ok", None),
            (10 ** 6 + 3, "xq zvk qqj wxz kjq zzx qvw jxk qzj", None)]
    df = spark.createDataFrame([*rows, *more], S).coalesce(4)
    kept = {r.doc_id for r in langid.reject_foreign(df).where("doc_id >= 1000000").collect()}
    assert kept == {10 ** 6 + 1, 10 ** 6 + 2}
