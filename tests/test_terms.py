import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from citeflow.config import TermConfig
from citeflow.operators import automaton
from citeflow.operators import terms as tm


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, value string")


def test_parse_terms_cases(spark):
    lines = [
        "# a comment",
        "",
        "no colon here",
        ": empty name",
        "Empty:   ",
        "Bars: | |",
        "Second: a:b|c",
        "Lead:  x| partial selective sweep",
        "Meta: C++|a.b",
        "\tTabbed\t:\tt1 |t2\t",
    ]
    rows = {r["line_no"]: r for r in tm.parse_terms(_lines(spark, lines)).collect()}
    assert rows[1]["status"] == "comment"
    assert rows[2]["status"] == "blank"
    assert rows[3]["status"] == "no_colon"
    assert rows[4]["status"] == "empty_name_or_patterns"
    assert rows[5]["status"] == "empty_name_or_patterns"
    assert rows[6]["status"] == "no_patterns"
    assert (rows[7]["name"], rows[7]["patterns"]) == ("Second", ["a:b", "c"])
    assert rows[8]["patterns"] == ["x", "partial selective sweep"]
    assert rows[9]["patterns"] == ["C++", "a.b"]
    assert (rows[10]["name"], rows[10]["patterns"]) == ("Tabbed", ["t1", "t2"])


def test_duplicate_names(spark):
    parsed = tm.parse_terms(_lines(spark, ["A: x", "A: y"]))
    try:
        tm.term_groups(parsed)
        raise AssertionError("duplicate accepted")
    except ValueError:
        pass
    assert tm.term_groups(parsed, TermConfig(last_wins=True)) == [("A", ["y"])]


CORPUS = [
    (1, "Café culture and the SNP data."),         # accented neighbour: 'caf' must not hit
    (2, "snp at the end snp"),                      # case-insensitive, start/end of text
    (3, "An ÉTUDE of whole genome\nsequencing"),    # accented case pair; phrase over a line break
    (4, "genome-wide association study"),           # hyphenated phrase
    (5, "C++ and a.b literal, not a_b or axb"),     # metacharacters are literal
    (6, "underscore_snp is one word"),
]


def _hits(spark, groups, cfg=TermConfig()):
    corpus = spark.createDataFrame(CORPUS, "doc_id long, text string")
    return {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups, cfg=cfg).collect()}


GROUPS = [("SNP", ["SNP"]), ("caf", ["caf"]), ("etude", ["étude"]), ("wgs", ["whole genome sequencing"]),
          ("gwas", ["genome-wide association"]), ("lit", ["a.b"]), ("cpp", ["C++"]), ("none", ["zzz"])]


def test_term_hits_semantics(spark):
    h = _hits(spark, GROUPS)
    assert h["SNP"] == 2          # docs 1, 2; not 'underscore_snp'
    assert h["caf"] == 0
    assert h["etude"] == 1
    assert h["wgs"] == 0          # line break is not a space by default
    assert h["gwas"] == 1
    assert h["lit"] == 1          # 'a.b' only, not 'axb'
    assert h["none"] == 0         # zero-hit group kept
    assert _hits(spark, GROUPS, TermConfig(normalize_ws=True))["wgs"] == 1


def test_group_is_union_of_alternatives(spark):
    h = _hits(spark, [("g", ["snp", "étude", "snp"])])
    assert h["g"] == 3


def test_token_path_equals_regex_path(spark):
    assert _hits(spark, GROUPS, TermConfig(max_regex_alternatives=0)) == _hits(spark, GROUPS)


ODD_CORPUS = CORPUS + [
    (7, "laſer and İndex at 5 \u212aelvin, STRASSE stra\u1e9ee straße"), (8, "ΟΔΟΣ οδος οδοσ Οδος-x"), (9, "soft\n sweep soft  sweep soft sweep"),
    (10, "concatenate cats, a--b a-- --b x--y"), (10, "a cat on a second row of one id"), (11, ""), (12, None),
    (13, "(abc) x(abc)y \\E quoted\\Ehere a|b"), (14, "e\u0301tude e\u0301 é É_é"), (15, "ǅ ǆ Ǆ ŉ ĳ Ĳ ﬁ"), (16, "tab\tsoft sweep; - - x - - y")]
ODD_GROUPS = [("laser", ["laser"]), ("index", ["index"]), ("kelvin", ["5 kelvin"]), ("street", ["straße", "strasse"]), ("road", ["οδος"]),
              ("sweep", ["soft sweep"]), ("cat", ["cat"]), ("dash", ["--"]), ("edges", ["--b", "a--"]), ("paren", ["(abc)"]), ("bs", ["\\E"]),
              ("quoted", ["quoted\\Ehere"]), ("bar", ["a|b"]), ("e", ["é"]), ("dz", ["ǆ"]), ("n", ["ŉ"]), ("ij", ["ĳ"]), ("fi", ["fi"]),
              ("gap", ["- -"]), ("x", ["x"]), ("none", ["zzz"])]


@pytest.mark.parametrize("ci, whole, ws", list(itertools.product([True, False], repeat=3)))
def test_all_plans_agree_for_every_switch(spark, ci, whole, ws):
    corpus = spark.createDataFrame(ODD_CORPUS, "doc_id long, text string")
    few = TermConfig(case_insensitive=ci, whole_word=whole, normalize_ws=ws)
    many = TermConfig(case_insensitive=ci, whole_word=whole, normalize_ws=ws, max_regex_alternatives=0)
    more = TermConfig(case_insensitive=ci, whole_word=whole, normalize_ws=ws, max_regex_alternatives=0, automaton_chars=0)
    a, b, c = (sorted(tuple(r) for r in tm.term_hits(corpus, ODD_GROUPS, cfg=c).collect()) for c in (few, many, more))
    assert a == b == c
    a, b, c = (sorted(tuple(r) for r in tm.term_matches(corpus, ODD_GROUPS, cfg=c).collect()) for c in (few, many, more))
    assert a == b == c and len(set(a)) == len(a)


def test_distinct_documents_are_counted(spark):
    corpus = spark.createDataFrame([(1, "a cat"), (1, "the cat"), (2, "cat")], "doc_id long, text string")
    for n in (0, 500):
        assert tm.term_hits(corpus, [("cat", ["cat"])], cfg=TermConfig(max_regex_alternatives=n)).first()["papers"] == 2


def test_case_key_joins_what_the_regex_equates(spark):
    """Every character and each of its one-to-one case partners that the regex flags equate."""
    pairs = sorted({(chr(c), x) for c in range(0x21, 0x2FFF) if not 0xD800 <= c < 0xE000
                    for x in (chr(c).upper(), chr(c).lower(), chr(c).title()) if len(x) == 1 and x != chr(c)})
    df = spark.createDataFrame(pairs, "a string, b string")
    rx = F.concat(F.lit("(?iuU)^\\Q"), F.col("a"), F.lit("\\E$"))
    key = [tm.case_key(F.col(c), TermConfig()) for c in ("a", "b")]
    assert df.where(F.regexp_like("b", rx) & (key[0] != key[1])).collect() == []


def test_term_matches_rows(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id long, text string")
    rows = sorted(tuple(r) for r in tm.term_matches(corpus, [("SNP", ["SNP", "zzz"])]).collect())
    assert rows == [("SNP", "SNP", 1), ("SNP", "SNP", 2)]


def test_report_lines(spark):
    from citeflow.sources.sinks import report_lines
    hits = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "term string, papers long")
    lines = [r["line"] for r in report_lines(hits, 9).orderBy("line_no").collect()]
    assert lines[0] == lines[5] == lines[11] == "" and len(lines) == 12
    assert lines[3] == "Total Markdown files searched: 9"
    assert lines[8] == f"{'c':<40} | {5:>12}"
    assert lines[9].startswith("a ") and lines[10].startswith("b ")


def test_prefilter_keeps_case_twins(spark):
    """Non-ASCII characters that the case-insensitive regex equates with ASCII
    letters must survive the substring prefilter."""
    corpus = spark.createDataFrame([(1, "ſnp and İndex at 5 Kelvin"), (2, "nothing")],
                                   "doc_id long, text string")
    groups = [("snp", ["snp"]), ("index", ["index"]), ("kelvin", ["kelvin"])]
    got = {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups).collect()}
    assert got == {"snp": 1, "index": 1, "kelvin": 1}


def test_ranked_hits_order(spark):
    hits = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("B", 2)], "term string, papers long")
    assert [r["term"] for r in tm.ranked_hits(hits).collect()] == ["c", "B", "a", "b"]


def test_dataframe_dictionary_token_path(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id long, text string")
    lines = ["SNP: SNP", "caf: caf", "etude: étude", "gwas: genome-wide association", "lit: a.b",
             "cpp: C++", "none: zzz", "# comment"]
    parsed = tm.parse_terms(_lines(spark, lines))
    got = {r["term"]: r["papers"] for r in
           tm.term_hits(corpus, parsed, cfg=TermConfig(max_regex_alternatives=0)).collect()}
    want = {r["term"]: r["papers"] for r in tm.term_hits(corpus, tm.term_groups(parsed)).collect()}
    assert got == want and got["gwas"] == 1 and got["lit"] == 1 and got["none"] == 0
    dup = tm.parse_terms(_lines(spark, ["A: snp", "A: étude"]))
    try:
        tm.term_hits(corpus, dup, cfg=TermConfig(max_regex_alternatives=0))
        raise AssertionError("duplicate accepted")
    except ValueError:
        pass
    last = tm.term_hits(corpus, dup, cfg=TermConfig(max_regex_alternatives=0, last_wins=True)).collect()
    assert [(r["term"], r["papers"]) for r in last] == [("A", 1)]


def test_term_matches_token_path(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id long, text string")
    parsed = tm.parse_terms(_lines(spark, ["SNP: SNP|zzz", "g: genome-wide association", "c: C++"]))
    a = sorted(tuple(r) for r in tm.term_matches(corpus, parsed, cfg=TermConfig(max_regex_alternatives=0)).collect())
    b = sorted(tuple(r) for r in tm.term_matches(corpus, tm.term_groups(parsed)).collect())
    # "C++" never matches as a whole word before a space (a boundary after "+" needs a word character)
    assert a == b and ("g", "genome-wide association", 4) in a and not any(r[0] == "c" for r in a)


def test_equal_case_keys_are_equal_for_the_regex(spark):
    """Single characters whose case keys are equal and as long as they are: the regex flags equate them."""
    pairs = sorted({(chr(c), x) for c in range(0x21, 0x2C00)
                    for x in {*map(str, (chr(c).upper(), chr(c).lower(), chr(c).title())), "i", "k", "s"} if len(x) == 1 and x != chr(c)})
    df = spark.createDataFrame(pairs, "a string, b string")
    key = [tm.case_key(F.col(c), TermConfig()) for c in ("a", "b")]
    rx = F.concat(F.lit("(?iuU)^\\Q"), F.col("a"), F.lit("\\E$"))
    wrong = df.where((key[0] == key[1]) & (F.length(key[0]) == 1) & ~F.regexp_like("b", rx))
    assert wrong.collect() == []


def test_automaton_finds_all_literals(monkeypatch):
    rng = random.Random(1)
    for _ in range(100):
        literals = list({"".join(rng.choice("abc d") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))})
        texts = ["".join(rng.choice("abc dé_") for _ in range(rng.randrange(60))) for _ in range(8)]
        monkeypatch.setattr(automaton, "LANE", rng.choice([4, 8, 1024]))
        monkeypatch.setattr(automaton, "TABLE_ENTRIES", rng.choice([10, 60, 1 << 24]))
        machines = automaton.automata(literals)
        for whole in (False, True):
            t, n, sure = (x.tolist() for x in automaton.occurrences(machines, texts, whole))
            got = {(i, literals[k]) for i, k in zip(t, n)}
            want = {(i, x) for i, text in enumerate(texts) for x in literals if x in text}
            if whole:
                ways = {(i, x): [(m.start(), m.start() + len(x)) for m in re.finditer(f"(?={re.escape(x)})", texts[i])] for i, x in want}
                want = {k for k, at in ways.items() if any(re.compile(rf"\b{re.escape(k[1])}\b").match(texts[k[0]], a) for a, _ in at)}
                assert want <= got and {k for k, s in zip(zip(t, (literals[k] for k in n)), sure) if s} <= want
            else:
                assert got == want and all(sure) and len(t) == len(got)


def test_large_dictionary_over_repeated_and_null_keys(spark):
    corpus = spark.createDataFrame([(1, "a cat"), (1, "the cat and a dog"), (2, "cat é"), (None, "dog"), (None, "cat"), (3, None), (4, "")],
                                   "doc_id long, text string")
    groups = [("animals", ["cat", "dog"]), ("dog", ["dog"]), ("cat too", ["cat"]), ("none", ["cow"])] + [(f"g{i}", [f"w{i}"]) for i in range(600)]
    got = {r["term"]: r["papers"] for r in tm.term_hits(corpus, groups).collect()}
    assert {k: v for k, v in got.items() if v} == {"animals": 3, "dog": 2, "cat too": 3} and len(got) == 604


def test_letters_beyond_ascii_need_no_regex(spark):
    """Accents at a word's edge and letters of two-letter upper case are decided in the scan; the rows are the regexes'."""
    texts = [(1, "la Straße été"), (2, "STRASSE ete"), (3, "caféine café"), (4, "naïve-été"), (5, "ÉTÉ, ﬁn de caf́e"), (6, "ße aé éa _é"), (7, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    alts = ["été", "caf", "café", "t", "a", "e", "straße", "strasse", "fin", "naïve", "l", "s", "é"]
    groups = [(x, [x]) for x in alts]
    quick, exact = TermConfig(max_regex_alternatives=0), TermConfig(max_regex_alternatives=10**9)
    rows = lambda df: sorted((r["term"], r["doc_id"]) for r in df.collect())
    assert rows(tm.term_matches(docs, groups, cfg=quick)) == rows(tm.term_matches(docs, groups, cfg=exact))
    listed, _ = tm._broadcastable(tm._as_alternatives(spark, groups), quick)
    left = {alts for r in tm._scanned(docs, listed, "text", "doc_id", quick).collect() for alts in (r["_k"] for _ in r["open"])}
    assert left <= {1, 5}  # the alternative with the sharp s itself, and marks


def test_characters_join_what_the_regex_equates(spark):
    """Characters that the regex engine takes as equal have one key, and where a key differs the regex does."""
    keys, kinds = tm.characters(spark)
    c = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    pairs = c.select("c", F.explode(F.array(F.upper("c"), F.lower("c"), F.lower(F.upper("c")), F.upper(F.lower("c")))).alias("d")).where("c <> d and length(d) = 1")
    equal = pairs.where(F.regexp_like("d", F.concat(F.lit("(?iuU)^\\Q"), F.col("c"), F.lit("\\E$"))))
    assert not [r for r in equal.collect() if keys[ord(r["c"])] != keys[ord(r["d"])]]
    assert kinds[ord("é")] == 1 and kinds[ord("—")] == 0 and kinds[0x301] == 2 and keys[ord("ß")] == ord("ß")
