import random

import pytest
from pyspark.sql import functions as F

from citeflow.functions.patterns import Phrase, Tag, all_of, any_of
from citeflow.operators import phrases
from citeflow.operators import search as se

ROWS = [(1, "Whole genome sequencing of crops", "A selective sweep; selective  sweeps", ["Review"]), (2, "whole-genome Sequenced", None, []),
        (3, "re-sequencing", "resequence, RESEQUENCING", ["article"]), (4, "", "the selective sweep", None), (5, None, None, ["article"]),
        (6, "Straße strasse STRASSE", "straẞe", []), (7, "selective\nsweep", "un_selective sweep selective-sweep", ["article"]),
        (8, "selective sweep", "selective sweep selective sweep", ["review"]), (8, "second row of one key: genome", "", []),
        (None, "selective sweep of no key", "", []), (9, "(selective sweep)", "É étude ÉTUDE", [])]
SCHEMA = "doc_id bigint, title string, abstract string, pubtypes array<string>"


def fields():
    return {"tiab": [F.col("title"), F.col("abstract")], "pt": [F.col("pubtypes")], "ti": [F.col("title")]}


def texts():
    return {k: v for k, v in fields().items() if k != "pt"}


QUERIES = [Phrase("selective sweep"), Phrase("whole genome sequenc*"), Phrase("whole-genome sequenc*"), Phrase("resequenc*"), Phrase("re-sequenc*"),
           Phrase("straße"), Phrase("strasse"), Phrase("étude"), Phrase("sweep", "ti"), Phrase("nothing here"),
           all_of(Phrase("selective sweep"), ~Tag("review")), any_of(Phrase("genome"), Phrase("stras*"), Tag("article")),
           all_of(~Phrase("selective sweep"), ~Phrase("genome")), Tag("article"), all_of(Phrase("sweep"), any_of(Phrase("selective"), Phrase("un_sel*")))]


def test_index_equals_the_scan(spark):
    corpus = spark.createDataFrame(ROWS, SCHEMA)
    # of rows that share a key each one is searched by itself in a scan; the index knows keys only
    once = corpus.where("doc_id is null or title <> 'second row of one key: genome' or title is null")
    index = phrases.build_index(once, texts())
    for q in QUERIES:
        want = sorted(str(r.doc_id) for r in se.search(once, q, fields()).collect())
        assert sorted(str(r.doc_id) for r in phrases.indexed_search(once, index, q, fields()).collect()) == want, q


def test_random_texts(spark):
    rng = random.Random(4)
    words, gaps = ["a", "ab", "abc", "B", "é", "x1", "_", "ß"], [" ", " ", "-", "  ", "\n", ", "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(12))), rng.choice(["", "ab abc", None]), []) for i in range(200)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    index = phrases.build_index(corpus, texts())
    for _ in range(6):
        p = [Phrase(rng.choice([" ", "-", "  "]).join(rng.choice(words[:6]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "*"])) for _ in range(3)]
        q = any_of(all_of(p[0], ~p[1]), p[2])
        assert {r.doc_id for r in phrases.indexed_search(corpus, index, q, fields()).collect()} == {r.doc_id for r in se.search(corpus, q, fields()).collect()}


def test_only_the_words_of_the_query_are_read(spark):
    index = phrases.build_index(spark.createDataFrame(ROWS, SCHEMA), texts())
    plan = phrases.phrase_hits(index, [Phrase("selective sweep"), Phrase("resequenc*")])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,resequenc)" in plan or "In(word" in plan
    with pytest.raises(ValueError):
        phrases.phrase_hits(index, [Phrase("C++")])


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], SCHEMA)
    index = phrases.build_index(corpus, texts())
    assert phrases.indexed_search(corpus, index, QUERIES[0], fields()).collect() == []
