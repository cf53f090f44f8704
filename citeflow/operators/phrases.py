"""Phrase search by positions (D8, D9): a postings table instead of a scan of all texts per phrase.

Every text is a sequence of words (maximal runs of word characters of its case key), each with the characters in front of it. The
postings (slot, word, key, place, gap) are stored in the order of their words, so a query reads the row groups of its own words: an equal
word, or for a right-truncated one the range of words that begin with it. A phrase stands where its words have consecutive
places and the gaps between them are its own; all phrases of a query are matched in one join with the (small) list of their
words and one aggregate by (phrase, text, place of the phrase's first word). What remains of the query (AND, OR, NOT, tags) is one
predicate over the found phrases, next to the other columns of the corpus; texts are not read again.

A text whose case key has other characters in other places than the text (``ß``) is searched with the phrase's regex as well, if the
postings name it. A phrase that begins or ends in no word character has no place in the table and raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TermConfig
from ..functions.patterns import And, Not, Or, Phrase, Query
from ..session import shared_dir
from .terms import case_key

_CASE = TermConfig()


@dataclass(frozen=True)
class PhraseIndex:
    """Stored postings, and the texts that need the regex; ``slots`` numbers the text columns of each field."""

    postings: DataFrame
    odd: DataFrame
    slots: dict


def build_index(corpus: DataFrame, fields: dict, key: str = "doc_id") -> PhraseIndex:
    """Postings of the text columns of ``fields`` (field -> list of columns), written once to the shared folder."""
    spark = corpus.sparkSession
    slots, columns = {}, []
    for field, own in fields.items():
        slots[field] = list(range(len(columns), len(columns) + len(own)))
        columns += own
    texts = corpus.select(F.col(key).alias("key"), F.posexplode(F.array(*[c.cast("string") for c in columns])).alias("slot", "text"))
    low = case_key(F.col("text"), _CASE)
    words, gaps = (F.regexp_extract_all(low, F.lit(rf"(?U)(\{c}+)"), 1) for c in ("w", "W"))
    # words and gaps alternate; a text that begins with a gap has one in front of its first word
    before = F.when(low.rlike(r"(?U)^\W"), gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
    pairs = texts.where(F.col("text").isNotNull()).select("key", "slot", F.posexplode(F.arrays_zip(words.alias("word"), before.alias("gap"))).alias("place", "pair"))
    rows = pairs.where(F.col("pair.word").isNotNull()).select("slot", "pair.word", "key", "place", "pair.gap")
    path = shared_dir(spark, "postings")
    rows.repartitionByRange("word", "key").sortWithinPartitions("word", "key", "slot", "place").write.parquet(path)
    odd_path = shared_dir(spark, "odd-texts")
    texts.where(F.length(low) != F.length("text")).write.parquet(odd_path)
    return PhraseIndex(spark.read.parquet(path), spark.read.parquet(odd_path), slots)


def leaves(query: Query) -> list[Phrase]:
    """The distinct phrases of a query."""
    if isinstance(query, (And, Or)):
        return list(dict.fromkeys(p for part in query.parts for p in leaves(part)))
    if isinstance(query, Not):
        return leaves(query.part)
    return [query] if isinstance(query, Phrase) else []


def _phrase_words(spark, phrases: list[Phrase]) -> list[tuple]:
    """(phrase, nth, word, gap, prefix, size) of every word of the phrases; case keys are made by Spark as for the texts."""
    stems = [p.text.removesuffix("*") for p in phrases]
    rows = spark.createDataFrame(list(enumerate(stems)), "id int, t string").select("id", case_key(F.col("t"), _CASE).alias("t")).collect()
    out = []
    for r in sorted(rows):
        parts = re.findall(r"\w+|\W+", r["t"])
        if not parts or not re.match(r"\w", parts[0]) or not re.match(r"\w", parts[-1]):
            raise ValueError(f"a phrase has to begin and end in a word: {phrases[r['id']].text!r}")
        words = parts[::2]
        for i, w in enumerate(words):
            last = i + 1 == len(words)
            out.append((r["id"], i, w, parts[2 * i - 1] if i else None, last and phrases[r["id"]].text.endswith("*"), len(words)))
    return out


def phrase_hits(index: PhraseIndex, phrases: list[Phrase]) -> DataFrame:
    """(key, found): the numbers of the phrases that stand in any column of their fields, for keys with one at least."""
    spark = index.postings.sparkSession
    table = _phrase_words(spark, phrases)
    exact, prefixes = sorted({w for _, _, w, _, p, _ in table if not p}), sorted({w for _, _, w, _, p, _ in table if p})
    wanted = F.col("word").isin(exact) if exact else F.lit(False)
    for w in prefixes:
        wanted = wanted | F.col("word").startswith(w)
    words = F.broadcast(spark.createDataFrame(  # the query's own words
        [(*row, slot) for row in table for slot in index.slots[phrases[row[0]].field]],
        "phrase int, nth int, w string, w_gap string, prefix boolean, size int, w_slot int"))
    read = index.postings.where(wanted)
    fits = F.col("w_gap").isNull() | (F.col("gap") == F.col("w_gap"))
    same = read.join(words.where("not prefix"), (F.col("word") == F.col("w")) & (F.col("slot") == F.col("w_slot")) & fits)
    begun = read.join(words.where("prefix"), F.col("word").startswith(F.col("w")) & (F.col("slot") == F.col("w_slot")) & fits)
    stands = (same.unionByName(begun).groupBy("phrase", "size", "slot", "key", (F.col("place") - F.col("nth")).alias("start"))
              .agg(F.count("*").alias("n")).where("n = size").select("phrase", "slot", "key").distinct())
    # texts whose key does not follow their characters: the phrase's regex decides
    regex = F.element_at(F.create_map(*[x for i, p in enumerate(phrases) for x in (F.lit(i), F.lit(p.regex()))]), F.col("phrase"))
    odd = index.odd.select(F.col("key").alias("o_key"), F.col("slot").alias("o_slot"), "text")
    met = stands.join(odd, F.col("key").eqNullSafe(F.col("o_key")) & (F.col("slot") == F.col("o_slot")), "left")
    sure = met.where(F.col("text").isNull() | F.regexp_like("text", regex))
    return sure.groupBy("key").agg(F.collect_set("phrase").alias("found"))


def _predicate(query: Query, fields: dict, number: dict, found: Column) -> Column:
    if isinstance(query, Phrase):
        return F.array_contains(found, number[query])
    if isinstance(query, Not):
        return ~_predicate(query.part, fields, number, found)
    if isinstance(query, (And, Or)):
        out = _predicate(query.parts[0], fields, number, found)
        for part in query.parts[1:]:
            p = _predicate(part, fields, number, found)
            out = out & p if isinstance(query, And) else out | p
        return out
    return query.to_column(fields)


def indexed_search(corpus: DataFrame, index: PhraseIndex, query: Query, fields: dict, key: str = "doc_id") -> DataFrame:
    """Keys of the rows of ``corpus`` that match ``query``, as ``operators.search.search`` gives them."""
    phrases = leaves(query)
    number = {p: i for i, p in enumerate(phrases)}
    if not phrases:
        return corpus.where(query.to_column(fields)).select(key)
    hits = phrase_hits(index, phrases).withColumnRenamed("key", "_hit_key")
    joined = corpus.join(hits, F.col(key).eqNullSafe(F.col("_hit_key")), "left")
    found = F.coalesce("found", F.array().cast("array<int>"))
    return joined.where(_predicate(query, fields, number, found)).select(key)
