"""Corpus search (S1): boolean bibliographic queries and free-text keyword
queries evaluated as one predicate column over the corpus (A9, D8, D9, H6, F15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Query


def search(corpus: DataFrame, query: Query, fields: dict, key: str = "doc_id") -> DataFrame:
    """Ids of documents matching ``query`` (a predicate tree, no string parsing)."""
    return corpus.where(query.to_column(fields)).select(key)


def first_hits(hits: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """H6: first N hits in a deterministic order (the limit is the feature)."""
    return hits.orderBy(key).limit(n)


def hit_count(hits: DataFrame) -> DataFrame:
    """number of hits."""
    return hits.agg(F.count("*").alias("hits"))


# FIXED VALUES: the literature query of the original study, as a predicate tree
# (fielded phrases, right truncation, AND / OR / NOT groups), in its own order.
PLANT_TERMS = ("plant", "plants", "crop", "crops", "crop plant", "crop species", "domestication",
               "domesticated plant")
RESEQUENCING_TERMS = ("resequenc*", "re-sequenc*", "whole-genome sequenc*", "whole genome sequenc*")
SELECTION_TERMS = ("balancing selection", "hard sweep", "negative selection", "polygenic selection",
                   "positive selection", "purifying selection", "selective sweep", "soft sweep",
                   "selection coefficient", "adaptive introgression", "selection")
EXCLUDED_MESH = ("Animals", "Humans", "Vertebrates")
EXCLUDED_TIAB = ("assembly", "genome assembly", "de novo")
EXCLUDED_PT = ("review", "editorial", "comment")
REQUIRED_PT = "journal article"


def study_query() -> Query:
    """The boolean query of the original literature search."""
    from ..functions.patterns import Phrase, Tag, all_of, any_of
    q = all_of(
        Tag(REQUIRED_PT, "pt"),
        any_of(*[Phrase(t) for t in PLANT_TERMS]),
        any_of(*[Phrase(t) for t in RESEQUENCING_TERMS]),
        any_of(*[Phrase(t) for t in SELECTION_TERMS]),
    )
    for m in EXCLUDED_MESH:
        q = q & ~Tag(m, "mesh")
    return q & ~any_of(*[Phrase(t) for t in EXCLUDED_TIAB], *[Tag(p, "pt") for p in EXCLUDED_PT])


def keyword_query_from(terms, excluded_pubtype: str | None = None) -> Query:
    """Free-text AND query (every word of every phrase required, as the
    remote engine treats spaces) with an optional excluded publication type."""
    from ..functions.patterns import Phrase, Tag, all_of
    words = [w for t in terms for w in t.split()]
    q = all_of(*[Phrase(w) for w in words])
    return q & ~Tag(excluded_pubtype, "pt") if excluded_pubtype else q
