"""The corpus pipeline: five stages over ``documents``, each one operator of the llm subpackage.

Every stage works on all rows its predecessor kept, and all but the last return the columns of
``documents``, whatever further ones there are. Near duplicates are 5-word shingle sets of Jaccard similarity 0.8 or more.

Defined results, stage by stage: null texts, empty ones and texts without letters go in the first stage; texts of any
length are read whole by every stage; rows without an id are kept like others and link like others, but lose against any id;
equal texts are one near-duplicate group, of which the smallest id stays, and rows equal in id and text stand or fall together;
the mix takes documents again and again where a source is below its target; an empty table passes through all
stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm import decontaminate, langid, mixing, ngram_join, token_output
from citeflow.llm.common import read_table, ship_code, stored
from citeflow.llm.queries import END_ID, tokenizer_path
from citeflow.session import shared_dir

#: Shuffled mixing and encoded token files have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters or in none of the languages go."""
    ship_code(spark)
    return langid.reject_foreign(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id."""
    ship_code(spark)
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixing.apply_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens, ids_crc32 per document of the mix."""
    ship_code(spark)
    path = shared_dir(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), END_ID)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``; every stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
