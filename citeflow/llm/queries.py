"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import conversation_repair, decontaminate, exact_dedup, html_extract, langid, line_dedup, mixing, ngram_join, paragraph_dedup, simhash, token_align, token_counts, token_output
from .common import read_table

#: Vocabulary file of the token queries, as the public tokenizer package names it.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: The two vocabularies that are aligned.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents")).drop("class_id", "text_hash")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.paragraph_dedup(read_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_output.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_output.read_tokens(spark, path)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.report(rows, conversation_repair.damaged(rows))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_align.align(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTES), tokenizer_path(PIECES))
    return token_align.agreement(out).withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard_join, op3_line_dedup, op4_token_counts, op5_substring_dedup, op6_benchmark_decontamination, op7_exact_dedup, op8_token_output,
                                    op9_html_extraction, op10_mixing, op11_conversation_repair, op12_simhash,
                                    op13_token_alignment)}
