"""Markup → text conversion with QA and bibliography removal (S4):
A7, B5, C15-C19, H8, K1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ConvertConfig
from ..functions import text as tx
from .util import latest


def sniff(docs: DataFrame, content: str = "content", cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """Add ``format`` (jats | html)."""
    return docs.withColumn("format", tx.sniff_format(F.col(content), cfg.markers, cfg.sniff_lines))


def convert(docs: DataFrame, content: str = "content", cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """K1: add ``format`` (if absent, sniffed), ``text`` and ``status`` (ok, ok_with_warnings,
    failed, empty). The format selects the reader, as in the original."""
    if "format" not in docs.columns:
        docs = sniff(docs, content, cfg)
    fmt = F.col("format")
    out = tx.markup_to_text(F.col(content), fmt)
    return docs.withColumn("text", out).withColumn("status", tx.conversion_status(F.col(content), F.col("text"), fmt))


def outcome(docs: DataFrame, content: str = "content", cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """K1: which pass converts a document: ``strict`` (its tags are well-formed and the chain knows all of its markup), ``lenient``
    (warnings, with the first ``fault``), ``empty`` (no text comes out) or ``failed`` (no input)."""
    done = convert(docs, content, cfg)
    fault = tx.markup_fault(F.col(content), F.col("format"))
    fault = F.coalesce(fault, F.when(F.col("status") == "ok_with_warnings", "unknown markup"))
    return done.withColumn("fault", F.when(F.col("status").isin("ok", "ok_with_warnings"), fault)).withColumn(
        "outcome", F.when(F.col("status").isin("failed", "empty"), F.col("status"))
        .when(F.col("fault").isNull(), "strict").otherwise("lenient"))


def qa(converted: DataFrame, path: str, root: str, out_root: str, src_bytes: str = "src_bytes",
       text: str = "text", cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """Output path, size ratio and line-count class.

    Line counts are taken before bibliography removal, as in the original."""
    ratio = tx.size_ratio(F.col(text), F.col(src_bytes))
    return converted.select(
        "*",
        tx.output_path(F.col(path), root, out_root).alias("out_path"),
        F.octet_length(text).alias("out_bytes"),
        ratio.alias("ratio"),
        (ratio < cfg.small_ratio).alias("small_output"),
        tx.newline_count(F.col(text)).alias("lines"),
        tx.line_class(F.col(text), cfg.few_lines, cfg.some_lines).alias("line_class"),
    )


def out_path_collisions(qa_df: DataFrame) -> DataFrame:
    """Out paths produced by more than one source (last write would win)."""
    return qa_df.groupBy("out_path").agg(F.count("*").alias("sources")).where(F.col("sources") > 1)


def one_per_path(qa_df: DataFrame, path: str = "path") -> DataFrame:
    """Of the sources that share an output path the last by source path stays, as when files are written one
    after the other; ``sources`` says how many there were."""
    groups = qa_df.groupBy(F.col("out_path").alias("_out")).agg(F.count("*").alias("sources"))
    return latest(qa_df, "out_path", path).join(groups, F.col("out_path") == F.col("_out")).drop("_out")


def truncate(docs: DataFrame, text: str = "text", cfg: ConvertConfig = ConvertConfig()) -> DataFrame:
    """Add ``body`` (text before the first bibliography heading) and ``cut``."""
    body = tx.truncate_bibliography(F.col(text), cfg.headings)
    return docs.withColumn("body", body).withColumn("cut", F.col("body") != F.col(text))
