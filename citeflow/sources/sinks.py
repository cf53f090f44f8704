"""Sinks B1-B8. Writers take a DataFrame and a target folder; they never collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg


def ranked_table(ranked: DataFrame) -> DataFrame:
    """B1 layout: PMID, Score, WeightedScore (%.6f text), Seeds (comma-joined), globally ordered."""
    if ranked.schema["seeds"].dataType.typeName() == "array":
        ranked = ranked.withColumn("seeds", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ","))
    return ranked.orderBy(F.desc("weighted"), F.desc("score"), F.asc("pmid")).select(
        F.col("pmid").alias("PMID"),
        F.col("score").alias("Score"),
        F.format_string("%.6f", F.col("weighted")).alias("WeightedScore"),
        F.col("seeds").alias("Seeds"),
    )


def write_ranked(ranked: DataFrame, path: str, single_file: bool = False) -> None:
    """B1: TSV with header. The global order is kept across part files (range
    partitioned sort); ``single_file`` funnels into one task and is meant only
    for bounded outputs."""
    out = ranked_table(ranked)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_threshold_lists(lists: DataFrame, path: str) -> None:
    """B2: one headerless id list per threshold folder, ids ascending over its files and within them.

    Range partitions on (threshold, id): a threshold that holds almost all candidates is many tasks."""
    (lists.repartitionByRange("threshold", "pmid").sortWithinPartitions("threshold", "pmid")
     .select(F.col("threshold"), F.col("pmid").cast("string").alias("value"))
     .write.mode("overwrite").partitionBy("threshold").text(path))


def write_crosswalk(xwalk: DataFrame, path: str) -> None:
    """pmid<TAB>pmcid, overwrite (truncate-then-append in one step)."""
    (xwalk.where(F.col("pmcid").isNotNull() & (F.col("pmcid") != ""))
     .select("pmid", "pmcid").write.mode("overwrite").option("sep", "\t").csv(path))


def write_landed(docs: DataFrame, path: str) -> None:
    """Landed documents routed by status (restricted ones in their own folder)."""
    docs.write.mode("overwrite").partitionBy("status").parquet(path)


def write_converted(converted: DataFrame, path: str) -> None:
    """Converted text keyed by out_path (collisions surface as duplicate keys)."""
    converted.write.mode("overwrite").parquet(path)


def report_lines(hits: DataFrame, total_docs) -> DataFrame:
    """Fixed-width report rows (line_no, line), header first, then
    ``name padded 40 | count right-aligned 12`` by count desc, name asc, with
    the blank lines before, between and after.

    ``total_docs`` is a Column (e.g. a scalar subquery) or an int.
    """
    spark = hits.sparkSession
    rule = "=" * cfg.REPORT_RULE_WIDTH
    total = total_docs if not isinstance(total_docs, int) else F.lit(total_docs)
    header = [
        F.lit(""),
        F.lit(cfg.REPORT_TITLE),
        F.lit(rule),
        F.format_string(cfg.REPORT_TOTAL_LABEL + "%d", total),
        F.lit(rule),
        F.lit(""),
        F.format_string(f"%-{cfg.REPORT_NAME_WIDTH}s | %{cfg.REPORT_COUNT_WIDTH}s",
                        F.lit(cfg.REPORT_NAME_HEADER), F.lit(cfg.REPORT_COUNT_HEADER)),
        F.lit("-" * cfg.REPORT_RULE_WIDTH),
    ]
    head = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("line_no"), c.alias("line")) for i, c in enumerate(header)])))
    body = hits.select(
        F.format_string(f"%-{cfg.REPORT_NAME_WIDTH}s | %{cfg.REPORT_COUNT_WIDTH}d",
                        "term", "papers").alias("line"),
        "papers", "term")
    # The body is one row per term group (dictionary-sized), so a global
    # row_number over it is bounded by the dictionary, not by the corpus.
    w = Window.orderBy(F.desc("papers"), F.asc("term"))
    last = body.agg((F.count("*") + len(header)).cast("int").alias("line_no"), F.lit("").alias("line"))
    body = body.select((F.row_number().over(w) + len(header) - 1).alias("line_no"), "line")
    return head.unionByName(body).unionByName(last)


def output_name_for_format(fmt_col, id_col) -> F.Column:
    """Output file name by format: PMC<id>.xml / .html / .pdf; null for any other format."""
    fmt_col = F.when(fmt_col.isin("xml", "html", "pdf"), fmt_col)
    return F.concat(F.lit(cfg.PMC_PREFIX), id_col.cast("string"), F.lit("."), fmt_col)
