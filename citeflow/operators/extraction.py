"""Structured per-paper extraction tables (S6): typing, union of layouts,
category and entity frequencies, quantity parsing (A10, I6, K3-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg

# FIXED VALUES: header → canonical column, per layout, in header order.
V25_RENAME = dict(zip(cfg.EXTRACTION_V25_COLUMNS, (
    "authors", "title", "journal", "year", "doi", "pmid", "pmcid", "species", "samples",
    "sweeps", "sweep_methods", "sel_coef", "sel_coef_value", "pooled", "soft_sweeps",
    "soft_sweep_tools", "balancing", "purifying", "go_enrichment", "go_terms", "genes",
    "sweep_genes", "polygenic", "polygenic_traits", "notes",
)))
V23_RENAME = dict(zip(cfg.EXTRACTION_V23_COLUMNS, (
    "authors", "title", "journal", "year", "doi", "species", "samples",
    "sweeps", "sweep_methods", "sel_coef", "sel_coef_value", "pooled", "soft_sweeps",
    "soft_sweep_tools", "balancing", "purifying", "go_enrichment", "go_terms", "genes",
    "sweep_genes", "polygenic", "polygenic_traits", "notes",
)))

FLAG_COLUMNS = ("sweeps", "sel_coef", "pooled", "soft_sweeps", "balancing", "purifying",
                "go_enrichment", "polygenic")
LIST_COLUMNS = ("authors", "sweep_methods", "soft_sweep_tools", "go_terms", "genes",
                "sweep_genes", "polygenic_traits")
LIST_SEPARATOR = r"\s*[;,]\s*"


def yes_no(col: Column) -> Column:
    """K3: Yes/No → BOOLEAN, anything else → NULL."""
    v = F.lower(F.trim(col))
    return F.when(v == "yes", F.lit(True)).when(v == "no", F.lit(False))


def as_list(col: Column) -> Column:
    """K3: ', ' or '; ' separated cell → ARRAY<STRING>; empty → NULL."""
    parts = F.filter(F.split(F.trim(col), LIST_SEPARATOR), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def leading_int(col: Column) -> Column:
    """Leading integer of a cell such as ``295 (187 contemporary + 108 historical)``."""
    return F.regexp_extract(col, r"^\s*(\d+)", 1).try_cast("int")


def canonical(df: DataFrame, rename: dict) -> DataFrame:
    """Header names → canonical names (the layouts drift between files)."""
    return df.select([F.col(f"`{h}`").alias(c) for h, c in rename.items() if h in df.columns])


def typed(df: DataFrame) -> DataFrame:
    """K3 on canonical STRING columns; columns a layout lacks are skipped."""
    out = []
    for c in df.columns:
        col = F.nullif(F.trim(F.col(c)), F.lit(""))
        if c in FLAG_COLUMNS:
            out.append(yes_no(col).alias(c))
        elif c in LIST_COLUMNS:
            out.append(as_list(col).alias(c))
        elif c == "year":
            out.append(col.try_cast("int").alias(c))
        elif c == "pmid":
            out.append(col.try_cast("bigint").alias(c))
        elif c == "samples":
            out.append(col.alias(c))
            out.append(leading_int(col).alias("samples_n"))
        else:
            out.append(col.alias(c))
    return df.select(out)


def union_layouts(*frames: DataFrame) -> DataFrame:
    """Append rows of several layouts; missing columns become NULL."""
    it = iter(frames)
    acc = next(it)
    for f in it:
        acc = acc.unionByName(f, allowMissingColumns=True)
    return acc


def category_frequency(df: DataFrame, flags) -> DataFrame:
    """K4: (category, yes, answered, share) — the flag columns are unpivoted
    in place (one row per flag, no shuffle) and counted in one aggregation.
    ``share`` = yes / answered; NULL answers are not counted as answered."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("category"), F.col(f).cast("boolean").alias("flag")) for f in flags])))
    return long.groupBy("category").agg(
        F.count_if(F.col("flag")).alias("yes"),
        F.count("flag").alias("answered"),
    ).withColumn("share", F.round(F.try_divide(F.col("yes"), F.col("answered")), 6))


def entity_frequency(df: DataFrame, list_col: str, key: str) -> DataFrame:
    """K5: (entity, papers) = distinct papers mentioning each entity.

    (entity, key) pairs are de-duplicated first (partial aggregation per task),
    so a very common entity costs one pre-reduced row per task, not one per paper."""
    pairs = df.select(key, F.explode(list_col).alias("entity")).where(F.col("entity") != "")
    return pairs.distinct().groupBy("entity").agg(F.count("*").alias("papers"))


#: A number: thousands groups, or digits with an optional fraction and exponent.
_NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\d])"
#: A sign belongs to a number only where no digit, letter or point stands before it.
_SIGNED = rf"(?<![\d.A-Za-z,])([-+]?{_NUMBER})"
RANGE_RX = rf"{_SIGNED}\s*[-\x{{2013}}]\s*({_NUMBER})"


def is_range(col: Column) -> Column:
    """True when the cell holds a lo–hi range."""
    return F.regexp_extract(col, RANGE_RX, 1) != ""


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def quantity_bounds(col: Column) -> tuple[Column, Column]:
    """K6: ``~0.01-0.16`` / ``2 loci, 0.06–0.20 per year`` → (lo, hi) of the first range; without a
    range the first number (``1e-4``, ``1,024``, ``-0.05``) → (x, x)."""
    ranged = is_range(col)
    single = _number(F.regexp_extract(col, _SIGNED, 1))
    return (F.when(ranged, _number(F.regexp_extract(col, RANGE_RX, 1))).otherwise(single),
            F.when(ranged, _number(F.regexp_extract(col, RANGE_RX, 2))).otherwise(single))
