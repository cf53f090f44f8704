"""Line de-duplication by winnowing over line hashes.

Each document is its sequence of non-blank lines, trimmed and hashed (128 bits, as lines are deleted by equal
hashes). In every window of ``min_run`` consecutive lines the smallest line hash is a fingerprint, so any run of that many
lines shared by two places shares one. Fingerprints that occur once drop out; from each other
one the match is extended both ways, as far as any run of ``min_run`` lines around it reaches, by
grouping those runs. A line of ``lone_words`` words or more is a run of its own, so a licence line between unique
neighbours and a text of one line are found too; shorter lines count only beside another repeated one. A run
that occurred before is a repeat, and its lines are deleted; overlapping repeats merge into longer ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot_split, join_small_or_shuffle, stored

#: Lines of the shortest repeated run, and words of a line that is one by itself.
MIN_RUN, LONE_WORDS = 2, 5

_TRIM = " \t\r"
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def _lines(docs: DataFrame, lone_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n, at, h, lone): places and hashes of the non-blank lines, and the indices of those long enough to stand alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    long = f"^(?:{_WORD}){{{lone_words}}}"
    every = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("at"), F.btrim(x, F.lit(_TRIM)).alias("line")))
    full = F.filter(every, lambda x: x["line"] != "")
    return (rows.withColumn("full", full)
            .select("doc_id", "th", F.size("full").alias("n"), F.transform("full", lambda x: x["at"]).alias("at"),
                    F.transform("full", lambda x: F.unhex(F.md5(x["line"].cast("binary")))).alias("h"),
                    F.filter(F.transform("full", lambda x, i: F.when(x["line"].rlike(long), i)), lambda i: i.isNotNull()).alias("lone")))


def _fingerprints(lines: DataFrame, run: int) -> DataFrame:
    """(print, doc_id, th, n, p, around): the window minima and the line hashes they can be extended over."""
    places = F.transform(F.sequence(F.lit(0), F.col("n") - run), lambda s: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(run - 1)), lambda j: F.struct(F.get("h", s + j).alias("print"), (s + j).alias("p")))))
    return (lines.where(F.col("n") >= run).select("doc_id", "th", "n", "h", F.explode(F.array_distinct(places)).alias("x"))
            .select("x.print", "doc_id", "th", "n", "x.p", F.greatest(F.col("x.p") - (run - 1), F.lit(0)).alias("low"), "h")
            .select("print", "doc_id", "th", "n", "p", "low", F.slice("h", F.col("low") + 1, 2 * run - 1).alias("around")))


def repeated_lines(docs: DataFrame, min_run: int = MIN_RUN, lone_words: int = LONE_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_lines, removed): per distinct row the sorted places (among all lines) of repeated lines."""
    lines = stored(_lines(docs, lone_words, id_col, text_col), "lines")
    distinct = lines.select("doc_id", "th", "n", "h", "lone").dropDuplicates(["doc_id", "th"])
    prints = stored(_fingerprints(distinct, min_run), "line-prints")
    total = prints.count()
    shared = prints.groupBy("print").agg(F.count("*").alias("m")).where("m > 1")
    hits = join_hot_split(prints, shared, "print", "m", total, "inner").drop("m")
    begins = F.sequence(F.col("low"), F.least(F.col("p"), F.col("n") - min_run))
    runs = (hits.withColumn("s", F.explode(begins))
            .withColumn("run", F.unhex(F.md5(F.concat(F.lit(b"run"), *[F.get("around", F.col("s") - F.col("low") + j) for j in range(min_run)]))))
            .select("run", "doc_id", "th", "s", F.lit(min_run).alias("size")).distinct())
    alone = (distinct.select("doc_id", "th", "h", F.explode("lone").alias("s"))
             .select(F.get("h", "s").alias("run"), "doc_id", "th", "s", F.lit(1).alias("size")))
    runs = stored(runs.unionByName(alone), "line-runs")
    first = (runs.groupBy("run").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "th", "s")).alias("first")).where("m > 1"))
    later = (join_hot_split(runs, first, "run", "m", runs.count(), "inner")
             .where(F.struct("doc_id", "th", "s") != F.col("first"))
             .groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "size")).alias("starts")))
    places = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["s"], x["s"] + x["size"] - 1))))
    later = stored(later.select(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"), places.alias("places")), "repeats")
    size = later.agg(F.count("*").alias("rows"), F.sum(F.size("places")).alias("places")).first()
    on = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))
    own = join_small_or_shuffle(lines.select("doc_id", "th", "n", "at").dropDuplicates(["doc_id", "th"]), later, on, "left",
                                64 * size["rows"] + 4 * (size["places"] or 0), 1)
    removed = F.coalesce(F.sort_array(F.transform("places", lambda p: F.get("at", p))), F.array().cast("array<int>"))
    return own.select("doc_id", "th", F.col("n").alias("n_lines"), removed.alias("removed"))


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, lone_words: int = LONE_WORDS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_lines (non-blank), n_removed, removed_lines, text.

    A line goes when it has ``lone_words`` words or more, or lies in a run of ``min_run`` or more consecutive non-blank lines, and
    that line or run occurred before: in a row of smaller id (null first), or earlier in the same text. ``removed_lines`` lists
    the places of the lines among all lines of the text, from 0, comma-joined. Blank lines are not compared and
    stay. Null and empty texts have no lines; a null text stays null. Rows equal in id and text
    are one document and get equal results. A text's lines are one array in its row, whatever their number. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(F.col(text_col)).alias("d_th"), F.col(text_col).alias("text"))
    found = stored(repeated_lines(docs, min_run, lone_words, id_col, text_col), "removed-lines")
    size = found.agg(F.count("*").alias("rows"), F.sum(F.size("removed")).alias("n")).first()
    on = F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_th") == F.col("th"))
    out = join_small_or_shuffle(rows, found, on, "inner", 64 * size["rows"] + 4 * (size["n"] or 0), 1)
    keep = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"),
                      F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"),
                      F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(keep, "\n")).alias("text"))
