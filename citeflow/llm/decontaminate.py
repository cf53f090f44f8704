"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts become word arrays, word 5-grams are hashed, and the smallest hash of every 6
consecutive 5-grams is kept as a fingerprint: any 10 words that a document shares with
a benchmark item contain one common fingerprint, so joining the two fingerprint sets
misses no shared span. Each hit is then extended along its diagonal (document position
minus item position) by comparing the words themselves; windows that agree in every
word are the result, so hash collisions cannot add any. Items shorter than 10 words
are one window of their own length and are found by the hash of the whole item.

Rows are identified by (id, hash of the text), so rows that repeat an id get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, join_small_or_shuffle, stored

#: Words of a window, of a hashed gram; a span of WINDOW words has WINDOW - GRAM + 1 grams.
WINDOW, GRAM = 10, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of the whole text after lower-casing A-Z; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS)
    return F.array_remove(parts, "")


def _grams(hashes: Column, n: Column, k: int) -> Column:
    """Hash of every k consecutive word hashes (empty when there are fewer than k)."""
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(
        *[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, n: Column) -> Column:
    """Distinct smallest gram of every window (empty for fewer than WINDOW words)."""
    width = WINDOW - GRAM + 1
    return F.when(n >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(
        *[F.get(grams, i + j) for j in range(width)])))).otherwise(F.array().cast("array<bigint>"))


def _with_grams(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("words", word_array(F.col("text")))
            .withColumn("n", F.size("words"))
            .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("grams", _grams(F.col("hashes"), F.col("n"), GRAM)))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = (benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
            .where("item_id is not null").distinct())
    return _with_grams(rows).where("n > 0")


def _item_prints(items: DataFrame, short: list[int]) -> DataFrame:
    """(print, item_id, item_pos, item_words, span): where each fingerprint stands in each item."""
    long = items.where(F.col("n") >= WINDOW).withColumn("minima", _minima(F.col("grams"), F.col("n")))
    long = (long.select("item_id", "words", "minima", F.posexplode("grams").alias("item_pos", "print"))
            .where(F.array_contains("minima", F.col("print")))
            .select("print", "item_id", "item_pos", F.col("words").alias("item_words"), F.lit(WINDOW).alias("span")))
    for k in short:
        whole = items.where(F.col("n") == k).withColumn("print", F.get(_grams(F.col("hashes"), F.col("n"), k), F.lit(0)))
        long = long.unionByName(whole.select("print", "item_id", F.lit(0).alias("item_pos"),
                                             F.col("words").alias("item_words"), F.lit(k).alias("span")))
    return long.distinct()


def _screen(rows: DataFrame, keys: DataFrame, n_keys: int, short: list[int]) -> DataFrame:
    """(doc_id, th, n, copies, n_prints): word count and number of fingerprints shared with any item.

    One pass over the whole table; ``copies`` counts rows equal in id and text. The aggregate is
    fixed-width and all fingerprints of a row sit in one task, so it folds before any shuffle.
    """
    full = _with_grams(rows)
    own = _minima(F.col("grams"), F.col("n"))
    for k in short:
        own = F.array_union(own, _grams(F.col("hashes"), F.col("n"), k))
    prints = (full.select("doc_id", "th", "n", own.alias("own"))
              .select("doc_id", "th", "n", F.greatest(F.size("own"), F.lit(1)).alias("m"), F.explode_outer("own").alias("print"))
              .withColumn("print", F.coalesce("print", "th")))  # rows without fingerprints spread by their text's hash
    return (join_small_or_shuffle(prints, keys, F.col("print") == F.col("i_print"), "left", n_keys, 16)
            .groupBy("doc_id", "th", "n", "m").agg(F.count(F.lit(1)).alias("rows"), F.count("i_print").alias("n_prints"))
            .select("doc_id", "th", "n", (F.col("rows") / F.col("m")).cast("int").alias("copies"), "n_prints"))


def _pairs(texts: DataFrame, keys: DataFrame, prints: DataFrame, n_prints: int, short: list[int]) -> DataFrame:
    """(doc_id, th, item_id, span, diagonal, lead, doc_part, item_words): aligned stretches to compare."""
    full = _with_grams(texts)
    by_size = [(GRAM, F.col("grams"))] + [(k, _grams(F.col("hashes"), F.col("n"), k)) for k in short if k != GRAM]
    marks = F.array_distinct(F.concat(*[g for _, g in by_size]))
    hits = (join_small_or_shuffle(full.select("doc_id", "th", F.explode(marks).alias("print")), keys,
                                  F.col("print") == F.col("i_print"), "inner", n_prints, 16)
            .groupBy(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th")).agg(F.collect_set("print").alias("hits")))
    here = full.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")))
    at = F.concat(*[F.filter(F.transform(g, lambda x, i: F.struct(i.alias("pos"), x.alias("print"))),
                             lambda s: F.array_contains("hits", s["print"])) for _, g in by_size])
    places = here.select("doc_id", "th", "words", F.explode(at).alias("at")).select("doc_id", "th", "words", "at.pos", "at.print")
    lead, diagonal = F.col("lead"), F.col("diagonal")
    return (join_small_or_shuffle(places, prints, "print", "inner", n_prints, 1024)
            .withColumn("diagonal", F.col("pos") - F.col("item_pos"))
            .withColumn("lead", F.greatest(F.lit(0), -diagonal))  # item words that would lie before the document
            .select("doc_id", "th", "item_id", "span", "diagonal", "lead", "item_words",
                    F.slice("words", diagonal + lead + 1, F.size("item_words") - lead).alias("doc_part"))
            .dropDuplicates(["doc_id", "th", "item_id", "diagonal", "item_words"]))


def _spans(pairs: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, first, end): every window that agrees word by word."""
    there = F.slice("item_words", F.col("lead") + 1, F.size("doc_part"))
    same = pairs.withColumn("same", F.zip_with("doc_part", there, lambda a, b: a == b)).where(F.size("same") >= F.col("span"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("span")),
                      lambda s: F.forall(F.slice("same", s + 1, F.col("span")), lambda x: x))
    return (same.select("doc_id", "th", "item_id", "span", "diagonal", "lead", F.explode(starts).alias("start"))
            .withColumn("first", F.col("diagonal") + F.col("lead") + F.col("start"))
            .select("doc_id", "th", "item_id", "first", (F.col("first") + F.col("span")).alias("end")).distinct())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items, text_hash.

    ``spans`` are the merged (first word, end) ranges that occur in an item, ``items`` the sorted
    ids. Null or empty texts have no words and no hit; items without id or words are left out;
    an empty benchmark gives no hit; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("th"))
    items = stored(_items(benchmark, item_col, item_text_col), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 9
    prints = stored(_item_prints(items, short), "item-prints")
    n_prints = prints.count()
    keys = prints.select(F.col("print").alias("i_print")).distinct()
    found = stored(_screen(rows, keys, n_prints, short), "screened")

    hit = found.where("n_prints > 0").select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"))
    on = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th"))
    texts = join_small_or_shuffle(rows, hit, on, "inner", hit.count(), 48).select("doc_id", "th", "text")
    texts = stored(texts.dropDuplicates(["doc_id", "th"]), "hit-texts")
    spans = stored(_spans(_pairs(texts, keys, prints, n_prints, short)), "spans")

    by_doc = Window.partitionBy("doc_id", "th").orderBy("first", "end")
    reached = F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    ranges = (spans.select("doc_id", "th", "first", "end").distinct().withColumn("reached", reached)
              .withColumn("part", F.sum(F.when(F.col("first") > F.col("reached"), 1).otherwise(0)).over(by_doc))
              .groupBy("doc_id", "th", "part").agg(F.min("first").alias("first"), F.max("end").alias("end"))
              .groupBy("doc_id", "th").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"),
                                           F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans")))
    by_item = (spans.groupBy(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"))
               .agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    hits = (ranges.join(by_item, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th")))
            .select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "n_hit", "spans", "items"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (found.join(hits, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", F.col("n").cast("bigint").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
                    F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
                    ids.alias("items"), F.col("th").alias("text_hash")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with any benchmark item."""
    p = free_prefix(docs.columns, "bad_")
    bad = (decontaminate(docs, benchmark, id_col, text_col).where("contaminated")
           .select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}text")).distinct())
    bad = stored(bad, "contaminated")
    on = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{p}text"))
    return join_small_or_shuffle(docs, bad, on, "left_anti", bad.count(), 48)
