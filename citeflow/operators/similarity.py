"""K2: related-item discovery when no link edges are supplied — TF-IDF cosine
similarity of seed texts against a corpus, exact top-k per seed.

Plan shape:
  corpus → one bag (document, tokens, tf) per document, counted inside its own row and kept as
           one Parquet row; only documents whose id repeats go through a group
         → df per token → idf = ln(N / df)         (hash aggregate with map-side combine)
  tokens in every document have idf 0 and add nothing to any dot product or
  norm, so they are dropped exactly (no frequency cap).
  norms: the most frequent tokens map-side against a broadcast table of bounded size, the
  rest through a shuffle join without hot keys.
  seeds of measured size: their postings are broadcast, a bag keeps the seeds' tokens, meets its norm,
  and a task adds up all dot products of its documents and hands on the k best of each few
  documents, so no (seed, document) table is ever shuffled. A seed set beyond a broadcast is joined on the token.
  top-k: first per (seed, doc-bucket), then per seed over at most k × buckets
  rows — a seed's candidate list is never gathered whole into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .util import kept

TOKEN_SPLIT = r"[^\p{L}]+"

#: (token, seed) entries of a seed set that is broadcast.
SEED_POSTINGS = 1 << 21
#: Cells (document, seed) or products that one numpy pass holds.
PASS_CELLS = 1 << 21


@dataclass(frozen=True)
class TfidfIndex:
    """``bags`` (key, toks, tfs), one row per document; ``norms`` (key, dn); ``vocab`` (tok, df, idf, n)."""

    bags: DataFrame
    norms: DataFrame
    vocab: DataFrame


def _tokens(text: str):
    return F.filter(F.split(F.lower(F.col(text)), TOKEN_SPLIT), lambda x: x != "")


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tok, tf): letter-run tokens of lower-cased text, counted per document."""
    toks = df.select(key, F.explode(_tokens(text)).alias("tok"))
    return toks.groupBy(key, "tok").agg(F.count("*").alias("tf"))


def term_bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, toks, tfs): ``term_frequencies`` as one row per document with an id and a token.

    A document of one row is counted inside that row; only rows that share their id are exploded and grouped."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(key).isNotNull()).select(key, text)
    repeated = kept(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "repeated-ids")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, toks array<string>, tfs array<int>"

    def count(batches):
        for b in batches:
            words = pc.dictionary_encode(pc.list_flatten(b.column(1)))
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            width = max(1, len(words.dictionary))
            cell, tf = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * width
                                 + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            edge = pa.array(np.searchsorted(cell, np.arange(len(sizes) + 1) * width), pa.int32())
            toks = words.dictionary.take(pa.array(cell % width, pa.int64())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(edge, toks), pa.ListArray.from_arrays(edge, pa.array(tf, pa.int32()))],
                [key, "toks", "tfs"])

    single, more = rows, None
    if not repeated.isEmpty():
        on = F.col(key) == F.col("_key")
        single = rows.join(repeated, on, "left_anti")
        more = (term_frequencies(rows.join(repeated, on, "left_semi"), key, text).groupBy(key)
                .agg(F.collect_list(F.struct("tok", F.col("tf").cast("int").alias("tf"))).alias("x"))
                .select(key, F.col("x.tok").alias("toks"), F.col("x.tf").alias("tfs")))
    bags = single.select(key, _tokens(text).alias("toks")).where(F.size("toks") > 0).mapInArrow(count, schema)
    return bags if more is None else bags.unionByName(more)


def doc_freq(corpus_tf: DataFrame, n_docs) -> DataFrame:
    """(tok, df, idf) with idf = ln(N / df); N = documents with a token. ``corpus_tf`` has a row per (document, token)."""
    return (corpus_tf.groupBy("tok").agg(F.count("*").alias("df"))
            .select("tok", "df", F.log(n_docs / F.col("df")).alias("idf")))


def weights(tf: DataFrame, idf_df: DataFrame, key: str) -> DataFrame:
    """(key, tok, w) with w = tf · idf."""
    return tf.join(idf_df, "tok").select(key, "tok", (F.col("tf") * F.col("idf")).alias("w"))


def corpus_norms(bags: DataFrame, vocab: DataFrame, key: str, hot_fraction: int | None = None,
                 broadcast_tokens: int = 1 << 17) -> DataFrame:
    """(key, dn): the length of every document's weight vector; ``vocab`` is (tok, df, idf, n).

    A token found in many documents is a hot join key. The ``broadcast_tokens`` most frequent ones are joined
    map-side against a broadcast table and added up there; the rows of the others, a small part of any text, go
    through a shuffle join. With ``hot_fraction`` the hot tokens are those with df ≥ N / ``hot_fraction`` instead."""
    if hot_fraction is None:
        sizes = vocab.groupBy("df").agg(F.count("*").alias("c"))  # at most the square root of all pairs
        upto = sizes.select("df", F.sum("c").over(Window.orderBy(F.desc("df"))).alias("c"))
        least = upto.where(F.col("c") <= broadcast_tokens).agg(F.min("df")).first()[0]
        is_hot = F.col("df") >= least if least is not None else F.lit(False)
    else:
        is_hot = F.col("df") * hot_fraction >= F.col("n")
    rows = bags.select(key, F.explode(F.arrays_zip("toks", "tfs")).alias("x")).select(key, F.col("x.toks").alias("tok"), F.col("x.tfs").alias("tf"))
    marked = rows.join(F.broadcast(vocab.where(is_hot).select("tok", F.col("idf").alias("hot"))), "tok", "left")
    square = lambda idf: F.sum(F.pow(F.col("tf") * F.col(idf), 2.0)).alias("s")
    hot = marked.where(F.col("hot").isNotNull()).groupBy(key).agg(square("hot"))
    cold = (marked.where(F.col("hot").isNull()).select(key, "tok", "tf").join(vocab.where(~is_hot).select("tok", "idf"), "tok")
            .groupBy(key).agg(square("idf")))
    return hot.unionByName(cold).groupBy(key).agg(F.sqrt(F.sum("s")).alias("dn"))


def tfidf_index(corpus: DataFrame, doc_key: str = "doc_id", text: str = "text",
                hot_fraction: int | None = None) -> TfidfIndex:
    """Build the corpus side once, from one tokenisation pass: bags, vocabulary and norms, kept as Parquet.

    Rows without an id count as one document in the frequencies, as ever, but are no candidates."""
    bags = kept(term_bags(corpus, doc_key, text), "bags")
    n_docs = bags.count()
    toks = bags.select(F.explode("toks").alias("tok"))
    unnamed = corpus.where(F.col(doc_key).isNull()).select(F.explode(_tokens(text)).alias("tok")).distinct()
    vocab = doc_freq(toks.unionByName(unnamed), F.lit(n_docs)).where(F.col("idf") > 0)
    vocab = kept(vocab.withColumn("n", F.lit(n_docs).cast("bigint")), "vocabulary")
    return TfidfIndex(bags, kept(corpus_norms(bags, vocab, doc_key, hot_fraction), "norms"), vocab)


def related_items(seeds: DataFrame, corpus: DataFrame, k: int = 5, seed_key: str = "item_id",
                  doc_key: str = "doc_id", text: str = "text", buckets: int = 64,
                  index: TfidfIndex | None = None, seed_postings: int = SEED_POSTINGS) -> DataFrame:
    """(seed_key, rank, doc_key, sim): the k most similar documents per seed.

    Order is sim (rounded to 6 places) descending, then document id; cosine over
    TF-IDF vectors in the corpus vocabulary (idf from the corpus). ``index`` may
    be a prebuilt ``tfidf_index(corpus)`` to serve many seed sets."""
    index = index if index is not None else tfidf_index(corpus, doc_key, text)
    stf = term_frequencies(seeds.where(F.col(seed_key).isNotNull()), seed_key, text)
    sw = stf.join(index.vocab.select("tok", "idf"), "tok").select(seed_key, "tok", "idf", (F.col("tf") * F.col("idf")).alias("ws"))
    sw = kept(sw, "seed-weights")
    sn = sw.groupBy(seed_key).agg(F.sqrt(F.sum(F.col("ws") * F.col("ws"))).alias("sn"))
    if sw.count() <= seed_postings:
        dot = _best_dots(index, sw, sn, k, seed_key, doc_key)
    else:
        rows = index.bags.select(doc_key, F.explode(F.arrays_zip("toks", "tfs")).alias("x")).select(
            doc_key, F.col("x.toks").alias("tok"), F.col("x.tfs").alias("tf"))
        dot = (rows.join(sw, "tok").groupBy(seed_key, doc_key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("ws")).alias("dot"))
               .join(index.norms, doc_key).join(sn, seed_key))
    sim = dot.select(seed_key, doc_key, F.round(F.col("dot") / (F.col("dn") * F.col("sn")), 6).alias("sim"))
    return top_k(sim, seed_key, doc_key, k, buckets)


def _best_dots(index: TfidfIndex, sw: DataFrame, sn: DataFrame, k: int, seed_key: str, doc_key: str) -> DataFrame:
    """(seed_key, doc_key, dot, dn, sn): of every few documents of a task those that may be among the k best of a seed.

    ``sw`` is of measured size. What is left out has k better documents beside it, however the similarity rounds."""
    spark = sw.sparkSession
    ship_package(spark)
    named = [(i, r[seed_key], r["sn"]) for i, r in enumerate(sn.orderBy(seed_key).collect())]
    number = {s: i for i, s, _ in named}
    posted = sorted((r["tok"], number[r[seed_key]], r["idf"] * r["ws"]) for r in sw.collect())
    toks = sorted({t for t, _, _ in posted})
    place = {t: i for i, t in enumerate(toks)}
    first = np.searchsorted(np.array([place[t] for t, _, _ in posted], dtype=np.int64), np.arange(len(toks) + 1))
    shared = spark.sparkContext.broadcast((toks, first, np.array([s for _, s, _ in posted], dtype=np.int64),
                                           np.array([v for _, _, v in posted]), np.array([x for _, _, x in named])))
    kind = index.bags.schema[doc_key].dataType.simpleString()

    def restrict(batches):
        wanted = pa.array(shared.value[0], pa.string())
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            at = pc.index_in(pc.list_flatten(b.column(1)), value_set=wanted)
            hit = at.is_valid()
            edge = np.concatenate(([0], np.cumsum(hit.to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(sizes)))]
            edge = pa.array(edge, pa.int32())
            tf = pc.list_flatten(b.column(2)).filter(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edge, at.filter(hit)), pa.ListArray.from_arrays(edge, tf)],
                                             [doc_key, "at", "tfs"])

    def best(batches):
        _, first, seed, value, lengths = shared.value
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            edge = np.concatenate(([0], np.cumsum(sizes)))
            at, tf = (pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            norm = b.column(3).to_numpy(zero_copy_only=False)
            n = first[at + 1] - first[at]
            products = np.concatenate(([0], np.cumsum(n)))[edge]
            cost = np.cumsum(np.maximum(np.diff(products), len(lengths)))
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PASS_CELLS, side="right")))
                x, y = edge[lo], edge[hi]
                m = n[x:y]
                entry = np.repeat(first[at[x:y]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                doc = np.repeat(np.repeat(np.arange(hi - lo), sizes[lo:hi]), m)
                dots = np.bincount(doc * len(lengths) + seed[entry], np.repeat(tf[x:y], m) * value[entry], (hi - lo) * len(lengths))
                cell = np.flatnonzero(dots)
                d, s, dot = cell // len(lengths), cell % len(lengths), dots[cell]
                millionths = dot / (norm[lo:hi][d] * lengths[s]) * 1e6
                low, high = np.floor(millionths + (0.5 - 1e-5)), np.floor(millionths + (0.5 + 1e-5))
                d_id = b.column(0).slice(lo, hi - lo).take(pa.array(d))
                order = pc.sort_indices(pa.table({"s": s, "r": -low, "id": d_id}), [("s", "ascending"), ("r", "ascending"), ("id", "ascending")]).to_numpy()
                in_seed = np.arange(len(order)) - np.searchsorted(s[order], s[order])
                take = order[(in_seed < k) | (low != high)[order]]
                yield pa.RecordBatch.from_arrays([pa.array(s[take], pa.int32()), d_id.take(pa.array(take)), pa.array(dot[take]), pa.array(norm[lo:hi][d[take]])],
                                                 ["_seed", doc_key, "dot", "dn"])
                lo = hi

    near = index.bags.mapInArrow(restrict, f"`{doc_key}` {kind}, at array<int>, tfs array<int>").where(F.size("at") > 0)
    found = near.join(index.norms, doc_key).select(doc_key, "at", "tfs", "dn").mapInArrow(best, f"_seed int, `{doc_key}` {kind}, dot double, dn double")
    seed_kind = sw.schema[seed_key].dataType.simpleString()
    return found.join(F.broadcast(spark.createDataFrame(named, f"_seed int, `{seed_key}` {seed_kind}, sn double")), "_seed")


def vector_neighbours(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding",
                      group: str = "label", k: int = 5, buckets: int = 64) -> DataFrame:
    """K2 over vectors: (centroid, rank, key, sim) — the k vectors closest (cosine)
    to each group's mean vector.

    The centroids are a stated query set, one row per group: means per dimension (an
    aggregate with map-side combine), gathered as one array row. Every vector meets all of them
    inside its own row, as array expressions, so vectors are neither exploded nor shuffled
    before the top-k.
    """
    mean = (vectors.select(group, F.posexplode(vec).alias("dim", "x"))
            .groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("c")))
    one = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("c"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    cents = one.select(F.struct(F.col(group).alias("centroid"), "c", norm(F.col("c")).alias("cn")).alias("s"))
    table = cents.agg(F.collect_list("s").alias("all"))  # one row: the query set
    rows = vectors.select(key, F.transform(vec, lambda x: x.cast("double")).alias("v")).withColumn("vn", norm(F.col("v")))
    met = rows.withColumn("all", table.scalar()).select(key, "v", "vn", F.inline("all"))
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    sim = met.select("centroid", key, F.round(dot / (F.col("vn") * F.col("cn")), 6).alias("sim"))
    return top_k(sim, "centroid", key, k, buckets)


def top_k(sim: DataFrame, seed_key: str, item_key: str, k: int, buckets: int = 64) -> DataFrame:
    """Exact top-k per seed by (sim desc, item asc) in two phases, so no seed's
    full candidate list is ever sorted in one task."""
    order = [F.desc("sim"), F.asc(item_key)]
    b = F.pmod(F.xxhash64(item_key), F.lit(buckets))
    w1 = Window.partitionBy(seed_key, "_b").orderBy(*order)
    local = (sim.withColumn("_b", b).withColumn("_r", F.row_number().over(w1))
             .where(F.col("_r") <= k))
    w2 = Window.partitionBy(seed_key).orderBy(*order)
    return (local.withColumn("rank", F.row_number().over(w2).cast("bigint")).where(F.col("rank") <= k)
            .select(seed_key, "rank", item_key, "sim"))
