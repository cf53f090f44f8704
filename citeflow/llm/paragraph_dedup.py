"""Substring de-duplication: MinHash banding over paragraphs, and exact windows inside them.

Two kinds of passage are compared. *Natural* ones are the lines of ``k`` words or more: MinHash signatures are cut in bands,
paragraphs sharing a band are joined, and their exact Jaccard similarity over distinct 5-word shingles decides. Lines
of fewer than MIN_WORDS words have too few shingles for that many bands; their bands are single minima, as
many as make sure that two lines of the wanted similarity share one. *Embedded* passages are exact runs of MIN_WORDS words
or more at any place. Seeds of ``seed`` words begin at content-chosen places (the smallest shingle of every window
of MIN_WORDS - seed + 1), so any run of MIN_WORDS words holds a seed wherever it stands. Around the seeds
that occur again every window of MIN_WORDS words is compared, so a shared passage is found up to
its last word for each pair of copies: its windows cover it, and no pair is ever written out.

Windows beside each other that choose the same place form a *span*; its seed begins there. Spans are grouped first, one row
each. Equal windows choose the same place, so they stand in spans of one seed. Where all spans of a seed are equal, the
group decides for its windows; only where spans of one seed differ, as at the ends of a copy or beside an edit, are they
taken apart into windows, once per distinct span. So the rows follow the places of seeds, not the words. Spans and windows
are equal when two hashes of 64 bits are, one of their shingles and one of their words.

Equal paragraphs are one class from the start (one row per class meets in the join, however many
copies there are); links between classes are clustered by connected components. Of each cluster, and of
each class of equal windows, the first occurrence (smallest id, then place) stays and the others are cut out of their texts.
Stored tables are removed after their last reader.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SPACE_WORD, connected_components, discard, gram_hashes, join_hot_split, join_small_or_shuffle, mixed,
                     ship_code, spread_tasks, stored, stored_part, text_chunks, word_places, word_spans)
from ..session import shared_dir
from .ngram_join import JoinConfig, candidates, shared_keys, sketch, verify

_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ParagraphConfig:
    """5-word shingles, Jaccard 0.8; bands x rows find a pair at 0.8 with probability 0.998."""

    k: int = 5
    percent: int = 80
    min_words: int = 25
    seed: int = 13
    bands: int = 12
    rows: int = 4

    @property
    def reach(self) -> int:
        """Shingles in a window of places, of which the smallest begins a seed."""
        return self.min_words - self.seed + 1


def recall(c: ParagraphConfig, similarity: float) -> float:
    """Probability that banding finds a pair of this similarity."""
    return 1 - (1 - similarity ** c.rows) ** c.bands


def _minima(grams: np.ndarray, window: int) -> np.ndarray:
    """Per window the place of its smallest gram (the earliest of equal ones)."""
    h = mixed(grams)
    least = np.arange(len(h))
    if len(h) < window:
        return least[:0]

    def smaller(a, b):
        return np.where(h[b] < h[a], b, a)

    width = 1
    while width * 2 <= window:  # minima over 1, 2, 4, ... places, then over the window
        least = smaller(least[: len(least) - width], least[width:])
        width *= 2
    rest = window - width
    return smaller(least[: len(least) - rest], least[rest:]) if rest else least


def _viable(size: int, at: np.ndarray, hits: np.ndarray, c: ParagraphConfig) -> np.ndarray:
    """Places of the windows of min_words words that can occur again: all their seeds do. ``at`` are the places
    chosen in a text of ``size`` shingles.

    A seed counts when the window of places that chose it lies inside, so that any copy has it too.
    """
    n = size - (c.min_words - c.k)
    hit = np.zeros(size, dtype=bool)
    hit[hits] = True
    x = np.flatnonzero(~hit[at])
    low = np.maximum(np.maximum(x - (c.min_words - c.k + 1 - c.reach), at[x] - (c.reach - 1)), 0)
    bad = np.zeros(size + 1, dtype=np.int64)
    np.add.at(bad, low, 1)
    np.add.at(bad, x + 1, -1)
    return np.flatnonzero(np.cumsum(bad)[:n] == 0)


def _run_hashes(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the sequence grams[begin:end], by running sums."""
    if not len(begin):
        return np.empty(0, dtype=np.int64)
    n = len(grams)
    power = np.full(n, _ODD, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    undo = np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64)
    undo[0] = 1
    undo = np.multiply.accumulate(undo)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(grams) * power, dtype=np.uint64)))
    return mixed((total[end] - total[begin]) * undo[begin] + (end - begin).astype(np.uint64) * _ODD2).view(np.int64)


def _bands(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, c: ParagraphConfig) -> np.ndarray:
    """(paragraph, band) keys from the minima of bands * rows hash functions."""
    if not len(begin):
        return np.empty((0, c.bands), dtype=np.uint64)
    size = end - begin
    cut = np.cumsum(size) - size
    grams = grams[np.repeat(begin - cut, size) + np.arange(size.sum())]
    keys = np.empty((len(begin), c.bands), dtype=np.uint64)
    seeds = mixed(np.arange(1, c.bands * c.rows + 1, dtype=np.uint64) * _ODD)
    factors = mixed(seeds) | np.uint64(1)
    for band in range(c.bands):
        key = np.full(len(begin), band + 1, dtype=np.uint64)
        for j in range(band * c.rows, (band + 1) * c.rows):
            value = (grams ^ seeds[j]) * factors[j]
            value ^= value >> np.uint64(32)
            key = mixed(key + np.minimum.reduceat(value, cut))
        keys[:, band] = key
    return keys & ~np.uint64(1)


def _least(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, c: ParagraphConfig) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key), in order: the smallest shingles of short lines, n - ceil(similarity * n) + 1 of the n distinct ones of each.
    Two sets of the wanted similarity share more than what both leave out, so they share one of these."""
    size = end - begin
    place = np.arange(size.max(initial=0))
    inside = place < size[:, None]
    values = np.full(inside.shape, np.iinfo(np.uint64).max, dtype=np.uint64)
    values[inside] = mixed(grams[(begin[:, None] + place)[inside]])
    values.sort(axis=1)  # a real value of the filling's size is equal to it: the first ``size`` places are the line's
    fresh = inside.copy()
    fresh[:, 1:] &= values[:, 1:] != values[:, :-1]
    nth = np.cumsum(fresh, axis=1)
    n = fresh.sum(axis=1)
    owner, at = np.nonzero(fresh & (nth <= (n + (-c.percent * n) // 100 + 1)[:, None]))
    return owner, values[owner, at] | np.uint64(1)


def _distinct(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of distinct leading bits of the shingles of every line: of distinct shingles there are as many or more."""
    size, bits = end - begin, max(1, len(begin).bit_length())
    flat = grams[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
    packed = np.sort(np.repeat(np.arange(len(begin), dtype=np.uint64), size) << np.uint64(64 - bits) | flat >> np.uint64(bits))
    fresh = np.concatenate(([True], packed[1:] != packed[:-1]))[: len(packed)]
    return np.bincount((packed[fresh] >> np.uint64(64 - bits)).astype(np.int64), minlength=len(begin))


def _keys(grams: np.ndarray, begin: np.ndarray, end: np.ndarray, c: ParagraphConfig) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys per paragraph, keys in their order): band keys of natural paragraphs grams[begin:end]. Between the two
    kinds of band lines have keys of both."""
    size, short = end - begin, c.min_words - c.k + 1
    long = np.flatnonzero(size >= short)
    owners, keys = [np.repeat(long, c.bands)], [_bands(grams, begin[long], end[long], c).ravel()]
    few = np.flatnonzero(size * c.percent <= 100 * short)
    for part in (few[i: i + 10_000] for i in range(0, len(few), 10_000)):  # one text may have millions of lines
        owner, key = _least(grams, begin[part], end[part], c)
        owners.append(part[owner])
        keys.append(key)
    # a long line of many repeated shingles may be similar to a short one too
    big = np.flatnonzero((size >= short) & (size * c.percent > 100 * short))
    for i in big[_distinct(grams, begin[big], end[big]) * c.percent <= 100 * short].tolist():
        own = np.unique(grams[begin[i]: end[i]])
        if len(own) * c.percent <= 100 * short:
            key = _least(own, np.zeros(1, dtype=np.int64), np.array([len(own)]), c)[1]
            owners.append(np.full(len(key), i))
            keys.append(key)
    owner = np.concatenate(owners)
    return np.bincount(owner, minlength=len(size)), np.concatenate(keys)[np.argsort(owner, kind="stable")]


def _paragraphs(texts: list[bytes], c: ParagraphConfig):
    """Words' grams of all texts, the first word of each text, and (begin, end, text) of the natural paragraphs."""
    words, start, _, first = word_spans(texts, SPACE_WORD)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    edge = np.concatenate((first, np.flatnonzero(np.diff(line)) + 1))
    bounds = np.unique(edge)
    begin, end = bounds[:-1], bounds[1:]
    wide = end - begin >= c.k
    begin, end = begin[wide], end[wide]
    return gram_hashes(words, c.k), first, begin, end, np.searchsorted(first, begin, side="right") - 1


def _seeds(grams: np.ndarray, first: np.ndarray, c: ParagraphConfig) -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of the seeds: the chosen places of texts of min_words words or more."""
    at = _minima(grams, c.reach)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)[: len(at)]
    inside = (np.arange(len(at)) + c.reach <= first[1:][text] - c.k + 1) & (size >= c.min_words)[text]
    at, text = at[inside], text[inside]
    fresh = np.diff(at, prepend=-1) > 0  # chosen places go up with the windows
    fresh &= at + c.seed <= first[1:][text]
    return at[fresh], text[fresh]


def _occurrences(rows: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(doc_id, th, cid, first, end, bands): all paragraphs and seeds of all texts. Only natural paragraphs
    have an end and band keys."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, texts in text_chunks(b.column(2)):
                grams, first, begin, end, owner = _paragraphs(texts, c)
                seeds, seeded = _seeds(grams, first, c)
                keyed = np.repeat([True, False], [len(begin), len(seeds)])
                begin, end, owner = (np.concatenate(v) for v in ((begin, seeds), (end, seeds + c.seed), (owner, seeded)))
                offset = first[owner]
                cid = _run_hashes(grams, begin, end - c.k + 1)
                counts = np.zeros(len(keyed), dtype=np.int64)
                counts[keyed], keys = _keys(grams, begin[keyed], end[keyed] - c.k + 1, c)
                flat = keys.view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat))
                own = b.slice(at, len(texts))
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), own.column(1).take(take), pa.array(cid, pa.int64()), pa.array(begin - offset, pa.int32()),
                     pa.array(end - offset, pa.int32(), mask=~keyed), bands], ["doc_id", "th", "cid", "first", "end", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, th bigint, cid bigint, first int, end int, bands array<bigint>")


def _sets(rows: DataFrame, wanted: DataFrame, n_bytes: int, c: ParagraphConfig) -> DataFrame:
    """(cid, size, sketch, shingles) of the wanted natural paragraphs, ``w_at`` being the first words of those of a text."""
    texts = join_small_or_shuffle(rows, wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")),
                                  "inner", n_bytes, 1).select("doc_id", "th", "text", "w_at")

    def run(batches):
        for b in batches:
            for at, texts in text_chunks(b.column(2)):
                grams, first, begin, end, owner = _paragraphs(texts, c)
                places = b.column(3).slice(at, len(texts))
                asked = first[np.repeat(np.arange(len(texts)), places.value_lengths().to_numpy(zero_copy_only=False))] + places.flatten().to_numpy()
                spans = np.stack([begin, end], axis=1)[np.isin(begin, asked)]
                if not len(spans):
                    continue
                end = spans[:, 1] - c.k + 1
                sets = [np.unique(grams[x:y]) for x, y in zip(spans[:, 0].tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_run_hashes(grams, spans[:, 0], end), pa.int64()), pa.array([len(u) for u in sets], pa.int64()),
                     pa.array([sketch(u) for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    ["cid", "size", "sketch", "shingles"])

    return texts.mapInArrow(run, "cid bigint, size bigint, sketch binary, shingles binary")


def _near_links(rows: DataFrame, found: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(a, b): a spanning forest of the natural paragraph classes of exact Jaccard similarity at or above the threshold."""
    join = JoinConfig(k=c.k, percent=c.percent)
    keyed = found.where(F.size("bands") > 0)
    shared = stored(shared_keys(keyed.select(F.explode("bands").alias("key"), "cid")), "shared-bands")
    near = shared.select(F.col("cid").alias("c_cid")).distinct()
    near = stored(keyed.join(near, F.col("cid") == F.col("c_cid")).groupBy("cid").agg(F.min(F.struct("doc_id", "th", "first")).alias("x")), "near")
    wanted = near.groupBy(F.col("x.doc_id").alias("w_id"), F.col("x.th").alias("w_th")).agg(F.collect_list("x.first").alias("w_at"))
    wanted = stored(wanted, "wanted")  # the places are bounded by the text's own length
    sets = _sets(rows, wanted, 64 * wanted.count() + 8 * near.count(), c)
    sets = stored(sets.dropDuplicates(["cid"]), "paragraph-sets")  # rows equal in id and text give equal sets
    pairs = stored(candidates(shared, sets.select("cid", "size", "sketch"), join), "candidates")
    whole = sets.select("cid", "shingles", F.lit(1).cast("bigint").alias("members"))
    links = stored(verify(pairs, whole, join).where(F.col("b").isNotNull()).select("a", "b"), "links")
    discard(shared, near, wanted, sets, pairs)
    return links


def _both(grams, words, begin, size, k):
    """16 bytes of every run of words: a hash of its shingles and one of its words."""
    hashes = np.stack([_run_hashes(grams, begin, begin + size - k + 1), _run_hashes(words, begin, begin + size)], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hashes), [None, pa.py_buffer(np.ascontiguousarray(hashes))]).cast(pa.binary())


def _spans(rows: DataFrame, seeds: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(doc_id, th, seed, cid, first, n): spans of n neighbouring windows of min_words words that choose the same place and
    whose seeds all occur again.

    Every run of min_words words that two places share is among the windows: its seeds are the same in both, and so is
    the place it chooses, whose seed lies inside it. So equal windows belong to spans of one seed.
    """
    n_seeds = seeds.count()
    shared = stored(seeds.groupBy("cid").agg(F.count("*").alias("m")).where("m > 1"), "shared-seeds")
    hits = stored(join_hot_split(seeds, shared, "cid", "m", n_seeds, "inner")
                  .groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"))
                  .agg(F.collect_set("first").alias("at")), "seed-places")  # bounded by the text's own length
    discard(shared, seeds)
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))
    texts = rows.join(hits, on).select("doc_id", "th", "text", "at")  # the hits grow with the corpus: a shuffle join at any size
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            hits = b.column(3).flatten().to_numpy()
            bounds = np.concatenate(([0], np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))))
            for at, texts in text_chunks(b.column(2)):
                words, _, _, first = word_spans(texts, SPACE_WORD)
                grams = gram_hashes(words, c.k)
                minima = _minima(grams, c.reach)
                owner, start, size, place, chosen = [], [], [], [], []
                for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if y - x < c.min_words:
                        continue
                    own = minima[x: y - c.k + 2 - c.reach] - x
                    windows = _viable(y - x - c.k + 1, own, hits[bounds[at + i]: bounds[at + i + 1]], c)
                    if not len(windows):
                        continue
                    least = own[windows]
                    cut = np.flatnonzero((np.diff(windows) > 1) | (np.diff(least) > 0)) + 1
                    begins = np.concatenate(([0], cut))
                    owner.append(np.full(len(begins), i))
                    place.append(windows[begins])
                    start.append(windows[begins] + x)
                    chosen.append(least[begins] + x)
                    size.append(np.diff(np.concatenate((begins, [len(windows)]))))
                if not owner:
                    continue
                owner, start, size, place, chosen = (np.concatenate(v) for v in (owner, start, size, place, chosen))
                own, take = b.slice(at, len(texts)), pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), own.column(1).take(take), pa.array(_run_hashes(grams, chosen, chosen + c.seed - c.k + 1)),
                     _both(grams, words, start, size + c.min_words - 1, c.k), pa.array(place, pa.int32()), pa.array(size, pa.int32())],
                    ["doc_id", "th", "seed", "cid", "first", "n"])

    found = stored(texts.mapInArrow(run, f"doc_id {kind}, th bigint, seed bigint, cid binary, first int, n int"), "spans")
    discard(hits)
    return found


def _windows(rows: DataFrame, spans: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(doc_id, th, again, wid, first): the windows of the spans (doc_id, th, first, n, again) of these texts."""
    places = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.collect_list(F.struct("first", "n", "again")).alias("at"))  # bounded by the text's own length
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))
    texts = rows.join(places, on).select("doc_id", "th", "text", "at")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, texts in text_chunks(b.column(2)):
                words, _, _, first = word_spans(texts, SPACE_WORD)
                grams = gram_hashes(words, c.k)
                own = b.slice(at, len(texts))
                lists = own.column(3)
                begin, size, again = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
                each = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                owner = np.repeat(owner, size)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), own.column(1).take(take), pa.array(np.repeat(again, size), pa.bool_()),
                     _both(grams, words, first[owner] + each, c.min_words, c.k), pa.array(each, pa.int32())],
                    ["doc_id", "th", "again", "wid", "first"])

    return texts.mapInArrow(run, f"doc_id {kind}, th bigint, again boolean, wid binary, first int")


def _repeated_windows(rows: DataFrame, seeds: DataFrame, c: ParagraphConfig) -> DataFrame:
    """(doc_id, th, first, end, gone) of the windows, or spans of windows, that repeat.

    ``gone`` is the first word to cut, null where the window stays; words of the staying window are
    left when a later one of the same text overlaps it, as in a text that says one thing over and over.
    """
    spans = _spans(rows, seeds, c)
    groups = stored(spans.groupBy("cid").agg(F.count("*").alias("m"), F.min("seed").alias("seed"), F.min("n").alias("n"),
                                             F.min(F.struct("doc_id", "th", "first")).alias("kept")), "span-groups")
    # seeds whose spans differ: only their windows can be equal without their spans being so
    mixed_seeds = groups.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1")
    first = stored(join_hot_split(groups, stored(mixed_seeds, "mixed-seeds"), "seed", "k", groups.count()).drop("seed")
                   .where("m > 1 or k > 1"), "first-spans")
    here = F.struct("doc_id", "th").eqNullSafe(F.struct("kept.doc_id", "kept.th"))
    members = spans.select("doc_id", "th", "cid", "first")
    repeats = stored(join_hot_split(members, first.where("m > 1"), "cid", "m", spans.count(), "inner").drop("cid"), "repeated-spans")
    discard(spans, groups)
    end = F.col("first") + F.col("n") + c.min_words - 1
    # in another text than the first of its group: all windows have an earlier occurrence there
    copies = repeats.where(~here).select("doc_id", "th", "first", end.alias("end"), F.col("first").alias("gone"))
    # the first of each group, and further ones in its own text
    alone = first.select("kept.doc_id", "kept.th", "kept.first", "n", "m", "k", F.lit(None).cast("int").alias("gone"))
    own = repeats.where(here & (F.col("first") != F.col("kept.first"))).select(
        "doc_id", "th", "first", "n", "m", "k", F.greatest(F.col("first"), F.col("kept.first") + c.min_words).alias("gone"))
    firsts = alone.unionByName(own)
    plain = firsts.where("k is null").select("doc_id", "th", "first", end.alias("end"), "gone")
    apart = firsts.where("k > 1").select("doc_id", "th", "first", "n", (F.col("m") > 1).alias("again"))
    windows = stored(_windows(rows, apart, c), "windows")
    kept = stored(windows.groupBy("wid").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "th", "first")).alias("kept"),
                                             F.max("again").alias("any_again")).where("m > 1 or any_again"), "kept-windows")
    marked = join_hot_split(windows.drop("again"), kept.drop("any_again"), "wid", "m", windows.count(), "inner")
    gone = (F.when(~here, F.col("first")).when(F.col("first") != F.col("kept.first"),
                                               F.greatest(F.col("first"), F.col("kept.first") + c.min_words)))
    marked = stored(marked.select("doc_id", "th", "first", (F.col("first") + c.min_words).alias("end"), gone.alias("gone")), "marked-windows")
    discard(windows, kept)
    return copies.unionByName(plain).unionByName(marked)


def repeated_spans(docs: DataFrame, c: ParagraphConfig, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, first, end, gone) of the passages that repeat.

    Words from ``gone`` to ``end`` are to be cut; a null there means that the passage stays.
    """
    rows = spread_tasks(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")))
    # two tables in one pass, so that each can go after its last reader
    found = _occurrences(rows, c)
    path = shared_dir(docs.sparkSession, "paragraphs")
    found.withColumn("seed", F.col("end").isNull()).write.partitionBy("seed").parquet(path)
    places, seeds = (stored_part(docs.sparkSession, found.schema, f"{path}/seed={kind}") for kind in ("false", "true"))
    seeds = seeds.select("doc_id", "th", "cid", "first")
    links = _near_links(rows, places, c)
    group = connected_components(links)
    counts = places.groupBy("cid").agg(F.count("*").alias("m"))
    classes = stored(counts.join(group, F.col("cid") == F.col("node"), "left").where("m > 1 or component is not null")
                     .select("cid", "m", F.coalesce("component", "cid").alias("cluster")), "paragraph-classes")
    here = places.select("doc_id", "th", "cid", "first", "end")
    spans = stored(join_hot_split(here, classes, "cid", "m", places.count(), "inner").drop("cid", "m"), "repeats")
    discard(links, classes, places)
    kept = (spans.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first")).alias("kept")))
    stays = F.struct("doc_id", "th", "first").eqNullSafe(F.col("kept"))
    marked = join_hot_split(spans, kept, "cluster", "n", spans.count(), "inner")
    natural = marked.select("doc_id", "th", "first", "end", F.when(~stays, F.col("first")).alias("gone"))
    return natural.unionByName(_repeated_windows(rows, seeds, c))


def paragraph_dedup(docs: DataFrame, config: ParagraphConfig = ParagraphConfig(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_repeated, n_removed, repeats, removed_spans, text.

    ``n_repeated`` counts the words in passages that occur again anywhere, ``n_removed`` those cut out
    because an earlier occurrence stays; ``removed_spans`` lists them as merged (first word, end);
    ``text`` is what is left. Null and empty texts have no words; null stays null. Rows equal in id
    and text repeat each other but share the staying occurrence, so both keep it. Extra columns are
    ignored; an empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    spans = repeated_spans(docs, config, id_col, text_col)
    ranges = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.collect_set(F.struct("first", "end", "gone")).alias("spans"))  # bounded by the text's own length
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))
    joined = rows.join(ranges, on, "left")  # the spans grow with the corpus: a shuffle join at any size
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, texts in text_chunks(b.column(1)):
                yield _cut(b.slice(at, len(texts)), texts)

    return (joined.select("doc_id", "text", "spans")
            .mapInArrow(run, f"doc_id {kind}, n_words bigint, n_repeated bigint, n_removed bigint, repeats boolean, "
                             "removed_spans array<struct<first:int,end:int>>, text string"))


def _merged(owner: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, end) in order, those of one owner that overlap or touch made one."""
    wide = int(end.max(initial=0)) + 2
    order = np.lexsort((first, owner))
    low = owner[order] * wide + first[order]
    high = np.maximum.accumulate(owner[order] * wide + end[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))[: len(low)]
    last = np.concatenate((new[1:], [True]))[: len(low)]
    return low[new] // wide, low[new] % wide, high[last] % wide


def _cut(b: pa.RecordBatch, raws: list[bytes]) -> pa.RecordBatch:
    """Cut the removed spans out of a batch of texts, given as UTF-8 too."""
    n = len(raws)
    _, start, end, word = word_places(raws, SPACE_WORD)
    lists = b.column(2)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first, stop, gone = lists.flatten().flatten()
    first, stop = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, stop))
    owner, cut = np.repeat(np.arange(n), lengths), gone.is_valid().to_numpy(zero_copy_only=False)
    gone = gone.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def words(merged):
        return np.bincount(merged[0], weights=merged[2] - merged[1], minlength=n).astype(np.int64)

    repeated, removed = _merged(owner, first, stop), _merged(owner[cut], gone[cut], stop[cut])
    bounds = np.searchsorted(removed[0], np.arange(n + 1))
    texts = b.column(1).to_pylist()
    base = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))  # as word_spans joins them
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        raw, parts, at = raws[i], [], 0
        starts, ends = (x[word[i]: word[i + 1]] - base[i] for x in (start, end))
        for x, y in zip(removed[1][bounds[i]: bounds[i + 1]].tolist(), removed[2][bounds[i]: bounds[i + 1]].tolist(), strict=True):
            parts.append(raw[at: starts[x]])
            at = int(starts[y]) if y < len(starts) else len(raw)
            if y < len(starts) and b"\n" in raw[ends[y - 1]: at]:
                parts.append(b"\n")  # the line break after a cut stays one
        parts.append(raw[at:])
        texts[i] = b"".join(parts).decode()
    struct = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in removed[1:]], ["first", "end"])
    n_repeated = words(repeated)
    return pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(np.diff(word), pa.int64()), pa.array(n_repeated), pa.array(words(removed)),
         pa.array(n_repeated > 0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct), pa.array(texts, pa.string())],
        ["doc_id", "n_words", "n_repeated", "n_removed", "repeats", "removed_spans", "text"])
