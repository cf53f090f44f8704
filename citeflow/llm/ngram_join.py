"""N-gram Jaccard self-join: size-aware heavy-light join over word-shingle sets.

Equal sets are one class. Every set's shingles are put in one global order, rare before
frequent; sets with Jaccard similarity t share shingles early in that order (prefix filter). A
*small* set is enumerated: every 2-subset of its extended prefix is a key, and two small
sets that link share one. A *large* set puts single prefix shingles in inverted lists, which
large sets, and small ones of a size that can link with large, are scanned against. The boundary is the
set size where the measured cost of enumerating passes that of scanning.

Keys with one set drop out; the sets of every other key are gathered under its smallest set, its
hub, because near copies share many keys but few hubs. Under a hub a pair comes up only if the
sizes and a parity sketch of a bit a shingle (an exact upper bound of the overlap) allow a link, and
under one hub only. Lists longer than a block are cut in blocks that meet pairwise. The
remaining pairs are verified on the whole sets; what leaves a cell is the number of links of each set and a
spanning forest, from which connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (connected_components, free_prefix, join_hot_split, join_small_or_shuffle, mixed, shingle_sets,
                     spread_tasks, stored, text_chunks)

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinConfig:
    """k words a shingle; a link needs 100 * |A n B| >= percent * |A u B|."""

    k: int = 4
    percent: int = 85
    block: int = 1000           # sets of a long list that meet at a time
    block_shingles: int = 2_000_000  # and the most shingles of those sets together
    compare_cost: float = 0.05  # of comparing two sets' sizes and sketches, in key rows sorted
    hot_tokens: int = 100_000   # frequent shingles whose order is known exactly; the others sort by hash
    count_tokens: int = 1_000_000   # shingles counted at a time in a task

    def least(self, n):
        """Smallest overlap of a set of size n with any set it links with."""
        return -(-self.percent * n // 100)

    def can_link(self, n):
        """Can a set of size n link with a different set at all?"""
        return 100 * n >= self.percent * (n + 1)


def _set_hash(u: np.ndarray) -> int:
    """One hash for a set of shingles (order-free, with the size)."""
    h = mixed(np.array([np.add.reduce(mixed(u * _ODD + np.uint64(1))) + np.uint64(len(u))], dtype=np.uint64))
    return int(h.view(np.int64)[0])


def sketch(u: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit i is the parity of the number of shingles falling on i.

    It has about one bit a shingle, a power of two of at least 512; xor-ing its halves gives the
    bitmap of half the width, so sets of different sizes compare at the narrower one.
    """
    width = 1 << max(9, int(len(u) - 1).bit_length())
    at = (mixed(u) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1).tobytes()


class Sketches:
    """Sketches of the rows of a batch, by width; ``differ`` counts the bits in which pairs differ."""

    def __init__(self, blobs: list[bytes]):
        self.words = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
        self.place: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for width in np.unique(self.words).tolist():
            own = np.flatnonzero((self.words == width) | (self.words == 2 * width))
            full = [np.frombuffer(blobs[i], dtype=np.uint64) for i in own.tolist()]
            self.rows[width] = np.stack([m if len(m) == width else m[:width] ^ m[width:] for m in full])
            self.place[width] = np.full(len(blobs), -1, dtype=np.int64)
            self.place[width][own] = np.arange(len(own))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least size of the symmetric difference of each pair of rows, as the sketches show it."""
        out = np.zeros(len(i), dtype=np.int64)
        least = np.minimum(self.words[i], self.words[j])
        for width in np.unique(least).tolist():
            at, rows = self.place[width], self.rows[width]
            pick = np.flatnonzero((least == width) & (at[i] >= 0) & (at[j] >= 0))
            step = max(1, (1 << 18) // width)
            for k in range(0, len(pick), step):
                p = pick[k: k + step]
                out[p] = np.bitwise_count(rows[at[i[p]]] ^ rows[at[j[p]]]).sum(axis=1, dtype=np.int64)
        return out


def _sets_of(batches, column: int, k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, sorted distinct shingles) for every row."""
    for b in batches:
        for first, texts in text_chunks(b.column(column)):
            for i, u in enumerate(shingle_sets(texts, k)):
                yield b, first + i, u


# ---------------------------------------------------------------- pass 1: sets, frequent shingles, costs

_DOC, _HOT, _SIZE, _SCAN = range(4)


def _describe(rows: DataFrame, c: JoinConfig) -> DataFrame:
    """One pass over all texts. Rows by kind: documents (n, cid, sketch); shingles frequent in a
    part of a task; numbers of sets by size; list lengths met (for the cost of scanning)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: set[int] = set()
        tokens, held, sets = [], 0, 0
        sizes: dict[int, int] = {}

        def frequent():
            if not tokens:
                return None
            value, count = np.unique(np.concatenate(tokens), return_counts=True)
            often = count >= max(3, sets // 1000)
            n = int(often.sum())
            rare = count[~often].astype(np.int64)  # frequent shingles come last in the order: lists of prefixes are of the others
            square, total = int((rare ** 2).sum()), int(rare.sum())
            return record([_HOT] * n + [_SCAN], counts=count[often].tolist() + [square], values=value[often].view(np.int64).tolist() + [total])

        def record(kinds, ids=None, counts=None, values=None, sketches=None, hashes=None):
            m = len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int8()), ids if ids is not None else pa.nulls(m, id_type),
                 pa.array(hashes if hashes is not None else [None] * m, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(values, pa.int64()), pa.array(sketches if sketches is not None else [None] * m, pa.binary())],
                ["kind", "doc_id", "th", "n", "cid", "sketch"])

        for b in batches:
            id_type = b.column(0).type
            counts, values, sketches = [], [], []
            for _, _, u in _sets_of([b], 2, c.k):
                n = len(u)
                counts.append(n)
                if not n:
                    values.append(None)
                    sketches.append(None)
                    continue
                cid = _set_hash(u)
                values.append(cid)
                fresh = cid not in known
                sketches.append(sketch(u) if fresh and c.can_link(n) else None)
                if fresh:
                    known.add(cid)
                    sizes[n] = sizes.get(n, 0) + 1
                    if c.can_link(n):
                        tokens.append(u)
                        held, sets = held + n, sets + 1
                if held >= c.count_tokens:
                    yield frequent()
                    tokens, held, sets = [], 0, 0
            yield record([_DOC] * b.num_rows, b.column(0), counts, values, sketches, b.column(1).to_pylist())
        last = frequent()
        if last is not None:
            yield last
        if sizes:
            yield record([_SIZE] * len(sizes), counts=list(sizes.values()), values=list(sizes))

    return rows.mapInArrow(run, f"kind tinyint, doc_id {kind}, th bigint, n bigint, cid bigint, sketch binary")


def boundary(sizes: dict[int, int], scan: float, c: JoinConfig) -> int:
    """Largest size whose sets are enumerated, by least total cost.

    A set of size n costs its number of key rows: (p + 1) p / 2 subsets when small; when large p
    inverted-list entries, plus the comparisons with the other ``scan`` - 1 sets of each list.
    """
    order = sorted(n for n in sizes if c.can_link(n))
    best = total = at = 0.0
    for n in order:
        p = n - c.least(n) + 1
        total += sizes[n] * ((p + 1) * p / 2 - p * (1 + (scan - 1) * c.compare_cost))
        if total <= best:
            best, at = total, n
    return int(at)


# ---------------------------------------------------------------- pass 2: keys

def _keys(u: np.ndarray, hot: np.ndarray, hot_rank: np.ndarray, light: int, c: JoinConfig) -> np.ndarray:
    """Keys of a set: even ones are single prefix shingles, odd ones are 2-subsets of a small set."""
    n = len(u)
    p = n - c.least(n) + 1
    want = min(n, p + 1)
    order = u
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        often = hot[at] == u
        order = u[~often]
        if len(order) < want:
            rank = hot_rank[at[often]]
            order = np.concatenate((order, u[often][np.argsort(rank, kind="stable")]))
    out = []
    if n > light or n >= c.least(light + 1):
        out.append(mixed(order[:p]) & ~np.uint64(1))
    if n <= light:
        t = order[:want]
        i, j = np.triu_indices(len(t), 1)
        out.append(mixed(mixed(t[i]) * _ODD + t[j]) | np.uint64(1))
    return np.concatenate(out)


def _postings(rows: DataFrame, hot: np.ndarray, hot_rank: np.ndarray, light: int, c: JoinConfig) -> DataFrame:
    """(key, cid): every distinct set of a task once under each of its keys."""
    shared = rows.sparkSession.sparkContext.broadcast((hot, hot_rank))

    def run(batches):
        hot, rank = shared.value
        known: set[int] = set()
        keys, cids, size = [], [], 0
        for _, _, u in _sets_of(batches, 2, c.k):
            if not len(u) or not c.can_link(len(u)):
                continue
            cid = _set_hash(u)
            if cid in known:
                continue
            known.add(cid)
            k = _keys(u, hot, rank, light, c)
            keys.append(k)
            cids.append(np.full(len(k), cid, dtype=np.int64))
            size += len(k)
            if size >= 50_000:
                yield _pairs_batch(np.concatenate(keys).view(np.int64), np.concatenate(cids), ("key", "cid"))
                keys, cids, size = [], [], 0
        if size:
            yield _pairs_batch(np.concatenate(keys).view(np.int64), np.concatenate(cids), ("key", "cid"))

    return rows.mapInArrow(run, "key bigint, cid bigint")


def _pairs_batch(a: np.ndarray, b: np.ndarray, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], list(names))


def shared_keys(postings: DataFrame) -> DataFrame:
    """(hub, cid): for every key with two sets or more, its sets, named by the smallest of them.

    Near copies share many keys, but few hubs; all sets of a key stand together under its hub, so no
    pair is lost. Rows come sorted by key and stream through, so a list of any length needs no memory.
    """
    def run(batches):
        key = cid = hub = None  # last distinct row, and the hub of its key
        alone = True            # is it the first of its key?
        for b in batches:
            k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            if key is not None:
                k, d = np.concatenate(([key], k)), np.concatenate(([cid], d))
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
            k, d = k[fresh], d[fresh]
            begin = np.concatenate(([True], k[1:] != k[:-1]))
            first = np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))
            hubs = d[first]
            if key is not None:  # the held row may continue a list
                begin[0] = alone
                hubs[first == 0] = hub
            ready = ~begin | np.concatenate((k[1:] == k[:-1], [False]))
            ready[-1] = False  # decided with the next batch
            key, cid, hub, alone = k[-1], d[-1], hubs[-1], bool(begin[-1])
            if ready.any():
                yield _pairs_batch(hubs[ready], d[ready], ("hub", "cid"))
        if key is not None and not alone:
            yield _pairs_batch(np.array([hub]), np.array([cid]), ("hub", "cid"))

    return (postings.repartition("key").sortWithinPartitions("key", "cid")
            .mapInArrow(run, "hub bigint, cid bigint").distinct())


# ---------------------------------------------------------------- candidates

def candidates(shared: DataFrame, classes: DataFrame, c: JoinConfig) -> DataFrame:
    """(hub, low, high, cid, partners): for each set of a cell the sets that sizes and sketches let it link with.

    A cell is a hub's list, or two blocks of it. A pair stands once, with the smaller set, under
    the smallest hub the two share; sets without a possible partner drop out, all others have one
    row a cell, so the number of rows follows the sets and not the pairs.
    """
    lists = shared.groupBy("cid").agg(F.sort_array(F.collect_set("hub")).alias("own"))  # bounded by the set's own keys
    info = (classes.join(lists, "cid").select(F.col("cid").alias("i_cid"), "size", "sketch", "own"))
    earlier = F.filter("own", lambda x: x < F.col("hub"))
    sized = shared.join(classes.select("cid", "size"), "cid")
    parts = stored(sized.groupBy(F.col("hub").alias("g_hub")).agg(F.ceil(F.greatest(
        F.count("*") / c.block, F.sum("size") / c.block_shingles)).cast("int").alias("parts")).where("parts > 1"), "long-lists")
    cells = join_small_or_shuffle(shared, parts, F.col("hub") == F.col("g_hub"), "left", parts.count(), 16)
    cells = (cells.withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("hub", "cid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    rows = (cells.join(info, F.col("cid") == F.col("i_cid"))
            .select("hub", "low", "high", "block", "cid", "size", "sketch", earlier.alias("earlier"))
            .repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high", "cid"))
    percent = c.percent

    def pairs_in(hub, low, high, block, size, marks, earlier):
        """Rows of each possible pair, by distance in the sorted order."""
        n = len(hub)
        sets: dict[int, frozenset] = {}
        left, right = [], []
        alive = np.arange(n)
        for d in range(1, n):
            alive = alive[alive + d < n]
            alive = alive[(hub[alive] == hub[alive + d]) & (low[alive] == low[alive + d]) & (high[alive] == high[alive + d])]
            if not len(alive):
                break
            i, j = alive, alive + d
            a, b = size[i], size[j]
            ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            ok &= (low[i] == high[i]) | (block[i] != block[j])  # inside a block only once
            i, j = i[ok], j[ok]
            both = size[i] + size[j]
            ok = (100 + percent) * (both - marks.differ(i, j)) >= 2 * percent * both
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                sx = sets.get(x)
                if sx is None:
                    sx = sets[x] = frozenset(earlier[x])
                if sx.isdisjoint(earlier[y]):
                    left.append(x)
                    right.append(y)
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def run(batches):
        for t in _whole_groups(batches, ("hub", "low", "high")):
            column = {name: t.column(name).to_numpy(zero_copy_only=False) for name in ("hub", "low", "high", "block", "cid", "size")}
            own = t.column("earlier")
            offsets, values = np.asarray(own.offsets), np.asarray(own.values)
            earlier = [values[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            left, right = pairs_in(column["hub"], column["low"], column["high"], column["block"], column["size"],
                                   Sketches(t.column("sketch").to_pylist()), earlier)
            if len(left):
                order = np.argsort(left, kind="stable")
                met = np.unique(np.concatenate((left, right)))
                count = np.bincount(left, minlength=t.num_rows)[met]
                partners = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()),
                                                    pa.array(column["cid"][right[order]], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(column["hub"][met], pa.int64()), pa.array(column["low"][met], pa.int32()),
                                                  pa.array(column["high"][met], pa.int32()), pa.array(column["cid"][met], pa.int64()),
                                                  partners], ["hub", "low", "high", "cid", "partners"])

    return rows.mapInArrow(run, "hub bigint, low int, high int, cid bigint, partners array<bigint>")


def _whole_groups(batches, names) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, re-cut so that no group of equal key columns is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and any(h.column(n)[-1].as_py() != b.column(n)[0].as_py() for h in held[-1:] for n in names):
            yield _joined(held)
            held = []
        if len(changes):
            cut = int(changes[-1])
            yield _joined([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches)


# ---------------------------------------------------------------- verification

def verify(cells: DataFrame, sets: DataFrame, c: JoinConfig) -> DataFrame:
    """(a, b, links) from the pairs that link, checked on the whole sets of their cells.

    Rows with ``b`` are edges of a spanning forest of a cell's links, enough for components;
    rows without count the rows (``members``) that set ``a`` links with in the cell. Both follow the sets,
    so a group of many near copies is never written out pair by pair.
    """
    rows = (cells.join(sets, "cid").select("hub", "low", "high", "cid", "partners", "members", "shingles")
            .repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high"))
    percent = c.percent

    def links_of(t):
        """Verified pairs of one or more whole cells, as row numbers."""
        hub, low, high = (t.column(n).to_numpy() for n in ("hub", "low", "high"))
        cut = np.flatnonzero((hub[1:] != hub[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        cid, partners, blob = (t.column(n).to_pylist() for n in ("cid", "partners", "shingles"))
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
            sets = [np.frombuffer(blob[i], dtype=np.uint64) for i in range(a, b)]
            place = {cid[i]: i - a for i in range(a, b)}
            for i in range(b - a):
                for other in partners[a + i]:
                    j = place[other]
                    x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    overlap = int((y[at] == x).sum())
                    if 100 * overlap >= percent * (len(x) + len(y) - overlap):
                        yield a + i, a + j

    def run(batches):
        for t in _whole_groups(batches, ("hub", "low", "high")):
            cid, members = t.column("cid").to_pylist(), t.column("members").to_pylist()
            parent = list(range(t.num_rows))
            total: dict[int, int] = {}
            a, b = [], []
            for i, j in links_of(t):
                total[i] = total.get(i, 0) + members[j]
                total[j] = total.get(j, 0) + members[i]
                x, y = i, j
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[x] = y
                    a.append(cid[i])
                    b.append(cid[j])
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a + [cid[i] for i in total], pa.int64()), pa.array(b + [None] * len(total), pa.int64()),
                     pa.array([None] * len(a) + list(total.values()), pa.int64())], ["a", "b", "links"])

    return rows.mapInArrow(run, "a bigint, b bigint, links bigint")


def _whole_sets(rows: DataFrame, wanted: DataFrame, n_wanted: int, k: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, from the text of one document each."""
    texts = join_small_or_shuffle(rows, wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")),
                                  "inner", n_wanted, 48).select("doc_id", "th", "text")

    def run(batches):
        for b in batches:
            cids, blobs = [], []
            for _, _, u in _sets_of([b], 2, k):
                cids.append(_set_hash(u) if len(u) else None)
                blobs.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(blobs, pa.binary())], ["cid", "shingles"])

    return texts.mapInArrow(run, "cid bigint, shingles binary").dropDuplicates(["cid"])


# ---------------------------------------------------------------- the operator

def jaccard_join(docs: DataFrame, config: JoinConfig = JoinConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, n_links, class_id, text_hash.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct k-word shingles of
    the whole text, or the whole sequence when it has fewer words. Two rows link when 100 * |A n B| >= percent *
    |A u B|; component_id is the smallest id reachable, n_links the number of other rows linked with. Null,
    empty and wordless texts have an empty set: no class, no link, their own component. Repeated
    rows count as rows of one class. A null id is no smallest id: component_id is null only when no row reached
    has an id. An empty table gives an empty result; other columns are ignored.
    """
    return _joined_rows(docs, config, id_col, text_col).drop("leads")


def _joined_rows(docs: DataFrame, c: JoinConfig, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``jaccard_join``, and ``leads``: in a group without any id, whether the row stands for it."""
    rows = spread_tasks(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")))
    seen = stored(_describe(rows, c), "sets")
    every = seen.where(F.col("kind") == _DOC).select("doc_id", "th", F.col("n").alias("n_shingles"), "cid")
    total = every.count()
    classes = stored(seen.where((F.col("kind") == _DOC) & F.col("cid").isNotNull()).groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.max("n").alias("size"), F.max("sketch").alias("sketch"),
        F.min(F.struct("doc_id", "th")).alias("first")), "classes")
    links = _links(rows, seen, classes, c)
    by_rep = classes.select("cid", "rep", "members", F.col("first.th").alias("lead_th"))
    result = _groups(links, by_rep)
    joined = join_hot_split(every, result, "cid", "members", total)
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                         F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.col("cid").alias("class_id"),
                         F.col("th").alias("text_hash"), (F.col("leads") & (F.col("th") == F.col("lead_th"))).alias("leads"))


def _links(rows: DataFrame, seen: DataFrame, classes: DataFrame, c: JoinConfig) -> DataFrame:
    """(a, b, links): what ``verify`` gives for all pairs of different classes."""
    hot = (seen.where(F.col("kind") == _HOT).groupBy("cid").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "cid").limit(c.hot_tokens).collect())
    token = np.array([r["cid"] for r in hot], dtype=np.int64).view(np.uint64)
    place = np.argsort(token)
    rank = np.arange(len(token), 0, -1)[place]  # the most frequent comes last in the order
    sizes = {r["cid"]: r["n"] for r in seen.where(F.col("kind") == _SIZE).groupBy("cid").agg(F.sum("n").alias("n")).collect()}
    met = seen.where(F.col("kind") == _SCAN).agg(F.sum("n").alias("square"), F.sum("cid").alias("total"), F.count("*").alias("parts")).first()
    scan = 1 + (met["square"] / met["total"] - 1) * met["parts"] if met["total"] else 1.0
    light = boundary(sizes, scan, c)
    shared = stored(shared_keys(_postings(rows, token[place], rank, light, c)), "shared-keys")
    pairs = stored(candidates(shared, classes.select("cid", "size", "sketch"), c), "candidates")
    near = pairs.select(F.col("cid").alias("c_cid")).distinct()
    wanted = stored(classes.join(near, F.col("cid") == F.col("c_cid"))
                    .select(F.col("first.doc_id").alias("w_id"), F.col("first.th").alias("w_th")), "wanted")
    sets = _whole_sets(rows, wanted, wanted.count(), c.k).join(classes.select("cid", "members"), "cid")
    return stored(verify(pairs, sets, c), "links")


def _groups(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, members, component, links, leads, lead_th) of the classes with more than one row or a link."""
    node = F.col("rep")
    nameless = not classes.where(node.isNull()).isEmpty()
    if nameless:  # classes without an id are nodes of their own, after all those with one
        node = F.struct(node.isNull().alias("nameless"), node.alias("rep"), F.when(node.isNull(), F.col("cid")).alias("own"))
    one = classes.select(F.col("cid").alias("a"), node.alias("node_a"))
    two = classes.select(F.col("cid").alias("b"), node.alias("node_b"))
    forest = links.where(F.col("b").isNotNull()).join(one, "a").join(two, "b")
    component = connected_components(forest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    degree = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("d_cid")).agg(F.sum("links").alias("others"))
    group = F.coalesce("component", "at")
    return (classes.withColumn("at", node).join(degree, F.col("cid") == F.col("d_cid"), "left")
            .join(component, F.col("at") == F.col("node"), "left")
            .where("members > 1 or others is not null")
            .select("cid", "members", (group["rep"] if nameless else group).alias("component"),
                    (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("links"),
                    (group["own"] == F.col("cid") if nameless else F.lit(None).cast("boolean")).alias("leads"), "lead_th"))


def keep_one(docs: DataFrame, config: JoinConfig = JoinConfig(k=5, percent=80), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays.

    Rows repeated with the same id and text are one document and stay once; rows with an empty set all stay. A row without an id goes when its
    component has one; of a component without any id one row stays.
    """
    found = stored(_joined_rows(docs, config, id_col, text_col), "near-groups")
    p = free_prefix(docs.columns, "keep_")
    kept = found.where("doc_id = component_id or (component_id is null and coalesce(leads, true))")
    plan = (kept.groupBy(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}text")).agg(F.count("*").alias(f"{p}n")))
    plan = stored(plan, "near-plan")
    on = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{p}text"))
    out = join_small_or_shuffle(docs, plan, on, "inner", plan.count(), 48)
    once = out.where(F.col(f"{p}n") == 1)
    again = out.where(F.col(f"{p}n") > 1).dropDuplicates([f"{p}id", f"{p}text"])
    return once.unionByName(again).select(*docs.columns)
