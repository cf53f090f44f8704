"""Near duplicates by SimHash fingerprints and anchor points (a covering code).

Every text gets a 64-bit fingerprint: its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) give
k-word shingles, repeats included, joined by blanks; a bit is 1 when it is set in over half of the
shingles' XXH64 values (UTF-8, seed 42). Fingerprints that differ in at most ``distance`` bits link.

The join: the codewords of a covering code are the anchors. A fingerprint has one *home*, the
codeword nearest to it, within the covering radius; it is replicated to every anchor within
radius + distance. If s and t differ in at most ``distance`` bits, t reaches the home of s, so every
link is met in the cell of the smaller one's home, and only there. The code is a direct sum of short
cyclic codes over consecutive bits (``BLOCKS``); a pair can spend its distance only once over
all blocks, so what a row has spent in one block is missing in the next. Only as many blocks
are used as the population asks for: cells with more than ``HOT`` homes are dealt again by the
next block, all others are compared. After the last block a cell is a ball of the
full 64-bit space, whose homes are compared with visitors that stream past in blocks.

Rows of equal fingerprint are one class before the join, cells yield a spanning forest of
their links (never all pairs), and components come from large-star/small-star rounds. Counts used to
plan are of classes and cells; no fingerprints are collected.

Defined results: a null text, an empty text and one without words have fingerprint zero and link like any
other; fewer than k words are one shingle; a text of any length is hashed in slices of ``SLICE`` bytes; equal
texts and repeated rows share a class; a null id never is a component id unless the component has no other; an
empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot_split, join_small_or_shuffle, ship_code, spread_tasks, stored

#: Fixed values of the fingerprint.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A text is split into words in slices of about this many bytes.
SLICE = 1 << 20
#: (bits, generator polynomial, covering radius): binary Golay twice, Hamming, and the three bits left over.
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 1, 0))
#: A cell of more homes than this is dealt again by the next block.
HOT = 4096
#: Comparisons of one numpy step.
STEP = 1 << 21

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of a text, slice by slice."""
    at, tail, whole = 0, [], False
    while at < len(text):
        end = at + SLICE
        stop = _SPACE.search(text, end) if end < len(text) else None
        end = stop.start() if stop else len(text)
        words = tail + text[at:end].lower().split()  # bytes: ASCII letters and ASCII white space only
        at = end
        if len(words) >= k:
            whole = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist(), strict=True)],
                           dtype=np.uint64)
            words = words[len(words) - k + 1:]
        tail = words
    if tail and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype=np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, k):
        for part in np.array_split(h, 1 + len(h) // 65536):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row."""
    ship_code(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                prints = [fingerprint(t.encode(), k) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    rows = spread_tasks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- anchors

class Code:
    """A cyclic code given by its generator polynomial, with all words of weight <= radius + distance by
    their syndrome (the first of each syndrome being the lightest)."""

    def __init__(self, bits: int, poly: int, radius: int, distance: int):
        self.bits, self.poly, self.check = bits, poly, poly.bit_length() - 1
        words = np.arange(1 << bits, dtype=np.uint32)
        weight = np.bitwise_count(words)
        words = words[weight <= radius + distance]
        weight = np.bitwise_count(words).astype(np.int64)
        syndrome = self.syndrome(words)
        order = np.lexsort((weight, syndrome))
        self.words = words[order].astype(np.uint64)
        self.first = np.searchsorted(syndrome[order], np.arange((1 << self.check) + 1))
        self.spent = np.maximum(weight[order] - radius, 0)
        if (self.first[:-1] == self.first[1:]).any() or self.spent[self.first[:-1]].any():
            raise ValueError("the code does not cover its space within the radius")

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """Remainder of the polynomials x by the generator."""
        for b in range(self.bits - 1, self.check - 1, -1):
            x = x ^ (((x >> x.dtype.type(b)) & x.dtype.type(1)) * x.dtype.type(self.poly << (b - self.check)))
        return x.astype(np.int64)

    def anchors(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """For all anchors within reach of each x: (index of x, information bits of the anchor, bits
        beyond the radius, is its home)."""
        s = self.syndrome(x)
        size = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(x)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = self.first[s][row] + nth
        return row, (x[row] ^ self.words[at]) >> np.uint64(self.check), self.spent[at], nth == 0


@lru_cache(maxsize=8)
def code(level: int, distance: int) -> Code:
    return Code(*BLOCKS[level], distance)


def dealt(rows: DataFrame, level: int, distance: int, homes_only: bool) -> DataFrame:
    """Rows (cell, fp, budget, home) sent to the anchors of block ``level`` that their budget reaches."""
    low = sum(b[0] for b in BLOCKS[:level])

    def run(batches):
        c = code(level, distance)
        mask, info = np.uint64((1 << c.bits) - 1), c.bits - c.check
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                cell, fp, budget, home = (np.asarray(x) for x in b.slice(at, 4096).columns)
                row, anchor, spent, first = c.anchors((fp.view(np.uint64) >> np.uint64(low)) & mask)
                is_home = first & home[row].astype(bool)
                keep = np.flatnonzero(is_home if homes_only else spent <= budget[row])
                row = row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell[row] << info) + anchor[keep].astype(np.int64)), pa.array(fp[row]),
                     pa.array((budget[row] - spent[keep]).astype(np.int8)), pa.array(is_home[keep].astype(np.int8))],
                    names=["cell", "fp", "budget", "home"])

    return rows.select("cell", "fp", "budget", "home").mapInArrow(run, "cell long, fp long, budget byte, home byte")


# ---------------------------------------------------------------- cells

def _forest(home: np.ndarray, visitors: np.ndarray, label: np.ndarray, distance: int) -> Iterator[tuple]:
    """Links (home, visitor) with home < visitor that join visitors to homes and homes met by one visitor
    to each other; ``label`` holds the homes' components so far and is updated."""
    step = max(1, STEP // max(1, len(home)))
    for at in range(0, len(visitors), step):
        v = visitors[at: at + step]
        near = (np.bitwise_count((v[:, None] ^ home[None, :]).view(np.uint64)) <= distance) & (home[None, :] < v[:, None])
        vi, hi = np.nonzero(near)
        if not len(vi):
            continue
        is_first = np.concatenate(([True], vi[1:] != vi[:-1]))
        first = hi[is_first][np.cumsum(is_first) - 1]
        yield home[hi[is_first]], v[vi[is_first]]
        apart = np.flatnonzero(label[hi] != label[first])
        if not len(apart):
            continue
        pairs = np.stack((label[hi[apart]], label[first[apart]]), axis=1)
        pairs, example = np.unique(pairs, axis=0, return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        used = []
        for (a, b), e in zip(pairs.tolist(), example.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                used.append(apart[e])
        yield home[hi[used]], v[vi[used]]
        names = np.unique(label)
        label[:] = np.array([find(x) for x in names.tolist()])[np.searchsorted(names, label)]


def cell_links(cells: DataFrame, distance: int) -> DataFrame:
    """(a, b): a spanning forest of the links of every cell."""
    def run(batches):
        now, home, label = None, [], None

        def compare(visitors):
            for a, b in _forest(home, visitors, label, distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cell, fp, is_home = (np.asarray(x) for x in batch.columns)
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if cell[a] != now:
                    if label is None and home:  # a cell of homes alone
                        home = np.concatenate(home)
                        label = np.arange(len(home))
                        yield from compare(home)
                    now, home, label = cell[a], [], None
                n = int(is_home[a:b].sum())  # homes come first
                if n:
                    home.append(fp[a: a + n])
                if a + n < b and (label is not None or home):
                    if label is None:
                        home = np.concatenate(home)
                        label = np.arange(len(home))
                        yield from compare(home)
                    yield from compare(fp[a + n: b])
        if label is None and home:
            home = np.concatenate(home)
            label = np.arange(len(home))
            yield from compare(home)

    rows = cells.select("cell", "fp", "home").repartition("cell").sortWithinPartitions("cell", F.desc("home"))
    return rows.mapInArrow(run, "a long, b long")


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all links."""
    ship_code(classes.sparkSession)
    rows = classes.select(F.lit(0).cast("long").alias("cell"), "fp", F.lit(distance).cast("byte").alias("budget"),
                          F.lit(1).cast("byte").alias("home"))
    out = None
    for level in range(len(BLOCKS)):
        cells, hot, n_hot = dealt(rows, level, distance, False), None, 0
        if level + 1 < len(BLOCKS):
            hot = stored(dealt(rows.where("home = 1"), level, distance, True).groupBy("cell").count()
                         .where(F.col("count") > HOT).select("cell"), "simhash-hot")
            n_hot = hot.count()
        light = cells if not n_hot else join_small_or_shuffle(cells, hot, "cell", "left_anti", n_hot, 16)
        edges = cell_links(light, distance)
        out = edges if out is None else out.unionByName(edges)
        if not n_hot:
            return out
        rows = stored(join_small_or_shuffle(cells, hot, "cell", "left_semi", n_hot, 16), "simhash-cells")
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                   distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, class_size, component_id) for every row; component_id is the smallest id
    reachable by links between fingerprints, the row's own included."""
    prints = stored(fingerprints(docs, id_col, text_col, k), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "simhash-classes")
    total = prints.count()
    linked = connected_components(links(classes, distance))
    classes = stored(classes.join(linked, classes.fp == linked.node, "left")
                     .select("fp", "n", "least", F.coalesce("component", "fp").alias("part")), "simhash-parts")
    parts = classes.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = join_hot_split(classes, parts, "part", "m", classes.count(), "inner").select("fp", "n", "component_id")
    return (join_hot_split(prints, named, "fp", "n", total, "inner")
            .select(F.col("id").alias("doc_id"), "fp", F.col("n").alias("class_size"), "component_id"))
