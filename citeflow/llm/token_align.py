"""Alignment of two tokenizers' tokens of the same text, and how well their ids go together.

Both tokenizers cover the bytes of space + text. The end offsets of their tokens are two rising lists; where both
have an end, the text is cut into groups. Per text the shorter list drives: each of its ends is sought in the longer one by
galloping (steps of 1, 2, 4 ... from the last place found, then binary search in between). Lists are walked in lanes of
``LANE`` elements, all lanes of a chunk of texts in step, so that one numpy call serves all. The common indices slice the groups, and
rank differences between them give the ranges of tokens that cover the same bytes.

A link is a pair of token occurrences that end together: the last tokens of a group. Counts of linked id pairs are
a plain aggregate over the corpus. They come back to the texts by a broadcast of the most frequent pairs, at most ``HEAD`` by their
share of all links, and a shuffle on the pair for the others, none of which is frequent.

Texts are cut at single blanks between two other characters, where neither tokenizer can join: the byte-level one
starts a new word there, and no entry of the other one has a blank behind another character (checked when its file is
loaded; otherwise texts go to it whole). The words in between are encoded once and remembered, up to ``WORDS`` of them.

Defined results: a null or empty text, and one whose tokens' bytes are not those of space + text (a tokenizer that
replaces characters), have no tokens: zeros and an empty digest. Repeated rows and equal ids are rows of their own, null ids
included; ties for the highest count of an id all count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, spread_tasks, stored, text_slices

#: Bytes of texts aligned at once, characters of a text cut into words at once.
CHUNK, PIECE = 1 << 18, 1 << 20
#: Remembered words of a tokenizer, and their greatest length.
WORDS, WORD_CHARS = 1 << 18, 64
#: Elements of the shorter list that one lane walks.
LANE = 64
#: Pairs that are broadcast with their counts at most.
HEAD = 1 << 18


# ---------------------------------------------------------------- tokenizers

def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes, in order,
    for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The published word pattern of byte-level BPE, and the texts in whose characters all regex engines see the same classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = re.compile("[\n -~\u00a1-\u024f]*")


class ByteLevel:
    """A byte-level BPE in the tokenizers library's file; special strings inside texts are plain text.

    Latin texts go through tiktoken with the same vocabulary, several times as fast, if the file's merges are in the order
    of their ids, so that ranks mean the same; all others through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.model.get_vocab()
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.entries[i] = bytes(alphabet[c] for c in entry)
        self.cuts, self.ranked = True, None
        file = json.loads(self.model.to_str())
        plain = file["model"]["vocab"]
        merged = [plain["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if file["normalizer"] is None and merged == sorted(set(merged)) and set(plain.values()) - set(merged) == set(range(256)):
            import tiktoken
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, special_tokens={},
                                            mergeable_ranks={self.entries[i]: i for i in plain.values() if i < 256 + len(merged)})

    def common(self, text: str) -> bool:
        return self.ranked is not None and _LATIN.fullmatch(text) is not None

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that begin with their blank."""
        fast = [self.common(p) for p in pieces]
        slow = iter(self.model.encode_batch_fast([p for p, f in zip(pieces, fast, strict=True) if not f], add_special_tokens=False))
        return [self.ranked.encode_ordinary(p) if f else next(slow).ids for p, f in zip(pieces, fast, strict=True)]


class Pieces:
    """A sentencepiece model, which puts a blank before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        n = len(self.model)
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.entries = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.cuts = all(re.fullmatch("▁*[^▁]*", p) for p in names)

    def common(self, text: str) -> bool:
        return True

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in pieces], num_threads=1)


@lru_cache(maxsize=4)
def load(kind: type, path: str):
    coder = kind(path)
    coder.sizes = np.array([len(e) for e in coder.entries], dtype=np.int64)
    coder.words, coder.wrong = {}, set()
    return coder


_CUT, _OTHER_WHITE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"[^\S \n]")


def pieces(text: str, limit: int) -> Iterator[str]:
    """The text without the blanks at which it is cut, after about ``limit`` characters each."""
    at = 0
    while True:
        cut = _CUT.search(text, at + limit) if at + limit < len(text) else None
        yield text[at: cut.start() if cut else len(text)]
        if cut is None:
            return
        at = cut.end()


def words(piece: str) -> list[str]:
    """The piece cut at every single blank between two other characters."""
    if piece[:1] == " " or piece[-1:] == " " or any(x in piece for x in ("  ", " \n", "\n ")) or _OTHER_WHITE.search(piece):
        return _CUT.split(piece)
    return piece.split(" ")


def _learn(coder, new: list[str]) -> tuple[dict[str, bytes], set[str]]:
    """(ids of words, each with a blank before it, as int32 bytes; the words whose tokens are not their bytes). Words that
    do not begin or end with white space are encoded together, some hundred in one text, and taken apart where their bytes end."""
    known: dict[str, bytes] = {}
    entry = coder.entries.__getitem__
    plain = [w for w in new if len(w) <= WORD_CHARS and w == w.strip() != ""] if coder.cuts else []
    latin = {w for w in plain if coder.common(w)}
    for one in (list(latin), [w for w in plain if w not in latin]):
        for at in range(0, len(one), 128):
            part = one[at: at + 128]
            joined = " " + " ".join(part)
            ids = coder.encode([joined])[0]
            if b"".join(map(entry, ids)) != joined.encode():
                continue
            ids = np.array(ids, dtype=np.int32)
            wanted = np.cumsum([len(w.encode()) + 1 for w in part])
            cut = np.searchsorted(np.cumsum(coder.sizes[ids]), wanted) + 1  # words end where tokens do
            raw, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
            known |= {w: raw[x:y] for w, x, y in zip(part, cut[:-1], cut[1:], strict=True)}
    rest, wrong = [w for w in new if w not in known], set()
    for at in range(0, len(rest), 64):
        part = rest[at: at + 64]
        for w, ids in zip(part, coder.encode([" " + w for w in part]), strict=True):
            known[w] = np.array(ids, dtype=np.int32).tobytes()
            if b"".join(map(entry, ids)) != b" " + w.encode():
                wrong.add(w)
    return known, wrong


def cut_texts(texts: list[str], limit: int) -> list[list[list[str]]]:
    """The words of every piece of every text."""
    return [[words(p) for p in pieces(t, limit)] for t in texts]


def encoded(coder, texts: list[str], cut: list[list[list[str]]]) -> list[np.ndarray]:
    """Ids of space + text for every text, or none where the tokens' bytes are not those of space + text."""
    if not coder.cuts:
        cut = [[[t]] for t in texts]
    if len(coder.words) > WORDS:
        coder.words, coder.wrong = {}, set()
    new, wrong = _learn(coder, list(set().union(*(ws for ps in cut for ws in ps)) - coder.words.keys()))
    coder.words |= new
    coder.wrong |= wrong
    every, wrong, out = coder.words, coder.wrong, []
    for text, ps in zip(texts, cut, strict=True):
        ids = np.frombuffer(b"".join(b"".join(map(every.__getitem__, ws)) for ws in ps), dtype=np.int32)
        if wrong and any(not wrong.isdisjoint(ws) for ws in ps) and b"".join(map(coder.entries.__getitem__, ids.tolist())) != b" " + text.encode():
            ids = ids[:0]
        out.append(ids)
    for w in [w for w in new if len(w) > WORD_CHARS]:  # not remembered
        del coder.words[w]
        coder.wrong.discard(w)
    return out


# ---------------------------------------------------------------- galloping

def _gallop(rising: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place from ``at`` on whose element is not below ``wanted``, for all lanes; the last element is a sentinel."""
    low, high, width = at.copy(), at.copy(), np.ones_like(at)
    todo = np.flatnonzero(rising[high] < wanted)
    while len(todo):
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + width[todo], len(rising) - 1)
        width[todo] *= 2
        todo = todo[rising[high[todo]] < wanted[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        less = rising[mid] < wanted[todo]
        low[todo[less]] = mid[less] + 1
        high[todo[~less]] = mid[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def common(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both rising lists of the elements they share; the shorter one drives."""
    n = len(short)
    if not n or not len(long):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    rising = np.append(long, np.iinfo(np.int64).max)
    lane = np.arange(0, n, LANE)
    place, found = np.zeros(len(lane), dtype=np.int64), np.empty(n, dtype=np.int64)
    for step in range(min(LANE, n)):
        lane_at = lane + step
        if lane_at[-1] >= n:  # only the last lane can be shorter
            lane_at = lane_at[:-1]
        place[: len(lane_at)] = _gallop(rising, place[: len(lane_at)], short[lane_at])
        found[lane_at] = place[: len(lane_at)]
    hit = np.flatnonzero(rising[found] == short)
    return hit, found[hit]


def aligned(n_a: np.ndarray, n_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common ends of all texts of a chunk, as indices into both; ends rise over the texts, which have n_a and n_b tokens."""
    a_short = n_a <= n_b
    found = []
    for by_a in (True, False):
        at_a = np.flatnonzero(np.repeat(a_short == by_a, n_a))
        at_b = np.flatnonzero(np.repeat(a_short == by_a, n_b))
        if by_a:
            i, j = common(ends_a[at_a], ends_b[at_b])
        else:
            j, i = common(ends_b[at_b], ends_a[at_a])
        found.append((at_a[i], at_b[j]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a)
    return a[order], b[order]


# ---------------------------------------------------------------- chunks of texts

@lru_cache(maxsize=8)
def _names(n: int, behind: str) -> np.ndarray:
    return np.array([f"{i}{behind}" for i in range(n)], dtype=object)


def group_texts(ids_a, ids_b, at_a, at_b, first_a, first_b) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` per text, from the ids and common ends of a chunk; first: where texts begin."""
    i, j = np.arange(len(ids_a)), np.arange(len(ids_b))
    group_a, group_b = np.searchsorted(at_a, i), np.searchsorted(at_b, j)
    place_a = i + np.concatenate(([0], at_b + 1))[group_a]
    place_b = j + at_a[group_b] + 1
    words = np.empty(len(i) + len(j), dtype=object)
    n = max(int(ids_a.max(initial=0)), int(ids_b.max(initial=0))) + 1
    n = 1 << n.bit_length()
    words[place_a] = _names(n, ",")[ids_a]
    words[place_b] = _names(n, ",")[ids_b]
    words[place_a[at_a]] = _names(n, "|")[ids_a[at_a]]
    words[place_b[at_b]] = _names(n, ";")[ids_b[at_b]]
    words = words.tolist()
    first = (first_a + first_b).tolist()
    return ["".join(words[x:y])[:-1] for x, y in zip(first[:-1], first[1:], strict=True)]


def align_chunk(a, b, texts: list[str], limit: int) -> dict:
    """Columns of the alignment of one chunk."""
    none = np.empty(0, dtype=np.int32)
    full = [t for t in texts if t]
    cut = cut_texts(full, limit)
    pairs = zip(encoded(a, full, cut), encoded(b, full, cut), strict=True)
    ids = list(zip(*((x, y) if len(x) and len(y) else (none, none) for x, y in (next(pairs) if t else (none, none) for t in texts)), strict=True))
    n = [np.array([len(r) for r in x], dtype=np.int64) for x in ids]
    first = [np.concatenate(([0], np.cumsum(x))) for x in n]
    flat = [np.concatenate(x).astype(np.int64) for x in ids]
    ends = [np.cumsum(c.sizes[f]) for c, f in zip((a, b), flat, strict=True)]  # both count the same bytes of the same texts
    at_a, at_b = aligned(*n, *ends)
    text_of = np.searchsorted(first[0], at_a, side="right") - 1
    groups = np.bincount(text_of, minlength=len(texts))
    key, times = np.unique((text_of * len(a.entries) + flat[0][at_a]) * len(b.entries) + flat[1][at_b], return_counts=True)
    key, id_b = np.divmod(key, len(b.entries))
    text_of, id_a = np.divmod(key, len(a.entries))
    return {"n_a": n[0], "n_b": n[1], "n_groups": groups, "groups": group_texts(*flat, at_a, at_b, *first),
            "id_a": id_a, "id_b": id_b, "times": times, "cut": np.searchsorted(text_of, np.arange(len(texts) + 1))}


LINK = "array<struct<a:int,b:int,n:int>>"


def align(docs: DataFrame, a_path: str, b_path: str, a_kind: type = ByteLevel, b_kind: type = Pieces, id_col: str = "doc_id",
          text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, groups (their text, or its digest unless ``texts_out``) and links,
    the distinct linked id pairs with their number."""
    ship_code(docs.sparkSession)
    piece = PIECE

    def run(batches):
        a, b = load(a_kind, a_path), load(b_kind, b_path)
        link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1), CHUNK):
                c = align_chunk(a, b, texts, piece)
                groups = c["groups"] if texts_out else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in c["groups"]]
                pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (c["id_a"], c["id_b"], c["times"])],
                                                   fields=list(link))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(c["n_a"]), pa.array(c["n_b"]), pa.array(c["n_groups"].astype(np.int64)),
                     pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(c["cut"].astype(np.int32)), pairs)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])
                at += len(texts)

    rows = spread_tasks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, groups string, links {LINK}")


def pair_counts(alignment: DataFrame) -> DataFrame:
    """(a, b, count, is_best): links of every id pair over the corpus; is_best: no other pair of b has more."""
    pairs = stored(alignment.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count")), "align-pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))


def agreement(alignment: DataFrame) -> DataFrame:
    """Per row of ``alignment`` its columns but links, with n_links, n_best and count_sum."""
    table = stored(alignment.withColumn("row", F.monotonically_increasing_id()), "align")
    counts = stored(pair_counts(table), "align-counts")
    n_pairs, n_links = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    keep = [c for c in table.columns if c != "links"]
    linked = table.select(*keep, F.inline_outer("links"))
    found = ["n", "count", "is_best"]
    # pairs with more than n_links / HEAD links number fewer than HEAD
    limit = 0 if n_pairs <= HEAD else n_links // HEAD
    head = F.broadcast(counts.where(F.col("count") > limit))
    rows = (linked.join(head, ["a", "b"], "left").withColumn("n", F.when(F.col("count").isNotNull(), F.col("n")))
            .select(*keep, *found))
    if limit:
        rows = rows.unionByName(linked.join(head, ["a", "b"], "left_anti")
                                .join(counts.where(F.col("count") <= limit), ["a", "b"]).select(*keep, *found))
    n = F.coalesce("n", F.lit(0))
    return rows.groupBy(*keep).agg(F.sum(n).cast("long").alias("n_links"),
                                   F.sum(F.when(F.col("is_best"), n).otherwise(0)).cast("long").alias("n_best"),
                                   F.sum(n * F.coalesce("count", F.lit(0))).cast("long").alias("count_sum")).drop("row")
