"""Exact ids of a word-BPE tokenizer file, word by word.

Inside plain text the pre-tokenizer's cuts depend on character classes alone, so the ids of a
text are the ids of its runs: lower-case letters, single digits, or punctuation. A *plain* piece
(text between blanks) has only characters of the fixed table below, none of which
composes, folds or joins with its neighbours in another way. Every other piece, such as one with
an apostrophe, a ``<`` (special strings), a combining mark or another script, is
given to the library whole and unchanged.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLANKS = " \t\n\r"
#: Lower-case letters below U+0180 that stand for themselves or an upper-case partner there.
LETTERS = "".join(chr(c) for c in range(0x180) if chr(c).isalpha() and chr(c).lower() == chr(c) and chr(c) not in "ªºµŉſı")
DIGITS = "0123456789"
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<")

#: Lower-casing of the table's characters, one to one.
FOLD = {c.upper(): c for c in LETTERS if len(c.upper()) == 1 and ord(c.upper()) < 0x180 and c.upper() != c}
RUN = re.compile(f"[{re.escape(LETTERS)}]+|[{DIGITS}]|[{re.escape(MARKS)}]+")
_FOLD = str.maketrans(FOLD)


def plain(piece: str) -> str | None:
    """The piece in lower case if it is plain, else None."""
    low = piece.translate(_FOLD)
    return low if sum(map(len, RUN.findall(low))) == len(low) else None


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that byte-level vocabularies write for it."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of runs, pieces and texts with bounded memories; one per Python worker and file."""

    _made: dict[str, "WordIds"] = {}

    def __init__(self, path: str, remember: int = 100_000):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        letter = _byte_letters()
        self.spell = str.maketrans({c: "".join(letter[b] for b in c.encode()) for c in LETTERS})
        self.remember = remember
        self.new: dict[str, tuple[int, ...]] = {}  # two generations: what is used stays
        self.old: dict[str, tuple[int, ...]] = {}
        self.table = RunTable(3 * remember)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of the plain table (lower case)."""
        got = self.new.get(run) or self.old.get(run)
        if got is None:
            got = tuple([t.id for t in self.model.tokenize(run.translate(self.spell))])
        return self._remembered(run, got)

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a text without blanks."""
        low = plain(piece)
        if low is not None:
            return tuple(i for r in RUN.findall(low) for i in self.run(r))
        return tuple(self.whole.encode(piece, add_special_tokens=False).ids)

    def _remembered(self, key: str, got: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= 64:
            if len(self.new) >= self.remember:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets with text i at offsets[i]:offsets[i + 1]); null is empty."""
        parts: list[np.ndarray] = [_NONE] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            low = t.lower() if t else ""
            if ODD.search(low) is None:
                group.append((i, low.encode()))
                size += len(low) + 1
                if size >= 1 << 18:
                    self._plain_texts(group, parts)
                    group, size = [], 0
            else:
                parts[i] = np.fromiter(chain.from_iterable(self.piece(p) for p in BLANK.findall(t)), dtype=np.uint32)
        if group:
            self._plain_texts(group, parts)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return np.concatenate([_NONE, *parts]), offsets

    def _plain_texts(self, group: list[tuple[int, bytes]], parts: list[np.ndarray]) -> None:
        """Ids of plain lower-case texts: runs are cut and hashed by numpy and looked up in the table of known runs."""
        raw = b" ".join(b for _, b in group) + b" "
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[data]
        edge = np.flatnonzero((kind != np.concatenate(([0], kind[:-1]))) | (kind == 2))
        stop = np.append(edge[1:], len(data))
        real = kind[edge] != 0
        start, end = edge[real], stop[real]
        sizes = np.fromiter((len(b) + 1 for _, b in group), dtype=np.int64, count=len(group))
        first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        hashes = span_hashes(data, start, end)
        row = self.table.find(hashes)
        missing = np.flatnonzero(row < 0)
        if len(missing) and self.table.make_room(len(missing)):
            missing = np.arange(len(hashes))
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            runs = [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.table.add(new, [[t.id for t in self.model.tokenize(r.translate(self.spell))] for r in runs])
            row = self.table.find(hashes)
        length = self.table.length[row]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.table.pool[np.repeat(self.table.begin[row] - (ends - length), length) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[first]
        for (i, _), a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            parts[i] = flat[a:b]


_NONE = np.empty(0, dtype=np.uint32)


class RunTable:
    """Open-addressing table from 64-bit run hashes to id lists in one pool; grows with its runs and starts anew when it is full."""

    def __init__(self, runs: int):
        self.limit = runs
        self._clear()

    def _clear(self) -> None:
        self._empty(1 << 12)
        self.n = self.used = 0
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)

    def _empty(self, slots: int) -> None:
        self.slots = slots
        self.key = np.zeros(slots, dtype=np.uint64)
        self.row = np.full(slots, -1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of every hash, -1 where it is unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            row, same = self.row[slot], self.key[slot] == hashes[todo]
            hit = same & (row >= 0)
            out[todo[hit]] = row[hit]
            more = ~same & (row >= 0)
            todo, slot = todo[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def make_room(self, more: int) -> bool:
        """Start anew if ``more`` runs would not fit; true if so."""
        if self.n + more <= self.limit:
            return False
        self.limit = max(self.limit, more)
        self._clear()
        return True

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Add distinct unknown hashes with their ids."""
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, n = int(lengths.sum()), self.n + len(ids)
        while n > len(self.begin):
            self.begin, self.length = (np.concatenate((a, np.zeros_like(a))) for a in (self.begin, self.length))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        rows = np.arange(self.n, n)
        self.pool[self.used: self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=total)
        self.begin[rows] = self.used + np.cumsum(lengths) - lengths
        self.length[rows] = lengths
        self.n, self.used = n, self.used + total
        if 2 * n > self.slots:  # half of the slots stay free
            known = self.row >= 0
            held, held_rows = self.key[known], self.row[known]
            self._empty(1 << (2 * n - 1).bit_length())
            self._place(held, held_rows)
        self._place(hashes, rows)

    def _place(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.row[slot] < 0
            take, first = np.unique(slot[free], return_index=True)  # one key a free slot; the others go on
            won = todo[free][first]
            self.key[take], self.row[take] = hashes[won], rows[won]
            rest = ~np.isin(todo, won)
            todo, slot = todo[rest], (slot[rest] + 1) & (self.slots - 1)


#: Byte of a plain lower-case text -> kind of run: 0 blank, 1 letter, 2 digit (a run each), 3 mark.
_KIND = np.ones(256, dtype=np.uint8)
_KIND[[ord(c) for c in BLANKS]] = 0
_KIND[[ord(c) for c in DIGITS]] = 2
_KIND[[ord(c) for c in MARKS]] = 3

#: Pieces of a text; a character that is neither blank nor plain.
BLANK = re.compile(f"[^{BLANKS}]+")
ODD = re.compile(f"[^{BLANKS}{re.escape(LETTERS)}{DIGITS}{re.escape(MARKS)}]")
