"""Many literals in one scan: an Aho–Corasick automaton in arrays, driven by numpy.

The trie of all literals has a full table (state x character class -> state) and, per state, the
literal that ends there and the nearest shorter suffix at which another one ends. A chunk of texts is one
array of character classes, cut into lanes that all advance in step; a lane starts early by the length of the longest
literal, so nothing that crosses a cut is lost. The work per character does not depend on the number of literals.
"""

from __future__ import annotations

import numpy as np

#: Entries of one automaton's table; more literals are cut into several automata.
TABLE_ENTRIES = 1 << 24
#: Characters of one numpy pass, and of a lane at least.
PASS_CHARS, LANE = 1 << 20, 1024
#: Stands between texts; no character has this code.
EDGE = 0x110000


class Automaton:
    """Finds all occurrences of ``literals`` (distinct, not empty); ``ids`` are their numbers in the results."""

    def __init__(self, literals: list[str], ids: list[int]):
        self.ids = np.array(ids, dtype=np.int64)
        self.sizes = np.array([len(x) for x in literals], dtype=np.int64)
        self.alphabet = np.array(sorted({ord(c) for x in literals for c in x}), dtype=np.uint32)
        place = {c: i + 1 for i, c in enumerate(self.alphabet.tolist())}
        self.classes = np.zeros(int(self.alphabet.max(initial=0)) + 2, dtype=np.int32)  # the last entry stands for all beyond
        self.classes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        parent, char, depth, own = [0], [0], [0], [-1]
        child: dict[tuple[int, int], int] = {}
        for n, x in enumerate(literals):
            s = 0
            for c in map(ord, x):
                t = child.get((s, c))
                if t is None:
                    t = child[s, c] = len(parent)
                    parent.append(s)
                    char.append(place[c])
                    depth.append(depth[s] + 1)
                    own.append(-1)
                s = t
            own[s] = n
        self.own = np.array(own, dtype=np.int64)
        parent, char, depth = (np.array(v, dtype=np.int64) for v in (parent, char, depth))
        self.width = len(self.alphabet) + 1
        goto = np.zeros((len(parent), self.width), dtype=np.int32)
        suffix = np.zeros(len(parent), dtype=np.int64)
        self.shorter = np.full(len(parent), -1, dtype=np.int64)
        for d in range(1, int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d) if d == 1 else nxt
            up = parent[level]
            if d > 1:
                suffix[level] = goto[suffix[up], char[level]]  # before the parents' own transitions replace it
                goto[up, char[level]] = level
            else:
                goto[0, char[level]] = level
            nxt = np.flatnonzero(depth == d + 1)
            goto[level] = goto[suffix[level]]
            s = suffix[level]
            self.shorter[level] = np.where(self.own[s] >= 0, s, self.shorter[s])
        self.goto = goto.ravel()
        self.ends = (self.own >= 0) | (self.shorter >= 0)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last place, literal) of every occurrence in an array of character codes."""
        classes = self.classes[np.minimum(codes, len(self.classes) - 1)]
        before = int(self.sizes.max()) - 1
        lane = max(LANE, 4 * before)
        n = -(-len(codes) // lane)
        padded = np.zeros(before + n * lane, dtype=np.int32)
        padded[before: before + len(codes)] = classes
        starts = np.arange(n) * lane
        state = np.zeros(n, dtype=np.int32)
        places, states = [], []
        for step in range(before + lane):
            state = self.goto[state * np.int32(self.width) + padded[starts + step]]
            if step >= before:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    places.append(starts[hit] + (step - before))
                    states.append(state[hit])
        if not places:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        place, now = np.concatenate(places), np.concatenate(states).astype(np.int64)
        out_place, out_literal = [], []
        while len(now):
            here = self.own[now]
            out_place.append(place[here >= 0])
            out_literal.append(here[here >= 0])
            now = self.shorter[now]
            place, now = place[now >= 0], now[now >= 0]
        return np.concatenate(out_place), np.concatenate(out_literal)


def automata(literals: list[str]) -> list[Automaton]:
    """Automata over ranges of the sorted literals, none with more than ``TABLE_ENTRIES`` entries."""
    out, part, chars, letters = [], [], 1, set()
    for i in sorted(range(len(literals)), key=literals.__getitem__):
        more = letters | set(literals[i])
        if part and (chars + len(literals[i])) * (len(more) + 1) > TABLE_ENTRIES:
            out.append(Automaton([literals[j] for j in part], part))
            part, chars, more = [], 1, set(literals[i])
        part.append(i)
        chars, letters = chars + len(literals[i]), more
    return [*out, Automaton([literals[j] for j in part], part)] if part else out


#: What a character is at a word's edge.
OTHER, WORD, UNDECIDED = 0, 1, 2

#: Known for ASCII characters and for the end of a text.
_ASCII = np.full(EDGE + 1, UNDECIDED, dtype=np.uint8)
_ASCII[:128] = OTHER
_ASCII[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = WORD
_ASCII[EDGE] = OTHER


def occurrences(machines: list[Automaton], texts: list[str], whole_word: bool, keys: np.ndarray | None = None,
                kinds: np.ndarray = _ASCII) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, literal, sure): each literal of each text once. ``sure`` means that an occurrence stands between word boundaries
    as far as ``kinds``, of every character, tells (or that none are asked for); others have an undecided character at an edge.
    The literals are looked for in the characters' ``keys``, if given."""
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    if not texts or not machines:
        return none
    codes = np.full(sum(map(len, texts)) + len(texts) + 1, EDGE, dtype=np.uint32)
    first, at = np.empty(len(texts), dtype=np.int64), 1
    for i, t in enumerate(texts):
        first[i] = at
        codes[at: at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at += len(t) + 1
    found, known = [], []
    looked = codes if keys is None else keys[codes]
    for m in machines:
        last, literal = m.find(looked)
        sure = np.ones(len(last), dtype=bool)
        if whole_word:
            edges = [kinds[codes[p]] for p in (last - m.sizes[literal], last - m.sizes[literal] + 1, last, last + 1)]
            decided = np.logical_and.reduce([k != UNDECIDED for k in edges])
            fits = (edges[0] != edges[1]) & (edges[2] != edges[3])
            last, literal, sure = (x[fits | ~decided] for x in (last, literal, decided))
        text = np.searchsorted(first, last, side="right") - 1
        found.append((text * (1 << 32) + m.ids[literal]) * 2 + ~sure)
        known.append(len(last))
    if not sum(known):
        return none
    key = np.unique(np.concatenate(found))
    pair = key >> 1
    fresh = np.concatenate(([True], pair[1:] != pair[:-1]))  # a sure occurrence stands before an unsure one
    pair, sure = pair[fresh], key[fresh] % 2 == 0
    return pair >> 32, pair & ((1 << 32) - 1), sure
