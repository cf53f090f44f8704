"""Plain-Python versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]),
                   hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(len(w) - 9 if len(w) >= 10 else min(1, len(w))):
            windows[tuple(w[i:i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        share = total / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in left}
        for s in over:
            out[s] = float(most * sizes[s])
            total -= out[s]
        left -= over
    return out


# ---------------------------------------------------------------- n-gram join

def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingles(text, k):
    w = word_list(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_groups(rows, k=4, percent=85):
    """[(id, set size, component, links)] by comparing every pair."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))
    links = [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links[x] += 1
                    links[y] += 1
                    parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(s), least[root(x)], links[x]) for x, (i, s) in enumerate(sets))


# ---------------------------------------------------------------- lines

def repeated_lines(rows, run, lone=5):
    """[(id, lines, removed places, text)] for rows of distinct ids; a line of ``lone`` words is a run by itself."""
    seen, out = set(), []
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [(at, x.strip(" \t\r")) for at, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for s in range(len(full) - run + 1):
            key = tuple(x for _, x in full[s:s + run])
            if key in seen:
                gone.update(at for at, _ in full[s:s + run])
            seen.add(key)
        for at, x in full:
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= lone:
                if (x, "alone") in seen:
                    gone.add(at)
                seen.add((x, "alone"))
        left = text if not gone else "\n".join(x for at, x in enumerate(lines) if at not in gone)
        out.append((i, len(full), len(gone), ",".join(map(str, sorted(gone))), left))
    return out
