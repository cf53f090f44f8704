import random

import numpy as np
import pytest
import xxhash

from citeflow.llm import queries, simhash

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"


def plain_print(text):
    """Fingerprint straight from the contract."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """All pairs of distinct fingerprints: smallest id reachable from each row."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        least[find(f)] = min(least.get(find(f), i), i)
    return sorted((i, f"{f:016x}", least[find(f)]) for i, f in prints)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = plain_groups([(r.doc_id, plain_print(r.text)) for r in rows])
    assert sorted(tuple(r) for r in queries.op12_simhash(spark, SMALL).collect()) == want
    assert any(i != c for i, _, c in want)


def test_jvm_hash_agrees(spark):
    text = "Çöl über alles the"
    got = spark.sql(f"select xxhash64('{text}')").first()[0]
    assert simhash.fingerprint(text.encode(), 4) == sum(1 << b for b in range(64) if got >> b & 1) != 0


@pytest.mark.parametrize("hot", [4096, 20, 0])
def test_every_link_within_three_bits_is_met(spark, monkeypatch, hot):
    """Chains of fingerprints one to four bits apart, a dense cluster and noise; hot cells go through all blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
            prints.append(f)
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(150)]
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = [(a % 2 ** 64, b % 2 ** 64) for a, b in simhash.links(classes).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in edges:
        parent[find(a)] = find(b)
    least = {}
    for f in prints:
        least[find(f)] = min(least.get(find(f), f), f)
    assert [(f, f"{f:016x}", least[find(f)]) for f in prints] == plain_groups([(f, f) for f in prints])


def test_long_text_in_slices(monkeypatch):
    rng = random.Random(1)
    text = " \n".join(rng.choice(["Ab", "c", "dé", "longer"]) for _ in range(3000))
    want = plain_print(text)
    assert simhash.fingerprint(text.encode()) == want
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text.encode()) == want


def test_null_empty_short_repeated_clashing(frame):
    rows = [(5, None, 1), (4, "", 2), (3, " \t", 3), (7, "One", 4), (6, "oNE", 5), (None, "one", 6), (8, "a b", 7), (8, "a b", 7),
            (None, "only nulls have this text here", 8)]
    got = {(r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.simhash_groups(frame(rows, D + ", fp int")).collect()}
    one, ab = plain_print("one"), plain_print("a b")
    assert got == {(5, 0, 3), (4, 0, 3), (3, 0, 3), (7, one, 6), (6, one, 6), (None, one, 6), (8, ab, 8),
                   (None, plain_print(rows[-1][1]), None)}
    assert simhash.simhash_groups(frame([], D)).collect() == []
