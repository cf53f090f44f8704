import random
import zlib

import numpy as np
import pytest

from citeflow.llm import queries, token_counts, token_output, wavelet, words

SMALL = "/root/testdata/sf0.001"
D = "doc_id bigint, text string"
ODD = ["'s", "'", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "|", ">", "a", "É", "é", "é", "İ", "ſ", "ß", "ẞ",
       "Σ", "ς", "ΟΔΟΣ", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", " ", "  ", "\n", "\t", "\r", "1", "12", "½", "²", "١",
       "中文", "😀", "...", "_", "don't", "the", "ª", "µ", "\x00", "﻿", "ﬁ", "Å", "K", "Ÿ", "ĳ", "well,known", "x" * 90]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def ids(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 9))) for _ in range(n)] + [
        "".join(rng.choice(["a", "b", ".", "1"]) * rng.randint(1, 5) for _ in range(3000)), "word " * 30_000, "noblank" * 700]


def test_counts_and_ids_equal_the_library(library):
    texts = odd_texts(4000)
    want = ids(library, texts)
    machine = token_counts.Transducer.of(queries.tokenizer_path())
    assert token_counts.count_texts(texts, machine) == list(map(len, want))
    flat, at = words.WordIds.of(queries.tokenizer_path()).texts(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_small_memories_give_the_same(library):
    texts = odd_texts(800, 3) + [f"word{i} mixedcase Wörter {i}" for i in range(2000)]
    want = list(map(len, ids(library, texts)))
    machine = token_counts.Transducer(queries.tokenizer_path(), capacity=300, remember=50)
    assert token_counts.count_texts(texts, machine) == want
    few = words.WordIds(queries.tokenizer_path(), remember=20)
    assert np.diff(few.texts(texts)[1]).tolist() == want


def test_long_texts_are_cut_at_blanks(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PASS_CHARS", 50)
    assert token_counts.parts_of("ab cd efg", 4) == ["ab cd", " efg"]
    texts = ["some words of a longer text, cut " * 20, "x" * 500, None, ""]
    machine = token_counts.Transducer.of(queries.tokenizer_path())
    assert token_counts.count_texts(texts, machine) == list(map(len, ids(library, texts)))


def test_op4_whole_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n, n > 2048) for r, n in zip(docs, map(len, ids(library, [r.text for r in docs]))))
    assert sorted(tuple(r) for r in queries.op4_token_counts(spark, SMALL).collect()) == want


def test_op4_edges(frame):
    path = queries.tokenizer_path()
    assert token_counts.token_counts(frame([], D), path).collect() == []
    df = frame([(1, None, 1), (2, "", 2), (2, "", 3), (None, "a b", 4)], D + ", n_tokens int")
    got = sorted((tuple(r) for r in token_counts.token_counts(df, path, limit=1).collect()), key=str)
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True)]


def files(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = np.array(ids(library, [t])[0] + [2], dtype="<u4")
        out.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def test_op8_whole_table(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op8_token_output(spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == files(rows, library)


def test_op8_edges_and_small_shards(spark, frame, library, scratch):
    rows = [(3, "three words here"), (1, None), (2, ""), (2, "b"), (2, "b"), (-5, odd_texts(0)[1]), (None, "no id")]
    df = frame([(*r, "x") for r in rows], D + ", blob string")
    for n, size in enumerate((5, 1 << 19)):
        token_output.write_tokens(df, f"{scratch}/t{n}", queries.tokenizer_path(), shard_tokens=size)
        got = sorted((tuple(r) for r in token_output.read_tokens(spark, f"{scratch}/t{n}").collect()), key=lambda r: r[1])
        assert got == files(rows, library)
    token_output.write_tokens(frame([], D), f"{scratch}/none", queries.tokenizer_path())
    assert token_output.read_tokens(spark, f"{scratch}/none").collect() == []


@pytest.mark.parametrize("n, distinct", [(0, 1), (1, 1), (5, 1), (1000, 2), (5000, 300), (3000, 2999)])
def test_wavelet_matrix(n, distinct):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, distinct, n).astype(np.uint32) * 7 + 2
    lengths = np.array([n // 3, 0, n - n // 3], dtype=np.int64)
    w = wavelet.Wavelet(wavelet.build(ids, lengths))
    assert (w.all() == ids).all() and w.lengths.tolist() == lengths.tolist()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert w.access(i) == ids[i]
        assert w.rank(int(ids[i])) == (ids == ids[i]).sum()
        assert w.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        where = np.flatnonzero(ids == ids[i])[:30]
        assert [w.select(int(ids[i]), k) for k in range(len(where))] == where.tolist()
    assert w.rank(1) == 0 and w.occurrences(1) == []
    with pytest.raises(IndexError):
        w.select(1, 0)


def test_file_is_smaller_than_the_ids(library):
    flat = np.array(ids(library, ["the cat sat on the mat and " * 3000])[0], dtype=np.uint32)
    assert len(wavelet.build(flat, np.array([len(flat)]))) < len(flat)
    with pytest.raises(ValueError):
        wavelet.Wavelet(b"not a file at all, really not one")
