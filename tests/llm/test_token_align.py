import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeflow.llm import queries, token_align
from citeflow.llm.token_align import ByteLevel, Pieces

D = "doc_id bigint, text string"
SMALL = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def coders():
    return (token_align.load(ByteLevel, queries.tokenizer_path(queries.BYTES)),
            token_align.load(Pieces, queries.tokenizer_path(queries.PIECES)))


def plain_document(text):
    """Ids and groups of one text, straight from the libraries, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer
    if "a" not in plain_document.__dict__:
        plain_document.a = Tokenizer.from_file(queries.tokenizer_path(queries.BYTES))
        plain_document.a.encode_special_tokens = True
        plain_document.b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))
    if not text:
        return [], [], []
    a, b = plain_document.a, plain_document.b
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    table = {}
    for x in range(256):  # the published rule of byte-level vocabularies
        own = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        table[chr(x if own else 256 + sum(not (33 <= y <= 126 or 161 <= y <= 172 or 174 <= y <= 255) for y in range(x)))] = x
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], []
    ends = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    groups, now_a, now_b = [], [], []
    i = j = 0
    for at in range(1, len((" " + text).encode()) + 1):
        end_a, end_b = i < len(ends[0]) and ends[0][i] == at, j < len(ends[1]) and ends[1][j] == at
        if end_a:
            now_a.append(ids_a[i])
            i += 1
        if end_b:
            now_b.append(ids_b[j])
            j += 1
        if end_a and end_b:
            groups.append((now_a, now_b))
            now_a, now_b = [], []
    return ids_a, ids_b, groups


def plain(rows):
    docs = [(i, *plain_document(t)) for i, t in rows]
    count = Counter((a[-1], b[-1]) for _, _, _, g in docs for a, b in g)
    most = {}
    for (a, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, ids_a, ids_b, g in docs:
        pairs = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, len(ids_a), len(ids_b), len(g), len(g), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def got(df, last="groups"):
    return sorted((tuple(r) for r in df.select(*COLUMNS, last).collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(rows)
    assert got(queries.op13_token_alignment(spark, SMALL), "groups_sha256") == want
    assert any(0 < w[5] < w[4] for w in want)


ODD = ["", None, " ", "  two  blanks ", "\t\n x\r\n", "<|endoftext|> <s></s> <unk>", "a▁b", "▁", "\x00nul", "é ﬁ Ⅳ 　x", "日本語の文", "🙂🙃 🙂",
       "don't it's we'll", "x" * 3000, "1234567890 12 345", "...!!! ??", "naïve Übergröße", "﻿bom", "a b", "A  B C"]


@pytest.mark.parametrize("head", [1 << 18, 8, 1])
def test_odd_texts_repeats_nulls_and_rare_pairs(frame, monkeypatch, head):
    """With a small head most pairs take the shuffled way."""
    monkeypatch.setattr(token_align, "HEAD", head)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a b"), (3, "a b"), (None, "again the same words"), (None, None)]
    df = frame([(*r, 1, "x") for r in rows], D + ", links int, n_a string")
    out = token_align.agreement(token_align.align(df, queries.tokenizer_path(queries.BYTES), queries.tokenizer_path(queries.PIECES)))
    assert got(out) == plain(rows)


def test_empty(frame):
    out = token_align.agreement(token_align.align(frame([], D), queries.tokenizer_path(queries.BYTES), queries.tokenizer_path(queries.PIECES)))
    assert out.collect() == []


@pytest.mark.parametrize("limit", [1, 5, 40, 1 << 20])
def test_words_and_pieces_encode_like_the_whole(coders, limit, monkeypatch):
    monkeypatch.setattr(token_align, "WORDS", 50)
    monkeypatch.setattr(token_align, "WORD_CHARS", 6)
    rng = random.Random(limit)
    texts = ["".join(rng.choice(["word", "s", " ", " ", "  ", "\n", "\t", "'s", "é", ".", "9", "日", " ", "🙂", "The", "ing", "\x1c", "\xa0"])
                     for _ in range(400)) for _ in range(30)] + [" ", "x", " x ", "a  b", *filter(None, ODD)]
    for coder in coders:
        assert coder.cuts
        got = [i.tolist() for i in token_align.encoded(coder, texts, token_align.cut_texts(texts, limit))]
        whole = [coder.encode([" " + t])[0] for t in texts]
        assert got == [i if b"".join(coder.entries[x] for x in i) == b" " + t.encode() else [] for i, t in zip(whole, texts)]
        assert sum(map(bool, got)) > 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True), st.lists(st.integers(0, 400), unique=True), st.integers(1, 70))
def test_galloping_finds_the_intersection(x, y, lane):
    token_align.LANE, before = lane, token_align.LANE
    try:
        short, long = sorted((sorted(x), sorted(y)), key=len)
        i, j = token_align.common(np.array(short, dtype=np.int64), np.array(long, dtype=np.int64))
        assert [short[k] for k in i] == sorted(set(x) & set(y)) == [long[k] for k in j]
    finally:
        token_align.LANE = before


def test_ranges_of_tokens_are_in_the_groups(frame):
    out = token_align.align(frame([(1, "tokenization alignments")], D), queries.tokenizer_path(queries.BYTES),
                            queries.tokenizer_path(queries.PIECES), texts_out=True)
    assert out.first().groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_document("tokenization alignments")[2])
