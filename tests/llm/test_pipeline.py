"""The pipeline against plain-Python versions of its stages."""

import zlib

import numpy as np

import corpus_pipeline
from citeflow.llm import queries

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, scratch):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
        seen.append(name)
        rows = [(r.doc_id, r.text) for r in before]
        if i < 4:
            assert docs.columns == columns
            after = sorted(r.doc_id for r in docs.collect())
        if name == "language_id":
            assert after == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text))
        elif name == "ngram_jaccard_join":
            assert after == sorted({c for _, _, c, _ in brute.near_groups(rows, 5, 80)})
        elif name == "benchmark_decontamination":
            assert after == [r[0] for r in brute.contamination(rows, bench) if not r[-1]]
        elif name == "mixing":
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + brute.n_words(r.text)
            got = {}
            for r in docs.collect():
                got[r.source] = got.get(r.source, 0) + brute.n_words(r.text)
            longest = max(brute.n_words(r.text) for r in before)
            for s, t in brute.targets(sizes).items():
                assert abs(got.get(s, 0) - t) <= 2 * longest
        else:
            library, start = Tokenizer.from_file(queries.tokenizer_path()), 0
            want = []
            for doc_id, text in sorted(rows):
                own = np.array(library.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
                want.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
                start += len(own)
            assert sorted(tuple(r) for r in docs.collect()) == want
    assert len(seen) == 5


def test_run_equals_the_stages(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
    want = sorted(tuple(r) for r in docs.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == want and want


def test_short_label_and_odd_rows_pass_the_stages(spark, scratch):
    """A one-word label takes nothing with it; null, empty and repeated rows and further columns have their defined results."""
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = real.columns
    odd = spark.createDataFrame([(10 ** 6, "ok a", "zz", "web", 4), (10 ** 6 + 1, None, "en", "web", 0), (10 ** 6 + 2, "", None, None, 0),
                                 (10 ** 6 + 3, "12 34", "en", "web", 5), (None, "A text that has no number of its own at all.", "en", "web", 44)],
                                real.schema)
    docs = real.unionByName(odd).withColumn("lid_lang", real.doc_id.isNull())
    kept = corpus_pipeline.language(spark, docs, SMALL)
    assert kept.columns == [*columns, "lid_lang"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in real.collect() if any(c.isalpha() for c in r.text or "")} | {10 ** 6, None} == ids


def test_workers_get_bounded_batches(spark):
    """Whole texts reach a Python worker in batches of a few MB, not all that fit 64 MB; the caller's own bound stands."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from citeflow.llm import langid
    from citeflow.llm.common import ARROW_BYTES, ARROW_SETTING

    def largest(docs):
        langid.reject_foreign(docs)  # binds the session

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 2000
        return max(r["bytes"] for r in got)

    docs = (spark.range(0, 2000, 1, 1).withColumnRenamed("id", "doc_id")
            .withColumn("text", F.repeat(F.lit("some words "), 1000)).withColumn("lang", F.lit("en")))
    before = spark.conf.get(ARROW_SETTING, None)
    try:
        spark.conf.unset(ARROW_SETTING)
        assert largest(docs) < 2 * ARROW_BYTES
        spark.conf.set(ARROW_SETTING, str(4 * ARROW_BYTES))
        assert largest(docs) > 2 * ARROW_BYTES
    finally:
        spark.conf.unset(ARROW_SETTING)
        if before is not None:
            spark.conf.set(ARROW_SETTING, before)


def test_workers_hold_what_they_met():
    """Batches of a MB, a table of runs that grows with its runs, and no columns for letters that no sample has."""
    from citeflow.llm import common, langid, words

    assert common.ARROW_BYTES <= 1 << 20
    table, rng = words.RunTable(300_000), np.random.default_rng(3)
    assert table.key.nbytes + table.row.nbytes <= 1 << 16
    hashes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    for part in np.array_split(rng.permutation(hashes), 7):
        table.add(part, [[int(h % 97)] * int(h % 3) for h in part])
    row = table.find(hashes)
    assert sorted(row.tolist()) == list(range(len(hashes))) and table.slots == 1 << 16
    assert [table.pool[b: b + n].tolist() for b, n in zip(table.begin[row], table.length[row], strict=True)] \
        == [[int(h % 97)] * int(h % 3) for h in hashes]
    assert (table.find(np.setdiff1d(hashes + np.uint64(1), hashes)) < 0).all()
    assert table.make_room(300_000) and (table.find(hashes) < 0).all()

    few = langid.Model({"aa": "abc cab bca " * 40, "bb": "xyz zyx yxz " * 40}, 4096, 2048)
    assert few.width == 2 + 1 + 6
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300))
    assert langid.Model({"aa": "abc cab " * 40, "zz": many * 3}, 4096, 2048).width == 2 + 32 + 200


def test_letters_that_no_sample_has_may_share_one_symbol(monkeypatch):
    """One shared symbol or 32: the same predictions, unknown letters included."""
    from citeflow.llm import langid

    samples = {"aa": "the cat sat on the mat and the dog ran home " * 30, "bb": "der hund lief nach haus und die katze schlief " * 30}
    texts = ["the dog sat", "der hund lief", "\u0436\u0437\u0438 the", "\u4e00\u4e8c\u4e09 der hund", "q", "\u0436", "cat\u00e9 j\u00e9 x", "", "12"]
    want = langid.Model(samples, 8192, 4096).predict(texts)
    every = langid.letters()

    def spread(points):
        table = np.full(0x110000, langid.GAP, dtype=np.uint8)
        where = np.flatnonzero(every)
        table[where] = 2 + where % 32
        seen = langid.Counter(c for s in points for c in s.tolist() if every[c])
        for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:200]):
            table[c] = 34 + i
        return table

    monkeypatch.setattr(langid, "symbol_table", spread)
    assert langid.Model(samples, 8192, 4096).predict(texts) == want
