import os

from pyspark.sql import functions as F

from citeflow.sources import readers as rd


def _write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_corpus_scan(spark, scratch):
    _write(f"{scratch}/a.md", "alpha")
    _write(f"{scratch}/sub/deeper/b.md", "beta\nline")
    _write(f"{scratch}/c.MD", "upper-case extension is not matched")
    _write(f"{scratch}/d.txt", "other extension")
    with open(f"{scratch}/bad.md", "wb") as f:
        f.write(b"caf\xc3\xa9 \xff end")
    rows = {os.path.basename(r["path"]): r["text"] for r in rd.corpus(spark, scratch).collect()}
    assert set(rows) == {"a.md", "b.md", "bad.md"}
    assert rows["b.md"] == "beta\nline"
    assert rows["bad.md"].startswith("café")


def test_text_lines_numbering(spark, scratch):
    _write(f"{scratch}/terms.txt", "A: x\r\n\n# c\nB: y")
    rows = [(r["line_no"], r["value"]) for r in rd.text_lines(spark, f"{scratch}/terms.txt").orderBy("line_no").collect()]
    assert rows == [(1, "A: x"), (2, ""), (3, "# c"), (4, "B: y")]


def test_id_list_header_and_no_header(spark, scratch):
    _write(f"{scratch}/ranked.tsv", "PMID\tScore\r\n11\t3\r\n12\t2\r\n\r\n13")
    got = [r["id"] for r in rd.id_list(spark, f"{scratch}/ranked.tsv", header=True).collect()]
    assert got == ["11", "12", "13"]
    _write(f"{scratch}/plain.txt", "21\n22\n")
    got = [r["id"] for r in rd.id_list(spark, f"{scratch}/plain.txt", header=False).collect()]
    assert got == ["21", "22"]


def test_edges_scan_cleans_ids(spark, scratch):
    raw = spark.createDataFrame([(1, ' "5" '), (1, "x7"), (2, ""), (2, "8\r")], "seed_id long, value string")
    raw.write.parquet(f"{scratch}/edges")
    got = sorted(tuple(r) for r in rd.edges(spark, f"{scratch}/edges").collect())
    assert got == [(1, 5), (2, 8)]


XML = """<?xml version="1.0"?>
<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">101</PMID>
<Article><ArticleTitle>Whole genome <i>Zea</i> study</ArticleTitle>
<Abstract><AbstractText Label="A">First part.</AbstractText><AbstractText>Second &amp; last.</AbstractText></Abstract>
<PublicationTypeList><PublicationType>Journal Article</PublicationType><PublicationType>Review</PublicationType></PublicationTypeList>
</Article>
<CommentsCorrectionsList><CommentsCorrections><PMID>999</PMID></CommentsCorrections></CommentsCorrectionsList>
</MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>102</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""


def test_article_xml(spark, scratch):
    _write(f"{scratch}/a.xml", XML)
    rows = {r["pmid"]: r for r in rd.articles_xml(spark, f"{scratch}/a.xml").collect()}
    assert set(rows) == {101, 102}                # the corrections PMID is no record
    a = rows[101]
    assert a["title"] == "Whole genome Zea study"
    assert a["abstract"] == "First part. Second & last."
    assert a["pubtypes_joined"] == "Journal Article;Review"
    assert rows[102]["abstract"] == "" and rows[102]["pubtypes"] == []


def test_crosswalk_and_raw_documents(spark, scratch):
    _write(f"{scratch}/x/.keep", "")
    _write(f"{scratch}/xw.tsv", "1\t100\n2\t200\n")
    assert [tuple(r) for r in rd.crosswalk(spark, f"{scratch}/xw.tsv").collect()] == [("1", "100"), ("2", "200")]
    _write(f"{scratch}/raw/a.xml", "<x/>")
    _write(f"{scratch}/raw/sub/B.HTM", "<p>b</p>")
    _write(f"{scratch}/raw/c.pdf", "%PDF")
    rows = {os.path.basename(r["path"]): r["src_bytes"] for r in rd.raw_documents(spark, f"{scratch}/raw").collect()}
    assert rows == {"a.xml": 4, "B.HTM": 8}


def test_extraction_tsv_layout(spark, scratch):
    from citeflow import config as cfg
    header = "\t".join(cfg.EXTRACTION_V25_COLUMNS) + "\r\n"
    row = "\t".join(['"A, B"', "T", "J", "2022"] + [""] * 21) + "\n"
    _write(f"{scratch}/v25.tsv", header + row)
    df = rd.extraction_tsv(spark, f"{scratch}/v25.tsv", cfg.EXTRACTION_V25_COLUMNS)
    (r,) = df.collect()
    assert r["Authors"] == "A, B" and r["Publication year"] == "2022"


def test_edge_rejects(spark):
    raw = spark.createDataFrame([(1, ' "5" '), (1, "x7"), (2, ""), (2, "8\r"), (3, "  ")], "seed_id long, value string")
    (r,) = rd.edge_rejects(raw).collect()
    assert (r["rejected"], r["lines"]) == (1, 5)


def test_raw_documents_report_missing_and_bad_bytes(spark, scratch):
    os.makedirs(f"{scratch}/raw2/sub")
    for name, data in (("a.XML", b"<a>fine</a>"), ("sub/b.Htm", b"bad \xff byte"), ("c.txt", b"no")):
        with open(f"{scratch}/raw2/{name}", "wb") as f:
            f.write(data)
    got = {os.path.basename(r["path"]): (r["status"], r["content"]) for r in rd.raw_documents(spark, f"{scratch}/raw2").collect()}
    assert got == {"a.XML": ("ok", "<a>fine</a>"), "b.Htm": ("repaired", "bad \ufffd byte")}
    listed = [f"{scratch}/raw2/a.XML", f"{scratch}/raw2/none.xml"]
    got = {os.path.basename(r["path"]): r["status"] for r in rd.raw_documents(spark, listed).collect()}
    assert got == {"a.XML": "ok", "none.xml": "missing"}
    assert [r["status"] for r in rd.raw_documents(spark, listed[1:]).collect()] == ["missing"]


def test_id_list_skips_lines_and_curated_ids_keep_order(spark, scratch):
    with open(f"{scratch}/ids.txt", "w") as f:
        f.write("title\nheader\n5\tx\r\n\n6\n")
    assert [r["id"] for r in rd.id_list(spark, f"{scratch}/ids.txt", skip=2).collect()] == ["5", "6"]
    with open(f"{scratch}/seeds.txt", "w") as f:
        f.write("# seeds\n9\n\n 3 \n")
    assert [tuple(r) for r in rd.curated_ids(spark, f"{scratch}/seeds.txt").orderBy("ord").collect()] == [(9, 2), (3, 4)]


def _many_files(root, n):
    """Files in folders of three levels, names of every kind; the paths of those that hold raw documents."""
    kept = []
    for i in range(n):
        folder = ("", "a b/%20x", "k=v/deep/er", "dir.xml")[i % 4]
        path = os.path.join(root, folder, f"é {i}.{('xml', 'HTM', 'hTml')[i % 3]}")
        _write(path, b"<p>%d</p>" % i + (b"\xff\xe2\x82" if i % 7 == 0 else b""), "wb")
        kept.append(path)
    for name in (".h/x.xml", "_u/x.xml", ".x.xml", "_x.xml", "x.xml._COPYING_", "x.pdf", "k=v/xml"):
        _write(f"{root}/{name}", "no")
    os.makedirs(f"{root}/empty")
    os.symlink("/nowhere", f"{root}/broken.xml")
    return kept


def test_raw_documents_of_a_folder_are_no_file_index_of_the_driver(spark, scratch):
    kept = _many_files(f"{scratch}/raw", 120)
    got = rd.raw_documents(spark, f"{scratch}/raw/")
    raw = F.col("content").cast("string")
    native = (spark.read.format("binaryFile").option("pathGlobFilter", rd.RAW_GLOB).option("recursiveFileLookup", True).load(f"{scratch}/raw")
              .select("path", "length", F.make_valid_utf8(raw), F.when(F.is_valid_utf8(raw), "ok").otherwise("repaired")))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, native.collect()))
    assert [r[0] for r in rows] == sorted(f"file:{p}" for p in kept)
    assert len(native.inputFiles()) == 120
    assert len(got.inputFiles()) < 20             # the kept lists of names, not the files


def test_document_source_gives_tasks_lists_not_names(spark, scratch):
    from citeflow.sources import files
    kept = _many_files(f"{scratch}/docs", 120)
    df = files.read_documents(spark, f"{scratch}/docs", "xml,html,htm")
    rows = sorted((r["path"], r["src_bytes"], r["status"]) for r in df.collect())
    hidden_folders = [f"{scratch}/docs/.h/x.xml", f"{scratch}/docs/_u/x.xml"]
    assert [r[0] for r in rows] == sorted(kept + hidden_folders)
    assert all(size == os.path.getsize(p) for p, size, _ in rows)
    assert sum(s == "repaired" for *_, s in rows) == 18
    parts = df._jdf.queryExecution().toRdd().partitions()
    size = sum(len(part.inputPartitions().apply(i).pickedPartition())
               for part in parts for i in range(part.inputPartitions().size()))
    assert size < 120 * len(scratch)


def test_many_small_files_are_many_tasks(spark, scratch, monkeypatch):
    from citeflow.sources import files
    monkeypatch.setattr(files, "PART_FILES", 10)
    kept = _many_files(f"{scratch}/small", 95)
    found = files.discovered(spark, f"{scratch}/small", rd._raw_name, rd._entered)
    assert found.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, found.collect())) == sorted((p, os.path.getsize(p)) for p in kept)
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40
