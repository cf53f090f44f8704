from pyspark.sql import functions as F

from citeflow.functions import text as tx


def _one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_clean_id(spark):
    got = _one(spark, tx.clean_id, [' "123" ', "45\r", "", "12a", "007", "99999999999999999999"])
    assert got == [123, 45, None, None, 7, None]


def test_first_field_and_line(spark):
    assert _one(spark, tx.first_field, ["1\tx\ty", "2", ""]) == ["1", "2", ""]
    assert _one(spark, tx.first_line, ["a\r\nb", "c"]) == ["a", "c"]


def test_path_algebra(spark):
    f = lambda c: tx.output_path(c, "/w", "/o")
    got = _one(spark, f, ["/w/a.xml", "/w/x/y/b.HTML", "/elsewhere/c.htm", "/w/noext", "/w/d.tar.gz"])
    assert got == ["/o/./a.md", "/o/x/y/b.md", "/o/./c.md", "/o/./noext.md", "/o/./d.tar.md"]


def test_sniff_window(spark):
    docs = ["<pmc-articleset>", "\n\n\n\njats", "\n\n\n\n\narticle xmlns", "<html>"]
    assert _one(spark, tx.sniff_format, docs) == ["jats", "jats", "html", "html"]


def test_line_class_and_ratio(spark):
    texts = ["x\n" * n for n in (49, 50, 99, 100)]
    assert _one(spark, tx.line_class, texts) == ["warn", "info", "info", "ok"]
    df = spark.createDataFrame([("a" * 9, 100), ("a" * 10, 100), ("x", 0)], "o string, s long")
    got = [tuple(r) for r in df.select(tx.size_ratio(F.col("o"), F.col("s")),
                                       tx.size_ratio(F.col("o"), F.col("s")) < 10).collect()]
    assert got == [(9, True), (10, False), (None, None)]


def test_truncate_bibliography(spark):
    cases = {
        "body\n## References\nx": "body",
        "References\nx": "",
        "a\n   # bibliography\nb": "a",
        "a\nReference genome was used\nb": "a",
        "a\nLiterature Cited\nb\nReferences": "a",
        "a\nReferenced later\nb": "a\nReferenced later\nb",
        "a\n\nReferences": "a\n",
        "plain": "plain",
        "a\n#\nReferences": "a\n#",
    }
    got = _one(spark, tx.truncate_bibliography, list(cases))
    assert got == list(cases.values())
    # idempotent
    assert _one(spark, tx.truncate_bibliography, got) == got


def test_markup_to_text(spark):
    html = ("<html><head><title>T &amp; U</title><style>p{}</style><script>var a='</p>';</script></head>"
            "<body><nav>menu</nav><!-- c --><h1>Head</h1><p>One&nbsp;two</p><p>x &lt; y</p>"
            "<ul><li>i1</li></ul></body></html>")
    (out,) = _one(spark, tx.markup_to_text, [html])
    assert out == "T & U\n# Head\nOne two\nx < y\ni1"
    st = spark.createDataFrame([(html, out), (None, ""), ("<p></p>", ""), ("&copy; b", "&copy; b"), ("a < b", "a < b")], "s string, o string")
    got = [r[0] for r in st.select(tx.conversion_status(F.col("s"), F.col("o"))).collect()]
    assert got == ["ok", "failed", "empty", "ok_with_warnings", "ok_with_warnings"]


def test_text_outside_the_bmp_and_literal_signs(spark):
    (cut,) = _one(spark, tx.truncate_bibliography, ["\U0001F600\U0001F600\U0001F600 body\n## References\nx"])
    assert cut == "\U0001F600\U0001F600\U0001F600 body"
    (title,) = _one(spark, tx.strip_tags, ["Low FST < 0.05 and pi > 0.1 in <i>Zea</i> mays"])
    assert title == "Low FST < 0.05 and pi > 0.1 in Zea mays"
    html = "<table><tr><td>SNP</td><td>GWAS</td></tr></table><dl><dt>SNP</dt><dd>Fst</dd></dl>"
    (out,) = _one(spark, tx.markup_to_text, [html])
    assert out.split() == ["SNP", "GWAS", "SNP", "Fst"]


def test_article_sections_become_headings(spark):
    from citeflow.operators import convert as cv
    jats = '<article xmlns="x"><front><article-title>A</article-title></front><sec><title>M</title><p>t</p></sec></article>'
    df = spark.createDataFrame([(jats,), ("<title>T</title><p>t</p>",)], "content string")
    assert [r["text"] for r in cv.convert(df).collect()] == ["# A\n## M\nt", "T\nt"]


def test_size_ratio_of_large_texts(spark):
    df = spark.range(1).select(F.repeat(F.lit("x"), 22_000_000).alias("t"))
    assert df.select(tx.size_ratio(F.col("t"), F.lit(44_000_000))).first()[0] == 50


def test_markup_faults(spark):
    cases = [("html", "<p>a<p>b", None), ("html", "<div><p>a</div>", None), ("html", "<ul><li>a<li>b</ul>", None), ("html", "<DIV>a</div>", None),
             ("jats", "<P>a</p>", "stray:p"), ("jats", "<p>a", "unclosed:p"), ("jats", "<a><b/></a>", None), ("html", "<br>a<img src='x>y'>", None),
             ("html", "<b><i>x</b></i>", "crossed:b"), ("html", "x</span>", "stray:span"), ("html", "x</p>", None), ("html", "<div><span>x", "unclosed:span"),
             ("html", "<script>if (a<b) '</div>'</script><p>x", None), ("html", "<!-- <div> -->x", None), ("jats", "<a><![CDATA[<b>]]></a>", None),
             ("html", "a < b and c > d", None), ("html", "", None), ("html", None, None), ("jats", "<s><p>x</s></p>", "crossed:s"),
             ("html", "<div>" * 300 + "</div>" * 300, None), ("html", '<a title="</a>">x</a>', None)]
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(cases)], "i int, f string, t string")
    got = dict(df.select("i", tx.markup_fault("t", F.col("f"))).collect())
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
