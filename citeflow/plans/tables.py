"""Stand-in inputs derived from the provided tables.

The original pipeline works on seeds, link edges, article records, id lists and
landed documents; none of those exist in the test data, so each is derived from
the provided tables by a fixed rule. Every derivation reads a whole table (or
data Spark derives from it), so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.util import spread

# FIXED VALUES of the stand-in mapping (shared with the DuckDB oracle).
SEED_MOD, SEED_REM = 9, 4        # seeds: parts with key % 9 = 4
EXCL_MOD = 23                    # exclusions: parts with key % 23 = 0
STANDIN_MIN_ID = 20              # cut-off on candidate ids
NO_META_MOD = 4                  # documents with doc_id % 4 = 0 have no article record
EMPTY_DOC_MOD = 41               # landing: documents with doc_id % 41 = 0 arrive empty
BIBLIO_MOD = 3                   # truncation: a heading is spliced into doc_id % 3 = 0
BLANK_PRIMARY_MOD = 5            # rendition fallback: primary blank for page_id % 5 = 0
CORRECTED = "Corrected: "        # title prefix of the second delivery of a record
SIGNS = " Fst < 0.05 and pi > 0.1 in maize"  # literal signs at the end of every 13th title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, ord): curated seeds, ``ord`` is the processing order."""
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_partkey") % SEED_MOD == SEED_REM).select(
        F.col("p_partkey").alias("seed_id"), F.col("p_partkey").cast("int").alias("ord"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_partkey") % EXCL_MOD == 0).select(F.col("p_partkey").alias("pmid"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, cand_id): parts on neighbouring lines of the same order, both
    directions (a pair seen in several orders repeats; the ranking treats the
    edges as a set, ``RankConfig.distinct_edges``). Built by an equi-join on
    (order, line number) so that an order with very many lines never becomes
    one join group: the output is linear in lineitem, never all pairs within
    an order."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    nxt = li.select(F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("l_linenumber"),
                    F.col("l_partkey").alias("b"))
    pair = li.join(nxt, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("b"))
    both = F.array(F.struct(F.col("l_partkey").alias("seed_id"), F.col("b").alias("cand_id")),
                   F.struct(F.col("b").alias("seed_id"), F.col("l_partkey").alias("cand_id")))
    return pair.select(F.inline(both))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed_id, value): an edge per lineitem, the candidate as raw text: quoted, padded, with a CR,
    blank or no number, by line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("seed_id"), F.expr(RAW_EDGE_SQL).alias("value"))


RAW_EDGE_SQL = """CASE l_linenumber % 6
  WHEN 0 THEN '"' || CAST(l_partkey AS STRING) || '"' WHEN 1 THEN '  ' || CAST(l_partkey AS STRING) || ' '
  WHEN 2 THEN CAST(l_partkey AS STRING) || chr(13) WHEN 3 THEN '' WHEN 4 THEN 'x' || CAST(l_partkey AS STRING)
  ELSE CAST(l_partkey AS STRING) END"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, title, abstract, pubtypes): documents with doc_id % 4 <> 0 stand in for
    article records; the rest of the candidates have none (fail-open path)."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % NO_META_MOD != 0).select(
        F.col("doc_id").alias("pmid"), F.col("text").alias("title"), F.lit("").alias("abstract"),
        F.col("source").alias("pubtypes"))


def term_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value): dictionary lines built from ``part`` so every parse case
    occurs at every scale (comment, no colon, empty name, empty alternatives,
    no alternatives, blank, second colon, plain)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("line_no"), F.expr(TERM_LINE_SQL).alias("value"))


TERM_LINE_SQL = """CASE p_size % 8
  WHEN 0 THEN '# ' || p_name
  WHEN 1 THEN p_name
  WHEN 2 THEN ' : ' || replace(p_name, ' ', '|')
  WHEN 3 THEN p_brand || ': ' || replace(p_name, ' ', ' || ')
  WHEN 4 THEN p_brand || ':  |  | '
  WHEN 5 THEN '   '
  WHEN 6 THEN p_type || ' : ' || p_name || ': x|' || p_brand
  ELSE '  ' || p_brand || ':' || replace(p_name, ' ', ' |') || '  '
END"""


# --- article records as PubMed-style XML (q13, q18) ---------------------------

def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, batch, xml): one PubmedArticle per document — title = first line,
    one AbstractText per further line, publication types = source and lang.

    Every 7th record carries inline markup in title and abstract, every 13th title holds literal
    ``<`` and ``>``, every 10th record also lists a
    second PMID inside a corrections list (must not start a new record), and
    every 10th document is delivered twice: batch 1 carries a corrected title
    ("Corrected: " prefix) that must win over batch 0.
    """
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")

    def marked(raw):
        t = _xml_escape(raw)
        return F.when(F.col("doc_id") % 7 == 0,
                      F.regexp_replace(t, r"^(\S+)", "<i>$1</i>")).otherwise(t)

    signs = F.when(F.col("doc_id") % 13 == 0, F.lit(SIGNS)).otherwise(F.lit(""))
    title = marked(F.concat(F.element_at(lines, 1), signs))
    sections = F.array_join(F.transform(F.slice(lines, 2, 1 << 30),
                                        lambda s: F.concat(F.lit("<AbstractText>"), marked(s),
                                                           F.lit("</AbstractText>"))), "")
    corrections = F.when(F.col("doc_id") % 10 == 0, F.concat(
        F.lit("<CommentsCorrectionsList><CommentsCorrections><PMID>"),
        (F.col("doc_id") + 1).cast("string"),
        F.lit("</PMID></CommentsCorrections></CommentsCorrectionsList>"))).otherwise(F.lit(""))

    def record(t):
        return F.concat(
            F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"),
            F.lit("</PMID><Article><ArticleTitle>"), t, F.lit("</ArticleTitle><Abstract>"),
            sections, F.lit("</Abstract><PublicationTypeList><PublicationType>"), F.col("source"),
            F.lit("</PublicationType><PublicationType>"), F.col("lang"),
            F.lit("</PublicationType></PublicationTypeList></Article>"), corrections,
            F.lit("</MedlineCitation></PubmedArticle>"))

    first = d.select(F.col("doc_id").alias("pmid"), F.lit(0).alias("batch"), record(title).alias("xml"))
    again = d.where(F.col("doc_id") % 10 == 0).select(
        F.col("doc_id").alias("pmid"), F.lit(1).alias("batch"), record(marked(F.concat(F.lit(CORRECTED), F.element_at(lines, 1), signs))).alias("xml"))
    return first.unionByName(again)


# --- crosswalk and landing (q14-q17) --------------------------------------------

def id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested-id lines as a ranked TSV would carry them: id<TAB>name<CR>."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.col("c_name"),
                             F.lit("\r")).alias("value"))


def crosswalk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, pmcid, ord): catalogue answers — finished orders of each customer,
    earliest (date, key) first."""
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").cast("string").alias("pmid"),
        F.col("o_orderkey").cast("string").alias("pmcid"),
        F.struct("o_orderdate", "o_orderkey").alias("ord"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmcid, content): what a fetch returns — every 41st document empty."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("pmcid"),
                    F.when(F.col("doc_id") % EMPTY_DOC_MOD == 0, F.lit("")).otherwise(F.col("text"))
                    .alias("content"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmcid, n_bytes): targets already present — the labelled documents."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pmcid"))
    return lab.join(fetched(spark, sf_dir), "pmcid").select(
        "pmcid", F.octet_length("content").alias("n_bytes"))


# --- raw markup documents (q18-q21, q24) ----------------------------------------

RAW_ROOT = "/data/raw"
MD_ROOT = "/data/md"


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): documents as markup, by id: well-formed, an end left out, two elements crossed, an end too many,
    html with optional ends left out and empty elements, a comment full of tags, no text, nothing at all."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED_UP_SQL).alias("content"))


_PLAIN = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MARKED_UP_SQL = f"""CASE doc_id % 8
  WHEN 0 THEN concat('<article xmlns="x"><sec><title>T</title><p>', {_PLAIN}, '</p></sec></article>')
  WHEN 1 THEN concat('<article xmlns="x"><sec><title>T</title><p>', {_PLAIN}, '</sec></article>')
  WHEN 2 THEN concat('<html><body><p><b><i>', {_PLAIN}, '</b></i></p></body></html>')
  WHEN 3 THEN concat('<html><body><div><p>', {_PLAIN}, '</p></div></div></body></html>')
  WHEN 4 THEN concat('<html><body><ul><li>one<li>', {_PLAIN}, '</ul><p>a<br>b<img src="x"><p>c</body></html>')
  WHEN 5 THEN concat('<html><body><!-- <p><div> --><div>', {_PLAIN}, '</body></html>')
  WHEN 6 THEN '<html><body><div></div></body></html>' ELSE CAST(NULL AS STRING) END"""


#: Role rules: documents whose file has a byte that is no UTF-8, or is named but not there; answers from this year on are late.
BROKEN_MOD, MISSING_MOD, LATE_YEAR = 11, 13, 1998


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): documents as raw files in folders; of every ten the first two differ in their extension only."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.expr(NAMED_PATH_SQL).alias("path"), "text")


NAMED_PATH_SQL = f"""concat('{RAW_ROOT}/', CAST(floor(doc_id / 10) % 7 AS INT), '/doc.',
  CAST(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS BIGINT),
  CASE WHEN doc_id % 10 = 1 THEN '.html' WHEN doc_id % 3 = 0 THEN '.HTM' ELSE '.xml' END)"""


def sniff_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): web pages plus article XML whose format marker sits on
    line 1..6 (line 6 is past the sniff window)."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("PMC"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"),
        F.expr(SNIFF_DOC_SQL).alias("content"))
    return pages.unionByName(docs)


SNIFF_DOC_SQL = """repeat(chr(10), CAST(doc_id % 6 AS INT)) || '<!-- ' ||
  CASE doc_id % 3 WHEN 0 THEN 'pmc-articleset' WHEN 1 THEN 'jats' ELSE 'article xmlns' END
  || ' -->' || chr(10) || text"""


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, src_bytes, content): pages as landed files; every 7th sits
    outside the raw root (its output goes to the top of the output root)."""
    p = table(spark, sf_dir, "pages")
    p = p.select("page_id", F.expr(PAGE_PATH_SQL).alias("path"), F.expr(PAGE_CONTENT_SQL).alias("content"))
    return p.select("page_id", "path", F.octet_length("content").alias("src_bytes"), "content")


# Every fifth page also has a table, a definition list and encoded signs; every fifth is an
# article of the other format, with sections.
PAGE_CONTENT_SQL = """CASE page_id % 5
  WHEN 0 THEN html || '<table><tr><td>SNP</td><td>GWAS &lt; 0.05</td></tr></table><dl><dt>SNP</dt><dd>Fst 😀</dd></dl>'
  WHEN 1 THEN '<article xmlns="x"><front><article-title>About ' || url || '</article-title></front><sec><title>Methods</title>'
    || '<p>One &amp; two</p></sec><sec><title>Data</title><p>a &gt; b</p></sec></article>'
  ELSE html END"""


PAGE_PATH_SQL = f"""CASE WHEN page_id % 7 = 0 THEN '/elsewhere/' || CAST(page_id AS STRING) || '.htm'
  ELSE '{RAW_ROOT}/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || '.html' END"""


def spliced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with bibliography headings spliced in (none has
    one natively): after the body, on line 1, a look-alike that must not cut,
    and a 'Reference genome' body line that does cut (as in the original)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr(SPLICE_SQL).alias("text"))


SPLICE_SQL = """CASE doc_id % 6
  WHEN 0 THEN text || chr(10) || '## References' || chr(10) || 'Smith J (2020) A cited work.'
  WHEN 1 THEN '😀😀😀😀 ' || text || chr(10) || 'BIBLIOGRAPHY' || chr(10) || '[1] Doe J.'
  WHEN 2 THEN text || chr(10) || 'Referenced works follow.'
  WHEN 3 THEN '  # Literature Cited' || chr(10) || text
  WHEN 4 THEN substr(text, 1, instr(text, chr(10))) || 'Reference genome v2 was used.' || chr(10) || text
  ELSE text END"""


def renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, fmt, primary, standard): full rendition blank for every 5th page."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, "html").otherwise("xml").alias("fmt"),
        F.when(F.col("page_id") % BLANK_PRIMARY_MOD == 0, F.lit("")).otherwise(F.col("html")).alias("primary"),
        F.concat(F.lit("<html><body>"), F.col("url"), F.lit("</body></html>")).alias("standard"))


# --- extraction tables (q25-q29) -----------------------------------------------

# Canonical field → portable SQL (Spark and DuckDB) over documents ⟕ labels.
EXTRACTION_SQL = (
    ("authors", "'Author ' || upper(lang) || '; Author ' || source"),
    ("title", "split_part(text, chr(10), 1)"),
    ("journal", "source"),
    ("year", "CAST(2000 + doc_id % 25 AS STRING)"),
    ("doi", "'10.1000/' || CAST(doc_id AS STRING)"),
    ("pmid", "CAST(doc_id AS STRING)"),
    ("pmcid", "'PMC' || CAST(doc_id AS STRING)"),
    ("species", "lang"),
    ("samples", "CAST(n_chars AS STRING) || ' (' || CAST(n_chars % 100 AS STRING) || ' contemporary + '"
                " || CAST(n_chars - n_chars % 100 AS STRING) || ' historical)'"),
    ("sweeps", "CASE WHEN coalesce(quality, 0) = 1 THEN 'Yes' ELSE 'No' END"),
    ("sweep_methods", "CASE WHEN coalesce(quality, 0) = 1 THEN 'XPEHH; iHS' ELSE '' END"),
    ("sel_coef", "CASE WHEN coalesce(toxic, 0) = 1 THEN 'Yes' ELSE 'No' END"),
    ("sel_coef_value", "CASE WHEN coalesce(toxic, 0) = 1 THEN '~0.0' || CAST(doc_id % 9 AS STRING)"
                       " || '-0.1' || CAST(doc_id % 7 AS STRING) ELSE '' END"),
    ("pooled", "CASE WHEN doc_id % 2 = 0 THEN ' yes ' ELSE 'NO' END"),
    ("soft_sweeps", "CASE WHEN doc_id % 5 = 0 THEN 'Yes' ELSE 'No' END"),
    ("soft_sweep_tools", "CASE WHEN doc_id % 5 = 0 THEN 'H12/H1; diploS/HIC' ELSE '' END"),
    ("balancing", "CASE WHEN doc_id % 11 = 0 THEN 'Yes' ELSE 'No' END"),
    ("purifying", "CASE WHEN coalesce(toxic, 0) = 0 THEN 'Yes' ELSE 'No' END"),
    ("go_enrichment", "'No'"),
    ("go_terms", "''"),
    ("genes", "split_part(text, ' ', 1) || '; ' || split_part(text, ' ', 2) || '; ' || split_part(text, ' ', 3)"),
    ("sweep_genes", "split_part(text, ' ', 1)"),
    ("polygenic", "CASE WHEN doc_id % 3 = 0 THEN 'Yes' ELSE 'unsure' END"),
    ("polygenic_traits", "CASE WHEN doc_id % 3 = 0 THEN 'height; yield' ELSE '' END"),
    ("notes", "'n=' || CAST(n_chars AS STRING)"),
)


def extraction_layout_exprs(rename: dict, list_sep: str = "; ", quote: str = "`"):
    """SELECT list that renders the stand-in rows under a layout's headers."""
    canon = dict(EXTRACTION_SQL)
    out = []
    for header, c in rename.items():
        e = canon[c]
        if list_sep != "; ":
            e = f"replace({e}, '; ', '{list_sep}')"
        out.append(f"{e} AS {quote}{header}{quote}")
    return out


def extraction_rows(spark: SparkSession, sf_dir: str, rename: dict, labelled: bool,
                    list_sep: str = "; ") -> DataFrame:
    """Extraction-table rows in a given layout: labelled documents (25-column
    layout) or unlabelled ones (23-column layout)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    src = d.join(lab, "doc_id", "inner" if labelled else "left_anti")
    if not labelled:
        src = src.select("*", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return src.selectExpr(*extraction_layout_exprs(rename, list_sep))


QUANTITY_SQL = """CASE l_linenumber % 7
  WHEN 0 THEN '~' || printf('%.2f', l_discount) || '-' || printf('%.2f', l_tax)
  WHEN 1 THEN printf('%.2f', l_discount) || '–' || printf('%.2f', l_tax) || ' per year'
  WHEN 2 THEN CAST(l_linenumber AS STRING) || ' loci, ' || printf('%.2f', l_discount) || ' - ' || printf('%.2f', l_tax)
  WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || 'e-4 at most'
  WHEN 4 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',024 samples'
  WHEN 5 THEN 's = -0.' || CAST(10 + CAST(l_quantity AS BIGINT) AS STRING)
  ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' (' || CAST(l_linenumber AS STRING)
       || ' contemporary + ' || CAST(l_suppkey % 100 AS STRING) || ' historical)' END"""


# --- the study's own queries (q22b, q23c) ---------------------------------------

# Sentences of the study's subject at the end of some documents, and publication types.
STUDY_TEXT_SQL = """CASE doc_id % 6
  WHEN 0 THEN text || ' Whole-genome resequencing of crop plants: a selective sweep.'
  WHEN 1 THEN text || ' Whole genome sequencing of a plant shows positive selection, with a genome assembly.'
  WHEN 2 THEN text || ' ' || '{keywords}'
  ELSE text END"""
STUDY_TYPE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Journal Article' WHEN 1 THEN 'Review' ELSE source END"


def study_text_sql() -> str:
    from ..config import SEARCH_QUERY_TERMS
    return STUDY_TEXT_SQL.replace("{keywords}", " and ".join(SEARCH_QUERY_TERMS))


def study_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, source, lang): documents, some about the study's subject."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr(study_text_sql()).alias("text"), F.expr(STUDY_TYPE_SQL).alias("source"), "lang")
