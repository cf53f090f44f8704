"""Query catalogue: each entry is ``(spark, sf_dir) -> DataFrame`` over the
provided tables. Keys match ``plans/oracle.py``; output columns are aliased to
the same names as the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as cfgmod
from ..config import RankConfig, TermConfig
from ..functions import text as tx
from ..functions.patterns import Phrase, Tag, all_of, any_of
from ..functions.text import first_nonempty, parse_id_lines
from ..operators import convert as cv
from ..operators import crosswalk as xw
from ..operators import extraction as ex
from ..operators import landing as ld
from ..operators import phrases as ph
from ..operators import related as rel
from ..operators import search as se
from ..operators import similarity as sm
from ..operators import terms as tm
from ..operators.util import global_rank, latest, materialize, spread
from ..session import shared_dir
from ..sources import readers as rd
from ..sources.files import listed_documents, read_documents, write_documents
from ..sources.readers import ARTICLE_SCHEMA, flatten_article
from ..sources.sinks import (output_name_for_format, report_lines, write_converted, write_crosswalk, write_landed,
                             write_ranked, write_threshold_lists)
from ..streaming import landing_stream as ls
from . import tables as tb

# FIXED VALUES: the test dictionary (term groups with a zero-hit group and an
# accented term), followed by the shipped dictionary.
TEST_TERM_LINES = (
    "articles: the|und",
    "que: que|para que",
    "e acute: é",
    "license: license| MIT License",
    "absent word: zyzzyvaqx",
)
TERM_LINES = TEST_TERM_LINES + cfgmod.SHIPPED_TERM_LINES

# FIXED VALUES: content-filter patterns re-aimed at the stand-in text.
STANDIN_RANK = RankConfig(
    min_id=tb.STANDIN_MIN_ID,
    comparative="tion",
    assembly="que",
    pubtype="src1",
    negative="license",
    positive="the",
    distinct_edges=True,
)


def _docs(spark, sf_dir):
    # Whole-text regex work follows every use: spread it over the cores.
    return spread(tb.table(spark, sf_dir, "documents"))


def _groups(spark: SparkSession, lines=TERM_LINES, cfg: TermConfig = TermConfig()):
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, value string")
    return tm.term_groups(tm.parse_terms(df), cfg)


# --- S5 term search ----------------------------------------------------------

def q01_term_hits(spark, sf_dir):
    return tm.term_hits(_docs(spark, sf_dir), _groups(spark))


def q01b_term_hits_token_join(spark, sf_dir):
    """q01 through the plan for dictionaries beyond any broadcast: the parsed dictionary stays a
    DataFrame and its anchors are joined with the documents' tokens."""
    lines = spark.createDataFrame(list(enumerate(TERM_LINES, 1)), "line_no int, value string")
    return tm.term_hits(_docs(spark, sf_dir), tm.parse_terms(lines),
                        cfg=TermConfig(max_regex_alternatives=0, automaton_chars=0))


def q01c_term_report(spark, sf_dir):
    """The fixed-width report (header with the number of documents searched,
    then one padded line per group, count descending, name ascending)."""
    docs = _docs(spark, sf_dir)
    total = docs.select(F.count("*")).scalar()
    return report_lines(tm.term_hits(docs, _groups(spark)), total)


def _item_dictionary(spark, sf_dir):
    """A dictionary derived from the benchmark: one group per item, its distinct
    words and its first three words as a phrase."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    b = tb.table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    alts = F.concat(F.array_distinct("w"), F.array(F.array_join(F.slice("w", 1, 3), " ")))
    return b.select((F.col("item_id") + 1).cast("int").alias("line_no"), F.concat(
        F.lit("item "), F.col("item_id").cast("string"), F.lit(": "), F.array_join(alts, "|")).alias("value"))


def q01d_large_dictionary(spark, sf_dir):
    """A dictionary of more than 500 alternatives, derived from the tables, with the default switches: the automaton."""
    return tm.term_hits(_docs(spark, sf_dir), tm.parse_terms(_item_dictionary(spark, sf_dir)))


def q01e_inside_words(spark, sf_dir):
    """q01 with matches inside words."""
    cfg = TermConfig(whole_word=False)
    return tm.term_hits(_docs(spark, sf_dir), _groups(spark, cfg=cfg), cfg=cfg)


def q02_term_matches(spark, sf_dir):
    return tm.match_listing(tm.term_matches(_docs(spark, sf_dir), _groups(spark)))


def q03_parse_terms(spark, sf_dir):
    parsed = tm.parse_terms(tb.term_lines(spark, sf_dir))
    return parsed.select(
        "line_no", "name",
        F.array_join("patterns", "|").alias("patterns"),
        F.when(F.col("status") == "ok", F.size("patterns")).cast("bigint").alias("n_patterns"),
        "status",
    )


# --- S2 related-paper ranking ------------------------------------------------

def _edges(spark, sf_dir, cfg=STANDIN_RANK):
    return rel.candidate_edges(tb.edges(spark, sf_dir), tb.seeds(spark, sf_dir), tb.exclusions(spark, sf_dir), cfg)


def _cands(spark, sf_dir, cfg=STANDIN_RANK):
    return rel.candidate_scores(tb.edges(spark, sf_dir), tb.seeds(spark, sf_dir),
                                tb.exclusions(spark, sf_dir), cfg)


def _classified(spark, sf_dir, cfg=STANDIN_RANK, edges=None):
    # Fixed-width candidates (id, score) feed both the record filter and the join: compute once.
    scores = materialize(rel.scores(edges if edges is not None else _edges(spark, sf_dir, cfg)))
    return rel.classify(scores, tb.articles(spark, sf_dir), cfg)


def _survivors(spark, sf_dir, cfg=STANDIN_RANK, edges=None):
    return rel.filtered(_classified(spark, sf_dir, cfg, edges))


def _survivors_once(spark, sf_dir, cfg=STANDIN_RANK, edges=None):
    # For outputs that read the survivors and their run scalars: compute them once.
    return materialize(_survivors(spark, sf_dir, cfg, edges))


def q04_candidate_scores(spark, sf_dir):
    return _cands(spark, sf_dir).select("pmid", "score", rel.seeds_text().alias("seeds"))


def q04b_limited_seeds(spark, sf_dir):
    cfg = RankConfig(**{**STANDIN_RANK.__dict__, "max_seeds": 25})
    return _cands(spark, sf_dir, cfg).select("pmid", "score", rel.seeds_text().alias("seeds"))


def q04c_candidate_edges(spark, sf_dir):
    """The long form: which seed found which candidate, one row per edge."""
    return _edges(spark, sf_dir).select(F.col("cand_id").alias("pmid"), "seed_id", "ord")


def q05_reject_reasons(spark, sf_dir):
    return rel.reject_reasons(_classified(spark, sf_dir))


def q06_filtered_candidates(spark, sf_dir):
    return _survivors(spark, sf_dir).select("pmid", "score", "comparative", "reason")


def q06b_repeated_records(spark, sf_dir):
    """One record per id: every record delivered twice without an order, once with a stray title."""
    a = tb.articles(spark, sf_dir)
    twice = a.unionByName(a).unionByName(a.withColumn("title", F.concat("title", F.lit(" again"))))
    c = rel.classify(materialize(rel.scores(_edges(spark, sf_dir))), twice, STANDIN_RANK)
    return c.groupBy("pmid").agg(F.count("*").alias("rows"))


def q07_ranked_candidates(spark, sf_dir):
    edges = materialize(_edges(spark, sf_dir))  # read for the scores and, for survivors, the seed lists
    ranked = global_rank(rel.ranked(_survivors_once(spark, sf_dir, edges=edges), STANDIN_RANK))
    return rel.with_seeds(ranked, edges).select(
        "rank", "pmid", "score", F.round("weighted", 6).alias("weighted"), rel.seeds_text().alias("seeds")).orderBy("rank")


def q08_score_histogram(spark, sf_dir):
    return rel.score_histogram(_survivors(spark, sf_dir))


def q09_threshold_lists(spark, sf_dir):
    return rel.threshold_lists(_survivors_once(spark, sf_dir), STANDIN_RANK)


def q10_threshold_counts(spark, sf_dir):
    return rel.threshold_counts(_survivors_once(spark, sf_dir), STANDIN_RANK)


def q11_confidence_tiers(spark, sf_dir):
    return rel.confidence_tiers(_survivors_once(spark, sf_dir), STANDIN_RANK)


def q12_run_summary(spark, sf_dir):
    return rel.run_summary(_survivors(spark, sf_dir))


def q12b_corpus_size(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))


QUERIES = {
    "q01_term_hits": q01_term_hits,
    "q01b_term_hits_token_join": q01b_term_hits_token_join,
    "q01c_term_report": q01c_term_report,
    "q01d_large_dictionary": q01d_large_dictionary,
    "q01e_inside_words": q01e_inside_words,
    "q02_term_matches": q02_term_matches,
    "q03_parse_terms": q03_parse_terms,
    "q04_candidate_scores": q04_candidate_scores,
    "q04b_limited_seeds": q04b_limited_seeds,
    "q04c_candidate_edges": q04c_candidate_edges,
    "q05_reject_reasons": q05_reject_reasons,
    "q06_filtered_candidates": q06_filtered_candidates,
    "q06b_repeated_records": q06b_repeated_records,
    "q07_ranked_candidates": q07_ranked_candidates,
    "q08_score_histogram": q08_score_histogram,
    "q09_threshold_lists": q09_threshold_lists,
    "q10_threshold_counts": q10_threshold_counts,
    "q11_confidence_tiers": q11_confidence_tiers,
    "q12_run_summary": q12_run_summary,
    "q12b_corpus_size": q12b_corpus_size,
}


# --- S2 article records (XML) ------------------------------------------------

def q13_article_metadata(spark, sf_dir):
    # Several deliveries of one record — the last batch wins. Resolved on
    # the raw records (id and batch only), so only winning records are parsed.
    x = latest(tb.article_xml(spark, sf_dir), "pmid", "batch")
    parsed = x.select("batch", F.from_xml("xml", ARTICLE_SCHEMA).alias("r"))
    return flatten_article(parsed, "r", keep=("batch",)).select(
        "pmid", "title", "abstract", F.col("pubtypes_joined").alias("pubtypes"),
        F.col("n_sections").cast("bigint").alias("n_sections"))


# --- S3 crosswalk and landing ------------------------------------------------

def _xwalk(spark, sf_dir):
    ids = parse_id_lines(tb.id_lines(spark, sf_dir), "value")
    return xw.crosswalk(ids, tb.crosswalk_answers(spark, sf_dir))


def q14_id_crosswalk(spark, sf_dir):
    return xw.mapped(_xwalk(spark, sf_dir))


def q14b_crosswalk_coverage(spark, sf_dir):
    return xw.coverage(_xwalk(spark, sf_dir))


def q15_unmapped_ids(spark, sf_dir):
    return xw.unmapped(_xwalk(spark, sf_dir))


LAND = cfgmod.LandConfig(needle="license")


def q16_landing_status(spark, sf_dir):
    st = ld.land(tb.fetched(spark, sf_dir), tb.landed(spark, sf_dir), LAND)
    return ld.status_counts(st)


def q17_pending(spark, sf_dir):
    return ld.pending(tb.fetched(spark, sf_dir), tb.landed(spark, sf_dir))


def q17b_pending_bucketed(spark, sf_dir):
    """q17 against a landed table kept in buckets of its id: only the requested ids move."""
    kept = ld.keep_bucketed(tb.landed(spark, sf_dir), shared_dir(spark, "landed-buckets"))
    return ld.pending(tb.fetched(spark, sf_dir), kept)


def q17s_stream_landing(spark, sf_dir):
    """J1 as a stream, run twice (the second time with a fresh checkpoint, as
    after losing it): the landed table must hold each document once."""
    schema = tb.table(spark, sf_dir, "documents").schema
    # A glob path, so the file source watches matching files, not a directory.
    src = (spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
           .select(F.col("doc_id").cast("string").alias("pmcid"),
                   F.when(F.col("doc_id") % tb.EMPTY_DOC_MOD == 0, F.lit(""))
                   .otherwise(F.col("text")).alias("content")))
    target = shared_dir(spark, "landed")
    for run in (1, 2):
        ls.run(spark, src, target, shared_dir(spark, f"landing-ckpt{run}"), LAND)
    return ld.current(spark.read.schema(ls.SCHEMA).parquet(target)).select(
        "pmcid", "status", "n_bytes", F.md5("content").alias("content_md5"))


def q17t_stream_repairs(spark, sf_dir):
    """Two deliveries: the first has failed and restricted documents, the second repairs them."""
    target = shared_dir(spark, "repaired")
    docs = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmcid"), "doc_id", "text")
    first = F.when(F.col("doc_id") % tb.EMPTY_DOC_MOD == 0, F.lit("")).otherwise(F.col("text"))
    for n, content in enumerate((first, F.replace("text", F.lit("license"), F.lit("licence")))):
        src = shared_dir(spark, f"delivery{n}")
        docs.select("pmcid", content.alias("content")).write.parquet(src)
        stream = spark.readStream.schema("pmcid string, content string").parquet(src)
        ls.run(spark, stream, target, shared_dir(spark, f"repair-ckpt{n}"), LAND)
    return ld.current(spark.read.schema(ls.SCHEMA).parquet(target)).select(
        "pmcid", "status", "n_bytes", F.md5("content").alias("content_md5"))


QUERIES.update({
    "q13_article_metadata": q13_article_metadata,
    "q14_id_crosswalk": q14_id_crosswalk,
    "q14b_crosswalk_coverage": q14b_crosswalk_coverage,
    "q15_unmapped_ids": q15_unmapped_ids,
    "q16_landing_status": q16_landing_status,
    "q17_pending": q17_pending,
    "q17b_pending_bucketed": q17b_pending_bucketed,
    "q17s_stream_landing": q17s_stream_landing,
    "q17t_stream_repairs": q17t_stream_repairs,
})


# --- S4 conversion, QA, bibliography cut --------------------------------------

def q18_format_sniff(spark, sf_dir):
    return cv.sniff(spread(tb.sniff_inputs(spark, sf_dir))).select("path", "format")


def _converted(spark, sf_dir):
    return cv.convert(spread(tb.raw_pages(spark, sf_dir)))


def q19_markup_to_text(spark, sf_dir):
    return _converted(spark, sf_dir).select("page_id", "text", "status")


def q19b_strict_outcome(spark, sf_dir):
    """K1: the strict pass and the lenient one, decided by the tag stack."""
    return cv.outcome(spread(tb.marked_up(spark, sf_dir))).select("doc_id", "format", "outcome", "fault")


def q20_conversion_qa(spark, sf_dir):
    q = cv.qa(_converted(spark, sf_dir), "path", tb.RAW_ROOT, tb.MD_ROOT)
    return q.select("page_id", "out_path", F.col("out_bytes").cast("bigint").alias("out_bytes"),
                    "ratio", "small_output", F.col("lines").cast("bigint").alias("lines"), "line_class")


def q21_truncate_bibliography(spark, sf_dir):
    return cv.truncate(tb.spliced_documents(spark, sf_dir)).select("doc_id", "body", "cut")


def q24_rendition_fallback(spark, sf_dir):
    r = tb.renditions(spark, sf_dir)
    chosen = F.when(F.col("fmt") == "html", first_nonempty("primary", "standard")).otherwise(
        F.nullif(F.col("primary"), F.lit("")))
    rendition = (F.when(F.nullif(F.col("primary"), F.lit("")).isNotNull(), "full")
                 .when((F.col("fmt") == "html") & (F.nullif(F.col("standard"), F.lit("")).isNotNull()),
                       "standard")
                 .otherwise("none"))
    return r.select(
        "page_id", F.col("fmt").alias("format"),
        output_name_for_format(F.col("fmt"), F.col("page_id")).alias("out_name"),
        rendition.alias("rendition"),
        F.coalesce(F.octet_length(chosen), F.lit(0)).cast("bigint").alias("n_bytes"),
        chosen.isNotNull().alias("success"))


# --- S1 corpus search --------------------------------------------------------

def _search_fields():
    return {"tiab": [F.col("text")], "pt": [F.array(F.col("source"))], "mesh": [F.array(F.col("lang"))]}


def boolean_query():
    """Stand-in of the bibliographic query: fielded phrases, truncation, groups."""
    return (all_of(any_of(Phrase("the"), Phrase("und"), Phrase("que")),
                   any_of(Phrase("tion*"), Phrase("ation"), Phrase("enti*")))
            & ~Tag("de", "mesh") & ~Tag("fr", "mesh")
            & ~any_of(Phrase("license"), Tag("src3", "pt"), Tag("src7", "pt")))


def keyword_query():
    """Free-text AND / NOT with a publication-type field."""
    return all_of(Phrase("the"), Phrase("and"), Phrase("of")) & ~Tag("src3", "pt")


KEYWORD_LIMIT = 50


def q22_boolean_search(spark, sf_dir):
    return se.search(_docs(spark, sf_dir), boolean_query(), _search_fields())


def q22b_study_query(spark, sf_dir):
    """The original study's own boolean query, over the whole corpus."""
    return se.search(spread(tb.study_corpus(spark, sf_dir)), se.study_query(), _search_fields())


def q23c_study_keyword_ids(spark, sf_dir):
    """The original free-text search (AND of words, NOT review publications)."""
    q = se.keyword_query_from(cfgmod.SEARCH_QUERY_TERMS, cfgmod.SEARCH_QUERY_EXCLUDED_PUBTYPE)
    return se.search(spread(tb.study_corpus(spark, sf_dir)), q, _search_fields())


def _indexed(spark, sf_dir, query):
    corpus, fields = spread(tb.study_corpus(spark, sf_dir)), _search_fields()
    index = ph.build_index(corpus, {"tiab": fields["tiab"]})
    return ph.indexed_search(corpus, index, query, fields)


def q22c_study_query_indexed(spark, sf_dir):
    """q22b through the table of positions."""
    return _indexed(spark, sf_dir, se.study_query())


def q23d_study_keyword_indexed(spark, sf_dir):
    """q23c through the table of positions."""
    return _indexed(spark, sf_dir, se.keyword_query_from(cfgmod.SEARCH_QUERY_TERMS, cfgmod.SEARCH_QUERY_EXCLUDED_PUBTYPE))


def q23_keyword_ids(spark, sf_dir):
    hits = se.search(_docs(spark, sf_dir), keyword_query(), _search_fields())
    return se.first_hits(hits, KEYWORD_LIMIT)


def q23b_keyword_hit_count(spark, sf_dir):
    return se.hit_count(se.search(_docs(spark, sf_dir), keyword_query(), _search_fields()))


# --- S6 extraction tables ----------------------------------------------------

def _typed_v25(spark, sf_dir):
    raw = tb.extraction_rows(spark, sf_dir, ex.V25_RENAME, labelled=True)
    return ex.typed(ex.canonical(raw, ex.V25_RENAME))


def _typed_v23(spark, sf_dir):
    raw = tb.extraction_rows(spark, sf_dir, ex.V23_RENAME, labelled=False, list_sep=", ")
    return ex.typed(ex.canonical(raw, ex.V23_RENAME))


def _joined(c):
    return F.array_join(c, "|")


def _n(c):
    return F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")


def q25_extraction_typed(spark, sf_dir):
    t = _typed_v25(spark, sf_dir)
    lo, hi = ex.quantity_bounds(F.col("sel_coef_value"))
    return t.select(
        "pmid", "year", _joined("authors").alias("authors"), "sweeps",
        _joined("sweep_methods").alias("sweep_methods"), "sel_coef",
        lo.alias("coef_lo"), hi.alias("coef_hi"), "pooled", "soft_sweeps",
        _joined("genes").alias("genes"), _n("genes").alias("n_genes"),
        "samples_n", "polygenic", _joined("polygenic_traits").alias("polygenic_traits"))


def _union(spark, sf_dir):
    return ex.union_layouts(_typed_v25(spark, sf_dir), _typed_v23(spark, sf_dir))


def q26_category_frequency(spark, sf_dir):
    return ex.category_frequency(_union(spark, sf_dir), ex.FLAG_COLUMNS)


def q27_entity_frequency(spark, sf_dir):
    p = tb.table(spark, sf_dir, "part").select(
        "p_partkey", F.split(F.col("p_name"), " ").alias("words"))
    return ex.entity_frequency(p, "words", "p_partkey")


def q27b_gene_frequency(spark, sf_dir):
    """K5 on the typed list cells of both layouts, papers told apart by DOI. The two cells are made once,
    since typing names each of them several times."""
    layouts = ((ex.V25_RENAME, True, "; "), (ex.V23_RENAME, False, ", "))
    cells = [materialize(ex.canonical(tb.extraction_rows(spark, sf_dir, names, labelled, sep), names).select("doi", "genes"))
             for names, labelled, sep in layouts]
    return ex.entity_frequency(ex.union_layouts(*map(ex.typed, cells)), "genes", "doi")


def q28_quantity_ranges(spark, sf_dir):
    li = spread(tb.table(spark, sf_dir, "lineitem")).select(
        "l_returnflag", F.expr(tb.QUANTITY_SQL).alias("q"))
    lo, hi = ex.quantity_bounds(F.col("q"))
    kind = F.when(ex.is_range(F.col("q")), "range").otherwise("count")
    return (li.select("l_returnflag", kind.alias("kind"), lo.alias("lo"), hi.alias("hi"))
            .groupBy("l_returnflag", "kind")
            .agg(F.count("*").alias("n"), F.min("lo").alias("min_lo"), F.max("hi").alias("max_hi"),
                 F.round(F.avg("lo"), 6).alias("avg_lo"), F.round(F.avg("hi"), 6).alias("avg_hi")))


def q29_extraction_union(spark, sf_dir):
    u = _union(spark, sf_dir)
    return u.select("doi", "pmid", "pmcid", "year", "sweeps", "pooled", "polygenic",
                    _n("genes").alias("n_genes"), "samples_n",
                    _joined("sweep_methods").alias("sweep_methods"))


# --- sinks written, then read back through the sources -----------------------------

def q31_ranked_file(spark, sf_dir):
    """B1 → TSV: the ranked table as it stands in its files."""
    edges = materialize(_edges(spark, sf_dir))
    ranked = rel.ranked(_survivors_once(spark, sf_dir, edges=edges), STANDIN_RANK)
    path = shared_dir(spark, "ranked")
    write_ranked(rel.with_seeds(ranked, edges), path)
    return rd.ranked_table(spark, path)


def q31b_ranked_ids(spark, sf_dir):
    """B1 → A3: the ids of the ranked files, header skipped."""
    path = shared_dir(spark, "ranked")
    edges = materialize(_edges(spark, sf_dir))
    write_ranked(rel.with_seeds(rel.ranked(_survivors_once(spark, sf_dir, edges=edges), STANDIN_RANK), edges), path)
    return rd.id_list(spark, path, header=True)


def q32_threshold_files(spark, sf_dir):
    """B2: one id list per threshold folder, read back with its threshold."""
    path = shared_dir(spark, "thresholds")
    write_threshold_lists(rel.threshold_lists(_survivors_once(spark, sf_dir), STANDIN_RANK), path)
    return rd.threshold_lists(spark, path)


def q33_crosswalk_file(spark, sf_dir):
    """B3 → A6."""
    path = shared_dir(spark, "crosswalk")
    write_crosswalk(_xwalk(spark, sf_dir), path)
    return rd.crosswalk(spark, path)


def q33b_kept_mapping(spark, sf_dir):
    """Two deliveries of ids. The second repeats the first with other answers, which change nothing that is mapped,
    and asks for the rest; a third run, with the mapping taken as whole, asks for nothing."""
    path = shared_dir(spark, "kept-mapping")
    ids = parse_id_lines(tb.id_lines(spark, sf_dir), "value")
    answers = tb.crosswalk_answers(spark, sf_dir)
    early = answers.where(F.year("ord.o_orderdate") < tb.LATE_YEAR)
    xw.update_mapping(ids.where(F.col("id").cast("bigint") % 3 != 0), early, path)
    late = answers.withColumn("pmcid", F.concat(F.lit("late "), "pmcid"))
    xw.update_mapping(ids, late, path)
    return xw.update_mapping(ids, answers, path, whole=True)


def q34_article_files(spark, sf_dir):
    """A5: the article records as XML files; both deliveries of a record are in them."""
    path = shared_dir(spark, "articles")
    sets = (tb.article_xml(spark, sf_dir).groupBy(F.floor(F.col("pmid") / 200).alias("part"))  # 200 ids a file
            .agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list("xml"), ""), F.lit("</PubmedArticleSet>")).alias("value")))
    sets.write.partitionBy("part").text(path)
    return rd.articles_xml(spark, path).select(
        "pmid", "title", "abstract", F.col("pubtypes_joined").alias("pubtypes"), F.col("n_sections").cast("bigint").alias("n_sections"))


def q35_edge_files(spark, sf_dir):
    """Edges written as raw text ids with quotes, blanks and rejects, read back clean."""
    path = shared_dir(spark, "edges")
    tb.raw_edges(spark, sf_dir).write.parquet(path)
    return rd.edges(spark, path)


def q36_landed_files(spark, sf_dir):
    """Landed documents routed by status, read back with their content."""
    path = shared_dir(spark, "landed-files")
    write_landed(ld.land(tb.fetched(spark, sf_dir), tb.landed(spark, sf_dir), LAND, content=True), path)
    return spark.read.schema(ls.SCHEMA).parquet(path).select("pmcid", "status", "n_bytes", F.md5("content").alias("content_md5"))


def q37_converted_files(spark, sf_dir):
    """Converted text keyed by its output path, and how many sources share one."""
    path = shared_dir(spark, "converted")
    q = cv.qa(_converted(spark, sf_dir), "path", tb.RAW_ROOT, tb.MD_ROOT)
    write_converted(q.select("out_path", "text"), path)
    return (spark.read.parquet(path).groupBy("out_path")
            .agg(F.count("*").alias("sources"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes")))


def q39_document_files(spark, sf_dir):
    """B5 → A1: one file per document, named by the path algebra; of two sources of one name the last stays. Read back
    as a corpus by the text source and by the data source, which must agree."""
    path = shared_dir(spark, "document-files")
    docs = tb.named_documents(spark, sf_dir).withColumn("out_path", tx.output_path(F.col("path"), tb.RAW_ROOT, "."))
    kept = cv.one_per_path(docs)
    write_documents(kept.select(F.regexp_replace("out_path", "^(\\./)+", "").alias("out_path"), F.col("text").alias("content")), path)
    name = F.regexp_extract("path", "[^/]+/[^/]+$", 0)
    texts = rd.corpus(spark, path).select(name.alias("out_path"), F.md5("text").alias("text_md5"))
    files = read_documents(spark, path).select(name.alias("name"), "src_bytes", "status", F.md5("content").alias("content_md5"))
    sources = kept.select(F.regexp_extract("out_path", "[^/]+/[^/]+$", 0).alias("kept_path"), "sources")
    return (texts.join(files, (F.col("out_path") == F.col("name")) & (F.col("text_md5") == F.col("content_md5")))
            .join(sources, F.col("out_path") == F.col("kept_path")).select("out_path", "sources", "src_bytes", "status", "text_md5"))


def q40_raw_files(spark, sf_dir):
    """Raw documents as files, some with bytes that are no UTF-8, extensions in any case; found by
    the folder and by a list that also names files that are not there."""
    path = shared_dir(spark, "raw-files")
    docs = tb.named_documents(spark, sf_dir).withColumn("out_path", F.regexp_replace("path", f"^{tb.RAW_ROOT}/", ""))
    broken = F.when(F.col("doc_id") % tb.BROKEN_MOD == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    there = F.col("doc_id") % tb.MISSING_MOD != 0
    write_documents(docs.where(there).select("out_path", F.concat(F.encode("text", "UTF-8"), broken).alias("content")), path)
    names = docs.select(F.concat(F.lit(path + "/"), "out_path").alias("path"))
    short = F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("path")
    columns = (short, "src_bytes", "status", F.md5("content").alias("content_md5"))
    listed = listed_documents(names).select(F.lit("list").alias("via"), *columns)
    native = rd.raw_documents(spark, path).select(F.lit("folder").alias("via"), *columns)
    source = read_documents(spark, path, "xml,html,htm").select(F.lit("source").alias("via"), *columns)
    return listed.unionByName(native).unionByName(source)


def q41_curated_ids(spark, sf_dir):
    """The seeds as a curated file with a heading, remarks and blank lines, read back in their order."""
    path = shared_dir(spark, "curated")
    rows = tb.seeds(spark, sf_dir).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "seed_id"))), lambda x: F.concat(
        F.when(x["seed_id"] % 5 == 0, "# next\n\n").otherwise(""), F.lit(' "'), x["seed_id"].cast("string"), F.lit('"\r'))), "\n").alias("t"))
    rows.select(F.concat(F.lit("Heading\n"), "t").alias("value")).write.text(path)  # a curated list is one small file
    ids = rd.curated_ids(spark, path, skip=1)
    return ids.select("id", F.rank().over(Window.orderBy("ord")).cast("bigint").alias("nth"))


def q42_edge_rejects(spark, sf_dir):
    """Raw edge lines that clean to no id."""
    return rd.edge_rejects(tb.raw_edges(spark, sf_dir))


def q43_first_lines(spark, sf_dir):
    """The first line of every document, as of an answer of several lines, CR removed."""
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.first_line(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("line"))


def q44_dictionary_file(spark, sf_dir):
    """A2: the dictionary lines written as a file and read back by their line numbers, then parsed."""
    path = shared_dir(spark, "dictionary")
    lines = tb.term_lines(spark, sf_dir)
    lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("value")) \
        .write.text(path)  # a dictionary is one file
    return tm.parse_terms(rd.text_lines(spark, path)).select("line_no", "name", F.array_join("patterns", "|").alias("patterns"), "status")


def q38_extraction_file(spark, sf_dir):
    """A10: the 25-column layout written as TSV, read back and typed."""
    path = shared_dir(spark, "extraction")
    raw = tb.extraction_rows(spark, sf_dir, ex.V25_RENAME, labelled=True)
    raw = raw.select([F.replace(F.col(f"`{c}`"), F.lit("\n"), F.lit(" ")).alias(c) for c in raw.columns])  # cells are one line
    raw.write.option("sep", "\t").option("quote", '"').option("escape", '"').option("header", True).csv(path)
    t = ex.typed(ex.canonical(rd.extraction_tsv(spark, path, list(ex.V25_RENAME)), ex.V25_RENAME))
    return t.select("doi", "pmid", "year", "sweeps", "pooled", "samples_n", _n("genes").alias("n_genes"))


QUERIES.update({f.__name__: f for f in (
    q31_ranked_file, q31b_ranked_ids, q32_threshold_files, q33_crosswalk_file, q34_article_files, q35_edge_files,
    q36_landed_files, q37_converted_files, q38_extraction_file, q33b_kept_mapping, q39_document_files, q40_raw_files,
    q41_curated_ids, q42_edge_rejects, q43_first_lines, q44_dictionary_file)})


# --- K2 related-item discovery -----------------------------------------------

RELATED_K = 5


def q30_related_items(spark, sf_dir):
    return sm.related_items(tb.table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir), k=RELATED_K)


def q30b_vector_neighbours(spark, sf_dir):
    return sm.vector_neighbours(tb.table(spark, sf_dir, "embeddings"), k=RELATED_K)


QUERIES.update({
    "q30b_vector_neighbours": q30b_vector_neighbours,
    "q18_format_sniff": q18_format_sniff,
    "q19_markup_to_text": q19_markup_to_text,
    "q19b_strict_outcome": q19b_strict_outcome,
    "q20_conversion_qa": q20_conversion_qa,
    "q21_truncate_bibliography": q21_truncate_bibliography,
    "q22_boolean_search": q22_boolean_search,
    "q23_keyword_ids": q23_keyword_ids,
    "q22b_study_query": q22b_study_query,
    "q23c_study_keyword_ids": q23c_study_keyword_ids,
    "q22c_study_query_indexed": q22c_study_query_indexed,
    "q23d_study_keyword_indexed": q23d_study_keyword_indexed,
    "q23b_keyword_hit_count": q23b_keyword_hit_count,
    "q24_rendition_fallback": q24_rendition_fallback,
    "q25_extraction_typed": q25_extraction_typed,
    "q26_category_frequency": q26_category_frequency,
    "q27_entity_frequency": q27_entity_frequency,
    "q27b_gene_frequency": q27b_gene_frequency,
    "q28_quantity_ranges": q28_quantity_ranges,
    "q29_extraction_union": q29_extraction_union,
    "q30_related_items": q30_related_items,
})

QUERIES = dict(sorted(QUERIES.items()))
