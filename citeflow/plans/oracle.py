"""Independent DuckDB SQL for each catalogue query (the correctness oracle).

Written directly against the provided tables; column names equal the Spark
outputs. Regex notes: DuckDB's ``\\b`` is ASCII-only, so word boundaries are
spelled ``(^|[^\\p{L}\\p{N}_])…($|[^\\p{L}\\p{N}_])``.
"""

from __future__ import annotations

from . import catalog as cat
from . import tables as tb

WB_L = r"(^|[^\p{L}\p{N}_])"
WB_R = r"($|[^\p{L}\p{N}_])"


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _parse_lines(lines):
    """Plain-Python reading of the fixed dictionary for SQL generation."""
    groups = []
    for line in lines:
        name, rest = line.split(":", 1)
        alts = [a.strip() for a in rest.strip().split("|") if a.strip()]
        groups.append((name.strip(), alts))
    return groups


def _word_rx(alts) -> str:
    body = "|".join(r"\Q" + a + r"\E" for a in alts)
    return "(?i)" + WB_L + "(?:" + body + ")" + WB_R


def _q01() -> str:
    parts = [
        f"SELECT {_sq(n)} AS term, count(*) FILTER (WHERE regexp_matches(text, {_sq(_word_rx(a))})) AS papers FROM documents"
        for n, a in _parse_lines(cat.TERM_LINES)
    ]
    return "\nUNION ALL\n".join(parts)


def _q02() -> str:
    parts = [
        f"SELECT {_sq(n)} AS term, {_sq(p)} AS pattern, doc_id FROM documents "
        f"WHERE regexp_matches(text, {_sq(_word_rx([p]))})"
        for n, alts in _parse_lines(cat.TERM_LINES) for p in alts
    ]
    return "\nUNION ALL\n".join(parts)


_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _t(x: str) -> str:
    return _TRIM.format(x=x)


Q03 = f"""
WITH l AS (SELECT p_partkey AS line_no, {tb.TERM_LINE_SQL} AS value FROM part),
s AS (SELECT line_no, {_t('value')} AS line FROM l),
p AS (
  SELECT line_no, line,
         CASE WHEN strpos(line, ':') > 0 THEN {_t("substr(line, 1, strpos(line, ':') - 1)")} END AS name,
         CASE WHEN strpos(line, ':') > 0 THEN {_t("substr(line, strpos(line, ':') + 1)")} END AS rest
  FROM s),
q AS (
  SELECT *, list_filter(list_transform(string_split(rest, '|'), lambda x: {_t('x')}),
                        lambda x: x <> '') AS alts
  FROM p),
r AS (
  SELECT *, CASE WHEN line = '' THEN 'blank'
                 WHEN starts_with(line, '#') THEN 'comment'
                 WHEN strpos(line, ':') = 0 THEN 'no_colon'
                 WHEN name = '' OR rest = '' THEN 'empty_name_or_patterns'
                 WHEN len(alts) = 0 THEN 'no_patterns'
                 ELSE 'ok' END AS status
  FROM q)
SELECT line_no,
       CASE WHEN status = 'ok' THEN name END AS name,
       CASE WHEN status = 'ok' THEN array_to_string(alts, '|') END AS patterns,
       CASE WHEN status = 'ok' THEN CAST(len(alts) AS BIGINT) END AS n_patterns,
       status
FROM r
"""


def _ranking_ctes(max_seeds: int | None = None) -> str:
    used = "SELECT * FROM seeds"
    if max_seeds:
        used = f"SELECT * FROM seeds ORDER BY ord LIMIT {max_seeds}"
    r = cat.STANDIN_RANK
    return f"""
WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
fwd AS (
  SELECT a.l_partkey AS seed_id, b.l_partkey AS cand_id
  FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
edges AS (
  SELECT DISTINCT seed_id, cand_id
  FROM (SELECT seed_id, cand_id FROM fwd UNION ALL SELECT cand_id, seed_id FROM fwd)
  WHERE seed_id <> cand_id),
seeds AS (SELECT p_partkey AS seed_id, p_partkey AS ord FROM part WHERE p_partkey % {tb.SEED_MOD} = {tb.SEED_REM}),
excl AS (SELECT p_partkey AS pmid FROM part WHERE p_partkey % {tb.EXCL_MOD} = 0),
used AS ({used}),
e AS (
  SELECT e.seed_id, e.cand_id, u.ord
  FROM edges e JOIN used u ON e.seed_id = u.seed_id
  WHERE e.cand_id >= {r.min_id}
    AND e.cand_id NOT IN (SELECT seed_id FROM seeds)
    AND e.cand_id NOT IN (SELECT pmid FROM excl)),
scores AS (
  SELECT cand_id AS pmid, count(*) AS score,
         string_agg(CAST(seed_id AS VARCHAR), ',' ORDER BY ord, seed_id) AS seeds
  FROM e GROUP BY cand_id),
meta AS (
  SELECT doc_id AS pmid, text AS title, '' AS abstract, source AS pubtypes
  FROM documents WHERE doc_id % {tb.NO_META_MOD} <> 0),
c AS (
  SELECT s.*, m.pmid IS NOT NULL AS has_meta,
         lower(coalesce(m.title, '') || ' ' || coalesce(m.abstract, '')) AS content,
         lower(coalesce(m.pubtypes, '')) AS pt
  FROM scores s LEFT JOIN meta m ON s.pmid = m.pmid),
k AS (SELECT *, has_meta AND regexp_matches(content, '(?i){r.comparative}') AS comparative FROM c),
classified AS (
  SELECT pmid, score, seeds, comparative,
         CASE WHEN NOT has_meta THEN 'kept_no_metadata'
              WHEN regexp_matches(content, '(?i){r.assembly}') AND NOT comparative THEN 'assembly'
              WHEN pt <> '' AND regexp_matches(pt, '(?i){r.pubtype}') THEN 'pubtype'
              WHEN regexp_matches(content, '(?i){r.negative}') THEN 'negative'
              WHEN NOT regexp_matches(content, '(?i){r.positive}') THEN 'no_positive'
              ELSE 'kept' END AS reason
  FROM k),
sv AS (SELECT * FROM classified WHERE reason IN ('kept', 'kept_no_metadata')),
st AS (SELECT min(pmid) AS mn, max(pmid) AS mx, max(score) AS ms, count(*) AS n,
              greatest(2, max(score) // 10) AS rec FROM sv)
"""


def _q01e() -> str:
    """Matches inside words: a substring test on the lower-cased text."""
    parts = []
    for n, alts in _parse_lines(cat.TERM_LINES):
        tests = " OR ".join(f"contains(t, {_sq(a.lower())})" for a in alts)
        parts.append(f"SELECT {_sq(n)} AS term, count(*) FILTER (WHERE {tests}) AS papers FROM low")
    return "WITH low AS (SELECT lower(text) AS t FROM documents)\n" + "\nUNION ALL\n".join(parts)


# Words are compared as maximal word runs; the phrase of an item as three runs with one blank between.
_Q01D = """
WITH b AS (SELECT 'item ' || CAST(item_id AS VARCHAR) AS term, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM benchmark),
d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS runs FROM documents),
words AS (SELECT DISTINCT term, unnest(w) AS x FROM b),
one AS (SELECT DISTINCT term, doc_id FROM (SELECT doc_id, unnest(list_distinct(runs)) AS x FROM d) JOIN words USING (x)),
three AS (SELECT term, doc_id FROM b JOIN d ON contains(t, array_to_string(w[1:3], ' '))
          WHERE regexp_matches(t, '(^|[^\\p{L}\\p{N}\\p{M}_])' || array_to_string(w[1:3], ' ') || '($|[^\\p{L}\\p{N}\\p{M}_])')),
hits AS (SELECT * FROM one UNION SELECT * FROM three)
SELECT b.term, count(hits.doc_id) AS papers FROM b LEFT JOIN hits USING (term) GROUP BY b.term
"""

_R = cat.STANDIN_RANK

ORACLE = {
    "q01d_large_dictionary": _Q01D,
    "q01e_inside_words": _q01e(),
    "q01_term_hits": _q01(),
    "q01b_term_hits_token_join": _q01(),
    "q02_term_matches": _q02(),
    "q03_parse_terms": Q03,
    "q04_candidate_scores": _ranking_ctes() + "SELECT pmid, score, seeds FROM scores",
    "q04b_limited_seeds": _ranking_ctes(25) + "SELECT pmid, score, seeds FROM scores",
    "q04c_candidate_edges": _ranking_ctes() + "SELECT cand_id AS pmid, seed_id, CAST(ord AS INTEGER) AS ord FROM e",
    "q06b_repeated_records": _ranking_ctes() + "SELECT pmid, CAST(1 AS BIGINT) AS rows FROM scores",
    "q05_reject_reasons": _ranking_ctes()
    + "SELECT reason, count(*) AS candidates FROM classified GROUP BY reason",
    "q06_filtered_candidates": _ranking_ctes() + "SELECT pmid, score, comparative, reason FROM sv",
    "q07_ranked_candidates": _ranking_ctes() + f"""
SELECT row_number() OVER (ORDER BY wf DESC, score DESC, pmid) AS rank,
       pmid, score, round(wf, 6) AS weighted, seeds
FROM (
  SELECT *, CASE WHEN comparative THEN w * {_R.boost}e0 ELSE w END AS wf
  FROM (
    SELECT sv.*, CASE WHEN st.mx = st.mn THEN CAST(score AS DOUBLE)
                      ELSE score * (1.0e0 - {_R.beta}e0 * power(CAST(st.mx - pmid AS DOUBLE) / (st.mx - st.mn), {_R.gamma}e0))
                 END AS w
    FROM sv, st))
ORDER BY rank""",
    "q08_score_histogram": _ranking_ctes()
    + "SELECT score, count(*) AS candidates FROM sv GROUP BY score ORDER BY score DESC",
    "q09_threshold_lists": _ranking_ctes() + """,
thr AS (SELECT DISTINCT CAST(t AS BIGINT) AS t
        FROM (SELECT unnest([2, 3, 5, 10, rec]) AS t, ms FROM st) WHERE t <= ms)
SELECT thr.t AS threshold, sv.pmid FROM sv JOIN thr ON sv.score >= thr.t""",
    "q10_threshold_counts": _ranking_ctes() + """,
thr AS (SELECT DISTINCT CAST(t AS BIGINT) AS t
        FROM (SELECT unnest([2, 3, 5, 10, rec]) AS t, ms FROM st) WHERE t <= ms)
SELECT thr.t AS threshold, count(*) AS candidates FROM sv JOIN thr ON sv.score >= thr.t GROUP BY thr.t""",
    "q11_confidence_tiers": _ranking_ctes() + """
SELECT CAST(st.rec AS BIGINT) AS recommended,
       count(*) FILTER (WHERE score >= st.rec) AS high,
       count(*) FILTER (WHERE score >= 3 AND score < st.rec) AS medium,
       count(*) FILTER (WHERE score < 3) AS low
FROM sv, st GROUP BY st.rec""",
    "q12_run_summary": _ranking_ctes() + """
SELECT n AS candidates, mn AS min_id, mx AS max_id, ms AS max_score, CAST(rec AS BIGINT) AS recommended FROM st""",
    "q12b_corpus_size": "SELECT count(*) AS documents FROM documents",
}


_XWALK = """
WITH ids AS (
  SELECT split_part(replace(CAST(c_custkey AS VARCHAR) || chr(9) || c_name || chr(13), chr(13), ''),
                    chr(9), 1) AS id
  FROM customer),
ans AS (
  SELECT CAST(o_custkey AS VARCHAR) AS pmid, CAST(o_orderkey AS VARCHAR) AS pmcid,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT ids.id AS pmid, a.pmcid FROM ids LEFT JOIN ans a ON ids.id = a.pmid AND a.rn = 1)
"""

_LAND = f"""
WITH f AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmcid,
         CASE WHEN doc_id % {tb.EMPTY_DOC_MOD} = 0 THEN '' ELSE text END AS content
  FROM documents),
l AS (
  SELECT f.pmcid, strlen(f.content) AS n_bytes
  FROM labels JOIN f ON CAST(labels.doc_id AS VARCHAR) = f.pmcid),
present AS (SELECT DISTINCT pmcid FROM l WHERE n_bytes > 0),
s AS (
  SELECT f.pmcid, f.content, strlen(f.content) AS n_bytes,
         CASE WHEN p.pmcid IS NOT NULL THEN 'skipped'
              WHEN strpos(f.content, 'license') > 0 THEN 'restricted'
              WHEN strlen(f.content) > 0 THEN 'ok'
              ELSE 'failed' END AS status,
         CASE WHEN strpos(f.content, 'license') > 0 THEN 'restricted'
              WHEN strlen(f.content) > 0 THEN 'ok'
              ELSE 'failed' END AS fresh_status
  FROM f LEFT JOIN present p ON f.pmcid = p.pmcid)
"""

ORACLE.update({
    "q13_article_metadata": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, source, lang FROM documents)
SELECT doc_id AS pmid,
       CASE WHEN doc_id % 10 = 0 THEN '{tb.CORRECTED}' ELSE '' END || ls[1]
         || CASE WHEN doc_id % 13 = 0 THEN '{tb.SIGNS}' ELSE '' END AS title,
       array_to_string(ls[2:], ' ') AS abstract,
       source || ';' || lang AS pubtypes,
       CAST(len(ls) - 1 AS BIGINT) AS n_sections
FROM d""",
    "q14_id_crosswalk": _XWALK + "SELECT pmid, pmcid, 'PMC' || pmcid AS pmc_ref FROM x WHERE pmcid IS NOT NULL",
    "q14b_crosswalk_coverage": _XWALK + "SELECT count(*) AS processed, count(pmcid) AS mapped FROM x",
    "q15_unmapped_ids": _XWALK + "SELECT pmid FROM x WHERE pmcid IS NULL",
    "q16_landing_status": _LAND + """
SELECT coalesce(outcome, 'total') AS outcome, detail, count(*) AS n
FROM (SELECT CASE WHEN status = 'restricted' THEN 'failed' ELSE status END AS outcome,
             status AS detail FROM s)
GROUP BY ROLLUP (outcome, detail)""",
    "q17_pending": _LAND + "SELECT DISTINCT pmcid FROM f WHERE pmcid NOT IN (SELECT pmcid FROM present)",
    "q17s_stream_landing": _LAND + "SELECT pmcid, fresh_status AS status, n_bytes, md5(content) AS content_md5 FROM s",
    "q17t_stream_repairs": f"""
SELECT CAST(doc_id AS VARCHAR) AS pmcid, CASE WHEN strlen(text) > 0 THEN 'ok' ELSE 'failed' END AS status,
       strlen(c) AS n_bytes, md5(c) AS content_md5
FROM (SELECT doc_id, text, CASE WHEN doc_id % {tb.EMPTY_DOC_MOD} = 0 OR contains(text, 'license')
                                THEN replace(text, 'license', 'licence') ELSE text END AS c FROM documents)""",
})


# --- conversion (q18-q21, q24) -------------------------------------------------
# Written over the pieces between "<" signs, not with the operator's patterns: each piece is one
# tag name and the text after it; pieces inside script, style and nav are left out by a running depth.

_PAGES = f"""
WITH src AS (
  SELECT page_id, {tb.PAGE_PATH_SQL} AS path, {tb.PAGE_CONTENT_SQL} AS content FROM pages),
cut AS (
  SELECT page_id, content, starts_with(content, '<article xmlns') AS jats, string_split(content, '<') AS parts FROM src),
piece AS (
  SELECT page_id, jats, i, parts[i] AS p, strpos(parts[i], '>') AS gt
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut)),
tag AS (
  SELECT *, CASE WHEN i > 1 AND gt > 0 THEN lower(regexp_extract(p, '^/?[A-Za-z0-9-]+|^!--')) ELSE '' END AS name,
         CASE WHEN i = 1 THEN p WHEN gt = 0 THEN '<' || p ELSE substr(p, gt + 1) END AS txt
  FROM piece),
deep AS (
  SELECT *, sum(CASE WHEN name IN ('script', 'style', 'nav') THEN 1 WHEN name IN ('/script', '/style', '/nav') THEN -1 ELSE 0 END)
              OVER (PARTITION BY page_id ORDER BY i) AS depth
  FROM tag),
shown AS (
  SELECT page_id, i,
         CASE WHEN jats AND name = 'article-title' THEN chr(10) || '# ' WHEN jats AND name = 'title' THEN chr(10) || '## '
              WHEN name = 'h1' THEN chr(10) || '# '
              WHEN name IN ('br', 'p', '/p', '/h1', 'li', '/li', '/div', '/tr', '/title', 'dt', '/dd', 'sec', '/sec', '/article-title')
              THEN chr(10)
              WHEN name IN ('td', '/td', '/dt', 'dd') THEN ' ' ELSE '' END || txt AS s
  FROM deep WHERE depth = 0),
raw AS (SELECT page_id, string_agg(s, '' ORDER BY i) AS r FROM shown GROUP BY page_id),
dec AS (
  SELECT page_id, r, replace(replace(replace(replace(replace(replace(
           r, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t
  FROM raw),
p AS (
  SELECT page_id, path, content, strlen(content) AS src_bytes, r,
         coalesce(array_to_string(list_filter(list_transform(string_split(replace(t, chr(9), ' '), chr(10)),
           lambda x: trim(array_to_string(list_filter(string_split(x, ' '), lambda y: y <> ''), ' '))), lambda x: x <> ''), chr(10)), '') AS t
  FROM src LEFT JOIN dec USING (page_id))
"""

_KNOWN = "replace(replace(replace(replace(replace(replace(r, '&lt;', ''), '&gt;', ''), '&quot;', ''), '&#39;', ''), '&nbsp;', ''), '&amp;', '')"
_STATUS = f"""CASE WHEN content IS NULL THEN 'failed' WHEN t = '' THEN 'empty'
            WHEN contains(r, '<') OR contains(r, '>') OR regexp_matches({_KNOWN}, '&[A-Za-z#0-9]+;') THEN 'ok_with_warnings' ELSE 'ok' END"""

_BIB = r"(?i)^\s*(#+\s*)?(References|Reference|Bibliography|Literature Cited)\b"


def _m(word: str) -> str:
    return f"regexp_matches(text, {_sq(_word_rx([word]))})"


def _trunc(word: str) -> str:
    return f"regexp_matches(text, {_sq('(?i)' + WB_L + chr(92) + 'Q' + word + chr(92) + 'E')})"


_BOOLEAN = (f"({_m('the')} OR {_m('und')} OR {_m('que')}) AND ({_trunc('tion')} OR {_m('ation')} OR {_trunc('enti')})"
            f" AND NOT lower(lang) = 'de' AND NOT lower(lang) = 'fr'"
            f" AND NOT ({_m('license')} OR lower(source) = 'src3' OR lower(source) = 'src7')")
_KEYWORD = f"{_m('the')} AND {_m('and')} AND {_m('of')} AND NOT lower(source) = 'src3'"

ORACLE.update({
    "q18_format_sniff": f"""
WITH s AS (
  SELECT url AS path, html AS content FROM pages
  UNION ALL
  SELECT 'PMC' || CAST(doc_id AS VARCHAR) || '.xml' AS path, {tb.SNIFF_DOC_SQL} AS content FROM documents)
SELECT path,
       CASE WHEN regexp_matches(array_to_string(string_split(content, chr(10))[1:5], chr(10)),
                                'pmc-articleset|jats|article xmlns') THEN 'jats' ELSE 'html' END AS format
FROM s""",
    "q19_markup_to_text": _PAGES + f"SELECT page_id, t AS text, {_STATUS} AS status FROM p",
    "q20_conversion_qa": _PAGES + f""",
r AS (
  SELECT *, CASE WHEN starts_with(path, '{tb.RAW_ROOT}/') THEN substr(path, {len(tb.RAW_ROOT) + 2}) END AS rel,
         regexp_extract(path, '[^/]*$', 0) AS base,
         length(t) - length(replace(t, chr(10), '')) AS n_lines,
         CASE WHEN src_bytes > 0 THEN strlen(t) * 100 // src_bytes END AS ratio
  FROM p)
SELECT page_id,
       '{tb.MD_ROOT}/' || CASE WHEN rel IS NULL THEN '.' WHEN strpos(rel, '/') > 0
                          THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END
       || '/' || regexp_replace(base, '\\.[^.]*$', '') || '.md' AS out_path,
       CAST(strlen(t) AS BIGINT) AS out_bytes, CAST(ratio AS BIGINT) AS ratio, ratio < 10 AS small_output,
       CAST(n_lines AS BIGINT) AS lines,
       CASE WHEN n_lines < 50 THEN 'warn' WHEN n_lines < 100 THEN 'info' ELSE 'ok' END AS line_class
FROM r""",
    "q21_truncate_bibliography": f"""
WITH d AS (SELECT doc_id, {tb.SPLICE_SQL} AS t FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, {_sq(_BIB)})), true) AS pos FROM l),
b AS (SELECT doc_id, t, CASE WHEN pos IS NULL OR pos = 0 THEN t WHEN pos = 1 THEN ''
                             ELSE array_to_string(ls[1:pos - 1], chr(10)) END AS body FROM p)
SELECT doc_id, body, body <> t AS cut FROM b""",
    "q22_boolean_search": f"SELECT doc_id FROM documents WHERE {_BOOLEAN}",
    "q23_keyword_ids": f"SELECT doc_id FROM documents WHERE {_KEYWORD} ORDER BY doc_id LIMIT {cat.KEYWORD_LIMIT}",
    "q23b_keyword_hit_count": f"SELECT count(*) AS hits FROM documents WHERE {_KEYWORD}",
    "q24_rendition_fallback": f"""
WITH r AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'xml' END AS fmt,
         CASE WHEN page_id % {tb.BLANK_PRIMARY_MOD} = 0 THEN '' ELSE html END AS prim,
         '<html><body>' || url || '</body></html>' AS std
  FROM pages),
c AS (SELECT *, CASE WHEN fmt = 'html' THEN coalesce(nullif(prim, ''), nullif(std, ''))
                     ELSE nullif(prim, '') END AS chosen FROM r)
SELECT page_id, fmt AS format, 'PMC' || CAST(page_id AS VARCHAR) || '.' || fmt AS out_name,
       CASE WHEN nullif(prim, '') IS NOT NULL THEN 'full'
            WHEN fmt = 'html' AND nullif(std, '') IS NOT NULL THEN 'standard' ELSE 'none' END AS rendition,
       CAST(coalesce(strlen(chosen), 0) AS BIGINT) AS n_bytes, chosen IS NOT NULL AS success
FROM c""",
})


# --- extraction (q25-q29) ------------------------------------------------------

_RANGE = r"^\D*?(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)"


def _raw(list_sep: str) -> str:
    cols = []
    for c, e in tb.EXTRACTION_SQL:
        if list_sep != "; ":
            e = f"replace({e}, '; ', '{list_sep}')"
        cols.append(f"nullif(trim({e}), '') AS {c}")
    return ", ".join(cols)


def _yn(c):
    return f"CASE lower({c}) WHEN 'yes' THEN true WHEN 'no' THEN false END"


def _lst(c):
    parts = f"list_filter(regexp_split_to_array({c}, '\\s*[;,]\\s*'), lambda y: y <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} END"


_FLAGS = ("sweeps", "sel_coef", "pooled", "soft_sweeps", "balancing", "purifying",
          "go_enrichment", "polygenic")
_LISTS = ("authors", "sweep_methods", "soft_sweep_tools", "go_terms", "genes",
          "sweep_genes", "polygenic_traits")


def _typed_select(has_ids: bool) -> str:
    out = []
    for c, _ in tb.EXTRACTION_SQL:
        if c in ("pmid", "pmcid") and not has_ids:
            out.append(f"NULL AS {c}")
        elif c in _FLAGS:
            out.append(f"{_yn(c)} AS {c}")
        elif c in _LISTS:
            out.append(f"{_lst(c)} AS {c}")
        elif c == "year":
            out.append("TRY_CAST(year AS INTEGER) AS year")
        elif c == "pmid":
            out.append("TRY_CAST(pmid AS BIGINT) AS pmid")
        elif c == "samples":
            out.append("samples, TRY_CAST(regexp_extract(samples, '^\\s*(\\d+)', 1) AS INTEGER) AS samples_n")
        else:
            out.append(c)
    return ", ".join(out)


_EXTRACT = f"""
WITH v25 AS (
  SELECT {_raw('; ')} FROM documents d JOIN labels l USING (doc_id)),
v23 AS (
  SELECT {_raw(', ')}
  FROM (SELECT d.*, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic
        FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels))),
t25 AS (SELECT {_typed_select(True)} FROM v25),
t23 AS (SELECT {_typed_select(False)} FROM v23),
u AS (SELECT * FROM t25 UNION ALL SELECT * FROM t23)
"""


def _bounds(v):
    single = f"TRY_CAST(regexp_extract({v}, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)"
    lo = (f"CASE WHEN regexp_matches({v}, '{_RANGE}') THEN TRY_CAST(regexp_extract({v}, '{_RANGE}', 1) AS DOUBLE)"
          f" ELSE {single} END")
    hi = (f"CASE WHEN regexp_matches({v}, '{_RANGE}') THEN TRY_CAST(regexp_extract({v}, '{_RANGE}', 2) AS DOUBLE)"
          f" ELSE {single} END")
    return lo, hi


_LO, _HI = _bounds("sel_coef_value")
# The quantities from the columns they are written from, not from the text.
_QLO = """CASE l_linenumber % 7 WHEN 0 THEN round(l_discount, 2) WHEN 1 THEN round(l_discount, 2) WHEN 2 THEN round(l_discount, 2)
  WHEN 3 THEN floor(l_quantity) / 10000 WHEN 4 THEN floor(l_quantity) * 1000 + 24 WHEN 5 THEN -(10 + floor(l_quantity)) / 100
  ELSE floor(l_quantity) END"""
_QHI = f"CASE WHEN l_linenumber % 7 < 3 THEN round(l_tax, 2) ELSE {_QLO} END"

ORACLE.update({
    "q25_extraction_typed": _EXTRACT + f"""
SELECT pmid, year, array_to_string(authors, '|') AS authors, sweeps,
       array_to_string(sweep_methods, '|') AS sweep_methods, sel_coef,
       {_LO} AS coef_lo, {_HI} AS coef_hi, pooled, soft_sweeps,
       array_to_string(genes, '|') AS genes, CAST(len(genes) AS BIGINT) AS n_genes,
       samples_n, polygenic, array_to_string(polygenic_traits, '|') AS polygenic_traits
FROM t25""",
    "q26_category_frequency": _EXTRACT + "SELECT category, count(*) FILTER (WHERE flag) AS yes, "
    "count(flag) AS answered, round(count(*) FILTER (WHERE flag) / count(flag), 6) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS category, {f} AS flag FROM u" for f in _FLAGS)
    + ") GROUP BY category",
    "q27_entity_frequency": """
SELECT entity, count(*) AS papers
FROM (SELECT DISTINCT p_partkey, entity
      FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS entity FROM part)
      WHERE entity <> '')
GROUP BY entity""",
    "q27b_gene_frequency": _EXTRACT + """
SELECT entity, count(*) AS papers FROM (SELECT DISTINCT doi, unnest(genes) AS entity FROM u) WHERE entity <> '' GROUP BY entity""",
    "q28_quantity_ranges": f"""
WITH v AS (SELECT l_returnflag, CASE WHEN l_linenumber % 7 < 3 THEN 'range' ELSE 'count' END AS kind,
             {_QLO} AS lo, {_QHI} AS hi FROM lineitem)
SELECT l_returnflag, kind, count(*) AS n, min(lo) AS min_lo, max(hi) AS max_hi,
       round(avg(lo), 6) AS avg_lo, round(avg(hi), 6) AS avg_hi
FROM v GROUP BY l_returnflag, kind""",
    "q29_extraction_union": _EXTRACT + """
SELECT doi, pmid, pmcid, year, sweeps, pooled, polygenic, CAST(len(genes) AS BIGINT) AS n_genes,
       samples_n, array_to_string(sweep_methods, '|') AS sweep_methods
FROM u""",
    "q30_related_items": f"""
WITH dt AS (
  SELECT doc_id, tok, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS tok FROM documents)
  WHERE tok <> '' GROUP BY doc_id, tok),
n AS (SELECT count(DISTINCT doc_id) AS n FROM dt),
idf AS (SELECT tok, ln((SELECT n FROM n) / count(*)) AS idf FROM dt GROUP BY tok),
idf2 AS (SELECT * FROM idf WHERE idf > 0),
dw AS (SELECT doc_id, tok, tf * idf AS w FROM dt JOIN idf2 USING (tok)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id),
st AS (
  SELECT item_id, tok, count(*) AS tf
  FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS tok FROM benchmark)
  WHERE tok <> '' GROUP BY item_id, tok),
sw AS (SELECT item_id, tok, tf * idf AS ws FROM st JOIN idf2 USING (tok)),
sn AS (SELECT item_id, sqrt(sum(ws * ws)) AS sn FROM sw GROUP BY item_id),
dot AS (SELECT item_id, doc_id, sum(w * ws) AS dot FROM dw JOIN sw USING (tok) GROUP BY item_id, doc_id),
sim AS (SELECT item_id, doc_id, round(dot / (dn * sn), 6) AS sim
        FROM dot JOIN dn USING (doc_id) JOIN sn USING (item_id))
SELECT item_id, rank, doc_id, sim
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM sim)
WHERE rank <= {cat.RELATED_K}""",
})


ORACLE["q30b_vector_neighbours"] = f"""
WITH e AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
         generate_subscripts(embedding, 1) - 1 AS dim
  FROM embeddings),
cent AS (SELECT label AS centroid, dim, avg(x) AS c FROM e GROUP BY label, dim),
cn AS (SELECT centroid, sqrt(sum(c * c)) AS cn FROM cent GROUP BY centroid),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vn FROM e GROUP BY vec_id),
dot AS (SELECT e.vec_id, cent.centroid, sum(e.x * cent.c) AS dot FROM e JOIN cent ON e.dim = cent.dim
        GROUP BY e.vec_id, cent.centroid),
sim AS (SELECT centroid, vec_id, round(dot / (vn * cn), 6) AS sim
        FROM dot JOIN vn USING (vec_id) JOIN cn USING (centroid))
SELECT centroid, rank, vec_id, sim
FROM (SELECT *, row_number() OVER (PARTITION BY centroid ORDER BY sim DESC, vec_id) AS rank FROM sim)
WHERE rank <= {cat.RELATED_K}"""


def _phrase_sql(t: str) -> str:
    if t.endswith("*"):
        return _trunc(t[:-1])
    return _m(t)


_STUDY = f"WITH s AS (SELECT doc_id, {tb.study_text_sql()} AS text, {tb.STUDY_TYPE_SQL} AS source, lang FROM documents) "


def _study_sql() -> str:
    from ..operators import search as se
    parts = [f"lower(source) = {_sq(se.REQUIRED_PT)}"]
    for group in (se.PLANT_TERMS, se.RESEQUENCING_TERMS, se.SELECTION_TERMS):
        parts.append("(" + " OR ".join(_phrase_sql(t) for t in group) + ")")
    for m in se.EXCLUDED_MESH:
        parts.append(f"NOT lower(lang) = {_sq(m.lower())}")
    excl = [_phrase_sql(t) for t in se.EXCLUDED_TIAB] + [f"lower(source) = {_sq(p)}" for p in se.EXCLUDED_PT]
    parts.append("NOT (" + " OR ".join(excl) + ")")
    return _STUDY + "SELECT doc_id FROM s WHERE " + " AND ".join(parts)


def _study_keyword_sql() -> str:
    from .. import config as c
    words = [w for t in c.SEARCH_QUERY_TERMS for w in t.split()]
    cond = " AND ".join(_m(w) for w in words)
    return (f"{_STUDY} SELECT doc_id FROM s WHERE {cond} "
            f"AND NOT lower(source) = {_sq(c.SEARCH_QUERY_EXCLUDED_PUBTYPE)}")


ORACLE["q22b_study_query"] = _study_sql()
ORACLE["q23c_study_keyword_ids"] = _study_keyword_sql()


def _q01c() -> str:
    from .. import config as c
    rule = "=" * c.REPORT_RULE_WIDTH
    dash = "-" * c.REPORT_RULE_WIDTH
    nw, cw = c.REPORT_NAME_WIDTH, c.REPORT_COUNT_WIDTH
    return f"""
WITH hits AS ({_q01()}),
n AS (SELECT count(*) AS n FROM documents)
SELECT 0 AS line_no, '' AS line
UNION ALL SELECT 1, {_sq(c.REPORT_TITLE)}
UNION ALL SELECT 2, '{rule}'
UNION ALL SELECT 3, {_sq(c.REPORT_TOTAL_LABEL)} || CAST(n AS VARCHAR) FROM n
UNION ALL SELECT 4, '{rule}'
UNION ALL SELECT 5, ''
UNION ALL SELECT 6, printf('%-{nw}s | %{cw}s', {_sq(c.REPORT_NAME_HEADER)}, {_sq(c.REPORT_COUNT_HEADER)})
UNION ALL SELECT 7, '{dash}'
UNION ALL SELECT CAST(7 + row_number() OVER (ORDER BY papers DESC, term) AS INTEGER),
                 printf('%-{nw}s | %{cw}d', term, papers) FROM hits
UNION ALL SELECT CAST(8 + count(*) AS INTEGER), '' FROM hits"""


ORACLE["q01c_term_report"] = _q01c()


# --- files written and read back ------------------------------------------------

_RANKED = _ranking_ctes() + f""",
w AS (SELECT pmid, score, seeds, CASE WHEN comparative THEN w * {_R.boost}e0 ELSE w END AS wf
  FROM (SELECT sv.*, CASE WHEN st.mx = st.mn THEN CAST(score AS DOUBLE)
                      ELSE score * (1.0e0 - {_R.beta}e0 * power(CAST(st.mx - pmid AS DOUBLE) / (st.mx - st.mn), {_R.gamma}e0))
                 END AS w FROM sv, st))
"""
ORACLE.update({
    "q31_ranked_file": _RANKED + "SELECT pmid AS PMID, score AS Score, printf('%.6f', wf) AS WeightedScore, seeds AS Seeds FROM w",
    "q31b_ranked_ids": _RANKED + "SELECT CAST(pmid AS VARCHAR) AS id FROM w",
    "q32_threshold_files": ORACLE["q09_threshold_lists"],
    "q33_crosswalk_file": _XWALK + "SELECT pmid, pmcid FROM x WHERE pmcid IS NOT NULL",
    "q34_article_files": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, source, lang, unnest(CASE WHEN doc_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS batch
           FROM documents)
SELECT doc_id AS pmid, CASE WHEN batch = 1 THEN '{tb.CORRECTED}' ELSE '' END || ls[1]
         || CASE WHEN doc_id % 13 = 0 THEN '{tb.SIGNS}' ELSE '' END AS title,
       array_to_string(ls[2:], ' ') AS abstract, source || ';' || lang AS pubtypes, CAST(len(ls) - 1 AS BIGINT) AS n_sections
FROM d""",
    "q35_edge_files": "SELECT l_suppkey AS seed_id, l_partkey AS cand_id FROM lineitem WHERE l_linenumber % 6 NOT IN (3, 4)",
    "q36_landed_files": _LAND + "SELECT pmcid, status, n_bytes, md5(content) AS content_md5 FROM s",
    "q37_converted_files": "SELECT out_path, count(*) AS sources, CAST(sum(out_bytes) AS BIGINT) AS n_bytes FROM ("
    + ORACLE["q20_conversion_qa"] + ") GROUP BY out_path",
    "q38_extraction_file": _EXTRACT + "SELECT doi, pmid, year, sweeps, pooled, samples_n, CAST(len(genes) AS BIGINT) AS n_genes FROM t25",
})

_NAMED = """
WITH d AS (SELECT doc_id, text, CAST(floor(doc_id / 10) AS BIGINT) % 7 AS dir, CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS stem,
  CASE WHEN doc_id % 10 = 1 THEN '.html' WHEN doc_id % 3 = 0 THEN '.HTM' ELSE '.xml' END AS ext FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, text, dir || '/doc.' || stem || ext AS path, dir || '/doc.' || stem || '.md' AS out_path FROM d)
"""
_READ = f"""strlen(text) + CASE WHEN doc_id % {tb.BROKEN_MOD} = 0 THEN 1 ELSE 0 END AS src_bytes,
  CASE WHEN doc_id % {tb.BROKEN_MOD} = 0 THEN 'repaired' ELSE 'ok' END AS status,
  md5(text || CASE WHEN doc_id % {tb.BROKEN_MOD} = 0 THEN chr(65533) ELSE '' END) AS content_md5 FROM n WHERE doc_id % {tb.MISSING_MOD} <> 0"""
ORACLE.update({
    "q33b_kept_mapping": f"""
WITH ids AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey FROM customer),
early AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS pmcid FROM orders
          WHERE o_orderstatus = 'F' AND year(o_orderdate) < {tb.LATE_YEAR} GROUP BY o_custkey),
late AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS pmcid FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT id AS pmid, CASE WHEN c_custkey % 3 <> 0 AND early.pmcid IS NOT NULL THEN CAST(early.pmcid AS VARCHAR)
                        ELSE 'late ' || CAST(late.pmcid AS VARCHAR) END AS pmcid
FROM ids LEFT JOIN early ON early.o_custkey = c_custkey JOIN late ON late.o_custkey = c_custkey""",
    "q39_document_files": _NAMED + """
SELECT out_path, count(*) AS sources, strlen(arg_max(text, path)) AS src_bytes, 'ok' AS status, md5(arg_max(text, path)) AS text_md5
FROM n GROUP BY out_path""",
    "q40_raw_files": _NAMED + f"""
SELECT 'list' AS via, path, {_READ}
UNION ALL SELECT 'folder', path, {_READ}
UNION ALL SELECT 'source', path, {_READ}
UNION ALL SELECT 'list', path, NULL, 'missing', NULL FROM n WHERE doc_id % {tb.MISSING_MOD} = 0""",
    "q41_curated_ids": f"""SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS nth FROM part
WHERE p_partkey % {tb.SEED_MOD} = {tb.SEED_REM}""",
    "q42_edge_rejects": "SELECT count(*) FILTER (l_linenumber % 6 = 4) AS rejected, count(*) AS lines FROM lineitem",
    "q43_first_lines": "SELECT doc_id, replace(split_part(text, chr(10), 1), chr(13), '') AS line FROM documents",
    # a text file ends with a line break, so a blank line follows the last one
    "q44_dictionary_file": f"""SELECT CAST(row_number() OVER (ORDER BY line_no) AS INTEGER) AS line_no, name, patterns, status FROM ({Q03})
UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), NULL, NULL, 'blank' FROM part""",
})
ORACLE.update({"q22c_study_query_indexed": ORACLE["q22b_study_query"], "q23d_study_keyword_indexed": ORACLE["q23c_study_keyword_ids"]})

# by the pieces the documents are made of, not by their tags
ORACLE["q19b_strict_outcome"] = """
SELECT doc_id, CASE WHEN doc_id % 8 < 2 THEN 'jats' ELSE 'html' END AS format,
  CASE doc_id % 8 WHEN 0 THEN 'strict' WHEN 4 THEN 'strict' WHEN 6 THEN 'empty' WHEN 7 THEN 'failed' ELSE 'lenient' END AS outcome,
  CASE doc_id % 8 WHEN 1 THEN 'crossed:sec' WHEN 2 THEN 'crossed:b' WHEN 3 THEN 'stray:div' WHEN 5 THEN 'crossed:body' END AS fault
FROM documents"""
ORACLE["q17b_pending_bucketed"] = ORACLE["q17_pending"]
