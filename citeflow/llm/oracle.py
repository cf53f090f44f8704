"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {}

ORACLE["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, w[p : p + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
docwins AS (
  SELECT doc_id, n, p, w[p : p + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, p, item_id FROM docwins JOIN wins USING (win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
        FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

ORACLE["op7_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM t WINDOW g AS (PARTITION BY low)
"""

ORACLE["op3_line_dedup"] = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, trim(lines[i], chr(32) || chr(9) || chr(13)) AS line
      FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
f AS (SELECT doc_id, pos, line, row_number() OVER w AS s, lead(line) OVER w AS after, lead(pos) OVER w AS after_pos
      FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, after_pos, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, s) AS k FROM f WHERE after IS NOT NULL),
lone AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) AS k
         FROM f WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 5),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM r WHERE k > 1 UNION ALL SELECT doc_id, after_pos FROM r WHERE k > 1
                                           UNION ALL SELECT doc_id, pos FROM lone WHERE k > 1)),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(d.lines[l.pos + 1], chr(10) ORDER BY l.pos) AS text
         FROM l JOIN d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.pos = l.pos) GROUP BY l.doc_id)
SELECT d.doc_id, CAST((SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS BIGINT) AS n_lines,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.places, '') AS removed_lines,
       CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op2_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[p : p + 3] END AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT both_ways.y, reach.c FROM reach JOIN both_ways ON reach.node = both_ways.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM reach WHERE node = d.doc_id) AS component_id,
       (SELECT CAST(count(*) AS BIGINT) FROM both_ways WHERE x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""


def _op11() -> str:
    """Forward dynamic programme over a conversation's rows: per automaton state the least (cost, audit, messages)."""
    def least(*ways):
        return f"list_sort([{', '.join(ways)}])[1]"

    def go(way, cost, letter, line="''"):
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'm': {way}.m || {line}}}"

    user, assistant = (f"chr(10) || '{r}:'" for r in ("user", "assistant"))
    far = "{'c': 1000000, 'a': '', 'm': ''}"
    # w: ways after a row; v: with the insertions before the next
    inserted_u = least("w.u", *[go(f"w.{s}", 3, "I", user) for s in "zsa"])
    inserted = (f"list_transform([w], lambda w: {{'z': w.z, 's': w.s, 'u': {inserted_u}, 'a': w.a, 'o': w.u}})")
    inserted = (f"list_transform({inserted}, lambda w: {{'z': w.z, 's': w.s, 'u': w.u, 'a': {least('w.a', go('w.u', 3, 'I', assistant))}}})[1]")
    late, keep = "(3 * x.late)", "chr(10) || x.role || ':' || x.text"
    to_u = [go(f"v.{s}", f"3 + {late}", "R", f"{user} || x.text") for s in "zsa"]
    kept_u = [f"CASE WHEN x.i = 'u' THEN {go(f'v.{s}', late, 'K', keep)} ELSE {far} END" for s in "zsa"]
    row = f"""CASE WHEN x.gone THEN {{{', '.join(f"'{s}': {go(f'v.{s}', 4, 'D')}" for s in 'zsua')}}} ELSE {{
        'z': {go('v.z', 4, 'D')},
        's': {least(go('v.s', 4, 'D'), f"CASE WHEN x.i = 's' THEN {go('v.z', late, 'K', keep)} ELSE {far} END")},
        'u': {least(go('v.u', 4, 'D'), *to_u, *kept_u)},
        'a': {least(go('v.a', 4, 'D'), go('v.u', f'3 + {late}', 'R', f'{assistant} || x.text'),
                    f"CASE WHEN x.i = 'a' THEN {go('v.u', late, 'K', keep)} ELSE {far} END")}}} END"""
    return f"""
WITH named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295) % 20 AS harm FROM named),
harmed AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
placed AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM harmed),
judged AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    right(bare, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM placed),
listed AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (odd) AS illegal,
    list({{'gone': blank OR again, 'late': cut::INT, 'i': i, 'role': role, 'text': text}} ORDER BY place) AS xs
    FROM judged GROUP BY conv_id),
solved AS (SELECT *, list_reduce(xs, lambda w, x: list_transform([{inserted}], lambda v: {row})[1],
    {{'z': {{'c': 0, 'a': '', 'm': ''}}, 's': {far}, 'u': {far}, 'a': {far}}}) AS w FROM listed),
ended AS (SELECT *, {least("w.z", "w.a", go("w.u", 3, "I", assistant), go("(" + go("w.s", 3, "I", user) + ")", 3, "I", assistant))} AS best FROM solved)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
    coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.m, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE["op11_conversation_repair"] = _op11()
