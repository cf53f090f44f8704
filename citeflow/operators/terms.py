"""Dictionary term search over a text corpus.

How many documents mention each term group, where a group is a set of literal
alternatives matched as whole words, case-insensitively (``TermConfig``).

A match has one definition: the regex of ``functions.patterns.literal_regex`` finds
the alternative in the text. Three plans evaluate it, and give the same rows:

* a configuration-sized dictionary is compiled into *foldable* regexes, and one
  scan of the corpus evaluates all of them;
* a larger one becomes an Aho–Corasick automaton (``operators.automaton``): its distinct alternatives, of
  measured size, are broadcast, and one scan finds all of them in each text, character by character in its case key. Where
  keys and word boundaries decide, by tables of what the regex engine says of every character, that is the match; the
  few others are decided by their regexes. Groups
  are counted in the scan, with map-side combine;
* a dictionary too large to broadcast stays a DataFrame. Every alternative has an *anchor*, a
  token its match cannot do without (a whole word run, a whole run between words,
  or, for matches inside words, a short character sequence). The documents' tokens are
  joined with the anchors, and each candidate (document, alternative) is then
  checked with the alternative's regex on the document's own text, in one pass.

Distinct documents are counted per group; groups without a hit come out with 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TermConfig
from ..functions.patterns import alternation_regex, flags, literal_regex
from ..functions.text import py_strip
from ..session import ship_package
from .automaton import EDGE, OTHER, PASS_CHARS, UNDECIDED, WORD, automata, occurrences
from .util import latest, materialize

TERM_GROUP_SCHEMA = "line_no int, name string, patterns array<string>"


def parse_terms(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """A2/C3/C4/D10: "Name: alt1|alt2" lines → (line_no, name, patterns, status).

    ``status`` is ``ok`` or the reason a line is skipped: ``blank``, ``comment``,
    ``no_colon``, ``empty_name_or_patterns``, ``no_patterns``. Rejected lines
    stay in the output as an audit trail.
    """
    line = py_strip(F.col(value))
    parts = F.split(line, ":", 2)
    name = py_strip(parts.getItem(0))
    rest = py_strip(parts.getItem(1))
    alts = F.filter(F.transform(F.split(rest, r"\|"), lambda x: py_strip(x)), lambda x: x != "")
    status = (
        F.when(line == "", "blank")
        .when(line.startswith("#"), "comment")
        .when(~line.contains(":"), "no_colon")
        .when((name == "") | (rest == ""), "empty_name_or_patterns")
        .when(F.size(alts) == 0, "no_patterns")
        .otherwise("ok")
    )
    ok = status == "ok"
    return lines.select(
        F.col(line_no).alias("line_no"),
        F.when(ok, name).alias("name"),
        F.when(ok, alts).alias("patterns"),
        status.alias("status"),
    )


def term_groups(parsed: DataFrame, cfg: TermConfig = TermConfig()):
    """Accepted groups as a driver list [(name, [patterns])] in line order.

    For dictionaries meant for the driver (a configuration file); a large one is
    given to the operators below as a DataFrame and never comes here.
    Duplicate names raise unless ``cfg.last_wins`` (then the last line wins).
    """
    out: dict[str, list] = {}
    for r in parsed.where(F.col("status") == "ok").select("line_no", "name", "patterns").orderBy("line_no").toLocalIterator():
        if r["name"] in out and not cfg.last_wins:
            raise ValueError(f"duplicate term group name: {r['name']!r}")
        out.pop(r["name"], None)
        out[r["name"]] = list(r["patterns"])
    return list(out.items())


def dictionary_alternatives(parsed: DataFrame, cfg: TermConfig = TermConfig()) -> DataFrame:
    """(term, alt): one row per accepted alternative, computed in Spark.

    Duplicate group names raise unless ``cfg.last_wins`` (then the group on the
    last line wins) — the check is a bounded probe, not a collect."""
    ok = parsed.where(F.col("status") == "ok").select("line_no", "name", "patterns")
    dup = ok.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if dup.limit(1).count():
        if not cfg.last_wins:
            raise ValueError("duplicate term group names in dictionary")
        ok = latest(ok, "name", "line_no")
    return ok.select(F.col("name").alias("term"), F.explode("patterns").alias("alt"))


# Non-ASCII characters that java.util.regex with (?iu) treats as equal to an
# ASCII letter (their upper or lower case is ASCII): dotted capital I,
# dotless small i, long s, Kelvin sign. FIXED VALUES.
ASCII_CASE_TWINS = ("\u0130\u0131\u017f\u212a", "iisk")
_ELIGIBLE = re.compile(r"^[\x20-\x7e]+$")


def folded(text_col):
    """Lower-cased text with the ASCII case twins mapped to ASCII: if a
    case-insensitive regex matches an ASCII literal somewhere, this string
    contains the lower-cased literal."""
    return F.lower(F.translate(text_col, *ASCII_CASE_TWINS))


def _prefilter(fold, alternatives, cfg: TermConfig):
    """Cheap necessary condition for a group (substring search on the folded
    text), so the Unicode regex only runs on documents that can match. None
    when an alternative is not a printable-ASCII literal (no safe filter)."""
    if cfg.regex or cfg.normalize_ws or not cfg.case_insensitive:
        return None
    if not all(_ELIGIBLE.match(a) for a in alternatives):
        return None
    cond = None
    for a in alternatives:
        c = fold.contains(a.lower())
        cond = c if cond is None else (cond | c)
    return cond


def _guarded(fold, text_col, alternatives, cfg: TermConfig, single: bool = False):
    rx = (literal_regex(alternatives[0], cfg.case_insensitive, cfg.whole_word, cfg.regex,
                        cfg.normalize_ws) if single else
          alternation_regex(alternatives, cfg.case_insensitive, cfg.whole_word, cfg.regex,
                            cfg.normalize_ws))
    pre = _prefilter(fold, alternatives, cfg)
    m = text_col.rlike(rx)
    return m if pre is None else (pre & m)


def _as_alternatives(spark, groups) -> DataFrame:
    return spark.createDataFrame([(n, a) for n, pats in groups for a in pats], "term string, alt string")


def _plan(corpus: DataFrame, groups, cfg: TermConfig):
    """(driver list, None) for the compiled plan, (None, alternatives) for the token plan.

    Only the plan depends on the size: both give the same rows. Regex alternatives
    have no anchor and are always compiled.
    """
    if isinstance(groups, DataFrame):
        alts = dictionary_alternatives(groups, cfg)
        if cfg.regex or alts.limit(cfg.max_regex_alternatives + 1).count() <= cfg.max_regex_alternatives:
            return term_groups(groups, cfg), None
        return None, alts
    if cfg.regex or sum(len(p) for _, p in groups) <= cfg.max_regex_alternatives:
        return groups, None
    return None, _as_alternatives(corpus.sparkSession, groups)


def term_hits(corpus: DataFrame, groups, text: str = "text", key: str = "doc_id",
              cfg: TermConfig = TermConfig()) -> DataFrame:
    """q01: (term, papers) — distinct documents per group, zero-hit groups kept.

    ``groups`` is a driver list [(name, [alternatives])] or the parsed
    dictionary DataFrame of ``parse_terms``.
    """
    spark = corpus.sparkSession
    listed, alts = _plan(corpus, groups, cfg)
    if listed is not None:
        src = corpus.select(F.col(key).alias("_k"), F.col(text).alias("_t"), folded(F.col(text)).alias("_f"))
        tests = [F.when(_guarded(F.col("_f"), F.col("_t"), pats, cfg), F.lit(name)) for name, pats in listed if pats]
        found = F.filter(F.array(*tests).cast("array<string>"), lambda x: x.isNotNull())
        pairs = src.select("_k", F.explode(found).alias("term"))
        names = spark.createDataFrame([(n,) for n, _ in listed], "term string")
    else:
        names = alts.select("term").distinct()
        dictionary = _broadcastable(alts, cfg)
        if dictionary is not None:
            return names.join(_automaton_counts(corpus, *dictionary, text, key, cfg), "term", "left").select(
                "term", F.coalesce("papers", F.lit(0)).cast("bigint").alias("papers"))
        pairs = _token_matches(corpus, alts, text, key, cfg).select(F.col(key).alias("_k"), "term")
    counts = pairs.distinct().groupBy("term").agg(F.count("*").alias("papers"))
    return names.join(counts, "term", "left").select(
        "term", F.coalesce("papers", F.lit(0)).cast("bigint").alias("papers"))


def term_matches(corpus: DataFrame, groups, text: str = "text", key: str = "doc_id",
                 cfg: TermConfig = TermConfig()) -> DataFrame:
    """q02 / B7: one row per (term, pattern, document) that matches, single scan."""
    listed, alts = _plan(corpus, groups, cfg)
    if listed is None:
        dictionary = _broadcastable(alts, cfg)
        found = (_token_matches(corpus, alts, text, key, cfg) if dictionary is None
                 else _automaton_matches(corpus, *dictionary, text, key, cfg))
        return found.select("term", F.col("alt").alias("pattern"), key).distinct()
    src = corpus.select(key, F.col(text).alias("_t"), folded(F.col(text)).alias("_f"))
    cands = [
        F.when(_guarded(F.col("_f"), F.col("_t"), [p], cfg, single=True),
               F.struct(F.lit(name).alias("term"), F.lit(p).alias("pattern")))
        for name, pats in listed for p in pats
    ]
    hit_type = T.ArrayType(T.StructType([T.StructField("term", T.StringType()),
                                         T.StructField("pattern", T.StringType())]))
    hits = F.filter(F.array(*cands).cast(hit_type), lambda x: x.isNotNull())
    return (src.select(key, F.explode(hits).alias("h")).select("h.term", "h.pattern", key).distinct())


def match_listing(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The listing in print order: term, pattern, then document ascending."""
    return matches.orderBy("term", "pattern", key)


# --- automaton plan -----------------------------------------------------------

def _regex(alt, cfg: TermConfig):
    """The regex of an alternative, as a column."""
    quoted = F.transform(F.split(alt, " ") if cfg.normalize_ws else F.array(alt), lambda x: F.concat(
        F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    edge = "\\b" if cfg.whole_word else ""
    return F.concat(F.lit(flags(cfg.case_insensitive) + edge + "(?:"), F.array_join(quoted, "\\s+"), F.lit(")" + edge))


def _one_blank(col, cfg: TermConfig):
    """Every run of white space as one blank where a blank matches any."""
    return F.regexp_replace(col, "(?U)\\s+", " ") if cfg.normalize_ws else col


_CHARACTERS: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}


def characters(spark, cfg: TermConfig = TermConfig()) -> tuple[np.ndarray, np.ndarray]:
    """(case key, kind) of every code point, as Spark and its regex engine have them: a table of fixed size, made once.

    A key is one character, also where the full case mapping has more ("ß" is not "ss" for the regex).
    Marks are undecided: whether they belong to a word depends on what they stand on."""
    name = spark.sparkContext.applicationId, cfg.case_insensitive
    if name not in _CHARACTERS:
        keys, kinds = np.arange(EDGE + 1, dtype=np.uint32), np.zeros(EDGE + 1, dtype=np.uint8)
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = (F.when(char.rlike("\\p{Mn}"), UNDECIDED)
                .when(char.rlike(flags(cfg.case_insensitive) + "\\b"), WORD).otherwise(OTHER).alias("kind"))
        key = case_key(F.col("c"), cfg)
        low = F.lower("c") if cfg.case_insensitive else F.col("c")
        key = F.when(F.length(key) == 1, key).when(F.length(low) == 1, low).otherwise(F.col("c"))
        rows = (spark.range(EDGE).where("id < 55296 or id > 57343").select("id", char.alias("c"), kind)
                .select("id", "kind", "c", key.alias("key")).where("kind <> 0 or key <> c").select("id", "kind", "key").toArrow())
        at = rows["id"].to_numpy()
        kinds[at] = rows["kind"].to_numpy()
        keys[at] = [ord(k) for k in rows["key"].to_pylist()]
        _CHARACTERS[name] = keys, kinds
    return _CHARACTERS[name]


#: Literals of these characters need no regex: beyond, case pairs newer than the regex engine's tables occur.
_OLD_LETTERS = "^[\\x{0}-\\x{2bff}\\x{3000}-\\x{9fff}]*$"


def _broadcastable(alts: DataFrame, cfg: TermConfig):
    """((id, alt, key, exact) rows, (term, id, alt, regex) table) of a dictionary whose measured size allows a
    broadcast, else None. ``exact``: where the key stands, the alternative does, whatever the characters."""
    distinct = alts.select("alt").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("alt")), F.lit(0)).alias("chars"),
                        F.min(F.length("alt")).alias("least")).first()
    if size["chars"] > cfg.automaton_chars or not size["least"]:
        return None
    key = _one_blank(case_key(F.col("alt"), cfg), cfg)
    exact = (F.length(case_key(F.col("alt"), cfg)) == F.length("alt")) & key.rlike(_OLD_LETTERS)
    if cfg.normalize_ws:
        exact &= (key == F.btrim(key)) & (F.regexp_replace("alt", "(?U)\\s+", " ") == F.col("alt"))
    rows = distinct.select("alt", _one_blank(F.col("alt"), cfg).alias("plain"), exact.alias("exact")).orderBy("alt").collect()
    keys, _ = characters(alts.sparkSession, cfg)
    listed = [(i, r["alt"], "".join(chr(keys[ord(c)]) for c in r["plain"]), r["exact"]) for i, r in enumerate(rows)]
    numbered = alts.sparkSession.createDataFrame([(i, a) for i, a, _, _ in listed], "id int, alt string")
    table = alts.join(F.broadcast(numbered), "alt").select("term", "id", "alt", _regex(F.col("alt"), cfg).alias("regex"))
    return listed, materialize(table.distinct())


def _scanned(corpus: DataFrame, listed, text: str, key: str, cfg: TermConfig, named: list[list[int]] | None = None) -> DataFrame:
    """(_k, _t, sure, open): the ids of alternatives that match for sure, and of those the regex has to decide. With
    ``named``, the numbers of each alternative's terms, ``sure`` has the distinct terms of the former instead."""
    ship_package(corpus.sparkSession)
    literals = sorted({k for _, _, k, _ in listed})
    place = {k: i for i, k in enumerate(literals)}
    of: list[list[tuple[int, bool]]] = [[] for _ in literals]
    for i, _, k, exact in listed:
        of[place[k]].append((i, exact))
    machines = corpus.sparkSession.sparkContext.broadcast((automata(literals), of, named, characters(corpus.sparkSession, cfg)))
    whole = cfg.whole_word

    @F.arrow_udf("struct<sure:array<int>,open:array<int>>")
    def scan(column: pa.Array) -> pa.Array:
        found, owners, terms, (keys, kinds) = machines.value
        sure = [[] for _ in range(len(column))]
        unsure = [[] for _ in range(len(column))]
        at = 0
        while at < len(column):
            texts, size = [], 0
            while at + len(texts) < len(column) and (not texts or size < PASS_CHARS):
                texts.append(column[at + len(texts)].as_py() or "")
                size += len(texts[-1])
            for t, literal, decided in zip(*(x.tolist() for x in occurrences(found, texts, whole, keys, kinds)), strict=True):
                for i, exact in owners[literal]:
                    (sure if decided and exact else unsure)[at + t].append(i)
            at += len(texts)
        if terms is not None:
            sure = [sorted({t for i in row for t in terms[i]}) for row in sure]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(sure, kind), pa.array(unsure, kind)], names=["sure", "open"])

    t = F.col(text)
    return (corpus.select(F.col(key).alias("_k"), t.alias("_t"), scan(_one_blank(t, cfg)).alias("_m"))
            .select("_k", F.when(F.size("_m.open") > 0, F.col("_t")).alias("_t"), F.col("_m.sure").alias("sure"), F.col("_m.open").alias("open")))


def _automaton_matches(corpus: DataFrame, listed, table: DataFrame, text: str, key: str, cfg: TermConfig) -> DataFrame:
    """(term, alt, key) of every match, a pair of one row and alternative once."""
    hits = materialize(_scanned(corpus, listed, text, key, cfg))
    small = F.broadcast(table)  # of measured size
    sure = hits.select("_k", F.explode("sure").alias("id")).join(small, "id").select("term", "alt", F.col("_k").alias(key))
    rest = (hits.select("_k", "_t", F.explode("open").alias("id")).join(small, "id").where(F.regexp_like("_t", F.col("regex")))
            .select("term", "alt", F.col("_k").alias(key)))
    return sure.unionByName(rest)


def _automaton_counts(corpus: DataFrame, listed, table: DataFrame, text: str, key: str, cfg: TermConfig) -> DataFrame:
    """(term, papers). Where keys are unique, rows whose matches are all sure are counted as they
    are, each of their terms once; pairs of other rows are made distinct first."""
    terms = table.select("term").distinct().withColumn("t", F.row_number().over(Window.orderBy("term")))  # a broadcast's size
    of_alt = {r["id"]: r["ts"] for r in table.join(terms, "term").groupBy("id").agg(F.collect_set("t").alias("ts")).collect()}
    hits = materialize(_scanned(corpus, listed, text, key, cfg, [of_alt.get(i, []) for i in range(len(listed))]))
    unique = corpus.groupBy(key).count().where("count > 1").isEmpty()
    alone = hits.where((F.size("open") == 0) & F.lit(unique))
    others = hits.where(~((F.size("open") == 0) & F.lit(unique)))
    counted = alone.select(F.explode("sure").alias("t")).groupBy("t").agg(F.count("*").alias("papers"))
    rest = (others.select("_k", "_t", F.explode("open").alias("id")).join(F.broadcast(table), "id")
            .where(F.regexp_like("_t", F.col("regex"))).join(F.broadcast(terms), "term").select("_k", "t"))
    pairs = others.select("_k", F.explode("sure").alias("t")).unionByName(rest).distinct()
    total = counted.unionByName(pairs.groupBy("t").agg(F.count("*").alias("papers"))).groupBy("t").agg(F.sum("papers").alias("papers"))
    return total.join(F.broadcast(terms), "t").select("term", "papers")


# --- token plan for larger dictionaries ---------------------------------------

#: Characters of an anchor that may stand inside a word.
GRAM = 3


def case_key(col, cfg: TermConfig):
    """Text for anchor lookup: characters that the regex flags treat as equal become
    equal: upper, then lower case, with the characters whose full case mapping differs
    from the one-to-one mapping mapped by hand. The capital sigma is lowered between the two
    (its lower case depends on the place in the word; it also keeps the optimizer from
    folding lower(upper(x)) into lower(x), which is not the same)."""
    if not cfg.case_insensitive:
        return col
    upper = F.upper(F.translate(col, "\u0130\u1e9e", "i\u00df"))
    return F.lower(F.translate(upper, "\u03a3", "\u03c3"))


def _longest(pieces):
    """First longest string of an array (null when it is empty)."""
    return F.array_max(F.transform(pieces, lambda x, i: F.struct(
        F.length(x).alias("n"), (-i).alias("at"), x.alias("x"))))["x"]


def _anchors(alts: DataFrame, cfg: TermConfig) -> DataFrame:
    """(term, alt, regex, kind, anchor). Kind 0: a maximal run of word characters;
    1: a maximal run of others; 2 to 2 + GRAM - 1: one to GRAM characters anywhere."""
    a = alts.select("term", "alt", case_key(F.col("alt"), cfg).alias("_f"))
    words = _longest(F.regexp_extract_all("_f", F.lit(r"(?U)(\w+)"), 1))
    solid = _longest(F.split("_f", " ")) if cfg.normalize_ws else F.col("_f")
    gram = F.substring(solid, 1, GRAM)
    gram_kind = F.least(F.length(solid), F.lit(GRAM)) + 1
    if cfg.whole_word:
        # every run inside a whole-word match is a whole run of the text
        gap = F.lit(cfg.normalize_ws) & F.col("_f").contains(" ")
        kind = F.when(words.isNotNull(), 0).when(~gap, 1).otherwise(gram_kind)
        anchor = F.when(words.isNotNull(), words).when(~gap, F.col("_f")).otherwise(gram)
    else:
        kind, anchor = gram_kind, gram
    return a.select("term", "alt", _regex(F.col("alt"), cfg).alias("regex"), kind.cast("int").alias("kind"), anchor.alias("anchor"))


def _tokens(low, kind: int):
    """Distinct anchors of one kind in a document (``low`` its case key, ``_c`` the characters)."""
    if kind < 2:
        found = F.regexp_extract_all(low, F.lit(r"(?U)(\w+)" if kind == 0 else r"(?U)(\W+)"), 1)
    else:
        n = kind - 1
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_c") - n, F.lit(0))),
                            lambda i: F.concat_ws("", *[F.get("_c", i + j) for j in range(n)]))
    return F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("anchor")))


def _token_matches(corpus: DataFrame, alts: DataFrame, text: str, key: str, cfg: TermConfig) -> DataFrame:
    """E5 for dictionaries too large to compile: (term, alt, key) of every match.

    Tokens are distinct per document before the join; candidates are gathered per
    document (at most the alternatives its own tokens can anchor) and meet its text again
    in one join, where their regexes decide.
    """
    anchors = _anchors(alts, cfg)
    low = case_key(F.col("_t"), cfg)
    kinds = sorted(r["kind"] for r in anchors.select("kind").distinct().collect())  # at most GRAM + 2
    tokens = [_tokens(low, k) for k in kinds]
    docs = corpus.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("_h"))
    per_doc = docs.withColumn("_c", F.split(low, "")) if any(k >= 2 for k in kinds) else docs
    toks = per_doc.select("_k", "_h", F.explode(F.concat(*tokens) if tokens else F.array().cast(
        "array<struct<kind:int,anchor:string>>")).alias("_x")).select("_k", "_h", "_x.kind", "_x.anchor")
    cand = (toks.join(anchors, ["kind", "anchor"])
            .groupBy(F.col("_k").alias("c_k"), F.col("_h").alias("c_h")).agg(F.collect_set(F.struct("term", "alt", "regex")).alias("_a")))
    met = docs.join(cand, F.col("_k").eqNullSafe(F.col("c_k")) & (F.col("_h") == F.col("c_h")))
    sure = F.filter("_a", lambda x: F.regexp_like(F.col("_t"), x["regex"]))
    return met.select(F.col("_k").alias(key), F.explode(sure).alias("_m")).select("_m.term", "_m.alt", key)


def ranked_hits(hits: DataFrame) -> DataFrame:
    """H3: count descending, name ascending (binary collation = Python order)."""
    return hits.orderBy(F.desc("papers"), F.asc("term"))
