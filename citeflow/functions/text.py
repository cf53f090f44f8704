"""Scalar column functions (C1-C4, C15-C23, K1). All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .patterns import quote


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace (Spark's
    ``trim`` only removes the space character)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def clean_id(col) -> Column:
    """Trim, strip CR and double quotes, digits only → BIGINT (else NULL)."""
    x = py_strip(F.regexp_replace(_c(col).cast("string"), "\r", ""))
    x = F.regexp_replace(x, '^"+|"+$', "")
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))


def first_field(col, sep: str = "\t") -> Column:
    """Text before the first separator."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def first_line(col) -> Column:
    """First line of a multi-line answer, CR removed."""
    return F.regexp_replace(F.split_part(_c(col), F.lit("\n"), F.lit(1)), "\r", "")


def parse_id_lines(df: DataFrame, col: str = "value", header_lines: int = 0,
                   line_no: str | None = None) -> DataFrame:
    """A3 on a line DataFrame: skip ``header_lines`` by ``line_no`` (if given),
    strip CR, keep the first tab field, drop empties → (id STRING)."""
    if header_lines and line_no:
        df = df.where(F.col(line_no) > header_lines)
    v = first_field(F.regexp_replace(F.col(col), "\r", ""))
    return df.select(v.alias("id")).where(F.col("id") != "")


def pmc_ref(col, prefix: str = cfg.PMC_PREFIX) -> Column:
    """C20: catalogue prefix on an id."""
    return F.concat(F.lit(prefix), _c(col))


def first_nonempty(*cols) -> Column:
    """First rendition that is non-empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


#: Text shaped like a tag; a lone ``<`` or ``>`` of the text itself is none.
TAG = r"</?[A-Za-z][^<>]*>"


def strip_tags(col) -> Column:
    """Remove inline markup from an element's text, and nothing else."""
    return F.regexp_replace(_c(col), TAG, "")


# --- path algebra (C15) -------------------------------------------------------

def relative_dir(path, root: str) -> Column:
    """Directory of ``path`` relative to ``root``; ``.`` when outside ``root`` or at its top."""
    p = _c(path)
    prefix = root.rstrip("/") + "/"
    rel = F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30))
    return (F.when(rel.isNull(), F.lit("."))
            .when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", ""))
            .otherwise(F.lit(".")))


def basename(path) -> Column:
    return F.regexp_extract(_c(path), "[^/]*$", 0)


def strip_extension(name) -> Column:
    """Remove the last ``.ext`` (shell ``${name%.*}``)."""
    return F.regexp_replace(_c(name), r"\.[^.]*$", "")


def output_path(path, root: str, out_root: str, suffix: str = ".md") -> Column:
    """out_root/relative_dir/stem + suffix."""
    return F.concat_ws("/", F.lit(out_root.rstrip("/")), relative_dir(path, root),
                       F.concat(strip_extension(basename(path)), F.lit(suffix)))


# --- conversion QA (C16-C19) --------------------------------------------------

def sniff_format(col, markers=cfg.SNIFF_MARKERS, lines: int = cfg.SNIFF_LINES) -> Column:
    """``jats`` if the first ``lines`` lines contain any marker (case-sensitive)."""
    head = F.substring_index(_c(col), "\n", lines)
    rx = "|".join(quote(m) for m in markers)
    return F.when(head.rlike(rx), F.lit("jats")).otherwise(F.lit("html"))


def newline_count(col) -> Column:
    """``wc -l``: number of newline characters."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def line_class(col, few: int = cfg.FEW_LINES, some: int = cfg.SOME_LINES) -> Column:
    """Warn (< few lines), info (< some lines), ok."""
    n = newline_count(col)
    return F.when(n < few, "warn").when(n < some, "info").otherwise("ok")


def size_ratio(out_col, src_bytes) -> Column:
    """C17: integer percentage out/src; NULL when the source size is 0."""
    src = _c(src_bytes)
    out = F.octet_length(_c(out_col)).cast("bigint")
    return F.when(src > 0, F.call_function("div", out * 100, src.cast("bigint")))


def bibliography_regex(headings=cfg.BIBLIOGRAPHY_HEADINGS) -> str:
    """Everything from the first line that starts (after blanks and optional ``#`` marks) with a
    heading word, with the line break before it, to the end of the text.

    ``[^\\S\\n]`` keeps the leading blanks on the same line.
    """
    words = "|".join(quote(h) for h in headings)
    return rf"(?iUu)(?:\A|\n)[^\S\n]*(?:#+[^\S\n]*)?(?:{words})\b(?s:.*)\z"


def truncate_bibliography(col, headings=cfg.BIBLIOGRAPHY_HEADINGS) -> Column:
    """Cut the text at the first bibliography heading line.

    Heading on line 1 → empty text; no heading → unchanged. One regex replacement,
    so no positions are counted (characters outside the BMP are safe).
    """
    return F.regexp_replace(_c(col), bibliography_regex(headings), "")


# --- markup → text (K1) -------------------------------------------------------

# FIXED VALUES: dropped element types and the entity table of the converter.
DROPPED_ELEMENTS = ("script", "style", "nav")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&"))
BREAK_TAGS = r"(?i)<(br|p|/p|/h[1-6]|li|/li|/div|/tr|/title|dt|/dd|sec|/sec|/article-title|/abstract)\b[^>]*>"
CELL_TAGS = r"(?i)<(/td|/th|/dt|td|th|dd)\b[^>]*>"
# FIXED VALUES: heading elements of the article format and their levels.
JATS_HEADINGS = (("article-title", 1), ("title", 2))


def _without_markup(col, fmt=None) -> Column:
    """Markup turned into line breaks, ``#`` headings and blanks; entities still as written."""
    t = F.regexp_replace(_c(col), r"(?s)<!--.*?-->", "")
    for tag in DROPPED_ELEMENTS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    if fmt is not None:
        for tag, level in JATS_HEADINGS:
            t = F.when(fmt == "jats", F.regexp_replace(t, rf"(?i)<{tag}\b[^>]*>", "\n" + "#" * level + " ")).otherwise(t)
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, BREAK_TAGS, "\n")
    t = F.regexp_replace(t, CELL_TAGS, " ")
    return F.regexp_replace(t, r"</?[A-Za-z!?][^<>]*>", "")


def markup_to_text(col, fmt=None) -> Column:
    """K1: HTML/JATS markup → plain text with ``#`` headings, as a native chain.

    ``fmt`` (C16: jats | html) selects the headings of the article format."""
    t = _without_markup(col, fmt)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{2,}", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def conversion_status(src, out, fmt=None) -> Column:
    """K1 status: failed (no input), empty (no text), ok_with_warnings (markup or entities that the
    chain does not know, so a strict pass would fail), ok. Judged before entities are decoded:
    an encoded ``&lt;`` is text, not left-over markup."""
    s, o = _c(src), _c(out)
    known = "|".join(e.strip("&;") for e, _ in ENTITIES)
    return (F.when(s.isNull(), "failed")
            .when(o == "", "empty")
            .when(_without_markup(s, fmt).rlike(rf"[<>]|&(?!(?:{known});)[A-Za-z#0-9]+;"), "ok_with_warnings")
            .otherwise("ok"))


# --- the strict pass (K1) -----------------------------------------------------

# FIXED VALUES: elements without an end tag, and elements whose end tag HTML lets one leave out.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPTIONAL_END = ("body", "colgroup", "dd", "dt", "head", "html", "li", "optgroup", "option", "p", "tbody", "td", "tfoot", "th", "thead", "tr")
_TAGS = r"<(/?[A-Za-z][^\s<>/]*(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"


def markup_fault(col, fmt) -> Column:
    """First fault of the tags of a text as a stack sees them, null when they are well-formed.

    ``unclosed:x`` (x still open at the end), ``stray:x`` (an end without a start), ``crossed:x`` (x ends while another
    element is open inside it). In html, elements without an end tag are no elements of the stack and optional ends may
    be missing; the article format asks for every end. Comments, CDATA and what script and style hold are no tags."""
    html = _c(fmt) == "html"
    bare = F.regexp_replace(_c(col), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    bare = F.when(html, F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")).otherwise(bare)
    tags = F.transform(F.regexp_extract_all(bare, F.lit(_TAGS), 1), lambda t: F.struct(
        F.when(html, F.lower(F.regexp_extract(t, r"^/?([^\s/]+)", 1))).otherwise(F.regexp_extract(t, r"^/?([^\s/]+)", 1)).alias("name"),
        t.startswith("/").alias("end"), t.endswith("/").alias("empty")))
    tags = F.filter(tags, lambda t: ~t["empty"] & ~(html & t["name"].isin(*VOID_ELEMENTS)))

    def lax(name):
        return html & name.isin(*OPTIONAL_END)

    def step(state, t):
        stack, name = state["stack"], t["name"]
        # ends that may be left out are taken off down to the element that ends here
        at = F.size(stack) - F.array_position(F.reverse(stack), name) + 1
        above = F.slice(stack, at + 1, F.size(stack))
        known = F.array_contains(stack, name)
        closes = known & F.forall(above, lax)
        fault = (F.when(state["fault"].isNotNull(), state["fault"])
                 .when(t["end"] & ~known & ~lax(name), F.concat(F.lit("stray:"), name))
                 .when(t["end"] & known & ~closes, F.concat(F.lit("crossed:"), name)))
        after = (F.when(~t["end"], F.concat(stack, F.array(name))).when(closes, F.slice(stack, F.lit(1), at - 1)).otherwise(stack))
        return F.struct(after.alias("stack"), fault.cast("string").alias("fault"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(None).cast("string").alias("fault"))

    def last(state):
        still = F.filter(state["stack"], lambda x: ~lax(x))
        return F.coalesce(state["fault"], F.when(F.size(still) > 0, F.concat(F.lit("unclosed:"), F.element_at(still, -1))))

    return F.aggregate(tags, start, step, last)
