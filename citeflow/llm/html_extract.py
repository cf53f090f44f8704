"""Main-text extraction with two-pass block rules.

A page is cut into blocks of running text at block-level tags. First pass: a block is bad
inside boilerplate containers (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) or when most of it is link text; good when it is long enough and dense in stop words;
all others are open. Second pass: an open block takes the label of its nearest decided
neighbours, those of its own article first. Where a page has an article with text, blocks
outside of it are bad.

Stop words of Latin-script languages are a list; for other scripts the most frequent words of up to four letters are
learned from the pages themselves. A name (class, id, role) is boilerplate when one of its words is, whatever the others say,
unless the name tells a state (``has-sidebar``). A heading straight in the article stays; one in a ``header`` goes with it. An
element whose end tag is missing hides nothing but itself, only script and style run to the end of the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, spread_tasks, text_slices

#: First-pass limits: words of a block that stop words can decide, their least share, most share of link text.
GOOD_WORDS, STOP_SHARE, LINK_SHARE = 12, 0.10, 0.5

# Function words of the languages the rules know.
STOP_WORDS = frozenset("""
the of and to in a is that it for on was be with as by this are at from or an not have has had but they his her you we their
der die und das in zu den ist des von mit dem für auf nicht eine ein als auch es an werden aus er hat dass sie nach bei wird
de la le les et des en un une du est que dans pour qui sur par au plus pas ne se ce il sont avec aux ou son
el los las y que en un una por con no para su al lo como más pero sus le ya o este sí porque del se es
di il che per una del non con sono della nel alla si più gli ma anche como uma não dos para os mais da em
van het een niet op te zijn met voor och att som av den till med om
""".split())

#: Learned stop words per script (block of 256 code points) beyond Latin.
LEARNED = 60

# Tag roles. The first two hold no markup; the others are dropped with what they hold if they end.
CODE = ("script", "style")
RAW = ("noscript", "template", "title", "textarea", "svg", "iframe", "select", "noframes")
BAD_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead tr ul br
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Words of class, id and role that name boilerplate.
BAD_WORDS = frozenset("""
ad ads adv advert adverts advertisement adsense advertising sponsor sponsored sponsors promo promotion promoted
banner cookie cookies consent gdpr notice notices notification alert disclaimer paywall popup modal overlay toast
sidebar sidenav rail widget widgets related recommended recommendations trending popular teaser
menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager skip toolbar
header masthead topbar footer copyright colophon contentinfo complementary
comment comments commentlist disqus replies reply respond discussion
form search login signup signin register subscribe subscription newsletter share sharing social follow hidden
""".split())
#: A name with one of these tells what else there is, or a state.
STATE_WORDS = frozenset("has have no with without is not open closed enabled disabled".split())

_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<({'|'.join(CODE)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

NONE, MAIN, HINTED, BAD = range(4)


def _role(tag: str, attrs: str) -> int:
    """What an element's tag and names say about what it holds."""
    hint = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or \
                (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return BAD
        if key in ("class", "id", "role"):
            names = [{w.lower() for w in _NAME.findall(name)} for name in value.split()]
            if any(n & BAD_WORDS and not n & STATE_WORDS for n in names):
                hint = True
    if tag in BAD_TAGS:
        return HINTED if tag == "form" else BAD
    if hint and tag not in ("html", "body"):
        return BAD if tag in MAIN_TAGS else HINTED
    return MAIN if tag in MAIN_TAGS else NONE


class _Page:
    """Blocks of a page: (text, link characters, in bad container, number of the article or 0)."""

    def __init__(self):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.stack: list[tuple[str, int, int]] = []  # open containers: tag, role, article
        self.bad, self.article, self.articles = False, 0, 0
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.in_link:
            self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((text, self.linked, self.bad, self.article))
            self.parts, self.linked = [], 0

    def _context(self) -> None:
        self.bad, hinted, self.article = False, False, 0
        for _, role, article in self.stack:
            if role == BAD:
                self.bad = True
            elif role == HINTED:
                hinted = True
            elif role == MAIN:
                self.article = article
                hinted = False  # an article inside a wrapper with a misleading name
        self.bad = self.bad or hinted

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK_TAGS:
            self.flush()
        if tag == "a":
            self.in_link = True
        if tag in VOID or attrs.endswith("/"):
            return
        role = _role(tag, attrs) if attrs or tag in BAD_TAGS or tag in MAIN_TAGS else NONE
        if role != NONE or (tag in BLOCK_TAGS and any(t == tag for t, _, _ in self.stack)) or tag in _NESTING:
            if role != NONE:
                self.flush()
            if role == MAIN:
                self.articles += 1
            self.stack.append((tag, role, self.articles))
            if role != NONE:
                self._context()

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS and tag != "br":
            self.flush()
        if tag == "a":
            self.in_link = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(r != NONE for _, r, _ in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                self._context()
                break


#: Elements whose nesting is followed even without a role, so that an end tag closes its own start.
_NESTING = frozenset("div section ul ol table td span li dl blockquote".split())


def blocks_of(page: str) -> list[tuple[str, int, bool, int]]:
    p, at = _Page(), 0
    endless: set[str] = set()  # elements that no end tag follows any more
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            p.text(page[at: m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            p.end(tag)
            continue
        if tag in _ENDS and tag not in endless and not m[4].endswith("/"):
            end = _ENDS[tag].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(tag)
        p.start(tag, m[4])
    if at < len(page):
        p.text(page[at:])
    p.flush()
    return p.blocks


def classify(blocks: list[tuple[str, int, bool, int]], learned: frozenset[str] = frozenset()) -> list[bool]:
    """Is a block main text? The two passes; ``learned`` are stop words of other scripts."""
    label: list[bool | None] = []
    for text, linked, bad, _ in blocks:
        words = text.lower().split()
        size = len(text) - len(words) + 1
        bare = [w.strip(".,;:!?\"'()«»„“”") for w in words]
        stops = sum(w in STOP_WORDS or w in learned for w in bare)
        if bad or linked > LINK_SHARE * size:
            label.append(False)
        elif len(words) >= GOOD_WORDS and stops >= STOP_SHARE * len(words):
            label.append(True)
        else:
            label.append(None)
    articles = {a for (_, _, _, a), x in zip(blocks, label, strict=True) if a and x is not False}
    if articles:  # prose outside the article is something else
        label = [x if a else False for x, (_, _, _, a) in zip(label, blocks, strict=True)]
    return _inherit(blocks, label)


def _inherit(blocks, label: list[bool | None]) -> list[bool]:
    """Second pass. Text of an article looks at blocks of the same article that are not in a bad
    container of their own; other text looks at all blocks outside articles."""
    def counts(i: int) -> bool:
        return label[i] is not None and not (blocks[i][3] and blocks[i][2])

    n = len(label)
    near: list[list[int]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        seen: dict[int, int] = {}
        for i in order:
            if label[i] is None and blocks[i][3] in seen:
                near[i].append(seen[blocks[i][3]])
            if counts(i):
                seen[blocks[i][3]] = i
    undecided = all(x is None for x in label)
    out = []
    for i, x in enumerate(label):
        if x is None:
            inside = blocks[i][3] > 0
            close = sorted((abs(i - j), label[j]) for j in near[i])
            if not close:
                x = inside or undecided  # nothing on the page speaks against it
            elif len(close) == 2 and close[0][0] == close[1][0] and close[0][1] != close[1][1]:
                x = inside  # a tie: text of an article stays, other text goes
            else:
                x = close[0][1]
        out.append(bool(x))
    return out


#: A word of up to four letters that are not Latin.
_OTHER_SCRIPT = r"[\p{L}&&[^\p{IsLatin}]]"
_SHORT_OTHER = rf"(?<!\p{{L}})({_OTHER_SCRIPT}{{1,4}})(?!\p{{L}})"


def learned_stop_words(pages: DataFrame, html_col: str = "html") -> frozenset[str]:
    """The ``LEARNED`` most frequent short words of every script but Latin, over all pages; pages without such letters
    are passed over. What comes to the driver is bounded by the number of scripts."""
    text = F.lower(F.regexp_replace(F.col(html_col), "<[^>]*+>", " "))
    words = (pages.where(F.col(html_col).rlike(_OTHER_SCRIPT)).select(F.explode(F.regexp_extract_all(text, F.lit(_SHORT_OTHER), 1)).alias("w"))
             .groupBy("w").agg(F.count("*").alias("n")).withColumn("script", F.floor(F.ascii("w") / 256)))
    place = F.row_number().over(Window.partitionBy("script").orderBy(F.desc("n"), "w"))
    return frozenset(r["w"] for r in words.withColumn("place", place).where(F.col("place") <= LEARNED).select("w").collect())


def main_text(page: str | None, learned: frozenset[str] = frozenset()) -> str:
    """Main text of a page: good blocks in page order joined by one space; empty for null or none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b[0] for b, good in zip(blocks, classify(blocks, learned), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks, n_kept.

    The whole page is read, broken-off ones too. Null or empty pages, and pages without main text, give
    an empty text; null urls stay null; repeated rows get equal results; other columns are ignored.
    """
    ship_code(pages.sparkSession)
    rows = spread_tasks(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    kind = dict(rows.dtypes)
    learned = learned_stop_words(pages, html_col)

    def run(batches):
        for b in batches:
            at = 0
            for pages_ in text_slices(b.column(2)):
                part = b.slice(at, len(pages_))
                at += len(pages_)
                texts, n_blocks, n_kept = [], [], []
                for page in pages_:
                    blocks = blocks_of(page)
                    good = classify(blocks, learned)
                    texts.append(" ".join(x[0] for x, g in zip(blocks, good, strict=True) if g))
                    n_blocks.append(len(blocks))
                    n_kept.append(sum(good))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                     pa.array(n_blocks, pa.int32()), pa.array(n_kept, pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint, n_blocks int, n_kept int")
