import html as entities
import re

import pytest

from citeflow.llm import html_extract as H
from citeflow.llm import queries

SMALL = "/root/testdata/sf0.001"
P = "The quick brown fox jumps over the lazy dog and it was a very good day for all of the people in the town."
CASES = [
    (f"<nav><a href=/>x</a></nav><article><h1>Head</h1><p>{P}<p>Short.</article><footer>{P}</footer>", f"Head {P} Short."),
    (f'<body class="has-sidebar"><header><h1>Site</h1></header><form><article class="post"><p>{P}<ul><li>one<li>two</ul></article></form>', f"{P} one two"),
    (f'<article><p>{P}</p><div class="share">share me</div><p>tail</p><aside>{P}</aside><p>end</article>', f"{P} tail end"),
    (f'<div class="menu"><a>x</a></div><div><p>{P}</p><p>short one</p><p>{P}</p></div><div id="footer">f</div>', f"{P} short one {P}"),
    (f'<main><p>{P}</p></main><section id="comments"><article class="comment"><p>{P}</p></article></section>', P),
    (f'<div class="cookie-notice">{P}</div><div class="ad-banner">{P}</div><div class=sidebar><p>{P}</p></div><article>{P}</article>', P),
    (f"<article><p>{P}</p><p><a href=x>only a link and nothing else</a></p></article>", P),
    (f'<article><script>var a = "<p>no</p>";</script><style>p{{}}</style><!-- <p>no --><p>{P} a &lt; b &amp; &eacute;&#8364;</p>', f"{P} a < b & é€"),
    (f"<article><p>{P} bro<b>ken</b>\n\t off<br>line</p><p>trunc &am", f"{P} broken off line trunc &am"),
    (f'<article><p title="a > b" hidden>{P}</p><p>{P}</p><p style="display: none">{P}</p></article>', P),
    (f"<article><form><label>{P}</label><input></form><p>{P}</p><button>Go</button></article>", P),
    ("<p>a < b stays", "a < b stays"), ("", ""), (None, ""), ("<html><body></body></html>", ""), ("just text", "just text"),
    ("<nav>only a menu</nav>", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rules(page, text):
    assert H.main_text(page) == text


def test_whole_table(spark):
    got = {r.page_id: r for r in queries.op9_html_extraction(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*(?:>|$)", " ", body[1])).split()) if body else ""
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_edges(frame):
    schema = "page_id bigint, url string, html string, text int"
    assert H.extract(frame([], schema)).collect() == []
    long = "<article>" + f"<p>{P}</p>" * 3000
    rows = [(1, None, None, 1), (2, "u", "", None), (2, "u", "", None), (3, "v", long, 2), (None, "w", CASES[0][0], 3)]
    got = sorted((r.page_id or 0, r.url, r.n_chars) for r in H.extract(frame(rows, schema)).collect() if r.url)
    assert got == [(0, "w", len(CASES[0][1])), (2, "u", 0), (2, "u", 0), (3, "v", (len(P) + 1) * 3000 - 1)]


def test_formula_and_fallback_text_stay():
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi></math>"
    assert H.main_text(f"<article><p>{P} Here {formula} holds.</p></article>") == f"{P} Here E=m holds."
    assert H.main_text(f'<article><object data="a.pdf"><param name="x"><p>{P} See the file.</p></object></article>') == f"{P} See the file."
    assert H.main_text(f"<nav>{formula}<object>{P}</object></nav><article><p>{P}</p></article>") == P


@pytest.mark.parametrize("name", ["post-comments", "comment-body", "comment-content", "sidebar-content", "footer-text", "cookie-text", "promo-story",
                                  "page-footer", "page-header", "newsletter-body", "mainNav", "x page_sidebar"])
def test_boilerplate_names_without_an_article(name):
    page = f'<body><div class="wrap"><p>{P}</p><p>{P}</p></div><div class="{name}"><p>{P}</p></div></body>'
    assert H.main_text(page) == f"{P} {P}"


@pytest.mark.parametrize("name", ["page-content", "main has-sidebar", "story-body no-sidebar", "entry comments-closed", "post-text", "article-body"])
def test_content_names_without_an_article(name):
    assert H.main_text(f'<body><div class="{name}"><p>{P}</p></div><div class="sidebar"><p>{P}</p></div></body>') == P


@pytest.mark.parametrize("tag", ["select", "svg", "iframe", "textarea", "noscript", "template", "title", "noframes"])
def test_elements_without_an_end_hide_nothing_else(tag):
    assert H.main_text(f"<article><p>{P}</p><{tag} class=x><p>{P}</p><p>tail</p></article>") == f"{P} {P} tail"
    assert H.main_text(f"<article><p>{P}</p><{tag} class=x>{P}</{tag}><p>tail</p><{tag}><p>end</p></article>") == f"{P} tail end"
    assert H.main_text(f"<article><p>{P}</p><{tag}/><p>tail</p></article>") == f"{P} tail"
    assert H.main_text("<article>" + f"<p>{P}</p><{tag}>" * 2000) == " ".join([P] * 2000)


def test_headings():
    assert H.main_text(f"<article><header><h1>Title</h1></header><p>{P}</p></article>") == P
    assert H.main_text(f"<article><h1>Title</h1><p>{P}</p></article>") == f"Title {P}"


def test_stop_words_of_another_script_are_learned(frame):
    """Russian pages without an article: the prose decides, the menu inherits nothing from it."""
    prose = "Это было в том году и не на этой земле, но и в нём мы не видели того, что он и она искали на всех дорогах и в горах."
    menu = "".join(f"<li>Раздел{i}</li>" for i in range(6))
    page = f"<body><ul class=menu>{menu}</ul><div><p>{prose}</p><p>Коротко.</p><p>{prose}</p></div><div>Все права защищены</div><div class=footer>{prose}</div></body>"
    df = frame([(i, None, page) for i in range(5)], "page_id bigint, url string, html string")
    learned = H.learned_stop_words(df)
    assert {"и", "в", "не", "на"} <= learned
    assert H.classify([(prose, 0, False, 0), ("word " * 20, 0, False, 0)], learned) == [True, True]
    got = {r.text for r in H.extract(df).collect()}
    assert got == {f"{prose} Коротко. {prose}"}  # the rights line is as near to the footer as to the prose
    assert H.learned_stop_words(frame([(1, None, "<p>Latin only</p>")], "page_id bigint, url string, html string")) == frozenset()


def test_two_columns_of_prose_and_a_navigation_block():
    """No names and no article: an open block goes with the nearer decided one."""
    links = "<p>" + " ".join(f"<a href={i}>link {i}</a>" for i in range(20)) + "</p>"
    assert H.main_text(f"<body>{links}<p>Top line</p>{links}<p>{P}</p><p>small</p><p>{P}</p>{links}<p>Bottom line</p></body>") == f"{P} small {P}"
