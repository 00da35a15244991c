import html
import re

import pytest

from acreledger.llm import queries
from acreledger.llm.extract import extract, main_text

LONG = "Here stand words enough for a paragraph of prose, and then some more of them to be sure."
PAGES = {
    f"<body><nav><ul><li><a href=x>x</a></ul></nav><article><header><h1>Head</h1></header><div class='notice'>Cookies</div><p>One.<aside>related</aside><section class=\"comments\"><p>c1</p></section><div class=ad>buy</div><p>{LONG}</p><footer>f</footer></article><footer>x</footer>": f"Head\nOne.\n{LONG}",
    f"<body><div id=top><a href=a>Home</a> <a href=b>News</a></div><div class=wrap><h1>Title</h1><div><p>{LONG}</p><p>Second &amp; <i>th</i>ird\n \t words&nbsp;&#233;<ul><li>one<li>two</ul></div></div><div class=sidebar><p>{LONG}</p></div>": f"Title\n{LONG}\nSecond & third words é\none\ntwo",
    f"<body><h1>T</h1><p><b>only <br>para<p>second<table><tr><td>a<td>b</table>tail<script>var a='<p>no</p>';</script><!-- {LONG} --><style>p{{x:y}}</style>": "T\nonly para\nsecond\na\nb\ntail",
    "plain text &lt;only": "plain text <only",
    "<p>cut off &amp": "cut off &",
    "<p>cut off <b": "cut off",
    "": "",
    "<html><head><title>t</title></head><body></body></html>": "",
    "<form><p>Name</p></form><div style='display: none'>gone</div><p hidden>gone</p><p>kept": "kept",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_pages(page):
    assert main_text(page) == PAGES[page]


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + LONG) == LONG
    page = "<body>" + f"<p>{LONG}</p>" * 3000
    assert main_text(page) == "\n".join([LONG] * 3000)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "u", 5), (1, None, "u", 5), (2, "<p>Año 1</p>", None, 6)], "page_id long, html string, url string, N_CHARS int")
    got = extract(df)
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (1, "", 0), (2, "Año 1", 5)]
    assert extract(df.limit(0)).count() == 0


def test_pages_give_their_documents(spark):
    """The pages of the test data wrap documents, which their address names."""
    sf = "/root/testdata/sf0.01"
    titles = {r.url: re.search(r"<h1>(.*?)</h1>", r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url", "html").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op9_html_extraction"](spark, sf).collect()
    assert len(rows) == 250
    for r in rows:
        doc = docs[int(re.search(r"\.(?:com|net|org)/[^/]+/(\d+)", r.url)[1])]
        assert r.text.split("\n", 1)[0] == " ".join(html.unescape(titles[r.url]).split())
        assert r.text.split("\n", 1)[1] == "\n".join(x for x in (" ".join(line.split()) for line in doc.split("\n")) if x)
        assert r.n_chars == len(r.text)


PROSE = [f"{LONG} Paragraph number {i} says it." for i in range(9)]


def paragraphs(first, last):
    return "".join(f"<p>{p}</p>" for p in PROSE[first:last])


@pytest.mark.parametrize(("before", "want"), [
    ("<h1>My Title</h1>", "My Title\n"),
    ("<div class='post-header'><h1>My Title</h1><p>Lead of it.</p></div>", "My Title\nLead of it.\n"),
    ("<h1>My Title</h1><p>Lead of it.</p>", "My Title\nLead of it.\n"),
    ("<div><div><h1>My Title</h1></div></div><p>By <a href=x>A</a>, a writer of long standing.</p>", "My Title\nBy A, a writer of long standing.\n"),
    ("<p>We set cookies.</p><h1>My Title</h1>", "My Title\n"),
    ("<h1>Site</h1><ul><li><a href=a>Home</a><li><a href=b>News</a></ul>", ""),
    ("<div class=nav><h1>Site</h1></div>", ""),
    ("<p>We set cookies.</p>", ""),
])
def test_headline_and_lead_beside_the_article(before, want):
    page = f"<body>{before}<div class=content>{paragraphs(0, 6)}</div><div class=sidebar>x</div><footer>f</footer></body>"
    assert main_text(page) == want + "\n".join(PROSE[:6])
    inner = f"<body>{before}<div class=content><h1>Own head</h1>{paragraphs(0, 6)}</div></body>"
    assert main_text(inner).endswith("Own head\n" + "\n".join(PROSE[:6]))
    wrapped = f"<body><div class=page>{before}<div class=content>{paragraphs(0, 6)}</div></div><footer>f</footer></body>"
    assert main_text(wrapped).endswith(want + "\n".join(PROSE[:6]))


@pytest.mark.parametrize("start", ["<div class='overflow-hidden'>", "<div class='content no-sidebar'>", "<div class=has-sidebar>", "<div id=post-with-comments>", "<form action=x>", "<form><div class='page search'>", "<div class=discussion>", "<div class=share-price>"])
def test_wrappers_of_the_article_stay(start):
    page = f"<body><div class=ad-slot>buy now</div>{start}<h1>T</h1>{paragraphs(0, 4)}<div class=related-posts><p>{LONG}</p></div><select><option>o</select>"
    assert main_text(page) == "\n".join(["T", *PROSE[:4]])


def test_attribute_values_hide_nothing():
    page = f"<body><p>{LONG} A <a href=/wiki/Hidden_Markov_model>model</a>, <i title='a hidden gem'>rare</i> <b data-class=ad>bold</b></p>{paragraphs(0, 3)}<p hidden=hidden>x</p><p class=hidden>x</p><p aria-hidden='true'>x</p>"
    assert main_text(page) == "\n".join([f"{LONG} A model, rare bold", *PROSE[:3]])
    comments = f"<body><div class=text><h1>T</h1>{paragraphs(0, 2)}</div><div class=comments>{paragraphs(2, 9)}</div>"
    assert main_text(comments) == "\n".join(["T", *PROSE[:2]])


@pytest.mark.parametrize(("start", "end"), [("", ""), ("<div id=all>", "</div>"), ("<div class=row><div>", "</div></div>")])
@pytest.mark.parametrize("tag", ["section", "div class=part"])
def test_articles_in_sibling_sections(start, end, tag):
    close = f"</{tag.split()[0]}>"
    links = "<ul>" + "".join(f"<li><a href={i}>some other page {i}</a>" for i in range(9)) + "</ul>"
    parts = [f"{start}<{tag}><h2>Part {n}</h2>{paragraphs(a, b)}{close}{end}" for n, (a, b) in enumerate([(0, 5), (5, 8), (8, 9)])]
    page = f"<body><div>{links}</div><h1>Title</h1>{parts[0]}{links}{parts[1]}{parts[2]}<div>{links}</div><div class=comments><p>{LONG}</p></div>"
    want = ["Title", "Part 0", *PROSE[:5], "Part 1", *PROSE[5:8], "Part 2", PROSE[8]]
    assert main_text(page) == "\n".join(want)
