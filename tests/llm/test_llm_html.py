import html
import re

from quarry.llm.html_text import extract_text, main_text


def test_given_pages_equal_their_articles(spark, sf_dir):
    """The given pages keep the article in one element; cut it out by hand and compare whole texts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br><p>", article)
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip() for b in blocks)
        want = "\n\n".join(b for b in plain if b)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


BOILERPLATE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="no-sidebar"><header><h1>Site</h1><a href=x>Home</a></header>
<div id="cookie-notice">We use cookies, as you know, to improve. Accept?</div>
<div class="wrap"><div class="menu"><a>A</a> <a>B</a></div><div class="post"><h2>Title here</h2>
%s
<aside>Side</aside><form>Mail <input name=q></form></div>
<div class="comments"><p>Great post, thanks. I love it, a lot, truly.</p></div></div><footer>(c)</footer></body>"""


def test_boilerplate_goes_and_article_stays():
    body = "<div>First para, with text. And <a>link</a> more.</div><div>Second &eacute;&nbsp;para,<br>line two.</div>"
    assert main_text(BOILERPLATE % body) == "Title here\n\nFirst para, with text. And link more.\n\nSecond é para, line two."


def test_article_with_own_header_and_comments_inside():
    page = ("<body><nav>x</nav><article><header><h1>Head</h1><p>by me</p></header><p>One, two. Three.</p>"
            "<ul><li>item one, x<li>item two</ul><section id=comments><p>Nice, very nice.</p></section></article>")
    assert main_text(page) == "Head\n\nOne, two. Three.\n\nitem one, x\n\nitem two"


def test_edge_cases(spark):
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x") == ""
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text("a < b <p>c") == "a < b\n\nc"
    long = "<article>" + "<p>Some text, here.</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n\n") == 19_999
    deep = "<div>" * 5000 + "Deep text, yes." + "</div>" * 5000
    assert main_text(deep) == "Deep text, yes."
    rows = [(1, None, "x", 5), (1, None, "x", 5), (2, "u", None, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()) == [(1, "x", 1)] * 2 + [(2, "", 0)]
    assert extract_text(df.limit(0)).count() == 0
