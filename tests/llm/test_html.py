from __future__ import annotations

import time

import pytest

from tallyrun.llm import html_text

PAGES = "page_id long, url string, html string, host string, text string, row int, blocks string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", 1, "b") for r in rows], PAGES).repartition(3)


def text_of(source):
    return "\n".join(html_text.Page(source).kept()[0])


def test_article():
    source = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li>Menu</ul></nav><header>Site</header>
    <!-- ad <p>no</p> --><div class="top-ad">Buy</div><div id=cookie-notice>We use</div><article><h1>A &amp; B &lt;c&gt; &copy</h1><p>One  <b>bo</b>ld\n two<br>three&nbsp;x<p>Unclosed <i>it
    <div class='comments'><p>First!</p></div><form><input value=">">Send</form><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>side</aside>a < b</article><footer>&copy; me</footer></body></html>"""
    assert text_of(source).split("\n") == ["A & B <c> ©", "One bold two three x", "Unclosed it", "x", "y", "1", "2", "a < b"]


def test_broken_pages():
    assert text_of("") == "" and text_of("<") == "<" and text_of("plain & text") == "plain & text"
    assert text_of("<script>never ends <p>x") == "" and text_of("<!-- never ends") == ""
    assert text_of("</p></div>x<p a='>y") in ("x", "x\ny", "x\n<p a='>y")
    assert text_of("<p>" * 3000 + "x") == "x"
    assert text_of("<div>" * 3000 + "x") == "x"
    assert text_of("<main><p>in</p></main><p>out</p>") == "in"
    assert text_of("<p>only</p><p>paragraphs</p>") == "only\nparagraphs"


def test_listed_names():
    for source in ('<article class="post has-comments">Story</article>', '<div class="content no-sidebar">Story</div>', '<article id="ad-123">Story</article>',
                   '<article><p class="share-price">Story</p></article>', '<article><section class="related-work">Story</section></article>', '<div title="x class=ad">Story</div>',
                   '<main class="share"><p data-x=\'id="ad"\'>Story</p></main>'):
        assert text_of(source) == "Story", source
    for name in ("ad", "x1 top-ad", "ad-123", "comments-area", "cookie_notice", "site-footer", "post-comments", "AdBox"):
        assert text_of(f"<div><p>Story</p><div class='{name}'>no</div><div id={name.split()[-1]}>no</div></div>") == "Story", name
    assert text_of('<article>Story<article class="comment">no</article><div role="search">no</div></article>') == "Story"


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<a '", "<a \"'>", "<p><td><x1>", "<x1><hr>", "</script ", "<!--", "<b><p>x", "<", "&amp", "<ul><li>x"])
def test_long_odd_pages(part):
    start = time.process_time()
    page = html_text.Page(part * (1_000_000 // len(part)) + ">")
    assert time.process_time() - start < 20
    assert all(0 <= i < j <= len(page.blocks) for _, i, j in page.subtrees)


def test_nested_template(spark):
    deep = "".join(f"<div>step {i}" for i in range(5000)) + "</div>" * 5000
    rows = [(i, "http://a.example/p", f"<body><p>own text {i}</p>{deep}<div>end {i}</div></body>") for i in range(12)]
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()} == {i: f"own text {i}\nend {i}" for i in range(12)}


def test_template_removal(spark):
    box = '<div class="x1"><p>Follow the site</p><p>every day</p></div>'
    rows = [(i, "http://a.example/p", f"<body>{box}<div><p>own text {i}</p><p>Said on three pages</p></div></body>" if i < 3 else f"<body>{box}<div><p>own text {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://b{i}.example/p", f"<body>{box}<p>elsewhere</p></body>") for i in range(12)]
    rows += [(200 + i, "http://c.example/", "<article><p>The same passage</p></article>") for i in range(12)]
    rows += [(300, None, box), (301, "http://a.example/q", None), (302, "http://a.example/q", ""), (303, "HTTP://A.example/p", f"<body>{box}<p>z</p></body>"), (303, "HTTP://A.example/p", f"<body>{box}<p>z</p></body>"), (None, "http://a.example/p", "<p>no id</p>")]
    got = {}
    for r in html_text.main_text(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[0] == ["own text 0\nSaid on three pages"] and got[5] == ["own text 5"]
    assert got[105] == ["Follow the site\nevery day\nelsewhere"]
    assert got[203] == ["The same passage"]
    assert got[300] == ["Follow the site\nevery day"] and got[301] == [""] and got[302] == [""] and got[303] == ["z", "z"] and got[None] == ["no id"]
    assert html_text.main_text(pages(spark, rows).limit(0)).count() == 0


def test_long_page(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} &eacute;</p>" for i in range(30_000)) + "</article>"
    (row,) = html_text.main_text(pages(spark, [(1, "http://a/", long)])).collect()
    assert row["text"] == "\n".join(f"paragraph {i} é" for i in range(30_000))


def test_template_inside_articles(spark):
    box = '<div class="x1"><p>Follow the site</p><p>every day</p></div>'
    page = lambda i: f'<div id="wrap"><article><h2>Notes</h2><p><b>Title {i}<p>own text {i}</p><p>The saying of the site, told again</p><ul><li>item</ul>{box}<p class="z9">Write to us</p><table><tr><td>0<td>{i}</table></article><p>out</p></div>'
    rows = [(i, "http://a.example/p", page(i)) for i in range(12)]
    rows += [(100 + i, "http://b.example/p", f'<article>{box}<p>The same passage</p></article><footer>{i}</footer>') for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[5] == "Notes\nTitle 5\nown text 5\nThe saying of the site, told again\nitem\n0\n5"
    assert got[105] == "Follow the site\nevery day\nThe same passage"


def test_copies_and_sizes_of_hosts(spark):
    box = '<div class="x1"><p>Follow the site</p><p>every day</p></div>'
    rows = [(i, "http://a.example/p", f"<body><div><p>One story</p><p>told often</p></div></body><!-- {i} -->") for i in range(20)]
    rows += [(100 + i, "http://a.example/p", f"<body><div><p>own text {i}</p></div></body>") for i in range(60)]
    rows += [(200 + i, "http://small.example/p", f"<body>{box}<p>own text {i}</p></body>") for i in range(4)]
    rows += [(1000 + i, "http://hot.example/p", f"<body>{box if i % 20 == 0 else ''}<p>own text {i}</p></body>") for i in range(10_000)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert {got[i] for i in range(20)} == {"One story\ntold often"} and got[105] == "own text 5"
    assert got[202] == "own text 2" and got[1040] == "own text 40" and got[1041] == "own text 41"
