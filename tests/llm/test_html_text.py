import html
import re

from cadenza.llm import html_text
from cadenza.llm.html_text import Page

SF = "/root/testdata/sf0.001"


def plain(source):
    """The article of a generated page, by cutting its markup with plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    inner = re.sub(r"</?(?:p|h1)>", "\0", inner).replace("<br>", " ")
    blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]*>", "", inner).split("\0"))
    return "\n".join(b for b in blocks if b)


def test_whole_table_against_plain_patterns(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_text.query(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_boilerplate_goes_and_text_stays():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="home nav-open"><header><p>Site</p></header>
    <div id=side-bar>x</div><main><nav>Menu</nav><div class="cookie-notice">We use</div><h2>One &amp; two</h2>
    <p>First <b>bold</b>&nbsp;text<br>next<p>Second</p><ul><li>a<li>b</ul><form><input><p>Name</p></form>
    <script>if (a < b) document.write("<p>no</p>")</script><section class="reader-comments"><p>Nice!</p></section>
    <table><tr><td>c<td>d</table><aside>Also</aside>tail 1 < 2 &lt;i&gt;</main><footer>&copy; us</footer></body></html>"""
    assert Page(page).text().split("\n") == ["One & two", "First bold text next", "Second", "a", "b", "c", "d", "tail 1 < 2 <i>"]


def test_articles_before_the_body_and_broken_markup():
    assert Page("<p>out</p><article><p>in<div>deep</article><p>out").text() == "in\ndeep"
    assert Page("<ARTICLE><P>In</P></ARTICLE>").text() == "In"
    assert Page("no markup at all").text() == "no markup at all"
    assert Page("<p>cut <b>off").text() == "cut off"
    assert Page("<div><p>a</p><!-- <p>b</p> --><p title='>'>c</p></x></div><p").text() == "a\nc"
    assert Page("").text() == "" and Page("<div><p> </p></div>").text() == ""


def test_templates_of_a_host_go(spark):
    rows = [(i, f"http://H.com/{i}", f"<body><div><p>Join us</p></div><p>text {i}</p><p>shared {i % 3}</p></body>", "x") for i in range(30)]
    rows += [(100 + i, f"http://copies.com/{i}", "<p>all alike</p>", "x") for i in range(25)]
    rows += [(200, None, None, "x"), (201, "http://h.org/", "<p>Join us</p>", "x"), (201, "http://h.org/", "<p>Join us</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.row.page_id, r.row.text, r.text) for r in html_text.extract(pages).collect())
    expected = [(i, "x", f"text {i}\nshared {i % 3}") for i in range(30)] + [(100 + i, "x", "all alike") for i in range(25)]
    assert got == sorted([*expected, (200, "x", ""), (201, "x", "Join us"), (201, "x", "Join us")])
    assert html_text.extract(pages.limit(0)).collect() == []


def test_marked_layouts_keep_their_content():
    assert Page('<div class="layout has-sidebar"><article><p>Story</p><div class="share">x</div></article><div class="sidebar">y</div></div>').text() == "Story"
    assert Page('<article class="post share"><p>Story</p></article>').text() == "Story"
    comments = '<div class="comments"><article>nice</article><article>good</article></div>'
    assert Page(f"<article>A long story</article>{comments}").text() == "A long story"
    assert Page(f'<div class="has-sidebar">{comments}<article>A long story</article></div>').text() == "A long story"
    assert Page('<div id="page-header"><main><p>Story</p></main></div><p>out</p>').text() == "Story"
    assert Page('<p>Hi</p><div class="no-sidebar"><p>The whole story</p><div class="ads">Buy</div></div>').text() == "Hi\nThe whole story"


def test_root_comes_from_elements():
    for no in ("<!-- <article> -->", '<script>w("<article>x</article>")</script>', "<aside><article>card</article></aside>", "<articles>", "<ARTICLE-x></ARTICLE-x>"):
        assert Page(f"{no}<p>Story</p>").text() == "Story", no
        assert Page(f"{no}<p>out</p><main>Story</main>").text() == "Story", no
    assert Page("<p>out</p><article></article>").text() == ""


def test_only_listed_elements_go():
    assert Page("<p>a <math><mi>x</mi></math> <object>b</object> <noscript>c</noscript></p>").text() == "a x b c"


def texts(spark, rows):
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.row.page_id: r.text for r in found.collect()}


def test_templates_of_the_table_are_found_and_decide(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    counts = {r.host: r["count"] for r in pages.select(html_text.host_of(pages.url).alias("host")).groupBy("host").count().collect()}
    known = {r.host: set(r.hashes) for r in html_text.templates(pages).collect()}
    large = [h for h, n in counts.items() if n >= 20]
    assert sum(bool(known.get(h)) for h in large) > 0.9 * len(large)
    for r in pages.limit(20).collect():
        page = Page(r.html)
        assert page.text(frozenset(known[next(h for h in counts if h and f"//{h}/" in r.url)])) == plain(r.html) != page.text(frozenset())


def test_an_unlisted_class_with_other_text_each_time_goes(spark):
    prose = lambda i: f"<p>Once {i} upon a time</p><p>they {i * 7} lived on</p><ul><li>and {i}</li></ul>"
    page = lambda i: f'<body><div class="zq7"><p>Buy {i * 31}</p></div><article>{prose(i)}<div class="qx-{i}"><p>more {i}</p></div></article><p>fine print {i}</p></body>'
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(30)]
    # no article: the container with most text stands for it
    rows += [(100 + i, f"http://b.org/{i}", f'<body><div class="zq8">Sign {i}</div><div class="body">{prose(i)}<div class="zq9">Deal {i}</div></div></body>') for i in range(30)]
    # a subtree on few pages of a large host is content, also outside of the article
    rows += [(200 + i, f"http://c.org/{i}", f"<article>{prose(i)}</article>" + f'<section class="s{"abc"[i % 3]}"><p>extra {i}</p></section>' * (i < 3)) for i in range(30)]
    got = texts(spark, rows)
    expected = lambda i: f"Once {i} upon a time\nthey {i * 7} lived on\nand {i}"
    for i in range(30):
        assert got[i] == expected(i)
        assert got[100 + i] == expected(i)
        assert got[200 + i] == expected(i) + f"\nextra {i}" * (i < 3)


def test_small_hosts_borrow_from_other_sites(spark):
    rows = [(i, f"http://site{i}.org/", f'<div class="zq7">Join {i}</div><article><p>Story {i}</p><p>Shared line</p></article>') for i in range(12)]
    rows += [(50, "http://odd.org/", '<section class="own"><p>Kept, as no other site has it</p></section><article><p>Story</p></article>')]
    got = texts(spark, rows)
    assert all(got[i] == f"Story {i}\nShared line" for i in range(12))
    assert got[50] == "Kept, as no other site has it\nStory"
    assert texts(spark, rows[:1]) == {0: "Story 0\nShared line"}


def test_copies_of_an_article_keep_every_paragraph(spark):
    story = "".join(f'<p class="c">Paragraph {k} of a story</p>' for k in range(8))
    rows = [(i, f"http://a.org/{i}", f"<nav>m</nav><article>{story}<p>edit {i}</p></article>") for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i}", f"<article>{story}</article>") for i in range(40)]
    got = texts(spark, rows)
    plain_story = "\n".join(f"Paragraph {k} of a story" for k in range(8))
    assert all(got[i] == f"{plain_story}\nedit {i}" and got[100 + i] == plain_story for i in range(40))


def test_hostile_pages_take_time_in_proportion():
    import time

    for unit in ("<div>", "<b>", "<ul><li>", "<div class='a'>"):
        n = 1_000_000 // (2 * len(unit))
        begun = time.time()
        Page(unit * n + "x" + "</p></li></div>" * (n // 3)).text()
        assert time.time() - begun < 8  # a quadratic one took half an hour
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert Page(long).text() == "\n".join(["word & word"] * 50_000)
