import re

import duckdb
import numpy as np

from portflow.llm import html_text as H


def test_named_parts_go_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
    <body class="has-sidebar"><header><a href="/">Site</a> name</header><nav><ul><li><a href="x">One</a></li><li><a href=y>Two</a></ul></nav>
    <div id="cookieNotice">We use cookies to make this long enough to look like some text of a page.</div>
    <main class="content with-sidebar"><article><header><h1>The &amp; title</h1></header><p>First  para&shy;graph<br>with a <a href="z">link</a>.<p>Second &lt;b&gt; one
    <div class="advert">Buy now and more words here</div><p>Short.</p><!-- <p>hidden</p> -->
    <figure><img src="a"><figcaption>A caption.</figcaption></figure><form><label>Name</label><input><button>Send</button></form></article>
    <section id="comments"><article class="comment"><p>A reader says something rather long about this article here.</p></article></section></main>
    <aside><p>Some side text that is long enough to be a paragraph of the article.</p></aside>
    <footer>&copy; 2024 All rights</footer><script>x</script></body></html>"""
    assert H.main_text(page).split("\n\n") == ["The & title", "First para\xadgraph with a link.", "Second <b> one", "Short.", "A caption."]


def test_names_of_containers():
    for name in ("footer container", "sidebar-left", "entry-footer", "post-comments", "adSlot ad-slot", "main-nav", "cookieBar", "is-hidden", "comment-content"):
        assert H.main_text(f'<article><p>Kept text.</p><div class="{name}"><p>Gone text.</p></div></article>') == "Kept text.", name
    for name in ("has-sidebar", "content-with-sidebar", "post-content", "container", "no-ads", "entry", "thread article-header"):
        assert H.main_text(f'<article><div id="{name}"><p>Kept text.</p></div></article>') == "Kept text.", name
    assert H.main_text('<main class="page sidebar"><p>Kept text.</p></main>') == "Kept text."


def test_pages_without_names():
    long = "word " * 40
    page = f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Mail us</a></ul><h1>A title</h1><p>{long}<p>Some words.<p>{long}<ul><li><a href=a>Imprint</a><li><a href=b>Terms</a></ul>"
    assert H.main_text(page).split("\n\n") == ["A title", long.strip(), "Some words.", long.strip()]


def test_broken_markup():
    for page in (None, "", "<p", "<!--", "<script>", "<a href=\"", "</p></div></nav>", "<nav><p>x", "<p title='>"):
        assert H.main_text(page) == ""
    assert H.main_text("<article><p>text &am") == "text &am"
    assert H.main_text('<article><p>a <b>b<p>c <a href="d>e') == "a b\n\nc e"
    assert H.main_text("<article>" + "<div>" * 5000 + "deep words") == "deep words"
    assert H.main_text("<article><p>" + "<" * 50_000).startswith("<<")
    assert len(H.main_text("<article><p>" + "long text " * 100_000)) == 999_999
    assert H.main_text("<article><p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


def test_tree_learns_its_table():
    table = np.array(H.LABELLED, float)
    tree = H.trained()
    assert all(H.is_article(tree, tuple(r[:-1])) == bool(r[-1]) for r in table)
    assert H.grow(np.zeros((4, 2)), np.array([0.0, 1, 1, 1])) == (0.75,)


def test_given_pages_match_their_articles(spark):
    """The given pages have one article element: what stands in it, cut at its paragraphs, is the expected text."""
    import html

    rows = duckdb.connect().execute("select page_id, url, html from read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall()
    want = {}
    for i, url, page in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body[1])] if body else []
        text = "\n\n".join(p for p in parts if p)
        want[i] = (url, text, len(text))
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(df).collect()}
    assert got == want


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<article>x y</article>", None), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, map(tuple, H.extract(df).collect()))) == sorted(map(str, [(1, None, "", 0), (1, "u", "x y", 3), (None, "v", "", 0)]))
    assert H.extract(df.limit(0)).count() == 0


def test_elements_without_an_end_do_not_take_the_page():
    from portflow.llm import html_text

    text = "This is the article of the page and it has a good number of words, so that it is one block of text. " * 3
    want = " ".join(text.split())
    body = f"<body><article><p>{text}</p></article></body></html>"
    head = "<html><head><meta charset=utf-8><title>A title</title><style>p { }</style><script>x = '<p>'</script>"
    for page in (head + body, head + "</head>" + body, head + f"<article><p>{text}</p></article>",
                 *(head + f"</head><body><{t} class=x>" + body[6:] for t in ("select", "svg", "object", "noscript", "math", "template", "iframe", "canvas"))):
        assert [b[0] for b in html_text.blocks(page)] == [want], page[:200]
    for t in ("select", "svg", "noscript", "object"):  # those that end are no text
        assert [b[0] for b in html_text.blocks(head + f"<body><{t}><b>not this</b></{t}>" + body[6:])] == [want]
    assert [b[0] for b in html_text.blocks(f"<body><p>{text}</p><script>never ended <p>{text}</p>")] == [want]
