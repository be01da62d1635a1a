"""Main text of pages whose parts are known, and of every given page against its article element."""

import html as H
import random
import re

from tilewright.llm import extraction as X

SMALL = "/root/testdata/sf0.001/pages.parquet"
TEXT = "The river, which rises in the north, flows past three towns before it meets the sea near the old harbour."


def article(rng):
    blocks, out = [], []
    for i in range(rng.randint(1, 9)):
        words = " ".join(rng.choice(TEXT.split() + ["A&B", "1 < 2", "é", "short."]) for _ in range(rng.choice([1, 3, 12, 60])))
        tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"])
        shown = H.escape(words).replace(" ", rng.choice([" ", "\n", " <b>", "&#32;", "<br>\n"]), 1)
        blocks.append(" ".join(words.split()))
        out.append(f"<ul><li>{shown}</ul>" if tag == "li" else f"<{tag}>{shown}</{tag}>")
    return blocks, "".join(out)


AROUND = ('<nav><a href="/">Home</a></nav>', '<div class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div>', '<header><h2>Our site</h2><p>News, every day</p></header>',
          '<div id="cookie-notice"><p>We use cookies, and so do others.</p></div>', '<aside><p>Read more, here.</p></aside>', '<div class="sideBar"><p>Weather, sport, cars</p></div>',
          '<form action="/s"><p>Your mail, please</p><input name="q"><button>Send</button></form>', '<footer><p>© 2024, all rights</p></footer>', '<div class="ad-slot-2">Buy now, pay later!</div>',
          '<script>var a="<p>no, no</p>";</script>', "<style>p{margin:0}</style>", "<!-- <p>hidden, too</p> -->", '<section class="comments"><article><p>First, I think.</p></article></section>',
          '<div style="display:none"><p>Unseen, surely</p></div>', '<ul><li><a href="/1">one</a></li><li><a href="/2">two</a></li><li><a href="/3">three</a></li></ul>',
          '<div role="alert"><p>Outdated browser, sorry</p></div>', "<noscript><p>Switch on scripts</p></noscript>")


def test_articles_among_surrounding_parts():
    rng = random.Random(5)
    for _ in range(300):
        blocks, inner = article(rng)
        title = "Title of the page"
        long = f"<p>{TEXT}</p><p>{TEXT} {TEXT}</p>"
        frame = rng.choice(["<article><h1>{t}</h1>{x}</article>", "<main><header><h1>{t}</h1></header>{x}</main>", '<div class="page"><div id="content"><h1>{t}</h1>{x}</div></div>',
                            "<h1>{t}</h1><div class=post>{x}</div>", "<article><header class='entry-header'><h1>{t}</h1></header><section>{x}</section></article>"])
        some = rng.sample(AROUND, 6)
        inside = rng.choice(AROUND[:2] + AROUND[3:]) if "<article" in frame or "<main" in frame or "content" in frame else ""
        page = (f"<!DOCTYPE html><html><head><title>No</title></head><body class='home has-sidebar'>{''.join(some[:3])}"
                + frame.format(t=title, x=long + inner + inside) + "".join(some[3:]) + rng.choice(["</body></html>", ""]))
        assert X.main_text(page) == "\n\n".join([title, TEXT, f"{TEXT} {TEXT}", *blocks]), page


def test_unclosed_nested_and_cut_off():
    assert X.main_text("<p>one<p>two <b>bold<p>three") == "one\n\ntwo bold\n\nthree"
    assert X.main_text("<div><p>a &amp b &lt;c&gt; &eacute;&#x41;</div></p></b><p>d") == "a & b <c> éA\n\nd"
    assert X.main_text("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "x\n\ny\n\n1\n\n2\n\n3"
    assert X.main_text("<article><p>one</p><p>two <a hre") .startswith("one\n\ntwo")
    assert X.main_text("<form><main><p>The page is one form.</p></main><input></form>") == "The page is one form."


def test_deep_and_long_pages():
    deep = "<div>" * 30000 + "<p>deep, very deep</p>"
    assert X.main_text(deep) == "deep, very deep"
    assert len(X.main_text("<p>word, " * 40000).split("\n\n")) == 40000


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no tags,  at all\n"), (None, "u", "<nav><a href=/>x</a></nav>"), (5, "u", "<p>a</p>"), (5, "u", "<p>a</p>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in X.extracted(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [(1, "u", "", 0), (2, "u", "", 0), (3, None, "no tags, at all", 15), (5, "u", "a", 1), (5, "u", "a", 1), (None, "u", "", 0)]
    assert X.extracted(df.limit(0)).count() == 0


def test_given_pages(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in X.extracted(spark.read.parquet(SMALL)).collect()}
    for r in spark.read.parquet(SMALL).collect():
        inner = r.html[r.html.index("<article>") + 9:].partition("</article>")[0]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
