"""Page parsing case by case, and the site style tree on invented sites."""

import random

import pytest

from siltbed.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, host string, block int"


def blocks(html):
    page = html_text.Page(html, html_text.tools())
    return [page.texts[k] for k in page.kept()]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<div", []),
        ("<p>a<p>b &amp; c &am", ["a", "b & c &am"]),
        ("<article><h1>T</h1><p><b>One<br>two\n  three <a href=x>link</a>.<br><p>Last&nbsp;&#233;", ["T", "One two three link.", "Last é"]),
        ("<title>t</title><style>p{}</style><script>var a='<p>no</p>'</script><p>x</p><!-- <p>n</p> --><!-- open", ["x"]),
        ("<header>h</header><nav>n</nav><article>a</article><aside>s</aside><form>f</form><footer>f</footer>", ["a"]),
        ("<article><header><h1>H</h1></header><p>t</p><footer>f</footer><section id=comments>c</section></article>", ["H", "t"]),
        ("<main><h1>H</h1><article><p>t</p></article><p>out</p></main>", ["H", "t"]),
        ("<article><p>t <span class=ad>no</span> u</p><article class=comment>c</article></article>", ["t u"]),
        ("<body class='has-sidebar'><div class='site-footer'>f</div><div id='cookieBanner'>c</div><div class='footnotes'>n</div>", ["n"]),
        ("<form><div class=content><p>a</p></div><input value=v></form>", ["a"]),
        ("<div class=nav-wrap><article>a</article></div>", ["a"]),
        ("<ul><li><a>one</a><li><a>two</a></ul><p>a</p><ul><li>x<li>y</ul>", ["a", "x", "y"]),
        ("<div hidden>h</div><div style='display: none'>i</div><p aria-hidden=true>j</p>k", ["k"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("<p>x < y & 3<4 <a href=\"open>z</p>", ["x < y & 3<4 z"]),
        ("<a href=1><div>in link</div></a>out<svg><text>t</text></svg>side", ["in link", "outside"]),
        ("<app-header>h</app-header><div><p>a</p></div>", ["a"]),
    ],
)
def test_blocks_of_a_page(html, want):
    assert blocks(html) == want


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    deep = blocks("<div>x" * 20_000 + "<p>last")
    assert len(deep) == 20_001 and deep[-1] == "last"
    assert blocks("<p>" + "word " * 300_000) == [("word " * 300_000).strip()]
    assert blocks("<p>a" + "</div>" * 20_000 + "b") == ["a", "b"]
    assert time.time() - began < 60


def site(host, n, seed, article=lambda k, say: "".join(f"<p>{say(30)}</p>" for _ in range(3 + k % 4))):
    """Pages without any mark: a notice and a line that all repeat, and an article of their own."""
    rnd = random.Random(seed)
    say = lambda m: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(m))
    notice, line = say(20), say(4)
    out = []
    for k in range(n):
        inner = article(k, say)
        html = f"<body><div class=x1><div>{notice}</div></div><div class=x2>{inner}</div><div class=x3>{line} <b>2024</b></div></body>"
        out.append((f"https://{host}/p/{k}", html, inner[3:-4].replace("</p><p>", "\n\n")))
    return out


def test_site_style_tree_finds_unmarked_repeats(spark):
    own, few = site("a.example", 30, 1), site("b.example", 3, 2)
    copied = site("c.example", 12, 3, lambda k, say: "<p>the same long article of everyone on this host, word for word, on every page</p><p>its end</p>")
    most = site("d.example", 20, 4, lambda k, say: f"<p>{say(25)}</p>" + "<p>a passage of some</p>" * (k % 3 == 0))
    pages = [(i, url, html, "x", "y", 1) for i, (url, html, _) in enumerate([*own, *few, *copied, *most, *own[:2]])]
    pages += [(None, None, None, None, None, None), (900, None, "<p>no host", "x", "y", 1), (901, "nonsense", own[0][1], "x", "y", 1), (902, "https://a.example/", "", "", "", 0)]
    out = html_text.extract(spark.createDataFrame(pages, SCHEMA).repartition(3)).collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    got = {(r.page_id, r.url): r.text for r in out}
    for i, (url, _, want) in enumerate([*own, *few, *copied, *most, *own[:2]]):
        host = url.split("/")[2]
        if host in ("a.example", "d.example"):
            assert got[i, url] == want  # the notice and the line are gone, passages of a third stay
        elif host == "b.example":
            assert want in got[i, url] and got[i, url] != want  # too few pages to judge
        else:
            assert got[i, url].count("word for word") == 1  # copies are no repetition of the site
    assert got[None, None] == "" and got[900, None] == "no host" and got[902, "https://a.example/"] == ""
    assert own[0][2] in got[901, "nonsense"]
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_importance_is_by_entropy(spark):
    """Equal layout and content have importance 0, layouts and texts of one page each have 1."""
    alike = [(k, f"https://e.example/{k}", f"<div class=a><p>same</p></div><div class=b>{'<p>x%d</p>' % k}{'<h2>y</h2>' * (k > 5)}<p>long text number {k} of this page</p></div>", "", "", 0) for k in range(9)]
    rows = html_text.style_rows(html_text._keyed(spark.createDataFrame(alike, SCHEMA)))
    elements, found = html_text.style_tree(rows)
    elements, found = elements.collect(), found.collect()
    assert {r.pages for r in elements} == {9, 3}  # h2 is on three pages
    assert any(r.styles == 1 and abs(r.presentation) < 1e-9 for r in elements) and any(r.styles == 2 and 0 < r.presentation < 1 for r in elements)
    assert [(r.held, round(r.content, 9)) for r in found if r.held == 9] == [(9, 0.0)]
    assert all(r.held > 2 for r in found)


def test_given_pages(spark):
    """Pages of the tables hold one article element: its blocks, read by a plain definition."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>", " ", p).replace("<b>", "")).split()) for p in re.split(r"</?p>|</?h1>", inner))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_noisy_elements_go_by_composite_importance(spark):
    """Boxes of few texts in turn, none of them on half of the pages, are noise with all below them; an element with texts of its own pages is not."""
    from collections import Counter

    rnd = random.Random(6)
    say = lambda m: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(m))
    turns, pages, want = [say(6) for _ in range(3)], [], {}
    for k in range(60):
        first, second = say(30), say(40)
        box = f"<div class=qa><div class=qb><p>{turns[k % 3]}</p></div><p>{turns[(k + 1) % 3]} too</p></div>"
        pages.append((k, f"https://t.example/{k}", f"<body><div class=xa>{box}</div><div class=xb><p>{first}</p><p>{second}</p></div></body>", "", "", 0))
        want[k] = f"{first}\n\n{second}"
    frame = spark.createDataFrame(pages, SCHEMA)
    rows = html_text.style_rows(html_text._keyed(frame)).cache()
    elements, contents = html_text.style_tree(rows)
    assert contents.where("2 * held > pages").count() == 0
    found = html_text.composite_importance(rows, elements, contents).collect()
    assert Counter(r.most <= html_text.LEAST for r in found) == {True: 5, False: 4}  # xa, qa, qb and two p; the page, body, xb and its p
    assert all(r.most >= r.composite - 1e-12 and r.composite >= 0 for r in found)
    assert {r.page_id: r.text for r in html_text.extract(frame).collect()} == want
