import collections
import random

import pytest

from tonelake.llm import pages
from tonelake.llm.pages import extract_pages, parse


def texts(html):
    return [text for text, stays, _ in parse(html)[0] if stays]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p>a<p>b &amp c&nbsp; d<br>e<div>x <i>y</i>z</div><ul><li>1<li>2</ul>", ["a", "b & c d e", "x yz", "1", "2"]),
        ("<body><div class='cookie-notice'>no</div><div id=main><p>yes &#39;s</div><div class=sidebar>no</div><section id=comments>no</section></body>", ["yes 's"]),
        ("<main><header><h1>T</h1></header><p>x</p><article><p>in</p><article>comment</article></article><form>no</form></main><footer>no</footer>", ["T", "x", "in"]),
        ("", []), ("<", ["<"]), ("a < b", ["a < b"]), ("no markup\n at all", ["no markup at all"]),
        ("<script>if(a<b)'</p>'</script>x<p title='a>b'>y</p><!-- z", ["x", "y"]),
        ("<style>p{}</style><noscript>n</noscript><p>t</p><script>never closed", ["t"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<nav><a>menu</a></nav><article><p>one</p><aside>no</aside><p>two</p></article><p>outside</p>", ["one", "two"]),
        ("<p>un<b>closed <a href=\"x>y", ["unclosed"]),
        ("<article><p>t</article></div></p></article>", ["t"]),
        ("<title>no</title><h1>H</h1><p>caf&eacute; &lt;b&gt; &#x1F600;</p>", ["H", "café <b> 😀"]),
        ("<div hidden>no</div><div class=adBanner>no</div><div class=shadow>yes</div>", ["yes"]),
    ],
)
def test_blocks(html, blocks):
    assert texts(html) == blocks


def test_long_and_deep():
    assert texts("<p>" + "word " * 200_000) == [("word " * 200_000).strip()]
    assert texts("<div>" * 900 + "x" + "</div>" * 900) == ["x"]
    # memory and time in proportion to the depth
    blocks, codes, above = parse("<div>a" * 50_000 + "</b></article>" * 1000)
    assert len(blocks) == len(codes) == len(above) == 50_000 and above == list(range(-1, 49_999)) and [b[2] for b in blocks] == list(range(50_000))


def page(i, body):
    return f"<html><head><title>t{i}</title></head><body><div class=x1><b>Welcome to our site</b> <i>since 1999</i></div><div class=x2><p>{body}</p></div><div class=x3>All rights kept, call us</div></body></html>"


def test_template_of_a_host_goes(spark):
    rows = [(i, f"http://a.example/p{i}", page(i, f"story number {i} of many"), 1) for i in range(40)]
    rows += [(100 + i, f"http://b{i}.example/", page(i, f"lonely {i}"), 1) for i in range(5)]
    rows += [(200, "http://a.example/x", page(0, "story number 0 of many"), 1), (201, None, None, 1), (202, "http://a.example/e", "", 1), (None, "odd url", "<p>t</p>", 1), (201, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [(r.page_id, r.text) for r in extract_pages(df).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    for i in range(40):
        assert by[i] == f"story number {i} of many"
    # a host of few pages shows no template
    assert by[100] == "Welcome to our site since 1999\nlonely 0\nAll rights kept, call us"
    assert by[200] == "story number 0 of many" and by[201] == "" and by[202] == "" and by[None] == "t"
    assert extract_pages(df.limit(0)).count() == 0


def test_prose_of_an_article_stays_however_often_it_recurs(spark):
    rows = [(i, "https://u:p@A.example:8080/?q", f"<nav><a>n</a></nav><article><p>The same line.</p><p>own {i % 3}</p><ul><li><a>more</a></li><li><a>links</a></li></ul></article>") for i in range(30)]
    got = {r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"The same line.\nown {k}" for k in range(3)}


def test_template_share_is_the_same_on_a_large_host(spark):
    # 24 of 600 pages are 4 %, 30 are 5 %
    def lines(i):
        return ["A common heading"] * (i < 24) + ["A site notice"] * (i >= 570) + [f"own text {i}"]

    rows = [(i, "http://large.example/", "".join(f"<p>{x}</p>" for x in lines(i))) for i in range(600)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(x for x in lines(i) if x != "A site notice") for i in range(600)}


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_host_counts_decide_like_brute_force(spark, monkeypatch, rows):
    # nothing in the markup tells the boxes apart: only how many pages of the host hold them
    monkeypatch.setattr(pages, "TEMPLATE_ROWS", rows)
    r = random.Random(4)
    table = []
    for host, n in (("a.example", 90), ("b.example", 30), ("c.example", 4), ("d.example", 2)):
        boxes = {f"{host} box {k} in {share}": share for k, share in enumerate([0.9, 0.5, 0.12, 0.06, 0.04, 0.02, 0.02])}
        for i in range(n):
            lines = [b for b, share in boxes.items() if r.random() < share] + [f"own line {host} {i} {j}" for j in range(3)]
            r.shuffle(lines)
            table.append((len(table), f"https://{host}/{i}", host, lines))
    pages_of, holds = collections.Counter(h for _, _, h, _ in table), collections.Counter((h, x) for _, _, h, lines in table for x in set(lines))
    template = {k for k, n in holds.items() if n >= 3 and n >= 0.05 * pages_of[k[0]]}
    assert len(template) > 5
    df = spark.createDataFrame([(i, u, "<body>" + "".join(f"<div><span>{x}</span></div>" for x in lines) + "</body>") for i, u, _, lines in table], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert got == {i: "\n".join(x for x in lines if (h, x) not in template) for i, _, h, lines in table}


def test_template_goes_without_telling_markup(spark, monkeypatch):
    # with all knowledge of element and class names taken away, counts alone find menus, adverts and footers
    monkeypatch.setattr(pages, "DROPPED", frozenset())
    monkeypatch.setattr(pages, "MARKS", frozenset())
    monkeypatch.setattr(pages, "CONTENT", frozenset())
    html = "<nav><ul><li><a>home</a></li><li><a>news</a></li></ul></nav><div class=ad>buy {ad}</div><article><h1>Title {i}</h1><p>story {i}</p></article><footer>&copy; example</footer>"
    df = spark.createDataFrame([(i, "http://x.example/", html.format(i=i, ad=i % 4)) for i in range(40)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == {i: f"Title {i}\nstory {i}" for i in range(40)}
