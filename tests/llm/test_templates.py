"""Template deduction: hosts with and without marked articles, copies, broken pages."""

import html as entities
import random
import re

import pytest

from lodeframe.llm import markup, queries, templates
from tests.conftest import TESTDATA

PAGES = "page_id long, url string, html string, site long, role string, text int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def alone(html):
    return markup.main_text(markup.read_page(html), set(), set(), {})


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h, 1, "r", 2) for i, (u, h) in enumerate(pages)], PAGES).repartition(3)
    out = templates.extract(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(out.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and [r["url"] for r in rows] == [u for u, _ in pages]
    return [r["text"] for r in rows]


def test_whole_table_gives_the_articles(spark):
    """Brute force: what stands in the article element, tags removed."""
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet").toPandas()
    ours = queries.op11_html(spark, TESTDATA).toPandas().set_index("page_id")["text"]
    for page_id, html in zip(pages["page_id"], pages["html"]):
        body = re.search(r"(?s)<article>(.*?)</article>", html)[1]
        want = " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        assert ours[page_id] == want


def soup(rng, k):
    """A page without any telling tag or name, and its article."""
    title, paragraphs = words(rng, 5), [words(rng, rng.randint(15, 60)) for _ in range(rng.randint(1, 6))]
    page = (
        f"<html><head><title>{title}</title></head><body><div class='a1'><div>The Daily Something</div><div><a href='/'>Home</a> <a href='/x'>World {rng.randint(1, 9)}</a></div></div>"
        f"<div class='b2'><div id='c3'><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class='q7'>Did you like this <a href='/s{k}'>story</a>?</div></div>"
        f"<div class='d4'>{words(rng, 4)}</div></div><div class='e5'>All rights reserved {rng.randint(1900, 2100)}</div></body></html>"
    )
    return page, " ".join([title, *paragraphs])


@pytest.mark.parametrize("n", [5, 40])
def test_template_of_a_host_without_marked_articles(spark, n):
    rng = random.Random(n)
    made = [soup(rng, k) for k in range(n)]
    assert texts(spark, [(f"http://soup.example/{k}", page) for k, (page, _) in enumerate(made)]) == [text for _, text in made]


def test_constant_text_goes_and_copies_of_an_article_stay(spark):
    rng = random.Random(3)
    line = words(rng, 30)
    page = lambda body: f"<body><article><p>{body}</p><div class='k'>Read more of our stories</div><p>{line}</p></article></body>"
    bodies = [words(rng, 50) for _ in range(6)]
    pages = [(f"http://a.example/{k}", page(b)) for k, b in enumerate(bodies)]
    pages += [(f"http://copies.example/{k}", page(bodies[0])) for k in range(30)]
    out = texts(spark, pages)
    assert out[:6] == [f"{b} {line}" for b in bodies]  # a line that all articles share is text: its role says more
    assert out[6:] == [f"{bodies[0]} Read more of our stories {line}"] * 30  # one content is no template


def test_named_parts_go(spark):
    sides = [
        "<nav><ul><li><a>Menu</a></ul></nav>", "<header><p>Site</p></header>", "<footer>&copy; x</footer>", "<aside>side</aside>", "<div class='cookie-notice'>we use cookies</div>", "<div id='adTop'>buy</div>",
        "<form><label>mail</label><input></form>", "<script>var a='<p>no</p>';</script>", "<style>p{}</style>", "<section class='comments'><p>first!</p></section>", "<!-- <p>no</p> -->", "<div role='banner'>top</div>",
    ]
    for side in sides:
        for page in (f"<body>{side}<article><h1>T</h1><p>text</p></article></body>", f"<body><main><h1>T</h1><p>text</p>{side}</main></body>", f"<body>{side}<div class='story'><h1>T</h1><p>text</p></div></body>"):
            assert alone(page) == "T text", page
    assert alone("<article><header><h1>T</h1><p>by X</p></header><p>text</p></article>") == "T text"
    assert alone("<form class='page'><div class='has-sidebar'><article>text</article></div></form>") == "text"


def test_names_that_mislead():
    assert alone("<body><div class='content no-sidebar ad-free'><h1>T</h1><p>a text that is longer than the rest</p></div><div class='sidebar'>x</div></body>") == "T a text that is longer than the rest"
    assert alone("<main><article><h1>T</h1><p>text</p></article><article class='comment'><p>a comment longer than the text</p></article></main>") == "T text"
    assert alone("<main><h1>T</h1><article><p>text</p></article><aside>x</aside></main>") == "T text"
    assert alone("<body><div><h1>The Site</h1></div><article><p>text</p></article></body>") == "text"
    assert alone("<article><p>one</p><button>click<p>two</p></article>") == "one click two" and alone("<article><p>one</p><button>click</button><p>two</p></article>") == "one two"


def test_characters_and_white_space():
    assert alone("<p>a&amp;b &#233;&#x1F600; &am &amp c&nbsp;d &lt;p&gt;</p>") == "a&b é😀 &am & c d <p>"
    assert alone("<p>one\n\t two<b>th</b>ree<br>four<p>five<li>six<td>seven</td>") == "one twothree four five six seven"
    assert alone("x < y and 1<2 <p>z") == "x < y and 1<2 z"
    assert alone("<p title='a>b' class=\"c>d\">text</p><p") == "text" and alone("<p>text<a href='open") == "text"
    assert alone("plain text") == "plain text" and alone("") == "" and alone(None) == "" and alone("<p> &nbsp; </p>") == ""


def test_hard_inputs(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 3
    long = "<article>" + "<p>word &amp; word</p>" * 40_000 + "</article>"
    pages = [(None, "<article>a</article>"), ("no scheme", None), ("http://h/1", ""), ("http://h/1", deep), ("http://h/2", long), ("http://h/2", long), ("http://h/3", "<nav>only</nav>")]
    out = texts(spark, pages)
    assert out[:4] == ["a", "", "", "deep text"] and out[4] == out[5] == " ".join(["word & word"] * 40_000) and out[6] == ""
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_of_different_order_are_no_template(spark):
    rng = random.Random(9)
    a, b = "<div class='x'>One of two</div>", "<div class='y'>Two of two</div>"
    pages = [(f"http://o.example/{k}", f"<body><article>{a + b if k % 2 else b + a}<p>{words(rng, 20)}</p></article></body>") for k in range(8)]
    frame = spark.createDataFrame([(i, u, h, 1, "r", 2) for i, (u, h) in enumerate(pages)], PAGES)
    assert all(("One of two" in t) == ("Two of two" in t) for t in texts(spark, pages))
    (row,) = templates.deduce(frame).collect()
    assert not row["constant"]
