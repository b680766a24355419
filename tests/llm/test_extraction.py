"""Main text of pages: cases by hand, the scan against all runs, and held-out pages against what they mark themselves."""

import html
import random
import re
import time

import pytest

from lendlens.llm import extraction, queries
from lendlens.llm.extraction import Weights, best_run, main_text

SF_DIR = "/root/testdata/sf0.01"
PLAIN = Weights()

ARTICLE = "<article><h1>A title here</h1><p>First words of it, <b>bold</b>ly.</p><p>Second &amp; last.</p></article>"
TEXT = "A title here First words of it, boldly. Second & last."


def marked(page: str) -> str:
    """What stands in a page's article, by a plain cut."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)
    text = re.sub(r"</?(?:a|b|i|em|strong)(?:\s[^>]*)?>", "", found.group(1)) if found else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<!DOCTYPE html><html><head><title>Of the page</title><style>p > a {{}}</style></head><body>{}</body></html>",
        "<head><title>No end of the head<meta name=x></title><body>{}",
        "<body><nav><ul><li><a href='/'>Home</a><li><a href='/x'>About us and more</a></ul></nav>{}<footer>&copy; all of the rights are ours</footer>",
        "<header><p>The name of the site</p></header>{}<aside>On the side of it there are some words</aside>",
        "<div class='ad'>Buy now and here for little</div>{}<div id=comments><p>I liked it a lot</p><p>So did I</p></div>",
        "<div class=\"cookie-notice\">We have cookies > biscuits</div><div id='wrapper'><div class='page'>{}</div></div>",
        "<script>var t = '</p><p>some words of code';</script>{}<script>never closed",
        "<form><label>Your name</label><input value='a>b'><textarea>words</textarea><button>Send it</button></form>{}",
        "<!-- <p>words in a comment</p> -->{}<!-- not closed <p>some more words",
        "<section class='related'><h2>More to read</h2><article class=teaser><p>Another story</p></article></section>{}",
        "<nav><div><div><p>Deep in the menu, words</p></div></div></nav>{}",
    ],
)
def test_what_is_left_out(around):
    assert main_text(around.format(ARTICLE), PLAIN) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   \n", ""),
        ("<nav>only a menu</nav>", ""),
        ("<p></p><br>", ""),
        ("plain words", "plain words"),
        ("a < b and 3 > 2 &lt;p&gt;", "a < b and 3 > 2 <p>"),
        ("<p>cut off in a tag <a href='x", "cut off in a tag"),
        ("<p>one<br>two</p>three<div>four</div>", "one two three four"),
        ("<p>f<i>oo</i>b<!-- x -->ar</p>", "foobar"),
        ("<p>a&nbsp;b &#65;&#x42;&eacute;&am; &amp &quot;</p>", 'a b ABé&am; & "'),
        ("<p>\t a \n\n b\r\n</p>", "a b"),
        ("<P CLASS=x>Upper</P></div></nav>", "Upper"),
        ("<article><ul><li>one item</li><li>two items</li></ul></article>", "one item two items"),
        ("<article><header><h1>Own title</h1></header><p>words of it</p><footer>filed under x</footer></article>", "Own title words of it"),
        ("<article><p>before it</p><div class='ad'>buy</div><p>after it is over</p></article>", "before it after it is over"),
        ("<article><p>before it</p><nav><a>x</a></nav><script>y()</script><p>after it is over</p></article>", "before it after it is over"),
        ("<p title='it is > that' alt=\"x\">words</p>", "words"),
        ("<p title=don't>words it's</p>", "words it's"),
        ("<p title='never closed>words", "words"),
        ("<svg><text>drawn</text></svg><p>written</p>", "written"),
    ],
)
def test_pages_by_hand(page, text):
    assert main_text(page, PLAIN) == text


def test_the_scan_finds_the_best_run():
    rng = random.Random(1)
    for n in range(0, 40):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(n)]
        runs = [(-sum(scores[a:b]), a) for a in range(n) for b in range(a + 1, n + 1)]
        start, stop = best_run(scores)
        least = min(runs, default=(0, 0))[0]
        assert sum(scores[start:stop]) == max(0.0, -least)
    assert best_run([1.0, -5.0, 1.0]) == (0, 1)
    assert best_run([]) == best_run([-1.0]) == (0, 0)


def test_weights_come_from_labelled_pages(spark):
    """A name that no list has is known for boilerplate once labelled pages show it."""
    page = "<html><body><div class='xyz'>Many words that are not of the article, {0}</div><article><p>Of it {0}</p></article></body></html>"
    other = "<html><body><div class='xyz'>Many words that are not of the article</div><div><p>These are it</p></div></body></html>"
    rows = [(i, "u", page.format(i)) for i in range(20)] + [(99, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = extraction.learn(pages)
    assert weights.elements["div xyz"] == (0, 20)
    assert weights.elements["article"] == (20, 0)
    found = {r.page_id: r.text for r in extraction.report(pages).collect()}
    assert found[99] == "These are it"
    assert found[7] == "Of it 7"
    assert main_text(other, PLAIN).startswith("Many words")


def test_tags_are_negative_and_words_positive():
    weights = Weights(tags={"p": (100, 0), "td": (0, 100), "b": (50, 50)})
    assert weights.tag("p") == -extraction.TAG and weights.tag("unseen") == -extraction.TAG
    assert weights.tag("td") == -extraction.MOST


def test_rows_and_columns(spark):
    rows = [(1, "a", None), (2, None, ""), (None, "c", ARTICLE), (4, "d", ARTICLE), (4, "d", ARTICLE), (5, "e", "<p>ünï ✓ 𝄞</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "1 AS n_chars", "'k' AS key", "'k' AS kind", "1 AS content", "2 AS other", "3 AS pages"
    )
    found = extraction.report(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, found.collect()), key=repr)
    own = "A title here First words of it, boldly. Second & last."
    wanted = [(1, "a", "", 0), (2, None, "", 0), (None, "c", own, len(own)), *[(4, "d", own, len(own))] * 2, (5, "e", "ünï ✓ 𝄞", 7)]
    assert got == sorted(wanted, key=repr)


def test_an_empty_table(spark):
    assert extraction.report(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "page",
    ["<div>" * 30000 + "words", "<a '" * 30000, '<a ="' * 30001, "<" * 60000, "<!--" * 30000, "<script>" * 30000, "&" * 60000, "</p" * 30000],
)
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    main_text(page, PLAIN)
    extraction.evidence(iter([page]))
    assert time.perf_counter() - start < 5


def test_a_page_longer_than_a_batch(spark):
    long = "<article>" + "<p>words of a long page</p>" * (extraction.BATCH_BYTES // 20) + "</article><footer>the end</footer>"
    pages = spark.createDataFrame([(1, "a", long), (2, "b", ARTICLE)], "page_id long, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in extraction.report(pages).collect()}
    assert found == {1: marked(long), 2: TEXT}


def test_held_out_pages(spark):
    """Weights of half of the pages, on the other half with their marks of the article taken away."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    weights = extraction.learn(pages.where("page_id % 2 = 0"))
    rest = pages.where("page_id % 2 = 1").collect()
    right = 0
    for r in rest:
        bare = re.sub("<(/?)article>", r"<\1div>", r.html)
        right += main_text(bare, weights) == marked(r.html)
    assert right >= 0.99 * len(rest)


def test_the_query_on_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.QUERIES["op11_extraction"](spark, SF_DIR).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == marked(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
