"""Main text of pages: hand-made pages, the tables' pages against a plain reading of their articles, broken and awkward ones."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from claimspark.llm import mainhtml, queries
from claimspark.llm.mainhtml import kept_lines, main_text

PROSE = "A sentence of the story that is long enough to make a line with weight in the distribution of text over lines"


def article(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p><p>no';</script></head><body class='has-sidebar'>{body}{extra}</body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>Hello &amp; good&nbsp;bye<br>now</p>", "Hello & good bye now"),
        ("<article><p>a<b>b</b>c &lt;p&gt; &amp;amp; &#233;</p></article>", "abc <p> &amp; é"),
        ("<nav><a href=x>Home</a></nav><article><h1>One</h1><p>Of.</article><footer>&copy; us</footer>", "One Of."),
        ("<article><header><h1>Title</h1></header><p>Text</p><aside>side</aside><p>more</p><footer>tags</footer></article>", "Title Text more"),
        ("<header><h1>Site</h1></header><main><h1>Title</h1><div class='ad-box'>buy</div><p>Text</p></main>", "Title Text"),
        ("<main><article><p>Story</p></article><section id=comments><article class='comment'><p>I disagree</p></article></section></main>", "Story"),
        ("<form action=/><div class=sidebar>x</div><article><p>Story</p></article><select><option>1</select></form>", "Story"),
        ("<div class='cookie-notice'>We use cookies</div><article><p>Story<div class=newsletter><form>mail <input></form></div><p>End</article>", "Story End"),
        ("<article><p>before <!-- <p>hidden --> after <style>p{}</style>x <svg><text>no</text></svg></p></article>", "before after x"),
        ("<article><ul><li>one<li>two<li class=share>tweet<li>three</ul><table><tr><td>a<td>b</table></article>", "one two three a b"),
        ("<article><p class=ad>buy<p>keep</article>", "keep"),
        ('<article><p title="a > b">x</p><a href="/menu">link</a> y</article>', "x link y"),
        ("<article><p>1 < 2 and a <b c> d", "1 < 2 and a d"),
        ("<article>x</article><script>never closed <p>y", "x"),
        ("<nav>only a menu</nav>", ""),
        ("</div></p><article></b>x</article>", "x"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_a_page_without_article_is_cut_at_surge_and_dive():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>section {i}</a></li>" for i in range(9)) + "</ul></div>"
    story = "<div><div><h2>Headline</h2>" + "".join(f"<p>{PROSE} {i}.</p>" for i in range(6)) + "<p>Short end.</p></div></div>"
    side = "<div><div><p>Weather: rain</p></div></div><div><div><p>Imprint</p></div></div>"
    assert main_text(article(menu + story + side)) == " ".join(["Headline", *(f"{PROSE} {i}." for i in range(6)), "Short end."])


def test_an_advert_within_the_story_does_not_end_it():
    body = f"<div>{''.join(f'<p>{PROSE} {i}</p>' for i in range(4))}<div class='advert'><p>{PROSE} BUY</p></div>{''.join(f'<p>{PROSE} {i}</p>' for i in range(4, 8))}</div>"
    assert main_text(article(body)) == " ".join(f"{PROSE} {i}" for i in range(8))


def test_lines_by_definition():
    rng = np.random.default_rng(7)
    for _ in range(300):
        lengths = np.where(rng.random(rng.integers(0, 40)) < 0.5, 0, rng.integers(0, 90, 1)[0] + rng.integers(0, 60))
        sums = [int(lengths[i : i + 3].sum()) for i in range(len(lengths))]
        least, stretches, start = min(80, max(sums, default=0)), [], None
        for i, s in enumerate(sums):
            if start is None and s >= least and lengths[i] > 0:
                start = i
            if start is not None and s == 0:
                stretches.append((start, i))
                start = None
        if start is not None:
            stretches.append((start, len(lengths)))
        most = max((int(lengths[a:b].sum()) for a, b in stretches), default=0)
        want = np.zeros(len(lengths), bool)
        for a, b in stretches:
            want[a:b] = lengths[a:b].sum() >= 0.2 * most
        assert (kept_lines(lengths) == want).all()


def test_time_grows_with_length_only():
    import time

    for page in ("<div>" * 100_000 + "x", "<p>" * 200_000, "<b>" * 200_000 + "</i>" * 200_000, "<a href='" * 50_000, "<!--" * 100_000, "<form><h1>x</h1>" * 30_000, "<" * 300_000, "<script>" * 50_000):
        start = time.time()
        main_text(page)
        assert time.time() - start < 10, page[:20]


def test_every_page_of_the_table(spark, sf):
    got = {r.page_id: r for r in queries.op13_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<br>|</?(?:p|h1)>", inner))
        want = " ".join(b for b in blocks if b)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def test_awkward_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("a.b", T.StringType())])
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, None, None, "t", "q"), (2, "u", "", None, None), (None, "u", "<p>x", None, None), (3, "u", long, None, None), (3, "u", long, None, None), (4, "u", "<p>𝒳𝒳", None, None)]
    got = sorted(mainhtml.extract(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [(r.id, len(r.text), r.n_chars) for r in got if r.id in (1, 2, 4)] == [(1, 0, 0), (2, 0, 0), (4, 2, 2)]
    assert [r.text for r in got if r.id is None] == ["x"] and [r.n_chars for r in got if r.id == 3] == [249_999, 249_999]
    empty = mainhtml.extract(spark.createDataFrame([], schema))
    assert empty.columns == ["id", "url", "text", "n_chars"] and empty.count() == 0
