"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines: every block element begins and ends one, and the end of a container (anything larger than a
paragraph) leaves an empty line besides, so parts of the page that are far apart in the tree are far apart in lines. A
line's length is the number of its characters outside links. Text in navigation, headers, footers, sidebars, notices,
adverts, forms and comments, which elements and their class, id and role name, counts nothing and is dropped. Where the page
has an ``article`` or ``main``, lines outside it count nothing, and each line with text inside it counts as a full line at
least, so one short paragraph isn't lost.

The lengths are summed over windows of ``window`` lines. A surge point is a line with text whose window reaches ``surge``
characters (or the page's greatest window, where that is less); the next dive point is where a window's sum falls to zero.
The lines between them are kept, from every surge whose stretch holds at least ``share`` of the longest stretch, with the
links and short lines among them; the stretch of an article that a dropped advert interrupts goes on behind it.

Rows never leave their task: one Arrow pass, no shuffle. Each page takes time in proportion to its length.

Defined results: a null page is an empty one; a page without text, or with boilerplate only, gives an empty text; repeated
rows and null ids are rows like any other; columns other than the three named are ignored; an empty table gives no rows. Of
two stretches of equal length both are kept. Broken markup is read as browsers do where that is simple: an end tag closes
the nearest open element of its name, an end tag without one is ignored, paragraphs, list items and cells end where the
next begins, a script without an end takes the rest of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import slices

# Elements of HTML by their part in a page.
RAW = frozenset("script style title noscript iframe noframes noembed xmp textarea template svg math object".split())
DROPPED = frozenset("nav footer aside form select button dialog menu datalist fieldset".split())
MAIN = frozenset("article main".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption summary pre blockquote hr option legend".split())
CONTAINERS = frozenset("html head body div section article main header footer nav aside form ul ol dl table thead tbody tfoot figure details address center fieldset hgroup menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that name what surrounds an article.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager toc masthead banner footer colophon sidebar aside widget widgets complementary contentinfo "
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert alerts dialog alertdialog disclaimer copyright legal popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments commentlist disqus respond reply replies responses share sharing social related recommended recommendations teaser teasers outbrain taboola".split()
)
CONTENT = frozenset("article content main post entry story body text page wrapper container layout".split())
# Opening an element of the first column ends an open one of the second, unless one of the third opened since.
ENDS = {
    **{t: (("p",), ("td", "th", "li", "div", "section", "article", "aside")) for t in PARAGRAPHS | CONTAINERS},
    "li": (("li", "p"), ("ul", "ol", "menu")),
    **{t: (("dt", "dd", "p"), ("dl",)) for t in ("dt", "dd")},
    **{t: (("td", "th", "p"), ("table",)) for t in ("td", "th")},
    "tr": (("tr", "td", "th", "p"), ("table",)),
}
_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_ATTRIBUTES = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')|=(?!\s*+["']))*+)>""")
_SIMPLE = re.compile(r"([^>]*)>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_boilerplate(attributes: str, outside: bool) -> bool:
    """Whether class, id or role name a part that isn't the article; a header only ``outside`` of one. A name like has-sidebar speaks of another part."""
    for kind, *values in _NAMED.findall(attributes):
        for token in "".join(values).split():
            words = [w.lower() for w in _WORD.findall(token)]
            if not words or words[0] in ("has", "with", "no", "without", "is", "not"):
                continue
            if BOILERPLATE.intersection((words[0], words[-1])) or CONTENT.isdisjoint(words) and (not BOILERPLATE.isdisjoint(words) or outside and words[-1] == "header"):
                return True
    return False


class _Page:
    """Lines of one page: text, length outside links, element that each stands in."""

    def __init__(self, html: str) -> None:
        self.parts: list[str] = []  # of the line being read
        self.linked = 0
        self.lines: list[tuple[str, int, int]] = []
        # by element: its parent, whether it is an article, whether it names a dropped part, whether it holds the article
        self.parent, self.main, self.named, self.holds = [-1], [False], [False], [False]
        self.names: list[str] = []  # of the open elements, with their numbers and by name their places
        self.nodes = [0]
        self.open: dict[str, list[int]] = {}
        self.articles = False
        self.read(html)

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(unescape(raw) if "&" in raw else raw)
            if self.open.get("a"):
                self.linked += len("".join(self.parts[-1].split()))

    def end_line(self, gap: bool = False) -> None:
        words = "".join(self.parts).split()
        if words:
            self.lines.append((" ".join(words), max(0, sum(map(len, words)) - self.linked), self.nodes[-1]))
        self.parts, self.linked = [], 0
        if gap:
            self.lines.append(("", 0, 0))

    def start(self, name: str, attributes: str) -> None:
        over, scope = ENDS.get(name, ((), ()))
        limit = max((self.open[s][-1] for s in scope if self.open.get(s)), default=-1)
        for x in over:
            if self.open.get(x) and self.open[x][-1] > limit:
                self.close(self.open[x][-1])
        if name in VOID:
            return
        outside = not any(self.open.get(m) for m in MAIN)
        hint = name not in ("html", "body") and "=" in attributes and is_boilerplate(attributes, outside)
        main = name in MAIN and not hint
        self.articles |= main
        if main:
            self.hold(self.nodes[-1])
        elif name == "h1" and self.open.get("form"):  # a form around the whole page
            self.holds[self.nodes[self.open["form"][0] + 1]] = True
        self.parent.append(self.nodes[-1])
        self.main.append(main)
        self.named.append(hint or name in DROPPED or name == "header" and outside)
        self.holds.append(False)
        self.open.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(len(self.parent) - 1)

    def hold(self, node: int) -> None:
        while node > 0 and not self.holds[node]:
            self.holds[node] = True
            node = self.parent[node]

    def close(self, at: int) -> None:
        while len(self.names) > at:
            self.open[self.names.pop()].pop()
            self.nodes.pop()

    def read(self, html: str) -> None:
        at, inner = 0, _ATTRIBUTES
        while m := _OPENING.search(html, at):
            self.text(html[at : m.start()])
            name = (m[4] or "").lower()
            if not name:
                end = _COMMENT_END.search(html, m.end()) if m[1] else _SIMPLE.match(html, m.end())
                at = end.end() if end else len(html)
                continue
            rest = inner.match(html, m.end())
            if not rest:  # a quote that nothing closes: from here on a tag ends at the next >
                inner = _SIMPLE
                rest = inner.match(html, m.end())
            if not rest:  # cut off within a tag
                at = len(html)
                break
            at, attributes = rest.end(), rest[1]
            if name in PARAGRAPHS or name in CONTAINERS:
                self.end_line(gap=name in CONTAINERS)
            elif name == "br":
                self.parts.append(" ")
            if m[3]:
                if self.open.get(name):
                    self.close(self.open[name][-1])
            elif name not in RAW:
                self.start(name, attributes)
            elif not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
        self.text(html[at:])
        self.end_line()

    def weighed(self, full: int) -> tuple[list[str], np.ndarray]:
        """The lines that aren't dropped, with their lengths."""
        gone, inside = [False], [False]
        for p, main, named, holds in zip(self.parent[1:], self.main[1:], self.named[1:], self.holds[1:], strict=True):
            gone.append(gone[p] or named and not holds)
            inside.append(inside[p] or main)
        texts, lengths = [], []
        for text, weight, node in self.lines:
            if gone[node]:
                continue
            texts.append(text)
            lengths.append(0 if not text else weight if not self.articles else max(weight, full) if inside[node] else 0)
        return texts, np.array(lengths, np.int64)


def kept_lines(lengths: np.ndarray, window: int = 3, surge: int = 80, share: float = 0.2) -> np.ndarray:
    """Whether each line lies between a surge and the dive after it."""
    n = len(lengths)
    kept = np.zeros(n, bool)
    if not n or not lengths.any():
        return kept
    total = np.append(0, np.cumsum(lengths))
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    rising = np.flatnonzero((sums >= min(surge, int(sums.max()))) & (lengths > 0))
    low = np.append(np.flatnonzero(sums == 0), n)
    stretches, k = [], 0
    while k < len(rising):
        start = int(rising[k])
        end = int(low[np.searchsorted(low, start)])
        stretches.append((start, end, int(total[end] - total[start])))
        k = np.searchsorted(rising, end)
    most = max(s[2] for s in stretches)
    for start, end, mass in stretches:
        kept[start:end] = mass >= share * most
    return kept


def main_text(html: str, window: int = 3, surge: int = 80, share: float = 0.2) -> str:
    page = _Page(html)
    texts, lengths = page.weighed(surge)
    if page.articles:
        share = 0.0  # the page itself says where its article is
    kept = kept_lines(lengths, window, surge, share)
    if page.articles:
        kept &= lengths > 0
    return " ".join(t for t, k in zip(texts, kept, strict=True) if k and t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 80, share: float = 0.2) -> DataFrame:
    """(id, url, text, n_chars) of every row of pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [main_text(h.as_py() or "", window, surge, share) for h in batch.column("html")]
            out = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
