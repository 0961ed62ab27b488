"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one per block element's run of text. A line's
text-to-tag ratio is its characters, links' left out, over the tags met since the line before. The ratios are smoothed with a Gaussian window; lines at or above a threshold (the ratios' standard
deviation, but no more than their mean) cluster into content. The content region is the smallest container that holds
all lines which are content by their own ratio too, and every article with content; if no such line lies outside the
articles, it is the articles with content. A region's lines stay whatever their own ratio, so short paragraphs do.

Tags, roles, classes and ids are features of the ratio. What they strongly hint to be no content (menus, headers,
footers, sidebars, notices, adverts, forms, comments) has the ratio HINTED, which is under every threshold and takes
no part in the smoothing; what they weakly hint at (sharing, related, search) is kept in a region only if its own
ratio reaches the threshold. A class, an id or a form is not believed if it holds the article or the page's main
heading. Scripts and styles are no text.

A null html is an empty one and gives an empty text; so does a page without text. Rows that repeat a page are each
extracted; a null page_id or url is kept. Pages may have any length and nesting, in time linear in both: the parser
holds one page. An empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe object svg canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header hgroup details summary fieldset hr center nav footer aside form menu dialog".split())
CONTAINERS = frozenset("html body main article section div td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
MARKS = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer copyright toolbar skip".split())
#: These may as well name a part of the article.
WEAK = frozenset("share sharing social related recommended recommendations widget search toc".split())
#: An article's own heading, which classes may call a header.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WHOLE = frozenset("html body main article".split()) | HEADINGS
#: Elements that an open p ends at.
ENDS_P = BLOCKS - {"html", "body"}
#: Elements that the next of their kind ends, unless one of these opened since.
ENDED_BY_NEXT = {t: ("ul", "ol", "dl", "table", "select") for t in ("li", "dt", "dd", "tr", "td", "th", "option")}
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

HINTED = -1.0


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """By its tag, its role, or because it is hidden."""
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True
    if tag in WHOLE:
        return False
    return any(name == "role" and value and value.lower().strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


def marks_of(attrs: list[tuple[str, str | None]]) -> set[str]:
    return {w for name, value in attrs if name in ("class", "id") and value for w in WORDS.findall(value.lower())}


@dataclass
class Hint:
    """An element that is no content by its tag or marks. What it holds may show that its marks mislead."""

    parent: int  # the hint it is in, or -1
    weak: bool
    sure: bool  # nothing that it holds clears it
    by_heading: bool = False  # it holds the page's main heading
    by_article: bool = False  # it holds an article


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    tags: int
    container: int
    article: int  # the outermost article it is in, or -1
    hint: int  # the innermost hint it is in, or -1


class Lines(HTMLParser):
    """Collects a page's lines. Containers are numbered as they open, so what a container holds has the numbers from
    its own to its last; `last` and `parent` have them by number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, drops its text, is a container, is a hint
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.blocks: list[int] = []  # places of block elements in the stack
        self.dropped = 0  # open elements that drop their text
        self.hints: list[Hint] = []
        self.open_hints: list[int] = []
        self.judged = [0, 0]  # how many of the open hints are known to hold a heading, an article
        self.links = 0
        self.parent, self.last = [-1], [0]
        self.container = 0
        self.articles: list[int] = []  # containers of the open articles
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            self.lines.append(Line(text, self.linked, self.tags, self.container, self.articles[0] if self.articles else -1, self.open_hints[-1] if self.open_hints else -1))
            self.tags = 0
        self.linked = 0

    def clear(self, kind: int) -> None:
        """What is open holds a heading (0) or an article (1). Those under the count of `judged` are known to."""
        for i in self.open_hints[self.judged[kind] :]:
            if kind:
                self.hints[i].by_article = True
            else:
                self.hints[i].by_heading = True
        self.judged[kind] = len(self.open_hints)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in ENDS_P and self.at["p"] and self.blocks[-1] == self.at["p"][-1]:
            self.end("p")
        if tag in ENDED_BY_NEXT and self.at[tag] and not any(self.at[x] and self.at[x][-1] > self.at[tag][-1] for x in ENDED_BY_NEXT[tag]):
            self.end(tag)
        inside = bool(self.articles)
        marks = marks_of(attrs) if tag not in HEADINGS else set()
        comment = not marks.isdisjoint(COMMENTS) and (tag not in WHOLE or tag == "article")
        if tag in ("main", "article") and not comment and not inside:
            self.clear(1)
        if tag == "h1" and not inside:
            self.clear(0)
        by_tag = is_boilerplate(tag, attrs, inside) or comment
        by_mark = tag not in WHOLE and not (MARKS - {"header", "disclaimer", "copyright"} if inside else MARKS).isdisjoint(marks)
        weak = tag not in WHOLE and not WEAK.isdisjoint(marks)
        hint = by_tag or by_mark or weak or tag == "form"
        drops = tag in SKIPPED
        self.stack.append((tag, drops, tag in CONTAINERS, hint))
        self.at[tag].append(len(self.stack) - 1)
        if tag in BLOCKS:
            self.blocks.append(len(self.stack) - 1)
        if hint:
            self.open_hints.append(len(self.hints))
            self.hints.append(Hint(self.open_hints[-2] if len(self.open_hints) > 1 else -1, weak and not (by_tag or by_mark or tag == "form"), by_tag))
        self.dropped += drops
        self.links += tag == "a"
        if tag in CONTAINERS:
            self.parent.append(self.container)
            self.container = len(self.parent) - 1
            self.last.append(self.container)
            if tag in ("article", "main"):
                self.articles.append(self.container)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # on HTML elements the slash means nothing
        if tag in ("svg", "math", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID and self.at[tag]:
            self.end(tag)

    def end(self, tag: str) -> None:
        """Closes the last open `tag` and what is open in it."""
        until = self.at[tag][-1]
        while len(self.stack) > until:
            name, drops, container, hint = self.stack.pop()
            self.at[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if hint:
                self.open_hints.pop()
                self.judged = [min(n, len(self.open_hints)) for n in self.judged]
            self.dropped -= drops
            self.links -= name == "a"
            if container:
                if name in ("article", "main"):
                    self.articles.pop()
                self.last[self.container] = len(self.parent) - 1
                self.container = self.parent[self.container]

    def finish(self) -> None:
        self.close()
        self.flush()
        while self.stack:
            self.end(self.stack[-1][0])
        self.last[0] = len(self.parent) - 1

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def hinted(self, by_article: bool) -> list[tuple[bool, bool]]:
        """(strongly, weakly) of each hint with those around it. by_article: only an article clears marks."""
        out: list[tuple[bool, bool]] = []
        for h in self.hints:  # a hint comes after the one it is in
            strong, weak = out[h.parent] if h.parent >= 0 else (False, False)
            if h.sure or not (h.by_article or h.by_heading and not by_article):
                strong, weak = strong or not h.weak, weak or h.weak
            out.append((strong, weak))
        return out


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the window is cut and its weights sum to 1."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = [weights[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi])) / sum(w))
    return out


def closed(html: str) -> str:
    """The page with each mark that begins what never ends as a character reference: it is text then, and what
    follows it is read on. Else the parser would look for the end once for each."""
    for begin, end in (("<!--", "--"), ("<![", "]"), ("<", "")):
        cut = html.rfind(f"{end}>") + 1
        html = html[:cut] + html[cut:].replace(begin, f"&lt;{begin[1:]}")
    return html


def threshold(ratios: list[float]) -> float:
    mean = sum(ratios) / len(ratios)
    return min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))


def main_text(html: str, sigma: float = 1.0, bar_of: Callable[[list[float]], float] = threshold) -> str:
    """The content region's lines, joined by an empty line."""
    page = Lines()
    page.feed(closed(html))
    page.finish()
    lines = page.lines
    if not lines:
        return ""
    with_heading, with_article = page.hinted(False), page.hinted(True)
    # Beside an article only what holds an article is not believed.
    some = any(x.article >= 0 and not (x.hint >= 0 and with_heading[x.hint][0]) for x in lines)
    hints = [(False, False) if x.hint < 0 else (with_article if some and x.article < 0 else with_heading)[x.hint] for x in lines]
    own = [HINTED if strong else max(0, len(x.text) - x.linked) / max(1, x.tags) for x, (strong, _) in zip(lines, hints)]
    plain = [i for i, (strong, _) in enumerate(hints) if not strong]
    level = list(own)
    for i, r in zip(plain, smooth([own[i] for i in plain], sigma)):
        level[i] = r
    bar = bar_of([level[i] for i in plain] or [0.0])
    content = [i for i, r in enumerate(level) if r >= bar]
    if not content:
        return ""
    sure = [i for i in content if own[i] >= bar] or content  # not by their neighbours alone
    articles = {lines[i].article for i in content} - {-1}
    outside = [lines[i].container for i in sure if lines[i].article < 0]
    if outside:
        held = outside + [x for a in articles for x in (a, page.last[a])]
        region = min(held)
        while page.last[region] < max(held):
            region = page.parent[region]
    in_region = [region <= x.container <= page.last[region] if outside else x.article in articles for x in lines]
    return "\n\n".join(x.text for x, inside, r, (strong, weak) in zip(lines, in_region, own, hints) if inside and (r >= bar or not (strong or weak)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
