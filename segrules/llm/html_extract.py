"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser cuts a page into lines, one per
block of text.  Each line has the ratio of its text to its tags; the ratios
are smoothed along the page, and a threshold separates content lines from
the rest.  Where the content lines are decides on the content region: the articles or mains that hold most of them,
or else the lowest container that holds all of them and the heading before them.  All its lines that no boilerplate
element holds are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import pick

# How elements are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math head iframe object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside button select option textarea fieldset dialog menu label input".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset("article main section div td body html".split())
ENDS_P = BLOCK - {"html", "body", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-?bar|aside|"
    r"footer|foot|masthead|topbar|toolbar|comments?|commentlist|comment-\w+|disqus|replies|respond|notices?|cookies?|cookie-\w+|consent|gdpr|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|related|recommend\w*|share|sharing|social|widget|pagination|pager|"
    r"skip|skip-link|hidden|copyright|legal|disclaimer|alert|toast)(?:$|[\s_-])",
    re.IGNORECASE,
)
WHOLE_NAME = re.compile(r"[A-Za-z]+[0-9]*|comment[_-]\w+|(?:cookie|skip|side)[_-]\w+|sign-up")  # an id of one word, or a usual pair
HEADER_NAMES = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
LAYOUT_NAMES = re.compile(r"\b(?:has|with|no)-[\w-]+", re.IGNORECASE)  # "with-sidebar" names a layout, not a sidebar
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    tags: int  # tags met in the line, its own included
    region: int  # number of the innermost region element around it, or -1
    good: bool  # not inside a boilerplate element
    heading: bool
    prose: bool  # in a paragraph or heading
    title: bool  # in a heading of the first rank
    form: int  # number of the form around it, or -1


class _Lines(HTMLParser):
    """Cuts a page into lines and notes the elements around each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names: list[str] = []  # of the region elements, by number
        self.parents: list[int] = []  # the number of the region element around each, or -1
        self.open_tags: Counter[str] = Counter()
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, hides text, is boilerplate, region number or -1
        self.text: list[str] = []
        self.tags = 0
        self.hidden = self.bad = 0
        self.region = -1
        self.forms = 0  # met so far

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            heading = any(self.open_tags[t] for t in HEADINGS)
            prose, title = heading or self.open_tags["p"] > 0, self.open_tags["h1"] > 0
            form = self.forms if self.open_tags["form"] else -1
            self.lines.append(Line(text, self.tags + 1, self.region, not self.bad, heading, prose, title, form))
            self.tags = 0

    def open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got = dict(attrs)
        hides = tag in UNSEEN or "hidden" in got or "display:none" in (got.get("style") or "").replace(" ", "").lower()
        inside = self.open_tags["article"] or self.open_tags["main"]  # a header in there belongs to the article
        bad = tag in BOILERPLATE or (got.get("role") or "").lower() in BAD_ROLES or (got.get("aria-hidden") or "").lower() == "true"
        bad = bad or (tag == "header" and not inside)
        if not bad and tag not in ("html", "body", "main") and tag not in HEADINGS:
            # Ids of parts of an article are often their titles: there only a whole id counts, and none of a paragraph.
            by_id = got.get("id") or ""
            if tag == "p" or (inside and not WHOLE_NAME.fullmatch(by_id)):
                by_id = ""
            names = LAYOUT_NAMES.sub("", f"{got.get('class') or ''} {by_id}")
            bad = bool(BAD_NAMES.search(names) or (not inside and HEADER_NAMES.search(names)))
        number = -1
        if tag in REGION:
            number = len(self.names)
            self.names.append(tag)
            self.parents.append(self.region)
            self.region = number
        self.stack.append((tag, hides, bad, number))
        self.forms += tag == "form" and not self.open_tags[tag]
        self.open_tags[tag] += 1
        self.hidden += hides
        self.bad += bad

    def close_top(self) -> None:
        tag, hides, bad, number = self.stack.pop()
        self.open_tags[tag] -= 1
        self.hidden -= hides
        self.bad -= bad
        if number >= 0:
            self.region = self.parents[number]

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # a head left open ends here
            while self.stack and self.stack[-1][0] != "html":
                self.close_top()
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and self.open_tags["p"]:
                self.handle_endtag("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.end_sibling(tag)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag not in VOID:
            self.open(tag, attrs)

    def end_sibling(self, tag: str) -> None:
        """An open element of the same kind ends, unless a list or table stands between."""
        for t, *_ in reversed(self.stack):
            if t == tag:
                self.handle_endtag(tag)
                return
            if t in ("ul", "ol", "dl", "table", "menu", "select") or (t == "tr" and tag in ("td", "th")):
                return

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCK:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
            elif tag in BLOCK:
                self.flush()
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.open_tags[tag]:
            while self.stack[-1][0] != tag:
                self.close_top()
            self.close_top()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def read_page(html: str) -> _Lines:
    """Lines of a page in order, and its region elements."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    prose: Counter[int] = Counter()
    for line in parser.lines:
        if line.good and line.prose:
            prose[line.form] += len(line.text)
    for line in parser.lines:  # a form with most of a page's paragraphs and headings is wrapped around the page
        line.good = line.good and (line.form < 0 or prose[line.form] * 2 > prose.total())
    return parser


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def content_lines(lines: list[Line], sigma: float = 1.0, factor: float = 1.0) -> list[bool]:
    """Threshold clustering: lines whose smoothed text-to-tag ratio reaches
    ``factor`` standard deviations, or, on a page so even that none does, the mean."""
    ratios = smoothed(np.array([len(x.text) / x.tags for x in lines], float), sigma)
    cut = factor * ratios.std()
    return list(ratios >= (cut if (ratios >= cut).any() else ratios.mean()))


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty if there is none.

    Character references are decoded, white space inside a block becomes one
    space.  Lines inside boilerplate elements (by tag, role, class or id) never count.
    The region is the ``article`` that holds most of such elements' content lines with its sibling articles, or all of
    the ``main`` around it and its sibling mains; without an article the ``main`` that
    holds most, with its siblings; else, also where those hold less than half of all content lines' text, the lowest element that holds all
    content lines and the heading before them, or the highest one around it with paragraphs or headings of its own.  All lines of
    the region are kept, and those from a first-rank heading before it if it has none itself; without a
    region, all from the first content line, or the heading before it, to the last.  A form is boilerplate unless it holds most of the
    page's paragraphs and headings.
    """
    if not html:
        return ""
    page = read_page(html)
    lines = [x for x in page.lines if x.good]
    if not lines:
        return ""
    content = content_lines(lines)
    own = [0] * len(page.names)  # code points of content lines below each region element
    for line, is_content in zip(lines, content):
        if line.region >= 0 and is_content:
            own[line.region] += len(line.text)
    for n in range(len(page.names) - 1, -1, -1):
        if page.parents[n] >= 0:
            own[page.parents[n]] += own[n]
    total = sum(len(x.text) for x, is_content in zip(lines, content) if is_content)
    best: set[int] = set()
    for tag in ("article", "main"):
        named = [n for n, name in enumerate(page.names) if name == tag]
        most = max((n for n in named if own[n]), key=lambda n: (own[n], -n), default=-1)
        # Teaser lists hold many small articles: then the element around them decides.
        if most >= 0 and own[most] * 2 >= sum(own[n] for n in named if page.parents[n] < 0 or page.names[page.parents[n]] != tag):
            around = [n for n in _upwards(page, most) if page.names[n] == "main"]
            if around:
                most, named = around[-1], [n for n, name in enumerate(page.names) if name == "main"]
            best = {n for n in named if page.parents[n] == page.parents[most]}
            if sum(own[n] for n in best) * 2 >= total:
                break
            best = set()
    if not best:
        at = [i for i, is_content in enumerate(content) if is_content]
        heading = next((i for i in range(at[0] - 1, -1, -1) if lines[i].heading), at[0])
        paths = [_upwards(page, lines[i].region) for i in {heading, *at}]
        common = max(set(paths[0]).intersection(*paths[1:]), default=-1)  # numbers grow with depth
        if common < 0:
            return "\n\n".join(x.text for x in lines[heading : at[-1] + 1])
        direct = {x.region for x in lines if x.prose}
        best = {min((n for n in _upwards(page, common) if n in direct), default=common)}
    inside = [False] * len(page.names)
    for n, parent in enumerate(page.parents):
        inside[n] = n in best or (parent >= 0 and inside[parent])
    kept = [x.region >= 0 and inside[x.region] for x in lines]
    if any(kept) and not any(k and x.title for k, x in zip(kept, lines)):
        first = kept.index(True)
        title = max((i for i in range(first) if lines[i].title), default=first)
        kept[title:first] = [True] * (first - title)
    return "\n\n".join(x.text for k, x in zip(kept, lines) if k)


def _upwards(page: _Lines, n: int) -> list[int]:
    """A region element and those around it."""
    out = []
    while n >= 0:
        out.append(n)
        n = page.parents[n]
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Edge cases: null or empty html, and pages without an article, give the
    empty text; ids and urls may be null or repeated; broken markup is read as far
    as the parser's events go; other columns are ignored; an empty table gives an empty result.

    Scale: one scan without a shuffle, one page in memory at a time.
    """
    rows = pick(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"])

    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
