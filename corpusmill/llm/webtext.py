"""HTML extraction (operator 7): parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser is fed a page piece by piece. Its events fill lines: a block element ends one, and each
line counts the code points of its text and the tags met since the line before. The ratio of text to tags is smoothed by
a Gaussian over neighbouring lines, and lines fall into two clusters at a threshold, the standard deviation of the
smoothed ratios; the upper one is content. The region is found by these clusters: from the root, it narrows to the child
that holds most of the content, as long as what stays outside is little and not running text of the same element. Then
it widens again: at each level above, neighbours without a telling name come to it if they are mostly content and hold
three tenths of what it does (a second section, another cell), and, if it has no heading, what leads up to it from the
heading before it.

Names weigh in. Being in a menu, footer, aside, form or the like, by tag, role or a whole word of its class, divides a
line's ratio and weight by HINT. Inside the region all lines stay, short ones too, but those of such elements, unless the
element holds most of the content itself (a form around the whole page, say; a menu or footer never does). One whose
name tells little (WEAK, or a compound such as "ad-hoc" of which a part is telling) goes only if its own ratio is below
the threshold. Scripts, styles and other elements without readable text give no lines at all.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed. A
null or empty page, and one without any text outside such parts, has an empty text. A tag that the end of the page
cuts off is no text. Pages of any length are read whole, in time linear in it. Repeated rows are extracted alike; where two
children hold as much, the first counts. An empty table gives no rows; columns other than html are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul br".split()
)
SILENT = frozenset("script style noscript template head title button select textarea iframe svg object canvas".split())
APART = frozenset("aside form".split())
#: Elements that are never the main text, nor around it.
NEVER = frozenset("nav footer dialog menu".split())
#: Elements that a region may be; the others hold running text of the element around them.
PLACES = frozenset("html body main article section div center td tr tbody table form aside fieldset details header footer nav dialog menu".split())
#: Elements that end an open one of the same kind.
ALONE = frozenset("p li dt dd tr td th option".split())
#: Words of class, id or role that name something else than the main text.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter "
    "subscribe subscription nav navigation navbar menu breadcrumb breadcrumbs sidebar complementary footer masthead comment comments disqus pagination contentinfo".split()
)
#: Words that may do so, or not.
WEAK = frozenset(
    "alert aside banner form header login overlay pager recommended related replies reply respond search share sharing signup skip social teaser topbar toolbar widget widgets".split()
)
TELLING = ASIDE | WEAK
#: Those of them that may name a part of the article itself once inside it.
TITLES = frozenset("header masthead banner".split())
#: Elements that head a text, and lines that a heading of few words may have with it.
TITLE = 3
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
WORDS = re.compile(r"[a-z]+")
TAIL = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
GAPS = re.compile(r"\s+")
#: Lines on either side that the smoothing reaches, and its deviation in lines.
REACH, SIGMA = 3, 1.0
#: What a name divides the ratio of the lines inside by.
HINT = 10.0
#: Code points fed at a time.
FEED = 1 << 16
#: What an element's name says of it.
NONE, MAYBE, SURE, ALWAYS, MUTE = range(5)


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, the innermost element; of elements their tag, parent and hint."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.hints, self.inside, self.mute = [""], [-1], [NONE], [False], [False]
        self.stack = [0]
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.homes: list[int] = []
        self.pieces: list[str] = []
        self.seen = 0

    def end_line(self) -> None:
        text = GAPS.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.texts.append(text)
            self.counts.append(self.seen)
            self.homes.append(self.stack[-1])
            self.seen = 0
        self.pieces.clear()

    def hint(self, tag: str, attrs: list[tuple[str, str | None]], within: bool) -> int:
        """What the name of an element says; within: inside an article or main element."""
        if tag in SILENT or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return MUTE
        if tag in ("html", "body"):
            return NONE
        if tag in NEVER or tag == "header" and not within:
            return ALWAYS
        told = SURE if tag in APART else NONE
        for name in " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role")).split():
            parts = set(WORDS.findall(name)) - (TITLES if within else frozenset())
            if parts & ASIDE and parts <= TELLING:
                told = SURE
            elif parts & TELLING and told == NONE:
                told = MAYBE
        return told

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        if tag in BLOCK:
            self.end_line()
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        if tag in VOID:
            return
        if tag in ALONE:
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 8), -1):
                name = self.tags[self.stack[k]]
                if name == tag:
                    del self.stack[k:]
                    break
                if name in BLOCK:
                    break
        top = self.stack[-1]
        hint = self.hint(tag, attrs, self.inside[top])
        self.tags.append(tag)
        self.parents.append(top)
        self.hints.append(hint)
        self.mute.append(self.mute[top] or hint == MUTE)
        self.inside.append(self.inside[top] or tag in ("article", "main"))
        self.stack.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "b", "i", "a", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCK:
            self.end_line()
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[k]]
            if name == tag:
                if k < len(self.stack) - 1 and tag in BLOCK:
                    self.end_line()
                del self.stack[k:]
                return
            if name in ("article", "main") and tag not in ("body", "html", "main", "article"):
                return  # a stray end tag closes nothing around the article

    def handle_data(self, data: str) -> None:
        if not self.mute[self.stack[-1]]:
            self.pieces.append(data)


def content_lines(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines belong to the upper cluster of smoothed ratios, all of them if none stands out; and the threshold."""
    at = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]
    smooth = np.convolve(ratios, kernel)[REACH : REACH + len(ratios)] / weight
    upper = smooth >= smooth.std()
    return (upper if upper.any() else np.ones(len(ratios), bool)), float(smooth.std())


def summed(page: Lines, of_lines: np.ndarray) -> np.ndarray:
    """The sum of a number of each line over all lines inside each element; children come after their parents."""
    held = np.zeros(len(page.tags))
    np.add.at(held, np.array(page.homes), of_lines)
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    return held


def region(page: Lines, held: np.ndarray) -> int:
    """The element that the content, held inside each element, narrows down to."""
    best: dict[int, int] = {}  # of each element the child place that holds most
    placed = np.zeros(len(held))  # held by all child places
    for e in range(1, len(held)):
        if page.tags[e] in PLACES:
            p = page.parents[e]
            placed[p] += held[e]
            if p not in best or held[e] > held[best[p]]:
                best[p] = e
    at = 0
    while (child := best.get(at)) is not None and 2 * held[child] > held[0]:
        running = held[at] - placed[at]  # text of its own, in no child place
        if 3 * held[child] < 2 * held[at] or 8 * running > held[at] or page.tags[at] == "article":
            break
        at = child
    return at


def widened(page: Lines, at: int, held: np.ndarray, every: np.ndarray, thin: np.ndarray) -> list[int]:
    """The region at and what belongs to it around it: elements without a hint that are mostly content and hold three
    tenths of what it does, at each level up to an article, the main element or the body; and, unless it has a heading or is an article
    itself, the elements before it from the nearest heading on, if none of them is hinted or thin."""
    kids: list[list[int]] = [[] for _ in page.tags]
    lines = summed(page, np.ones(len(page.homes)))
    headed = [tag in HEADINGS for tag in page.tags]
    for e in range(len(page.tags) - 1, 0, -1):
        kids[page.parents[e]].append(e)
        headed[page.parents[e]] |= headed[e]
    found, here, titled = [at], at, headed[at] or page.tags[at] in ("article", "main")
    while here > 0 and page.tags[here] not in ("body", "html", "main"):
        above = page.parents[here]
        for e in kids[above]:
            if e != here and page.hints[e] == NONE and 2 * held[e] >= every[e] and 10 * held[e] >= 3 * held[at] > 0:
                found.append(e)
        run: list[int] = []
        for e in (e for e in kids[above] if e < here and every[e] > 0 and not titled):  # from the nearest backwards
            if page.hints[e] != NONE or thin[e] and not (headed[e] and lines[e] <= TITLE):
                break
            run.append(e)
            if headed[e]:
                found += run
                titled = True
        if page.tags[above] == "article":
            break
        here = above
    return found


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Lines()
    whole = TAIL.sub("", html)
    for i in range(0, len(whole), FEED):
        page.feed(whole[i : i + FEED])
    page.close()
    page.end_line()
    if not page.texts:
        return ""
    divisor = np.ones(len(page.tags))
    for e in range(1, len(page.tags)):
        divisor[e] = divisor[page.parents[e]] * (HINT if page.hints[e] in (SURE, ALWAYS) else 1.0)
    lengths = np.array([len(t) for t in page.texts])
    weights = lengths / divisor[page.homes]
    content, threshold = content_lines(weights / np.maximum(1, page.counts))
    held, every, tags = summed(page, np.where(content, weights, 0.0)), summed(page, weights), summed(page, np.array(page.counts))
    gone, within, thin = [False] * len(page.tags), [False] * len(page.tags), every < threshold * tags
    for e in widened(page, region(page, held), held, every, thin):
        within[e] = True
    for e in range(1, len(page.tags)):
        told = page.hints[e] == SURE or page.hints[e] == MAYBE and thin[e]
        gone[e] = gone[page.parents[e]] or page.hints[e] == ALWAYS or told and 2 * held[e] <= held[0]
        within[e] = within[e] or within[page.parents[e]]
    return "\n".join(t for t, e in zip(page.texts, page.homes) if within[e] and not gone[e])


def extracted(html: Column) -> Column:
    """The main text of each page, string."""

    @text_udf("string")
    def extract_main_text(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p) for p in pages.to_pylist()), pa.string())

    return extract_main_text(html)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = table(spark, sf_dir, "pages").select("page_id", "url", extracted(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
