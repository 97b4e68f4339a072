"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser gives the events of a page, which are cut into lines: one per block. Lines
inside elements that never hold an article (menus, page headers and footers, sidebars, notices, adverts, forms, reader
comments, scripts, styles) get ratio 0; of the others the ratio is the characters of text outside links for each
tag. A link is an a element with href; one without its end tag counts up to the end of its line only. What can't stand in
head ends it. The ratios are smoothed with a Gaussian kernel, lines over their standard deviation form clusters, and
the clusters select a region: the article or main element that holds most of their text, else the innermost container
that encloses them all (the whole page if none does). All lines of the region that are not excluded are the main text, also short ones.

Words in class, id or role, and forms, exclude softly: on a page that they leave with next to no text (a layout called "has-sidebar",
a page in one form), the outermost of these elements with most of the text is taken for a wrapper and no longer excludes, and so
on inwards. Elements that are never an article (nav, footer, aside and the like) always exclude.

NULL or empty html, and pages without text, give an empty string. Character references are decoded, white space in a
block becomes one space, blocks are joined in page order by one space. Rows are independent of each other; repeated
rows, NULL ids and ties change nothing, an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.tables import map_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("body center details div section td".split())  # elements that can hold a whole article, other than REGIONS
NEVER_TEXT = frozenset("head script style noscript template iframe object svg canvas audio video math textarea select button title".split())
APART = frozenset("nav footer aside form menu dialog".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
REGIONS = frozenset(("article", "main"))
# Words in class, id or role that mark parts which belong to the page and not to the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies "
    "disqus footer masthead menu nav navbar navigation newsletter notice notices popup promo promoted related replies reply "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
TOKEN = re.compile(r"[a-z0-9]+")
SIGMA, REACH = 1.0, 3
NEXT_TO_NOTHING = 0.05  # share of a marked element's text


class Lines(HTMLParser):
    """Collects (text, tags, characters in links, mark, region, container) of every block.

    A mark is an element that excludes its text, numbered from 1; 0 is none. Marks, containers and regions know what they lie in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, dict[int, int], int, int, int]] = []  # characters by link
        self.open: list[tuple[str, int, int, int, int]] = []  # name, mark, region, link, container
        self.count: Counter[str] = Counter()  # open elements by name
        self.within = [0]  # container that each container lies in; 0 is the page
        self.marks = [(0, False)]  # mark that each mark lies in, and whether it excludes softly
        self.regions = [0]  # mark that each region lies in
        self.text: list[str] = []
        self.linked: dict[int, int] = {}
        self.links: dict[int, int] = {}  # line in which a link begins
        self.live: set[int] = set()
        self.ended: set[int] = set()
        self.tags = 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            mark, region, _, container = self.open[-1][1:] if self.open else (0, 0, 0, 0)
            self.lines.append((text, self.tags, self.linked, mark, region, container))
            self.tags, self.linked = 0, {}
        self.text = []

    def shut(self, k: int, alone: bool = False) -> None:
        """Takes open elements from the k-th on, or that one alone, off the stack, and their links with them."""
        end = k + 1 if alone else len(self.open)
        self.live.difference_update(link for name, _, _, link, _ in self.open[k:end] if name == "a")
        self.count.subtract(name for name, *_ in self.open[k:end])
        del self.open[k:end]

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a name that is open."""
        k = len(self.open) - 1
        while self.open[k][0] != tag:
            k -= 1
        return k

    def end_head(self, anyway: bool) -> None:
        """Ends an open head, if no element is open in it or anyway."""
        if self.count["head"] and (anyway or self.open[-1][0] == "head"):
            self.cut()
            self.shut(self.last("head"))

    def outside_links(self, k: int) -> int:
        """Characters of a line that are in no link; text of an unclosed one counts in the line it begins in."""
        text, _, linked, *_ = self.lines[k]
        return max(0, len(text) - sum(n for link, n in linked.items() if link in self.ended or self.links[link] == k))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        if tag not in IN_HEAD:
            self.end_head(tag == "body")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a" and self.count["a"]:  # an open link ends where the next begins
            self.shut(self.last("a"), alone=True)
        if tag == "p" and self.count["p"]:  # an open paragraph ends where the next begins
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self.shut(k, alone=True)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        mark, region, link, container = self.open[-1][1:] if self.open else (0, 0, 0, 0)
        if tag == "a":
            link = 0
            if any(k == "href" for k, _ in attrs):
                link = len(self.links) + 1
                self.links[link] = len(self.lines)
                self.live.add(link)
        names = TOKEN.findall(" ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v)) if attrs else ()
        header = tag == "header" and not region
        never = tag in APART and tag != "form" or tag in NEVER_TEXT or header
        if never or tag == "form" or bool(MARKS.intersection(names)) and tag not in ("html", "body", *REGIONS):
            self.marks.append((mark, not never))
            mark = len(self.marks) - 1
        if tag in REGIONS and not region:
            self.regions.append(mark)
            region = len(self.regions) - 1
        if tag in CONTAINERS or tag in REGIONS:
            self.within.append(container)
            container = len(self.within) - 1
        self.open.append((tag, mark, region, link, container))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if not self.count[tag]:
            return
        k = self.last(tag)
        if tag == "a":
            self.ended.add(self.open[k][3])
        self.shut(k, alone=tag == "a" and any(name in BLOCKS for name, *_ in self.open[k:]))

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head(False)
        if self.open and self.open[-1][0] in NEVER_TEXT:
            return
        self.text.append(data)
        link = self.open[-1][3] if self.open else 0
        if link in self.live:
            self.linked[link] = self.linked.get(link, 0) + len(data.strip())


def clustered(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio is over the standard deviation of all; all with a ratio if none is."""
    at = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratios, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")
    chosen = (smooth > smooth.std()) & (ratios > 0)
    return chosen if chosen.any() else ratios > 0


def enclosed(within: list[int], containers: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Lines in the innermost container that holds all chosen ones; a container's number is over that of the one it lies in."""
    common = set(containers[chosen].tolist())
    while len(common) > 1:
        last = max(common)
        common.remove(last)
        common.add(within[last])
    best = common.pop()
    inside = np.zeros(len(within), bool)
    for k, outer in enumerate(within):
        inside[k] = k == best or k > 0 and inside[outer]
    return inside[containers]


def _selected(parser: Lines, free: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Lines of the main text, if marks hide as given."""
    lines = parser.lines
    excluded = hidden[[x[3] for x in lines]]
    regions = np.array([0 if hidden[parser.regions[x[4]]] else x[4] for x in lines])
    ratios = np.where(excluded, 0.0, free / np.array([x[1] + 1 for x in lines]))
    chosen = clustered(ratios)
    if not chosen.any():
        return chosen
    weight = np.bincount(regions[chosen], free[chosen])
    best = int(weight.argmax())
    if best:
        inside = regions == best
    else:
        inside = enclosed(parser.within, np.array([x[5] for x in lines]), chosen)
    return inside & ~excluded


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    for start in range(0, len(html), 1 << 16):
        parser.feed(html[start : start + (1 << 16)])
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    free = np.array([parser.outside_links(k) for k in range(len(lines))])
    own = np.bincount([x[3] for x in lines], free, len(parser.marks))
    total, heaviest = own.copy(), [0] * len(parser.marks)  # text of a mark with those in it, and the one in it with most text
    for mark in range(len(parser.marks) - 1, 0, -1):
        outer = parser.marks[mark][0]
        total[outer] += total[mark]
        if outer and parser.marks[mark][1] and total[mark] > (total[heaviest[outer]] if heaviest[outer] else 0):
            heaviest[outer] = mark
    lifted: set[int] = set()
    while True:
        # A mark lies in marks of smaller numbers; the outermost one that hides a line counts its text.
        outermost = [0] * len(parser.marks)
        for mark, (outer, _) in enumerate(parser.marks):
            outermost[mark] = outermost[outer] or (mark if mark not in lifted else 0)
        selected = _selected(parser, free, np.array(outermost) > 0)
        held = np.bincount(outermost, own, len(parser.marks))
        held[[k for k, (_, soft) in enumerate(parser.marks) if not soft]] = 0
        wrapper = int(held.argmax())
        if free[selected].sum() > NEXT_TO_NOTHING * held[wrapper] or not held[wrapper]:
            return " ".join(lines[k][0] for k in np.flatnonzero(selected))
        lifted.add(wrapper)
        while heaviest[wrapper] and total[heaviest[wrapper]] >= (1 - NEXT_TO_NOTHING) * total[wrapper]:
            wrapper = heaviest[wrapper]
            lifted.add(wrapper)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batch: pa.RecordBatch):
        html = batch.column("html")
        for start in range(0, batch.num_rows, 500):
            texts = [main_text(h) for h in html.slice(start, 500).to_pylist()]
            part = batch.slice(start, 500)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
