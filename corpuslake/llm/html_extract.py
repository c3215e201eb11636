"""Main text of web pages: flat text blocks, features of a block and its neighbours, and a decision tree.

After Kohlschuetter et al. (2010): a page is cut into blocks at block-level tags; a block is judged by its
word count and link density, those of the blocks before and after it, and where its tags put it. The tree
is trained when the query is built, on the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import ship
from corpuslake.llm._words import pieces

# HTML element names by their part in a page.
SKIPPED = frozenset("script style noscript template svg iframe object textarea select button head title math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER = frozenset("nav footer aside form menu dialog header".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that name a page's furniture.
NAMED_HEADER = frozenset(["header", "masthead"])
FURNITURE = frozenset(
    """ad ads adbox adslot advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies
    dialog disclaimer disqus discussion feedback footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager
    popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription tags teaser toolbar topbar widget widgets""".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    main: bool
    heading: bool


def _furniture(attrs: str, main: bool = False) -> bool:
    """Whether an element is hidden or has a name of furniture; an article's own header is none."""
    if not attrs:
        return False
    if HIDDEN.search(attrs):
        return True
    names = {n for a, b, c in MARKS.findall(attrs) for n in NAME.findall((a or b or c).lower())}
    return not FURNITURE.isdisjoint(names - NAMED_HEADER if main else names)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, references decoded and white space collapsed; blank ones are left out.

    Unclosed elements are closed by the end tag of an element around them; an end tag without a start is ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    heading = own_bad = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                bad, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                linked = len(html.unescape(" ".join(links)).split()) if links else 0
                out.append(Block(text, text.count(" ") + 1, linked, bad or own_bad, main, heading))
        parts, links = [], []

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if not m[3]:
            take(html.escape(m[1]) if m[1] else "")
            continue
        closing, tag, attrs = m[1 + 1], m[3].lower(), m[4]
        if tag in SKIPPED:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in ("button", "select"):
                continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            if not closing and tag != "a" and tag not in VOID and _furniture(attrs):
                flush()
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
            continue
        flush()
        heading = tag in HEADING and not closing
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", *HEADING):
            own_bad = not closing and _furniture(attrs, bool(stack) and stack[-1][2])
            continue
        own_bad = False
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            bad, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            bad = bad or (tag in OUTER and not (tag == "header" and main)) or (tag not in ("html", "body") and _furniture(attrs, main))
            stack.append((tag, bad, main or tag in MAIN))
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture", "in_main", "page_has_main", "heading")

#: Labelled pages: for each block in order its words, link density, whether its tags or names are of furniture, whether
#: it stands in an article or main element, whether it is a heading, then 1 for main text.
PAGES = (
    # menu, advert, article, footer
    ((1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 0, 0, 0), (10, 0.0, 1, 0, 0, 0), (8, 0.0, 0, 1, 1, 1), (31, 0.0, 0, 1, 0, 1), (12, 0.0, 0, 1, 0, 1), (107, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 1, 0, 1), (60, 0.1, 0, 1, 0, 1), (11, 0.0, 1, 0, 0, 0)),
    # a short article
    ((1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 0, 0, 0), (16, 0.0, 1, 0, 0, 0), (2, 0.0, 0, 1, 1, 1), (1, 0.0, 0, 1, 0, 1), (4, 0.0, 1, 0, 0, 0)),
    ((3, 1.0, 1, 0, 0, 0), (6, 0.0, 0, 1, 0, 1), (14, 0.2, 1, 0, 0, 0)),
    ((12, 0.0, 1, 0, 0, 0), (1, 0.0, 0, 1, 1, 1), (250, 0.0, 0, 1, 0, 1), (2, 0.0, 0, 1, 0, 1), (3, 0.0, 0, 1, 0, 1), (8, 0.0, 1, 0, 0, 0)),
    ((5, 0.0, 0, 1, 0, 1),),
    # links inside running text stay, lists of links at the end of an article don't
    ((9, 0.0, 0, 1, 1, 1), (50, 0.0, 0, 1, 0, 1), (6, 1.0, 0, 1, 0, 1), (40, 0.3, 0, 1, 0, 1), (90, 0.1, 0, 1, 0, 1), (8, 0.5, 0, 1, 0, 1), (70, 0.0, 0, 1, 0, 1)),
    ((4, 0.0, 0, 1, 1, 1), (80, 0.0, 0, 1, 0, 1), (45, 0.1, 0, 1, 0, 1), (4, 1.0, 0, 1, 0, 0), (5, 1.0, 0, 1, 0, 0), (3, 1.0, 0, 1, 0, 0), (6, 0.9, 0, 1, 0, 0), (10, 0.0, 1, 0, 0, 0)),
    ((1, 1.0, 0, 1, 0, 0), (2, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 1, 0, 0), (7, 0.0, 0, 1, 1, 1), (35, 0.0, 0, 1, 0, 1), (64, 0.0, 0, 1, 0, 1), (12, 0.9, 0, 1, 0, 0), (9, 1.0, 0, 1, 0, 0), (14, 0.8, 0, 1, 0, 0)),
    ((3, 1.0, 0, 1, 0, 0), (4, 1.0, 0, 1, 0, 0), (5, 1.0, 0, 1, 0, 0), (80, 0.0, 0, 1, 0, 1), (60, 0.0, 0, 1, 0, 1)),
    # reader comments, notices and sidebars, long ones too
    ((5, 0.0, 0, 1, 1, 1), (70, 0.0, 0, 1, 0, 1), (90, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 1, 1, 0), (60, 0.0, 1, 1, 0, 0), (25, 0.1, 1, 1, 0, 0), (90, 0.0, 1, 1, 0, 0), (200, 0.0, 1, 1, 0, 0), (3, 1.0, 1, 1, 0, 0)),
    ((30, 0.0, 1, 1, 0, 0), (44, 0.0, 0, 1, 0, 1), (60, 0.0, 1, 1, 0, 0), (52, 0.0, 0, 1, 0, 1), (2, 1.0, 1, 1, 0, 0), (75, 0.0, 0, 1, 0, 1)),
    ((2, 0.0, 1, 0, 1, 0), (60, 0.0, 1, 0, 0, 0), (80, 0.0, 1, 0, 0, 0), (200, 0.0, 1, 0, 0, 0), (7, 0.0, 0, 1, 1, 1), (20, 0.0, 0, 1, 0, 1), (150, 0.1, 1, 0, 0, 0)),
    # text outside the marked article: short pieces aren't main text, a run of long ones is
    ((10, 0.0, 0, 0, 0, 0), (8, 0.0, 0, 1, 1, 1), (22, 0.0, 0, 1, 0, 1), (35, 0.0, 0, 1, 0, 1), (22, 0.0, 0, 0, 0, 0), (5, 1.0, 0, 0, 0, 0), (14, 0.0, 0, 0, 0, 0)),
    ((3, 0.0, 0, 0, 1, 0), (30, 0.0, 0, 0, 0, 0), (6, 0.0, 0, 1, 1, 1), (64, 0.0, 0, 1, 0, 1), (110, 0.0, 0, 1, 0, 1), (34, 0.0, 0, 0, 0, 0), (12, 0.0, 0, 0, 0, 0)),
    ((40, 0.0, 0, 0, 0, 0), (4, 0.0, 0, 1, 1, 1), (90, 0.0, 0, 1, 0, 1), (45, 0.0, 0, 1, 0, 1), (25, 0.0, 0, 0, 0, 0), (20, 0.0, 0, 0, 0, 0), (28, 0.0, 0, 0, 0, 0)),
    ((20, 0.0, 0, 0, 0, 0), (25, 0.0, 0, 0, 0, 0), (12, 0.0, 0, 1, 1, 1), (33, 0.0, 0, 1, 0, 1), (48, 0.0, 0, 0, 0, 0)),
    ((7, 0.0, 0, 1, 1, 1), (200, 0.0, 0, 1, 0, 1), (70, 0.0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0), (18, 0.0, 0, 0, 0, 0), (52, 0.1, 0, 0, 0, 0)),
    ((2, 1.0, 1, 0, 0, 0), (6, 0.0, 0, 1, 1, 1), (18, 0.0, 0, 1, 0, 1), (80, 0.0, 0, 0, 0, 1), (120, 0.0, 0, 0, 0, 1), (95, 0.1, 0, 0, 0, 1), (64, 0.0, 0, 0, 0, 1), (9, 0.0, 1, 0, 0, 0)),
    ((5, 0.0, 0, 1, 0, 1), (150, 0.0, 0, 0, 0, 1), (70, 0.1, 0, 0, 0, 1), (210, 0.0, 0, 0, 0, 1), (6, 1.0, 0, 0, 0, 0), (4, 1.0, 0, 0, 0, 0)),
    # pages that mark furniture but no article
    ((1, 1.0, 1, 0, 0, 0), (3, 0.0, 1, 0, 1, 0), (8, 0.0, 0, 0, 1, 1), (70, 0.0, 0, 0, 0, 1), (55, 0.1, 0, 0, 0, 1), (30, 0.0, 1, 0, 0, 0), (55, 0.1, 1, 0, 0, 0), (150, 0.0, 1, 0, 0, 0)),
)

#: Labelled blocks of pages that mark no article and no furniture, where words and links decide: words, link
#: density, those of the block before and of the block after, heading, then 1 for main text.
UNPLACED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0), (6, 1.0, 2, 1.0, 5, 0.9, 0, 0), (12, 0.9, 0, 0.0, 40, 0.0, 0, 0), (9, 0.8, 3, 1.0, 2, 1.0, 0, 0),
    (3, 0.0, 1, 1.0, 1, 1.0, 0, 0), (5, 0.0, 8, 1.0, 0, 0.0, 0, 0), (4, 0.0, 2, 1.0, 6, 0.7, 0, 0), (20, 0.7, 4, 0.5, 9, 1.0, 0, 0), (7, 0.0, 3, 0.0, 0, 0.0, 0, 0), (30, 0.6, 2, 1.0, 2, 1.0, 0, 0),
    (3, 0.8, 60, 0.0, 50, 0.0, 0, 0), (40, 0.7, 60, 0.0, 3, 1.0, 0, 0), (2, 0.0, 1, 1.0, 2, 0.0, 1, 0), (15, 0.9, 40, 0.0, 0, 0.0, 0, 0), (80, 0.9, 1, 1.0, 5, 1.0, 0, 0), (4, 0.0, 2, 0.0, 3, 0.0, 0, 0),
    (80, 0.0, 9, 0.0, 70, 0.0, 0, 1), (65, 0.1, 80, 0.0, 14, 0.0, 0, 1), (150, 0.0, 10, 0.0, 12, 0.0, 0, 1), (12, 0.0, 70, 0.0, 60, 0.0, 0, 1), (25, 0.1, 40, 0.0, 3, 1.0, 0, 1), (40, 0.2, 12, 0.0, 50, 0.1, 0, 1),
    (6, 0.0, 60, 0.0, 50, 0.0, 1, 1), (8, 0.0, 2, 1.0, 70, 0.0, 1, 1), (18, 0.0, 30, 0.0, 20, 0.0, 0, 1), (3, 0.0, 50, 0.0, 40, 0.0, 0, 1), (30, 0.3, 60, 0.0, 25, 0.1, 0, 1), (22, 0.0, 25, 0.0, 1, 1.0, 0, 1),
    (4, 1.0, 4, 1.0, 90, 0.0, 0, 0), (2, 1.0, 3, 1.0, 60, 0.0, 0, 0), (6, 1.0, 5, 0.9, 120, 0.1, 0, 0), (12, 1.0, 12, 1.0, 45, 0.0, 0, 0),
    (90, 0.0, 3, 1.0, 60, 0.0, 0, 1), (120, 0.1, 4, 1.0, 80, 0.0, 0, 1), (50, 0.0, 6, 0.9, 45, 0.1, 0, 1), (70, 0.0, 2, 1.0, 8, 0.0, 0, 1), (35, 0.0, 5, 1.0, 60, 0.0, 0, 1), (100, 0.0, 12, 1.0, 35, 0.0, 0, 1),
    (300, 0.0, 1, 1.0, 2, 1.0, 0, 1), (60, 0.0, 3, 0.0, 0, 0.0, 0, 1), (45, 0.1, 1, 1.0, 30, 0.0, 0, 1), (16, 0.0, 45, 0.0, 90, 0.0, 0, 1), (4, 0.0, 3, 0.0, 80, 0.0, 1, 1), (28, 0.0, 0, 0.0, 26, 0.0, 0, 1),
)

def rows_of(page) -> list[tuple]:
    """Feature rows of a page's blocks (words, link density, furniture, in_main, heading, ...); beyond the ends a neighbour has no words and no links."""
    has_main = int(any(b[3] and not b[2] for b in page))
    padded = [(0, 0.0), *(b[:2] for b in page), (0, 0.0)]
    return [(*b[:2], *padded[i], *padded[i + 2], int(b[2]), int(b[3]), has_main, int(b[4])) for i, b in enumerate(page)]


#: The labelled table: the features in order, then 1 for main text.
LABELLED = tuple((*row, b[5]) for page in PAGES for row, b in zip(rows_of(page), page, strict=True)) + tuple((w, d, wb, db, wa, da, 0, 0, 0, head, y) for w, d, wb, db, wa, da, head, y in UNPLACED)


def train(rows=LABELLED, depth: int = 8) -> tuple:
    """A tree of (feature, threshold, left, right) and leaves 0 or 1, by least Gini impurity; ties go to the earlier feature and lower threshold."""
    table = np.array(rows, np.float64)

    def grow(t: np.ndarray, left: int):
        y = t[:, -1]
        if left == 0 or y.min() == y.max():
            return int(2 * y.sum() > len(y))
        best = None
        for f in range(t.shape[1] - 1):
            values = np.unique(t[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = y[t[:, f] <= cut]
                high = y[t[:, f] > cut]
                cost = sum(len(z) * z.mean() * (1 - z.mean()) for z in (low, high))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut))
        if best is None:
            return int(2 * y.sum() > len(y))
        _, f, cut = best
        return f, cut, grow(t[t[:, f] <= cut], left - 1), grow(t[t[:, f] > cut], left - 1)

    return grow(table, depth)


def features(found: list[Block]) -> list[tuple]:
    return rows_of([(b.words, b.linked / b.words, b.furniture, b.main, b.heading) for b in found])


def classify(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame, rows=LABELLED) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page, and one without main text, has the empty text. Repeated pages each get a row; other
    columns are ignored; an empty table gives none. The whole page is read; no shuffle; memory is bounded by a
    slice of 4 MB or the longest page.
    """
    ship(pages.sparkSession)
    tree = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 4 << 20):
                texts = [main_text(p, tree) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
