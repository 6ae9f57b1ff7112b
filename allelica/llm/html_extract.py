"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with the path of tags from the root. Blocks of the same path are
summed: their number, text length, punctuation and link text. A path's ratio fuses its text per block with
its punctuation per block and the share of its text outside links, so running prose has high ratios and
menus, labels and link lists low ones.

Ratios are smoothed over the page's tree: a container (a box that is no paragraph, heading, list or table)
has the sum of its blocks' ratios, a share of its parent's and children's and a smaller one of its
siblings'. So a heading or a short line is carried by the prose around it. What the markup says of a box is
fused in as a factor: article and main count for more; navigation, footers, asides, forms and boxes named as
adverts, notices, menus or comments for nothing. Paths whose smoothed weight reaches a share of the page's
best one are content, in every box alike; all their blocks are kept whole, in page order. Paths of several
blocks in one box that are all link text are lists of links and go, unless an article's running text leads
up to them and goes on behind them. A page that names leave without any text is read again without them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Boxes that are no containers of their own: their text belongs to the container around them.
LEAF = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table caption ul ol dl blockquote pre figcaption figure hgroup header center address details summary".split()
)
SKIP = frozenset("nav footer aside form head menu dialog search fieldset".split())
#: Words in class, id or role that mark a box as no part of the article.
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios cookie cookies consent disqus "
    "footer footnav masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup popover promo promoted related "
    "recommended replies reply respond share sharing sidebar sidenav skip social sponsor sponsored subscribe toolbar topbar widget complementary "
    "contentinfo alert dialog search login signup".split()
)
#: Words that say nothing of their own next to one of SKIP_NAMES, as in "site-footer".
FILLERS = frozenset("site page main box block bar section list container wrapper inner left right top bottom area links unit slot post".split())
#: Factor of article and main; share of the best weight that makes content; shares taken from parent or
#: children and from siblings.
BOOST, SHARE, NEAR, SIDE = 6.0, 0.3, 0.25, 0.0625
#: Blocks from which on a path of nothing but links is a list of links.
LIST = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s\xa0]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_ENDS = {"li": "li", "dt": "dd", "dd": "dt", "td": "td", "th": "th", "tr": "tr"}


def _skipped(name: str, tag: str, in_article: bool, names: bool) -> bool:
    """Whether the markup says that a box is no part of an article; its class, id and role count with ``names``."""
    if name in SKIP or (name == "header" and not in_article):
        return True
    if len(tag) == len(name) + 2 or name in ("html", "body", "article", "main"):
        return False
    held = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(tag, len(name) + 1)}
    if "hidden" in held or held.get("aria-hidden") == "true" or _NONE.search(held.get("style", "")):
        return True
    for mark in " ".join(held.get(k, "") for k in ("class", "id", "role")).split() if names else ():
        words = {w for w in re.split(r"[^a-z]+", mark) if w}
        if words & SKIP_NAMES and words <= SKIP_NAMES | FILLERS:
            return True
    return False


class Page:
    """The blocks of a page in order, their paths and the tree of containers.

    ``blocks``: (text, path number, container number, characters in links). ``paths``: the tag paths.
    ``parent``, ``article``: of each container, the one around it and whether it lies in article or main.
    Blocks in skipped boxes are left out; with ``names`` also those in boxes named as no part of an article.
    """

    def __init__(self, page: str, names: bool = True):
        self._names = names
        self.blocks: list[tuple[str, int, int, int]] = []
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.parent, self.article = [-1], [False]
        self._numbers: dict[tuple[int, str], int] = {}
        self._parts: list[str] = []
        self._links = 0
        # Open tags: name, path, container, in article or main, skipped; where names and blocks are open.
        self._stack: list[tuple[str, int, int, bool, bool]] = []
        self._open: dict[str, list[int]] = defaultdict(list)
        self._boxes: list[int] = []
        self._read(page)

    def _top(self) -> tuple[str, int, int, bool, bool]:
        return self._stack[-1] if self._stack else ("", 0, 0, False, False)

    def _close(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip() if self._parts else ""
        if text:
            _, path, container, _, skipped = self._top()
            if not skipped:
                self.blocks.append((text, path, container, min(self._links, len(text))))
        self._parts.clear()
        self._links = 0

    def _cut(self, at: int) -> None:
        """Close the open tags from place ``at`` on."""
        for name, *_ in reversed(self._stack[at:]):
            self._open[name].pop()
        del self._stack[at:]
        while self._boxes and self._boxes[-1] >= at:
            self._boxes.pop()

    def _start(self, name: str, tag: str) -> None:
        _, path, container, article, skipped = self._top()
        box = name in BLOCK
        if box:
            number = self._numbers.setdefault((path, name), len(self.paths))
            if number == len(self.paths):
                self.paths.append((path, name))
            path = number
            skipped = skipped or _skipped(name, tag, article, self._names)
            article = article or name in ("article", "main")
            if name not in LEAF:
                self.parent.append(container)
                self.article.append(article)
                container = len(self.parent) - 1
            self._boxes.append(len(self._stack))
        else:
            skipped = skipped or _skipped(name, tag, article, self._names)
        self._open[name].append(len(self._stack))
        self._stack.append((name, path, container, article, skipped))

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            m = _TOKEN.match(page, at)
            token, at = m[0], m.end()
            if token[0] != "<" or token == "<":
                text = unescape(token)
                self._parts.append(text)
                if self._open["a"]:
                    self._links += len(text.strip())
                continue
            if token[1] in "!?":
                continue
            name = _NAME.match(token)[1].lower()
            if token[1] == "/":
                if name in BLOCK:
                    self._close()
                # An inline end tag does not close blocks around it.
                if self._open[name] and (name in BLOCK or not self._boxes or self._open[name][-1] > self._boxes[-1]):
                    self._cut(self._open[name][-1])
                continue
            if name in RAW and not token.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if name == "br":
                self._parts.append(" ")
            if name in BLOCK:
                self._close()
                # A new block ends an open paragraph, a new item the one before it.
                if self._boxes:
                    last = self._stack[self._boxes[-1]][0]
                    if last == "p" or last == name == _ENDS.get(name) or (name in _ENDS and last in (name, _ENDS[name])):
                        self._cut(self._boxes[-1])
            if name not in VOID and not token.endswith("/>"):
                self._start(name, token)
        self._close()


def ratios(page: Page) -> tuple[list[float], set[tuple[int, int]]]:
    """The fused ratio of each tag path, and the (path, container) that are lists of links."""
    sums = [[0, 0, 0, 0] for _ in page.paths]
    boxes: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
    for text, path, container, links in page.blocks:
        for k, v in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), links)):
            sums[path][k] += v
        for k, v in enumerate((1, len(text), links)):
            boxes[path, container][k] += v
    fused = [chars / n * (1 + marks / n) * (1 - links / chars) if n else 0.0 for n, chars, marks, links in sums]
    lists = {box for box, (n, chars, links) in boxes.items() if n >= LIST and links >= 0.95 * chars}
    return fused, lists


def smoothed(page: Page, fused: list[float]) -> list[float]:
    """The weight of each container: its blocks' ratios, smoothed over the tree, times the markup's factor."""
    own = [0.0] * len(page.parent)
    for _, path, container, _ in page.blocks:
        own[container] += fused[path]
    below = [0.0] * len(own)
    for c, p in enumerate(page.parent):
        if p >= 0:
            below[p] += own[c]
    out = []
    for c, p in enumerate(page.parent):
        around, beside = (own[p], below[p] - own[c]) if p >= 0 else (0.0, 0.0)
        out.append((own[c] + NEAR * (around + below[c]) + SIDE * beside) * (BOOST if page.article[c] else 1.0))
    return out


def within_text(page: Page, lists: set[tuple[int, int]]) -> set[int]:
    """The places of blocks of lists of links within an article's running text: the box's block before the list is
    text and no heading, and the box's text goes on behind it."""
    kept: set[int] = set()
    boxes: dict[int, tuple[str, list[int]]] = {}  # of each box: the tag of its last text, the list behind it
    for at, (_, path, c, _) in enumerate(page.blocks):
        before, run = boxes.setdefault(c, ("", []))
        if (path, c) in lists:
            run.append(at)
            continue
        if page.article[c] and before and before not in HEADINGS:
            kept.update(run)
        boxes[c] = page.paths[path][1], []
    return kept


def main_text(html: str | None) -> str:
    """The content blocks, one per line; '' if there are none."""
    page = Page(html or "")
    if not page.blocks:
        page = Page(html or "", names=False)
    if not page.blocks:
        return ""
    fused, lists = ratios(page)
    weights = smoothed(page, fused)
    held = {c for _, path, c, _ in page.blocks if (path, c) not in lists}
    least = SHARE * max((weights[c] / (BOOST if page.article[c] else 1.0) for c in held), default=0.0)
    inside = within_text(page, lists)
    return "\n".join(text for at, (text, path, c, _) in enumerate(page.blocks) if ((path, c) not in lists or at in inside) and weights[c] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row, the whole page read.

    A null or empty page, or one without content, has text ''. Broken markup is read to its end: tags left
    open end with the page. Repeated rows and null ids are rows like others; other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")
    kind = dict(rows.dtypes)["page_id"]

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
