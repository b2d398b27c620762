"""Main text of web pages by tag-path ratios.

Every block of text has the path of block-level tags from the root. Per path, text length, punctuation and the share of text in links
are averaged over its blocks and fused; the scores are smoothed along the page, and the blocks of paths that score above a share of the page's
spread are the content. Each content block chooses a node: the outermost article or main element around it; where there is none at all, the
innermost element around all content blocks; beside articles, the nearest element that holds more than one kind of text. The main text is
everything in the chosen nodes, but for menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. These
are told by their tags, by what classes, ids and roles say, by the headings of comment sections, and, at the edges of the content, by text
that stands in links.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed tag names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture map area".split())
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav header footer aside form button select textarea input dialog menu".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Words that mark what isn't the article.
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead header notice notices cookie cookies consent gdpr popup modal dialog alertdialog newsletter subscribe share sharing social related comment comments commentlist respond reply replies disqus toolbar pagination pager search login contentinfo complementary".split())
#: Words that may stand beside a mark in one name and leave it one.
NEUTRAL = frozenset("site page user users reader readers global main top bottom left right list bar slot box area block section container wrapper wrap inner outer item items row widget signup sign up form link links buttons icons panel pane thread content body text message policy unit zone primary secondary mobile desktop".split())
#: Marks of reader comments, which may hold articles of their own.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: A name of only these says that its element is the article's, whatever other names it has.
CONTENT = frozenset("article post entry story content main body text".split())
#: Headings that only sections of reader comments have.
COMMENT_HEADING = re.compile(r"(\d+|reader|readers'|user) (comments?|replies|responses)|(comments|replies|responses) ?\(\d+\)|(leave|post|add|write) (a|your) (comment|reply)", re.IGNORECASE)
CLOSES_P = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends open elements of these kinds, up to the given ancestors.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HOLDERS = frozenset(("article", "main"))
#: Marks on these tell of the page's layout, not of a part to leave out.
WHOLE = HOLDERS | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: The id of these is often a slug of their heading.
SLUGGED = frozenset(("section",))
#: Elements of one kind of text, which may stand amid the article, but don't hold it whole.
PARTS = HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address details summary".split())
#: Such text next to an element belongs to the same article.
PROSE = HEADINGS | {"p"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute: a quote counts only right after an equals sign.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TO_END = re.compile(r"[\s/]*>")
_MARKING = frozenset(("class", "id", "role"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
_SIGMA, _RADIUS, _SHARE, _LINKED = 1.0, 2, 0.5, 0.5


@dataclass
class Block:
    #: Number of its path, the innermost block-level element, and how much of it stands in links.
    path: int
    node: int
    linked: float
    text: str


@dataclass
class Page:
    """Blocks in page order and the elements around them. Element 0 is the page; a parent comes before its children.

    Element ``k`` holds the blocks ``first[k]`` to ``last[k]``, end exclusive.
    """

    blocks: list[Block] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    first: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    #: Elements that may go by their marks: whether they are reader comments.
    marked: dict[int, bool] = field(default_factory=dict)

    def only(self, kept: list[bool]) -> Page:
        """The page with the blocks that are kept."""
        before = [0, *accumulate(kept)]
        out = Page([b for b, k in zip(self.blocks, kept, strict=True) if k], self.tag, self.parent, [before[k] for k in self.first], [before[k] for k in self.last], self.marked)
        return out

    def holders(self) -> list[int]:
        """The outermost article or main element around each element, which may be itself; 0 if there is none."""
        out = [0] * len(self.tag)
        for k in range(1, len(out)):
            out[k] = out[self.parent[k]] or (k if self.tag[k] in HOLDERS else 0)
        return out

    def outside(self, nodes: set[int]) -> list[bool]:
        """Of each block, whether none of these elements holds it."""
        change = [0] * (len(self.blocks) + 1)
        for k in nodes:
            change[self.first[k]] += 1
            change[self.last[k]] -= 1
        return [depth == 0 for depth in accumulate(change[:-1])]


def tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
    """(kind, value, attributes, self-closed) of the parts of a page in order: ``text``, ``open`` and ``close``; raw elements' content and comments are left out.

    Every character is passed over a fixed number of times. A tag that never ends takes the rest of the page with it, as in browsers.
    """
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        less = n if less < 0 else less
        if less > at:
            yield "text", page[at:less], [], False
        if less == n:
            return
        after = page[less + 1 : less + 2]
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
        elif name := _NAME.match(page, less + 2 if after == "/" else less + 1):
            tag, at, attributes = name[0].lower(), name.end(), []
            if page.find(">", at) < 0:
                return
            while not (end := _TO_END.match(page, at)):
                found = _ATTRIBUTE.match(page, at)
                if not found:
                    return
                at = found.end()
                if found[1].lower() in _MARKING:
                    attributes.append((found[1].lower(), found[2] or found[3] or found[4] or ""))
            at = end.end()
            if after == "/":
                yield "close", tag, [], False
            else:
                yield "open", tag, attributes, "/" in end[0]
                if tag in RAW:
                    shut = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                    at = shut.end() if shut else n
        else:
            yield "text", "<", [], False
            at = less + 1


def _mark(tag: str, attributes: list[tuple[str, str]]) -> bool | None:
    """Whether a name among class, id or role marks reader comments (true) or another part that isn't the article (false); None if none does."""
    for name, value in attributes:
        if name == "id" and tag in SLUGGED:
            continue
        names = [{w.lower() for w in _WORD.findall(x)} for x in value.split()]
        if any(x and CONTENT.issuperset(x) for x in names):
            continue
        found = [x for x in names if x & MARKS and x <= MARKS | NEUTRAL and x != {"page", "header"}]
        if found:
            return any(x & COMMENTS for x in found)
    return None


class _Builder:
    """Builds a page from its parts in one pass; what is open is kept by tag as well, so that no step walks the stack."""

    def __init__(self) -> None:
        self.page, self.stack = Page(), [0]
        self.opened: dict[str, list[int]] = defaultdict(list)  # places on the stack
        self.levels = [0]  # places of block-level elements
        self.paths: dict[tuple[int, str], int] = {}
        self.path_of = [0]
        self.dropping = self.links = 0
        self.cuts: dict[int, tuple[int, int]] = {}  # inline elements whose text goes: the pieces before it, and how many blocks there were
        self.pieces: list[str] = []
        self.linked: list[str] = []

    def text(self, value: str) -> None:
        self.pieces.append(value)
        if self.links:
            self.linked.append(value)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        linked = sum(len("".join(x.split())) for x in self.linked)
        self.pieces.clear()
        self.linked.clear()
        if text and not self.dropping:
            node = self.stack[self.levels[-1]]
            self.page.blocks.append(Block(self.path_of[node], node, min(1.0, linked / max(1, len(text.replace(" ", "")))), text))

    def place(self, tag: str) -> int:
        """The place of the innermost open element of this tag; 0 if there is none."""
        return self.opened[tag][-1] if self.opened[tag] else 0

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            node = self.stack[-1]
            tag = self.page.tag[node]
            cut = self.cuts.pop(node, None)
            if cut and cut[1] == len(self.page.blocks):
                del self.pieces[cut[0] :]
            elif cut or tag not in INLINE:
                self.flush()
            self.page.last[node] = len(self.page.blocks)
            self.stack.pop()
            self.opened[tag].pop()
            if tag not in INLINE:
                self.levels.pop()
            self.dropping -= tag in DROPPED
            self.links -= tag == "a"

    def end(self, tag: str) -> None:
        k = self.place(tag)
        if k and not (tag in INLINE and self.levels[-1] > k):
            self.close(k)
        elif tag not in INLINE:
            self.flush()

    def start(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if tag == "br":
            self.text("\n")
            return
        if tag not in INLINE:
            if tag in CLOSES_P and (k := self.place("p")):
                self.close(k)
            if tag in ENDS:
                kinds, limits = ENDS[tag]
                limit = max(self.place(t) for t in limits)
                above = [places[i] for t in kinds if (i := bisect_right(places := self.opened[t], limit)) < len(places)]
                if above:
                    self.close(min(above))
            self.flush()
        elif tag == "a" and (k := self.place("a")) and k > self.levels[-1]:
            self.close(k)
        if tag in RAW or tag in VOID or closed and tag in ("svg", "path"):
            return
        page, above = self.page, self.stack[self.levels[-1]]
        node = len(page.tag)
        page.tag.append(tag)
        page.parent.append(self.stack[-1])
        page.first.append(len(page.blocks))
        page.last.append(len(page.blocks))
        self.path_of.append(self.path_of[above] if tag in INLINE else self.paths.setdefault((self.path_of[above], tag), len(self.paths) + 1))
        mark = None if tag in DROPPED or tag in WHOLE or tag in HEADINGS else _mark(tag, attributes)
        if mark is not None:
            page.marked[node] = mark
            if tag in INLINE:
                self.cuts[node] = (len(self.pieces), len(page.blocks))
        self.opened[tag].append(len(self.stack))
        if tag not in INLINE:
            self.levels.append(len(self.stack))
        self.stack.append(node)
        self.dropping += tag in DROPPED
        self.links += tag == "a"


def read_page(page: str) -> Page:
    """The blocks outside dropped tags, and all elements. A link left open ends where the next one opens in the same block."""
    out = _Builder()
    for kind, value, attributes, closed in tokens(page):
        if kind == "text":
            out.text(html.unescape(value))
        elif kind == "close":
            out.end(value)
        else:
            out.start(value, attributes, closed)
    out.close(1)
    out.flush()
    out.page.last[0] = len(out.page.blocks)
    return out.page


def path_scores(found: list[Block]) -> dict[int, float]:
    """Fused ratios of each path: text per block outside links, raised by punctuation per block."""
    chars, marks, count = defaultdict(float), defaultdict(int), defaultdict(int)
    for b in found:
        chars[b.path] += len(b.text) * (1 - b.linked)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        count[b.path] += 1
    return {p: chars[p] / n * (1 + marks[p] / n) for p, n in count.items()}


def content_blocks(found: list[Block]) -> list[bool]:
    """Of each block, whether its path holds content. Paths are judged by their smoothed scores; at least one always holds some."""
    scores = path_scores(found)
    line = np.array([scores[b.path] for b in found])
    kernel = np.exp(-0.5 * (np.arange(-_RADIUS, _RADIUS + 1) / _SIGMA) ** 2)
    weight = np.convolve(np.ones(len(line)), kernel)[_RADIUS:-_RADIUS]
    smooth = np.convolve(line, kernel)[_RADIUS:-_RADIUS] / weight
    total, count = defaultdict(float), defaultdict(int)
    for b, s in zip(found, smooth.tolist(), strict=True):
        total[b.path] += s
        count[b.path] += 1
    limit = _SHARE * float(smooth.std())
    best = max(scores.values())
    paths = {p for p, s in total.items() if s >= limit * count[p] and scores[p] >= 0.1 * best} or {max(scores, key=scores.get)}
    return [b.path in paths for b in found]


def _comment_sections(page: Page) -> set[int]:
    """The outermost elements that begin with the heading of a comment section."""
    out = set()
    for i, b in enumerate(page.blocks):
        k = b.node
        if page.tag[k] in HEADINGS and COMMENT_HEADING.fullmatch(b.text):
            while (up := page.parent[k]) and page.tag[up] not in WHOLE and page.first[up] == i:
                k = up
            out.add(k)
    return out


def _without_comments(page: Page) -> Page:
    """Leaves out reader comments, unless no prose would be left."""
    gone = {k for k, comments in page.marked.items() if comments} | _comment_sections(page)
    kept = page.outside(gone)
    prose = any(k and b.linked < _LINKED and (page.tag[b.node] == "p" or len(b.text.split()) >= 5 and _PUNCTUATION.search(b.text)) for b, k in zip(page.blocks, kept, strict=True))
    return page.only(kept) if prose else page


def _without_marked(page: Page) -> Page:
    """Leaves out marked elements. A mark tells nothing on what holds all content, nor on what holds every article (every main element, if there is
    no article), half of all content and the whole content of the article or main element around it."""
    marked = [k for k, comments in page.marked.items() if not comments]
    if not marked:
        return page
    content = [0, *accumulate(len(b.text) if c else 0 for b, c in zip(page.blocks, content_blocks(page.blocks), strict=True))]
    within = lambda k: content[page.last[k]] - content[page.first[k]]
    held = [k for k, tag in enumerate(page.tag) if tag in HOLDERS and within(k)]
    held = [k for k in held if page.tag[k] == "article"] or held
    start, end = (min(page.first[k] for k in held), max(page.last[k] for k in held)) if held else (-1, -1)
    holder = page.holders()

    def whole(k: int) -> bool:
        return bool(held) and page.first[k] <= start and end <= page.last[k] and 2 * within(k) >= content[-1] and (not holder[k] or within(holder[k]) == within(k))

    return page.only(page.outside({k for k in marked if within(k) < content[-1] and not whole(k)}))


def _chosen(page: Page) -> list[bool]:
    """Of each block, whether a chosen node holds it."""
    found, content = page.blocks, content_blocks(page.blocks)
    holder = page.holders()
    nearest = [0] * len(page.tag)  # the nearest element, itself included, that is neither inline nor a part
    for k in range(1, len(page.tag)):
        nearest[k] = nearest[page.parent[k]] if page.tag[k] in PARTS or page.tag[k] in INLINE else k
    held = {holder[b.node] for b, c in zip(found, content, strict=True) if c}
    if held - {0}:
        nodes = held - {0}
        near = {nearest[b.node] for b, c in zip(found, content, strict=True) if c and not holder[b.node]}
        nodes |= {k for k in near if k and page.tag[k] not in WHOLE and not any(page.first[k] <= page.first[h] and page.last[h] <= page.last[k] for h in nodes)}
        left = page.outside(nodes)
        return [not out or c and not holder[b.node] and b.linked < _LINKED for b, c, out in zip(found, content, left, strict=True)]
    places = [i for i, c in enumerate(content) if c]
    top = found[places[0]].node
    while top and not (page.first[top] <= places[0] and places[-1] < page.last[top] and page.tag[top] not in INLINE):
        top = page.parent[top]
    beside = defaultdict(set)  # the prose right in each element
    for b in found:
        if page.tag[b.node] in PROSE:
            beside[page.parent[b.node]].add(b.node)
    while top and (page.tag[top] in PARTS or beside[page.parent[top]] - {top}):
        top = page.parent[top]
    inside = range(page.first[top], page.last[top])
    # at the edges, text in links is a menu; amid the content it is the article's
    return [i in inside and (places[0] <= i <= places[-1] or b.linked < _LINKED or page.tag[b.node] in HEADINGS) for i, b in enumerate(found)]


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines; empty if there is none."""
    read = read_page(page or "")
    read = _without_marked(_without_comments(read)) if read.blocks else read
    if not read.blocks:
        return ""
    return "\n\n".join(b.text for b, kept in zip(read.blocks, _chosen(read), strict=True) if kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``. Null and empty html give empty text; a null url stays null.

    Rows are independent: null and repeated ids and other columns do no harm, and an empty table gives none. Very long pages are read whole,
    in time linear in their length and depth. No shuffle.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
