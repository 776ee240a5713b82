"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its tag path from the root (inline elements left out; a block that is all link ends in ``a``).
Items and cells count with the list or table that holds them: its path is theirs, it counts once, and it is a list of links if most of its text is.
For every path the operator sums text length, punctuation and number of blocks (lists, tables); the path's fused value is the text for each of
these, weighed with the punctuation per block.  Values are smoothed along the page, near paths more than far ones, and a path's ratio is the mean
of its blocks' smoothed values.  Paths whose ratio, weighed with what marks and links say, reaches ``LIMIT`` of the greatest ratio (of a path that is
no list or table, if there is one) are content, and their blocks are the text, wherever on the page they stand.  Marks are evidence beside the
ratios: within ``article`` or ``main`` all that is not mostly link is content; on pages with such marks, paths outside need the greatest ratio of all.
Menus, headers, footers, sidebars, notices, adverts, forms, comments and invisible elements, told by element, role or class, take no part; of a
class or id of several words all must be boilerplate's or say nothing (``site-footer``, but not ``related-work``).

Pages are independent: one pass, no shuffle.  Work and memory grow with the page's length alone: elements know their parent, and no path is
ever spelt out.

Defined results: null and empty pages give an empty text; a page without markup is one block; unclosed and stray
tags are taken as browsers take them (``p``, ``li``, cells and options end where the next one begins); a tag that the page's end cuts
off is dropped; after a quote that never closes, quotes no longer hide a tag's end; repeated rows are each
extracted; a page whose only text is boilerplate gives an empty text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object select canvas noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mtable mtr mtd mspace semantics".split()
)
#: Lists and tables, their parts, and what may stand in an item.
HOLDERS = frozenset("ul ol dl table".split())
HOLDER_PARTS = frozenset("li dt dd thead tbody tfoot tr td th caption".split())
ITEMS = frozenset("li dt dd".split())
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu input select fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Words of a class or id that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related recommended "
    "rss share sharing shoutbox sidebar social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Words that say nothing of their own beside these.
NEUTRAL_WORDS = frozenset(
    "a the and all area article articles aside bar block body bottom box btn button buttons col column container content count desktop fixed float floating form global group "
    "home icon icons inner item items js left line link links list main media mobile more notification outer page panel policy post posts primary reader right row section "
    "secondary signup site slot sticky stories story text title tools top unit user view wrap wrapper".split()
)
#: Beside these a word says how a page is laid out, not what an element is: ``layout-with-sidebar``.
MODIFIERS = frozenset("with without has have no non not layout".split())
#: Of these an article's own header is no boilerplate.
OWN_HEADER = frozenset(["header"])
MARKS = frozenset(["article", "main"])
#: Share of the greatest ratio from which a path is content; what marks make of a ratio: inside, inside but link, outside; and a link on other pages.
LIMIT, MARKED, MARKED_LINK, UNMARKED, LINK = 0.03, float("inf"), 0.1, 0.03, 0.03
#: Share of link text from which a list or table is one of links.
MOSTLY = 0.5

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟।]")


def _is_boiler(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate for sure, and whether its class or id says so."""
    if tag in BOILER_TAGS and not (in_article and tag in OWN_HEADER):
        return True, False
    by_class = False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                for word in value.split():
                    parts = [w for w in re.split(r"[^a-z]+", word) if w]
                    told = not BOILER_WORDS.isdisjoint(parts) and BOILER_WORDS.union(NEUTRAL_WORDS).issuperset(parts)
                    by_class |= (told or word in BOILER_WORDS) and MODIFIERS.isdisjoint(parts)
        elif name == "role":
            if value.strip() in BOILER_ROLES:
                return True, by_class
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, by_class
    return False, by_class


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) of a page's parts in order: ``text``, ``open`` with attributes, ``close``; comments and
    the content of raw elements are left out.  Linear in the page."""
    at, size = 0, len(page)
    last, plain = {c: page.rfind(c) for c in "\"'>"}, False
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name and after not in ("!", "?"):
            yield "text", "", page[at : lt + 1]
            at = lt + 1
            continue
        if lt > at:
            yield "text", "", page[at:lt]
        if not name:
            close = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(close, lt + 2)
            at = size if end < 0 else end + len(close)
            continue
        if name.end() > last[">"]:
            return
        end = name.end()
        while True:
            stop = STOP.search(page, end)
            if stop and stop[0] == ">":
                end = stop.end()
                break
            if plain or not stop or stop.end() > last[stop[0]]:
                plain = plain or bool(stop)
                end = page.find(">", name.end()) + 1
                break
            end = page.find(stop[0], stop.end()) + 1
        tag, attributes = name[0].lower(), page[name.end() : end - 1]
        at = end
        if closing:
            yield "close", tag, ""
        elif tag in RAW and not attributes.endswith("/"):
            yield "open", "br", ""
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else size
        else:
            yield "open", tag, attributes


class Blocks:
    """The text blocks of a page, boilerplate left out: text, path number, whether under a mark, and how far the path is from
    that of the block before.  Elements are rows of columns with their parent's number."""

    def __init__(self, page: str):
        self.parent, self.tag, self.hard, self.soft, self.path, self.depth, self.marked, self.holder = [0], [""], [False], [False], [0], [0], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        pieces: list[tuple[int, int, bool, str]] = []  # block, block element, in a link, text
        stack: list[tuple[int, str, bool]] = [(0, "", False)]  # element, tag, inline
        open_, block = Counter(), 0
        inner = [Counter()]  # inline tags open above each block element
        for kind, tag, content in tokens(page):
            if kind == "text":
                pieces.append((block, stack[-1][0], open_["a"] > 0, content))
                continue
            inline = tag in INLINE
            block += not inline
            if kind == "close":
                if inner[-1][tag] if inline else open_[tag]:
                    self._pop(stack, next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag), open_, inner)
                continue
            if tag in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1) if not inline else ():
                if tag in CLOSED_BY.get(stack[k][1], ()):
                    self._pop(stack, k, open_, inner)
                    break
                if not stack[k][2] and stack[k][1] != "p":
                    break
            above = stack[-1][0]
            open_[tag] += 1
            if inline:
                inner[-1][tag] += 1
            else:
                inner.append(Counter())
            hard, soft = _is_boiler(tag, content, open_["article"] > (tag == "article"))
            if inline and not (hard or soft):
                stack.append((above, tag, True))
                continue
            stack.append((len(self.parent), tag, inline))
            self.parent.append(above)
            self.tag.append(tag)
            self.hard.append(hard)
            self.soft.append(soft)
            self.path.append(self.path[above] if inline else self._path(self.path[above], tag))
            self.depth.append(self.depth[above] + (not inline))
            self.marked.append(self.marked[above] or tag in MARKS)
            self.holder.append(self._holder(len(self.parent) - 1, tag, inline))
        self._collect(pieces)

    def _holder(self, element: int, tag: str, inline: bool) -> int:
        """The list or table that an element belongs to: the outermost of lists in lists, the innermost table; 0 for none."""
        above = self.parent[element]
        held = self.holder[above]
        if tag in HOLDERS:
            return held if held and tag != "table" and self.tag[above] in ITEMS else element
        if inline or tag in HOLDER_PARTS or (tag == "p" and self.tag[above] in ITEMS):
            return held
        return 0

    def _path(self, above: int, tag: str) -> int:
        return self.paths.setdefault((above, tag), len(self.paths) + 1)

    @staticmethod
    def _pop(stack: list, k: int, open_: Counter, inner: list[Counter]) -> None:
        for _, tag, inline in reversed(stack[k:]):
            open_[tag] -= 1
            if inline:
                inner[-1][tag] -= 1
            else:
                inner.pop()
        del stack[k:]

    def _collect(self, pieces: list[tuple[int, int, bool, str]]) -> None:
        n = len(self.parent)
        # a class word on what holds the article says nothing
        holds = [t in MARKS for t in self.tag]
        for e in range(n - 1, 0, -1):
            holds[self.parent[e]] |= holds[e]
        bad = [False] * n
        for e in range(1, n):
            bad[e] = bad[self.parent[e]] or self.hard[e] or self.soft[e] and not holds[e]
        self.text: list[str] = []
        rows: list[list] = []  # block, element, link so far, text
        for block, element, link, text in pieces:
            if bad[element]:
                continue
            if rows and rows[-1][0] == block:
                rows[-1][2] &= link or not text.strip()
                rows[-1][3].append(text)
            else:
                rows.append([block, element, link or not text.strip(), [text]])
        kept, size, linked = [], Counter(), Counter()
        for _, element, link, parts in rows:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                kept.append((element, link, text))
                size[self.holder[element]] += len(text)
                linked[self.holder[element]] += len(text) * link
        kinds, units, own, apart, last = [], [], [], [], None
        for at, (element, link, text) in enumerate(kept):
            holder = self.holder[element]
            if holder:
                link = linked[holder] >= MOSTLY * size[holder]
            self.text.append(text)
            kinds.append((self.path[holder or element], bool(holder), link))
            units.append(-holder if holder else at)
            own.append((self.marked[element], link, bool(holder)))
            apart.append(0 if last is None or self.path[last] == self.path[element] else self._apart(last, element))
            last = element
        names = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
        self.which = np.array([names[k] for k in kinds], dtype=np.int64)
        #: How many blocks, or lists and tables, each path has.
        self.number = np.bincount([k for k, _ in dict.fromkeys(zip(self.which.tolist(), units, strict=True))], minlength=len(names))
        self.apart = np.array(apart, dtype=float)
        self.is_marked, self.is_link, self.is_held = (np.array([x[k] for x in own], dtype=bool) for k in range(3))

    def _apart(self, a: int, b: int) -> int:
        """Steps between two elements of the tree, inline ones not counted.  Blocks that follow each other are a walk through the tree, so
        all such walks of a page together are linear in it."""
        steps, x, y = 0, a, b
        while x != y:
            if x < y:
                x, y = y, x
            up = self.parent[x]
            steps += self.depth[x] - self.depth[up]
            x = up
        return steps


def path_ratios(which: np.ndarray, lengths: np.ndarray, points: np.ndarray, apart: np.ndarray, units: np.ndarray | None = None, spread: float = 1.5, reach: int = 3) -> np.ndarray:
    """The ratio of each path: text length per unit (block, list or table) times one plus the punctuation per block, averaged over neighbouring
    blocks with weights that fall with their distance on the page and between paths (``apart``: from the block before), and over the path's blocks."""
    n = int(which.max()) + 1
    number = np.bincount(which, minlength=n)
    fused = (np.bincount(which, lengths, n) / (number if units is None else units)) * (1 + np.bincount(which, points, n) / number)
    own = fused[which]
    total, weight = own.copy(), np.ones(len(own))
    steps = np.cumsum(apart)
    for step in range(1, min(reach, len(own) - 1) + 1):
        away = np.where(which[step:] == which[:-step], 0, steps[step:] - steps[:-step])
        w = np.exp(-(step**2) / (2 * spread**2)) / (1 + away) ** 2
        total[step:] += w * own[:-step]
        weight[step:] += w
        total[:-step] += w * own[step:]
        weight[:-step] += w
    return np.bincount(which, total / weight, n) / number


def main_text(page: str | None) -> str:
    """The article of one page: blocks of one space between words, joined by one space."""
    blocks = Blocks(page or "")
    if not blocks.text:
        return ""
    lengths = np.array([len(t) - t.count(" ") for t in blocks.text], dtype=float)
    points = np.array([len(PUNCTUATION.findall(t)) for t in blocks.text], dtype=float)
    ratios = path_ratios(blocks.which, lengths, points, blocks.apart, blocks.number)[blocks.which]
    evidence = np.where(blocks.is_link, LINK, 1.0)
    if blocks.is_marked.any():
        evidence = np.where(~blocks.is_marked, UNMARKED, np.where(blocks.is_link, MARKED_LINK, MARKED))
    plain = ratios[~blocks.is_held & ~blocks.is_link]
    greatest = plain.max() if len(plain) else ratios.max()
    chosen = ratios * evidence >= LIMIT * greatest * (1 - 1e-9)
    return " ".join(t for t, x in zip(blocks.text, chosen.tolist(), strict=True) if x)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
