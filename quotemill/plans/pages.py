"""Pages as arrays of their elements: one linear pass a page in tasks, everything after it as expressions and groups.  CSS selectors become
filters over the array (:func:`select`).

Unclosed paragraphs, items and cells end where HTML ends them; end tags without a start and text of scripts, styles and ``noscript`` count for
nothing.  Null and empty pages have no elements.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.rules import normal_url
from quotemill.operators.batches import small
from quotemill.operators.keyed import ranked_dedupe, top_per_group

BOXES = frozenset(("article", "main", "div", "section"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SILENT = frozenset(("script", "style", "noscript"))
#: Elements whose content is text to their end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title", "textarea")}
SCOPES = BOXES | {"body", "html", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "ol", "li", "header", "footer", "nav", "aside", "form", "blockquote"}
BLOCKS = SCOPES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "dl", "figure"}
#: What an opening tag ends, and the tags that shield it.
_ROW = {"tr", "td", "th", "p"}
_PART = _ROW | {"thead", "tbody", "tfoot"}
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": (_ROW, {"table"}), "thead": (_PART, {"table"}), "tbody": (_PART, {"table"}), "tfoot": (_PART, {"table"}), "a": ({"a"}, SCOPES),
}
#: A paragraph of so many characters counts as text.
LONG = 40

#: An element: its number, those of its last descendant and its parent, its tag and attributes, for links the tags and classes of it and its two
#: ancestors, the number of its table row, where its text begins and ends in the page's (bytes), and for containers what their paragraphs hold.
ELEMENT = [
    ("at", "int", pa.int32()), ("last", "int", pa.int32()), ("parent", "int", pa.int32()), ("name", "string", pa.string()), ("attrs", "map<string,string>", pa.map_(pa.string(), pa.string())),
    ("chain", "string", pa.string()), ("row", "int", pa.int32()), ("from", "int", pa.int32()), ("to", "int", pa.int32()),
    ("paragraphs", "int", pa.int32()), ("long", "int", pa.int32()), ("chars", "bigint", pa.int64()), ("linked", "int", pa.int32()),
]
_ARROW = pa.list_(pa.struct([pa.field(n, t) for n, _, t in ELEMENT]))
_SPARK = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t, _ in ELEMENT) + ">>"

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*(=)\s*([\"'])?)?)")
_BARE = re.compile(r"[^\s>]*")
_CLOSED = re.compile(r"&(#(?:[0-9]+|[xX][0-9A-Fa-f]+);|\w+;)")


def _closed(text: str) -> str:
    """Decodes the character references that end in a semicolon."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0]), text)


#: How character references are read: as HTML does, which knows ``&amp`` without its semicolon as well, or only those that are closed.
REFERENCES: dict[str, Callable[[str], str]] = {"html": unescape, "closed": _closed}


def _tokens(page: str, decoded: Callable[[str], str] = unescape) -> Iterator[tuple[str, str, dict | None]]:
    """(kind, text or name, attributes) in one pass forwards: ``text``, ``raw``, ``start``, ``end``.  What a page leaves open ends with it."""
    at = 0
    while True:
        begin = page.find("<", at)
        if begin != at:
            yield "text", decoded(page[at : begin if begin >= 0 else len(page)]), None
        if begin < 0:
            return
        m = _OPEN.match(page, begin)
        if not m:
            yield "text", "<", None
            at = begin + 1
            continue
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else ">", m.end())
            if end < 0:
                return
            at = end + (3 if m[1] else 1)
            continue
        name, attrs, at = m[4].lower(), {}, m.end()
        while True:
            a = _ATTR.match(page, at)
            if not a:
                return
            at = a.end()
            if a[1]:
                break
            value = ""
            if a[4]:
                end = page.find(a[4], at)
                if end < 0:
                    return
                value, at = page[at:end], end + 1
            elif a[3]:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            attrs.setdefault(a[2].lower(), decoded(value))
        yield ("end" if m[3] else "start"), name, attrs
        if not m[3] and name in RAW:
            closed = RAW[name].search(page, at)
            end = closed.start() if closed else len(page)
            yield "raw", page[at:end], None
            at = end


class _Pass:
    def __init__(self, references: str = "html"):
        self.decoded = REFERENCES[references]
        self.stack, self.open, self.boxes, self.rows, self.words, self.kept, self.told = [], Counter(), [], [], [], [], []
        self.count = self.anchors = self.silent = self.bytes = self.chars = 0

    def start(self, tag: str, attrs: dict) -> None:
        names, shields = ENDS.get(tag, ({"p"}, SCOPES) if tag in BLOCKS else ((), ()))
        if any(self.open[n] for n in names):
            self._end(names, shields)
        node = {"at": self.count, "parent": self.stack[-1]["at"] if self.stack else None, "name": tag, "attrs": attrs, "from": self.bytes, "before": self.chars, "anchors": self.anchors}
        node["label"] = ".".join([tag, *attrs.get("class", "").split()[:2]])
        self.count += 1
        self.anchors += tag == "a"
        if tag == "a" or tag in BOXES:
            node["chain"] = " ".join([n["label"] for n in self.stack[-2:]] + ["a[href]" if node["label"] == "a" else node["label"]])
        node |= {"row": self.rows[-1] if self.rows and not self.open["thead"] else None}
        if tag in VOID:
            self._keep(node)
            return
        if tag == "tr":
            self.rows.append(node["at"])
            node["row"] = None if self.open["thead"] else node["at"]
        if tag in BOXES:
            node |= {"paragraphs": 0, "long": 0, "chars": 0, "linked": 0}
            self.boxes.append(node)
        self.silent += tag in SILENT
        self.open[tag] += 1
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if self.open[tag]:
            self._end({tag}, () if tag in SCOPES or tag in SILENT else SCOPES - {tag})

    def text(self, data: str) -> None:
        if not self.silent:
            for word in data.split():
                self.words.append(word)
                self.bytes += len(word.encode("utf-8", "replace")) + 1
                self.chars += len(word) + 1

    def _end(self, names, shields) -> None:
        """End everything from the outermost of ``names`` above the nearest shield on; for end tags, the innermost."""
        depth = None
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i]["name"]
            if name in names:
                depth = i
                if len(names) == 1:
                    break
            elif name in shields:
                break
        while depth is not None and len(self.stack) > depth:
            self._leave()

    def _leave(self) -> None:
        node = self.stack.pop()
        tag = node["name"]
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        if tag == "p" and self.boxes:
            box, size = self.boxes[-1], max(0, self.chars - node["before"] - 1)
            box["paragraphs"] += 1
            box["linked"] += self.anchors > node["anchors"]
            if size >= LONG:
                box["long"] += 1
                box["chars"] += size
        if tag in BOXES:
            self.boxes.pop()
            if self.boxes:
                for k in ("paragraphs", "long", "chars", "linked"):
                    self.boxes[-1][k] += node[k]
        if tag == "tr":
            self.rows.pop()
        self._keep(node)

    def _keep(self, node: dict) -> None:
        row = {k: node.get(k) for k, _, _ in ELEMENT}
        self.kept.append(row | {"last": self.count - 1, "to": self.bytes, "attrs": list(node["attrs"].items())})

    def run(self, page: str | None) -> _Pass:
        for kind, text, attrs in _tokens(page or "", self.decoded):
            if kind == "start":
                self.start(text, attrs)
            elif kind == "end":
                self.end(text)
            elif kind == "text":
                self.text(text)
            elif self.stack and self.stack[-1]["name"] == "script":
                if self.stack[-1]["attrs"].get("type", "").strip().lower() == "application/ld+json":
                    self.told.append(text)
            else:
                self.text(self.decoded(text))
        while self.stack:
            self._leave()
        self.kept.sort(key=lambda e: e["at"])
        return self


def with_elements(pages: DataFrame, html: str = "html", references: str = "html") -> DataFrame:
    """The pages with ``elements``, all of them in page order; ``words``, the page's text once, each word with a blank behind it, as bytes; and ``told``, the
    contents of JSON-LD scripts.  The texts of elements are spans of ``words`` (:func:`text_of`), so nested ones cost no copies.  ``references``: a key of ``REFERENCES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, (html,)):  # the elements of a page take many times its bytes
            found = [_Pass(references).run(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            words = pa.array([("".join(f"{w} " for w in f.words)).encode("utf-8", "replace") for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.kept for f in found], _ARROW), words, pa.array([f.told for f in found], pa.list_(pa.string()))], [*batch.schema.names, "elements", "words", "told"])

    more = [T.StructField("elements", T.DataType.fromDDL(_SPARK)), T.StructField("words", T.BinaryType()), T.StructField("told", T.ArrayType(T.StringType()))]
    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, *more]))


def text_of(e: Column) -> Column:
    """An element's text, its words with a blank between them."""
    return F.rtrim(F.substring(F.col("words"), e["from"] + 1, e["to"] - e["from"]).cast("string"))


def _attr(e: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a column named twice would be planned, and run, twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- selectors

_PART_OF = re.compile(r"""\s*(?:
    (?P<comma>,) | (?P<child>>) | (?P<tag>\*|[A-Za-z][A-Za-z0-9-]*) | \.(?P<class>[\w-]+) | \#(?P<id>[\w-]+)
    | \[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]
)""", re.VERBOSE)


def parsed_selector(css: str) -> list[list[tuple[str, list[tuple]]]]:
    """A list of selectors, each a list of (combinator, conditions) from the outermost element in; a condition is
    (attribute or ``tag``, operator, value).  Descendants, children, tags, classes, ids and attributes."""
    out, steps, combinator, tests, at = [], [], " ", [], 0

    def close() -> None:
        nonlocal tests
        if tests:
            steps.append((combinator, tests))
            tests = []

    css = css.strip()
    while at < len(css):
        m = _PART_OF.match(css, at)
        if not m:
            raise ValueError(f"cannot read the selector {css!r} at {css[at:]!r}")
        spaced = css[at].isspace()
        at = m.end()
        if m["comma"] or m["child"]:
            had = bool(tests)
            close()
            if not steps or (combinator == ">" and not had):
                raise ValueError(f"empty part in the selector {css!r}")
            if m["comma"]:
                out.append(steps)
                steps, combinator = [], " "
            else:
                combinator = ">"
            continue
        if spaced and tests:
            close()
            combinator = " "
        if m["tag"]:
            if tests:
                raise ValueError(f"cannot read the selector {css!r}")
            tests.append(("tag", "=", m["tag"].lower()))
        elif m["class"]:
            tests.append(("class", "~=", m["class"]))
        elif m["id"]:
            tests.append(("id", "=", m["id"]))
        else:
            value = next((v for v in (m["d"], m["s"], m["bare"]) if v is not None), None)
            tests.append((m["attr"].lower(), m["op"] or "", value))
    had = bool(tests)
    close()
    if not steps or (combinator == ">" and not had):
        raise ValueError(f"empty part in the selector {css!r}")
    return [*out, steps]


def _fits(e: Column, tests: list[tuple]) -> Column:
    def one(attr: str, op: str, value: str | None) -> Column:
        if attr == "tag":
            return F.lit(True) if value == "*" else e["name"] == value
        own = _attr(e, attr)
        if not op:
            return F.map_contains_key(e["attrs"], attr)
        if op == "~=":
            return F.array_contains(F.split(own, r"\s+"), value)
        if op == "|=":
            return (own == value) | own.startswith(f"{value}-")
        known = {"=": own == value, "^=": own.startswith(value), "$=": own.endswith(value), "*=": own.contains(value)}[op]
        return known if value else known & F.map_contains_key(e["attrs"], attr) & F.lit(op == "=")

    return functools.reduce(Column.__and__, (one(*t) for t in tests))


def select(elements: Column, css: str) -> Column:
    """The elements that a CSS selector matches, in page order, each once.

    A step filters the elements by its own conditions and by the spans (or numbers) of what the step before matched, which are computed
    once for each page."""

    def children(tests: list[tuple]):
        return lambda p: F.filter(elements, lambda e: _fits(e, tests) & F.array_contains(p, e["parent"]))

    def descendants(tests: list[tuple]):
        return lambda p: F.filter(elements, lambda e: _fits(e, tests) & F.exists(p, lambda m: (m["at"] < e["at"]) & (e["at"] <= m["last"])))

    def matched(steps: list[tuple[str, list[tuple]]]) -> Column:
        found = F.filter(elements, lambda e: _fits(e, steps[0][1]))
        for combinator, tests in steps[1:]:
            if combinator == ">":
                found = _let(F.transform(found, lambda m: m["at"]), children(tests))
            else:
                found = _let(F.transform(found, lambda m: F.struct(m["at"].alias("at"), m["last"].alias("last"))), descendants(tests))
        return found

    parts = [matched(steps) for steps in parsed_selector(css)]
    if len(parts) == 1:
        return parts[0]
    numbers = F.concat(*(F.transform(p, lambda e: e["at"]) for p in parts))
    return _let(numbers, lambda n: F.filter(elements, lambda e: F.array_contains(n, e["at"])))


def one_text(css: str) -> Column:
    """The text of the first element that a selector matches; null where none does."""
    return _let(F.get(select(F.col("elements"), css), F.lit(0)), text_of)


def all_texts(css: str) -> Column:
    """The texts of all elements that a selector matches, joined by a blank."""
    return F.array_join(F.filter(F.transform(select(F.col("elements"), css), text_of), lambda t: t != ""), " ")


# --- articles

#: Names, ids and classes of containers that hold no article.
NOISE_BOX = r"(?i)(nav|menu|footer|header|sidebar|comment|related|banner|ads?|social|breadcrumb|tag-list|share|widget|popup|subscribe)"


def best_body(elements: Column) -> Column:
    """With the column ``words``: the paragraphs, joined by a blank, of the container with the most text: its characters in paragraphs of 40 or more, 50 for each of these, 200 off for
    the share with links, 500 for ``article``; equal ones: the first.  Null without a container of two such paragraphs."""
    named = lambda e: F.concat_ws(" ", _attr(e, "id"), _attr(e, "class"), e["name"])
    boxes = F.filter(elements, lambda e: e["name"].isin(*BOXES) & (e["long"] >= 2) & ~named(e).rlike(NOISE_BOX))
    score = lambda e: e["chars"] + e["long"] * 50 - e["linked"] / e["paragraphs"] * 200 + F.when(e["name"] == "article", 500).otherwise(0)
    best = F.array_max(F.transform(boxes, lambda e: F.struct(score(e).alias("score"), (-e["at"]).alias("at"), e["last"].alias("last"))))
    return _let(best, lambda b: F.when(b["score"] > 0, F.array_join(F.transform(F.filter(elements, lambda e: (e["name"] == "p") & (e["at"] > -b["at"]) & (e["at"] <= b["last"]) & (e["to"] > e["from"])), text_of), " ")))


# --- links

#: Parts of addresses that no article has, and of those that sections have.
NOISE_LINK = r"(?i)(login|register|javascript:|mailto:|#|facebook|youtube|tiktok|/tag/|/tim-kiem|search)"
SECTIONS = ("kinh-doanh", "chung-khoan", "tai-chinh", "doanh-nghiep", "thi-truong", "ngan-hang", "co-phieu", "bat-dong-san", "smart-money", "nhan-dinh", "phan-tich", "chn", "htm")
ANY_LINK = "article a[href], h3 a[href]"


def absolute_url(page: Column, href: Column) -> Column:
    """A link of a page as a full address: ``.`` and ``..`` resolved."""
    base, here = F.regexp_extract(page, r"^([A-Za-z]+://[^/?#]+)", 1), F.regexp_extract(page, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)

    def resolved(path: Column) -> Column:
        parts = F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda done, p: F.when(p == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
        )
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(parts, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)

    def full(h: Column) -> Column:
        folder = F.coalesce(F.nullif(F.regexp_extract(here, "^(.*/)", 1), F.lit("")), F.lit("/"))
        joined = F.when(h.startswith("/"), h).when(h.startswith("?"), F.concat(here, h)).otherwise(F.concat(folder, h))
        local = _let(joined, lambda j: F.concat(base, _let(F.regexp_extract(j, r"^([^?#]*)", 1), resolved), F.regexp_extract(j, r"^[^?#]*(.*)$", 1)))
        return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z]+:)", 1), h)).otherwise(local)

    return _let(F.trim(href), full)


def scored_links(pages: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """page_id, at, href, text, chain, score of the links to pages of the same host: a tenth of the text's length, at most 12, 3 for a section's word in the path, 1
    for the ending of an article."""
    own = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    hit = F.filter("elements", lambda e: (e["name"] == "a") & F.map_contains_key(e["attrs"], "href") & (e["to"] > e["from"]))
    named = F.transform(hit, lambda e: F.struct(e["at"].alias("at"), text_of(e).alias("text"), e["chain"].alias("chain"), _let(absolute_url(F.col("url"), _attr(e, "href")), normal_url).alias("href")))
    # An exploded column ends the reach of the optimizer, which would else copy the address's expression into each use of it.
    d = with_elements(pages.select("page_id", "url", "html")).select("page_id", own.alias("own"), F.explode(named).alias("x")).select("page_id", "own", "x.*")
    d = d.where(F.col("href").rlike("^https?://") & ~F.col("href").rlike(NOISE_LINK) & F.endswith(F.lower(F.try_parse_url("href", F.lit("HOST"))), F.col("own")))
    path = F.lower(F.coalesce(F.try_parse_url("href", F.lit("PATH")), F.lit("")))
    score = F.least(F.length("text"), F.lit(120)) / 10 + F.when(path.rlike("|".join(map(re.escape, sections)) or "$^"), 3).otherwise(0) + F.when(path.rlike(r"\.(chn|html?)$"), 1).otherwise(0)
    return d.select("page_id", "at", "href", "text", "chain", score.alias("score"))


def page_links(pages: DataFrame, n: int = 20, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """page_id, href, text, score, rank of a page's n best addresses, each by its first link with a text of 4 characters and a score of 1; equal scores in page order."""
    d = ranked_dedupe(scored_links(pages, sections).where("length(text) >= 4 and score >= 1"), ["page_id", "href"], [F.asc("at")])
    return top_per_group(d, ["page_id"], [F.desc("score"), F.asc("at")], n).drop("at", "chain")


def link_patterns(pages: DataFrame, least: float = 2.0, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """page_id, pattern, n: the most frequent tags and classes of links with a score of ``least`` and their two ancestors; equal ones: the one met first.
    Pages without such links get a general pattern and 0."""
    counted = scored_links(pages, sections).where(F.col("score") >= least).groupBy("page_id", "chain").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counted.groupBy("page_id").agg(F.max_by("chain", F.struct("n", -F.col("at"))).alias("pattern"), F.max("n").alias("n"))
    return pages.select("page_id").distinct().join(best, "page_id", "left").select("page_id", F.coalesce("pattern", F.lit(ANY_LINK)).alias("pattern"), F.coalesce("n", F.lit(0)).alias("n"))


# --- tables of disclosures

#: Calls, attributes and cells of disclosure tables.
CALL = r"(?i)(?:ViewDetailArticlesByID|ShowFileAttach)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
ID_ATTRS = ("data-articlesid", "data-articleid", "data-article-id", "data-article", "data-id", "data-article_id")
DATE_CELL = r"^\d{1,2}/\d{1,2}/\d{4}(?:\s+\d{1,2}:\d{2})?$"
TICKER_CELL = "^[A-Z0-9]{2,10}$"
#: More bytes than such a cell has.
CELL = 64


def disclosure_rows(pages: DataFrame) -> DataFrame:
    """page_id, row, ticker, title, article_id, file_attach, published_at of table rows that have a title link and an article's number: in the call of the
    attachment, of the title, or in an attribute.  Rows in ``thead`` are none."""
    e = F.col("e")
    # cells are compared with short patterns alone, so the text of a long one is never cut out
    kept = F.filter("elements", lambda x: x["row"].isNotNull() & x["name"].isin("a", "td", "tr"))
    short = lambda x: (x["name"] == "a") | ((x["name"] == "td") & (x["to"] - x["from"] <= CELL))
    cut = F.transform(kept, lambda x: x.withField("text", F.when(short(x), text_of(x)).otherwise("")))
    d = with_elements(pages.select("page_id", "html")).select("page_id", F.explode(cut).alias("e"))
    has_class = lambda c: F.array_contains(F.split(_attr(e, "class"), r"\s+"), c)
    link, onclick = e["name"] == "a", _attr(e, "onclick")
    own = F.coalesce(*(F.when(_attr(e, a).rlike(r"^\s*\d+\s*$"), F.trim(_attr(e, a)).cast("long")) for a in ID_ATTRS))
    called = lambda i: F.nullif(F.regexp_extract(onclick, CALL, i), F.lit("")).cast("long")
    what = F.struct(e["text"].alias("text"), called(1).alias("id"), F.when(called(1).isNotNull(), F.coalesce(called(2), F.lit(0))).alias("file"), own.alias("own"))
    title = link & (has_class("hrefViewDetail") | onclick.contains("ViewDetailArticlesByID"))
    attached = link & (has_class("icon-FileAttach") | onclick.contains("ShowFileAttach"))
    cell = lambda pattern: F.max_by(e["text"], F.when((e["name"] == "td") & e["text"].rlike(pattern), e["at"]))
    symbol = link & (e["chain"].rlike(r"(^| )td(\.\S+)?\.SYMBOL( |\.)") | _attr(e, "href").contains("/chi-tiet-chung-khoan-"))
    first = lambda hit, better: F.min_by(what, F.when(hit, F.struct(~better, e["at"])))
    g = d.groupBy("page_id", e["row"].alias("row")).agg(
        first(title, has_class("hrefViewDetail")).alias("t"), first(attached, has_class("icon-FileAttach")).alias("f"), F.max(F.when(e["name"] == "tr", own)).alias("own"),
        cell(DATE_CELL).alias("published_at"), cell(TICKER_CELL).alias("cell"), F.upper(F.min_by(e["text"], F.when(symbol, e["at"]))).alias("symbol"),
    )
    number = F.coalesce("f.id", "t.id", "t.own", "f.own", "own")
    ticker = F.coalesce("cell", F.when(F.col("symbol").rlike(TICKER_CELL), F.col("symbol")), F.lit(""))
    return g.where((F.col("t.text") != "") & number.isNotNull()).select(
        "page_id", "row", ticker.alias("ticker"), F.col("t.text").alias("title"), number.alias("article_id"), F.coalesce("f.file", "t.file", F.lit(0)).alias("file_attach"), F.coalesce("published_at", F.lit("")).alias("published_at"))
