"""Page markup as data.

``with_elements`` turns the html of a page into an array of elements in
document order.  An element knows its position, the position of its last
descendant, its own step (tag, classes, itemprop) and the span of visible
text pieces it covers.  "Inside this card" and "below that element" are
integer comparisons, a selector is a pattern for each of its steps: what an
element stores does not grow with its depth, and there is no limit to that.
Everything after this one step is column expressions; nothing is shuffled,
because a page stays one row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadloom.functions.text import bind
from leadloom.session import narrow_batches

_NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("i", "last")]
    + [T.StructField(n, T.StringType()) for n in ("tag", "step", "href")]
    + [T.StructField(n, T.IntegerType()) for n in ("t0", "t1")]
)
ELEMENTS_TYPE = T.StructType(
    [T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("texts", T.ArrayType(T.StringType()))]
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set("script style template".split())
_BLOCK = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"},
             "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = set("ul ol table dl select".split())


class _Elements(HTMLParser):
    """The elements of one page, a list for each field of an element, and the visible text pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.last: list[int] = []
        self.tag: list[str] = []
        self.step: list[str] = []
        self.href: list[str | None] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.depths: defaultdict[str, list[int]] = defaultdict(list)  # where elements of a tag are open, so that none is searched

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            at = self.open.pop()
            self.depths[self.tag[at]].pop()
            self.last[at], self.t1[at] = len(self.tag) - 1, len(self.texts)

    def _deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def _close_implied(self, tag: str) -> None:
        ended = _SIBLINGS.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        if ended and (depth := self._deepest(ended)) > self._deepest(_SCOPES):
            self._close_to(depth)

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        attr = {k: v or "" for k, v in reversed(attrs)}
        here, texts = len(self.tag), len(self.texts)
        self.last.append(here)
        self.tag.append(tag)
        self.step.append(".".join([tag, *attr.get("class", "").split(), *(["@" + attr["itemprop"]] if attr.get("itemprop") else []), ""]))
        self.href.append(attr.get("href"))
        self.t0.append(texts)
        self.t1.append(texts)
        if tag not in _VOID:
            self.depths[tag].append(len(self.open))
            self.open.append(here)

    def handle_endtag(self, tag):
        if self.depths.get(tag):
            self._close_to(self.depths[tag][-1])

    def handle_data(self, data):
        piece = data.strip()
        if piece and not (self.open and self.tag[self.open[-1]] in _HIDDEN):
            self.texts.append(piece)


def _elements(html: str | None) -> _Elements:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser._close_to(0)
    return parser


#: Pages whose elements are held as Python values at a time; then they are put into Arrow arrays.
_PAGES_AT_ONCE = 64


def _lists(parts: list[list], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, parts), initial=0)), pa.int32()), values)


def _arrays(htmls: list[str | None]) -> pa.StructArray:
    pages = [_elements(h) for h in htmls]
    fields = {"i": [range(len(p.tag)) for p in pages]} | {name: [getattr(p, name) for p in pages] for name in ("last", "tag", "step", "href", "t0", "t1")}
    kinds = {f.name: pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in _NODE}
    flat = {name: pa.array(list(chain.from_iterable(fields[name])), kinds[name]) for name in kinds}
    nodes = pa.StructArray.from_arrays(list(flat.values()), list(flat))
    texts = [p.texts for p in pages]
    return pa.StructArray.from_arrays(
        [_lists([p.tag for p in pages], nodes), _lists(texts, pa.array(list(chain.from_iterable(texts)), pa.string()))], ["nodes", "texts"])


@F.arrow_udf(ELEMENTS_TYPE)
def _parse(html: pa.Array) -> pa.Array:
    return pa.concat_arrays([_arrays(html[at : at + _PAGES_AT_ONCE].to_pylist()) for at in range(0, max(1, len(html)), _PAGES_AT_ONCE)])


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column by ``nodes`` and ``texts``.

    Elements are many times larger than their page; they leave a worker in
    small batches, so that what it holds does not grow with the table.
    """
    narrow_batches(pages.sparkSession)
    parsed = pages.withColumn("_page", _parse(F.col(html)))
    return parsed.select(*[c for c in pages.columns if c != html], "_page.nodes", "_page.texts")


# --- selectors -------------------------------------------------------------

_STEP = re.compile(r"([a-z][a-z0-9]*)?((?:\.[\w-]+)*)((?:\[[^\]]+\])*)")


def _step_test(step: str) -> Callable[[Column], Column]:
    """Does an element fit one step of a selector, whatever is around it?"""
    tag, classes, attributes = _STEP.fullmatch(step).groups()
    ahead = "".join(rf"(?=[^ ]*\.{re.escape(c)}\.)" for c in classes.split(".") if c)
    hrefs: list[Callable[[Column], Column]] = []
    for name, op, value in re.findall(r"\[([a-z]+)(\*?=)?'?([^'\]]*)'?\]", attributes):
        if name == "class":
            ahead += rf"(?=[^ .]+\.(?:[^ .@]+\.)*[^ .@]*{re.escape(value)})"
        elif name == "itemprop":
            ahead += rf"(?=[^ ]*\.@{re.escape(value)}\.)"
        elif name == "href" and op:
            hrefs.append(lambda n, v=value: F.contains(F.coalesce(n["href"], F.lit("")), F.lit(v)))
        elif name == "href":
            hrefs.append(lambda n: n["href"].isNotNull())
    pattern = rf"^{ahead}{tag or '[^ .]+'}\.[^ ]*$"
    return lambda n: reduce(Column.__and__, [test(n) for test in hrefs], n["step"].rlike(pattern))


def below(node: Column, outer: Column) -> Column:
    """Is the element inside one of ``outer``?"""
    return F.exists(outer, lambda o: (node["i"] > o["i"]) & (node["i"] <= o["last"]))


def select(nodes: Column, selector: str, page: Column | None = None) -> Column:
    """The elements of ``nodes`` that match a selector (descendant steps, comma alternatives), in their order.

    The elements around them are looked up in ``page`` (all elements of the
    page, or ``around_and_inside``), where ``nodes`` are only some of them.  Each step keeps the elements
    that fit it and lie below one that the steps before kept; these are found
    once for all elements.
    """
    page = nodes if page is None else page
    chains = [[_step_test(s) for s in alternative.split()] for alternative in selector.split(",")]

    def kept(chain: list, use: Callable[[Column | None], Column], outer: Column | None = None) -> Column:
        """``use`` with the elements that the steps of ``chain`` but the last one keep."""
        if len(chain) == 1:
            return use(outer)
        found = F.filter(page, lambda n: chain[0](n) if outer is None else chain[0](n) & below(n, outer))
        return bind(found, lambda hits: kept(chain[1:], use, hits))

    def union(left: list, tests: list) -> Column:
        if left:
            last = left[0][-1]
            return kept(left[0], lambda outer: union(left[1:], [*tests, lambda n: last(n) if outer is None else last(n) & below(n, outer)]))
        return F.filter(nodes, lambda n: reduce(Column.__or__, [test(n) for test in tests]))

    return union(chains, [])


def first_selection(nodes: Column, selectors: list[str]) -> Column:
    """Elements of the first selector that finds any."""
    found = [
        F.get(F.filter(F.array(select(nodes, s)), lambda hits: F.size(hits) > 0), 0) for s in selectors
    ]
    return F.coalesce(*found, F.slice(nodes, 1, 0))


def inside(nodes: Column, outer: Column) -> Column:
    return F.filter(nodes, lambda n: (n["i"] > outer["i"]) & (n["i"] <= outer["last"]))


def around_and_inside(nodes: Column, node: Column) -> Column:
    """An element, those around it and those inside: all that a selector over what is inside can ask for."""
    return F.filter(nodes, lambda n: ((n["i"] <= node["i"]) & (n["last"] >= node["last"])) | ((n["i"] > node["i"]) & (n["i"] <= node["last"])))


def select_one(nodes: Column, selectors: list[str], page: Column | None = None) -> Column:
    """First element, in document order, of the first selector that finds any; null if none does."""
    return F.coalesce(*[F.get(select(nodes, s, page), 0) for s in selectors])


def ancestor(nodes: Column, node: Column, test) -> Column:
    """Nearest enclosing element that passes ``test``."""
    around = F.filter(nodes, lambda p: (p["i"] < node["i"]) & (p["last"] >= node["i"]) & test(p))
    return F.try_element_at(around, F.lit(-1))


def text_of(texts: Column, node: Column, glue: str = " ") -> Column:
    """Visible text of an element; empty for no element."""
    piece = F.slice(texts, node["t0"] + 1, node["t1"] - node["t0"])
    return F.coalesce(F.array_join(piece, glue), F.lit(""))
