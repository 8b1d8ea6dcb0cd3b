"""Review blocks out of stored HTML pages, and the rule that ends a paged source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# HTML elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# The class of a review block, and the columns of a review in order.
BLOCK = "review-details-holder"
FIELDS = ("date", "user", "age", "gender", "patient_type", "medication_duration", "condition", "overall_rating", "effectiveness", "ease_of_use", "satisfaction", "likes", "dislikes", "textual_review")


@dataclass(frozen=True)
class Place:
    """Where a field stands: nodes, the texts or the attribute read there, which one of them, and how it is cleaned."""

    path: str
    attr: str | None = None  # read instead of the nodes' own texts
    at: int = 0
    skip: tuple[str, ...] = ()  # texts that don't count as positions
    without: tuple[str, ...] = ()
    only_with: str = ""
    default: str | None = None


RATE, MARKER = "webmd-rate", "On medication for"
_SPAN, _RATED = "div.details >span", f"div~{RATE}"
# Places of the fields. In a path, a blank leads to descendants and > to children; .x is the whole class, ~x a part of
# it, #n the node's number.
PLACES = {
    "date": Place("div.date"),
    "user": Place(_SPAN, at=0, skip=("",), without=("|",)),
    "age": Place(_SPAN, at=1, skip=("",), without=("|",)),
    "gender": Place(_SPAN, at=2, skip=("",), without=("|",)),
    "patient_type": Place(_SPAN, at=-1, skip=("",), only_with="Patient"),
    "medication_duration": Place("div.details", skip=("", "|"), without=(MARKER, "|")),
    "condition": Place("strong.condition", without=("Condition: ",)),
    "overall_rating": Place(f"div.overall-rating {_RATED}", attr="aria-valuenow"),
    "effectiveness": Place(f"div.categories >section#0 {_RATED}", attr="aria-valuenow"),
    "ease_of_use": Place(f"div.categories >section#1 {_RATED}", attr="aria-valuenow"),
    "satisfaction": Place(f"div.categories >section#2 {_RATED}", attr="aria-valuenow"),
    "likes": Place("div~like-dislikes div.helpful span.likes"),
    "dislikes": Place("div~like-dislikes div.not-helpful span.dislikes", default="0"),
}
# Of a details text split at bars, the part that fills a field without a value, and what that part must hold.
PARTS = {"user": (0, ""), "age": (1, ""), "gender": (2, ""), "medication_duration": (3, MARKER), "patient_type": (4, "")}
# The review's text, the first kind that a block has: paths, and what joins their texts.
BODY = "div.description p.description-text"
BODIES = (((f"{BODY} span~showSec", f"{BODY} span~hiddenSec"), ""), ((BODY,), " "))


_STEP = re.compile(r"(>?)(\w+)(?:\.([\w-]+))?(?:~([\w-]+))?(?:#(\d+))?")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    @property
    def cls(self) -> str:
        return self.attrs.get("class") or ""

    def nodes(self) -> Iterator[Node]:
        """Descendants in document order."""
        for x in self.items:
            if isinstance(x, Node):
                yield x
                yield from x.nodes()

    def texts(self) -> list[str]:
        return [x for x in self.items if isinstance(x, str)]

    def all_text(self) -> Iterator[str]:
        for x in self.items:
            if isinstance(x, str):
                yield x
            else:
                yield from x.all_text()

    def find(self, path: str) -> list[Node]:
        """Nodes at the end of a path."""
        found = [self]
        for child, tag, exact, part, number in _STEP.findall(path):
            near = (x for n in found for x in (n.nodes() if not child else (y for y in n.items if isinstance(y, Node))))
            found = [x for x in near if x.tag == tag and exact in ("", x.cls) and part in x.cls]
            if number:
                found = found[int(number) :][:1]
        return found


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p":  # a paragraph ends the one before
            up = self.at
            while up.parent is not None and up.tag not in ("p", "div", "article", "body"):
                up = up.parent
            if up.tag == "p":
                self.at = up.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.items.append(data)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _read(block: Node, place: Place) -> str | None:
    """The value at a place; null where it is blank or not there, unless the place has a default."""
    nodes = block.find(place.path)
    told = [n.attrs.get(place.attr) or "" for n in nodes] if place.attr else [t.strip() for n in nodes for t in n.texts()]
    told = [t for t in told if t not in place.skip]
    value = next(iter(told[place.at :]), "")
    if place.only_with not in value:
        value = ""
    for mark in place.without:
        value = value.replace(mark, "")
    return value.strip() or place.default


def _body(block: Node) -> str:
    """The review's text without white space and quotes around it: the long form, else the short one, else any text of the description."""
    for paths, joint in BODIES:
        told = [t.strip() for path in paths for n in block.find(path) for t in n.texts()]
        if joint:
            told = list(filter(None, told))
        if told:
            break
    else:
        told, joint = [t.strip() for n in block.find("div.description")[:1] for t in n.all_text() if t.strip()][:1], ""
    return joint.join(told).strip().strip('"')


def review(block: Node) -> dict[str, str | None]:
    """The fields of a review block as PLACES has them; PARTS of the details' text fill gaps."""
    out = {field: _read(block, place) for field, place in PLACES.items()}
    parts = [p.strip() for p in "".join(t for n in block.find("div.details") for t in n.all_text()).split("|") if p.strip()]
    for field, (k, mark) in PARTS.items():
        if out[field] is None and k < len(parts) and mark in parts[k]:
            out[field] = parts[k].replace(mark, "").strip()
    out["textual_review"] = _body(block)
    return {field: out[field] for field in FIELDS}


def review_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row per review block of each page: the page's other columns, block (from 0) and the fields as texts."""
    keep = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, html in zip(pdf[keep].itertuples(index=False), pdf[html_col], strict=True):
                for k, block in enumerate(tree(html).find(f"div~{BLOCK}")):
                    rows.append((*own, k, *review(block).values()))
            yield pd.DataFrame(rows, columns=[*keep, "block", *FIELDS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keep), "block int", *(f"{f} string" for f in FIELDS)])
    return pages.mapInPandas(run, schema)


def elements(pages: DataFrame, tag: str, attr: str | None = None, html_col: str = "html") -> DataFrame:
    """pages with found: the stripped text, or an attribute, of every element of the tag; blanks are null."""
    keep = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[(n.attrs.get(attr) if attr else " ".join("".join(n.all_text()).split()) or None) for n in tree(h).find(tag)] for h in pdf[html_col]]
            yield pdf[keep].assign(found=found)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keep), "found array<string>"])
    return pages.mapInPandas(run, schema)


def tag_attribute(html: Column, tag: str, attr: str) -> Column:
    """An attribute of the first element of a tag, without a parser: for well-known generators."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<{re.escape(tag)}\b[^>]*?\b{re.escape(attr)}="([^"]*)"', 1), F.lit(""))


def tag_text(html: Column, tag: str) -> Column:
    """Text up to the next tag inside the first element of a tag."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{re.escape(tag)}\b[^>]*>([^<]*)", 1), F.lit(""))


def until_repeated(pages: DataFrame, source: str, page: str, content: str) -> DataFrame:
    """Pages of each source before the first one that is empty or equal to the page before it."""
    by = Window.partitionBy(source).orderBy(page)
    stop = F.col(content).isNull() | (F.col(content) == "") | F.coalesce(F.col(content) == F.lag(content).over(by), F.lit(False))
    return pages.withColumn("_stop", stop).withColumn("_ended", F.max(F.col("_stop").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_ended = 0").drop("_stop", "_ended")
