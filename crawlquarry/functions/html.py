"""HTML to rows: anchors, text, metadata, images and CSS selection over the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_LINKS = ("#", "javascript:", "mailto:", "tel:", "data:")


class Node:
    """An element: tag, attributes, parent, children (elements and strings)."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                yield from c.texts()

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def normalize(url: str) -> str:
    """The same form that functions.urls.normalize_url gives."""
    p = urlsplit(url)
    head, _, params = p.path.rpartition("/")
    last, cut, rest = params.partition(";")
    path = (f"{head}/{last}" if head or p.path.startswith("/") else last).rstrip("/") or "/"
    query = urlencode(sorted(parse_qsl(p.query)))
    return f"{p.scheme.lower()}://{p.netloc.lower()}{path}{cut}{rest}{'?' + query if query else ''}"


def anchors(html: str | None, base: str) -> list[tuple[str, str]]:
    """(url, text) of the followable anchors in document order."""
    out = []
    for a in parse(html).walk():
        href = a.attrs.get("href", "").strip() if a.tag == "a" else ""
        if not href or href.startswith(NOT_LINKS):
            continue
        if href.startswith("//"):
            href = "https:" + href
        try:
            full = urljoin(base, href)
            if urlsplit(full).scheme.lower() in ("http", "https"):
                out.append((normalize(full), " ".join(t.strip() for t in a.texts() if t.strip())))
        except ValueError:
            continue
    return out


_SIMPLE = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:=[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")


def _compound(text: str):
    return [(m.lastgroup if m.lastgroup != "val" else "attr", m) for m in _SIMPLE.finditer(text)]


def _fits(node: Node, compound) -> bool:
    for kind, m in compound:
        if kind == "tag" and m["tag"] != "*" and node.tag != m["tag"].lower():
            return False
        if kind == "id" and node.attrs.get("id") != m["id"]:
            return False
        if kind == "cls" and m["cls"] not in node.attrs.get("class", "").split():
            return False
        if kind == "attr" and (m["attr"] not in node.attrs or (m["val"] is not None and node.attrs[m["attr"]] != m["val"])):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements of a selector list: tags, #ids, .classes, [attributes], descendants and children."""
    chains = []
    for one in selector.split(","):
        parts = re.findall(r">|[^\s>]+", one)
        chain, link = [], " "
        for p in parts:
            if p == ">":
                link = ">"
            else:
                chain.append((link, _compound(p)))
                link = " "
        if chain:
            chains.append(chain)

    def matches(node, chain) -> bool:
        if not _fits(node, chain[-1][1]):
            return False
        if len(chain) == 1:
            return True
        up = node.parent
        while up is not None and up.parent is not None:
            if matches(up, chain[:-1]):
                return True
            if chain[-1][0] == ">":
                return False
            up = up.parent
        return False

    return [n for n in root.walk() if any(matches(n, c) for c in chains)]


def css(html: str | None, selector: str, attribute: str | None = None) -> list[str]:
    """Stripped texts, or values of an attribute, of the selected elements; empty ones dropped."""
    found = select(parse(html), selector)
    values = (n.attrs.get(attribute, "") if attribute else "".join(n.texts()).strip() for n in found)
    return [v for v in values if v]


def xpath_to_css(xpath):
    """A simple XPath as a CSS selector, as a native expression; null for nothing."""
    x = F.col(xpath) if isinstance(xpath, str) else xpath
    x = F.regexp_replace(x, r"^//", "")
    x = F.regexp_replace(x, "//", " ")
    x = F.regexp_replace(x, r"\[@([\w-]+)=", "[$1=")
    x = F.regexp_replace(x, r"\[@([\w-]+)\]", "[$1]")
    x = F.regexp_replace(x, "/", " > ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(x != "", x)


def css_column(html, selector: str, attribute: str | None = None):
    """array<string> column of css()."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: css(x, selector, attribute))

    return run(html)


def css_first(html, selector: str, attribute: str | None = None):
    """The first of css(), null if there is none."""
    return F.get(css_column(html, selector, attribute), F.lit(0))


def extract_all(html, selectors: dict[str, str]):
    """map<string,array<string>> of css() for each named selector; a page is parsed once for all of them."""

    @F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    def run(h: pd.Series) -> pd.Series:
        def one(x):
            root = parse(x)
            return {name: [v for v in ("".join(n.texts()).strip() for n in select(root, selector)) if v] for name, selector in selectors.items()}

        return h.map(one)

    return run(html)


def _elements(html, tag: str, needed: str, describe):
    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: [describe(n) for n in parse(x).walk() if n.tag == tag and needed in n.attrs])

    return run(html)


def links_column(html):
    """array of (href, text) of every anchor with a href, as it is written."""
    found = _elements(html, "a", "href", lambda n: {"href": n.attrs["href"], "text": "".join(n.texts()).strip()})
    return F.transform(found, lambda m: F.struct(m["href"].alias("href"), m["text"].alias("text")))


def images_column(html):
    """array of (src, alt) of every image with a src; a missing alt is ''."""
    found = _elements(html, "img", "src", lambda n: {"src": n.attrs["src"], "alt": n.attrs.get("alt", "")})
    return F.transform(found, lambda m: F.struct(m["src"].alias("src"), m["alt"].alias("alt")))


def body_text(html):
    """Text of the body without separators, '' if there is none."""

    @F.pandas_udf(T.StringType())
    def run(h: pd.Series) -> pd.Series:
        def one(x):
            body = next((n for n in parse(x).walk() if n.tag == "body"), None)
            return "".join(t.strip() for t in body.texts()) if body else ""

        return h.map(one)

    return run(html)


def meta_column(html):
    """map<string,string> of meta names and properties; later ones win."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(h: pd.Series) -> pd.Series:
        def one(x):
            out = {}
            for n in parse(x).walk():
                name = (n.attrs.get("name") or n.attrs.get("property")) if n.tag == "meta" else None
                if name:
                    out[name] = n.attrs.get("content", "")
            return out

        return h.map(one)

    return run(html)


def anchor_rows(pages: DataFrame, key: str = "url_hash", url: str = "url", html: str = "html") -> DataFrame:
    """(key, position, url, text): one row a followable anchor."""

    def run(batches):
        for b in batches:
            rows = [(k, i, u, t) for k, base, h in zip(*(c.to_pylist() for c in b.columns)) for i, (u, t) in enumerate(anchors(h, base or ""))]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[key, "position", "link", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind}, position int, link string, text string")


def outlinks(anchor_rows_: DataFrame, key: str = "url_hash") -> DataFrame:
    """(key, outlinks): distinct links of a page in order of first occurrence."""
    first = anchor_rows_.groupBy(key, "link").agg(F.min("position").alias("at"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "link"))).alias("a")).select(key, F.transform("a", lambda s: s["link"]).alias("outlinks"))
