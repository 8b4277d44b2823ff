"""Sections from HTML: the one step that needs Python, as an Arrow map and as a
table function for SQL. Only the tree walk is done here; table detection, cleaning
and numbering are JVM expressions in ``operators.sections``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from citewell import ship
from citewell.config import Settings
from citewell.operators.sections import is_table_block

HEADING_WALK, ALL_TEXT = "heading_walk", "all_text"
UNTITLED_PAGE = "Page content"

# Elements without content, headings and blocks, and page furniture.
DROPPED = frozenset("script style noscript svg template iframe".split())
HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = frozenset("div p li span td th tr h1 h2 h3 h4 h5 h6".split())
FURNITURE_TITLES = frozenset(
    (
        "home", "login", "log in", "sign up", "signup", "sign in", "download app", "contact us", "careers",
        "privacy policy", "terms and conditions", "disclaimer", "cookie", "cookies", "skip to content",
    )
)
FURNITURE_CLASSES = frozenset(
    (
        "footer", "footerTopSection", "footer_gap", "hamburger", "searchBar", "appDownload", "cookieBanner", "stickyAd",
        "companyLogo",
    )
)
MODULE_CLASS = re.compile(r"^([A-Za-z_][A-Za-z0-9_]*?)_[A-Za-z0-9]{4,}__[A-Za-z0-9]{2,}$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: For each tag, the open ones that its start ends, and the ones beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FOLD = str.maketrans({**dict.fromkeys("‘’‛′", "'"), **dict.fromkeys("“”„″", '"'), **dict.fromkeys("–—−", "-"), " ": " ", **dict.fromkeys("‌‍﻿")})


#: An ampersand and the name behind it.
NAMED = re.compile(r"&(?=([A-Za-z][A-Za-z0-9]*;?))")


def whole_references(html: str) -> str:
    """For pages whose named references end with a semicolon: one that is cut off before it,
    or of no known name, is text."""
    return NAMED.sub(lambda m: "&" if m[1][-1] == ";" and m[1] in html5 else "&amp;", html)


def clean(text: str) -> str:
    return " ".join(text.translate(FOLD).split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            else:
                yield x

    def text(self) -> str:
        return clean(" ".join(s for t in self.texts() if (s := t.strip())))

    def own_text(self) -> str:
        return clean(" ".join(c for c in self.children if isinstance(c, str)))


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def _end(self, tags: set[str], beyond: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in beyond:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._end({"p"}, {"td", "th", "table", "button"})
        if tag in ENDS:
            tags, beyond = ENDS[tag]
            self._end(tags, beyond)
            if tag == "tr":  # a row ends the cell and the row it is in
                self._end(tags, beyond)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def prune(root: Node, gone) -> None:
    for node in [root, *root.walk()]:
        node.children = [c for c in node.children if not (isinstance(c, Node) and gone(c))]


def is_furniture(node: Node) -> bool:
    names = (MODULE_CLASS.match(c) for c in node.attrs.get("class", "").split())
    return any(m and m[1] in FURNITURE_CLASSES for m in names)


def content_root(root: Node) -> Node:
    nodes = list(root.walk())
    tests = (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: n.attrs.get("role") == "main",
        lambda n: n.attrs.get("id") == "__next",
        lambda n: n.tag == "body",
    )
    return next((n for test in tests for n in nodes if test(n)), root)


def block_line(node: Node) -> str:
    leaf = not any(n.tag in BLOCKS for n in node.walk())
    return node.text() if leaf else node.own_text()


def in_table(node: Node | None) -> bool:
    while node is not None:
        if node.tag == "table":
            return True
        node = node.parent
    return False


def walk_sections(root: Node) -> list[tuple[str, int, list[str], bool]]:
    """Title, level, lines and whether the first line stands in a table. Lines go to
    the heading before them; those before any heading are left out."""
    found: list[tuple[str, int, list[str], list[bool]]] = []
    for node in root.walk():
        if node.tag in HEADINGS:
            title = node.text()
            if title and title.lower() not in FURNITURE_TITLES:
                found.append((title, int(node.tag[1]), [], []))
                continue
        if node.tag in BLOCKS and found and (line := block_line(node)):
            found[-1][2].append(line)
            found[-1][3].append(in_table(node))
    return [(t, n, lines, inside[0]) for t, n, lines, inside in found if lines]


def extract(html: str, least: int = Settings.min_page_chars) -> tuple[str | None, str | None, list[dict]]:
    """mode, error, sections (title, level, text, in_table)."""
    tree = Tree(html or "").root
    prune(tree, lambda n: n.tag in DROPPED)
    root = content_root(tree)
    everything = [line for node in root.walk() if node.tag in BLOCKS and (line := block_line(node))]
    first = next((n.text() for n in root.walk() if n.tag in HEADINGS[:3]), "") or UNTITLED_PAGE
    prune(root, is_furniture)
    sections, seen = [], set()
    for title, level, lines, inside in walk_sections(root):
        key = title.lower(), "\n".join(lines)
        if key not in seen:
            seen.add(key)
            sections.append({"section_title": title, "heading_level": level, "text": key[1], "in_table": inside})
    if (n := sum(len(s["text"]) for s in sections)) >= least:
        return HEADING_WALK, None, sections
    if (m := sum(map(len, everything))) >= least:
        return ALL_TEXT, None, [{"section_title": first, "heading_level": 1, "text": "\n".join(everything), "in_table": False}]
    return None, f"extraction gave {n} characters by headings and {m} in all, under {least}", []


RAW = "array<struct<section_title:string,heading_level:int,text:string,in_table:boolean>>"


def extract_pages(pages: DataFrame, html: str = "html", s: Settings = Settings(), whole: bool = False) -> DataFrame:
    """``pages`` without their html, with extraction_mode, error and sections. A page
    with too little content has an error and no sections; it fails alone. With ``whole``,
    references without a semicolon are text, where browsers know some of them."""
    ship()
    kept = [c for c in pages.columns if c not in (html, "extraction_mode", "error", "sections")]
    struct = pa.struct(
        [("section_title", pa.string()), ("heading_level", pa.int32()), ("text", pa.string()), ("in_table", pa.bool_())]
    )
    least = s.min_page_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (h.as_py() for h in batch.column(html))
            found = [extract(whole_references(t) if whole and t else t, least) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.string()),
                    pa.array([x[2] for x in found], pa.list_(struct)),
                ],
                [*kept, "extraction_mode", "error", "raw"],
            )

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"extraction_mode string, error string, raw {RAW}"])
    rows = pages.select(*kept, html).mapInArrow(run, schema)
    section = lambda x, i: F.struct(
        x["section_title"].alias("section_title"),
        x["heading_level"].alias("heading_level"),
        x["text"].alias("text"),
        is_table_block(x["text"], x["in_table"], s.min_table_pairs).alias("is_table"),
        i.alias("order"),
    )
    return rows.withColumn("sections", F.transform("raw", section)).drop("raw")


@udtf(returnType="section_title string, heading_level int, text string, in_table boolean, place int")
class Sectionize:
    """SELECT ... FROM pages, LATERAL sectionize(html)"""

    def eval(self, html: str):
        for place, x in enumerate(extract(html)[2]):
            yield x["section_title"], x["heading_level"], x["text"], x["in_table"], place


def register(spark: SparkSession) -> None:
    ship()
    spark.udtf.register("sectionize", Sectionize)
