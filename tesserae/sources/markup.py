"""Readers of marked-up documents: HTML, nested legal XML, separated text, paragraphs."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import triples as V
from tesserae.sources.jsonld import jsonld_triples

#: Formats of a document in order of preference.
FORMATS = (".akn", ".html", ".htm", ".pdf", ".json")

_BLANK = re.compile(r"[ \n\t]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("name", "parts", "attrs")

    def __init__(self, name: str, attrs: dict[str, str | None] | None = None):
        self.name, self.parts, self.attrs = name, [], attrs or {}

    def children(self) -> list[_Node]:
        return [x for x in self.parts if isinstance(x, _Node)]

    def text(self) -> str:
        """All text below, in order; nesting may be deeper than Python's stack."""
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                rest.extend(reversed(x.parts))
        return "".join(out)

    def clean(self) -> str:
        return _BLANK.sub(" ", html.unescape(self.text())).strip()


class _Tree(HTMLParser):
    """A forgiving tree of elements without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open, self.skip = [self.root], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag == "p" and self.open[-1].name == "p":
            self.open.pop()
        node = _Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.skip:
            self.open[-1].parts.append(data)


def parse(markup: str) -> _Node:
    tree = _Tree()
    tree.feed(markup or "")
    tree.close()
    return tree.root


def _walk(node: _Node) -> Iterator[tuple[_Node, _Node]]:
    """The elements below a node in document order, each with its parent."""
    rest = [(child, node) for child in reversed(node.children())]
    while rest:
        own, above = rest.pop()
        yield own, above
        rest.extend((child, own) for child in reversed(own.children()))


def _leaf_texts(node: _Node) -> list[str]:
    """Texts of the innermost p, li, td and th elements of a list or table, or its own."""
    found = [x.clean() for x, _ in _walk(node) if x.name in ("p", "li", "td", "th") and not any(y.name in ("p", "li", "td", "th") for y, _ in _walk(x))]
    return [x for x in found if x] or [node.clean()]


def paragraphs(markup: str) -> list[str]:
    """Distinct texts of the p elements in order; lists and tables that follow one come under it, a row for each item."""
    seen: dict[str, None] = {}
    following: dict[int, list[_Node]] = {}
    for node, parent in _walk(parse(markup)):
        if id(parent) not in following:  # for each child of the parent the lists and tables right behind it
            behind: list[_Node] = []
            for x in reversed(parent.children()):
                following[id(x)] = behind
                behind = [x, *behind] if x.name in ("table", "ul", "ol") else []
            following[id(parent)] = following.get(id(parent), [])
        if node.name != "p":
            continue
        own = node.clean()
        after = [t for x in following.get(id(node), []) for t in _leaf_texts(x)]
        for text in [f"{own} {x}".strip() for x in after] or [own]:
            if text:
                seen.setdefault(text)
    return list(seen)


def html_paragraphs(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, pos, text): paragraphs of whole pages; a text stands once in a page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, t) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, t in enumerate(paragraphs(m))]
            keys, pos, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.types[0]), pa.array(pos, pa.int32()), pa.array(text, pa.string())], names=[key, "pos", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, markup).mapInArrow(run, f"{key} {kind}, pos int, text string")


#: Parents of a paragraph that are told, each with its property; those of the second kind with their headings.
_NUMBERED = (("paragraph", "my:paragraph_id"), ("article", "my:article_id"))
_HEADED = (("section", "my:section_id"), ("chapter", "my:chapter_id"))


def _child_text(node: _Node, name: str) -> str:
    return next((x.clean() for x in node.children() if x.name == name), "")


def _named(node: _Node, base: str, heading: bool) -> dict | None:
    """A numbered element as a nested object: its id, its number as label, and its heading if that is wanted."""
    num, title = _child_text(node, "num"), _child_text(node, "heading") if heading else ""
    out = {"@id": f"{base}:{node.attrs.get('eid') or ''}"} | ({V.LABEL: num} if num else {}) | ({"my:heading": title} if title else {})
    return out if len(out) > 1 else None


def _legal_rows(text: str, base: str) -> Iterator[tuple[int, str, str]]:
    """(number, text, annotation) of the p elements of nested legal XML that are no introductions of lists."""
    rest: list[tuple[_Node, tuple]] = [(x, ()) for x in reversed(parse(text).children())]
    number = -1
    while rest:
        child, above = rest.pop()
        if child.name != "p":
            rest.extend((x, (child, above)) for x in reversed(child.children()))
            continue
        number += 1
        nearest: dict[str, _Node] = {}  # of each name the innermost parent
        link = above
        while link:
            nearest.setdefault(link[0].name, link[0])
            link = link[1]
        intro, found = "", {}
        if (block := nearest.get("blocklist")) is not None:
            intro = _child_text(block, "listintroduction")
            if (item := nearest.get("item")) is not None:
                found["my:block_id"] = _named(item, base, False)
        elif "intro" in nearest:
            continue
        elif "list" in nearest:
            intro = _child_text(nearest["list"], "intro")
        for kinds, heading in ((_NUMBERED, False), (_HEADED, True)):
            found |= {p: _named(nearest[name], base, heading) for name, p in kinds if name in nearest}
        annotation = {p: x for p, x in found.items() if x}
        refs = [{"@id": f"{base}:{x.attrs.get('href') or ''}", V.LABEL: x.clean()} for x in child.children() if x.name == "ref"]
        yield number, f"{intro} {child.clean()}".strip(), json.dumps(annotation | {"my:reference_id": refs}, ensure_ascii=False)


def legal_paragraphs(documents: DataFrame, key: str, markup: str = "xml", base: Column | None = None) -> DataFrame:
    """(key, pos, text, annotation): paragraphs of nested legal XML, with a JSON-LD object of where each stands.

    The introduction of the nearest list is put before a paragraph and gives no row of its own. The annotation
    has the number of the nearest item, paragraph and article, number and heading of section and chapter, and the
    references in the paragraph. base is the document's name in their ids, the key if none is given. pos counts
    all p elements; null documents have none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, m, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for r in _legal_rows(m, own)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [b.schema.types[0], pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "pos", "text", "annotation"])

    kind = documents.schema[key].dataType.simpleString()
    own = F.coalesce((F.col(key) if base is None else base).cast("string"), F.lit(""))
    return documents.select(key, markup, own.alias("_base")).mapInArrow(run, f"{key} {kind}, pos int, text string, annotation string")


def legal_annotations(paragraphs: DataFrame, key: str) -> DataFrame:
    """(id, ord, s, p, o) of the annotations of legal paragraphs; id is the document's key and the paragraph's number,
    _:<id>_0 the paragraph itself."""
    own = paragraphs.select(F.concat_ws("_", F.col(key).cast("string"), "pos").alias("id"), "annotation")
    return jsonld_triples(own, "id", "annotation")


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def flat_json_triples(rows: DataFrame, subject: Column, document: str) -> DataFrame:
    """(s, p, o) of flat JSON objects: a triple for each key."""
    pairs = F.explode(F.from_json(F.col(document), "map<string,string>"))
    return rows.select(subject.alias("s"), pairs).select("s", F.col("key").alias("p"), F.col("value").alias("o"))


def preferred_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(base, path): for each base name the file of the most preferred format; other formats are left out."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[A-Za-z]+)$", 1))
    order = F.array_position(F.array(*[F.lit(x) for x in FORMATS]), ext)
    base = F.regexp_replace(F.regexp_extract(F.col(path), "([^/]*)$", 1), r"\.[A-Za-z]+$", "")
    known = files.select(base.alias("base"), F.col(path).alias("path"), order.alias("o")).filter("o > 0")
    return known.groupBy("base").agg(F.min_by("path", F.struct("o", "path")).alias("path"))


def document_list(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content) of all files below a directory."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "content")


def subclass_tables(spark: SparkSession, directory: str) -> DataFrame:
    """(concept, label) from separated files with a SubClasses column: a file's stem is a class."""
    rows = spark.read.option("sep", ";").option("header", True).csv(directory).withColumn("file", F.input_file_name())
    own = F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1)
    return rows.select(own.alias("concept"), own.alias("label")).unionByName(rows.filter("SubClasses is not null").select(F.col("SubClasses").alias("concept"), F.col("SubClasses").alias("label"))).distinct()


def memoised(rows: DataFrame, key: list[str], compute, name: str) -> DataFrame:
    """Append compute(key columns), evaluated once for each distinct key."""
    once = rows.select(*key).distinct().withColumn(name, compute)
    return rows.join(once, key, "left")
