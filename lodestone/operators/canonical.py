"""Canonical documents from raw layouts: two parser layouts and HTML pages to one nested row per paper.

Parsing is per document and stateless: a document that fails gives a row with ``error`` and loses nothing else.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Raw element types by canonical kind, and headings that end or precede the body.
KINDS = {
    "text": "text", "paragraph": "text", "list": "text", "title": "heading", "heading": "heading", "image": "figure", "figure": "figure", "chart": "figure",
    "table": "table", "equation": "formula", "equation_interline": "formula", "header": "excluded", "page_header": "excluded", "footer": "excluded",
    "page_footer": "excluded", "page_number": "excluded", "page_footnote": "excluded", "footnote": "excluded", "ref_text": "reference", "reference": "reference",
}
REFERENCE_HEADINGS = ("references", "reference", "bibliography", "literaturecited", "workscited")
ABSTRACT_HEADINGS = ("abstract", "summary", "keywords", "keyword", "highlights", "articleinfo", "articleinformation")

ELEMENT = (
    "doc_id string, seq long, kind string, raw_type string, level int, page int, bbox array<double>, raw_text string, caption string, "
    "role string, section_path array<string>, section_id string, has_sections boolean"
)
_NAMES = [x.split()[0] for x in ELEMENT.split(", ")]


def rendered(node) -> str:
    """The text of a nested rich-text node: strings, lists, and the text-bearing fields of mappings, in order."""
    if node is None or isinstance(node, bool):
        return ""
    if isinstance(node, (str, int, float)):
        return str(node)
    if isinstance(node, list):
        return " ".join(x for x in map(rendered, node) if x)
    keys = ("content", "text", "value", "children", "items", "list_items", "math_content", "html")
    return " ".join(x for x in (rendered(node[k]) for k in keys if k in node) if x)


def _box(value) -> list[float] | None:
    try:
        return [float(x) for x in value] if isinstance(value, list) and len(value) == 4 else None
    except (TypeError, ValueError):
        return None


def _int(value) -> int | None:
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else None


def flat_elements(items: list[dict]) -> Iterator[tuple]:
    """Elements of the flat layout: one list, ``text_level`` marks headings, pages in ``page_idx``."""
    for i, x in enumerate(items):
        raw = str(x.get("type", "other"))
        kind = "heading" if raw == "text" and _int(x.get("text_level")) is not None else KINDS.get(raw, "uncertain")
        body = x.get("text") or x.get("table_body") or ""
        caption = next((rendered(x[k]) for k in (f"{raw}_caption", "image_caption", "table_caption", "chart_caption") if x.get(k)), None)
        yield i, kind, raw, _int(x.get("text_level")), _int(x.get("page_idx")), _box(x.get("bbox")), rendered(body), caption


def paged_elements(pages: list[list[dict]]) -> Iterator[tuple]:
    """Elements of the paged layout: a list of pages of typed nodes with nested content; the page is the list index."""
    i = 0
    for page, nodes in enumerate(pages):
        for x in nodes:
            raw, content = str(x.get("type", "other")), x.get("content") or {}
            kind = KINDS.get(raw, "uncertain")
            known = content if isinstance(content, dict) else {"content": content}
            body = next((rendered(known[k]) for k in (f"{raw}_content", "title_content", "paragraph_content", "list_items", "math_content", "html", "content", "text") if known.get(k)), "")
            caption = next((rendered(known[k]) for k in known if k.endswith("_caption") and known[k]), None)
            yield i, kind, raw, _int(known.get("level")), page, _box(x.get("bbox")), body, caption
            i += 1


class _Page(HTMLParser):
    """Blocks of a web page: headings, paragraphs and list items; script, style and page furniture are excluded."""

    SKIP = ("script", "style", "nav", "header", "footer", "aside")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.skip: list[str] = []
        self.open: tuple[str, list[str]] | None = None

    def close_block(self) -> None:
        if self.open:
            tag, parts = self.open
            body = " ".join("".join(parts).split())
            if body:
                level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else None
                self.out.append(("heading" if level else "text", tag, level, body))
        self.open = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.close_block()
            self.skip.append(tag)
            self.out.append(("excluded", tag, None, ""))
        elif not self.skip and re.fullmatch("h[1-6]|p|li|td|blockquote|title", tag):
            self.close_block()
            self.open = (tag, [])

    def handle_endtag(self, tag: str) -> None:
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif self.open and tag == self.open[0]:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.skip and self.open:
            self.open[1].append(data)

    def handle_comment(self, data: str) -> None:
        self.out.append(("excluded", "comment", None, ""))


def page_elements(source: str) -> Iterator[tuple]:
    """Elements of an HTML page."""
    p = _Page()
    p.feed(source)
    p.close()
    p.close_block()
    for i, (kind, tag, level, body) in enumerate(p.out):
        yield i, kind, tag, level, 0, None, htmllib.unescape(body), None


_LAYOUTS = {"flat": lambda s: flat_elements(json.loads(s)), "paged": lambda s: paged_elements(json.loads(s)), "html": page_elements}


def sectioned(doc_id: str, found: list[tuple]) -> Iterator[tuple]:
    """The elements of a document with their role, section path and section: a stack of headings; the title is no section."""
    path: list[str] = []
    rows, seen_title, n = [], False, 0
    for e in found:
        _, kind, _, level, _, _, body, _ = e
        role = "body"
        if kind == "heading":
            level = 2 if level is None else level
            if level == 1 and not seen_title and not path:
                seen_title, role = True, "title"
            else:
                role, n = "section", n + 1
                path = [*path[: max(1, level - 1) - 1], body or ""]
        own = [] if role == "title" else list(path)
        rows.append((doc_id, *e, role, own, f"{doc_id}:s{n:04d}" if own or role == "section" else None))
    yield from ((*r, n > 0) for r in rows)


def elements(df: DataFrame, layout: str) -> DataFrame:
    """Elements of every document of (doc_id, content) with their sections, in one pass over documents.

    A document that cannot be parsed gives one ``error`` element.
    """
    parse = _LAYOUTS[layout]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, content in b.itertuples(index=False, name=None):
                try:
                    rows += sectioned(doc_id, list(parse(content or "")))
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((doc_id, 0, "error", type(e).__name__, None, None, None, str(e)[:200], None, "body", [], None, False))
            out = pd.DataFrame(rows, columns=_NAMES)
            yield out.astype({"level": "Int32", "page": "Int32"})

    return df.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, ELEMENT)


def directory_elements(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Elements of the documents below a folder, ``<layout>/<doc_id>.json`` each, with their ``parser_source``.

    A document in several layouts is read from its flat file, else from its paged one; ``only`` forces a layout.  Which file
    serves a document is decided on names alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    files = files.select("path", "content", F.element_at(parts, -2).alias("layout"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("doc_id")).filter(F.col("path").endswith(".json") & F.col("layout").isin("flat", "paged"))
    files = files.filter(F.col("layout") == only) if only else files
    chosen = files.groupBy("doc_id").agg(F.min("layout").alias("layout"))
    own = files.join(chosen, ["doc_id", "layout"], "left_semi").select("doc_id", "layout", F.col("content").cast("string").alias("content"))
    found = [elements(own.filter(F.col("layout") == k), k).withColumn("parser_source", F.lit(k)) for k in ("flat", "paged")]
    return found[0].unionByName(found[1])


def with_sections(items: DataFrame) -> DataFrame:
    """Elements with the paragraph verdict.

    A paragraph is left out, with the reason, where it is empty, under references, an abstract or keywords, or before
    the first section of a document that has sections.
    """
    j = items.withColumn("clean_text", T.unicode_clean(F.coalesce("raw_text", F.lit(""))))
    keys = F.transform("section_path", lambda h: T.compact_key(h))
    why = F.when(F.col("clean_text") == "", "empty_text").when(F.exists(keys, lambda k: k.isin(*REFERENCE_HEADINGS)), "references")
    why = why.when(F.exists(keys, lambda k: k.isin(*ABSTRACT_HEADINGS)), "abstract_or_keywords").when(F.col("has_sections") & F.col("section_id").isNull(), "front_matter_unsectioned")
    return j.withColumn("excluded_reason", F.when(F.col("kind") == "text", why).when(F.col("kind") == "excluded", F.col("raw_type")).when(F.col("kind") == "reference", "reference")).drop("has_sections")


def documents(items: DataFrame) -> DataFrame:
    """One nested row per document: sections, paragraphs, objects, uncertain elements and counts of what was left out."""
    body = (F.col("kind") == "text") & F.col("excluded_reason").isNull()
    obj = F.col("kind").isin("figure", "table", "formula")
    pick = lambda cond, *cols: F.sort_array(F.collect_list(F.when(cond, F.struct("seq", *cols))))
    nested = items.groupBy("doc_id").agg(
        pick(F.col("role") == "section", "section_id", "section_path", "page").alias("sections"),
        pick(body, "section_id", "raw_text", "clean_text", "page", "bbox").alias("paragraphs"),
        pick(obj, "kind", "caption", "raw_text", "page", "bbox").alias("objects"),
        pick(F.col("kind") == "uncertain", "raw_type", "raw_text").alias("uncertain_elements"),
        F.min(F.when(F.col("role") == "title", F.struct("seq", "clean_text"))).alias("title"),
        F.count_if(F.col("kind") == "error").alias("n_errors"),
        F.collect_list("excluded_reason").alias("reasons"),
    )
    counts = F.transform(F.array_sort(F.array_distinct("reasons")), lambda k: F.struct(k.alias("key"), F.size(F.filter("reasons", lambda x: x == k)).cast("long").alias("value")))
    counts = F.when(F.size("reasons") > 0, F.map_from_entries(counts)).alias("excluded_counts")
    return nested.select("doc_id", "sections", "paragraphs", "objects", "uncertain_elements", F.col("title.clean_text").alias("title"), "n_errors", counts)
