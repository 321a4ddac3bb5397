"""Links and documents of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lex
from ..functions.text import clean_title, col, find_date

DOCUMENT = "(?i)^[^?#]*\\.(pdf|doc|docx)([?#].*)?$"


def is_document_url(url: str | Column) -> Column:
    """The path ends in .pdf, .doc or .docx; a query doesn't matter."""
    return F.coalesce(col(url).rlike(DOCUMENT), F.lit(False))


def matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(patterns))


def is_relevant(text: str | Column, title: str | Column, url: str | Column, patterns: list[str] | None = None) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (text, title, url)])
    return is_document_url(url) | matches(joined, patterns or lex.RELEVANT)


def link_category(text: str | Column, title: str | Column, url: str | Column, patterns: list[str] | None = None) -> Column:
    """document, scheme_page or, for what is dropped, null."""
    return F.when(is_document_url(url), "document").when(is_relevant(text, title, url, patterns), "scheme_page")


def document_type(title: str | Column, url: str | Column, types: list[tuple[str, str]] | None = None) -> Column:
    joined = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(url), F.lit("")))
    out = None
    for name, pattern in types or lex.TYPES:
        test = joined.rlike("(?i)" + pattern)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise("other")


def is_scheme_document(title: str | Column, url: str | Column, patterns: list[str] | None = None) -> Column:
    joined = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(url), F.lit("")))
    return ~matches(joined, patterns or lex.EXCLUDED)


class _Page(HTMLParser):
    """Anchors with text and title, the cells of their table row, and the text of the nearest list item or paragraph; and the
    page's base. Comments, scripts and styles say nothing; entities are resolved."""

    def __init__(self, html: str | None, url: str | None):
        super().__init__(convert_charrefs=True)
        self.anchors, self.row, self.cell, self.block, self.open = [], None, None, None, None
        self.base, self.based, self.quiet = url or "", False, 0
        self.feed(html or "")
        self.close()

    def absolute(self, href: str) -> str | None:
        """The web address that a reference names from here, or none."""
        try:
            url = urljoin(self.base, href)
            return url if urlsplit(url).scheme in ("http", "https") else None
        except ValueError:  # not a URL, such as a bracket that isn't closed
            return None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "base" and a.get("href") and not self.based:
            self.base, self.based = self.absolute(a["href"].strip()) or self.base, True
        elif tag == "tr":
            self.row = {"cells": []}
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag in ("li", "p"):
            self.block = {"text": []}
        elif tag == "a" and a.get("href") is not None:
            self.open = {"href": a["href"].strip(), "title": (a.get("title") or "").strip(), "text": [], "row": self.row, "block": self.block}
            self.anchors.append(self.open)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet = 0
        elif tag == "tr":
            self.row = None
        elif tag in ("td", "th") and self.row is not None and self.cell is not None:
            self.row["cells"].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag in ("li", "p"):
            self.block = None
        elif tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.quiet:
            return
        for part in (self.open and self.open["text"], self.cell, self.block and self.block["text"]):
            if part is not None and part is not False:
                part.append(data)


def links_of(html: str | None, url: str | None) -> list[tuple]:
    """(place, address, text, title) of a page's links, the first to each address. Fragments, scripts and mail are passed over."""
    page, out, seen = _Page(html, url), [], set()
    for place, a in enumerate(page.anchors):
        target = None if not a["href"] or a["href"].startswith("#") or a["href"].lower().startswith("javascript:") else page.absolute(a["href"])
        if target is not None and target not in seen:
            seen.add(target)
            out.append((place, target, " ".join(t for t in map(str.strip, a["text"]) if t), a["title"]))
    return out


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Links of pages: key, pos (among the page's anchors), url (absolute), text, title.

    Relative references are resolved as RFC 3986 says, from the page or its base; one with a host of its own stays as written.
    The first of a page's links to one address stays; a null or empty page has none."""
    schema = T.StructType([pages.select(F.col(key).alias(key)).schema[0], T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("url", "text", "title")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *link) for k, u, h in zip(b["k"], b["u"], b["h"]) for link in links_of(h, u)], columns=[key, "pos", "url", "text", "title"])

    found = pages.select(F.col(key).alias("k"), col(url).alias("u"), col(html).alias("h")).mapInPandas(run, schema)
    return found.select(key, "pos", "url", clean_title("text").alias("text"), "title")


def documents_of(html: str, base: str) -> list[dict]:
    """Document links of a page: those in table rows first, then the rest; one for each URL."""
    page, out, seen = _Page(html, base), [], set()
    for in_rows in (True, False):
        for a in page.anchors:
            url = page.absolute(a["href"])
            if bool(a["row"]) != in_rows or url is None or url in seen or not a["href"] or not urlsplit(url).path.lower().endswith((".pdf", ".doc", ".docx")):
                continue
            seen.add(url)
            text = " ".join("".join(a["text"]).split())
            cells = a["row"]["cells"] if a["row"] else []
            if not text or text.lower() in lex.GENERIC_LINKS:
                good = [c for c in cells if c.lower() not in lex.GENERIC_LINKS and not c.isdigit() and len(c) > 3]
                text = good[0] if good else a["title"] or urlsplit(url).path.rsplit("/", 1)[-1]
            around = " | ".join(cells) if cells else "".join(a["block"]["text"]) if a["block"] else ""
            out.append({"document_url": url, "title": text, "context": around})
    return out


def page_documents(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", scheme_only: bool = False, types: list | None = None, excluded: list | None = None) -> DataFrame:
    """Documents that pages link to: key, document_url, source_page_url, title, document_type, published_date, is_scheme_document."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, u, d["document_url"], d["title"], d["context"]) for k, u, h in zip(b[key], b["u"], b["h"]) for d in documents_of(h, u)]
            yield pd.DataFrame(rows, columns=[key, "source_page_url", "document_url", "title", "context"])

    found = pages.select(key, col(url).alias("u"), col(html).alias("h")).mapInPandas(run, f"{key} {kind}, source_page_url string, document_url string, title string, context string")
    found = found.select(key, "document_url", "source_page_url", clean_title("title").alias("title"), document_type("title", "document_url", types).alias("document_type"), find_date(F.concat_ws(" ", "context", "title")).alias("published_date"), is_scheme_document("title", "document_url", excluded).alias("is_scheme_document"))
    return found.where("is_scheme_document") if scheme_only else found


def direct_document(url: str | Column) -> Column:
    """A URL that is itself a document: a struct of document_url, title and document_type; else null."""
    name = F.regexp_extract(F.regexp_replace(col(url), "[?#].*$", ""), "([^/]*)$", 1)
    return F.when(F.lower(col(url)).endswith(".pdf"), F.struct(col(url).alias("document_url"), name.alias("title"), F.when(F.lower(name).rlike("go|order"), "order").otherwise("guideline").alias("document_type")))


def filter_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition; all rows if none does. One aggregate row decides."""
    some = df.agg(F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False)).alias("_some"))
    return df.join(F.broadcast(some), condition | ~F.col("_some")).drop("_some")  # the broadcast is one row


def sources_for(sources: DataFrame, department: str | None = None, scheme: str | None = None) -> DataFrame:
    """Sources (source_name, department and more) of a department, else those that serve a scheme by its name; all where none
    matches. A scheme belongs to the first group whose words its name has; null names match nothing."""
    has = lambda c, word: F.coalesce(F.lower(c).contains(word), F.lit(False))
    if department:
        return filter_or_all(sources, has("department", department.lower()))
    name = (scheme or "").lower().replace("-", " ")
    for words, served, source in lex.SOURCE_GROUPS:
        if any(w in name for w in words):
            return filter_or_all(sources, has("department", served) | has("source_name", source))
    return sources
