"""Fields of news pages: meta tags, linked data and the article's text, as Arrow batches over the standard parser.

The text is looked for in three ways, one after the other: blocks with many words and few links, wherever they stand; the
element whose paragraphs hold most words; the element that a tag, class or id names. The first one with enough words is
taken, and which it was says how far it is to be trusted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

# Elements that hold no article, and words of a full and of a partial extraction.
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe", "ads"}
BODY_NAME = re.compile(r"article[_-]?(body|content|text)", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FULL, PARTIAL = 30, 20
FIELDS = "title string, description string, author string, site string, canonical_url string, published string, body string, method string"
#: Words of a block that is text, and of one beside such a block; the share of its characters in links at most; the share of
#: a container's words that one inside it may have to be taken for it.
DENSE, BESIDE, LINKED, INNER = 15, 4, 0.33, 0.6


#: Elements that begin and end a block, and those whose text nobody reads.
BREAKS = {"p", "div", "article", "section", "main", "aside", "header", "footer", "nav", "form", "fieldset", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "body", "br"}
UNREAD = {"script", "style", "noscript", "iframe", "template", "head", "button", "select", "option", "textarea", "svg", "ld"}


class Page(HTMLParser):
    """One pass over a page: meta tags, linked data, the first h1, and the text of the article, main or body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.linked: list[str] = []
        #: Texts by what holds them, the best first: an article, a class or an id that names one, main, body.
        self.text: dict[str, list[str]] = {"article": [], "class": [], "id": [], "main": [], "body": []}
        self.open: list[str] = []
        self.kinds: list[tuple[str, ...]] = []
        self.names: dict[str, str] = {}
        self.canonical = ""
        #: Blocks in order: numbers of the elements around them from outside in, tag, text, characters in links.
        self.blocks: list[tuple[tuple[int, ...], str, str, int]] = []
        self.numbers: list[int] = []
        self.line: list[str] = []
        self.linked_chars = self.seen = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or a.get("itemprop") or "").lower(), a.get("content", "").strip())
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href", "")
        if tag in BREAKS:
            self.end_block()
            if tag != "br" and self.open and self.open[-1] == "p":  # a paragraph ends where a block begins
                del self.open[-1], self.kinds[-1], self.numbers[-1]
        if tag not in VOID:
            self.seen += 1
            self.numbers.append(self.seen)
            self.open.append("ld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else tag)
            named = [k for k in ("class", "id") if BODY_NAME.search(a.get(k, ""))]
            self.kinds.append((*named, *([tag] if tag in self.text else [])))
        if tag in ("p", "br", "div", "h1", "h2", "h3", "li", "tr"):
            self._add("\n")

    def end_block(self) -> None:
        """What was read since the last block is one, of the innermost element that makes blocks."""
        text = " ".join("".join(self.line).split())
        if text:
            k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k] in BREAKS), -1)
            self.blocks.append((tuple(self.numbers[: k + 1]), self.open[k] if k >= 0 else "", text, min(self.linked_chars, len(text))))
        self.line, self.linked_chars = [], 0

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag or tag == "script" and self.open[k] == "ld":
                del self.open[k:], self.kinds[k:], self.numbers[k:]
                break

    def _add(self, data: str) -> None:
        if not DROPPED.intersection(self.open):
            for name in {n for kinds in self.kinds for n in kinds}:
                self.text[name].append(data)

    def handle_data(self, data: str) -> None:
        last = self.open[-1] if self.open else ""
        if last == "ld":
            self.linked.append(data)
        elif last in ("title", "h1"):
            self.names.setdefault(last, data.strip())
        if last != "title" and last != "ld":
            self._add(data)
            if not UNREAD.intersection(self.open):
                self.line.append(data)
                self.linked_chars += len(data.strip()) if "a" in self.open else 0


def linked_fields(parts: list[str]) -> dict[str, str]:
    """Headline, author and date of the first article in linked data; broken data has none."""
    for part in parts:
        try:
            data = json.loads(part)
        except ValueError:
            continue
        for item in data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []:
            if isinstance(item, dict) and "Article" in str(item.get("@type", "")):
                author = item.get("author")
                author = author[0] if isinstance(author, list) and author else author
                return {"title": str(item.get("headline") or ""), "author": str(author.get("name") if isinstance(author, dict) else author or ""), "published": str(item.get("datePublished") or "")}
    return {}


def by_density(blocks: list[tuple]) -> str:
    """Blocks of many words and few links, and shorter ones without links between two of them."""
    words, linked = [len(b[2].split()) for b in blocks], [b[3] > LINKED * len(b[2]) for b in blocks]
    dense = [n >= DENSE and not li for n, li in zip(words, linked, strict=True)]
    between = lambda k: 0 < k < len(blocks) - 1 and dense[k - 1] and dense[k + 1] and words[k] >= BESIDE and not linked[k]
    return "\n".join(b[2] for k, b in enumerate(blocks) if dense[k] or between(k))


def by_paragraphs(blocks: list[tuple]) -> str:
    """The paragraphs of the element that holds most words of paragraphs; of nested ones the innermost that has most of
    them. Paragraphs of links do not count."""
    whole: dict[int, int] = {}
    depth: dict[int, int] = {}
    paragraphs = [b for b in blocks if b[1] == "p" and b[3] <= 0.5 * len(b[2])]
    for path, _, text, _ in paragraphs:
        for k, number in enumerate(path[:-1]):
            whole[number] = whole.get(number, 0) + len(text.split())
            depth[number] = k
    if not whole:
        return ""
    most = max(whole.values())
    best = max((n for n in whole if whole[n] >= INNER * most), key=lambda n: (depth[n], whole[n], -n))
    return "\n".join(b[2] for b in paragraphs if best in b[0])


def fields_of(page: str) -> tuple:
    p = Page()
    p.feed(page)
    p.close()
    p.end_block()
    ld, m = linked_fields(p.linked), p.meta
    tagged = next((b for b in (re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\r\f\v]+", " ", "".join(p.text[k]))).strip() for k in p.text) if b), "")
    ways = {"density": lambda: by_density(p.blocks), "paragraphs": lambda: by_paragraphs(p.blocks)}
    body, method = next(((b, name) for name, way in ways.items() if len((b := way()).split()) > FULL), (tagged, "tags" if len(tagged.split()) > PARTIAL else None))
    first = lambda *xs: next((x for x in xs if x), None)
    return (
        first(m.get("og:title"), m.get("twitter:title"), ld.get("title"), p.names.get("h1"), p.names.get("title")), first(m.get("og:description"), m.get("twitter:description"), m.get("description")), first(m.get("author"), m.get("article:author"), ld.get("author")),
        first(m.get("og:site_name")), first(p.canonical, m.get("og:url")), first(m.get("article:published_time"), ld.get("published"), m.get("date"), m.get("pubdate")), body or None, method,
    )


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a struct column fields, its day and a status: success where one of the first two ways to look for the text
    found enough of it, partial where the third did, else failed."""

    @F.pandas_udf(FIELDS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([fields_of(x or "") for x in part], columns=[f.split()[0] for f in FIELDS.split(", ")])

    out = pages.withColumn("fields", run(F.col(html)))
    return out.withColumn("published_day", T.clean_date(F.col("fields.published"))).withColumn("extraction_status", F.when(F.col("fields.method").isin("density", "paragraphs"), "success").when(F.col("fields.method") == "tags", "partial").otherwise("failed"))


def overlay(known: Column, found: Column) -> Column:
    """found only where known is missing or empty."""
    return F.coalesce(F.nullif(known, F.lit("")), found)
