"""HTML extraction by union-free regular expressions, inferred host by host.

A page is a stream of tags and texts; with the end tags that HTML lets out put in, it is a nested one. A wrapper is a
regular expression over such streams without unions: containers, text slots, optional parts and repeated parts. Two of
them are aligned part by part: what both have is merged, what one has is optional, what comes again beside itself is one
repeated part. A slot keeps the blocks of text that stood there on all pages so far; whatever else stands there varies.
Each task folds its pages into a wrapper for each host, then a host's wrappers are folded, some tasks' at a time. A
host's pages are never brought together.

The wrapper then says which of its parts is the article: the one whose slots hold the text that varies from page to
page, not in links. Tags and roles that say which part it is are believed; class words only weigh in. Each page is laid
along its host's wrapper and what lies on that part is its text. The wrappers are broadcast while they stay under
broadcast_bytes together; above that they are joined by host.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut
from newsloom.llm.url_trie import host_and_path

BROADCAST_BYTES = 16 << 20
#: Parts in a row of which more become a repeated group of optional ones; wrappers of a host that are folded at a time.
GROUP, FAN_IN = 50, 64
#: The share of the varying text that an unmarked article has; pages on which a block has to stand to be no article's.
MOST, SURE = 0.6, 3

# HTML's element kinds, and words for parts of a page that are not its article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "noembed", "noframes", "xmp", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "object", "canvas", "audio", "video", "map", "search", "datalist", "option", "input"} | RAW
NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "menu", "nav", "navbar", "navigation", "header", "footer", "sidebar", "aside", "breadcrumb",
    "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "widget", "toolbar", "pagination", "pager", "skip", "masthead", "copyright", "disclaimer", "tags", "topbar",
}
#: Words that beside those leave a class name what it is.
NEUTRAL = {"site", "page", "top", "bottom", "left", "right", "box", "block", "section", "container", "wrapper", "wrap", "area", "list", "bar", "inner", "outer", "links", "posts", "primary", "secondary", "global", "item", "items"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"}
MAIN_CLASSES = {"article", "articlebody", "post", "entry", "content", "story", "main"}

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a wrapper has parts for; all others are text, or lines of it, in their container's slot.
CONTAINER = BLOCK - HEADINGS - {"p", "li", "dt", "dd", "tr", "th", "pre", "hr", "summary", "legend", "caption", "figcaption", "address"}

#: Containers that may be turns of one part within a page; any may be where pages differ.
TURNS = {"table", "tbody", "thead", "tfoot", "td", "ul", "ol", "dl", "blockquote", "figure"}

TOKEN = re.compile(r"(?s)<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<")
#: An attribute's name and its value, quoted or not, one after the other, so that values are never taken for names.
ATTRIBUTE = re.compile(r"(?s)[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TELLING = re.compile(r"class|id|role|itemprop|hidden", re.I)
PART = re.compile(r"[a-z]+")
#: What an element's start ends, inside the given border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Element:
    """An element of a page: kids are texts and elements, in order."""

    __slots__ = ("tag", "mark", "kids")

    def __init__(self, tag: str, mark: str):
        self.tag, self.mark, self.kids = tag, mark, []


def mark_of(tag: str, attributes: str) -> str:
    """- never article text; ~ is not, as its class or id has it; + is the article; ? is, as its class or id has it."""
    if tag in DROPPED:
        return "-"
    main = tag in ("article", "main")
    noise = hint = False
    # Of an attribute that comes twice the first counts.
    given: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes) if TELLING.search(attributes) else ():
        given.setdefault(name.lower(), "".join(values).lower())
    for name, value in given.items():
        if name in ("class", "id"):
            for word in value.split():
                parts = set(PART.findall(word))
                noise |= bool(parts & NOISE) and parts <= NOISE | NEUTRAL
                hint |= word.replace("-", "").replace("_", "") in MAIN_CLASSES
        elif name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody":
            main = True
        elif name == "role" and value in OTHER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "-"
    if main:
        return "+"
    # Within a line of text, and on what the whole page is in, a class says nothing.
    if tag in BLOCK and tag not in HEADINGS and tag not in ("html", "body"):
        return "~" if noise else "?" if hint and tag in CONTAINER else ""
    return ""


def tree(page: str) -> Element:
    """The nested stream of a page, however deep."""
    root = Element("", "")
    stack = [root]
    open_: dict[str, int] = {}
    at, size = 0, len(page)

    def close(to: int) -> None:
        for element in stack[to:]:
            open_[element.tag] -= 1
        del stack[to:]

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].kids.append(m[0])
            elif m[0].startswith("<![CDATA["):
                stack[-1].kids.append(html.escape(m[0][9:-3], quote=False))
            continue
        tag = tag.lower()
        if m[1]:
            if open_.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ("article", "main", "td", "table", "aside", "nav", "footer", "header") and tag not in BLOCK:
                        break  # an inline end tag does not end a block
            continue
        if tag in BLOCK and open_.get("p"):
            k = innermost("p")
            if not {"table", "td", "div", "article", "section", "li"} & {e.tag for e in stack[k + 1 :]}:
                close(k)
        if tag in CLOSES:
            ends, border = CLOSES[tag]
            if any(open_.get(e) for e in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in border:
                        break
                    if stack[k].tag in ends:
                        close(k)
                        if tag != "tr":
                            break
        element = Element(tag, mark_of(tag, m[3]))
        stack[-1].kids.append(element)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title", "xmp") else at)
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            stack.append(element)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def steps(element: Element) -> Iterator[tuple[str, object]]:
    """("text", str), ("in", Element) and ("out", Element) for all that is within an element, in order. The caller may
    send True after an "in" to pass over that element (there is no "out" then)."""
    stack = [(element, iter(element.kids))]
    while stack:
        own, kids = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if own is not element:
                yield "out", own
        elif isinstance(kid, str):
            yield "text", kid
        elif not (yield "in", kid):
            stack.append((kid, iter(kid.kids)))


class Part:
    """A part of a wrapper: a container with its text slot and the containers within it.

    The slot knows the text blocks that stood there on every page so far (fixed), and how many characters stood there
    in all, and in links. A part is optional where pages lack it and repeated where it comes again and again. A page's
    own part knows its elements."""

    __slots__ = ("tag", "mark", "kids", "flow", "fixed", "chars", "links", "pages", "optional", "repeated", "elements")

    def __init__(self, tag: str, mark: str, element: Element | None = None):
        self.tag, self.mark = tag, mark
        self.elements = [element] if element else []
        self.kids: list[Part] = []
        self.flow: set[str] = set()
        self.fixed: dict[int, int] = {}
        self.chars = self.links = 0
        self.pages, self.optional, self.repeated = 1, False, False


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def digest(block: str) -> int:
    return xxhash.xxh64_intdigest(block.encode("utf-8", "surrogatepass")) >> 1


def wrapper_of(page: Element, keep: bool = True) -> Part:
    """A page's nested stream as a wrapper: what is never article text is a part without anything in it. keep: its
    parts know their elements."""
    root = Part("", "", page if keep else None)
    stack, line, linked, in_link = [root], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if line and (block := squeezed("".join(line))):
            own = stack[-1]
            own.chars += len(block)
            own.links += min(linked, len(block))
            own.fixed[digest(block)] = len(block)
        line.clear()
        linked = 0

    walk = steps(page)
    skip = None
    while True:
        try:
            kind, what = walk.send(skip)
        except StopIteration:
            break
        skip = None
        if kind == "text":
            line.append(what)
            if in_link:
                linked += len(what.strip())
            continue
        tag = what.tag
        if tag == "a":
            in_link += 1 if kind == "in" and what.mark != "-" else -1 if kind == "out" else 0
        elif tag == "br":
            line.append(" ")
        if tag in BLOCK:
            flush()
        if kind == "in":
            stack[-1].flow.add(tag if tag in BLOCK or tag == "a" else "#")
            if tag in CONTAINER:
                own = Part(tag, what.mark, what if keep else None)
                stack[-1].kids.append(own)
                if what.mark != "-":
                    stack.append(own)
            skip = what.mark == "-"
        elif tag in CONTAINER:
            stack.pop()
    flush()
    return ready(root)


def alike(a: Part, b: Part) -> float:
    """How well two parts of one name fit each other, 0 to 5."""
    x, y = a.flow | {k.tag for k in a.kids}, b.flow | {k.tag for k in b.kids}
    same = len(x & y) / len(x | y) if x or y else 1.0
    p, q = a.chars / a.pages, b.chars / b.pages
    links = abs((a.links / a.chars if a.chars else 0) - (b.links / b.chars if b.chars else 0))
    length = min(p, q) / max(p, q) if p or q else 1.0
    return same + (1 - links) + length + (2.0 if a.fixed.keys() & b.fixed.keys() else 0.0)


def aligned(x: list[Part], y: list[Part]) -> list[tuple[int, int]]:
    """Places of x and y that belong together, in order, with the largest sum of alike()."""
    if len(x) == len(y) == 1:
        return [(0, 0)] if (x[0].tag, x[0].mark) == (y[0].tag, y[0].mark) else []
    gain = [[1 + alike(p, q) if (p.tag, p.mark) == (q.tag, q.mark) else 0.0 for q in y] for p in x]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            both = best[i + 1][j + 1] + gain[i][j] if gain[i][j] else 0.0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if gain[i][j] and best[i][j] == best[i + 1][j + 1] + gain[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def same_kind(a: Part, b: Part) -> bool:
    """Whether b may be another turn of a."""
    return (a.tag, a.mark) == (b.tag, b.mark) and alike(a, b) >= 2


def absorb(a: Part, b: Part, again: bool = False) -> Part:
    """a becomes the wrapper of both. again: b is another turn of a on the same page."""
    todo = [(a, b, again)]
    while todo:
        a_, b_, turn = todo.pop()
        a_.chars += b_.chars
        a_.links += b_.links
        a_.flow |= b_.flow
        if turn:
            a_.fixed.update(b_.fixed)
            a_.elements += b_.elements
            a_.repeated, a_.pages = True, max(a_.pages, b_.pages)
        else:
            a_.fixed = {k: v for k, v in a_.fixed.items() if k in b_.fixed}
            a_.pages += b_.pages
            a_.repeated |= b_.repeated
        a_.optional |= b_.optional
        pairs = aligned(a_.kids, b_.kids)
        kids: list[Part] = []
        i = j = 0
        for p, q in [*pairs, (len(a_.kids), len(b_.kids))]:
            for other in (*a_.kids[i:p], *b_.kids[j:q]):
                if kids and same_kind(kids[-1], other):
                    todo.append((kids[-1], other, True))
                else:
                    other.optional = True
                    kids.append(other)
            if p < len(a_.kids):
                todo.append((a_.kids[p], b_.kids[q], turn))
                kids.append(a_.kids[p])
            i, j = p + 1, q + 1
        a_.kids = kids
        if len(kids) > GROUP:
            grouped(a_, todo)
    return a


def grouped(part: Part, todo: list) -> None:
    """What comes in too many orders becomes a repeated group of optional parts, one of each name."""
    names: dict[tuple[str, str], Part] = {}
    for kid in part.kids:
        first = names.setdefault((kid.tag, kid.mark), kid)
        kid.optional = first.repeated = True
        if first is not kid:
            todo.append((first, kid, True))
    part.kids = list(names.values())


def ready(root: Part) -> Part:
    """A page's wrapper with turns of one part folded: rows of tables, lists one after another."""
    todo = [root]
    while todo:
        part = todo.pop()
        kids: list[Part] = []
        turns: list[tuple[Part, Part, bool]] = []
        for kid in part.kids:
            if kids and kid.mark != "-" and kids[-1].tag in TURNS and same_kind(kids[-1], kid):
                turns.append((kids[-1], kid, True))
            else:
                kids.append(kid)
        part.kids = kids
        if len(kids) > GROUP:
            grouped(part, turns)
        for a, b, _ in turns:
            absorb(a, b, again=True)
        todo += part.kids
    return root


def parts_of(root: Part) -> list[tuple[Part, int]]:
    """All parts with the place of the one around each, outer ones first, in order."""
    out, stack = [], [(root, -1)]
    while stack:
        part, up = stack.pop()
        out.append((part, up))
        stack += [(kid, len(out) - 1) for kid in reversed(part.kids)]
    return out


def varying(part: Part) -> float:
    """Characters of a part's own slot that are not in links and not the same on every page, for each page."""
    fixed = sum(part.fixed.values()) * part.pages if part.pages > 1 else 0
    return max(0, part.chars - part.links - fixed) / part.pages


def article(root: Part) -> tuple[Part, bool]:
    """The part that holds the article, and whether its tag says so.

    Among parts that are marked as articles by tag or role the one with most varying text, an article rather than the
    main part around it. Where nothing is marked, from outside in the part that has most of the varying text. Class
    words weigh in, but where they leave next to nothing they are not believed.
    """
    rows = parts_of(root)
    plain, believed = [0.0] * len(rows), [0.0] * len(rows)
    noise = [False] * len(rows)
    for k, (part, up) in enumerate(rows):
        noise[k] = part.mark == "~" or up >= 0 and noise[up]
    for k in range(len(rows) - 1, -1, -1):
        part, up = rows[k]
        own = varying(part)
        plain[k] += own
        believed[k] += 0 if noise[k] else own
        if up >= 0:
            plain[up] += plain[k]
            believed[up] += believed[k] * (2 if part.mark == "?" else 1)
    trust = believed[0] >= 0.1 * plain[0]
    mass = believed if trust else plain
    strong = [k for k, (part, _) in enumerate(rows) if part.mark == "+" and not (trust and noise[k])]
    if strong:
        best = max(strong, key=lambda k: (mass[k], -k))
        inner = [k for k in strong if rows[k][0].tag == "article" and mass[k] >= 0.5 * mass[best]]
        return rows[min(inner, default=best) if rows[best][0].tag != "article" else best][0], True
    at, places = 0, {id(part): k for k, (part, _) in enumerate(rows)}
    while True:
        inside = [places[id(kid)] for kid in rows[at][0].kids]
        top = max(inside, key=lambda k: mass[k] * (2 if rows[k][0].mark == "?" else 1), default=None)
        if top is None or mass[top] * (2 if rows[top][0].mark == "?" else 1) < MOST * max(mass[at], 1e-9):
            return rows[at][0], False
        at = top


def expression(root: Part) -> str:
    """The wrapper as a regular expression without unions, for people."""
    inner = "".join(map(expression, root.kids))
    own = ("(.*)" if root.chars else "") + inner
    if not root.tag:
        return own
    own = f"<{root.tag}>{own}</{root.tag}>"
    return f"({own})" + ("*" if root.optional and root.repeated else "+" if root.repeated else "?") if root.optional or root.repeated else own


def laid_along(page: Part, wrapper: Part) -> dict[int, Part]:
    """id of a page's element -> the part of the wrapper that it is."""
    out, todo = {id(e): wrapper for e in page.elements}, [(page, wrapper)]
    while todo:
        own, part = todo.pop()
        met = dict(aligned(own.kids, part.kids)) if own.kids and part.kids else {}
        for i, kid in enumerate(own.kids):
            if i in met:
                found = part.kids[met[i]]
            else:
                turns = [p for p in part.kids if (p.tag, p.mark) == (kid.tag, kid.mark) and p.repeated]
                found = max(turns, key=lambda p: alike(p, kid), default=None)
            if found is not None:
                out |= {id(e): found for e in kid.elements}
                todo.append((kid, found))
    return out


def read(page: Element, wrapper: Part) -> str:
    """The page's main text, read along the wrapper of its host."""
    own = wrapper_of(page)
    where = laid_along(own, wrapper)
    wanted, marked = article(wrapper)
    elements = [e for part, _ in parts_of(own) for e in part.elements if where.get(id(e)) is wanted]
    if not elements:  # an optional part that this page lets out
        wanted, marked = article(own)
        elements, where = wanted.elements, {}
    # Class words are believed unless they would leave next to nothing of the article.
    whole = sum(varying(p) for p, _ in parts_of(wanted))
    rows = parts_of(wanted)
    noise = [False] * len(rows)
    for k, (part, up) in enumerate(rows):
        noise[k] = k > 0 and (part.mark == "~" or noise[up])
    trust = sum(varying(p) for (p, _), n in zip(rows, noise, strict=True) if not n) >= 0.1 * whole
    blocks: list[str] = []
    for element in outermost(page, elements):
        blocks += text_of(element, where, marked, trust)
    return "\n".join(blocks)


def outermost(page: Element, elements: list[Element]) -> list[Element]:
    """Those of the elements that stand in none of the others, in the page's order."""
    if len(elements) < 2:
        return elements
    wanted, out, walk, skip = {id(e) for e in elements}, [], steps(page), None
    while True:
        try:
            kind, what = walk.send(skip)
        except StopIteration:
            return out
        skip = kind == "in" and id(what) in wanted
        if skip:
            out.append(what)


def text_of(element: Element, where: dict[int, Part], marked: bool, trust: bool) -> list[str]:
    """The blocks of an element. Where no tag says that it is the article, blocks that stand there on every page of the
    host and containers of links are left out."""
    blocks: list[str] = []
    line: list[str] = []
    around = [where.get(id(element))]

    def flush() -> None:
        block = squeezed("".join(line))
        line.clear()
        part = around[-1]
        if block and not (not marked and part is not None and part.pages >= SURE and digest(block) in part.fixed):
            blocks.append(block)

    walk, skip = steps(element), None
    while True:
        try:
            kind, what = walk.send(skip)
        except StopIteration:
            break
        skip = None
        if kind == "text":
            line.append(what)
            continue
        tag = what.tag
        if tag == "br":
            line.append(" ")
        elif tag in BLOCK:
            flush()
        if kind == "in":
            part = where.get(id(what))
            skip = what.mark == "-" or what.mark == "~" and trust or not marked and part is not None and part.pages > 1 and 0 < part.chars <= part.links / 0.8 and not part.kids
            if not skip and tag in CONTAINER:
                around.append(part)
        elif tag in CONTAINER:
            around.pop()
    flush()
    return blocks


def packed(root: Part) -> str:
    """A wrapper as JSON, flat: nesting may be deep."""
    return json.dumps([[up, p.tag, p.mark, sorted(p.flow), list(p.fixed.items()), p.chars, p.links, p.pages, p.optional, p.repeated] for p, up in parts_of(root)])


def unpacked(text: str) -> Part:
    parts: list[Part] = []
    for up, tag, mark, flow, fixed, chars, links, pages, optional, repeated in json.loads(text):
        part = Part(tag, mark)
        part.flow, part.fixed = set(flow), dict(map(tuple, fixed))
        part.chars, part.links, part.pages, part.optional, part.repeated = chars, links, pages, optional, repeated
        if up >= 0:
            parts[up].kids.append(part)
        parts.append(part)
    return parts[0]


def infer(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, html) -> host, wrapper (JSON) for each host. Equal pages of a task count once."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Part] = {}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for host, page in zip(batch.host, batch.html, strict=True):
                if (at := (host, digest(page))) not in seen:
                    seen.add(at)
                    own = wrapper_of(tree(page), keep=False)
                    known[host] = absorb(known[host], own) if host in known else own
        task = TaskContext.get().partitionId()
        yield pd.DataFrame([(h, task, packed(w)) for h, w in known.items()], columns=["host", "task", "wrapper"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = map(unpacked, group.sort_values("task").wrapper)
        for other in others:
            absorb(first, other)
        return pd.DataFrame({"host": [group.host.iloc[0]], "task": [int(group.task.min()) // fan_in], "wrapper": [packed(first)]})

    schema = "host string, task long, wrapper string"
    parts = cut(pages.select("host", "html").mapInPandas(fold, schema))
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:  # wrappers of fan_in tasks at a time, until a host has one
        parts = parts.groupBy("host", F.expr(f"task div {fan_in}").alias("turn")).applyInPandas(join, schema)
        if tasks <= fan_in:
            return parts.select("host", "wrapper")
        parts, tasks = cut(parts), -(-tasks // fan_in)


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, text, n_chars for every row.

    text is the article's: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
    left out; character references are decoded; white space within a block is one space; blocks are lines. Null and
    empty pages have an empty text; pages of any length and depth are read whole; a null url is a host of its own;
    repeated rows stay; an empty table gives an empty one. Other columns are not looked at, whatever their names.
    """
    hosted = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_and_path(F.col("url"))[0].alias("host"))
    known = cut(infer(hosted))
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, Part] = {}
        for batch in batches:
            texts = []
            for page, own in zip(batch.html, batch.wrapper, strict=True):
                if own not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[own] = unpacked(own)
                texts.append(read(tree(page), parsed[own]))
            yield pd.DataFrame({"page_id": batch.page_id.astype("Int64"), "url": batch.url, "text": texts, "n_chars": [len(t) for t in texts]})

    met = hosted.join(F.broadcast(known) if size <= broadcast_bytes else known, "host")
    return met.select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id long, url string, text string, n_chars long")
