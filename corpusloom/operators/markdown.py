"""HTML pages as Markdown: page furniture dropped, parts with little text pruned, links resolved.

A page is read once into a tree where it lies. As an element ends, its numbers are known from its children's: characters of
text, of links and of markup, and words. Its score weighs text against markup, text outside links, its kind, its class and id, and
its length; an element below THRESHOLD, or with fewer than LEAST_WORDS words, goes with all that it holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, LEAST_WORDS = 0.4, 20
#: Levels of elements; what is nested deeper is text of the last one.
DEEPEST = 150
#: Elements that are dropped, that hold nothing, that end a paragraph, and how much a kind of element counts.
DROPPED = {"nav", "footer", "header", "aside", "script", "style", "noscript", "template", "svg", "iframe", "form", "button", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "article", "section", "main", "body", "html", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "dl", "dt", "dd", "hr", "details", "summary"}
KINDS = {"article": 1.5, "main": 1.4, "section": 1.3, "p": 1.2, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7, "blockquote": 1.0, "pre": 1.2, "code": 1.0, "ul": 0.8, "ol": 0.8, "table": 1.0, "div": 0.5, "span": 0.3}
_FURNITURE = re.compile(r"\b(nav|footer|header|sidebar|ads?|advert\w*|comments?|promo|social|share|cookie|banner|menu)\b", re.IGNORECASE)
#: Elements that end an open one of their own kind.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: What is judged whether it stays; anything else stays with what holds it.
_JUDGED = BLOCKS - {"html", "body", "li", "tr", "hr", "dt", "dd", "summary", "h1", "h2", "h3", "h4", "h5", "h6"}


class Element:
    __slots__ = ("attrs", "children", "keep", "link", "markup", "tag", "text", "words")

    def __init__(self, tag: str, attrs: dict[str, str], markup: int):
        self.tag, self.attrs, self.markup = tag, attrs, markup
        self.children: list = []
        self.text = self.link = self.words = 0
        self.keep = True

    def score(self) -> float:
        density = self.text / (self.text + self.markup) if self.text else 0.0
        # a part that is all link counts against itself
        outside = 1 - 2 * self.link / self.text if self.text else 0.0
        named = 0.0 if not _FURNITURE.search(f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}") else -0.5
        return 0.4 * density + 0.2 * outside + 0.2 * KINDS.get(self.tag, 0.5) + 0.1 * named + 0.1 * min(1.0, math.log(self.text + 1) / 6)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, 0)
        self.open, self.dropped, self.over = [self.root], 0, 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.dropped:
            self.dropped += tag not in VOID and tag == self.skipping
            return
        if tag in DROPPED:
            self.skipping, self.dropped = tag, 1
            return
        if len(self.open) > DEEPEST:
            self.over += tag not in VOID
            return
        ends = _ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self._close()
        made = Element(tag, {k: v or "" for k, v in attrs}, len(self.get_starttag_text() or ""))
        self.open[-1].children.append(made)
        self.open.append(made)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            self.dropped -= tag == self.skipping
            return
        if self.over:
            self.over -= 1
            return
        if any(e.tag == tag for e in self.open[1:]):
            while self.open[-1].tag != tag:
                self._close()
            self.open[-1].markup += len(tag) + 3
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            own = self.open[-1]
            own.children.append(data)
            n = len(" ".join(data.split()))
            own.text += n
            own.words += len(data.split())

    def _close(self) -> None:
        """Numbers of an element are whole once it ends, and add to those of what holds it."""
        own = self.open.pop()
        if own.tag == "a":
            own.link = own.text
        above = self.open[-1]
        above.text, above.link, above.words, above.markup = above.text + own.text, above.link + own.link, above.words + own.words, above.markup + own.markup

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self._close()


def _prune(own: Element, threshold: float, least: int) -> None:
    """From the top: what goes takes all that it holds with it; what stays is judged part by part."""
    held = [own]
    while held:
        e = held.pop()
        for c in e.children:
            if isinstance(c, Element):
                if c.tag in _JUDGED and (c.words < least or c.score() < threshold):
                    c.keep = False
                else:
                    held.append(c)


class _Writer:
    def __init__(self, base: str):
        self.base, self.links = base, []

    def inline(self, e) -> str:
        if isinstance(e, str):
            return re.sub(r"\s+", " ", e)
        if not e.keep or e.tag == "img":
            return ""
        inner = "".join(map(self.inline, e.children))
        if e.tag == "br":
            return "  \n"
        if e.tag == "a" and e.attrs.get("href"):
            try:
                to = urljoin(self.base, e.attrs["href"].strip())
            except ValueError:
                to = e.attrs["href"].strip()
            self.links.append(to)
            return f"[{inner.strip()}]({to})" if inner.strip() else ""
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}.get(e.tag)
        return f"{mark}{inner.strip()}{mark}" if mark and inner.strip() else inner

    def blocks(self, e: Element, depth: int = 0) -> Iterator[str]:
        """Paragraphs of an element, each without blank lines around it."""
        run: list[str] = []

        def flush() -> Iterator[str]:
            text = re.sub(r" *\n *", "\n", re.sub(r"(?<! ) (?= |$)|^ ", "", "".join(run).replace("  \n", "\n"))).strip()
            run.clear()
            if text:
                yield text

        for c in e.children:
            if isinstance(c, str) or (c.tag not in BLOCKS and not any(isinstance(x, Element) and x.tag in BLOCKS for x in c.children)):
                run.append(self.inline(c))
                continue
            yield from flush()
            if c.keep:
                yield from self.block(c, depth)
        yield from flush()

    def block(self, c: Element, depth: int) -> Iterator[str]:
        if re.fullmatch("h[1-6]", c.tag):
            text = " ".join("".join(map(self.inline, c.children)).split())
            if text:
                yield f"{'#' * int(c.tag[1])} {text}"
        elif c.tag == "hr":
            yield "---"
        elif c.tag == "pre":
            yield f"```\n{_raw(c).strip(chr(10))}\n```"
        elif c.tag in ("ul", "ol"):
            lines, n = [], 0
            for item in c.children:
                if isinstance(item, Element) and item.keep:
                    inner = list(self.blocks(item, depth + 1))
                    if inner:
                        n += 1
                        mark = f"{n}." if c.tag == "ol" else "*"
                        lines.append(f"{mark} " + "\n".join(inner).replace("\n", "\n" + " " * (len(mark) + 1)))
            if lines:
                yield "\n".join(lines)
        elif c.tag == "blockquote":
            inner = "\n\n".join(self.blocks(c, depth))
            if inner:
                yield "\n".join(f"> {x}".rstrip() for x in inner.split("\n"))
        elif c.tag == "table":
            rows = [["".join(" ".join(self.blocks(cell, depth)).split("\n")) for cell in row.children if isinstance(cell, Element) and cell.tag in ("td", "th")] for row in _rows(c)]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                yield "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])
        else:
            yield from self.blocks(c, depth)


def _raw(e) -> str:
    return e if isinstance(e, str) else "".join(map(_raw, e.children))


def _rows(table: Element) -> Iterator[Element]:
    for c in table.children:
        if isinstance(c, Element):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def convert(page: str, base: str = "", *, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> tuple[str, str, list[str]]:
    """(raw, fit, links): the whole page and what pruning leaves as Markdown, and the addresses its links lead to, in order."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    writer = _Writer(base)
    raw, links = "\n\n".join(writer.blocks(tree.root)), writer.links
    _prune(tree.root, threshold, least_words)
    return raw, "\n\n".join(_Writer(base).blocks(tree.root)), links


def markdown(pages: DataFrame, *, url: str = "url", html: str = "html", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """`pages` with `raw`, `fit`, `content` (fit, or raw where pruning leaves nothing) and `links`; null and empty pages have empty texts."""
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    names = [f.name for f in given.schema["row"].dataType.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [convert(h or "", u or "", threshold=threshold, least_words=least_words) for u, h in zip(batch["url"], batch["html"], strict=True)]
            yield pd.DataFrame({"row": batch["row"], "raw": [m[0] for m in made], "fit": [m[1] for m in made], "links": [m[2] for m in made]})

    kind = given.schema["row"].dataType.simpleString()
    out = given.mapInPandas(run, f"row {kind}, raw string, fit string, links array<string>")
    return out.select(*[F.col(f"row.`{c}`") for c in names], "raw", "fit", F.coalesce(F.nullif("fit", F.lit("")), "raw").alias("content"), "links")
