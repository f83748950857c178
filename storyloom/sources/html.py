"""Pages as a source: links, and the text of the element that holds a chapter."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import STRING, array, struct
_HIDDEN = re.compile(r"\.([\w-]+)\s*\{[^}]*(?:display\s*:\s*none|speak\s*:\s*never)[^}]*\}", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Links in order, and the text of the first element whose class has ``marker``, but for hidden elements."""

    def __init__(self, marker: str, hidden: set[str]):
        super().__init__()
        self.marker, self.hidden = marker, hidden
        self.links: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.inside = self.muted = 0
        self.done = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").lower()
        opens = not self.inside and not self.done and tag == "div" and self.marker in classes
        hides = tag in ("script", "style") or bool(self.hidden & set((a.get("class") or "").split()))
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], ""))
        if self.inside and tag in ("p", "br", "div") and not self.muted and not hides:
            self.parts.append("\n")
        if tag not in _VOID:
            self.stack.append((tag, hides))
            self.inside += bool(self.inside or opens)
            self.muted += hides

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, hides = self.stack.pop()
            self.muted -= hides
            if self.inside:
                self.inside -= 1
                self.done |= not self.inside
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.links and self.stack and any(t == "a" for t, _ in self.stack):
            self.links[-1] = (self.links[-1][0], self.links[-1][1] + data)
        if self.inside and not self.muted and data.strip():
            self.parts.append(data.strip())


def parse_page(html: str, marker: str = "chapter-content") -> tuple[str, list[tuple[str, str]]]:
    page = _Page(marker, set(_HIDDEN.findall(html)))
    page.feed(html)
    page.close()
    text = re.sub(" +", " ", re.sub(r"\s*\n\s*", "\n\n", " ".join(page.parts)))
    return text.strip(), page.links


@F.pandas_udf(struct(text=STRING, links=array(struct(href=STRING, title=STRING))))
def page_parts(html: pd.Series) -> pd.DataFrame:
    """The chapter's text, paragraphs a blank line apart, and all links of a page."""
    rows = [parse_page(h or "") for h in html]
    return pd.DataFrame({"text": [t for t, _ in rows], "links": [[{"href": h, "title": " ".join(t.split())} for h, t in ls] for _, ls in rows]})


def chapter_links(pages: DataFrame, key: str, html: str, pattern: str = r"/chapter/(\d+)") -> DataFrame:
    """(``key``, number, href, title) of chapter links, in the order of numbers; the first of each number; no 'n hours ago' links."""
    links = pages.select(key, F.posexplode(page_parts(F.col(html))["links"]).alias("_pos", "_l")).select(key, "_pos", "_l.*")
    found = links.withColumn("number", F.regexp_extract("href", pattern, 1).try_cast("int")).where(F.col("number").isNotNull() & ~F.col("title").rlike(r"(?i)\b\d+\s+\w+\s+ago\b"))
    w = Window.partitionBy(key, "number").orderBy("_pos")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "number", "href", "title")


def document_text(node: str | None) -> str | None:
    """The text of a rich-text JSON document: paragraphs and headings end with a blank line, hard breaks with a line feed."""
    try:
        todo, out = [json.loads(node or "")], []
    except ValueError:
        return None
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, dict):
            kind = n.get("type")
            if kind == "text":
                out.append(n.get("text") or "")
            elif kind == "hardBreak":
                out.append("\n")
            else:
                todo += [*(["\n\n"] if kind in ("paragraph", "heading") else []), *reversed(n.get("content") or [])]
    return re.sub("\n{3,}", "\n\n", "".join(out)).strip()


@F.pandas_udf(STRING)
def rich_text(nodes: pd.Series) -> pd.Series:
    return nodes.map(document_text, na_action="ignore")
