"""Trees of HTML pages: texts of elements, and what stands beside them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+(?:>|\Z)|<(?:!|\?|/)[^>]*(?:>|\Z)""",
    re.S,
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup, and elements whose own strings are no text of the page.
_RAW = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in ("script", "style")}
_NO_TEXT = {"script", "style", "template", "rt", "rp"}
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@dataclass
class Tree:
    """Elements in page order, the root first. The descendants of ``i`` are those up to
    ``end[i]``, and its texts those from ``first[i]`` up to ``last[i]``."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    #: How many elements, strings (blank ones too) and comments stand right inside.
    parts: list[int] = field(default_factory=list)
    #: Stripped strings that are not empty.
    texts: list[str] = field(default_factory=list)

    def lines(self, i: int = 0, drop: frozenset[str] = frozenset()) -> list[str]:
        """Texts of an element, without those inside of elements named in ``drop``."""
        if not drop:
            return self.texts[self.first[i] : self.last[i]]
        out, at = [], self.first[i]
        k, end = i + 1, self.end[i]
        while k < end:
            if self.tag[k] in drop:
                out += self.texts[at : self.first[k]]
                at, k = self.last[k], self.end[k]
            else:
                k += 1
        return out + self.texts[at : self.last[i]]

    def only_text(self, i: int) -> str | None:
        """The string of an element that holds nothing else, however deep in single elements."""
        while self.parts[i] == 1:
            if self.end[i] == i + 1:
                return self.texts[self.first[i]] if self.first[i] < self.last[i] else None
            i += 1
        return None

    def siblings_after(self, i: int):
        """Elements that follow within the same one."""
        end = self.end[self.parent[i]]
        k = self.end[i]
        while k < end:
            yield k
            k = self.end[k]


def decoded(text: str, closed: bool = False) -> str:
    """``text`` with its character references decoded as browsers do, which some names need no
    semicolon for; with ``closed``, only known ones that end in one."""
    if not closed:
        return html.unescape(text)
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def tree(source: str, closed: bool = False) -> Tree:
    """The tree of a page, its texts ``decoded``. An element ends at its end tag, else with the one around it;
    end tags of nothing open are left out. Any input gives a tree, in time linear in its
    length times the number of names that are open at once."""
    t = Tree()
    stack: list[int] = []
    open_names: dict[str, int] = {}

    def start(tag: str, parent: int) -> int:
        t.tag.append(tag)
        t.parent.append(parent)
        t.first.append(len(t.texts))
        t.parts.append(0)
        t.end.append(0)
        t.last.append(0)
        if parent >= 0:
            t.parts[parent] += 1
        return len(t.tag) - 1

    def close(i: int) -> None:
        t.end[i] = len(t.tag)
        t.last[i] = len(t.texts)

    def string(piece: str, i: int) -> None:
        t.parts[i] += 1
        if t.tag[i] not in _NO_TEXT and (text := decoded(piece, closed).strip()):
            t.texts.append(text)

    stack.append(start("#page", -1))
    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        begin = m.start() if m else size
        if begin > at:
            string(source[at:begin], stack[-1])
        if m is None:
            break
        at = m.end()
        if m["tag"] is None:
            t.parts[stack[-1]] += 1
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_names.get(tag):
                while True:
                    i = stack.pop()
                    open_names[t.tag[i]] -= 1
                    close(i)
                    if t.tag[i] == tag:
                        break
            continue
        i = start(tag, stack[-1])
        if tag in _VOID or source.endswith("/>", begin, at):
            close(i)
        elif tag in _RAW:
            closing = _RAW[tag].search(source, at)
            t.parts[i] += (closing.start() if closing else size) > at
            at = closing.end() if closing else size
            close(i)
        else:
            stack.append(i)
            open_names[tag] = open_names.get(tag, 0) + 1
    for i in stack:
        close(i)
    return t


def section(t: Tree, heading: re.Pattern, marks: tuple[str, ...] = ("b", "strong"), least: int = 21, joiner: str = "") -> str | None:
    """What the elements after a heading hold, up to the next of ``marks`` beside it: a line
    for each with text, its strings put together with ``joiner``. A heading is one of
    ``marks`` with nothing but a string that ``heading`` is found in; the first whose section
    has ``least`` characters counts. Text between elements is no part of it."""
    for i, tag in enumerate(t.tag):
        if tag not in marks or not (name := t.only_text(i)) or not heading.search(name):
            continue
        lines = []
        for k in t.siblings_after(i):
            if t.tag[k] in marks:
                break
            if line := joiner.join(t.lines(k)):
                lines.append(line)
        if len(found := "\n".join(lines)) >= least:
            return found
    return None


def page_text(source: Column, drop: tuple[str, ...] = (), closed: bool = False) -> Column:
    """Stripped strings of a page, one a line, without the elements in ``drop``, however
    nested or unclosed; scripts and styles have no text. Null for null."""
    names = frozenset(drop)

    @pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else "\n".join(tree(p, closed).lines(0, names)) for p in pages], dtype="object")

    return run(source)


def section_and_text(source: Column, heading: str, closed: bool = False, least: int = 21) -> Column:
    """Struct of ``section``, null where there is none, and of the page's text."""

    @pandas_udf("struct<section:string,text:string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        found = re.compile(heading)
        rows = []
        for p in pages:
            t = None if p is None else tree(p, closed)
            rows.append((None, None) if t is None else (section(t, found, least=least), "\n".join(t.lines())))
        return pd.DataFrame(rows, columns=["section", "text"], dtype="object")

    return run(source)
