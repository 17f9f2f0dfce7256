"""Elements of a page by one pass with a stack, for a whole Arrow batch of pages.

An opening tag begins an element, which ends at its closing tag. A closing tag also ends what is still open inside its element, one
without an element is passed over, and what is open at the end of the page ends there. Void elements hold nothing. An element's text is an
interval of the page's text nodes, so elements inside each other cost no second pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# a tag begins with a letter, slash, '!' or '?' and ends at the first '>' outside quotes
_TOKEN = re.compile(r"""<(?=[A-Za-z/!?])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<""", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# --- fixed values: elements without content, and those that the opening of another one ends ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table thead tbody tfoot select".split())


@dataclass
class Element:
    """``tag``: the opening tag as it stands; its text is ``texts[first:last]``."""

    name: str
    tag: str
    first: int
    last: int

    @cached_property
    def attributes(self) -> dict[str, str]:
        """Attributes by name in lower case; the first of equal names counts. They are parsed once, however many tests ask for them."""
        out: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(self.tag[len(self.name) + 1:].rstrip("/>")):
            out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("\"", "'") else value))
        return out

    @cached_property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()


def elements(page: str) -> tuple[list[Element], list[str]]:
    """Elements in order of their opening tags, and text nodes."""
    found: list[Element] = []
    texts: list[str] = []
    stack: list[Element] = []
    depth: dict[str, int] = {}  # how often a name is on the stack, so that a stray closing tag costs no search

    def end(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            e.last = len(texts)
            depth[e.name] -= 1

    for token in _TOKEN.findall(page):
        named = _NAME.match(token) if token[0] == "<" else None
        if named is None:
            if token[0] != "<" or len(token) == 1:
                texts.append(token)
            continue
        name = named[1].lower()
        if token[1] == "/":
            if depth.get(name):
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                end(at)
            continue
        for other in IMPLIED.get(name, ()):
            at = len(stack) - 1
            while depth.get(other) and at >= 0 and stack[at].name not in HOLDERS:
                if stack[at].name == other:
                    end(at)
                    break
                at -= 1
        e = Element(name, token, len(texts), len(texts))
        found.append(e)
        if name not in VOID and not token.endswith("/>"):
            stack.append(e)
            depth[name] = depth.get(name, 0) + 1
    end(0)
    return found, texts


Test = Callable[[Element], bool]


def selector(css: str) -> Test:
    """A test for a simple selector: ``tag``, ``.class``, ``#id``, ``[name]``, ``[name=value]``, ``[name*=part]``, or several without blanks."""
    parts = re.findall(r"""([.#]?)([A-Za-z][\w-]*)|\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""", css)
    if "".join(f"{m[0]}{m[1]}" if m[1] else "" for m in parts) != re.sub(r"\[[^\]]*\]", "", css) or not parts:
        raise ValueError(f"no simple selector: {css!r}")

    def test(e: Element) -> bool:
        for kind, word, name, sign, value in parts:
            if word and not kind:
                if e.name != word.lower():
                    return False
                continue
            if kind == ".":
                good = word in e.classes
            elif kind == "#":
                good = e.attributes.get("id") == word
            elif sign:
                have = e.attributes.get(name.lower())
                good = have is not None and (have == value if sign == "=" else bool(value) and value in have)
            else:
                good = name.lower() in e.attributes
            if not good:
                return False
        return True

    return test


def tag_pattern(pattern: str) -> Test:
    """A test of the opening tag by a regular expression."""
    return lambda e, found=re.compile(pattern): found.search(e.tag) is not None


def area_texts(page: Column, tests: Callable[[], Sequence[Test]]) -> Column:
    """array<array<string>>: for each test the texts, references as they stand, of the elements it holds for, in order."""

    @F.pandas_udf("array<array<string>>")
    def areas(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        every = list(tests())
        for some in pages:
            out = []
            for html in some:
                if html is None:
                    out.append(None)
                    continue
                found, texts = elements(html)
                out.append([["".join(texts[e.first:e.last]) for e in found if test(e)] for test in every])
            yield pd.Series(out)

    return areas(page)
