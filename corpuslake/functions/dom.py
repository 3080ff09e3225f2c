"""A small element tree for page extraction, on the standard library's HTML tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Element:
    """Tag, attributes and children (elements and strings) of an element."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Element))

    def matching(self, tag: str | None = None, *, cls: str | None = None, where: Callable[[Element], bool] | None = None, **attrs: str) -> Iterator[Element]:
        """Elements below by tag, class and attribute values, in document order."""
        for e in self.walk():
            if (tag is None or e.tag == tag) and (cls is None or cls in e.attrs.get("class", "").split()) and all(e.attrs.get(k) == v for k, v in attrs.items()) and (where is None or where(e)):
                yield e

    def all(self, tag: str | None = None, **kwargs) -> list[Element]:  # noqa: ANN003
        return list(self.matching(tag, **kwargs))

    def first(self, tag: str | None = None, **kwargs) -> Element | None:  # noqa: ANN003
        return next(self.matching(tag, **kwargs), None)

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        """Text pieces below, in document order, without those inside ``skip`` tags."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skip:
                stack.extend(reversed(x.children))

    def text(self, separator: str = "", strip: bool = True, skip: frozenset[str] = frozenset()) -> str:
        """The text below; with ``strip`` each piece is trimmed and blank ones are left out."""
        pieces = self.strings(skip)
        return separator.join(p for p in ((s.strip() if strip else s) for s in pieces) if p or not strip)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = _SELF_CLOSING.get(tag)
        if closes and self.open[-1].tag in closes:
            while len(self.open) > 1 and self.open[-1].tag in closes:
                self.open.pop()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i: int) -> int:
        """As the library's, but "<![" is a comment up to the next ">", as in browsers: the library refuses broken ones."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)


#: The ampersand of a named reference without its semicolon.
_UNENDED = re.compile(r"&(?=[A-Za-z][0-9A-Za-z]*+(?!;))")


def parse(html: str | bytes | None, loose: bool = True) -> Element:
    """The tree of a page; null gives an empty one. Bytes are read as UTF-8, bad ones replaced.

    Named references without a semicolon are read as browsers do, or kept as they are written where not ``loose``.
    """
    if isinstance(html, (bytes, bytearray)):
        html = bytes(html).decode("utf-8", "replace")
    b = _Builder()
    b.feed(html or "" if loose else _UNENDED.sub("&amp;", html or ""))
    if b.rawdata.startswith("<!--"):  # a comment without an end goes on to the end of the page
        b.rawdata = ""
    b.close()
    return b.root
