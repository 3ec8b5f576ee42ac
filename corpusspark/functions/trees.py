"""A tolerant tree of HTML, made with the standard library, for converters that need structure."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Fixed values of HTML: elements without content, and what an opening tag closes by itself.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "div", "section", "main"}
HIDDEN = {"script", "style"}


class Node:
    """An element with its attributes and children; children are nodes and strings."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.elements()[::-1]

    def find(self, name: str | None = None, cls: str | None = None) -> Node | None:
        return next(self.all(name, cls), None)

    def all(self, name: str | None = None, cls: str | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if (name is None or n.name == name) and (cls is None or cls in n.classes))

    def below(self, name: str | None = None, cls: str | None = None) -> list[Node]:
        """Children alone."""
        return [n for n in self.elements() if (name is None or n.name == name) and (cls is None or cls in n.classes)]

    def siblings(self, back: bool = False) -> list[Node]:
        """Elements after this one in its parent, or before it, nearest first."""
        own = self.parent.elements() if self.parent else [self]
        at = next(i for i, n in enumerate(own) if n is self)
        return own[:at][::-1] if back else own[at + 1 :]

    def raw(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.name not in HIDDEN:
                todo += n.children[::-1]
        return "".join(out)

    def text(self, between: str = "") -> str:
        """The visible text with single spaces; `between` is put between pieces of different elements."""
        if not between:
            return tidy(self.raw())
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.name not in HIDDEN:
                todo += n.children[::-1]
        return tidy(between.join(out))


def tidy(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace("\xa0", " ")).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            n = self.at
            while n.parent is not None and n.name not in CLOSES[tag] and n.name not in SCOPES:
                n = n.parent
            if n.name in CLOSES[tag]:
                self.at = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:  # an end tag without its start is ignored
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parsed(html: str) -> Node:
    """The tree of a page; what is cut off or nested wrongly still gives a tree."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
