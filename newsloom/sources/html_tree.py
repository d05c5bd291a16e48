"""A small lenient HTML tree on the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends an open element of these kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}
#: Elements that an implied end doesn't reach out of.
SCOPES = set("table td th ul ol dl button article section div main body html".split())


class Node:
    """An element: tag, attributes, children (nodes and strings)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        for node in self.walk():
            if node.tag in tags and (where is None or where(node)):
                yield node

    def first(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next(self.find(*tags, where=where), None)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "") -> str:
        """Stripped strings below, those without content left out."""
        return separator.join(x for x in (s.strip() for s in self.strings()) if x)

    def prune(self, tags: set[str]) -> None:
        """Drop elements of some kinds with all that is in them."""
        for node in [self, *self.walk()]:
            node.children = [c for c in node.children if isinstance(c, str) or c.tag not in tags]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.open = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = ENDS.get(tag)
        if closes:
            node = self.open
            while node.parent is not None:
                if node.tag in closes:
                    self.open = node.parent
                    break
                if node.tag in SCOPES:
                    break
                node = node.parent
        node = Node(tag, {}, self.open)
        for key, value in attrs:
            node.attrs.setdefault(key, value or "")
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None:
            if node.tag == tag:
                self.open = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
