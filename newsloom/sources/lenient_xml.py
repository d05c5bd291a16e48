"""XML as it is found: a tokenizer that never stops at an error, and the entries of feeds and sitemaps.

What isn't well-formed is read like this: an ampersand that starts no known reference is text, and so is a ``<`` that starts no
tag; named references of HTML are known; values of attributes may go without quotes; an end tag closes what is open above its
own start tag, and is nothing if there is none; at the end of the text all is closed, and a tag that breaks off is dropped. Entries
don't nest, so one that starts closes one that is open. Names lose their prefix and are in lower case.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# one branch for each kind of mark-up; a tag ends at the first > outside quotes, and holds no <. No part gives back what it took.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<\?[^<>]*+>|<![a-zA-Z](?:[^<>\[]|\[[^\]]*+\])*+>|</(?P<end>[^\s<>/]++)[^<>]*+>"""
    r"""|<(?P<start>[^\W\d][^\s<>/=]*+)(?P<attrs>(?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]*[^\s"'<>/]))""")
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_CUT_OFF = re.compile(r"<(?:[/!?\w][^<>]*)?\Z")
_DECLARED = re.compile(rb"""\A\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)""")


@dataclass(slots=True)
class Element:
    """An element of an entry: its name, attributes and the text before its first child (or all text in it, if there is none before)."""

    tag: str
    attrs: dict[str, str]
    text: str = ""
    inside: list[str] = field(default_factory=list)
    parent: bool = False

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)


def unescape(text: str) -> str:
    """Text with its references replaced; those that aren't known, or lack their semicolon, stay."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def declared_charset(content: bytes) -> str | None:
    """The character set that a byte order mark or the XML declaration names."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return name
    found = _DECLARED.match(content[:1024])
    return found[1].decode("ascii") if found else None


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


def events(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("start", name, attributes), ("end", name, {}) and ("text", text, {}) in order. Starts and ends needn't match."""
    at = 0
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            yield "text", unescape(text[at : m.start()]), {}
        at = m.end()
        if m["start"]:
            attrs: dict[str, str] = {}
            for a in _ATTR.finditer(m["attrs"]):
                attrs.setdefault(_local(a[1]), unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]))
            yield "start", _local(m["start"]), attrs
            if m["attrs"].endswith("/"):
                yield "end", _local(m["start"]), {}
        elif m["end"]:
            yield "end", _local(m["end"]), {}
        elif m["data"]:
            yield "text", m["data"], {}
    rest = _CUT_OFF.sub("", text[at:])
    if rest:
        yield "text", unescape(rest), {}


def root_name(text: str) -> str:
    """The name of the first element; empty if there is none."""
    return next((name for kind, name, _ in events(text) if kind == "start"), "")


def entries(text: str, starts: Callable[[str, int], bool]) -> Iterator[list[Element]]:
    """The elements of each entry in document order, its own first. ``starts`` tells from a name and how deep it stands (the root: 0)
    whether an element is an entry."""
    open_: list[tuple[str, Element | None]] = []
    entry: list[Element] | None = None
    own = -1  # where the open entry's own element stands in open_

    def close(down_to: int, by_name: bool) -> Iterator[list[Element]]:
        nonlocal entry, own
        last = open_[down_to][1]
        if by_name and last is not None and not last.text.strip():
            last.text = "".join(last.inside)
        del open_[down_to:]
        if entry is not None and down_to <= own:
            done, entry, own = entry, None, -1
            yield done

    for kind, value, attrs in events(text):
        if kind == "start":
            # an entry of the same kind inside another means that the other's end is missing
            if entry is not None and open_[own][0] == value and starts(value, own):
                yield from close(own, False)
            if entry is None and starts(value, len(open_)):
                entry, own = [], len(open_)
            element = Element(value, attrs) if entry is not None else None
            if element is not None:
                entry.append(element)
                if open_ and open_[-1][1] is not None:
                    open_[-1][1].parent = True
            open_.append((value, element))
        elif kind == "end":
            at = next((i for i in reversed(range(len(open_))) if open_[i][0] == value), None)
            if at is not None:
                yield from close(at, True)
        elif entry is not None:
            for _, element in open_[own + 1 :]:
                element.inside.append(value)
            top = open_[-1][1]
            if not top.parent:
                top.text += value
    if open_:
        yield from close(0, False)
