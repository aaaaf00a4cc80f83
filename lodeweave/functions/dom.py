"""A small document tree on the standard parser, with the selectors that result pages need."""

from __future__ import annotations

import re
from collections.abc import Callable
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag)
        if closes and self.at.tag in closes:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; whatever is malformed is read as well as can be."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except (ValueError, AssertionError):
        pass
    return b.root


_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*$]?=)["']?(?P<val>[^"'\]]*)["']?\s*(?P<i>i)?)?\]""", re.X)


class Selector:
    """Lists of compounds with the descendant combinator."""

    def __init__(self, text: str):
        self.choices = [[self._compound(c) for c in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part.strip())] for part in re.split(r",(?![^\[]*\])", text)]

    @staticmethod
    def _compound(text: str) -> list[dict[str, str | None]]:
        return [m.groupdict() for m in _PART.finditer(text)]

    @staticmethod
    def _fits(n: Node, compound: list[dict[str, str | None]]) -> bool:
        for m in compound:
            if m["tag"]:
                if m["tag"] not in ("*", n.tag):
                    return False
            elif m["cls"]:
                if m["cls"] not in n.attrs.get("class", "").split():
                    return False
            elif m["id"]:
                if n.attrs.get("id") != m["id"]:
                    return False
            else:
                v = n.attrs.get(m["attr"])
                if v is None:
                    return False
                if m["op"]:
                    want = m["val"]
                    if m["i"]:
                        v, want = v.lower(), want.lower()
                    ok = {"=": v == want, "^=": v.startswith(want), "*=": want in v, "$=": v.endswith(want)}[m["op"]]
                    if not ok:
                        return False
        return True

    def matches(self, n: Node) -> bool:
        for chain in self.choices:
            if not chain or not self._fits(n, chain[-1]):
                continue
            rest = chain[:-1]
            for a in n.ancestors():
                if rest and self._fits(a, rest[-1]):
                    rest = rest[:-1]
            if not rest:
                return True
        return False

    def all(self, root: Node) -> list[Node]:
        return [n for n in root.walk() if n is not root and self.matches(n)]

    def first(self, root: Node) -> Node | None:
        return next((n for n in root.walk() if n is not root and self.matches(n)), None)

    def closest(self, n: Node) -> Node | None:
        return next((a for a in (n, *n.ancestors()) if self.matches(a)), None)


_DROPPED = Selector("nav, header, footer, aside, script, style, noscript, iframe, form, [role=navigation], [role=banner], [role=contentinfo]")
_MAIN = Selector("main, article, [role=main]")
_BODY = Selector("body")


def main_text(html: str | None) -> str:
    """Text of the main part of a page, without menus and scripts; three and more line breaks become two."""
    root = parse(html)
    at = _MAIN.first(root) or _BODY.first(root) or root
    out: list[str] = []

    def go(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif not _DROPPED.matches(c):
                block = c.tag in BLOCKS
                if block or c.tag == "br":
                    out.append("\n")
                go(c)
                if block:
                    out.append("\n")

    go(at)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))).strip()


# Signs that Markdown would read: anywhere, and at the head of a text.
_SIGN = re.compile(r"[\\*`_\[\]]")
_HEAD = re.compile(r"^(?=[->]|=+|~~~|#{1,6} |\+ )")
_HEAD_NUMBER = re.compile(r"^(\d+)\. ")


def escaped(text: str) -> str:
    return _HEAD_NUMBER.sub(r"\1\\. ", _HEAD.sub(r"\\", _SIGN.sub(r"\\\g<0>", text)))


def main_markdown(html: str | None) -> str:
    """Markdown of the main part of a page, without menus and scripts."""
    root = parse(html)
    return markdown(_MAIN.first(root) or _BODY.first(root) or root, lambda n: n.tag == "title" or _DROPPED.matches(n))


def markdown(html: str | None | Node, drop: Callable[[Node], bool] = lambda n: False) -> str:
    """Markdown of a page: headings, lists, links, emphasis, code and quotes, without what is to be dropped."""

    def inline(n: Node | str) -> str:
        if isinstance(n, str):
            return escaped(re.sub(r"\s+", " ", n))
        inner = "".join(inline(c) for c in n.children)
        if n.tag in ("strong", "b"):
            return f"**{inner.strip()}**" if inner.strip() else ""
        if n.tag in ("em", "i"):
            return f"_{inner.strip()}_" if inner.strip() else ""
        if n.tag == "code":
            return f"`{n.text()}`"
        if n.tag == "a" and n.attrs.get("href"):
            return f"[{inner.strip()}]({n.attrs['href']})"
        if n.tag == "br":
            return "  \n"
        return "" if n.tag in ("script", "style", "iframe", "noscript") else inner

    out: list[str] = []

    def block(n: Node, prefix: str = "") -> None:
        held: list[str] = []

        def flush() -> None:
            s = "".join(held).strip()
            held.clear()
            if s:
                out.append(prefix + s)

        for i, c in enumerate(n.children):
            if not isinstance(c, str) and drop(c):
                continue
            if isinstance(c, str) or (c.tag not in BLOCKS and c.tag not in ("script", "style", "iframe", "noscript", "html", "head", "#root")):
                held.append(inline(c))
                continue
            flush()
            if c.tag in ("script", "style", "iframe", "noscript", "head"):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                out.append(f"{prefix}{'#' * int(c.tag[1])} {inline(c).strip()}")
            elif c.tag == "pre":
                out.append(f"{prefix}```\n{c.text().strip()}\n```")
            elif c.tag in ("ul", "ol"):
                items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
                lines = [f"{prefix}{'-   ' if c.tag == 'ul' else f'{k}.  '}{inline(x).strip()}" for k, x in enumerate(items, 1)]
                if lines:
                    out.append("\n".join(lines))
            elif c.tag == "blockquote":
                block(c, prefix + "> ")
            else:
                block(c, prefix)
        flush()

    block(html if isinstance(html, Node) else parse(html))
    return "\n\n".join(out)
