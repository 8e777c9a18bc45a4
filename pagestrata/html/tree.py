"""An HTML tree on the standard library's tokenizer, with the implied ends of elements that pages rely on.

Nodes are numbered in document order. ``pre`` is an element's number and ``end`` the last number inside
it, so containment and order are comparisons of numbers; the elements, and the pieces of text, of a document stand in one
list each, of which an element's own are a slice. Nothing here calls itself, however deep a page is nested.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose start ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
}
#: What an element's start ends, and where the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: Elements nested deeper are put side by side, as browsers do.
DEPTH = 512
#: Formatting elements alike that go on after a block's end, at most, as in browsers.
ALIKE = 3
WHITE = re.compile(r"\s+")


class Document:
    """All elements in order, and all pieces of text in order."""

    __slots__ = ("elements", "texts")

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.texts: list[str] = []


class Element:
    """A tag with attributes and children, which are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "pre", "end", "document", "first_text", "past_text", "_raw")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.pre = self.end = self.first_text = self.past_text = 0
        self.document: Document | None = None
        self._raw: str | None = None

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def has(self, name: str) -> bool:
        return name in self.attrs

    def walk(self) -> list[Element]:
        """The elements inside, in document order, without this one."""
        return self.document.elements[self.pre + 1 : self.end + 1]

    def all(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self.walk() if test(e)]

    def tags(self, *names: str) -> list[Element]:
        wanted = set(names)
        return [e for e in self.walk() if e.tag in wanted]

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        inside = self.document.elements
        return next((inside[i] for i in range(self.pre + 1, self.end + 1) if test(inside[i])), None)

    def line(self) -> Iterator[Element]:
        """This element and those around it, inside out."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent

    def inside(self, test: Callable[[Element], bool]) -> Element | None:
        """The nearest of this element and those around it that passes."""
        return next((e for e in self.line() if test(e)), None)

    def around(self, test: Callable[[Element], bool]) -> Element | None:
        return self.parent.inside(test) if self.parent is not None else None

    def contains(self, other: Element) -> bool:
        return self.pre <= other.pre <= self.end

    def precedes(self, other: Element) -> bool:
        """Whether the other starts later; what is inside starts later too."""
        return self.pre < other.pre

    @property
    def raw(self) -> str:
        """All text inside."""
        if self._raw is None:
            self._raw = "".join(self.document.texts[self.first_text : self.past_text])
        return self._raw

    @property
    def text(self) -> str:
        return squeeze(self.raw)

    @property
    def child_elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def pieces(self, skip: frozenset[str] | set[str] = frozenset(), edges: frozenset[str] | set[str] = frozenset()) -> Iterator[str]:
        """The pieces of text inside, without those in elements of ``skip``; a blank where an element of ``edges`` starts or ends."""
        todo: list[Element | str] = [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                yield at
            elif at is self or at.tag not in skip:
                if at.tag in edges:
                    yield " "
                    todo.append(" ")
                todo.extend(reversed(at.children))


def squeeze(text: str | None) -> str:
    return WHITE.sub(" ", (text or "").strip())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.head = Element("head", {}, self.root)
        self.body = Element("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.open = [self.root, self.head]
        self.in_body = False
        self.ended: list[Element] = []  # formatting that a block's end cut short

    def enter_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.open = [self.root, self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "body"):
            own = self.root if tag == "html" else self.body
            for k, v in given.items():
                own.attrs.setdefault(k, v)
            if tag == "body":
                self.enter_body()
            return
        if tag == "head":
            return
        if not self.in_body and tag not in HEAD_ONLY:
            self.enter_body()
        if tag in ENDS_P:
            self.end_implied({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            self.end_implied(*IMPLIED[tag])
        if tag == "a":
            self.end_implied({"a"}, SCOPE)
        self.reopen(tag)
        self.push(tag, given)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.open[min(len(self.open), DEPTH) - 1]
        node = Element(tag, attrs, parent)
        parent.children.append(node)
        self.open.append(node)

    def end_implied(self, ends: set[str], stops: set[str]) -> None:
        """Ends the outermost open element of ``ends`` within the nearest of ``stops``."""
        at = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in stops:
                break
            if self.open[i].tag in ends:
                at = i
        if at is not None:
            self.cut(at)

    def cut(self, at: int) -> None:
        """Ends all open elements from one on; formatting among them goes on in what follows."""
        for e in self.open[at + 1 :]:
            if e.tag in FORMATTING and sum(x.tag == e.tag and x.attrs == e.attrs for x in self.ended) < ALIKE:
                self.ended.append(e)
        del self.open[at:]

    def reopen(self, tag: str = "") -> None:
        if not self.ended or tag in ENDS_P or tag in IMPLIED:
            return
        for e in self.ended:
            if e.tag != tag or tag != "a":
                self.push(e.tag, dict(e.attrs))
        self.ended = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and not self.in_body:
                self.open = [self.root, self.head]
            return
        if tag in FORMATTING:
            late = next((e for e in reversed(self.ended) if e.tag == tag), None)
            if late is not None:
                self.ended.remove(late)
                return
        wanted = set(HEADINGS) if tag in HEADINGS else {tag}
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in wanted:
                if tag in FORMATTING or tag == "span":
                    kept = [e for e in self.open[i + 1 :] if e.tag in FORMATTING]
                    if any(e.tag not in FORMATTING and e.tag != "span" for e in self.open[i + 1 :]):
                        return  # a block is open inside: the end takes effect with the block's
                    del self.open[i:]
                    self.ended += kept
                else:
                    self.cut(i)
                return
            if self.open[i].tag in SCOPE and tag not in SCOPE and tag not in ("tr", "thead", "tbody", "tfoot", "table"):
                break
        if tag == "p":  # an end without a start makes an empty paragraph
            self.enter_body()
            self.push("p", {})
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.in_body and self.open[-1] in (self.root, self.head):
            if not data.strip():
                return
            self.enter_body()
        if self.ended and data.strip():
            self.reopen()
        self.open[-1].children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def number(root: Element) -> None:
    """Numbers the elements and fills the document's lists."""
    document = Document()
    todo: list[Element | str | tuple[Element]] = [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            document.texts.append(at)
        elif isinstance(at, tuple):  # all inside has been numbered
            at[0].end, at[0].past_text = len(document.elements) - 1, len(document.texts)
        else:
            at.document, at.pre, at.first_text = document, len(document.elements), len(document.texts)
            document.elements.append(at)
            todo.append((at,))
            todo.extend(reversed(at.children))


def parse(html: str | None) -> Element:
    """The document's html element; it always has a head and a body."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    number(builder.root)
    return builder.root
