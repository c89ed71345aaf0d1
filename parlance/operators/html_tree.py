"""HTML as browsers read it: tokens with their places in the source, and the standard's tree of them.

The tree decides what a page's texts are: end tags are implied, text between the rows of a table goes before the table, marks that
overlap are closed and opened again, and neighbouring characters are one text. Frames are passed over.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of the standard: groups of elements that its rules name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound frame".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = BLOCKS | HEADINGS | VOID | frozenset(
    "applet body caption colgroup dd dt form frameset head html iframe li marquee noembed noframes noscript object p plaintext script select style table tbody td template textarea tfoot th thead title tr xmp".split()
)
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
ROWS = ("tbody", "tfoot", "thead")
#: Elements that end foreign content, and those inside it where the page's own rules hold again.
BREAKOUT = BLOCKS | HEADINGS | frozenset("b big body br code dd dt em embed head hr i img li meta nobr p ruby s small span strong strike sub sup table tt u var".split())
INTEGRATION = frozenset((("svg", "foreignobject"), ("svg", "desc"), ("svg", "title")))
MATH_TEXT = frozenset("mi mo mn ms mtext".split())

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TAG = re.compile(r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*>""")
_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


@dataclass
class Token:
    kind: str  # start, end, text, comment, doctype
    name: str
    begin: int
    end: int
    attrs: dict[str, tuple[str, int, int, str]] = field(default_factory=dict)  # name to (value, begin, end, quote)
    closed: bool = False


@dataclass
class Text:
    """Characters that are one text of the page, though they may come from several places of the source."""

    runs: list[tuple[int, int]]


@dataclass(eq=False)
class Element:
    name: str
    space: str = "html"
    token: Token | None = None
    children: list = field(default_factory=list)
    parent: Element | None = None

    def add(self, node: Element | Text, before: Element | None = None) -> None:
        at = self.children.index(before) if before is not None else len(self.children)
        if isinstance(node, Text):
            if at and isinstance(self.children[at - 1], Text):
                self.children[at - 1].runs += node.runs
                return
        else:
            if node.parent is not None:
                node.parent.children.remove(node)
            node.parent = self
            at = self.children.index(before) if before is not None else len(self.children)
        self.children.insert(at, node)


def attribute_value(raw: str) -> str:
    """raw with its references as an attribute has them: a name without a semicolon is none before a letter, a digit or an equals sign."""

    def one(m: re.Match) -> str:
        got = m[0]
        if got[1] != "#" and not got.endswith(";"):
            after = raw[m.end() : m.end() + 1]
            if after == "=" or html.unescape(got)[-1:] == got[-1:] and len(html.unescape(got)) > 1:
                return got
        return html.unescape(got)

    return _REFERENCE.sub(one, raw).replace("\r\n", "\n").replace("\r", "\n")


class Tokens:
    """The tokens of a page. Whoever reads them says, after a start tag, whether the text that follows is raw."""

    def __init__(self, raw: str):
        self.raw, self.at, self.low = raw, 0, raw.lower()
        if len(self.low) != len(raw):  # characters whose lower case is longer
            self.low = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)

    def raw_text(self, name: str) -> Token | None:
        """All up to the element's own end tag."""
        m = None if name == "plaintext" else re.compile(f"</{re.escape(name)}(?=[\\s/>])").search(self.low, self.at)
        end = m.start() if m else len(self.raw)
        begin, self.at = self.at, end
        return Token("text", "", begin, end) if end > begin else None

    def next(self, foreign: bool = False) -> Token | None:
        raw, at = self.raw, self.at
        while at < len(raw):
            if raw[at] != "<":
                end = raw.find("<", at)
                self.at = end if end >= 0 else len(raw)
                return Token("text", "", at, self.at)
            after = raw[at + 1 : at + 2]
            if after == "!" or after == "?":
                return self._declaration(at, foreign)
            close = after == "/"
            first = raw[at + 2 : at + 3] if close else after
            if first.isascii() and first.isalpha():
                m = _TAG.match(raw, at + 1 + close)
                if not m:
                    self.at = len(raw)  # a tag that never ends is none
                    return None
                self.at = m.end()
                return self._tag(at, m.end(), close)
            if close and first == ">":
                at = self.at = at + 3
                continue
            if close and first:
                end = raw.find(">", at)
                self.at = end + 1 if end >= 0 else len(raw)
                return Token("comment", "", at, self.at)
            end = raw.find("<", at + 1)
            self.at = end if end >= 0 else len(raw)
            return Token("text", "", at, self.at)
        self.at = len(raw)
        return None

    def _declaration(self, at: int, foreign: bool) -> Token:
        raw = self.raw
        if raw.startswith("<!--", at):
            m = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S).match(raw, at)
            self.at = m.end()
            return Token("comment", "", at, self.at)
        if foreign and raw.startswith("<![CDATA[", at):
            end = raw.find("]]>", at)
            self.at = end + 3 if end >= 0 else len(raw)
            return Token("text", "cdata", at + 9, end if end >= 0 else len(raw))
        end = raw.find(">", at)
        self.at = end + 1 if end >= 0 else len(raw)
        return Token("doctype" if self.low.startswith("<!doctype", at) else "comment", "", at, self.at)

    def _tag(self, begin: int, end: int, close: bool) -> Token:
        start = begin + 1 + close
        m = re.compile(r"[^\s/>]+").match(self.raw, start)
        name = "".join(c.lower() if c.isascii() else c for c in m[0])
        out = Token("end" if close else "start", name, begin, end, closed=self.raw[end - 2] == "/")
        at = m.end()
        while not close and at < end - 1 and (a := _ATTRIBUTE.match(self.raw, at, end - 1)):
            at = a.end()
            k = next((k for k in (2, 3, 4) if a[k] is not None), 0)
            key = "".join(c.lower() if c.isascii() else c for c in a[1])
            out.attrs.setdefault(key, (attribute_value(a[k]) if k else "", a.start(k) if k else -1, a.end(k) if k else -1, {2: '"', 3: "'"}.get(k, "")))
        return out


class Tree:
    """The standard's way from tokens to a tree. `root` has the page."""

    def __init__(self, raw: str):
        self.raw, self.tokens = raw, Tokens(raw)
        self.root = Element("#document")
        self.open: list[Element] = []
        self.active: list[Element | None] = []  # formatting elements; None is a mark
        self.head: Element | None = None
        self.form: Element | None = None
        self.mode = "before_html"
        self.templates: list[str] = []
        self.foster = False
        self.drop_newline = False
        self.quirks = True
        while (t := self.tokens.next(self._foreign_now())) is not None:
            self._take(t)
        if self.mode in ("before_html", "before_head", "in_head", "after_head"):
            self._body()

    # places

    def _foreign_now(self) -> bool:
        return bool(self.open) and self.open[-1].space != "html"

    def _place(self) -> tuple[Element, Element | None]:
        """Where the next node goes: in the current node, or before the table that it may not be in."""
        target = self.open[-1] if self.open else self.root
        if not (self.foster and target.name in ("table", "tr", *ROWS)):
            return target, None
        for i in range(len(self.open) - 1, -1, -1):
            x = self.open[i]
            if x.name == "template":
                return x, None
            if x.name == "table":
                return (x.parent, x) if x.parent is not None else (self.open[i - 1], None)
        return self.open[0], None

    def insert(self, token: Token | None, name: str | None = None, space: str = "html", keep: bool = True) -> Element:
        node = Element(name or token.name, space, token)
        parent, before = self._place()
        parent.add(node, before)
        if keep:
            self.open.append(node)
        return node

    def write(self, begin: int, end: int) -> None:
        if end > begin:
            parent, before = self._place()
            parent.add(Text([(begin, end)]), before)

    def in_scope(self, *names: str, more: frozenset | tuple = ()) -> bool:
        for x in reversed(self.open):
            if x.space == "html" and x.name in names:
                return True
            if x.space == "html" and (x.name in SCOPE or x.name in more) or (x.space, x.name) in INTEGRATION or x.space == "math" and x.name in MATH_TEXT:
                return False
        return False

    def in_table_scope(self, *names: str) -> bool:
        for x in reversed(self.open):
            if x.space == "html" and x.name in names:
                return True
            if x.name in ("html", "table", "template"):
                return False
        return False

    def pop_to(self, *names: str) -> None:
        while self.open:
            x = self.open.pop()
            if x.space == "html" and x.name in names:
                return

    def imply(self, but: str = "", more: frozenset | tuple = ()) -> None:
        while self.open and self.open[-1].space == "html" and (self.open[-1].name in IMPLIED or self.open[-1].name in more) and self.open[-1].name != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", more=("button",)):
            self.imply("p")
            self.pop_to("p")

    def back_to(self, *names: str) -> None:
        """Clears the stack back to a table's part."""
        while self.open and self.open[-1].name not in (*names, "template", "html"):
            self.open.pop()

    def clear_marks(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # formatting

    def remember(self, node: Element) -> None:
        alike = [x for x in self._since_mark() if x.name == node.name and {k: v[0] for k, v in x.token.attrs.items()} == {k: v[0] for k, v in node.token.attrs.items()}]
        if len(alike) >= 3:
            self.active.remove(alike[0])
        self.active.append(node)

    def _since_mark(self) -> list[Element]:
        out = []
        for x in reversed(self.active):
            if x is None:
                break
            out.append(x)
        return out[::-1]

    def reopen(self) -> None:
        """Formatting that an end of a block has cut off goes on."""
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.insert(self.active[k].token)

    def adopt(self, name: str) -> None:
        """The end of a formatting element, where marks overlap blocks."""
        if self.open[-1].name == name and self.open[-1] not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            mark = next((x for x in reversed(self._since_mark()) if x.name == name), None)
            if mark is None:
                self._any_end(name)
                return
            if mark not in self.open:
                self.active.remove(mark)
                return
            if not self.in_scope(name):
                return
            at = self.open.index(mark)
            block = next((x for x in self.open[at + 1 :] if x.name in SPECIAL and x.space == "html"), None)
            if block is None:
                del self.open[at:]
                self.active.remove(mark)
                return
            above, spot = self.open[at - 1], self.active.index(mark)
            node_at, last, steps = self.open.index(block), block, 0
            while True:
                node_at -= 1
                node = self.open[node_at]
                if node is mark:
                    break
                steps += 1
                if steps > 3 and node in self.active:
                    if self.active.index(node) < spot:
                        spot -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.open.remove(node)
                    continue
                fresh = Element(node.name, "html", Token("start", node.name, -1, -1, node.token.attrs))
                self.active[self.active.index(node)] = fresh
                self.open[node_at] = fresh
                if last is block:
                    spot = self.active.index(fresh) + 1
                fresh.add(last)
                last = fresh
            if above.name in ("table", "tr", *ROWS):
                self.foster, held = True, self.open
                self.open = self.open[: self.open.index(above) + 1]
                parent, before = self._place()
                self.foster, self.open = False, held
                parent.add(last, before)
            else:
                above.add(last)
            fresh = Element(mark.name, "html", Token("start", mark.name, -1, -1, mark.token.attrs))
            children, block.children = block.children, []
            for c in children:
                if isinstance(c, Element):
                    c.parent = fresh
                fresh.children.append(c)
            block.add(fresh)
            old = self.active.index(mark)
            self.active.remove(mark)
            self.active.insert(spot - (old < spot), fresh)
            self.open.remove(mark)
            self.open.insert(self.open.index(block) + 1, fresh)

    def _any_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            x = self.open[i]
            if x.name == name and x.space == "html":
                self.imply(name)
                del self.open[i:]
                return
            if x.name in SPECIAL and x.space == "html":
                return

    # modes

    def _take(self, t: Token) -> None:
        newline, self.drop_newline = self.drop_newline, False
        if t.kind == "comment":
            # a comment is a node: characters before and after it are two texts
            target, before = self._place() if self.open else (self.root, None)
            target.add(Element("#comment"), before)
            return
        if t.kind == "doctype":
            self.quirks = self.quirks and "html" not in self.raw[t.begin : t.end].lower()[9:]
            return
        if t.kind == "text":
            if newline and self.raw[t.begin : t.end][:2] == "\r\n":
                t.begin += 2
            elif newline and self.raw[t.begin : t.begin + 1] == "\n":
                t.begin += 1
            if self._foreign_text():
                self.write(t.begin, t.end)
                return
            lead = re.compile(r"[ \t\n\f\r]*").match(self.raw, t.begin, t.end).end()
            if lead > t.begin:
                self._blank(t.begin, lead)
            if lead < t.end:
                self._characters(lead, t.end, lead > t.begin)
            return
        if self._in_foreign(t):
            self._foreign(t)
        else:
            self._dispatch(t)

    def _foreign_text(self) -> bool:
        x = self.open[-1] if self.open else None
        return x is not None and x.space != "html" and (x.space, x.name) not in INTEGRATION and not (x.space == "math" and x.name in MATH_TEXT)

    def _in_foreign(self, t: Token) -> bool:
        x = self.open[-1] if self.open else None
        if x is None or x.space == "html":
            return False
        if t.kind == "start" and ((x.space, x.name) in INTEGRATION or x.space == "math" and x.name in MATH_TEXT and t.name not in ("mglyph", "malignmark") or x.name == "annotation-xml" and t.name == "svg"):
            return False
        return True

    def _foreign(self, t: Token) -> None:
        if t.kind == "start":
            if t.name in BREAKOUT or t.name == "font" and {"color", "face", "size"} & set(t.attrs):
                while self.open[-1].space != "html" and (self.open[-1].space, self.open[-1].name) not in INTEGRATION and not (self.open[-1].space == "math" and self.open[-1].name in MATH_TEXT):
                    self.open.pop()
                self._dispatch(t)
                return
            self.insert(t, space=self.open[-1].space, keep=not t.closed)
            return
        if t.name in ("br", "p"):
            while self.open[-1].space != "html":
                self.open.pop()
            self._dispatch(t)
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == t.name:
                del self.open[i:]
                return
            if self.open[i - 1].space == "html":
                self._dispatch(t)
                return

    def _html(self) -> None:
        if not self.open:
            self.insert(None, "html")
        self.mode = "before_head"

    def _head(self) -> None:
        if self.mode == "before_html":
            self._html()
        self.head = self.insert(None, "head")
        self.mode = "in_head"

    def _body(self) -> None:
        if self.mode in ("before_html", "before_head"):
            self._head()
        if self.mode == "in_head":
            self.open.pop()
            self.mode = "after_head"
        self.insert(None, "body")
        self.mode = "in_body"

    def _blank(self, begin: int, end: int) -> None:
        if self.mode in ("before_html", "before_head"):
            return
        if self.mode in ("in_table", "in_body_of_table", "in_row") and self.open[-1].name in ("table", "tr", *ROWS):
            # blanks stay in the table, unless words come right after them
            after = self.raw[end : end + 1]
            if after and after != "<":
                self._fostered(begin, end)
                return
        elif self.mode in ("in_body", "in_cell", "in_caption", "in_template"):
            self.reopen()
        self.write(begin, end)

    def _fostered(self, begin: int, end: int) -> None:
        self.foster = True
        self.reopen()
        self.write(begin, end)
        self.foster = False

    def _characters(self, begin: int, end: int, after_blank: bool) -> None:
        if self.mode in ("before_html", "before_head", "in_head", "after_head"):
            self._body()
        elif self.mode == "in_columns":
            if self.open[-1].name != "colgroup":
                return
            self.open.pop()
            self.mode = "in_table"
        elif self.mode == "after_body":
            self.mode = "in_body"
        if self.mode in ("in_table", "in_body_of_table", "in_row") and self.open[-1].name in ("table", "tr", *ROWS):
            self._fostered(begin, end)
            return
        if self.mode != "in_select":
            self.reopen()
        self.write(begin, end)

    def _dispatch(self, t: Token) -> None:
        getattr(self, f"_{self.mode}")(t)

    def _before_html(self, t: Token) -> None:
        if t.kind == "end" and t.name not in ("head", "body", "html", "br"):
            return
        if t.name == "html" and t.kind == "start":
            self.insert(t)
            self.mode = "before_head"
            return
        self._html()
        self._dispatch(t)

    def _before_head(self, t: Token) -> None:
        if t.kind == "start" and t.name == "html" or t.kind == "end" and t.name not in ("head", "body", "html", "br"):
            return
        if t.kind == "start" and t.name == "head":
            self.head = self.insert(t)
            self.mode = "in_head"
            return
        self._head()
        self._dispatch(t)

    def _in_head(self, t: Token) -> None:
        if t.kind == "start" and t.name in IN_HEAD:
            self._head_element(t)
        elif t.kind == "end" and t.name == "template":
            self._end_template()
        elif t.kind == "end" and t.name == "head":
            self.open.pop()
            self.mode = "after_head"
        elif t.kind == "start" and t.name in ("head", "html") or t.kind == "end" and t.name not in ("body", "html", "br"):
            return
        else:
            self.open.pop()
            self.mode = "after_head"
            self._dispatch(t)

    def _head_element(self, t: Token) -> None:
        if t.name == "template":
            self.insert(t)
            self.active.append(None)
            self.templates.append("in_template")
            self.mode = "in_template"
        elif t.name in RAW or t.name in ESCAPABLE:
            self._raw(t)
        else:
            self.insert(t, keep=False)

    def _raw(self, t: Token) -> None:
        """An element whose text has no tags; its end tag follows at once."""
        self.insert(t)
        held = self.tokens.raw_text(t.name)
        if held is not None:
            begin = held.begin
            if t.name == "textarea":
                begin += 2 if self.raw.startswith("\r\n", begin) else self.raw.startswith("\n", begin)
            if held.end > begin:
                self.open[-1].add(Text([(begin, held.end)]))
        self.open.pop()
        if t.name != "plaintext":
            after = self.tokens.at
            if after < len(self.raw):
                self.tokens.next()

    def _end_template(self) -> None:
        if any(x.name == "template" and x.space == "html" for x in self.open):
            self.pop_to("template")
            self.clear_marks()
            if self.templates:
                self.templates.pop()
            self._reset()

    def _after_head(self, t: Token) -> None:
        if t.kind == "start" and t.name == "body":
            self.insert(t)
            self.mode = "in_body"
        elif t.kind == "start" and t.name in IN_HEAD and t.name != "noscript":
            self.open.append(self.head)
            self._head_element(t)
            if self.head in self.open:
                self.open.remove(self.head)
        elif t.kind == "end" and t.name == "template":
            self._end_template()
        elif t.kind == "start" and t.name in ("head", "html") or t.kind == "end" and t.name not in ("body", "html", "br"):
            return
        else:
            self._body()
            self._dispatch(t)

    def _reset(self) -> None:
        modes = {
            "select": "in_select", "tr": "in_row", "tbody": "in_body_of_table", "thead": "in_body_of_table", "tfoot": "in_body_of_table", "caption": "in_caption",
            "colgroup": "in_columns", "table": "in_table", "body": "in_body", "td": "in_cell", "th": "in_cell", "head": "in_head",
        }
        for x in reversed(self.open):
            if x.name == "template":
                self.mode = self.templates[-1] if self.templates else "in_body"
                return
            if x.name in modes:
                self.mode = modes[x.name]
                return
            if x.name == "html":
                self.mode = "before_head" if self.head is None else "after_head"
                return
        self.mode = "in_body"

    def _in_body(self, t: Token) -> None:  # noqa: C901
        name = t.name
        if t.kind == "start":
            if name in IN_HEAD and name != "noscript":
                self._head_element(t)
            elif name in ("html", "body", "head", "frameset", "frame", "caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return
            elif name in BLOCKS or name == "p" or name in HEADINGS:
                self.close_p() if name != "button" else None
                if name in HEADINGS and self.open[-1].name in HEADINGS:
                    self.open.pop()
                if name == "button":
                    if self.in_scope("button"):
                        self.imply()
                        self.pop_to("button")
                    self.reopen()
                self.insert(t)
                self.drop_newline = name in ("pre", "listing")
            elif name == "form":
                if self.form is not None and not self.templates:
                    return
                self.close_p()
                node = self.insert(t)
                self.form = self.form if self.templates else node
            elif name in ("li", "dd", "dt"):
                for x in reversed(self.open):
                    if x.name == name or name != "li" and x.name in ("dd", "dt"):
                        self.imply(x.name)
                        self.pop_to(x.name)
                        break
                    if x.name in SPECIAL and x.name not in ("address", "div", "p"):
                        break
                self.close_p()
                self.insert(t)
            elif name == "plaintext":
                self.close_p()
                self._raw(t)
            elif name == "a":
                if any(x.name == "a" for x in self._since_mark()):
                    old = next(x for x in reversed(self._since_mark()) if x.name == "a")
                    self.adopt("a")
                    if old in self.active:
                        self.active.remove(old)
                    if old in self.open:
                        self.open.remove(old)
                self.reopen()
                self.remember(self.insert(t))
            elif name in FORMATTING:
                self.reopen()
                if name == "nobr" and self.in_scope("nobr"):
                    self.adopt("nobr")
                    self.reopen()
                self.remember(self.insert(t))
            elif name in ("applet", "marquee", "object"):
                self.reopen()
                self.insert(t)
                self.active.append(None)
            elif name == "table":
                if not self.quirks:
                    self.close_p()
                self.insert(t)
                self.mode = "in_table"
            elif name in ("area", "br", "embed", "img", "keygen", "wbr", "input", "image"):
                self.reopen()
                self.insert(t, "img" if name == "image" else None, keep=False)
            elif name in ("param", "source", "track"):
                self.insert(t, keep=False)
            elif name == "hr":
                self.close_p()
                self.insert(t, keep=False)
            elif name == "textarea":
                self._raw(t)
            elif name in ("xmp", "iframe", "noembed", "noscript"):
                if name == "xmp":
                    self.close_p()
                    self.reopen()
                self._raw(t)
            elif name == "select":
                self.reopen()
                self.insert(t)
                self.mode = "in_select"
            elif name in ("optgroup", "option"):
                if self.open[-1].name == "option":
                    self.open.pop()
                self.reopen()
                self.insert(t)
            elif name in ("rb", "rtc", "rp", "rt"):
                if self.in_scope("ruby"):
                    self.imply("rtc" if name in ("rp", "rt") else "")
                self.insert(t)
            elif name in ("math", "svg"):
                self.reopen()
                self.insert(t, space=name, keep=not t.closed)
            else:
                self.reopen()
                self.insert(t)
            return
        if name == "template":
            self._end_template()
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
        elif name in BLOCKS or name in ("applet", "marquee", "object"):
            if self.in_scope(name):
                self.imply()
                self.pop_to(name)
                if name in ("applet", "marquee", "object"):
                    self.clear_marks()
        elif name == "form":
            node, self.form = self.form, None if not self.templates else self.form
            if node is not None and node in self.open and self.in_scope("form"):
                self.imply()
                self.open.remove(node)
        elif name == "p":
            if not self.in_scope("p", more=("button",)):
                self.insert(None, "p")
            self.close_p()
        elif name in ("li", "dd", "dt"):
            if self.in_scope(name, more=("ol", "ul") if name == "li" else ()):
                self.imply(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name == "br":
            self.reopen()
            self.insert(None, "br", keep=False)
        else:
            self._any_end(name)

    def _after_body(self, t: Token) -> None:
        if t.kind == "end" and t.name in ("html", "body"):
            return
        self.mode = "in_body"
        self._dispatch(t)

    def _in_table(self, t: Token) -> None:
        name = t.name
        if t.kind == "start" and name in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "td", "th", "tr"):
            self.back_to("table")
            if name == "caption":
                self.active.append(None)
                self.insert(t)
                self.mode = "in_caption"
            elif name in ("colgroup", "col"):
                self.insert(t if name == "colgroup" else None, "colgroup")
                self.mode = "in_columns"
                if name == "col":
                    self._dispatch(t)
            else:
                self.insert(t if name in ROWS else None, name if name in ROWS else "tbody")
                self.mode = "in_body_of_table"
                if name not in ROWS:
                    self._dispatch(t)
        elif t.kind == "start" and name == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self._reset()
                self._dispatch(t)
        elif t.kind == "end" and name == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self._reset()
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        elif t.kind == "start" and name in ("style", "script", "template"):
            self._head_element(t)
        elif t.kind == "end" and name == "template":
            self._end_template()
        elif t.kind == "start" and name == "input" and t.attrs.get("type", ("",))[0].lower() == "hidden":
            self.insert(t, keep=False)
        elif t.kind == "start" and name == "form":
            if self.form is None and not self.templates:
                self.form = self.insert(t, keep=False)
        else:
            self.foster = True
            self._in_body(t)
            self.foster = False

    def _in_caption(self, t: Token) -> None:
        cells = ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if t.kind == "end" and t.name in ("caption", "table") or t.kind == "start" and t.name in cells:
            if self.in_table_scope("caption"):
                self.imply()
                self.pop_to("caption")
                self.clear_marks()
                self.mode = "in_table"
                if (t.kind, t.name) != ("end", "caption"):
                    self._dispatch(t)
        elif t.kind == "end" and t.name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return
        else:
            self._in_body(t)

    def _in_columns(self, t: Token) -> None:
        if t.kind == "start" and t.name == "col":
            self.insert(t, keep=False)
        elif t.kind == "end" and t.name == "col":
            return
        elif t.name == "template":
            self._head_element(t) if t.kind == "start" else self._end_template()
        elif self.open[-1].name == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            if (t.kind, t.name) != ("end", "colgroup"):
                self._dispatch(t)

    def _in_body_of_table(self, t: Token) -> None:
        name = t.name
        if t.kind == "start" and name in ("tr", "td", "th"):
            self.back_to(*ROWS)
            self.insert(t if name == "tr" else None, "tr")
            self.mode = "in_row"
            if name != "tr":
                self._dispatch(t)
        elif t.kind == "end" and name in ROWS:
            if self.in_table_scope(name):
                self.back_to(*ROWS)
                self.open.pop()
                self.mode = "in_table"
        elif t.kind == "start" and name in ("caption", "col", "colgroup", *ROWS) or t.kind == "end" and name == "table":
            if self.in_table_scope(*ROWS):
                self.back_to(*ROWS)
                self.open.pop()
                self.mode = "in_table"
                self._dispatch(t)
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return
        else:
            self._in_table(t)

    def _in_row(self, t: Token) -> None:
        name = t.name
        if t.kind == "start" and name in ("td", "th"):
            self.back_to("tr")
            self.insert(t)
            self.mode = "in_cell"
            self.active.append(None)
        elif t.kind == "end" and name == "tr" or t.kind == "start" and name in ("caption", "col", "colgroup", "tr", *ROWS) or t.kind == "end" and name in ("table", *ROWS):
            if self.in_table_scope("tr") and (name not in ROWS or t.kind == "start" or self.in_table_scope(name)):
                self.back_to("tr")
                self.open.pop()
                self.mode = "in_body_of_table"
                if (t.kind, name) != ("end", "tr"):
                    self._dispatch(t)
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return
        else:
            self._in_table(t)

    def _end_cell(self) -> None:
        self.imply()
        self.pop_to("td", "th")
        self.clear_marks()
        self.mode = "in_row"

    def _in_cell(self, t: Token) -> None:
        name = t.name
        if t.kind == "end" and name in ("td", "th"):
            if self.in_table_scope(name):
                self.imply()
                self.pop_to(name)
                self.clear_marks()
                self.mode = "in_row"
        elif t.kind == "start" and name in ("caption", "col", "colgroup", "td", "th", "tr", *ROWS):
            if self.in_table_scope("td", "th"):
                self._end_cell()
                self._dispatch(t)
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return
        elif t.kind == "end" and name in ("table", "tr", *ROWS):
            if self.in_table_scope(name):
                self._end_cell()
                self._dispatch(t)
        else:
            self._in_body(t)

    def _in_select(self, t: Token) -> None:
        name = t.name
        if t.kind == "start" and name in ("option", "optgroup", "hr"):
            if self.open[-1].name == "option":
                self.open.pop()
            if name != "option" and self.open[-1].name == "optgroup":
                self.open.pop()
            self.insert(t, keep=name != "hr")
        elif t.kind == "end" and name == "optgroup":
            if self.open[-1].name == "option" and len(self.open) > 1 and self.open[-2].name == "optgroup":
                self.open.pop()
            if self.open[-1].name == "optgroup":
                self.open.pop()
        elif t.kind == "end" and name == "option":
            if self.open[-1].name == "option":
                self.open.pop()
        elif name == "select" or t.kind == "start" and name in ("input", "keygen", "textarea"):
            self.pop_to("select")
            self._reset()
            if name != "select":
                self._dispatch(t)
        elif name in ("caption", "table", *ROWS, "tr", "td", "th"):
            if t.kind == "start" and any(x.name == "table" for x in self.open) or t.kind == "end" and self.in_table_scope(name):
                self.pop_to("select")
                self._reset()
                self._dispatch(t)
        elif t.kind == "start" and name in ("script", "template"):
            self._head_element(t)
        elif t.kind == "end" and name == "template":
            self._end_template()

    def _in_template(self, t: Token) -> None:
        if t.kind == "start" and t.name in IN_HEAD:
            self._head_element(t)
        elif t.kind == "end":
            if t.name == "template":
                self._end_template()
        else:
            mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_columns", "tr": "in_body_of_table", "td": "in_row", "th": "in_row"}.get(t.name, "in_body")
            self.templates[-1] = self.mode = mode
            self._dispatch(t)


def walk(node: Element) -> Iterator[Element | Text]:
    """All nodes below one, in the order of the tree; an element comes again, as a pair with None, when it ends."""
    todo: list = list(reversed(node.children))
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Element):
            todo.append((x, None))
            todo += reversed(x.children)
