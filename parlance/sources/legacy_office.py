"""RTF and DOC, read as their formats say: a stack of groups, and the pieces of text in a compound file."""

from __future__ import annotations

import bisect
import codecs
import re
import struct
from dataclasses import dataclass

from .markdown import Unreadable, Writer

# RTF

#: Fixed values of the format: code pages of fonts' character sets; control words for characters; groups that hold no body text.
CHARSETS = {0: 1252, 77: 10000, 128: 932, 129: 949, 130: 1361, 134: 936, 136: 950, 161: 1253, 162: 1254, 163: 1258, 177: 1255, 178: 1256, 186: 1257, 204: 1251, 222: 874, 238: 1250}
CHARACTERS = {
    "tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "bullet": "•", "lquote": "‘", "rquote": "’",
    "ldblquote": "“", "rdblquote": "”", "~": "\u00a0", "_": "‑", "-": "", "zwj": "‍", "zwnj": "‌",
}
ELSEWHERE = frozenset(
    "colortbl info pict object header headerl headerr headerf footer footerl footerr footerf footnote annotation fldinst listtable listoverridetable pntext listtext"
    " revtbl rsidtbl generator themedata colorschememapping latentstyles datastore xmlnstbl filetbl nonshppict bkmkstart bkmkend atnid atnauthor".split()
)
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)", re.S)
#: The codec of a code page, by its number; Latin text where there is none.
_PAGES: dict[int, str] = {}


def code_page(number: int) -> str:
    if number not in _PAGES:
        name = {65001: "utf-8", 10000: "mac-roman", 1361: "johab"}.get(number, f"cp{number}")
        try:
            codecs.lookup(name)
        except LookupError:
            name = "cp1252"
        _PAGES[number] = name
    return _PAGES[number]


class _Group:
    """What a group inherits and may change."""

    def __init__(self, above: _Group | None = None):
        self.page = above.page if above else 0
        self.after_unicode = above.after_unicode if above else 1
        self.hidden = above.hidden if above else False
        self.role = above.role if above else ""
        self.optional = False


class _Rtf:
    def __init__(self, out: Writer):
        self.out, self.stack = out, [_Group()]
        self.ansi = 1252
        self.fonts: dict[int, int] = {}
        self.headings: dict[int, int] = {}
        self.font = self.style = 0
        self.name = bytearray()
        self.held = bytearray()
        self.skip = 0
        self.surrogate = 0
        self.table = False
        self.fresh()

    def fresh(self) -> None:
        """A paragraph's properties as \\pard leaves them."""
        self.table, self.level, self.item, self.depth = False, 0, False, 0

    def flush(self) -> None:
        """Bytes in a code page, which may be of several to a character, once they end."""
        if self.held:
            if not self.stack[-1].hidden:
                self.out.text(bytes(self.held).decode(code_page(self.stack[-1].page or self.ansi), "replace"))
            self.held.clear()

    def say(self, text: str) -> None:
        self.flush()
        if not self.stack[-1].hidden:
            self.out.text(text)

    def paragraph(self) -> None:
        self.flush()
        if self.stack[-1].hidden:
            return
        # a paragraph's kind is known when it ends
        self.out.level, self.out.item = self.level, self.depth if self.item else None
        self.out.end()

    def raw(self, data: bytes) -> None:
        if self.skip:
            n = min(self.skip, len(data))
            self.skip, data = self.skip - n, data[n:]
        if not data:
            return
        if self.stack[-1].role == "stylesheet":
            self.name += data
        else:
            self.held += data

    def word(self, word: str, number: int | None) -> None:
        g = self.stack[-1]
        if word != "u":
            self.flush()
        if word == "ansicpg":
            self.ansi = number or 1252
        elif word == "uc":
            g.after_unicode = number or 0
        elif word == "u":
            self.unicode((number or 0) & 0xFFFF)
        elif word in ("fonttbl", "stylesheet"):
            g.role, g.hidden = word, True
        elif word in ELSEWHERE:
            g.hidden, g.role = True, "elsewhere"
        elif word == "fldrslt" and g.optional:
            g.hidden = False
        elif g.role == "fonttbl":
            if word == "f":
                self.font = number or 0
            elif word == "fcharset":
                self.fonts[self.font] = CHARSETS.get(number or 0, 0)
        elif g.role == "stylesheet":
            if word == "s":
                self.style = number or 0
            elif word == "outlinelevel" and (number or 0) < 9:
                self.headings[self.style] = (number or 0) + 1
        elif word == "f":
            g.page = self.fonts.get(number or 0, 0)
        elif word == "plain":
            g.page = 0
        elif word == "v":
            g.hidden = number != 0
        elif word == "par" or word in ("sect", "page"):
            if self.table:
                self.say(" ")
            else:
                self.paragraph()
        elif word == "pard":
            self.fresh()
        elif word == "intbl":
            self.table = True
        elif word == "cell":
            self.out.take_cell()
        elif word == "row":
            self.out.end_row()
        elif word == "s":
            self.level = self.headings.get(number or 0, 0)
        elif word == "outlinelevel" and (number or 0) < 9:
            self.level = (number or 0) + 1
        elif word == "ls":
            self.item = bool(number)
        elif word == "ilvl":
            self.depth = number or 0
        elif word in CHARACTERS:
            self.say(CHARACTERS[word])

    def unicode(self, unit: int) -> None:
        if self.held:
            self.flush()
        if 0xD800 <= unit < 0xDC00:
            self.surrogate = unit
        elif 0xDC00 <= unit < 0xE000:
            if self.surrogate:
                self.say(chr(0x10000 + ((self.surrogate - 0xD800) << 10) + unit - 0xDC00))
            self.surrogate = 0
        else:
            self.say(chr(unit))
        self.skip = self.stack[-1].after_unicode

    def leave(self) -> None:
        self.flush()
        if len(self.stack) > 1:
            g = self.stack.pop()
            if g.role == "stylesheet":
                found = re.match(rb"\s*heading (\d)", bytes(self.name), re.I)
                if found and 1 <= int(found[1]) <= 9:
                    self.headings[self.style] = int(found[1])
                elif re.match(rb"\s*title;", bytes(self.name), re.I):
                    self.headings[self.style] = 1
                self.name.clear()


def read_rtf(content: bytes, out: Writer) -> None:
    """Headings by style or outline level, items of lists, tables, text in any code page or as \\u units."""
    if not content.lstrip()[:5].startswith(b"{\\rtf"):
        raise Unreadable("not an RTF document")
    doc, at = _Rtf(out), 0
    while at < len(content):
        m = _TOKEN.match(content, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, number, byte, sign, brace, text = m.groups()
        if brace == b"{":
            doc.flush()
            doc.skip = 0
            doc.stack.append(_Group(doc.stack[-1]))
        elif brace:
            doc.skip = 0
            doc.leave()
        elif text is not None:
            doc.raw(text)
        elif byte is not None:
            doc.raw(bytes([int(byte, 16)]))
        elif word is not None:
            if word == b"bin":
                at += max(0, int(number or 0))
            elif doc.skip and word != b"u":
                doc.skip -= 1
            else:
                doc.word(word.decode(), None if number is None else int(number))
        elif sign == b"*":
            g = doc.stack[-1]
            g.optional = g.hidden = True
        elif sign in b"{}\\":
            doc.raw(sign)
        elif sign in (b"\n", b"\r"):
            doc.word("par", None)
        elif sign.decode("latin-1") in CHARACTERS:
            doc.say(CHARACTERS[sign.decode("latin-1")])
    doc.flush()
    doc.paragraph()


# DOC

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: Fixed values of the format: text of single bytes is in code page 1252.
SINGLE = "cp1252"


class Compound:
    """A compound file: chains of sectors, and of small sectors for small streams."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Unreadable("not a compound file")
        self.data = data
        self.size, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        if not 128 <= self.size <= 1 << 16:
            raise Unreadable("damaged: size of sectors")
        first_dir, self.cutoff, first_small, more, n_more = struct.unpack_from("<I4xIIxxxxII", data, 48)
        fat_at = list(struct.unpack_from("<109I", data, 76))
        while more not in (FREE, END) and n_more:
            block = struct.unpack_from(f"<{self.size // 4}I", data, self._offset(more))
            fat_at += block[:-1]
            more, n_more = block[-1], n_more - 1
        self.next: list[int] = []
        for sector in fat_at:
            if sector not in (FREE, END):
                self.next += struct.unpack_from(f"<{self.size // 4}I", data, self._offset(sector))
        self.small_next = self._numbers(self._chain(first_small))
        self.streams: dict[str, tuple[int, int]] = {}
        entries = self._chain(first_dir)
        for at in range(0, len(entries) - 127, 128):
            length = struct.unpack_from("<H", entries, at + 64)[0]
            name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", entries, at + 116)
            if entries[at + 66] == 5:
                self.pool = self._chain(start)
            elif entries[at + 66] == 2:
                self.streams.setdefault(name, (start, size & 0xFFFFFFFF))

    def _offset(self, sector: int) -> int:
        return (sector + 1) * self.size

    @staticmethod
    def _numbers(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def _chain(self, sector: int) -> bytes:
        out, seen = [], set()
        while sector < len(self.next) and sector not in seen:
            seen.add(sector)
            out.append(self.data[self._offset(sector) : self._offset(sector + 1)])
            sector = self.next[sector]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.streams:
            raise Unreadable(f"damaged: no stream {name}")
        start, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < len(self.small_next) and start not in seen:
            seen.add(start)
            out.append(self.pool[start * self.small : (start + 1) * self.small])
            start = self.small_next[start]
        return b"".join(out)[:size]


def _pieces(table: bytes, at: int, size: int) -> list[tuple[int, int, int, bool]]:
    """(first character, character after the last, place in the file, whether of single bytes) of every piece of text."""
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise Unreadable("damaged: no table of pieces")
    body = clx[i + 5 : i + 5 + struct.unpack_from("<I", clx, i + 1)[0]]
    n = (len(body) - 4) // 12
    borders = struct.unpack_from(f"<{n + 1}I", body, 0)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", body, 4 * (n + 1) + 8 * k + 2)[0]
        single = bool(fc & 0x40000000)
        out.append((borders[k], borders[k + 1], (fc & 0x3FFFFFFF) // (2 if single else 1), single))
    return out


#: Fixed values of the format: bytes of a property's operand by the kind in its code; codes of a row's end, of being in a table,
#: of a list, and of the depth in it.
OPERANDS = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}
ROW_END, IN_TABLE, LIST, DEPTH = 0x2417, 0x2416, 0x460B, 0x260A


def _properties(raw: bytes) -> dict[int, int]:
    """Codes of a paragraph's own properties, with the first byte of their operands."""
    out, i = {}, 0
    while i + 2 < len(raw):
        code = struct.unpack_from("<H", raw, i)[0]
        size = OPERANDS.get(code >> 13)
        if size is None:
            size = 1 + (struct.unpack_from("<H", raw, i + 2)[0] if code == 0xD608 and i + 4 <= len(raw) else raw[i + 2])
        out[code] = raw[i + 2]
        i += 2 + size
    return out


@dataclass
class Paragraphs:
    """Places where paragraphs begin and end in the file, in order, with their styles and own properties."""

    begins: list[int]
    ends: list[int]
    styles: list[int]
    own: list[dict[int, int]]

    @classmethod
    def read(cls, main: bytes, table: bytes) -> Paragraphs:
        """From the pages of the file that list them."""
        at, size = struct.unpack_from("<II", main, 0x102)
        bins, found = table[at : at + size], []
        n = max(0, (len(bins) - 4) // 8)
        for k in range(n):
            page = struct.unpack_from("<I", bins, 4 * (n + 1) + 4 * k)[0] & 0x3FFFFF
            fkp = main[page * 512 : page * 512 + 512]
            if len(fkp) < 512:
                continue
            runs = fkp[511]
            borders = struct.unpack_from(f"<{runs + 1}I", fkp, 0)
            for r in range(runs):
                p = 2 * fkp[4 * (runs + 1) + 13 * r]
                style, own = 0, {}
                if 0 < p < 508:
                    # a length in words that counts itself, or a zero and then the true one
                    p, size = (p + 1, 2 * fkp[p] - 1) if fkp[p] else (p + 2, 2 * fkp[p + 1])
                    style, own = struct.unpack_from("<H", fkp, p)[0], _properties(fkp[p + 2 : p + size])
                found.append((borders[r], borders[r + 1], style, own))
        found.sort(key=lambda x: x[:2])
        return cls(*([list(x) for x in zip(*found, strict=True)] or [[], [], [], []]))

    def at(self, place: int) -> tuple[int, dict[int, int]]:
        i = bisect.bisect_right(self.begins, place) - 1
        return (self.styles[i], self.own[i]) if i >= 0 and place < self.ends[i] else (0, {})


def read_doc(content: bytes, out: Writer) -> None:
    """The main text: paragraphs, headings by their built-in styles, tables; fields show their results."""
    file = Compound(content)
    main = file.stream("WordDocument")
    if len(main) < 0x1AA or struct.unpack_from("<H", main, 0)[0] != 0xA5EC:
        raise Unreadable("not a Word document")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x0100:
        raise Unreadable("encrypted")
    table = file.stream("1Table" if flags & 0x0200 else "0Table")
    count = struct.unpack_from("<I", main, 0x4C)[0]
    paragraphs = Paragraphs.read(main, table)
    field: list[bool] = []  # open fields: whether their result has begun
    for first, last, at, single in _pieces(table, *struct.unpack_from("<II", main, 0x1A2)):
        last = min(last, count)
        if last <= first:
            continue
        width = 1 if single else 2
        # a character of two units keeps its place: units are decoded one by one, and joined when they are words
        for i in range(last - first):
            place = at + i * width
            unit = main[place] if single else struct.unpack_from("<H", main, place)[0]
            if unit == 0x13:
                field.append(False)
            elif unit == 0x14 and field:
                field[-1] = True
            elif unit == 0x15 and field:
                field.pop()
            elif not all(field):
                continue
            elif unit in (0x0D, 0x0C):
                style, own = paragraphs.at(place)
                if own.get(IN_TABLE):
                    out.text(" ")
                else:
                    out.level = style if 1 <= style <= 9 else 0
                    out.item = own.get(DEPTH, 0) if own.get(LIST) else None
                    out.end()
            elif unit == 0x07:
                if paragraphs.at(place)[1].get(ROW_END):
                    out.end_row()
                else:
                    out.take_cell()
            elif unit == 0x0B:
                out.text("\n")
            elif unit == 0x1E:
                out.text("‑")
            elif unit >= 0x20 or unit == 0x09:
                out.text(bytes([unit]).decode(SINGLE, "replace") if single else chr(unit))
