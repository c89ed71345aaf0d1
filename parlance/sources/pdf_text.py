"""Text of a PDF page: its operators are followed, codes become characters by the fonts' maps, and places make lines and gaps."""

from __future__ import annotations

import re
import unicodedata

from .pdf_objects import Lexer, Name, Pdf, Stream, Word

#: Names of characters that are not their own name, and of the accents that follow letters' names.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ",
    "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "degree": "°", "copyright": "©",
    "registered": "®", "trademark": "™", "section": "§", "paragraph": "¶", "dagger": "†", "daggerdbl": "‡", "Euro": "€", "sterling": "£", "cent": "¢", "yen": "¥", "currency": "¤", "mu": "µ",
    "multiply": "×", "divide": "÷", "plusminus": "±", "exclamdown": "¡", "questiondown": "¿", "periodcentered": "·", "nbspace": " ", "sfthyphen": "-", "fraction": "⁄", "ordfeminine": "ª", "ordmasculine": "º",
}
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊",
    "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̦",
}
#: Where the built-in encoding of old fonts differs from ASCII.
STANDARD = {39: "’", 96: "‘", 161: "¡", 162: "¢", 163: "£", 164: "⁄", 165: "¥", 167: "§", 169: "'", 170: "“", 171: "«", 172: "‹", 173: "›", 174: "fi", 175: "fl", 177: "–", 180: "·", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 191: "¿", 208: "—", 225: "Æ", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß"}
#: Shares of a font's size: a gap that parts words, and a step that begins a line.
GAP, STEP = 0.2, 0.5


def glyph(name: str) -> str:
    """The characters that a glyph's name stands for; none if it says nothing."""
    name = name.partition(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000)
    accent = next((a for a in ACCENTS if name[1:] == a), None)
    return unicodedata.normalize("NFC", name[0] + ACCENTS[accent]) if accent else ""


class Font:
    """Codes of a string, their characters and widths (in thousandths)."""

    def __init__(self, pdf: Pdf, spec: dict):
        get = pdf.get
        self.wide = get(spec.get("Subtype")) == "Type0"
        self.map: dict[bytes, str] = {}
        self.lengths = {2} if self.wide else {1}
        if isinstance(cmap := get(spec.get("ToUnicode")), Stream):
            self._read_map(pdf.decoded(cmap) or b"")
        self.widths: dict[int, float] = {}
        if self.wide:
            below = get((get(spec.get("DescendantFonts")) or [None])[0])
            below = below if isinstance(below, dict) else {}
            self.other = get(below.get("DW", 1000)) or 1000
            self._read_widths([get(x) for x in get(below.get("W")) or []], get)
            self.plain: dict[int, str] = {}
        else:
            first, listed = get(spec.get("FirstChar")) or 0, get(spec.get("Widths"))
            about = get(spec.get("FontDescriptor"))
            base = str(get(spec.get("BaseFont")) or "")
            self.other = (get(about.get("MissingWidth")) if isinstance(about, dict) else None) or (600 if "Courier" in base else 500)
            if isinstance(listed, list):
                self.widths = {first + i: w for i, x in enumerate(listed) if isinstance(w := get(x), (int, float))}
            self.plain = self._encoding(pdf, spec, about, base)
        self.sizes = sorted(self.lengths)
        self.known: dict[bytes, tuple[str, float, bool]] = {}

    def _encoding(self, pdf: Pdf, spec: dict, about: object, base: str) -> dict[int, str]:
        encoding = pdf.get(spec.get("Encoding"))
        name = encoding if isinstance(encoding, Name) else pdf.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
        codec = {"MacRomanEncoding": "mac-roman", "WinAnsiEncoding": "cp1252"}.get(name)
        out = {c: bytes([c]).decode(codec or "cp1252", "ignore") for c in range(32, 256)}
        if codec is None:
            out |= STANDARD
        if isinstance(encoding, dict):
            code = 0
            for x in pdf.get(encoding.get("Differences")) or []:
                x = pdf.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    out[code] = glyph(x)
                    code += 1
        return out

    def _read_widths(self, listed: list, get) -> None:
        i = 0
        while i + 1 < len(listed):
            first, second = listed[i], listed[i + 1]
            if isinstance(second, list):
                self.widths |= {first + k: get(w) for k, w in enumerate(second)}
                i += 2
            else:
                if i + 2 < len(listed) and isinstance(first, int) and isinstance(second, int):
                    self.widths |= dict.fromkeys(range(first, min(second, first + 65535) + 1), listed[i + 2])
                i += 3

    def _read_map(self, data: bytes) -> None:
        lexer, held = Lexer(data, refs=False), []
        said = lambda b: b.decode("utf-16-be", "ignore")
        while (x := lexer.next()) is not Lexer.END:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "endcodespacerange":
                self.lengths = {len(b) for b in held if isinstance(b, bytes) and b} or self.lengths
            elif x == "endbfchar":
                self.map |= {a: said(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif x == "endbfrange":
                for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    lo, n = int.from_bytes(a, "big"), min(int.from_bytes(b, "big") - int.from_bytes(a, "big"), 65535)
                    for k in range(n + 1):
                        if isinstance(to, list):
                            target = to[k] if k < len(to) and isinstance(to[k], bytes) else None
                        else:
                            target = to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big") if isinstance(to, bytes) and len(to) > 1 else None
                        if target is not None:
                            self.map[(lo + k).to_bytes(len(a), "big")] = said(target)
            held = []

    def codes(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(characters, width, whether a single space) of every code of a string."""
        sizes, known = self.sizes, self.known
        if len(sizes) == 1:
            size = sizes[0]
            return [known.get(code) or self._code(code, size) for code in (raw[i : i + size] for i in range(0, len(raw), size))]
        out, i = [], 0
        while i < len(raw):
            size = next((n for n in sizes if raw[i : i + n] in self.map), sizes[-1])
            code = raw[i : i + size]
            # one that the string's end cuts is no code of its size
            out.append((known.get(code) if len(code) == size else None) or self._code(code, size))
            i += size
        return out

    def _code(self, code: bytes, size: int) -> tuple[str, float, bool]:
        number = int.from_bytes(code, "big")
        text = self.map.get(code)
        found = (self.plain.get(number, "") if text is None else text, self.widths.get(number, self.other), size == 1 and number == 32)
        if len(code) == size:
            self.known[code] = found
        return found


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """Follows a page's operators and collects its text."""

    def __init__(self, pdf: Pdf, fonts: dict[int, Font]):
        self.pdf, self.fonts = pdf, fonts
        self.out: list[str] = []
        self.end: tuple[float, float] | None = None  # where the last text ended
        self.size = 1.0

    def text(self, page: dict) -> str:
        held = self.pdf.get(page.get("Contents"))
        parts = [self.pdf.get(x) for x in held] if isinstance(held, list) else [held]
        data = b"\n".join(self.pdf.decoded(x) or b"" for x in parts if isinstance(x, Stream))
        self.run(data, self.pdf.get(page.get("Resources")) or {}, _SAME, 0)
        # fixed values: how blanks and lines are squeezed
        joined = re.sub(r"[ \t]+\n", "\n", "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", joined)).strip()

    def font(self, resources: dict, name: str) -> Font | None:
        fonts = self.pdf.get(resources.get("Font"))
        spec = self.pdf.get(fonts.get(name)) if isinstance(fonts, dict) else None
        if not isinstance(spec, dict):
            return None
        if id(spec) not in self.fonts:
            self.fonts[id(spec)] = Font(self.pdf, spec)
        return self.fonts[id(spec)]

    def show(self, state: dict, raw: bytes) -> None:
        font = state["font"]
        if font is None:
            return
        size, scale, rise, char, word = (state[k] for k in ("size", "scale", "rise", "char", "word"))
        ta, tb, tc, td, te, tf = state["tm"]
        ca, cb, cc, cd, ce, cf = state["ctm"]
        # along a string only the place changes
        a, b, c, d, *_ = _times(state["tm"], state["ctm"])
        height = max(1e-6, ((size * c) ** 2 + (size * d) ** 2) ** 0.5)
        along = ((size * scale * a) ** 2 + (size * scale * b) ** 2) ** 0.5 or 1e-6
        ux, uy = size * scale * a / along, size * scale * b / along
        # where every code has characters, each begins at the end of the one before: only the first can stand apart
        codes = font.codes(raw)
        close, first = rise == 0 and all(text for text, _, _ in codes), True
        for text, width, space in codes:
            if text and self.end is not None and (first or not close):
                dx, dy = rise * c + (te * ca + tf * cc + ce) - self.end[0], rise * d + (te * cb + tf * cd + cf) - self.end[1]
                ahead, aside = dx * ux + dy * uy, abs(dy * ux - dx * uy)
                if aside > STEP * min(height, self.size) or ahead < -2 * height:
                    self.out.append("\n")
                elif ahead > GAP * height or ahead < -GAP * height:
                    self.out.append(" ")
            first = False
            if text:
                self.out.append(text)
            advance = (width / 1000 * size + char + (word if space else 0)) * scale
            te, tf = advance * ta + te, advance * tb + tf
            if text and not close:
                self.end, self.size = (te * ca + tf * cc + ce, te * cb + tf * cd + cf), height
        state["tm"] = ta, tb, tc, td, te, tf
        if close and codes:
            self.end, self.size = (te * ca + tf * cc + ce, te * cb + tf * cd + cf), height

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int) -> None:
        state = {"ctm": ctm, "tm": _SAME, "line": _SAME, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        saved: list[dict] = []
        lexer, held = Lexer(data, refs=False), []

        def move(x: float, y: float) -> None:
            state["line"] = state["tm"] = _times((1, 0, 0, 1, x, y), state["line"])

        while (x := lexer.next()) is not Lexer.END:
            if not isinstance(x, Word):
                held.append(x)
                if len(held) > 64:
                    del held[:-32]
                continue
            numbers = [n for n in held if isinstance(n, (int, float)) and not isinstance(n, bool)]
            last = numbers[-1] if numbers else 0
            if x == "q":
                saved.append(dict(state))
            elif x == "Q" and saved:
                state.update(saved.pop())
            elif x == "cm" and len(numbers) >= 6:
                state["ctm"] = _times(tuple(numbers[-6:]), state["ctm"])
            elif x == "BT":
                state["tm"] = state["line"] = _SAME
            elif x == "Tf":
                name = next((n for n in held if isinstance(n, Name)), None)
                state["font"], state["size"] = self.font(resources, name) if name else None, last
            elif x in ("Tc", "Tw", "TL", "Ts"):
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[x]] = last
            elif x == "Tz":
                state["scale"] = last / 100
            elif x in ("Td", "TD") and len(numbers) >= 2:
                if x == "TD":
                    state["lead"] = -numbers[-1]
                move(*numbers[-2:])
            elif x == "Tm" and len(numbers) >= 6:
                state["tm"] = state["line"] = tuple(map(float, numbers[-6:]))
            elif x == "T*":
                move(0, -state["lead"])
            elif x in ("Tj", "'", '"'):
                if x == '"' and len(numbers) >= 2:
                    state["word"], state["char"] = numbers[-2:]
                if x != "Tj":
                    move(0, -state["lead"])
                if held and isinstance(held[-1], bytes):
                    self.show(state, held[-1])
            elif x == "TJ" and held and isinstance(held[-1], list):
                for part in held[-1]:
                    if isinstance(part, bytes):
                        self.show(state, part)
                    elif isinstance(part, (int, float)):
                        state["tm"] = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), state["tm"])
            elif x == "Do" and held and isinstance(held[-1], Name):
                self._form(resources, held[-1], state["ctm"], depth)
            elif x == "ID":  # the bytes of an image inside the operators
                m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)").search(data, lexer.at)
                lexer.at = m.end() if m else len(data)
            held = []

    def _form(self, resources: dict, name: str, ctm: tuple, depth: int) -> None:
        objects = self.pdf.get(resources.get("XObject"))
        form = self.pdf.get(objects.get(name)) if isinstance(objects, dict) else None
        if depth < 12 and isinstance(form, Stream) and self.pdf.get(form.head.get("Subtype")) == "Form":
            matrix = [self.pdf.get(v) for v in self.pdf.get(form.head.get("Matrix")) or _SAME]
            own = self.pdf.get(form.head.get("Resources"))
            self.run(self.pdf.decoded(form) or b"", own if isinstance(own, dict) else resources, _times(tuple(matrix), ctm), depth + 1)
