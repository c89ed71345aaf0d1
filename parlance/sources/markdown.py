"""Markdown put together block by block, whatever format the blocks come from."""

from __future__ import annotations


class Unreadable(Exception):
    """A document that is not of its kind, or is locked."""


class Writer:
    """Blocks parted by blank lines. Items of one list, and rows of one table, follow one another; a table's first row is its head."""

    def __init__(self):
        self.out: list[str] = []
        self.before: object = None
        self.words: list[str] = []
        self.level, self.item = 0, None
        self.cells: list[str] | None = None
        self.open_cell = False

    def text(self, s: str) -> None:
        self.words.append(s)

    def start(self, level: int = 0, item: int | None = None) -> None:
        """Begins a heading, an item at a depth, or a paragraph; in a table's cell all are words."""
        self.end()
        self.level, self.item = min(6, level), item

    def block(self) -> None:
        """Begins a paragraph inside what is open: an item that has no words yet stays one."""
        if self.cells is not None or self.item is None or "".join(self.words).strip():
            self.end()

    def end(self) -> None:
        if self.cells is not None:
            self.words.append(" ")
            return
        text = "".join(self.words).strip()
        self.words = []
        if text:
            if self.level:
                self._put("h", f"{'#' * min(6, self.level)} {' '.join(text.split())}")
            elif self.item is not None:
                self._put("li", f"{'  ' * self.item}- {' '.join(text.split())}")
            else:
                self._put("p", "\n".join(line.strip(" \t") for line in text.split("\n")))
            self.item = None
        self.level = 0

    def row(self) -> None:
        if self.cells is not None:
            self.end_row()
        self.end()
        self.cells, self.open_cell = [], False

    def cell(self) -> None:
        if self.cells is None:
            self.row()
        self._close_cell()
        self.open_cell = True

    def _close_cell(self) -> None:
        if self.open_cell:
            self.cells.append(" ".join("".join(self.words).split()).replace("|", "\\|"))
        self.words, self.open_cell = [], False

    def take_cell(self) -> None:
        """The words so far are a cell, the first of a row if none is open."""
        words, self.words = self.words, []
        if self.cells is None:
            self.row()
        self.words, self.open_cell = words, True
        self._close_cell()

    def end_row(self) -> None:
        if self.cells is None:
            return
        self._close_cell()
        cells, self.cells = self.cells, None
        self.level, self.item = 0, None
        if cells:
            line = f"| {' | '.join(cells)} |"
            self._put("row", line if self.before == "row" else f"{line}\n|{'---|' * len(cells)}")

    def _put(self, kind: str, lines: str) -> None:
        if self.out:
            self.out.append("\n" if kind == self.before and kind in ("row", "li") else "\n\n")
        self.out.append(lines)
        self.before = kind

    def markdown(self) -> str:
        self.end_row()
        self.end()
        # halves of one character, as some formats give them, meet here
        text = "".join(self.out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        return text + ("\n" if text else "")
