"""Cell and range addresses: A1 and R1C1, absolute marks, sheet prefixes. Rows and columns count from 0."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import ParseError


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        if not "A" <= c <= "Z":
            raise ParseError(f"{letters!r} is no column")
        n = n * 26 + ord(c) - 64
    if not n:
        raise ParseError("an empty column")
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass(frozen=True)
class Cell:
    """One reference. A fixed part has ``$`` (or is absolute in R1C1); ``relative`` parts of R1C1 are offsets until placed."""

    row: int
    col: int
    fixed_row: bool = False
    fixed_col: bool = False
    sheet: str | None = None
    offset_row: bool = False
    offset_col: bool = False

    def text(self) -> str:
        prefix = quote_sheet(self.sheet) + "!" if self.sheet else ""
        return f"{prefix}{'$' * self.fixed_col}{column_letters(self.col)}{'$' * self.fixed_row}{self.row + 1}"

    def moved(self, rows: int, cols: int) -> Cell:
        """As it reads after being copied so far; raises if that leaves the sheet."""
        out = replace(self, row=self.row if self.fixed_row else self.row + rows, col=self.col if self.fixed_col else self.col + cols)
        if out.row < 0 or out.col < 0:
            raise ParseError("the reference leaves the sheet")
        return out

    def at(self, row: int, col: int) -> Cell:
        """R1C1 offsets resolved for a formula in that cell."""
        out = replace(self, row=self.row + row if self.offset_row else self.row, col=self.col + col if self.offset_col else self.col, offset_row=False, offset_col=False)
        if out.row < 0 or out.col < 0:
            raise ParseError("the reference leaves the sheet")
        return out


@dataclass(frozen=True)
class Range:
    first: Cell
    last: Cell

    def box(self) -> tuple[int, int, int, int]:
        """top, left, bottom, right; corners in any order."""
        a, b = self.first, self.last
        return min(a.row, b.row), min(a.col, b.col), max(a.row, b.row), max(a.col, b.col)

    def text(self) -> str:
        return f"{self.first.text()}:{replace(self.last, sheet=None).text()}"


_A1 = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*)$")
_RC = re.compile(r"[Rr](?:\[(-?\d+)\]|(\d+))?[Cc](?:\[(-?\d+)\]|(\d+))?$")
_SHEET = re.compile(r"(?:'((?:[^']|'')+)'|([A-Za-z_][\w.]*))!(.+)$")


def quote_sheet(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][\w.]*", name) else "'" + name.replace("'", "''") + "'"


def parse_cell(text: str, sheet: str | None = None) -> Cell:
    if m := _SHEET.match(text):
        return parse_cell(m[3], (m[1] or "").replace("''", "'") or m[2])
    if m := _A1.match(text):
        return Cell(int(m[4]) - 1, column_number(m[2]), bool(m[3]), bool(m[1]), sheet)
    if m := _RC.match(text):
        r, c = (int(m[1]) if m[1] else int(m[2]) - 1 if m[2] else 0), (int(m[3]) if m[3] else int(m[4]) - 1 if m[4] else 0)
        return Cell(r, c, bool(m[2]), bool(m[4]), sheet, not m[2], not m[4])
    raise ParseError(f"{text!r} is no cell")


def parse_range(text: str) -> Range:
    first, _, last = text.partition(":")
    a = parse_cell(first)
    return Range(a, parse_cell(last, a.sheet) if last else a)


def fill(template: str, values: dict[str, object]) -> str:
    """``{key}`` in the template replaced; unknown keys stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), template)
