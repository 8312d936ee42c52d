"""Tables inside texts: HTML, Markdown and compact tabular text. Pure functions, and the same over a column."""

from __future__ import annotations

import csv
import io
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError

Rows = list[list[str | None]]


class _Tables(HTMLParser):
    """Collects tables; cells are [text, is header, columns, rows]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[list]]] = []
        self.open: list[list[list[list]]] = []
        self.cell: list | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.open.append([])
        elif self.open:
            if tag == "tr":
                self._end_cell()
                self.open[-1].append([])
            elif tag in ("td", "th"):
                self._end_cell()
                if not self.open[-1]:
                    self.open[-1].append([])
                a = dict(attrs)
                span = lambda k: min(1000, max(1, int(a[k]))) if (a.get(k) or "").strip().isdigit() else 1
                self.cell = ["", tag == "th", span("colspan"), span("rowspan")]
            elif tag == "br" and self.cell:
                self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.done.append(self.open.pop())

    def _end_cell(self):
        if self.cell is not None and self.open:
            self.cell[0] = re.sub(r"\s+", " ", self.cell[0]).strip()
            self.open[-1][-1].append(self.cell)
        self.cell = None

    def handle_data(self, data):
        if self.cell is not None and not self.skip:
            self.cell[0] += data


def spread(rows: list[list[list]]) -> tuple[Rows, bool]:
    """(cells with their spans filled, whether the first row is all header cells)."""
    out: list[dict[int, str]] = []
    for i, row in enumerate(rows):
        while len(out) <= i:
            out.append({})
        j = 0
        for text, _, wide, high in row:
            while j in out[i]:
                j += 1
            for k in range(i, min(i + high, len(rows))):
                while len(out) <= k:
                    out.append({})
                for m in range(j, j + wide):
                    out[k][m] = text
            j += wide
    width = max((max(r) + 1 for r in out if r), default=0)
    return [[r.get(j) for j in range(width)] for r in out if r], bool(rows and rows[0] and all(c[1] for c in rows[0]))


def html_tables(text: str) -> list[tuple[Rows, bool]]:
    p = _Tables()
    p.feed(text)
    p.close()
    return [t for t in (spread(rows) for rows in p.done) if t[0]]


def header_names(first: list[str | None], width: int) -> list[str]:
    """Names of a header row: repeated ones get ``_2``, ``_3``; missing ones are ``Column_n``."""
    out: list[str] = []
    for j in range(width):
        base = (first[j] if j < len(first) else None) or f"Column_{j + 1}"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _split_row(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s)]


def markdown_tables(text: str, min_rows: int = 2, min_cols: int = 2) -> list[Rows]:
    """Pipe tables (header, rule, rows) with at least so many rows, the header counted, and columns. Fenced code is left out."""
    out, lines, i, fence = [], text.splitlines(), 0, False
    while i < len(lines):
        if lines[i].lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and i + 1 < len(lines) and "|" in lines[i] and "-" in lines[i + 1] and _RULE.match(lines[i + 1]):
            head = _split_row(lines[i])
            if len(_split_row(lines[i + 1])) == len(head):
                rows, i = [head], i + 2
                while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                    cells = _split_row(lines[i])[: len(head)]
                    rows.append(cells + [None] * (len(head) - len(cells)))
                    i += 1
                if len(rows) >= min_rows and len(head) >= min_cols:
                    out.append(rows)
                continue
        i += 1
    return out


_TOON = re.compile(r"^\s*([A-Za-z_][\w-]*)?\[(\d+)\]\{([^}]*)\}:\s*$")


def toon_table(text: str) -> tuple[str, list[str], Rows]:
    """(name, columns, rows) of ``name[count]{a,b}:`` and its rows."""
    lines = [x for x in text.splitlines() if x.strip()]
    m = _TOON.match(lines[0]) if lines else None
    if not m:
        raise ParseError("a table begins with name[count]{columns}:")
    names = [c.strip() for c in m[3].split(",")]
    rows = [next(csv.reader([x.strip()], skipinitialspace=True)) for x in lines[1:]]
    if len(rows) != int(m[2]):
        raise ParseError(f"{m[2]} rows were announced, {len(rows)} came")
    for k, r in enumerate(rows, 1):
        if len(r) != len(names):
            raise ParseError(f"row {k} has {len(r)} cells, not {len(names)}")
    return m[1] or "table", names, rows


def toon_text(name: str, names: list[str], rows: list[list[object]]) -> str:
    for n in names:
        if not re.fullmatch(r"[A-Za-z_][\w .-]*", n):
            raise ParseError(f"{n!r} can't be a column here")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    show = lambda v: "null" if v is None else "true" if v is True else "false" if v is False else v
    for r in rows:
        w.writerow([show(v) for v in r])
    return f"{name}[{len(rows)}]{{{','.join(names)}}}:\n" + "".join("  " + x + "\n" for x in out.getvalue().splitlines())


TABLES = "array<struct<header:boolean,rows:array<array<string>>>>"


def html_tables_of(c: Column) -> Column:
    """All tables of an HTML column: array of (first row is a header, rows). Arrow batches, one parse per page."""

    @F.pandas_udf(TABLES)
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"header": h, "rows": r} for r, h in html_tables(t or "")])

    return parse(c)


def markdown_tables_of(c: Column, min_rows: int = 2, min_cols: int = 2) -> Column:

    @F.pandas_udf(TABLES)
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"header": True, "rows": r} for r in markdown_tables(t or "", min_rows, min_cols)])

    return parse(c)


def exploded(df: DataFrame, key: str, tables: Column) -> DataFrame:
    """One row per table row: key, table (from 0), row (from 0), is_header, cells."""
    t = df.select(key, F.posexplode(tables).alias("table", "t"))
    return t.select(key, "table", F.col("t.header").alias("header"), F.posexplode("t.rows").alias("row", "cells")).select(
        key, "table", "row", (F.col("header") & (F.col("row") == 0)).alias("is_header"), "cells")


def text_tables(text: str, min_rows: int = 2, min_cols: int = 2) -> list[Rows]:
    """Tables in laid-out text: neighbouring lines with the same number of cells, split at two spaces, tabs or pipes; rules are skipped."""
    out: list[Rows] = []
    run: Rows = []

    def end() -> None:
        nonlocal run
        if len(run) >= min_rows and len(run[0]) >= min_cols:
            out.append(run)
        run = []

    for line in text.splitlines():
        if re.fullmatch(r"[\s|+=_-]*", line) and line.strip():
            continue
        cells = [c.strip() for c in re.split(r"\s{2,}|\t+|\s*\|\s*", line.strip().strip("|").strip())] if line.strip() else []
        if len(cells) < min_cols or run and len(cells) != len(run[0]):
            end()
        if len(cells) >= min_cols:
            run.append(cells)
    end()
    return out
