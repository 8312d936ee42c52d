"""Number and date patterns of spreadsheet cells.

``pos;neg;zero;text`` sections, ``[Color]`` marks, ``0 # ? , . %`` places, ``@`` text, literal text around them, and date
patterns of y, m, d, h and s (``mm`` is always the month). A serial of 60 and more is one day ahead of the calendar
before 1900-03-01, as spreadsheets count a 1900-02-29.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_COLOR = re.compile(r"\[(Black|Blue|Cyan|Green|Magenta|Red|White|Yellow|Color ?\d+)\]", re.IGNORECASE)
_DATE = re.compile(r'"[^"]*"|y+|m+|d+|h+|s+', re.IGNORECASE)


def sections(pattern: str) -> list[str]:
    return pattern.split(";")


def pick(pattern: str, value: object) -> str:
    s = sections(pattern)
    if isinstance(value, str):
        return s[3] if len(s) > 3 else s[0] if "@" in s[0] else "@"
    if value < 0 and len(s) > 1:
        return s[1]
    if value == 0 and len(s) > 2:
        return s[2]
    return s[0]


def color(pattern: str, value: object) -> str | None:
    m = _COLOR.search(pick(pattern, value))
    return m[1] if m else None


def is_date(section: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]', "", section)
    return bool(re.search(r"[ymdhs]", bare, re.IGNORECASE)) and not re.search(r"[0#?]", bare)


def places(section: str) -> tuple[str, str, str, str]:
    """(text before, whole part, fraction, text after) of a numeric section."""
    m = re.search(r"[0#?][0#?,]*(?:\.[0#?]*)?|\.[0#?]+", section)
    if not m:
        return section, "", "", ""
    whole, _, fraction = m[0].partition(".")
    return section[: m.start()], whole, fraction, section[m.end() :]


def date_text(serial: float, section: str) -> str:
    day = datetime(1899, 12, 30) + timedelta(days=serial if serial >= 60 else serial + 1)
    names = {"yyyy": "%Y", "yy": "%y", "mmmm": "%B", "mmm": "%b", "mm": "%m", "dddd": "%A", "ddd": "%a", "dd": "%d", "hh": "%H", "ss": "%S"}

    def one(m: re.Match) -> str:
        t = m[0]
        if t[0] == '"':
            return t[1:-1]
        t = t.lower()
        if t in names:
            return day.strftime(names[t])
        return str({"y": day.year, "m": day.month, "d": day.day, "h": day.hour, "s": day.second}[t[0]])

    return _DATE.sub(one, section)


def number_text(value: float, section: str, signed: bool) -> str:
    percent = section.count("%")
    before, whole, fraction, after = places(section)
    if not whole and not fraction:
        return section.replace('"', "")
    x = abs(Decimal(repr(float(value)))) * 100**percent
    scale = len(whole) - len(whole.rstrip(","))
    x /= 1000**scale
    whole = whole.rstrip(",")
    digits = x.quantize(Decimal(1).scaleb(-len(fraction)), ROUND_HALF_UP)
    head, _, tail = f"{digits:f}".partition(".")
    least = sum(c in "0?" for c in whole)
    head = head.lstrip("0").rjust(least, "0") if least else head.lstrip("0")
    if "," in whole and head:
        head = f"{int(head):,}".rjust(least, "0") if head.isdigit() else head
    keep = len(fraction.rstrip("#"))
    while len(tail) > keep and tail.endswith("0"):
        tail = tail[:-1]
    minus = "-" if signed and value < 0 and digits != 0 else ""
    clean = lambda t: t.replace('"', "").replace("\\", "").replace("_", "").replace("*", "")
    return minus + clean(before) + head + ("." + tail if tail else "") + clean(after)


def format_value(pattern: str, value: object) -> str:
    """One value by a pattern."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    section = _COLOR.sub("", pick(pattern, value))
    if isinstance(value, str):
        return section.replace('"', "").replace("@", value)
    if section.strip().lower() in ("", "general"):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    if is_date(section):
        return date_text(float(value), section)
    return number_text(value, section, signed=len(sections(pattern)) < 2)


def format_column(pattern: str, c: Column) -> Column:
    """A numeric column by a constant pattern, as a built-in expression.

    Places are compiled: a fixed number of decimals (``0``s) and optional thousands marks, percent and literal text. Other patterns
    (optional decimals, dates with names) go value by value through an Arrow UDF.
    """
    parts = [_COLOR.sub("", s) for s in sections(pattern)]

    def one(section: str, x: Column, signed: bool) -> Column | None:
        if is_date(section):
            return None
        before, whole, fraction, after = places(section)
        bare = whole.replace(",", "")
        if not whole or whole.endswith(",") or set(fraction) - {"0"} or "?" in bare or bare.count("0") > 1:
            return None
        d = F.abs(x).cast("decimal(38,12)") * F.lit(100 ** section.count("%")).cast("decimal(5,0)")
        shown = F.format_number(F.round(d, len(fraction)), len(fraction))
        if "," not in whole:
            shown = F.replace(shown, F.lit(","), F.lit(""))
        if "0" not in bare:
            shown = F.regexp_replace(shown, r"^0(?=\.|$)", "")
        clean = lambda t: t.replace('"', "").replace("\\", "")
        minus = F.when((x < 0) & (F.round(d, len(fraction)) != 0), "-").otherwise("") if signed else F.lit("")
        return F.concat(minus, F.lit(clean(before)), shown, F.lit(clean(after)))

    built = [one(s, c, len(parts) < 2) for s in parts[:3]]
    if any(b is None for b in built):

        @F.pandas_udf("string")
        def by_value(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if pd.isna(v) else format_value(pattern, float(v)))

        return by_value(c.cast("double"))
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    if len(built) > 1:
        out = out.when(c < 0, built[1])
    if len(built) > 2:
        out = out.when(c == 0, built[2])
    return out.otherwise(built[0])
