"""Excel workbooks with the standard library: read, list and write. Legacy .xls files are refused."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from ..errors import GridError, Unsupported
from ..plans.addresses import column_letters, column_number

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _open(data: bytes) -> zipfile.ZipFile:
    if data[:4] == b"\xd0\xcf\x11\xe0":
        raise Unsupported("legacy .xls workbooks are not supported; save as .xlsx")
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise GridError("not an Excel workbook") from None


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> path, in order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_P}Relationship")}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    path = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
    return {s.get("name"): path(links[s.get(f"{_R}id")]) for s in book.iter(f"{_M}sheet")}


def sheet_names(data: bytes) -> list[str]:
    return list(_sheets(_open(data)))


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]


def read_sheet(data: bytes, name: str | None = None) -> list[list[object]]:
    """Rows of the named (first) sheet; dates are serial numbers, errors ``#ERROR: label``, formulas their last value."""
    z = _open(data)
    found = _sheets(z)
    if name is not None and name not in found:
        raise GridError(f"no sheet {name!r}; there are {', '.join(found)}")
    shared = _strings(z)
    rows: list[list[object]] = []
    for _, el in ET.iterparse(io.BytesIO(z.read(found[name] if name is not None else next(iter(found.values()))))):
        if el.tag != f"{_M}row":
            continue
        i = int(el.get("r") or len(rows) + 1) - 1
        while len(rows) <= i:
            rows.append([])
        row = rows[i]
        for c in el.iter(f"{_M}c"):
            ref = re.match(r"[A-Z]+", c.get("r") or "")
            j = column_number(ref[0]) if ref else len(row)
            while len(row) <= j:
                row.append(None)
            v, kind = c.find(f"{_M}v"), c.get("t")
            if kind == "inlineStr":
                row[j] = "".join(t.text or "" for t in c.iter(f"{_M}t"))
            elif v is None or v.text is None:
                row[j] = None
            elif kind == "s":
                row[j] = shared[int(v.text)]
            elif kind == "b":
                row[j] = v.text == "1"
            elif kind == "e":
                row[j] = f"#ERROR: {v.text}"
            elif kind in ("str", "d"):
                row[j] = v.text
            else:
                row[j] = float(v.text)
        el.clear()
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (datetime, date)):
        v = v.isoformat()
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, str) and v.startswith("=") and len(v) > 1:
        return f'<c r="{ref}"><f>{escape(v[1:])}</f></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_book(sheets: dict[str, list[list[object]]]) -> bytes:
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    names = list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + over + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="{_P[1:-1]}"><Relationship Id="rId1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{_M[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="{_P[1:-1]}">' + "".join(f'<Relationship Id="rId{k}" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, n in enumerate(names, 1):
            body = "".join(f'<row r="{i}">' + "".join(_cell(f"{column_letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", head + f'<worksheet xmlns="{_M[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
