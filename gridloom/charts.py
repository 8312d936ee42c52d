"""Chart descriptions of aggregated frames, as JSON or a page. Only what is drawn reaches the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from .errors import GridError
from .operators.keys import need

KINDS = ("bar", "line", "pie", "scatter", "area")


def spec(df: DataFrame, kind: str, x: str, *y: str, title: str = "", most: int = 10_000) -> dict:
    if kind not in KINDS:
        raise GridError(f"a chart is one of {', '.join(KINDS)}")
    need(df, [x, *y])
    rows = df.select(*[f"`{c}`" for c in (x, *y)]).limit(most + 1).collect()
    if len(rows) > most:
        raise GridError(f"more than {most} points; aggregate first")
    return {"type": kind, "title": title, "x": {"name": x, "values": [r[0] for r in rows]}, "series": [{"name": c, "values": [r[k] for r in rows]} for k, c in enumerate(y, 1)]}


def to_json(chart: dict) -> str:
    return json.dumps(chart, default=str)


def to_html(chart: dict) -> str:
    head = "".join(f"<th>{html.escape(str(s['name']))}</th>" for s in chart["series"])
    body = "".join(f"<tr><td>{html.escape(str(v))}</td>" + "".join(f"<td>{html.escape(str(s['values'][i]))}</td>" for s in chart["series"]) + "</tr>" for i, v in enumerate(chart["x"]["values"]))
    data = to_json(chart).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(chart["title"])}</title><script type="application/json" id="chart">{data}</script><table><tr><th>{html.escape(chart["x"]["name"])}</th>{head}</tr>{body}</table>'
