"""Command line: ``python -m gridloom.cli -e "dim r = 1 + 1" -D name=value -f json script``."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import GridError
from .lang.interpreter import Interpreter
from .session import session
from .sheet import Sheet


def shown(value: object, form: str) -> str:
    """A result as a table, JSON or CSV."""
    if isinstance(value, Sheet):
        if form == "json":
            return value.to_json(pretty=True)
        cells = [["" if v is None else str(v) for v in r] for r in [value.columns, *value.rows()]]
        if form == "csv":
            quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
            return "\n".join(",".join(map(quote, r)) for r in cells)
        wide = [max(len(r[j]) for r in cells) for j in range(len(cells[0]))]
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells)
    return json.dumps(value, default=str, ensure_ascii=False) if form == "json" or isinstance(value, (list, dict)) else "" if value is None else str(value)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("script", nargs="?")
    p.add_argument("-e", "--eval")
    p.add_argument("-i", "--interactive", action="store_true")
    p.add_argument("-f", "--format", choices=["table", "json", "csv"], default="table")
    p.add_argument("-D", "--define", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--master")
    a = p.parse_args(argv)
    spark = session(a.master)
    if not a.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    it = Interpreter(spark)
    for d in a.define:
        name, _, value = d.partition("=")
        try:
            it.set(name, json.loads(value))
        except ValueError:
            it.set(name, value)

    def do(text: str) -> int:
        before = len(it.output)
        try:
            out = it.run(text)
        except GridError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        for line in it.output[before:]:
            print(line)
        if out is not None:
            print(shown(out, a.format))
        return 0

    code = do(a.eval) if a.eval else 0
    if a.script:
        with open(a.script, encoding="utf-8") as f:
            code = do(f.read()) or code
    if a.interactive or not (a.eval or a.script):
        for line in iter(lambda: input("> "), "exit"):
            do(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
