"""Runs scripts on the driver. Tables and sheets stay lazy frames; lambdas over their rows compile to columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GridError, Unsupported
from ..functions import columns as C
from ..functions import scalar as S
from ..sheet import Book, Sheet
from ..sources import files
from . import values as V
from .parser import parse


class _Exit(Exception):
    def __init__(self, what: str):
        self.what = what


class _Return(Exception):
    def __init__(self, value: object):
        self.value = value


class Function:
    def __init__(self, name: str, params: list, body: list):
        self.name, self.params, self.body = name, params, body


class Lambda:
    def __init__(self, params: list[str], body: tuple):
        self.params, self.body = params, body


class Interpreter:
    """One script's world. ``output`` is what print wrote."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scopes: list[dict[str, object]] = [{}]
        self.functions: dict[str, Function] = {}
        self.python: dict[str, object] = {}
        self.output: list[str] = []

    # variables

    def get(self, name: str) -> object:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        raise GridError(f"no variable {name}")

    def set(self, name: str, value: object) -> None:
        """Assigns where the name is known, else at the top; its views are made anew."""
        value = Sheet.of(value, name) if isinstance(value, DataFrame) else value
        for s in reversed(self.scopes):
            if name in s:
                s[name] = value
                return
        self.scopes[-1][name] = value

    def frame(self, name: str) -> DataFrame:
        return self.sheet(self.get(name)).frame

    def sheet(self, v: object) -> Sheet:
        if isinstance(v, Sheet):
            return v
        if isinstance(v, DataFrame):
            return Sheet.of(v)
        if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            return Sheet.of(files.from_objects(self.spark, v))
        if isinstance(v, list) and v and all(isinstance(x, list) for x in v):
            return Sheet.of(files.from_rows(self.spark, v, False), named=False)
        raise GridError(f"{V.kind(v)} is no table")

    # running

    def run(self, text: str) -> object:
        return self.block(parse(text))

    def block(self, statements: list) -> object:
        out = None
        for s in statements:
            try:
                out = self.statement(s)
            except GridError as e:
                if e.line is None:
                    raise type(e)(e.message, s[1]) from e
                raise
        return out

    def inner(self, statements: list) -> None:
        self.scopes.append({})
        try:
            self.block(statements)
        finally:
            self.scopes.pop()

    def statement(self, s: tuple) -> object:
        kind, line, *rest = s
        match kind:
            case "dim":
                names, value = rest
                v = self.eval(value) if value else None
                for n in names:
                    self.scopes[-1][n] = Sheet.of(v, n) if isinstance(v, DataFrame) else v
            case "assign":
                self.assign(rest[0], self.eval(rest[1]))
            case "expr":
                return self.eval(rest[0])
            case "if":
                for test, body in rest[0]:
                    if V.truthy(self.eval(test)):
                        self.inner(body)
                        return None
                self.inner(rest[1])
            case "while":
                while V.truthy(self.eval(rest[0])):
                    if self.loop(rest[1], "while"):
                        break
            case "for":
                var, first, last, step, body = rest
                i, end, by = (self.eval(x) for x in (first, last, step))
                if by == 0:
                    raise GridError("a loop's step is not 0")
                while i <= end if by > 0 else i >= end:
                    if self.loop(body, "for", {var: i}):
                        break
                    i += by
            case "each":
                var, over, body = rest
                v = self.eval(over)
                items = v.each() if isinstance(v, Sheet) else v.sheets.values() if isinstance(v, Book) else v
                for x in items:
                    if self.loop(body, "for", {var: x}):
                        break
            case "exit":
                raise _Exit(rest[0])
            case "function":
                self.functions[rest[0].lower()] = Function(*rest)
            case "return":
                raise _Return(self.eval(rest[0]) if rest[0] else None)
            case "import":
                paths, sheet, into, options = rest
                got = self.load([self.eval(p) for p in paths], self.eval(sheet) if sheet else None, self.eval(options))
                self.scopes[-1][into] = got
            case "export":
                v, path = self.eval(rest[0]), self.eval(rest[1])
                if isinstance(v, Book):
                    v.write(path)
                else:
                    self.sheet(v).write(path, "append" if rest[2] else "overwrite")
        return None

    def loop(self, body: list, what: str, bound: dict | None = None) -> bool:
        """One round; true if the loop is left."""
        self.scopes.append(dict(bound or {}))
        try:
            self.block(body)
        except _Exit as e:
            if e.what != what:
                raise
            return True
        finally:
            self.scopes.pop()
        return False

    def load(self, paths: list[str], sheet: str | None, options: dict) -> Sheet | Book:
        if len(paths) > 1 or files.extension(paths[0]) in ("md", "markdown"):
            return Book.read(self.spark, *paths, **options)
        return Sheet.read(self.spark, paths[0], sheet, **options)

    def assign(self, target: tuple, value: object) -> None:
        match target:
            case ("name", name):
                self.set(name, value)
            case ("index", inner, key):
                holder, k = self.eval(inner), self.eval(key)
                if isinstance(holder, Sheet):
                    self.assign(inner, holder.set(k, value))
                elif isinstance(holder, (list, dict)):
                    if isinstance(holder, list):
                        V.at(holder, k)
                    holder[k] = value
                else:
                    raise GridError(f"can't assign into {V.kind(holder)}")
            case ("field", inner, name):
                holder = self.eval(inner)
                if not isinstance(holder, dict):
                    raise GridError(f"can't assign a field of {V.kind(holder)}")
                holder[name] = value
            case _:
                raise GridError("can't assign to that")

    # expressions

    def eval(self, e: tuple) -> object:
        match e:
            case ("value", v):
                return v
            case ("name", n):
                return self.get(n)
            case ("array", items):
                return [self.eval(x) for x in items]
            case ("object", pairs):
                return {k: self.eval(x) for k, x in pairs}
            case ("lambda", params, body):
                return Lambda(params, body)
            case ("unary", "-", x):
                v = self.eval(x)
                if not V.numeric(v):
                    raise GridError(f"- needs a number, not {V.kind(v)}")
                return -v
            case ("unary", "not", x):
                return not V.truthy(self.eval(x))
            case ("is_null", x):
                return self.eval(x) is None
            case ("binary", "and", a, b):
                return V.truthy(self.eval(a)) and V.truthy(self.eval(b))
            case ("binary", "or", a, b):
                left = self.eval(a)
                if isinstance(left, Sheet):
                    right = self.eval(b)
                    return left.zip(right) if isinstance(right, Sheet) else True
                return V.truthy(left) or V.truthy(self.eval(b))
            case ("binary", op, a, b):
                left, right = self.eval(a), self.eval(b)
                if op == "+" and isinstance(left, Sheet):
                    return left.append(self.sheet(right))
                if op == "+" and isinstance(left, Book):
                    return left.merge(right)
                return V.binary(op, left, right)
            case ("index", x, i):
                return self.index(self.eval(x), self.eval(i))
            case ("field", x, name):
                v = self.eval(x)
                return v.columns if isinstance(v, Sheet) and name == "columns" else V.at(v, name)
            case ("join", a, b, how, lk, rk):
                return self.sheet(self.eval(a)).join(self.sheet(self.eval(b)), (self.eval(lk), self.eval(rk)), how)
            case ("append", a, b):
                return self.sheet(self.eval(a)).append(self.sheet(self.eval(b)))
            case ("append_distinct", a, b, k):
                return self.sheet(self.eval(a)).append_distinct(self.sheet(self.eval(b)), self.eval(k))
            case ("upsert", a, b, k):
                return self.sheet(self.eval(a)).upsert(self.sheet(self.eval(b)), self.eval(k))
            case ("query", text):
                return self.query(text)
            case ("call", ("field", x, name), args):
                return self.method(self.eval(x), name.lower(), [self.eval(a) for a in args], args)
            case ("call", ("name", name), args):
                return self.call(name, args)
            case ("call", f, args):
                return self.apply(self.eval(f), [self.eval(a) for a in args])
        raise GridError(f"can't evaluate {e[0]}")

    def index(self, v: object, i: object) -> object:
        if isinstance(v, Sheet):
            return v.a1(i) if isinstance(i, str) else v.row(i)
        return v.get(i) if isinstance(v, Book) else V.at(v, i)

    def apply(self, f: object, args: list) -> object:
        if not isinstance(f, Lambda):
            raise GridError(f"{V.kind(f)} can't be called")
        if len(args) != len(f.params):
            raise GridError(f"{len(f.params)} arguments are needed, {len(args)} came")
        self.scopes.append(dict(zip(f.params, args, strict=True)))
        try:
            return self.eval(f.body)
        finally:
            self.scopes.pop()

    def call(self, name: str, args: list) -> object:
        low = name.lower()
        if low in self.functions:
            return self.call_function(self.functions[low], args)
        for s in reversed(self.scopes):
            if isinstance(s.get(name), Lambda):
                return self.apply(s[name], [self.eval(a) for a in args])
        given = [self.eval(a) for a in args]
        if low == "print":
            self.output.append(" ".join(V.text(x) if not isinstance(x, (Sheet, list, dict)) else str(x.rows() if isinstance(x, Sheet) else x) for x in given))
            return None
        if name in self.python:
            return self.python[name](*given)
        if low == "register_python":
            return self.register_python(*given)
        if low == "fetch":
            return files.fetch(given[0])
        if low == "fetch_all":
            return [files.fetch(u) for u in given[0]]
        if low == "with_column":
            return self.with_column(*given)
        if low == "consolidate":
            return (given[0] if isinstance(given[0], Book) else Book({k: self.sheet(x) for k, x in sorted(given[0].items())})).consolidate(*given[1:])
        if low.startswith("sheet_") or low in ("is_sheet_cell_formula",):
            return self.method(self.sheet(given[0]), low.removeprefix("sheet_"), given[1:], args[1:])
        if low.startswith("book_"):
            return self.book_call(low.removeprefix("book_"), given)
        if given and isinstance(given[0], Sheet) and low in ("sum", "avg", "average", "min", "max", "count"):
            return given[0].aggregate(low, *given[1:])
        if name.upper() in S.FUNCTIONS and low not in ("abs", "int"):
            return V.formula(name, given)
        if low in V.BUILTINS:
            return V.BUILTINS[low](*given)
        raise GridError(f"no function {name}")

    def call_function(self, f: Function, args: list) -> object:
        scope: dict[str, object] = {}
        back: list[tuple[str, tuple]] = []
        for k, (name, mode, default) in enumerate(f.params):
            if mode == "paramarray":
                scope[name] = [self.eval(a) for a in args[k:]]
            elif k < len(args):
                scope[name] = self.eval(args[k])
                if mode == "byref" and args[k][0] in ("name", "index", "field"):
                    back.append((name, args[k]))
            elif mode == "optional":
                scope[name] = self.eval(default) if default else None
            else:
                raise GridError(f"{f.name} needs {name}")
        if len(args) > len(f.params) and not (f.params and f.params[-1][1] == "paramarray"):
            raise GridError(f"{f.name} takes {len(f.params)} arguments")
        self.scopes.append(scope)
        try:
            self.block(f.body)
            out = None
        except _Return as r:
            out = r.value
        except _Exit as e:
            if e.what != "function":
                raise
            out = None
        finally:
            self.scopes.pop()
        for name, target in back:  # by reference: the caller's place gets the last value
            self.assign(target, scope[name])
        return out

    # SQL

    def query(self, text: str) -> Sheet:
        """SQL over script variables and quoted file names; both are views over lazy frames."""
        def file(m: re.Match) -> str:
            path = m[2]
            view = re.sub(r"\W", "_", PurePosixPath(path).stem)
            got = files.read(self.spark, path)
            (next(iter(got.values())) if isinstance(got, dict) else got).createOrReplaceTempView(view)
            return f"{m[1]} {view}"

        text = re.sub(r"(?i)\b(from|join)\s+[\"']([^\"']+\.\w+)[\"']", file, text)
        names = {n for s in self.scopes for n, v in s.items() if isinstance(v, (Sheet, list))}
        for n in names:
            if re.search(rf"(?i)\b(from|join|,)\s+{n}\b", text):
                self.sheet(self.get(n)).frame.createOrReplaceTempView(n)
        text = re.sub(r'"([A-Za-z_][\w ]*)"', r"`\1`", text)
        return Sheet.of(self.spark.sql(ordered(text)), "query")

    def register_python(self, name: str, source: str, result: str = "string") -> None:
        """A Python lambda (or a file and a function in it) for scripts and, by Arrow batches, for SQL."""
        if source.endswith(".py"):
            scope: dict[str, object] = {}
            exec(compile(files.read_bytes(self.spark, source), source, "exec"), scope)
            f = scope[result]
            result = "string"
        else:
            f = eval(source)
        self.python[name] = f

        def batch(*cols: pd.Series) -> pd.Series:
            return pd.Series([f(*v) for v in zip(*cols, strict=True)])

        # Spark can't batch a function without arguments
        self.spark.udf.register(name, F.pandas_udf(batch, result) if f.__code__.co_argcount else self.row_function(f, result))

    @staticmethod
    def row_function(f: Callable, result: str):
        return F.udf(f, result)

    # rows by lambdas

    def compiled(self, f: Lambda, s: Sheet) -> C.Val:
        """The lambda's body over a row of ``s`` as a column."""
        schema, row = s.body.schema, f.params[0]

        def go(e: tuple) -> C.Val:
            match e:
                case ("value", v):
                    return C.literal(v)
                case ("field", ("name", n), c) | ("index", ("name", n), ("value", str(c))) if n == row:
                    if c not in schema.names:
                        raise GridError(f"no field {c!r}")
                    return C.from_column(F.col(f"`{c}`"), schema[c].dataType)
                case ("name", n) if n != row:
                    v = self.get(n)
                    if isinstance(v, (bool, int, float, str)) or v is None:
                        return C.literal(v)
                case ("unary", "-", x):
                    n = C.number(go(x))
                    return C.Val("num", -n.col, n.err)
                case ("unary", "not", x):
                    t = truth(go(x))
                    return C.Val("bool", ~t.col, t.err)
                case ("is_null", x):
                    return C.Val("bool", go(x).col.isNull())
                case ("binary", "and" | "or" as o, a, b):
                    x, y = truth(go(a)), truth(go(b))
                    return C.Val("bool", x.col & y.col if o == "and" else x.col | y.col)
                case ("binary", "like", a, ("value", str(p))):
                    return C.Val("bool", C.text(go(a)).col.like(p.replace("\\", "\\\\").replace("_", "\\_")))
                case ("binary", "=" | "<>" as o, a, b):
                    x, y = go(a), go(b)
                    if x.numeric and y.numeric:
                        x, y = C.Val("num", x.col.cast("double"), x.err, nullable=True), C.Val("num", y.col.cast("double"), y.err, nullable=True)
                    return C.operate(o, x, y)
                case ("binary", "+" | "-" | "*" as o, a, b):
                    x, y = go(a), go(b)
                    if o == "+" and "text" in (x.kind, y.kind):
                        return C.operate("&", x, y)
                    if x.kind == y.kind == "int":
                        return C.Val("int", {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[o], C.first_error(x.err, y.err), nullable=True)
                    return C.operate(o, x, y)
                case ("binary", "/" as o, a, b):
                    x, y = go(a), go(b)
                    if x.kind == y.kind == "int":
                        q = F.floor(F.abs(x.col) / F.abs(y.col)) * F.signum(x.col) * F.signum(y.col)
                        return C.Val("int", F.when(y.col != 0, q.cast("bigint")), C.first_error(x.err, y.err, C.flag(y.col == 0, "#DIV/0!")))
                    return C.operate(o, x, y)
                case ("binary", "&" | "<" | "<=" | ">" | ">=" as o, a, b):
                    return C.operate(o, go(a), go(b))
                case ("call", ("name", n), args) if n.upper() in C.FUNCTIONS:
                    return C.FUNCTIONS[n.upper()](*[go(a) for a in args])
            raise Unsupported("this lambda can't be compiled")

        def truth(v: C.Val) -> C.Val:
            if v.kind == "text":
                return C.Val("bool", F.coalesce(v.col != "", F.lit(False)))
            return C.truth(v)

        return go(f.body)

    def row_udf(self, f: Lambda, s: Sheet, result: str):
        """A lambda that can't be compiled, row by row in Arrow batches; only values and formula functions are at hand."""

        known = {k: v for scope in self.scopes for k, v in scope.items() if isinstance(v, (bool, int, float, str, list, dict)) or v is None}
        functions, names = dict(self.functions), s.columns

        @F.pandas_udf(result)
        def run(rows: pd.DataFrame) -> pd.Series:
            own = Interpreter(None)
            own.scopes, own.functions = [known], functions
            out = [own.apply(f, [dict(zip(names, r, strict=True))]) for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)]
            return pd.Series([V.truthy(x) if result == "boolean" else None if x is None else V.text(x) for x in out])

        return run(F.struct(*[F.col(f"`{c}`") for c in names]))

    def condition(self, f: Lambda, s: Sheet):
        try:
            v = self.compiled(f, s)
            return F.coalesce(v.col != "", F.lit(False)) if v.kind == "text" else C.strict(C.truth(v))
        except Unsupported:
            return self.row_udf(f, s, "boolean")

    def with_column(self, v: object, name: str, f: Lambda) -> Sheet:
        s = self.sheet(v)
        try:
            return s.with_column(name, C.strict(self.compiled(f, s)))
        except Unsupported:
            return s.with_column(name, self.row_udf(f, s, "string"))

    def map_rows(self, s: Sheet, f: Lambda) -> Sheet:
        """row => {column: value, ...}: the columns stay as they are, missing ones are null."""
        if f.body[0] != "object":
            raise Unsupported("a row is mapped to an object")
        made = {k: C.strict(self.compiled(Lambda(f.params, e), s)) for k, e in f.body[1]}
        return Sheet(s.body.select(*[(made[c] if c in made else F.lit(None)).alias(c) for c in s.columns], s.order), s.name, s.named)

    def method(self, v: object, name: str, args: list, raw: list) -> object:
        if isinstance(v, Book):
            return self.book_call(name, [v, *args])
        if not isinstance(v, Sheet):
            if isinstance(v, list) and name in ("map", "filter"):
                return [self.apply(args[0], [x]) for x in v] if name == "map" else [x for x in v if V.truthy(self.apply(args[0], [x]))]
            raise GridError(f"{V.kind(v)} has no {name}")
        match name:
            case "map":
                return self.map_rows(v, args[0]) if isinstance(args[0], Lambda) else v.map(args[0])
            case "filter":
                return v.where(self.condition(args[0], v))
            case "filter_rows":
                return v.filter_rows(*args)
            case "transpose":
                return v.transpose()
            case "name_columns_by_row":
                return v.name_columns_by_row(args[0])
            case "sort":
                names = args[0] if isinstance(args[0], list) else [args[0]]
                return v.sort(*names, descending=bool(args[1]) if len(args) > 1 else False)
            case "take" | "limit":
                return v.take(args[0], args[1] if len(args) > 1 else 0)
            case "top":
                return v.top(args[0], *(args[1] if isinstance(args[1], list) else [args[1]]))
            case "get_row_by_name":
                return v.row_named(args[0], args[1])
            case "set_row_by_name":
                return v.set_row_named(args[0], args[1], **args[2])
            case "row_update" | "update_row":
                return v.update_row(args[0], *args[1])
            case "row_insert" | "insert_row":
                return v.insert_row(args[0], *args[1])
            case "row_append" | "append_row":
                return v.append_row(*args[0])
            case "column_insert" | "insert_column":
                return v.insert_column(args[0], args[1], F.lit(None).cast("string")).with_values(args[1], args[2]).select(*v.columns[: args[0]], args[1], *v.columns[args[0] :])
            case "select_columns":
                return v.select(*args[0])
            case "remove_columns":
                return v.remove(*args[0])
            case "remove_empty_rows":
                return v.remove_empty_rows()
            case "remove_duplicates":
                return v.remove_duplicates(*(args[0] if args else []))
            case "clean_data":
                ops = [k for k, on in args[0].items() if on is True] if isinstance(args[0], dict) else list(args[0])
                return v.clean(*ops, fill=args[1] if len(args) > 1 else None)
            case "clean_data_range":
                return v.clean(*args[1], fill=args[2] if len(args) > 2 else None, at=args[0])
            case "validate_column":
                how = args[2] if len(args) > 2 else {}
                return v.invalid(args[0], args[1], **({"low": how.get("min"), "high": how.get("max")} if args[1] == "range" else {"pattern": how.get("pattern")} if args[1] == "regex" else {}))
            case "row_count":
                return v.row_count()
            case "col_count" | "column_count":
                return v.column_count()
            case "column_names":
                return v.columns
            case "column_by_name":
                return v.column(args[0])
            case "get_a1" | "get_cell" | "get_cell_value" | "get_range":
                return v.a1(args[0])
            case "get_a1_eval":
                got = v.a1(args[0])
                return v.evaluate(got) if isinstance(got, str) and got.startswith("=") else got
            case "is_sheet_cell_formula":
                got = v.a1(args[0])
                return isinstance(got, str) and got.startswith("=")
            case "get_by_name":
                return v.cell(args[0], args[1])
            case "set_a1" | "set_formula":
                return v.set(args[0], args[1])
            case "set_by_name":
                return v.set_at(args[0], args[1], args[2])
            case "set_column_by_name":
                return v.with_values(args[0], args[1])
            case "map_range":
                return v.map(args[1], at=args[0])
            case "eval_formula":
                return v.evaluate(args[0])
            case "evaluate_formulas":
                return v.recalculated()
            case "rename" | "set_name":
                return Sheet(v.body, args[0], v.named)
        raise GridError(f"a sheet has no {name}")

    def book_call(self, name: str, args: list) -> object:
        if name == "from_files" or name == "from_files_with_options":
            return Book.read(self.spark, *args[0], **(args[1] if len(args) > 1 else {}))
        if name == "from_dict":
            return Book({k: Sheet(self.sheet(x).body, k, self.sheet(x).named) for k, x in args[0].items()})
        b, rest = args[0], args[1:]
        match name:
            case "sheet_names" | "names":
                return b.names()
            case "sheet_count":
                return len(b.sheets)
            case "has_sheet":
                return rest[0] in b.sheets
            case "get_sheet" | "get_sheet_by_index":
                return b.get(rest[0])
            case "active_sheet":
                return b.active_sheet()
            case "set_active_sheet":
                b.get(rest[0])
                return Book(b.sheets, b.name, rest[0])
            case "add_sheet":
                return b.add(rest[0], self.sheet(rest[1]))
            case "add_empty_sheet":
                return b.add(rest[0], Sheet.of(self.spark.createDataFrame([], "column_0 string"), named=False))
            case "remove_sheet":
                return b.remove(rest[0])
            case "rename_sheet":
                return b.rename(*rest)
            case "merge":
                return b.merge(rest[0])
            case "sheets":
                return list(b.sheets.values())
            case "to_dict":
                return dict(b.sheets)
            case "name":
                return b.name
            case "set_name":
                return Book(b.sheets, rest[0], b.active)
            case "consolidate":
                return b.consolidate(*rest)
            case "consolidate_with_options":
                o = rest[0]
                return b.consolidate(o.get("source_column_name", "_source") if o.get("add_source_column") else None)
            case "for_each_sheet":
                for n, s in b.sheets.items():
                    self.apply(rest[0], [s] if len(rest[0].params) == 1 else [n, s])
                return None
            case "for_each_sheet_mut":
                return Book({n: self.sheet(self.apply(rest[0], [s] if len(rest[0].params) == 1 else [n, s])) for n, s in b.sheets.items()}, b.name, b.active)
        raise GridError(f"a book has no {name}")


def ordered(sql: str) -> str:
    """ORDER BY terms without a null rule get the surface's: ascending nulls last, descending nulls first."""
    m = None
    for m in re.finditer(r"(?i)\border\s+by\b", sql):
        pass
    if m is None or sql.count("(", m.end()) != sql.count(")", m.end()):
        return sql
    tail = re.split(r"(?i)\b(limit|offset)\b", sql[m.end() :], maxsplit=1)
    terms, depth, now = [], 0, ""
    for c in tail[0]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            terms.append(now)
            now = ""
        else:
            now += c
    terms.append(now)
    out = [t if re.search(r"(?i)\bnulls\b", t) else f"{t.rstrip()} nulls {'first' if re.search(r'(?i)\bdesc\s*$', t) else 'last'}" for t in terms]
    return sql[: m.end()] + ",".join(out) + " " + "".join(tail[1:])
