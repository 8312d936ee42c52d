"""The formula functions as Spark columns: a formula over a row compiles to one expression, no UDF.

A value is a :class:`Val`: its static kind, its column and a column with an error label (null: no error). Errors go through
operators and functions by ``coalesce``; every domain error is guarded so that ANSI mode never raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DIV0, NA, NAME, NUM, REF, VALUE, GridError, Unsupported
from ..operators.keys import number_text
from ..plans import formulas as P
from ..plans.addresses import Cell, Range

EPOCH_SERIAL = 25569


_OPEN = object()


@dataclass(frozen=True)
class Val:
    kind: str  # num, int, text, bool, empty, error, array
    col: Column | None = None
    err: Column | None = None
    items: tuple[Val, ...] = ()
    nullable: bool = False  # a null of this column is an empty cell
    const: object = _OPEN  # what a literal is
    cells: tuple[tuple[object, ...], ...] | None = None  # of a fixed range: its values

    @property
    def numeric(self) -> bool:
        return self.kind in ("num", "int")


def from_column(c: Column, kind: T.DataType) -> Val:
    if isinstance(kind, T.BooleanType):
        return Val("bool", c, nullable=True)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Val("int", c.cast("bigint"), nullable=True)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Val("num", c.cast("double"), nullable=True)
    return Val("text", c.cast("string"), nullable=True)


def literal(v: object) -> Val:
    if v is None:
        return Val("empty", F.lit(None).cast("double"), const=v)
    if isinstance(v, bool):
        return Val("bool", F.lit(v), const=v)
    if isinstance(v, int):
        return Val("int", F.lit(v).cast("bigint"), const=v)
    if isinstance(v, float):
        return Val("num", F.lit(v), const=v)
    return Val("text", F.lit(v), const=v)


def error(label: str) -> Val:
    return Val("error", F.lit(None).cast("double"), F.lit(label))


def first_error(*errs: Column | None) -> Column | None:
    known = [e for e in errs if e is not None]
    return None if not known else known[0] if len(known) == 1 else F.coalesce(*known)


def flag(bad: Column, label: str) -> Column:
    return F.when(bad, label)


def leaves(args: list[Val]) -> list[Val]:
    return [x for a in args for x in (leaves(list(a.items)) if a.kind == "array" else [a])]


def number(v: Val) -> Val:
    """As a double; text, bool, empty and null cells are #VALUE!."""
    if v.numeric:
        return Val("num", v.col.cast("double"), first_error(v.err, flag(v.col.isNull(), VALUE) if v.nullable else None))
    return Val("num", F.lit(None).cast("double"), first_error(v.err, F.lit(VALUE)))


def truth(v: Val) -> Val:
    if v.kind == "bool":
        return Val("bool", F.coalesce(v.col, F.lit(False)), v.err)
    if v.numeric:
        return Val("bool", F.coalesce(v.col != 0, F.lit(False)), first_error(v.err, flag(F.isnan(v.col.cast("double")), NUM)))
    if v.kind == "empty":
        return Val("bool", F.lit(False), v.err)
    return Val("bool", F.lit(False), first_error(v.err, flag(v.col.isNotNull(), VALUE) if v.kind == "text" and v.nullable else F.lit(VALUE)))


def text(v: Val) -> Val:
    if v.kind == "text":
        c = v.col
    elif v.kind == "bool":
        c = F.upper(v.col.cast("string"))
    elif v.kind == "int":
        c = v.col.cast("string")
    elif v.kind == "num":
        c = number_text(v.col)
    else:
        c = F.lit("")
    return Val("text", F.coalesce(c, F.lit("")), v.err)


FUNCTIONS: dict[str, Callable[..., Val]] = {}


def function(*names: str):
    def put(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def _numbers(args: list[Val]) -> tuple[list[Column], Column | None]:
    """(doubles, null where not a number; the errors of plain arguments)."""
    return [x.col.cast("double") for x in leaves(args) if x.numeric], first_error(*[a.err for a in args if a.kind != "array"])


def _fold(cols: list[Column], zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return reduce(lambda a, c: F.when(c.isNull(), a).otherwise(step(a, c)), cols, zero)


def _count(cols: list[Column]) -> Column:
    return reduce(lambda a, c: a + F.when(c.isNotNull(), 1).otherwise(0), cols, F.lit(0)).cast("bigint")


@function("SUM")
def _sum(*a: Val) -> Val:
    cols, err = _numbers(list(a))
    return Val("num", _fold(cols, F.lit(0.0), lambda x, c: x + c), err)


@function("AVERAGE", "AVG")
def _average(*a: Val) -> Val:
    cols, err = _numbers(list(a))
    n = _count(cols)
    return Val("num", F.try_divide(_fold(cols, F.lit(0.0), lambda x, c: x + c), n), first_error(err, flag(n == 0, DIV0)))


@function("COUNT")
def _count_fn(*a: Val) -> Val:
    cols, err = _numbers(list(a))
    return Val("int", _count(cols), err)


def _extreme(args, pick) -> Val:
    cols, err = _numbers(list(args))
    if not cols:
        return Val("num", F.lit(None).cast("double"), first_error(err, F.lit(VALUE)))
    c = pick(*cols) if len(cols) > 1 else cols[0]
    return Val("num", c, first_error(err, flag(c.isNull(), VALUE)))


@function("MAX")
def _max(*a: Val) -> Val:
    return _extreme(a, F.greatest)


@function("MIN")
def _min(*a: Val) -> Val:
    return _extreme(a, F.least)


@function("PRODUCT")
def _product(*a: Val) -> Val:
    cols, err = _numbers(list(a))
    return Val("num", F.when(_count(cols) == 0, 0.0).otherwise(_fold(cols, F.lit(1.0), lambda x, c: x * c)), err)


def _math(f: Callable[[Column], Column], bad: Callable[[Column], tuple[Column, str]] | None = None, kind: str = "num"):
    def build(x: Val) -> Val:
        n = number(x)
        if bad is None:
            return Val(kind, f(n.col), n.err)
        wrong, label = bad(n.col)
        return Val(kind, F.when(~wrong, f(n.col)), first_error(n.err, flag(wrong, label)))

    return build


def _places(how: Callable[[Column], Column]):
    def build(x: Val, p: Val | None = None) -> Val:
        n, d = number(x), number(p or literal(0))
        m = F.pow(F.lit(10.0), F.floor(d.col))
        return Val("num", F.signum(n.col) * how(F.abs(n.col) * m) / m, first_error(n.err, d.err))

    return build


def _outward(odd: bool):
    def f(c: Column) -> Column:
        up = F.ceil(F.abs(c)).cast("double")
        out = up + F.when((up % 2) == (0 if odd else 1), 1.0).otherwise(0.0)
        return F.when(c < 0, -out).otherwise(out)

    return f


FUNCTIONS |= {
    "ABS": _math(F.abs),
    "ROUND": _places(lambda c: F.floor(c + 0.5)),
    "ROUNDUP": _places(F.ceil),
    "ROUNDDOWN": _places(F.floor),
    "TRUNC": _places(F.floor),
    "INT": _math(lambda c: F.floor(c).cast("double")),
    "SIGN": _math(lambda c: F.signum(c).cast("bigint"), kind="int"),
    "SQRT": _math(F.sqrt, lambda c: (c < 0, NUM)),
    "LN": _math(F.ln, lambda c: (c <= 0, NUM)),
    "LOG10": _math(F.log10, lambda c: (c <= 0, NUM)),
    "EXP": _math(F.exp),
    "EVEN": _math(_outward(False)),
    "ODD": _math(_outward(True)),
    "FACT": _math(
        lambda c: F.when(F.floor(c) == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(c).cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i)),
        lambda c: ((F.floor(c) < 0) | (F.floor(c) > 170), NUM)),
    "PI": lambda: Val("num", F.pi()),
    "RAND": lambda: Val("num", F.rand()),
    "NOW": lambda: Val("num", F.unix_timestamp() / 86400.0 + EPOCH_SERIAL),
    "TODAY": lambda: Val("num", (F.datediff(F.current_date(), F.lit("1970-01-01").cast("date")) + EPOCH_SERIAL).cast("double")),
    "ISBLANK": lambda x: Val("bool", (x.col.isNull() if x.nullable else F.lit(x.kind == "empty")) & (x.err.isNull() if x.err is not None else F.lit(True))),
    "ISERROR": lambda x: Val("bool", x.err.isNotNull() if x.err is not None else F.lit(False)),
    "ISNA": lambda x: Val("bool", F.coalesce(x.err == NA, F.lit(False)) if x.err is not None else F.lit(False)),
    "ISNUMBER": lambda x: Val("bool", x.col.isNotNull() if x.numeric else F.lit(False)),
    "ISTEXT": lambda x: Val("bool", x.col.isNotNull() if x.kind == "text" else F.lit(False)),
}


@function("MOD")
def _mod(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    return Val("num", F.try_mod(x.col, y.col), first_error(x.err, y.err, flag(y.col == 0, DIV0)))


@function("POWER")
def _power(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    return Val("num", F.pow(x.col, y.col), first_error(x.err, y.err))


@function("LOG")
def _log(x: Val, base: Val | None = None) -> Val:
    base = base or literal(10)
    if not x.numeric or not base.numeric:
        return error(NUM)
    a, b = x.col.cast("double"), base.col.cast("double")
    bad = a.isNull() | b.isNull() | (a <= 0) | (b <= 0) | (b == 1)
    return Val("num", F.when(~bad, F.ln(a) / F.ln(b)), first_error(x.err, base.err, flag(bad, NUM)))


@function("RANDBETWEEN")
def _randbetween(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    lo, hi = F.floor(x.col), F.floor(y.col)
    return Val("int", (F.floor(F.rand() * (hi - lo + 1)) + lo).cast("bigint"), first_error(x.err, y.err, flag(lo > hi, VALUE)))


def common(a: Val, b: Val) -> tuple[str, Column, Column]:
    """A kind that both columns can be cast to."""
    if a.kind == b.kind:
        return a.kind, a.col, b.col
    if {a.kind, b.kind} <= {"num", "int", "empty", "error"}:
        return "num", a.col.cast("double"), b.col.cast("double")
    if "error" in (a.kind, b.kind) or "empty" in (a.kind, b.kind):
        keep = b if a.kind in ("error", "empty") else a
        kind = {"text": "string", "bool": "boolean", "num": "double", "int": "bigint"}[keep.kind]
        return keep.kind, a.col.cast(kind) if a is keep else F.lit(None).cast(kind), b.col.cast(kind) if b is keep else F.lit(None).cast(kind)
    return "text", text(a).col, text(b).col


@function("IF")
def _if(c: Val, t: Val, f: Val | None = None) -> Val:
    f = f or literal(False)
    test = truth(c)
    kind, x, y = common(t, f)
    none = F.lit(None).cast("string")
    branch = None if t.err is None and f.err is None else F.when(test.col, t.err if t.err is not None else none).otherwise(f.err if f.err is not None else none)
    return Val(kind, F.when(test.col, x).otherwise(y), first_error(test.err, branch), nullable=t.nullable or f.nullable)


def _logic(args, op) -> Val:
    parts = [truth(x) for x in leaves(list(args))]
    return Val("bool", reduce(op, [p.col for p in parts]), first_error(*[p.err for p in parts]))


@function("AND")
def _and(*a: Val) -> Val:
    return _logic(a, lambda x, y: x & y)


@function("OR")
def _or(*a: Val) -> Val:
    return _logic(a, lambda x, y: x | y)


@function("NOT")
def _not(x: Val) -> Val:
    t = truth(x)
    return Val("bool", ~t.col, t.err)


@function("CONCAT", "CONCATENATE")
def _concat(*a: Val) -> Val:
    parts = [text(x) for x in leaves(list(a))]
    return Val("text", F.concat(*[p.col for p in parts]) if parts else F.lit(""), first_error(*[p.err for p in parts]))


@function("LEN")
def _len(x: Val) -> Val:
    if x.kind == "array":
        return literal(len(leaves([x])))
    t = text(x)
    return Val("int", F.length(t.col).cast("bigint"), t.err)


def _take(side: str):
    def build(t: Val, n: Val | None = None) -> Val:
        s, k = text(t), number(n or literal(1))
        size = F.floor(k.col).cast("int")
        whole = F.length(s.col)
        c = F.substring(s.col, F.lit(1), size) if side == "left" else F.when(size > 0, F.substring(s.col, F.greatest(whole - size + 1, F.lit(1)), whole)).otherwise("")
        return Val("text", F.when(size >= 0, c), first_error(s.err, k.err, flag(size < 0, VALUE)))

    return build


def _text_fn(f: Callable[[Column], Column]):
    def build(t: Val) -> Val:
        s = text(t)
        return Val("text", f(s.col), s.err)

    return build


def _proper(c: Column) -> Column:
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.when(a["letter"], F.lower(x)).otherwise(F.upper(x))).alias("out"), x.rlike(r"^\p{L}").alias("letter"))
    return F.aggregate(F.split(c, ""), zero, step, lambda a: a["out"])


FUNCTIONS |= {
    "LEFT": _take("left"),
    "RIGHT": _take("right"),
    "TRIM": _text_fn(lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")),
    "UPPER": _text_fn(F.upper),
    "LOWER": _text_fn(F.lower),
    "PROPER": _text_fn(_proper),
}


@function("DATE")
def _date(y: Val, m: Val, d: Val) -> Val:
    a, b, c = number(y), number(m), number(d)
    i = lambda v: F.floor(v.col).cast("int")
    day = F.try_make_timestamp(i(a), i(b), i(c), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")
    out = (F.datediff(day, F.lit("1970-01-01").cast("date")) + EPOCH_SERIAL).cast("double")
    return Val("num", out, first_error(a.err, b.err, c.err, flag(day.isNull(), VALUE)))


def serial_to_date(c: Column) -> Column:
    return F.date_from_unix_date((F.floor(c) - EPOCH_SERIAL).cast("int"))


def operate(op: str, a: Val, b: Val) -> Val:
    if op == "&":
        x = [F.coalesce(v.err, text(v).col) if v.err is not None else text(v).col for v in (a, b)]
        return Val("text", F.concat(*x))
    if op in ("=", "<>"):
        same_kind = a.kind == b.kind
        eq = F.coalesce(a.col.eqNullSafe(b.col), F.lit(False)) if same_kind else (a.col.isNull() & b.col.isNull() if a.nullable or b.nullable else F.lit(False))
        return Val("bool", eq if op == "=" else ~eq, first_error(a.err, b.err))
    x, y = number(a), number(b)
    err = first_error(x.err, y.err)
    match op:
        case "+":
            return Val("num", x.col + y.col, err)
        case "-":
            return Val("num", x.col - y.col, err)
        case "*":
            return Val("num", x.col * y.col, err)
        case "/":
            return Val("num", F.try_divide(x.col, y.col), first_error(err, flag(y.col == 0, DIV0)))
        case "^":
            return Val("num", F.pow(x.col, y.col), err)
        case "<":
            return Val("bool", x.col < y.col, err)
        case "<=":
            return Val("bool", x.col <= y.col, err)
        case ">":
            return Val("bool", x.col > y.col, err)
        case ">=":
            return Val("bool", x.col >= y.col, err)
    raise GridError(f"unknown operator {op}")


# lookups in fixed ranges: the table is a literal, a row's place in it an expression


def _kind_of(v: object) -> str:
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "text"


def _given(v: Val, kind: type | tuple[type, ...], default: object) -> object:
    if v is None:
        return default
    if v.const is _OPEN or not isinstance(v.const, kind):
        raise Unsupported("a lookup's column, row and modes must be constants")
    return v.const


def _table(v: Val) -> list[list[object]]:
    if v.cells is None:
        raise Unsupported("a lookup needs a fixed range ($A$1:$B$9)")
    return [list(r) for r in v.cells]


def _line(v: Val) -> list[object]:
    return [x for r in _table(v) for x in r]


def _sought(v: Val, keys: list[object]) -> tuple[Column, str, list[tuple[int, object]]]:
    """(the value sought, its kind, (place, key) of the keys it can be compared with)."""
    kind = "num" if v.numeric else v.kind
    return (v.col.cast("double") if kind == "num" else v.col), kind, [(i, float(k) if kind == "num" else k) for i, k in enumerate(keys, 1) if k is not None and _kind_of(k) == kind]


def _at(places: list[int], n: Column) -> Column:
    """The n-th of ``places`` (from 1), null for 0."""
    return F.when(n > 0, F.element_at(F.array(*map(F.lit, places)), n.cast("int"))) if places else F.lit(None).cast("int")


def _exact_place(v: Val, keys: list[object], last: bool = False) -> Column:
    x, _, own = _sought(v, keys)
    own = own[::-1] if last else own
    return _at([i for i, _ in own], F.array_position(F.array(*[F.lit(k) for _, k in own]), x)) if own else F.lit(None).cast("int")


def _scanned_place(v: Val, keys: list[object], down: bool = False) -> Column:
    """The last key up to the value before the first one beyond it, over keys in any order: by running extremes."""
    if any(k is not None and _kind_of(k) != ("num" if v.numeric else v.kind) for k in keys):
        raise Unsupported("keys of several types can't be ordered")
    x, _, own = _sought(v, keys)
    tops: list[object] = []
    for _, k in own:
        tops.append(k if not tops else (min if down else max)(tops[-1], k))
    return _at([i for i, _ in own], F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t >= x if down else t <= x))) if own else F.lit(None).cast("int")


def _picked(values: list[object], place: Column, err: Column | None, missing: Val | None = None) -> Val:
    kinds = {_kind_of(v) for v in values if v is not None} or {"text"}
    if len(kinds) > 1:
        raise Unsupported("a lookup column of several types")
    kind = kinds.pop()
    if kind == "num" and all(isinstance(v, int) for v in values if v is not None):
        kind = "int"
    spark_kind = {"bool": "boolean", "num": "double", "int": "bigint", "text": "string"}[kind]
    hit = F.element_at(F.array(*[F.lit(v).cast(spark_kind) for v in values]), place)
    if missing is None:
        return Val(kind, hit, first_error(err, flag(place.isNull(), NA)), nullable=None in values)
    if kind == "text" or missing.kind == kind:
        return Val(kind, F.when(place.isNotNull(), hit).otherwise(text(missing).col if kind == "text" else missing.col), first_error(err, F.when(place.isNull(), missing.err) if missing.err is not None else None), nullable=None in values)
    raise Unsupported("XLOOKUP's values and its default must be of one type")


def _part(n: int, size: int) -> int | None:
    return None if n < 1 or n > size else n - 1


def _lookup_in(v: Val, keys: list[object], values: Callable[[int], list[object]], n: Val, size: int, approx: Val | None) -> Val:
    at = _part(k := int(_given(n, (int, float), 1)), size)
    if at is None:
        return error(VALUE if k < 1 else REF)
    place = _scanned_place(v, keys) if _given(approx, (bool, int), True) else _exact_place(v, keys)
    return _picked(values(at), place, v.err)


@function("VLOOKUP")
def _vlookup(v: Val, table: Val, col: Val, approx: Val | None = None) -> Val:
    t = _table(table)
    return _lookup_in(v, [r[0] for r in t], lambda c: [r[c] for r in t], col, len(t[0]), approx)


@function("HLOOKUP")
def _hlookup(v: Val, table: Val, row: Val, approx: Val | None = None) -> Val:
    t = _table(table)
    return _lookup_in(v, t[0], lambda r: t[r], row, len(t), approx)


@function("MATCH")
def _match(v: Val, keys: Val, kind: Val | None = None) -> Val:
    k, line = _given(kind, (int, float), 1), _line(keys)
    if k not in (-1, 0, 1):
        return error(VALUE)
    place = _exact_place(v, line) if k == 0 else _scanned_place(v, line, down=k < 0)
    return Val("int", place.cast("bigint"), first_error(v.err, flag(place.isNull(), NA)))


@function("XLOOKUP")
def _xlookup(v: Val, look: Val, give: Val, missing: Val | None = None, mode: Val | None = None, search: Val | None = None) -> Val:
    keys, values, how, way = _line(look), _line(give), _given(mode, (int, float), 0), _given(search, (int, float), 1)
    if how not in (-1, 0, 1) or way not in (-1, 1) or len(keys) != len(values):
        raise Unsupported("XLOOKUP over a column knows the modes -1, 0, 1 and searches from either end")
    place = _exact_place(v, keys, last=way < 0)
    if how:
        x, _, own = _sought(v, keys)
        first: dict[object, int] = {}
        for i, k in own if way > 0 else own[::-1]:
            first.setdefault(k, i)
        ranked = sorted(first, reverse=how > 0)
        if ranked:
            beyond = F.size(F.filter(F.array(*map(F.lit, ranked)), lambda k: k < x if how < 0 else k > x))
            place = F.coalesce(place, _at([first[k] for k in ranked], beyond))
    return _picked(values, place, v.err, missing)


@function("INDEX")
def _index(table: Val, row: Val, col: Val | None = None) -> Val:
    t = _table(table)
    if col is None and len(t) > 1 and len(t[0]) > 1:
        raise Unsupported("INDEX of a whole row")
    values = [r[0] for r in t] if col is None and len(t[0]) == 1 else t[0] if col is None else None
    if values is None:
        at = _part(k := int(_given(col, (int, float), 1)), len(t[0]))
        if at is None:
            return error(VALUE if k < 1 else REF)
        values = [r[at] for r in t]
    n = number(row)
    k = F.floor(n.col).cast("int")
    fits = F.when((k >= 1) & (k <= len(values)), k)
    out = _picked(values, fits, n.err)
    return Val(out.kind, out.col, first_error(n.err, flag(k < 1, VALUE), flag(k > len(values), REF)), nullable=out.nullable)


def compile_tree(tree, cell: Callable[[Cell], Val], name: Callable[[str], Val], table: Callable[[Range], list[list[object]]] | None = None) -> Val:
    """A formula tree as a value; ``cell`` and ``name`` give references their columns, ``table`` a fixed range its values."""
    go = lambda t: compile_tree(t, cell, name, table)
    match tree:
        case P.Literal(v):
            return literal(v)
        case P.ErrorLiteral(label):
            return error(label)
        case P.Name(n):
            return name(n)
        case P.Ref(c):
            return cell(c)
        case P.RangeRef(r) if table is not None and r.first.fixed_row and r.last.fixed_row:
            cells = tuple(tuple(row) for row in table(r))
            return Val("array", items=tuple(literal(v) for row in cells for v in row), cells=cells)
        case P.RangeRef(r):
            top, left, bottom, right = r.box()
            return Val("array", items=tuple(cell(Cell(i, j, sheet=r.first.sheet)) for i in range(top, bottom + 1) for j in range(left, right + 1)))
        case P.Unary("%", arg):
            return operate("/", go(arg), literal(100))
        case P.Unary("-", P.Literal(v)) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return literal(-v)
        case P.Unary("-", arg):
            n = number(go(arg))
            return Val("num", -n.col, n.err)
        case P.Unary("+", arg):
            return number(go(arg))
        case P.Binary(op, a, b):
            return operate(op, go(a), go(b))
        case P.Call(fn, args):
            if fn not in FUNCTIONS:
                return error(NAME)
            try:
                return FUNCTIONS[fn](*[go(a) for a in args])
            except TypeError:
                return error(VALUE)
    raise GridError(f"can't compile {tree!r}")


def formula(text_: str, schema: T.StructType, row: int = 0, table: Callable[[Range], list[list[object]]] | None = None) -> Val:
    """A formula over one row: names are columns; A1 references must point into the formula's own ``row`` (0-based), but for
    ranges with fixed rows, whose values ``table`` gives."""

    def of_name(n: str) -> Val:
        return from_column(F.col(f"`{n}`"), schema[n].dataType) if n in schema.names else error(NAME)

    def of_cell(c: Cell) -> Val:
        if c.offset_row or c.offset_col:
            c = c.at(row, 0)
        if c.row != row:
            raise Unsupported("a lifted formula refers to its own row only")
        return of_name(schema.names[c.col]) if c.col < len(schema.names) else error(REF)

    return compile_tree(P.parse(text_), of_cell, of_name, table)


def shown(v: Val) -> Column:
    """Cell mode: the value, or the label of its error, as text where there can be an error."""
    return v.col if v.err is None else F.coalesce(v.err, text(v).col)


def strict(v: Val) -> Column:
    """Script mode: an error stops the query."""
    return v.col if v.err is None else F.when(v.err.isNotNull(), F.raise_error(v.err).cast({"num": "double", "int": "bigint", "bool": "boolean", "text": "string"}.get(v.kind, "string"))).otherwise(v.col)
