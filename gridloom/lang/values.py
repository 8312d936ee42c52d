"""Operators and builtins over plain script values; no Spark, so workers can use them too."""

from __future__ import annotations

import re

from ..errors import GridError, OutOfBounds
from ..functions import scalar as S

MAX = (1 << 63) - 1


def truthy(v: object) -> bool:
    if v is None:
        return False
    if hasattr(v, "is_empty") and callable(v.is_empty):
        return not v.is_empty()
    if isinstance(v, (bool, int, float, str, list, dict)):
        return bool(v)
    return True


def kind(v: object) -> str:
    names = {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", list: "array", dict: "object"}
    return names.get(type(v), type(v).__name__.lower())


def numeric(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def equal(a: object, b: object) -> bool:
    if numeric(a) and numeric(b):
        return abs(a - b) <= 2.220446049250313e-16
    return type(a) is type(b) and not isinstance(a, list) and a == b


def text(v: object) -> str:
    return S.plain(v).lower() if isinstance(v, bool) else "" if v is None else S.plain(v)


def whole(n: int) -> int:
    if not -MAX - 1 <= n <= MAX:
        raise GridError("integer overflow")
    return n


def like(v: object, pattern: object) -> bool:
    return re.fullmatch(".*".join(map(re.escape, text(pattern).split("%"))), text(v), re.DOTALL) is not None


def binary(op: str, a: object, b: object) -> object:
    match op:
        case "=":
            return equal(a, b)
        case "<>":
            return not equal(a, b)
        case "<" | "<=" | ">" | ">=":
            if not (numeric(a) and numeric(b)):
                raise GridError(f"{op} compares numbers, not {kind(a)} and {kind(b)}")
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        case "&":
            return text(a) + text(b)
        case "like":
            return like(a, b)
        case "in":
            return any(equal(a, x) for x in b)
        case "+":
            if isinstance(a, str) or isinstance(b, str):
                return text(a) + text(b)
            if isinstance(a, list) and isinstance(b, list):
                return a + b
    if not (numeric(a) and numeric(b)):
        raise GridError(f"{op} needs numbers, not {kind(a)} and {kind(b)}")
    ints = isinstance(a, int) and isinstance(b, int)
    match op:
        case "+":
            return whole(a + b) if ints else a + b
        case "-":
            return whole(a - b) if ints else a - b
        case "*":
            return whole(a * b) if ints else a * b
        case "/":
            if b == 0:
                raise GridError("division by zero")
            return whole(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)) if ints else a / b
        case "%":
            if not ints:
                raise GridError("% needs whole numbers")
            if b == 0:
                raise GridError("division by zero")
            return abs(a) % abs(b) * (-1 if a < 0 else 1)
    raise GridError(f"unknown operator {op}")


def at(v: object, i: object) -> object:
    if isinstance(v, dict):
        if i not in v:
            raise GridError(f"no field {i!r}")
        return v[i]
    if isinstance(v, (list, str)):
        if not isinstance(i, int) or not -len(v) <= i < len(v):
            raise OutOfBounds(f"no element {i!r}")
        return v[i]
    raise GridError(f"{kind(v)} has no elements")


def filter_array(a: list, include: object, if_empty: object = "#CALC!") -> object:
    if isinstance(include, list):
        if len(include) != len(a):
            raise GridError("the mask has another length")
        out = [x for x, m in zip(a, include, strict=True) if truthy(m)]
    else:
        out = list(a) if truthy(include) else []
    return out or if_empty


def to_int(v: object) -> int:
    if isinstance(v, bool) or isinstance(v, int):
        return int(v)
    try:
        return int(v) if isinstance(v, float) else int(str(v).strip())
    except ValueError:
        raise GridError(f"int({v!r}) is no whole number") from None


def to_float(v: object) -> float:
    if isinstance(v, bool):
        raise GridError("a bool is no float")
    try:
        return float(v)
    except (TypeError, ValueError):
        raise GridError(f"float({v!r}) is no number") from None


def length(v: object) -> int:
    if isinstance(v, str):
        return len(v.encode())
    if hasattr(v, "row_count"):
        return v.row_count()
    return len(v.sheets) if hasattr(v, "sheets") else len(v)


BUILTINS = {
    "str": text, "int": to_int, "float": to_float, "type": kind, "length": length,
    "keys": lambda o: o.names() if hasattr(o, "names") else list(o), "values": lambda o: list(o.sheets.values()) if hasattr(o, "sheets") else list(o.values()),
    "filter": filter_array, "abs": lambda v: abs(v),
    # planned names, defined the plain way
    "bool": truthy, "substr": lambda s, i, n=None: s[i:] if n is None else s[i : i + n], "split": lambda s, d: s.split(d), "replace": lambda s, a, b: s.replace(a, b),
    "floor": lambda v: S.FUNCTIONS["INT"](v), "ceil": lambda v: -S.FUNCTIONS["INT"](-v), "first": lambda a: a[0] if a else None, "last": lambda a: a[-1] if a else None,
    "push": lambda a, v: [*a, v], "pop": lambda a: a[:-1], "slice": lambda a, i, j=None: a[i:j], "contains": lambda a, v: any(equal(x, v) for x in a) if isinstance(a, list) else v in a,
    "reverse": lambda a: a[::-1], "sort": lambda a: sorted(a, key=lambda x: (x is None, x)), "has": lambda o, k: k in o, "merge": lambda a, b: {**a, **b},
}


def formula(name: str, args: list) -> object:
    """A formula function from a script: an error value stops it."""
    try:
        out = S.call(name.upper(), args)
    except S.Stop as stop:
        out = stop.err
    if isinstance(out, S.Err):
        raise GridError(f"{name.upper()}: {out.label}")
    return out
