"""From text cells to typed columns: one pass over the data decides, casts do the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT, FLOAT = r"^[+-]?\d{1,19}$", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


@dataclass(frozen=True)
class Words:
    """What a format reads as null, true and false; ``zeros``: a leading zero keeps a number text."""

    null: tuple[str, ...] = ("",)
    true: tuple[str, ...] = ("true",)
    false: tuple[str, ...] = ("false",)
    zeros: bool = False


CSV = Words(true=("true", "yes"), false=("false", "no"))
TOON = Words(null=("", "null"))
MARKDOWN = Words(null=("", "null", "n/a"))
HTML = Words(null=("", "null", "none"), true=("true", "yes", "y", "t"), false=("false", "no", "n", "f"), zeros=True)


def cell(c: Column, words: Words) -> tuple[Column, Column]:
    """(trimmed text, kind: null, bool, int, float, formula or text)."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    low = F.lower(t)
    number = t.try_cast("bigint").isNotNull() & t.rlike(INT)
    if words.zeros:
        number = number & ~t.rlike(r"^[+-]?0\d")
    kind = (
        F.when(c.isNull() | low.isin(*words.null), "null").when(t.startswith("="), "formula").when(low.isin(*words.true, *words.false), "bool")
        .when(number, "int").when(low.rlike("(?i)" + FLOAT) & (~t.rlike(r"^[+-]?0\d") if words.zeros else F.lit(True)), "float").otherwise("text")
    )
    return t, kind


def resolve(kinds: set[str], for_parquet: bool = False) -> str:
    """A column's type from the kinds of its cells. Numbers mixed with bools are text, in Parquet files numbers."""
    kinds = kinds - {"null"}
    if not kinds or kinds & {"text", "formula"}:
        return "string"
    if "bool" in kinds and len(kinds) > 1 and not for_parquet:
        return "string"
    return "double" if "float" in kinds else "bigint" if "int" in kinds else "boolean"


def infer(df: DataFrame, words: Words = CSV, columns: list[str] | None = None, for_parquet: bool = False) -> DataFrame:
    """Text columns cast to what all their cells are."""
    names = [n for n in (columns or df.columns) if dict(df.dtypes)[n] == "string"]
    if not names:
        return df
    seen = df.agg(*[F.collect_set(cell(F.col(f"`{n}`"), words)[1]).alias(f"k{i}") for i, n in enumerate(names)]).first()  # at most six words a column
    out = {}
    for i, n in enumerate(names):
        t, kind = cell(F.col(f"`{n}`"), words)
        to = resolve(set(seen[i]), for_parquet)
        if to == "boolean":
            new = F.when(kind == "bool", F.lower(t).isin(*words.true))
        elif to in ("bigint", "double"):
            new = F.when(kind == "bool", F.lower(t).isin(*words.true).cast("int").cast(to)).when(kind != "null", t.try_cast(to))
        else:
            new = F.when(kind != "null", F.col(f"`{n}`"))
        out[n] = new
    return df.select(*[out[n].alias(n) if n in out else F.col(f"`{n}`") for n in df.columns])
