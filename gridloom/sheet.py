"""Sheets and books: named, ordered tables over lazy DataFrames.

A :class:`Sheet` is a frame with an order key per row; its header is the frame's column names, never a row. Relational verbs (choosing,
mapping, filtering, joining, appending, merging) return a new sheet and run nothing: they filter keys or put them together. What
speaks of row numbers (cells, ranges, ``zip``, row edits) needs contiguous ones, which are made once per sheet by writing it in
order (:attr:`Sheet.df`); ``sort`` and ``top`` do so too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DuplicateColumn, GridError, OutOfBounds
from .functions import columns as C
from .operators import joins, quality, rows
from .operators.keys import need, text_of
from .operators.ordering import KEY, ROW, before, beside, by, keyed, number_rows
from .plans.addresses import Range, parse_cell, parse_range
from .plans.grid import Grid, lift
from .sources import files


@dataclass(frozen=True)
class Sheet:
    body: DataFrame  # the cells, and either row numbers (ROW) or an order key (KEY)
    name: str = "Sheet1"
    named: bool = True

    # making one

    @classmethod
    def of(cls, df: DataFrame, name: str = "Sheet1", named: bool = True) -> Sheet:
        return cls(df if ROW in df.columns or KEY in df.columns else keyed(df), name, named)

    @classmethod
    def from_data(cls, spark: SparkSession, data: list[list[object]], headers: bool = False, name: str = "Sheet1") -> Sheet:
        return cls.of(files.from_rows(spark, data, headers), name, headers)

    @classmethod
    def from_records(cls, spark: SparkSession, records: list[dict], name: str = "Sheet1") -> Sheet:
        return cls.of(files.from_records(spark, records), name)

    @classmethod
    def read(cls, spark: SparkSession, path: str, sheet: str | None = None, **options) -> Sheet:
        got = files.read(spark, path, sheet, **options)
        df = next(iter(got.values())) if isinstance(got, dict) else got
        return cls.of(files.in_file_order(df) if files.extension(path) in ("csv", "tsv", "txt", "json", "jsonl", "ndjson", "parquet") else df, sheet or files.stem(path))

    def _with(self, df: DataFrame) -> Sheet:
        return replace(self, body=df)

    @property
    def order(self) -> str:
        return ROW if ROW in self.body.columns else KEY

    @cached_property
    def df(self) -> DataFrame:
        """The rows with contiguous numbers from 0 (ROW)."""
        return self.body if self.order == ROW else number_rows(self.ordered)

    @property
    def numbered(self) -> Sheet:
        return self._with(self.df)

    @property
    def keyed(self) -> DataFrame:
        """The rows with their order key (KEY)."""
        return self.body if self.order == KEY else self.body.withColumn(KEY, F.array(F.col(ROW).cast("long"))).drop(ROW)

    @property
    def ordered(self) -> DataFrame:
        """The cells, sorted."""
        return self.body.orderBy(self.order).drop(self.order)

    def _for(self, *parts: object) -> Sheet:
        """With row numbers, if an expression speaks of them."""
        return self.numbered if any(ROW in str(p) for p in parts) else self

    # looking at it

    @property
    def columns(self) -> list[str]:
        return [c for c in self.body.columns if c not in (ROW, KEY)]

    @property
    def frame(self) -> DataFrame:
        """The rows without their numbers."""
        return self.body.drop(self.order)

    def row_count(self) -> int:
        return self.body.count()

    def column_count(self) -> int:
        return len(self.columns)

    def is_empty(self) -> bool:
        return not self.body.take(1)

    def rows(self) -> list[list[object]]:
        return [[r[c] for c in self.columns] for r in self.ordered.collect()]

    def records(self) -> list[dict]:
        return [{c: r[c] for c in self.columns} for r in self.ordered.collect()]

    def each(self) -> Iterator[dict]:
        """Rows one after the other, a partition at a time."""
        for r in self.ordered.toLocalIterator():
            yield {c: r[c] for c in self.columns}

    def to_pandas(self):
        return self.ordered.toPandas()

    def row(self, i: int) -> dict:
        """A row by number; negative ones count from the end."""
        n = i if i >= 0 else self.row_count() + i
        got = self.df.where(F.col(ROW) == n).first()
        if n < 0 or got is None:
            raise OutOfBounds(f"no row {i}")
        return {c: got[c] for c in self.columns}

    def cell(self, row: int, column: int | str) -> object:
        name = column if isinstance(column, str) else self._name(column)
        need(self.body, [name])
        return self.row(row)[name]

    def _name(self, j: int) -> str:
        if not 0 <= j < len(self.columns):
            raise OutOfBounds(f"no column {j}")
        return self.columns[j]

    def a1(self, address: str) -> object:
        """The value at a cell, or the sheet of a range. Row 1 is the header of a named sheet."""
        if ":" in address:
            return self.range(address)
        c = parse_cell(address)
        if self.named and c.row == 0:
            return self._name(c.col)
        return self.cell(c.row - self.named, self._name(c.col))

    def range(self, address: str) -> Sheet:
        top, left, bottom, right = parse_range(address).box()
        if right >= len(self.columns):
            raise OutOfBounds(f"{address} is wider than the sheet")
        first, last = top - self.named, bottom - self.named
        if last >= self.df.count():
            raise OutOfBounds(f"{address} is longer than the sheet")
        out = self.df.where(F.col(ROW).between(max(first, 0), last)).select(*[f"`{c}`" for c in self.columns[left : right + 1]], (F.col(ROW) - max(first, 0)).alias(ROW))
        return self._with(out)

    def column(self, name: str) -> list[object]:
        need(self.body, [name])
        return [r[0] for r in self.ordered.select(f"`{name}`").collect()]

    # columns

    def select(self, *names: str) -> Sheet:
        need(self.body, list(names))
        return self._with(self.body.select(*[f"`{n}`" for n in names], self.order))

    def remove(self, *names: str) -> Sheet:
        need(self.body, list(names))
        return self._with(self.body.drop(*names))

    def remove_at(self, *places: int) -> Sheet:
        return self.remove(*[self._name(j) for j in places])

    def filter_columns(self, keep: Callable[[int, str], bool]) -> Sheet:
        return self.select(*[c for j, c in enumerate(self.columns) if keep(j, c)])

    def rename(self, old: str, new: str) -> Sheet:
        need(self.body, [old])
        if new in self.columns and new != old:
            raise DuplicateColumn(f"there is a column {new!r} already")
        return self._with(self.body.withColumnRenamed(old, new))

    def with_column(self, name: str, value: Column) -> Sheet:
        s = self._for(value)
        return s._with(s.body.withColumn(name, value).select(*[f"`{c}`" for c in dict.fromkeys([*self.columns, name])], s.order))

    def insert_column(self, at: int, name: str, value: Column) -> Sheet:
        """A new column before the one at ``at`` (counted from 0)."""
        if name in self.columns:
            raise DuplicateColumn(f"there is a column {name!r} already")
        if not 0 <= at <= len(self.columns):
            raise OutOfBounds(f"no column {at}")
        return self.with_column(name, value).select(*self.columns[:at], name, *self.columns[at:])

    def with_formula(self, name: str, formula: str) -> Sheet:
        """A column computed by a formula over the row's columns."""
        v = C.formula(formula, self.frame.schema)
        return self.with_column(name, C.shown(v))

    def fill_down(self, name: str, formula: str, row: int = 1, others: dict[str, Sheet] | None = None, most: int = 10_000) -> Sheet:
        """A formula in A1 style, as it stands in the sheet's row ``row`` (0 is the header), over every row.

        Ranges with fixed rows (``$A$1:$B$9``, also of ``others``: ``rates!$A$1:$B$9``) are read once, as a lookup's table; they may
        have ``most`` cells. Larger tables are joined (:mod:`gridloom.operators.lookup`).
        """

        def table(r: Range) -> list[list[object]]:
            top, left, bottom, right = r.box()
            if (bottom - top + 1) * (right - left + 1) > most:
                raise GridError(f"{r.text()} has more than {most} cells")
            if r.first.sheet and r.first.sheet not in (others or {}):
                raise GridError(f"no sheet {r.first.sheet!r}")
            s = others[r.first.sheet] if r.first.sheet else self
            return s.range(Range(replace(r.first, sheet=None), replace(r.last, sheet=None)).text()).rows()

        body = lift(self.body.select(*[f"`{c}`" for c in self.columns], self.order), name, formula, row, table)
        return self._with(body.select(*[f"`{c}`" for c in dict.fromkeys([*self.columns, name])], self.order))

    def name_columns_by_row(self, at: int) -> Sheet:
        """The cells of a row become the column names; the row goes, all others are text as sheets show it."""
        names = [str(v) if v is not None else "" for v in self.select(*self.columns)._as_text().row(at).values()]
        if len(set(names)) < len(names):
            raise DuplicateColumn(f"row {at} names a column twice")
        rest = self._as_text().remove_rows(at if at >= 0 else self.row_count() + at)
        return replace(rest, body=rest.body.toDF(*names, rest.order), named=True)

    def _as_text(self) -> Sheet:
        return self._with(self.df.select(*[text_of(F.col(f"`{c}`"), self.body.schema[c].dataType).alias(c) for c in self.columns], ROW))

    def row_named(self, column: str, name: object) -> dict:
        """The first row whose cell in ``column`` (the column of row names) shows as ``name`` does."""
        need(self.body, [column])
        got = self.body.where(text_of(F.col(f"`{column}`"), self.body.schema[column].dataType) == F.lit(str(name))).orderBy(self.order).first()
        if got is None:
            raise OutOfBounds(f"no row {name!r}")
        return {c: got[c] for c in self.columns}

    def set_row_named(self, column: str, name: object, **cells: object) -> Sheet:
        """Cells of every row whose cell in ``column`` shows as ``name`` does."""
        need(self.body, [column, *cells])
        hit = text_of(F.col(f"`{column}`"), self.body.schema[column].dataType) == F.lit(str(name))
        kinds = {c: self.body.schema[c].dataType for c in cells}
        return self._with(self.body.withColumns({c: F.when(hit, F.lit(v).cast(kinds[c])).otherwise(F.col(f"`{c}`")) for c, v in cells.items()}))

    def with_values(self, name: str, values: list[object]) -> Sheet:
        """A column of given values, one per row."""
        if len(values) != self.row_count():
            raise GridError(f"{len(values)} values for {self.row_count()} rows")
        col = number_rows(files.from_rows(self.body.sparkSession, [[name], *[[v] for v in values]]))
        rest = self.df.drop(name)
        return self._with(rest.join(col, ROW).select(*[f"`{c}`" for c in dict.fromkeys([*self.columns, name])], ROW))

    def map(self, op: str | Callable[[Column], Column], columns: Iterable[str] | None = None, at: str | None = None) -> Sheet:
        """upper, lower, trim, or a function of a column, over text cells; ``at``: only inside a range."""
        f = {"upper": F.upper, "lower": F.lower, "trim": quality.strip}.get(op) if isinstance(op, str) else op
        if f is None:
            raise GridError(f"unknown operation {op!r}")
        names, inside = list(columns or self.columns), F.lit(True)
        if at is not None:
            top, left, bottom, right = parse_range(at).box()
            if right >= len(self.columns):
                raise OutOfBounds(f"{at} is wider than the sheet")
            names = [c for c in self.columns[left : right + 1] if c in names]
            inside = F.col(ROW).between(top - self.named, bottom - self.named)
        kinds = dict(self.body.dtypes)
        if isinstance(op, str):
            names = [n for n in names if kinds[n] == "string"]
        s = self._for(inside)
        return s._with(s.body.withColumns({n: F.when(inside, f(F.col(f"`{n}`"))).otherwise(F.col(f"`{n}`")) for n in names}) if names else s.body)

    # rows

    def where(self, condition: Column | str) -> Sheet:
        s = self._for(condition)
        return s._with(s._sparse(s.body.where(condition)))

    def _sparse(self, df: DataFrame) -> DataFrame:
        """Rows were taken out: their numbers are but an order now."""
        return self._with(df).keyed

    def filter_rows(self, column: str, value: object) -> Sheet:
        """Rows whose cell has that type and value."""
        need(self.body, [column])
        kind = dict(self.body.dtypes)[column]
        fits = {bool: {"boolean"}, int: {"bigint", "int", "smallint", "tinyint"}, float: {"double", "float"}, str: {"string"}}.get(type(value))
        if value is not None and kind not in (fits or set()):
            return self._with(self.body.limit(0))
        return self.where(F.col(f"`{column}`").eqNullSafe(F.lit(value)))

    def remove_rows(self, *numbers: int) -> Sheet:
        return self.where(~F.col(ROW).isin(*numbers))

    def remove_empty_rows(self) -> Sheet:
        return self._with(self._sparse(rows.remove_empty_rows(self.body, self.order)))

    def sort(self, *names: str, descending: bool | tuple[bool, ...] = False) -> Sheet:
        """By columns (nulls last, descending first); rows alike keep their order."""
        need(self.body, list(names))
        down = descending if isinstance(descending, tuple) else (descending,) * len(names)
        return self._with(number_rows(self.body.orderBy(*[by(n, d) for n, d in zip(names, down, strict=True)], self.order).drop(self.order)))

    def take(self, n: int, offset: int = 0) -> Sheet:
        """The first rows."""
        out = self.body.orderBy(self.order)
        return self._with(self._sparse((out.offset(offset) if offset else out).limit(n)))

    def top(self, n: int, *names: str, descending: bool = True) -> Sheet:
        """The first ``n`` rows of ``sort``, without sorting the rest."""
        need(self.body, list(names))
        return self._with(number_rows(self.body.orderBy(*[by(x, descending) for x in names], self.order).limit(n).drop(self.order)))

    def update_row(self, at: int, *values: object) -> Sheet:
        self.row(at)
        one, n = self._one(values).body.first(), at if at >= 0 else self.row_count() + at
        return self._with(self.df.withColumns({c: F.when(F.col(ROW) == n, F.lit(one[c]).cast(self.body.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c in self.columns}))

    def append_row(self, *values: object) -> Sheet:
        return self.append(self._one(values))

    def insert_row(self, at: int, *values: object) -> Sheet:
        if not 0 <= at <= self.row_count():
            raise OutOfBounds(f"no row {at}")
        one = self._one(values).body.withColumn(ROW, F.lit(at).cast("bigint"))
        moved = self.df.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + 1).otherwise(F.col(ROW)))
        return self._with(moved.unionByName(one))

    def _one(self, values) -> Sheet:
        if len(values) != len(self.columns):
            raise GridError(f"{len(values)} cells for {len(self.columns)} columns")
        return Sheet(self.body.sparkSession.createDataFrame([(*values, 0)], self.frame.select(*[f"`{c}`" for c in self.columns], F.lit(0).cast("bigint").alias(ROW)).schema), self.name, self.named)

    def set(self, address: str, value: object) -> Sheet:
        c = parse_cell(address)
        return self.set_at(c.row - self.named, self._name(c.col), value)

    def set_at(self, row: int, column: str, value: object) -> Sheet:
        need(self.body, [column])
        kind = self.body.schema[column].dataType
        return self._with(self.df.withColumn(column, F.when(F.col(ROW) == row, F.lit(value).cast(kind)).otherwise(F.col(f"`{column}`"))))

    # whole sheets

    def join(self, other: Sheet, on: str | tuple[str, str], how: str = "inner", keys: str = "text") -> Sheet:
        """Rows in the left's order, for each the right's; then the right's unmatched ones."""
        left, right = self.keyed.withColumnRenamed(KEY, "__l"), other.keyed.withColumnRenamed(KEY, "__r")
        out = joins.join(left, right, on, how, keys)
        return Sheet(out.withColumn(KEY, beside("__l", "__r")).drop("__l", "__r"), self.name)

    def append(self, other: Sheet) -> Sheet:
        if not self.columns:
            return other
        low = other.keyed if self.named else other.keyed.select(*[f"`{c}`" for c in other.columns], KEY).toDF(*self.columns, KEY)
        return self._with(rows.append(self.keyed.withColumn(KEY, before(True)), low.withColumn(KEY, before(False))))

    def append_distinct(self, other: Sheet, key: str) -> Sheet:
        return self._with(rows.append_distinct(self.keyed.withColumn(KEY, before(True)), other.keyed.withColumn(KEY, before(False)), key, KEY))

    def upsert(self, other: Sheet, key: str) -> Sheet:
        source = other.keyed.withColumn(KEY, before(False)).withColumnRenamed(KEY, "__s")
        return self._with(rows.upsert(self.keyed.withColumn(KEY, before(True)), source, key, KEY, "__s"))

    def zip(self, other: Sheet) -> Sheet:
        if self.row_count() != other.row_count():
            raise GridError("sheets of different heights can't stand side by side")
        out = joins.zip_columns(self.df, other.df, ROW, ROW)
        return self._with(out.select(*[f"`{c}`" for c in out.columns if c != ROW], ROW))

    def transpose(self, most: int = 10_000) -> Sheet:
        """Rows to columns ``column_0``..., cells as text where types differ."""
        n = self.row_count()
        if n > most:
            raise GridError(f"{n} rows would become columns; the limit is {most}")
        kinds = {self.body.schema[c].dataType for c in self.columns}
        cell = (lambda c: F.col(f"`{c}`")) if len(kinds) == 1 else (lambda c: text_of(F.col(f"`{c}`"), self.body.schema[c].dataType))
        long = self.df.select(ROW, F.posexplode(F.array(*[cell(c) for c in self.columns])).alias("__c", "__v"))
        wide = long.groupBy("__c").pivot(ROW, list(range(n))).agg(F.first("__v"))
        return replace(self, body=wide.select(*[F.col(f"`{i}`").alias(f"column_{i}") for i in range(n)], F.col("__c").cast("bigint").alias(ROW)), named=False)

    def remove_duplicates(self, *columns: str) -> Sheet:
        return self._with(self._sparse(rows.remove_duplicates(self.body, list(columns), self.order)))

    def clean(self, *ops: str, fill: object = None, at: str | None = None) -> Sheet:
        how = quality.Cleaning.of(*ops, fill=fill)
        if at is None:
            return self._with(quality.clean(self.body, how, self.columns))
        top, left, bottom, right = parse_range(at).box()
        return self._with(quality.clean(self.df, how, self.columns[left : right + 1], F.col(ROW).between(top - self.named, bottom - self.named)))

    def invalid(self, column: str, rule: str, **how) -> list[int]:
        """Row numbers whose cell breaks the rule, as spreadsheet rows count: with the header for a named sheet."""
        got = quality.failures(self.df, column, rule, ROW, **how).orderBy(ROW).collect()
        return [r[0] + self.named for r in got]

    def evaluate(self, formula: str) -> object:
        """A formula over the sheet's cells (A1 addresses), on the driver."""
        from .functions.scalar import Err
        from .plans.grid import evaluate_once

        v = evaluate_once(formula, self.cells(), self.name)
        return str(v) if isinstance(v, Err) else v

    def cells(self) -> list[list[object]]:
        return ([self.columns] if self.named else []) + self.rows()

    def aggregate(self, name: str, address: str | None = None) -> float | int | None:
        """SUM, AVERAGE, MIN, MAX or COUNT over the numbers of a range (the whole sheet): one pass, no cells on the driver."""
        s = self if address is None else self.range(address)
        kinds = dict(s.body.dtypes)
        nums = [c for c in s.columns if kinds[c] in ("double", "float", "bigint", "int", "smallint", "tinyint") or kinds[c].startswith("decimal")]
        parts = [F.struct(F.sum(F.col(f"`{c}`").cast("double")), F.count(f"`{c}`"), F.min(F.col(f"`{c}`").cast("double")), F.max(F.col(f"`{c}`").cast("double"))) for c in nums]
        got = [tuple(x) for x in s.body.agg(*parts).first()] if nums else []
        total, n = sum(g[0] or 0.0 for g in got), sum(g[1] for g in got)
        match name.upper():
            case "SUM":
                return float(total)
            case "COUNT":
                return n
            case "AVERAGE" | "AVG":
                return total / n if n else "#DIV/0!"
            case "MIN":
                return min((g[2] for g in got if g[1]), default="#VALUE!")
            case "MAX":
                return max((g[3] for g in got if g[1]), default="#VALUE!")
        raise GridError(f"no aggregate {name}")

    def recalculated(self) -> Sheet:
        """Formula cells (text that begins with =) replaced by their values. For sheets that fit on the driver."""
        g = Grid({self.name: self.cells()})
        g.recalculate()
        return Sheet.of(files.from_rows(self.body.sparkSession, g.values(self.name), self.named), self.name, self.named)

    def query(self, sql: str, view: str = "sheet") -> DataFrame:
        self.frame.createOrReplaceTempView(view)
        return self.body.sparkSession.sql(sql)

    def write(self, path: str, mode: str = "overwrite", key: str | None = None) -> None:
        files.write(self.ordered, path, mode, key)

    def to_json(self, pretty: bool = False) -> str:
        return files.json_text(self.ordered, pretty)


@dataclass
class Book:
    """Sheets by name, in order, one of them active."""

    sheets: dict[str, Sheet] = field(default_factory=dict)
    name: str = "Book1"
    active: str | None = None

    @classmethod
    def read(cls, spark: SparkSession, *paths: str, **options) -> Book:
        book = cls()
        for p in paths:
            if files.extension(p) in ("xlsx", "xlsm"):
                got = files.read_workbook(spark, p, options.get("has_headers", options.get("headers", True)))
            else:
                got = files.read(spark, p, **options)
                got = got if isinstance(got, dict) else {files.stem(p): got}
            book = book.merge(cls({n: Sheet.of(df, n) for n, df in got.items()}))
        return book

    @classmethod
    def read_dir(cls, spark: SparkSession, path: str, **how) -> Book:
        return cls({n: Sheet.of(df, n) for n, df in files.read_csv_dir(spark, path, **how).items()})

    def names(self) -> list[str]:
        return list(self.sheets)

    def get(self, key: str | int) -> Sheet:
        if isinstance(key, int):
            if not -len(self.sheets) <= key < len(self.sheets):
                raise OutOfBounds(f"no sheet {key}")
            return list(self.sheets.values())[key]
        if key not in self.sheets:
            raise GridError(f"no sheet {key!r}")
        return self.sheets[key]

    def add(self, name: str, sheet: Sheet) -> Book:
        if name in self.sheets:
            raise GridError(f"there is a sheet {name!r} already")
        return Book({**self.sheets, name: replace(sheet, name=name)}, self.name, self.active)

    def remove(self, name: str) -> Book:
        self.get(name)
        return Book({n: s for n, s in self.sheets.items() if n != name}, self.name, self.active if self.active != name else None)

    def rename(self, old: str, new: str) -> Book:
        self.get(old)
        if new in self.sheets and new != old:
            raise GridError(f"there is a sheet {new!r} already")
        return Book({new if n == old else n: replace(s, name=new) if n == old else s for n, s in self.sheets.items()}, self.name, new if self.active == old else self.active)

    def merge(self, other: Book) -> Book:
        out = dict(self.sheets)
        for n, s in other.sheets.items():
            new, k = n, 0
            while new in out:
                k += 1
                new = f"{n}_{k}"
            out[new] = replace(s, name=new)
        return Book(out, self.name, self.active)

    def active_sheet(self) -> Sheet:
        return self.get(self.active) if self.active else self.get(0)

    def consolidate(self, source_column: str | None = None) -> Sheet:
        if any(not s.named for s in self.sheets.values()):
            raise GridError("only sheets with column names can be consolidated")
        return Sheet.of(rows.consolidate({n: s.ordered for n, s in self.sheets.items()}, source_column), "consolidated")

    def write(self, path: str) -> None:
        spark = self.get(0).body.sparkSession
        from .sources.xlsx import write_book

        files.put_bytes(spark, path, write_book({n: s.cells() for n, s in self.sheets.items()}))


__all__ = ["Book", "Sheet"]
