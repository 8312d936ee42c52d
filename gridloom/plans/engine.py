"""The raw SQL engine: frames and files as tables by name, any Spark SQL over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GridError
from ..lang.interpreter import ordered
from ..sources import files


class SqlEngine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: set[str] = set()

    def register_table(self, name: str, df: DataFrame) -> str:
        """A lazy view: filters and columns still reach the files behind it."""
        if not df.columns:
            raise GridError("a table has at least one column")
        df.createOrReplaceTempView(name)
        self.names.add(name)
        return name

    def register_file(self, path: str, name: str | None = None) -> str:
        """csv, json, ndjson, parquet, xlsx, toon; an unknown extension is read as CSV. Named by its stem."""
        kind = files.extension(path)
        df = files.read(self.spark, path) if kind in ("csv", "tsv", "json", "jsonl", "ndjson", "parquet", "xlsx", "toon") else files.read_csv(self.spark, path)
        return self.register_table(name or re.sub(r"\W", "_", files.stem(path)), df)

    register_csv = register_json = register_parquet = register_file

    def deregister_table(self, name: str) -> None:
        if name not in self.names:
            raise GridError(f"no table {name}")
        self.spark.catalog.dropTempView(name)
        self.names.discard(name)

    def create_function(self, name: str, params: str, returns: str, body: str) -> None:
        """A function written in SQL (``params``: "x double, y double"); Spark inlines its body into the plan."""
        self.spark.sql(f"create or replace temporary function {name}({params}) returns {returns} return {body}")

    def register_aggregate(self, name: str, f: Callable[..., object], returns: str) -> None:
        """An aggregate of Python: ``f`` gets the column's values of a group as a pandas series (a group must fit in a task)."""

        def one(*cols: pd.Series) -> float:
            return f(*cols)

        self.spark.udf.register(name, F.pandas_udf(one, returns))

    def register_table_function(self, name: str, rows: Callable[..., Iterator[tuple]], returns: str) -> None:
        """A function to be used in FROM or LATERAL: ``rows`` gives the rows for its arguments; ``returns``: "k int, v string"."""

        class Rows:
            def eval(self, *args):
                yield from rows(*args)

        self.spark.udtf.register(name, F.udtf(Rows, returnType=returns))

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(ordered(sql))
