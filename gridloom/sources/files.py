"""Readers and writers of whole files, by extension.

Large formats (CSV, JSON, JSON lines, Parquet) are read and written by Spark in place; a workbook, an HTML or a Markdown file is one
document and is parsed on the driver from bytes that Spark fetches, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import urllib.request
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GridError, Unsupported
from ..operators.keys import unique
from . import infer, jsonarray, tables, xlsx

OPTIONS = {"headers", "has_headers", "detect_headers", "page_range", "min_table_rows", "min_table_cols", "min_table_size", "extract_structure", "structure"}


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower().lstrip(".")


def stem(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise GridError(f"no file {path}")
    return bytes(row.content)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file written through Hadoop's file systems, replaced as a whole."""
    jvm = spark._jvm
    where, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".writing")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(own, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(where):
        fs.delete(where, True)
    fs.rename(own, where)


def in_file_order(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, read from files, with the order key of its rows: files by name, then place in the file.

    Spark deals out files by size, so its own order is that of one file only.
    """
    from ..operators.ordering import KEY, keyed, number_rows

    names = sorted(df.inputFiles())
    if not names:
        return keyed(df)
    at = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    if len(names) > most:
        return number_rows(df.withColumns({"__f": F.col("_metadata.file_path"), "__s": at[0], "__i": at[1]}).orderBy("__f", "__s", "__i").drop("__f", "__s", "__i"))
    if len(names) > 1:
        plain = lambda n: n.replace("file:///", "file:/")
        rank = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (plain(n), k)])
        at.insert(0, F.element_at(rank, F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/"))))
    return df.withColumn(KEY, F.array(*[c.cast("long") for c in at]))


def from_rows(spark: SparkSession, rows: list[list[object]], headers: bool = True, words: infer.Words | None = None) -> DataFrame:
    """A frame of parsed rows; text cells are typed by ``words``, typed cells by what they are."""
    width = max(map(len, rows), default=0)
    names = tables.header_names([None if v is None else str(v) for v in rows[0]], width) if headers and rows else [f"column_{j}" for j in range(width)]
    data = [list(r) + [None] * (width - len(r)) for r in (rows[1:] if headers else rows)]
    if words is not None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return infer.infer(spark.createDataFrame([[None if v is None else str(v) for v in r] for r in data], schema), words)
    kinds = [jsonarray.kind_of({type(r[j]) for r in data if r[j] is not None}) for j in range(width)]
    return spark.createDataFrame([[jsonarray.cast(v, k) for v, k in zip(r, kinds, strict=True)] for r in data], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def looks_like_header(first: list[str | None], second: list[str | None] | None) -> bool:
    """Whether a file's first row names its columns: all text, and the second row is absent or has a number or a bool, or the names read like names."""
    def kind(v: str | None) -> str:
        v = (v or "").strip()
        if not v:
            return "empty"
        try:
            float(v)
            return "number"
        except ValueError:
            return "bool" if v.lower() in ("true", "false", "yes", "no") else "text"

    if not first or any(kind(v) != "text" for v in first):
        return False
    if second is None or any(kind(v) in ("number", "bool") for v in second):
        return True
    words = {"id", "name", "date", "email", "type", "value", "amount", "price", "count", "total", "status", "key", "city", "age"}
    return any("_" in v or v.strip().lower() in words for v in first) or any(len(v or "") > 30 for v in second)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_headers: bool = True, quote: str = '"', infer_types: bool = True, detect_headers: bool = False) -> DataFrame:
    """Cells are typed as sheets do it (:mod:`.infer`), not by Spark's inference.

    Only a file in which quotes span lines (a line has an odd number of them) must be read in one piece; others are split.
    """
    odd = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))) if quote else F.lit(0)
    spans = bool(spark.read.text(path).where(odd % 2 == 1).take(1))
    r = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("multiLine", spans)
    if detect_headers:
        two = [list(x) for x in r.csv(path).head(2)]
        has_headers = bool(two) and looks_like_header(two[0], two[1] if len(two) > 1 else None)
    df = r.option("header", has_headers).option("inferSchema", False).option("mode", "FAILFAST").csv(path)
    if not has_headers:
        df = df.toDF(*[f"column_{j}" for j in range(len(df.columns))])
    else:
        unique(df.columns)
    return infer.infer(df, infer.CSV) if infer_types else df


def _first_keys(df: DataFrame, lines: DataFrame) -> list[str]:
    first = lines.where("trim(value) <> ''").first()
    return list(json.loads(first.value)) if first else df.columns


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Columns are those of the first object; nested values become JSON text."""
    df = spark.read.json(path)
    keys = _first_keys(df, spark.read.text(path))
    return flat(df.select(*[f"`{k}`" for k in keys if k in df.columns]))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return jsonarray.read(spark, path)


def flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[(F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def from_records(spark: SparkSession, records: list[dict], keys: list[str] | None = None) -> DataFrame:
    """Columns from the first record; other keys are dropped, missing ones null."""
    keys = keys or (list(records[0]) if records else [])
    return from_rows(spark, [list(keys), *[[jsonarray.shown(r.get(k)) for k in keys] for r in records]])


def from_objects(spark: SparkSession, objects: list[dict]) -> DataFrame:
    """Columns: the union of all keys in alphabetical order."""
    return from_records(spark, objects, sorted({k for o in objects for k in o}))


def read_html(spark: SparkSession, path: str, nth: int | None = 0, headers: bool | None = None):
    found = tables.html_tables(read_bytes(spark, path).decode(errors="replace"))
    if not found:
        raise GridError(f"{path} has no table")
    make = lambda t: from_rows(spark, t[0], t[1] if headers is None else headers, infer.HTML)
    return {f"table_{k}": make(t) for k, t in enumerate(found, 1)} if nth is None else make(found[nth])


def read_markdown(spark: SparkSession, path: str, min_rows: int = 2, min_cols: int = 2) -> dict[str, DataFrame]:
    found = tables.markdown_tables(read_bytes(spark, path).decode(), min_rows, min_cols)
    return {f"table_{k}": from_rows(spark, rows, True, infer.MARKDOWN) for k, rows in enumerate(found, 1)}


def read_toon(spark: SparkSession, path: str) -> DataFrame:
    _, names, rows = tables.toon_table(read_bytes(spark, path).decode())
    return from_rows(spark, [names, *rows], True, infer.TOON)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, headers: bool = True) -> DataFrame:
    return from_rows(spark, xlsx.read_sheet(read_bytes(spark, path), sheet), headers)


def read_workbook(spark: SparkSession, path: str, headers: bool = True) -> dict[str, DataFrame]:
    data = read_bytes(spark, path)
    return {n: from_rows(spark, xlsx.read_sheet(data, n), headers) for n in xlsx.sheet_names(data)}


def read(spark: SparkSession, path: str, sheet: str | None = None, **options):
    """A file by its extension; Markdown gives a dict of tables."""
    bad = set(options) - OPTIONS
    if bad:
        raise GridError(f"unknown import option {sorted(bad)[0]!r}")
    headers = options.get("has_headers", options.get("headers", True))
    detect = options.get("detect_headers", False)
    match extension(path):
        case "csv" | "tsv" | "txt" as e:
            return read_csv(spark, path, "\t" if e == "tsv" else ",", headers, detect_headers=detect)
        case "json":
            return read_json(spark, path)
        case "jsonl" | "ndjson":
            return read_jsonl(spark, path)
        case "parquet":
            return spark.read.parquet(path)
        case "xlsx" | "xlsm":
            return read_xlsx(spark, path, sheet, headers)
        case "html" | "htm":
            return read_html(spark, path, headers=None if headers is True else headers)
        case "md" | "markdown":
            size = options.get("min_table_size") or 2
            return read_markdown(spark, path, options.get("min_table_rows") or size, options.get("min_table_cols") or size)
        case "toon":
            return read_toon(spark, path)
        case "xls" | "pdf" as e:
            raise Unsupported(f".{e} files can't be read here")
        case e:
            raise GridError(f"unknown file type .{e}")


def read_csv_dir(spark: SparkSession, path: str, **how) -> dict[str, DataFrame]:
    """Every .csv and .tsv of a folder, by name."""
    names = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.[ct]sv").load(path).select("path").collect())
    return {stem(n): read_csv(spark, n, "\t" if extension(n) == "tsv" else ",", **how) for n in names}


def fetch(url: str, timeout: float = 30.0) -> object:
    """JSON from a web address."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
        if not 200 <= r.status < 300:
            raise GridError(f"{url} answered {r.status}")
        return json.loads(r.read())


def json_text(df: DataFrame, pretty: bool = False) -> str:
    rows = [{k: jsonarray.clean_number(v) for k, v in r.asDict(True).items()} for r in df.collect()]
    return json.dumps(rows, indent=2 if pretty else None, default=str, ensure_ascii=False)


def write(df: DataFrame, path: str, mode: str = "overwrite", key: str | None = None, order: str = "__row") -> None:
    """A sheet to a file (CSV, JSON lines, Parquet: a folder of Spark's) by extension.

    mode: overwrite, append, append_distinct or append_or_update (both by ``key``).
    """
    from ..operators import rows

    spark, kind = df.sparkSession, extension(path)
    body = df.drop(order)
    if mode not in ("overwrite", "append", "append_distinct", "append_or_update"):
        raise GridError(f"unknown export mode {mode!r}")
    if mode == "append" and kind in ("xlsx", "parquet", "toon"):
        raise Unsupported(f"can't append to .{kind} files")
    if mode == "append" and kind == "jsonl":
        body.write.mode("append").json(path)
        return
    if mode != "overwrite":
        old = read(spark, path)
        if kind == "json":
            from ..operators.ordering import KEY

            old = in_file_order(old).orderBy(KEY).drop(KEY)
        if mode == "append":
            if sorted(old.columns) != sorted(body.columns):
                raise GridError(f"{path} has other columns: {', '.join(old.columns)}")
            body = rows.append(old, body)
        else:
            from ..operators.ordering import number_rows

            k = key or old.columns[0]
            t, s = number_rows(old, "__t"), number_rows(body, "__s")
            body = (rows.append_distinct(t, s, k, "__s") if mode == "append_distinct" else rows.upsert(t, s, k, "__t", "__s").orderBy("__t")).drop("__t")
        if kind not in ("json", "xlsx", "toon"):
            held = path.rstrip("/") + ".new"
            _write_spark(body, held, kind)
            spark_rename(spark, held, path)
            return
    match kind:
        case "csv" | "tsv" | "jsonl" | "parquet":
            _write_spark(body, path, kind)
        case "json":
            jsonarray.write(body, path)
        case "xlsx":
            put_bytes(spark, path, xlsx.write_book({stem(path): as_rows(body)}))
        case "toon":
            put_bytes(spark, path, tables.toon_text(stem(path), body.columns, as_rows(body)[1:]).encode())
        case e:
            raise GridError(f"can't export to .{e}")


def as_rows(df: DataFrame) -> list[list[object]]:
    return [df.columns, *[list(r) for r in df.collect()]]


def spark_rename(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    fs.rename(a, b)


def _write_spark(df: DataFrame, path: str, kind: str) -> None:
    w = df.write.mode("overwrite")
    if kind == "parquet":
        w.parquet(path)
    elif kind == "jsonl":
        w.json(path)
    else:
        w.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
