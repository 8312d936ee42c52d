"""A JSON array of objects in one file, read and written by the executors.

Reading: Spark deals the file out in pieces, each up to a ``}``. What a split does to the nesting depends only on whether it
begins inside a string, so one scan finds that for both cases and the driver chains the answers (two numbers a split). Then
every split knows where its objects end. An object that lies across splits is put together on the driver, one a split.
A second scan finds the kinds of the columns, a third writes typed rows to the shared folder, a part per split, in order.

Writing: every partition's text is written beside the others, and the files are copied one after the other.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GridError
from .shared import fresh_path, written
from .tables import header_names

_ESCAPED = re.compile(r"\\.", re.S)
_WRONG = "a JSON sheet is an array of objects"
_HELD = 1_000_000


def _segments(piece: str) -> list[str]:
    """A piece cut at its quotes: every second segment is inside a string."""
    return (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')


def _opened(segments: list[str]) -> int:
    text = "".join(segments)
    return text.count("{") + text.count("[") - text.count("]")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether a string that isn't (that is) open at its begin is open at its end, and by how much the depth grows."""
    found: dict[int, list[int]] = {}
    for batch in batches:
        for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = found.setdefault(start, [0, 0, 0])  # the string is open, if none was at the begin; depth, if none was; depth, if one was
            cut = _segments(piece)
            s[1] += _opened(cut[s[0] :: 2])
            s[2] += _opened(cut[1 - s[0] :: 2])
            s[0] ^= 1 - len(cut) % 2
            s[1 + s[0]] -= 1
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k for k in found], pa.int64()), *[pa.array([s[j] for s in found.values()], pa.int64()) for j in range(3)]], names=["start", "open", "plain", "quoted"])


def _objects(batches: Iterator[pa.RecordBatch], states: dict[int, tuple[int, int]]) -> Iterator[tuple[int, bool, str]]:
    """(split, whether it ends here, text) of every object that lies in a split or across its ends, with the comma before it."""
    at, inside, depth, held = None, 0, 0, []
    for batch in batches:
        for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if start != at:
                if held:
                    yield at, False, "".join(held)
                at, (inside, depth), held = start, states[start], []
            cut = _segments(piece)
            depth += _opened(cut[inside::2])
            inside ^= 1 - len(cut) % 2
            held += piece, "}"
            if not inside:
                depth -= 1
                if depth == 1:
                    yield at, True, "".join(held)
                    held = []
    if held:
        yield at, False, "".join(held)


def _object(text: str, first: bool = False) -> dict | None:
    """The object behind the comma (or the bracket that opens the array); None if it isn't one."""
    text = text.lstrip(" \t\n\r")
    if text[:1] != ("[" if first else ","):
        return None
    try:
        value = json.loads(text[1:])
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def shown(v: object) -> object:
    return json.dumps(v) if isinstance(v, (dict, list)) else v


def _seen(value: dict, kinds: dict[str, set[type]]) -> None:
    for k, seen in kinds.items():
        if (v := value.get(k)) is not None:
            seen.add(str if isinstance(v, (dict, list)) else type(v))


def kind_of(seen: set[type]) -> T.DataType:
    """A column's type from the Python types of its cells."""
    if str in seen or not seen or bool in seen and len(seen) > 1:
        return T.StringType()
    return T.BooleanType() if bool in seen else T.DoubleType() if float in seen else T.LongType()


def cast(v: object, kind: T.DataType) -> object:
    return None if v is None else str(v) if isinstance(kind, T.StringType) and not isinstance(v, str) else float(v) if isinstance(kind, T.DoubleType) else v


def read(spark: SparkSession, path: str) -> DataFrame:
    """Columns from the first object; other keys are dropped, missing ones null."""
    lines = spark.read.option("lineSep", "}").text(path)
    if len(lines.inputFiles()) != 1:
        raise GridError(f"{path} is not one file")
    pieces = lines.select(F.col("_metadata.file_block_start").alias("start"), "value")
    states, inside, depth = {}, 0, 0
    for r in sorted(pieces.mapInArrow(_chained, "start long, open long, plain long, quoted long").collect()):
        states[r.start] = inside, depth
        inside, depth = inside ^ r.open, depth + (r.quoted if inside else r.plain)

    def survey(keys: list[str] | None) -> list:
        """A row per split: texts of the objects that end and begin beyond it, the number and kinds of those between."""
        names = ["start", "n", "head", "ends", "tail", "wrong", "kinds"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, dict] = {}
            for start, ends, text in _objects(batches, states):
                s = out.get(start)
                if s is None:
                    out[start] = {"start": start, "n": 0, "head": text, "ends": ends, "tail": "", "wrong": False, "kinds": {k: set() for k in keys or ()}}
                elif not ends:
                    s["tail"] = text
                else:
                    s["n"] += 1
                    if keys is not None and not s["wrong"]:
                        value = _object(text)
                        s["wrong"] = value is None
                        _seen(value or {}, s["kinds"])
            rows = [s | {"kinds": json.dumps([sorted(t.__name__ for t in k) for k in s["kinds"].values()])} for s in out.values()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in names], names=names)

        return sorted(pieces.mapInArrow(run, "start long, n long, head string, ends boolean, tail string, wrong boolean, kinds string").collect())

    def whole(splits: list) -> tuple[dict[int, str], str]:
        """The objects that end in a split as its first, by split; what is left behind the last one."""
        heads, carry = {}, ""
        for s in splits:
            if s.ends:
                heads[s.start], carry = carry + s.head, s.tail
            else:
                carry += s.head
        return heads, carry[:-1]  # the last piece has no } behind it

    heads, rest = whole(survey(None))
    if not heads:
        if "".join(rest.split()) != "[]":
            raise GridError(_WRONG)
        return spark.range(0).select()
    origin = min(heads)
    first = _object(heads[origin], True)
    if first is None or rest.strip(" \t\n\r") != "]":
        raise GridError(_WRONG)
    keys = list(first)
    splits = survey(keys)
    between = {s: _object(t, s == origin) for s, t in heads.items()}
    if any(s.wrong for s in splits) or None in between.values():
        raise GridError(_WRONG)
    kinds: dict[str, set[type]] = {k: set() for k in keys}
    for value in between.values():
        _seen(value, kinds)
    by_name = {t.__name__: t for t in (str, bool, int, float)}
    for s in splits:
        for k, names in zip(keys, json.loads(s.kinds), strict=True):
            kinds[k] |= {by_name[n] for n in names}
    if not keys:
        return spark.range(sum(s.n for s in splits) + len(heads)).select()
    types = [kind_of(kinds[k]) for k in keys]
    arrow = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}
    schema = T.StructType([T.StructField(f"c{j}", t) for j, t in enumerate(types)])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            cols = [pa.array([cast(shown(v.get(k)), t) for v in values], arrow[t]) for k, t in zip(keys, types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        at, values, n = None, [], 0
        for start, ends, text in _objects(batches, states):
            if start != at:
                at, text = start, heads.get(start, "")
            if ends:
                values.append(_object(text, start == origin and text is heads[origin]))
                n += len(text)
            if n >= _HELD or len(values) >= 10_000:
                yield flush()
                values, n = [], 0
        if values:
            yield flush()

    return written(pieces.mapInArrow(typed, schema), "json").toDF(*header_names(keys, len(keys)))


def clean_number(v: object) -> object:
    return str(v) if isinstance(v, float) and not math.isfinite(v) else v


def _texts(rows: Iterator, schema: T.StructType) -> Iterator[str]:
    """A partition's objects, parted by commas, in lines of about a million characters."""
    encode = json.JSONEncoder(default=str, ensure_ascii=False).encode
    nested = any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in schema)
    floats = [f.name for f in schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    held, n, some = [], 0, False
    for r in rows:
        value = r.asDict(True) if nested else dict(zip(schema.names, r, strict=True))
        for c in floats:
            value[c] = clean_number(value[c])
        held.append(encode(value))
        n += len(held[-1])
        if n >= _HELD:
            yield (", " if some else "") + ", ".join(held)
            held, n, some = [], 0, True
    if held:
        yield (", " if some else "") + ", ".join(held)


def write(df: DataFrame, path: str) -> None:
    """The rows as one file, replaced as a whole."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path
    parts = to(fresh_path(df.sparkSession, "json-parts"))
    schema = df.schema
    df.rdd.mapPartitions(lambda rows: _texts(rows, schema)).saveAsTextFile(parts.toString())
    held, where, own = parts.getFileSystem(conf), to(path), to(path + ".writing")
    fs = where.getFileSystem(conf)
    out = fs.create(own, True)
    try:
        some = False
        out.write(bytearray(b"["))
        for f in sorted((f for f in held.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: int(f.getPath().getName()[5:])):
            if some:
                out.write(bytearray(b", "))
            some, part = True, held.open(f.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
        out.write(bytearray(b"]"))
    finally:
        out.close()
    if fs.exists(where):
        fs.delete(where, True)
    fs.rename(own, where)
    held.delete(parts, True)
