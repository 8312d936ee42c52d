"""Shared-folder tables: the way every operator here cuts lineage.

Executors may be lost at any time, so intermediate tables go, as Parquet, to the
folder the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary folder is chosen
and put into the session if driver and executors are one process (local tests), and an error is raised else.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as it is written in ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with the schema it has."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned; nothing may read it afterwards."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of queries that are over: it does so when the driver has collected its garbage.

    The first collection still finds the last query held by the connection to Python; the second one lets it go.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


def free(columns: list[str], name: str) -> str:
    """``name``, or where a column has it (in any case) the first of ``name_``, ``name__``... that none has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_input(path: str):
    """A random-access file of any store that pyarrow knows, by its URI (a plain path is local)."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


def write_file(path: str, chunks) -> int:
    """Write bytes objects to ``path`` under a private name, then rename: a repeated or speculative task
    leaves one whole file. Returns the bytes written."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    where.create_dir(name.rpartition("/")[0], recursive=True)
    own, total = f"{name}.{uuid.uuid4().hex[:8]}.part", 0
    with where.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
            total += len(chunk)
    where.move(own, name)
    return total
