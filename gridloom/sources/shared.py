"""Tables written to the folder that driver and executors share.

Executors may be lost at any time, so what must not be computed twice goes, as Parquet, to the folder the cluster names in
``spark.checkpoint.dir``; where that is unset, a temporary folder is chosen and put into the session if driver and executors
are one process (local tests), and an error is raised else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with the schema it has (columns of only nulls aren't written)."""
    path = fresh_path(df.sparkSession, tag)
    void = {c for c, kind in df.dtypes if kind == "void"}
    some = df.drop(*void)
    some.write.parquet(path)
    out = df.sparkSession.read.schema(some.schema).parquet(path)
    return out.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else out
