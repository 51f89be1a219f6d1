"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it (tests) gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillgrid.scratch.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("quillgrid.scratch.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: what follows is planned, and recovers, from there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_large(df: DataFrame, label: str) -> DataFrame:
    """The same for tables that grow with the rows while their texts repeat; joins with them are merge joins.

    Their files are a hundredth of their rows and less. The planner would take these bytes for
    the size and collect millions of rows on the driver to broadcast them.
    """
    return materialise(df, label).hint("merge")


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession, limit: int = 8000) -> Iterator[None]:
    """Jobs that run inside fuse operators only where the JVM compiles the result.

    It leaves methods of over 8000 bytes to its interpreter. Plans with as many expressions
    as a sheet's rows need take half the time when their operators stay apart.
    """
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, limit)
    try:
        yield
    finally:
        spark.conf.unset(METHOD_LIMIT) if before is None else spark.conf.set(METHOD_LIMIT, before)
