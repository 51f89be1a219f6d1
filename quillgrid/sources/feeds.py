"""Feeds, link lists and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "name string, url string, credit string, links_work int, updated int, best boolean"
REPORT = "sheet_id string, name string, status string, n_eras bigint, n_songs bigint, issues array<struct<check:string,severity:string,details:array<string>>>"


def read_discovery(spark: SparkSession, path: str, best_only: bool = False, name_like: str | None = None, limit: int | None = None, strict: bool = False, drop_documents: bool = True) -> DataFrame:
    """A feed of one JSON object a line; blank and malformed lines are dropped, or fail if ``strict``.

    ``limit`` takes the first in the feed's order: by file, then by place in it.
    """
    feed = spark.read.schema(FEED).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if limit is not None:
        # partitions hold stretches of files: numbers that rise with the place, file by file
        feed = feed.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if drop_documents:
        feed = feed.filter(~F.coalesce(F.col("url").contains("docs.google.com/document"), F.lit(False)))
    if best_only:
        feed = feed.filter("best")
    if name_like:
        feed = feed.filter(F.lower("name").contains(name_like.lower()))
    return feed if limit is None else feed.orderBy("_file", "_block", "_at").limit(limit).drop("_file", "_block", "_at")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``(url)`` of a text file: one a line; blank lines and comments left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON record a sheet."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Passed records of an earlier report; none if it cannot be found."""
    try:
        return spark.read.schema(REPORT).json(path).filter(F.col("status").isin("ok", "warn"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], REPORT)
