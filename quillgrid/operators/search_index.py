"""A written index for searches within texts, and a written order for pages.

The index holds the versions dealt into parts by song, for each three letters the distinct
texts that have them, dealt into parts by the letters, and for each text the parts with a song
that has it. Texts repeat from sheet to sheet, and are taken apart once. A search reads the
postings of its few rarest letters, the parts of the texts with all of them, and then only
these parts of the versions; it is then a search of their songs, with the same result as one
of the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators.search import SONG, Searches, search_many

GRAM = 3
#: Of a query's letter groups, so many of the least frequent ones are looked up.
LOOKED_UP = 4
#: Folders of versions and of postings; a search names the folders it reads.
PARTS = 256
#: So many tasks write the versions of a song, or the postings of a letter group, as either may be a large share of all.
SPREAD = 8


def _texts(versions: DataFrame) -> Column:
    """All that a search looks at, in lower case, apart by a NUL."""
    credits = [F.col(c) for c in ("featuring", "producers", "collaboration") if c in versions.columns]
    return F.lower(F.concat_ws("\0", "base_name", "name", F.array_join("alt_titles", "\0"), *credits))


def _grams(text: Column) -> Column:
    """The distinct letter groups of a text."""
    n = F.length(text) - (GRAM - 1)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """What ``build_index`` wrote under ``root``."""

    spark: SparkSession
    root: str
    parts: int
    schema: T.StructType

    def _read(self, table: str) -> DataFrame:
        # the forms are known, so that empty tables, which have no files, can be read too
        schema = {
            "versions": self.schema,
            "holders": "text_no long, text string, song_part int, text_part int",
            "postings": "text_no long, gram string, gram_part int",
            "grams": "gram string, gram_part int, texts long",
        }[table]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def versions(self) -> DataFrame:
        return self._read("versions").drop("song_no", "song_part")

    def folders(self, query: str) -> list[int] | None:
        """The folders with a text that has the query's rarest letter groups; none, for all, if it is too short to have one."""
        q = query.strip().lower()
        grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not grams:
            return None
        # as many rows as the query has groups
        found = self._read("grams").filter(F.col("gram").isin(grams)).collect()
        if len(found) < len(grams):
            return []
        rarest = [r["gram"] for r in sorted(found, key=lambda r: (r["texts"], r["gram"]))[:LOOKED_UP]]
        parts = sorted({r["gram_part"] for r in found if r["gram"] in rarest})
        met = self._read("postings").filter(F.col("gram_part").isin(parts) & F.col("gram").isin(rarest)).groupBy("text_no").agg(F.count("*").alias("n"))
        texts = met.filter(F.col("n") == len(rarest)).select("text_no", _part(F.col("text_no"), self.parts).alias("text_part"))
        # at most one number for each folder reaches the driver, here and below
        parts = [r[0] for r in texts.select("text_part").distinct().collect()]
        holders = self._read("holders").filter(F.col("text_part").isin(parts)).join(texts, ["text_part", "text_no"], "left_semi")
        return [r[0] for r in holders.select("song_part").distinct().collect()]

    def candidates(self, *queries: str) -> DataFrame:
        """The versions in the folders that hold a song that may match one of the queries."""
        rows = self._read("versions")
        named = [self.folders(q) for q in queries if q.strip()]
        if None not in named:
            rows = rows.filter(F.col("song_part").isin(sorted({p for folders in named for p in folders})))
        return rows.drop("song_no", "song_part")

    def search(self, searches: Searches) -> DataFrame:
        """``search.search_many`` of the indexed versions."""
        return search_many(self.candidates(*[query for _, query, _ in searches]), searches)


def build_index(versions: DataFrame, root: str, parts: int = PARTS) -> SearchIndex:
    """Writes the index of ``versions`` under ``root``. Null titles count as empty; versions of one song share its entries."""
    spark = versions.sparkSession
    # two songs of one number are looked up together, and told apart by the search itself
    numbered = versions.withColumn("song_no", F.xxhash64(*SONG)).withColumn("song_part", _part(F.col("song_no"), parts))
    numbered.repartition(F.col("song_part"), F.pmod(F.xxhash64("sheet_id", "row_idx"), F.lit(SPREAD))).sortWithinPartitions("song_part", "song_no").write.partitionBy("song_part").parquet(f"{root}/versions")
    index = SearchIndex(spark, root, parts, numbered.schema)
    written = index._read("versions")
    texts = written.select(_texts(written).alias("text"), "song_part").distinct().withColumn("text_no", F.xxhash64("text")).withColumn("text_part", _part(F.col("text_no"), parts))
    holders = texts.select("text_no", "text", "song_part", "text_part").repartition("text_part", F.pmod("text_no", F.lit(SPREAD)))
    holders.sortWithinPartitions("text_part", "text_no").write.partitionBy("text_part").parquet(f"{root}/holders")
    # two texts of one number are one here, with the letters of both
    pairs = index._read("holders").select("text_no", "text").distinct().select("text_no", F.explode(_grams(F.col("text"))).alias("gram"))
    pairs = pairs.select("text_no", "gram", _part(F.col("gram"), parts).alias("gram_part"), F.pmod("text_no", F.lit(SPREAD)).alias("spread"))
    pairs.repartition("gram_part", "gram", "spread").distinct().drop("spread").sortWithinPartitions("gram_part", "gram").write.partitionBy("gram_part").parquet(f"{root}/postings")
    counted = index._read("postings").groupBy("gram", "gram_part").agg(F.count("*").alias("texts"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")
    return index


# ---------------------------------------------------------------- pages


@dataclass(frozen=True)
class OrderedRows:
    """What ``write_ordered`` wrote: the rows in ranges of an order, and how many stand before each range."""

    spark: SparkSession
    path: str
    order: tuple[Column, ...]
    schema: T.StructType

    def page(self, number: int, size: int = 60) -> DataFrame:
        """Page ``number``, from 0; only the ranges that it lies in are read. Beyond the last page it is empty."""
        low, high = number * size, (number + 1) * size
        ranges = self.spark.read.schema("range_no int, n long, start long").parquet(f"{self.path}/ranges").filter((F.col("start") < high) & (F.col("start") + F.col("n") > low)).collect()
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        held = rows.filter(F.col("range_no").isin([r["range_no"] for r in ranges])).drop("range_no")
        return held.orderBy(*self.order).offset(low - min((r["start"] for r in ranges), default=low)).limit(size)


def write_ordered(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> OrderedRows:
    """Writes ``rows`` in ranges of an order, for pages. Rows that tie in the order may change places between pages.

    Without ``ranges`` their number is Spark's, by the size of the rows. The rows are written as
    given first: the ranges' bounds come from a sample, for which they would be made twice.
    """
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/given")
    given = spark.read.schema(rows.schema).parquet(f"{path}/given")
    ranged = given.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("range_no", F.spark_partition_id())
    # sorted as the folders need it, too, so that the rows are sorted once
    ranged.sortWithinPartitions("range_no", *order).write.partitionBy("range_no").parquet(f"{path}/rows")
    sizes = spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("range_no").agg(F.count("*").alias("n"))
    # one row for each range
    before = F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("start", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/ranges")
    return OrderedRows(spark, path, tuple(order), ranged.schema)
