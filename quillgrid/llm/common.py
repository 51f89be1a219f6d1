"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.scratch import materialise, scratch_root

__all__ = ["free_name", "key_filter", "map_batches", "match_spans", "may_hold", "materialise", "ranked_spans", "scratch_root", "span_digest", "table"]


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores after it until no column has that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_batches(rows: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: a name with a dot cannot be an input there. ``run`` goes by position."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, schema)


#: A filter has at most so many bits (4 MB); with far more keys it lets everything pass.
FILTER_BITS = 1 << 25


def key_filter(keys: DataFrame, key_col: str, most_bits: int = FILTER_BITS) -> bytes:
    """A bit map with a bit set for each key (a 64-bit hash), about 16 bits a key up to ``most_bits``.

    Words of the map combine in Spark; at most ``most_bits / 64`` of them reach the driver.
    """
    n = keys.count()
    bits = 1 << min(most_bits.bit_length() - 1, max(10, (16 * n).bit_length()))
    place = F.pmod(F.col(key_col), F.lit(bits))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def may_hold(key: Column, bitmap: bytes) -> Column:
    """Whether a key's bit is set: true for all keys of the filter and for few others."""
    place = F.pmod(key, F.lit(8 * len(bitmap)))
    byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def match_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of a Java pattern, left to right.

    Gives ``array<struct<start,end,hit>>`` with code-point offsets, end exclusive. The
    pattern must not match the empty string. Offsets are running sums over the pieces
    between matches; texts without a match are tested once and not split.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        hits,
        lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit")),
    )
    step = lambda acc, p: F.struct(
        (acc["pos"] + p["gap"] + p["len"]).alias("pos"),
        F.concat(
            acc["out"],
            F.array(
                F.struct(
                    (acc["pos"] + p["gap"]).alias("start"),
                    (acc["pos"] + p["gap"] + p["len"]).alias("end"),
                    p["hit"].alias("hit"),
                )
            ),
        ).alias("out"),
    )
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)


def ranked_spans(spans: Column, rank: int, kind: str) -> Column:
    """Spans as (start, rank, end, kind, hit), which sorts by start, then rank; null gives none."""
    return F.transform(
        F.coalesce(spans, F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["hit"].alias("hit"),
        ),
    )


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
