"""Chat formatting with collapse of cumulative snapshots.

A service that logs a conversation after every turn leaves snapshots that are prefixes of
the last one. Rolling hashes of turn prefixes identify them: a conversation is dropped if
its whole hash is the hash of a proper prefix of another one. Equal conversations leave the
one of least id. What remains is rendered with role marks.

Ordinals and hashes are running sums in two levels (inside a block of turn numbers, then
over a conversation's blocks), so that a conversation with a third of all turns is not one
task. Prefix hashes collapse before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, table

#: Turn numbers in one block.
BLOCK_TURNS = 256
LANES = (11, 23)


def _running(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds to ``rows`` (conv_id, block, in order of ``keys``) the running sums of ``values`` over the conversation."""
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(f"_t_{k}").over(outer), F.lit(0)).alias(f"_o_{k}") for k in values])
    summed = rows.withColumns({k: F.sum(v).over(inner) for k, v in values.items()}).join(totals, ["conv_id", "block"])
    return summed.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in values}).drop(*[f"_o_{k}" for k in values])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Each turn with its position from 1 and the hashes of the prefix that ends with it.

    A prefix's hash is the sum of the hashes of (position, role, text) in two lanes of 64
    bits, kept as decimals so that no sum overflows. Turns are ordered by number, then role,
    then text; a null number comes first; null roles and texts count as empty; repeated rows
    count once; rows without a conversation are dropped.
    """
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.dropna(subset=["conv_id"]).distinct().withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("_one", F.lit(1))
    placed = _running(rows, {"pos": "_one"})
    placed = placed.withColumns({f"g{i}": F.xxhash64("pos", "role", "text", F.lit(seed)).cast("decimal(20,0)") for i, seed in enumerate(LANES)})
    return _running(placed, {"h0": "g0", "h1": "g1"}).select("conv_id", "pos", "role", "text", "g0", "g1", "h0", "h1")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of conversations that are no prefix of another."""
    whole = hashed.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.sum("g0").alias("h0"), F.sum("g1").alias("h1"))
    alone = whole.groupBy("n_turns", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    inside = hashed.join(whole.select("conv_id", "n_turns"), "conv_id").filter(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "h0", "h1").distinct()
    # both sides widened alike, as sums of different depth differ in precision
    same = lambda d: d.withColumns({h: F.col(h).cast("decimal(38,0)") for h in ("h0", "h1")})
    return same(alone).join(same(inside), ["n_turns", "h0", "h1"], "left_anti").select("conv_id", "n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, text)``: maximal conversations, rendered turn by turn.

    A rendered conversation is one row, so a task holds the longest one whole, and one of
    2 GB or more has no row in Spark. Everything before rendering is split. Several turns of
    one number follow each other by role, then text.
    """
    hashed = materialise(prefix_hashes(turns), "prefix-hashes")
    kept = hashed.join(maximal_conversations(hashed), "conv_id")
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", turn.alias("line")))), lambda s: s["line"])
    return kept.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.array_join(lines, "").alias("text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH rows_ AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn, role, text) AS lines FROM rows_ GROUP BY conv_id),
hashed AS (SELECT conv_id, lines, md5(array_to_string(list_transform(lines, lambda x: md5(x)), ',')) AS h FROM convs),
prefixes AS (
  SELECT DISTINCT md5(array_to_string(list_transform(lines[1:k], lambda x: md5(x)), ',')) AS h
  FROM (SELECT lines, unnest(generate_series(1, len(lines) - 1)) AS k FROM convs)),
alone AS (SELECT h, min(conv_id) AS conv_id FROM hashed GROUP BY h)
SELECT conv_id, len(lines)::BIGINT AS n_turns, array_to_string(lines, '') AS text
FROM hashed JOIN alone USING (h, conv_id) WHERE h NOT IN (SELECT h FROM prefixes)
"""
