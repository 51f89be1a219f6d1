"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic). Raking scales the cells'
token weights to each dimension's target shares in turn; a document is then kept with the
probability of its cell, the weight over the cell's tokens, scaled so that the largest is 1.

The raking works on the cell table, whose rows are bounded by the product of the
dimensions' values, not by the documents. Sums of a value combine before they are shuffled
and are joined back, so that a value with most of the cells is not one task. Nulls in a
dimension form a cell of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import free_name, materialise, table

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Full turns over all dimensions; the cells are written after each.
TURNS = 8
#: Target share of a value: its own share to this power, made to sum to 1.
SMOOTHING = 0.8
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column, n_tokens: Column) -> Column:
    """A topic by form, for tables without one."""
    return (
        F.when(text.rlike("[0-9]{3}"), "figures")
        .when(n_tokens < 120, "brief")
        .when(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= 12, "listing")
        .when(n_tokens < 500, "article")
        .otherwise("longread")
    )


def with_cells(docs: DataFrame, out_col: str = "mix") -> DataFrame:
    """``docs`` with ``out_col``: struct(tokens, source, lang, topic), the cell that a document is in."""
    text, counted = F.coalesce("text", F.lit("")), free_name(docs, "mix_tokens")
    out = docs.withColumn(counted, F.regexp_count(text, F.lit(WORD)).cast("long"))
    cell = F.struct(F.col(counted).alias("tokens"), F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic(text, F.col(counted)).alias("topic"))
    return out.withColumn(out_col, cell).drop(counted)


def smoothed_targets(cells: DataFrame, dimension: str, power: float = SMOOTHING) -> DataFrame:
    """``(dimension, share)``: shares of tokens, flattened by ``power``."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    whole = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(dimension, (F.col("p") / F.lit(float(whole))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], turns: int = TURNS) -> DataFrame:
    """``cells`` (dimensions, ``tokens``) with ``weight``: raked tokens, whose sum stays the same.

    A value without a target keeps none of its weight; a cell without tokens has weight 0.
    """
    dims = list(targets)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in dims:
        cells = cells.join(targets[d].select(d, F.coalesce("share", F.lit(0.0)).alias(f"share_{d}")), d, "left")
    cells = materialise(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(turns):
        for d in dims:
            held = cells.groupBy(d).agg(F.sum("weight").alias("_held"))
            scaled = F.when(F.col("_held") > 0, F.col("weight") * F.coalesce(f"share_{d}", F.lit(0.0)) * F.lit(total) / F.col("_held")).otherwise(0.0)
            cells = cells.join(held, d).withColumn("weight", scaled).drop("_held")
        cells = materialise(cells, "cells")
    return cells.select(*dims, "tokens", "weight")


def raking_residual(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a value's share of the raked weight and its target share."""
    total = float(raked.agg(F.sum("weight")).first()[0] or 0)
    if total <= 0:
        return 0.0
    worst = 0.0
    for d, target in targets.items():
        got = raked.groupBy(d).agg((F.sum("weight") / F.lit(total)).alias("got")).join(target, d, "left")
        worst = max(worst, got.agg(F.max(F.abs(F.col("got") - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
    return float(worst)


def cell_probabilities(cells: DataFrame, targets: dict[str, DataFrame], turns: int = TURNS) -> DataFrame:
    """Raked ``cells`` with ``probability``: weight over tokens as a share of the largest such ratio; and ``residual``."""
    raked = materialise(rake(cells, targets, turns).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)), "raked")
    top = raked.agg(F.max("ratio")).first()[0] or 1.0
    named = raked.withColumn("probability", F.when(F.col("tokens") > 0, F.col("ratio") / F.lit(float(top))).otherwise(1.0))
    return named.withColumn("residual", F.lit(raking_residual(raked, targets)))


def unit_hash(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on id and seed only; null ids count as empty."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def mix_sources(docs: DataFrame, turns: int = TURNS, power: float = SMOOTHING, out_col: str = "mix") -> DataFrame:
    """The sampled rows of ``docs`` with ``out_col``: struct(tokens, source, lang, topic, weight, probability, residual).

    A column of that name is replaced; all others stay as they are, whatever their names.
    Documents without words carry no tokens: they alone in a cell have probability 1,
    otherwise the cell's. Repeated ids share their fate. ``residual`` is the same in every
    row: how far the raked shares are from their targets after ``turns``.
    """
    dims = list(DIMENSIONS)
    celled = with_cells(docs, out_col)
    cells = materialise(celled.groupBy(*[F.col(f"{out_col}.{d}") for d in dims]).agg(F.sum(f"{out_col}.tokens").alias("tokens")), "cells")
    odds = cell_probabilities(cells, {d: smoothed_targets(cells, d, power) for d in dims}, turns)
    cell = free_name(celled, "mix_cell")
    odds = odds.select(F.struct(*dims).alias(cell), F.struct("weight", "probability", "residual").alias(f"{cell}_odds"))
    placed = celled.withColumn(cell, F.struct(*[F.col(f"{out_col}.{d}") for d in dims])).join(odds, cell)
    both = F.struct(F.col(f"{out_col}.*"), F.col(f"{cell}_odds.*"))
    return placed.withColumn(out_col, both).drop(cell, f"{cell}_odds").filter(unit_hash(F.col("doc_id")) < F.col(f"{out_col}.probability"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "mix.*")
    return mixed.select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("weight", 3).alias("cell_weight"), F.round("probability", 6).alias("probability"), F.round("residual", 6).alias("residual"))


def _sql() -> str:
    """The same steps in SQL, one common table for each raking step."""
    steps = [
        rf"""c AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents)""",
        r"""d AS (SELECT doc_id, source, lang, n, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'figures' WHEN n < 120 THEN 'brief'
  WHEN length(text) - length(replace(text, chr(10), '')) >= 12 THEN 'listing' WHEN n < 500 THEN 'article' ELSE 'longread' END AS topic FROM c)""",
        "cells AS (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in DIMENSIONS:
        steps.append(f"t_{dim} AS (SELECT {dim}, pow(sum(tokens), {SMOOTHING}) / sum(pow(sum(tokens), {SMOOTHING})) OVER () AS share_{dim} FROM cells GROUP BY {dim})")
    steps.append("w0 AS (SELECT *, tokens AS weight, sum(tokens) OVER () AS total FROM cells " + " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS) + ")")
    k = 0
    for _ in range(TURNS):
        for dim in DIMENSIONS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {dim}) > 0 THEN weight * share_{dim} * total / sum(weight) OVER (PARTITION BY {dim}) ELSE 0 END AS weight) FROM w{k})")
            k += 1
    steps.append(f"p AS (SELECT source, lang, topic, tokens, weight, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM w{k})")
    off = [f"SELECT abs(sum(weight) / (SELECT sum(weight) FROM p) - any_value(share_{dim})) AS off FROM w{k} GROUP BY {dim}" for dim in DIMENSIONS]
    steps.append(f"res AS MATERIALIZED (SELECT max(off) AS residual FROM ({' UNION ALL '.join(off)}))")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(weight, 3) AS cell_weight, round(probability, 6) AS probability, (SELECT round(residual, 6) FROM res) AS residual
FROM d JOIN (SELECT *, CASE WHEN tokens > 0 THEN ratio / (SELECT max(ratio) FROM p) ELSE 1 END AS probability FROM p) USING (source, lang, topic)
WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0 < probability"""
    )


OP8_SQL = _sql()
