"""Corpus pipeline: quality, near duplicates, decontamination, secrets, mixing.

Counted as part of ``quillgrid.llm``. Every stage takes all rows that the one before it
kept and returns the columns of ``documents``; each result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import free_name, key_filter, materialise, may_hold, table
from quillgrid.llm.decontaminate import find_leaks
from quillgrid.llm.jaccard import jaccard_groups
from quillgrid.llm.mixing import mix_sources
from quillgrid.llm.quality import fit_quality, score_quality
from quillgrid.llm.secrets import redact, scan_secrets

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is below ``QUALITY_THRESHOLD``."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return score_quality(docs, model, out_col=score).filter(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns, nulls told apart: rows of one key (and one id) are equal."""
    plain = [F.to_json(f.name) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of least id, rows without an id last, then of least row key.

    Every row is judged by its own text, so rows of one id but different texts are different
    documents. Equal rows leave one. Rows without words are in no group and all stay.

    Texts are not shuffled to drop rows: a bounded bit map of the surplus keys tells most
    rows that stay, and only the others are joined with these keys.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    grouped = jaccard_groups(keyed, keep=(key,)).filter(F.col("root").isNotNull()).select("id", key, "root")
    grouped = materialise(grouped, "placed")
    chosen = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", key)).alias("c")).select(F.col("c.id").alias("_id"), F.col(f"c.{key}").alias("_key"))
    distinct = grouped.groupBy("id", key).agg(F.count("*").alias("rows"))
    is_chosen = distinct["id"].eqNullSafe(chosen["_id"]) & (distinct[key] == chosen["_key"])
    surplus = materialise(distinct.join(chosen, is_chosen, "left_anti").select(F.col("id").alias("_id"), F.col(key).alias("_key")), "surplus")
    repeated = materialise(distinct.filter("rows > 1").join(chosen, is_chosen, "left_semi").select(F.col("id").alias("_id"), F.col(key).alias("_key")), "repeated")
    same = (F.col(key) == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    kept = without(keyed, surplus, key, same)
    if not repeated.isEmpty():
        once = kept.filter(may_hold(F.col(key), key_filter(repeated, "_key"))).join(repeated, same, "left_semi")
        kept = without(kept, repeated, key, same).unionByName(once.dropDuplicates([key, "doc_id"]))
    return kept.drop(key)


def without(rows: DataFrame, keys: DataFrame, key: str, same: Column) -> DataFrame:
    """The rows that meet none of ``keys``; only rows that may meet one take part in the join."""
    held = may_hold(F.col(key), key_filter(keys, "_key"))
    return rows.filter(~held).unionByName(rows.filter(held).join(keys, same, "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item within its error budget."""
    leaks = free_name(docs, "leaks")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), out_col=leaks).filter(F.coalesce(F.size(leaks), F.lit(0)) <= 0).drop(leaks)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document is dropped."""
    found = free_name(docs, "findings")
    scanned = scan_secrets(docs, out_col=found)
    masked = scanned.withColumn("text", F.when(F.size(found) > 0, redact(F.col("text"), F.col(found))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the raked weights of source, language and topic; adds ``n_tokens`` and ``probability``."""
    mix = free_name(docs, "mix")
    return mix_sources(docs, out_col=mix).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{mix}.tokens").alias(free_name(docs, "n_tokens")), F.col(f"{mix}.probability").alias(free_name(docs, "probability")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing to target weights", mixing),
]

#: The classifier and the edit distances are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
