"""Each stage against a plain check on what the stage before it kept."""

import pyarrow as pa

from pyspark.sql import functions as F

import corpus_pipeline as P
from quillgrid.llm import decontaminate as D
from quillgrid.llm.common import key_filter, materialise, may_hold, table


def test_stages(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    kept = {"documents": docs.toPandas().set_index("doc_id")}
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf), "stage")
        kept[name] = docs.toPandas().set_index("doc_id")
        if name != P.STAGES[-1][0]:
            assert docs.columns == table(spark, sf, "documents").columns
    before, quality, near, clean, masked, mixed = kept.values()
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    known = labels.index.intersection(before.index)
    assert (labels[known][labels[known] == 1].index.isin(quality.index)).mean() > 0.97
    assert (labels[known][labels[known] == 0].index.isin(quality.index)).mean() < 0.2
    assert near.text.nunique() == len(near) and set(quality.text) >= set(near.text)
    items = [t for t in D.plain_texts(pa.array(table(spark, sf, "benchmark").toPandas().text))]
    holds = {i for i, t in zip(near.index, D.plain_texts(pa.array(near.text)), strict=True) if any(x in t for x in items)}
    assert holds and not holds & set(clean.index) and len(near) - len(clean) <= len(holds) + 3
    assert list(masked.index.sort_values()) == list(clean.index.sort_values())
    changed = masked.text != clean.text.reindex(masked.index)
    assert changed.any() and masked[changed].text.str.contains("[SECRET]", regex=False).all() and not masked.text.str.contains("token = \"[0-9a-f]{24}").any()
    assert 0.2 * len(masked) < len(mixed) < len(masked) and set(mixed.index) <= set(masked.index)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
T, U = "a b c d e f", "quite another text of seven words here"


def stage(spark, sf_dir, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs.repartition(3), sf_dir).collect()), key=repr)


def test_every_row_is_judged_by_its_own_text(spark, sf_dir):
    """Rows of one id with different texts are different documents; each group leaves one row."""
    assert stage(spark, sf_dir, [(3, T), (5, T), (5, U)]) == [(3, T), (5, U)]
    assert stage(spark, sf_dir, [(5, T), (5, U), (7, U), (3, T)]) == [(3, T), (5, U)]
    assert stage(spark, sf_dir, [(1, T), (1, T), (2, T), (None, T), (3, None), (4, ""), (4, "")]) == sorted([(1, T), (3, None), (4, ""), (4, "")], key=repr)
    assert stage(spark, sf_dir, [(None, T), (None, T), (None, U), (None, None)]) == sorted([(None, T), (None, U), (None, None)], key=repr)
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more or less"
    assert stage(spark, sf_dir, [(9, near), (8, near + " end"), (9, U)]) == [(8, near + " end"), (9, U)]


def test_equal_choices_in_every_order(spark, sf_dir):
    """Of two different copies under one id the same one stays, however rows are dealt."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(2, near), (2, near + " tail"), (4, near)]
    assert len({tuple(stage(spark, sf_dir, order)) for order in (rows, rows[::-1], rows[1:] + rows[:1])}) == 1


def test_stages_on_empty_tables_and_clashing_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name in ("score", "row_key", "leaks", "findings", "mix", "probability", "n_tokens", "root", "weight"):
        docs = docs.withColumn(name, docs["lang"])
    for name, run in P.STAGES:
        kept = run(spark, docs, sf_dir)
        none = run(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and kept.columns[: len(docs.columns)] == docs.columns == none.columns[: len(docs.columns)]
        assert kept.count() > 50 and kept.filter("score <> lang or leaks <> lang or weight <> lang").count() == 0, name
    assert kept.columns[len(docs.columns) :] == ["n_tokens_", "probability_"]


def test_key_filters(spark):
    """A filter holds all its keys and few others; a full one lets everything pass."""
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("k"))
    others = spark.range(1, 60_000, 3).select(F.xxhash64("id").alias("k"))
    bitmap = key_filter(keys, "k")
    assert keys.filter(~may_hold(F.col("k"), bitmap)).count() == 0 and others.filter(may_hold(F.col("k"), bitmap)).count() < 0.1 * 20_000
    assert len(key_filter(keys, "k", 1024)) == 128 and others.filter(may_hold(F.col("k"), key_filter(keys, "k", 1024))).count() == 20_000
    assert others.filter(may_hold(F.col("k"), key_filter(keys.limit(0), "k"))).count() == 0
