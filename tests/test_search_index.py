"""Searches over a written index and pages of a written order against the plain ones."""

import random

from pyspark.sql import functions as F

from quillgrid.operators import search
from quillgrid.operators.search_index import build_index, write_ordered

ROWS = "sheet_id string, era_idx long, row_idx long, base_name string, name string, alt_titles array<string>, featuring string, badge string, available_length string, quality string"


def table(spark, rng, n):
    words = ["alpha", "beta", "Gamma", "délta", "ep", "zeta ray", "eta"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        base = rng.choice([text(), f"song {rng.randint(0, 40)}", None if i % 29 == 0 else "x"])
        rows.append((f"s{i % 3}", i % 4, i, base, f"{base} take {i}", rng.choice([None, [], [text()], [text(), f"alt{i}"]]), rng.choice([None, "Guest Name"]), rng.choice([None, "best"]), "Full", "CD"))
    return spark.createDataFrame(rows, ROWS)


def test_index_searches_equal_plain_ones(spark, tmp_path):
    versions = table(spark, random.Random(1), 400).cache()
    index = build_index(versions, str(tmp_path / "index"), parts=8)
    assert sorted(map(str, index.versions().select(*versions.columns).collect())) == sorted(map(str, versions.collect()))
    found = 0
    for words in ("alpha", " BETA gamma ", "delta", "délta", "ep", "p", "song 1", "take 37", "alt12", "ray eta", "nothing", "zzz", "guest", "", "ta "):
        for options in ({}, {"scoring": "spec"}, {"only_best": True}):
            rows = lambda v: [tuple(r) for r in search.search(v, words, **options).select("sheet_id", "era_idx", "row_idx", "score").collect()]  # noqa: B023, E731
            plain = rows(versions)
            assert rows(index.candidates(words)) == plain
            found += len(plain)
    assert found > 500


def test_a_search_reads_few_rows(spark, tmp_path, node_metrics):
    rows = spark.range(4000).select(
        F.lit("s").alias("sheet_id"), F.lit(0).cast("long").alias("era_idx"), F.col("id").alias("row_idx"), F.concat(F.lit("the song "), F.md5(F.col("id").cast("string"))).alias("base_name"),
    ).withColumns({"name": F.col("base_name"), "alt_titles": F.array().cast("array<string>"), **{c: F.lit(None).cast("string") for c in ("featuring", "badge", "available_length", "quality")}})
    index = build_index(rows, str(tmp_path / "index"), parts=16)
    word = rows.filter("row_idx = 17").first()["base_name"]
    read = index.candidates(word)
    assert [r["row_idx"] for r in search.search(read, word).collect()] == [17]
    assert 0 < sum(node_metrics(read, "base_name")) < 4000 / 8
    assert index.candidates("no such words").count() == 0
    assert index.candidates("th").count() == 4000
    empty = build_index(rows.limit(0), str(tmp_path / "empty"), parts=4)
    assert empty.candidates(word).count() == 0


def test_postings_do_not_grow_with_copies(spark, tmp_path):
    versions = table(spark, random.Random(3), 60).cache()
    copies = versions.crossJoin(spark.range(7).withColumnRenamed("id", "copy")).withColumn("sheet_id", F.concat("sheet_id", F.lit("-"), "copy")).drop("copy")
    count = lambda v, name: spark.read.parquet(f"{build_index(v, str(tmp_path / name), parts=4).root}/postings").count()
    assert count(copies, "copies") == count(versions, "once") > 0


def test_searches_together_equal_single_ones(spark, tmp_path):
    versions = table(spark, random.Random(4), 300).cache()
    index = build_index(versions, str(tmp_path / "index"), parts=8)
    searches = [
        ("a", "alpha", {}), ("b", " BETA ", {"scoring": "spec"}), ("c", "take 1", {"only_best": True}), ("d", "", {}), ("e", "zzz", {}),
        ("f", "delta", {"hide_snippets": True}), ("g", "guest", {"scoring": "spec"}), ("h", "ta", {"hide_snippets": True, "dialect": "ios"}),
    ]
    short = versions.withColumn("available_length", F.when(F.col("row_idx") % 3 == 0, "Snippet").when(F.col("row_idx") % 3 == 1, "Unavailable").otherwise("Full"))
    for found, rows in ((index.search(searches), versions), (search.search_many(short, searches), short)):
        got = sorted(tuple(r) for r in found.select("search", "sheet_id", "era_idx", "row_idx", "score").collect())
        want = [(name, *r) for name, words, options in searches for r in search.search(rows, words, **options).select("sheet_id", "era_idx", "row_idx", "score").collect()]
        assert got == sorted(want) and len(got) > 300
    assert search.search_many(versions, [("d", " ", {})]).count() == 0 == index.search([]).count()


def test_rows_are_made_once_for_a_written_order(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).mapInArrow(counted, "id long")
    page = write_ordered(rows, [F.desc("id")], str(tmp_path / "o"), 4).page(1, 10)
    assert [r["id"] for r in page.collect()] == list(range(489, 479, -1))
    assert made.value == 500


def test_pages_of_a_written_order(spark, tmp_path, node_metrics):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.randint(0, 30)) for i in range(1000)], "id int, k int").repartition(5)
    order = [F.desc("k"), F.col("id")]
    written = write_ordered(rows, order, str(tmp_path / "o"), 8)
    whole = [tuple(r) for r in rows.orderBy(*order).collect()]
    for number in (0, 1, 7, 16, 17):
        page = written.page(number)
        assert [tuple(r) for r in page.collect()] == whole[60 * number : 60 * number + 60]
        assert sum(node_metrics(page, "Scan parquet")) <= 500
    assert written.page(17).count() == 0
    assert write_ordered(rows.limit(0), order, str(tmp_path / "e")).page(0).count() == 0
