"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.functions import text as T
from quillgrid.operators.stats import declared_pairs
from quillgrid.plans.text_queries import QUERIES
from quillgrid.sources.html import unescape


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


@pytest.mark.parametrize(
    "f,cases",
    [
        (T.badge, {"⭐ Song": "best", "⭐️Song": "best", "💿🥉 Tape": "wanted", "🗑️ x": "worst", "🏆 y": "grail", "Song ⭐": None, "plain": None, None: None}),
        (T.version_tag, {"A [V2]": "V2", "A [V1-V3]": "V1-V3", "A [V2-V?]": "V2-V?", "A [V?]": "V?", "A [Alt.]": "Alt.", "A [with X]": None, "[Song 2] B": "Song 2", "": None}),
        (T.without_tag, {"A [V2] B": "A B", "[V1] B": "B", "A": "A", " A [MASTER]": "A", "A [V1] [V2]": "A [V2]"}),
        (T.match_key, {"Before Baby(as someone)": "before baby", "Ca$ino(Child)": "ca$ino", "Tu Pimp [V1](x)": "tu pimp", "(Mollyworld, Balaclava Era)": "mollyworld balaclava era", "Super geëky": "super geeky", "Rodeo*": "rodeo", "Woo, Vol. 2": "woo vol 2", "": ""}),
        (T.slug, {"Héllo, World_x!": "héllo-world-x", " -a- ": "a"}),
        (T.og_filename, {"OG Filename: Broke My Heart 1": "Broke My Heart 1", "x\nog filename (Metadata): a b\nc": "a b", "none": None}),
        (L.duration_seconds, {"3:14": 194, "1:00:01": 3601, "?:10": 0, "abc": 0, "5": 0, None: 0}),
        (lambda c: L.parse_date(c).cast("string"), {"12/25/2024": "2024-12-25", "March 20, 2023": "2023-03-20", "Mar 2, 2023": "2023-03-02", "December 2024": "2024-12-01", "2024": "2024-01-01", "early 2019?": "2019-01-01", "soon": None, "": None}),
        (L.quality_class, {"CD Quality": "cd", "OG File": "og", "Lossless": "lossless", None: "na", "Recording": "rec"}),
        (L.unwrap_link, {"https://www.google.com/url?q=https%3A%2F%2Fa.b%2Fc&sa=D": "https://a.b/c", "https://a.b": "https://a.b"}),
        (unescape, {"a &amp;lt; b": "a &lt; b", "&#9733;&#x1F3C6;": "★🏆", "&lt;x&gt;&nbsp;&quot;&#39;": "<x>\xa0\"'", "&unknown;": "&unknown;", "caf&eacute; &mdash; &copy;&amp;copy;": "café — ©&copy;"}),
        (lambda c: F.array_join(T.samples(c), "|"), {'Samples "Got Money" by Lil Wayne': '"Got Money" by Lil Wayne', "Samples Chaka's 'Nobody'": '"Nobody" by Chaka', 'Samples "A" by George and others.': '"A" by George'}),
        (lambda c: F.to_json(declared_pairs(c)), {"1 OG File(s)45 Full1 Tagged": '{"tagged":1,"full":45,"og file":1}', "🔗 616 Total Links\n❌ 0 Missing Links": '{"missing links":0,"total links":616}', "2 Full\n3 Full": '{"full":3}', "": "{}"}),
        (T.plausible_era_name, {"Rap Hard": True, "Barter 7": True, "Links": False, "a\nb\nc": False, "22.10.2025 - Big": False, "718 Total Full": False, "Added x": False, "symex (@symex.b)": False, "NEW!!!": False, "": False, "1/23 - Sent": False}),
    ],
)
def test_golden(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_declared_totals_are_held_against_parsed_ones(spark):
    """The difference counts by what was read: 100 declared and 78 read are 28 % off; nothing read says nothing."""
    from quillgrid.operators.quality import run_checks
    from quillgrid.operators.stats import declared_totals

    base = "'x' name, 5L n_eras, 90L n_songs, 1L n_sections, cast(array() as array<string>) zero_eras, array('a') era_names, cast(array() as array<string>) section_names, 100L total_rows, 100L song_rows, 0L skipped_rows, 0L fuzzy_rows, cast(array() as array<string>) unmatched"
    sheets = spark.sql(f"select sheet_id, {base}, declared, parsed from values ('a', 100L, 78L), ('b', 100L, 80L), ('c', 100L, 0L), ('d', 80L, 100L), ('e', 70L, 100L) t(sheet_id, declared, parsed)")
    assert sorted(r["sheet_id"] for r in run_checks(sheets).filter("check = 'STATS_MISMATCH'").collect()) == ["a", "e"]
    eras = spark.sql("select * from values ('s', 5L, 9L), ('s', 0L, 100L), ('t', 0L, 3L) t(sheet_id, declared_total, n_versions)")
    assert sorted(map(tuple, declared_totals(eras).collect())) == [("s", 5, 9), ("t", 0, 0)]


def test_unread_and_abandoned_sheets(spark):
    from quillgrid.operators.quality import status_by_rules

    rows = [("ok", None, 0, 0), ("net", "network", 1, 0), ("gone", "network", 0, 0), ("url", "invalid_url", 0, 0), ("no", "access_denied", 1, 1), ("tables", "no_tables", 1, 1), ("left", "no_tables", 0, 0), ("odd", "boom", 0, 0)]
    sheets = spark.createDataFrame(rows, "sheet_id string, error string, links_work int, updated int").selectExpr("*", "3L n_eras", "30L n_songs", "cast(array() as array<string>) zero_eras", "10L total_rows", "0L skipped_rows")
    got = {r["sheet_id"]: r["status"] for r in status_by_rules(sheets).collect()}
    assert got == {"ok": "ok", "net": "error", "gone": "skip", "url": "error", "no": "skip", "tables": "fail", "left": "skip", "odd": "error"}
    assert {r["status"] for r in status_by_rules(sheets.withColumn("n_songs", F.lit(0)).filter("error is null")).collect()} == {"fail"}  # abandoned, but read


def test_repeated_names_and_near_hashes(spark):
    from quillgrid.operators.hashes import near_hash_bands
    from quillgrid.operators.quality import duplicate_names

    names = spark.createDataFrame([(["B ", "a", "b", "A", "c", "a"],), ([],), (["x", None, None],), (None,)], "n array<string>")
    assert [r[0] for r in names.select(duplicate_names(F.col("n"))).collect()] == [["a", "b"], [], [], None]
    import random

    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in list(hashes):
        for _ in range(rng.randint(0, 12)):
            h ^= 1 << rng.randrange(64)
        hashes.append(h)
    rows = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "one long, hash long")
    got = {tuple(r) for r in near_hash_bands(rows, rows.withColumnRenamed("one", "two"), "one", "two", 10).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if (a ^ b).bit_count() <= 10}


def test_texts_of_parts_are_read_by_all_tasks(spark, sf_dir):
    for name in ("file_metadata_columns", "unfinished_songs"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
