"""Names that clash with helper columns, empty tables, and texts with very many spans."""

import datetime as dt
import time

from pyspark.sql import functions as F

from quillgrid.llm import pii, tokens, urls


def test_url_filters_leave_other_columns_alone(spark):
    at = dt.datetime(2024, 3, 1, 12)
    schema = "_day string, _hit int, Host string, Verdict int, fetch_day int, url_hit int, day int, url string, fetched_at timestamp"
    captures = spark.createDataFrame([("d", 1, "old", 9, 2, 3, 4, "http://a.bad.com/x", at), (None, 5, "old", 9, 6, 7, 8, None, at)], schema)
    captures = captures.unionByName(captures.limit(1))
    entries = spark.createDataFrame([("block", "bad.com", dt.date(2024, 1, 1), "add")], "list string, pattern string, listed_on date, event string")
    out = urls.filter_urls(captures, entries)
    assert out.columns == ["_day", "_hit", "fetch_day", "url_hit", "day", "url", "fetched_at", "host", "verdict", "matched"]
    got = sorted(map(tuple, out.drop("fetched_at", "url").collect()), key=str)
    one = ("d", 1, 2, 3, 4, "a.bad.com", "block", "bad.com")
    assert got == [one, one, (None, 5, 6, 7, 8, None, "none", None)]
    assert urls.filter_urls(captures.filter("false"), entries).count() == 0
    assert [r["verdict"] for r in urls.filter_urls(captures, entries.filter("false")).collect()] == ["none"] * 3


def test_token_counts_leave_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "ab cd", 7, "k", 5, "z"), (1, None, 8, "k", 5, "z")], "doc_id long, text string, _counted int, counted_text string, N_Tokens int, `a.b` string")
    scores = {"▁": -3.0, "▁a": -1.0, "b": -1.0, "c": -1.0, "d": -1.0}
    out = tokens.count_tokens(docs, scores)
    assert out.columns == ["doc_id", "text", "_counted", "counted_text", "a.b", "n_pretokens", "n_tokens"]
    assert sorted((r["_counted"], r["a.b"], r["n_pretokens"], r["n_tokens"]) for r in out.collect()) == [(7, "z", 2, 5), (8, "z", 0, 0)]
    assert tokens.count_tokens(docs.filter("false"), scores).count() == 0


def test_personal_data_in_texts_with_ten_thousand_spans(spark):
    """Loose spans beside base ones: each text is searched once and spans are compared in one walk."""
    text = "ip 10.0.0.1 (212) 555-1234 " * 5000
    docs = spark.createDataFrame([(1, text), (2, "call 2125551234 or +12125551234x"), (3, None)], "doc_id long, text string")
    begun = time.time()
    found = {r["doc_id"]: r["findings"] for r in pii.find_pii(docs).collect()}
    assert time.time() - begun < 150
    base = [s for s in found[1] if s["kind"] == "ip"]
    assert [(s["start"], s["end"]) for s in base] == [(27 * i + 3, 27 * i + 11) for i in range(5000)]
    assert found[3] == []


def test_loose_spans_apart_from_base_spans(spark):
    """The walk against all pairs."""
    import random

    rng = random.Random(9)
    span = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
    some = lambda n, low: sorted(((a := rng.randrange(200)), rng.randrange(low, low + 3), a + rng.randint(1, 9), "k", "h") for _ in range(n))
    rows = [(some(rng.randint(0, 12), 0), some(rng.randint(0, 30), 3)) for _ in range(60)]
    got = spark.createDataFrame(rows, f"base {span}, loose {span}").select("base", "loose", pii._apart_from(F.col("loose"), F.col("base")).alias("kept")).collect()
    for r in got:
        want = [s for s in r["loose"] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["base"])]
        assert [tuple(s) for s in r["kept"]] == sorted((tuple(s) for s in want), key=lambda s: (s[1], s[0], s[2]))
