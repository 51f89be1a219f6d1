import datetime as dt
import json

from quillgrid.operators.favourites import favourites_state
from quillgrid.operators.quality import report_rows, run_checks
from quillgrid.sources import feeds
from quillgrid.sources.html import discover_sheets, read_sheets, sheet_rows, stream_sheets
from quillgrid.streaming import snapshots as snap


def test_feeds(spark, tmp_path):
    lines = [{"name": "B", "url": "u", "best": True}, {"name": "A", "url": "https://docs.google.com/document/d/1"}, {"name": "C", "url": "v", "best": False}]
    (tmp_path / "f.ndjson").write_text("\n".join([json.dumps(x) for x in lines] + ["", "{bad"]))
    got = [r["name"] for r in feeds.read_discovery(spark, str(tmp_path / "f.ndjson")).orderBy("name").collect()]
    assert got == ["B", "C"]
    assert feeds.read_discovery(spark, str(tmp_path / "f.ndjson"), best_only=True).count() == 1
    (tmp_path / "links.txt").write_text("# no\n\n https://a \nhttps://b\n")
    assert [r["url"] for r in feeds.read_links(spark, str(tmp_path / "links.txt")).collect()] == ["https://a", "https://b"]


def test_report_round_trip(spark, tmp_path):
    assert feeds.read_report(spark, str(tmp_path / "none")).count() == 0
    sheet = spark.sql("select 's' sheet_id, 'n' name, 'warn' status, 2L n_eras, 9L n_songs, 1L n_sections, array('x') zero_eras, array('Links') era_names, array('') section_names, 10L total_rows, 9L song_rows, 0L skipped_rows, 0L fuzzy_rows, cast(array() as array<string>) unmatched, 0L declared, 0L parsed")
    feeds.write_report(report_rows(sheet.select("sheet_id", "name", "status", "n_eras", "n_songs"), run_checks(sheet)), str(tmp_path / "r"))
    back = feeds.read_report(spark, str(tmp_path / "r")).first()
    assert [i["check"] for i in back["issues"]] == ["BOGUS_ERAS", "ZERO_SONG_ERAS"]


def test_sheet_files(spark, tmp_path):
    for name in ("Known - Google Drive", "Other - Google Drive"):
        d = tmp_path / f"{name}_files"
        d.mkdir()
        (d / "sheet.html").write_text(f"<table><tr><td>{name}</td></tr></table>")
    known = spark.createDataFrame([("Known - Google Drive", "K", 0)], "folder string, name string, ord int")
    for name in ("A first - Google Drive", "Zed - Google Drive"):
        (tmp_path / f"{name}_files").mkdir()
        (tmp_path / f"{name}_files" / "sheet.html").write_text("<table><tr><td>x</td></tr></table>")
    assert [(r["name"], r["folder"]) for r in discover_sheets(spark, str(tmp_path), known).collect()] == [("K", "Known - Google Drive"), ("A first", "A first - Google Drive"), ("Other", "Other - Google Drive"), ("Zed", "Zed - Google Drive")]
    for name in ("A first - Google Drive", "Zed - Google Drive"):
        (tmp_path / f"{name}_files" / "sheet.html").unlink()
    assert read_sheets(spark, str(tmp_path)).count() == 2
    run = sheet_rows(stream_sheets(spark, str(tmp_path))).writeStream.format("memory").queryName("sheet_stream").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("sheet_stream").count() == 2


def test_sheet_stream_takes_files_by_bytes_and_starts_again(spark, tmp_path):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()

    def put(names, size=1000):
        for n in names:
            (folder / f"{n}.html").write_text(f"<table><tr><td>{n}</td></tr></table>".ljust(size))

    def run():
        stream = stream_sheets(spark, str(folder), batch_bytes=2500).selectExpr("regexp_extract(sheet_id, '([^/]+)[.]html', 1) name", "length(html) n")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    put("abcdef")
    assert run() == [2, 2, 2]
    put("g", 9000)
    put("hi")
    taken = run()
    assert sum(taken) == 3 and max(taken) <= 2 and len(taken) >= 2
    assert run() == []
    assert sorted((r["name"], r["n"]) for r in spark.read.parquet(out).collect()) == [(c, 9000 if c == "g" else 1000) for c in "abcdefghi"]


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.html").write_text("<table><tr><td>x</td></tr></table>")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        sheets = read_sheets(spark, str(tmp_path))
        assert sheets.count() == 200 and sheets.selectExpr("spark_partition_id() p").distinct().count() <= 8
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(spark, path, rows, i):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("u", at + dt.timedelta(minutes=m), h) for m, h in rows], "url string, fetched_at timestamp, content_hash string").coalesce(1).write.parquet(f"{path}/b={i}")


def test_changed_stream_equals_batch_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for i, rows in enumerate([[(0, "A"), (1, "A")], [(2, "B")], [(3, "A")], [(4, "A")]]):
        _write(spark, path, rows, i)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(path)
    stream = spark.readStream.schema(stored.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    run = snap.changed_snapshots_stream(stream).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    want = snap.changed_snapshots(stored).count()
    assert want == 3 and spark.table("changes").count() == 3


DAY = 24 * 60


def test_changed_stream_forgets_old_urls_and_knows_earlier_ones(spark, tmp_path):
    """Days of u, v and others in several batches: the stream equals the batch form, and old states leave the store."""
    path, at = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    days = [[("u", 0, "A"), ("v", 0, "X"), ("x", 0, None)], [("u", 1, "A"), ("w", 1, "W"), ("x", 1, None)], [("w", 20, "W")], [("w", 21, "W")], [("u", 22, "A"), ("v", 22, "Y")]]
    for i, rows in enumerate(days):
        spark.createDataFrame([(u, at + dt.timedelta(days=d), h) for u, d, h in rows], "url string, fetched_at timestamp, content_hash string").coalesce(1).write.parquet(f"{path}/b={i}")
    initial = _batch(spark, [("v", -DAY, "X"), ("w", -30 * DAY, "W"), ("x", -30 * DAY, None)])
    stored = spark.read.option("recursiveFileLookup", "true").parquet(path)
    stream = spark.readStream.schema(stored.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    for name, known in (("plain", None), ("seeded", initial)):
        run = snap.changed_snapshots_stream(stream, 5 * 86400, known, "1 hour").writeStream.format("memory").queryName(f"forget_{name}").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        told = lambda rows: sorted((r["url"], r["fetched_at"].day, str(r["content_hash"])) for r in rows.collect())
        want = told(snap.changed_snapshots(stored, 5 * 86400, known))
        assert told(spark.table(f"forget_{name}")) == want
        assert ("u", 23, "A") in want and ("w", 21, "W") in want and ("w", 22, "W") not in want
        assert ("x", 1, "None") in want and ("x", 2, "None") not in want
        assert (("v", 1, "X") in want) == (known is None)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        assert max(kept) == 4 and kept[-1] == 3  # x has gone; u, v and w have come again


def test_merges_rewrite_grown_buckets_only(spark, tmp_path):
    root, schema = str(tmp_path / "out"), "url string, fetched_at timestamp, content_hash string"
    step = _steps(root, compact_every=1, buckets=8)
    at = dt.datetime(2024, 1, 1)
    step(spark.createDataFrame([(f"u{i}", at, "a") for i in range(800)], schema), 0)
    first = snap._named_bases(spark, root)
    assert len(first) == 8 and sum(r["n_rows"] for r in first.values()) == 800
    step(_batch(spark, [("u5", 1, "b")]), 1)  # too few rows for a merge
    assert snap._named_bases(spark, root) == first
    one = spark.range(20000).selectExpr("concat('n', id) url").filter("pmod(xxhash64(url), 8) = 3").limit(60)
    step(one.selectExpr("url", "timestamp '2024-01-02' fetched_at", "'c' content_hash"), 2)
    second = snap._named_bases(spark, root)
    assert [b for b in first if second[b] != first[b]] == [3]
    assert [p.name for p in (tmp_path / "out" / "base" / f"at={second[3]['at']}").iterdir() if p.is_dir()] == ["bucket=3"]
    now = {r["url"]: r["content_hash"] for r in snap.read_latest(spark, root).collect()}
    assert len(now) == 860 and now["u5"] == "b" and now["u6"] == "a"
    step(_batch(spark, []), 3)
    assert snap.read_latest(spark, root).count() == 860


def _steps(root, **how):
    """What a stream would run for each batch."""
    held = {}

    class Stream:
        writeStream = property(lambda self: self)
        foreachBatch = lambda self, f: held.update(f=f) or self
        option = lambda self, *a: self

    snap.upsert_latest(Stream(), root, "none", **how)
    return held["f"]


def test_latest_stream_keeps_the_newest(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    assert snap.read_latest(spark, root) is None
    for i, rows in enumerate([[(5, "new")], [(1, "old")]]):
        _write(spark, path, rows, i)
    schema = "url string, fetched_at timestamp, content_hash string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    snap.upsert_latest(stream, root, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [r["content_hash"] for r in snap.read_latest(spark, root).collect()] == ["new"]


def _batch(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(u, at + dt.timedelta(minutes=m), h) for u, m, h in rows], "url string, fetched_at timestamp, content_hash string")


def test_latest_survives_a_stop_at_any_point(spark, tmp_path, monkeypatch):
    """Batches that are run again, and a stop between a new base and its pointer, lose nothing."""
    root = str(tmp_path / "out")
    step = {}

    class Stream:
        writeStream = property(lambda self: self)
        foreachBatch = lambda self, f: step.update(f=f) or self
        option = lambda self, *a: self

    snap.upsert_latest(Stream(), root, "none", compact_every=2)
    now = lambda: sorted((r["url"], r["content_hash"]) for r in snap.read_latest(spark, root).collect())
    step["f"](_batch(spark, [("u", 1, "a"), ("v", 1, "x")]), 0)
    assert now() == [("u", "a"), ("v", "x")]
    real = snap.compact_latest

    def stopped(session, folder, through):
        snap.read_latest(session, folder, through).write.parquet(f"{folder}/base/at={through}-half/bucket=0")
        raise RuntimeError("stopped")

    monkeypatch.setattr(snap, "compact_latest", stopped)
    try:
        step["f"](_batch(spark, [("u", 5, "b")]), 1)
        raise AssertionError
    except RuntimeError:
        assert now() == [("u", "b"), ("v", "x")]
    monkeypatch.setattr(snap, "compact_latest", real)
    step["f"](_batch(spark, [("u", 5, "b")]), 1)  # the batch again, as the stream would
    step["f"](_batch(spark, [("u", 3, "late"), ("w", 1, "n")]), 2)
    assert now() == [("u", "b"), ("v", "x"), ("w", "n")]
    step["f"](_batch(spark, [("v", 9, "y")]), 3)
    assert now() == [("u", "b"), ("v", "y"), ("w", "n")]


def test_favourites_stream_tells_of_empty_sets(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, user_id long, action string, artist_slug string, era_name string, base_name string"
    rows = [(t, 1, "toggle", "a", "e", "s"), (t + dt.timedelta(minutes=1), 1, "clear", None, None, None), (t, 2, "toggle", "a", "e", "s")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = snap.favourites_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("emptied").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["user_id"], r["base_name"]) for r in spark.table("emptied").collect()) == [(1, None), (2, "s")]


def test_favourites_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    actions = ["toggle", "toggle", "toggle", "remove", "toggle", "clear", "toggle"]
    rows = [(t + dt.timedelta(minutes=i), 1, a, "a", "e", f"s{i % 2}") for i, a in enumerate(actions)]
    schema = "ts timestamp, user_id long, action string, artist_slug string, era_name string, base_name string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = snap.favourites_stream(stream).writeStream.format("memory").queryName("favs").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    want = favourites_state(spark.createDataFrame(rows, schema)).select("base_name").collect()
    assert [r["base_name"] for r in spark.table("favs").select("base_name").collect()] == [r["base_name"] for r in want] == ["s0"]
