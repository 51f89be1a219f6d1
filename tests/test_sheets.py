"""Whole sheets through the reader: one for each way that rows find their era."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillgrid.functions.text import FOOTER_WORDS
from quillgrid.operators import resolve
from quillgrid.operators.columns import project_fields
from quillgrid.operators.resolve import era_texts, merge_stub_eras
from quillgrid.operators.rows import describe_rows
from quillgrid.plans.catalogue import read_catalogue
from quillgrid.plans.fixtures import mixed_sheets, rendered_sheets
from quillgrid.scratch import materialise_large
from quillgrid.sources.html import explode_cells, head_rows, sheet_rows
from quillgrid.sources.scan import TAGS, CellColumns, _tags

HEAD = "<tr><td>Era</td><td>Name</td><td>Notes</td><td>Quality</td><td>Link(s)</td></tr>"


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def read(spark, *rows):
    sheets = spark.createDataFrame([("s", "<table>" + HEAD + "".join(rows) + "</table>")], "sheet_id string, html string")
    cat = read_catalogue(sheets)
    eras = {r["era_idx"]: r["name"] for r in cat["eras"].orderBy("era_idx").collect()}
    songs = [(eras[r["era_idx"]], r["name"], r["match_kind"]) for r in cat["versions"].orderBy("row_idx").collect()]
    return eras, songs, cat


SONG = ("x", "HQ", "http://a.b")


def test_headers_exact_and_key(spark):
    eras, songs, _ = read(spark, row("1 Full", "Rodeo<br>(Alt Name)", "(2001) (x)", "", ""), row("Rodeo", "A", *SONG), row("rodeo [V2]", "B", *SONG), row("Alt Name", "C", *SONG))
    assert list(eras.values()) == ["Rodeo"]
    assert songs == [("Rodeo", "A", "exact"), ("Rodeo", "B", "key"), ("Rodeo", "C", "exact")]


def test_fuzzy_acronym_and_learnt_alias(spark):
    _, songs, cat = read(
        spark,
        row("1 Full", "Collaboration Digital Nas", "", "", ""), row("1 Full", "Shoot For The Stars", "", "", ""),
        row("Digital Nas Collab", "A", *SONG), row("sfts", "B", *SONG), row("Odd Name", "C", *SONG), row("Odd Name", "D", *SONG),
    )
    assert songs == [("Collaboration Digital Nas", "A", "fuzzy"), ("Shoot For The Stars", "B", "acronym"), ("Shoot For The Stars", "C", "learnt"), ("Shoot For The Stars", "D", "exact")]
    assert cat["ingest_metrics"].first()["fuzzy_rows"] == 2


def test_without_headers_eras_are_made(spark):
    eras, songs, cat = read(spark, row("Links", "skip me", *SONG), row("First Era", "A", *SONG), row("", "B", *SONG), row("Second Era", "C", "", "", ""))
    assert list(eras.values()) == ["First Era", "Second Era"]
    assert [s[1:] for s in songs] == [("A", "auto"), ("B", "position")]
    m = cat["ingest_metrics"].first()
    assert (m["skipped_rows"], m["song_rows"], m["unmatched"]) == (1, 2, ["Row 1: Links | skip me | x | HQ | http://a.b"])


def test_image_only_header_is_named_by_the_next_row(spark):
    eras, songs, _ = read(spark, row("1 Full", '<img src="http://i/1">', "(2001) (x)", "", ""), row("Narcissist", "A", *SONG))
    assert list(eras.values()) == ["Narcissist"] and songs == [("Narcissist", "A", "backfill")]


def test_sections_groups_and_footer(spark):
    eras, songs, cat = read(
        spark,
        row("1 Full", "Rodeo", "", "", ""), row("", "Die Lit 2", "", "", ""), row("Features", "", "", "", ""), row("Rodeo", "A", *SONG), row("Demos", "", "", "", ""),
        row("", "Changelog", "", "", ""), row("Rodeo", "in footer", *SONG), row("2 Full", "Days Before", "", "", ""), row("Days Before", "B", *SONG),
    )
    assert [s[:2] for s in songs] == [("Rodeo", "A"), ("Days Before", "B")]
    kept = [(r["name"], r["group"]) for r in cat["sections"].filter("era_idx = 0").orderBy("section_idx").collect()]
    assert kept == [("Features", "Die Lit 2")]
    assert cat["ingest_metrics"].first()["footer_rows"] == 2


def test_song_columns(spark):
    _, _, cat = read(spark, row("1 Full", "Rodeo", "", "", ""), row("Rodeo", "⭐ Benz [V2]<br>(with Go) (feat. R) (prod. K &amp; A)<br>(All I Have)<br>[unfinished]", 'OG Filename: f<br><a href="http://n.o">n</a>', "CD Quality", '<a href="http://a.b">1</a> <a href="http://n.o">2</a>'))
    r = cat["versions"].first()
    assert (r["name"], r["version_tag"], r["badge"], r["featuring"], r["producers"], r["collaboration"]) == ("Benz", "V2", "best", "R", "K & A", "Go")
    assert (r["alt_titles"], r["links"], r["og_filename"]) == (["All I Have"], ["http://a.b", "http://n.o"], "f")


def test_cells(spark):
    html = """<style>.s1{background-color:RGB(1, 2, 255)} .s1{background-color:#fff} .s2{color:red}</style><!-- <table><tr><td>no</td></tr></table> -->
    <table><tr><th>x</th></tr><tr><td class="s1" colspan="2">a<br/>b <a href='u1'>l</a><br><a href="">e</a><a href="u2">m</a></td><td><img src="i" alt="pic"> z</td></tr></table><table><tr><td colspan="x">2</td></tr></table>"""
    cells = explode_cells(sheet_rows(spark.createDataFrame([("s", html), ("none", "<p>"), ("null", None)], "sheet_id string, html string"))).orderBy("row_idx", "col_idx").collect()
    got = [(c["row_idx"], c["col_idx"], c["text"], c["links"], c["link_lines"], c["images"], c["bg_color"]) for c in cells]
    assert got == [(0, 0, "a\nb l\nem", ["u1", "u2"], [1, 2], [], "#0102ff"), (0, 1, "", [], [], [], None), (0, 2, "pic z", [], [], ["i"], None), (1, 0, "2", [], [], [], None)]


def test_stub_eras_merge_twice(spark):
    rows = [("s", 0, "Birds In The Trap", 0, "d"), ("s", 1, "Birds", 3, None), ("s", 2, "HiTunes [V3]", 0, "h"), ("s", 3, "Other", 1, None), ("s", 4, "HiTunes", 2, None), ("s", 5, "Alone", 0, None)]
    eras = spark.createDataFrame(rows, "sheet_id string, era_idx int, name string, n_songs int, description string").withColumns(
        {"alt_names": F.array(F.col("name")), "art_url": F.lit(None).cast("string"), "stats_raw": F.lit(None).cast("string"), "timeline": F.array().cast("array<struct<date:string,event:string>>")}
    )
    got = [(r["era_idx"], r["name"], r["description"]) for r in merge_stub_eras(eras).orderBy("era_idx").collect()]
    assert got == [(1, "Birds In The Trap", "d"), (3, "Other", None), (4, "HiTunes [V3]", "h"), (5, "Alone", None)]


def eras_of(cat, *cols):
    return [tuple(r[c] for c in cols) for r in cat["eras"].orderBy("era_idx").collect()]


def test_eras_opened_by_rows_keep_what_the_rows_say(spark):
    """A name of two lines has notes and an image; a row with an era but no name has events and the first image."""
    _, songs, cat = read(
        spark,
        row("", "The Graduates<br>(2007 - 2009)", "Early days", "", '<img src="http://i/g">'), row("The Graduates", "A", *SONG),
        row("Next Era", "", "(2010) (begun)<br>(2011) (done)", "x", '<img src="http://i/n"><img src="http://i/m">'), row("Next Era", "B", *SONG),
        row("Third Era", "C", "", "", ""), row("Third Era", "D", *SONG),
    )
    got = eras_of(cat, "name", "origin", "description", "art_url")
    assert got == [("The Graduates", "name", "Early days", "http://i/g"), ("Next Era", "auto", None, "http://i/n"), ("Third Era", "auto", None, None)]
    events = [[tuple(e) for e in r["timeline"]] for r in cat["eras"].orderBy("era_idx").collect()]
    assert events == [[], [("2010", "begun"), ("2011", "done")], []]
    assert [s[:2] for s in songs] == [("The Graduates", "A"), ("Next Era", "B"), ("Third Era", "D")]


def test_name_column_image_before_other_images(spark):
    _, _, cat = read(spark, row("", '<img src="http://i/own">The Graduates<br>(2007)', "d", "", '<img src="http://i/other">'), row("The Graduates", "A", *SONG))
    assert eras_of(cat, "name", "art_url") == [("The Graduates", "http://i/own")]


def test_a_lone_name_opens_an_era_without_content(spark):
    _, songs, cat = read(spark, row("", "Before Unknown Death", "notes here", "", ""), row("", "A", *SONG), row("", "B", *SONG))
    assert eras_of(cat, "name", "origin", "description") == [("Before Unknown Death", "name", None)]
    assert [s[0] for s in songs] == ["Before Unknown Death"] * 2


def test_the_job_merges_stubs_reads_statistics_notices_and_art(spark):
    html = "<table>" + row("Some notice that is long", "") + HEAD + row("0 Full", "Birds In The Trap", "(2001) (x)", "", "About birds") + row("2 Full<br>1 Snippet(s)", "Birds", "", "", "")
    html += row("Birds", "A", *SONG) + row("Birds", "A [V2]", *SONG) + row("Birds", "B", *SONG) + row("3 Total Links<br>1 Missing Links", "", "2 Total Full", "", "") + "</table>"
    sheets = spark.createDataFrame([("s", html), ("empty", "<p>"), ("head", "<table>" + HEAD + "</table>")], "sheet_id string, html string")
    art = spark.createDataFrame([("s", "<table>" + row("Birds In The Trap", '<img src="http://i/a">', "alternate") + row("Birds In The Trap", '<img src="http://i/c">', "Front cover") + "</table>")], "sheet_id string, html string")
    names = spark.createDataFrame([("s", "The Artist!")], "sheet_id string, artist_name string")
    cat = read_catalogue(sheets, names=names, art=art)
    got = eras_of(cat, "name", "description", "art_url", "declared_total", "n_songs", "n_versions", "era_idx")
    assert got == [("Birds In The Trap", "About birds", "http://i/c", 3, 2, 3, 1)]
    assert [(r["text"], r["kind"]) for r in cat["notices"].collect()] == [("Some notice that is long", "info")]
    stats = cat["sheet_stats"].first()
    assert (stats["total_links"], stats["missing_links"], stats["total_full"]) == (3, 1, 2)
    artists = {r["sheet_id"]: (r["artist_name"], r["slug"], r["n_eras"], r["n_songs"], r["n_versions"], r["art_url"]) for r in cat["artists"].collect()}
    assert artists == {"s": ("The Artist!", "the-artist", 1, 2, 3, "http://i/c"), "head": ("head", "head", 0, 0, 0, None)}
    nested = cat["nested"].collect()
    assert len(nested) == 1 and [e["era_name"] for e in nested[0]["eras"]] == ["Birds In The Trap"] and nested[0]["n_versions"] == 3
    metrics = {r["sheet_id"]: (r["total_rows"], r["song_rows"], r["footer_rows"]) for r in cat["ingest_metrics"].collect()}
    assert metrics == {"s": (6, 3, 1), "head": (0, 0, 0)}


def test_links_know_their_lines(spark):
    html = "<table><tr><td>" + "".join(f'<a href="u{i}">x</a>{"<br>" if i % 2 else " "}' for i in range(40)) + "</td></tr></table>"
    cell = explode_cells(sheet_rows(spark.createDataFrame([("s", html)], "sheet_id string, html string"))).first()
    assert cell["links"] == [f"u{i}" for i in range(40)] and cell["link_lines"] == [i // 2 for i in range(40)]


def test_columns_that_a_header_does_not_name_have_default_places(spark):
    """Era, name and notes stand in the first three columns unless the header says otherwise."""
    html = "<table><tr><td>What</td><td>Who</td><td>Why</td><td>Quality</td><td>Link(s)</td></tr>" + row("1 Full", "Rodeo", "(2001) (x)", "", "") + row("Rodeo", "A", "OG Filename: f", "HQ", '<a href="http://a.b">x</a>') + "</table>"
    cat = read_catalogue(spark.createDataFrame([("s", html)], "sheet_id string, html string"))
    r = cat["versions"].first()
    assert (r["name"], r["og_filename"], r["quality"], r["links"]) == ("A", "f", "HQ", ["http://a.b"])
    assert len(cat["eras"].first()["timeline"]) == 1 and set(cat["layout"].first()["fields"]) == {"quality", "links"}


def test_first_rows_are_the_first_of_all_rows(spark):
    html = "<table>" + "".join(f"<tr><td>Era</td><td>Name</td><td>t{i} &amp; x<br>y</td></tr>" for i in range(40)) + "</table>"
    sheets = spark.createDataFrame([("s", html), ("short", "<table><tr><td>x</td></tr></table>"), ("none", "<p>")], "sheet_id string, html string")
    every = sheet_rows(sheets).orderBy("sheet_id", "row_idx").collect()
    first = head_rows(sheets).orderBy("sheet_id", "row_idx").collect()
    assert first == [r for r in every if r["row_idx"] < 11] and len(first) == 12


def test_sheets_are_made_where_their_rows_are(spark, sf_dir):
    """Narrow rows are spread once; no text of a sheet is shuffled, and parts are not broadcast by their file's size."""
    for sheets in (mixed_sheets(spark, sf_dir), rendered_sheets(spark, sf_dir)):
        plan = sheets._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3 and "Broadcast" not in plan


def test_rows_are_read_for_what_they_can_be_only(spark):
    """Names beside many cells have no keys of eras, and a footer's words are not found across two cells."""
    long = "<tr><td></td><td>Alone<br>b</td><td>n</td><td>Full</td><td>HQ</td></tr>"
    split = "<tr><td>total</td><td>links</td></tr><tr><td></td><td>Total LINKS</td></tr>"
    html = "<table><tr><td>Era</td><td>Name</td><td>Notes</td><td>Available Length</td><td>Quality</td></tr>" + long + "<tr><td></td><td>Alone</td></tr>" + split + "</table>"
    got = describe_rows(project_fields(sheet_rows(spark.createDataFrame([("s", html)], "sheet_id string, html string")))).orderBy("row_idx").collect()
    assert [(r["kind"], r["line_keys"]) for r in got] == [("row", []), ("row", ["alone"]), ("row", []), ("footer", [])]
    assert got[0]["version_name"] == "Alone" and got[0]["alt_titles"] == ["b"]


def test_an_era_opened_by_name_knows_its_key_after_a_song_of_that_name(spark):
    html = "<table><tr><td>Era</td><td>Name</td><td>Notes</td><td>Quality</td></tr><tr><td>Alpha</td><td>Beta</td><td>n</td><td>HQ</td></tr><tr><td></td><td>Beta<br>(2001)</td></tr><tr><td>Gamma</td><td></td><td>x</td><td>LQ</td></tr></table>"
    cat = read_catalogue(spark.createDataFrame([("s", html)], "sheet_id string, html string"))
    assert [r["name"] for r in cat["eras"].orderBy("era_idx").collect()] == ["Alpha", "Beta", "Gamma"]


def test_era_texts_are_read_once_a_sheet(spark):
    rows = [("s", "Rodeo [V2]"), ("s", "Rodeo [V2]"), ("s", "Links"), ("s", None), ("t", "Ab / Cd")] * 3
    got = [tuple(r) for r in era_texts(spark.createDataFrame(rows, "sheet_id string, era string")).orderBy("sheet_id", "era").collect()]
    assert got == [("s", "Links", "links", "links", ["links"], False), ("s", "Rodeo [V2]", "rodeo [v2]", "rodeo", ["rodeo", "rodeo [v2]"], True), ("t", "Ab / Cd", "ab / cd", "ab / cd", ["ab / cd", "ab", "cd"], True)]


def test_kept_tables_are_never_collected_for_a_join(spark):
    # their files are a few bytes a thousand rows, which says nothing of the rows
    rows = spark.range(200_000).selectExpr("'a sheet' as sheet_id", "id as row_idx", "'song' as action")
    one, two = materialise_large(rows, "one"), materialise_large(rows, "two")
    joined = one.filter("action = 'song'").select("sheet_id", "row_idx").join(two.groupBy("sheet_id", "row_idx").count(), ["sheet_id", "row_idx"])
    assert joined.count() == 200_000
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_era_texts_are_read_by_all_tasks(spark):
    rows = spark.range(4000).selectExpr("concat('sheet', id % 400) as sheet_id", "concat('Era ', id) as era")
    got = era_texts(rows)
    assert got.count() == 4000 and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_jvm_compiles_what_makes_sheets(spark, sf_dir):
    """It leaves methods of over 8000 bytes to its interpreter."""
    for sheets in (mixed_sheets(spark, sf_dir), rendered_sheets(spark, sf_dir)):
        sheets.collect()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        parts = getattr(debug, "MODULE$").codegenStringSeq(sheets._jdf.queryExecution().executedPlan())
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
        assert sizes and max(sizes) < 8000


def test_whole_cells_are_read_at_once():
    """As the same cells tag by tag: these are cut one tag at a time where anything but texts and breaks stands in them."""
    simple = "<table>" + "<tr>" + '<TD class="s7"> a &amp; b<br>c </td>' * 50 + "</tr></table>"
    assert sum(1 for _ in _tags(simple, TAGS)) == 50 + 5
    plain, tagged = CellColumns(), CellColumns()
    odd = '<td>outside</td><table><tr><td colspan="3">x&lt<br>y</td><td><a href="u">open<td>1<br>2</td></a><td>kept<tr><td>z</td></tr><td>lost</td></table>'
    for columns, html in ((plain, simple + odd), (tagged, (simple + odd).replace("</td>", "<b></b></td>"))):
        columns.scan(html, {"s7": "#1"})
    assert plain.__dict__ == tagged.__dict__
    assert plain.texts[0] == "a & b\nc" and plain.colors[0] == "#1" and plain.texts[50:] == ["z"]


def test_texts_that_the_scan_has_stripped_are_not_stripped_again(spark):
    texts = [f"x {w.title()} y" for w in FOOTER_WORDS] + ["Total", "guide", "an editor", "tracks"]
    html = "<table>" + HEAD + "".join(row("", f"   {t}\x1c ", "a<br> ", "HQ", "") for t in texts) + "</table>"
    fields = project_fields(materialise_large(sheet_rows(spark.createDataFrame([("s", html)], "sheet_id string, html string")), "rows"))
    got = describe_rows(fields).orderBy("row_idx").collect()
    assert [(r["row_text"] or r["kind"], r["notes"]) for r in got] == [("footer", "a")] * len(FOOTER_WORDS) + [(f"{t} | a | HQ", "a") for t in texts[len(FOOTER_WORDS) :]]
    assert "trim" not in fields.select("filled", "name", "era", "quality")._jdf.queryExecution().optimizedPlan().toString()


def test_the_fold_reads_values_as_they_are():
    """Columns of every kind, in pieces and with nulls, as Arrow's own slow reading gives them."""
    head = pa.struct([("era_name", pa.string()), ("header_keys", pa.list_(pa.string()))])
    for kind, values in (
        (pa.string(), ["a", None, "", "é"]), (pa.string(), [None, None]), (pa.int32(), [3, 1]), (pa.int32(), [3, None]), (pa.bool_(), [True, False]), (pa.bool_(), [None, False]),
        (head, [None, {"era_name": None, "header_keys": None}, {"era_name": "x", "header_keys": ["k", None]}, None]), (head, [None, None]), (pa.list_(pa.string()), [["a"], None, []]),
    ):
        column = pa.chunked_array([pa.array(values, kind), pa.array(values[1:], kind)])
        got = resolve._values(column)
        assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist()))
