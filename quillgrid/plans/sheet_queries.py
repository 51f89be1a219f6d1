"""Registered queries that read rendered sheets and pages back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.operators.columns import detect_layout, diff_layouts, field_matrix, layout_columns, missing_fields, project_fields
from quillgrid.operators.notices import notices
from quillgrid.operators.songs import flatten_catalog
from quillgrid.operators.stats import availability_stats, nameless_rows, reconcile_sheets, sheet_stats
from quillgrid.operators.tabs import canonical_urls, dedup_urls, resolve_artist, select_tab
from quillgrid.plans.catalogue import NESTED, read_catalogue
from quillgrid.plans.fixtures import LAYOUTS, MIXED, SHEET_ITEMS, mixed_sheets, rendered_sheets, table
from quillgrid.scratch import materialise, new_folder
from quillgrid.sources.feeds import read_discovery, read_links
from quillgrid.sources.html import attribute, discover_sheets, discover_tabs, head_rows, plain_text, preview_cells, read_sheets, sheet_class_colors, sheet_profile, sheet_rows, stream_sheets

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    SHEET_ITEMS + "SELECT sheet_id, era, count(*) AS total, count(*) FILTER (l_quantity < 25) AS available, count(*) FILTER (available_length = 'Snippet') AS snippets, "
    "floor(100.0 * count(*) FILTER (l_quantity < 25) / count(*) + 0.5)::BIGINT AS percent FROM i GROUP BY ALL"
)
def sheet_roundtrip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01/02, PRJ-01..03, FLT, WN, JN-05, EN-01..06, AG-03 in one: per sheet and era the availability."""
    cat = read_catalogue(rendered_sheets(spark, sf_dir), fields=("available_length", "quality", "badge", "links"))
    stats = availability_stats(cat["versions"], ["sheet_id", "era_idx"])
    return stats.join(cat["eras"].select("sheet_id", "era_idx", F.col("name").alias("era")), ["sheet_id", "era_idx"]).select("sheet_id", "era", "total", "available", "snippets", "percent")


@query(
    SHEET_ITEMS + "SELECT sheet_id, era, name, 'V' || l_linenumber AS version_tag, CASE WHEN badge0 IN ('best', 'special') THEN badge0 END AS badge, p_brand || ' & Co' AS producers, available_length, quality, "
    "'f' || l_partkey AS og_filename, '#4caf50' AS quality_color, CASE WHEN l_quantity < 25 THEN 'https://pillows.su/f/' || l_orderkey END AS link FROM i"
)
def sheet_roundtrip_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = read_catalogue(rendered_sheets(spark, sf_dir), fields=("version_tag", "badge", "producers", "available_length", "quality", "og_filename", "quality_color", "links"))
    named = cat["versions"].join(cat["eras"].select("sheet_id", "era_idx", F.col("name").alias("era")), ["sheet_id", "era_idx"])
    return named.select("sheet_id", "era", "name", "version_tag", "badge", "producers", "available_length", "quality", "og_filename", "quality_color", L.first_streamable(F.col("links")).alias("link"))


@query(
    SHEET_ITEMS + "SELECT sheet_id, era AS name, 'the ' || lower(era) || ' years' AS alt_names, 'All about ' || era AS description, 2::BIGINT AS n_events, count(*) FILTER (available_length = 'Full') AS declared_full, "
    "count(*) AS declared_total, count(DISTINCT name) AS n_songs FROM i GROUP BY ALL"
)
def sheet_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-08/09, AG-05: header rows with their declared statistics."""
    eras = read_catalogue(rendered_sheets(spark, sf_dir), fields=())["eras"]
    return eras.select("sheet_id", "name", F.array_join("alt_names", "|").alias("alt_names"), "description", F.size("timeline").cast("long").alias("n_events"), F.col("full").alias("declared_full"), "declared_total", F.col("n_songs").cast("long").alias("n_songs"))


@query(SHEET_ITEMS + "SELECT sheet_id, count(*) + count(DISTINCT era) + 2 AS total_rows, count(*) AS song_rows, 0::BIGINT AS skipped_rows, 2::BIGINT AS footer_rows, 0::BIGINT AS fuzzy_rows FROM i GROUP BY ALL")
def sheet_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07, WN-02."""
    return read_catalogue(rendered_sheets(spark, sf_dir), fields=())["ingest_metrics"].drop("unmatched")


_SUPPLIERS = "s AS (SELECT DISTINCT l_suppkey, 'sup-' || l_suppkey AS sheet_id, l_suppkey % 4 AS layout FROM lineitem JOIN part ON l_partkey = p_partkey)"
_FIELDS = "f(layout, field, col_idx) AS (VALUES " + ", ".join(f"({k}, '{f}', {i})" for k, fields in enumerate(LAYOUTS) for i, (_, f) in enumerate(fields)) + ")"


def _columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A row a sheet, kept, as what follows reads it more than once."""
    layout = materialise(detect_layout(head_rows(mixed_sheets(spark, sf_dir))), "layouts")
    return layout, layout_columns(layout)


@query(f"WITH {_SUPPLIERS}, {_FIELDS} SELECT sheet_id, CASE layout WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 1 END::BIGINT AS header_row, field, col_idx::BIGINT AS col_idx FROM s JOIN f USING (layout)")
def sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01/02: four layouts, by equal aliases, their beginnings, parentheses and single lines; the header in three places."""
    layout, _ = _columns(spark, sf_dir)
    return layout.select("sheet_id", F.col("header_row").cast("long").alias("header_row"), F.explode("fields").alias("field", "col_idx")).withColumn("col_idx", F.col("col_idx").cast("long"))


@query(f"WITH {_SUPPLIERS}, {_FIELDS} SELECT field, count(DISTINCT sheet_id) AS n_sheets, count(DISTINCT col_idx) AS n_positions, count(DISTINCT col_idx) > 1 AS differs FROM s JOIN f USING (layout) GROUP BY field")
def layout_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04 in numbers."""
    return diff_layouts(_columns(spark, sf_dir)[1])


@query(f"WITH {_SUPPLIERS}, {_FIELDS} SELECT n.field, s.sheet_id, f.col_idx::BIGINT AS col_idx FROM s CROSS JOIN (SELECT DISTINCT field FROM f JOIN s USING (layout)) n LEFT JOIN f ON f.layout = s.layout AND f.field = n.field")
def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04: every field's column in every sheet."""
    layout, columns = _columns(spark, sf_dir)
    return field_matrix(columns, layout).withColumn("col_idx", F.col("col_idx").cast("long"))


@query(
    f"WITH {_SUPPLIERS} SELECT sheet_id, CASE layout WHEN 0 THEN 'alt_links,date_of_recording,file_date,leak_date,track_length,type' WHEN 1 THEN 'date_of_recording,file_date,leak_date,track_length,type' "
    "WHEN 2 THEN 'alt_links,date_of_recording,file_date,track_length,type' ELSE 'alt_links,available_length,date_of_recording,file_date,leak_date,track_length,type' END AS missing, CASE WHEN layout = 3 THEN 'streaming' ELSE '' END AS unusual FROM s"
)
def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, ST-04."""
    gaps = missing_fields(_columns(spark, sf_dir)[1])
    return gaps.select("sheet_id", F.array_join("missing", ",").alias("missing"), F.array_join("unusual", ",").alias("unusual"))


@query(f"WITH {_SUPPLIERS}, c(layout, css_class, bg_color) AS (VALUES (0, 's7', '#4caf50'), (1, 's7', '#0102ff'), (2, 's8', '#123')) SELECT sheet_id, css_class, bg_color FROM s JOIN c USING (layout)")
def sheet_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: colours in three spellings; neutral and missing ones do not count."""
    return sheet_class_colors(mixed_sheets(spark, sf_dir))


@query(
    f"""WITH {_SUPPLIERS}, n(layout, ord, text, link, kind) AS (VALUES (0, 0, 'Sheet of the supplier ★ all links are down, no ETA', 'https://a.b/down', 'alert'), (2, 0, 'join us at discord', NULL, 'info'),
(2, 1, 'Welcome to the catalogue', NULL, 'info'), (2, 2, 'Read the rules first', 'https://a.b/rules', 'info'), (3, 0, 'All about the supplier', NULL, 'info')) SELECT sheet_id, ord::BIGINT AS ord, text, link, kind FROM s JOIN n USING (layout)"""
)
def sheet_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02, JN-11: notices in and above the header, with the links of their lines."""
    return notices(head_rows(mixed_sheets(spark, sf_dir))).select("sheet_id", F.col("ord").cast("long").alias("ord"), "text", "link", "kind")


@query(
    f"""WITH {_SUPPLIERS}, p(layout, row_idx, col_idx, text, n_links) AS (VALUES (0, 0, 0, 'Sheet of the supplier ★ all links are down, no ETA', 1), (0, 0, 1, '', 0), (0, 1, 0, 'Era', 0), (0, 1, 1, 'Name (and credits)', 0), (1, 0, 0, 'Era', 0), (1, 0, 1, 'Title', 0), (1, 1, 0, 'Links', 0), (1, 1, 1, '', 0),
(2, 0, 0, 'Welcome to the catalogue', 0), (2, 1, 0, 'My Tracker', 0), (3, 0, 0, '', 0), (3, 0, 1, 'All about the supplier', 0), (3, 1, 0, 'Era', 0), (3, 1, 1, 'Name', 0)) SELECT sheet_id, row_idx::BIGINT AS row_idx, col_idx::BIGINT AS col_idx, text, n_links::BIGINT AS n_links FROM s JOIN p USING (layout)"""
)
def sheet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SRC-12."""
    cells = preview_cells(head_rows(mixed_sheets(spark, sf_dir)), 0, 2, 2)
    return cells.select("sheet_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"), "text", F.col("n_links").cast("long").alias("n_links"))


# ---------------------------------------------------------------- the whole job over sheets of several layouts


@query(
    MIXED + """SELECT sheet_id, CASE p_type WHEN 'LARGE' THEN 'LARGE [Phase 1]' ELSE p_type END AS name, CASE p_type WHEN 'ECONOMY' THEN 'auto' WHEN 'MEDIUM' THEN 'name' ELSE 'header' END AS origin, CASE p_type WHEN 'SMALL' THEN 'the small years' ELSE '' END AS alt_names,
CASE p_type WHEN 'LARGE' THEN 'The stub of LARGE' WHEN 'MEDIUM' THEN 'Notes of MEDIUM' WHEN 'ECONOMY' THEN NULL ELSE 'All about ' || p_type END AS description, CASE p_type WHEN 'SMALL' THEN 2 WHEN 'PROMO' THEN 2 WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 1 ELSE 0 END::BIGINT AS n_events,
CASE p_type WHEN 'MEDIUM' THEN 'http://img/m' WHEN 'ECONOMY' THEN 'http://img/e' END AS art_url, CASE WHEN p_type IN ('MEDIUM', 'ECONOMY') THEN 0 WHEN p_type = 'STANDARD' THEN count(*) + 2 ELSE count(*) END AS declared_total, count(DISTINCT p_name) AS n_songs, count(*) AS n_versions FROM i GROUP BY sheet_id, p_type"""
)
def catalogue_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05 in all its ways, JN-14, ST-03, EN-08/09, AG-05: what the rows that open an era say of it, stubs merged."""
    eras = read_catalogue(mixed_sheets(spark, sf_dir), fields=())["eras"]
    return eras.select("sheet_id", "name", "origin", F.array_join("alt_names", "|").alias("alt_names"), "description", F.size("timeline").cast("long").alias("n_events"), "art_url", "declared_total", F.col("n_songs").cast("long").alias("n_songs"), F.col("n_versions").cast("long").alias("n_versions"))


@query(
    MIXED + "SELECT sheet_id, p_type AS era, CASE WHEN late THEN 'Demos' END AS section, CASE WHEN late THEN CASE p_type WHEN 'SMALL' THEN 'WLR Higher Files' WHEN 'LARGE' THEN 'Uncut Reels' WHEN 'MEDIUM' THEN 'Bonus Disc' END END AS grp, count(DISTINCT p_name) AS n_songs FROM i GROUP BY sheet_id, p_type, late"
)
def catalogue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-05, FLT-06, WN-03/04: separators and labels of three kinds, which group the section after them."""
    cat = read_catalogue(mixed_sheets(spark, sf_dir), fields=())
    named = cat["sections"].join(cat["eras"].select("sheet_id", "era_idx", F.split("name", " ")[0].alias("era")), ["sheet_id", "era_idx"])
    return named.select("sheet_id", "era", F.col("name").alias("section"), F.col("group").alias("grp"), F.col("n_songs").cast("long").alias("n_songs"))


@query(
    MIXED + """, k AS (SELECT sheet_id, p_type, CASE p_type WHEN 'PROMO' THEN 'position' WHEN 'SMALL' THEN CASE l_linenumber WHEN 7 THEN 'key' WHEN 5 THEN 'fuzzy' WHEN 4 THEN 'acronym' ELSE 'exact' END WHEN 'STANDARD' THEN CASE WHEN rn = 1 THEN 'backfill' ELSE 'exact' END
WHEN 'LARGE' THEN CASE WHEN l_linenumber = 5 AND odd = 1 THEN 'learnt' ELSE 'exact' END ELSE 'exact' END AS match_kind, (l_quantity < 25)::INT + (l_suppkey % 4 = 1)::INT AS n_links FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, p_type ORDER BY late, l_orderkey, l_linenumber, l_partkey) AS rn, row_number() OVER (PARTITION BY sheet_id, p_type, l_linenumber ORDER BY l_orderkey, l_partkey) AS odd FROM i))
SELECT sheet_id, p_type AS era, match_kind, count(*) AS n, sum(n_links)::BIGINT AS n_links FROM k GROUP BY ALL"""
)
def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02..05, FLT-08, ST-01: how song rows find their eras, and the links of their two columns."""
    cat = read_catalogue(mixed_sheets(spark, sf_dir), fields=("links",))
    named = cat["versions"].join(cat["eras"].select("sheet_id", "era_idx", F.split("name", " ")[0].alias("era")), ["sheet_id", "era_idx"])
    return named.groupBy("sheet_id", "era", "match_kind").agg(F.count("*").alias("n"), F.sum(F.size("links")).alias("n_links"))


@query(
    MIXED + """SELECT sheet_id, count(*) + 20 AS total_rows, count(*) AS song_rows, 1::BIGINT AS skipped_rows, 3::BIGINT AS footer_rows, count(*) FILTER (p_type = 'SMALL' AND l_linenumber IN (4, 5)) AS fuzzy_rows,
'Row ' || CASE l_suppkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 2 END || ': Links | see' AS unmatched FROM i GROUP BY sheet_id, l_suppkey"""
)
def catalogue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07, WN-02, FLT-03/07: rows by what became of them."""
    return read_catalogue(mixed_sheets(spark, sf_dir), fields=())["ingest_metrics"].withColumn("unmatched", F.array_join("unmatched", ";"))


@query(
    MIXED + """, e AS (SELECT sheet_id, l_suppkey, p_type, count(DISTINCT p_name) AS songs, count(*) AS n, count(*) FILTER (l_linenumber % 6 = 0) AS f FROM i GROUP BY ALL)
SELECT sheet_id, 'Artist ' || l_suppkey AS artist_name, 'artist-' || l_suppkey AS slug, count(*) AS n_eras, sum(songs)::BIGINT AS n_songs, sum(n)::BIGINT AS n_versions, arg_min(CASE p_type WHEN 'ECONOMY' THEN 'http://img/e' WHEN 'MEDIUM' THEN 'http://img/m' END, p_type) FILTER (p_type IN ('ECONOMY', 'MEDIUM')) AS art_url,
count(*) FILTER (p_type IN ('LARGE', 'PROMO', 'SMALL')) AS n_match, count(*) FILTER (p_type = 'STANDARD') AS n_mismatch, coalesce(sum(f) FILTER (p_type IN ('LARGE', 'PROMO', 'SMALL', 'STANDARD')), 0)::BIGINT AS full_eras, sum(n)::BIGINT AS total_links, 5::BIGINT AS total_full FROM e GROUP BY sheet_id, l_suppkey"""
)
def catalogue_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01/02, AG-06, JN-13 for whole sheets, SRC-08's artist row."""
    sheets = mixed_sheets(spark, sf_dir)
    cat = read_catalogue(sheets, fields=("links",), names=sheets.select("sheet_id", F.concat(F.lit("Artist "), F.substring("sheet_id", 5, 20)).alias("artist_name")))
    told = reconcile_sheets(cat["eras"], cat["sheet_stats"]).select("sheet_id", "n_match", "n_mismatch", "full_eras")
    return cat["artists"].drop("n_links").join(told, "sheet_id").join(cat["sheet_stats"].select("sheet_id", "total_links", "total_full"), "sheet_id")


@query(MIXED + "SELECT sheet_id, p_type AS era, CASE WHEN late THEN 'Demos' END AS section, p_name AS base_name, 'V' || l_linenumber AS version_tag, count(*) AS n FROM i GROUP BY ALL")
def catalogue_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: the nested catalogue of the job, taken apart again; a song stands in the section where it is seen first or again."""
    flat = flatten_catalog(read_catalogue(mixed_sheets(spark, sf_dir), fields=NESTED)["nested"])
    return flat.groupBy("sheet_id", F.split("era_name", " ")[0].alias("era"), F.col("section_name").alias("section"), "base_name", "version_tag").agg(F.count("*").alias("n"))


@query(
    MIXED + """, x(p_type, k, era, texts) AS (VALUES ('ECONOMY', 0, 'ECONOMY', 'ECONOMY|(2001) (begun)|x|y'), ('SMALL', 1, NULL, 'WLR Higher Files'), ('STANDARD', 2, 'stats', 'All about STANDARD'))
SELECT sheet_id, p_type, count(*) AS n FROM (SELECT DISTINCT sheet_id, p_type FROM i) JOIN x USING (p_type) GROUP BY ALL"""
)
def rows_without_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13: rows with texts but no name, told by what they say."""
    rows = nameless_rows(project_fields(sheet_rows(mixed_sheets(spark, sf_dir))))
    said = F.array_join("texts", " ")
    kind = F.when(said.contains("ECONOMY"), "ECONOMY").when(said.contains("WLR Higher"), "SMALL").when(said.contains("All about STANDARD"), "STANDARD")
    return rows.select("sheet_id", kind.alias("p_type")).filter("p_type is not null").groupBy("sheet_id", "p_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources, written to the shared folder and read back


_LINKS = "SELECT n AS total_links, count(*) AS n_sheets FROM (SELECT l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) GROUP BY 1"


def _sheet_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one file for each sheet."""
    path = new_folder(spark, "sheet-files")
    mixed_sheets(spark, sf_dir).select("html").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(_LINKS)
def sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: whole files as sheets."""
    stats = sheet_stats(sheet_rows(read_sheets(spark, _sheet_files(spark, sf_dir))))
    return stats.groupBy("total_links").agg(F.count("*").alias("n_sheets"))


@query(
    f"WITH {_SUPPLIERS} SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Artist ' || l_suppkey ELSE sheet_id END AS name, sheet_id || ' - Google Drive' AS folder, "
    "CASE WHEN l_suppkey % 2 = 0 THEN row_number() OVER (ORDER BY l_suppkey % 2, l_suppkey) END AS ord, l_suppkey % 4 AS layout FROM s"
)
def known_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, JN-08: folders of saved sheets; the known ones, half of them, by their names and in their order."""
    path = new_folder(spark, "sheet-folders")
    sheets = mixed_sheets(spark, sf_dir).withColumn("folder", F.concat("sheet_id", F.lit(" - Google Drive_files")))
    sheets.select("html", "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    key = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").filter(key % 2 == 0).select(F.concat(F.lit("sup-"), key.cast("string"), F.lit(" - Google Drive")).alias("folder"), F.concat(F.lit("Artist "), key.cast("string")).alias("name"), key.cast("int").alias("ord"))
    found = discover_sheets(spark, path, known, r"/folder=([^/]+)_files/part-[^/]+$").withColumn("ord", F.when(F.col("name").startswith("Artist"), F.monotonically_increasing_id()))
    layouts = detect_layout(sheet_rows(found.withColumnRenamed("folder", "sheet_id")))
    kind = F.when(F.map_contains_key("fields", F.lit("streaming")), 3).when(F.map_contains_key("fields", F.lit("leak_date")), 2).when(F.map_contains_key("fields", F.lit("alt_links")), 1).otherwise(0)
    placed = found.select("name", "folder", "ord").join(layouts.select(F.col("sheet_id").alias("folder"), kind.cast("long").alias("layout")), "folder")
    first = Window.orderBy("ord")
    return placed.filter("ord is not null").withColumn("ord", F.row_number().over(first).cast("long")).unionByName(placed.filter("ord is null")).select("name", "folder", "ord", "layout")


@query(_LINKS)
def sheet_files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05: the same from a stream of new files, in several batches by bytes."""
    rows = sheet_rows(stream_sheets(spark, _sheet_files(spark, sf_dir), batch_bytes=32 << 20))
    path = new_folder(spark, "streamed-rows")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return sheet_stats(spark.read.schema(rows.schema).parquet(path)).groupBy("total_links").agg(F.count("*").alias("n_sheets"))


@query("SELECT c_name AS name, 'https://x/' || c_custkey AS url, c_mktsegment AS credit FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 25")
def discovery_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: a feed's first entries, in its order, of those that its filters leave."""
    c, path = table(spark, sf_dir, "customer"), new_folder(spark, "feed")
    key = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("https://docs.google.com/document/d/"), key)).otherwise(F.concat(F.lit("https://x/"), key))
    c.orderBy("c_custkey").select(F.col("c_name").alias("name"), url.alias("url"), F.col("c_mktsegment").alias("credit"), F.lit(1).alias("links_work"), F.lit(1).alias("updated"), (F.col("c_mktsegment") == "BUILDING").alias("best")).write.json(path)
    return read_discovery(spark, path, best_only=True, name_like="1", limit=25).select("name", "url", "credit")


@query("SELECT 'https://x/' || o_orderkey AS url FROM orders WHERE o_orderkey % 3 = 0")
def link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: lines with links, between comments and blank lines."""
    path, key = new_folder(spark, "links"), F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.concat(F.lit("  https://x/"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("# https://x/"), key.cast("string"))).otherwise("   ")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return read_links(spark, path)


@query(
    r"SELECT page_id::VARCHAR AS sheet_id, length(html)::BIGINT AS n_chars, len(regexp_extract_all(html, '(?i)<tr\b'))::BIGINT AS n_rows, len(regexp_extract_all(html, '(?i)<th\b'))::BIGINT AS n_header_cells, "
    r"len(regexp_extract_all(html, '(?i)<img\b'))::BIGINT AS n_images FROM pages"
)
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14."""
    return sheet_profile(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("sheet_id"), "html"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a [^>]*href="[^"]+"'))::BIGINT AS n_links, nullif(regexp_extract(html, '(?i)<a [^>]*href="([^"]+)"', 1), '') AS first_link,
    length(regexp_extract(html, '(?s)<title>([^<]*)</title>', 1))::BIGINT AS raw_title FROM pages"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01's link rule on raw pages."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    targets = F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.size(targets).cast("long").alias("n_links"), F.get(targets, F.lit(0)).alias("first_link"), F.length(F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1)).cast("long").alias("raw_title"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages".replace('\\"', '"'))
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of SRC-01."""
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1)).alias("title"))


@query(
    r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS domain, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(?:.*\.)?example\.(?:com|org)$') AS allowed FROM pages"
)
def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-19, FLT-15."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", L.display_domain(url).alias("domain"), L.allowed_domain(url, (), ("example.com", "example.org")).alias("allowed"))


_BOOKS = "SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'https://' END || 'docs.google.com/spreadsheets/' || CASE WHEN o_custkey % 2 = 0 THEN 'u/1/' ELSE '' END || 'd/K' || o_custkey || '/edit' || CASE WHEN o_orderkey % 2 = 0 THEN '#gid=' || (o_orderkey % 9) ELSE '' END AS url, o_custkey, o_orderkey FROM orders"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.concat(
        F.when(F.col("o_custkey") % 3 == 0, "").otherwise("https://"), F.lit("docs.google.com/spreadsheets/"), F.when(F.col("o_custkey") % 2 == 0, "u/1/").otherwise(""), F.lit("d/K"),
        F.col("o_custkey").cast("string"), F.lit("/edit"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("#gid="), (F.col("o_orderkey") % 9).cast("string"))).otherwise(""),
    )
    return o.select(F.col("o_orderkey").alias("ord"), url.alias("url"))


@query(
    f"WITH b AS ({_BOOKS}) SELECT ord, 'https://docs.google.com/spreadsheets/d/K' || o_custkey || '/htmlview' AS sheet_url, 'K' || o_custkey AS workbook_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 9)::VARCHAR END AS gid, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'https://docs.google.com/spreadsheets/d/K' || o_custkey || '/htmlview/sheet?headers=true&gid=' || (o_orderkey % 9) END AS tab_url FROM b"
)
def url_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13."""
    return canonical_urls(_books(spark, sf_dir)).drop("url")


@query(f"WITH b AS ({_BOOKS}) SELECT ord, 'K' || o_custkey AS workbook_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 = 0 DESC, ord) AS rn FROM b) WHERE rn = 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-07."""
    return dedup_urls(_books(spark, sf_dir)).select("ord", "workbook_id")


@query(
    "SELECT c_custkey AS workbook_id, t.ord::BIGINT AS tab_ord, CASE t.ord WHEN 0 THEN '000' || c_custkey WHEN 1 THEN c_custkey::VARCHAR ELSE '00' || c_custkey END AS gid, CASE t.ord WHEN 0 THEN 'Recent' WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '🔥 Unreleased' ELSE 'Part ' || c_custkey END ELSE 'Album Art' END AS tab_name, "
    "CASE t.ord WHEN 0 THEN 'other' WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'other' END ELSE 'art' END AS role FROM customer, (VALUES (0), (1), (2)) t(ord) WHERE t.ord < 2 OR c_custkey % 2 = 0"
)
def workbook_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, EN-14: workbooks with a main tab or without, with an art tab or without."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    js = F.concat(
        F.lit('items.push({name: "Recent", pageUrl: "x", gid: "000'), key, F.lit('"});items.push({name: "'), F.when(F.col("c_custkey") % 3 == 0, "🔥 Unreleased").otherwise(F.concat(F.lit("Part "), key)), F.lit('", gid: "'), key, F.lit('"});'),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('items.push({name: "Album Art", gid: "00'), key, F.lit('"});'))).otherwise(""), F.lit('items.push({name: "Again", gid: "000'), key, F.lit('"});'),
    )
    return discover_tabs(c.select(F.col("c_custkey").alias("workbook_id"), F.concat("c_name", js).alias("html"))).withColumn("tab_ord", F.col("tab_ord").cast("long"))


@query("SELECT c_custkey AS workbook_id, CASE WHEN c_custkey % 5 = 0 THEN 'Given ' || c_custkey WHEN c_custkey % 2 = 0 THEN 'Tab ' || c_custkey ELSE c_name END AS artist FROM customer")
def workbook_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-13: a given name before a sheet tab's before the title's."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    html = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<li class="x sheet-tab y"> </li><li class="docs-sheet-tab">Tab '), key, F.lit(" Tracker</li>"))).otherwise("<p>none</p>")
    given = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Given "), key)).otherwise("")
    return c.select(F.col("c_custkey").alias("workbook_id"), resolve_artist(given, html, F.concat("c_name", F.lit(" Tracker - Google Drive"))).alias("artist"))


@query(
    """WITH t AS (SELECT o_custkey AS workbook_id, o_orderkey AS tab_ord, o_orderkey::VARCHAR AS gid, o_orderstatus = 'P' AS is_main, (floor(o_totalprice)::BIGINT % 7) AS n_eras, (floor(o_totalprice)::BIGINT % 3) AS n_songs FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY workbook_id ORDER BY NOT is_main, tab_ord) AS pos FROM t),
e AS (SELECT workbook_id, min(pos) FILTER ((is_main AND n_eras >= 1) OR n_eras >= 5) AS stop FROM p GROUP BY 1),
c AS (SELECT p.*, row_number() OVER (PARTITION BY p.workbook_id ORDER BY n_eras DESC, n_songs > 0 DESC, CASE WHEN n_songs > 0 THEN -pos ELSE pos END) AS rn FROM p JOIN e USING (workbook_id) WHERE pos <= coalesce(stop, 1000000) AND n_eras > 0)
SELECT workbook_id, gid, n_eras FROM c WHERE rn = 1"""
)
def workbook_best_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17."""
    price = F.floor("o_totalprice")
    o = table(spark, sf_dir, "orders")
    tabs = o.select(F.col("o_custkey").alias("workbook_id"), F.col("o_orderkey").alias("tab_ord"), F.col("o_orderkey").cast("string").alias("gid"), F.when(F.col("o_orderstatus") == "P", "main").otherwise("other").alias("role"), (price % 7).alias("n_eras"), (price % 3).alias("n_songs"))
    return select_tab(tabs)


_COUNTERS = {
    "sources_needed": (4, "Sources Needed"), "not_available_links": (5, "Not Available"), "lossless": (7, "Lossless"), "cd_quality": (8, "CD Quality"), "high_quality": (9, "High Quality"), "low_quality": (10, "Low Quality"), "recordings": (11, "Recordings"),
    "not_available_quality": (12, "Not Available"), "og_files": (2, "OG File(s)"), "stem_bounces": (13, "Stem Bounces"), "full": (14, "Full"), "tagged": (15, "Tagged"), "partial": (16, "Partial"), "snippets": (17, "Snippets"), "unavailable": (18, "Unavailable"),
    "best_of": (1, "Best Of"), "special": (19, "Special"), "grails": (3, "Grails"), "wanted": (20, "Wanted"), "worst_of": (21, "Worst Of"),
}


@query(
    "SELECT 'book-' || (c_custkey // 60) AS sheet_id, count(*) AS total_links, sum((c_acctbal < 0)::BIGINT)::BIGINT AS missing_links, count(DISTINCT c_mktsegment) AS total_full, "
    + ", ".join(f'{n}::BIGINT AS "{c}"' for c, (n, _) in _COUNTERS.items())
    + " FROM customer GROUP BY ALL"
)
def sheet_declared_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-06: all counters of the last statistics row of sheets that declare them."""
    book = F.floor(F.col("c_custkey") / 60).alias("book")
    c = table(spark, sf_dir, "customer").groupBy(book).agg(F.count("*").alias("n"), F.sum((F.col("c_acctbal") < 0).cast("int")).alias("m"), F.countDistinct("c_mktsegment").alias("s"))
    s = lambda x: F.col(x).cast("string")
    told = lambda *names: "<br>".join(f"{_COUNTERS[c][0]} {_COUNTERS[c][1]}" for c in names)
    names = list(_COUNTERS)
    html = F.concat(
        F.lit("<table><tr><td>🔗 1 Total Links</td></tr><tr><td>🔗 "), s("n"), F.lit(" Total Links<br>❌ "), s("m"), F.lit(f" Missing Links<br>{told(*names[:2])}</td><td>{told(*names[2:8])}</td><td>"),
        s("s"), F.lit(f" Total Full<br>{told(*names[8:15])}</td><td>{told(*names[15:])}</td></tr></table>"),
    )
    rows = sheet_rows(c.select(F.concat(F.lit("book-"), s("book")).alias("sheet_id"), html.alias("html")))
    return sheet_stats(rows)
