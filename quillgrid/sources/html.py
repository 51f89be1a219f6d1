"""Sheets as HTML table exports: rows, cells, colours, tabs.

Sheets are scanned once, in batches; all is a map over the sheets, without a shuffle.
"""

from __future__ import annotations

from functools import cache, partial
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.text import let, some, squash, strip
from quillgrid.operators.columns import ALIASES, HEADER_ROWS, layout_of
from quillgrid.sources.scan import scan_batches

# Fixed: background colours without meaning.
NEUTRAL = ("#ffffff", "#fff", "#000000", "#000", "#fafafa", "#f8f9fa", "#f3f3f3", "#eeeeee", "#cccccc", "#1e1e1e", "#1a1a1a", "#1f1f1f", "#2a2a2a", "#161616", "#0f0f0f", "#0d0d0d")
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{2B50}\x{FE0F}\x{200D}]+"
# Fixed: names of the art tab and of the main tab.
ART_TABS = ("art", "album art", "cover art", "artwork", "arts", "album arts")
MAIN_TABS = ("unreleased", "leaks", "leaked", "unreleased songs", "leaked songs", "all unreleased", "all unreleased songs", "all leaks", "main", "tracker")

CELL = "struct<text:string,links:array<string>,link_lines:array<int>,images:array<string>,css_class:string,bg_color:string>"


@cache
def named_entities() -> str:
    """Names and characters of the standard table as one text for ``str_to_map``; '&amp;' is decoded apart."""
    known = {"apos": 39, **{n: c for n, c in name2codepoint.items() if n != "amp"}}
    return "\x02".join(f"{n}\x01{chr(c)}" for n, c in sorted(known.items()))


def unescape(col: Column) -> Column:
    """Decodes numeric and named entities; unknown names stay as written."""
    refs = F.array_distinct(F.regexp_extract_all(col, F.lit("&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})|(?!amp;)[A-Za-z][A-Za-z0-9]{1,7});"), F.lit(0)))

    def decode(acc: Column, ref: Column) -> Column:
        body = F.substring(ref, F.lit(3), F.length(ref) - 3)
        code = F.when(F.lower(body).startswith("x"), F.substring(body, F.lit(2), F.length(body))).otherwise(F.conv(body, 10, 16))
        numeric = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        named = F.element_at(F.str_to_map(F.lit(named_entities()), F.lit("\x02"), F.lit("\x01")), F.substring(ref, F.lit(2), F.length(ref) - 2))
        return F.replace(acc, ref, F.coalesce(F.when(ref.startswith("&#"), numeric).otherwise(named), ref))

    return F.when(col.contains("&"), F.replace(F.aggregate(refs, col, decode), F.lit("&amp;"), F.lit("&"))).otherwise(col)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's decoded value within a tag's text, '' if missing."""
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [some(F.regexp_extract(tag, form, g)) for g in (1, 2, 3)]
    return unescape(F.coalesce(*parts, F.lit("")))


def plain_text(content: Column) -> Column:
    """Character data of a cell: breaks as newlines, image texts in place, other tags dropped."""
    broken = F.regexp_replace(content, r"(?i)<br\b[^>]*>", "\n")
    named = F.regexp_replace(F.regexp_replace(broken, r'(?is)<img\b[^>]*?\salt\s*=\s*"([^"]*)"[^>]*>', "$1"), r"(?is)<img\b[^>]*?\salt\s*=\s*'([^']*)'[^>]*>", "$1")
    bare = F.when(content.contains("<"), F.regexp_replace(named, r"(?s)<[^>]*>", "")).otherwise(content)
    return let(bare, unescape)


def class_colors(html: Column) -> Column:
    """map<class, colour> of the first style block; neutral colours do not count, the last other one does."""
    style = F.regexp_extract(html, r"(?is)<style[^>]*>(.*?)</style>", 1)
    rule = r"(?s)\.(s\d+)\s*\{([^}]+)\}"
    pairs = F.arrays_zip(F.regexp_extract_all(style, F.lit(rule), F.lit(1)).alias("cls"), F.regexp_extract_all(style, F.lit(rule), F.lit(2)).alias("body"))

    def colour(p: Column) -> Column:
        raw = F.lower(F.regexp_extract(p["body"], r"(?i)background-color\s*:\s*(#[0-9a-fA-F]{3,8}|rgba?\([^)]+\))", 1))
        nums = F.transform(F.slice(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), 1, 3), lambda n: F.lpad(F.lower(F.hex(n.cast("long"))), 2, "0"))
        value = F.when(raw.startswith("rgb"), F.when(F.size(nums) == 3, F.concat(F.lit("#"), F.array_join(nums, "")))).otherwise(some(raw))
        return F.struct(p["cls"].alias("cls"), value.alias("color"))

    kept = F.filter(F.transform(pairs, colour), lambda c: c["color"].isNotNull() & ~c["color"].isin(*NEUTRAL))
    # the last rule of a class wins: fold from the right, first come first kept
    last = F.aggregate(F.reverse(kept), F.expr("cast(array() as array<struct<cls:string,color:string>>)"), lambda acc, c: F.when(F.exists(acc, lambda a: a["cls"] == c["cls"]), acc).otherwise(F.concat(acc, F.array(c))))
    return F.map_from_entries(last)


def sheet_class_colors(sheets: DataFrame, html_col: str = "html") -> DataFrame:
    """``(sheet_id, css_class, bg_color)``."""
    return sheets.select("sheet_id", class_colors(F.col(html_col)).alias("c")).select("sheet_id", F.explode("c").alias("css_class", "bg_color"))


def sheet_rows(sheets: DataFrame, html_col: str = "html", aliases: dict[str, str] = ALIASES, most_rows: int | None = None) -> DataFrame:
    """``(sheet_id, row_idx, cells array<struct>, header_row, fields)``: table rows with a cell.

    A wide cell is followed by empty ones. The layout, ``header_row`` and ``fields``, is
    found in a sheet's first rows before they are spread, so that it needs no join. The
    texts are scanned once, see ``quillgrid.sources.scan`` for cells that are not closed and
    tables within tables. ``most_rows`` ends the scan of a sheet after so many rows, or after
    those that the layout is found in, for callers that look no further.
    """
    scan = scan_batches if most_rows is None else partial(scan_batches, most_rows=max(most_rows, HEADER_ROWS))
    read = sheets.select("sheet_id", F.col(html_col).alias("html"), class_colors(F.col(html_col)).alias("colors"))
    scanned = read.mapInArrow(scan, f"sheet_id {read.schema['sheet_id'].dataType.simpleString()}, rows array<array<{CELL}>>")
    head = F.transform(F.slice("rows", 1, HEADER_ROWS), lambda row: F.transform(row, lambda c: c["text"]))
    placed = scanned.select("sheet_id", "rows", layout_of(head, aliases).alias("_layout"))
    return placed.select("sheet_id", F.posexplode("rows").alias("row_idx", "cells"), "_layout.header_row", "_layout.fields")


def head_rows(sheets: DataFrame, html_col: str = "html", aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The first rows of ``sheet_rows``, in which a header can stand: all that layouts, notices and previews of them look at."""
    return sheet_rows(sheets, html_col, aliases, HEADER_ROWS)


def sheet_cells(sheets: DataFrame, html_col: str = "html") -> DataFrame:
    """``(sheet_id, row_idx, col_idx, text, links, link_lines, images, css_class, bg_color)``."""
    return explode_cells(sheet_rows(sheets, html_col))


def explode_cells(rows: DataFrame) -> DataFrame:
    return rows.select("sheet_id", "row_idx", F.posexplode("cells").alias("col_idx", "c")).select("sheet_id", "row_idx", "col_idx", "c.*")


def preview_cells(rows: DataFrame, start: int = 0, n: int = 10, cols: int = 8) -> DataFrame:
    """A window of raw rows: texts cut at 60 characters, number of links, class. Empty rows after the second are left out."""
    shown = rows.filter((F.col("row_idx") >= start) & (F.col("row_idx") < start + n)).filter((F.col("row_idx") <= 1) | F.exists("cells", lambda c: c["text"] != ""))
    cells = explode_cells(shown).filter(F.col("col_idx") < cols)
    text = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text"))
    return cells.select("sheet_id", "row_idx", "col_idx", text.alias("text"), F.size("links").alias("n_links"), "css_class")


def sheet_profile(sheets: DataFrame, html_col: str = "html") -> DataFrame:
    """``(sheet_id, n_chars, n_rows, n_header_cells, n_images)`` of the raw text."""
    count = lambda form: F.regexp_count(F.col(html_col), F.lit(form)).cast("long")
    return sheets.select("sheet_id", F.length(html_col).cast("long").alias("n_chars"), count(r"(?i)<tr\b").alias("n_rows"), count(r"(?i)<th\b").alias("n_header_cells"), count(r"(?i)<img\b").alias("n_images"))


def discover_tabs(pages: DataFrame, html_col: str = "html", id_col: str = "workbook_id") -> DataFrame:
    """``(workbook_id, tab_ord, gid, tab_name, role)``: gids in order of first sight, with the first name given."""
    gids = pages.select(id_col, F.posexplode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(r"gid[=:]\s*[\"']?(\d+)"), F.lit(1)))).alias("tab_ord", "gid"))
    form = r"\{name:\s*\"([^\"]+)\"[^}]*?gid:\s*\"(\d+)\""
    pairs = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(form), F.lit(1)).alias("name"), F.regexp_extract_all(html_col, F.lit(form), F.lit(2)).alias("gid"))
    named = pages.select(id_col, F.posexplode(pairs).alias("pos", "p")).select(id_col, "pos", F.col("p.gid").alias("gid"), strip(F.col("p.name")).alias("name")).filter("name <> ''")
    names = named.groupBy(id_col, "gid").agg(F.min_by("name", "pos").alias("tab_name"))
    return gids.join(names, [id_col, "gid"], "left").select(id_col, "tab_ord", "gid", "tab_name", tab_role(F.col("tab_name")).alias("role"))


def tab_role(name: Column) -> Column:
    clean = squash(F.lower(strip(F.regexp_replace(name, EMOJI, " "))))
    return F.when(clean.isin(*ART_TABS), "art").when(clean.isin(*MAIN_TABS), "main").otherwise("other")


def _whole_files(files: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return files.select(path.alias("sheet_id"), path.alias("source_url"), F.col("value").alias("html"))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """``(sheet_id, source_url, html)``: one whole file a sheet. Small files share a task, by their bytes and the cost of opening one."""
    return _whole_files(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True))


#: Bytes of new files that one batch of a stream takes.
BATCH_BYTES = 8 << 30


def stream_sheets(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The same as a stream of new files, a batch at a time of up to ``batch_bytes``, or of one file if that is larger.

    The oldest come first. What was read is in the query's checkpoint: a query that starts
    again reads no file twice and leaves none out.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxBytesPerTrigger", batch_bytes)
    return _whole_files(files.load(path))


SAVED_SHEET = r"/([^/]+)_files/sheet\.html$"


def discover_sheets(spark: SparkSession, path: str, known: DataFrame | None = None, pattern: str = SAVED_SHEET) -> DataFrame:
    """``(name, folder, html)`` of ``<folder>_files/sheet.html``, or of files whose path matches ``pattern`` (group 1 is the folder).

    Known folders (folder, name, ord) come first in their order, then the others by folder.
    """
    found = read_sheets(spark, path).withColumn("folder", F.url_decode(F.regexp_extract("sheet_id", pattern, 1))).filter("folder <> ''")
    if known is None:
        known = spark.createDataFrame([], "folder string, name string, ord int")
    named = found.join(known.select("folder", F.col("name").alias("_known"), "ord"), "folder", "left")
    name = F.coalesce("_known", strip(F.replace("folder", F.lit(" - Google Drive"), F.lit(""))))
    return named.orderBy(F.col("ord").isNull(), "ord", "folder").select(name.alias("name"), "folder", "html")
