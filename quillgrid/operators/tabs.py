"""Workbooks: source addresses, artist names, choice of the tab that holds the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import let, some, strip

SOLID_ERAS = 5
# Fixed: what is cut from a page's title.
SUFFIXES = (" - Google Drive", " - Google Sheets", " - Google Docs", " Music Tracker", " Tracker [Currently in Use]", " Tracker", " Leak Tracker", " Leaks Tracker")
PREFIXES = ("Updated ", "New ", "Official ")
OTHER_NAMES = {"the guy from degrassi": "Drake"}


def canonical_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``sheet_url`` (with a scheme; workbooks as their plain view), ``workbook_id``, ``gid`` and ``tab_url``."""
    raw = strip(F.col(url_col))
    url = F.when(raw.rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    book = some(F.regexp_extract(url, r"docs\.google\.com/spreadsheets(?:/u/\d+)?/d/([A-Za-z0-9_-]+)", 1))
    base = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    view = F.concat(base, F.lit("/spreadsheets/d/"), book, F.lit("/htmlview"))
    gid = some(F.regexp_extract(url, r"[#?&]gid=(\d+)", 1))
    root = F.coalesce(view, F.concat(base, F.lit("/htmlview")))
    tab = F.concat(root, F.lit("/sheet?headers=true&gid="), gid)
    return df.withColumns({"sheet_url": F.coalesce(view, url), "workbook_id": book, "gid": gid, "tab_url": tab})


def dedup_urls(df: DataFrame, url_col: str = "url", ord_col: str = "ord") -> DataFrame:
    """One address for each workbook or else host: one that names a tab before others, then the first."""
    keyed = canonical_urls(df, url_col).withColumn("source_key", F.coalesce("workbook_id", F.lower(F.regexp_extract("sheet_url", r"^https?://([^/?#]*)", 1))))
    w = Window.partitionBy("source_key").orderBy(F.desc(F.col("gid").isNotNull()), ord_col)
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _cut_end(name: Column, end: str) -> Column:
    return let(name, lambda n: F.when(n.endswith(end), strip(F.substring(n, F.lit(1), F.length(n) - len(end)))).otherwise(n))


def _cut_start(name: Column, start: str) -> Column:
    return let(name, lambda n: F.when(n.startswith(start), strip(F.substring(n, F.lit(len(start) + 1), F.length(n)))).otherwise(n))


def artist_name(title: Column) -> Column:
    """The artist that a page's title names."""

    def cut(name: Column) -> Column:
        return reduce(_cut_end, SUFFIXES, name)

    name = cut(strip(F.regexp_replace(cut(strip(title)), r"(?i)\s+Tracker\s+[\d.v]+\s*$", "")))
    name = let(name, lambda n: let(cut(strip(F.regexp_replace(n, r"\s*\([^)]*\)\s*$", ""))), lambda bare: F.when(bare != "", bare).otherwise(n)))
    name = strip(F.regexp_replace(reduce(_cut_start, PREFIXES, name), r"^[\x{1F300}-\x{1F9FF}\s]+", ""))

    def known(n: Column) -> Column:
        out = n
        for low, other in OTHER_NAMES.items():
            out = F.when(F.lower(n) == low, other).otherwise(out)
        return some(out)

    return F.coalesce(let(name, known), strip(title))


def tab_artist(html: Column) -> Column:
    """The artist that the first sheet tab of a page names: its text without the ends that say what a page is."""
    names = F.regexp_extract_all(html, F.lit(r"(?i)class=\"[^\"]*sheet-tab[^\"]*\"[^>]*>([^<]+)<"), F.lit(1))
    bare = F.transform(names, lambda n: reduce(_cut_end, SUFFIXES, strip(n)))
    return F.get(F.filter(bare, lambda n: F.length(n) > 1), F.lit(0))


def resolve_artist(override: Column, html: Column, title: Column) -> Column:
    """The name given, else the one of a sheet tab, else the one of the page's title."""
    return F.coalesce(some(override), tab_artist(html), artist_name(title))


def select_tab(tabs: DataFrame) -> DataFrame:
    """``(workbook_id, gid, n_eras)`` of the tab to read, over ``(workbook_id, tab_ord, gid, role, n_eras, n_songs)``.

    Tabs are tried in order, the main one first, up to a main tab with an era or a tab with
    five; of those tried the one of most eras counts, on a tie the last with songs, else the first.
    """
    order = F.struct((F.col("role") != "main").alias("late"), F.col("tab_ord"))
    stop = ((F.col("role") == "main") & (F.col("n_eras") >= 1)) | (F.col("n_eras") >= SOLID_ERAS)
    w = Window.partitionBy("workbook_id").orderBy("_ord")
    placed = tabs.withColumn("_ord", order).withColumn("_pos", F.row_number().over(w))
    ends = placed.groupBy("workbook_id").agg(F.min(F.when(stop, F.col("_pos"))).alias("_end"))
    tried = placed.join(ends, "workbook_id").filter(F.col("_pos") <= F.coalesce("_end", F.lit(1 << 30))).filter("n_eras > 0")
    songs = F.col("n_songs") > 0
    rank = F.struct("n_eras", songs.alias("s"), F.when(songs, F.col("_pos")).otherwise(-F.col("_pos")).alias("p"))
    return tried.groupBy("workbook_id").agg(F.max_by(F.struct("gid", "n_eras"), rank).alias("b")).select("workbook_id", "b.gid", "b.n_eras")
