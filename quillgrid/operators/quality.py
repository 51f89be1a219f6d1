"""Quality sweep over many sheets: one row for each sheet and failed check.

Input is one row a sheet: ``sheet_id, n_eras, n_songs, n_sections, zero_eras array<string>,
era_names array<string>, section_names array<string>, total_rows, song_rows, skipped_rows,
fuzzy_rows, unmatched array<string>, declared, parsed``. The last two are sums over the
eras that declare a total (``stats.declared_totals``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.text import BOGUS, let

SEVERITIES = ("INFO", "WARNING", "CRITICAL")
# Fixed: words that mark lost sections.
SECTION_WORDS = ("features", "collaborations", "collaboration", "featured", "loosies", "guest verses", "guest features")
LISTED_SECTIONS = 20


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _none() -> Column:
    return F.array().cast("array<string>")


def duplicate_names(names: Column) -> Column:
    """Names that occur twice or more, whatever their case, once each in lower case, sorted."""

    def repeated(low: Column) -> Column:
        """In order, a name that equals the one before it; null names come last and equal nothing."""
        return F.array_distinct(F.filter(low, lambda n, i: F.coalesce(n == F.get(low, i - 1), F.lit(False))))

    return let(F.array_sort(F.transform(names, lambda n: F.lower(F.trim(n)))), repeated)


def run_checks(sheets: DataFrame) -> DataFrame:
    """``(sheet_id, check, severity, details)`` of all checks that speak; one pass, no shuffle."""
    skip, fuzzy = _ratio("skipped_rows", "total_rows"), _ratio("fuzzy_rows", "song_rows")
    bogus = F.filter("era_names", lambda n: F.trim(n).rlike(BOGUS))
    lost = F.filter("unmatched", lambda t: F.lower(t).rlike("|".join(SECTION_WORDS)))
    named = F.filter("section_names", lambda n: n != "")
    off = F.when((F.col("declared") > 0) & (F.col("parsed") > 0), F.abs(F.col("parsed") - F.col("declared")) / F.col("parsed")).otherwise(0.0)
    has_eras, has_songs = F.col("n_eras") > 0, F.col("n_songs") > 0

    def check(name: str, cond: Column, severity: str, details: Column | None = None) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), (_none() if details is None else details).alias("details")))

    checks = [
        check("NO_ERAS", ~has_eras, "CRITICAL"),
        check("NO_SONGS", ~has_songs, "CRITICAL"),
        check("HIGH_SKIP", skip > 0.15, "WARNING", F.slice("unmatched", 1, 10)),
        check("ELEVATED_SKIP", (skip > 0.05) & (skip <= 0.15), "INFO", F.slice("unmatched", 1, 5)),
        check("ZERO_SONG_ERAS", F.size("zero_eras").between(1, 2), "WARNING", F.col("zero_eras")),
        check("ZERO_SONG_ERAS", F.size("zero_eras") > 2, "CRITICAL", F.col("zero_eras")),
        check("BOGUS_ERAS", F.size(bogus) > 0, "WARNING", bogus),
        check("LOST_SECTIONS", F.size(lost) > 0, "INFO", lost),
        check("SECTIONS_FOUND", F.size(named) > 0, "INFO", F.slice(named, 1, LISTED_SECTIONS)),
        check("LOW_SONG_RATIO", (F.col("n_eras") >= 3) & (_ratio("n_songs", "n_eras") < 3), "WARNING"),
        check("MANY_ERAS", F.col("n_eras") > 40, "INFO"),
        check("HIGH_FUZZY", fuzzy > 0.2, "WARNING"),
        check("DUPLICATE_ERAS", F.size(duplicate_names(F.col("era_names"))) > 0, "WARNING", duplicate_names(F.col("era_names"))),
        check("STATS_MISMATCH", off > 0.25, "WARNING"),
    ]
    return sheets.select("sheet_id", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("sheet_id", "i.*")


def roll_up(sheets: DataFrame, issues: DataFrame) -> DataFrame:
    """``(sheet_id, status)``: critical, warning or ok by the worst check."""
    rank = reduce(lambda acc, p: acc.when(F.col("severity") == p[1], p[0]), enumerate(SEVERITIES), F)
    worst = issues.groupBy("sheet_id").agg(F.max(rank).alias("_w"))
    status = F.when(F.col("_w") == 2, "critical").when(F.col("_w") == 1, "warning").otherwise("ok")
    return sheets.select("sheet_id").join(worst, "sheet_id", "left").select("sheet_id", status.alias("status"))


# Fixed: errors of a sheet that could not be read, and the status that they give to (live, abandoned) sheets.
READ_ERRORS = {"access_denied": ("skip", "skip"), "invalid_url": ("error", "error"), "network": ("error", "skip"), "no_tables": ("fail", "skip")}


def status_by_rules(sheets: DataFrame) -> DataFrame:
    """``(sheet_id, status)`` by the second rule set: ok, warn, fail, skip or error.

    A sheet with ``error`` (if there is that column) was not read: its status comes from the
    kind of error, an unknown kind being an error, and from whether the sheet is abandoned:
    no working links and no updates (``links_work``, ``updated``). Sheets that were read
    keep their status, abandoned or not.
    """
    skip = _ratio("skipped_rows", "total_rows")
    status = (
        F.when((F.col("n_eras") == 0) | (F.col("n_songs") == 0) | (skip > 0.2), "fail")
        .when((skip > 0.05) | (F.size("zero_eras") > 3) | ((F.col("n_eras") > 2) & (_ratio("n_songs", "n_eras") < 1)), "warn")
        .otherwise("ok")
    )
    if "error" in sheets.columns:
        known = {"links_work", "updated"} <= set(sheets.columns)
        abandoned = F.coalesce((F.col("links_work") == 0) & (F.col("updated") == 0), F.lit(False)) if known else F.lit(False)
        unread = F.lit("error")
        for kind, (live, left) in READ_ERRORS.items():
            unread = F.when(F.col("error") == kind, F.when(abandoned, left).otherwise(live)).otherwise(unread)
        status = F.when(F.coalesce(F.col("error"), F.lit("")) != "", unread).otherwise(status)
    return sheets.select("sheet_id", status.alias("status"))


def verdict_of(sheets: DataFrame) -> DataFrame:
    """``(sheet_id, verdict)`` by the third rule set."""
    unmatched = F.least(F.size("unmatched"), F.lit(50)) > 0.3 * F.col("song_rows")
    verdict = F.when(F.col("n_eras") == 0, "FAIL_NO_ERAS").when(F.col("n_songs") == 0, "FAIL_NO_SONGS").when(unmatched, "WARN_MANY_UNMATCHED").otherwise("OK")
    return sheets.select("sheet_id", verdict.alias("verdict"))


def art_coverage(eras: DataFrame) -> DataFrame:
    return eras.groupBy("sheet_id").agg(F.count("*").alias("n_eras"), F.count("art_url").alias("n_art"), F.round(F.avg(F.col("art_url").isNotNull().cast("int")), 4).alias("coverage"))


def issue_frequency(issues: DataFrame) -> DataFrame:
    """``(check, severity, n, n_sheets)`` without mere information."""
    return issues.filter("severity <> 'INFO'").groupBy("check", "severity").agg(F.count("*").alias("n"), F.countDistinct("sheet_id").alias("n_sheets"))


def corpus_totals(results: DataFrame) -> DataFrame:
    """``(status, n_sheets, n_eras, n_songs, percent)`` of sheets by status."""
    by = results.groupBy("status").agg(F.count("*").alias("n_sheets"), F.sum("n_eras").alias("n_eras"), F.sum("n_songs").alias("n_songs"))
    return by.withColumn("percent", F.round(100 * F.col("n_sheets") / F.sum("n_sheets").over(Window.partitionBy()), 2))


# Fixed: labels that are no eras.
META = ("types", "links", "link", "mega folder", "notes for me", "rules", "editor(s)", "editors", "type", "owner", "template", "key", "legend", "performance tracks", "suggest content to be added", "rest in power liam", "notes", "general information", "release date", "updates")


def empty_category(name: Column) -> Column:
    """Why an era has no songs, by the first rule that its name meets."""
    low = F.lower(F.trim(name))
    return (
        F.when(low == "", "empty")
        .when(low.rlike("^skip to|click to view|click here"), "navigation")
        .when(low.contains("discord"), "discord")
        .when(low.rlike("guideline|contribute"), "guidelines")
        .when(low.rlike("please read|please do not"), "announcements")
        .when(low.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}|^(?:added|updated|removed) "), "updates")
        .when(low.isin(*META) | low.rlike("full compilation|compilation of"), "meta_label")
        .otherwise("real_era")
    )


def categorize_empty(eras: DataFrame) -> DataFrame:
    """``(category, fixable, n, n_sheets)`` of eras without songs."""
    named = eras.filter("n_songs = 0").withColumn("category", empty_category(F.col("name")))
    return named.groupBy("category").agg((F.first("category") != "real_era").alias("fixable"), F.count("*").alias("n"), F.countDistinct("sheet_id").alias("n_sheets"))


def pending(feed: DataFrame, report: DataFrame, key: str = "name") -> DataFrame:
    """Feed rows that a report does not hold as passed."""
    return feed.join(report.filter(F.col("status").isin("ok", "warn")).select(key), key, "left_anti")


def report_rows(results: DataFrame, issues: DataFrame) -> DataFrame:
    """One record a sheet with its issues as an array, ready for ``write.json``."""
    listed = issues.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("check", "severity", "details"))).alias("issues"))
    return results.join(listed, "sheet_id", "left")
