"""Statistics of eras and sheets: counted from versions, and declared in the sheet's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.labels import first_streamable, streamable
from quillgrid.sources.html import EMOJI

COUNTS = ("total", "available", "snippets", "confirmed", "full_hq")
# Fixed: synonyms of declared counts, in order of preference.
ERA_FIELDS = {
    "og_files": ("og file", "og files"), "full": ("total full", "full"), "tagged": ("tagged",), "partial": ("partial", "partial / cut"),
    "snippets": ("snippet", "snippets"), "stem_bounces": ("stem bounce", "stem bounces"), "unavailable": ("unavailable",),
}
SHEET_FIELDS = {
    "links": {"total_links": ("total links", "total link"), "missing_links": ("missing links", "missing link"), "sources_needed": ("sources needed",), "not_available_links": ("not avaliable", "not available")},
    "quality": {"lossless": ("lossless",), "cd_quality": ("cd quality",), "high_quality": ("high quality",), "low_quality": ("low quality",), "recordings": ("recordings", "recording"), "not_available_quality": ("not available", "not avaliable")},
    "availability": {"total_full": ("total full",), "og_files": ("og files", "og file"), "stem_bounces": ("stem bounces", "stem bounce"), "full": ("full",), "tagged": ("tagged",), "partial": ("partial",), "snippets": ("snippets", "snippet"), "unavailable": ("unavailable",)},
    "highlights": {"best_of": ("best of",), "special": ("special",), "grails": ("grails", "grail"), "wanted": ("wanted",), "worst_of": ("worst of",)},
}


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def availability_stats(versions: DataFrame, keys: list[str], dialect: str = "web") -> DataFrame:
    """``(keys, total, available, snippets, confirmed, full_hq, percent)``; one conditional aggregate.

    ``web`` and ``ios`` differ in what is available, confirmed and of full quality. Percent is rounded half up.
    """
    length, quality = F.lower(F.coalesce("available_length", F.lit(""))), F.lower(F.coalesce("quality", F.lit("")))
    if dialect == "web":
        available = first_streamable(F.col("links")).isNotNull()
        confirmed = (F.coalesce(F.size("links"), F.lit(0)) <= 0) & ((F.coalesce("badge", F.lit("")) == "") | F.lower("badge").contains("confirmed"))
        full_hq = length.contains("full") & quality.contains("hq")
    else:
        available = streamable(F.col("links"), F.col("og_filename"), "ios")
        confirmed = length.contains("confirmed") & ~available
        full_hq = length.rlike("full|og file") & quality.rlike("hq|high|cd|lossless|og")
    out = versions.groupBy(*keys).agg(F.count("*").alias("total"), _n(available).alias("available"), _n(length.contains("snippet")).alias("snippets"), _n(confirmed).alias("confirmed"), _n(full_hq).alias("full_hq"))
    return out.withColumn("percent", F.floor(F.col("available") * 100 / F.col("total") + 0.5).cast("long"))


def recents_card_stats(versions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, available, snippets, confirmed)`` of a card in the list of recent sheets: a version may count as available and confirmed."""
    length = F.lower(F.coalesce("available_length", F.lit("")))
    return versions.groupBy(*keys).agg(_n(streamable(F.col("links"), F.col("og_filename"), "ios")).alias("available"), _n(length.contains("snippet")).alias("snippets"), _n(length.contains("confirmed")).alias("confirmed"))


def total_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the eras' statistics."""
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def declared_pairs(text: Column) -> Column:
    """map<label,count> of ``number label`` pairs; emoji dropped, '(s)' cut, the last of equal labels counts."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, EMOJI, ""), r"\s+", " "))
    form = r"(\d+)\s+([A-Za-z][A-Za-z /()]+?)(?=\d|\z)"
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(form), F.lit(2)).alias("l"), F.regexp_extract_all(clean, F.lit(form), F.lit(1)).alias("n"))
    named = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.trim(F.lower(p["l"])), r"\(s\)$|\($", "").alias("label"), p["n"].cast("long").alias("n")))
    last = F.aggregate(F.reverse(named), F.expr("cast(array() as array<struct<label:string,n:bigint>>)"), lambda acc, p: F.when(F.exists(acc, lambda a: a["label"] == p["label"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(last)


def _pick(pairs: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.element_at(pairs, F.lit(n)) for n in names], F.lit(0))


def declared_stats(eras: DataFrame, text_col: str = "stats_raw") -> DataFrame:
    """``eras`` with the seven counts declared in a header's text and their total."""
    paired = eras.withColumn("_pairs", declared_pairs(F.coalesce(F.col(text_col), F.lit(""))))
    out = paired.withColumns({k: _pick(F.col("_pairs"), names) for k, names in ERA_FIELDS.items()}).drop("_pairs")
    return out.withColumn("declared_total", sum((F.col(k) for k in ERA_FIELDS), F.lit(0)))


def sheet_stats(rows: DataFrame) -> DataFrame:
    """``(sheet_id, …23 counters)`` of the last row that says 'Total Link' or 'Total Full'."""
    signed = rows.filter(F.exists("cells", lambda c: c["text"].rlike("Total Link|Total Full")))
    last = signed.groupBy("sheet_id").agg(F.max_by("cells", "row_idx").alias("cells"))
    family = lambda t: F.when(t.rlike("Total Link|Missing Links"), "links").when(t.rlike("Lossless|CD Quality"), "quality").when(t.rlike("Total Full|OG File"), "availability").when(t.rlike("Best Of|Special|Grails"), "highlights")
    texts = _family_texts(family)
    paired = last.withColumns({f"_{k}": declared_pairs(t) for k, t in texts.items()})
    return paired.select("sheet_id", *[_pick(F.col(f"_{k}"), names).alias(c) for k, fields in SHEET_FIELDS.items() for c, names in fields.items()])


def _family_texts(family) -> dict[str, Column]:
    """The last cell of each family, '' if there is none."""

    def of(kind: str) -> Column:
        mine = F.filter(F.transform("cells", lambda c: c["text"]), lambda t: F.coalesce(family(t) == kind, F.lit(False)))
        return F.when(F.size(mine) > 0, F.element_at(mine, -1)).otherwise("")

    return {k: of(k) for k in SHEET_FIELDS}


def reconcile_stats(eras: DataFrame, versions: DataFrame) -> DataFrame:
    """``(sheet_id, era_idx, declared, parsed, diff)`` of eras with declared counts."""
    parsed = versions.groupBy("sheet_id", "era_idx").agg(F.count("*").alias("parsed"))
    out = eras.select("sheet_id", "era_idx", F.col("declared_total").alias("declared")).join(parsed, ["sheet_id", "era_idx"], "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return out.withColumn("diff", F.col("parsed") - F.col("declared"))


def declared_totals(eras: DataFrame) -> DataFrame:
    """``(sheet_id, declared, parsed)``: totals of the eras that declare one, and the versions read in these."""
    told = F.col("declared_total") > 0
    return eras.groupBy("sheet_id").agg(F.coalesce(F.sum(F.when(told, F.col("declared_total"))), F.lit(0)).alias("declared"), F.coalesce(F.sum(F.when(told, F.col("n_versions"))), F.lit(0)).alias("parsed"))


def reconcile_sheets(eras: DataFrame, sheet: DataFrame) -> DataFrame:
    """``(sheet_id, n_match, n_mismatch, n_art, n_eras, …)``: per sheet, how eras and the sheet's own statistics agree.

    Eras with a declared total match if it equals the versions read. For original files,
    full and unavailable songs the eras' sum and the sheet's figure stand side by side.
    """
    told = F.col("stats_raw").isNotNull()
    by = eras.groupBy("sheet_id").agg(
        F.count_if(told & (F.col("declared_total") == F.col("n_versions"))).alias("n_match"),
        F.count_if(told & (F.col("declared_total") != F.col("n_versions"))).alias("n_mismatch"),
        F.count("art_url").alias("n_art"),
        F.count("*").alias("n_eras"),
        *[F.coalesce(F.sum(F.when(told, F.col(c))), F.lit(0)).alias(f"{c}_eras") for c in ("og_files", "full", "unavailable")],
    )
    own = sheet.select("sheet_id", *[F.col(c).alias(f"{c}_sheet") for c in ("og_files", "full", "unavailable")])
    return by.join(own, "sheet_id", "left")


def badge_counts(versions: DataFrame, keys: list[str]) -> DataFrame:
    return versions.filter("badge is not null").groupBy(*keys, "badge").agg(F.count("*").alias("n"))


def era_row_profile(rows: DataFrame, keys: list[str], name_col: str, filled: Column) -> DataFrame:
    """``(keys, n_rows, n_named, n_nameless)`` of rows that are not empty."""
    named = F.coalesce(F.col(name_col), F.lit("")) != ""
    return rows.filter(filled).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(named).alias("n_named"), F.count_if(~named).alias("n_nameless"))


def nameless_rows(projected: DataFrame, chars: int = 40) -> DataFrame:
    """``(sheet_id, row_idx, era, texts)`` of rows with texts but no name: what a reader may have missed."""
    some = projected.filter((F.size("filled") > 0) & F.col("name").isNull())
    return some.select("sheet_id", "row_idx", "era", F.transform("filled", lambda t: F.substring(t, 1, chars)).alias("texts"))
