"""Songs, sections and the nested catalogue from version rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.labels import BEST_OF, STREAM_HOSTS, first_streamable, streamable
from quillgrid.functions.text import SECTION_LABELS, credit_notes, without_tag

SONG = ["sheet_id", "era_idx", "base_name"]


def with_base_name(versions: DataFrame) -> DataFrame:
    return versions.withColumn("base_name", without_tag(F.col("name")))


def build_songs(versions: DataFrame, order: str = "row_idx") -> DataFrame:
    """One row for each base name of an era: its section where first seen, badge and fields of the first version.

    ``display_badge`` is best before special before the song's own badge, which is the
    first one given. A two-level aggregate; no window.
    """
    ranked = lambda c, cond=None: F.min_by(F.when(cond, F.col(c)) if cond is not None else F.col(c), F.when(cond, F.col(order)) if cond is not None else F.col(order))
    first = [ranked(c).alias(f"primary_{c}") for c in ("available_length", "quality", "track_length", "leak_date", "file_date")]
    songs = versions.groupBy(*SONG).agg(
        F.min(order).alias("first_row"),
        ranked("section_idx").alias("section_idx"),
        F.count("*").alias("n_versions"),
        ranked("badge", F.col("badge").isNotNull()).alias("badge"),
        F.max(F.when(F.col("badge") == "best", 2).when(F.col("badge") == "special", 1)).alias("_top"),
        *first,
    )
    return songs.withColumn("display_badge", F.when(F.col("_top") == 2, "best").when(F.col("_top") == 1, "special").otherwise(F.col("badge"))).drop("_top")


def song_alt_titles(versions: DataFrame, order: str = "row_idx") -> DataFrame:
    """``(…, alt_titles)``: of songs of two versions or more the other titles, each once whatever its case, first spelling kept."""
    alts = versions.select(*SONG, order, F.posexplode("alt_titles").alias("pos", "alt")).withColumn("_k", F.lower(F.trim("alt"))).filter("_k <> ''")
    many = versions.groupBy(*SONG).agg(F.count("*").alias("n")).filter("n > 1").select(*SONG)
    once = alts.join(many, SONG, "left_semi").groupBy(*SONG, "_k").agg(F.min(F.struct(order, "pos", F.trim("alt").alias("alt"))).alias("f"))
    return once.groupBy(*SONG).agg(F.array_sort(F.collect_list("f")).alias("_f")).withColumn("alt_titles", F.transform("_f", lambda f: f["alt"])).drop("_f")


def first_streamable_versions(versions: DataFrame, order: str = "row_idx", dialect: str = "web") -> DataFrame:
    """``(…, link)`` of each song's first version with a streaming link.

    ``ios`` passes over versions whose file or link is known to hold no sound.
    """
    linked = versions.withColumn("_link", first_streamable(F.col("links"))).filter("_link is not null")
    if dialect == "ios":
        linked = linked.filter(streamable(F.col("links"), F.col("og_filename"), "ios"))
    return linked.groupBy(*SONG).agg(F.min(order).alias(order), F.min_by("_link", order).alias("link"))


def next_streamable(versions: DataFrame, order: str = "row_idx", best_of: bool = False) -> DataFrame:
    """``versions`` with ``next_row``: the next version of the era with a streaming link (and a best-of badge if asked)."""
    ok = F.exists("links", lambda x: x.rlike(STREAM_HOSTS))
    if best_of:
        ok = ok & F.coalesce(F.col("badge").isin(*BEST_OF), F.lit(False))
    w = Window.partitionBy("sheet_id", "era_idx").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return versions.withColumn("next_row", F.first(F.when(ok, F.col(order)), ignorenulls=True).over(w))


DETAILS = (("Quality", "quality"), ("Available", "available_length"), ("Length", "track_length"), ("File date", "file_date"), ("Leak date", "leak_date"), ("Recorded", "date_of_recording"), ("Type", "type"))
CREDIT_ROWS = (("Featuring", "featuring"), ("Producers", "producers"), ("With", "collaboration"), ("References", "refs"))


def version_details(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows ``(keys, ord, label, value)``: details, credits, notes, first and other alternate titles; nulls left out."""
    had = [(label, F.col(c)) for label, c in (*DETAILS, *CREDIT_ROWS) if c in versions.columns]
    had += [("Notes", credit_notes(F.col("notes")))] if "notes" in versions.columns else []
    if "alt_titles" in versions.columns:
        had += [("Subtitle", F.get(F.col("alt_titles"), F.lit(0))), ("Also known as", F.nullif(F.array_join(F.slice("alt_titles", F.lit(2), F.greatest(F.size("alt_titles"), F.lit(1))), ", "), F.lit("")))]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), c.cast("string").alias("value")) for i, (label, c) in enumerate(had)])
    return versions.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.ord", "r.label", "r.value").filter("value is not null")


def consolidate_groups(sections: DataFrame) -> DataFrame:
    """Sections with ``group``: an empty named section that is no standard label groups those after it.

    Over ``(sheet_id, era_idx, section_idx, name, n_songs)``. In eras of one section nothing
    changes; otherwise empty sections go.
    """
    era = Window.partitionBy("sheet_id", "era_idx")
    upto = era.orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0)
    empty, named = F.col("n_songs") == 0, F.coalesce(F.col("name"), F.lit("")) != ""
    label = empty & named & ~F.lower(F.trim("name")).isin(*SECTION_LABELS)
    marked = sections.withColumns({"_n": F.count("*").over(era), "group": F.last(F.when(label, F.col("name")), ignorenulls=True).over(upto)})
    kept = marked.filter((F.col("_n") <= 1) | ~empty)
    return kept.withColumn("group", F.when(F.col("_n") > 1, F.col("group"))).drop("_n")


def catalog_counts(versions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_songs, n_versions, n_links, n_linked)``; base names count within an era."""
    return versions.groupBy(*keys).agg(
        F.countDistinct("era_idx", "base_name").alias("n_songs"),
        F.count("*").alias("n_versions"),
        F.sum(F.size("links")).cast("long").alias("n_links"),
        F.sum((F.size("links") > 0).cast("long")).alias("n_linked"),
    )


def section_counts(sections: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_sections, n_named)``: sections, and those with a name."""
    return sections.groupBy(*keys).agg(F.count("*").alias("n_sections"), F.count_if(F.coalesce(F.col("name"), F.lit("")) != "").alias("n_named"))


def nest_catalog(versions: DataFrame, fields: list[str]) -> DataFrame:
    """``(sheet_id, n_versions, eras)``: eras of sections of songs of versions, each with its ordinal and counts.

    Versions have ``era_idx, era_name, section_idx, section_name, base_name, row_idx``. They
    are spread by sheet once; all levels are then built from the bottom where the rows are.
    """
    versions = versions.repartition("sheet_id")
    v = F.struct(F.col("row_idx"), *[F.col(f) for f in fields])
    song = versions.groupBy("sheet_id", "era_idx", "era_name", "section_idx", "section_name", "base_name").agg(F.min("row_idx").alias("first_row"), F.array_sort(F.collect_list(v)).alias("versions"))
    section = song.groupBy("sheet_id", "era_idx", "era_name", "section_idx", "section_name").agg(F.array_sort(F.collect_list(F.struct("first_row", "base_name", "versions"))).alias("songs"), F.sum(F.size("versions")).alias("n_versions"))
    era = section.groupBy("sheet_id", "era_idx", "era_name").agg(F.array_sort(F.collect_list(F.struct("section_idx", "section_name", "n_versions", "songs"))).alias("sections"), F.sum("n_versions").alias("n_versions"))
    return era.groupBy("sheet_id").agg(F.sum("n_versions").alias("n_versions"), F.array_sort(F.collect_list(F.struct("era_idx", "era_name", "n_versions", "sections"))).alias("eras"))


def flatten_catalog(nested: DataFrame) -> DataFrame:
    """The version rows of a nested catalogue."""
    e = nested.select("sheet_id", F.explode("eras").alias("e"))
    s = e.select("sheet_id", "e.era_idx", "e.era_name", F.explode("e.sections").alias("s"))
    g = s.select("sheet_id", "era_idx", "era_name", "s.section_idx", "s.section_name", F.explode("s.songs").alias("g"))
    return g.select("sheet_id", "era_idx", "era_name", "section_idx", "section_name", "g.base_name", F.explode("g.versions").alias("v")).select("sheet_id", "era_idx", "era_name", "section_idx", "section_name", "base_name", "v.*")


def content_hash(cols: list[str]) -> Column:
    """16 hexadecimal digits of the SHA-256 of the columns as JSON, in order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))).cast("binary"), 256), 1, 16)
