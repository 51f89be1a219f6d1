"""Search, filters, recents and pages over version rows.

``dialect`` chooses between two clients that differ in details: ``web`` and ``ios``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.labels import BEST_OF, parse_date

SONG = ["sheet_id", "era_idx", "base_name"]
Searches = Sequence[tuple[str, str, dict]]


def _low(col: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit("")))


def is_snippet(dialect: str = "web") -> Column:
    """Versions that a filter for whole songs hides."""
    web = _low("available_length").contains("snippet")
    return web if dialect == "web" else web | _low("available_length").contains("unavailable") | _low("quality").contains("not available")


def no_snippets(versions: DataFrame, dialect: str = "web") -> DataFrame:
    return versions.filter(~is_snippet(dialect))


def best_of(versions: DataFrame, dialect: str = "web") -> DataFrame:
    """Best and special versions; ``web`` asks for the song's first badge to be one, ``ios`` for any of its versions."""
    kept = versions.filter(F.col("badge").isin(*BEST_OF))
    if dialect == "ios":
        return kept
    badges = versions.filter("badge is not null").groupBy(*SONG).agg(F.min_by("badge", "row_idx").alias("_b")).filter(F.col("_b").isin(*BEST_OF))
    return kept.join(badges.select(*SONG), SONG, "left_semi")


def with_search_text(versions: DataFrame) -> DataFrame:
    """``search_text``: base name, name and other titles in lower case, apart by a NUL."""
    alts = F.coalesce(F.array_join("alt_titles", "\0"), F.lit(""))
    return versions.withColumn("search_text", F.lower(F.concat_ws("\0", "base_name", "name", alts)))


def match_songs(versions: DataFrame, query: str) -> DataFrame:
    """Songs of which some version's search text holds the query."""
    return with_search_text(versions).filter(F.col("search_text").contains(query.strip().lower())).select(*SONG).distinct()


def _all_texts(columns: list[str]) -> Column:
    """All that a search looks at, in lower case, line by line: a query that it does not hold has no score."""
    credits = [F.col(c) for c in ("featuring", "producers", "collaboration") if c in columns]
    return F.lower(F.concat_ws("\n", F.col("base_name"), F.col("name"), F.array_join("alt_titles", "\n"), *credits))


def _score(columns: list[str], query: str, scoring: str) -> Column:
    q = query.strip().lower()
    base, name = F.lower("base_name"), F.lower("name")
    if scoring == "spec":
        quoted = r"\b\Q" + q.replace("\\E", "") + r"\E"
        text = _all_texts(columns)
        return F.when(base.startswith(q), 100).when(text.rlike(quoted), 60).when(text.contains(q), 30)
    alts = F.transform(F.coalesce("alt_titles", F.array().cast("array<string>")), F.lower)
    return (
        F.when(base == q, 100)
        .when(F.exists(alts, lambda a: a == q), 90)
        .when(base.startswith(q), 70)
        .when(F.exists(alts, lambda a: a.startswith(q)), 60)
        .when(base.contains(q), 40)
        .when(name.contains(q) | F.exists(alts, lambda a: a.contains(q)), 20)
    )


def song_scores(versions: DataFrame, query: str, scoring: str = "clients") -> DataFrame:
    """``(sheet_id, era_idx, base_name, score)`` of songs that match the query.

    ``clients``: 100 base name, 90 other title, 70 and 60 their beginnings, 40 within the base
    name, 20 within a version's name or other title. ``spec``: 100 beginning, 60 start of a
    word in names, titles and credits, 30 anywhere in these.
    """
    return scores_of(versions, [("", query, {"scoring": scoring})]).drop("search")


def scores_of(versions: DataFrame, searches: Searches) -> DataFrame:
    """``(sheet_id, era_idx, base_name, search, score)`` of the songs that match each of several searches, in one pass.

    Rows that hold no query are left out first; the others are scored for the queries that they hold.
    """
    held = {f"_held{i}": _all_texts(versions.columns).contains(query.strip().lower()) for i, (_, query, _) in enumerate(searches)}
    score = {f"_score{i}": F.when(F.col(f"_held{i}"), _score(versions.columns, query, options.get("scoring", "clients"))) for i, (_, query, options) in enumerate(searches)}
    scored = versions.withColumns(held).filter(reduce(Column.__or__, map(F.col, held))).select(*SONG, *[c.alias(n) for n, c in score.items()])
    songs = scored.groupBy(*SONG).agg(*[F.max(n).alias(n) for n in score])
    pairs = F.array(*[F.struct(F.lit(name).alias("search"), F.col(f"_score{i}").alias("score")) for i, (name, _, _) in enumerate(searches)])
    return songs.select(*SONG, F.inline(pairs)).filter("score is not null")


def search(versions: DataFrame, query: str, only_best: bool = False, hide_snippets: bool = False, dialect: str = "web", scoring: str = "clients") -> DataFrame:
    """Matching versions with ``score``, best first, then in the catalogue's order; an empty query finds none."""
    options = {"only_best": only_best, "hide_snippets": hide_snippets, "dialect": dialect, "scoring": scoring}
    return search_many(versions, [("", query, options)]).drop("search").orderBy(F.desc("score"), "sheet_id", "era_idx", "row_idx")


def search_many(versions: DataFrame, searches: Searches) -> DataFrame:
    """The versions that each of several searches finds, with ``search``, its name, and ``score``, in no order.

    A search is ``(name, query, options)`` with the options of ``search``. The versions are read
    and joined once for all of them.
    """
    asked = [s for s in searches if s[1].strip()]
    if not asked:
        return versions.withColumns({"search": F.lit(""), "score": F.lit(0)}).limit(0)
    found = versions.join(scores_of(versions, asked), SONG)
    for name, _, options in asked:
        others = F.col("search") != name
        if options.get("only_best"):
            found = found.filter(others | F.col("badge").isin(*BEST_OF))
        if options.get("hide_snippets"):
            found = found.filter(others | ~is_snippet(options.get("dialect", "web")))
    return found


def filter_eras(eras: DataFrame, versions: DataFrame, query: str = "", only_best: bool = False, dialect: str = "web") -> DataFrame:
    """Eras with songs left by the filters, whose name, other names or songs hold the query."""
    left = best_of(versions, dialect) if only_best else versions
    kept = eras.join(left.select("sheet_id", "era_idx").distinct(), ["sheet_id", "era_idx"], "left_semi")
    q = query.strip().lower()
    if not q:
        return kept
    hit = match_songs(left, q).select("sheet_id", "era_idx").distinct().withColumn("_hit", F.lit(True))
    named = F.lower("name").contains(q) | F.exists("alt_names", lambda a: F.lower(a).contains(q))
    return kept.join(hit, ["sheet_id", "era_idx"], "left").filter(F.coalesce(named, F.lit(False)) | F.col("_hit").isNotNull()).drop("_hit")


def filter_songs(versions: DataFrame, eras: DataFrame, query: str = "", only_best: bool = False, hide_snippets: bool = False, dialect: str = "web") -> DataFrame:
    """Versions of the songs that a client lists; an era whose name holds the query keeps all of them.

    ``web`` applies the snippet filter only together with another one.
    """
    q = query.strip().lower()
    out = best_of(versions, dialect) if only_best else versions
    if hide_snippets and (dialect == "ios" or only_best or q):
        out = no_snippets(out, dialect)
    if not q:
        return out
    named = eras.filter(F.lower("name").contains(q) | F.exists("alt_names", lambda a: F.lower(a).contains(q))).select("sheet_id", "era_idx", F.lit(True).alias("_era"))
    songs = match_songs(out, q).withColumn("_song", F.lit(True))
    marked = out.join(named, ["sheet_id", "era_idx"], "left").join(songs, SONG, "left")
    return marked.filter(F.col("_era").isNotNull() | F.col("_song").isNotNull()).drop("_era", "_song")


def filter_sections(sections: DataFrame, versions: DataFrame, eras: DataFrame, query: str = "", only_best: bool = False, hide_snippets: bool = False, dialect: str = "web") -> DataFrame:
    """Sections ``(sheet_id, era_idx, section_idx, …)`` with ``n_left``, the songs that the filters leave.

    Without a query or the filter for best versions all sections are listed, whole; otherwise
    those without songs left are dropped. ``web`` applies the filter for snippets only beside
    these, for ``ios`` it is a filter like them.
    """
    place = ["sheet_id", "era_idx", "section_idx"]
    filtering = only_best or bool(query.strip()) or (hide_snippets and dialect == "ios")
    left = filter_songs(versions, eras, query, only_best, hide_snippets, dialect) if filtering else versions
    first = versions.groupBy(*SONG).agg(F.min_by("section_idx", "row_idx").alias("section_idx"))
    counts = left.select(*SONG).distinct().join(first, SONG).groupBy(*place).agg(F.count("*").alias("n_left"))
    out = sections.join(counts, place, "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))
    return out.filter("n_left > 0") if filtering else out


def inspect_songs(versions: DataFrame, era_like: str | None = None, name_like: str | None = None, badges_only: bool = False, per_era: int | None = None) -> DataFrame:
    """Versions by parts of names, with a badge, and the first of each era."""
    out = versions
    if era_like:
        out = out.filter(F.lower("era_name").contains(era_like.lower()))
    if name_like:
        out = out.filter(F.lower("name").contains(name_like.lower()))
    if badges_only:
        out = out.filter("badge is not null")
    if per_era is not None:
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy("sheet_id", "era_idx").orderBy("row_idx"))).filter(F.col("_rn") <= per_era).drop("_rn")
    return out


def recents_order() -> list[Column]:
    return [F.desc("sort_date"), F.col("sheet_id"), F.col("era_idx"), F.col("row_idx")]


def dated_versions(versions: DataFrame, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Versions with a leak or file date and that date as ``sort_date``, in no order.

    ``days`` keeps those of so many days up to ``as_of``.
    """
    text = F.coalesce(F.nullif("leak_date", F.lit("")), F.nullif("file_date", F.lit("")))
    dated = versions.withColumn("_when", text).filter("_when is not null").withColumn("sort_date", F.coalesce(parse_date(F.col("_when")), F.lit("1970-01-01").cast("date"))).drop("_when")
    if days is not None:
        end = F.lit(as_of).cast("date") if as_of else F.current_date()
        dated = dated.filter((F.col("sort_date") <= end) & (F.col("sort_date") > F.date_sub(end, days)))
    return dated


def recents(versions: DataFrame, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """The ``dated_versions``, newest first, undated forms last."""
    return dated_versions(versions, days, as_of).orderBy(*recents_order())


def page(df: DataFrame, number: int, size: int = 60) -> DataFrame:
    """One page, from 0, of an ordered table, which is sorted for it; ``search_index.write_ordered`` writes an order for many pages."""
    return df.offset(number * size).limit(size)


def discovery_order(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.desc(F.coalesce("best", F.lit(False))), F.lower("name"), "name")
