"""Favourites and views: state from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import without_tag

KEY = ["artist_slug", "era_name", "base_name"]


def favourites_state(events: DataFrame) -> DataFrame:
    """``(user_id, artist_slug, era_name, base_name, added_at)`` after ``(ts, user_id, action, …)``.

    ``toggle`` flips a key, ``remove`` drops it, ``clear`` drops all of the user's. What counts is
    the parity of toggles after the last drop; no order within a key has to be kept. Of events
    at one time a drop comes after a toggle.
    """
    clears = events.filter("action = 'clear'").groupBy("user_id").agg(F.max("ts").alias("_cleared"))
    keyed = events.filter("action <> 'clear'").join(clears, "user_id", "left")
    removed = keyed.filter("action = 'remove'").groupBy("user_id", *KEY).agg(F.max("ts").alias("_removed"))
    toggles = keyed.filter("action = 'toggle'").join(removed, ["user_id", *KEY], "left")
    live = toggles.filter((F.col("ts") > F.coalesce("_cleared", F.lit("0001-01-01").cast("timestamp"))) & (F.col("ts") > F.coalesce("_removed", F.lit("0001-01-01").cast("timestamp"))))
    counted = live.groupBy("user_id", *KEY).agg(F.count("*").alias("_n"), F.max("ts").alias("added_at"))
    return counted.filter("_n % 2 = 1").drop("_n")


def favourites_join(songs: DataFrame, favourites: DataFrame, how: str = "flag") -> DataFrame:
    """Songs that are favourites (``semi``), are not (``anti``), or all with ``is_favourite`` (``flag``)."""
    songs = songs.withColumn("base_name", without_tag(F.col("base_name")))
    keys = favourites.select(*KEY).distinct()
    if how in ("semi", "anti"):
        return songs.join(keys, KEY, f"left_{how}")
    return songs.join(keys.withColumn("is_favourite", F.lit(True)), KEY, "left").withColumn("is_favourite", F.coalesce("is_favourite", F.lit(False)))


def favourites_by_artist(favourites: DataFrame) -> DataFrame:
    """``(user_id, artist_slug, n, latest, eras, …)``: nested by artist and era, newest first.

    ``artist_name``, ``source_url`` and, within eras, ``era_art`` are those of the newest
    entry, if ``favourites`` has these columns.
    """
    newest = F.struct("added_at", "base_name")
    artist = [c for c in ("artist_name", "source_url") if c in favourites.columns]
    art = [F.max_by("era_art", newest).alias("era_art")] if "era_art" in favourites.columns else []
    era = favourites.groupBy("user_id", "artist_slug", "era_name").agg(
        F.max("added_at").alias("latest"), F.count("*").alias("n"), F.sort_array(F.collect_list(newest), asc=False).alias("songs"),
        F.max(newest).alias("_at"), *[F.max_by(c, newest).alias(c) for c in artist], *art,
    )
    inner = F.struct("latest", "era_name", "songs", *(["era_art"] if art else []))
    return era.groupBy("user_id", "artist_slug").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), *[F.max_by(c, "_at").alias(c) for c in artist], F.sort_array(F.collect_list(inner), asc=False).alias("eras"))


def recent_views(views: DataFrame, key: str = "source_url", n: int = 20) -> DataFrame:
    """The latest view of each source, the newest ``n``."""
    last = views.groupBy(key).agg(F.max("ts").alias("ts"), F.count("*").alias("n_views"))
    return last.orderBy(F.desc("ts"), key).limit(n)


def recent_cards(views: DataFrame, artists: DataFrame, stats: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` viewed sheets with their name, songs, cover (first era with art) and counts.

    Over ``views`` (sheet_id, ts), ``artists`` of the catalogue and ``stats.recents_card_stats`` by sheet.
    """
    cards = recent_views(views, "sheet_id", n).join(artists.select("sheet_id", "artist_name", "slug", "n_songs", "art_url"), "sheet_id", "left").join(stats, "sheet_id", "left")
    return cards.orderBy(F.desc("ts"), "sheet_id")
