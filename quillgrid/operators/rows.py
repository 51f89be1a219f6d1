"""Classes of sheet rows and the columns that are read from each of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.functions.labels import unwrap_link
from quillgrid.operators.columns import column_of

LONG_NOTE = 20
LABEL_CHARS = 60
#: Filled cells of a row whose name alone can open an era or a section.
MOST_BESIDE_NAME = 3


def is_section_separator() -> Column:
    """One or two filled cells, one of them a known label, a collaboration, or labels joined by '/'."""

    def label(t: Column) -> Column:
        low = F.lower(t)
        parts = F.split(low, "/")
        compound = (F.size(parts) >= 2) & F.forall(parts, lambda p: T.strip(p).isin(*T.SECTION_LABELS))
        return low.isin(*T.SECTION_LABELS) | low.startswith("collaboration with") | compound

    return (F.size(F.col("filled")) <= 2) & F.exists(F.col("filled"), label)


def is_era_header() -> Column:
    """Statistics in the first cell and, somewhere, a text that is not 'number word' or has an image."""
    named = lambda c: (T.strip(c["text"]) != "") & (~F.split(T.strip(c["text"]), "\n")[0].rlike(r"^\d+\s") | (F.size(c["images"]) > 0))
    return F.get(F.col("cells"), F.lit(0))["text"].rlike(T.ERA_STATS) & F.exists("cells", named)


#: Pieces that many of the footer words have: a text without them is not searched for these words.
SHARED = ("total ", "guid", "editor", "track")


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words: those that hold another need no look, those with a shared piece only beside it."""
    left = [w for w in words if not any(o != w and o in w for o in words)]
    found = []
    for piece in SHARED:
        some = [w for w in left if piece in w]
        found.append(text.contains(piece) & reduce(or_, [text.contains(w) for w in some], F.lit(False)))
        left = [w for w in left if piece not in w]
    return reduce(or_, [*found, *[text.contains(w) for w in left]], F.lit(False))


def is_footer(name: Column) -> Column:
    # all texts at once: no word has a line break, so none is found across two of them
    words = T.let(F.lower(F.array_join("filled", "\n")), lambda t: _contains_any(t, T.FOOTER_WORDS))
    return words | F.coalesce(F.lower(name).isin(*T.HUB_LABELS), F.lit(False))


def dynamic_label() -> Column:
    """The longer text of one or two filled cells without links, if short, of one line and in no data column."""
    cells = F.filter(F.transform("cells", lambda c, i: F.struct(F.length(T.strip(c["text"])).alias("n"), (-i).alias("at"), T.strip(c["text"]).alias("text"))), lambda c: c["n"] > 0)

    def label(best: Column) -> Column:
        in_data = F.lit(False)
        for f in ("quality", "track_length", "available_length", "links"):
            in_data = in_data | F.coalesce(-best["at"] == column_of(f), F.lit(False))
        return F.when((best["n"] <= LABEL_CHARS) & ~best["text"].contains("\n") & ~in_data, best["text"])

    few = F.size("filled").between(1, 2) & ~F.exists("cells", lambda c: (T.strip(c["text"]) != "") & (F.size(c["links"]) > 0))
    return F.when(few, T.let(F.array_max(cells), label))


def register_keys(name: Column, alts: Column) -> Column:
    """Keys under which an era is found: its match key, its full name, its other names, parts joined by ' / '."""
    return keys_of(name, alts, T.match_key(name), T.full_key(name))


def keys_of(name: Column, alts: Column, primary: Column, full: Column) -> Column:
    parts = F.when(name.contains(" / "), F.transform(F.split(name, " / "), T.match_key)).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(primary, full), F.transform(alts, T.match_key), parts)
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def with_version_columns(projected: DataFrame) -> DataFrame:
    """Adds the song columns that a row's name, notes and links give: ``title``, tag, badge, credits, links."""
    # badges are no ASCII: names of ASCII alone, stripped as they are, have none
    ascii_only = F.octet_length("name") == F.length("name")
    named = projected.withColumns({"badge": F.when(~ascii_only, T.badge(F.col("name"))), "_named": F.when(ascii_only, F.col("name")).otherwise(T.without_badge(F.col("name")))})
    named = named.withColumn("_bare", T.lines(T.without_credits(F.col("_named"))))
    named = named.withColumns({"_alts": T.other_lines(F.col("_bare")), "_title": F.element_at("_bare", 1)})
    is_unfinished = lambda t: t.rlike(r"(?i)^\[?unfinished\]?$")
    links = lambda f: F.transform(F.filter(f"{f}_cell_links", lambda x: x != ""), unwrap_link)
    return named.withColumns(
        {
            "title": T.without_tag(F.col("_title")),
            "version_tag": F.coalesce(T.version_tag(F.col("_title")), F.when(F.exists("_alts", is_unfinished), "Unfinished")),
            # a badge stands before all credits: they are the same with it
            **{k: T.credit(F.col("name"), k) for k in T.CREDITS},
            "alt_titles": F.filter("_alts", lambda t: ~is_unfinished(t)),
            "links": F.array_distinct(F.concat(links("links"), links("alt_links"), links("notes"))),
        }
    ).drop("_named", "_bare", "_alts", "_title")


VERSION = (
    "version_tag", "badge", *T.CREDITS, "alt_titles", "notes", "og_filename", "samples", "track_length", "file_date", "leak_date",
    "available_length", "quality", "links", "quality_color", "available_length_color", "date_of_recording", "type",
)


def enrich_versions(described: DataFrame, fields: Sequence[str] = VERSION) -> DataFrame:
    """The song columns of every row with a name: cleaned name, badge, tag, credits, links, notes, or those asked for."""
    return described.filter("named").select("sheet_id", "row_idx", F.col("version_name").alias("name"), *fields)


def has_song_data() -> Column:
    """On projected rows: a link, quality, length or date."""
    some = F.coalesce("quality", "track_length", "available_length", "leak_date", "file_date").isNotNull()
    linked = [F.exists(f"{f}_cell_links", lambda x: x != "") for f in ("links", "alt_links", "notes")]
    return linked[0] | linked[1] | linked[2] | some


def is_label_version(n_filled: Column, era: Column) -> Column:
    """On rows with version columns: nothing but a name beside the era, so a section's label."""
    # most rows have more cells, so that no credits are looked for
    few = (n_filled - era.isNotNull().cast("int") <= 1) & (F.length(F.coalesce("notes", F.lit(""))) <= LONG_NOTE)
    return few & ~has_song_data() & F.coalesce("featuring", "producers", "collaboration").isNull()


def _with_header_name(rows: DataFrame) -> DataFrame:
    """Adds ``era_name``, ``alt_names`` and ``needs_backfill`` of header rows; nothing is read for others.

    A name in parentheses only, or an image without text, leaves the name to the next song row.
    """

    def read(names: Column) -> Column:
        first = F.element_at(names, 1)
        wrapped = first.startswith("(") & first.endswith(")") & (F.length(first) > 1)
        others = F.filter(F.transform(F.slice(names, F.lit(2), F.size(names)), T.unwrap_parens), lambda x: x != "")
        inner = F.when(wrapped, F.filter(F.array(T.unwrap_parens(first)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(wrapped, "").otherwise(first).alias("name"), F.when(wrapped, F.array_distinct(F.concat(inner, others))).otherwise(others).alias("alts"), (wrapped | (first == "")).alias("open"))

    bound = rows.withColumn("_head", F.when(F.col("kind") == "header", T.let(T.lines(F.coalesce("name", F.lit(""))), read)))
    return bound.withColumns({"era_name": F.col("_head.name"), "alt_names": F.col("_head.alts"), "needs_backfill": F.col("_head.open")}).drop("_head")


HEAD = "struct<alt_names:array<string>,description:string,timeline:array<struct<date:string,event:string>>,stats_raw:string,art_url:string,highlighted_producers:array<string>>"
_EVENTS = "array<struct<date:string,event:string>>"


def _first_image(cells: Column) -> Column:
    return F.get(F.flatten(F.transform(cells, lambda c: c["images"])), F.lit(0))


def _header_content() -> Column:
    """What a header row with statistics says: other names, description, timeline, statistics, art, producers."""

    def read(right: Column) -> Column:
        texts = F.filter(F.transform(right, lambda c: T.strip(c["text"])), lambda t: t != "")
        says = lambda t: t.contains("Highlighted") & t.contains("Producer")
        longest = F.aggregate(F.filter(texts, lambda t: ~says(t)), F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
        own_image = F.get(F.get(F.col("cells"), column_of("name"))["images"], F.lit(0))
        named = (F.coalesce("name", F.lit("")) != "") & ~(F.col("name").startswith("(") & F.col("name").endswith(")"))
        return F.struct(
            F.col("alt_names").alias("alt_names"),
            T.some(longest).alias("description"),
            F.coalesce(T.timeline(F.col("notes")), F.array().cast(_EVENTS)).alias("timeline"),
            T.some(T.strip(F.get(F.col("cells"), F.lit(0))["text"])).alias("stats_raw"),
            F.coalesce(F.when(named, own_image), _first_image(right)).alias("art_url"),
            F.coalesce(_last_producers(F.filter(texts, says)), F.array().cast("array<string>")).alias("highlighted_producers"),
        ).cast(HEAD)

    return T.let(F.slice("cells", column_of("notes") + 2, F.size("cells")), read)


def _opener_content() -> Column:
    """What other rows say that can open an era.

    A name of several lines: its notes as description, its own image, else another cell's,
    as art. A row with an era but no name: events of its notes, and the first image.
    """
    at = column_of("name")
    others = F.filter("cells", lambda c, i: i != at)
    own = F.get(F.get(F.col("cells"), at)["images"], F.lit(0))
    none, events = F.array().cast("array<string>"), F.array().cast(_EVENTS)
    empty = F.lit(None).cast("string")
    by_name = F.struct(none, T.some(F.col("notes")), events, empty, F.coalesce(F.when(F.col("name_line") != "", own), _first_image(others)), none).cast(HEAD)
    by_era = F.struct(none, empty, F.coalesce(T.timeline(F.col("notes")), events), empty, _first_image(F.col("cells")), none).cast(HEAD)
    return F.when(F.col("era").isNull() & F.col("name").contains("\n"), by_name).when(F.col("era").isNotNull() & F.col("name").isNull(), by_era)


def _last_producers(cells: Column) -> Column:
    return F.when(F.size(cells) > 0, T.highlighted_producers(F.element_at(cells, -1)))


CLASSES = (
    "kind", "era", "n_filled", "first_text", "name_line", "name_multiline", "name_plausible", "name_keys", "line_keys",
    "dynamic_label", "row_text", "named", "label_name", "has_data", "is_label", "era_name", "needs_backfill", "header_keys",
)


def describe_rows(projected: DataFrame) -> DataFrame:
    """All that later steps need of every row that is not empty, without its cells; a map over rows.

    The columns of ``CLASSES`` for the resolution of eras, those of ``VERSION`` for songs,
    and ``head`` for rows that can open an era. The columns are many and most steps need few
    of them: each selects its own, so that the others are not made.
    """
    kind = F.when(is_section_separator(), "separator").when(is_era_header(), "header").when(is_footer(F.col("name")), "footer").otherwise("row")
    none, false = F.array().cast("array<string>"), F.lit(False)
    rows = with_version_columns(projected.filter(F.size("filled") > 0)).withColumns(
        {"kind": kind, "n_filled": F.size("filled"), "named": F.col("name").isNotNull(), "name_line": T.strip(F.split(F.col("name"), "\n")[0]), "version_name": F.when(F.col("name").isNotNull(), F.col("title"))}
    )
    named = F.col("named")
    rows = _with_header_name(rows).withColumns({"has_data": F.coalesce(named & has_song_data(), false), "is_label": F.coalesce(named & is_label_version(F.col("n_filled"), F.col("era")), false)})
    is_row, is_head = F.col("kind") == "row", F.col("kind") == "header"
    # only such rows can open an era or a section by their name alone
    alone = F.col("era").isNull() & named & (F.col("n_filled") <= MOST_BESIDE_NAME)
    only_row = lambda c, cond=None: F.when(is_row if cond is None else is_row & cond, c)
    return rows.select(
        "sheet_id", "row_idx", "kind", "era", "n_filled", F.get("filled", F.lit(0)).alias("first_text"),
        "name_line", F.coalesce(F.col("name").contains("\n"), false).alias("name_multiline"),
        F.coalesce(only_row(T.plausible_era_name(F.col("name_line")), F.col("era").isNull() & F.col("name").contains("\n") & (F.col("n_filled") <= MOST_BESIDE_NAME)), false).alias("name_plausible"),
        F.coalesce(only_row(register_keys(F.col("name"), none), alone), none).alias("name_keys"),
        F.coalesce(only_row(register_keys(F.col("name_line"), none), alone), none).alias("line_keys"),
        only_row(dynamic_label()).alias("dynamic_label"),
        # what is reported of a row that is skipped
        only_row(F.substring(F.array_join("filled", " | "), 1, 200)).alias("row_text"),
        "named", "version_name", "has_data", "is_label",
        # a row with data is a song whatever its name is
        F.when(F.col("is_label") | ~F.col("has_data"), F.col("version_name")).alias("label_name"),
        F.when(is_head, F.col("era_name")).alias("era_name"), F.coalesce(F.when(is_head, F.col("needs_backfill")), false).alias("needs_backfill"),
        F.coalesce(F.when(is_head, register_keys(F.col("era_name"), F.col("alt_names"))), none).alias("header_keys"),
        F.when(is_head, _header_content()).when(is_row, _opener_content()).alias("head"),
        "version_tag", "badge", *T.CREDITS, "alt_titles", "notes",
        T.og_filename(F.col("notes")).alias("og_filename"),
        F.coalesce(T.samples(F.col("notes")), none).alias("samples"),
        "track_length", "file_date", "leak_date", "available_length", "quality", "links",
        "quality_color", "available_length_color", "date_of_recording", "type",
    )


def forward_fill(df: DataFrame, part: list[str], order: list[str], col: str, out: str | None = None) -> DataFrame:
    """The last value other than null up to each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or col, F.last(col, ignorenulls=True).over(w))


def footer_state(df: DataFrame, part: list[str], order: list[str], footer: Column, header: Column) -> DataFrame:
    """``in_footer``: from a footer row on, until the next header row."""
    event = F.when(header, False).when(footer, True)
    return forward_fill(df.withColumn("_event", event), part, order, "_event").withColumn("in_footer", F.coalesce("_event", F.lit(False))).drop("_event")


def section_ordinals(df: DataFrame, part: list[str], order: list[str], starts: Column) -> DataFrame:
    """``section_idx``: how many section rows there are up to each row."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section_idx", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w))


def change_flag(df: DataFrame, part: list[str], order: list[str], col: str, out: str = "is_first") -> DataFrame:
    """Whether a row's value differs from the row before it; the first row does."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(out, (F.row_number().over(w) == 1) | ~F.col(col).eqNullSafe(F.lag(col).over(w)))
