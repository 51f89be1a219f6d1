"""Detection of a sheet's columns and projection of its rows onto fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import let, squash

# Fixed: header text -> field, in order of preference.
ALIASES = {
    "era": "era", "name": "name", "title": "name", "song name": "name", "song title": "name",
    "notes": "notes", "notes & information": "notes", "track number / info": "notes", "info": "notes", "description": "notes",
    "track length": "track_length", "length": "track_length", "track duration": "track_length", "duration": "track_length",
    "file date": "file_date", "creation date": "file_date", "date created": "file_date", "year": "file_date",
    "leak date": "leak_date", "release date": "leak_date", "obtained on:": "leak_date", "obtained on": "leak_date",
    "available length": "available_length", "currently available": "available_length", "available?": "available_length", "what's available?": "available_length",
    "available": "available_length", "song status": "available_length", "status": "available_length", "availability": "available_length", "portion": "available_length",
    "quality": "quality",
    "link(s)": "links", "links": "links", "link": "links", "download(s)": "links", "downloads": "links", "download": "links", "og link(s)": "links", "main link": "links",
    "alternate links": "alt_links", "alternate link": "alt_links", "alt links": "alt_links", "alt link": "alt_links", "mirror links": "alt_links", "mirror link": "alt_links", "mirrors": "alt_links", "mirror": "alt_links",
    "streaming": "streaming", "streaming?": "streaming", "in circulation": "available_length",
    "type": "type", "track type": "type", "song type": "type", "date of recording": "date_of_recording", "recording date": "date_of_recording",
}
#: Fields that a reader expects; others are unusual.
KNOWN_FIELDS = ("era", "name", "notes", "track_length", "file_date", "leak_date", "available_length", "quality", "links", "alt_links", "type", "date_of_recording")
#: Rows in which the header may stand, and columns where fields stand when it does not say.
HEADER_ROWS = 11
DEFAULTS = {"era": 0, "name": 1, "notes": 2}
SCALARS = ("track_length", "file_date", "leak_date", "available_length", "quality", "date_of_recording", "type", "streaming")


def field_of(key: Column, aliases: dict[str, str]) -> Column:
    """The field of a header key: an equal alias, else the first alias that it begins with."""

    def choose(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for alias, field in reversed([(a, f) for a, f in aliases.items() if len(a) > 2]):
            out = F.when(k.startswith(alias), field).otherwise(out)
        equal = F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), k)
        return F.coalesce(equal, out)

    return let(key, choose)


def header_field(text: Column, aliases: dict[str, str]) -> Column:
    """The field that a header cell names: by the text before a parenthesis, else by one of its lines."""
    at = F.instr(text, "(")
    raw = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    whole = field_of(squash(F.lower(raw)), aliases)
    by_line = F.filter(F.transform(F.split(raw, "\n"), lambda x: field_of(squash(F.lower(x)), aliases)), lambda x: x.isNotNull())
    return F.coalesce(whole, F.get(by_line, F.lit(0)))


def row_fields(texts: Column, aliases: dict[str, str]) -> Column:
    """map<field,column> of one row's texts; the first column of a field counts."""
    named = F.filter(F.transform(texts, lambda t, i: F.struct(header_field(t, aliases).alias("field"), i.alias("col_idx"))), lambda f: f["field"].isNotNull())

    def once(found: Column) -> Column:
        fields = F.transform(found, lambda f: f["field"])
        return F.map_from_entries(F.filter(found, lambda f, i: F.array_position(fields, f["field"]) == i + 1))

    return let(named, once)


def layout_of(head: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """struct(header_row, fields) of a sheet's first rows (array<array<text>>): the first row with two fields, else row 0."""

    def choose(rows: Column) -> Column:
        fit = F.filter(F.transform(rows, lambda f, i: F.struct(i.alias("header_row"), f.alias("fields"))), lambda r: F.size(r["fields"]) >= 2)
        none = F.expr("cast(map() as map<string,int>)")
        first = F.struct(F.lit(0).alias("header_row"), F.coalesce(F.get(rows, F.lit(0)), none).alias("fields"))
        return F.coalesce(F.get(fit, F.lit(0)), first)

    return let(F.transform(head, lambda texts: row_fields(texts, aliases)), choose)


def detect_layout(rows: DataFrame) -> DataFrame:
    """``(sheet_id, header_row, fields map<string,int>)`` of the sheets of ``sheet_rows``."""
    return rows.filter("row_idx = 0").select("sheet_id", "header_row", "fields")


def layout_columns(layout: DataFrame) -> DataFrame:
    """``(sheet_id, field, col_idx)`` of the chosen header rows."""
    return layout.select("sheet_id", F.explode("fields").alias("field", "col_idx"))


def column_of(field: str) -> Column:
    """Index of a field in ``fields``, its default, or null."""
    return F.coalesce(F.element_at(F.col("fields"), F.lit(field)), F.lit(DEFAULTS.get(field)).cast("int"))


def cell_of(field: str) -> Column:
    return F.get(F.col("cells"), column_of(field))


def project_fields(rows: DataFrame) -> DataFrame:
    """Rows below the header with a text column for each field (null if empty) and the cells of links and notes.

    ``filled`` has the row's texts that are not blank. A map over rows: each carries its layout.
    The texts of ``sheet_rows`` have no white space at their ends.
    """
    below = rows.filter(F.col("row_idx") > F.col("header_row"))
    text = lambda f: F.nullif(cell_of(f)["text"], F.lit(""))
    return below.select(
        "sheet_id", "row_idx", "cells", "fields",
        F.array_remove(F.col("cells")["text"], "").alias("filled"),
        *[text(f).alias(f) for f in ("era", "name", "notes", *SCALARS)],
        *[F.coalesce(cell_of(f)["links"], F.array().cast("array<string>")).alias(f"{f}_cell_links") for f in ("links", "alt_links", "notes")],
        *[cell_of(f)["bg_color"].alias(f"{f}_color") for f in ("quality", "available_length")],
    )


def field_matrix(columns: DataFrame, sheets: DataFrame) -> DataFrame:
    """``(field, sheet_id, col_idx)`` for every field that any sheet has and every sheet; null where it lacks it.

    The fields are few: a list of some dozens goes to every sheet, as a column.
    """
    known = columns.groupBy().agg(F.sort_array(F.collect_set("field")).alias("known"))
    had = columns.groupBy("sheet_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "col_idx"))).alias("had"))
    fields = known.first()["known"] or []
    wide = sheets.select("sheet_id").distinct().join(had, "sheet_id", "left")
    every = wide.select("sheet_id", "had", F.explode(F.array(*[F.lit(f) for f in fields]).cast("array<string>")).alias("field"))
    return every.select("field", "sheet_id", F.element_at("had", F.col("field")).alias("col_idx"))


def diff_layouts(columns: DataFrame) -> DataFrame:
    """``(field, n_sheets, n_positions, differs)`` over ``(sheet_id, field, col_idx)``."""
    return columns.groupBy("field").agg(F.countDistinct("sheet_id").alias("n_sheets"), F.countDistinct("col_idx").alias("n_positions")).withColumn("differs", F.col("n_positions") > 1)


def missing_fields(columns: DataFrame, expected: tuple[str, ...] = KNOWN_FIELDS) -> DataFrame:
    """``(sheet_id, missing, unusual)``: expected fields that a sheet lacks and others that it has, sorted."""
    had = columns.groupBy("sheet_id").agg(F.collect_set("field").alias("had"))
    want = F.array(*[F.lit(f) for f in expected])
    return had.select("sheet_id", F.array_sort(F.array_except(want, "had")).alias("missing"), F.array_sort(F.array_except("had", want)).alias("unusual"))
