"""Resolution of sheet rows to eras.

Lookups that do not depend on earlier rows are joins. What does (aliases learnt from
rows, eras made on the way) is a fold over the rows of one sheet, in order, on narrow
columns; sheets are independent and bounded (the largest known has about 10 MB).
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators.rows import MOST_BESIDE_NAME, keys_of, register_keys

PLACEMENTS = "sheet_id string, row_idx int, action string, era_idx int, section_idx int, label string, match_kind string"


def _tasks(rows: DataFrame) -> int:
    """As many tasks as asked for: the rows are few bytes, but work."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words(key: str) -> set[str]:
    return {w for w in key.split() if len(w) > 2}


#: What an era's text says of it: its full text, its match key, all keys that it registers, whether it can be a name.
EraText = namedtuple("EraText", "norm, key, keys, plausible")


def era_texts(classified: DataFrame) -> DataFrame:
    """``(sheet_id, era, norm, key, keys, plausible)`` of the distinct era texts of each sheet: songs repeat few of them.

    They are spread by sheet before they are read: the distinct ones are so few bytes that one task would get all.
    """
    texts = classified.select("sheet_id", "era").filter("era is not null").distinct().repartition(_tasks(classified), "sheet_id")
    read = texts.withColumns({"norm": T.full_key(F.col("era")), "key": T.match_key(F.col("era"))})
    keys = keys_of(F.col("era"), F.array().cast("array<string>"), F.col("key"), F.col("norm"))
    return read.select("sheet_id", "era", "norm", "key", keys.alias("keys"), F.coalesce(T.plausible_era_name(F.col("era")), F.lit(False)).alias("plausible"))


class SheetFold:
    """The state of one sheet: eras, the section in use of each, and the keys learnt so far."""

    def __init__(self, texts: dict[str, EraText], name_keys: dict[str, str | None]) -> None:
        self.texts, self.name_keys = texts, name_keys
        self.names: list[str] = []
        self.sections: list[int] = []
        self.keys: dict[str, int] = {}
        self.key_words: dict[str, set[str]] = {}
        self.answers: dict[tuple[str, str], tuple[int | None, str | None]] = {}
        self.unnamed: set[int] = set()
        self.current: int | None = None
        self.in_footer = False
        self.out: list[tuple] = []

    def emit(self, row: int, action: str, label: str | None = None, match: str | None = None) -> None:
        era = self.current
        self.out.append((row, action, era, None if era is None else self.sections[era], label, match))

    def learn(self, keys: Iterable[str], era: int) -> None:
        for k in keys:
            if k not in self.keys:
                self.keys[k] = era
                self.key_words[k] = words(k)
                self.answers.clear()

    def open_era(self, row: int, name: str, keys: list[str], how: str) -> None:
        self.names.append(name)
        self.sections.append(0)
        self.current = len(self.names) - 1
        self.learn(keys, self.current)
        self.emit(row, "era", name, how)

    def open_section(self, row: int, label: str) -> None:
        self.sections[self.current] += 1
        self.emit(row, "section", label)

    def find(self, norm: str, key: str) -> tuple[int | None, str | None]:
        """The era of a row's text; answers are remembered until a key is learnt."""
        if (norm, key) not in self.answers:
            self.answers[norm, key] = self._look_up(norm, key)
        return self.answers[norm, key]

    def _look_up(self, norm: str, key: str) -> tuple[int | None, str | None]:
        if norm in self.keys:
            return self.keys[norm], "exact"
        if key in self.keys:
            return self.keys[key], "key"
        mine, best, score = words(norm), None, 0.0
        for other, era in self.keys.items() if mine else ():
            theirs = self.key_words[other]
            shared = len(mine & theirs)
            if shared >= 2 and shared / min(len(mine), len(theirs)) > score:
                best, score = era, shared / min(len(mine), len(theirs))
        if score >= 0.5:
            return best, "fuzzy"
        glued = norm.replace(" ", "")
        if mine and len(glued) >= 3:
            for other, era in self.keys.items():
                parts = other.split()
                if len(parts) >= 3 and glued == "".join(p[0] for p in parts):
                    return era, "acronym"
        return None, None

    def row(self, r) -> None:
        at = int(r.row_idx)
        if r.kind == "separator":
            if self.current is not None:
                self.open_section(at, r.first_text)
        elif r.kind == "header":
            self.in_footer = False
            self.open_era(at, r.header["era_name"], r.header["header_keys"], "header")
            if r.header["needs_backfill"]:
                self.unnamed.add(self.current)
        elif r.kind == "footer" or self.in_footer:
            self.in_footer = True
            self.emit(at, "footer")
        elif r.era and self.current in self.unnamed:
            self.names[self.current] = r.era
            self.learn(self.texts[r.era].keys, self.current)
            self.unnamed.discard(self.current)
            self.emit(at, "name", r.era)
            if r.named:
                self.emit(at, "song", match="backfill")
        elif r.era:
            self.era_row(at, r)
        elif not self.name_row(at, r):
            self.rest(at, r)

    def era_row(self, at: int, r) -> None:
        named, text = r.named, self.texts[r.era]
        found, how = self.find(text.norm, text.key)
        if found is not None:
            self.current = found
            if named and r.is_label:
                self.emit(at, "matched", match=how)
                self.open_section(at, r.label_name)
            else:
                self.emit(at, "song" if named else "matched", match=how)
        elif self.current is None:
            if not text.plausible:
                self.emit(at, "skip", r.row_text)
                return
            self.open_era(at, r.era, text.keys, "auto")
            if named:
                self.emit(at, "song", match="auto")
        elif text.key and text.key == self.current_key():
            if named:
                self.emit(at, "song", match="same")
            elif r.n_filled <= 3:
                self.open_section(at, r.era)
        elif named and text.plausible and not r.has_data:
            self.open_era(at, r.era, text.keys, "auto")  # the row's own version is not kept
        elif named:
            self.emit(at, "song", match="learnt" if text.plausible else "fallback")
            if text.plausible:
                self.learn([text.key], self.current)
        elif r.n_filled <= 2 or not text.plausible:
            self.open_section(at, r.era)
        else:
            self.open_era(at, r.era, text.keys, "auto")

    def current_key(self) -> str | None:
        """The match key of the current era's name: the first key that the name registers."""
        return self.name_keys.get(self.names[self.current])

    def name_row(self, at: int, r) -> bool:
        alone = r.alone
        if not alone["name_line"] or r.n_filled > MOST_BESIDE_NAME:
            return False
        if alone["name_multiline"] and alone["name_plausible"]:
            self.open_era(at, alone["name_line"], alone["name_keys"], "name")
        elif self.current is not None:
            self.open_section(at, alone["name_line"])
            self.learn(alone["line_keys"], self.current)
        else:
            self.open_era(at, alone["name_line"], alone["name_keys"], "name")
        return True

    def rest(self, at: int, r) -> None:
        label = r.alone["dynamic_label"]
        if self.current is not None and not r.alone["name_line"] and label:
            self.open_section(at, label)
        elif self.current is not None and r.named and (r.label_name or r.has_data):
            self.emit(at, "song", match="position")
        else:
            self.emit(at, "skip", r.row_text)


_OUT = pa.schema([("sheet_id", pa.string()), ("row_idx", pa.int32()), ("action", pa.string()), ("era_idx", pa.int32()), ("section_idx", pa.int32()), ("label", pa.string()), ("match_kind", pa.string())])


def _values(column: pa.ChunkedArray) -> list:
    """``to_pylist``, without an Arrow object for each value; a struct that few rows have is read where it is."""
    if pa.types.is_struct(column.type):
        known = iter(column.drop_null().to_pylist())
        return [next(known) if there else None for there in column.is_valid().to_numpy().tolist()]
    if pa.types.is_string(column.type) or not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy().tolist()
    return column.to_pylist()


#: The rows of a sheet by their columns' names.
_row_type = lru_cache(16)(lambda *names: namedtuple("Row", names))


def _fold(key: tuple, group: pa.Table, texts: pa.Table) -> pa.Table:
    read = texts.drop_columns(["sheet_id"]).to_pydict()
    of_text = dict(zip(read.pop("era"), map(EraText._make, zip(*(read[f] for f in EraText._fields), strict=True)), strict=True))
    group = group.drop_columns(["sheet_id"]).sort_by("row_idx")
    columns = dict(zip(group.column_names, map(_values, group.columns), strict=True))
    rows = list(map(_row_type(*columns)._make, zip(*columns.values(), strict=True)))
    # key of each name that an era can get: from the first row with it
    name_keys: dict[str, str | None] = {}
    for era, kind in zip(columns["era"], columns["kind"], strict=True):
        if era is not None and era not in name_keys:
            name_keys[era] = of_text[era].key if kind == "row" else None
    for which, name, keys in (("header", "era_name", "header_keys"), ("alone", "name_line", "line_keys")):
        for r in columns[which]:
            if r is not None and r[name] is not None and r[keys]:
                name_keys.setdefault(r[name], r[keys][0])
    state = SheetFold(of_text, name_keys)
    for r in rows:
        state.row(r)
    if not state.out:
        return _OUT.empty_table()
    sheet = pa.repeat(key[0].cast(pa.string()), len(state.out))
    return pa.Table.from_arrays([sheet, *(pa.array(c, f.type) for c, f in zip(zip(*state.out, strict=True), list(_OUT)[1:], strict=True))], schema=_OUT)


def resolve_rows(classified: DataFrame) -> DataFrame:
    """What each row does: opens an era or a section, names an era, is a song of one, footer or skipped.

    ``(sheet_id, row_idx, action, era_idx, section_idx, label, match_kind)``; a row can do two things.
    A sheet's rows meet what its era texts say; what few rows need is null in the others.
    """
    is_row, kind = F.col("kind") == "row", F.col("kind")
    rows = classified.select(
        "sheet_id", "row_idx", "kind", "era", "n_filled", "named", "has_data", "is_label", "label_name", F.when(kind == "separator", F.col("first_text")).alias("first_text"), "row_text",
        F.when(kind == "header", F.struct("era_name", "needs_backfill", "header_keys")).alias("header"),
        F.when(is_row & F.col("era").isNull(), F.struct("name_line", "name_multiline", "name_plausible", "name_keys", "line_keys", "dynamic_label")).alias("alone"),
    )
    texts = era_texts(classified).groupBy("sheet_id")
    return rows.repartition(_tasks(classified), "sheet_id").groupBy("sheet_id").cogroup(texts).applyInArrow(_fold, PLACEMENTS)


# ---------------------------------------------------------------- lookups without state


def era_keys(eras: DataFrame) -> DataFrame:
    """``(sheet_id, key, era_idx)`` over ``(sheet_id, era_idx, name, alt_names)``: the first era of a key has it."""
    keys = eras.select("sheet_id", "era_idx", F.posexplode(register_keys(F.col("name"), F.col("alt_names"))).alias("ord", "key"))
    return keys.groupBy("sheet_id", "key").agg(F.min_by("era_idx", F.struct("era_idx", "ord")).alias("era_idx"), F.min(F.struct("era_idx", "ord")).alias("registered"))


def resolve_exact(rows: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``era_idx``: by the full text without accents and case, else by its match key; null if neither."""
    k = keys.select("sheet_id", "key", "era_idx")
    first = rows.withColumns({"_full": T.full_key(F.col(text_col)), "_match": T.match_key(F.col(text_col))})
    one = first.join(k.select("sheet_id", F.col("key").alias("_full"), F.col("era_idx").alias("_e1")), ["sheet_id", "_full"], "left")
    two = one.join(k.select("sheet_id", F.col("key").alias("_match"), F.col("era_idx").alias("_e2")), ["sheet_id", "_match"], "left")
    return two.withColumn("era_idx", F.coalesce("_e1", "_e2")).drop("_full", "_match", "_e1", "_e2")


def _words(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(col, r"\s+"), lambda w: F.length(w) > 2))


def _by_rarity(rows: DataFrame, side_id: str, by: list[str], counts: DataFrame) -> DataFrame:
    """``(by, side_id, words)``: each row's words, the rarest first."""
    named = rows.select(*by, side_id, F.explode(_words(F.col("key"))).alias("_w")).join(counts, [*by, "_w"])
    order = F.array_sort(F.collect_set(F.struct("_c", "_w")))
    return named.groupBy(*by, side_id).agg(F.transform(order, lambda w: w["_w"]).alias("words"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, by: list[str] | None = None, least_shared: int = 2, least_score: float = 0.5) -> DataFrame:
    """``(left_id, right_id, shared, score)``: of each left row the right one that shares most words.

    Both sides have a column ``key``. Words of over two characters count; ``least_shared``
    must be shared, and ``least_score`` of the shorter side's; ties go to the least
    ``right_id``. ``by`` names further columns that must be equal.

    A pair that shares ``t`` words has its rarest shared word among each side's words but the
    ``t - 1`` most frequent ones. Sides are joined on these rarer words alone, and a pair is
    made at its rarest shared word only: once, and never at a word that half of the rows
    have beside rarer ones. Rights of equal words meet as one.
    """
    by = by or []
    every = left.select(*by, "key").unionByName(right.select(*by, "key"))
    counts = every.select(*by, F.explode(_words(F.col("key"))).alias("_w")).groupBy(*by, "_w").agg(F.count("*").alias("_c"))
    lefts = _by_rarity(left, left_id, by, counts).withColumnRenamed("words", "_lw")
    rights = _by_rarity(right, right_id, by, counts).groupBy(*by, "words").agg(F.min(right_id).alias(right_id)).withColumnRenamed("words", "_rw")
    rare = lambda words: F.slice(words, F.lit(1), F.greatest(F.size(words) - (least_shared - 1), F.lit(0)))
    one = lefts.select(*by, left_id, "_lw", F.posexplode(rare(F.col("_lw"))).alias("_i", "_w"))
    two = rights.select(*by, right_id, "_rw", F.posexplode(rare(F.col("_rw"))).alias("_j", "_w"))
    shorter = F.least(F.size("_lw"), F.size("_rw"))
    need = F.greatest(F.lit(least_shared), F.ceil(F.lit(least_score) * shorter - 1e-9).cast("int"))
    close = one.join(two, [*by, "_w"]).filter((F.col("_i") <= F.size("_lw") - need) & (F.col("_j") <= F.size("_rw") - need))
    both = close.withColumn("_both", F.array_intersect("_lw", "_rw")).filter(F.get("_both", F.lit(0)) == F.col("_w"))
    scored = both.withColumns({"shared": F.size("_both").cast("long"), "score": F.size("_both") / shorter}).filter((F.col("shared") >= least_shared) & (F.col("score") >= least_score))
    best = scored.groupBy(*by, left_id).agg(F.max_by(F.struct(right_id, "shared", "score"), F.struct("score", -F.col(right_id))).alias("b"))
    return best.select(*by, left_id, f"b.{right_id}", "b.shared", "b.score")


def acronym_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, by: list[str] | None = None) -> DataFrame:
    """``(left_id, right_id)``: left keys, blanks removed, that are the initials of a right key of three words or more."""
    by = by or []
    short = left.withColumn("_a", F.replace("key", F.lit(" "), F.lit(""))).filter(F.length("_a") >= 3).select(*by, left_id, "_a")
    long = right.select(*by, right_id, T.acronym(F.col("key")).alias("_a")).filter("_a is not null").groupBy(*by, "_a").agg(F.min(right_id).alias(right_id))
    return short.join(long, [*by, "_a"]).groupBy(*by, left_id).agg(F.min(right_id).alias(right_id))


def unused_keys(keys: DataFrame, used: DataFrame) -> DataFrame:
    """Keys ``(sheet_id, key)`` that no row uses, with the used ones that contain it or that it contains."""
    idle = keys.join(used, ["sheet_id", "key"], "left_anti").select("sheet_id", "key")
    near = idle.join(used.select("sheet_id", F.col("key").alias("used_key")).distinct(), "sheet_id").filter(F.col("used_key").contains(F.col("key")) | F.col("key").contains(F.col("used_key")))
    listed = near.groupBy("sheet_id", "key").agg(F.array_sort(F.collect_set("used_key")).alias("near_misses"))
    return idle.join(listed, ["sheet_id", "key"], "left").withColumn("near_misses", F.coalesce("near_misses", F.array().cast("array<string>")))


def art_map(rows: DataFrame) -> DataFrame:
    """``(sheet_id, key, art_url)`` of an art sheet's rows: per key the first image of a row that says cover, else the first."""
    image = F.get(F.flatten(F.transform("cells", lambda c: c["images"])), F.lit(0))
    texts = F.filter(F.transform("cells", lambda c: T.strip(c["text"])), lambda t: t != "")
    read = rows.select("sheet_id", "row_idx", image.alias("url"), T.match_key(F.get(texts, F.lit(0))).alias("key"), F.array_join(texts, " ").alias("all"))
    read = read.filter("url is not null and key is not null and key <> ''")
    cover = F.col("all").rlike(r"(?i)\bcover\b")
    best = read.groupBy("sheet_id", "key").agg(F.min_by(F.when(cover, F.col("url")), F.when(cover, F.col("row_idx"))).alias("c"), F.min_by("url", "row_idx").alias("f"))
    return best.select("sheet_id", "key", F.coalesce("c", "f").alias("art_url"))


def apply_art(eras: DataFrame, art: DataFrame) -> DataFrame:
    """``eras`` with ``art_url`` from the art of its name's key, else of its other names in order, else its own."""
    keys = eras.select("sheet_id", "era_idx", F.posexplode(F.transform(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>"))), T.match_key)).alias("ord", "key"))
    hit = keys.join(art.withColumnRenamed("art_url", "_art"), ["sheet_id", "key"]).groupBy("sheet_id", "era_idx").agg(F.min_by("_art", "ord").alias("_art"))
    return eras.join(hit, ["sheet_id", "era_idx"], "left").withColumn("art_url", F.coalesce("_art", "art_url")).drop("_art")


def _related(ka: Column, kb: Column, a: Column, b: Column) -> Column:
    """Whether two eras belong together, by their match keys and names."""
    wa, wb = F.split(ka, " ")[0], F.split(kb, " ")[0]
    same = (ka == kb) | ka.startswith(F.concat(kb, F.lit(" "))) | kb.startswith(F.concat(ka, F.lit(" "))) | ((wa == wb) & (F.length(wa) > 3))
    collab = F.lower(a).startswith("collaboration with ") & F.rtrim(F.lower(b)).endswith("collab")
    return ((ka != "") & (kb != "") & same) | collab


def merge_stub_eras(eras: DataFrame) -> DataFrame:
    """Merges eras without songs into related ones: into the next era, else into any of an equal key.

    Over ``(sheet_id, era_idx, name, alt_names, description, art_url, stats_raw, timeline, n_songs)``.
    The target keeps its values and takes what it lacks; the longer name stays.
    """
    order = Window.partitionBy("sheet_id").orderBy("era_idx")
    fields = ["name", "alt_names", "description", "art_url", "stats_raw", "timeline"]
    following = {f"_next_{c}": F.lead(c).over(order) for c in ("name", "_key", "era_idx", "n_songs")}
    looked = eras.withColumn("_key", T.match_key(F.col("name"))).withColumns(following)
    forward = (F.col("n_songs") == 0) & (F.col("_next_n_songs") > 0) & _related(F.col("_key"), F.col("_next__key"), F.col("name"), F.col("_next_name"))
    looked = looked.withColumn("_into", F.when(forward, F.col("_next_era_idx"))).drop("_key", *following)
    once = _absorb(looked.filter("_into is null").drop("_into"), looked.filter("_into is not null"), fields)
    keyed = once.withColumn("_key", T.match_key(F.col("name")))
    targets = keyed.filter("n_songs > 0 and _key <> ''").groupBy("sheet_id", "_key").agg(F.min("era_idx").alias("_into"))
    second = keyed.filter("n_songs = 0 and _key <> ''").join(targets, ["sheet_id", "_key"]).drop("_key")
    rest = once.join(second.select("sheet_id", "era_idx"), ["sheet_id", "era_idx"], "left_anti")
    return _absorb(rest, second, fields)


def _absorb(targets: DataFrame, stubs: DataFrame, fields: list[str]) -> DataFrame:
    first = lambda f: F.min_by(F.when(_has(f), F.col(f)), F.when(_has(f), F.col("era_idx"))).alias(f"_{f}")
    given = stubs.groupBy("sheet_id", F.col("_into").alias("era_idx")).agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("era_idx"))).alias("_name"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("era_idx", "alt_names"))), lambda s: s["alt_names"])).alias("_alt_names"),
        *[first(f) for f in fields if f not in ("name", "alt_names")],
    )
    merged = targets.join(given, ["sheet_id", "era_idx"], "left")
    new = {"name": F.when(F.length("_name") > F.length("name"), F.col("_name")).otherwise(F.col("name")), "alt_names": F.array_union("alt_names", F.coalesce("_alt_names", F.array().cast("array<string>")))}
    new |= {f: F.when(_has(f), F.col(f)).otherwise(F.coalesce(f"_{f}", f)) for f in fields if f not in new}
    return merged.withColumns(new).drop(*[f"_{f}" for f in fields])


def _has(field: str) -> Column:
    return F.size(field) > 0 if field == "timeline" else F.coalesce(F.col(field) != "", F.lit(False))
