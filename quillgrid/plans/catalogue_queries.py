"""Registered queries over catalogue-shaped tables: songs, statistics, search, quality, favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.labels import first_streamable
from quillgrid.operators import favourites as fav
from quillgrid.operators import quality as dq
from quillgrid.operators import resolve, search, songs, stats
from quillgrid.operators.hashes import near_hash, near_hash_rows
from quillgrid.operators.search_index import build_index, write_ordered
from quillgrid.plans.fixtures import V, eras, table, versions
from quillgrid.scratch import new_folder
from quillgrid.sources.feeds import read_report, write_report

QUERIES, SQL = {}, {}
HOST = r"list_filter(links, lambda x: regexp_matches(x, '(?i)^https?://(?:(?:www\.)?(?:pillows\.su|pillowcase\.su|(?:temp\.)?imgur\.gg)/f/|music\.froste\.lol/song/[a-f0-9]+|(?:www\.)?krakenfiles\.com/view/[A-Za-z0-9_-]+/file\.html)'))"
SONGS = "sheet_id, era_idx, base_name"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- songs


@query(
    V + f"""SELECT {SONGS}, min(row_idx) AS first_row, arg_min(section_idx, row_idx) AS section_idx, count(*) AS n_versions, arg_min(badge, row_idx) FILTER (badge IS NOT NULL) AS badge,
CASE WHEN bool_or(badge = 'best') THEN 'best' WHEN bool_or(badge = 'special') THEN 'special' ELSE arg_min(badge, row_idx) FILTER (badge IS NOT NULL) END AS display_badge,
arg_min(available_length, row_idx) AS primary_length, arg_min(quality, row_idx) AS primary_quality FROM v GROUP BY {SONGS}"""
)
def song_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01, PRJ-06/07."""
    v = versions(spark, sf_dir).withColumn("track_length", F.lit(None).cast("string"))
    s = songs.build_songs(v)
    return s.select("sheet_id", "era_idx", "base_name", "first_row", "section_idx", "n_versions", "badge", "display_badge", F.col("primary_available_length").alias("primary_length"), "primary_quality")


@query(
    V + f"""SELECT {SONGS}, string_agg(alt, '|' ORDER BY r, pos) AS alts FROM (SELECT {SONGS}, lower(alt) AS k, min(row_idx) AS r, arg_min(alt, row_idx * 10 + pos) AS alt, arg_min(pos, row_idx * 10 + pos) AS pos
FROM (SELECT {SONGS}, row_idx, unnest(alt_titles) AS alt, generate_subscripts(alt_titles, 1) AS pos FROM v) GROUP BY ALL)
WHERE (sheet_id, era_idx, base_name) IN (SELECT ({SONGS}) FROM v GROUP BY {SONGS} HAVING count(*) > 1) GROUP BY {SONGS}""".replace(f"SELECT ({SONGS}) FROM", f"SELECT {SONGS} FROM")
)
def song_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09."""
    return songs.song_alt_titles(versions(spark, sf_dir)).select("sheet_id", "era_idx", "base_name", F.array_join("alt_titles", "|").alias("alts"))


@query(V + f"SELECT {SONGS}, min(row_idx) AS row_idx, arg_min({HOST}[1], row_idx) AS link FROM v WHERE len({HOST}) > 0 GROUP BY {SONGS}")
def song_first_streamable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08."""
    return songs.first_streamable_versions(versions(spark, sf_dir))


@query(V + f"SELECT {SONGS}, min(row_idx) AS row_idx, arg_min({HOST}[1], row_idx) AS link FROM v WHERE len({HOST}) > 0 AND og_filename IS NULL GROUP BY {SONGS}")
def song_first_playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, the other dialect: versions whose file is an archive are passed over."""
    return songs.first_streamable_versions(versions(spark, sf_dir), dialect="ios")


@query(V + f"SELECT sheet_id, row_idx, min(CASE WHEN len({HOST}) > 0 THEN row_idx END) OVER (PARTITION BY sheet_id, era_idx ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_row FROM v")
def version_next_streamable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-06."""
    return songs.next_streamable(versions(spark, sf_dir)).select("sheet_id", "row_idx", "next_row")


@query(
    V + "SELECT sheet_id, row_idx, label, value FROM (SELECT sheet_id, row_idx, unnest(['Quality', 'Available', 'File date', 'Leak date', 'Producers', 'Subtitle', 'Also known as']) AS label, "
    "unnest([quality, available_length, file_date, leak_date, producers, alt_titles[1], alt_titles[2]]) AS value FROM v) WHERE value IS NOT NULL"
)
def version_detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10."""
    return songs.version_details(versions(spark, sf_dir), ["sheet_id", "row_idx"]).select("sheet_id", "row_idx", "label", "value")


@query(V + "SELECT sheet_id, count(DISTINCT (era_idx, base_name)) AS n_songs, count(*) AS n_versions, sum(len(links))::BIGINT AS n_links, count(*) FILTER (len(links) > 0) AS n_linked FROM v GROUP BY sheet_id")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-02."""
    return songs.catalog_counts(versions(spark, sf_dir), ["sheet_id"])


@query(V + "SELECT sheet_id, era_idx, era_name, section_idx, base_name, row_idx, name, quality, len(links)::BIGINT AS n_links FROM v")
def catalogue_nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: nesting and flattening give the rows back."""
    v = versions(spark, sf_dir).withColumn("section_name", F.lit("s"))
    flat = songs.flatten_catalog(songs.nest_catalog(v, ["name", "quality", "links"]))
    return flat.select("sheet_id", "era_idx", "era_name", "section_idx", "base_name", "row_idx", "name", "quality", F.size("links").cast("long").alias("n_links"))


@query(V + """SELECT sheet_id, row_idx, substr(sha256('{"base_name":"' || base_name || '","quality":"' || quality || '"}'), 1, 16) AS fingerprint FROM v""")
def version_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-15."""
    return versions(spark, sf_dir).select("sheet_id", "row_idx", songs.content_hash(["quality", "base_name"]).alias("fingerprint"))


_SECTIONS = "SELECT 'book-' || (c_custkey // 40) AS sheet_id, (c_custkey // 40)::BIGINT AS era_idx, c_custkey AS section_idx, CASE WHEN c_custkey % 5 = 0 THEN 'Disc ' || c_custkey WHEN c_custkey % 7 = 0 THEN 'Demos' ELSE 'Part ' || c_custkey END AS name, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 4 + 1 END AS n_songs FROM customer"


@query(
    f"WITH s AS ({_SECTIONS}), g AS (SELECT *, last_value(CASE WHEN n_songs = 0 AND name NOT IN ('Demos') THEN name END IGNORE NULLS) OVER (PARTITION BY sheet_id ORDER BY section_idx) AS grp FROM s) "
    "SELECT sheet_id, section_idx, name, grp FROM g WHERE n_songs > 0"
)
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-04."""
    c = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("book-"), F.floor(c / 40).cast("string")).alias("sheet_id"), F.floor(c / 40).alias("era_idx"), c.alias("section_idx"),
        F.when(c % 5 == 0, F.concat(F.lit("Disc "), c.cast("string"))).when(c % 7 == 0, "Demos").otherwise(F.concat(F.lit("Part "), c.cast("string"))).alias("name"),
        F.when((c % 5 == 0) | (c % 7 == 0), 0).otherwise(c % 4 + 1).alias("n_songs"),
    )
    return songs.consolidate_groups(s).select("sheet_id", "section_idx", "name", F.col("group").alias("grp"))


@query(f"WITH s AS ({_SECTIONS}) SELECT sheet_id, count(*) AS n_sections, count(*) FILTER (c % 6 > 0) AS n_named FROM (SELECT *, section_idx AS c FROM s) GROUP BY sheet_id")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-02: sections and named ones."""
    c = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(F.concat(F.lit("book-"), F.floor(c / 40).cast("string")).alias("sheet_id"), F.when(c % 6 > 0, F.col("c_name")).alias("name"))
    return songs.section_counts(s, ["sheet_id"])


# ---------------------------------------------------------------- statistics

_PERCENT = "floor(100.0 * available / total + 0.5)::BIGINT AS percent"


@query(
    V + f"""SELECT *, {_PERCENT} FROM (SELECT sheet_id, era_idx, count(*) AS total, count(*) FILTER (len({HOST}) > 0) AS available, count(*) FILTER (available_length = 'Snippet') AS snippets,
count(*) FILTER (len(links) = 0 AND badge IS NULL) AS confirmed, count(*) FILTER (available_length = 'Full' AND quality = 'High Quality (HQ)') AS full_hq FROM v GROUP BY sheet_id, era_idx)"""
)
def era_stats_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-03."""
    return stats.availability_stats(versions(spark, sf_dir), ["sheet_id", "era_idx"])


@query(
    V + f"""SELECT *, {_PERCENT} FROM (SELECT sheet_id, era_idx, count(*) AS total, count(*) FILTER (len({HOST}) > 0 AND og_filename IS NULL) AS available, count(*) FILTER (available_length = 'Snippet') AS snippets,
count(*) FILTER (available_length = 'Confirmed' AND NOT (len({HOST}) > 0 AND og_filename IS NULL)) AS confirmed, count(*) FILTER (available_length IN ('Full', 'OG File') AND quality <> 'Not Available') AS full_hq FROM v GROUP BY sheet_id, era_idx)"""
)
def era_stats_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-04, FLT-14."""
    return stats.availability_stats(versions(spark, sf_dir), ["sheet_id", "era_idx"], "ios")


@query(
    V + f"""SELECT sheet_id, count(*)::BIGINT AS total, count(*) FILTER (len({HOST}) > 0)::BIGINT AS available, count(*) FILTER (available_length = 'Snippet')::BIGINT AS snippets,
count(*) FILTER (len(links) = 0 AND badge IS NULL)::BIGINT AS confirmed, count(*) FILTER (available_length = 'Full' AND quality = 'High Quality (HQ)')::BIGINT AS full_hq FROM v GROUP BY sheet_id"""
)
def sheet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-03 for whole sheets, as sums of the eras'."""
    return stats.total_stats(stats.availability_stats(versions(spark, sf_dir), ["sheet_id", "era_idx"]), ["sheet_id"])


_CARD = f"count(*) FILTER (len({HOST}) > 0 AND og_filename IS NULL) AS available, count(*) FILTER (available_length = 'Snippet') AS snippets, count(*) FILTER (available_length = 'Confirmed') AS confirmed"


@query(V + f"SELECT sheet_id, {_CARD} FROM v GROUP BY sheet_id")
def recents_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-04: the counts of a card, where a version may count twice."""
    return stats.recents_card_stats(versions(spark, sf_dir), ["sheet_id"])


@query(V + "SELECT sheet_id, era_idx, badge, count(*) AS n FROM v WHERE badge IS NOT NULL GROUP BY ALL")
def era_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-08."""
    return stats.badge_counts(versions(spark, sf_dir), ["sheet_id", "era_idx"])


@query("SELECT p_partkey, p_size::BIGINT AS og_files, p_partkey % 50 AS full_, p_partkey % 3 AS partial, 4::BIGINT AS snippets, p_size + p_partkey % 50 + p_partkey % 3 + 4 AS declared_total FROM part")
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-05: labels glued to counts, repeated ones, '(s)', emoji."""
    s = lambda c: c.cast("string")
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("🔗 99 Full\n"), s(F.col("p_size")), F.lit(" OG File(s)"), s(F.col("p_partkey") % 50), F.lit(" Full\n"), s(F.col("p_partkey") % 3), F.lit(" Partial\n4 Snippet(s)"))
    return stats.declared_stats(p.select("p_partkey", text.alias("stats_raw"))).select("p_partkey", F.col("og_files").cast("long").alias("og_files"), F.col("full").alias("full_"), "partial", "snippets", "declared_total")


@query(V + ", e AS (SELECT 'sheet-' || s_suppkey AS sheet_id, s_suppkey AS era_idx, 550 + s_suppkey % 9 AS declared FROM supplier) SELECT e.sheet_id, e.era_idx, declared, count(v.row_idx) AS parsed, count(v.row_idx) - declared AS diff FROM e LEFT JOIN v USING (sheet_id, era_idx) GROUP BY e.sheet_id, e.era_idx, declared")
def stats_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13."""
    e = eras(spark, sf_dir).withColumn("declared_total", F.lit(550) + F.col("era_idx") % 9)
    return stats.reconcile_stats(e, versions(spark, sf_dir))


@query("SELECT conv_id, count(*) AS n_rows, count(*) FILTER (role = 'user') AS n_named, count(*) FILTER (role <> 'user') AS n_nameless FROM conversations WHERE text <> '' GROUP BY conv_id")
def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13."""
    c = table(spark, sf_dir, "conversations").withColumn("named", F.when(F.col("role") == "user", F.col("role")))
    return stats.era_row_profile(c, ["conv_id"], "named", F.col("text") != "")


# ---------------------------------------------------------------- search

_SCORE = "CASE WHEN base_name = 'red widget' THEN 100 WHEN list_contains(list_transform(alt_titles, lambda a: lower(a)), 'red widget') THEN 90 WHEN starts_with(base_name, 'red widget') THEN 70 WHEN contains(base_name, 'red widget') THEN 40 END"


@query(V + f"SELECT sheet_id, row_idx, {_SCORE} AS score FROM v WHERE {_SCORE} IS NOT NULL AND available_length <> 'Snippet'")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-01, FLT-10/11."""
    return search.search(versions(spark, sf_dir), " Red Widget", hide_snippets=True).select("sheet_id", "row_idx", "score")


VM = V.replace("WITH v AS (", "WITH v AS MATERIALIZED (")


@query(VM + ", k AS MATERIALIZED (SELECT DISTINCT sheet_id, era_idx, base_name FROM v WHERE list_contains(alt_titles, 'ECONOMY')) SELECT v.sheet_id, v.row_idx, 90 AS score FROM v JOIN k ON v.sheet_id = k.sheet_id AND v.era_idx = k.era_idx AND v.base_name = k.base_name")
def search_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-01 on other titles."""
    return search.search(versions(spark, sf_dir), "economy").select("sheet_id", "row_idx", "score")


@query(VM + ", k AS MATERIALIZED (SELECT DISTINCT sheet_id, era_idx, base_name FROM v WHERE list_contains(alt_titles, 'ECONOMY')) SELECT v.sheet_id, v.row_idx, 60 AS score FROM v JOIN k ON v.sheet_id = k.sheet_id AND v.era_idx = k.era_idx AND v.base_name = k.base_name")
def search_alternate_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-01: other titles that begin with the query."""
    return search.search(versions(spark, sf_dir), "Econ").select("sheet_id", "row_idx", "score")


@query(VM + ", k AS MATERIALIZED (SELECT DISTINCT sheet_id, era_idx, base_name FROM v WHERE contains(name, 'take 3')) SELECT v.sheet_id, v.row_idx, 20 AS score FROM v JOIN k ON v.sheet_id = k.sheet_id AND v.era_idx = k.era_idx AND v.base_name = k.base_name")
def search_within_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-01: a version's name that holds the query."""
    return search.search(versions(spark, sf_dir), "take 3").select("sheet_id", "row_idx", "score")


@query(V + "SELECT sheet_id, row_idx, CASE WHEN starts_with(base_name, 'wid') THEN 100 WHEN regexp_matches(base_name, '\\bwid') THEN 60 ELSE 30 END AS score FROM v WHERE contains(base_name, 'wid')")
def search_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-02."""
    return search.search(versions(spark, sf_dir), "wid", scoring="spec").select("sheet_id", "row_idx", "score")


@query(V + "SELECT sheet_id, row_idx, CASE WHEN l_tax <= 0.06 THEN l_shipdate::DATE ELSE make_date(year(l_shipdate), 1, 1) END::VARCHAR AS sort_date FROM v")
def recent_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-03, EN-16."""
    return search.recents(versions(spark, sf_dir)).select("sheet_id", "row_idx", F.col("sort_date").cast("string").alias("sort_date"))


@query(V + "SELECT sheet_id, row_idx FROM v WHERE (CASE WHEN l_tax <= 0.06 THEN l_shipdate::DATE ELSE make_date(year(l_shipdate), 1, 1) END) BETWEEN DATE '1999-02-01' - 29 AND DATE '1999-02-01'")
def recent_30_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-04."""
    return search.recents(versions(spark, sf_dir), days=30, as_of="1999-02-01").select("sheet_id", "row_idx")


#: Searches of one index: the query that each repeats, its words and its options.
SEARCHES = (
    ("search_ranked", " Red Widget", {"hide_snippets": True}), ("search_alternates", "economy", {}), ("search_alternate_beginnings", "Econ", {}),
    ("search_within_names", "take 3", {}), ("search_spec", "wid", {"scoring": "spec"}),
)


@query(" UNION ALL ".join(f"SELECT '{name}' AS search, * FROM ({SQL[name]})" for name, _, _ in SEARCHES))
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-01/02 over a written index: searches read the postings of their letters and the parts that they name.

    The index holds the columns that searches read and the row's number.
    """
    v = versions(spark, sf_dir).select("sheet_id", "era_idx", "row_idx", "base_name", "name", "alt_titles", "producers", "badge", "available_length", "quality")
    index = build_index(v, new_folder(spark, "search-index"), parts=16)
    return index.search(SEARCHES).select("search", "sheet_id", "row_idx", "score")


@query(V + "SELECT sheet_id, row_idx FROM v ORDER BY CASE WHEN l_tax <= 0.06 THEN l_shipdate::DATE ELSE make_date(year(l_shipdate), 1, 1) END DESC, sheet_id, era_idx, row_idx LIMIT 60 OFFSET 1200")
def recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-03/06: a page far down, read from the ranges of a written order, which holds the rows' keys and dates."""
    rows = search.dated_versions(versions(spark, sf_dir)).select("sheet_id", "era_idx", "row_idx", "sort_date")
    written = write_ordered(rows, search.recents_order(), new_folder(spark, "recents"))
    return written.page(20).select("sheet_id", "row_idx")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, lower(c_name), c_name LIMIT 60 OFFSET 60")
def discovery_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR-05/06: the second page."""
    feed = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("best"))
    return search.page(search.discovery_order(feed), 1).select("c_custkey", F.col("name").alias("c_name"))


_FIRST_BADGE = f"(SELECT {SONGS} FROM v GROUP BY {SONGS} HAVING arg_min(badge, row_idx) FILTER (badge IS NOT NULL) IN ('best', 'special'))"


@query(V + f"SELECT sheet_id, row_idx FROM v WHERE badge IN ('best', 'special') AND ({SONGS}) IN {_FIRST_BADGE}")
def best_of_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: the song's first badge decides."""
    return search.best_of(versions(spark, sf_dir)).select("sheet_id", "row_idx")


@query(V + "SELECT sheet_id, row_idx FROM v WHERE badge IN ('best', 'special') AND available_length NOT IN ('Snippet', 'Unavailable') AND quality <> 'Not Available'")
def best_whole_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09/10, the other dialect."""
    return search.no_snippets(search.best_of(versions(spark, sf_dir), "ios"), "ios").select("sheet_id", "row_idx")


@query(
    V + "SELECT s.s_suppkey AS era_idx FROM supplier s WHERE s_suppkey IN (SELECT era_idx FROM v) AND (contains(lower(s_name), '00000001') OR contains('alt ' || substr(s_name, 16, 3), '00000001') "
    "OR s_suppkey IN (SELECT era_idx FROM v WHERE contains(base_name, '00000001')))"
)
def era_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12."""
    return search.filter_eras(eras(spark, sf_dir), versions(spark, sf_dir), "00000001").select("era_idx")


_BRAND = "k AS MATERIALIZED (SELECT DISTINCT sheet_id, era_idx, base_name FROM v WHERE available_length <> 'Snippet' AND (contains(base_name, 'brand#2') OR contains(lower(name), 'brand#2') OR contains(lower(array_to_string(alt_titles, ' ')), 'brand#2')))"


@query(VM + f", {_BRAND} SELECT v.sheet_id, v.row_idx FROM v LEFT JOIN k ON v.sheet_id = k.sheet_id AND v.era_idx = k.era_idx AND v.base_name = k.base_name WHERE available_length <> 'Snippet' AND (contains(lower(era_name), 'brand#2') OR k.sheet_id IS NOT NULL)")
def song_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13."""
    return search.filter_songs(versions(spark, sf_dir), eras(spark, sf_dir), "brand#2", hide_snippets=True).select("sheet_id", "row_idx")


@query(
    VM + f", {_BRAND}, f AS (SELECT {SONGS}, arg_min(section_idx, row_idx) AS section_idx FROM v GROUP BY {SONGS}), a AS (SELECT DISTINCT sheet_id, era_idx, section_idx FROM v) "
    "SELECT a.sheet_id, a.era_idx, a.section_idx, count(*) AS n_left FROM a JOIN f USING (sheet_id, era_idx, section_idx) JOIN k USING (sheet_id, era_idx, base_name) GROUP BY ALL"
)
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13 by sections: those without songs left are dropped."""
    v = versions(spark, sf_dir)
    listed = v.select("sheet_id", "era_idx", "section_idx").distinct()
    return search.filter_sections(listed, v, eras(spark, sf_dir), "brand#2", hide_snippets=True)


_WHOLE = "available_length NOT IN ('Snippet', 'Unavailable') AND quality <> 'Not Available'"


@query(
    VM + f", k AS (SELECT DISTINCT {SONGS} FROM v WHERE {_WHOLE}), f AS (SELECT {SONGS}, arg_min(section_idx, row_idx) AS section_idx FROM v GROUP BY {SONGS}), a AS (SELECT DISTINCT sheet_id, era_idx, section_idx FROM v) "
    "SELECT a.sheet_id, a.era_idx, a.section_idx, count(*) AS n_left FROM a JOIN f USING (sheet_id, era_idx, section_idx) JOIN k USING (sheet_id, era_idx, base_name) GROUP BY ALL"
)
def section_filter_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, the other dialect: hiding snippets alone drops sections without songs left."""
    v = versions(spark, sf_dir)
    listed = v.select("sheet_id", "era_idx", "section_idx").distinct()
    return search.filter_sections(listed, v, eras(spark, sf_dir), hide_snippets=True, dialect="ios")


@query(V + "SELECT sheet_id, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, era_idx ORDER BY row_idx) AS rn FROM v WHERE badge IS NOT NULL AND contains(name, 'bolt') AND contains(era_name, '0000')) WHERE rn <= 3")
def song_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, SR-07."""
    return search.inspect_songs(versions(spark, sf_dir), era_like="r#0000", name_like="Bolt", badges_only=True, per_era=3).select("sheet_id", "row_idx")


# ---------------------------------------------------------------- resolution


@query("SELECT 'sheet-' || s_suppkey AS sheet_id, regexp_replace(lower(s_name), '[,.:;!?]+', ' ', 'g') AS key, s_suppkey AS era_idx FROM supplier UNION ALL SELECT 'sheet-' || s_suppkey, 'alt ' || substr(s_name, 16, 3), min(s_suppkey) FROM supplier GROUP BY 1, 2")
def era_key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01."""
    return resolve.era_keys(eras(spark, sf_dir)).select("sheet_id", "key", "era_idx")


@query("SELECT s_suppkey AS row_id, s_suppkey AS era_idx FROM supplier")
def era_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02, EN-10: era texts with a version tag, parentheses and accents."""
    e = eras(spark, sf_dir)
    rows = e.select("sheet_id", F.col("era_idx").alias("row_id"), F.concat(F.translate("name", "u", "ü"), F.lit(" [V2](as told)")).alias("era"))
    return resolve.resolve_exact(rows, resolve.era_keys(e), "era").select("row_id", "era_idx")


_WORDS = r"SELECT DISTINCT {id}, unnest(list_filter(string_split_regex(key, '\s+'), lambda w: length(w) > 2)) AS w FROM {t}"


@query(
    "WITH l AS (SELECT min(p_partkey) AS id, p_name || ' ' || lower(p_type) AS key FROM part GROUP BY 2), r AS (SELECT min(p_partkey) AS other, p_name || ' ' || lower(p_brand) AS key FROM part GROUP BY 2), "
    f"lw AS ({_WORDS.format(id='id', t='l')}), rw AS ({_WORDS.format(id='other', t='r')}), ln AS (SELECT id, count(*) AS n FROM lw GROUP BY 1), rn AS (SELECT other, count(*) AS n FROM rw GROUP BY 1), "
    "p AS (SELECT id, other, count(*) AS shared FROM lw JOIN rw USING (w) GROUP BY 1, 2), s AS (SELECT id, other, shared, shared / least(ln.n, rn.n) AS score FROM p JOIN ln USING (id) JOIN rn USING (other)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS k FROM s WHERE shared >= 2 AND score >= 0.5) SELECT id, other, shared, round(score, 6) AS score FROM b WHERE k = 1"
)
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03 between two spellings of titles, each distinct one once."""
    p = table(spark, sf_dir, "part")
    spelt = lambda col, name: p.select("p_partkey", F.concat_ws(" ", "p_name", F.lower(col)).alias("key")).groupBy("key").agg(F.min("p_partkey").alias(name))
    return resolve.fuzzy_match(spelt("p_type", "id"), spelt("p_brand", "other"), "id", "other").withColumn("score", F.round("score", 6))


@query("WITH q AS MATERIALIZED (SELECT p_partkey, substr(p_name, 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1) || lower(substr(p_type, 1, 1)) AS a FROM part), m AS (SELECT a, min(p_partkey) AS other FROM q GROUP BY a) SELECT p_partkey, other FROM q JOIN m USING (a)")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04."""
    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", F.lower("p_type")))
    short = p.select("p_partkey", resolve.T.acronym(F.col("key")).alias("key"))
    return resolve.acronym_match(short, p.select(F.col("p_partkey").alias("other"), "key"), "p_partkey", "other")


@query(
    "WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), idle AS (SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM u)) "
    "SELECT idle.k, count(u.k) AS n_near FROM idle LEFT JOIN u ON u.k // 10 = idle.k // 10 AND (contains('c' || u.k || 'c', 'c' || idle.k || 'c') OR contains('c' || idle.k || 'c', 'c' || u.k || 'c')) GROUP BY idle.k"
)
def unused_era_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12: idle keys, and the used ones of their sheet that are close to them."""
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"), F.lit("c")).alias("key")
    sheet = lambda c: F.floor(F.col(c) / 10).cast("string").alias("sheet_id")
    keys = table(spark, sf_dir, "customer").select(sheet("c_custkey"), key("c_custkey"))
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(sheet("o_custkey"), key("o_custkey")).distinct()
    return resolve.unused_keys(keys, used).select(F.regexp_extract("key", "[0-9]+", 0).cast("long").alias("k"), F.size("near_misses").cast("long").alias("n_near"))


@query(
    """WITH e AS (SELECT s_suppkey // 20 AS book, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS n, lead(s_suppkey) OVER w AS nx, lead(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END) OVER w AS nn FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey)),
m AS (SELECT book, s_suppkey, nx FROM e WHERE n = 0 AND nn > 0)
SELECT 'book-' || e.book AS sheet_id, e.s_suppkey AS era_idx, CASE WHEN m.s_suppkey IS NULL THEN 'Rodeo ' || e.s_suppkey WHEN length('Rodeo ' || m.s_suppkey || ' The Whole') > length('Rodeo ' || e.s_suppkey) THEN 'Rodeo ' || m.s_suppkey || ' The Whole' END AS name,
CASE WHEN m.s_suppkey IS NULL THEN NULL ELSE 'about ' || m.s_suppkey END AS description, 'a' || e.s_suppkey || CASE WHEN m.s_suppkey IS NULL THEN '' ELSE '|a' || m.s_suppkey END AS alts
FROM e LEFT JOIN m ON m.book = e.book AND m.nx = e.s_suppkey WHERE (e.book, e.s_suppkey) NOT IN (SELECT book, s_suppkey FROM m)""".replace("CASE WHEN m.s_suppkey IS NULL THEN 'Rodeo ' || e.s_suppkey", "CASE WHEN m.s_suppkey IS NULL THEN 'Rodeo ' || e.s_suppkey || CASE WHEN e.s_suppkey % 5 = 0 THEN ' The Whole' ELSE '' END").replace("CASE WHEN m.s_suppkey IS NULL THEN NULL", "CASE WHEN m.s_suppkey IS NULL THEN CASE WHEN e.s_suppkey % 5 = 0 THEN 'about ' || e.s_suppkey END")
)
def stub_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14: empty eras go into the next one of the same first word; other names are joined (ST-03)."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    stub = k % 5 == 0
    e = s.select(
        F.concat(F.lit("book-"), F.floor(k / 20).cast("string")).alias("sheet_id"), k.alias("era_idx"), F.concat(F.lit("Rodeo "), k.cast("string"), F.when(stub, " The Whole").otherwise("")).alias("name"),
        F.array(F.concat(F.lit("a"), k.cast("string"))).alias("alt_names"), F.when(stub, F.concat(F.lit("about "), k.cast("string"))).alias("description"),
        F.lit(None).cast("string").alias("art_url"), F.lit(None).cast("string").alias("stats_raw"), F.array().cast("array<struct<date:string,event:string>>").alias("timeline"), F.when(stub, 0).otherwise(1).alias("n_songs"),
    )
    return resolve.merge_stub_eras(e).select("sheet_id", "era_idx", "name", "description", F.array_join("alt_names", "|").alias("alts"))


_SIGN = "SELECT vec_id, CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END::BIGINT AS h FROM (SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0 END for i in range(1, 65)])::HUGEINT AS b FROM embeddings)"


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of a vector's 64 components as the bits of a number."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(F.col("embedding"), i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("hash"))


@query(f"WITH s AS ({_SIGN}) SELECT a.vec_id AS one, b.vec_id AS two, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM s a JOIN s b ON a.vec_id // 8 = b.vec_id // 8 AND bit_count(xor(a.h, b.h)) <= 28")
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: sign hashes of vectors of one key, as of the few pictures of one era."""
    s = _signs(spark, sf_dir).withColumn("k", F.floor(F.col("vec_id") / 8))
    pairs = near_hash(s.select("k", F.col("vec_id").alias("one"), "hash"), s.select("k", F.col("vec_id").alias("two"), F.col("hash").alias("other_hash")), "k", 28)
    return pairs.select("one", "two", F.col("distance").cast("long").alias("distance"))


@query(f"WITH s AS MATERIALIZED ({_SIGN}) SELECT a.vec_id AS one, b.vec_id AS two, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM s a, s b WHERE bit_count(xor(a.h, b.h)) <= 10")
def hash_distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15 without a key, by bands: all pairs of rows."""
    s = _signs(spark, sf_dir)
    return near_hash_rows(s.select(F.col("vec_id").alias("one"), "hash"), s.select(F.col("vec_id").alias("two"), "hash"), "one", "two", 10).select("one", "two", F.col("distance").cast("long").alias("distance"))


# ---------------------------------------------------------------- quality sweep

_SHEETS = """s AS (SELECT c_custkey // 60 AS sheet_id, count(*) FILTER (c_acctbal > 5000) AS n_eras, count(*) FILTER (c_acctbal > 9000) AS n_songs, list(c_name ORDER BY c_custkey) FILTER (c_custkey % 40 = 0) AS zero_eras,
list(CASE WHEN c_custkey % 180 = 0 THEN 'Changelog' ELSE c_mktsegment END ORDER BY c_custkey) FILTER (c_custkey % 20 = 0) AS era_names, list('Part ' || c_custkey ORDER BY c_custkey) FILTER (c_custkey % 90 = 7) AS section_names,
list('Row ' || c_custkey || CASE WHEN c_custkey % 100 = 9 THEN ': Guest Verses' ELSE ': stray' END ORDER BY c_custkey) FILTER (c_acctbal < 600 OR (c_custkey // 60) % 5 = 0) AS unmatched,
count(*) AS total_rows, count(*) FILTER (c_acctbal > 0) AS song_rows, count(*) FILTER (c_acctbal < 600) AS skipped_rows,
count(*) FILTER (c_acctbal > 7800) AS fuzzy_rows, count(*) FILTER (c_custkey % 2 = 0) AS declared, count(*) FILTER (c_custkey % 60 < 23 + (c_custkey // 60) % 3) AS parsed FROM customer GROUP BY c_custkey // 60)"""
_ISSUES = (
    _SHEETS
    + """, d AS (SELECT sheet_id, (SELECT count(*) FROM (SELECT unnest(coalesce(era_names, []::VARCHAR[])) AS x) GROUP BY lower(x) HAVING count(*) > 1 LIMIT 1) IS NOT NULL AS dup FROM s),
i AS (SELECT sheet_id, unnest(list_filter([
  CASE WHEN n_eras = 0 THEN 'NO_ERAS:CRITICAL' END, CASE WHEN n_songs = 0 THEN 'NO_SONGS:CRITICAL' END,
  CASE WHEN skipped_rows / total_rows > 0.15 THEN 'HIGH_SKIP:WARNING' WHEN skipped_rows / total_rows > 0.05 THEN 'ELEVATED_SKIP:INFO' END,
  CASE WHEN len(zero_eras) BETWEEN 1 AND 2 THEN 'ZERO_SONG_ERAS:WARNING' WHEN len(zero_eras) > 2 THEN 'ZERO_SONG_ERAS:CRITICAL' END,
  CASE WHEN n_eras >= 3 AND n_songs / n_eras < 3 THEN 'LOW_SONG_RATIO:WARNING' END, CASE WHEN n_eras > 40 THEN 'MANY_ERAS:INFO' END,
  CASE WHEN song_rows > 0 AND fuzzy_rows / song_rows > 0.2 THEN 'HIGH_FUZZY:WARNING' END, CASE WHEN dup THEN 'DUPLICATE_ERAS:WARNING' END,
  CASE WHEN declared > 0 AND parsed > 0 AND abs(parsed - declared) / parsed > 0.25 THEN 'STATS_MISMATCH:WARNING' END, CASE WHEN list_contains(era_names, 'Changelog') THEN 'BOGUS_ERAS:WARNING' END, CASE WHEN len(list_filter(unmatched, lambda t: contains(t, 'Guest'))) > 0 THEN 'LOST_SECTIONS:INFO' END, CASE WHEN len(section_names) > 0 THEN 'SECTIONS_FOUND:INFO' END], lambda x: x IS NOT NULL)) AS issue FROM s JOIN d USING (sheet_id))"""
)


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty customers as a sheet."""
    c, k, b = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    names = lambda text, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("c_custkey", text.alias("n"))))), lambda s: s["n"])
    book = F.floor(k / 60)
    return c.groupBy(book.alias("sheet_id")).agg(
        F.count_if(b > 5000).alias("n_eras"), F.count_if(b > 9000).alias("n_songs"), names(F.col("c_name"), k % 40 == 0).alias("zero_eras"),
        names(F.when(k % 180 == 0, "Changelog").otherwise(F.col("c_mktsegment")), k % 20 == 0).alias("era_names"), names(F.concat(F.lit("Part "), k.cast("string")), k % 90 == 7).alias("section_names"),
        F.count("*").alias("total_rows"), F.count_if(b > 0).alias("song_rows"), F.count_if(b < 600).alias("skipped_rows"), F.count_if(b > 7800).alias("fuzzy_rows"),
        names(F.concat(F.lit("Row "), k.cast("string"), F.when(k % 100 == 9, ": Guest Verses").otherwise(": stray")), (b < 600) | (book % 5 == 0)).alias("unmatched"),
        F.count_if(k % 2 == 0).alias("declared"), F.count_if(k % 60 < 23 + book % 3).alias("parsed"),
    )


@query(f"WITH {_ISSUES} SELECT sheet_id::BIGINT AS sheet_id, split_part(issue, ':', 1) AS \"check\", split_part(issue, ':', 2) AS severity FROM i")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-01..12."""
    return dq.run_checks(_sheets(spark, sf_dir)).select(F.col("sheet_id").cast("long").alias("sheet_id"), "check", "severity")


@query(f"WITH {_ISSUES} SELECT s.sheet_id::BIGINT AS sheet_id, CASE WHEN bool_or(issue LIKE '%CRITICAL') THEN 'critical' WHEN bool_or(issue LIKE '%WARNING') THEN 'warning' ELSE 'ok' END AS status FROM s LEFT JOIN i USING (sheet_id) GROUP BY s.sheet_id")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-13."""
    s = _sheets(spark, sf_dir)
    return dq.roll_up(s, dq.run_checks(s)).withColumn("sheet_id", F.col("sheet_id").cast("long"))


@query(f"WITH {_ISSUES} SELECT split_part(issue, ':', 1) AS \"check\", split_part(issue, ':', 2) AS severity, count(*) AS n, count(DISTINCT sheet_id) AS n_sheets FROM i WHERE issue NOT LIKE '%INFO' GROUP BY 1, 2")
def quality_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-09."""
    return dq.issue_frequency(dq.run_checks(_sheets(spark, sf_dir)))


_STATUS = """CASE WHEN sheet_id % 11 = 3 THEN CASE WHEN sheet_id % 2 = 0 THEN 'skip' ELSE 'error' END WHEN sheet_id % 11 = 5 THEN 'skip' WHEN sheet_id % 11 = 7 THEN CASE WHEN sheet_id % 2 = 0 THEN 'skip' ELSE 'fail' END WHEN sheet_id % 11 = 9 THEN 'error'
WHEN n_eras = 0 OR n_songs = 0 OR skipped_rows / total_rows > 0.2 THEN 'fail' WHEN skipped_rows / total_rows > 0.05 OR len(zero_eras) > 3 OR (n_eras > 2 AND n_songs / n_eras < 1) THEN 'warn' ELSE 'ok' END"""


@query(f"WITH {_SHEETS}, t AS (SELECT *, {_STATUS} AS status FROM s) SELECT status, count(*) AS n_sheets, sum(n_eras)::BIGINT AS n_eras, sum(n_songs)::BIGINT AS n_songs, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM t GROUP BY status")
def quality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-14, AG-10: sheets that were read and sheets that were not, some of them abandoned."""
    k = F.col("sheet_id")
    error = F.when(k % 11 == 3, "network").when(k % 11 == 5, "access_denied").when(k % 11 == 7, "no_tables").when(k % 11 == 9, "odd")
    s = _sheets(spark, sf_dir).withColumns({"error": error, "links_work": k % 2, "updated": F.lit(0)})
    return dq.corpus_totals(s.join(dq.status_by_rules(s), "sheet_id"))


@query(f"WITH {_SHEETS} SELECT sheet_id::BIGINT AS sheet_id, CASE WHEN n_eras = 0 THEN 'FAIL_NO_ERAS' WHEN n_songs = 0 THEN 'FAIL_NO_SONGS' WHEN least(coalesce(len(unmatched), 0), 50) > 0.3 * song_rows THEN 'WARN_MANY_UNMATCHED' ELSE 'OK' END AS verdict FROM s")
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-15."""
    return dq.verdict_of(_sheets(spark, sf_dir)).withColumn("sheet_id", F.col("sheet_id").cast("long"))


@query("SELECT 'sheet-' || s_suppkey AS sheet_id, count(*) AS n_eras, count(*) FILTER (s_acctbal > 3000) AS n_art, round(avg((s_acctbal > 3000)::INT), 4) AS coverage FROM supplier GROUP BY ALL")
def quality_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-16."""
    return dq.art_coverage(eras(spark, sf_dir).withColumn("art_url", F.when(F.col("s_acctbal") > 3000, F.col("name"))))


_EMPTY = {"navigation": "Skip to {}", "discord": "{} Discord", "updates": "Added {}", "meta_label": "Mega Folder", "guidelines": "{} guidelines", "announcements": "Please read {}", "empty": " ", "real_era": "{}"}


@query(
    "SELECT category, category <> 'real_era' AS fixable, count(*) AS n, count(DISTINCT c_custkey // 60) AS n_sheets FROM (SELECT c_custkey, ["
    + ", ".join(f"'{c}'" for c in _EMPTY)
    + "][c_custkey % 8 + 1] AS category FROM customer) GROUP BY ALL"
)
def quality_empty_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11: every reason why an era has no songs."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    names = F.array(*[F.concat(*[x for part in form.split("{}") for x in (F.lit(part), F.col("c_name"))][:-1]) for form in _EMPTY.values()])
    return dq.categorize_empty(c.select(F.floor(k / 60).alias("sheet_id"), F.get(names, (k % 8).cast("int")).alias("name"), F.lit(0).alias("n_songs")))


@query(f"WITH {_ISSUES}, t AS (SELECT *, {_STATUS} AS status FROM s) SELECT t.sheet_id::VARCHAR AS sheet_id, status, n_eras, count(i.issue) AS n_issues FROM t LEFT JOIN i USING (sheet_id) WHERE status IN ('ok', 'warn') GROUP BY ALL")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09/10: a report written as records and read back; only passed sheets count."""
    k, path = F.col("sheet_id"), new_folder(spark, "report")
    error = F.when(k % 11 == 3, "network").when(k % 11 == 5, "access_denied").when(k % 11 == 7, "no_tables").when(k % 11 == 9, "odd")
    s = _sheets(spark, sf_dir).withColumns({"error": error, "links_work": k % 2, "updated": F.lit(0)})
    results = s.join(dq.status_by_rules(s), "sheet_id").select("sheet_id", F.lit("n").alias("name"), "status", "n_eras", "n_songs")
    write_report(dq.report_rows(results, dq.run_checks(s)), path)
    return read_report(spark, path).select("sheet_id", "status", "n_eras", F.greatest(F.coalesce(F.size("issues"), F.lit(0)), F.lit(0)).cast("long").alias("n_issues"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def pending_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, SRC-10's rule: what has not passed."""
    o = table(spark, sf_dir, "orders")
    report = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "warn").otherwise("fail").alias("status"))
    return dq.pending(table(spark, sf_dir, "customer"), report, "c_custkey").select("c_custkey")


# ---------------------------------------------------------------- favourites and views

_FAV = "SELECT ts, user_id, CASE event_type WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'remove' ELSE 'toggle' END AS action, 'a' || (event_id % 2) AS artist_slug, 'e' || (event_id % 3) AS era_name, 'song' AS base_name FROM events"
_FAV_STATE = f"""f AS ({_FAV}), c AS (SELECT user_id, max(ts) AS t FROM f WHERE action = 'clear' GROUP BY 1),
r AS (SELECT user_id, artist_slug, era_name, base_name, max(ts) AS t FROM f WHERE action = 'remove' GROUP BY ALL),
st AS (SELECT f.user_id, f.artist_slug, f.era_name, f.base_name, max(f.ts) AS added_at FROM f LEFT JOIN c ON c.user_id = f.user_id LEFT JOIN r ON r.user_id = f.user_id AND r.artist_slug = f.artist_slug AND r.era_name = f.era_name AND r.base_name = f.base_name
WHERE action = 'toggle' AND (c.t IS NULL OR f.ts > c.t) AND (r.t IS NULL OR f.ts > r.t) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def favourite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "signup", "remove").otherwise("toggle")
    return e.select("ts", "user_id", action.alias("action"), F.concat(F.lit("a"), (i % 2).cast("string")).alias("artist_slug"), F.concat(F.lit("e"), (i % 3).cast("string")).alias("era_name"), F.lit("song").alias("base_name"))


@query(f"WITH {_FAV_STATE} SELECT user_id, artist_slug, era_name, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at FROM st")
def favourites_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04, batch form."""
    return fav.favourites_state(favourite_events(spark, sf_dir)).select("user_id", "artist_slug", "era_name", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added_at"))


@query(
    f"WITH {_FAV_STATE} SELECT user_id, artist_slug, count(*) AS n, strftime(max(added_at), '%Y-%m-%d %H:%M:%S') AS latest, arg_max(era_name, added_at) AS newest_era, 'Name of ' || artist_slug AS artist_name, "
    "'https://x/' || arg_max(era_name, added_at) AS source_url, 'art-' || arg_max(era_name, added_at) AS newest_art FROM st GROUP BY ALL"
)
def favourites_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-12: with the artist's name and source, and the eras' art, of the newest entry."""
    held = fav.favourites_state(favourite_events(spark, sf_dir))
    told = held.withColumns({"artist_name": F.concat(F.lit("Name of "), "artist_slug"), "source_url": F.concat(F.lit("https://x/"), "era_name"), "era_art": F.concat(F.lit("art-"), "era_name")})
    n = fav.favourites_by_artist(told)
    return n.select("user_id", "artist_slug", "n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.col("eras")[0]["era_name"].alias("newest_era"), "artist_name", "source_url", F.col("eras")[0]["era_art"].alias("newest_art"))


@query(V + ", k AS (SELECT DISTINCT 'sheet-' || (o_custkey % 50) AS sheet_id, 'Supplier#' || lpad((o_custkey % 50)::VARCHAR, 9, '0') AS era_name FROM orders) SELECT v.sheet_id, v.row_idx, k.sheet_id IS NOT NULL AND base_name LIKE 'red%' AS is_favourite FROM v LEFT JOIN k ON k.sheet_id = v.sheet_id AND k.era_name = v.era_name")
def favourite_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09: base names with a tag find their favourites."""
    v = versions(spark, sf_dir)
    names = v.select("base_name").distinct().filter("base_name like 'red%'")
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.concat(F.lit("sheet-"), (F.col("o_custkey") % 50).cast("string")).alias("artist_slug"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 50).cast("string"), 9, "0")).alias("era_name")).distinct()
    tagged = v.withColumns({"artist_slug": F.col("sheet_id"), "base_name": F.concat("base_name", F.lit(" [V2]"))})
    liked = keys.join(v.select(F.col("sheet_id").alias("artist_slug"), "era_name", "base_name").distinct(), ["artist_slug", "era_name"]).join(names, "base_name", "left_semi")
    return fav.favourites_join(tagged, liked).select("sheet_id", "row_idx", "is_favourite")


@query("SELECT user_id, count(*) AS n_views, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_view FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 20")
def recent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-08."""
    return fav.recent_views(table(spark, sf_dir, "events"), "user_id").select("user_id", "n_views", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_view"))


@query(
    VM + f", c AS (SELECT sheet_id, {_CARD}, count(DISTINCT (era_idx, base_name)) AS n_songs FROM v GROUP BY sheet_id), w AS (SELECT 'sheet-' || (user_id % 100) AS sheet_id, max(ts) AS ts, count(*) AS n_views FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), "
    "a AS (SELECT 'sheet-' || s_suppkey AS sheet_id, s_name AS artist_name, CASE WHEN s_acctbal > 3000 THEN 'art of ' || s_name END AS art_url FROM supplier) "
    "SELECT w.sheet_id, n_views, artist_name, art_url, c.n_songs, available, snippets, confirmed FROM w LEFT JOIN a USING (sheet_id) LEFT JOIN c USING (sheet_id)"
)
def recent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-08: the cards of the sheets viewed last, with their covers."""
    v = versions(spark, sf_dir)
    views = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("sheet-"), (F.col("user_id") % 100).cast("string")).alias("sheet_id"))
    e = eras(spark, sf_dir)
    named = e.select("sheet_id", F.col("name").alias("artist_name"), F.col("name").alias("slug"), F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("art of "), "name")).alias("art_url"))
    artists = named.join(songs.catalog_counts(v, ["sheet_id"]).select("sheet_id", "n_songs"), "sheet_id", "left")
    return fav.recent_cards(views, artists, stats.recents_card_stats(v, ["sheet_id"])).select("sheet_id", "n_views", "artist_name", "art_url", "n_songs", "available", "snippets", "confirmed")


@query(V + f"SELECT sheet_id, row_idx, {HOST}[1] AS link FROM v")
def streamable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14's link rule."""
    return versions(spark, sf_dir).select("sheet_id", "row_idx", first_streamable(F.col("links")).alias("link"))
