"""Registered queries of the enrichment jobs, event logs, snapshots and ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import labels as L
from quillgrid.functions import text as T
from quillgrid.operators import media, quality, rows
from quillgrid.operators.columns import project_fields
from quillgrid.operators.resolve import apply_art, art_map
from quillgrid.operators.tabs import artist_name
from quillgrid.plans.fixtures import table
from quillgrid.scratch import new_folder
from quillgrid.sources.html import sheet_rows
from quillgrid.streaming import snapshots as snap

QUERIES, SQL = {}, {}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, spread over the tasks asked for: a million of them are one small file, but the texts made of them are work."""
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _s(col: str) -> Column:
    return F.col(col).cast("string")


# ---------------------------------------------------------------- names and notes


@query(
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'best' WHEN 1 THEN 'special' WHEN 2 THEN 'wanted' WHEN 3 THEN 'worst' END AS badge, p_name AS base, CASE p_partkey % 4 WHEN 0 THEN 'V' || p_size WHEN 1 THEN 'V1-V?' WHEN 2 THEN 'Radio Mix' END AS tag, "
    "p_brand AS featuring, p_type || ', ' || p_brand AS producers, CASE WHEN p_partkey % 2 = 0 THEN 'Friends' END AS collaboration, 'Old ' || p_name AS alts FROM part"
)
def name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-01/02/03 on raw multi-line names."""
    p = parts(spark, sf_dir)
    star = F.when(F.col("p_size") % 5 == 0, "⭐️ ").when(F.col("p_size") % 5 == 1, "💿✨").when(F.col("p_size") % 5 == 2, " 🥇 ").when(F.col("p_size") % 5 == 3, "🗑️").otherwise("")
    tag = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" [V"), _s("p_size"), F.lit("]"))).when(F.col("p_partkey") % 4 == 1, " [v1-V?]").when(F.col("p_partkey") % 4 == 2, " [Radio Mix]").otherwise("")
    raw = F.concat(star, F.col("p_name"), tag, F.lit("\n(feat. "), F.col("p_brand"), F.lit(") (Prod. "), F.col("p_type"), F.lit(") (prod "), F.col("p_brand"), F.lit(")"), F.when(F.col("p_partkey") % 2 == 0, " (with Friends)").otherwise(""), F.lit("\n(Old "), F.col("p_name"), F.lit(")\n"))
    named = p.select("p_partkey", T.badge(raw).alias("badge"), T.without_badge(raw).alias("n"))
    title = T.title(F.col("n"))
    tag_out = F.when(T.version_tag(title) == "v1-V?", "V1-V?").otherwise(T.version_tag(title))
    return named.select("p_partkey", "badge", T.without_tag(title).alias("base"), tag_out.alias("tag"), *[T.credit(F.col("n"), k).alias(k) for k in ("featuring", "producers", "collaboration")], F.array_join(T.alt_titles(F.col("n")), "|").alias("alts"))


@query("SELECT p_partkey, lower(p_name) || ' vol 2' AS match_key, lower(replace(p_name, ' ', '-')) || '-vol-2-' || lower(p_type) AS slug, upper(substr(p_name, 1, 1)) || upper(substr(string_split(p_name, ' ')[2], 1, 1)) AS short FROM part")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-10/11/23: accents, punctuation, tags and parentheses go."""
    messy = F.concat(F.translate("p_name", "eioa", "éïöà"), F.lit(", Vol. 2 [V3]*(live at "), F.col("p_type"), F.lit(")"))
    return parts(spark, sf_dir).select("p_partkey", T.match_key(messy).alias("match_key"), T.slug(F.concat("p_name", F.lit(", Vol. 2_"), F.col("p_type"), F.lit("!"))).alias("slug"), T.initials(F.col("p_name")).alias("short"))


@query("""SELECT p_partkey, p_name || '.wav' AS og, '"' || p_name || '" by ' || p_brand AS samples, p_brand || '|' || p_type AS producers, 'released' AS event, p_size::VARCHAR AS event_date, 'Plain ' || p_name AS kept FROM part""")
def note_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-05..08, PRJ-10's notes rule."""
    notes = F.concat(F.lit("Plain "), F.col("p_name"), F.lit("\nOG Filename (Metadata): "), F.col("p_name"), F.lit(".wav"))
    sampled = F.concat(F.lit('Here it samples "'), F.col("p_name"), F.lit('" by '), F.col("p_brand"), F.lit(" and others.\n"))
    producers = F.concat(F.lit("Highlighted Producers:\n- "), F.col("p_brand"), F.lit("\n- ???\n- "), F.col("p_type"))
    events = T.timeline(F.concat(F.lit("("), _s("p_size"), F.lit(") (released)\n(2001)\nno date")))
    return parts(spark, sf_dir).select(
        "p_partkey", T.og_filename(notes).alias("og"), F.array_join(T.samples(sampled), "|").alias("samples"), F.array_join(T.highlighted_producers(producers), "|").alias("producers"),
        F.get(events, F.lit(0))["event"].alias("event"), F.get(events, F.lit(0))["date"].alias("event_date"), T.credit_notes(notes).alias("kept"),
    )


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'lossless' WHEN 1 THEN 'cd' WHEN 2 THEN 'na' ELSE 'lq' END AS quality, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'snippet' WHEN 2 THEN 'partial' ELSE 'na' END AS availability, "
    "CASE WHEN p_size % 4 = 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'snippet' WHEN 2 THEN 'partial' END ELSE CASE p_size % 4 WHEN 0 THEN 'lossless' WHEN 1 THEN 'cd' ELSE 'lq' END END AS shown, "
    "CASE WHEN p_size % 4 <> 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'snippet' END END AS second FROM part"
)
def badge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-17/18."""
    q = F.when(F.col("p_size") % 4 == 0, "Lossless").when(F.col("p_size") % 4 == 1, "CD Quality").when(F.col("p_size") % 4 == 2, "Not Available").otherwise("Low Quality")
    a = F.when(F.col("p_partkey") % 4 == 0, "Full").when(F.col("p_partkey") % 4 == 1, "Snippet").when(F.col("p_partkey") % 4 == 2, "Partial / Cut")
    p = parts(spark, sf_dir).select("p_partkey", q.alias("q"), a.alias("a"))
    return p.select("p_partkey", L.quality_class(F.col("q")).alias("quality"), L.availability_class(F.col("a")).alias("availability"), L.effective_badge(F.col("q"), F.col("a"))["variant"].alias("shown"), L.secondary_badge(F.col("q"), F.col("a"))["variant"].alias("second"))


@query("SELECT o_orderkey, o_custkey AS seconds, (o_custkey // 60)::VARCHAR || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS shown, CASE o_orderkey % 4 WHEN 3 THEN make_date(year(o_orderdate), 1, 1) WHEN 2 THEN make_date(year(o_orderdate), month(o_orderdate), 1) ELSE o_orderdate::DATE END::VARCHAR AS day FROM orders")
def durations_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-15/16."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    text = F.concat(F.floor(c / 60).cast("string"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"))
    day = F.when(k % 4 == 0, F.date_format(d, "M/d/yyyy")).when(k % 4 == 1, F.date_format(d, "MMMM d, yyyy")).when(k % 4 == 2, F.date_format(d, "MMMM yyyy")).otherwise(F.concat(F.lit("around "), F.date_format(d, "yyyy"), F.lit(" (?)")))
    out = table(spark, sf_dir, "orders").select("o_orderkey", L.duration_seconds(text).alias("seconds"), L.parse_date(day).cast("string").alias("day"))
    return out.select("o_orderkey", "seconds", L.format_duration(F.col("seconds")).alias("shown"), "day")


@query(
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pillowcase' WHEN 1 THEN 'kraken' END AS provider, CASE p_size % 3 WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN 'k' || p_partkey END AS file_id, "
    "CASE WHEN p_size % 2 = 0 THEN 'https://lh3.googleusercontent.com/' || p_partkey || '=s0' END AS art FROM part"
)
def link_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-12/19, FLT-18: redirects unwrapped, providers told, art in full size."""
    k = _s("p_partkey")
    real = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("https://pillows.su/f/p"), k)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("https://krakenfiles.com/view/k"), k, F.lit("/file.html"))).otherwise(F.concat(F.lit("https://example.org/"), k))
    wrapped = F.concat(F.lit("https://www.google.com/url?q="), F.url_encode(real), F.lit("&sa=D"))
    art = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("//lh3.googleusercontent.com/"), k, F.lit("=w200-h200"))).otherwise(F.concat(F.lit("data:image/"), k))
    p = parts(spark, sf_dir).select("p_partkey", L.provider(L.unwrap_link(wrapped)).alias("p"), L.art_url(art).alias("art"))
    return p.select("p_partkey", "p.provider", "p.file_id", "art")


@query("SELECT c_custkey, c_name AS artist FROM customer")
def artist_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-13."""
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    title = F.when(k == 0, F.concat(n, F.lit(" Music Tracker - Google Drive"))).when(k == 1, F.concat(F.lit("Updated "), n, F.lit(" Tracker 2.0 - Google Sheets"))).when(k == 2, F.concat(F.lit("🔥 "), n, F.lit(" Tracker (reup 12.29.25) - Google Drive"))).otherwise(F.concat(n, F.lit(" Tracker [Currently in Use] - Google Drive")))
    return table(spark, sf_dir, "customer").select("c_custkey", artist_name(title).alias("artist"))


#: A text for each rule by which a name is refused (``~`` stands for a part's name), and some that are not.
REFUSED = (
    "a\nb\nc", "", " \n ", "ask @me now", "see x.com", "~ at files.gg", "one two three four five six seven eight nine ten eleven", "~ " + "x" * 80, "~:", "Changelog", "what's new?", "collaboration with ~",
    "~ tracker", "skip to ~", "click to view ~", "click here ~", "discord.gg/~", "discord.com/~", "http://~", "https://~", "~.gg/x", "~ playlist", "on spotify ~", "sent all ~", "onlyfiles ~",
    "Added ~", "removed ~", "Updated ~", "renamed ~", "started ~", "Finished ~", "12.10.2024 - ~", "1/2/24 ~", "2024-1-2 ~", "1/23 - ~", "123", "*~", "who (@me)", "~ x @you", "~!!", "12 Full", "3 Snippets and ~",
)
ACCEPTED = ("~", "~ (part two: more)", "~ @ home", "~!", "1234 ~", "~\nsecond line", "Barter 7", "The ~ Added", "~ links", "Ca$ino ~")


@query(f"SELECT p_partkey, p_partkey % {len(REFUSED) + len(ACCEPTED)} >= {len(REFUSED)} AS plausible FROM part")
def plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: every rule once in each round of parts."""
    forms = F.array(*[F.lit(t) for t in (*REFUSED, *ACCEPTED)])
    text = F.replace(F.get(forms, (F.col("p_partkey") % (len(REFUSED) + len(ACCEPTED))).cast("int")), F.lit("~"), F.col("p_name"))
    return parts(spark, sf_dir).select("p_partkey", T.plausible_era_name(text).alias("plausible"))


# ---------------------------------------------------------------- files


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS codec, CASE WHEN p_partkey % 2 = 0 THEN p_size || 'kbps' ELSE (p_size * 10) || 'kbps' END AS bitrate, CASE WHEN p_partkey % 2 = 0 THEN p_size % 2 = 0 END AS lossless, "
    "CASE WHEN p_partkey % 2 = 1 THEN (p_size * 10)::BIGINT END AS estimated_bitrate, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title FROM part"
)
def file_metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-20: a labelled text without newlines, and JSON."""
    text = F.concat(F.lit("COMMON INFOCONTAINER: MP4CODEC PROFILE: unknownCODEC: "), F.col("p_type"), F.lit("BITRATE: "), _s("p_size"), F.lit("kbpsLOSSLESS: "), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit("ARTIST: nullTITLE: "), F.col("p_name"))
    json = F.concat(F.lit('{"estimatedBitrate": '), (F.col("p_size") * 10).cast("string"), F.lit('.2, "frequencyCutoff": 16.04}'))
    even = F.col("p_partkey") % 2 == 0
    p = parts(spark, sf_dir).select("p_partkey", F.when(even, "pillows").otherwise("froste").alias("provider"), F.when(even, text).otherwise(json).alias("body"))
    return media.file_metadata(p).select("p_partkey", "codec", "bitrate", "lossless", "estimated_bitrate", "title")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size * 1000 END::BIGINT AS file_size, 'audio/mpeg' AS mime_type, p_name || '.mp3' AS filename, p_size % 2 = 0 AS quality_mismatch, round(p_size * 1.25 - 0.01, 1)::DOUBLE AS frequency_cutoff FROM part")
def file_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-20: the other JSON shape."""
    size = F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 1000).otherwise(0)
    body = F.concat(F.lit('{"size": '), size.cast("string"), F.lit(', "mimeType": "audio/mpeg", "name": "'), F.col("p_name"), F.lit('.mp3", "qualityMismatch": '), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit(', "frequencyCutoff": '), (F.col("p_size") * 1.25 - 0.01).cast("decimal(10,2)").cast("string"), F.lit("}"))
    p = parts(spark, sf_dir).select("p_partkey", F.lit("imgur").alias("provider"), body.alias("body"))
    return media.file_metadata(p).select("p_partkey", "file_size", "mime_type", "filename", "quality_mismatch", "frequency_cutoff")


@query("SELECT p_partkey, 'AAC · ' || CASE WHEN p_size % 2 = 0 THEN 'Lossless' ELSE p_size * 40 || 'kbps' END AS summary, CASE WHEN p_size * 40 >= 1000 THEN 'lossless' WHEN p_size * 40 >= 320 THEN 'hq' WHEN p_size * 40 >= 192 THEN 'cd' ELSE 'lq' END AS grade, p_size % 2 = 0 OR p_size * 40 >= 1000 AS is_large, '~' || CASE WHEN p_size * 900000 >= 1048576 THEN printf('%.1f MB', p_size * 900000 / 1048576) ELSE round(p_size * 900000 / 1024)::BIGINT || ' KB' END AS size_text FROM part")
def file_display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-21."""
    p = parts(spark, sf_dir).select(
        "p_partkey", F.lit("AAC").alias("codec"), F.lit("MP4").alias("container"), (F.col("p_size") % 2 == 0).alias("lossless"), F.concat((F.col("p_size") * 40).cast("string"), F.lit("kbps")).alias("bitrate"),
        F.lit(None).cast("long").alias("estimated_bitrate"), F.lit(180).alias("seconds"),
    )
    return media.display_columns(p).select("p_partkey", "summary", F.col("bitrate_class").alias("grade"), "is_large", "size_text")


@query(
    "SELECT p_partkey, label, value, variant FROM (SELECT p_partkey, unnest(['Codec', 'Bitrate', 'Lossless', 'Est. Bitrate', 'Duration', 'Freq. Cutoff', 'Quality Match']) AS label, "
    "unnest(['AAC', p_size * 40 || 'kbps', CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'No' END, CASE WHEN p_size % 2 = 0 THEN p_size * 30 || ' kbps' END, (p_size * 7 // 60) || ':' || lpad((p_size * 7 % 60)::VARCHAR, 2, '0'), p_size * 400 || ' Hz', CASE WHEN p_size % 2 = 0 THEN 'Mismatch' ELSE 'OK' END]) AS value, "
    "unnest(['secondary', CASE WHEN p_size * 40 >= 1000 THEN 'lossless' WHEN p_size * 40 >= 320 THEN 'hq' WHEN p_size * 40 >= 192 THEN 'cd' ELSE 'lq' END, CASE WHEN p_size % 3 = 0 THEN 'lossless' ELSE 'secondary' END, "
    "CASE WHEN p_size * 30 >= 1000 THEN 'lossless' WHEN p_size * 30 >= 320 THEN 'hq' WHEN p_size * 30 >= 192 THEN 'cd' ELSE 'lq' END, 'secondary', 'secondary', CASE WHEN p_size % 2 = 0 THEN 'lq' ELSE 'full' END]) AS variant FROM part) WHERE value IS NOT NULL"
)
def file_detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11: labels, formats and classes of the fields that a client shows."""
    n = F.col("p_size")
    p = parts(spark, sf_dir).select(
        "p_partkey", F.lit("AAC").alias("codec"), F.concat((n * 40).cast("string"), F.lit("kbps")).alias("bitrate"), F.when(n % 3 < 2, n % 3 == 0).alias("lossless"), F.when(n % 2 == 0, n * 30).alias("estimated_bitrate"),
        (n * 7).cast("string").alias("duration"), (n * 400).cast("double").alias("frequency_cutoff"), (n % 2 == 0).alias("quality_mismatch"),
    )
    return media.metadata_details(p, ["p_partkey"]).select("p_partkey", "label", "value", "variant")


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'audio/ogg' WHEN 1 THEN 'audio/flac' WHEN 2 THEN 'audio/mp4' END AS sniffed, CASE p_partkey % 3 WHEN 0 THEN 'audio/mp4' WHEN 1 THEN 'audio/flac' ELSE 'audio/mpeg' END AS declared, "
    "p_size % 4 <> 3 AND CASE p_size % 4 WHEN 0 THEN 'audio/ogg' WHEN 1 THEN 'audio/flac' WHEN 2 THEN 'audio/mp4' END <> CASE p_partkey % 3 WHEN 0 THEN 'audio/mp4' WHEN 1 THEN 'audio/flac' ELSE 'audio/mpeg' END AS mismatch FROM part"
)
def file_format_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-22."""
    z, k = F.col("p_size") % 4, F.col("p_partkey") % 3
    head = F.when(z == 0, "OggS").when(z == 1, "fLaC").when(z == 2, "\0\0\0 ftyp").otherwise("<htm")
    p = parts(spark, sf_dir).select(
        "p_partkey", F.concat(head, F.col("p_name")).cast("binary").alias("content"), F.when(k == 0, "audio/m4a; x=1").otherwise("application/octet-stream").alias("content_type"),
        F.when(k == 1, 'attachment; filename="a.FLAC"').alias("content_disposition"), F.concat(F.lit("https://example.org/a.mp3?x="), F.col("p_name")).alias("url"),
    )
    return media.audit_formats(p).select("p_partkey", "sniffed", "declared", "mismatch")


# ---------------------------------------------------------------- ordered rows


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS asked_at, count(*) FILTER (role = 'user') OVER w AS section_idx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def turns_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-01/03."""
    c = table(spark, sf_dir, "conversations").withColumn("asked_at", F.when(F.col("role") == "user", F.col("turn")))
    filled = rows.forward_fill(c, ["conv_id"], ["turn"], "asked_at")
    return rows.section_ordinals(filled, ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "asked_at", "section_idx")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN TRUE WHEN role = 'user' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), FALSE) AS in_footer FROM conversations")
def turns_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-02."""
    c = table(spark, sf_dir, "conversations")
    return rows.footer_state(c, ["conv_id"], ["turn"], F.col("role") == "system", F.col("role") == "user").select("conv_id", "turn", "in_footer")


@query("SELECT o_custkey, o_orderkey, coalesce(o_orderstatus <> lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), TRUE) AS is_first FROM orders")
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-05."""
    return rows.change_flag(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "is_first")


@query("SELECT p_partkey // 50 AS book, lower(trim(p_name)) AS name FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-09: names that occur twice in a sheet, whatever their case."""
    p = parts(spark, sf_dir)
    shouted = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    names = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("book")).agg(F.collect_list(shouted).alias("names"))
    return names.select("book", F.explode(quality.duplicate_names(F.col("names"))).alias("name"))


@query(
    "WITH a AS (SELECT s_suppkey, 'http://img/' || (s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1000 ELSE 0 END) AS url FROM supplier WHERE s_suppkey % 2 = 0) "
    "SELECT 'book-' || (s.s_suppkey // 20) AS sheet_id, s.s_suppkey AS era_idx, coalesce(a.url, 'own') AS art_url FROM supplier s LEFT JOIN a ON a.s_suppkey = s.s_suppkey"
)
def era_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16, JN-06: covers before other images, found by another name where the first is unknown."""
    s, k = table(spark, sf_dir, "supplier"), _s("s_suppkey")
    row = F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit(' (x)</td><td><img src="http://img/'), k, F.lit('"></td></tr>'), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit('</td><td>Front Cover</td><td><img src="http://img/'), (F.col("s_suppkey") + 1000).cast("string"), F.lit('"></td></tr>'))).otherwise(""))
    book = F.concat(F.lit("book-"), F.floor(F.col("s_suppkey") / 20).cast("string")).alias("sheet_id")
    even = s.filter("s_suppkey % 2 = 0").groupBy(book).agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("r"))
    art = art_map(sheet_rows(even.select("sheet_id", F.concat(F.lit("<table>"), "r", F.lit("</table>")).alias("html"))))
    unnamed = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Working title "), k)).otherwise(F.col("s_name"))
    eras = s.select(book, F.col("s_suppkey").alias("era_idx"), unnamed.alias("name"), F.array("s_name").alias("alt_names"), F.lit("own").alias("art_url"))
    return apply_art(eras, art).select("sheet_id", "era_idx", "art_url")


# ---------------------------------------------------------------- snapshots


def user_snapshots(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("u"), _s("user_id")).alias("url"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("content_hash"))


_SNAP = "SELECT 'u' || user_id AS url, ts AS fetched_at, event_type AS content_hash FROM events"
_CHANGED = f"WITH s AS ({_SNAP}) SELECT url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS at, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, content_hash) AS b FROM s) WHERE b IS DISTINCT FROM content_hash"


@query(_CHANGED)
def snapshots_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, batch form."""
    return snap.changed_snapshots(user_snapshots(table(spark, sf_dir, "events"))).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


@query(_CHANGED)
def snapshots_changed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01 as a stream over the events table, run until it is read."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    changed = snap.changed_snapshots_stream(user_snapshots(source), keep_seconds=10 * 365 * 86400)
    path = new_folder(spark, "changes")
    changed.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, "stream")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changed.schema).parquet(path).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


@query(f"WITH s AS ({_SNAP}), m AS (SELECT max(fetched_at) AS t FROM s) SELECT url, CASE WHEN epoch(t) - epoch(fetched_at) <= 3600 THEN 'hit' WHEN epoch(t) - epoch(fetched_at) <= 86400 THEN 'stale' ELSE 'miss' END AS freshness, count(*) AS n FROM (SELECT url, date_trunc('second', fetched_at) AS fetched_at FROM s), (SELECT date_trunc('second', t) AS t FROM m) GROUP BY ALL")
def snapshots_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02 against the time of the newest snapshot."""
    s = user_snapshots(table(spark, sf_dir, "events"))
    now = F.lit(s.agg(F.max("fetched_at")).first()[0])
    return s.groupBy("url", snap.freshness(F.col("fetched_at"), now).alias("freshness")).agg(F.count("*").alias("n"))


@query(f"WITH s AS ({_SNAP}) SELECT url, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS at, arg_max(content_hash, fetched_at) AS content_hash FROM s GROUP BY url")
def snapshots_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03, batch form."""
    return snap.latest_snapshots(user_snapshots(table(spark, sf_dir, "events"))).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


_LATEST = f"WITH s AS ({_SNAP}) SELECT url, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS at, arg_max(content_hash, (fetched_at, content_hash)) AS content_hash FROM s GROUP BY url"


@query(_LATEST)
def snapshots_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03 as a stream over the events table: deltas by bucket, merged once there are any."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    root = new_folder(spark, "latest")
    snap.upsert_latest(user_snapshots(source), root, new_folder(spark, "stream"), compact_every=1, buckets=16).trigger(availableNow=True).start().awaitTermination()
    return snap.read_latest(spark, root).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


_EXPIRED = "WITH s AS (SELECT 'u' || user_id AS url, ts AS fetched_at, event_type AS content_hash FROM events), l AS (SELECT *, lag(content_hash) OVER w AS b, lag(fetched_at) OVER w AS t FROM s WINDOW w AS (PARTITION BY url ORDER BY fetched_at, content_hash)) SELECT url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS at, content_hash FROM l WHERE b IS DISTINCT FROM content_hash OR epoch_us(fetched_at) - epoch_us(t) > 259200000000"


@query(_EXPIRED)
def snapshots_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01 with expiry: after three days without a snapshot a url is new again."""
    return snap.changed_snapshots(user_snapshots(table(spark, sf_dir, "events")), keep_seconds=3 * 86400).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


@query(_EXPIRED)
def snapshots_expiring_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01 with expiry as a stream, whose state goes by event time."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    changed = snap.changed_snapshots_stream(user_snapshots(source), keep_seconds=3 * 86400)
    path = new_folder(spark, "changes")
    changed.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, "stream")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changed.schema).parquet(path).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "content_hash")


@query(f"WITH s AS ({_SNAP}), m AS (SELECT date_trunc('second', max(fetched_at)) AS t FROM s) SELECT url, count(*) FILTER (epoch(t) - epoch(date_trunc('second', fetched_at)) <= 604800 AND content_hash <> 'error') AS n_valid FROM s, m GROUP BY url")
def snapshots_client_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02: a client's copies that are young enough and of the current form."""
    s = user_snapshots(table(spark, sf_dir, "events"))
    now = F.lit(s.agg(F.max("fetched_at")).first()[0])
    version = F.when(F.col("content_hash") == "error", 0).otherwise(1)
    return s.groupBy("url").agg(F.count_if(snap.client_copy_valid(F.col("fetched_at"), now, version)).alias("n_valid"))


@query("SELECT p_partkey, 'Unfinished' AS version_tag, p_name AS name, p_brand AS alts FROM part")
def unfinished_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EN-04: an other title that says unfinished becomes the tag and is no title."""
    cell = F.concat(F.lit("<table><tr><td>Era</td><td>Name</td><td>Notes</td></tr><tr><td>x</td><td>"), F.col("p_name"), F.lit("<br>"), F.col("p_brand"), F.lit("<br>[Unfinished]</td><td>n</td></tr></table>"))
    read = rows.with_version_columns(project_fields(sheet_rows(parts(spark, sf_dir).select(_s("p_partkey").alias("sheet_id"), cell.alias("html")))))
    return read.select(F.col("sheet_id").cast("long").alias("p_partkey"), "version_tag", F.col("title").alias("name"), F.array_join("alt_titles", "|").alias("alts"))
