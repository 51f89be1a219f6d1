"""URL filters by a temporal list join.

Dated list entries (added, removed) become validity intervals; each capture is judged by
the entries that were active when it was fetched. Of a host's suffixes the longest with an
active entry decides, an allowing entry before a blocking one.

Verdicts are found once for each distinct (host, day), so that a host with a third of all
captures spreads over its days and its captures meet the lists only as counted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import free_name, table

ENDLESS = "9999-12-31"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a single label is its own only suffix."""
    labels = F.split(host, r"\.")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(many)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` from ``(list, pattern, listed_on, event)``.

    An ``add`` holds from its day until the pattern's next entry in the list, end exclusive.
    Of several entries of one day an ``add`` wins; repeated ones count once; entries with a
    null are ignored.
    """
    days = entries.dropna(subset=["list", "pattern", "listed_on", "event"]).groupBy("list", "pattern", "listed_on").agg(F.max((F.col("event") == "add").cast("int")).alias("on"))
    following = F.lead("listed_on").over(Window.partitionBy("list", "pattern").orderBy("listed_on"))
    spans = days.withColumn("valid_to", F.coalesce(following, F.lit(ENDLESS).cast("date")))
    return spans.filter("on = 1").select("list", "pattern", F.col("listed_on").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``verdict`` (block, allow, none) and ``matched`` (the entry's pattern).

    Captures without a host or a time match nothing. Columns of ``captures`` called host,
    verdict or matched, in any case, are replaced; all others stay as they are, whatever
    they are called. Empty captures give an empty table, empty entries no verdict; repeated
    rows stay.
    """
    own = ("host", "verdict", "matched")
    kept = [c for c in captures.columns if c.lower() not in own]
    wide = captures.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url_col}`")).alias("host"), F.to_date(f"`{time_col}`").alias(day := free_name(captures, "fetch_day")))
    seen = wide.select("host", F.col(day).alias("day")).dropna().distinct().select("host", "day", F.explode(host_suffixes(F.col("host"))).alias("pattern"))
    active = seen.join(validity_intervals(entries), "pattern").filter((F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to")))
    rank = F.struct(F.length("pattern"), (F.col("list") == "allow").cast("int"))
    hit = free_name(captures, "url_hit")
    judged = active.groupBy("host", F.col("day").alias(day)).agg(F.max_by(F.struct("list", "pattern"), rank).alias(hit))
    joined = wide.join(judged, ["host", day], "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], "host", F.coalesce(F.col(hit)["list"], F.lit("none")).alias("verdict"), F.col(hit)["pattern"].alias("matched"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time, which the table lacks: spread over two years by page id."""
    hours = F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(17520)).cast("int")
    return pages.select("page_id", "url", F.timestamp_add("HOUR", hours, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries for the table's own domains: about a third are listed, half of those later
    removed, some listed again; a fifth are on the allow list."""
    keys = pages.select(F.explode(host_suffixes(url_host(F.col("url")))).alias("pattern")).distinct()
    v = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 4), 16, 10).cast("int")
    listed = keys.withColumn("v", v).withColumn("spam", F.col("pattern").rlike("spam|pills|casino")).filter("v % 3 = 0 OR spam")
    name = F.when((F.col("v") % 5 == 0) & ~F.col("spam"), "allow").otherwise("block")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    first = F.col("v") % 400
    events = F.array_compact(
        F.array(
            F.struct(day(first).alias("listed_on"), F.lit("add").alias("event")),
            F.when(F.col("v") % 2 == 0, F.struct(day(first + 90 + F.col("v") % 50).alias("listed_on"), F.lit("remove").alias("event"))),
            F.when(F.col("v") % 4 == 0, F.struct(day(first + 200).alias("listed_on"), F.lit("add").alias("event"))),
        )
    )
    return listed.select(name.alias("list"), "pattern", F.explode(events).alias("e")).select("list", "pattern", "e.listed_on", "e.event")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captures_of(pages), entries_of(pages)).select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("fetched"), "host", "verdict", "matched")


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(((coalesce(page_id, 0) * 7919) % 17520)::INT) AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL),
keys AS (
  SELECT host, array_to_string(labels[i:], '.') AS pattern
  FROM (SELECT host, labels, unnest(generate_series(1, greatest(len(labels) - 1, 1))) AS i FROM hosts)),
listed AS (
  SELECT pattern, v, spam FROM (
    SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS v, regexp_matches(pattern, 'spam|pills|casino') AS spam FROM keys)
  WHERE v % 3 = 0 OR spam),
entries AS (
  SELECT CASE WHEN v % 5 = 0 AND NOT spam THEN 'allow' ELSE 'block' END AS list, pattern, DATE '2024-01-01' + (v % 400)::INT AS listed_on, 1 AS on_ FROM listed
  UNION ALL SELECT CASE WHEN v % 5 = 0 AND NOT spam THEN 'allow' ELSE 'block' END, pattern, DATE '2024-01-01' + (v % 400 + 90 + v % 50)::INT, 0 FROM listed WHERE v % 2 = 0
  UNION ALL SELECT CASE WHEN v % 5 = 0 AND NOT spam THEN 'allow' ELSE 'block' END, pattern, DATE '2024-01-01' + (v % 400 + 200)::INT, 1 FROM listed WHERE v % 4 = 0),
days AS (SELECT list, pattern, listed_on, max(on_) AS on_ FROM entries GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(listed_on) OVER (PARTITION BY list, pattern ORDER BY listed_on), DATE '9999-12-31') AS valid_to FROM days),
judged AS (
  SELECT c.host, c.fetched_at, s.list, s.pattern,
    row_number() OVER (PARTITION BY c.host, c.fetched_at ORDER BY length(s.pattern) DESC, s.list = 'allow' DESC) AS rn
  FROM (SELECT DISTINCT host, fetched_at FROM captures) c JOIN keys k ON c.host = k.host
  JOIN spans s ON s.pattern = k.pattern AND s.on_ = 1 AND c.fetched_at::DATE >= s.listed_on AND c.fetched_at::DATE < s.valid_to)
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M') AS fetched, c.host, coalesce(j.list, 'none') AS verdict, j.pattern AS matched
FROM captures c LEFT JOIN judged j ON c.host = j.host AND c.fetched_at = j.fetched_at AND j.rn = 1
"""
