"""Tables of the catalogue's shape, derived from the sales tables, for the registered queries.

Each has its twin in SQL, so that a query's result can be computed from the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = "l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
LENGTHS = "CASE l_linenumber % 6 WHEN 0 THEN 'Full' WHEN 1 THEN 'OG File' WHEN 2 THEN 'Snippet' WHEN 3 THEN 'Partial' WHEN 4 THEN 'Confirmed' ELSE 'Unavailable' END"
QUALITIES = "CASE l_returnflag WHEN 'A' THEN 'High Quality (HQ)' WHEN 'R' THEN 'CD Quality' ELSE 'Not Available' END"
BADGES = "CASE p_size % 10 WHEN 0 THEN 'best' WHEN 1 THEN 'special' WHEN 2 THEN 'worst' END"

_ROW_NUMBER = f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER})"
_COLUMNS = f"""
  concat('sheet-', CAST(l_suppkey AS STRING)) AS sheet_id, CAST(l_suppkey AS BIGINT) AS era_idx, s_name AS era_name, CAST(p_size % 4 AS BIGINT) AS section_idx,
  CAST({_ROW_NUMBER} AS BIGINT) AS row_idx,
  p_name AS base_name, concat(p_name, ' take ', CAST(l_linenumber AS STRING)) AS name, {BADGES} AS badge, {LENGTHS} AS available_length, {QUALITIES} AS quality,
  CASE WHEN l_discount < 0.03 THEN concat(p_name, '.zip') END AS og_filename, CAST(NULL AS STRING) AS notes, p_brand AS producers"""

# rows are numbered before any text is made of them, so that the narrow columns are shuffled and sorted, the texts never
SPARK_VERSIONS = f"""SELECT {_COLUMNS.replace(_ROW_NUMBER, "row_no")},
  CASE WHEN l_quantity < 20 THEN array(concat('https://pillows.su/f/', CAST(l_orderkey AS STRING)))
    WHEN l_quantity < 30 THEN array(concat('https://example.com/', CAST(l_partkey AS STRING)), concat('https://music.froste.lol/song/ab', CAST(l_linenumber AS STRING)))
    WHEN l_quantity < 40 THEN array('https://example.com/x.zip') ELSE CAST(array() AS ARRAY<STRING>) END AS links,
  CASE WHEN p_size % 3 = 0 THEN array(p_type, p_brand) ELSE CAST(array() AS ARRAY<STRING>) END AS alt_titles,
  CASE WHEN l_tax <= 0.06 THEN date_format(l_shipdate, 'MM/dd/yyyy') END AS leak_date, date_format(l_shipdate, 'yyyy') AS file_date
FROM (SELECT *, {_ROW_NUMBER} AS row_no FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey)"""

V = f"""WITH v AS (SELECT {_COLUMNS},
  CASE WHEN l_quantity < 20 THEN ['https://pillows.su/f/' || l_orderkey]
    WHEN l_quantity < 30 THEN ['https://example.com/' || l_partkey, 'https://music.froste.lol/song/ab' || l_linenumber]
    WHEN l_quantity < 40 THEN ['https://example.com/x.zip'] ELSE []::VARCHAR[] END AS links,
  CASE WHEN p_size % 3 = 0 THEN [p_type, p_brand] ELSE []::VARCHAR[] END AS alt_titles,
  CASE WHEN l_tax <= 0.06 THEN strftime(l_shipdate, '%m/%d/%Y') END AS leak_date, strftime(l_shipdate, '%Y') AS file_date, l_quantity, l_shipdate, l_tax
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier as a sheet with one era, its line items as versions of the parts' songs."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")}
    return spark.sql(SPARK_VERSIONS, **tables)


def eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as eras, some without songs."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("sheet-"), F.col("s_suppkey").cast("string")).alias("sheet_id"), F.col("s_suppkey").alias("era_idx"), F.col("s_name").alias("name"),
        F.array(F.concat(F.lit("Alt "), F.substring("s_name", 16, 3))).alias("alt_names"), F.col("s_acctbal"),
    )


# ---------------------------------------------------------------- sheets as HTML

ITEM_ORDER = ("p_type", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def _items_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their parts, spread by supplier before any text is made of them.

    What follows groups by supplier where the rows are: the narrow columns are shuffled, the
    texts never. The number of tasks is the one asked for, as the rows are few bytes, but work.
    A part's texts repeat, so that its file says little of its size: it is not left to a broadcast.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").hint("merge")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).repartition(tasks, "l_suppkey")


def rendered_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML sheet for each supplier: part types are eras with a header row, line items are song rows.

    The first row says whose sheet it is, the second is the header; a footer closes it.
    """
    items = _items_by_supplier(spark, sf_dir)
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    star = F.when(F.col("p_size") % 10 == 0, "⭐ ").when(F.col("p_size") % 10 == 1, "✨ ").otherwise("")
    name = F.concat(star, F.col("p_name"), F.lit(" [V"), F.col("l_linenumber").cast("string"), F.lit("]<br>(prod. "), F.col("p_brand"), F.lit(" &amp; Co)"))
    link = F.when(F.col("l_quantity") < 25, F.concat(F.lit('<a href="https://www.google.com/url?q=https%3A%2F%2Fpillows.su%2Ff%2F'), F.col("l_orderkey").cast("string"), F.lit('&amp;sa=D">play</a>'))).otherwise("")
    song = F.concat(F.lit("<tr>"), td(F.col("p_type")), td(name), td(F.concat(F.lit("OG Filename: f"), F.col("l_partkey").cast("string"), F.lit("<br>x"))), td(F.expr(LENGTHS)), F.lit('<td class="s7">'), F.expr(QUALITIES), F.lit("</td>"), td(link), F.lit("</tr>"))
    rows = items.select("l_suppkey", "p_type", F.struct(*ITEM_ORDER, song.alias("html")).alias("r"), (F.col("l_linenumber") % 6 == 0).cast("int").alias("full"))
    by_era = rows.groupBy("l_suppkey", "p_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["html"]), "").alias("songs"), F.sum("full").alias("full"), F.count("*").alias("n"))
    head = F.concat(F.lit("<tr><td>"), F.col("full").cast("string"), F.lit(" Full<br>"), (F.col("n") - F.col("full")).cast("string"), F.lit(" Unavailable</td><td>"), F.col("p_type"), F.lit("<br>(the "), F.lower("p_type"), F.lit(" years)</td><td>(2001) (begun)<br>(2002) (ended)</td><td></td><td>All about "), F.col("p_type"), F.lit("</td><td></td></tr>"))
    sheets = by_era.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_type", F.concat(head, F.col("songs")).alias("h")))), lambda s: s["h"]), "").alias("body"))
    top = "<html><head><style>.s7{background-color:#4CAF50;}.s8{background-color:#fff}</style></head><body><table><tr><td colspan=\"6\">Sheet of the supplier &#9733; all links are down, no ETA</td></tr><tr><td>Era</td><td>Name (and credits)</td><td>Notes</td><td>Available Length</td><td>Quality</td><td>Link(s)</td></tr>"
    foot = "<tr><td></td><td>Changelogs</td><td></td></tr><tr><td>x</td><td>y</td></tr></table></body></html>"
    return sheets.select(F.concat(F.lit("sup-"), F.col("l_suppkey").cast("string")).alias("sheet_id"), F.concat(F.lit(top), F.col("body"), F.lit(foot)).alias("html"))


SHEET_ITEMS = f"""WITH i AS (SELECT 'sup-' || l_suppkey AS sheet_id, p_type AS era, p_name AS name, l_linenumber, {BADGES} AS badge0, p_size, p_brand, {LENGTHS} AS available_length, {QUALITIES} AS quality,
  l_partkey, l_orderkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


# ---------------------------------------------------------------- sheets of several layouts

#: Header texts and fields of four layouts; supplier k has layout k % 4.
LAYOUTS = (
    (("Era", "era"), ("Name (and credits)", "name"), ("Notes", "notes"), ("Available Length", "available_length"), ("Quality", "quality"), ("Link(s)", "links")),
    (("Era", "era"), ("Title", "name"), ("Track Number / Info", "notes"), ("Portion", "available_length"), ("Quality", "quality"), ("Main Link", "links"), ("Mirror Links", "alt_links")),
    (("Era", "era"), ("Song Name<br>(join us at discord)", "name"), ("Notes &amp; Information", "notes"), ("Leak Date", "leak_date"), ("Currently Available", "available_length"), ("See below<br>Quality", "quality"), ("Downloads", "links")),
    (("Era", "era"), ("Name", "name"), ("Info", "notes"), ("Quality of file", "quality"), ("Links to files", "links"), ("Streaming?", "streaming")),
)
#: What stands above the header of each layout.
ABOVE = (
    '<tr><td colspan="6">Sheet of the supplier &#9733; <a href="https://a.b/down">all links</a> are down, no ETA</td></tr>',
    "",
    '<tr><td>Welcome to the catalogue</td></tr><tr><td>My Tracker</td></tr><tr><td>Read <a href="https://www.google.com/url?q=https%3A%2F%2Fa.b%2Frules">the rules</a> first</td></tr><tr><td>short</td></tr><tr><td>Welcome to the catalogue</td></tr>',
    "<tr><td></td><td>All about the supplier</td></tr>",
)
STYLES = (".s7{background-color:#4CAF50;}", ".s7{background-color:RGB(1, 2, 255)}", ".s7{background-color:#fff}.s8{background-color:#123}", ".s7{color:red}")
#: One way of each part type to open its era, by what its first rows are.
SONG_ERA = """CASE p_type WHEN 'PROMO' THEN '' WHEN 'SMALL' THEN CASE l_linenumber WHEN 7 THEN 'Smäll [V2]' WHEN 6 THEN 'The Small Years' WHEN 5 THEN 'Those Small Years' WHEN 4 THEN 'TSY' ELSE 'SMALL' END
  WHEN 'LARGE' THEN CASE WHEN l_linenumber = 5 THEN 'Odd LARGE Thing' ELSE 'LARGE' END ELSE p_type END"""


def _tr(*cells) -> str:
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def _song_row(fields: list[str]) -> Column:
    """A row of the cells made of these fields; marks that meet are one text."""
    parts, mark = [], "<tr>"
    for f in fields:
        parts += [F.lit(mark + ('<td class="s7">' if f == "quality" else "<td>")), F.col(f"_{f}")]
        mark = "</td>"
    return F.concat(*parts, F.lit(mark + "</tr>"))


def mixed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML sheet for each supplier, in one of four layouts; each part type opens its era in another way.

    ECONOMY by a row with an era but no name, LARGE by an empty header before its own,
    MEDIUM by a name of two lines, PROMO by a header whose songs have no era, SMALL by a
    header whose songs use four other spellings, STANDARD by an image that the first song
    names. Items of line 4 and above form a section; stray, label and footer rows are there too.
    """
    items = _items_by_supplier(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    cells = {
        "era": F.expr(SONG_ERA),
        "name": F.concat(F.col("p_name"), F.lit(" [V"), text("l_linenumber"), F.lit("]<br>(prod. "), F.col("p_brand"), F.lit(" &amp; Co)")),
        "notes": F.concat(F.lit("OG Filename: f"), text("l_partkey"), F.lit("<br>x")),
        "available_length": F.expr(LENGTHS), "quality": F.expr(QUALITIES), "streaming": F.lit("no"), "leak_date": F.date_format("l_shipdate", "MM/dd/yyyy"),
        "links": F.when(F.col("l_quantity") < 25, F.concat(F.lit('<a href="https://pillows.su/f/'), text("l_orderkey"), F.lit('">play</a>'))).otherwise(""),
        "alt_links": F.concat(F.lit('<a href="https://alt.example/'), text("l_partkey"), F.lit('">b</a>')),
    }
    # cells are made before they are placed, once: a method that makes each in every layout is too long for the JVM to compile
    items = items.withColumns({f"_{f}": c for f, c in cells.items()})
    layout, song = F.col("l_suppkey") % len(LAYOUTS), F.lit(None).cast("string")
    for k, fields in enumerate(LAYOUTS):
        song = F.when(layout == k, _song_row([f for _, f in fields])).otherwise(song)
    late = F.col("l_linenumber") >= 4
    rows = items.select("l_suppkey", "p_type", F.struct(late.alias("late"), *ITEM_ORDER, song.alias("html")).alias("r"), (F.col("l_linenumber") % 6 == 0).cast("int").alias("full"))
    by_era = rows.groupBy("l_suppkey", "p_type").agg(F.sort_array(F.collect_list("r")).alias("r"), F.sum("full").alias("full"), F.count("*").alias("n"))
    join = lambda is_late: F.array_join(F.transform(F.filter("r", lambda r: r["late"] == F.lit(is_late)), lambda r: r["html"]), "")
    kind = F.col("p_type")
    extra = F.when(kind == "STANDARD", 2).otherwise(0)
    stats = F.concat(text("full"), F.lit(" Full<br>"), (F.col("n") - F.col("full") + extra).cast("string"), F.lit(" Unavailable"))
    header = lambda name, events, about: F.concat(F.lit("<tr><td>"), stats, F.lit("</td><td>"), name, F.lit("</td><td>" + events + "</td><td></td><td>"), about, F.lit("</td><td></td></tr>"))
    two = "(2001) (begun)<br>(2002) (ended)"
    head = (
        F.when(kind == "ECONOMY", _tr("ECONOMY", "", "(2001) (begun)", 'x <img src="http://img/e">', "y", ""))
        .when(kind == "LARGE", F.concat(F.lit(_tr("0 Full", "LARGE [Phase 1]", "", "", "The stub of LARGE", "")), header(kind, "", F.lit(""))))
        .when(kind == "MEDIUM", _tr("", "MEDIUM<br>(2007 - 2009)", "Notes of MEDIUM", "", '<img src="http://img/m">', ""))
        .when(kind == "SMALL", header(F.lit("SMALL<br>(the small years)"), two, F.lit("All about SMALL")))
        .when(kind == "STANDARD", header(F.lit('<img src="http://img/s">'), "(2001) (begun)", F.lit("All about STANDARD")))
        .otherwise(header(kind, two, F.concat(F.lit("All about "), kind)))
    )
    label = F.when(kind == "SMALL", _tr("", "", "WLR Higher Files", "", "", "")).when(kind == "LARGE", _tr("", "Uncut Reels", "", "", "", "")).when(kind == "MEDIUM", _tr("MEDIUM", "Bonus Disc", "", "", "", "")).otherwise("")
    body = F.concat(head, join(False), label, F.lit(_tr("Demos", "", "", "", "", "")), join(True))
    sheets = by_era.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_type", body.alias("h")))), lambda s: s["h"]), "").alias("body"), F.sum("n").alias("n"))
    top = F.lit(None).cast("string")
    for k, fields in enumerate(LAYOUTS):
        top = F.when(layout == k, f"<html><head><style>{STYLES[k]}</style></head><body><table>{ABOVE[k]}{_tr(*[t for t, _ in fields])}").otherwise(top)
    foot = F.concat(F.lit(_tr("", "Changelogs", "") + _tr("x", "y") + "<tr><td>🔗 "), text("n"), F.lit(" Total Links<br>❌ 1 Missing Links</td><td>7 Lossless</td><td>5 Total Full<br>3 OG File(s)</td><td>2 Best Of</td></tr></table></body></html>"))
    return sheets.select(F.concat(F.lit("sup-"), text("l_suppkey")).alias("sheet_id"), F.concat(top, F.lit(_tr("Links", "", "see", "", "", "")), F.col("body"), foot).alias("html"))


MIXED = f"""WITH i AS (SELECT 'sup-' || l_suppkey AS sheet_id, l_suppkey, p_type, p_name, l_linenumber, l_linenumber >= 4 AS late, l_partkey, l_orderkey, l_quantity, {LENGTHS} AS available_length, {QUALITIES} AS quality
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
