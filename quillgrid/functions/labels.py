"""Column functions that class qualities, lengths, dates, durations and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.text import some, strip

# Fixed: ordered (contained text, class).
QUALITY = (("lossless", "lossless"), ("og", "og"), ("cd", "cd"), ("high", "hq"), ("low", "lq"), ("recording", "rec"), ("beat", "beatonly"))
AVAILABILITY = (("tagged", "tagged"), ("stem", "stem"), ("beat", "beatonly"), ("partial", "partial"), ("cut", "partial"), ("snippet", "snippet"), ("confirmed", "confirmed"), ("unavailable", "unavailable"))
AVAILABILITY_VALUES = ("og file", "og files", "full", "tagged", "stem", "stem bounce", "stem bounces", "beat only", "partial", "snippet", "confirmed", "unavailable")
BEST_OF = ("best", "special")

# Fixed: links that can be streamed.
STREAM_HOSTS = r"(?i)^https?://(?:(?:www\.)?(?:pillows\.su|pillowcase\.su|(?:temp\.)?imgur\.gg)/f/|music\.froste\.lol/song/[a-f0-9]+|(?:www\.)?krakenfiles\.com/view/[A-Za-z0-9_-]+/file\.html)"
PROVIDERS = (
    ("pillowcase", r"(?i)^https?://(?:www\.)?(?:pillows\.su|pillowcase\.su)/f/([A-Za-z0-9_-]+)"),
    ("imgur", r"(?i)^https?://(?:www\.)?(?:temp\.)?imgur\.gg/f/([A-Za-z0-9_-]+)"),
    ("froste", r"(?i)^https?://music\.froste\.lol/song/([a-f0-9]+)"),
    ("kraken", r"(?i)^https?://(?:www\.)?krakenfiles\.com/view/([A-Za-z0-9_-]+)/file\.html"),
)
# Fixed: extensions of files that hold no sound.
OTHER_FILES = r"(?i)\.(?:zip|rar|7z|tar|gz|tgz|pdf|txt|doc|docx|rtf|exe|dmg|iso|pkg|jpg|jpeg|png|gif|webp|bmp|mp4|mov|mkv|avi|webm)$"


def _first(low: Column, rules: tuple, other: str) -> Column:
    out = F.lit(other)
    for part, kind in reversed(rules):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def quality_class(quality: Column) -> Column:
    return F.when(F.coalesce(quality, F.lit("")) == "", "na").otherwise(_first(F.lower(quality), QUALITY, "na"))


def availability_class(length: Column) -> Column:
    low = F.lower(length)
    return F.when(F.coalesce(length, F.lit("")) == "", "na").when(low.contains("og file"), "ogfile").when(low == "full", "full").otherwise(_first(low, AVAILABILITY, "na"))


def _low(col: Column) -> Column:
    return strip(F.lower(F.coalesce(col, F.lit(""))))


def effective_badge(quality: Column, length: Column) -> Column:
    """struct(text, variant, type): the quality, or the availability if there is none."""
    q, a = _low(quality), _low(length)
    by_length = F.struct(length.alias("text"), availability_class(length).alias("variant"), F.lit("availability").alias("type"))
    by_quality = F.struct(quality.alias("text"), quality_class(quality).alias("variant"), F.lit("quality").alias("type"))
    return F.when(q.isin("", "not available", "n/a"), F.when(~a.isin("", "n/a"), by_length)).otherwise(by_quality)


def secondary_badge(quality: Column, length: Column) -> Column:
    """struct(text, variant) of the availability where it adds to the quality."""
    q, a = _low(quality), _low(length)
    shown = ~a.isin("", "n/a", "not available") & ~q.isin("", "not available", "n/a") & (a != q) & a.isin(*AVAILABILITY_VALUES)
    return F.when(shown, F.struct(length.alias("text"), availability_class(length).alias("variant")))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``m:ss`` or ``h:mm:ss``; anything else is 0."""
    parts = F.transform(F.split(text, ":"), lambda p: F.try_to_number(F.trim(p), F.lit("999999")).cast("long"))
    whole = F.forall(parts, lambda p: p.isNotNull())
    two, three = parts[0] * 60 + parts[1], F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))
    out = F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three)
    return F.coalesce(F.when(whole & ~text.contains("?"), out), F.lit(0))


def format_duration(seconds: Column) -> Column:
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def parse_date(text: Column) -> Column:
    """A date from the usual forms, else the first of January of a year found; null if there is none."""
    # a form is tried where its separator is: each one that fails costs an exception
    formats = {"M/d/yyyy": "/", "yyyy-MM-dd": "-", "MMMM d, yyyy": ", ", "MMM d, yyyy": ", ", "MMMM yyyy": " ", "MMM yyyy": " "}
    tries = [F.when(text.contains(mark), F.try_to_timestamp(text, F.lit(f)).cast("date")) for f, mark in formats.items()]
    year = some(F.regexp_extract(text, r"(\d{4})", 1))
    return F.coalesce(*tries, F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))


def first_streamable(links: Column) -> Column:
    """The first link of a streaming host."""
    return F.get(F.filter(links, lambda x: x.rlike(STREAM_HOSTS)), F.lit(0))


def streamable(links: Column, og_filename: Column, dialect: str = "web") -> Column:
    """``web``: a host link, and no zip archive by name. ``ios``: neither file name nor that link may end as another kind of file."""
    if dialect == "web":
        return first_streamable(links).isNotNull() & ~F.lower(F.coalesce(og_filename, F.lit(""))).endswith(".zip")
    playable = ~F.regexp_replace(first_streamable(links), r"[?#].*$", "").rlike(OTHER_FILES)
    return F.coalesce(playable, F.lit(False)) & ~F.coalesce(og_filename, F.lit("")).rlike(OTHER_FILES)


def provider(link: Column) -> Column:
    """struct(provider, file_id), null for other hosts."""
    out = F.lit(None)
    for name, form in reversed(PROVIDERS):
        out = F.when(link.rlike(form), F.struct(F.lit(name).alias("provider"), F.regexp_extract(link, form, 1).alias("file_id"))).otherwise(out)
    return out


def display_domain(link: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(link, F.lit("HOST"))), r"^www\.", "")


def allowed_domain(link: Column, hosts: tuple[str, ...], parents: tuple[str, ...] = ()) -> Column:
    """Whether the link's host is one of ``hosts`` or lies under one of ``parents``."""
    host = F.lower(F.try_parse_url(link, F.lit("HOST")))
    under = F.lit(False)
    for p in parents:
        under = under | (host == p) | host.endswith("." + p)
    return F.coalesce(host.isin(*hosts) | under, F.lit(False))


def unwrap_link(link: Column) -> Column:
    """The target of a redirect ``google.com/url?q=``, else the link itself."""
    target = F.try_url_decode(F.try_parse_url(link, F.lit("QUERY"), F.lit("q")))
    return F.when(link.contains("google.com/url"), F.coalesce(target, link)).otherwise(link)


def art_url(url: Column) -> Column:
    """An image address for full size; null unless it is http(s)."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    sized = full.rlike(r"lh[3-6]\.googleusercontent\.com|docs\.google\.com/sheets-images") & ~full.rlike(r"lh7-rt\.googleusercontent\.com")
    large = F.when(sized, F.concat(F.regexp_replace(full, r"=[swh]\d+(?:-[swh]\d+)*$", ""), F.lit("=s0"))).otherwise(full)
    return F.when(full.startswith("http"), large)
