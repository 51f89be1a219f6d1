"""Technical metadata of files: provider texts, header bytes, display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import some, strip

# Fixed: labels of a provider's text; where one begins with another the longer stands first.
LABELS = (
    "FILE FORMAT INFO", "COMMON INFO", "CODEC PROFILE", "CODEC", "CONTAINER", "DURATION", "BITRATE", "SAMPLE RATE", "BITS PER SAMPLE", "LOSSLESS",
    "NUMBER OF CHANNELS", "CREATION TIME", "MODIFICATION TIME", "TRACK GAIN", "ALBUM GAIN", "ALBUM ARTIST", "ARTIST", "ALBUM", "TITLE", "TRACK", "GENRE", "DATE", "YEAR", "COMMENT",
)
TEXT_FIELDS = {"container": "CONTAINER", "codec": "CODEC", "codec_profile": "CODEC PROFILE", "bitrate": "BITRATE", "sample_rate": "SAMPLE RATE", "bits_per_sample": "BITS PER SAMPLE", "lossless": "LOSSLESS", "channels": "NUMBER OF CHANNELS", "duration": "DURATION", "artist": "ARTIST", "title": "TITLE"}
JSON_BODY = "estimatedBitrate double, frequencyCutoff double, qualityMismatch boolean, size bigint, mimeType string, name string"
# Fixed: media types.
CORRECTED = {"audio/m4a": "audio/mp4", "audio/m4b": "audio/mp4", "audio/x-m4a": "audio/mp4"}
BY_EXTENSION = {"m4a": "audio/mp4", "m4b": "audio/mp4", "mp3": "audio/mpeg", "ogg": "audio/ogg", "oga": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac", "wav": "audio/wav"}
GENERIC = ("application/octet-stream", "binary/octet-stream", "")


def provider_text_fields(body: Column) -> dict[str, Column]:
    """The typed fields of a text of labels and values, with or without newlines between them."""
    split = r"(?s)(?:^|.*?)\b?(" + "|".join(LABELS) + r"):\s*(.*?)(?=(?:" + "|".join(LABELS) + r"):|\z)"
    keys, values = (F.regexp_extract_all(body, F.lit(split), F.lit(g)) for g in (1, 2))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), F.transform(values, strip).alias("v")), lambda p: ~F.lower(p["v"]).isin("", "unknown", "null", "[object object]"))
    last = lambda label: F.element_at(F.filter(pairs, lambda p: p["k"] == label), -1)["v"]
    had = lambda label: F.exists(pairs, lambda p: p["k"] == label)
    return {name: F.when(had(label), last(label)) for name, label in TEXT_FIELDS.items()}


def file_metadata(df: DataFrame, provider_col: str = "provider", body_col: str = "body") -> DataFrame:
    """Adds the typed fields of a provider's answer: a labelled text, or one of two JSON shapes."""
    json = F.from_json(F.col(body_col), JSON_BODY)
    text = F.col(provider_col) == "pillows"
    out = df.withColumns({"_j": F.when(~text, json), "_b": F.when(text, strip(F.col(body_col)))})
    fields = provider_text_fields(F.col("_b"))
    typed = fields | {"lossless": F.lower(fields["lossless"]) == "true", "channels": F.when(fields["channels"].rlike(r"^\d+$"), fields["channels"])}
    kbps = F.bround("_j.estimatedBitrate", 0).cast("long")
    typed["bitrate"] = F.coalesce(fields["bitrate"], F.concat(kbps.cast("string"), F.lit("kbps")))
    typed |= {"estimated_bitrate": kbps, "frequency_cutoff": F.bround("_j.frequencyCutoff", 1), "quality_mismatch": F.col("_j.qualityMismatch"), "file_size": F.nullif("_j.size", F.lit(0)), "mime_type": some(F.col("_j.mimeType")), "filename": some(F.col("_j.name"))}
    return out.withColumns(typed).drop("_j", "_b")


def leading_number(col: Column) -> Column:
    return some(F.regexp_extract(col, r"^\s*(\d+)", 1)).cast("long")


def display_columns(meta: DataFrame, seconds_col: str = "seconds") -> DataFrame:
    """Adds ``summary``, ``bitrate_class``, ``size_text`` and ``is_large``."""
    codec = F.coalesce(F.when(~F.col("codec").eqNullSafe(F.col("container")), F.col("codec")), F.col("container"))
    rate = F.when(F.coalesce("lossless", F.lit(False)), "Lossless").otherwise(F.coalesce("bitrate", F.concat(F.lit("~"), F.col("estimated_bitrate").cast("string"), F.lit("kbps"))))
    kbps = F.coalesce("estimated_bitrate", leading_number(F.col("bitrate")))
    size = kbps * 125 * F.col(seconds_col)
    mb, gb = 1024.0**2, 1024.0**3
    fixed = lambda c: F.format_string("%.1f", c)
    size_text = F.when((kbps > 0) & (F.col(seconds_col) > 0), F.when(size >= gb, F.concat(F.lit("~"), fixed(size / gb), F.lit(" GB"))).when(size >= mb, F.concat(F.lit("~"), fixed(size / mb), F.lit(" MB"))).otherwise(F.concat(F.lit("~"), F.round(size / 1024).cast("long").cast("string"), F.lit(" KB"))))
    grade = rate_class(kbps)
    return meta.withColumns({"summary": F.concat_ws(" · ", codec, rate), "bitrate_class": grade, "size_text": size_text, "is_large": F.coalesce("lossless", F.lit(False)) | F.coalesce(kbps >= 1000, F.lit(False))})


# Fixed: labels of the fields that a client shows, in its order.
SHOWN = (
    ("container", "Container"), ("codec", "Codec"), ("codec_profile", "Profile"), ("bitrate", "Bitrate"), ("sample_rate", "Sample Rate"), ("bits_per_sample", "Bit Depth"),
    ("lossless", "Lossless"), ("channels", "Channels"), ("estimated_bitrate", "Est. Bitrate"), ("duration", "Duration"), ("frequency_cutoff", "Freq. Cutoff"), ("quality_mismatch", "Quality Match"),
)


def rate_class(kbps: Column) -> Column:
    return F.when(kbps >= 1000, "lossless").when(kbps >= 320, "hq").when(kbps >= 192, "cd").when(kbps.isNotNull(), "lq").otherwise("secondary")


def _shown(field: str) -> tuple[Column, Column]:
    """(text, class) of a field as a client shows it; a null text hides it."""
    value, plain = F.col(field), F.lit("secondary")
    if field == "bitrate":
        return some(value), rate_class(leading_number(value))
    if field == "estimated_bitrate":
        return F.when(value > 0, F.concat(F.round(value).cast("long").cast("string"), F.lit(" kbps"))), rate_class(value)
    if field == "lossless":
        return F.when(value, "Yes").when(~value, "No"), F.when(value, "lossless").otherwise("secondary")
    if field == "quality_mismatch":
        return F.when(value, "Mismatch").when(~value, "OK"), F.when(value, "lq").otherwise("full")
    if field == "duration":
        seconds = some(F.regexp_extract(value.cast("string"), r"^\s*(\d+(?:\.\d+)?)", 1)).cast("double")
        text = F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))
        return F.when(seconds > 0, text), plain
    if field == "frequency_cutoff":
        return F.when(value > 0, F.concat(F.round(value).cast("long").cast("string"), F.lit(" Hz"))), plain
    return some(value.cast("string")), plain


def metadata_details(meta: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows ``(keys, ord, field, label, value, variant)`` of the fields that are there, as a client shows them."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(label).alias("label"), _shown(f)[0].alias("value"), _shown(f)[1].alias("variant")) for i, (f, label) in enumerate(SHOWN) if f in meta.columns]
    return meta.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").filter("value is not null")


def sniffed_type(content: Column) -> Column:
    """The media type that the first bytes show; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    box = F.substring(head, 9, 8)
    return (
        F.when(head.startswith("4F676753") | ((F.length(head) < 8) & head.startswith("4F")), "audio/ogg")
        .when(head.startswith("664C6143"), "audio/flac")
        .when(head.startswith("52494646") & ((F.length(head) < 24) | head.endswith("57415645")), "audio/wav")
        .when(head.startswith("494433") | head.rlike("^FF[EF]"), "audio/mpeg")
        .when(box.isin("66747970", "6D6F6F76", "6D646174", "66726565", "736B6970", "77696465", "706E6F74"), "audio/mp4")
    )


def declared_type(content_type: Column, url: Column, disposition: Column) -> Column:
    """The type that a server means: corrected, or by the extension of the file name, then of the address."""
    base = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))

    def by_extension(name: Column) -> Column:
        ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
        out = F.lit(None).cast("string")
        for e, kind in BY_EXTENSION.items():
            out = F.when(ext == e, kind).otherwise(out)
        return out

    name = strip(F.regexp_extract(disposition, "(?i)filename\\*?=(?:UTF-8'')?[\"']?([^;\\n\"']+)", 1))
    path = F.regexp_replace(url, r"[?#].*$", "")
    generic = F.coalesce(by_extension(name), by_extension(path), F.lit("audio/mpeg"))
    out = F.when(base.isin(*GENERIC), generic).otherwise(base)
    for wrong, right in CORRECTED.items():
        out = F.when(base == wrong, right).otherwise(out)
    return out


def audit_formats(files: DataFrame) -> DataFrame:
    """``files`` (content, content_type, content_disposition, url) with ``sniffed``, ``declared`` and ``mismatch``."""
    out = files.withColumns({"sniffed": sniffed_type(F.col("content")), "declared": declared_type(F.col("content_type"), F.col("url"), F.col("content_disposition"))})
    return out.withColumn("mismatch", F.coalesce(F.col("sniffed") != F.col("declared"), F.lit(False)))
