"""Column functions on names, notes and keys. A missing result is null, never ''."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def some(col: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(col, F.lit(""))


#: White space of any script, as sheets hold no-break spaces.
BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The same characters as text.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col, F.lit(BLANKS))


def squash(col: Column) -> Column:
    """Stripped, and runs of white space as one blank; most texts have none but single blanks."""
    other = BLANK.replace(r"\s", r"\t-\r")
    return strip(F.when(col.rlike(rf"  |{other}"), F.regexp_replace(col, f"{BLANK}+", " ")).otherwise(col))


def lines(col: Column) -> Column:
    """The stripped lines of a text."""
    return F.transform(F.split(col, "\n"), strip)


def unwrap_parens(col: Column) -> Column:
    inner = col.startswith("(") & col.endswith(")") & (F.length(col) > 1)
    return F.when(inner, strip(F.substring(col, F.lit(2), F.length(col) - 2))).otherwise(col)


# ---------------------------------------------------------------- names

# Fixed: emoji -> badge. A variation selector may follow.
BADGES = {"⭐": "best", "💎": "best", "✨": "special", "🗑": "worst", "🏆": "grail", "🏅": "wanted", "🥇": "wanted", "🥉": "wanted", "🤖": "ai"}
DECORATIONS = "💿🎵🎶🔥"
_BADGE = rf"^\s*[{DECORATIONS}]*\s*({'|'.join(BADGES)})\x{{FE0F}}?\s*"

# Fixed: what counts as a version tag.
TAG = r"(?i)\[(V\d+(?:-V?\d+|-V?\?)?|V\?|Alt\.?|Radio Mix|Unfinished|MASTER|CD VERSION|Album|Clean|Song \d+)\]"


def badge(name: Column) -> Column:
    """The badge of a leading emoji, after optional decorations."""
    emoji = F.regexp_extract(name, _BADGE, 1)
    out = F.lit(None).cast("string")
    for e, kind in BADGES.items():
        out = F.when(emoji == e, kind).otherwise(out)
    return out


def without_badge(name: Column) -> Column:
    return strip(F.regexp_replace(name, _BADGE, ""))


def version_tag(name: Column) -> Column:
    """The first version tag, without its brackets."""
    return some(F.regexp_extract(name, TAG, 1))


def without_tag(name: Column) -> Column:
    """The name without its first version tag; what stands on both sides is joined by a blank."""
    joined = lambda parts: F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), " ")
    return let(F.split(name, TAG, 2), lambda parts: F.when(F.size(parts) > 1, joined(parts)).otherwise(strip(parts[0])))


# Fixed: credit forms in a name.
CREDITS = {"featuring": r"(?i)\((?:feat\.?|featuring|ft\.?)\s+(.+?)\)", "producers": r"(?i)\(prod\.?\s+(.+?)\)", "collaboration": r"(?i)\(with\s+(.+?)\)", "refs": r"(?i)\(ref\.?\s+(.+?)\)"}


def credit(name: Column, kind: str) -> Column:
    """All credits of a kind, joined by ', '."""
    return some(F.array_join(F.regexp_extract_all(name, F.lit(CREDITS[kind]), F.lit(1)), ", "))


def without_credits(name: Column) -> Column:
    for pattern in CREDITS.values():
        name = F.regexp_replace(name, pattern, "")
    return name


def title(name: Column) -> Column:
    """The first line of a name without credits."""
    return F.element_at(lines(without_credits(name)), 1)


def alt_titles(name: Column) -> Column:
    """The other non-empty lines, freed of wrapping parentheses."""
    return other_lines(lines(without_credits(name)))


def other_lines(rest: Column) -> Column:
    """Of the lines of a name without credits those after the first that are not empty, freed of wrapping parentheses."""
    return F.transform(F.filter(F.slice(rest, F.lit(2), F.size(rest)), lambda x: x != ""), unwrap_parens)



def initials(name: Column, most: int = 3) -> Column:
    """Upper-case first letters of the first words."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.upper(F.substring(w, 1, 1))), "")


# ---------------------------------------------------------------- keys


@cache
def accent_map() -> tuple[str, str]:
    """Letters that decompose to one base letter, and these letters, from the Unicode tables."""
    plain = {}
    for code in range(0xA0, 0x2C00):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


@cache
def combining_class() -> str:
    """A regular-expression class of combining marks."""
    marks = [c for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c))]
    runs, start = [], marks[0]
    for a, b in zip(marks, [*marks[1:], None], strict=True):
        if b != a + 1:
            runs.append(rf"\x{{{start:X}}}-\x{{{a:X}}}")
            start = b
    return f"[{''.join(runs)}]"


def without_accents(col: Column) -> Column:
    return F.when(F.octet_length(col) != F.length(col), F.regexp_replace(F.translate(col, *accent_map()), combining_class(), "")).otherwise(col)


def full_key(name: Column) -> Column:
    return strip(F.lower(without_accents(name)))


PUNCTUATION = ",.:;!?'\""


def match_key(name: Column) -> Column:
    """Key for matching names: up to the first parenthesis (or inside a leading one), without
    version tags, trailing asterisks, accents, case and punctuation."""

    at, close = F.instr(name, "("), F.instr(name, ")")
    outside = F.when(at > 1, F.substring(name, F.lit(1), at - 1)).when((at == 1) & (close > 1), F.substring(name, F.lit(2), close - 2)).otherwise(name)
    tagged = F.when(name.contains("["), F.regexp_replace(strip(outside), TAG, "")).otherwise(outside)
    bare = F.when(name.contains("*"), F.regexp_replace(strip(tagged), r"\*+$", "")).otherwise(tagged)
    return squash(F.translate(F.lower(without_accents(strip(bare))), PUNCTUATION, " " * len(PUNCTUATION)))


def slug(name: Column) -> Column:
    out = F.regexp_replace(strip(F.lower(name)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def acronym(key: Column) -> Column:
    """First letters of a key of three words or more."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    return F.when(F.size(words) >= 3, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


# ---------------------------------------------------------------- notes

# Fixed: forms of an original file's name and of a sample in notes.
OG_FILENAME = r"(?i)OG Filename(?:\s*\(Metadata\))?:\s*(.+?)(?:\n|\z)"
_SAMPLES = r"(?i)Samples\s+(?:[^\"“]+?\s+)?[\"“](.+?)[\"”](?:\s+by\s+(.+?))?(?:\.|,|\n|\z)|Samples\s+(.+?)'s\s+[\"'‘’](.+?)[\"'‘’]"


def og_filename(notes: Column) -> Column:
    return some(strip(F.regexp_extract(notes, OG_FILENAME, 1)))


def samples(notes: Column) -> Column:
    """Sampled works as ``"song" by artist``; an artist ends before ' and ', ' vs' or ' feat'."""
    hits = F.regexp_extract_all(notes, F.lit(_SAMPLES), F.lit(0))

    def one(hit: Column) -> Column:
        part = lambda g: some(strip(F.regexp_extract(hit, _SAMPLES, g)))
        artist = F.regexp_replace(part(2), r"(?i)\s+(?:and\s|vs\b|feat\b).*$", "")
        quoted = F.concat(F.lit('"'), F.coalesce(part(1), part(4)), F.lit('"'))
        by = F.coalesce(F.when(part(1).isNotNull(), artist), part(3))
        return F.concat_ws(" by ", quoted, by)

    return F.transform(hits, one)


def highlighted_producers(text: Column) -> Column:
    """Names of the lines that start with '- ', unknown ones left out."""
    named = F.filter(lines(text), lambda x: x.startswith("- "))
    names = F.transform(named, lambda x: strip(F.substring(x, F.lit(3), F.length(x))))
    return F.filter(names, lambda x: ~x.isin("", "???", "N/A"))


def timeline(text: Column) -> Column:
    """Events of lines ``(date) event`` as array<struct<date,event>>; both must be there."""
    form = r"^\(([^)]+)\)\s*(.*)"
    dated = F.filter(lines(text), lambda x: x.rlike(form))
    events = F.transform(dated, lambda x: F.struct(strip(F.regexp_extract(x, form, 1)).alias("date"), unwrap_parens(strip(F.regexp_extract(x, form, 2))).alias("event")))
    return F.filter(events, lambda e: (e["date"] != "") & (e["event"] != ""))


def credit_notes(notes: Column) -> Column:
    """Notes without their lines that name an original file."""
    return some(F.array_join(F.filter(F.split(notes, "\n"), lambda x: ~F.lower(strip(x)).startswith("og filename")), "\n"))


# ---------------------------------------------------------------- plausible names

# Fixed labels and words that are no names of eras.
SECTION_LABELS = (
    "surfaced", "unsurfaced", "unavailable", "og files for released songs & alternate versions", "og files for released songs", "unknown collaborations",
    "features", "collaborations", "collaboration", "featured", "collaborations & features", "loosies", "guest verses", "guest features",
    "throwaways", "throwaway", "demos", "demo", "snippets", "snippet", "snippets/unavailable", "production", "productions", "other media", "other",
    "instrumentals", "instrumental", "remixes", "remix", "stems", "stem bounces", "interludes", "interlude", "skits", "skit", "leaks", "leaked",
    "unreleased", "released", "pre-release", "pre release", "live performances", "live", "recordings", "full", "partial", "og files",
    "og files for released songs + alternate mixes", "alternate mixes",
)
NOT_ERAS = (
    "links", "link", "changelog", "changelogs", "notes", "tracker guidelines", "guidelines", "discord", "credits", "editors", "current editors",
    "update notes", "resources", "template", "template:", "about", "info", "key", "legend", "recent additions", "what's new", "what's new?",
    "types", "type", "owner", "general information", "release date", "updates", "mega folder", "performance tracks", "progress reports", "rules",
    "highlighted", "current editor", "editor comments", "features", "collaborations", "collaboration", "featured", "collaborations & features",
    "loosies", "guest verses", "guest features",
)
FOOTER_WORDS = (
    "total links", "total link", "total full", "changelogs", "changelog", "tracker guidelines", "unreleased guidelines", "current tracker editors",
    "editor comments", "current editors", "progress reports", "want to contribute", "update notes", "spreadsheet data", "guide & information",
    "link & invites", "whole spreadsheet data", "availability summary", "other trackers", "trackerhub", "file hosting",
)
HUB_LABELS = ("carti tracker hub",)
ERA_STATS = r"(?i)\d+\s+(?:OG File|Total Full|Full|Tagged|Partial|Snippet|Stem|Unavailable|Edited|of Leaks|of Snippets|of Partials|of Recordings|of Unavailable|of Full|Leaks?|Snippets?|Partials?|Streaming|Off-Streaming|Off Streaming|On Streaming|On-Streaming|tracks?|songs?|Released|Deleted|Lost|Privated)"


def plausible_era_name(text: Column) -> Column:
    """Whether a text can be the name of an era, rather than an announcement, label or footer."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    def judge(s: Column) -> Column:
        """Of (n_lines, whole first line, the same up to a parenthesis)."""
        whole, first = s["whole"], s["first"]
        low, low_whole = F.lower(first), F.lower(whole)
        refused = (
            (s["n"] >= 3)
            | (whole == "")
            | (whole.rlike(r"@\w+") & (words(whole) <= 4))
            | (low_whole.rlike(r"\.\w{2,4}\b") & low_whole.rlike(r"\.(?:icu|su|gg|com|net|org|io)"))
            | (words(first) > 10)
            | (F.length(first) > 80)
            | first.endswith(":")
            | low.isin(*NOT_ERAS)
            | low.startswith("collaboration with")
            | low.rlike("tracker|^skip to |click to view|click here|discord\\.gg/|discord\\.com/|https?://|\\.gg/|playlist|spotify|sent all|onlyfiles")
            | low.rlike("^(?:added|removed|updated|renamed|started|finished) ")
            | first.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}|^\d{4}-\d{1,2}-\d{1,2}|^\d{1,2}/\d{1,2}\s*[-–]|^\d{1,3}$|^\*")
            | (first.rlike(r"@\w+") & (words(first) <= 3))
            | (F.regexp_count(first, F.lit("!")) >= 2)
            | first.rlike("^(?:" + ERA_STATS + ")")
        )
        return ~refused & (words(first) >= 1)

    def cut(s: Column) -> Column:
        at = F.instr(s["whole"], "(")
        first = F.when(at > 1, strip(F.substring(s["whole"], F.lit(1), at - 1))).otherwise(s["whole"])
        return let(F.struct(s["n"].alias("n"), s["whole"].alias("whole"), first.alias("first")), judge)

    rows = F.filter(lines(text), lambda x: x != "")
    return let(rows, lambda r: let(F.struct(F.size(r).alias("n"), F.coalesce(F.get(r, F.lit(0)), F.lit("")).alias("whole")), cut))


# Fixed: names of eras that a sweep reports as bogus.
BOGUS = r"(?i)^changelog|^update\s*(?:notes|log)|^recent\s*(?:additions|changes)|^credits?$|^(?:current\s+)?editors?$|^(?:tracker\s+)?guidelines?|^discord$|^links?$|^resources?$|^template|^about$|^info$|^key$|^legend$|^navigation|^table\s*of\s*contents|^what['’]?s\s+new|^announcements?$|^total\s+(?:full|links|leaks)"
