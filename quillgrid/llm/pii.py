"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base kinds) and from looser ones. Four
labelers vote on each candidate (1, 0 for none, -1): its shape by regular expressions, a
gazetteer (domains, address ranges, issuers, dial and area codes, countries), the context
on both sides, and a checksum or count. None of them is fixed by the kind.
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability and each candidate's probability. A logistic span classifier is trained on
these probabilities; it sees features of the span beside the votes and decides on the
looser candidates. Base spans always stay, with their score.

Texts are read once by column functions; the candidates (no texts) are written, their
patterns counted. Only these counts reach the driver: at most
kinds * 3**labelers * 12 span features, about 9000 rows, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import match_spans, materialise, ranked_spans, span_digest, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_masked", "card_loose", "phone_local", "national_id", "iban")

# Fixed patterns. Those of the base kinds match what the plain ones match: a run can only
# be matched from its start, so look-behinds and possessive runs save the other starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,5}+",
    "card_loose": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{15,16}(?![0-9])",
    "phone_local": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Tested first, as the pattern itself begins with a wide class: one of these must be there.
GUARDS = {"email": ("@",), "email_masked": ("at]", "at)", "AT]", "AT)"), "phone": ("+",)}
#: The other kinds have a digit in every match, so texts without digits are not searched for them.
WITHOUT_DIGITS = ("email", "email_masked")

#: Kinds whose matches must pass a further test.
CHECKED = ("ip", "card", "phone")

# Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = (
    "com", "org", "net", "edu", "gov", "info", "io", "biz", "app", "dev", "int", "mil",
    "at", "au", "be", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "hu", "ie", "in", "it", "jp", "kr", "mx", "nl", "no", "nz", "pl", "pt", "ro", "ru", "se", "tr", "ua", "uk", "us", "za",
)
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
DIAL_CODES = r"^(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])"
#: Three digits of area and three of exchange, as in North America: neither begins with 0 or 1 nor ends with 11.
AREA = r"^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}"
SPECIAL_IPS = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.2|198\.51\.100|203\.0\.113|22[4-9]|2[3-5][0-9])\."
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|contact|ring)\b",
    "national": r"(?i)\b(?:ssn|social|security|id|tax|taxpayer)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
AGAINST = r"(?i)\b(?:isbn|version|invoice|order|sku|model|part|serial|no|nr)[.:# ]*$"
#: Characters beside a span that say code, tables or noise rather than prose.
NOISE_BEFORE, NOISE_AFTER = r"[0-9=#/\\|<>{}\[*&%$][ ]*$", r"^[ ]*[0-9=#/\\|<>{}\]*&%$]"
PROSE_BEFORE, PROSE_AFTER = r"(?:^|\p{L}[.,;:!?]?\s+)$", r"^[.,;:!?)]?(?:\s+\p{L}|\s*$)"
#: Characters on each side of a span that the context labeler reads.
CONTEXT_CHARS = 32
LABELERS = ("shape", "gazetteer", "context", "checksum")
SHAPES = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?(?:@| ?[\[(](?:at|AT)[\])] ?).*[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[0-9]+$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*$|^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$",
    "national": r"^[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}$",
    "iban": r"^[A-Z0-9]+$|^[A-Z0-9]{4}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$",
}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add)
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return luhn(_digits(hit))
    return F.length(_digits(hit)).between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def iban_ok(compact: Column) -> Column:
    """Whether the check digits of an account number without blanks are right (remainder 1 modulo 97)."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _varied(digits: Column) -> Column:
    return F.size(F.array_distinct(F.split(digits, ""))) > 2


def _votes(family: str, hit: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(hit)
    if family == "email":
        known = F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
        fits = (F.length(hit) <= 254) & ~hit.contains("..") & ~hit.rlike("^[^@]{65,}@")
    elif family == "ip":
        known, fits = ~hit.rlike(SPECIAL_IPS), ~(before.rlike(r"[0-9]\.$") | after.rlike(r"^\.[0-9]"))
    elif family == "card":
        known, fits = digits.rlike(ISSUERS), luhn(digits)
    elif family == "phone":
        abroad = hit.startswith("+") & ~digits.startswith("1")
        national = F.when(hit.startswith("+"), F.substring(digits, F.lit(2), F.lit(15))).otherwise(digits)
        known = F.when(abroad, digits.rlike(DIAL_CODES)).otherwise(national.rlike(AREA))
        fits = F.length(digits).between(10, 13) & _varied(digits)
    elif family == "national":
        known, fits = ~digits.rlike("^(?:000|666|9)|^...00|0000$"), _varied(digits)
    else:
        compact = F.replace(hit, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        known, fits = F.coalesce(F.element_at(lengths, F.substring(hit, 1, 2)) == F.length(compact), F.lit(False)), iban_ok(compact)
    against = before.rlike(AGAINST) | before.rlike(NOISE_BEFORE) | after.rlike(NOISE_AFTER)
    said = before.rlike(CONTEXT[family]) | after.rlike(CONTEXT[family])
    prose = before.rlike(PROSE_BEFORE) & after.rlike(PROSE_AFTER)
    shape = hit.rlike(SHAPES[family])
    return [_vote(shape, ~shape), _vote(known, ~known), F.when(said & ~before.rlike(AGAINST), 1).when(against, -1).when(prose, 1).otherwise(0), _vote(fits, ~fits)]


def _features(hit: Column, before: Column, after: Column) -> list[Column]:
    """Of a span: whether it stands alone on its line, whether most of it are digits, how it is divided (0, 1, more)."""
    alone = before.rlike(r"(?:^|\n)[ ]*$") & after.rlike(r"^[ ]*(?:\n|$)")
    dense = F.length(_digits(hit)) * 4 >= F.length(hit) * 3
    marks = F.length(F.regexp_replace(hit, "[A-Za-z0-9]", ""))
    return [alone.cast("int"), dense.cast("int"), F.least(marks, F.lit(2))]


def _apart_from(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span, by kind, then start.

    One walk over both by position: base spans count from their start on, a loose one is
    judged at its end, by the furthest end of the base spans met so far.
    """
    event = lambda at, kind: lambda s: F.struct(s[at].alias("at"), F.lit(kind).alias("is_base"), s.alias("s"))
    events = F.array_sort(F.concat(F.transform(base, event("start", 1)), F.transform(loose, event("end", 0))))

    def step(acc: Column, e: Column) -> Column:
        s = e["s"]
        kept = F.concat(acc["kept"], F.array(F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s.alias("s"))))
        return F.struct(
            F.when(e["is_base"] == 1, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"]).alias("reach"),
            F.when((e["is_base"] == 0) & (acc["reach"] <= s["start"]), kept).otherwise(acc["kept"]).alias("kept"),
        )

    span = "start:int,rank:int,end:int,kind:string,hit:string"
    start = F.struct(F.lit(0).alias("reach"), F.expr(f"cast(array() as array<struct<rank:int,start:int,s:struct<{span}>>>)").alias("kept"))
    return F.aggregate(events, start, step, lambda acc: F.transform(F.array_sort(acc["kept"]), lambda k: k["s"]))


def candidate_spans(text: Column) -> Column:
    """Candidates of all kinds, by kind, then start; loose ones where no base span is."""

    def spans_of(kinds: tuple[str, ...]) -> Column:
        found = {}
        for kind in kinds:
            spans = match_spans(text, PATTERNS[kind])
            if kind in GUARDS:
                spans = F.when(reduce(lambda a, b: a | b, [text.contains(g) for g in GUARDS[kind]]), spans)
            if kind in CHECKED:
                spans = _checked(spans, kind)
            found[kind] = ranked_spans(spans, KINDS.index(kind), kind)
        whole = F.struct(F.concat(*[found[k] for k in kinds if k in BASE]).alias("base"), F.concat(*[found[k] for k in kinds if k not in BASE]).alias("loose"))
        return F.get(F.transform(F.array(whole), lambda w: F.concat(w["base"], _apart_from(w["loose"], w["base"]))), F.lit(0))

    return F.when(text.rlike("[0-9]"), spans_of(KINDS)).otherwise(spans_of(WITHOUT_DIGITS))


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["hit"]))


def with_votes(text: Column, spans: Column) -> Column:
    """Adds ``votes`` of the labelers and ``marks``, the span's features."""

    def one(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        sides = F.struct(F.substring(text, low + 1, s["start"] - low).alias("before"), F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS)).alias("after"))

        def judged(c: Column) -> Column:
            family, votes = F.split(s["kind"], "_")[0], F.lit(None)
            for name in CONTEXT:
                votes = F.when(family == name, F.array(*_votes(name, s["hit"], c["before"], c["after"]))).otherwise(votes)
            marks = F.array(*_features(s["hit"], c["before"], c["after"]))
            return F.struct(s["start"], s["rank"], s["end"], s["kind"], s["hit"], votes.alias("votes"), marks.alias("marks"))

        return F.get(F.transform(F.array(sides), judged), F.lit(0))

    return F.transform(spans, one)


def estimate(counts: Sequence[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count).

    Gives each pattern's probability of being personal data, and the reliabilities: for each
    labeler and class the probabilities of its votes. Starts from the vote sums.
    """
    patterns = [(k, v, n) for k, v, n in counts if n > 0]
    kinds = sorted({k for k, _, _ in patterns})
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    rates: dict = {}
    for _ in range(rounds):
        prior = {}
        for kind in kinds:
            mine = [(v, n) for k, v, n in patterns if k == kind]
            prior[kind] = (1 + sum(n * post[kind, v] for v, n in mine)) / (2 + sum(n for _, n in mine))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                mass = {x: 1.0 + (2.0 if x == 2 * y - 1 else 0.0) for x in (-1, 0, 1)}  # labelers are taken to lean the right way
                for k, v, n in patterns:
                    mass[v[j]] += n * (post[k, v] if y else 1 - post[k, v])
                whole = sum(mass.values())
                rates[j, y] = {x: m / whole for x, m in mass.items()}
        for k, v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(rates[j, 1][x] / rates[j, 0][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


MARKS = ("alone", "dense", "divided")


def train_classifier(counts: Sequence[tuple[str, tuple[int, ...], tuple[int, ...], int]], post: dict, steps: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Logistic weights of a bias, the labelers' two votes and the span's features within its family, from soft labels.

    Over (kind, votes, marks, count). Families weigh alike, however many candidates they have.
    """
    family = lambda k: k.split("_")[0]
    names = lambda k, v, f: ["bias", *[f"{LABELERS[j]}:{x}" for j, x in enumerate(v) if x], *[f"{family(k)}:{MARKS[j]}:{x}" for j, x in enumerate(f) if x]]
    sizes: dict[str, int] = {}
    for k, _, _, n in counts:
        sizes[family(k)] = sizes.get(family(k), 0) + n
    weights: dict[str, float] = {}
    for _ in range(steps):
        grad: dict[str, float] = {}
        for k, v, f, n in counts:
            named = names(k, v, f)
            z = sum(weights.get(x, 0.0) for x in named)
            d = n / sizes[family(k)] / len(sizes) * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - post[k, v])
            for x in named:
                grad[x] = grad.get(x, 0.0) + d
        for x, g in grad.items():
            weights[x] = weights.get(x, 0.0) * (1 - 1e-4) - rate * g
    return weights


def _score(span: Column, weights: dict[str, float]) -> Column:
    z = F.lit(weights.get("bias", 0.0))
    for j, name in enumerate(LABELERS):
        z = z + F.when(span["votes"][j] == 1, weights.get(f"{name}:1", 0.0)).when(span["votes"][j] == -1, weights.get(f"{name}:-1", 0.0)).otherwise(0.0)
    of_span = {k: w for k, w in weights.items() if k.count(":") == 2}
    if of_span:
        table_ = F.create_map(*[F.lit(x) for pair in sorted(of_span.items()) for x in pair])
        for j, name in enumerate(MARKS):
            z = z + F.coalesce(F.element_at(table_, F.concat(F.split(span["kind"], "_")[0], F.lit(f":{name}:"), span["marks"][j].cast("string"))), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, findings)``: array of (start, rank, end, kind, hit, score), by kind, then start.

    Offsets are code points, end exclusive. Null and empty texts have no findings; null ids
    and repeated rows are kept as they are; other columns are not read. Without any
    candidate nothing is trained and the result has empty findings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.select(F.col(id_col), text.alias("_text"), candidate_spans(text).alias("_spans"))
    found = materialise(spans.select(id_col, with_votes(F.col("_text"), F.col("_spans")).alias("found")), "pii-candidates")
    votes = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.marks").count()
    counts = sorted((r["kind"], tuple(r["votes"]), tuple(r["marks"]), r["count"]) for r in votes.collect())
    patterns: dict = {}
    for k, v, _, n in counts:
        patterns[k, v] = patterns.get((k, v), 0) + n
    post, _ = estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    weights = train_classifier(counts, post)
    scored = F.transform("found", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["hit"], _score(s, weights).alias("score")))
    return found.select(id_col, F.filter(scored, lambda s: s["kind"].isin(*BASE) | (s["score"] >= threshold)).alias("findings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(span_digest(base).cast("binary"), 256).alias("base_sha256"), span_digest(F.col("findings")).alias("spans"))
