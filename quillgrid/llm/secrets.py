"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs).
The documents' postings for the trigrams that any rule mentions are intersected per
clause; only texts that satisfy a clause are verified with the rule's expression. Rules
without mandatory trigrams scan every text.

Postings are keyed by a hash of the text, so that copies share their postings and a
collision only costs a needless verification. Null texts count as empty; null ids,
repeated rows and extra columns pass through (only id and text are read).
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import free_name, match_spans, materialise, ranked_spans, span_digest, table


@dataclass(frozen=True)
class Rule:
    """``min_group``: (group, least characters) that a match must have, else it is dropped."""

    kind: str
    pattern: str
    min_group: tuple[int, int] | None = None


#: The three base kinds in their listed order, then the added ones. Greedy runs of one
#: class keep their matches when the least length is put into the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 6)),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")

#: Beyond so many alternatives a part of an expression counts as "any text".
MAX_BRANCHES = 96
#: Character classes of up to so many characters are spelled out.
MAX_CLASS = 6


def _join(lefts: list[list[str]], rights: list[list[str]]) -> list[list[str]]:
    """Concatenates two lists of alternatives; each one is a list of literal runs."""
    if len(lefts) * len(rights) > MAX_BRANCHES:
        return [[*a, ""] for a in lefts]
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in lefts for b in rights]


def _alternatives(parsed) -> list[list[str]]:
    out = [[""]]
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = [[chr(arg).lower()]]
        elif op is sre.SUBPATTERN:
            part = _alternatives(arg[-1])
        elif op is sre.BRANCH:
            part = [a for choice in arg[1] for a in _alternatives(choice)]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= MAX_CLASS:
            part = [[c] for c in sorted({chr(v).lower() for _, v in arg})]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = _alternatives(body)
            if (low, high) == (0, 1):
                part = [[""], *inner]
            elif low == 0:
                part = [["", ""]]
            else:  # the body at least once, then unknown text
                part = [[*a, ""] for a in inner] if high > 1 else inner
        elif op is sre.AT:
            part = [[""]]
        else:
            part = [["", ""]]
        out = _join(out, part)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams; a match holds all of at least one. Empty: no such query."""
    clauses = set()
    for runs in _alternatives(sre_parser.parse(pattern)):
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return []
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def trigram_postings(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """Postings ``(gram, key)``: which texts (by hash) hold which trigrams of the vocabulary."""
    low = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(vocabulary)]))
    return low.select("key", F.explode(held).alias("gram"))


def vocabulary_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that any rule mentions, sorted."""
    return sorted({g for rule in rules for clause in trigram_query(rule.pattern) for g in clause})


def index_postings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The postings ``(gram, key)`` of all texts, written under ``path`` to be reused by later scans.

    Here grams are trigrams, so that an index serves every rule set whose trigrams it has;
    it holds as many rows as texts have trigrams of ``rules``. New documents are added by
    writing theirs beside it. Mode is "error": an index is never replaced.
    """
    grams = F.array(*[F.lit(g) for g in vocabulary_of(rules)])
    named = trigram_postings(docs, vocabulary_of(rules), text_col).select(F.get(grams, F.col("gram")).alias("gram"), "key")
    named.distinct().write.parquet(path)
    return docs.sparkSession.read.schema("gram string, key long").parquet(path)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """``(key, mask)``: bit r is set if the text with that hash satisfies rule r's query.

    ``postings`` of :func:`index_postings` save the pass over the texts; they must cover
    all texts and the rules' trigrams.
    """
    spark = docs.sparkSession
    queries = [(r, clause) for r, rule in enumerate(rules) for clause in trigram_query(rule.pattern)]
    if not queries:
        return spark.createDataFrame([], "key long, mask long")
    vocabulary = vocabulary_of(rules)
    terms = [(vocabulary.index(g), c, r, 1 << i, len(clause)) for c, (r, clause) in enumerate(queries) for i, g in enumerate(sorted(clause))]
    # the rule list bounds this table, not the data
    lookup = F.broadcast(spark.createDataFrame(terms, "gram int, clause int, rule int, bit long, need int"))
    if postings is None:
        found = trigram_postings(docs, vocabulary, text_col)
    else:
        numbers = F.broadcast(spark.createDataFrame([*enumerate(vocabulary)], "number int, gram string"))
        found = postings.join(numbers, "gram").select("key", F.col("number").alias("gram"))
    met = (
        found.join(lookup, "gram")
        .groupBy("key", "clause", "rule", "need")
        .agg(F.bit_or("bit").alias("bits"))
        .filter(F.bit_count("bits") == F.col("need"))
    )
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def _rule_spans(text: Column, rule: Rule) -> Column:
    spans = match_spans(text, rule.pattern)
    if rule.min_group:
        group, least = rule.min_group
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], rule.pattern, group)) >= least)
    return spans


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out_col: str = "findings", postings: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``out_col``: array of (start, rank, end, kind, hit), by start, then rule order.

    Offsets are code points, end exclusive. Null and empty texts have no findings. A column
    called like ``out_col`` is replaced. The candidate table is written once; the planner
    broadcasts it if its size allows, otherwise it joins by the text's hash, where skewed
    hashes are split.
    """
    key, mask = free_name(docs, "secret_key"), free_name(docs, "secret_mask")
    found = materialise(candidates(docs, rules, text_col, postings), "secret-candidates").withColumnsRenamed({"key": key, "mask": mask})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(text)).join(found, key, "left").drop(key)
    met = F.coalesce(F.col(mask), F.lit(0))
    kinds = []
    for i, rule in enumerate(rules):
        spans = _rule_spans(text, rule)
        if trigram_query(rule.pattern):
            spans = F.when(met.bitwiseAND(F.lit(1 << i)) != 0, spans)
        kinds.append(ranked_spans(spans, i, rule.kind))
    return keyed.withColumn(out_col, F.array_sort(reduce(lambda a, b: F.concat(a, b), kinds))).drop(mask)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by ``mark``; overlapping findings get one mark."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["pos"],
        F.struct(
            s["end"].alias("pos"),
            F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark)).alias("out"),
        ),
    ).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "findings")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(span_digest(base).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    """The base and added spans by splitting each text at the matches; DuckDB's counterpart."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    hits, spans = [], []
    for i, rule in enumerate(RULES):
        p = quote(rule.pattern)
        hits.append(f"regexp_extract_all(t, {p}) AS m{i}, string_split_regex(t, {p}) AS g{i}")
        span = f"list_transform(range(1, len(m{i}) + 1), lambda k: {{'a': list_sum(list_transform(g{i}[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m{i}[1:k-1], lambda x: length(x))), 0)::BIGINT, 'r': {i}, 'n': length(m{i}[k]), 'h': m{i}[k], 'kind': '{rule.kind}'}})"
        if rule.min_group:
            span = f"list_filter({span}, lambda s: length(regexp_extract(s.h, {p}, {rule.min_group[0]})) >= {rule.min_group[1]})"
        spans.append(span)
    digest = lambda x: f"array_to_string(list_transform({x}, lambda s: s.kind || ':' || s.a || ':' || (s.a + s.n)), ',')"
    base = f"list_filter(f, lambda s: s.r < {len(BASE)})"
    counts = ", ".join(f"len(list_filter(f, lambda s: s.r = {i}))::BIGINT AS n_{k}" for i, k in enumerate(BASE))
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, " + ", ".join(hits) + " FROM d), f AS (SELECT doc_id, list_sort(list_concat("
        + ", ".join(spans) + f")) AS f FROM h) SELECT doc_id, {counts}, sha256({digest(base)}) AS base_sha256, {digest('f')} AS spans FROM f"
    )


OP1_SQL = _sql()
