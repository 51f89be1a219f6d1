"""N-gram Jaccard join by prefix filtering under several global token orders.

Tokens are hashed word shingles. Under any global order of tokens, two sets whose Jaccard
similarity reaches the threshold share a token among the first n - ceil(t*n) + 1 of each;
so a candidate pair has to share a prefix token under every one of several orders. All
orders put tokens that occur in one set only first, for these can match nothing; the
orders then differ (document frequency; two hash orders).

The result is exact up to collisions of hashes: sets carry a 64-bit signature, tokens at
least 52 bits. Only tokens of two or more sets are kept after counting; these hold every
intersection, so that verification needs no text.

Groups are not expanded into all pairs. Equal sets collapse into one. Then each prefix
token's sets are matched against one pivot. Of sets that are in different components after
that, pairs are formed; where a token has many of these, only among those that also share
a prefix token of the second order, and where that is not enough, of the third: the filters
are intersected in the join's key. No link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import materialise, table
from quillgrid.llm.components import connected_components, name_components
from quillgrid.llm.shingles import mix, shingle_sets, signatures

U = np.uint64
#: Tokens for one group of the counting shuffle.
GROUP_TOKENS = 2_000_000
#: A token in more than this share of the sets (and more sets than the number) is hot: it
#: is counted before the shuffle. At most (mean set size / share) tokens can be hot.
HOT_SHARE, HOT_SETS = 0.005, 4096
#: Ranges of tokens are at most 2**MAX_BITS, for about 2 * 10**15 tokens.
MAX_BITS = 30
#: Tokens that are gathered before they are dealt to many ranges.
GATHER = 1 << 20
#: Pairs are formed among at most so many sets of one token. Above, the key gets another
#: order's token, which costs a row for each prefix token of the set (a quarter of its size).
CROWD = 4096


def _summaries(size: int, keep: list[str]):
    """Per row (id, signature, set size, further columns); per chunk the tokens that are frequent in it."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, sets in shingle_sets(texts, size):
                sigs = signatures(sets)
                n = len(sets)
                seen = {g: s for g, s in zip(sigs, sets, strict=True) if g is not None}
                toks, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True) if seen else (np.zeros(0, U), np.zeros(0, int))
                often = counts >= max(3, len(seen) / 200)
                toks, counts = toks[often], counts[often]
                m = len(toks)
                yield pa.record_batch(
                    {
                        "id": pa.concat_arrays([ids.slice(at, n).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                        "sig": pa.array(sigs + [None] * m, pa.int64()),
                        "n": pa.array([len(s) for s in sets] + [None] * m, pa.int32()),
                        "tok": pa.array([None] * n + toks.view(np.int64).tolist(), pa.int64()),
                        "cnt": pa.array([None] * n + counts.tolist(), pa.int64()),
                        **{k: pa.concat_arrays([batch.column(2 + i).slice(at, n), pa.nulls(m, batch.column(2 + i).type)]) for i, k in enumerate(keep)},
                    }
                )

    return run


def _packed(size: int, bits: int, hot: np.ndarray):
    """The sets, dealt to 2**bits ranges of tokens, as one row of bytes for each range.

    A token is the top 48 + bits bits of its hash, 64 at most; the range says the first
    ``bits``, so 6 bytes a token remain. Hot tokens go to ranges of their own, by signature.
    Sets are taken a chunk at a time, or several where there are more ranges than a chunk
    has tokens; a row with a single token has about 40 bytes.
    """
    shift, low, ranges = U(max(0, 16 - bits)), U(min(48, 64 - bits)), 1 << bits

    def gathered(batches):
        seen, held = {}, 0
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), size):
                for sig, s in zip(signatures(sets), sets, strict=True):
                    if sig is not None:
                        seen[sig] = s
                        held += len(s)
                if held >= min(GATHER, ranges):
                    yield seen
                    seen, held = {}, 0
        yield seen

    def run(batches):
        for seen in gathered(batches):
            if seen:
                sigs = np.fromiter(seen, dtype=np.int64, count=len(seen))
                lens = np.array([len(s) for s in seen.values()])
                toks, rows = np.concatenate(list(seen.values())), np.repeat(np.arange(len(sigs)), lens)
                out = []
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, toks), len(hot) - 1)] == toks
                    where = ranges + (sigs.view(np.uint64) % U(ranges)).astype(np.int64)[rows[is_hot]]
                    out.append((where, rows[is_hot], toks[is_hot] >> shift))
                    toks, rows = toks[~is_hot], rows[~is_hot]
                toks = toks >> shift
                out.append(((toks >> low).astype(np.int64), rows, toks))
                got = {"part": [], "sigs": [], "counts": [], "toks": []}
                for where, row, tok in out:
                    if not len(where):
                        continue
                    # rows are in order; few ranges sort by digits
                    order = np.argsort(where.astype(np.uint16) if bits < 15 else where, kind="stable")
                    where, row, tok = where[order], row[order], tok[order]
                    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                    for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                        new = np.flatnonzero(np.r_[True, row[a + 1 : b] != row[a : b - 1]])
                        got["part"].append(int(where[a]))
                        got["sigs"].append(sigs[row[a:b][new]].tobytes())
                        got["counts"].append(np.diff(np.r_[new, b - a]).astype(np.int32).tobytes())
                        got["toks"].append(np.ascontiguousarray(tok[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() if where[a] < ranges else tok[a:b].tobytes())
                yield pa.record_batch([pa.array(got["part"], pa.int32()), *(pa.array(got[k], pa.binary()) for k in ("sigs", "counts", "toks"))], names=list(got))

    return run


def _shared(bits: int, hot: np.ndarray, hot_df: np.ndarray):
    """Of one range: each set's tokens that occur in two sets or more, with their frequencies."""
    shift, low, ranges = U(max(0, 16 - bits)), U(min(48, 64 - bits)), 1 << bits
    hot_toks = hot >> shift

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)
        sigs, raw = np.repeat(join("sigs", np.int64), join("counts", np.int32)), join("toks", np.uint8)
        if part < ranges:
            toks = np.zeros((len(sigs), 8), dtype=np.uint8)
            toks[:, :6] = raw.reshape(-1, 6)
            toks = toks.reshape(-1).view(np.uint64) | (U(part) << low)
            order = np.argsort(toks)
            toks, sigs = toks[order], sigs[order]
            same = toks[1:] == toks[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            toks, sigs = toks[keep], sigs[keep]
        else:
            toks = raw.view(np.uint64)
        order = np.lexsort((sigs, toks))
        toks, sigs = toks[order], sigs[order]
        if len(toks):
            new = np.r_[True, (toks[1:] != toks[:-1]) | (sigs[1:] != sigs[:-1])]
            toks, sigs = toks[new], sigs[new]
        if part < ranges:
            counts = np.diff(np.r_[np.flatnonzero(np.r_[len(toks) > 0, toks[1:] != toks[:-1]]), len(toks)])
            df = np.repeat(counts, counts)
            toks, sigs, df = toks[df >= 2], sigs[df >= 2], df[df >= 2]
        else:
            df = hot_df[np.searchsorted(hot_toks, toks)] if len(toks) else np.zeros(0, np.int64)
        order = np.argsort(sigs, kind="stable")
        toks, sigs, df = toks[order], sigs[order], df[order]
        cuts = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[cuts, len(sigs)].astype(np.int32))
        return pa.table(
            {
                "sig": pa.array(sigs[cuts]),
                "toks": pa.ListArray.from_arrays(offsets, pa.array(toks.view(np.int64))),
                "dfs": pa.ListArray.from_arrays(offsets, pa.array(df.astype(np.int64))),
            }
        )

    return run


#: Tokens that are put in order at once (one set's at least).
ORDER_TOKENS = 1 << 20


def _prefixes(percent: int):
    """Per set (sig, n, toks, dfs): its tokens and its prefix under each order; sets that can match nothing are left out."""

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, lists = batch.column("n").to_numpy().astype(np.int64), batch.column("toks")
        lens = lists.value_lengths().to_numpy()
        single = n - lens
        room = n - np.ceil(percent * n / 100.0).astype(np.int64) + 1 - single
        toks, dfs = lists.flatten().to_numpy(), batch.column("dfs").flatten().to_numpy()
        row, starts = np.repeat(np.arange(len(n)), lens), np.cumsum(lens) - lens
        first = np.arange(len(toks)) - starts[row] < room[row]
        values, rooms = toks.view(np.uint64), np.clip(room, 0, lens)
        offsets = pa.array(np.r_[0, np.cumsum(rooms)].astype(np.int32))

        def prefix(*keys: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, pa.array(toks[np.lexsort((*keys, row))[first]]))

        cols = {"order1": prefix(toks, dfs), "order2": prefix(mix(values ^ U(2))), "order3": prefix(mix(values ^ U(3 << 32)))}
        out = pa.record_batch({"sig": batch.column("sig"), "n": batch.column("n"), "single": pa.array(single.astype(np.int32)), "toks": lists, **cols})
        return out.filter(pa.array(room > 0))

    def run(batches):
        for batch in batches:
            total = np.r_[0, np.cumsum(batch.column("toks").value_lengths().to_numpy())]
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] + ORDER_TOKENS, "right")) - 1)
                yield some(batch.slice(at, end - at))
                at = end

    return run


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """Least intersection with 100 * shared >= percent * union."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under the other orders too and reach the threshold.

    Only what the filters need is joined first; whole token lists travel for what they leave.
    """
    side = lambda s, *cols: sets.select(F.col("sig").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    both = pairs.join(side("a", "n", "order2", "order3"), "a").join(side("b", "n", "order2", "order3"), "b")
    left = both.filter(F.arrays_overlap("a_order2", "b_order2") & F.arrays_overlap("a_order3", "b_order3"))
    left = materialise(left.select("a", "b", _least_overlap(F.col("a_n"), F.col("b_n"), percent).alias("least")), "filtered-pairs")
    full = left.join(side("a", "toks"), "a").join(side("b", "toks"), "b")
    return full.filter(F.size(F.array_intersect("a_toks", "b_toks")) >= F.col("least")).select("a", "b")


def _pairs(rows: DataFrame, keys: list[str], fits) -> DataFrame:
    """Pairs (a, b) of sets of an equal key that lie in different components and pass the positional filter."""
    side = lambda s: rows.select(*keys, F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"p_{s}"), F.col("root").alias(f"r_{s}"))
    return side("a").join(side("b"), keys).filter((F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & fits("n_a", "p_a", "n_b", "p_b")).select("a", "b")


def _apart(entries: DataFrame, roots: DataFrame, sets: DataFrame, fits) -> DataFrame:
    """Pairs of sets that share a prefix token but no component.

    Tokens of more than ``CROWD`` such sets are joined on a prefix token of the second
    order too, then of the third. A pair that reaches the threshold shares all three.
    """
    rows = entries.join(roots, entries["sig"] == roots["node"], "left").select("tok", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
    keys, found = ["tok"], None
    for order in ("order2", "order3", None):
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("root").alias("_r0"), F.max("root").alias("_r1"))
        counts = materialise(counts.filter(F.col("_r0") != F.col("_r1")).select(*keys, "_c"), "mixed")
        rows = materialise(rows.join(counts, keys), "apart")
        few = rows if order is None else rows.filter(F.col("_c") <= CROWD)
        pairs = _pairs(few, keys, fits)
        found = pairs if found is None else found.union(pairs)
        crowded = rows.filter(F.col("_c") > CROWD).drop("_c")
        if order is None or crowded.isEmpty():
            break
        rows = crowded.join(sets.select("sig", F.explode(order).alias(order)), "sig")
        keys = [*keys, order]
    return found.distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``root``, ``component_id`` and the columns of ``keep``.

    ``root`` is equal for the rows of one component, whatever their ids, and null for rows
    without a set. ``keep`` columns must not be called id, text, sig, n, tok, cnt or root.
    """
    spark = docs.sparkSession
    keep = list(keep)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    schema = T.StructType([*T.StructType.fromDDL("id long, sig long, n int, tok long, cnt long").fields, *[T.StructField(f.name, f.dataType) for f in docs.select(*keep).schema.fields]])
    seen = materialise(rows.mapInArrow(_summaries(size, keep), schema), "shingle-summaries")
    of_rows = seen.filter(F.col("n").isNotNull()).select("id", "sig", "n", *keep)
    n_sets, n_tokens = of_rows.agg(F.count("sig"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(HOT_SETS, HOT_SHARE * n_sets)
    frequent = seen.filter(F.col("tok").isNotNull()).groupBy("tok").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= least).collect()
    hot = np.array([r["tok"] for r in frequent], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_df = hot[order], np.array([r["cnt"] for r in frequent], dtype=np.int64)[order]
    bits = min(MAX_BITS, max(4, int(np.ceil(np.log2(max(1, n_tokens / GROUP_TOKENS))))))

    shared = rows.select("text").mapInArrow(_packed(size, bits, hot), "part int, sigs binary, counts binary, toks binary").groupBy("part").applyInArrow(_shared(bits, hot, hot_df), "sig long, toks array<long>, dfs array<long>")
    of_sets = of_rows.filter(F.col("n") > 0).groupBy("sig").agg(F.min("id").alias("least_id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    tokens = shared.groupBy("sig").agg(F.flatten(F.collect_list("toks")).alias("toks"), F.flatten(F.collect_list("dfs")).alias("dfs"))
    of_tokens = tokens.join(of_sets.select("sig", "n"), "sig").select("sig", "n", "toks", "dfs")
    sets = of_tokens.mapInArrow(_prefixes(percent), "sig long, n int, single int, toks array<long>, order1 array<long>, order2 array<long>, order3 array<long>")
    sets = materialise(sets, "shingle-sets")
    entries = materialise(
        sets.select("sig", "n", (F.size("toks") / F.col("n")).alias("share"), "single", F.posexplode("order1").alias("j", "tok")).select("sig", "n", "share", "tok", (F.col("single") + F.col("j")).alias("pos")),
        "shingle-prefixes",
    )

    def fits(n1: str, p1: str, n2: str, p2: str) -> Column:
        rest = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
        return rest >= _least_overlap(F.col(n1), F.col(n2), percent)

    # one pivot for each token: the set that shares most of itself with others
    pivots = entries.groupBy("tok").agg(F.max_by(F.struct("sig", "n", "pos"), F.struct("share", "sig")).alias("p"), F.count("*").alias("c")).filter(F.col("c") > 1)
    pivots = pivots.select("tok", F.col("p.sig").alias("psig"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    tried = entries.join(pivots, "tok").filter((F.col("sig") != F.col("psig")) & fits("n", "pos", "pn", "ppos"))
    tried = materialise(tried.select(F.least("sig", "psig").alias("a"), F.greatest("sig", "psig").alias("b")).distinct(), "pairs")
    links = materialise(_verified(tried, sets, percent), "links")
    roots = connected_components(links)

    more = materialise(_verified(_apart(entries, roots, sets, fits).join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
    if not more.isEmpty():
        roots = connected_components(links.union(more))

    # components are named set by set; rows whose set is alone need no name
    placed = name_components(roots, of_sets.select(F.col("sig").alias("node"), "least_id"), "least_id")
    named = of_sets.join(placed, of_sets["sig"] == placed["node"], "left").filter(F.col("root").isNotNull() | (F.col("copies") > 1))
    named = materialise(named.select("sig", "root", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("name")).alias("component_id")), "named-sets")
    return of_rows.join(named, "sig", "left").select("id", *keep, "n", F.coalesce("root", "sig").alias("root"), F.coalesce("component_id", "id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (least id reachable by links, itself included).

    A link: 100 * intersection >= percent * union of the distinct shingle sets. Null,
    empty and blank texts have no set and link to nothing; their component is their own id.
    Null ids keep their row and never name a component unless it has no other id. Repeated
    rows and ids are rows like any others. Very long texts are one set like any other, held
    by one task. Other columns are not read. Degrees are not reported: counting them would
    need every pair of a large group.
    """
    groups = jaccard_groups(docs, id_col, text_col, size, percent)
    return groups.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d),
t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(g)
"""
