"""Neighbours, similarity join, lists, mixing, chats and the pipeline against plain Python."""

import collections
import datetime as dt
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import ann, chat, components, jaccard, mixing, registry, urls
from quillgrid.llm.common import table
from quillgrid.llm.shingles import signatures


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cursor = con.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == want


# ---------------------------------------------------------------- neighbours


def test_neighbours_recall_and_exact_scores(spark, sf_dir):
    got = ann.op2_ann_partitions(spark, sf_dir.replace("sf0.001", "sf0.01")).toPandas()
    t = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings").toPandas()
    x, ids = np.array(t.embedding.tolist(), dtype=float), t.vec_id.values
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, [d[ids == v][0] for v in mine.vec_id], rtol=0, atol=1e-14)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(mine.vec_id))
        total += 10
    assert hits / total >= 0.9


def test_neighbours_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    same = [(i, [1.0, 0.0], "e") for i in range(40)]
    odd = [(100, None, ""), (101, [0.0, 0.0], ""), (102, [float("nan"), 1.0], ""), (103, [1.0, None], ""), (104, [1.0, 2.0, 3.0], ""), (None, [1.0, 1.0], ""), (105, [], "")]
    rows = spark.createDataFrame(same + odd, "vec_id long, embedding array<float>, rank string")
    got = ann.nearest_neighbours(rows, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(q, v, 0.0) for q in (0, 20) for v in [i for i in range(40) if i != q][:10]]
    few = ann.nearest_neighbours(rows.filter("vec_id < 3"), F.col("id") == 0)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert ann.nearest_neighbours(rows.filter("false"), F.col("id") == 0).count() == 0


def brute_neighbours(rows, queries, k=10):
    """Nearest pair of each (query id, other id) of equal lengths, k ids each."""
    best = collections.defaultdict(dict)
    for q, x in rows:
        if q in queries:
            for v, y in rows:
                if v != q and len(x) == len(y):
                    d = float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))
                    best[q][v] = min(d, best[q].get(v, d))
    return [(q, i + 1, v) for q in sorted(best) for i, (_, v) in enumerate(sorted((round(d, 12), v) for v, d in best[q].items())[:k])]


def test_neighbours_of_repeated_rows_and_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).round(2).tolist()) for i in range(40)] + [(200, [1.0, 1.0])]
    rows += [rows[0]] * 25 + [rows[7]] * 9 + [(0, rng.normal(size=4).tolist()), (9, rng.normal(size=4).tolist()), (100, rows[61][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest_neighbours(df, F.col("id") % 20 == 0, mass=1.0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == brute_neighbours(rows, {q for q, _ in rows if q % 20 == 0})


def test_neighbours_in_two_levels_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "SECOND_LEVEL", 1000)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    trees = ann.fit_trees(ann.usable(df, "vec_id", "embedding"), sample_rows=500)
    assert len(trees[8].below) > 10 and len(trees[8].probabilities(centres)[0]) > 100
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("id") % 100 == 0, sample_rows=500).collect()}
    want = {(q, v) for q, _, v in brute_neighbours(rows, set(range(0, 3000, 100)))}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("level, least", [(10**9, 0.94), (1000, 0.94)])
def test_recall_on_vectors_without_structure(spark, monkeypatch, level, least):
    """The table's own vectors, in one level of parts and in two, and every neighbour with all parts."""
    monkeypatch.setattr(ann, "SECOND_LEVEL", level)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in df.collect()]
    ids, x = np.array([v for v, _ in rows]), np.stack([v for _, v in rows])
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want |= {(int(ids[q]), int(v)) for v in ids[np.lexsort((ids, d))[:10]]}
    for mass, bound in ((ann.MASS, least), (1.0, 1.0)):
        got = {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("id") % 20 == 0, mass=mass).collect()}
        recall = len(got & want) / len(want)
        print("recall", level, mass, recall)
        assert recall >= bound


# ---------------------------------------------------------------- similarity join


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return sorted(out, key=repr)


def test_prefixes_and_signatures_are_made_for_many_sets_at_once(monkeypatch):
    """One pass of a batch orders all of its sets; sets without room for a shared token are left out."""
    rng = random.Random(4)
    lists = [rng.sample(range(-(10**6), 10**6), rng.randint(1, 30)) for _ in range(200)]
    dfs = [[rng.randint(2, 5) for _ in s] for s in lists]
    n = [len(s) + rng.randint(0, 12) for s in lists]
    batch = pa.record_batch({"sig": pa.array(range(200), pa.int64()), "n": pa.array(n, pa.int32()), "toks": pa.array(lists, pa.list_(pa.int64())), "dfs": pa.array(dfs, pa.list_(pa.int64()))})
    room = [m - -(-75 * m // 100) + 1 - (m - len(s)) for m, s in zip(n, lists, strict=True)]
    for tokens in (1, 50, 1 << 20):
        monkeypatch.setattr(jaccard, "ORDER_TOKENS", tokens)
        got = pa.Table.from_batches(jaccard._prefixes(75)([batch.slice(0, 90), batch.slice(90)])).to_pylist()
        assert [r["sig"] for r in got] == [i for i in range(200) if room[i] > 0] and 0 < len(got) < 200
        for r in got:
            i = r["sig"]
            assert r["order1"] == [t for _, t in sorted(zip(dfs[i], lists[i], strict=True))][: room[i]]
            assert r["toks"] == lists[i] and r["single"] == n[i] - len(lists[i])
            assert len(r["order2"]) == len(r["order3"]) == len(r["order1"]) and {*r["order2"], *r["order3"]} <= {*lists[i]}
    # one order for all sets: the least token of a union is the least of one of its parts
    pair = pa.record_batch({"sig": pa.array([1, 2, 3], pa.int64()), "n": pa.array([8, 8, 16], pa.int32()), "toks": pa.array([[*range(8)], [*range(8, 16)], [*range(16)]], pa.list_(pa.int64())), "dfs": pa.array([[2] * 8, [2] * 8, [2] * 16], pa.list_(pa.int64()))})
    one, two, both = pa.Table.from_batches(jaccard._prefixes(75)([pair])).to_pylist()
    for order in ("order2", "order3"):
        assert both[order][0] in (one[order][0], two[order][0])
    sets = [np.array(s, dtype=np.uint64) for s in ([], [1, 2], [5], [], [1, 2], [1, 3])]
    got = signatures(sets)
    assert got[0] is got[3] is None and got[1] == got[4] and len(set(got)) == 4
    assert got[1:3] == signatures(sets[1:3]) and signatures(sets[:1]) == [None]


@pytest.mark.parametrize("hot,crowd,group_tokens", [((4096, 0.005), 64, 2_000_000), ((3, 0.0), 2, 2_000_000), ((4096, 0.005), 1, 0.01), ((3, 0.0), 64, 0.01)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, hot, crowd, group_tokens):
    """Also with hot tokens, with crowded ones, and with more ranges than a token's first 16 bits tell apart."""
    monkeypatch.setattr(jaccard, "HOT_SETS", hot[0])
    monkeypatch.setattr(jaccard, "HOT_SHARE", hot[1])
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", group_tokens)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    line = " ".join(word() for _ in range(14))
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + rng.choice(["", "", "\n" + line]))
    star = [word() for _ in range(80)]
    for i in range(12):  # a centre whose copies are near to it but not to each other
        copy = list(star)
        copy[5 * i + 3] = "edit"
        copy[(5 * i + 40) % 80] = f"e{i}"
        texts.append(" ".join(copy))
    common = [word() for _ in range(12)]
    for _ in range(10):  # texts that share a passage but are no copies
        texts.append(" ".join(common + [word() for _ in range(10)]))
    texts += [" ".join(star), " ".join(word() for _ in range(4000)), "", None, " \n", "one two", "ONE\ttwo", "É one two three four", line, line.upper()]
    rows = [(rng.randrange(10_000), t) for t in texts]
    rows += [rows[0], (None, rows[3][1]), (None, "all alone here now and ever")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(df.filter("false")).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.connected_components(links.filter("false")).count() == 0


# ---------------------------------------------------------------- lists


def test_url_lists_over_time(spark):
    d = dt.date
    entries = [("block", "bad.org", d(2024, 1, 10), "add"), ("block", "bad.org", d(2024, 2, 10), "remove"), ("block", "bad.org", d(2024, 2, 10), "remove"), ("allow", "good.bad.org", d(2024, 1, 20), "add"), ("block", None, d(2024, 1, 1), "add"), ("block", "x.org", d(2024, 3, 1), "remove"), ("block", "x.org", d(2024, 3, 1), "add")]
    lists = spark.createDataFrame(entries, "list string, pattern string, listed_on date, event string")
    t = lambda m, day: dt.datetime(2024, m, day, 12)
    caps = [(1, "http://u:p@WWW.bad.org:80/x", t(1, 9)), (2, "http://www.bad.org", t(1, 10)), (3, "https://good.bad.org./", t(1, 15)), (4, "https://good.bad.org/", t(1, 25)), (5, "http://bad.org?q", t(2, 10)), (6, "nohost", t(2, 1)), (7, None, t(2, 1)), (8, "http://bad.org", None), (9, "http://x.org", t(3, 1)), (9, "http://x.org", t(3, 1)), (None, "http://localhost/", t(3, 1))]
    rows = urls.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp").withColumn("verdict", F.lit("old")), lists)
    got = sorted(((r["page_id"], r["verdict"], r["matched"]) for r in rows.collect()), key=repr)
    want = [(1, "none", None), (2, "block", "bad.org"), (3, "block", "bad.org"), (4, "allow", "good.bad.org"), (5, "none", None), (6, "none", None), (7, "none", None), (8, "none", None), (9, "block", "x.org"), (9, "block", "x.org"), (None, "none", None)]
    assert got == sorted(want, key=repr)
    assert urls.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp"), lists.filter("false")).filter("verdict <> 'none'").count() == 0


# ---------------------------------------------------------------- mixing


def test_raking_meets_its_targets(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, t, rng.randint(0, 90)) for s in "abc" for t in "xy"] + [("z", "x", 0)], "source string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"), "topic": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "topic string, share double")}
    got = mixing.rake(cells, targets, turns=30).toPandas()
    total = got.tokens.sum()
    for dim, want in (("source", {"a": 0.5, "b": 0.3, "c": 0.2, "z": 0.0}), ("topic", {"x": 0.6, "y": 0.4})):
        for value, share in want.items():
            assert abs(got[got[dim] == value].weight.sum() / total - share) < 1e-6
    assert mixing.cell_probabilities(cells, targets).toPandas().probability.between(0, 1).all()


def test_raking_residual(spark):
    """Few turns leave a residual that is reported, many none; targets that cannot be met leave one."""
    cells = spark.createDataFrame([("a", "x", 90), ("a", "y", 1), ("b", "x", 2), ("b", "y", 40)], "source string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.2), ("b", 0.8)], "source string, share double"), "topic": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "topic string, share double")}
    left = [mixing.raking_residual(mixing.rake(cells, targets, turns=t), targets) for t in (0, 1, 6, 40)]
    assert min(left[:2]) > 0.4 and left[1] > left[2] > left[3] and left[3] < 1e-3
    reached = mixing.cell_probabilities(cells, targets, turns=1).toPandas()
    assert np.allclose(reached.residual, left[1])
    alone = spark.createDataFrame([("a", "x", 5)], "source string, topic string, tokens long")
    assert mixing.raking_residual(mixing.rake(alone, targets), targets) > 0.05
    assert mixing.raking_residual(mixing.rake(cells.filter("false"), targets), targets) == 0


def test_mixing_edges(spark):
    rows = [(1, "a b", None, "s"), (2, None, "en", None), (None, "c d", "en", "s"), (3, "", "en", "s"), (1, "a b", None, "s"), (4, "w " * 300_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("topic", "weight", "probability", "tokens", "mix", "mix_tokens", "mix_cell", "residual", "_held"):
        df = df.withColumn(name, F.lit("own"))
    out = mixing.mix_sources(df, out_col="found")
    assert out.columns == [*df.columns, "found"] and out.filter("found.probability < 0 or found.probability > 1 or weight <> 'own' or mix <> 'own'").count() == 0
    assert out.filter("doc_id = 4 and found.tokens <> 300000").count() == 0
    assert set(mixing.mix_sources(df).columns) == set(df.columns)
    assert mixing.mix_sources(df.filter("false")).count() == 0


# ---------------------------------------------------------------- chats


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    rng = random.Random(4)
    full = {c: [(rng.choice(["user", "assistant"]), f"t{rng.randint(0, 2)}") for _ in range(rng.randint(1, 9))] for c in range(30)}
    for c in range(30, 60):
        of = full[rng.randrange(30)]
        full[c] = of[: rng.randint(1, len(of))]
    rows = [(c, i * 3, role, text) for c, turns in full.items() for i, (role, text) in enumerate(turns)]
    rows += [*rows[:5], (None, 0, "user", "x"), (77, None, None, None)]
    full[77] = [("", "")]
    want = {}
    for c, turns in full.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in full.values())
        earlier = any(o == turns and k < c for k, o in full.items())
        if not longer and not earlier:
            want[c] = (len(turns), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(df).collect()}
    assert got == want and len(want) < 50
    assert chat.format_chats(df.filter("false")).count() == 0


def test_very_long_turns_and_turns_of_one_number(spark):
    """Long texts are rendered whole; turns of one number follow each other by role, then text."""
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "system", "s"), (2, 0, "user", long), (3, 0, "user", None), (3, 1, None, "x")]
    got = {r["conv_id"]: r["text"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == {1: turn("user", long) + turn("assistant", "a") + turn("assistant", "b") + turn("system", "s"), 3: turn("user", "") + turn("", "x")}


def test_very_long_urls_and_hosts(spark):
    t = dt.datetime(2024, 1, 15, 12)
    deep = ".".join(f"p{i}" for i in range(300))
    caps = [(1, "http://bad.org/" + "x/" * 100_000, t), (2, f"http://{deep}.bad.org/", t), (3, "http://" + "h" * 50_000, t), (4, f"http://{deep}.org/?u=bad.org", t)]
    lists = spark.createDataFrame([("block", "bad.org", dt.date(2024, 1, 1), "add")], "list string, pattern string, listed_on date, event string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(caps, "page_id long, url string, fetched_at timestamp"), lists).collect()}
    assert got == {1: "block", 2: "block", 3: "none", 4: "none"}
