"""Word and hash joins against all pairs, and what they make of crowded keys."""

import random

import duckdb

from quillgrid.operators import hashes
from quillgrid.operators.hashes import _radii, near_hash_bands, near_hash_classes, near_hash_groups
from quillgrid.operators.resolve import fuzzy_match
from quillgrid.operators.songs import flatten_catalog, nest_catalog
from quillgrid.plans.queries import QUERIES, SQL


def words(key):
    return {w for w in key.split() if len(w) > 2}


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(2)
    common, rare = ["the", "and", "of", "era"], [f"w{i:02d}" for i in range(25)]
    some = lambda: " ".join(rng.choices(common, k=rng.randint(0, 3)) + rng.choices(rare, k=rng.randint(0, 5)))
    left, right = [(i, i % 3, some()) for i in range(150)], [(i, i % 3, some()) for i in range(120)]
    args = [spark.createDataFrame(rows, f"{n} int, sheet int, key string") for rows, n in ((left, "l"), (right, "r"))]
    for by in (["sheet"], None):
        want = {}
        for i, s, k in left:
            best = None
            for j, t, m in right:
                a, b = words(k), words(m)
                shared = len(a & b)
                if (by is None or s == t) and shared >= 2 and shared / min(len(a), len(b)) >= 0.5:
                    best = max(best or (0, 0, 0), (shared / min(len(a), len(b)), -j, shared))
            if best:
                want[i] = (-best[1], best[2], best[0])
        got = {r["l"]: (r["r"], r["shared"], r["score"]) for r in fuzzy_match(*args, "l", "r", by).collect()}
        assert got == want and len(want) > 20


def test_a_word_in_half_of_the_rows_makes_no_pairs(spark, node_metrics):
    n = 1500
    left = spark.createDataFrame([(i, f"vault x{i:05d}" if i % 2 else f"x{i:05d} y{i:05d}") for i in range(n)], "l int, key string")
    right = spark.createDataFrame([(i, f"vault x{i:05d}" if i % 2 else f"x{i:05d} y{i:05d}") for i in range(n)], "r int, key string")
    got = fuzzy_match(left, right, "l", "r")
    assert max(node_metrics(got, "Join")) < 10 * n
    assert sorted((r["l"], r["r"]) for r in got.collect()) == [(i, i) for i in range(n)]


def test_hash_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    centres = [rng.getrandbits(64) for _ in range(6)]
    hashes = [flip(rng.choice(centres), rng.randint(0, 9)) for _ in range(90)] + centres * 2 + [0, (1 << 64) - 1]
    rows = [(i, signed(h)) for i, h in enumerate(hashes)] + [(998, None), (0, signed(hashes[0]))]
    for most in (0, 2, 3, 10, 13):
        assert sum(r + 1 for r in _radii(most)) == most + 1
        left, right = (spark.createDataFrame(rows, f"{n} int, hash long") for n in ("a", "b"))
        got = sorted(map(tuple, near_hash_bands(left, right, "a", "b", most).collect()))
        want = sorted((i, j, (g ^ h).bit_count()) for i, g in enumerate(hashes) for j, h in enumerate(hashes) if (g ^ h).bit_count() <= most)
        assert got == want


def test_equal_hashes_are_one_class(spark, node_metrics):
    rows = spark.range(5000).selectExpr("7L AS hash")
    near = near_hash_classes(rows, rows.withColumnRenamed("hash", "other_hash"))
    assert [tuple(r) for r in near.collect()] == [(7, 7, 0)]
    assert max(node_metrics(near, "Join")) <= 4


def test_band_values_are_dealt_out_and_not_collected(spark, node_metrics):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(400)], "hash long")
    near = near_hash_classes(rows, rows.withColumnRenamed("hash", "other_hash"))
    assert not node_metrics(near, "BroadcastExchange", "dataSize")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4), REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan


def test_copies_are_members_and_not_pairs(spark):
    rows = spark.range(4000).selectExpr("id + 5 AS id", "CASE WHEN id % 2 = 0 THEN 7L ELSE 6L END AS hash").union(spark.createDataFrame([(1, -1), (2, None)], "id long, hash long"))
    got = near_hash_groups(rows, "id").collect()
    assert len(got) == 4003
    assert {tuple(r) for r in got if r["distance"]} == {(5, 6, 1), (6, 5, 1)}
    assert {tuple(r) for r in got if not r["distance"]} == {(5 + i % 2, i + 5, 0) for i in range(4000)} | {(1, 1, 0)}


def test_the_hash_query_gives_all_pairs_of_rows(spark, tmp_path):
    rng = random.Random(5)
    base = [rng.uniform(-1, 1) for _ in range(64)]
    turned = lambda k: [-x if i < k else x for i, x in enumerate(base)]
    signs = lambda v: sum(1 << i for i, x in enumerate(v or []) if x > 0)
    vectors = [(i, turned(i % 3 * 6)) for i in range(12)] + [(3, turned(0)), (3, turned(0)), (None, turned(1)), (20, None), (21, None)]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = [(i, j, (signs(v) ^ signs(w)).bit_count()) for i, v in vectors for j, w in vectors]
    got = sorted(map(tuple, QUERIES["hash_distance_bands"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((p for p in pairs if p[2] <= 10), key=repr)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(SQL["hash_distance_bands"]).fetchall(), key=repr) == got


def test_large_classes_are_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(hashes, "CHUNK", 10)
    rows = spark.range(95).selectExpr("id", "CASE WHEN id < 60 THEN 7L ELSE 6L END AS hash").union(spark.createDataFrame([(1, 7), (None, 7), (2, None)], "id long, hash long"))
    kept = [(r["id"], r["hash"]) for r in rows.collect() if r["hash"] is not None]
    got = hashes.near_hash_rows(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "a", "b")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, j, (g ^ h).bit_count()) for i, g in kept for j, h in kept), key=repr)


def test_nesting_shuffles_the_versions_once(spark):
    rows = [(f"s{i % 3}", i % 2, f"era {i % 2}", i % 4, "part", f"song {i % 5}", i, f"take {i}") for i in range(60)]
    versions = spark.createDataFrame(rows, "sheet_id string, era_idx int, era_name string, section_idx int, section_name string, base_name string, row_idx int, name string")
    nested = nest_catalog(versions, ["name"])
    assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, flatten_catalog(nested).collect())) == sorted(rows)
    assert {r["sheet_id"]: r["n_versions"] for r in nested.collect()} == {"s0": 20, "s1": 20, "s2": 20}
