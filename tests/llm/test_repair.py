"""Structure repair against a search over all edits, and against a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillgrid.llm import repair as R

ROWS = "conv_id long, turn long, role string, text string, pos string, kind int"


def faults(rows):
    """First faults of ordered (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        words = re.sub("[\x20\x09-\x0d]+", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost and ASCII-least audit by a table over (row, state) that keeps whole audits."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    kinds, n = faults(rows), len(rows)
    worst = (10**9, "")
    best = [[worst] * 4 for _ in range(n + 1)]
    best[n] = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for i in range(n - 1, -1, -1):
        (role, _), kind = rows[i], kinds[i]
        extra = 5 if kind == "truncated" else 0
        for q in range(4):
            options = [(2 + best[i + 1][q][0], "D" + best[i + 1][q][1])]
            if kind in (None, "truncated"):
                if role[:1] in after[q] and role[:1] != "":
                    c, a = best[i + 1][after[q][role[0]]]
                    options.append((extra + c, "K" + a))
                c, a = best[i + 1][3 if q == 2 else 2]
                options.append((1 + extra + c, "R" + a))
            best[i][q] = min(options)
        for _ in range(3):
            for q in range(4):
                c, a = best[i][3 if q == 2 else 2]
                best[i][q] = min(best[i][q], (5 + c, "I" + a))
    return best[0][0]


def exhaustive(rows):
    """All edits tried, up to two turns added in a place."""
    kinds, found = faults(rows), []
    adds = [p for n in range(3) for p in itertools.product("ua", repeat=n)]

    def go(i, initials, audit, cost):
        for add in adds:
            c, a, s = cost + 5 * len(add), audit + "I" * len(add), initials + "".join(add)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", s):
                    found.append((c, a))
                continue
            role, kind = rows[i][0], kinds[i]
            go(i + 1, s, a + "D", c + 2)
            if kind in (None, "truncated"):
                extra = 5 if kind else 0
                go(i + 1, s + (role[:1] or "x"), a + "K", c + extra)
                go(i + 1, s + "u", a + "R", c + extra + 1)
                go(i + 1, s + "a", a + "R", c + extra + 1)

    go(0, "", "", 0)
    return min(found)


def apply_edits(rows, audit):
    out, i, state = [], 0, "a"
    for letter in audit:
        wanted = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((wanted, ""))
        else:
            role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            out.append((wanted if letter == "R" else role, text))
        state = out[-1][0][0]
    return "\n".join(f"{r}:{t}" for r, t in out)


def expected(turns):
    """The query's rows for (conv_id, turn, role, text) before damage."""
    space = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = ("user" if h == 4 else space(role)), ("" if h == 1 else re.sub("[.!?]", "", space(text)) if h == 2 else space(text))
        rows += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [r[0] for r in rows if r[0] is not None]
        rows = [r[1:] for r in rows]
        kinds = faults(rows)
        cost, audit = cheapest(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        sha = hashlib.sha256(apply_edits(rows, audit).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)
    return out


def rows_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def some_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " "]
    texts = ["Done.", "Yes!", "cut off", "  ", "a?", "b.", "c.", "d", "e. \n", "f! x"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"t{rng.random()}.") for _ in range(n)]


def letters(rows):
    symbols = {"blank": R.BLANK, "duplicate": R.DUPLICATE}
    plain = [r[0] if r[:1] in ("s", "u", "a") and r else "x" for r, _ in rows]
    return "".join(symbols.get(k) or (p.upper() if k else p) for p, k in zip(plain, faults(rows))).encode()


def audit_of(walked):
    _, edits, behind = walked
    return "".join("I" * len(add) + letter for add, letter, _ in edits) + "I" * len(behind)


def test_least_cost_and_order_match_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(0, 3))
        assert exhaustive(rows) == cheapest(rows)


def test_checkpointed_walk_and_segments():
    rng, repair = random.Random(4), R.Repair()
    for _ in range(600):
        rows = some_rows(rng, rng.randint(0, 40))
        symbols, (cost, audit) = letters(rows), cheapest(rows)
        assert repair.back(symbols, tuple(R.WHOLE_END))[R.START] == cost
        assert audit_of(repair.walk(symbols, tuple(R.WHOLE_END), R.START)) == audit
        # the same in segments
        cuts = sorted({0, len(symbols), *(rng.randint(0, len(symbols)) for _ in range(3))})
        parts = [symbols[a:b] for a, b in zip(cuts, cuts[1:])] or [b""]
        ends = R.chain_back([repair.table(p) for p in parts])
        starts = R.chain_forward([[repair.walk(p, e, q, False)[0] for q in range(4)] for p, e in zip(parts, ends)])
        whole = [repair.walk(p, e, q, i == len(parts) - 1) for i, (p, e, q) in enumerate(zip(parts, ends, starts))]
        assert "".join(map(audit_of, whole)) == audit


def test_query_on_the_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(R.op11_conversation_repair(spark, sf_dir)) == expected(list(map(tuple, turns)))


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
        return str(tmp_path)

    return write


def test_odd_rows(spark, folder):
    rng = random.Random(6)
    turns = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 12)):
            role, text = some_rows(rng, 1)[0]
            turns.append((conv, rng.choice([turn, turn, turn, None, turn * 3, -turn]), rng.choice([role, role, None]), rng.choice([text, text, text, None, "", "é" * 5000 + ".", "x. "])))
        turns += turns[-1:] * rng.randint(0, 2)
    turns += [(77, t, "user", f"{t}.") for t in (-(2**63), 2**63 - 1)]
    path = folder([(*t, "p", 1) for t in turns])
    got, want = rows_of(R.op11_conversation_repair(spark, path)), expected(turns)
    want[77] = (0, *want[77][1:])
    assert got == want


def test_a_conversation_of_many_segments(spark, folder, monkeypatch):
    rng = random.Random(7)
    turns = [(1, t, *some_rows(rng, 1)[0]) for t in range(3000)] + [(1, 5, "user", "again.")] * 300
    turns += [(c, t, *some_rows(rng, 1)[0]) for c in (0, 2, 3) for t in range(20)]
    path = folder([(*t, "p", 1) for t in turns])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        placed = R.ordered_turns(R.damaged(spark.read.parquet(f"{path}/conversations.parquet")))
        assert R.plan_repairs(placed).filter("conv_id = 1").count() > 5
        assert rows_of(R.op11_conversation_repair(spark, path)) == expected(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    turns = spark.createDataFrame([], ROWS)
    repaired, report = R.repair_conversations(turns)
    assert repaired.count() == 0 and report.count() == 0


def test_dropped_conversations_stay(spark, folder):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = rows_of(R.op11_conversation_repair(spark, folder([(gone, 0, "user", "Hi.", "", 0), (gone, 0, "user", "Hi.", "", 0)])))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    turns = spark.createDataFrame([("x", 1, "assistant", "One."), ("x", 2, "assistant", "Two."), ("x", 3, "user", " ")], "conv_id string, turn int, role string, text string")
    repaired, report = R.repair_conversations(turns)
    assert [tuple(r) for r in repaired.orderBy("segment", "step").select("edit", "role", "text").collect()] == [("R", "user", "One."), ("K", "assistant", "Two.")]
    assert report.select("audit", "cost").first() == ("RKD", 3)
