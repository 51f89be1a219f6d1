"""Conversation structure repair by square-root checkpointed dynamic programming.

The cheapest edits turn a conversation's role initials into ``(s?(ua)+)?``. A row is one
symbol (its initial, whether it is cut short, whether it has to go), the grammar has four
states, and the least cost from each state to the end is a vector of four numbers that is
computed backwards, row by row. Of these vectors only every square-root-th one is stored.
A walk forwards computes the vectors of one block at a time again and takes, at each row,
the ASCII-least edit that keeps to the least cost.

Conversations may be of any length. Rows are sorted by ranges over the cluster; each range
cuts a long conversation into segments. A segment of ``n`` symbols is a table of 4 x 4 least
costs; the tables of a conversation's segments, chained backwards, give the vector at the
end of each, which is all that the rows of a segment need from those behind them. The walk
through a segment from each of the four states gives the state it ends in; chained forwards,
these give the state in which each segment begins. Most conversations are one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, table

#: States of the grammar: at the start, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
FAR = 1 << 40
#: The state after a turn of this initial, for each state; none where the grammar has no such turn.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The initial that a changed or added turn has to have, and the state after it.
WANTED = tuple(("a", ASSISTANT) if q == USER else ("u", USER) for q in range(4))
ROLES = {"u": "user", "a": "assistant"}
#: Symbols of rows: the initial, in upper case where the text is cut short; rows that have to go.
BLANK, DUPLICATE = "_", "-"
GONE = {ord(BLANK), ord(DUPLICATE)}
PRICE = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
LEGAL = ("su", "ua", "au")
#: The bits of a position that count within one range of the sort.
RANGE_MASK = (1 << 33) - 1
WHOLE_END = [0, 2 * INSERT, INSERT, 0]
Costs = tuple[int, int, int, int]


def _with_insertions(costs: list[int]) -> Costs:
    """Least costs when turns may be added first; two in a row are enough."""
    for q in (USER, ASSISTANT, USER, START, SYSTEM):
        costs[q] = min(costs[q], INSERT + costs[WANTED[q][1]])
    return tuple(min(c, FAR) for c in costs)  # type: ignore[return-value]


class Repair:
    """Least costs and edits of rows given as symbols; steps are remembered by the differences of the costs."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, Costs], Costs] = {}

    def _step(self, symbol: int, after: Costs) -> Costs:
        """The costs before a row from those after it, both for each state."""
        low = min(after)
        apart = tuple(min(c - low, FAR) for c in after)
        before = self.steps.get((symbol, apart))
        if before is None:
            costs = []
            for q in range(4):
                best = DELETE + apart[q]
                for cost, state, _ in self._stays(symbol, q):
                    best = min(best, cost + apart[state])
                costs.append(best)
            before = self.steps[symbol, apart] = _with_insertions(costs)
        return tuple(min(c + low, FAR) for c in before)  # type: ignore[return-value]

    @staticmethod
    def _stays(symbol: int, q: int) -> Iterator[tuple[int, int, str]]:
        """(cost, state, letter) of keeping the row and of giving it another role."""
        if symbol in GONE:
            return
        initial = chr(symbol)
        extra = CUT_SHORT if initial.isupper() else 0
        state = AFTER[q].get(initial.lower())
        if state is not None:
            yield KEEP + extra, state, "K"
        yield REROLE + extra, WANTED[q][1], "R"

    def back(self, symbols: bytes, end: Costs) -> Costs:
        for symbol in reversed(symbols):
            end = self._step(symbol, end)
        return end

    def table(self, symbols: bytes) -> list[int]:
        """Least costs from each state before the rows to each state after them, row by row."""
        columns = [self.back(symbols, tuple(0 if q == p else FAR for q in range(4))) for p in range(4)]  # type: ignore[arg-type]
        return [columns[p][q] for q in range(4) for p in range(4)]

    def walk(self, symbols: bytes, end: Costs, start: int, last: bool = True) -> tuple[int, list[tuple[str, str, str]], str]:
        """The state at the end, each row's (letters before it, its letter, its new initial), and letters behind the last.

        Letters before and behind are the initials of added turns.
        """
        size = max(1, isqrt(len(symbols)))
        checkpoints = [end]
        for at in range((len(symbols) - 1) // size * size, 0, -size):
            checkpoints.append(self.back(symbols[at : at + size], checkpoints[-1]))
        edits, q = [], start
        for at in range(0, len(symbols), size):
            block = symbols[at : at + size]
            costs = [checkpoints.pop()]
            for symbol in reversed(block):
                costs.append(self._step(symbol, costs[-1]))
            costs.reverse()
            for i, symbol in enumerate(block):
                now, then, added = costs[i], costs[i + 1], ""
                while now[q] != DELETE + then[q] and now[q] == INSERT + now[WANTED[q][1]]:
                    letter, q = WANTED[q]
                    added += letter
                if now[q] == DELETE + then[q]:
                    edits.append((added, "D", ""))
                    continue
                letter, state = min((letter, state) for cost, state, letter in self._stays(symbol, q) if now[q] == cost + then[state])
                edits.append((added, letter, WANTED[q][0] if letter == "R" else ""))
                q = state
        added = ""
        while last and WHOLE_END[q]:
            letter, q = WANTED[q]
            added += letter
        return q, edits, added


def chain_back(tables: list[list[int]]) -> list[Costs]:
    """The costs behind each segment of a conversation, from the tables of all."""
    ends = [tuple(WHOLE_END)]
    for t in tables[:0:-1]:
        ends.append(tuple(min(min(t[4 * q + p] + ends[-1][p] for p in range(4)), FAR) for q in range(4)))
    return ends[::-1]  # type: ignore[return-value]


def chain_forward(exits: list[list[int]]) -> list[int]:
    """The state in which each segment begins, from the states that each one leads to."""
    starts = [START]
    for e in exits[:-1]:
        starts.append(e[starts[-1]])
    return starts


def _chain(pieces: DataFrame, schema: str, out: str, step) -> DataFrame:
    """``(base, <out>)`` from ``step(values)`` over the segments of each conversation that has several."""
    value = [c for c in pieces.columns if c not in ("conv_id", "base")][0]
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("base", value))).alias("s")).filter(F.size("s") > 1)

    def run(batches):
        for batch in batches:
            bases, values = [], []
            for segments in batch.column("s").to_pylist():
                bases += [g["base"] for g in segments]
                values += [list(v) if isinstance(v, tuple) else v for v in step([g[value] for g in segments])]
            yield pa.record_batch([pa.array(bases, pa.int64()), pa.array(values, pa.list_(pa.int64()) if "array" in schema else pa.int64())], names=["base", out])

    return whole.select("s").mapInArrow(run, f"base long, {out} {schema}")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn, role, text, kind, key)``, written; ``pos`` rises along each conversation.

    Rows are sorted in ranges by conversation, turn (nulls first), role, text, so that a
    conversation of any length, and a turn repeated any number of times, is many tasks.
    ``kind`` is blank, truncated or null; ``key`` tells the texts of a conversation apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text", "tie"]  # rows that tie are equal
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    kind = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return materialise(placed.select("conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", kind.alias("kind"), F.unhex(F.md5("text")).alias("key")), "ordered-turns")


def _symbols(placed: DataFrame) -> DataFrame:
    """``(conv_id, pos, initial, symbol)``: what the dynamic programme reads of each row."""
    rows = placed.select("conv_id", "pos", "role", "key", "kind")
    shown = rows.filter("kind IS NULL OR kind <> 'blank'")
    place = ["conv_id", "role", "key"]
    first = shown.groupBy(*place).agg(F.min("pos").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    first = first.select(*[F.col(c).alias(f"_{c}") for c in place], "first")
    again = shown.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))).filter("pos > first").select("pos", F.lit(True).alias("again"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("kind") == "blank", BLANK).when(F.col("again"), DUPLICATE).when(F.col("kind") == "truncated", F.upper(initial)).otherwise(initial)
    return rows.join(again, "pos", "left").select("conv_id", "pos", initial.alias("initial"), symbol.alias("symbol"))


SEGMENT = "base long, symbols string, first string, last string, illegal long, costs array<long>"


def _segments(batches):
    """Rows in order to segments: runs of one conversation within one range of the sort."""
    repair, names = Repair(), ["conv_id", *[c.split(" ")[0] for c in SEGMENT.split(", ")]]
    open_: list = []  # conv_id, base, pieces of symbols, pieces of initials

    def close(edge: bool):
        conv, base, symbols, initials = open_[0], open_[1], "".join(open_[2]), "".join(open_[3])
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        # a segment between two others of its range is a whole conversation
        costs = repair.table(symbols.encode()) if edge or base & RANGE_MASK == 0 else None
        return conv, base, symbols, initials[0], initials[-1], illegal, costs

    def batch_of(done, conv_type):
        columns = list(zip(*done)) if done else [[] for _ in names]
        types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    conv_type = None
    for batch in batches:
        if not batch.num_rows:
            continue
        convs, pos = batch.column("conv_id"), batch.column("pos").to_numpy()
        conv_type, symbols, initials = convs.type, "".join(batch.column("symbol").to_pylist()), "".join(batch.column("initial").to_pylist())
        codes = convs.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (pos[1:] != pos[:-1] + 1)])
        done, whole = [], pos.tolist()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)]):
            conv = convs[a].as_py()
            if open_ and open_[0] == conv and open_[4] + 1 == whole[a]:
                open_[2].append(symbols[a:b])
                open_[3].append(initials[a:b])
                open_[4] = whole[b - 1]
                continue
            if open_:
                done.append(close(whole[a] != open_[4] + 1))
            open_ = [conv, whole[a], [symbols[a:b]], [initials[a:b]], whole[b - 1]]
        yield batch_of(done, conv_type)
    if open_:
        yield batch_of([close(True)], conv_type)


def _walks(batches):
    """The states in which the walks through a segment end, for each state at its start."""
    repair = Repair()
    for batch in batches:
        exits = [[repair.walk(s.encode(), tuple(end), q, last=False)[0] for q in range(4)] for s, end in zip(batch.column("symbols").to_pylist(), batch.column("end").to_pylist())]
        yield pa.record_batch([batch.column("conv_id"), batch.column("base"), pa.array(exits, pa.list_(pa.int64()))], names=["conv_id", "base", "exits"])


def _plans(batches):
    """Each segment's edits, the initials that they set, and their cost."""
    repair = Repair()
    for batch in batches:
        audits, roles, costs = [], [], []
        for symbols, end, start, last in zip(*(batch.column(c).to_pylist() for c in ("symbols", "end", "start", "last_one"))):
            _, edits, behind = repair.walk(symbols.encode(), tuple(end), start, last)
            audits.append("".join(["I" * len(added) + letter for added, letter, _ in edits]) + "I" * len(behind))
            roles.append("".join([added + (role or "-") for added, _, role in edits]) + behind)
            stays = [s for s, (_, letter, _) in zip(symbols, edits) if letter != "D"]
            cost = CUT_SHORT * sum(s.isupper() for s in stays)
            costs.append(cost + sum(PRICE[letter] * audits[-1].count(letter) for letter in PRICE))
        yield pa.record_batch([*batch.columns[: batch.schema.get_field_index("end")], pa.array(audits, pa.string()), pa.array(roles, pa.string()), pa.array(costs, pa.int64())], names=[*batch.schema.names[: batch.schema.get_field_index("end")], "audit", "roles", "cost"])


def plan_repairs(placed: DataFrame) -> DataFrame:
    """The edits of every segment of a conversation, written.

    ``(conv_id, base, symbols, first, last, illegal, audit, roles, cost)``: the segment's rows
    are those from position ``base`` on; ``audit`` has a letter for each edit in order (Keep,
    Rerole, Delete, Insert) and ``roles`` the initial that the edit sets, or ``-``.
    """
    conv = f"conv_id {placed.schema['conv_id'].dataType.simpleString()}"
    rows = _symbols(placed).withColumn("range", F.shiftright("pos", 33))
    rows = rows.repartition("range").sortWithinPartitions("pos").select("conv_id", "pos", "initial", "symbol")
    segments = materialise(rows.mapInArrow(_segments, f"{conv}, {SEGMENT}"), "segments")
    edges = segments.filter(F.col("costs").isNotNull())
    ends = materialise(_chain(edges.select("conv_id", "base", "costs"), "array<long>", "end", chain_back), "segment-ends")
    walks = edges.join(ends, "base").select("conv_id", "base", "symbols", "end").mapInArrow(_walks, f"{conv}, base long, exits array<long>")
    starts = _chain(walks, "long", "start", chain_forward)
    lasts = _chain(edges.select("conv_id", "base", "last"), "long", "last_one", lambda s: [0] * (len(s) - 1) + [1])
    ready = segments.drop("costs").join(ends, "base", "left").join(starts, "base", "left").join(lasts, "base", "left")
    end = F.coalesce("end", F.array(*[F.lit(c).cast("long") for c in WHOLE_END]))
    ready = ready.select("conv_id", "base", "symbols", "first", "last", "illegal", end.alias("end"), F.coalesce("start", F.lit(START)).alias("start"), (F.coalesce("last_one", F.lit(1)) == 1).alias("last_one"))
    schema = f"{conv}, base long, symbols string, first string, last string, illegal long, audit string, roles string, cost long"
    return materialise(ready.mapInArrow(_plans, schema), "repair-plans")


def _steps(batches):
    """A row for each edit of a segment: its number, letter, initial, and the position of the row that stays."""
    for batch in batches:
        for i, (base, audit, roles) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("base", "audit", "roles")))):
            letters = np.frombuffer(audit.encode(), dtype="S1")
            old = letters != b"I"
            stays = (letters == b"K") | (letters == b"R")
            pos = base + np.cumsum(old) - 1
            for a in range(0, len(audit), 100_000):
                n = len(audit[a : a + 100_000])
                conv = batch.column("conv_id").take(pa.array(np.full(n, i)))
                yield pa.record_batch([conv, pa.array(np.full(n, base)), pa.array(np.arange(a, a + n)), pa.array(list(audit[a : a + n])), pa.array(list(roles[a : a + n])), pa.array(pos[a : a + n], mask=~stays[a : a + n])], names=["conv_id", "segment", "step", "edit", "initial", "pos"])


def repaired_turns(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, segment, step, edit, role, text)``: the repaired conversations, in order of segment and step.

    Added turns have an empty text. Deleted rows are not there. The join is of one row to
    one: steps are many more than their written form, a letter each, lets the planner guess,
    so it is told to merge.
    """
    conv = f"conv_id {placed.schema['conv_id'].dataType.simpleString()}"
    steps = plans.select("conv_id", "base", "audit", "roles").mapInArrow(_steps, f"{conv}, segment long, step long, edit string, initial string, pos long")
    role = F.when(F.col("initial") == "u", ROLES["u"]).when(F.col("initial") == "a", ROLES["a"])
    stay = steps.filter(F.col("pos").isNotNull()).hint("merge").join(placed.select("pos", "role", "text"), "pos").select("conv_id", "segment", "step", "edit", F.coalesce(role, "role").alias("role"), "text")
    added = steps.filter("edit = 'I'").select("conv_id", "segment", "step", "edit", role.alias("role"), F.lit("").alias("text"))
    return stay.unionByName(added)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines, for conversations with a row.

    A digest takes its text in order, so one task reads a conversation's rows; it holds none
    of them but a batch.
    """
    conv = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}"
    lines = repaired.select("conv_id", "segment", "step", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        now, digest, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv_id != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv_id, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.record_batch([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([now], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "step").select("conv_id", "line").mapInArrow(run, f"{conv}, repaired_sha256 string")


def repair_report(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation with rows."""
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy("conv_id").agg(F.coalesce(span.try_cast("long"), F.lit(0).cast("long")).alias("gaps"))
    count = lambda c: F.length(F.regexp_replace("symbols", f"[^{c}]", "")).cast("long")
    pieces = plans.select("conv_id", count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count("A-Z").alias("truncated"), "illegal", "cost", F.struct("base", "first", "last", "audit").alias("p"))
    sums = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.sort_array(F.collect_list("p")).alias("p"))
    borders = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.concat(a["last"], b["first"]))
    sums = sums.withColumn("illegal", F.col("illegal") + F.size(F.filter(borders, lambda pair: ~pair.isin(*LEGAL))))
    sums = sums.withColumn("audit", F.array_join(F.transform("p", lambda s: s["audit"]), "")).drop("p").withColumnRenamed("conv_id", "_conv_id")
    return gaps.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns and the report of ``turns`` (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and text; rows of one turn number, and
    equal rows, are rows like others (an equal one is a duplicate). A null role or text is
    one space, which is no legal role and a blank text; an empty role has no legal initial
    either. A null conversation is one of its own. Texts of any length are read whole. An
    empty table gives empty ones. Other columns are not read, so no name can clash. Gaps are
    those of turn numbers that are there, 0 if none is or if they are more than a long holds.
    """
    placed = ordered_turns(turns)
    plans = plan_repairs(placed)
    return repaired_turns(placed, plans), repair_report(placed, plans)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` damaged by the checksum of their conversation and turn; nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired, report = repair_conversations(damaged(turns))
    digests = conversation_digests(repaired).withColumnRenamed("conv_id", "_of")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    all_ = ids.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("_id").eqNullSafe(F.col("_of")), "left")
    zero = F.lit(0).cast("long")
    return all_.select(F.col("_id").alias("conv_id"), *[F.coalesce(n, zero).alias(n) for n in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
