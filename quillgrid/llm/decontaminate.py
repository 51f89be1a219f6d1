"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. A text that holds
the item with at most k edits holds one piece unchanged, at most k characters off its
place. Pieces are looked up by rolling hashes of their first characters, for all places of a
batch at once; hits are compared with the whole piece, and each place they point to is
verified with Myers' bit-parallel distance (1999). Both sides are compared in a plain form:
lower case, runs of anything but letters and digits as one space.

Documents are read by a map over batches, without a shuffle. The items are a stated query
set, which the driver reads. Items of up to ``BLOCK_BYTES`` together take one pass; a larger
set takes one pass for each block, in one chain, and a task holds the block that it is at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import map_batches, table
from quillgrid.llm.shingles import _BYTE, _POWERS, U, chunks

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Bytes of item text for one pass; a task needs some six times as much memory.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are searched at once; their hashes and places take some sixty times as much.
TEXT_BYTES = 1 << 19
#: Pieces are hashed by so many first characters, the most that they have; shorter ones whole.
GRAMS = (12, 10, 8)
LEAK = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def plain_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk its first row, the bytes of the plain forms, and the rows' starts and ends in them; nulls are empty."""
    for at, _, data, offsets in chunks(pc.utf8_lower(texts), TEXT_BYTES):
        data = _PLAIN[data]
        gap = data == 32
        opens = np.zeros(len(data) + 1, dtype=bool)
        opens[offsets] = True
        keep = ~(gap & (np.r_[True, gap[:-1]] | opens[:-1])) if len(data) else gap
        kept, to = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        starts, ends = to[:-1], to[1:].copy()
        full = ends > starts
        ends[full] -= kept[ends[full] - 1] == 32
        yield at, kept, starts, ends


def plain_texts(texts: pa.Array) -> Iterator[str]:
    """The plain form of each text, one character for each UTF-8 byte."""
    for _, kept, starts, ends in plain_chunks(texts):
        whole = kept.tobytes().decode("latin-1")
        for a, b in zip(starts, ends, strict=True):
            yield whole[a:b]


def budget(length: int) -> int:
    return int(ERROR_RATE * length)


def pieces(item: bytes, k: int) -> list[tuple[int, int]]:
    """The item cut into k + 1 pieces of nearly equal length: (start, end)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def _running(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch is read off."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWERS.upto(len(data))[0][: len(data)], out=total[1:])
    return total


def _gram_hashes(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` bytes."""
    n = max(0, len(total) - size)
    return (total[size:] - total[:n]) * _POWERS.upto(len(total))[1][:n]


class Pattern:
    """An item made ready for Myers' algorithm, which reports its best end in a window."""

    def __init__(self, item_id: int, text: bytes) -> None:
        self.item_id, self.text, self.k = item_id, text, budget(len(text))
        self.masks: dict[int, int] = {}
        self.grams: list[bytes] = []

    def may_hold(self, window: bytes) -> bool:
        """Whether the window has enough of the item's 4-grams, of which an edit destroys four at most."""
        need = len(self.text) - 3 - 4 * self.k
        if need <= 0:
            return True
        self.grams = self.grams or [self.text[i : i + 4] for i in range(len(self.text) - 3)]
        have = {window[i : i + 4] for i in range(len(window) - 3)}
        return sum(g in have for g in self.grams) >= need

    def best(self, window: bytes) -> tuple[int, int]:
        """(least distance of the item to any substring, the first end where it occurs)."""
        if not self.masks:
            for i, c in enumerate(self.text):
                self.masks[c] = self.masks.get(c, 0) | 1 << i
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        least, end = m, 0
        get = self.masks.get
        for j, c in enumerate(window):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full  # a match may start anywhere: the row above costs nothing
            pv = ((mh << 1) & full) | (full & ~(xv | ph))
            mv = ph & xv
            if score < least:
                least, end = score, j + 1
        return least, end


class Gram:
    """Where the pieces of one hashed length are: by hash (item, offset), with a bit map before it."""

    def __init__(self, size: int, hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.size, self.hashes, self.items, self.offsets = size, hashes[order], items[order], offsets[order]
        bits = min(24, max(16, int(len(hashes)).bit_length() + 4))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.hashes >> self.shift] = True

    def hits(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the bytes, row of this table) of each equal hash."""
        hashes = _gram_hashes(total, self.size)
        at = np.flatnonzero(self.seen[hashes >> self.shift])
        low, high = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
        counts = high - low
        rows = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(at) else at
        return np.repeat(at, counts), rows


def _whole_words(text: bytes, start: int, end: int) -> bool:
    """Whether a stretch of a plain form begins and ends where words do."""
    return text[start - 1 : start] in (b"", b" ") and text[end : end + 1] in (b"", b" ")


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.patterns = [Pattern(i, t) for i, t in items if t]
        whole = np.frombuffer(b"".join(p.text for p in self.patterns), dtype=np.uint8)
        starts = np.cumsum([0, *[len(p.text) for p in self.patterns]])
        places: dict[int, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for a, b in pieces(p.text, p.k):
                places.setdefault(next((g for g in GRAMS if g <= b - a), b - a), []).append((n, a))
        total = _running(whole)
        self.grams = []
        for size, where in places.items():
            items_, offsets = (np.array(v, dtype=np.int64) for v in zip(*where, strict=True))
            self.grams.append(Gram(size, _gram_hashes(total, size)[starts[items_] + offsets], items_, offsets))

    def leaks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, list[dict]]:
        """Of each row that holds items: the best place of each within its budget (least distance, then first)."""
        if not self.patterns or not len(data):
            return {}
        total, found = _running(data), []
        for gram in self.grams:
            at, rows = gram.hits(total)
            doc = np.searchsorted(starts, at, "right") - 1
            inside = (at >= starts[doc]) & (at + gram.size <= ends[doc])
            doc, at, rows = doc[inside], at[inside], rows[inside]
            found.append(np.column_stack([doc, gram.items[rows], at - starts[doc] - gram.offsets[rows], gram.offsets[rows]]))
        hits, out, text, held = np.concatenate(found), {}, b"", -1
        if not len(hits):
            return {}
        hits = hits[np.lexsort(hits.T[::-1])]
        cuts = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1)])
        for a, b in zip(cuts, [*cuts[1:], len(hits)], strict=True):
            doc, n = int(hits[a, 0]), int(hits[a, 1])
            if doc != held:
                text, held = data[starts[doc] : ends[doc]].tobytes(), doc
            leak = self._best(self.patterns[n], text, hits[a:b, 2:].tolist())
            if leak:
                out.setdefault(doc, []).append(leak)
        return out

    @staticmethod
    def _best(p: Pattern, text: bytes, at: list[list[int]]) -> dict | None:
        """The best place of an item, over (start, offset of the piece) of its hits in order."""
        m, best = len(p.text), None
        ends = dict(pieces(p.text, p.k))
        runs: list[list[int]] = []
        for s, offset in at:
            if text[s + offset : s + ends[offset]] != p.text[offset : ends[offset]]:
                continue
            if s >= 0 and text.startswith(p.text, s) and (p.k or _whole_words(text, s, s + m)):
                best = min(best or (1,), (0, s, s + m))
            if not p.k:
                continue
            if runs and s - runs[-1][1] <= p.k:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        for a, b in [] if best else runs:
            low = max(0, a - p.k)
            window = text[low : b + m + p.k]
            if not p.may_hold(window):
                continue
            distance, end = p.best(window)
            if distance <= p.k:
                best = min(best or (m + 1,), (distance, max(low, low + end - m), low + end))
        return best and {"item_id": p.item_id, "distance": best[0], "start": best[1], "end": best[2]}


def item_blocks(benchmark: DataFrame, text_col: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """Items in plain form, in blocks of about ``BLOCK_BYTES``."""
    block, held = [], 0
    rows = benchmark.select("item_id", text_col).where(F.col("item_id").isNotNull() & F.col(text_col).isNotNull()).toLocalIterator()
    for item_id, text in rows:
        plain = next(plain_texts(pa.array([text]))).encode("latin-1")
        block.append((item_id, plain))
        held += len(plain)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """``docs`` with ``out_col``: the items that each text holds, with distance and place.

    Places are offsets in the plain form's UTF-8 bytes, end exclusive; of several places of
    one item the closest counts, then the first. Null and empty texts hold nothing: an empty
    array; where there is no item to search for, the column is null. Items that are null or
    have no letter or digit match nothing; repeated rows are searched like any others; items
    of one id are items of their own. Items too short for an edit (under 13 bytes) count as
    whole words only: "art" is not in "party". A column called like ``out_col`` is replaced.
    """
    out = docs.drop(out_col)
    names = out.columns
    at = names.index(text_col)
    schema = T.StructType([*out.schema.fields, T.StructField(out_col, LEAK)])

    def searching(block):
        def run(batches):
            matcher = Matcher(block)
            for batch in batches:
                had = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [[]] * batch.num_rows
                rows = list(had)
                for first, data, starts, ends in plain_chunks(batch.column(at)):
                    for doc, leaks in matcher.leaks(data, starts, ends).items():
                        rows[first + doc] = rows[first + doc] + leaks
                yield pa.record_batch([*batch.columns[: len(names)], pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))], names=[*names, out_col])

        return run

    for block in item_blocks(benchmark):
        out = map_batches(out, searching(block), schema)
    return out if out_col in out.columns else out.withColumn(out_col, F.lit(None).cast(LEAK))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("e")).select("doc_id", "e.item_id", "e.distance", F.col("e.start").alias("match_start"), F.col("e.end").alias("match_end"))
