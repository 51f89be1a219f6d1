"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_GOLD, _MIX1, _MIX2, _BASE = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
_BASE_INV = U(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = ~_SPACE
#: A value of 64 bits for each byte; the same for both cases of a letter.
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE[_LOWER]
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    half = x >> U(30)
    x = x ^ half
    x *= _MIX1
    x ^= np.right_shift(x, U(27), out=half)
    x *= _MIX2
    x ^= np.right_shift(x, U(31), out=half)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown to the longest chunk seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full(size - 1, b)], dtype=np.uint64) for b in (_BASE, _BASE_INV))
        return self.up, self.down


_POWERS = _Powers()


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes (one row at least): first row, end, bytes, offsets.

    Null texts are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row (A-Z lower-cased, split at ASCII white space), and words per row.

    One very long row is hashed in stretches of about ``CHUNK_BYTES`` that end at white space.
    """
    if len(offsets) != 2 or len(data) <= 2 * CHUNK_BYTES:
        return _word_hashes(data, offsets)
    found, at = [], 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data) and not _SPACE[data[end : end + 4096]].any():
            end += 4096
        if end < len(data):
            end += int(np.argmax(_SPACE[data[end : end + 4096]]))
        end = min(end, len(data))
        found.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    words = np.concatenate(found)
    return words, np.array([len(words)])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    word = _WORD[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:n] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (first[1:] | np.r_[~word[1:], True])) + 1
    up, down = _POWERS.upto(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    weighted = _FOLDED[data]
    weighted *= up[:n]
    np.cumsum(weighted, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)
    per_row = np.diff(np.searchsorted(starts, offsets))
    return hashes, per_row


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values, of one at least; ``np.unique`` goes by a hash table, which is slower here."""
    values = np.sort(values)
    new = values[1:] != values[:-1]
    return values if new.all() else values[np.r_[True, new]]


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each chunk the first row's index and each row's sorted distinct shingle hashes.

    A text of fewer words than ``size`` has its whole sequence as the one shingle.
    """
    for at, end, data, offsets in chunks(texts):
        words, per_row = word_hashes(data, offsets)
        stop = np.cumsum(per_row)
        m = max(0, len(words) - size + 1)
        rolled = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            rolled ^= rolled >> U(29)
            rolled *= _MIX1
            rolled += words[k : k + m]
        rolled = mix(rolled)
        sets = []
        for row in range(end - at):
            n, last = int(per_row[row]), int(stop[row])
            if n >= size:
                sets.append(distinct(rolled[last - n : last - size + 1]))
            elif n:
                short = U(n)
                with np.errstate(over="ignore"):
                    for w in words[last - n : last]:
                        short = (short ^ (short >> U(29))) * _MIX2 + w
                sets.append(mix(np.array([short], dtype=np.uint64)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        yield at, sets


def signatures(sets: list[np.ndarray]) -> list[int | None]:
    """One 64-bit value of each whole set, as a signed integer; None for a set without values."""
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    some = lens > 0
    if not some.any():
        return [None] * len(sets)
    values, starts = np.concatenate(sets), np.r_[0, np.cumsum(lens[some])[:-1]]
    added = mix(np.add.reduceat(mix(values), starts) + lens[some].astype(np.uint64) * _GOLD)
    values *= _MIX2
    found = iter((added * _MIX1 + mix(np.bitwise_xor.reduceat(values, starts))).view(np.int64).tolist())
    return [next(found) if x else None for x in some]
