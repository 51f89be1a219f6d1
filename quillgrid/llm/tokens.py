"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram model splits a pre-token into the vocabulary pieces of the greatest summed
log-probability. The best score of a prefix depends on the prefix alone, so distinct
pre-tokens are inserted in a trie, whose nodes hold the score and the number of pieces;
shared prefixes are scored once, and terminals keep their counts for repeated words.

Counting is a map over batches without a shuffle. Each task grows its own trie; its nodes
are dropped when they reach ``MAX_NODES``, and so are its terminals; long words are scored
without being stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import free_name, map_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands before every pre-token
MAX_NODES = 800_000
LONG_WORD = 64
#: How much less likely than the rarest piece a byte of an unknown character is.
BYTE_PENALTY = 10.0


def unigram_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Log-probabilities of a vocabulary's pieces; Zipf's law on their rank where it stores ranks only."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


class PrefixScores:
    """A trie whose nodes are (score, pieces); the best split of the prefix that ends there."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES) -> None:
        self.scores, self.max_nodes = scores, max_nodes
        #: Lengths of the pieces that end in two given characters.
        self.lengths: dict[str, list[int]] = {}
        for piece in scores:
            if len(piece) > 1:
                self.lengths.setdefault(piece[-2:], []).append(len(piece))
        self.lengths = {end: sorted(set(n)) for end, n in self.lengths.items()}
        self.unknown = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.terminals: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.nodes: list[tuple[float, int]] = [(0.0, 0)]

    def _forward(self, word: str, end: int, before: list[tuple[float, int]]) -> tuple[float, int]:
        """The best (score, fewer pieces on a tie) of ``word[:end]`` from those of its prefixes."""
        scores, c = self.scores, word[end - 1]
        score, n = before[end - 1]
        alone = scores.get(c)
        if alone is None:  # bytes stand for a character without a piece, and are worse than any piece
            size = len(c.encode())
            score, n = score + size * self.unknown, n + size
        else:
            score, n = score + alone, n + 1
        for length in self.lengths.get(word[end - 2 : end], ()) if end > 1 else ():
            if length > end:
                break
            piece = scores.get(word[end - length : end])
            if piece is not None:
                low, m = before[end - length]
                low += piece
                if low > score or (low == score and m + 1 < n):
                    score, n = low, m + 1
        return score, n

    def insert(self, raw: bytes) -> int:
        word = MARK + raw.decode("utf-8", "replace")
        states = [(0.0, 0)]
        if len(word) > LONG_WORD:
            for end in range(1, len(word) + 1):
                states.append(self._forward(word, end, states))
            return states[-1][1]
        at = 0
        for end, c in enumerate(word, 1):
            child = self.children[at].get(c)
            if child is None:
                child = len(self.nodes)
                self.children[at][c] = child
                self.children.append({})
                self.nodes.append(self._forward(word, end, states))
            at = child
            states.append(self.nodes[at])
        self.terminals[raw] = states[-1][1]
        return states[-1][1]

    def count(self, words: list[bytes]) -> int:
        """Pieces of all the words."""
        if len(self.nodes) > self.max_nodes:
            self._clear()
        if len(self.terminals) > self.max_nodes:
            self.terminals.clear()
        extra = {w: self.insert(w) for w in set(words).difference(self.terminals)}
        known = self.terminals.get
        return sum([known(w) or extra[w] for w in words])


def count_tokens(docs: DataFrame, scores: dict[str, float], text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``n_pretokens`` and ``n_tokens``.

    Pre-tokens are runs without ASCII white space. Null and empty texts have none; repeated
    rows are counted like any others; an empty table gives an empty one. Columns called
    n_pretokens or n_tokens, in any case, are replaced; no other name can clash.
    """
    own = ("n_pretokens", "n_tokens")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(free_name(docs, "counted_text")))

    def run(batches):
        trie = PrefixScores(scores)
        for batch in batches:
            pre, tok = [], []
            for text in batch.column(len(keep)).to_pylist():
                words = (text or "").encode().split()
                pre.append(len(words))
                tok.append(trie.count(words))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(pre, pa.int64()), pa.array(tok, pa.int64())], names=[*keep, "n_pretokens", "n_tokens"])

    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_batches(rows, run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), unigram_scores(), keep=["doc_id"])
