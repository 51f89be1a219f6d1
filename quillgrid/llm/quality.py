"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model that minimises the
non-negative unbiased risk (Kiryo et al., 2017): pi * R+(positives as 1) + max(0, R-(all
unlabelled as 0) - pi * R-(positives as 0)). The class prior pi is estimated first, from a
classifier of labelled against unlabelled rows (Elkan and Noto, 2008).

The features describe a text's form and need no language, source, label or id. Scoring is
a map over batches: no shuffle, memory bounded by a chunk of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import table
from quillgrid.llm.shingles import _MIX1, chunks, mix, word_hashes

#: At most so many positives, and so many unlabelled rows, train the model (lowest hashes first).
SAMPLE_ROWS = 8000
FEATURES = ("log_words", "upper", "digits", "symbols", "stops", "spaces", "lines", "distinct_words", "distinct_pairs", "repeats", "top_word", "word_length", "non_ascii", "single")

_CLASS = np.zeros((256, 7))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*|!<>=@^~\\/{}[]_+", b".,;:?'\"()-", b" \t\r\n\v\f", b"\n")):
    _CLASS[list(_set), _k] = 1


def byte_counts(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """How often each byte occurs in each row; long rows are counted in steps, as counting widens bytes."""
    out = np.zeros((len(offsets) - 1, 256))
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for at in range(a, b, step):
            out[row] += np.bincount(data[at : min(b, at + step)], minlength=256)
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; empty and null texts give zeros.

    A very long text is a chunk of its own; what is held beside it are 8 bytes a word, three times.
    """
    out = []
    for at, end, data, offsets in chunks(texts):
        rows = end - at
        size = np.maximum(np.diff(offsets), 1).astype(float)
        counts = byte_counts(data, offsets)
        upper, lower, digits, symbols, stops, spaces, lines = (counts @ _CLASS).T
        high = counts[:, 128:].sum(1)
        words, per_row = word_hashes(data, offsets)
        stop = np.cumsum(per_row)
        pairs = mix(words[:-1] * _MIX1 + words[1:]) if len(words) > 1 else words[:0]
        same = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1)
        n = np.maximum(per_row, 1).astype(float)
        distinct, top, doubles, repeats = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        for row in range(rows):
            b, m = int(stop[row]), int(per_row[row])
            if m:
                _, counts = np.unique(words[b - m : b], return_counts=True)
                distinct[row], top[row] = len(counts) / m, counts.max() / m
                doubles[row] = len(np.unique(pairs[b - m : b - 1])) / (m - 1) if m > 1 else 1
                repeats[row] = (same[b - 1] - same[b - m]) / m
        letters = np.maximum(upper + lower, 1)
        out.append(
            np.column_stack(
                [np.log1p(per_row), upper / letters, digits / size, symbols / size, stops / size, spaces / size, lines / n, distinct, doubles, repeats, top, (size - spaces) / n, high / size, 1 / n]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(_expand((features - self.mean) / self.scale) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Adds squares; values are clipped, so that odd texts do not run away."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, x * x])


def _descend(gradient, dims: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Adam on weights and a last bias; the bias does not decay."""
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: mean labelled-probability there over that of positives."""
    both, y = np.vstack([pos, unl]), np.r_[np.ones(len(pos)), np.zeros(len(unl))]
    share = np.r_[np.full(len(pos), 0.5 / len(pos)), np.full(len(unl), 0.5 / len(unl))]
    w = _descend(lambda w: np.r_[both.T @ (d := share * (_sigmoid(both @ w[:-1] + w[-1]) - y)), d.sum()], both.shape[1])
    odds = lambda x: np.exp(np.clip(x @ w[:-1] + w[-1], -20, 20))  # noqa: E731  density ratio of labelled to unlabelled
    # among positives the ratio is 1 / prior; its median there is robust to overlap
    return float(np.clip(1 / np.median(odds(pos)), 0.05, 0.98))


def nnpu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The direction in which weights and bias (last) descend, for positives ``p`` and unlabelled ``u``.

    The gradient of the unbiased risk, as long as its estimate of the negatives' risk is not
    below zero; else the gradient that raises this estimate again.
    """
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    sp, su = _sigmoid(zp), _sigmoid(zu)
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if as_negative >= 0:
        dp, du = prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)
    else:
        dp, du = prior * sp / len(p), -su / len(u)
    return np.r_[p.T @ dp + u.T @ du, dp.sum() + du.sum()]


def fit_nnpu(pos: np.ndarray, unl: np.ndarray) -> QualityModel:
    """The model of least non-negative risk on features of positives and unlabelled rows.

    Without positives or unlabelled rows nothing can be learnt and every score is 0.5.
    """
    dims = len(FEATURES)
    if not len(pos) or not len(unl):
        return QualityModel(np.zeros(dims), np.ones(dims), np.zeros(2 * dims), 0.0, 0.5)
    mean, scale = unl.mean(0), unl.std(0) + 1e-6
    p, u = _expand((pos - mean) / scale), _expand((unl - mean) / scale)
    prior = estimate_prior(p, u)
    w = _descend(lambda w: nnpu_gradient(w, p, u, prior), p.shape[1])
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Trains on at most ``sample_rows`` positives and as many unlabelled rows, none held out.

    Rows labelled 0 take no part. Null ids and null labels are ignored; of contradicting
    labels of one id the greatest counts. A chosen id gives one row, however often it
    occurs: that of the least features.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = ids.join(marks, "doc_id", "left")
    pick = lambda which: known.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = pick(F.col("quality") == 1).select("doc_id", F.lit(1).alias("_pos")).union(pick(F.col("quality").isNull()).select("doc_id", F.lit(0)))

    def run(batches):
        for batch in batches:
            rows = text_features(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "pos", "x"])

    # two limits bound the chosen ids
    described = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_pos", "text").mapInArrow(run, "doc_id long, pos int, x array<double>")
    rows = described.groupBy("doc_id", "pos").agg(F.min("x").alias("x")).collect()
    part = lambda k: np.array(sorted(r["x"] for r in rows if r["pos"] == k)).reshape(-1, len(FEATURES))  # noqa: E731  sorted: the fit does not depend on task order
    return fit_nnpu(part(1), part(0))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``out_col``: the model's probability that the text is of quality."""
    names = [c for c in docs.columns if c != out_col]
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(model.score(text_features(batch.column(at))))], names=[*batch.schema.names, out_col])

    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(out_col, T.DoubleType())])
    return docs.select(*names).mapInArrow(run, schema)


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, out_col="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
