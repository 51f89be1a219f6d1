"""Approximate nearest neighbours by learned partitions.

A bounded sample is linked into a neighbour graph, which is cut into parts of equal size
(Dong et al., 2020). A small network learns which parts a vector's neighbours lie in. It
files every vector under its most probable part, and sends each query to its several most
probable parts, where all vectors are ranked by their exact distance. A query visits parts
until their probabilities reach a set mass, so that a query near a border visits more.

The parts grow with the table: from ``SECOND_LEVEL`` vectors on, each part is cut again in
the same way, by a network of its own that a task trains on a bounded sample of the part,
and a query's probabilities are the products of both levels.

Vectors of one length are one search: the most frequent lengths have parts of their own,
all vectors of another length are one part. Parts are split into blocks of bounded size by
a hash, and so are a part's queries, so that a part with a third of all vectors is many tasks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise, table

#: At most so many vectors (lowest hashes first) shape the parts and train the router.
SAMPLE_ROWS = 8192
GRAPH_NEIGHBOURS = 30
PARTS = 64
#: From so many vectors of a length on, each part is cut into up to ``PARTS`` parts again.
SECOND_LEVEL = 4_000_000
#: So many lengths of vectors, the most frequent ones, get parts that are learnt.
LENGTHS = 8
#: Probability of the parts that a query visits; recall on vectors without structure is about as high.
MASS = 0.95
#: Where parts are cut again, two networks may err: what the mass leaves out is taken times this.
SECOND_LEFT_OUT = 0.4
#: Vectors, and queries, for one task of a part; more are split by a hash of the id.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of the sample, itself excluded."""
    norms = (x * x).sum(1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        d = norms[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _balanced(cost: np.ndarray, room: int) -> np.ndarray:
    """Each row to its cheapest column with room left; rows that lose most by waiting go first."""
    order = np.argsort(cost, axis=1)
    best_two = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.zeros((len(cost), 2))
    left, part = np.full(cost.shape[1], room), np.full(len(cost), -1)
    for i in np.argsort(best_two[:, 0] - best_two[:, 1], kind="stable"):
        for p in order[i]:
            if left[p]:
                part[i], left[p] = p, left[p] - 1
                break
    return part


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 8, seed: int = 1) -> np.ndarray:
    """A cut of the neighbour graph into ``parts`` of equal size with few cut links.

    Starts from balanced centres and then reassigns all vertices by the parts of their
    neighbours, under the same sizes.
    """
    n, rng = len(x), np.random.default_rng(seed)
    room = -(-n // parts)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        part = _balanced((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, room)
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    a = np.repeat(np.arange(n), near.shape[1])
    a, b = np.r_[a, near.ravel()], np.r_[near.ravel(), a]
    best, least = part, np.inf
    for _ in range(sweeps):
        links = np.zeros((n, parts))
        np.add.at(links, (a, part[b]), 1.0)
        links[np.arange(n), part] += 0.5  # a little inertia
        part = _balanced(-links, room)
        cut = float((part[a] != part[b]).sum())
        if cut < least:
            best, least = part, cut
    return best


@dataclass(frozen=True)
class Router:
    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 2) -> Router:
    """One hidden layer, trained by Adam on the cross entropy with soft targets."""
    rng, (n, dim), parts = np.random.default_rng(seed), x.shape, target.shape[1]
    mean, scale = x.mean(0), float(x.std()) + 1e-12
    z = (x - mean) / scale
    ws = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
    ms, vs, t = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            zi, ti = z[order[at : at + 256]], target[order[at : at + 256]]
            h = np.maximum(zi @ ws[0] + ws[1], 0)
            o = h @ ws[2] + ws[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - ti) / len(zi)
            dh = (d @ ws[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((zi.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                ms[k], vs[k] = 0.9 * ms[k] + 0.1 * g, 0.999 * vs[k] + 0.001 * g * g
                ws[k] = ws[k] - 0.003 * (ms[k] / (1 - 0.9**t)) / (np.sqrt(vs[k] / (1 - 0.999**t)) + 1e-8) - 3e-5 * ws[k]
    return Router(mean, scale, *ws)


def fit_router(x: np.ndarray, parts: int = PARTS) -> Router:
    """Parts of the sample's neighbour graph, and the network that predicts them."""
    parts = max(1, min(parts, len(x) // 8))
    k = min(GRAPH_NEIGHBOURS, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(x.mean(0), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = _nearest(x, k)
    part = partition_graph(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[near.ravel()]), 1.0 / (k + 1))
    target[np.arange(len(x)), part] += 1.0 / (k + 1)
    return train_router(x, target)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, dim, x)`` of the rows that take part: an id and a finite vector other than zero."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("x"))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class Tree:
    """The routers of one length of vectors: the parts', and of some parts one more."""

    top: Router
    below: dict[int, Router]

    def visits(self, falling: np.ndarray, mass: float) -> np.ndarray:
        """How many parts each vector visits, from their falling probabilities; all for a mass of 1."""
        if mass >= 1:
            return np.full(len(falling), falling.shape[1])
        reach = 1 - (1 - mass) * SECOND_LEFT_OUT if self.below else mass
        return (np.cumsum(falling, axis=1) < reach).sum(1) + 1

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(names, one row of probabilities for each vector) of all last parts."""
        top = _softmax(self.top.logits(x))
        names, columns = [], []
        for part in range(top.shape[1]):
            inner = _softmax(self.below[part].logits(x)) if part in self.below else np.ones((len(x), 1))
            names += [part * PARTS + i for i in range(inner.shape[1])]
            columns.append(top[:, part : part + 1] * inner)
        return np.array(names), np.hstack(columns)


def _route(trees: dict[int, Tree], mass: float | None):
    """Rows with ``parts``: the most probable one, or all up to the mass. Equal rows of a batch are filed once."""

    def run(batches):
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                some = batch.take(pa.array(at))
                x = _matrix(some.column(2))
                if mass is None:
                    _, first = np.unique(np.column_stack([ids[at].view(np.float64), x]).view(np.uint64), axis=0, return_index=True)
                    first.sort()
                    some, x = some.take(pa.array(first)), x[first]
                if int(dim) not in trees:
                    parts = [[0]] * len(x)
                else:
                    names, p = trees[int(dim)].probabilities(x)
                    if mass is None:
                        parts = [[int(n)] for n in names[p.argmax(1)]]
                    else:
                        order = np.argsort(-p, axis=1, kind="stable")
                        visits = trees[int(dim)].visits(np.take_along_axis(p, order, 1), mass)
                        parts = [names[row[:m]].tolist() for row, m in zip(order, visits, strict=True)]
                yield pa.record_batch([*some.columns, pa.array(parts, pa.list_(pa.int32()))], names=["id", "dim", "x", "parts"])

    return run


def _train_part(group: pa.Table) -> pa.Table:
    """The router of one part, from its bounded sample."""
    router = fit_router(_matrix(group.column("x")))
    return pa.table({"dim": group.column("dim")[:1], "part": group.column("part")[:1], "router": pa.array([pickle.dumps(router)], pa.binary())})


def fit_trees(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, Tree]:
    """The routers of the most frequent lengths; samples are the rows of lowest hashes.

    At most ``LENGTHS`` samples reach the driver. Those of second routers stay in tasks; the
    routers that come back are at most ``LENGTHS * PARTS``, of some 100 KB each for 100 numbers.
    """
    trees, counts = {}, {}
    for r in rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(LENGTHS).collect():
        sample = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).select("x").toArrow()
        trees[r["dim"]], counts[r["dim"]] = Tree(fit_router(_matrix(sample.column("x"))), {}), r["count"]
    large = [d for d, n in counts.items() if n >= SECOND_LEVEL]
    if not large:
        return trees
    filed = materialise(rows.where(F.col("dim").isin(large)).mapInArrow(_route(trees, None), "id long, dim int, x array<double>, parts array<int>").select("dim", (F.col("parts")[0] / PARTS).cast("int").alias("part"), "id", "x"), "first-level")
    share = filed.groupBy("dim", "part").count().select("dim", "part", (F.lit(1.2 * sample_rows) / F.col("count")).alias("share"))
    # a hash of the row picks about as many rows as the sample may have from each part
    picked = filed.join(F.broadcast(share), ["dim", "part"]).where(F.pmod(F.xxhash64("id", "x", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    for r in picked.groupBy("dim", "part").applyInArrow(_train_part, "dim int, part int, router binary").collect():
        trees[r["dim"]].below[r["part"]] = pickle.loads(r["router"])
    return trees


def _rank_block(k: int):
    """The k nearest ids of a block to each of its queries, ties to the smaller id.

    An id counts once, by its nearest vector.
    """

    def run(_key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            q, x = _matrix(queries.column("x")), _matrix(rows.column("x"))
            q_ids, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            repeats = len(starts) < len(ids)
            names, ends = ids[starts], np.r_[starts[1:], len(ids)]
            norms, longest = (x * x).sum(1), (x * x).sum(1).max()
            for a in range(0, len(q), 256):
                qs = q[a : a + 256]
                rough = norms[None, :] - 2 * qs @ x.T
                if repeats:
                    rough = np.minimum.reduceat(rough, starts, axis=1)
                rough[q_ids[a : a + 256, None] == names[None, :]] = np.inf
                kth = np.partition(rough, min(k, len(names)) - 1, axis=1)[:, min(k, len(names)) - 1]
                slack = 1e-9 * ((qs * qs).sum(1) + longest)  # rounding of the product form
                for i in range(len(qs)):
                    near = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & (rough[i] < np.inf))
                    if repeats:
                        exact = np.array([np.sqrt(((x[starts[n] : ends[n]] - qs[i]) ** 2).sum(1)).min() for n in near])
                    else:
                        exact = np.sqrt(((x[near] - qs[i]) ** 2).sum(1))
                    best = np.lexsort((names[near], exact))[:k]
                    out["query_id"].append(np.full(len(best), q_ids[a + i]))
                    out["vec_id"].append(names[near[best]])
                    out["score"].append(exact[best])
        join = lambda v, kind: pa.array(np.concatenate(v) if v else np.zeros(0), kind)
        return pa.table({"query_id": join(out["query_id"], pa.int64()), "vec_id": join(out["vec_id"], pa.int64()), "score": join(out["score"], pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, mass: float = MASS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found by Euclidean distance.

    ``is_query`` is a condition on the column ``id``. Every vector is indexed; a row of the
    query's own id is no candidate. Null, zero, non-finite vectors and null ids take no
    part; a vector has no distance to one of another length, so that only equal lengths are
    neighbours. A ``mass`` of 1 visits all parts and is exact. Equal distances go to the smaller id; fewer candidates give fewer rows.
    Repeated rows count once; of several vectors under one id, and of several queries
    under one id, the nearest pair counts. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = rows.sparkSession
    trees = fit_trees(rows, sample_rows)
    if not trees:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    schema = "id long, dim int, x array<double>, parts array<int>"
    filed = materialise(rows.mapInArrow(_route(trees, None), schema).select("id", "dim", "x", F.col("parts")[0].alias("part")), "filed")
    asked = materialise(rows.where(is_query).mapInArrow(_route(trees, mass), schema).select("id", "dim", "x", F.explode("parts").alias("part")), "asked")
    # sizes of the parts, as many rows as parts
    place = ["dim", "part"]
    sizes = filed.groupBy(*place).count().withColumnRenamed("count", "n").join(asked.groupBy(*place).count().withColumnRenamed("count", "m"), place)
    cuts = sizes.select(*place, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("lanes"))
    salt = F.xxhash64("id", "x")
    row_side = filed.join(cuts, place).select(*place, F.pmod(salt, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "id", "x")
    query_side = asked.join(cuts, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(salt, F.col("lanes")).cast("int").alias("lane"), "id", "x")
    keys = [*place, "block", "lane"]
    found = query_side.groupBy(*keys).cogroup(row_side.groupBy(*keys)).applyInArrow(_rank_block(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    merged = once.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return merged.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op2_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
