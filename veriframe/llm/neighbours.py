"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors a neighbour graph is built and partitioned into balanced parts with few edges between
them. A small classifier learns from a vector how its neighbours spread over the parts. Every vector is filed under its
most probable part; a query is routed to several, the most probable first, and the vectors filed there are ranked again by
their exact distance. There are as many parts as the table asks for: where one classifier can't tell so many, each of its
parts has a classifier of its own, fitted in a task on a bounded sample of that part. Parts are searched in blocks of bounded
size, for files and queries alike, so neither a large part nor many copies of one vector ever meet in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut

#: Vectors that a partition and its classifier are fitted on, at most; and for each of its parts.
SAMPLE, SAMPLE_PER_PART = 4096, 64
GRAPH_NEIGHBOURS = 12
#: Vectors of a part, about; parts that one classifier tells apart, at least and at most.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4000, 16, 128
#: Parts are searched in order of probability until it adds up to this much, and until they hold this many vectors for
#: each neighbour that is asked for.
MASS, SPARE = 0.96, 20
#: Vectors and queries of one block, at most on average.
BLOCK_ROWS, BLOCK_QUERIES = 4000, 500
#: Vectors routed at once.
ROUTED = 512


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row its k nearest other rows."""
    norms = (x**2).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 10) -> np.ndarray:
    """A part for each row: balanced k-means seeds the parts, then rows move to where most of their neighbours are.

    No part holds more than a tenth above its share. In each round the moves that gain most edges go first, as far as
    there is room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    room = -(-11 * n // (10 * parts))
    centres = x[rng.choice(n, parts, replace=False)].astype(float)
    part = np.zeros(n, np.int64)
    for _ in range(15):
        d = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).astype(float)
        part = np.full(n, -1)
        left = np.full(parts, room)
        for rank in range(parts):  # first choices first, the clearest of them before others
            todo = np.flatnonzero(part < 0)
            if not len(todo):
                break
            choice = np.where(left[None, :] > 0, d[todo], np.inf)
            best = choice.argmin(axis=1)
            for p in range(parts):
                mine = todo[best == p]
                mine = mine[np.argsort(d[mine, p], kind="stable")][: left[p]]
                part[mine] = p
                left[p] -= len(mine)
        centres = np.array([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
    source = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(12):
        ties = np.zeros((n, parts))
        np.add.at(ties, (both[0], part[both[1]]), 1)
        gain = ties - ties[np.arange(n), part][:, None]
        target = gain.argmax(axis=1)
        best = gain[np.arange(n), target]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-best, kind="stable"):
            if best[i] <= 0:
                break
            if sizes[target[i]] < room:
                sizes[part[i]] -= 1
                sizes[target[i]] += 1
                part[i] = target[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer that gives the probability of each part for a vector."""

    def __init__(self, centre, scale, w1, b1, w2, b2):
        self.centre, self.scale, self.w1, self.b1, self.w2, self.b2 = centre, scale, w1, b1, w2, b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def __len__(self) -> int:
        return self.w2.shape[1]


class Tree:
    """A router over parts and, if there are many, one for each part; leaf p * fan + q is part q of part p."""

    def __init__(self, top: Router, below: dict[int, Router] | None = None, fan: int = 1):
        self.top, self.below, self.fan = top, below or {}, fan

    def __len__(self) -> int:
        return len(self.top) * self.fan

    def file(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector, level by level."""
        part = self.top.probabilities(x).argmax(axis=1)
        leaf = part * self.fan
        for p in np.unique(part) if self.below else ():
            mine = part == p
            leaf[mine] += self.below[p].probabilities(x[mine]).argmax(axis=1)
        return leaf

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The probability of each leaf; those of parts beyond MASS stay 0."""
        top = self.top.probabilities(x)
        if not self.below:
            return top
        order = np.argsort(-top, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(top, order, axis=1), axis=1) - np.take_along_axis(top, order, axis=1)
        searched = np.zeros(top.shape, bool)
        np.put_along_axis(searched, order, before < MASS, axis=1)
        out = np.zeros((len(x), len(self)))
        for p in np.flatnonzero(searched.any(axis=0)):
            mine = np.flatnonzero(searched[:, p])
            inner = self.below[p].probabilities(x[mine])
            out[mine[:, None], p * self.fan + np.arange(inner.shape[1])[None, :]] = inner * top[mine, p][:, None]
        return out


def fit_router(x: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 10) -> Router:
    """A router trained so that a vector's probabilities are the shares of its graph neighbours (and itself) in the parts."""
    n, dim = x.shape
    parts = max(1, min(parts, n // 32))
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std() + 1e-12
    if parts == 1:
        return Router(centre, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, min(GRAPH_NEIGHBOURS, n - 1))
    part = balanced_partition(x, graph, parts)
    target = np.zeros((n, parts))
    for j in range(graph.shape[1]):
        target[np.arange(n), part[graph[:, j]]] += 1
    target[np.arange(n), part] += 2
    target /= target.sum(axis=1, keepdims=True)
    z = (x - centre) / scale
    weights = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
            a = z[batch] + rng.normal(0, 0.15, (len(batch), dim))
            h = np.maximum(a @ weights[0] + weights[1], 0)
            o = h @ weights[2] + weights[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[batch]) / len(batch)
            gh = (g @ weights[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate([a.T @ gh + 1e-4 * weights[0], gh.sum(axis=0), h.T @ g + 1e-4 * weights[2], g.sum(axis=0)]):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                weights[k] -= 0.002 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(centre, scale, *weights)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the rows whose vectors are not null, empty or zero and hold finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def common_length(rows: DataFrame) -> int:
    """The length that most vectors have, the least of several; 0 without rows."""
    found = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return found["size"] if found else 0


def drawn(rows: DataFrame, sample: int) -> np.ndarray:
    """The distinct vectors of least hash, `sample` at most. Hashes are made distinct first, so copies count once."""
    hashed = rows.select("v", F.xxhash64("v").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return np.empty((0, 0))
    return np.array(hashed.filter(F.col("h") <= last).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").toArrow().column("v").to_pylist())


def _fit_part(fan: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.array(rows["v"].tolist()), axis=0)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [pickle.dumps(fit_router(x, fan))]})

    return run


def fit(rows: DataFrame, sample: int = SAMPLE, parts: int | None = None, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> Tree | None:
    """Routers for rows (id, v), each fitted on a bounded sample; None without rows.

    parts None: one for each part_rows vectors, on two levels if they are more than most_parts.
    """
    n = rows.count() if parts is None else 0
    top_parts = parts or min(most_parts, max(LEAST_PARTS, n // part_rows))
    x = drawn(rows, max(sample, SAMPLE_PER_PART * top_parts))
    if not len(x):
        return None
    top = fit_router(x, top_parts)
    fan = min(most_parts, -(-n // (len(top) * part_rows)))
    if parts is not None or n <= 2 * most_parts * part_rows or fan < 2:
        return Tree(top)
    # One row a part comes back, of at most most_parts; a part's sample is drawn like that of the whole.
    filed = rows.mapInArrow(_file(Tree(top)), "id long, v array<double>, part int").select("part", "v", F.xxhash64("v").alias("h"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h"))
    picked = filed.withColumn("rank", rank).filter(F.col("rank") <= max(sample, SAMPLE_PER_PART * fan)).select("part", "v")
    below = {r["part"]: pickle.loads(r["router"]) for r in picked.groupBy("part").applyInPandas(_fit_part(fan), "part int, router binary").toLocalIterator()}
    empty = fit_router(x[:1], 1)
    return Tree(top, {p: below.get(p, empty) for p in range(len(top))}, fan)


def _file(tree: Tree):
    """Each row with the leaf that it is filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.file(_matrix(batch.column(1))), pa.int32())], names=["id", "v", "part"])

    return run


def _route(tree: Tree, filed: np.ndarray, least: int):
    """Each row once for each leaf to search, given how many vectors are filed under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROUTED):
                batch = whole.slice(at, ROUTED)
                p = tree.probabilities(_matrix(batch.column(1)))
                order = np.argsort(-p, axis=1, kind="stable")
                mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                held = np.cumsum(filed[order], axis=1)
                used = np.minimum(np.maximum((mass < MASS * mass[:, -1:]).sum(axis=1), (held < least).sum(axis=1)) + 1, p.shape[1])
                row = np.repeat(np.arange(len(batch)), used)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order[row, rank], pa.int32())], names=["id", "v", "part"])

    return run


def _rerank(k: int):
    """The k nearest of each block's queries: one matrix product tells which can be, and these are measured exactly."""

    def run(key, queries: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(files):
            x, ids = np.array(files["v"].tolist()), files["id"].to_numpy()
            asked, names = np.array(queries["v"].tolist()), queries["query_id"].to_numpy()
            norms, own = (x**2).sum(axis=1), (asked**2).sum(axis=1)
            most = min(k, len(x)) - 1
            for at in range(0, len(asked), 64):
                near = norms[None, :] + own[at : at + 64, None] - 2 * asked[at : at + 64] @ x.T
                near[names[at : at + 64, None] == ids[None, :]] = np.inf
                limits = np.partition(near, most, axis=1)[:, most]
                for i, (row, limit) in enumerate(zip(near, limits, strict=True), at):
                    slack = 1e-9 * (own[i] + norms.max())  # more than the product can be off
                    may = np.flatnonzero((row <= limit + slack) & np.isfinite(row))
                    d = np.sqrt(((x[may] - asked[i][None, :]) ** 2).sum(axis=1))
                    first = np.lexsort((ids[may], d))[:k]
                    out.append(pd.DataFrame({"query_id": names[i], "id": ids[may][first], "score": d[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int | None = None, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among all vectors but its own row's id.

    Distances are Euclidean, in double precision, on the vectors as they are; ties go to the smaller id. Rows whose id or
    vector is null, and whose vector is empty, zero or holds null or non-finite numbers, take no part on either side, nor do
    those whose length is not the most common one among vectors (the least of several). Rows of one id are candidates one
    by one, but a query's id is asked once, with its least vector. Other columns are not read; without vectors or queries
    the result is empty.
    """
    rows = valid(vectors, id_col, vector_col)
    size = common_length(rows)
    rows = rows.filter(F.size("v") == size)
    tree = fit(rows, sample, parts, part_rows, most_parts)
    empty = "query_id long, rank int, vec_id long, score double"
    if tree is None:
        return vectors.sparkSession.createDataFrame([], empty)
    kind = "id long, v array<double>, part int"
    filed = rows.mapInArrow(_file(tree), kind)
    sizes = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf
    held = np.array([sizes.get(p, 0) for p in range(len(tree))])
    once = valid(queries, id_col, vector_col).filter(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))
    asked = cut(once.mapInArrow(_route(tree, held, SPARE * k), kind))

    # Blocks: as many as the parts' sizes ask for, so that no pair of blocks grows with the table.
    wanted = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = [(p, -(-n // BLOCK_ROWS), -(-wanted.get(p, 0) // BLOCK_QUERIES)) for p, n in sizes.items() if wanted.get(p)]
    shape = F.broadcast(vectors.sparkSession.createDataFrame(table or [(-1, 1, 1)], "part int, files int, asks int"))  # a row for each part
    file_rows = filed.join(shape, "part").select(
        "part", "id", "v", F.pmod(F.xxhash64("id", "v"), F.col("files")).cast("int").alias("file"), F.explode(F.sequence(F.lit(0), F.col("asks").cast("int") - 1)).alias("ask")
    )
    ask_rows = asked.join(shape, "part").select(
        "part", F.col("id").alias("query_id"), "v", F.explode(F.sequence(F.lit(0), F.col("files").cast("int") - 1)).alias("file"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("asks")).cast("int").alias("ask")
    )
    keys = ["part", "file", "ask"]
    near = ask_rows.groupBy(*keys).cogroup(file_rows.groupBy(*keys)).applyInPandas(_rerank(k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
