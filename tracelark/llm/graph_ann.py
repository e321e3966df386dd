"""Approximate nearest neighbours by inner product, with a robust-pruned directed graph in every shard.

Equal vectors are one node that carries its smallest vec_ids (one more than the number of neighbours asked for, which is
all that an answer can hold). Nodes are dealt to shards by a hash. In a shard, one further coordinate gives all vectors
the same norm, so that the largest inner product is the smallest Euclidean distance; then greedy beam searches propose
neighbours of each node, robust pruning keeps a candidate only if no kept neighbour is nearer to it by the factor
``alpha``, and back edges are added and pruned alike (two passes, alpha 1 and ``alpha``). Every query visits every shard: a
beam search gives candidates, whose inner products are taken again in double precision on the original vectors, and the
shards' lists are merged by query. Queries come in blocks of about ``query_rows``: a task's unit is one shard and one block.
The index is written, so that no lost executor makes a graph be built twice.

The index is built for all rows. Recall depends on ``beam``; tests and the README hold it against brute force.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do null ids;
of rows that repeat a vec_id the smallest vector counts; neighbours that tie are ranked by the smaller vec_id, within a shard
and across shards; vectors are only compared with vectors of their own length; with
fewer candidates than asked for, all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

NODES = "shard int, dim int, ids array<long>, vector array<double>"
INDEX = "shard int, dim int, ids array<long>, vector array<double>, node int, out array<int>"
FOUND = "query_id long, vec_id long, score double"


class Graph:
    """A directed graph over the rows of x, all of one norm."""

    def __init__(self, x: np.ndarray, degree: int):
        self.x = x.astype(np.float32)
        n = len(x)
        self.out = np.full((n, degree), -1, dtype=np.int32)
        mean = self.x.mean(axis=0) if n else None
        self.entry = int(np.argmax(self.x @ mean)) if n else 0

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once: (ids, inner products), best first, -1 where nothing was found."""
        n, k = len(self.x), len(q)
        q = q.astype(np.float32)
        ids = np.full((k, beam), -1, dtype=np.int32)
        sim = np.full((k, beam), -np.inf, dtype=np.float32)
        done = np.ones((k, beam), dtype=bool)
        seen = np.zeros((k, n), dtype=bool)
        ids[:, 0], sim[:, 0], done[:, 0], seen[:, self.entry] = self.entry, q @ self.x[self.entry], False, True
        rows = np.arange(k)
        while len(rows):
            d = done[rows]
            live = np.argsort(np.where(d, np.inf, -sim[rows]), axis=1, kind="stable")[:, :width]
            fresh = ~np.take_along_axis(d, live, axis=1)
            take = np.take_along_axis(ids[rows], live, axis=1)
            d[np.arange(len(rows))[:, None], live] = True
            done[rows] = d
            near = np.where(fresh[:, :, None], self.out[take], -1).reshape(len(rows), -1)
            ok = (near >= 0) & ~seen[rows[:, None], near]
            near = np.where(ok, near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            ok = near >= 0
            at_row, at_col = np.nonzero(ok)
            seen[rows[at_row], near[at_row, at_col]] = True
            s = np.full(near.shape, -np.inf, dtype=np.float32)
            s[at_row, at_col] = np.einsum("nd,nd->n", q[rows[at_row]], self.x[near[at_row, at_col]])
            all_s = np.concatenate([sim[rows], s], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sim[rows] = np.take_along_axis(all_s, best, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), best, axis=1)
            done[rows] = np.take_along_axis(np.concatenate([d, ~ok], axis=1), best, axis=1)
            done[rows] |= ids[rows] < 0
            rows = rows[~done[rows].all(axis=1)]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)

    def prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates (-1: none) to at most the graph's degree."""
        degree = self.out.shape[1]
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[np.maximum(cand, 0)]
        norm = float((self.x[0].astype(np.float64) ** 2).sum())
        own = np.maximum(2 * (norm - np.einsum("ncd,nd->nc", v, self.x[nodes])), 0)
        own = np.where(cand < 0, np.inf, own)
        among = np.maximum(2 * (norm - np.matmul(v, v.transpose(0, 2, 1))), 0)
        alive = cand >= 0
        out = np.full((len(nodes), degree), -1, dtype=np.int32)
        r = np.arange(len(nodes))
        for k in range(degree):
            pick = np.argmin(np.where(alive, own, np.inf), axis=1)
            any_left = alive[r, pick]
            if not any_left.any():
                break
            out[:, k] = np.where(any_left, cand[r, pick], -1)
            alive &= ~((alpha * alpha * among[r, pick] <= own) | (np.arange(cand.shape[1]) == pick[:, None]))
        return out

    def build(self, beam: int, alpha: float, batch: int = 256, seed: int = 7) -> Graph:
        n, degree = self.out.shape
        if n < 2:
            return self
        r = np.random.default_rng(seed)
        start = r.integers(0, n, size=(n, min(degree, 12, n - 1)), dtype=np.int32)
        self.out[:, : start.shape[1]] = start
        for a in (1.0, alpha):
            order = r.permutation(n)
            for at in range(0, n, batch):
                nodes = order[at : at + batch]
                found, _ = self.search(self.x[nodes], min(beam, max(n, 2)))
                self.out[nodes] = self.prune(nodes, np.concatenate([found, self.out[nodes]], axis=1), a)
                self._back_edges(nodes, a)
        return self

    def _back_edges(self, nodes: np.ndarray, alpha: float) -> None:
        src = np.repeat(nodes, self.out.shape[1])
        dst = self.out[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        uniq, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = int(count.max())
        new = np.full((len(uniq), wide), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(uniq)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate([self.out[uniq], new], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        free = (both >= 0).sum(axis=1) <= self.out.shape[1]
        if free.any():
            b = -np.sort(-both[free], axis=1)[:, : self.out.shape[1]]
            self.out[uniq[free], : b.shape[1]] = b
        full = np.flatnonzero(~free)
        for at in range(0, len(full), 512):
            k = full[at : at + 512]
            self.out[uniq[k]] = self.prune(uniq[k], both[k], alpha)


def same_norm(x: np.ndarray) -> np.ndarray:
    """x with one more coordinate, so that all rows have the largest row's norm."""
    square = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): one row an id, without vectors that take no part."""
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nodes_of(vectors: DataFrame, keep_ids: int, shards: int) -> DataFrame:
    """Distinct vectors with their smallest ids: first within each task, so that a vector of a third of all rows is a row a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        vectors: dict[bytes, list[float]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([sorted(x)[:keep_ids] for x in held.values()], pa.list_(pa.int64())), pa.array([vectors[k] for k in held], pa.list_(pa.float64()))], names=["ids", "vector"]
            )
            held.clear()
            vectors.clear()
            return out

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = [y + 0.0 for y in x]  # -0.0 is 0.0
                key = np.array(x).tobytes()
                ids = held.setdefault(key, [])
                vectors.setdefault(key, x)
                ids.append(i)
                if len(ids) > 4 * keep_ids:
                    ids.sort()
                    del ids[keep_ids:]
            if len(held) > 100_000:
                yield flush()
        yield flush()

    got = vectors.mapInArrow(local, "ids array<long>, vector array<double>").groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return got.select(
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), F.slice(F.array_sort("ids"), 1, keep_ids).alias("ids"), "vector"
    )


def _spread(df: DataFrame, units: int, *keys: str) -> DataFrame:
    """Rows by shard over so many parts that few units of work share one; adaptive execution doesn't merge these, as shards take long for their bytes."""
    return df.repartition(4 * units, "shard", "dim", *keys)


def build_index(nodes: DataFrame, shards: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """The nodes of every shard with their out-edges."""

    def build(t: pa.Table) -> pa.Table:
        x = np.array(t.column("vector").to_pylist())
        g = Graph(same_norm(x), degree).build(beam, alpha)
        return t.append_column("node", pa.array(np.arange(len(x), dtype=np.int32))).append_column("out", pa.array([o[o >= 0].tolist() for o in g.out], pa.list_(pa.int32())))

    return _spread(nodes, shards).groupBy("shard", "dim").applyInArrow(build, INDEX)


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, degree: int, beam: int, blocks: int = 1) -> DataFrame:
    """(query_id, vec_id, score): the k best of every shard for each query (vec_id, vector)."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"), F.size("vector").alias("dim"), block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))

    def search(nodes: pa.Table, asks: pa.Table) -> pa.Table:
        ids_out, vec_out, score_out = [], [], []
        if nodes.num_rows and asks.num_rows:
            order = np.argsort(nodes.column("node").to_numpy())
            nodes = nodes.take(pa.array(order))
            x = np.array(nodes.column("vector").to_pylist())
            ids = nodes.column("ids").to_pylist()
            g = Graph(same_norm(x), degree)
            for row, o in zip(g.out, nodes.column("out").to_pylist(), strict=True):
                row[: len(o)] = o
            q_ids, q = asks.column("query_id").to_pylist(), np.array(asks.column("q").to_pylist())
            step = int(max(1, min(256, (64 << 20) // len(x))))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                found, _ = g.search(np.concatenate([part, np.zeros((len(part), 1))], axis=1), min(max(beam, k + 1), max(len(x), 2)))
                for own, vec, row in zip(q_ids[at : at + step], part, found, strict=True):
                    row = row[row >= 0]
                    s = (x[row] * vec).sum(axis=1)
                    best = np.argsort(-s, kind="stable")[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    if len(row) > k + 1:  # and all that tie with the last
                        best = np.flatnonzero(s >= s[best[-1]])
                    hits = sorted((-float(s[j]), i) for j in best for i in ids[row[j]] if i != own)[:k]
                    ids_out += [own] * len(hits)
                    vec_out += [i for _, i in hits]
                    score_out += [-v for v, _ in hits]
        return pa.table({"query_id": pa.array(ids_out, pa.int64()), "vec_id": pa.array(vec_out, pa.int64()), "score": pa.array(score_out, pa.float64())})

    left, right = (_spread(df, shards * blocks, "block").groupBy("shard", "dim", "block") for df in (index, asked))
    return left.cogroup(right).applyInArrow(search, FOUND)


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    every: int = 20,
    degree: int = 28,
    build_beam: int = 48,
    beam: int = 160,
    alpha: float = 1.2,
    shard_rows: int = 9_000,
    least_shards: int = 6,
    query_rows: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (rows whose id is divisible by `every`, unless given)."""
    vectors = valid_vectors(df, id_col, vector_col)
    shards = max(least_shards, -(-df.count() // shard_rows))
    index = Scratch(df.sparkSession).table(build_index(nodes_of(vectors, k + 1, shards), shards, degree, build_beam, alpha))
    asked = valid_vectors(queries, id_col, vector_col) if queries is not None else vectors.where(F.col("vec_id") % every == 0)
    rows = queries.count() if queries is not None else df.where(df[id_col].cast("long") % every == 0).count()
    found = search_index(index, asked, shards, k, degree, beam, max(1, -(-rows // query_rows)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple[int, list[float] | None]], k: int = 20, every: int = 20) -> dict[int, list[tuple[int, float]]]:
    """Exact answers, for tests and recall."""
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = (x * v).sum(axis=1)
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[int(i)] = [(int(ids[keep][j]), float(s[keep][j])) for j in order]
    return out
