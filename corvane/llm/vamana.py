"""Approximate nearest neighbours on robust-pruned directed graphs (Vamana; Subramanya et al., 2019).

The rows are dealt to shards by hash. A task builds the graph of a shard: points are inserted in growing batches; a
greedy beam search over the graph so far proposes neighbours, relaxed distance pruning keeps those that no kept, nearer
one is closer to by a factor, and edges run both ways up to a degree. A query block searches each shard's graph by
beam search, and the best of all shards stay.

The measure is the inner product. Vectors get a further component that gives all in a shard one norm, so that the
nearest by Euclidean distance to a query with 0 there are those of the largest inner product. Found candidates are
scored again, in double precision on the vectors as given.

Equal vectors are one point of a graph with its smallest ids; as many are kept as a result can name, plus the query's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Rows of a shard; queries that go to a shard together, at least and at most.
SHARD, LEAST_BLOCK, BLOCK = 8192, 512, 16_384


class Graph:
    """A directed graph over points (float32 rows, equal norms) with greedy beam search."""

    def __init__(self, points: np.ndarray, degree: int = 40, beam: int = 64, alpha: float = 1.2, out: np.ndarray | None = None):
        self.x = np.ascontiguousarray(points, dtype=np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        self.entry = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin()) if len(points) else 0
        if out is not None:
            self.out = out
            return
        self.out = np.full((len(points), degree), -1, dtype=np.int32)
        order = np.random.default_rng(7).permutation(len(points))
        order = np.concatenate([[self.entry], order[order != self.entry]]) if len(points) else order
        at, size = 1, 1
        while at < len(order):  # batches as large as the graph so far, 256 points at most
            new = order[at : at + min(size, 256)]
            self._insert(new)
            at += len(new)
            size *= 2

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of queries (rows) to their own lists of points."""
        return np.einsum("qd,qd->q", q, q)[:, None] + self.sq[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam of each query, nearest first; -1 where there are fewer points."""
        n, m = len(q), len(self.x)
        ids = np.full((n, beam), -1, dtype=np.int32)
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        done = np.ones((n, beam), dtype=bool)
        seen = np.zeros((n, m + 1), dtype=bool)
        seen[:, m] = True  # where -1 points
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = self._distance(q, np.full((n, 1), self.entry))[:, 0]
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            left = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(left, width - 1, axis=1)[:, :width] if beam > width else np.argsort(left, axis=1)[:, :width]
            open_ = np.isfinite(np.take_along_axis(left, pick, 1))
            rows = live[:, None]
            done[rows, pick] = True
            near = np.where(open_[:, :, None], self.out[ids[rows, pick]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] = True
            d = np.where(near >= 0, self._distance(q[live], near), np.inf).astype(np.float32)
            all_d = np.concatenate([dist[live], d], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), keep, 1)
            live = live[(~done[live]).any(1)]
        return ids, dist

    def _prune(self, points: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning: each point's kept neighbours out of its candidates, nearest first; -1 pads."""
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        v = self.x[cand]
        own = self.sq[cand]
        between = own[:, :, None] + own[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        free = np.isfinite(dist) & (cand >= 0) & (cand != points[:, None])
        kept = np.full((len(points), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(points))
        for j in range(self.degree):
            some = free.any(1)
            if not some.any():
                break
            best = free.argmax(1)
            kept[some, j] = cand[rows, best][some]
            free &= self.alpha2 * between[rows, best] > dist
            free[rows, best] = False
        return kept

    def _insert(self, new: np.ndarray) -> None:
        cand, dist = self.search(self.x[new], self.beam)
        if len(new) > 1:  # points of one batch may be neighbours too
            near = (self.sq[new][:, None] + self.sq[new][None, :] - 2 * self.x[new] @ self.x[new].T).astype(np.float32)
            np.fill_diagonal(near, np.inf)
            some = np.argsort(near, axis=1)[:, : min(16, len(new) - 1)]
            cand = np.concatenate([cand, new[some]], 1)
            dist = np.concatenate([dist, np.take_along_axis(near, some, 1)], 1)
        self.out[new] = self._prune(new, cand, dist)
        source, target = np.repeat(new, self.degree), self.out[new].ravel()
        at = target >= 0
        source, target = source[at], target[at]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = self.degree + int(count.max(initial=0))
        for a in range(0, len(heads), 512):
            h, f, c = heads[a : a + 512], first[a : a + 512], count[a : a + 512]
            lists = np.full((len(h), wide), -1, dtype=np.int32)
            lists[:, : self.degree] = self.out[h]
            fill = np.repeat(np.arange(len(h)), c)
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            lists[fill, self.degree + inner] = source[np.repeat(f, c) + inner]
            lists = np.sort(lists, axis=1)[:, ::-1].copy()
            lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
            lists = np.sort(lists, axis=1)[:, ::-1].copy()
            full = (lists >= 0).sum(1) > self.degree
            self.out[h[~full]] = lists[~full, : self.degree]
            if full.any():
                over = h[full]
                d = np.where(lists[full] >= 0, self._distance(self.x[over], lists[full]), np.inf)
                self.out[over] = self._prune(over, lists[full], d)


INDEX = "dim int, shard int, n int, vectors binary, edges binary, ids binary, id_counts binary"


def _build(degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("ids").to_pylist(), table.column("embedding").to_pylist(), strict=True))
        ids = [r[0] for r in rows]
        v = np.array([r[1] for r in rows], dtype=np.float32)
        graph = Graph(_level(v), degree, beam, alpha)
        blobs = [v.tobytes(), graph.out.tobytes(), np.concatenate(ids).astype("<i8").tobytes(), np.array([len(x) for x in ids], "<i4").tobytes()]
        head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "shard")]
        return pa.table([*head, pa.array([len(v)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], ["dim", "shard", "n", "vectors", "edges", "ids", "id_counts"])

    return run


def _level(v: np.ndarray) -> np.ndarray:
    """The vectors with one more component, so that all have the largest norm."""
    sq = np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64))
    scale = 1 / np.sqrt(max(sq.max(initial=0.0), 1e-300))
    return np.concatenate([v * scale, np.sqrt(np.maximum(0.0, 1 - sq * scale * scale))[:, None]], 1).astype(np.float32)


def _pack(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True))
    head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "block")]
    blobs = [np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<f4").tobytes()]
    return pa.table([*head, *[pa.array([b], pa.binary()) for b in blobs]], ["dim", "block", "query_ids", "queries"])


def _search(k: int, beam: int, degree: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dim, n, vectors, edges, ids, counts, query_ids, queries = (batch.column(c)[row].as_py() for c in range(8))
                v = np.frombuffer(vectors, "<f4").reshape(n, dim)
                graph = Graph(_level(v), degree, out=np.frombuffer(edges, np.int32).reshape(n, degree))
                first = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i4"))])
                ids, who = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                q = np.frombuffer(queries, "<f4").reshape(len(who), dim)
                out = []
                for at in range(0, len(who), 128):
                    some = q[at : at + 128].astype(np.float64)
                    flat = np.concatenate([some / np.sqrt((some**2).sum(1))[:, None], np.zeros((len(some), 1))], 1).astype(np.float32)
                    found, _ = graph.search(flat, beam)
                    for i, own in enumerate(found):
                        own = own[own >= 0]
                        score = v[own].astype(np.float64) @ some[i]
                        best = np.argsort(-score, kind="stable")
                        best = best[: len(best) if len(best) <= k + 1 else int((score >= score[best[k]]).sum())]
                        own, score = own[best], score[best]
                        size = first[own + 1] - first[own]
                        each = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        cand, s = ids[each], np.repeat(score, size)
                        other = (cand != who[at + i]) | ~np.repeat((v[own] == q[at + i]).all(1), size)
                        s, cand = s[other], cand[other]
                        top = np.lexsort((cand, -s))[:k]
                        out.append((np.full(len(top), who[at + i]), cand[top], s[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


VALID = """vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)
 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"""


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part. Rows equal in both are one row; an id may have several vectors."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding")).where(VALID)
    return rows.distinct().withColumn("dim", F.size("embedding"))


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD, degree: int = 40, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """The graphs of all shards as a written table; ``vectors`` as ``clean_vectors`` gives them."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    some = vectors.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    points = some.groupBy("embedding", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = written(points, "points")
    shards = max(1, -(-points.count() // shard_rows))
    points = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    return written(points.groupBy("dim", "shard").applyInArrow(_build(degree, beam, alpha), INDEX), "graphs")


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = 96, degree: int = 40, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest found over all shards of its dimension.

    ``queries`` has one vector an id. Every block of queries goes to every shard, by its number: a join on (dim, shard) brings them
    to the graphs, so a graph moves once a block of many queries and no key has more than one shard's work. The
    candidates of a shard are cut to ``k`` a query before they are merged.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    count = queries.count()
    size = block_rows or min(BLOCK, max(LEAST_BLOCK, count * shards // partitions(queries.sparkSession)))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, -(-count // size)))).cast("int"))
    packed = packed.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, query_ids binary, queries binary")
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    work = index.join(packed.hint("shuffle_hash"), ["dim", "shard"])
    work = work if size == BLOCK else work.repartition("shard", "block")  # few queries: a shard's blocks are work for several tasks
    found = work.select("dim", "n", "vectors", "edges", "ids", "id_counts", "query_ids", "queries").mapInArrow(_search(k, beam, degree), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the 20 nearest of every twentieth vector, by inner product.

    Null, zero and non-finite vectors, and those without an id, take no part. Vectors are compared within one length. All vectors
    of a repeated id are candidates, its smallest one is its query; another vector of the query's own id is a candidate too.
    """
    vectors = written(clean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    queries = vectors.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    return search_index(build_index(vectors), queries)
