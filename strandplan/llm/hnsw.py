"""Approximate nearest neighbours by inner product: a navigable small-world graph for each shard.

Rows are dealt into shards of about ``shard_rows`` by a hash of id and vector. Each shard's graph is built in one
task over its distinct vectors, with layers drawn from a seed, and stored as flat neighbour arrays. Queries
travel in blocks; every block meets every shard, walks the graph, and the shards' best are merged. Vectors that
are equal share a node, so a vector that many rows hold costs one node, and ties come back whole. Rows that are
equal in id and vector are counted before they are dealt.

Largest inner products become nearest neighbours on the sphere by one more coordinate, which fills a vector's
length up to the longest of its shard; in double precision, so one vector that is thousands of times longer than
the others doesn't level them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.plans.session import batches_of, bounded_batches, written


@dataclass(frozen=True)
class HnswRules:
    """Links a node in upper layers (twice that at the bottom), widths of the searches, rows of a shard, queries of a block."""

    links: int = 16
    build_width: int = 80
    search_width: int = 240
    shard_rows: int = 16384
    block: int = 1024
    seed: int = 11


class Graph:
    """A layered graph over unit vectors in flat arrays: ``near[row]`` are the neighbours of a (node, layer) row."""

    def __init__(self, vectors: np.ndarray, rules: HnswRules, near: np.ndarray | None = None, levels: np.ndarray | None = None):
        self.v, self.rules, n = vectors, rules, len(vectors)
        if levels is None:
            draws = np.random.default_rng(rules.seed).random(n)
            levels = np.floor(-np.log1p(-draws) / math.log(rules.links)).astype(np.int32)
        self.levels = levels
        #: Row of a node's layer 0; its upper layers follow at the end of the table.
        self.upper = n + np.concatenate(([0], np.cumsum(levels)[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
        rows = n + int(levels.sum())
        self.near = np.full((rows, 2 * rules.links), -1, np.int32) if near is None else near
        self.count = (self.near >= 0).sum(axis=1).tolist()
        self.seen = np.zeros(n, np.int64)
        self.stamp = 0
        self.entry = int(np.argmax(levels)) if near is not None and n else -1

    def row(self, node: int, layer: int) -> int:
        return node if layer == 0 else int(self.upper[node]) + layer - 1

    def walk(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found, nearest first, as (similarity, node)."""
        self.stamp += 1
        seen, stamp, v, near, count = self.seen, self.stamp, self.v, self.near, self.count
        ahead = [(-s, i) for s, i in starts]
        best = list(starts)
        heapq.heapify(ahead)
        heapq.heapify(best)
        for _, i in starts:
            seen[i] = stamp
        while ahead:
            s, i = heapq.heappop(ahead)
            if -s < best[0][0] and len(best) >= width:
                break
            r = i if layer == 0 else self.row(i, layer)
            new = near[r, : count[r]]
            new = new[seen[new] != stamp]
            if not len(new):
                continue
            seen[new] = stamp
            sims = v[new] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                new, sims = new[good], sims[good]
            for s, i in zip(sims.tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(ahead, (-s, i))
        best.sort(reverse=True)
        return best

    def _spread(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of nodes (nearest first): those nearer to the centre than to any taken, then the nearest left over."""
        if len(nodes) <= most:
            return nodes
        among = self.v[nodes]
        among = among @ among.T
        open_ = np.ones(len(nodes), bool)
        taken = []
        while len(taken) < most and open_.any():
            j = int(np.argmax(open_))
            taken.append(j)
            open_ &= among[j] <= sims
            open_[j] = False
        if len(taken) < most:
            rest = np.ones(len(nodes), bool)
            rest[taken] = False
            taken += np.flatnonzero(rest)[: most - len(taken)].tolist()
        return nodes[np.array(taken)]

    def add(self, i: int) -> None:
        level, q = int(self.levels[i]), self.v[i]
        if self.entry < 0:
            self.entry = i
            return
        top = int(self.levels[self.entry])
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(top, level, -1):
            at = self.walk(q, at, 1, layer)
        for layer in range(min(level, top), -1, -1):
            at = self.walk(q, at, self.rules.build_width, layer)
            most = self.rules.links * (2 if layer == 0 else 1)
            picked = self._spread(np.array([x[1] for x in at], np.int32), np.array([x[0] for x in at]), self.rules.links)
            mine = self.row(i, layer)
            self.near[mine, : len(picked)] = picked
            self.count[mine] = len(picked)
            for j in picked.tolist():
                r = self.row(j, layer)
                c = self.count[r]
                if c < most:
                    self.near[r, c] = i
                    self.count[r] = c + 1
                else:
                    every = np.append(self.near[r, :c], np.int32(i))
                    sims = self.v[every] @ self.v[j]
                    order = np.argsort(-sims, kind="stable")
                    kept = self._spread(every[order], sims[order], most)
                    self.near[r, : len(kept)] = kept
                    self.near[r, len(kept) :] = -1
                    self.count[r] = len(kept)
        if level > top:
            self.entry = i

    def build(self) -> Graph:
        for i in range(len(self.v)):
            self.add(i)
        return self

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self.walk(q, at, 1, layer)
        return self.walk(q, at, width, 0)


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose inner products with a query order as those of ``vectors`` do."""
    lengths = np.linalg.norm(vectors, axis=1)
    longest = lengths.max() if len(lengths) else 1.0
    scaled = vectors / longest
    fill = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    return np.concatenate((scaled, fill[:, None]), axis=1)


SHARD = "dim int, shard int, ids binary, copies binary, node_of binary, vectors binary, near binary, levels binary"


def _builder(rules: HnswRules):
    def build(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks]).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        ids, copies, vectors = ids[order], copies[order], vectors[order]
        nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
        shuffled = np.random.default_rng(rules.seed).permutation(len(nodes))  # an order that doesn't follow the vectors
        place = np.empty(len(nodes), np.int32)
        place[shuffled] = np.arange(len(nodes), dtype=np.int32)
        nodes, node_of = nodes[shuffled], place[node_of.reshape(-1)]
        by_node = np.argsort(node_of, kind="stable")
        graph = Graph(on_sphere(nodes), rules).build()
        row = [dim, shard, *(x.tobytes() for x in (ids[by_node], copies[by_node], node_of[by_node], nodes, graph.near, graph.levels))]
        names = ["dim", "shard", "ids", "copies", "node_of", "vectors", "near", "levels"]
        return pa.table({k: pa.array([x], t) for k, x, t in zip(names, row, [pa.int32()] * 2 + [pa.binary()] * 6, strict=True)})

    return build


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, embedding array<double>, dim, copies)``: each distinct row and how often it stands.

    Rows without an id, and vectors that are null, empty or zero or hold a null or non-finite component, take no
    part. Several vectors of one id are as many rows.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & some)
    rows = rows.withColumn("embedding", F.transform(v, lambda x: x + 0.0))  # -0.0 and 0.0 are one
    return rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))


def build_index(vectors: DataFrame, rules: HnswRules | None = None) -> tuple[DataFrame, int]:
    """(a row a shard with its flat arrays, number of shards a dimension) of ``usable`` rows; every row is indexed."""
    rules = rules or HnswRules()
    bounded_batches(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // rules.shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(_builder(rules), SHARD), "hnsw-shards"), shards


BLOCK = "dim int, b int, q_ids binary, q_copies binary, q_vectors binary"


def _blocker(table: pa.Table) -> pa.Table:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks])
    packed = [table.column("vec_id").to_numpy(), table.column("copies").to_numpy(), flat]
    columns = {k: pa.array([table.column(k)[0].as_py()], pa.int32()) for k in ("dim", "b")}
    return pa.table(columns | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("q_ids", "q_copies", "q_vectors"), packed, strict=True)})


def _best(shard: tuple, found: list[tuple[float, int]], x: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of the nodes found, all rows of a node but the query's own row, ties by id."""
    ids, copies, starts, vectors = shard
    nodes = [i for _, i in found]
    out: list[tuple[float, int]] = []
    for score, node in sorted(zip((vectors[nodes] @ x).tolist(), nodes, strict=True), key=lambda y: -y[0]):
        if len(out) >= k and score < out[k - 1][0]:
            break
        mine = own if (vectors[node] == x).all() else None
        # A node's ids are in order, so k+1 of them hold the k best that aren't the query's own.
        here = slice(starts[node], min(starts[node + 1], starts[node] + k + 1))
        out += [(score, i) for i, n in zip(ids[here].tolist(), copies[here].tolist(), strict=True) for _ in range(min(k, n - (i == mine)))]
        out.sort(key=lambda y: (-y[0], y[1]))
        del out[k:]
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("b", pa.int32()), ("at", pa.int32()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searcher(rules: HnswRules, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                ids, node_of = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["node_of"], np.int32)
                vectors = np.frombuffer(r["vectors"]).reshape(-1, dim)
                shard = ids, np.frombuffer(r["copies"], np.int64), np.searchsorted(node_of, np.arange(len(vectors) + 1)), vectors
                graph = Graph(on_sphere(vectors), rules, np.frombuffer(r["near"], np.int32).reshape(-1, 2 * rules.links), np.frombuffer(r["levels"], np.int32))
                asked, copies, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_copies"], np.int64), np.frombuffer(r["q_vectors"]).reshape(-1, dim)
                rows = []
                for at, (own, n, x) in enumerate(zip(asked.tolist(), copies.tolist(), q, strict=True)):
                    unit = np.append(x / np.linalg.norm(x), 0.0)
                    found = graph.search(unit, max(rules.search_width, k + 1))
                    rows += [(own, r["b"], at, n, i, s) for s, i in _best(shard, found, x, own, k)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return run


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, rules: HnswRules | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query, its own row left out, ties to the smaller id.

    ``queries`` are ``usable`` rows; a row that stands several times is as many queries, each other's candidates.
    They are packed into blocks; a block row is repeated for each shard of its dimension and meets the shard's row
    by an equi-join, so a task holds one shard and one block at a time. A query whose dimension no row shares gets
    nothing.
    """
    rules = rules or HnswRules()
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // rules.block))
    packed = queries.withColumn("b", F.pmod(F.xxhash64(F.lit(rules.seed), "vec_id", "embedding"), F.lit(blocks)).cast("int"))
    packed = written(packed.groupBy("dim", "b").applyInArrow(_blocker, BLOCK), "hnsw-blocks")
    spread = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = index.join(spread, ["dim", "shard"])
    with batches_of(spark, 1):  # a row is a shard with a block
        found = written(met.mapInArrow(_searcher(rules, k), "query_id long, b int, at int, copies long, vec_id long, score double"), "hnsw-found")
    rank = F.row_number().over(Window.partitionBy("query_id", "b", "at").orderBy(F.col("score").desc(), F.col("vec_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")
