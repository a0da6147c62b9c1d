"""Exact inner-product search for the top k by a dual-tree walk over cover trees.

Vectors become whole numbers, so scores are exact. Queries and candidates are dealt by hash into blocks of bounded size; every
pair of a query block and a candidate block is one task's work, and each query's best of all candidate blocks
meet in one merge of k rows per block. In a task both sides are indexed by a cover tree: a node of level l covers all
points below it within 2^l, and its children's centres lie more than 2^(l - 1) apart. The walk takes
pairs of nodes, best bound first. No point under two nodes with centres q, p and radii r, s can score more than
q.p + |q| s + |p| r + r s; a pair whose bound does not exceed the worst k-th score among the node's queries
is left out. What is left ends in leaves, scored by one matrix product. Points that are all far from each other, as in many
dimensions without structure, stay together in one leaf.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. A vec_id
that repeats counts once, with its least vector. Scores are of vectors with the same number of components only.
Ties go to the smaller vec_id. An empty table gives an empty table, extra columns are left out. Scores are exact
up to 2^53; components saturate at the range of a long.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of the vectors in a block, about: 2 MB as doubles. Trees are built in time up to the square of a block.
BLOCK_COMPONENTS = 200_000
LEAF = 64


class CoverTree:
    """Nodes in arrays: centre (row), radius, children and rows of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        everything = np.arange(len(points))
        reach = self._distances(0, everything)
        level = math.ceil(math.log2(reach.max())) if reach.max() > 0 else 0
        todo = [(self._node(0, everything, reach), everything, reach, level)]
        while todo:
            node, rows, far, level = todo.pop()
            if len(rows) <= leaf or self.radius[node] == 0:
                self.rows[node] = rows
                continue
            while 2.0**level >= self.radius[node]:  # levels on which the node has but itself for a child
                level -= 1
            nearest, owner, centers = far.copy(), np.zeros(len(rows), np.int64), [self.center[node]]
            most = 4 * -(-len(rows) // leaf)
            while nearest[worst := int(np.argmax(nearest))] > 2.0**level and len(centers) <= most:
                gap = self._distances(rows[worst], rows)
                closer = gap < nearest
                nearest[closer], owner[closer] = gap[closer], len(centers)
                centers.append(int(rows[worst]))
            if len(centers) > most:  # points all apart from each other: nothing to tell them by, so one leaf
                self.rows[node] = rows
                continue
            for c, center in enumerate(centers):
                mine = owner == c
                child = self._node(center, rows[mine], nearest[mine])
                self.children[node].append(child)
                todo.append((child, rows[mine], nearest[mine], level))

    def _distances(self, center: int, rows: np.ndarray) -> np.ndarray:
        gap = self.points[rows] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _node(self, center: int, rows: np.ndarray, far: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(far.max()) if len(far) else 0.0)
        self.children.append([])
        self.rows.append(rows[:0])
        return len(self.center) - 1


class Best:
    """The k best candidates of each query, as (score, -id) in rows sorted from the worst."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of ``rows`` by ``ids``; minus infinity is no candidate."""
        worst = self.scores[rows].min(1)
        good = (scores >= worst[:, None]).any(1)
        if not good.any():
            return
        rows, scores = rows[good], scores[good]
        if scores.shape[1] > 4 * self.k:  # ties at the k-th score all stay
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            wanted = (scores >= kth[:, None]) & (scores >= worst[good][:, None])
            for r, s, w in zip(rows, scores, wanted):
                self._merge(r, s[w], ids[w])
        else:
            for r, s in zip(rows, scores):
                self._merge(r, s, ids)

    def _merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[row], scores]), np.concatenate([self.ids[row], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[row], self.ids[row] = s[order], i[order]


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int) -> Best:
    """The k best of ``points`` for each query but itself."""
    best = Best(len(queries), k)
    left, right = CoverTree(queries, LEAF // 4), CoverTree(points)
    under: dict[int, np.ndarray] = {}

    def rows_under(node: int) -> np.ndarray:
        if node not in under:
            kids = left.children[node]
            under[node] = np.concatenate([rows_under(c) for c in kids]) if kids else left.rows[node]
        return under[node]

    def bound(a: int, b: int) -> float:
        q, p = left.center[a], right.center[b]
        r, s = left.radius[a], right.radius[b]
        return float(queries[q] @ points[p]) + left.norms[q] * s + right.norms[p] * r + r * s

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        # A bound is rounded, a score is not.
        if -top * (1 + 1e-9) + 1e-6 < best.scores[rows_under(a)].min():
            continue
        kids_a, kids_b = left.children[a], right.children[b]
        if not kids_a and not kids_b:
            q, p = left.rows[a], right.rows[b]
            for at in range(0, len(p), 4096):
                part = p[at : at + 4096]
                scores = queries[q] @ points[part].T
                scores[query_ids[q][:, None] == point_ids[part][None, :]] = -np.inf
                best.add(q, scores, point_ids[part])
        elif kids_a and (not kids_b or left.radius[a] > right.radius[b]):
            for c in kids_a:
                heapq.heappush(heap, (-bound(c, b), c, b))
        else:
            for c in kids_b:
                heapq.heappush(heap, (-bound(a, c), a, c))
    return best


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, of vectors that take part."""
    good = F.col("vec_id").isNotNull() & F.col(vector).isNotNull()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.where(good).where(F.forall(F.col(vector).cast("array<double>"), finite))
    floor = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), floor.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` for each of ``queries``, both (vec_id, vector)."""

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        total = df.agg(F.sum(F.size("vector") + 1).alias("n")).first()["n"] or 0
        blocks = max(1, math.ceil(total / block_components))
        df = df.select("vec_id", "vector", F.size("vector").alias("size"))
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks

    left, query_blocks = dealt(queries, "query_block")
    right, blocks = dealt(vectors, "block")
    # Each block goes to every block of the other side: queries stand against all rows, in blocks.
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["query_block", "block", "size"]

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = table["vector"].combine_chunks()
        flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
        return table["vec_id"].to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            query_ids, q = matrix(a)
            point_ids, p = matrix(b)
            best = search(q, query_ids, p, point_ids, k)
            for query, scores, ids in zip(query_ids, best.scores, best.ids):
                real = scores > -np.inf
                out["query_id"] += [int(query)] * int(real.sum())
                out["vec_id"] += ids[real].tolist()
                out["score"] += scores[real].astype(np.int64).tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int, query: str, scale: int = 256) -> str:
    """The same result as SQL over ``embeddings``."""
    return f"""
WITH vectors AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.vector, v.vector)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id AND len(q.vector) = len(v.vector) WHERE q.{query})
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= {k}"""
