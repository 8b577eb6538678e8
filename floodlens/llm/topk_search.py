"""Exact top-k search by inner product with a KD-tree per shard.

Rows are dealt evenly to shards by a hash of their id. A shard's tree splits at medians of its
widest component and keeps the tight box and the smallest id of every node. A query walks a tree
best-first: a node comes up in the order of the largest inner product its box allows, and the walk
ends when that cannot beat the query's k-th result.

Queries are first searched in the shard that holds them. Their k-th result goes along to all other
shards, which are left at the root where their box cannot beat it. Queries meet shards in blocks;
every block and shard is of bounded size. All queries of a block walk a tree together: each takes its
most promising leaf first, then in rounds the next ones that its k-th result leaves open, one, two,
four and so on at a time, and the items of a leaf are scored for all queries in one product.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.session import staged

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LEAF = 128
SCALE = 64
LARGEST_SUM = 1 << 62  # what an inner product may come to, so that it fits 64 bits


@dataclass
class Tree:
    """Nodes in arrays: box, smallest id, item range, and first child (the second follows it)."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least_id: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes: list[list] = [[0, len(ids), -1]]
        boxes = []
        at = 0
        while at < len(nodes):
            begin, end, _ = nodes[at]
            inside = vectors[order[begin:end]]
            low, high = inside.min(axis=0), inside.max(axis=0)
            boxes.append((low, high, ids[order[begin:end]].min()))
            if end - begin > leaf:
                axis = int((high - low).argmax())
                order[begin:end] = order[begin:end][np.argsort(inside[:, axis], kind="stable")]
                middle = (begin + end) // 2
                nodes[at][2] = len(nodes)
                nodes += [[begin, middle, -1], [middle, end, -1]]
            at += 1
        low, high, least = (np.array(x) for x in zip(*boxes))
        begin, end, child = np.array(nodes).T
        return Tree(ids[order], vectors[order], low, high, least, begin, end, child)

    def bounds(self, query: np.ndarray, node: int, nodes: int) -> np.ndarray:
        """Largest inner product with the boxes of `nodes` nodes from `node` on."""
        part = slice(node, node + nodes)
        return np.maximum(self.low[part] * query, self.high[part] * query).sum(axis=1)

    def search(self, own_id: int, query: np.ndarray, k: int, kth: tuple[int, int] | None
               ) -> list[tuple[int, int]]:
        """Up to k items other than `own_id` as (-score, id) in order. Only items that are better
        than `kth`, a k-th result from elsewhere, are of interest."""
        found: list[tuple[int, int]] = []
        limit = kth
        heap = [(-int(self.bounds(query, 0, 1)[0]), int(self.least_id[0]), 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if limit is not None and (bound, least) > limit:
                break
            child = self.child[node]
            if child >= 0:
                for i, value in enumerate(self.bounds(query, child, 2).tolist()):
                    entry = (-value, int(self.least_id[child + i]), int(child + i))
                    if limit is None or entry[:2] <= limit:
                        heapq.heappush(heap, entry)
                continue
            part = slice(self.begin[node], self.end[node])
            scores = self.vectors[part] @ query
            if limit is None:
                near = np.arange(len(scores))
            else:
                near = np.flatnonzero(scores >= -limit[0])
            new = [(-s, i) for s, i in zip(scores[near].tolist(), self.ids[part][near].tolist())
                   if i != own_id]
            if new:
                found = sorted(found + new)[:k]
                if len(found) == k and (limit is None or found[-1] < limit):
                    limit = found[-1]
        return found


    def _pair_bounds(self, queries: np.ndarray, query: np.ndarray, node: np.ndarray
                     ) -> np.ndarray:
        """Largest inner product with a node's box for each pair (row of `queries`, node)."""
        out = np.empty(len(query), dtype=queries.dtype)
        for at in range(0, len(query), 1 << 14):
            q, n = queries[query[at:at + (1 << 14)]], node[at:at + (1 << 14)]
            out[at:at + (1 << 14)] = np.maximum(self.low[n] * q, self.high[n] * q).sum(axis=1)
        return out

    def _first_leaves(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query reaches by the better bound at every node."""
        node = np.zeros(len(queries), np.int64)
        every = np.arange(len(queries))
        while (inner := np.flatnonzero(self.child[node] >= 0)).size:
            child = self.child[node[inner]]
            left, right = (self._pair_bounds(queries, every[inner], child + i) for i in (0, 1))
            node[inner] = child + (right > left)
        return node

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int,
                   kth: tuple[np.ndarray, np.ndarray] | None = None
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `queries`, score, id) of the up to k best items of every query, in the order of
        row, score downwards and id; `own` ids are left out. With `kth`, scores and ids of k-th
        results from elsewhere, only items that are better are given."""
        rows = len(queries)
        lowest = np.iinfo(np.int64).min
        limit, limit_id = (x.copy() for x in kth) if kth is not None else (
            np.full(rows, lowest), np.full(rows, np.iinfo(np.int64).max))
        best = tuple(np.empty(0, np.int64) for _ in range(3))

        def may_help(query: np.ndarray, bound: np.ndarray, node: np.ndarray) -> np.ndarray:
            return (bound > limit[query]) | ((bound == limit[query])
                                             & (self.least_id[node] <= limit_id[query]))

        def take(query: np.ndarray, leaf: np.ndarray) -> None:
            """Score these leaves for these queries, and draw the limits closer."""
            nonlocal best
            found = [best]
            order = np.argsort(leaf, kind="stable")
            query, leaf = query[order], leaf[order]
            cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])[:len(leaf)])
            for a, b in zip(cuts, np.append(cuts[1:], len(leaf))):
                q, node = query[a:b], leaf[a]
                part = slice(self.begin[node], self.end[node])
                scores = (queries[q] @ self.vectors[part].T).astype(np.int64)
                ids = self.ids[part]
                good = (scores > limit[q][:, None]) | (
                    (scores == limit[q][:, None]) & (ids <= limit_id[q][:, None]))
                good &= ids != own[q][:, None]
                i, j = np.nonzero(good)
                found.append((q[i], scores[i, j], ids[j]))
            row, score, item = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((item, -score, row))
            row, score, item = row[order], score[order], item[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            best = row[keep], score[keep], item[keep]
            last = np.flatnonzero(rank == k - 1)
            q, value, at = row[last], score[last], item[last]
            closer = (value > limit[q]) | ((value == limit[q]) & (at < limit_id[q]))
            limit[q[closer]], limit_id[q[closer]] = value[closer], at[closer]

        every = np.arange(rows)
        asked = every[may_help(every, self._pair_bounds(queries, every, np.zeros(rows, np.int64)),
                               np.zeros(rows, np.int64))]
        first = self._first_leaves(queries[asked])
        take(asked, first)
        done = np.full(rows, -1)
        done[asked] = first
        query, node = asked, np.zeros(len(asked), np.int64)
        bound = self._pair_bounds(queries, query, node)
        while (self.child[node] >= 0).any():  # down to the leaves that are still open
            inner = self.child[node] >= 0
            child = self.child[node[inner]]
            down_query = np.repeat(query[inner], 2)
            down = np.column_stack([child, child + 1]).ravel()
            down_bound = self._pair_bounds(queries, down_query, down)
            open_ = may_help(down_query, down_bound, down)
            query = np.concatenate([query[~inner], down_query[open_]])
            node = np.concatenate([node[~inner], down[open_]])
            bound = np.concatenate([bound[~inner], down_bound[open_]])
        rest = node != done[query]
        query, node, bound = query[rest], node[rest], bound[rest]
        order = np.lexsort((-bound, query))
        query, node, bound = query[order], node[order], bound[order]
        leaves = 1
        while len(query):
            now = np.arange(len(query)) - np.searchsorted(query, query) < leaves
            take(query[now], node[now])
            later = ~now
            later[later] = may_help(query[later], bound[later], node[later])
            query, node, bound = query[later], node[later], bound[later]
            leaves *= 2
        if kth is None:
            return best
        row, score, item = best
        better = (score > kth[0][row]) | ((score == kth[0][row]) & (item < kth[1][row]))
        return row[better], score[better], item[better]


def quantized(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, dim) with components floor(scale * x), x as double. Rows with a null id,
    null or empty vectors, and vectors with null or non-finite components are left out; of rows
    with the same id the one with the smallest vector counts. Components so large that
    inner products might not fit 64 bits raise."""
    largest = F.sqrt(F.lit(float(LARGEST_SUM)) / F.size(vector)) - 1
    scaled = lambda x: x.cast("double") * scale
    whole = F.transform(
        F.col(vector), lambda x: F.when(F.abs(scaled(x)) <= largest, F.floor(scaled(x)))
        .otherwise(F.raise_error(F.lit("vector components too large for 64-bit scores")))
        .cast("long"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < float("inf")))
    out = (rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()
                      & (F.size(vector) > 0)).where(finite)
           .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")))
    repeated = out.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not repeated.isEmpty():
        single = out.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(
            F.min("vector").alias("vector"))
        out = out.join(repeated, "vec_id", "left_anti").unionByName(single)
    return out.withColumn("dim", F.size("vector"))


def _matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(table.num_rows, -1)
    largest = float(np.abs(vectors).max(initial=0))
    exact = largest * largest * vectors.shape[1] < 2 ** 53  # then doubles hold all sums exactly
    return vectors.astype(np.float64) if exact else vectors


def _lists(best: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int
           ) -> tuple[pa.Array, pa.Array]:
    """Ids and scores of every row."""
    begins = pa.array(np.searchsorted(best[0], np.arange(rows + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(begins, pa.array(best[2])),
            pa.ListArray.from_arrays(begins, pa.array(best[1])))


def search(rows: DataFrame, is_query: Column, k: int, vector: str = "embedding",
           shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row for which `is_query` (on vec_id)
    holds, the k best other rows by integer inner product of the quantized vectors (all if fewer),
    ties to smaller ids. Only vectors of the same length are compared. Rows that `quantized`
    leaves out take no part; other columns play none; an empty table gives an empty result."""
    items = quantized(rows, vector)
    shards = max(1, math.ceil(items.count() / shard_rows))
    items = items.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))

    def at_home(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table)
        asked = np.flatnonzero(table.column("asked").to_numpy())
        best = (Tree.build(ids, vectors).search_all(ids[asked], vectors[asked], k)
                if len(asked) else [np.empty(0, np.int64)] * 3)
        found, scores = _lists(best, len(asked))
        return pa.table({
            "query_id": ids[asked], "home": table.column("shard").take(asked),
            "vector": table.column("vector").take(asked), "dim": table.column("dim").take(asked),
            "ids": found, "scores": scores})

    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    home = staged(
        items.select("*", asked).groupBy("dim", "shard").applyInArrow(
            at_home, "query_id long, home long, vector array<long>, dim int, ids array<long>, "
                     "scores array<long>"), "search-home")
    hits = home.select("query_id", "ids", "scores")
    if shards > 1:
        hits = hits.unionByName(_abroad(items, home, shards, k, query_block))
    best = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
            .selectExpr("query_id", "hit.ids as vec_id", "hit.scores as score")
            .withColumn("rank", best).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _abroad(items: DataFrame, home: DataFrame, shards: int, k: int, query_block: int
            ) -> DataFrame:
    """Results better than the k-th at home, from all other shards."""
    blocks = max(1, math.ceil(home.count() / query_block))

    def meet(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()),
                             "ids": pa.array([], pa.list_(pa.int64())),
                             "scores": pa.array([], pa.list_(pa.int64()))})
        # One matrix, so that both sides hold their sums exactly.
        vectors = _matrix(pa.concat_tables([queries.select(["vector"]), shard.select(["vector"])]))
        asked, vectors = vectors[:queries.num_rows], vectors[queries.num_rows:]
        tree = Tree.build(shard.column("vec_id").to_numpy(), vectors)
        own = queries.column("query_id").to_numpy()
        # Without k results at home, everything is better.
        kth = tuple(queries.column(name).combine_chunks().fill_null(fill).to_numpy()
                    for name, fill in (("kth_score", np.iinfo(np.int64).min),
                                       ("kth_id", np.iinfo(np.int64).max)))
        found, scores = _lists(tree.search_all(own, asked, k, kth), len(own))
        return pa.table({"query_id": own, "ids": found, "scores": scores})

    block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks))
    travelling = home.select(
        "query_id", "vector", "dim", F.get("scores", F.lit(k - 1)).alias("kth_score"),
        F.get("ids", F.lit(k - 1)).alias("kth_id"), block.alias("block"), "home",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    ).where("shard <> home").drop("home")
    met = items.select("*", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["dim", "shard", "block"]
    return travelling.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(
        meet, "query_id long, ids array<long>, scores array<long>")
