"""Operator 1: nearest neighbours by a forest of random-projection trees.

1. Trees are fitted on a bounded sample (``SAMPLE`` rows, those of least hash): a
   node's plane lies between two random points of it, at the median.
2. Every row is indexed: it goes to one leaf of each tree.
3. A query walks all trees through one shared priority queue, the nearest side of
   the least certain split first, until it has opened ``budget`` leaves.
4. Rows of the opened leaves are ranked by their exact inner product.

For the largest inner product rather than the least angle, vectors get one more
component that brings all to the same length; queries get 0 there.

``budget`` is measured, not assumed: for ``TRIAL`` queries the true neighbours are
found by brute force over all rows, and the budget is the least that finds the share
``recall`` of them; of forests of two trees and more that which opens the fewest leaves is
taken.  Vectors without structure need most leaves, others few.
"""

from __future__ import annotations

import copy
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mix, stored, table
from .vectors import dot_rows, is_usable, matrix

TREES = 4
SAMPLE = 16_384
LEAF_ROWS = 256
TRIAL = 96
RECALL = 0.96
#: A forest has two trees at least; whether it takes more, the trial queries decide.
LEAST_TREES = 2
#: Rows of the index that a task holds at a time.
SHARD_ROWS = 16_384
#: Parts that copies of one vector are first cut down in.
SALT = 13


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, trees: int, depth: int, seed: int):
        self.longest, self.depth = longest, depth
        rng = np.random.default_rng(seed)
        points = self.lift(sample)
        self.planes = np.zeros((trees, (1 << depth) - 1, points.shape[1]))
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            node = np.zeros(len(points), np.int64)
            for k in range((1 << depth) - 1):
                if k & (k + 1) == 0 and k:  # a new level begins
                    node = self._down(points, node, t)
                own = points[node == k]
                plane = own[rng.integers(len(own))] - own[rng.integers(len(own))] if len(own) else 0.0
                if not np.any(plane):
                    plane = rng.normal(size=points.shape[1])
                self.planes[t, k] = plane / np.linalg.norm(plane)
                self.cuts[t, k] = np.median(own @ self.planes[t, k]) if len(own) else 0.0

    def first(self, trees: int) -> Forest:
        """The forest of the first trees alone."""
        few = copy.copy(self)
        few.planes, few.cuts = self.planes[:trees], self.cuts[:trees]
        return few

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, rest[:, None]]) / self.longest

    def _down(self, points, node, t):
        return 2 * node + 1 + ((points * self.planes[t, node]).sum(axis=1) > self.cuts[t, node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row, numbered through all trees."""
        points, out = self.lift(x), np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(points, node, t)
            out[:, t] = node + 1 - (1 << self.depth) + (t << self.depth)
        return out

    def visits(self, queries: np.ndarray, budget: int) -> list[list[int]]:
        """The first ``budget`` leaves that each query opens."""
        scale = np.linalg.norm(queries, axis=1, keepdims=True)
        points = np.hstack([queries / scale, np.zeros((len(queries), 1))])
        margins = [(points @ p.T - c).tolist() for p, c in zip(self.planes, self.cuts)]
        inner = (1 << self.depth) - 1
        out = []
        for q in range(len(queries)):
            queue, opened = [(-math.inf, t, 0) for t in range(len(self.planes))], []
            while queue and len(opened) < budget:
                doubt, t, node = heapq.heappop(queue)
                while node < inner:  # the nearer side goes on, the other waits
                    m = margins[t][q][node]
                    far = 2 * node + 1 + (m <= 0)
                    heapq.heappush(queue, (max(doubt, abs(m)), t, far))
                    node = 2 * node + 1 + (m > 0)
                opened.append(node - inner + (t << self.depth))
            out.append(opened)
        return out


def _best(scores, ids, k):
    """Per row of scores (columns in order of ids) the candidates that can be among the best k."""
    # an id that repeats with other vectors counts once, by its best
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    if len(first) > k:
        each = scores if len(first) == len(ids) else np.maximum.reduceat(scores, first, axis=1)
        least = -np.partition(-each, k - 1, axis=1)[:, k - 1 : k]
        return np.nonzero(scores >= least - 1e-9 * (1 + np.abs(least)))
    return np.nonzero(np.isfinite(scores))


def _cut(query, ids, score, k):
    """Rows of the best k of each query, ties to smaller ids, each id once by its best score."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[new], ids[new], score[new]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _hits(query, ids, score):
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


_HITS = "query_id long, vec_id long, score double"


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, query_ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among ``rows`` (vec_id, embedding)."""
    own = np.asarray(query_ids)

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            scores = queries @ x.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            q, c = _best(scores, ids, k)
            q, c = q[np.isfinite(scores[q, c])], c[np.isfinite(scores[q, c])]
            yield from _hits(*_cut(own[q], ids[c], dot_rows(queries[q], x[c]), k)).to_batches()

    return _top(rows.select("vec_id", "embedding").mapInArrow(run, _HITS), k)


def fit(rows: DataFrame, k: int, trees: int = TREES, recall: float = RECALL, seed: int = 7) -> tuple[Forest, int]:
    """A forest over a bounded sample of ``rows`` and the measured number of leaves to open."""
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).collect()
    points = np.asarray([r[1] for r in sample], np.float64)
    deepest = max(1, int(math.log2(max(len(points), 2) / 16)))
    depth = min(max(1, math.ceil(math.log2(max(n / LEAF_ROWS, 1)))), deepest)
    forest = Forest(points, longest or 1.0, trees, depth, seed)
    chosen = sample[:TRIAL]
    queries = points[: len(chosen)]
    truth = brute_force(rows, [r[0] for r in chosen], queries, k).join(rows.select("vec_id", "embedding"), "vec_id").dropDuplicates(["query_id", "vec_id"]).select("query_id", "embedding").collect()
    if not truth:
        return forest, trees << depth
    row_of = {r[0]: i for i, r in enumerate(chosen)}
    own = np.asarray([row_of[r[0]] for r in truth])
    found = forest.leaves(np.asarray([r[1] for r in truth], np.float64))
    measured = []
    # leaves hold about as many rows each, so the fewest leaves are the fewest rows to score
    for few in range(min(LEAST_TREES, trees), trees + 1):
        ranks = np.full((len(chosen), few << depth), few << depth)
        for q, opened in enumerate(forest.first(few).visits(queries, few << depth)):
            ranks[q, opened] = np.arange(len(opened))
        need = ranks[own[:, None], found[:, :few]].min(axis=1)
        measured.append((int(np.quantile(need, recall, method="higher")) + 1, few))
    budget, few = min(measured)
    return forest.first(few), budget


def shards(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each leaf and how many it has: neighbouring leaves fill a shard of ``most`` rows, a larger one has some of its own."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    now, filled = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and filled + n > most:
            now, filled = now + 1, 0
        first[leaf] = now
        if parts[leaf] > 1:
            now, filled = now + int(parts[leaf]), 0
        else:
            filled += n
    return first, parts


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """The ``k`` nearest ``rows`` found for each of ``queries`` (both vec_id, embedding).

    Returns query_id, rank (from 1), vec_id, score: the inner product of the original
    vectors in double precision, ties to smaller vec_id, the query's own vec_id left
    out.  Vectors that are null, zero or hold null or non-finite components and rows
    with a null vec_id take no part; vectors of different length have no inner product and are
    no candidates of each other.  Rows that
    repeat a vec_id give it once, with its best score.  Of more than ``k`` + 1 different
    ids of one vector only the smallest can be among the nearest, and only those are
    indexed.  Empty tables give no rows.  Other columns are ignored.

    A row stands in the index once for each tree; queries stream past the shards whose leaves
    they open, so neither side grows with the other, and a leaf of any size is cut in shards.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select("vec_id", "embedding").filter(is_usable()).distinct()
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).orderBy("vec_id")
    whole = Window.partitionBy("embedding").orderBy("vec_id")
    for window in (salted, whole):
        rows = rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k + 1).drop("_n")
    rows = stored(rows, "vectors")
    queries = queries.select("vec_id", "embedding").filter(is_usable())
    hits = spark.createDataFrame([], _HITS)
    for (width,) in rows.select(F.size("embedding")).distinct().collect():  # as a rule one
        same = F.size("embedding") == width
        hits = hits.union(_searched(rows.filter(same), queries.filter(same), k, trees, recall, seed))
    return _top(hits, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _searched(rows: DataFrame, queries: DataFrame, k: int, trees: int, recall: float, seed: int) -> DataFrame:
    """The best candidates of each shard for ``queries``, of vectors of one length."""
    spark = rows.sparkSession
    forest, budget = fit(rows, k, trees, recall, seed)
    # Its size is bounded: TREES * SAMPLE / 16 planes at most.
    shared = spark.sparkContext.broadcast(forest)
    trees, depth = len(forest.planes), forest.depth

    def place(batches):
        for batch in batches:
            leaf = shared.value.leaves(matrix(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * trees), pa.array(leaf.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "embedding", "leaves"])

    index = stored(rows.mapInArrow(place, "vec_id long, embedding array<float>, leaves array<int>"), "index")
    sizes = np.zeros(trees << depth, np.int64)
    for leaf, n in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*")).collect():  # a row a leaf
        sizes[leaf] = n
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, parts = shards(sizes, max(LEAF_ROWS, min(SHARD_ROWS, int(sizes.sum()) // (2 * partitions))))

    def members(batches):
        for batch in batches:
            leaf, ids = batch.column(2).flatten().to_numpy().reshape(-1, trees), batch.column(0).to_numpy()
            for t in range(trees):
                own = leaf[:, t]
                spread = (mix(ids.view(np.uint64)) % parts[own].astype(np.uint64)).astype(np.int64)
                none = pa.nulls(len(own), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(first[own] + spread), pa.array(np.zeros(len(own), np.int32)), pa.array(own), batch.column(0), batch.column(1), none], names)

    def walk(batches):
        for batch in batches:
            rows_of, shard, opened = [], [], []
            for i, leaves in enumerate(shared.value.visits(matrix(batch.column(1)), budget)):
                own = np.repeat(np.asarray(leaves), parts[leaves])
                to = first[own] + np.arange(len(own)) - _starts(parts[leaves])
                order = np.argsort(to, kind="stable")
                own, to = own[order], to[order]
                edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:]):
                    rows_of.append(i)
                    shard.append(to[a])
                    opened.append(own[a:b])
            at = pa.array(rows_of, pa.int64())
            n = len(rows_of)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, -1, np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(opened, pa.list_(pa.int32()))], names)

    def rank(batches):
        now, held, built = None, [], None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(2 * shard + kind, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, held, built = shard[a], [], None
                if not kind[a]:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4))))
                elif held or built:
                    if built is None:
                        built, held = tuple(np.concatenate(c) for c in zip(*held)), []
                    yield from _answers(built, part, k).to_batches()

    names = ["shard", "kind", "leaf", "id", "embedding", "leaves"]
    schema = "shard long, kind int, leaf int, id long, embedding array<float>, leaves array<int>"
    both = index.mapInArrow(members, schema).union(queries.mapInArrow(walk, schema))
    # members come before the queries of their shard
    met = both.repartitionById(partitions, (F.col("shard") % partitions).cast("int")).sortWithinPartitions("shard", "kind", "leaf", "id")
    return met.mapInArrow(rank, _HITS)


def _starts(n: np.ndarray) -> np.ndarray:
    """For each place of an array that repeats each item ``n`` times the place where its item begins."""
    return np.repeat(np.cumsum(n) - n, n)


def _answers(members, asked: pa.RecordBatch, k: int) -> pa.Table:
    """The best ``k`` of a shard's members (leaf, id, vector; sorted by leaf and id) for each query, from the leaves it opens."""
    leaf, ids, x = members
    query_ids, q = asked.column(3).to_numpy(), matrix(asked.column(4))
    wanted = asked.column(5)
    who = np.repeat(np.arange(len(query_ids)), np.asarray(wanted.value_lengths()))
    what = wanted.flatten().to_numpy()
    by_leaf = np.argsort(what, kind="stable")
    who, what = who[by_leaf], what[by_leaf]
    out, pending = [], 0
    for name in np.unique(leaf):
        a, b = np.searchsorted(leaf, [name, name + 1])
        own = who[slice(*np.searchsorted(what, [name, name + 1]))]
        step = max(1, (4 << 20) // (b - a))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            scores = q[part] @ x[a:b].T
            scores[query_ids[part][:, None] == ids[None, a:b]] = -np.inf
            r, c = _best(scores, ids[a:b], k)
            fine = np.isfinite(scores[r, c])
            r, c = part[r[fine]], a + c[fine]
            out.append((query_ids[r], ids[c], dot_rows(q[r], x[c])))
            pending += len(r)
            if pending > 1 << 20:
                out, pending = [_cut(*map(np.concatenate, zip(*out)), k)], 0
    return _hits(*_cut(*map(np.concatenate, zip(*out)), k)) if out else _hits([], [], [])


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for every row whose vec_id is divisible by 20; see ``nearest``."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
