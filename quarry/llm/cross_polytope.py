"""Operator 9: near-duplicate vectors by cross-polytope hashing.

A table hashes a vector with ``rotations`` fast rotations (three rounds of random
signs and a Hadamard transform); each gives the nearest of the 2d signed axes.  A
vector lies in one bucket a table and also looks into ``probes`` others, those that the
runners-up of its rotations name.  Pairs that meet are verified by their cosine.

Links are counted, not listed: a pair that meets several times counts where it first
meets, which either side can tell from the two vectors alone; what a task emits is one
row per linked vector, with its links and the least vector it is joined to there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table
from .graph import components
from .vectors import dot_rows, is_usable, matrix

TABLES = 14
PROBES = 2
#: Vectors of a bucket that are compared in one go; larger buckets are cut in blocks that meet in pairs.
BLOCK = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows; their length is a power of two."""
    n, width, x = x.shape[0], x.shape[1], x.copy()
    step = 1
    while step < width:
        y = x.reshape(n, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


class Hasher:
    def __init__(self, dim: int, tables: int, rotations: int, probes: int, seed: int = 11):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.rotations, self.probes = tables, rotations, min(probes, rotations)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, self.width))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x (1 + probes): own bucket first, then the others looked into."""
        n = len(x)
        padded = np.zeros((n, self.width))
        padded[:, : x.shape[1]] = x
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            best = np.empty((n, self.rotations, 2), np.int64)
            gap = np.empty((n, self.rotations))
            for r in range(self.rotations):
                y = padded
                for s in self.signs[t, r]:
                    y = hadamard(y * s)
                size = np.abs(y)
                for k in range(2):
                    axis = size.argmax(axis=1)
                    best[:, r, k] = 2 * axis + (y[rows, axis] < 0)
                    gap[:, r] = size[rows, axis] if k == 0 else gap[:, r] / np.maximum(size[rows, axis], 1e-300)
                    size[rows, axis] = -1
            scale = (2 * self.width) ** np.arange(self.rotations)
            out[:, t, 0] = best[:, :, 0] @ scale
            turn = np.argsort(gap, axis=1, kind="stable")  # the least certain rotation first
            for p in range(self.probes):
                other = best[:, :, 0].copy()
                other[rows, turn[:, p]] = best[rows, turn[:, p], 1]
                out[:, t, 1 + p] = other @ scale
        return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index joined to each of n vertices."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _meet(code_a, code_b):
    """Bucket in which two vectors (a the smaller id) meet in a table; -1: in none. Codes: pairs x (1 + probes)."""
    own_a, own_b = code_a[:, 0], code_b[:, 0]
    a_in_b = (code_b == own_a[:, None]).any(axis=1)
    b_in_a = (code_a == own_b[:, None]).any(axis=1)
    return np.where(a_in_b, own_a, np.where(b_in_a, own_b, -1))


def linked_vectors(rows: DataFrame, least: float = 0.95, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """Partial links among ``rows`` (id, n, embedding): (a, b, links), distinct vectors.

    Per vector ``a`` and task: ``links``, the sum of n of the vectors linked to it there
    that nowhere else count, and ``b``, the least id it is joined to there.
    """
    spark = rows.sparkSession
    n_rows, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n_rows:
        return spark.createDataFrame([], "a long, b long, links long")
    wide = 2 << max(1, (dim - 1).bit_length())
    rotations = max(1, math.ceil(math.log(max(n_rows / 64, 2)) / math.log(wide)))
    hasher = Hasher(dim, tables, rotations, probes)

    def place(batches):
        for batch in batches:
            codes, n = hasher.codes(matrix(batch.column(1))), batch.num_rows
            for t in range(tables):
                for p in range(codes.shape[2]):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, t, np.int32)), pa.array(codes[:, t, p]), pa.array(np.full(n, p == 0))], ["id", "table", "bucket", "own"])

    placed = stored(rows.select("id", "embedding").mapInArrow(place, "id long, table int, bucket long, own boolean"), "buckets")
    sizes = placed.groupBy("table", "bucket").agg(F.count("*").alias("rows"), F.count_if("own").alias("owned")).filter("rows > 1 and owned > 0")
    blocks = F.floor((F.col("rows") - 1) / block + 1).cast("int")
    met = placed.join(sizes.select("table", "bucket", blocks.alias("blocks")), ["table", "bucket"])
    # a vector's buckets together, at most tables * (1 + probes) of them: the vectors themselves move once, below
    met = met.groupBy("id").agg(F.collect_list(F.struct("table", "bucket", "own", "blocks")).alias("met"))
    dealt = rows.join(met, "id").withColumn("at", F.explode("met")).select("id", "n", "embedding", "at.*")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "mine").alias("i"), F.greatest(j, "mine").alias("j")))
    dealt = dealt.withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    dealt = dealt.select("table", "bucket", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "mine", "own", "id", "n", "embedding")
    keys = ["table", "bucket", "i", "j"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "id")

    def verify(found):
        """found: columns of whole groups, sorted by group and id."""
        t, bucket, i, j, mine, own, ids, n, x = found
        change = np.zeros(len(t), bool)
        change[0] = True
        for c in (t, bucket, i, j):
            change[1:] |= c[1:] != c[:-1]
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(t)))
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        left, right = [], []
        # groups of one size together: all their pairs in one array
        for s in np.unique(size[size > 1]):
            groups = start[size == s]
            a, b = np.triu_indices(s, 1)
            step = max(1, (1 << 19) // len(a))
            for at in range(0, len(groups), step):
                g = groups[at : at + step]
                if s <= 24:
                    p, q = (g[:, None] + a).ravel(), (g[:, None] + b).ravel()
                    may = (own[p] | own[q]) & ((i[p] == j[p]) | (mine[p] != mine[q])) & (ids[p] != ids[q])
                    p, q = p[may], q[may]
                    near = dot_rows(unit[p], unit[q]) >= least - 1e-9
                    left.append(p[near])
                    right.append(q[near])
                else:
                    for first in g:
                        part = slice(first, first + s)
                        p, q = np.nonzero(np.triu(unit[part] @ unit[part].T >= least - 1e-9, 1))
                        p, q = p + first, q + first
                        may = (own[p] | own[q]) & ((i[p] == j[p]) | (mine[p] != mine[q])) & (ids[p] != ids[q])
                        left.append(p[may])
                        right.append(q[may])
        p, q = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        cosine = dot_rows(x[p], x[q]) / np.sqrt((x[p] * x[p]).sum(axis=1) * (x[q] * x[q]).sum(axis=1))
        p, q = p[cosine >= least], q[cosine >= least]
        if not len(p):
            return
        # the pair counts in the first table where it meets, in the one bucket that _meet names
        used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
        vectors, same = np.unique(ids[used], return_inverse=True)
        sample = np.zeros(len(vectors), np.int64)
        sample[same] = used
        codes = hasher.codes(x[sample])
        va, vb = same[back[: len(p)]], same[back[len(p) :]]
        va, vb = np.minimum(va, vb), np.maximum(va, vb)
        first_here = np.zeros(len(p), bool)
        open_ = np.ones(len(p), bool)
        for table_no in range(tables):
            spot = _meet(codes[va, table_no], codes[vb, table_no])
            first_here |= open_ & (t[p] == table_no) & (spot == bucket[p])
            open_ &= spot < 0
        va, vb = va[first_here], vb[first_here]
        if not len(va):
            return
        weight = n[sample]
        links = np.bincount(va, weight[vb], len(vectors)) + np.bincount(vb, weight[va], len(vectors))
        label = _forest(len(vectors), va, vb)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(vectors[some]), pa.array(vectors[label[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]), matrix(batch.column(8))]
            if held is not None:
                cols = [np.concatenate(pair) for pair in zip(held, cols)]
            # the last group may go on in the next batch
            last = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            held = [c[cut:] for c in cols]
            if cut:
                yield from verify([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from verify(held)

    return dealt.mapInArrow(run, "a long, b long, links long")


def near_vectors(rows: DataFrame, least: float = 0.95, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Links between vectors whose cosine is at least ``least``, of ``rows`` (vec_id, embedding).

    One row per row: vec_id, n_links (others linked directly), component_id (the
    smallest vec_id reachable), kept (vec_id = component_id).  Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do rows with a
    null vec_id (component null, kept null).  Vectors of different length never link.
    Equal vectors are one vector with its number of rows; rows that repeat a vec_id
    count each.  Other columns are ignored; no rows give none.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select("vec_id", "embedding")
    good = rows.filter(is_usable())
    reps = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "n", "embedding"), "vectors")
    widths = [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]
    part = None
    for width in widths:
        one = linked_vectors(reps.filter(F.size("embedding") == width), least, tables, probes)
        part = one if part is None else part.union(one)
    if part is None:
        part = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    part = stored(part, "links")
    links = part.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(part.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    told = reps.join(links, "id", "left").join(groups, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # written, so that the join is of two plain exchanges: Spark splits the partition of a vector with many rows
    linked = good.join(stored(told, "told"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_vectors`` over all ``embeddings`` at a cosine of 0.95: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
