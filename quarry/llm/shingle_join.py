"""Operator 2: Jaccard join of word shingles with Bayesian candidate pruning.

A document is the set of its runs of five words.  Equal sets are one class with members.
Over the classes' representatives:

1. MinHash values fall into bands; documents that agree in a whole band are candidates.
2. In each bucket, candidates are compared by further MinHash values, ``STEP`` at a
   time.  After each step the posterior probability that the pair reaches the threshold,
   given the agreements so far and a uniform prior, is looked up; below ``TOLERANCE`` the pair goes.
3. What is left is verified exactly on the sets.

No pair is listed.  A bucket yields the trees of its surviving pairs, whose components hold
all pairs that may link; documents of one component meet again, in blocks of
bounded size, and each is told how many others it links to.  Blocks of a bucket meet only for rows
that no tree joins yet, and so do those of a component when links need not be counted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, grams, mix, signed, slices, stored, table, utf8, words
from .cross_polytope import _forest
from .graph import components

SHINGLE = 5
LEAST = 0.8
#: 28 bands of 5 values: a pair of similarity 0.8 shares none with probability 1.5e-5.
BANDS, BAND_ROWS = 28, 5
#: MinHash values for the pruning, apart from those of the bands, and how many are compared at a time.
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
#: Documents of a bucket or component that are compared in one go.
BLOCK = 128
#: A bucket's rows are only signatures: its blocks have so many times as many.
SIGNED = 4


def shingle_sets(column, n: int = SHINGLE):
    """Sorted different shingles of each text: (hashes, offsets). Words are lower-cased.

    A text of fewer than n words has one shingle, all of its words; without words, none.
    """
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buf, off = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    values, sizes = [], []
    for a, b in slices(off):
        h, _, _, rows = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        g, at = grams(h, rows, n)
        row = np.searchsorted(rows, at, "right") - 1
        count = np.diff(rows)
        few = np.flatnonzero((count > 0) & (count < n))
        whole = [grams(h[rows[i] : rows[i + 1]], np.array([0, count[i]]), int(count[i]))[0] for i in few]
        g = np.concatenate([g, *whole])
        row = np.concatenate([row, few])
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        values.append(g[new])
        sizes.append(np.bincount(row[new], minlength=b - a))
    return np.concatenate([np.zeros(0, np.uint64), *values]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)


def minhashes(g: np.ndarray, off: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """rows x count MinHash values (uint32) of non-empty sets."""
    rng = np.random.default_rng(seed)
    odd = (rng.integers(0, 1 << 32, count, np.uint64) | np.uint64(1)).astype(np.uint32)
    flip = rng.integers(0, 1 << 32, count, np.uint64).astype(np.uint32)
    out = np.empty((len(off) - 1, count), np.uint32)
    low = (mix(g) >> np.uint64(32)).astype(np.uint32)
    step = 1 << 16
    # pieces that stay in the cache; a set longer than a piece is one piece
    for a, b in slices(off, step):
        part, at = low[off[a] : off[b]], off[a:b] - off[a]
        for k in range(count):
            out[a:b, k] = np.minimum.reduceat((part ^ flip[k]) * odd[k], at)
    return out


def fewest_agreements(least: float = LEAST, tolerance: float = TOLERANCE, compared: int = COMPARED, step: int = STEP) -> list[int]:
    """Per step the fewest agreements with which a pair stays.

    With a uniform prior the similarity after m agreements in n has a Beta(m + 1, n - m + 1)
    posterior; its mass above ``least`` is a binomial tail.
    """
    out = []
    for n in range(step, compared + 1, step):
        logs = [math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(least) + (n + 1 - j) * math.log(1 - least) for j in range(n + 2)]
        # P(similarity >= least | m) = P(Binomial(n + 1, least) <= m)
        below = np.cumsum(np.exp(logs))
        out.append(int(np.searchsorted(below, tolerance)))
    return out


def _pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: list[int], step: int) -> np.ndarray:
    """Which pairs survive the incremental comparison."""
    alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest):
        cols = slice(k * step, (k + 1) * step)
        agreed = agreed + (sig[a[alive], cols] == sig[b[alive], cols]).sum(axis=1)
        stay = agreed >= least
        alive, agreed = alive[stay], agreed[stay]
    return alive


def _grouped(check, n_keys: int = 3):
    """Feed whole groups (equal first ``n_keys`` columns of sorted batches) to ``check(table, starts)``."""

    def run(batches):
        held = []
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
            last = np.ones(batch.num_rows, bool)
            for k in keys:
                last &= k == k[-1]
            if held:
                before = [held[-1].column(k)[-1].as_py() for k in range(n_keys)]
                if all(b == k[0] for b, k in zip(before, keys)) and last.all():
                    held.append(batch)
                    continue
            cut = int(np.argmax(last))
            if cut or held:
                # the held group ends in this batch, or before it
                yield from whole([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield from whole(held)

    def whole(batches):
        t = pa.Table.from_batches([b for b in batches if b.num_rows]).combine_chunks() if any(b.num_rows for b in batches) else None
        if t is None:
            return
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in range(n_keys):
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        yield from check(t, np.append(np.flatnonzero(change), t.num_rows))

    return run


def _blocks(size, block: int):
    return F.floor((size - 1) / block + 1).cast("int")


def _block_pairs(df: DataFrame, size: str, key: str, block: int) -> DataFrame:
    """Cut groups of ``size`` rows in blocks: a row goes to each pair (i, j) of blocks that has its own.

    Rows of equal ``label`` need not be compared there.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(j, "_mine").alias("i"), F.greatest(j, "_mine").alias("j")))
    cut = df.withColumn("_blocks", _blocks(F.col(size), block)).withColumn("_mine", F.pmod(F.xxhash64(key, F.lit("block")), F.col("_blocks")).cast("int"))
    met = cut.withColumn("pair", F.explode(pairs)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")})
    return met.withColumn("label", F.when(F.col("i") == F.col("j"), F.col(key)).otherwise(F.col("_mine"))).drop("_blocks", "_mine", "pair", size)


def _across(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Cells (key, i, j, label, id) in which all ``rows`` (key, id, label) of a key meet that differ in label.

    Of each key, the rows of its most frequent label meet the others only, each in as many cells as the others
    have blocks; a key of one label has none.  So a key whose rows are nearly all of one label costs a few cells a row.
    """
    counted = rows.groupBy(key, "label").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"))
    main = counted.filter("size > most.n").select(key, F.col("most.label").alias("main"), F.col("most.n").alias("_d"), (F.col("size") - F.col("most.n")).alias("_p"))
    met = rows.join(stored(main, "mains"), key).withColumns({"_p": _blocks(F.col("_p"), block), "_d": _blocks(F.col("_d"), block), "_other": F.col("label") != F.col("main")})
    met = met.withColumn("_mine", F.pmod(F.xxhash64("id", key), F.when(F.col("_other"), F.col("_p")).otherwise(F.col("_d"))).cast("int"))
    cell = lambda i, j, label: F.struct(i.alias("i"), j.alias("j"), label.cast("long").alias("label"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    others = F.transform(upto("_p"), lambda q: cell(F.least(q, "_mine"), F.greatest(q, "_mine"), F.col("label")))
    to_main = F.transform(upto("_d"), lambda d: cell(F.col("_mine"), F.col("_p") + d, F.lit(0)))
    to_others = F.transform(upto("_p"), lambda q: cell(q, F.col("_p") + F.col("_mine"), F.lit(1)))
    at = F.explode(F.when(F.col("_other"), F.concat(others, to_main)).otherwise(to_others))
    return met.select(key, "id", at.alias("at")).select(key, "at.*", "id")


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) with a word in it: doc_id, node and check (hashes of its set), bands, sig."""

    def sign(batches):
        for batch in batches:
            g, off = shingle_sets(batch.column(1))
            own = np.flatnonzero(np.diff(off))
            off = np.append(off[own], len(g))
            if not len(own):
                continue
            names = [np.add.reduceat(mix(g ^ np.uint64(c)), off[:-1]) + np.diff(off).astype(np.uint64) for c in (1, 2)]
            sig = minhashes(g, off, BANDS * BAND_ROWS + COMPARED)
            bands = sig[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            h = np.zeros((len(sig), BANDS), np.uint64)
            for k in range(BAND_ROWS):
                h = mix(h ^ bands[:, :, k]) + np.arange(BANDS, dtype=np.uint64)
            rest = np.ascontiguousarray(sig[:, BANDS * BAND_ROWS :].astype("<u2"))  # enough to tell whether values agree
            at = np.arange(len(own) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own)),
                    *(pa.array(signed(n)) for n in names),
                    pa.ListArray.from_arrays(pa.array(at * BANDS), pa.array(h.ravel().view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at * (2 * COMPARED)), pa.py_buffer(rest)]),
                ],
                ["doc_id", "node", "check", "bands", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, node long, check long, bands array<long>, sig binary")


def candidate_trees(signed_sets: DataFrame, least: float, tolerance: float, block: int) -> DataFrame:
    """(u, v): trees over the pairs of ``signed_sets`` (id, bands, sig) that banding proposes and pruning keeps.

    A bucket is first cut in blocks, each row in one of them.  Then rows of different blocks are compared, but
    only those that the trees of all buckets do not join yet: the components are the same as if all were.
    """
    spark = signed_sets.sparkSession
    fewest = fewest_agreements(least, tolerance)
    placed = signed_sets.select("id", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(placed.join(sizes, "band").select("id", "band", "size"), "buckets")

    def check(t, starts):
        label, ids = (t.column(k).to_numpy() for k in ("label", "id"))
        raw, _ = utf8(t.column("sig"))
        sig = np.frombuffer(raw.tobytes(), "<u2").reshape(-1, COMPARED)
        sizes_ = np.diff(starts)
        us, vs = [], []
        for s in np.unique(sizes_[sizes_ > 1]):
            firsts = starts[:-1][sizes_ == s]
            a, b = np.triu_indices(s, 1)
            per = max(1, (1 << 17) // len(a))
            for at in range(0, len(firsts), per):
                f = firsts[at : at + per, None]
                p, q = (f + a).ravel(), (f + b).ravel()
                may = label[p] != label[q]
                p, q = p[may], q[may]
                keep = _pruned(sig, p, q, fewest, STEP)
                us.append(p[keep])
                vs.append(q[keep])
        if not us:
            return
        u, v = np.concatenate(us), np.concatenate(vs)
        names, back = np.unique(ids[np.concatenate([u, v])], return_inverse=True)
        label = _forest(len(names), back[: len(u)], back[len(u) :])
        hang = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[hang]), pa.array(names[label[hang]])], ["u", "v"])

    def trees(cells):
        dealt = cells.select("band", "i", "j", "label", "id", "sig").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "band", "i", "j")
        return dealt.sortWithinPartitions("band", "i", "j", "id").mapInArrow(_grouped(check), "u long, v long").distinct()

    of_id = met.groupBy("id").agg(F.collect_list(F.struct("band", "size")).alias("met"))  # at most BANDS each
    dealt = signed_sets.select("id", "sig").join(of_id, "id").select("id", "sig", F.explode("met").alias("at")).select("at.band", "at.size", "id", "sig")
    mine = F.pmod(F.xxhash64("id", "band"), _blocks(F.col("size"), block)).cast("int")
    first = stored(trees(dealt.withColumns({"i": mine, "j": mine, "label": F.col("id")})), "candidates")
    large = met.filter(F.col("size") > block)
    if large.isEmpty():
        return first
    labelled = stored(_labelled(large.select("band", "id"), first), "labels")
    return first.union(trees(_across(labelled, "band", block).join(signed_sets.select("id", "sig"), "id"))).distinct()


def _labelled(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows`` with the label of each id: its component in ``trees`` (u, v), or itself."""
    names = components(trees).select(F.col("node").alias("id"), F.col("component").alias("label"))
    return rows.join(names, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _links(cells: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Exact links inside each of ``cells`` (component, i, j, label, id), between different labels: (a, b, links), as in ``linked_vectors``.

    ``sets`` has id, n (members) and g.
    """
    spark = sets.sparkSession
    dealt = cells.join(sets, "id").select("component", "i", "j", "label", "id", "n", "g")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j").sortWithinPartitions("component", "i", "j", "id")

    def check(t, starts):
        ids, n, label = (t.column(k).to_numpy() for k in ("id", "n", "label"))
        raw, off = utf8(t.column("g"))
        g, off = np.frombuffer(raw.tobytes(), np.uint64), off // 8
        a_out, b_out, l_out = [], [], []
        for first, last in zip(starts[:-1], starts[1:]):
            rows = last - first
            if rows < 2:
                continue
            own, at = g[off[first] : off[last]], np.diff(off[first : last + 1])
            value, col = np.unique(own, return_inverse=True)
            row = np.repeat(np.arange(rows), at)
            both = np.zeros((rows, rows))
            # shingles by shingles, so that the matrix of a block stays small
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for c in range(0, len(value), 4096):
                lo, hi = np.searchsorted(col, [c, c + 4096])
                has = np.zeros((rows, 4096), np.float32)
                has[row[lo:hi], col[lo:hi] - c] = 1
                both += has @ has.T
            near = np.triu(both >= least * (at[:, None] + at[None, :] - both) - 1e-9, 1)
            near &= label[first:last, None] != label[None, first:last]
            p, q = np.nonzero(near)
            if len(p):
                links = np.bincount(p, n[first + q], rows) + np.bincount(q, n[first + p], rows)
                tree = _forest(rows, p, q)
                some = np.flatnonzero(links)
                a_out.append(ids[first + some])
                b_out.append(ids[first + tree[some]])
                l_out.append(links[some].astype(np.int64))
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, l_out)], ["a", "b", "links"])

    return dealt.mapInArrow(_grouped(check), "a long, b long, links long")


def verified_links(sets: DataFrame, groups: DataFrame, least: float, block: int, counted: bool = True) -> DataFrame:
    """Exact links inside each of ``groups`` (node, component): (a, b, links), whose trees (a, b) have the components of all links.

    ``sets`` has id, n (members) and g.  The sums of ``links`` by ``a`` count all links if ``counted``, for which every
    two blocks of a group meet.  Otherwise rows meet in two random cuts of their group in blocks, and then
    only where these have not joined them, so that a group of near copies costs a few cells a row.
    """
    sized = groups.withColumnRenamed("node", "id").join(groups.groupBy("component").agg(F.count("*").alias("size")), "component")
    if counted:
        return _links(_block_pairs(sized, "size", "id", block), sets, least)
    large = stored(sized.filter(F.col("size") > block).select("component", "id"), "large")
    some = not large.isEmpty()
    if some:
        sets = stored(sets, "sets")
    cuts = F.explode(F.when(F.col("size") > block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    mine = F.pmod(F.xxhash64("id", "i"), _blocks(F.col("size"), block)).cast("int")
    first = _links(sized.withColumn("i", cuts).withColumn("j", mine).withColumn("label", F.col("id")), sets, least)
    if not some:
        return first
    first = stored(first, "links")
    labelled = stored(_labelled(large, first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    return first.union(_links(_across(labelled, "component", block), sets, least))


def near_texts(docs: DataFrame, least: float = LEAST, tolerance: float = TOLERANCE, block: int = BLOCK, counted: bool = True) -> DataFrame:
    """Documents linked by a Jaccard similarity of their shingle sets of ``least`` or more.

    ``docs`` has doc_id and text.  One row per row: doc_id, n_links (other rows linked
    directly), class_id (the smallest doc_id of its set's equals), component_id (the
    smallest doc_id reachable by links), kept (doc_id = component_id).  Without ``counted``
    n_links is null: links are followed, but those between rows that others join already are not counted.  Words are
    lower-cased and separated by ASCII white space.  A text without words, null or empty, links with
    nothing and is its own class.  A row without doc_id counts among the equals of its text; a
    class in which no row has one links with its equals only (ids and kept null).
    Rows that repeat a doc_id count each, and all of them are kept if that id is.
    Other columns are ignored.  A text is held whole by one task, with some 60 bytes a byte of
    it while it is cut in words; its set of shingles moves as one value of at most 2 GB.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    told = stored(signatures(docs), "signatures")
    classes = stored(told.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    one_each = told.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumnRenamed("node", "id")
    trees = stored(candidate_trees(one_each, least, tolerance, SIGNED * block), "candidates")
    groups = stored(components(trees), "groups")

    # The sets of candidates, made again from one text each.
    wanted = groups.join(classes.withColumnRenamed("class_id", "doc_id"), groups.node == classes.node).select("doc_id", groups.node, "n")
    texts = docs.join(wanted, "doc_id").select("node", "n", "text")

    def take(batches):
        for batch in batches:
            g, off = shingle_sets(batch.column(2))
            size = np.diff(off)
            full = np.flatnonzero(size)
            names = np.zeros(len(size), np.uint64)
            if len(full):
                names[full] = np.add.reduceat(mix(g ^ np.uint64(1)), off[full]) + size[full].astype(np.uint64)
            # rows that share a doc_id may have other texts
            own = pa.array(np.flatnonzero((signed(names) == batch.column(0).to_numpy()) & (size > 0)))
            data = g.tobytes()
            sets = pa.array([data[8 * a : 8 * b] for a, b in zip(off[:-1], off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([c.take(own) for c in (batch.column(0), batch.column(1), sets)], ["id", "n", "g"])

    sets = texts.mapInArrow(take, "id long, n long, g binary").dropDuplicates(["id"])
    part = stored(verified_links(sets, groups, least, block, counted), "links")
    links = part.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(part.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_class = classes.join(links, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("n") - 1 if counted else F.lit(None).cast("long")
    of_class = of_class.join(names, "component").select("node", "class_id", "component_id", n_links.alias("n_links"))
    # written, so that the join is of two plain exchanges: Spark splits the partition of a class with many rows
    found = told.select("doc_id", "node").join(stored(of_class, "classes"), "node").select("doc_id", "n_links", "class_id", "component_id")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    alone = docs.filter(wordless).select("doc_id", F.lit(0 if counted else None).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_texts`` over all ``documents``."""
    return near_texts(table(spark, sf_dir, "documents"))
