"""Retrieval for many questions at once: BM25, dense, fused, reranked.

Questions are (qid, question); chunks have chunk_id, text, source_file, section and chunk_ord, which
breaks ties.  Ranks count from 1.  Lists of hits are long tables, one row a hit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, tokens
from ..sources.folders import stored
from .best import ROUNDED, Best

# Fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES, POOL, RRF_K, TOP = 20, 15, 60, 5
#: Blocks of 512 queries that are sent to all tasks at a time (about 0.5 MB each at 128 components).
SENT_BLOCKS = 64
#: Question words, or keys of repeated chunks, that are sent to all tasks instead of shuffling the corpus; one takes some 50 bytes.
SENT_WORDS = 200_000
#: Scores, and products of a question's word and a posting, that a task holds at a time.
SCORES, PRODUCTS = 1 << 18, 1 << 21
#: Vectors and pairs that are worth a task, and vectors that it takes at a time.
TASK_VECTORS, TASK_PAIRS, BATCH_VECTORS = 16_384, 1 << 26, 2_048


def ranked(df: DataFrame, k: int, *order: Column, by: str = "qid", name: str = "rank") -> DataFrame:
    """Number rows by ``order`` and keep the first ``k``; Spark cuts each partition before it shuffles."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)


def _counted(toks) -> Column:
    """Different words of a list, in order, with their numbers: array of (tok, tf)."""
    begins = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda j: (j == 1) | (F.get(s, j - 1) != F.get(s, j - 2)))
    counts = lambda s, b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s) + 1)), lambda at, then: F.struct(F.get(s, at - 1).alias("tok"), (then - at).cast("long").alias("tf")))
    return F.when(F.size(toks) > 0, bound(F.sort_array(toks), lambda s: bound(begins(s), lambda b: counts(s, b))))


def listed(chunks: DataFrame) -> DataFrame:
    """A row a chunk: chunk_id, chunk_ord, dl, words (array of tok, tf), copies, shared.

    Words are counted within their row, nothing moves.  Rows of one chunk that are equally long count as one with the words
    of all (``copies`` tells how many); ``shared`` marks chunks with rows of several lengths or copies.
    """
    key = ["chunk_id", "chunk_ord"]
    repeated = chunks.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key])
    read = chunks.select(*key, tokens("text").alias("toks"))
    n = repeated.limit(SENT_WORDS + 1).count()
    one = lambda df: df.select(*key, F.size("toks").alias("dl"), "toks", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("shared"))
    if n == 0:
        rows = one(read)
    else:
        found = F.broadcast(repeated) if n <= SENT_WORDS else repeated
        same = F.col("chunk_id").eqNullSafe(F.col("_chunk_id")) & F.col("chunk_ord").eqNullSafe(F.col("_chunk_ord"))
        several = read.join(found, same, "left_semi").withColumn("dl", F.size("toks")).groupBy(*key, "dl").agg(F.flatten(F.collect_list("toks")).alias("toks"), F.count("*").alias("copies"))
        rows = one(read.join(found, same, "left_anti")).unionByName(several.withColumn("shared", F.lit(True)))
    # behind a generator, so that the words are read and counted once
    entry = F.struct("dl", _counted(F.col("toks")).alias("words"))
    return rows.select(*key, "copies", "shared", F.explode(F.array(entry)).alias("e")).select(*key, "e.dl", "e.words", "copies", "shared")


def postings(docs: DataFrame) -> DataFrame:
    """tok, chunk_id, chunk_ord, dl, tf of what ``listed`` gives."""
    return docs.select("chunk_id", "chunk_ord", "dl", F.explode("words").alias("w")).select("w.tok", "chunk_id", "chunk_ord", "dl", "w.tf")


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length avgdl, chunks without a token included."""
    return docs.agg(F.sum("copies").alias("n"), (F.sum(F.col("dl") * F.col("copies")) / F.sum("copies")).alias("avgdl"))


def bm25_stats(posted: DataFrame, size: DataFrame) -> DataFrame:
    """tok, df, idf. A negative idf becomes a share of the mean over the vocabulary. ``size`` is one row."""
    df = posted.groupBy("tok").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _asked_words(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(tokens("question")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf"))


def _weighed(questions: DataFrame, posted: DataFrame, stats: DataFrame, size: DataFrame) -> DataFrame:
    """qid, chunk_id, chunk_ord, part: a row for each word of a question in each chunk that holds it."""
    asked = _asked_words(questions)
    few = asked.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    sent = F.broadcast if few else lambda df: df
    words = asked.join(stats.select("tok", "idf"), "tok")
    weighed = posted.join(sent(words), "tok").crossJoin(F.broadcast(size.select("avgdl")))  # one row
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighed.select("qid", "chunk_id", "chunk_ord", part.alias("part"))


def bm25_score(questions: DataFrame, posted: DataFrame, stats: DataFrame, size: DataFrame) -> DataFrame:
    """qid, chunk_id, chunk_ord, score of every chunk that holds a word of the question; repeated words count again."""
    return _weighed(questions, posted, stats, size).groupBy("qid", "chunk_id", "chunk_ord").agg(F.sum("part").alias("score"))


def bm25_topk(questions: DataFrame, index, k: int = CANDIDATES) -> DataFrame:
    """The best k by score (rounded, as sums of doubles have no fixed order), ties in corpus order.

    ``index``: what ``index.lexical_index`` or ``open_lexical_index`` gives.  Lists are padded
    with chunks that score 0, first in corpus order: among the first 2k chunks
    there are k without a match wherever fewer than k match.  These enter with
    nothing added, so one aggregation serves both.  Words of questions go to the chunks, and each task hands on its best
    alone; questions with more than ``SENT_WORDS`` words are joined to the postings.  The lists are stored.
    """
    first = stored(index.first.orderBy(F.asc_nulls_last("chunk_ord")).limit(2 * k), "first")  # bounded
    nothing = questions.select("qid").distinct().crossJoin(F.broadcast(first)).select("qid", "chunk_id", "chunk_ord", F.lit(0.0).alias("part"))
    asked = _asked_words(questions).join(index.stats.select("tok", "idf"), "tok").select("qid", "tok", (F.col("qf") * F.col("idf")).alias("weight"))
    words = asked.limit(SENT_WORDS + 1).toArrow()
    if words.num_rows > SENT_WORDS:
        parts = _weighed(questions, index.postings, index.stats, index.size)
    else:
        always = [r[0] for r in first.select("chunk_ord").collect()]
        schema = f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id string, chunk_ord long, part double"
        score = _scorer(words, index.size.first()["avgdl"], always, k)
        parts = index.docs.select("chunk_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "dl", "shared", "words").mapInArrow(score, schema)
    scored = parts.unionByName(nothing).groupBy("qid", "chunk_id", "chunk_ord").agg(F.round(F.sum("part"), 6).alias("score"))
    return stored(ranked(scored, k, F.desc("score"), F.asc_nulls_last("chunk_ord")), "bm25")


def _scorer(words: pa.Table, avgdl: float, always: list, k: int):
    """What a task does: the best k chunks of each question among its own, by ``words`` (qid, tok, weight).

    Those in ``always`` and those that ``listed`` marks as shared come back whatever they score, to be added up.
    """
    words = words.combine_chunks()
    coded = pc.dictionary_encode(words["qid"], null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    qids, question = coded.dictionary, coded.indices.to_numpy()
    vocabulary = pc.unique(words["tok"])
    word = pc.index_in(words["tok"], vocabulary).to_numpy()
    order = np.argsort(word, kind="stable")
    question, weight = question[order], words["weight"].to_numpy()[order]
    ends = np.searchsorted(word[order], np.arange(len(vocabulary) + 1))
    n, none = len(qids), np.iinfo(np.int64).max
    kept = np.asarray([none if x is None else x for x in always], np.int64)
    step = max(16, SCORES // max(1, n))

    def score(batches):
        best = Best(n, k)

        def out(q, chunk, ord_, value):
            return pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(chunk, pa.string()), pa.array(ord_, pa.int64(), mask=ord_ == none), pa.array(value, pa.float64())], ["qid", "chunk_id", "chunk_ord", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows if n else 0, step):
                part = batch.slice(at, step)
                d = part.num_rows
                lists = part.column(4)
                held = lists.flatten().flatten()  # tok, tf
                chunk = np.repeat(np.arange(d), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                found = pc.index_in(held[0], vocabulary)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                w, chunk, tf = found.drop_null().to_numpy().astype(np.int64), chunk[hit], held[1].to_numpy()[hit].astype(np.float64)
                dl = pc.fill_null(part.column(2), 0).to_numpy()[chunk]
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                many = ends[w + 1] - ends[w]
                total = np.cumsum(many)
                scores = np.zeros(n * d)
                lo = 0
                while lo < len(w):
                    hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PRODUCTS, "right")))
                    m = many[lo:hi]
                    own = np.repeat(np.arange(lo, hi), m)
                    entry = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m) + ends[w[own]]
                    scores += np.bincount(question[entry] * d + chunk[own], share[own] * weight[entry], n * d)
                    lo = hi
                scores = scores.reshape(n, d)
                ord_ = pc.fill_null(part.column(1), none).to_numpy()
                whole = pc.fill_null(part.column(3), False).to_numpy(zero_copy_only=False) | np.isin(ord_, kept)
                if whole.any():
                    q, c = np.nonzero((scores != 0) & whole)
                    yield out(q, part.column(0).take(pa.array(c)).to_pylist(), ord_[c], scores[q, c])
                    scores[:, whole] = 0
                limit = np.minimum(best.bound, -np.partition(scores, d - k, axis=1)[:, d - k] + ROUNDED) if d >= k else best.bound
                q, c = np.nonzero((scores != 0) & (-scores <= limit[:, None]))
                best.add(q, -scores[q, c], ord_[c], np.asarray(part.column(0).take(pa.array(c)).to_pylist() or [], object))
        if best.columns:
            q, value, ord_, chunk = best.columns
            yield out(q, list(chunk), ord_, -value)

    return score


def squared_distance(a, b) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, query_block: int = 512) -> DataFrame:
    """Exact nearest by squared distance: queries (qid, query), vectors (vec_id, embedding). Ties to the smaller id.

    A stated set of queries against all rows.  Vectors are dealt to tasks that meet ``query_block`` queries at a time as one
    product of matrices; what is near the best k by that is measured again, term by term, and each task hands on its best alone.
    Queries go to the tasks, ``SENT_BLOCKS`` blocks at a time.  Vectors (or queries) that
    are null, of another length or hold null or very large components are measured by expressions; a distance
    that is null comes last.  The lists are stored.
    """
    dim = queries.agg(F.max(F.size("query"))).first()[0] or -1  # -1: no vector is plain
    plain = lambda v, key: F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))) & F.col(key).isNotNull(), F.lit(False))
    queries, vectors = queries.select("qid", "query").withColumn("plain", plain("query", "qid")), vectors.select("vec_id", "embedding").withColumn("plain", plain("embedding", "vec_id"))
    n_queries, odd_queries = queries.agg(F.count("*"), F.count_if(~F.col("plain"))).first()
    n, odd = vectors.agg(F.count("*"), F.count_if(~F.col("plain"))).first()
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, distance double"
    # a task has enough rows that its best are few against what it has read, and enough products to be worth it
    tasks = max(1, min(n // TASK_VECTORS, n * n_queries // TASK_PAIRS))
    dealt = vectors.filter("plain").select("vec_id", "embedding").repartition(tasks)
    slices = max(1, -(-n_queries // (SENT_BLOCKS * query_block)))
    numbered = queries.filter("plain").withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)))
    found = [dealt.mapInArrow(_nearest(asked, k, dim, query_block), schema) for i in range(slices) if (asked := numbered.filter(F.col("slice") == i).select("qid", "query").toArrow()).num_rows]

    def measured(some: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.crossJoin(some).select("qid", "vec_id", squared_distance(F.col("query"), F.col("embedding")).alias("distance"))

    if odd:
        found.append(measured(F.broadcast(queries), vectors.filter(~F.col("plain"))))
    if odd_queries:
        found.append(measured(F.broadcast(queries.filter(~F.col("plain"))), vectors.filter("plain")))
    scored = (reduce(DataFrame.unionByName, found) if found else measured(queries, vectors)).withColumn("distance", F.round("distance", 6))
    return stored(ranked(scored.select("qid", "vec_id", "distance"), k, F.asc_nulls_last("distance"), F.asc_nulls_last("vec_id")), "dense")


def _matrix(lists, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(asked: pa.Table, k: int, dim: int, query_block: int):
    """What a task does: the nearest of its rows (vec_id, embedding) to the queries ``asked`` (qid, query)."""
    qids, held = asked["qid"].combine_chunks(), asked["query"].combine_chunks()

    def nearest(batches):
        queries = _matrix(held, dim)
        norms = (queries**2).sum(1)
        blocks = [slice(at, at + query_block) for at in range(0, len(queries), query_block)]
        best = [Best(len(queries[b]), k) for b in blocks]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, BATCH_VECTORS):
                part = batch.slice(at, BATCH_VECTORS)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim)
                own = (x**2).sum(1)
                for b, kept in zip(blocks, best):
                    near = norms[b, None] + own - 2 * (queries[b] @ x.T)
                    error = 1e-12 * (norms[b] + own.max())  # of the product, many times over
                    limit = kept.bound if len(x) < k else np.minimum(kept.bound, np.partition(near, k - 1, axis=1)[:, k - 1] + ROUNDED + error)
                    q, r = np.nonzero(near <= (limit + error)[:, None])
                    distance = np.zeros(len(q))
                    for j in range(dim):  # the order of the sum in the expression
                        step = queries[b][q, j] - x[r, j]
                        distance += step * step
                    kept.add(q, distance, ids[r])
        for b, kept in zip(blocks, best):
            if kept.columns:
                q, distance, ids = kept.columns
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q + b.start)), pa.array(ids, id_type), pa.array(distance)], ["qid", "vec_id", "distance"])

    return nearest


def rrf_fuse(lexical: DataFrame, dense: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Both lists (qid, chunk_id, rank) by reciprocal ranks: qid, chunk_id, bm25_rank, dense_rank, rrf_score."""
    both = lexical.select("qid", "chunk_id", F.lit("bm25").alias("list"), "rank").unionByName(dense.select("qid", "chunk_id", F.lit("dense").alias("list"), "rank"))
    own = lambda name: F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank")
    fused = both.groupBy("qid", "chunk_id").agg(own("bm25"), own("dense"))
    part = lambda name: F.coalesce(1.0 / (rrf_k + F.col(f"{name}_rank")), F.lit(0.0))
    return fused.withColumn("rrf_score", part("bm25") + part("dense"))


def rrf_topk(fused: DataFrame, k: int = POOL) -> DataFrame:
    """Ties: lexical hits by their rank, then hits of the dense list alone."""
    return ranked(fused, k, F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts and metadata of hits; an empty section is none."""
    return hits.join(chunks.select("chunk_id", "text", "source_file", F.nullif("section", F.lit("")).alias("section")), "chunk_id")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], k: int = TOP) -> DataFrame:
    """Score (question, text) of each hit and keep the best k; ties keep the order of the fused list. Not-a-number ranks last."""
    scored = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    return ranked(scored.withColumnRenamed("rank", "rrf_rank"), k, F.desc(F.nanvl("rerank_score", F.lit(float("-inf")))), F.asc("rrf_rank"))


def retrieve_hybrid(questions: DataFrame, chunks: DataFrame, index, dense: DataFrame, k: int = TOP) -> DataFrame:
    """``index``: the lexical index of ``chunks``; ``dense``: qid, chunk_id, rank of the other list."""
    return hydrate(rrf_topk(rrf_fuse(bm25_topk(questions, index), dense), k), chunks)


def retrieve_reranked(questions: DataFrame, chunks: DataFrame, index, dense: DataFrame, scorer, k: int = TOP, pool: int = POOL) -> DataFrame:
    """At most ``pool`` hits come back, whatever k is. They are stored, as an answer reads them several times."""
    return stored(rerank(retrieve_hybrid(questions, chunks, index, dense, pool).join(questions, "qid"), scorer, k), "hits")
