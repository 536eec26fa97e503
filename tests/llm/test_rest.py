"""Vectors, pages, sources and the pipeline."""

import collections
import hashlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import cross_polytope, forest, mixing, warc
from quarry.llm.graph import components

VECTORS = "vec_id long, embedding array<float>, label int, shard long, rank int, bucket string, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, "b", 3) for i, v in rows], VECTORS)


def odd_rows(n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:80] = x[50] + rng.normal(size=(30, d)).astype(np.float32) * 0.02
    x[100:140] = x[100]  # equal ones, more than any list is long
    x[200] = 3 * x[201]
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(x)]
    return rows + [(900, None), (901, [0.0] * d), (902, [float("nan")] + [1.0] * (d - 1)), (903, [float("inf")] + [1.0] * (d - 1)), (904, [None] + [1.0] * (d - 1)), (None, rows[3][1]), (5, rows[5][1])]


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]


def test_nearest(spark):
    rows = odd_rows()
    df = vectors(spark, rows)
    got = collections.defaultdict(list)
    for r in forest.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: v for i, v in usable(rows)}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        best = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1))
        assert all(abs(s - float(good[q] @ good[i])) < 1e-9 for _, i, s in got[q])
        assert [(-round(s, 9), i) for _, i, s in got[q]] == sorted((-round(s, 9), i) for _, i, s in got[q])
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
        total += len(best)
    assert hits >= 0.9 * total and set(got) == {i for i in good if i % 20 == 0}


def test_nearest_of_copies_whose_rows_repeat(spark):
    """A group of copies, one id of it 30 times, all others three times; far ones besides, one id with many vectors."""
    copies = [(i, [1.0, 0.0]) for i in range(100, 130) for _ in range(30 if i == 100 else 3)]
    many = [(7, [2.0, k / 64]) for k in range(30)]
    df = vectors(spark, copies + many + [(500 + i, [-1.0, i / 8]) for i in range(40)])
    got = [(r.vec_id, r.score) for r in forest.nearest(df, df.filter("vec_id = 105").limit(1), recall=1.0).orderBy("rank").collect()]
    assert got == [(7, 2.0)] + [(i, 1.0) for i in range(100, 120) if i != 105]


def test_nearest_of_few(spark):
    few = vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 0])])
    got = [(r.query_id, r["rank"], r.vec_id) for r in forest.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert forest.nearest(vectors(spark, []), vectors(spark, [])).count() == 0


def test_nearest_of_many_and_large_leaves(spark, monkeypatch):
    """Leaves cut in several shards, vectors of two lengths, an id forty times."""
    monkeypatch.setattr(forest, "SHARD_ROWS", 16)
    monkeypatch.setattr(forest, "LEAF_ROWS", 16)
    rng = np.random.default_rng(9)
    rows = [(i, list(map(float, rng.normal(size=8).astype(np.float32)))) for i in range(200)]
    wide = [(1000 + i, list(map(float, rng.normal(size=12).astype(np.float32)))) for i in range(30)]
    df = vectors(spark, rows + wide + [rows[7]] * 40)
    got = collections.defaultdict(list)
    for r in forest.nearest(df, df.filter("vec_id % 20 = 0"), recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for part in (rows, wide):
        x = {i: np.array(v) for i, v in part}
        for q in [i for i in x if i % 20 == 0]:
            best = [i for _, i in sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]]
            assert len(set(best) & set(got[q])) >= 19 and len(set(got[q])) == len(got[q]) == 20 and set(got[q]) <= set(x)


def test_shards():
    first, parts = forest.shards(np.array([3, 4, 30, 2, 0, 9]), 10)
    assert list(first) == [0, 0, 1, 4, 4, 5] and list(parts) == [1, 1, 3, 1, 1, 1]


def test_near_vectors_of_two_lengths(spark):
    rows = [(1, [1, 0]), (2, [1, 0]), (3, [1, 0, 0]), (4, [1, 0, 0, 0]), (5, [0.99, 0.01, 0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cross_polytope.near_vectors(vectors(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


@pytest.mark.parametrize("block", [128, 4])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(cross_polytope.linked_vectors, "__defaults__", (0.95, cross_polytope.TABLES, cross_polytope.PROBES, block))
    rows = odd_rows()
    got = collections.defaultdict(list)
    for r in cross_polytope.near_vectors(vectors(spark, rows)).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    good = usable(rows)
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.array([min(label[k], label[near[k]].min(initial=10**9)) for k in range(len(good))])
        if np.array_equal(new, label):
            break
        label = new
    want = collections.defaultdict(list)
    for k, (i, _) in enumerate(good):
        want[i].append((int(near[k].sum()), int(label[k]), i == int(label[k])))
    for i, v in rows:
        if i in (900, 901, 902, 903, 904):
            want[i].append((0, i, True))
    want[None].append((0, None, None))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_near_vectors_without_rows(spark):
    assert cross_polytope.near_vectors(vectors(spark, [])).count() == 0
    assert cross_polytope.near_vectors(vectors(spark, [(1, None)])).first().n_links == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5)] + [tuple(map(int, rng.integers(200, 230, 2))) for _ in range(20)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: c for v, c in label.items() if any(v in e and e[0] != e[1] for e in edges)}


# Sources --------------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), ("d", 5), (None, 300), ("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted((s for s, _ in sizes if s), key=str) + [None]
    weight, size = {s: k % 3 + 1 for k, s in enumerate(order)}, dict(sizes)
    fixed, total = {}, sum(size.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    want = fixed | {s: level * weight[s] for s in free}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, texts):
    rng = np.random.default_rng(0)
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 60))), "en", ("a", "b", None, "d")[int(k) % 4], 0) for k in range(2000)]
    rows += [(7, "w w w", "en", "a", 0), (None, "w w", "en", None, 0), (2001, None, "en", "z", 0)]
    docs = texts(rows).drop("size").withColumn("size", mixing.word_count(mixing.F.col("text")))
    a, b = (sorted((str(r.doc_id), r.size, r.source or "", r.copies, round(r.target, 6), r.source_size) for r in mixing.mix_sources(docs).collect()) for _ in range(2))
    assert a == b and len(a) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for _, size, source, copies, target, _ in a:
        assert 0 <= copies <= 3
        by[source][0] += size
        by[source][1] += size * copies
        by[source][2] = target
    for size, taken, target in by.values():
        assert abs(taken - target) <= 120
    assert mixing.emit_copies(mixing.mix_sources(docs)).count() == sum(r[3] for r in a)
    assert mixing.mix_sources(docs.filter("false")).count() == 0


# Pages ----------------------------------------------------------------------------------------------


def page_rows():
    quoted = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "<p>é</p>" * 300
    return [
        (1, "http://a/ü?x=1\n2", big),
        (2, None, big),
        (3, "http://b", big),
        (4, "http://c", quoted * 20),
        (5, "http://c", quoted),
        (6, "", ""),
        (7, "http://d", None),
        (8, "http://e", "x" * 999),
        (9, "http://e", "x" * 999),
        (10, "http://f", "WARC/1.0\r\n"),
        (11, "http://g", "y" * 1000),
        (12, "http://g", "y" * 1000),
        (None, "http://h", "z" * 2000),
        (13, "u" * 3000, "\x00\r\n\r\n" * 400),
    ]


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 3000])
def test_warc(spark, size):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "digest", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(warc.open_warc(spark, warc.write_warc(pages, archive_bytes=size))).collect()), key=repr)
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and largest.get(html or "", i) != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", largest[html or ""] if again else None))
    assert got == sorted(want, key=repr)


def test_warc_keeps_payloads_and_finds_damage(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    archives = warc.open_warc(spark, warc.write_warc(pages, compression="none"))
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_warc(archives).filter("record_type = 'response'").collect()}
    assert payloads[4] == page_rows()[3][2].encode()
    spoilt = archives.selectExpr("archive_no", "cast(replace(cast(archive as string), 'yyyyyyyy', 'yyyyqyyy') as binary) as archive")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spoilt).collect()
    assert warc.read_warc(warc.open_warc(spark, warc.write_warc(pages.filter("false")))).count() == 0


def test_warc_of_long_payloads(spark):
    """Payloads longer than an archive and than one look for candidates, with headers quoted at its edges; a copy of one."""
    quoted = "WARC/1.1\r\nContent-Length: 9\r\n\r\n"
    long = ("a" * ((1 << 20) - 20) + quoted) * 6
    rows = [(1, "u", long), (2, "u", long), (3, "u", "b" * 2_500_000), (4, "u", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(warc.open_warc(spark, warc.write_warc(pages)), payloads=False).collect()}
    assert got == {1: (len(long), "revisit", 2), 2: (len(long), "response", None), 3: (2_500_000, "response", None), 4: (1, "response", None)}


def test_warc_files_are_plain(spark):
    """What other readers open: each file begins with a record and ends with the end of one (Spark may add an empty file)."""
    folder = warc.write_warc(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), archive_bytes=3000)
    raw = [warc.plain(bytes(r.archive)) for r in warc.open_warc(spark, folder).collect()]
    raw = [x for x in raw if x]
    assert len(raw) > 1 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in raw)


def test_chain_rejects_what_it_does_not_reach():
    offset, after = np.array([40, 0, 100, 55, 10]), np.array([100, 40, 170, 100, 55])
    assert list(warc.reached(offset, after)) == [True, True, True, False, False]
    assert list(warc.reached(np.array([5]), np.array([9]))) == [False]
    assert list(warc.reached(np.array([], int), np.array([], int))) == []


# Pipeline -------------------------------------------------------------------------------------------


def test_pipeline(spark):
    path = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), "test")
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        sizes.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert last.count() == sizes[-1] > 0 and sizes[1] < sizes[0]
    assert corpus_pipeline.run(spark, path).count() == sizes[-1]


def test_near_duplicates_by_row(spark):
    """One row per group of near texts, also where ids are shared or missing, and empty texts each."""
    words = [[f"{c}{k}" for k in range(60)] for c in "abcde"]
    near = lambda w: " ".join([*w[:-1], "z"])
    a, b, c, d, e = map(" ".join, words)
    rows = [(5, a), (3, near(words[0])), (None, a), (7, b), (7, c), (7, c), (None, d), (None, near(words[3])), (None, e), (8, ""), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert [t for i, t in got if i is None and t in (d, near(words[3]))] in ([d], [near(words[3])])
    rest = sorted((g for g in got if g[1] not in (d, near(words[3]))), key=repr)
    assert rest == sorted([(3, near(words[0])), (7, b), (7, c), (None, e), (8, ""), (9, None)], key=repr)
