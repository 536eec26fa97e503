"""Operators on texts against brute force, with odd rows."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, bwt, quality, shingle_join, substring, suffix_dedup, token_file, token_output
from quarry.llm.common import grams, utf8, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(n))


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    base = prose(rng, 300)
    shared = prose(rng, 70)
    out = [
        (1, base),
        (2, base),  # an exact copy
        (2, base),  # a repeated row
        (3, base.replace("a", "b", 3)),
        (4, prose(rng, 40) + " " + shared + " " + prose(rng, 20)),
        (5, shared + "\n" + prose(rng, 90)),
        (6, ""),
        (7, None),
        (8, "one"),
        (9, "one"),
        (10, " \n\t "),
        (None, prose(rng, 80)),
        (None, None),
        (11, "ab" * 900),
        (12, "x" * 70_000 + " " + prose(rng, 9000)),
        (13, "é ß 　 ç" * 300),
        (14, prose(rng, 60)),
        (14, prose(rng, 65)),  # a repeated id with another text
    ]
    return [(i, t, ("en", "fr", None)[k % 3], ("s", None)[k % 2], 0) for k, (i, t) in enumerate(out)]


def as_lists(df, *names):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append(tuple(r[n] for n in names))
    return {k: sorted(v, key=repr) for k, v in got.items()}


def wanted(rows, values):
    out = collections.defaultdict(list)
    for r, v in zip(rows, values):
        out[r[0]].append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_words_and_grams():
    import pyarrow as pa

    rows = ["a bb  a\n", "", None, " bb a bb a", "  x"]
    buf, off = utf8(pa.array(rows))
    h, start, end, at = words(buf, off)
    got = [[bytes(buf[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(at, at[1:])]
    assert got == [WORD.findall(r or "") for r in rows]
    g, where = grams(h, at, 2)
    assert list(where) == [0, 1, 3, 4, 5, 7] and g[1] != g[0] and g[2] == g[4] and g[1] == g[0] or g[2] == g[4]


# 2 --------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def linked(rows, least=0.8):
    sets = [shingles(r[1]) for r in rows]
    near = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= least * len(a | b)] for i, a in enumerate(sets)]
    return near


@pytest.mark.parametrize("block", [128, 3])
def test_shingle_join(spark, texts, block):
    rng = np.random.default_rng(5)
    base = prose(rng, 200).split()
    rows = [r for r in rows_of() if r[0] is not None]
    for k in range(12):  # a group of different near copies
        w = base.copy()
        w[int(rng.integers(200))] = f"q{k}"
        rows.append((100 + k, " ".join(w), "en", "s", 0))
    got = as_lists(shingle_join.near_texts(texts(rows), block=block), "n_links")
    assert got == wanted(rows, [(len(n),) for n in linked(rows)])
    parts = {r.doc_id: r.component_id for r in shingle_join.near_texts(texts(rows), block=block).collect()}
    assert {parts[100 + k] for k in range(12)} == {100} and parts[1] == parts[2] == parts[3] == 1 and parts[9] == 8


def edited(base, first, n, width=1):
    """Texts of ``base``, each with ``width`` own words; the edits of a chain (width > 1) add up."""
    out, w = [], base.split()
    for k in range(n):
        w = w.copy() if width > 1 else base.split()
        w[k * width * 7 % 190 : k * width * 7 % 190 + width] = [f"q{first + k}x{j}" for j in range(width)]
        out.append((first + k, " ".join(w), "en", "s", 0))
    return out


@pytest.mark.parametrize("block", [128, 4, 1])
def test_shingle_join_components_only(spark, texts, block):
    """Chains, whose ends are no links, and groups of near copies: components are those of all links."""
    rng = np.random.default_rng(8)
    rows = [r for r in rows_of() if r[0] is not None and r[0] not in (2, 14)]
    rows += edited(prose(rng, 200), 100, 40) + edited(prose(rng, 200), 200, 30, 12) + edited(prose(rng, 200), 300, 30, 6)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    near, parts = linked(rows), list(range(len(rows)))
    while (less := [min(parts[k] for k in (i, *n)) for i, n in enumerate(near)]) != parts:
        parts = less
    least = {p: min(r[0] for r, q in zip(rows, parts) if q == p) for p in set(parts)}
    want = {r[0]: least[p] for r, p in zip(rows, parts)}
    got = shingle_join.near_texts(texts(rows), block=block, counted=False).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_links is None for r in got)
    assert {r.doc_id: r.component_id for r in shingle_join.near_texts(texts(rows), block=block).collect()} == want


def test_shingle_join_of_near_copies_grows_with_their_number(spark, texts, monkeypatch):
    base, grouped = prose(np.random.default_rng(9), 200), shingle_join._grouped

    def met(n):
        seen = spark.sparkContext.accumulator(0)

        def counting(check, *rest):
            def run(batches):
                def told():
                    for b in batches:
                        seen.add(b.num_rows)
                        yield b

                yield from grouped(check, *rest)(told())

            return run

        monkeypatch.setattr(shingle_join, "_grouped", counting)
        docs = spark.createDataFrame(edited(base, 0, n), "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        assert [r.doc_id for r in got] == [0] and seen.value
        return seen.value

    assert met(240) < 4 * met(80)


def test_shingle_join_without_rows(spark, texts):
    assert shingle_join.near_texts(texts([])).count() == 0
    assert shingle_join.near_texts(texts([(1, None, None, None, None)])).first().kept


def test_pruning_keeps_likely_pairs():
    fewest = shingle_join.fewest_agreements()
    n = shingle_join.COMPARED
    # a pair of similarity 0.8 falls below the last bound with negligible probability
    p = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(fewest[-1]))
    assert p < 1e-4 and all(a <= b for a, b in zip(fewest, fewest[1:])) and fewest[-1] > n / 2


# 4 --------------------------------------------------------------------------------------------------


def brute_model(texts_, order):
    """The interpolated probabilities, by dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts_:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        discounts[k] = [0] + [max(quality.LEAST_DISCOUNT, min(i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]
    totals = {k: collections.Counter() for k in counts}
    given = {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            given[k][g[:-1]] += discounts[k][min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        low = p(g[1:])
        if g[:-1] not in totals[k]:
            return low
        own = max(0.0, counts[k][g] - discounts[k][min(counts[k][g], 3)]) if counts[k][g] else 0.0
        return (own + given[k][g[:-1]] * low) / totals[k][g[:-1]]

    return p


def test_perplexity(spark, texts):
    rng = np.random.default_rng(1)
    train_texts = [prose(rng, 60) for _ in range(6)]
    model = quality.train(quality.count_runs(spark.createDataFrame(list(enumerate(train_texts)), "doc_id long, text string"), list(range(6))))
    rows = [r for r in rows_of() if r[0] != 12]
    p, order = brute_model(train_texts, quality.ORDER), quality.ORDER
    want = []
    for r in rows:
        b = bytes(order - 1) + (r[1] or "").encode()
        logs = [math.log(p(b[i : i + order])) for i in range(len(b) - order + 1)]
        want.append((round(math.exp(-sum(logs) / len(logs)), 6) if logs else None,))
    got = as_lists(quality.perplexities(texts(rows), quality.stored(model, "m")), "perplexity")
    got = {k: sorted(((None if v[0] is None else round(v[0], 6),) for v in vs), key=repr) for k, vs in got.items()}
    assert got == wanted(rows, want)


def test_classifier_on_held_out_labels(spark):
    """Documents without a label in training: clean ones stay, noise goes."""
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    told = quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels.filter("doc_id % 3 > 0"))
    held = {r.doc_id: r for r in told.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()}
    good = [r.kept for r in held.values() if r.quality == 1]
    bad = [r.kept for r in held.values() if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.4


def test_model_counts_all_trusted_documents(spark, monkeypatch):
    """More than 20,000 of them train; a document of five bytes adds five runs."""
    docs = spark.range(45_000).selectExpr("id as doc_id", "'en' as lang", "concat('#', lpad(conv(id, 10, 36), 4, '0')) as text")
    labels = spark.range(45_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    counted, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda counts: counted.append(counts.selectExpr("sum(c)").first()[0]) or train(counts))
    quality.classify(docs, labels)
    n = labels.filter("pmod(xxhash64(doc_id, 'fold'), 2) = 0").count()
    assert n > 20_000 and counted == [5 * n]


def test_threshold_is_the_held_out_quantile(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    told = quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels, quantile=0.5, slack=0.0).collect()
    # a perplexity that a document has, not a multiple of one
    assert {r.threshold for r in told if r.threshold is not None} <= {r.perplexity for r in told}
    held_out = {r.doc_id for r in quality.trusted_ids(labels).filter("pmod(xxhash64(doc_id, 'fold'), 2) = 1").collect()}
    assert 0.45 <= np.mean([r.kept for r in told if r.doc_id in held_out]) <= 0.55


def test_classifier_keeps_little_junk(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    told = quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels.filter("doc_id % 3 > 0"))
    held = told.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("quality", "kept").collect()
    assert np.mean([r.kept for r in held if r.quality == 1]) >= 0.99 and np.mean([r.kept for r in held if r.quality == 0]) <= 0.1


def test_classifier_without_labels(spark, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [r for r in rows_of() if r[0] != 12]
    got = quality.classify(texts(rows), labels).collect()
    assert len(got) == len(rows) and all(r.kept == (r.perplexity is not None) for r in got)
    assert quality.classify(texts([]), labels).count() == 0


# 5 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 511, 4096, 4097])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    docs = np.split(np.minimum(rng.zipf(1.4, n), 49407), sorted(rng.integers(0, n + 1, 3)))
    (frame,) = token_file.write_frames([([5, None, 7, 8], docs)], 49408, block=512)
    ((index, ids),) = token_file.read_frames([frame])
    assert list(index["n"]) == [len(d) for d in docs] and list(index["has"]) == [1, 0, 1, 1]
    assert np.array_equal(ids, np.concatenate(docs))
    if n > 1:
        damaged = bytearray(frame)
        damaged[-3] ^= 1
        with pytest.raises(ValueError):
            token_file.read_frames([bytes(damaged)])


def test_repeated_ids_take_little_room():
    ids = np.tile(np.arange(50) + 1000, 80)
    (frame,) = token_file.write_frames([([1], [ids])], 49408)
    assert len(frame) < len(ids) * 0.6


def test_ids_of_text_take_less_room_than_a_general_compressor_needs():
    """Against zstd over the plain 16-bit ids of all texts at once, and in blocks as independent as ours."""
    import pyarrow.parquet as pq
    import zstandard

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, _ = encoder.encode(table.column("text").combine_chunks())
    own = sum(map(len, token_file.write_frames([([1], [part]) for part in np.array_split(ids, 2)], 49408)))
    plain, press = ids.astype("<u2").tobytes(), zstandard.ZstdCompressor(level=3)
    assert own < 0.95 * len(press.compress(plain))
    step = 2 * token_file.BLOCK
    assert own < 0.8 * sum(len(press.compress(plain[at : at + step])) for at in range(0, len(plain), step))
    with pytest.raises(ValueError):
        token_file.write_frames([([1], [ids[:5]])], 49408, block=1 << 20)


def test_token_frames_coded_together_fit_beside_a_tokenizer():
    """What a worker holds while it codes as many ids as go together: two workers share an executor of 3000 MB with its heap."""
    rng = np.random.default_rng(6)
    frames = [([k], [np.minimum(rng.zipf(1.3, token_output.FRAME_IDS), 49407).astype(np.int32)]) for k in range(2)]
    tracemalloc.start()
    try:
        written = token_file.write_frames(frames, 49408)
        writing = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        told = token_file.read_frames(written)
        reading = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert all((ids == docs[0]).all() for (_, ids), (_, docs) in zip(told, frames))
    share = token_output.TOGETHER_IDS / (2 * token_output.FRAME_IDS)
    assert writing * share < 250e6 and reading * share < 250e6


def test_token_output(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = rows_of()
    folder = token_output.write_token_files(texts(rows), path, 2, 49408)
    got = token_output.read_token_files(spark, folder).collect()
    tok = Tokenizer.from_file(path)
    want = [[*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    values = [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    assert as_lists(token_output.read_token_files(spark, folder), "n_tokens", "ids_crc32") == wanted(rows, values)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_output.read_token_files(spark, token_output.write_token_files(texts([]), path, 2, 49408)).count() == 0


# 6 --------------------------------------------------------------------------------------------------


def repeats_removed(rows, width):
    data = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [512, 2])
def test_suffix_dedup(spark, texts, most, monkeypatch):
    rows = rows_of()
    if most == 2:  # a small window and collections that are dealt anew; a letter 70,000 times would be dealt anew too often for a test
        rows = [r for r in rows if r[0] != 12]
        width, symbol = 40, 5
        monkeypatch.setattr(suffix_dedup, "LEVELS", (7, 2, 1))
    else:
        width, symbol = 400, 50
    got = as_lists(suffix_dedup.drop_repeats(texts(rows), width, symbol, most), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == wanted(rows, repeats_removed(rows, width))


def test_suffix_dedup_of_very_long_texts(spark, texts):
    """Two texts of 3.5 MB, searched in pieces, that share a passage over the pieces' edges; a copy of it in a short one."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    a, b = (rng.choice(letters, 3_500_000).tobytes().decode() for _ in range(2))
    shared = rng.choice(letters, 5000).tobytes().decode()
    cut = (1 << 20) - 2000
    a, b = a[:cut] + shared + a[cut:], b[:777] + shared + b[777:]
    rows = [(1, a, "en", "s", 0), (2, b, "en", "s", 0), (3, "x" + shared[1000:2000] + "y", "en", "s", 0), (4, "short", "en", "s", 0)]
    got = as_lists(suffix_dedup.drop_repeats(texts(rows), rest=False), "n_bytes", "n_removed", "n_spans")
    assert got == {1: [(len(a), 5000, 1)], 2: [(len(b), 5000, 1)], 3: [(1002, 1000, 1)], 4: [(5, 0, 0)]}


def test_suffix_dedup_by_words(spark, texts):
    """Runs of fewer words than asked for stay, those of as many go."""
    rng = np.random.default_rng(5)
    short, long = prose(rng, 45), prose(rng, 55)
    rows = [(k, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "en", "s", 0) for k, passage in enumerate([short, short, long, long])]
    out = {r.doc_id: r.rest for r in suffix_dedup.drop_repeats(texts(rows), 100, 50, as_text=True, least_words=50).collect()}
    assert out[0] == rows[0][1] and out[1] == rows[1][1]
    assert long[10:-10] not in out[2] + out[3] and 57 <= len(out[2].split()) <= 62


@pytest.mark.parametrize("on_disk", [True, False])
def test_repeated_windows_in_one_transform(on_disk):
    """Strings of one kind, multiplicities, and repeats within a string are all told by the transform."""
    rng = np.random.default_rng(6)
    make = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    once, often, inner, tail = make(60), make(50), make(44), make(30)
    parts = [once, often, inner + inner, tail + once[:45]]
    windows, n = np.array([len(p) - 39 for p in parts]), np.array([1, 3, 1, 1])
    seen = collections.Counter()
    for p, times, w in zip(parts, n, windows):
        for i in range(w):
            seen[p[i : i + 40]] += times
    want = {(k, i) for k, p in enumerate(parts) for i in range(windows[k]) if seen[p[i : i + 40]] > 1}
    k, a, b = suffix_dedup.repeated_windows(parts, windows, n, 40, 5, on_disk)
    assert {(x, i) for x, y, z in zip(k.tolist(), a.tolist(), b.tolist()) for i in range(y, z)} == want


def test_suffix_dedup_without_rows(spark, texts):
    assert suffix_dedup.drop_repeats(texts([])).count() == 0


def test_suffix_dedup_carries_columns(spark, texts):
    rows = rows_of()[:9]
    out = suffix_dedup.drop_repeats(texts(rows), as_text=True, carry=("lang", "source"))
    assert {(r.doc_id, r.lang, r.source) for r in out.collect()} == {(r[0], r[2], r[3]) for r in rows}


@pytest.mark.parametrize("seed", range(20))
def test_transform_by_columns(seed, tmp_path):
    rng = np.random.default_rng(seed)
    strings = [list(rng.integers(1, rng.integers(2, 5), rng.integers(0, 12))) for _ in range(rng.integers(1, 8))]
    strings += [strings[0][:]] * (seed % 3)
    cuts, text = np.cumsum([0] + [len(s) for s in strings]), np.array(sum(strings, []), np.int64)
    got = bwt.build(text, cuts, 5, on_disk=seed % 2 == 1)
    want = sorted(tuple(s[k:]) for s in strings for k in range(len(s) + 1))
    owner = [int(np.searchsorted(cuts, n, "right")) - 1 if f else None for n, f in zip(got["name"], got["key"] >> 32)]
    suffixes = [() if o is None else tuple(text[n : cuts[o + 1]]) for n, o in zip(got["name"], owner)]
    assert suffixes == want
    shared = [0] + [next(k for k in range(6) if k == 5 or k >= min(len(a), len(b)) or a[k] != b[k]) for a, b in zip(want, want[1:])]
    assert shared == list(got["lcp"])
    for n, o, before in zip(got["name"], owner, got["bwt"]):
        assert o is None or before == (text[n - 1] if n > cuts[o] else 0)


# 8 --------------------------------------------------------------------------------------------------


def test_substring(spark, texts):
    rows = rows_of()
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            if r[0] is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, r[0]), r[0])
    want = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[i : i + 50])] < r[0]:
                gone[i : i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert as_lists(substring.drop_earlier_windows(texts(rows)), "n_words", "n_removed", "kept_sha256") == wanted(rows, want)
    assert substring.drop_earlier_windows(texts([])).count() == 0


# 10 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (300, 40), (64, 16)])
def test_bpe(spark, texts, chunk, overlap):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [*rows_of(), (20, "  \n\n " * 800, "en", "s", 0), (21, "don't  \n" * 400, "en", "s", 0)]
    if chunk == 64:
        rows = [r for r in rows if r[0] != 12]
    encoded = bpe.encode_bpe(texts(rows), path, pattern, chunk, overlap)
    decoded = bpe.decode_bpe(encoded, path)
    want = []
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), bytearray((r[1] or "").encode())))
    assert as_lists(decoded, "n_tokens", "ids_sha256", "decoded") == wanted(rows, want)
    at_once = bpe.encode_bpe(texts(rows), path, pattern, chunk, overlap, then=bpe.decoder(path))
    assert as_lists(at_once, "n_tokens", "ids_sha256", "decoded") == wanted(rows, want)
    assert bpe.encode_bpe(texts([]), path, pattern).count() == 0
