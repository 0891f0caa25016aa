import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytewright.llm import minhash
from bytewright.llm.components import connected_components
from bytewright.llm.embeddings import CollisionParams, embedding_duplicates
from bytewright.llm.minhash import near_duplicates
from bytewright.llm.passages import PassageParams, passage_digests, remove_repeated_passages, segments, words_of
from bytewright.llm.textkit import shingles, slices, text_buffers, word_hashes, word_spans

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = ["", " a  b\tc\n", "x", None, "é ß z \x1c\x1f", "\x0b\x0cq\x85r" * 50, "long " * 3000]
    column = pa.array(texts)
    data, offsets = text_buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    for k, t in enumerate(texts):
        got = [data[s:e].tobytes().decode() for s, e in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])]
        assert got == WORDS.findall(t or "")
    hashes = word_hashes(data, starts, ends)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert len(set(hashes.tolist())) == len(set(words))
    assert [j - i for i, j in slices(column, 1)] == [1, 1, 1, 1, 1, 1, 1] or sum(j - i for i, j in slices(column, 1)) == 7


def test_shingles_of_short_rows():
    import pyarrow as pa

    column = pa.array(["a b c d e f", "a b", "", "A B", "x x x x x x x x"])
    data, offsets = text_buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    grams, at = shingles(word_hashes(data, starts, ends, lower=True), bounds)
    assert np.diff(at).tolist() == [2, 1, 0, 1, 1]
    assert grams[at[1]] == grams[at[3]]


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(200, 201), (201, 200)], [(5, 9), (9, 7), (7, 3), (100, 3), (50, 51)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)


def corpus(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    docs = [(k, " ".join(word() for _ in range(rnd.randrange(1, 160)))) for k in range(60)]
    bases = [t for _, t in docs if len(t.split()) > 60][:4]
    for base in bases:
        for _ in range(14):
            words = base.split()
            for _ in range(rnd.randrange(0, 6)):
                words[rnd.randrange(len(words))] = rnd.choice([word(), "the"])
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + k, t) for k, t in enumerate([None, "", " \t\n", "one", "ONE", "a b c d", "A  b\tc d", bases[0], bases[0].upper(), "z " * 30_000])]
    return docs


def brute_sets(docs):
    out = []
    for k, t in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORDS.findall(t or "")]
        out.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus()
    sets = brute_sets(docs)
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = brute_components([k for k, _ in sets], edges)
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, component_id int, digest int")
    got = {r.doc_id: r for r in near_duplicates(frame).collect()}
    assert len(got) == len(docs) and any(a != b for a, b in want.items())
    for k, s in sets:
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(s), want[k], want[k] == k)


def test_prefix_join_finds_what_stars_leave(spark, monkeypatch):
    """Without stars' links everything is left to the exact join."""
    docs = corpus(9)
    sets = brute_sets(docs)
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    want = brute_components([k for k, _ in sets], edges)
    real = minhash._verified
    calls = []

    def none_first(pairs, full, percent):
        calls.append(1)
        return real(pairs.where("false") if len(calls) == 1 else pairs, full, percent)

    monkeypatch.setattr(minhash, "_verified", none_first)
    seen = minhash.settle

    def no_star(df, tag, **kw):
        return seen(df.where("false") if tag == "dup-star" else df, tag, **kw)

    monkeypatch.setattr(minhash, "settle", no_star)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (2, 2, True), (2, 2, True)], key=repr)


def brute_links(rows, cosine=0.98):
    links = []
    good = []
    for k, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.append((k, np.array(v, float), label))
    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[:i]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    return links


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        for _ in range(40):
            rows.append((len(rows), [float(np.float32(x)) for x in r.standard_normal(32)], label))
    for label in (0, 1, 1):
        center = r.standard_normal(32)
        for _ in range(30):
            rows.append((len(rows), [float(np.float32(x)) for x in center + 0.13 * r.standard_normal(32)], label))
    rows += [(len(rows) + k, v, 1) for k, v in enumerate([rows[90][1], rows[90][1], None, [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [], [2.0] * 5, [1e300, 1e300, 0.0], [3e300, 3e300, 0.0]])]
    rows.append((len(rows), rows[90][1], None))
    links = brute_links([x for x in rows if x[1] is None or len(x[1]) != 3])
    big = [k for k, v, _ in rows if v and len(v) == 3]
    links.append(tuple(big))
    want = brute_components([k for k, _, _ in rows], links)
    counts = {k: sum(k in e for e in links) for k, _, _ in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for params in (CollisionParams(), CollisionParams(block_rows=7)):
        got = {x.vec_id: x for x in embedding_duplicates(frame, params).collect()}
        assert {k: (x.n_links, x.component_id, x.kept) for k, x in got.items()} == {k: (counts[k], want[k], want[k] == k) for k in counts}
    assert embedding_duplicates(frame.where("false")).count() == 0


def test_embeddings_of_odd_tables(spark):
    near = [[1.0, 0.0, 1e-3 * k] for k in range(6)]
    rows = [(1, near[0], "a"), (1, near[0], "a"), (1, [0.0, 1.0, 0.0], "a"), (2, near[1], "a"), (3, [0.0, 1.0, 1e-3], "a"), (3, near[2], "b"), (None, near[3], "a"), (4, [-0.0, 1.0, 0.0], "a"), (5, near[5], None)]
    frame = spark.createDataFrame([(*r, 7, 8, "c") for r in rows], "vec_id long, embedding array<double>, label string, rep int, keys int, digest string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 0, 3, True), (None, 0, None, False), (4, 2, 1, False), (5, 0, 5, True)]
    assert got == sorted(want, key=repr)


def test_cosine_exactly_at_the_threshold_links(spark):
    from bytewright.llm.embeddings import _unit

    pair = [[3.0, 4.0], [4.0, 3.0]]
    at = float(np.einsum("ij,ij->i", _unit(np.array(pair[:1])), _unit(np.array(pair[1:])))[0])
    frame = spark.createDataFrame([(k, v, 0) for k, v in enumerate(pair)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in embedding_duplicates(frame, CollisionParams(cosine=at)).collect()] == [1, 1]
    assert [r.n_links for r in embedding_duplicates(frame, CollisionParams(cosine=at + 1e-12)).collect()] == [0, 0]


def test_required_count_follows_from_the_miss():
    p = CollisionParams()
    q = math.erf(p.window / math.sqrt(2))
    tail = lambda k: sum(math.comb(p.projections, i) * q**i * (1 - q) ** (p.projections - i) for i in range(k))
    assert tail(p.required) <= p.miss < tail(p.required + 1)
    assert p.layout(10**9)[0] > p.layout(10**4)[0]


def brute_passages(docs, window):
    owner = {}
    words = {k: WORDS.findall(t or "") for k, t in docs}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            owner.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("params", [PassageParams(), PassageParams(window=12, phrase=4, shard_bytes=2000)])
def test_passages_equal_brute_force(spark, params):
    import hashlib

    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "bb", "é", "c,", "D"]) + str(rnd.randrange(300))
    shared = [[word() for _ in range(n)] for n in (params.window, params.window + 1, 3 * params.window, params.window - 1)]
    docs = []
    for k in range(50):
        parts = [[word() for _ in range(rnd.randrange(0, 80))]]
        for s in rnd.sample(shared, rnd.randrange(0, 3)):
            parts += [s, [word() for _ in range(rnd.randrange(0, 20))]]
        docs.append((1000 - k * 7, rnd.choice([" ", "\n", "  \t"]).join(w for p in parts for w in p)))
    docs += [(2000, docs[3][1]), (2001, None), (2002, ""), (2003, "w " * 4000), (2004, "w " * 3000), (2005, " " + docs[5][1] + "\n")]
    want = brute_passages(docs, params.window)
    result = remove_repeated_passages(spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, tag int"), params)
    got = {r.doc_id: r for r in passage_digests(result).collect()}
    assert len(got) == len(docs) and sum(v[1] > 0 for v in want.values()) > 10
    for k, (n, gone, kept) in want.items():
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), k
    copied = {r.doc_id for r in result.whole.where("copied").collect()}
    assert {r.doc_id: r.text for r in result.cleaned.collect()} == {k: v[2] for k, v in want.items() if v[1] and k not in copied}
    assert copied and all(not want[k][2] for k in copied)


def test_passages_of_odd_tables(spark):
    assert passage_digests(remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    text = " ".join(str(k) for k in range(60))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (2, text + " x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in passage_digests(remove_repeated_passages(rows)).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, 60), (2, 60)], key=repr)


def test_windows_fall_into_segments_of_one_anchor():
    import pyarrow as pa

    rnd = random.Random(1)
    p = PassageParams(window=20, phrase=5)
    texts = [" ".join(rnd.choice("abcd") * rnd.randrange(1, 4) for _ in range(n)) for n in (10, 20, 270, 0, 200, 20)]
    words = words_of(pa.array([*texts, texts[2]]))
    at, count, anchor, hashes = segments(words, p)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(at, count)])
    want = [w for lo, hi in zip(words.bounds, words.bounds[1:]) for w in range(lo, hi - p.window + 1)]
    assert starts.tolist() == want
    assert ((anchor >= at + count - 1) & (anchor + p.phrase <= at + p.window)).all()
    found = {}
    for a, n, place, h in zip(at.tolist(), count.tolist(), anchor.tolist(), hashes.tolist()):
        for w in range(a, a + n):
            assert found.setdefault(words.text(w, w + p.window), (place - w, h)) == (place - w, h)


def twins(rounds=10):
    """Two words of 2 ** rounds letters that any polynomial hash modulo 2 ** 64 confuses from 1,024 letters on."""
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_words_of_one_polynomial_hash_differ(spark):
    a, b = twins()
    fill = lambda w: " ".join([w] * 60)
    rows = [(1, fill(a)), (2, fill(b)), (3, " ".join([a, b] * 40)), (4, " ".join([b, a] * 40)), (5, fill(a) + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = brute_sets(rows)
    links = [(x, y) for i, (x, s) in enumerate(sets) for y, t in sets[:i] if 100 * len(s & t) >= 85 * len(s | t)]
    want = brute_components([k for k, _ in rows], links)
    got = {r.doc_id: r for r in near_duplicates(frame).collect()}
    assert {k: r.component_id for k, r in got.items()} == want and {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets}
    gone = brute_passages(rows, 50)
    assert {r.doc_id: r.n_removed for r in passage_digests(remove_repeated_passages(frame)).collect()} == {k: v[1] for k, v in gone.items()}
    assert gone[2][1] == 0 and gone[5][1] == 60


def test_near_duplicates_of_ids_with_several_texts(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (9, text(2)), (7, text(3)), (7, text(4)), (3, text(4)), (8, text(3) + " x")]
    got = {(r.doc_id, r.tag): r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sorted((r.doc_id, r.component_id, r.kept) for r in got.values())
    assert found == [(1, 1, True), (3, 3, True), (5, 1, False), (5, 5, True), (7, 3, False), (7, 7, True), (8, 7, False), (9, 5, False)]


def test_templates_below_the_threshold_meet_in_no_join(spark, monkeypatch):
    """400 documents share 80 % of their words; none is similar enough, and no pair is compared."""
    common = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(common + [f"d{k}x{i}" for i in range(100)])) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counted = []
    real = minhash._prefix_pairs
    monkeypatch.setattr(minhash, "_prefix_pairs", lambda *a: counted.append(real(*a)) or counted[-1])
    seen = minhash.settle
    sizes = {}

    def watch(df, tag, **kw):
        out = seen(df, tag, **kw)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(minhash, "settle", watch)
    assert near_duplicates(frame, minhash.NearDupParams(percent=70)).where("kept").count() == 400
    assert sizes["dup-star"] + sizes["dup-more"] <= 400 and sizes.get("dup-front", 0) <= 400 * 500


def scratch(spark):
    import os

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    return {x.rsplit("-", 1)[0] for x in os.listdir(f"{root}/bytewright")} if os.path.isdir(f"{root}/bytewright") else set()


def test_operators_delete_what_they_no_longer_read(spark):
    import shutil

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    shutil.rmtree(f"{root}/bytewright", ignore_errors=True)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert near_duplicates(docs).count() and scratch(spark) == {"dup-meta", "dup-found"}
    shutil.rmtree(f"{root}/bytewright")
    assert passage_digests(remove_repeated_passages(docs)).count() and scratch(spark) == {"pas-whole", "pas-cleaned"}
    shutil.rmtree(f"{root}/bytewright")
    vectors = spark.createDataFrame([(k, [1.0, k % 3 * 1e-3], 0) for k in range(20)], "vec_id long, embedding array<double>, label int")
    assert embedding_duplicates(vectors).count() and scratch(spark) == {"emb-rows", "emb-named"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from bytewright.llm.common import scratch_root

    conf = SimpleNamespace(get=lambda *a: None)
    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)
        if fails:
            with pytest.raises(ValueError):
                scratch_root(session)
        else:
            assert scratch_root(session).startswith("file://")


def test_hot_group_of_copies_costs_one_representative(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = near_duplicates(rows)
    assert out.where("kept").count() == 1 and out.where("component_id = 0").count() == 3000
