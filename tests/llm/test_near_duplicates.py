"""MinHash and embedding near-duplicates against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from cohort_risk.llm import components as CC
from cohort_risk.llm import embedding_dedup as ED
from cohort_risk.llm import minhash_dedup as MD

from .helpers import clashing, docs


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (3, 0)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {x.node: x.component for x in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.p}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------- MinHash


def idf_of(rows):
    n = np.zeros(MD.SLOTS)
    for _, t in rows:
        n[np.unique(MD.word_hashes(t) & np.uint64(MD.SLOTS - 1)).astype(int)] += 1
    return np.log1p(len(rows) / (1 + n)) + 0.1


def brute_text(rows):
    idf, u = idf_of(rows), Union()
    w = [(i, MD.shingles(MD.word_hashes(t), idf)) for i, t in rows if i is not None and len(MD.word_hashes(t))]
    for x, (i, a) in enumerate(w):
        for j, b in w[x + 1 :]:
            if i != j and MD.weighted_jaccard(a, b) >= MD.THRESHOLD:
                u.join(i, j)
    return sorted(((i, None if i is None else u.find(i)) for i, _ in rows), key=repr)


def run_text(df):
    out = MD.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in out)
    return sorted(((r.doc_id, r.component_id) for r in out), key=repr)


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(120)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(r.randint(60, 200))] + common
        for _ in range([2, 3, 30, 5, 2, 1][g]):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = word()
            rows.append(" ".join(edited))
    chain = [word() for _ in range(150)]
    for k in range(12):  # each link of the chain is near the next only
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(" ".join(chain))
    rows += ["", None, "!!!", "two words", "Two, WORDS", "one", rows[0], rows[0].upper(), rows[3] + "."]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_minhash_against_brute_force(spark):
    rows = corpus() + [(None, "two words"), (5, "same id, other text entirely made of new words")]
    expected = brute_text(rows)
    assert len({c for _, c in expected}) < len(rows) - 40
    assert run_text(docs(spark, rows)) == expected


def test_minhash_against_words_and_shingles_in_plain_python(spark):
    """Words, shingles, weights and similarity written anew: regular expression, tuples of
    five words, dictionaries."""
    rows = corpus(9) + [(900, "Ünd SO_ it  goes-on, über 12 größe\x00drei"), (901, "ünd so it goes on über 12 größe drei"), (902, "ÜND so it goes on über 12 größe drei")]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for i, t in rows}
    held = collections.Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log1p(len(rows) / (1 + k)) + 0.1 for w, k in held.items()}
    weights = {}
    for i, ws in words.items():
        if ws:
            n = min(5, len(ws))
            times = collections.Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
            weights[i] = {s: c * sum(idf[w] for w in s) / n for s, c in times.items()}
    u = Union()
    for i, a in weights.items():
        for j, b in weights.items():
            if i < j:
                least = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
                if least / (sum(a.values()) + sum(b.values()) - least) >= 0.8:
                    u.join(i, j)
    expected = sorted(((i, u.find(i)) for i in words), key=repr)
    assert dict(expected)[901] == 901 and dict(expected)[902] == 900
    assert run_text(docs(spark, rows)) == expected


def test_links_past_the_first_document_of_a_bucket(spark):
    """Classes of a bucket that its smallest class isn't similar to are still
    compared with each other, block by block."""
    text = {i: f"word{i // 10} " + " ".join(f"t{i // 10}x{k}" for k in range(40)) for i in [0, *range(10, 40)]}
    keys = spark.createDataFrame([(77, 0, i) for i in text], "key long, band int, id long")
    samples = {i: np.concatenate([np.zeros(MD.ROWS, "<u4"), np.full((MD.BANDS - 1) * MD.ROWS, 1 + i // 10, "<u4")]) for i in text}
    classes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in samples.items()], "id long, samples binary")
    component = spark.createDataFrame([(i, 10) for i in range(10, 18)], "node long, component long")
    idf = spark.sparkContext.broadcast(np.ones(MD.SLOTS))
    texts = spark.createDataFrame(list(text.items()), "id long, text string")
    u = Union()
    for r in MD._cross_links(keys, classes, component, texts, idf, MD.THRESHOLD).collect():
        assert r.a // 10 == r.b // 10 and not (10 <= r.a < 18 and 10 <= r.b < 18)
        u.join(r.a, r.b)
    for i in range(11, 18):
        u.join(10, i)
    assert all(u.find(i) == 10 * (i // 10) for i in text)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(MD, "BLOCK", 3)
    test_links_past_the_first_document_of_a_bucket(spark)


def test_sampler_agrees_with_weighted_jaccard():
    r = np.random.default_rng(1)
    key = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    draw = MD.Sampler(2000)
    for share in (0.5, 0.8, 0.9):
        n = int(len(key) * share)
        w = r.uniform(0.5, 5, len(key))
        a, b = (key, w), (key[:n], w[:n] * 1.1)
        j = MD.weighted_jaccard(a, b)
        agreed = (draw(*a) == draw(*b)).mean()
        assert abs(agreed - j) < 0.05
    assert (draw(key, w) == draw(key, w, step=100)).all()


def test_minhash_edges(spark):
    assert MD.near_duplicates(docs(spark, [])).count() == 0
    df = clashing(docs(spark, [(1, "some words of a text here"), (2, "some words of a text here"), (2, None)]))
    out = MD.near_duplicates(df)
    assert sorted(out.columns) == sorted(df.columns) and out.filter("doc_id = 2 AND component_id = 1").count() == 2


# ---------------------------------------------------------------- embeddings

VEC = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows):
    u, links = Union(), {}
    v = [(i, np.array(x, float) if x is not None and None not in x else np.zeros(0), y) for i, x, y in rows]
    ok = [len(x) > 0 and np.isfinite(x).all() and x.any() and y is not None and i is not None for i, x, y in v]
    for a, (i, x, y) in enumerate(v):
        links.setdefault(i, 0)
        for b, (j, z, q) in enumerate(v):
            if a != b and ok[a] and ok[b] and y == q and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= ED.THRESHOLD - 1e-12:
                links[i] += 1
                u.join(i, j)
    return {i: (n, None if i is None else u.find(i)) for i, n in links.items()}


def vectors(n=160, d=24, seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 8, d))
    rows = []
    for i in range(n):
        x = base[i % len(base)] + r.standard_normal(d) * 0.12 * (i % 3)
        rows.append((i, [float(t) for t in x.astype(np.float32)], i % 2))
    rows += [(1000 + i, rows[8][1], 0) for i in range(40)]  # copies
    rows += [(2000, None, 0), (2001, [0.0] * d, 0), (2002, [float("nan")] + [1.0] * (d - 1), 0), (2003, [float("inf")] * d, 0), (2004, rows[0][1], None), (2005, [None] * d, 0)]
    rows += [(2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (None, rows[0][1], 0), (2008, [], 0), (2009, [3.0], 1), (2010, [5.0], 1), (2011, [-5.0], 1), (3, rows[3][1], 1)]
    return rows


@pytest.mark.parametrize("block,small", [(1024, 16), (8, 4)])
def test_embeddings_against_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(ED, "BLOCK", block)
    monkeypatch.setattr(ED, "SMALL", small)
    rows = vectors()
    expected = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ED.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert got.keys() == expected.keys()
    right = sum(got[i] == expected[i] for i in expected)
    assert all(got[i][0] <= expected[i][0] for i in expected) and right >= 0.97 * len(expected)


def test_embedding_edges(spark):
    assert ED.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    df = clashing(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], VEC))
    out = ED.near_duplicates(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_tables_keep_their_recall():
    for n in (100, 10_000, 10**7):
        bits, tables = ED.plan(n, 64, np.arccos(0.93))
        same = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - same) ** tables >= ED.RECALL


def common_direction(n, d=64, norm=0.8, seed=1):
    """n unit vectors about a mean of length ``norm`` and, for each, one at cosine 0.93 from it."""
    r = np.random.default_rng(seed)
    m = ED.unit(r.standard_normal((1, d)))
    e = r.standard_normal((n, d))
    e = ED.unit(e - (e @ m.T) * m)
    f = r.standard_normal((n, d))
    f -= (f @ m.T) * m
    f = ED.unit(f - (f * e).sum(1, keepdims=True) * e)
    c = (0.93 - norm**2) / (1 - norm**2)
    out = np.sqrt(1 - norm**2)
    return norm * m + out * e, norm * m + out * (c * e + np.sqrt(1 - c * c) * f)


@pytest.mark.parametrize("norm", [0.0, 0.8])
@pytest.mark.parametrize("largest", [1000, 10**5])
def test_recall_and_balance_where_vectors_share_a_direction(largest, norm):
    x, y = common_direction(2000, norm=norm)
    center, angle = ED.viewpoint(x, 0.93)
    bits, tables = ED.plan(largest, 64, angle)
    model = [ED.projection(x, 64, seed) for seed in range(-(-tables // (64 // bits)))]
    a, b = (ED.table_keys(v - center, model, bits, tables) for v in (x, y))
    assert (a == b).any(1).mean() >= 0.99
    ones = np.stack([(a >> i & 1).mean(0) for i in range(bits)])
    assert 0.4 < ones.min() and ones.max() < 0.6  # balanced codes


@pytest.mark.parametrize("norm", [0.0, 0.8])
def test_few_pairs_of_a_large_label_are_compared(norm):
    n = 40_000
    x, _ = common_direction(n, norm=norm)
    sample = x[: ED.FIT_ROWS]
    center, angle = ED.viewpoint(sample, 0.93)
    bits, tables = ED.plan(n, 64, angle)
    model = [ED.projection(sample, 64, seed) for seed in range(-(-tables // (64 // bits)))]
    keys = ED.table_keys(x - center, model, bits, tables)
    compared = sum(int((c * (c - 1) // 2).sum()) for c in (np.unique(keys[:, t], return_counts=True)[1] for t in range(tables)))
    assert compared < 0.02 * n * (n - 1) / 2


def test_a_label_around_its_mean_and_tiny_samples_lose_no_link(spark):
    r = np.random.default_rng(3)
    close = ED.unit(np.eye(8)[0] + 0.02 * r.standard_normal((30, 8)))
    for v in (close, close[:2], close[:1], np.eye(8)[:5]):
        rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
        near = (ED.unit(v) @ ED.unit(v).T >= 0.93).sum(1) - 1
        assert {x.vec_id: x.n_links for x in ED.near_duplicates(rows).collect()} == dict(enumerate(near.tolist()))


@pytest.mark.parametrize("n", [300, 1500])
def test_links_where_vectors_share_a_direction(spark, n):
    v = np.concatenate(common_direction(n, seed=n))
    near = v @ v.T >= 0.9299  # the partners lie on the threshold
    expected = near.sum() - len(v)
    rows = [(i, x, 1) for i, x in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ED.near_duplicates(df, threshold=0.9299, keep=["vec_id"]).collect()
    assert 0.99 * expected <= sum(r.n_links for r in got) <= expected


def test_null_ids_meet_no_join_and_repeated_ids_keep_one_row(spark):
    from cohort_risk.llm import minhash_dedup as MD

    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "other words in this row", 3), (None, "a b c d e f", 4), (None, None, 5), (2, None, 6), (2, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    one = MD.one_row_per_id(df).collect()
    assert sorted((r.doc_id or 0) for r in one) == [0, 0, 1, 2]
    again = MD.one_row_per_id(df.repartition(5)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, again))  # whatever the order of rows
    assert sorted(map(repr, MD.one_row_per_id(df.filter("extra > 3 AND doc_id IS NULL")).collect())) == sorted(map(repr, df.filter("extra > 3 AND doc_id IS NULL").collect()))
    got = MD.near_duplicates(df).collect()
    assert sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 2 and len(got) == len(rows)


def test_pairs_under_the_estimate_are_as_rare_as_stated():
    from math import comb

    from cohort_risk.llm import minhash_dedup as MD

    n = MD.BANDS * MD.ROWS
    lost = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(MD.MIN_MATCHES))
    no_band = (1 - 0.8**MD.ROWS) ** MD.BANDS
    assert lost < 2e-5 and lost + no_band < 0.002


def test_fewer_vectors_than_dimensions_share_keys():
    r = np.random.default_rng(11)
    met = []
    for _ in range(60):
        x = ED.unit(np.eye(8)[0] + 0.02 * r.standard_normal((2, 8)))
        center, angle = ED.viewpoint(x, 0.93)
        bits, tables = ED.plan(2, 8, angle)
        model = [ED.projection(x, 8, seed) for seed in range(-(-tables // (8 // bits)))]
        a, b = ED.table_keys(x - center, model, bits, tables)
        met.append((a == b).any())
    assert np.mean(met) >= 0.97
