"""Held-out accuracy and awkward rows of the two classifiers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_risk.llm import quality_classifier as QC
from cohort_risk.llm import toxicity as TX
from cohort_risk.llm.queries import QUERIES

from .helpers import clashing, docs

SF = "/root/testdata/sf0.1"
LABEL = "doc_id long, quality int, toxic int"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0
    got = rows.filter("held_out").join(labels, "doc_id").select("predicted", "y").collect()
    return np.array([(r.predicted, r.y) for r in got]).T


def test_quality_held_out(spark):
    predicted, y = held_out(spark, "op2_quality_classifier", "quality")
    assert (predicted == y).mean() > 0.98 and predicted[y == 0].mean() < 0.05


def test_toxicity_held_out(spark):
    predicted, y = held_out(spark, "op7_toxicity", "toxic")
    assert (predicted == y).mean() > 0.93 and predicted[y == 0].mean() < 0.02 and predicted[y == 1].mean() > 0.5


ODD = [(1, None), (2, ""), (3, "!!!"), (4, "word " * 50_000), (5, "x"), (5, "x"), (None, "null id"), (6, "été \x00 日本 " * 30), (7, "a" * 200_000)]


def test_quality_odd_rows(spark):
    df = clashing(docs(spark, ODD))
    features = QC.with_features(df)
    assert features.count() == len(ODD)
    bad = QC.statistics("THE!! CAT!! SAT!! " * 30)
    good = QC.statistics("A plain sentence, with other words in it. Another one follows here.")
    rows = [(i, [x + 0.01 * i for x in (good if i % 2 else bad)]) for i in range(1, 41)]
    train = spark.createDataFrame(rows, "doc_id long, features array<double>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 41)] + [(1, None, None), (1, 0, 0), (999, 1, 0), (None, 1, 0)], LABEL)
    model = QC.fit(train, labels)
    out = QC.score(features, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    a, b = QC.log_odds(model, np.array([good, bad]))
    assert a > 0 > b
    assert QC.fit(train, labels.limit(0)) == {"constant": 0.5}
    assert QC.fit(train, labels.filter("quality = 1")) == {"constant": 1.0}
    assert {r.score for r in QC.score(features, {"constant": 0.25}).collect()} == {0.25}
    assert QC.score(QC.with_features(docs(spark, [])), model).count() == 0


def test_quality_model_and_scores_equal_their_definition(spark):
    """Moments, shrunk covariances and log densities from numpy's own on the same rows."""
    r = np.random.default_rng(5)
    d = len(QC.FEATURES)
    mix = r.normal(size=(2, d, d)) / 3
    x = {i: r.normal(size=d) @ mix[int(i % 3 == 0)] + (i % 3 == 0) + 4 for i in range(900)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "doc_id long, features array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(800)], LABEL)
    model = QC.fit(frame, labels)
    one = np.array([x[i] for i in range(800) if i % 3 == 0])
    zero = np.array([x[i] for i in range(800) if i % 3])
    covs = [np.cov(c.T, bias=True) for c in (zero, one)]
    pooled = (len(zero) * covs[0] + len(one) * covs[1]) / 800
    density = []
    for c, cov in zip((zero, one), covs, strict=True):
        s = (1 - QC.SHRINK_POOLED) * cov + QC.SHRINK_POOLED * pooled
        s = (1 - QC.SHRINK_DIAGONAL) * s + QC.SHRINK_DIAGONAL * np.diag(s.diagonal()) + QC.RIDGE * np.eye(d)
        inverse, log_det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density.append({i: np.log(len(c) / 800) - 0.5 * ((v - c.mean(0)) @ inverse @ (v - c.mean(0)) + log_det) for i, v in x.items()})
    got = {row.doc_id: row.score for row in QC.score(frame, model).collect()}
    assert got.keys() == x.keys()
    for i, p in got.items():
        assert p == pytest.approx(1 / (1 + np.exp(density[0][i] - density[1][i])), rel=1e-8, abs=1e-12), i


def test_quality_statistics_of_a_small_text():
    """Counted by hand: 8 different words on two lines; "ok!!" is decorated, "$$" a bare symbol."""
    text = "A b b, 12 ok!! $$\nSo b?"
    got = dict(zip(QC.FEATURES, QC.statistics(text), strict=True))
    words = ["A", "b", "b,", "12", "ok!!", "$$", "So", "b?"]

    def share(k, n):
        return np.log(k / n + 0.01)

    want = {
        "log_words": np.log(9), "log_word_length": np.log((sum(map(len, words)) + 1) / 9), "distinct_words": share(0, 8), "repeated_neighbours": share(0, 7),
        "distinct_trigrams": share(0, 6), "upper_letters": share(2, len(text)), "digits": share(2, len(text)), "symbols": share(4, len(text)),
        "decorated_words": share(1, 8), "bare_symbols": share(1, 8), "log_line_words": np.log(5), "distinct_lines": share(0, 2),
        "sentence_marks": share(2, 8), "top_word": share(1, 8),
    }
    assert got == pytest.approx(want)
    repeated = dict(zip(QC.FEATURES, QC.statistics("x y x y x y\nx y x y x y"), strict=True))
    assert repeated["distinct_words"] == pytest.approx(share(10, 12)) and repeated["distinct_trigrams"] == pytest.approx(share(8, 10))
    assert repeated["distinct_lines"] == pytest.approx(share(1, 2)) and repeated["top_word"] == pytest.approx(share(6, 12))


def test_toxicity_odd_rows(spark):
    r = random.Random(6)
    plain = "the quick brown fox jumps over lazy dogs near river banks while many other words are written here about weather farming numbers letters tables printed on paper by machines".split()
    rows = []
    for i in range(400):
        words = [r.choice(plain) for _ in range(60)]
        for _ in range(3 * (i % 4 == 0)):
            words.insert(r.randrange(60), r.choice(["grumblefrotz", "snarkwort"]))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1, 1, None), (None, 1, 1), (5000, 1, 1)], LABEL)
    model = TX.fit(clashing(docs(spark, rows)), labels)
    scored = TX.score(clashing(docs(spark, [(900, "a grumblefrotz snarkwort, that person over the lazy dog"), (901, " ".join(plain))] + ODD)), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[900] > 0.5 > got[901] and all(0 <= s <= 1 for s in got.values()) and scored.count() == len(ODD) + 2
    assert TX.fit(docs(spark, rows), labels.filter("toxic = 0")) == {"constant": 0.0}
    assert TX.fit(docs(spark, []), labels) == pytest.approx({"constant": 101 / 401})
    assert TX.score(docs(spark, []), model).count() == 0


def test_toxicity_held_out_in_every_language(spark):
    docs_, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op7_toxicity"](spark, SF).filter("held_out").join(labels.filter("toxic = 1"), "doc_id").join(docs_.select("doc_id", "lang"), "doc_id")
    found = {r.lang: (r.found, r.n) for r in rows.groupBy("lang").agg(F.sum("predicted").alias("found"), F.count("*").alias("n")).collect()}
    assert found.keys() == {"de", "en", "es", "fr"}
    assert all(k >= 0.25 * n for k, n in found.values()), found
    assert sum(k for k, _ in found.values()) >= 0.68 * sum(n for _, n in found.values()), found


def test_windows_cover_the_whole_text():
    text = "Some WORDS, ünd more! " * 3000
    assert b"".join(TX.windows(text)).split() == " ".join(TX._WORDS.findall(text.lower())).encode().split()
