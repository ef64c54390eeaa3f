"""The pipeline against a brute-force version, stage by stage on each stage's own input."""

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from cohort_risk.llm import common as C
from cohort_risk.llm import queries as Q
from cohort_risk.llm import toxicity as TX
from tests.conftest import SF_SMALL

from .helpers import clashing
from .test_decontamination import words
from .test_line_dedup import brute as brute_lines
from .test_near_duplicates import brute_text
from .test_token_files import plain


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def contaminated(text, windows):
    w = words(text)
    hit = set()
    for p in range(len(w)):
        for size in {len(x) for x in windows}:
            if tuple(w[p : p + size]) in windows:
                hit |= set(range(p, p + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_are_what_they_say(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    start = C.table(spark, SF_SMALL, "documents")
    docs, seen = start, {}
    for name, stage in P.STAGES:
        docs = C.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == start.columns
    given = rows(start)
    model = TX.fit(start, Q.learned_labels(spark, SF_SMALL))
    toxic = {r.doc_id for r in TX.score(start, model, keep=["doc_id"]).collect() if r.score >= 0.5}
    expected = [(i, t) for i, t in given if i not in toxic]
    assert rows(seen["toxicity"]) == expected
    expected = sorted((i, t) for i, _, _, t in brute_lines(expected))
    assert rows(seen["line_dedup"]) == expected
    assert seen["line_dedup"].filter(F.length("text") != F.col("n_chars")).count() == 0
    group = dict(brute_text(expected))
    expected = [(i, t) for i, t in expected if group[i] == i]
    assert rows(seen["near_dedup"]) == expected
    windows = set()
    for r in C.table(spark, SF_SMALL, "benchmark").collect():
        b = words(r.text)
        windows |= {tuple(b[k : k + 13]) for k in range(max(len(b) - 12, 1)) if b}
    expected = [(i, t) for i, t in expected if not contaminated(t, windows)]
    assert rows(seen["decontamination"]) == expected
    ids = {i: np.frombuffer(x, "<u4").tolist() + [0] for (i, _), x in zip(expected, plain("byte_bpe_50k.json", [t for _, t in expected]), strict=True)}
    covered = defaultdict(int)
    for r in sorted(seen["packing"].collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(piece) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}


def test_odd_rows_and_columns_pass(spark, tmp_path):
    for t in ("labels", "benchmark"):
        C.table(spark, SF_SMALL, t).write.parquet(f"{tmp_path}/{t}.parquet")
    odd = [(1, None, None, "s", None), (2, "", None, None, 0), (3, "", None, None, 0), (None, "null id text", "en", "s", 12), (4, "one line here\n" * 3, "en", "s", 42), (4, "one line here\n" * 3, "en", "s", 42)]
    for data in (odd, []):
        start = clashing(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))
        docs = start
        for name, stage in P.STAGES:
            docs = C.written(stage(spark, docs, str(tmp_path)), "test-odd")
            if name != "packing":
                rows_left = len(data) - (bool(data) and name not in ("toxicity", "line_dedup"))  # of two rows with an id one stays
                assert docs.columns == start.columns and docs.count() == rows_left
                assert docs.filter(F.col("score") != "own").count() == 0
        assert docs.agg(F.sum("length")).first()[0] == (docs.filter("offset >= 0").agg(F.sum("length")).first()[0])


def test_labels_of_one_kind_drop_nothing(spark, tmp_path):
    spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    assert P.toxicity(spark, docs, str(tmp_path)).count() == 3
