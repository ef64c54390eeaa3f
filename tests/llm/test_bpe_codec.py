import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from cohort_risk.llm import bpe_codec as BC
from cohort_risk.llm import common as C

from .helpers import clashing, docs

RANKS = C.tokenizer_path("byte_bpe_multi_50k.tiktoken")


def plain():
    return tiktoken.Encoding("whole", pat_str=BC.default_pattern(), mergeable_ranks=BC.load_ranks(RANKS), special_tokens={})


def fuzz(n, longest, seed=5):
    r = random.Random(seed)
    alphabet = "ab é'’,.!-* \n\t  \x1c\x85 123٣²İßΣ日本語е́'s 'll 're 've  　"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


ODD = [
    None, "", " ", "\n\n\n", "a" * 500, " " * 500, "<|endoftext|>", "it's we'll they've 're " * 40, "x" + "\n" * 300 + "y" * 300 + " z",
    "don't\n\n\n  stop" * 30, "日本語 テスト。" * 40, "1٣²" * 200, "'" * 200 + "ll" * 100, "é " * 100, "word " * 200,
]


@pytest.mark.parametrize("chunk, overlap", [(16, 8), (50, 50), (64, 3)])
def test_chunked_ids_are_those_of_whole_texts(spark, chunk, overlap):
    texts = ODD + fuzz(400, 300)
    rows = docs(spark, [(i, t) for i, t in enumerate(texts)])
    got = BC.encode(rows, RANKS, keep=["doc_id"], chunk=chunk, overlap=overlap)
    back = {r.doc_id: (r.ids, bytes(r.bytes)) for r in BC.decode(got, RANKS).collect()}
    whole = plain()
    assert len(back) == len(texts)
    for i, t in enumerate(texts):
        assert back[i] == (whole.encode_ordinary(t or ""), (t or "").encode()), repr(t)


def test_merging_repeats_until_neighbours_meet(spark):
    # a pre-token that reaches over many chunks, white space over several, then ordinary words
    texts = ["ab " * 20 + "c" * 400 + " " * 200 + "def " * 50, "x" * 1000, " " * 1000]
    got = BC.encode(docs(spark, list(enumerate(texts))), RANKS, chunk=20, overlap=5).collect()
    assert {r.doc_id: r.ids for r in got} == {i: plain().encode_ordinary(t) for i, t in enumerate(texts)}


def test_long_texts_are_cut_and_spread(spark):
    text = "some words, and more of them. " * 2000
    long = docs(spark, [(1, text)]).select(F.struct("doc_id").alias("kept"), F.col("text").alias("piece"), F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"))
    rows = [r for b in [long.toArrow().combine_chunks().to_batches()] for r in _cut_rows(b)]
    assert [r["start"] for r in rows] == list(range(0, 60_000 - 100, 1000))
    assert all(len(r["piece"]) == 1100 for r in rows[:-1]) and [r["kept"] is None for r in rows] == [False] + [True] * (len(rows) - 1)


def _cut_rows(batches):
    from unittest import mock

    with mock.patch.object(BC, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        return [r for out in BC._cut(1000, 100)(batches) for r in out.to_pylist()]


def test_repeated_rows_null_ids_and_clashing_columns_stay(spark):
    text = "more than one chunk of text " * 10
    rows = clashing(docs(spark, [(1, text), (1, text), (None, text), (2, None), (None, None)])).withColumn("ids", F.lit("own")).withColumn("start", F.lit(1))
    got = BC.encode(rows, RANKS, chunk=32, overlap=16)
    assert sorted(got.columns) == sorted(rows.columns)
    found = got.collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in found) == sorted((i or 0, len(plain().encode_ordinary(t or ""))) for i, t in [(1, text), (1, text), (None, text), (2, None), (None, None)])
    assert {(r.score, r.start) for r in found} == {("own", 1)}


def test_empty_table(spark):
    got = BC.decode(BC.encode(docs(spark, []), RANKS), RANKS)
    assert got.columns == ["doc_id", "text", "ids", "bytes"] and got.count() == 0


def test_decoding_concatenates_bytes(spark):
    ids = spark.createDataFrame([(1, [0, 1, 2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    token = {i: t for t, i in BC.load_ranks(RANKS).items()}
    got = {r.doc_id: r.bytes and bytes(r.bytes) for r in BC.decode(ids, RANKS, keep=["doc_id"]).collect()}
    assert got == {1: token[0] + token[1] + token[2], 2: bytearray(b""), 3: None}
    with pytest.raises(Exception, match="KeyError"):
        BC.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), RANKS).collect()


def test_scans_class_every_character_as_the_encoder_does(spark):
    import regex

    pattern = BC.default_pattern()
    like = BC.stand_ins(pattern)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind in (r"\s", r"\p{L}", r"\p{N}"):
        only = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        encoder = set(only.decode(only.encode_ordinary(every)))
        assert encoder == {c for c in every if regex.match(kind, c.translate(like))}
    odd = "".join(map(chr, list(like)[:: max(1, len(like) // 50)]))
    texts = ["".join(x) for x in zip(*[iter(fuzz(60, 30, seed=8))] * 6)] + [f"a{c}b 1{c} {c}" * 20 for c in odd]
    got = BC.encode(docs(spark, list(enumerate(texts))), RANKS, chunk=12, overlap=6).collect()
    assert {r.doc_id: r.ids for r in got} == {i: plain().encode_ordinary(t) for i, t in enumerate(texts)}


def test_query(spark):
    import hashlib

    from cohort_risk.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    whole = plain()
    expected = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = whole.encode_ordinary(r.text or "")
        expected[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = QUERIES["op13_byte_bpe"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == expected and len(got) == len(expected)


def test_a_part_of_long_texts_is_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    texts = [f"word {i} " * 3000 for i in range(100, 140)]
    whole = plain()
    expected = sum(len(whole.encode_ordinary(t)) for t in texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    coding = BC._encode(RANKS, BC.default_pattern(), ["doc_id", "ids"])
    next(coding([batch.slice(0, 1)]))  # the encoder is loaded
    tracemalloc.start()
    try:
        (coded,) = coding([batch])
        encoding_peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, coded.column("ids").to_pylist())) == expected
    assert encoding_peak < 16 * expected
