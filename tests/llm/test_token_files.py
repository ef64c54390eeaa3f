import random
import zlib

import numpy as np
import pytest

from cohort_risk.llm import common as C
from cohort_risk.llm import token_files as TF
from cohort_risk.llm import tokenize as TK

from .helpers import clashing, docs

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "it's, don't 'tis ,'def x1,y", "<|endoftext|> a<|startoftext|>", "a\x1cb  c\n\n d \t", "é, İ, a̸ ≮b ΣΑΣ ẞ", "x" * 300, "日本語 テスト。", "1٣²", "\u3000a\u2028b"]


def plain(name, texts, special_as_text=False):
    """The library's own ids, with the file as it is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(C.tokenizer_path(name))
    if special_as_text:
        t.encode_special_tokens = True
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("name", FILES)
def test_chunked_encoding_is_the_tokenizers(name, special_as_text):
    r = random.Random(3)
    alphabet = "ab é'’,.!-* \n\t  \x1c1٣İßΣ<|endoftext|>е́ ́ 's 'll  "
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    special = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " <|endoftext|>", "<|endoftext|", "a", " b,", "\n", "é", "'s"]
    texts += ["".join(r.choice(special) for _ in range(r.randint(1, 8))) for _ in range(3000)]
    assert TK.Encoder(C.tokenizer_path(name), special_as_text).encode(texts) == plain(name, texts, special_as_text)


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, "repeated id"), (50, None), (None, "null id"), (40, "word " * 30_000), (41, "after"), (42, "after")]


def test_written_files_read_back(spark):
    folder = C.work_path(spark, "test-tokens")
    manifest = TF.write_token_files(clashing(docs(spark, ROWS)), folder, C.tokenizer_path(FILES[0]), 2, frame_ids=1000)
    rows = TF.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    ids = plain(FILES[0], [t or "" for _, t in ROWS])
    end = np.array([2], "<u4").tobytes()
    expected = sorted((-1 if i is None else i, zlib.crc32(x + end), len(x) // 4 + 1) for (i, _), x in zip(ROWS, ids, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in rows) == expected
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    start = 0
    for r in rows:
        assert r.start == start and len(r.ids) == r.n_tokens and r.ids[-1] == 2
        start += r.n_tokens
    assert start == sum(m["n_ids"] for m in manifest)
    # one document of a shard opens only the frames that hold it
    for m in manifest:
        index = TF.read_index(C.filesystem(folder)[0], f"{C.filesystem(folder)[1]}/{m['name']}.docs")
        last = int(index["doc_id"][-1])
        found, opened = TF.read_documents(folder, m["name"], [last])
        assert opened <= -(-int(index["n_tokens"][-1]) // 1000) + 1
        assert zlib.crc32(found[last].tobytes()) in {r.ids_crc32 for r in rows if r.doc_id == last}


def test_damage_is_noticed(spark):
    folder = C.work_path(spark, "test-damage")
    TF.write_token_files(docs(spark, [(1, "some words here " * 50)]), folder, C.tokenizer_path(FILES[0]), 2, frame_ids=16)
    _, path = C.filesystem(folder)
    name = TF.read_manifest(folder)[0]["name"]
    whole = open(f"{path}/{name}.ids", "rb").read()
    with open(f"{path}/{name}.ids", "wb") as f:
        f.write(whole[:20] + bytes([whole[20] ^ 255]) + whole[21:])
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or a wrong checksum
        TF.read_documents(folder, name, [1])
    with open(f"{path}/{name}.ids", "wb") as f:
        f.write(whole[:-1])
    with pytest.raises(ValueError, match="seek table"):
        TF.read_documents(folder, name, [1])


def test_empty_table(spark):
    folder = C.work_path(spark, "test-empty")
    assert TF.write_token_files(docs(spark, []), folder, C.tokenizer_path(FILES[0]), 2) == []
    assert TF.read_token_files(spark, folder).count() == 0


def test_equal_rows_spread_over_shards(spark):
    rows = spark.range(0, 3000, 1, 16).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id + 100 END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same row' ELSE 'another row ' || id END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = TF.write_token_files(rows, C.work_path(spark, "test-equal"), C.tokenizer_path(FILES[0]), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(m["n_docs"] for m in manifest)
    assert sum(sizes) == 3000 and sizes[-1] < 900  # 1,000 rows are equal
