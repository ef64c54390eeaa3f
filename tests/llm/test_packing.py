import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohort_risk.llm import common as C
from cohort_risk.llm import packing as PK

from .helpers import clashing, docs
from .test_token_files import ODD, plain

PATH = C.tokenizer_path("byte_bpe_50k.json")


def pad(n, size):
    return 0 if n & (n - 1) == 0 else size - n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=25), st.sampled_from([9, 12, 16]))
def test_best_cuts_are_optimal(gaps, size):
    pos, pen = [0], [0]
    for g, p in gaps:
        pos.append(pos[-1] + g)
        pen.append(p)
    best = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + pad(pos[j] - pos[i], size) + pen[j] for i in range(j) if pos[j] - pos[i] <= size)
    cuts = PK.best_cuts(pos, pen, size)
    assert cuts[0] == 0 and cuts[-1] == len(pos) - 1
    assert all(0 < pos[b] - pos[a] <= size for a, b in zip(cuts, cuts[1:], strict=False))
    assert sum(pad(pos[b] - pos[a], size) + pen[b] for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


def check(spark, rows, size=64, **kw):
    got = PK.pack(docs(spark, rows), PATH, 0, size=size, with_ids=True).collect()
    ids = plain("byte_bpe_50k.json", [t or "" for _, t in rows])
    end = np.array([0], "<u4").tobytes()
    whole = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        whole[i].append(x + end)
    pieces, sequences = defaultdict(bytes), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        data = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and len(r.ids) == r.length > 0
        if r.start == 0:
            pieces[r.doc_id, r.sequence_id, r.offset] = b""
            current = (r.doc_id, r.sequence_id, r.offset)
        assert len(pieces[current]) == 4 * r.start
        pieces[current] += data
        sequences[r.sequence_id].append(r)
    assert sorted((repr(k[0]), v) for k, v in pieces.items()) == sorted((repr(i), x) for i, xs in whole.items() for x in xs)
    for rs in sequences.values():
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= size
    return sequences


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, "repeated id"), (50, None), (None, "null id. yes."), (40, "No stop here " * 4000), (41, "One. Two. Three. " * 400)]


def test_pieces_cover_every_id_once(spark):
    check(spark, ROWS)
    check(spark, ROWS, size=1024)


def test_blocks_carry_over(spark, monkeypatch):
    seqs = check(spark, [(i, "Some words. And more words here! " * (i % 7 + 1)) for i in range(300)])
    lengths = [sum(r.length for r in rs) for rs in seqs.values()]
    assert sum(pad(n, 64) for n in lengths) / (64 * len(lengths)) < 0.06


def test_empty_and_clashing(spark):
    assert PK.pack(docs(spark, []), PATH, 0).count() == 0
    assert PK.pack(clashing(docs(spark, ROWS)), PATH, 0).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_a_worker_holds_the_state_of_one_operator(spark):
    """Dictionaries of an operator go when another one's tasks begin in the worker."""
    import pyarrow as pa

    from cohort_risk.llm import minhash_dedup as MD
    from cohort_risk.llm import tokenize as TK

    df = docs(spark, [(i, f"word{i} and some text of five words {i}") for i in range(40)]).repartition(16)
    kinds = lambda: sorted(str(k) for k in TK.worker_state() if not str(k).startswith("__"))

    def seen(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(kinds(), pa.string())], names=["k"])

    PK.pack(df, PATH, 0).collect()
    MD.near_duplicates(df).collect()
    seen.__module__ = MD.__name__  # looks into the workers as a task of that operator
    names = {r.k for r in C.map_arrow(df, seen, "k string").collect()}
    assert "owner" in names and not any("byte_bpe" in k for k in names)
    state = TK.worker_state()
    try:
        TK.only_state_of("a")
        state["x"] = 1
        TK.only_state_of("a")
        assert state["x"] == 1
        TK.only_state_of("b")
        assert "x" not in state and state["owner"] == "b"
    finally:
        TK.only_state_of("")
