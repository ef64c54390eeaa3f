from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_risk.llm.line_dedup import line_dedup

from .helpers import clashing, docs

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=2, min_chars=10):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [i is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != min(holders[key(x)]) for x in lines]
        kept = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
        out.append((i, len(lines), sum(drop), t if not any(drop) else kept))
    return out


def run(df, **kw):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(df, **kw).select("doc_id", "n_lines", "n_dropped", "text").collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


ROWS = [
    (3, "Shared line one\nown three\n\n"), (1, "  SHARED line ONE\t\nshort\nshort"), (2, None), (4, ""), (5, "ÉTÉ été line\nshort"),
    (6, "été été line\nshared line one"), (6, "shared line one\nanother text, same id"), (None, "shared line one"),
    (7, "shared line one"), (8, "repeat this line\nrepeat this line"), (9, "repeat this line"), (8, "repeat this line\nrepeat this line"),
]


def test_against_brute_force(spark):
    same(run(docs(spark, ROWS)), brute(ROWS))
    same(run(docs(spark, ROWS), min_docs=4), brute(ROWS, min_docs=4))


def test_only_ascii_is_lowered(spark):
    got = dict((r[0], r[2]) for r in run(docs(spark, [(1, "ÉCOLE normale"), (2, "école normale"), (3, "École NORMALE")])))
    assert got == {1: 0, 2: 0, 3: 0 if key("École NORMALE") != key("ÉCOLE normale") else 1}


def test_empty_table_long_text_and_clashing_columns(spark):
    assert run(docs(spark, [])) == []
    long = "\n".join(f"line number {i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + "\nnew line of two")]
    same(run(docs(spark, rows)), brute(rows))
    out = line_dedup(clashing(docs(spark, ROWS)))
    assert set(clashing(docs(spark, ROWS)).columns) == set(out.columns)
    assert dict(out.dtypes)["n_lines"] == "bigint" and out.filter(F.col("key") != "own").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from(["Alpha beta gamma", " alpha beta gamma", "delta epsilon", "x", "", "ÀÉ alpha beta"]), max_size=5).map("\n".join)), min_size=1, max_size=9))
def test_random(spark, rows):
    same(run(docs(spark, rows)), brute(rows))
