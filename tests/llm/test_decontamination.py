import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cohort_risk.llm import decontamination as DC

from .helpers import clashing, docs

ITEM = "item_id string, text string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(rows, items, n=13):
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            b = words(text)
            size = min(n, len(b))
            for k in range(len(b) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == b[k : k + size]:
                        hit |= set(range(p, p + size))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def run(spark, rows, items, **kw):
    df = DC.find_hits(docs(spark, rows), spark.createDataFrame(items, ITEM), **kw)
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in df.collect()), key=repr)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [("10", LONG), ("9", "Short, ITEM here!"), ("x", None), ("y", "..."), ("9", "été un deux"), (None, "null id item")]
ROWS = [
    (1, "a " + " ".join(LONG.split()[5:18]) + " b"), (2, " ".join(LONG.split()[5:17])), (3, "say short item HERE short item here"), (4, None), (5, ""), (6, "!!"),
    (7, LONG + " ÉTÉ un deux été un deux"), (7, LONG), (None, "null id item"), (8, ("filler " * 5000) + LONG),
]


def test_against_brute_force(spark):
    assert run(spark, ROWS, ITEMS) == brute(ROWS, ITEMS)


def test_parts_of_a_large_benchmark_add_up(spark):
    assert run(spark, ROWS, ITEMS, part_chars=40) == brute(ROWS, ITEMS)


def test_removal(spark):
    bench = spark.createDataFrame(ITEMS, ITEM)
    kept = {r.doc_id for r in DC.decontaminate(docs(spark, ROWS), bench).collect()}
    assert kept == {2, 4, 5, 6, 8}  # 8: 40 of 5040 words
    cut = {r.doc_id: r.text for r in DC.decontaminate(docs(spark, ROWS[:3] + ROWS[9:]), bench, action="span").collect()}
    assert cut[1] == "a  b" and cut[2] == ROWS[1][1] and cut[3] == "say " and cut[8].strip() == ("filler " * 5000).strip()


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame(ITEMS, ITEM)
    assert run(spark, [], ITEMS) == []
    assert run(spark, ROWS, []) == brute(ROWS, [])
    df = clashing(docs(spark, ROWS))
    assert set(df.columns) - set(DC.RESULT) == set(DC.decontaminate(df, bench).columns)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12).map(" ".join), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=30).map(" ".join), min_size=1, max_size=4))
def test_random(spark, items, texts):
    rows, items = list(enumerate(texts)), [(str(i), t) for i, t in enumerate(items)]
    assert run(spark, rows, items, n=4) == brute(rows, items, n=4)


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(DC.Windows, "hashes", staticmethod(lambda grams, size: (grams[:, 0] % 2).astype("uint64")))
    w = DC.Windows([("1", "a b c"), ("2", "b c a"), ("3", "c a b")], 2)
    hit, items = w.scan([b"a", b"b", b"x", b"c", b"b"])
    assert hit.tolist() == [True, True, False, False, False] and items == {"1", "3"}


def test_parts_are_bounded(spark, monkeypatch):
    """Repeated rows count once, a long item is cut and loses no window."""
    long = " ".join(f"x{i}" for i in range(600))
    items = [("hot", LONG)] * 200 + [(f"i{k}", f"{LONG} {k}") for k in range(30)] + [("long", long), ("short", "a b c")]
    sizes, init = [], DC.Windows.__init__

    def counted(self, rows, n):
        sizes.append(sum(len(t) for _, t in rows))
        init(self, rows, n)

    monkeypatch.setattr(DC.Windows, "__init__", counted)
    rows = [(1, long), (2, LONG), (3, " ".join(long.split()[90:140])), (4, "z a b c"), (5, None)]
    assert run(spark, rows, items, part_chars=2000) == brute(rows, dict.fromkeys(items))
    assert len(sizes) > 1 and max(sizes) <= 2000
