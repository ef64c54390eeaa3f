import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_risk.llm import queries as Q
from cohort_risk.llm import source_divergence as SD

from .helpers import clashing

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_force(rows):
    """The contract, term by term and source by source."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread: dict[str, int] = {}
        for d in own:
            for t in set(d[2]):
                spread[t] = spread.get(t, 0) + 1
        kept = [t for t, n in spread.items() if n >= 3]

        def shares(texts, kept=kept):
            words = [t for ws in texts for t in ws]
            count = {t: words.count(t) for t in kept}
            total = sum(count.values()) + len(kept)
            return count, {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        _, q = shares([d[2] for d in own])
        sources = {s: shares([d[2] for d in own if d[1] == s]) for s in {d[1] for d in own}}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (count, p) in sources.items():
            pair = [(-sum(f(p[t], o[1][t]) for t in kept), x.encode(), x) for x, o in sources.items() if x != s]
            term = [(-f(p[t], q[t]), t.encode(), t) for t in kept if count[t] and p[t] > q[t]]
            for part, found in (("pair", pair), ("term", sorted(term)[:200])):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(found))]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


ROWS = [
    (1, "The cat, the dog; 12 dogs", "en", "a"), (2, "the cat THE", "en", "b"), (3, "The end of it", "en", "a"), (4, "cat the", "en", None), (5, None, "en", "empty"),
    (6, "", "en", "empty2"), (7, "ÉTÉ été ÉtÉ ﬁn", "fr", "a"), (8, "ÉTÉ x été", "fr", "b"), (9, "ÉTÉ", "fr", "b"), (10, "one two", None, "a"), (11, "one two", None, "b"),
    (11, "one two one", None, "b"), (12, "nothing kept here", "xx", "a"), (13, "at all", "xx", "b"), (14, "cat the é日本 " * 50, "en", "a"), (14, "é日本 é日本", "en", "b"), (15, "é日本", "en", ""),
]


def test_equals_brute_force(spark):
    assert found(SD.divergence(spark.createDataFrame(ROWS, SCHEMA))) == brute_force(ROWS)


def test_random_tables_with_ties_and_a_hot_source(spark):
    r = random.Random(11)
    words = [a + b + c for a in "abcdefgh" for b in ("", "long", "é", "longlonglong") for c in ("", "er", "erst", "日")]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["x", "y"]), r.choice(["hot", "hot", "s1", "s2", "s3"])) for i in range(150)]
    assert found(SD.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute_force(rows)


def test_equals_its_sql(spark):
    import duckdb

    rows = spark.createDataFrame(ROWS, SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("docs", rows)
    assert sorted(con.execute(Q.divergence_sql("docs")).fetchall()) == brute_force(ROWS)


@pytest.mark.parametrize("shard", [1, 7, 64, 1 << 20])
def test_shards_and_slices_of_long_texts_count_alike(spark, shard):
    rows = spark.createDataFrame([(1, "wordword a bb word " * 20, "l", "s"), (2, "a bb", "l", "s"), (3, "", "l", "t"), (4, "bb" * 30, "l", "t")], SCHEMA).coalesce(1)
    got = {(r.source, r.term): (r.n, r.docs) for r in SD.term_counts(rows, shard_bytes=shard).collect()}
    assert got == {("s", "wordword"): (20, 1), ("s", "a"): (21, 2), ("s", "bb"): (21, 2), ("s", "word"): (20, 1), ("t", "bb" * 30): (1, 1), ("s", None): (0, 0), ("t", None): (0, 0)}


@pytest.mark.parametrize("small", [1, 5, 4096])
def test_multikey_quicksort_is_a_stable_sort(small):
    r = random.Random(small)
    terms = [bytes(r.choice(b"abc") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 30]))) if r.random() < 0.6 else r.choice([b"the", b"internationalisation", b"internationalise"]) for _ in range(3000)]
    data = np.frombuffer(b" ".join(terms) + bytes(8), np.uint8)
    lengths = np.array([len(t) for t in terms])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    order, first = SD.multikey_quicksort(data, starts, lengths, small)
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
    assert first.tolist() == [i == 0 or terms[order[i]] != terms[order[i - 1]] for i in range(len(terms))]


def test_shares_are_exact_beyond_a_long(spark):
    rows = spark.createDataFrame([(5 * 10**12, 9 * 10**12), (0, 1), (10**10, 10**10 + 1)], "n long, total long")
    got = [r[0] for r in rows.select(SD.share(F.col("n"), F.col("total"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // t for n, t in [(5 * 10**12, 9 * 10**12), (0, 1), (10**10, 10**10 + 1)]]


def test_empty_tables_and_clashing_columns(spark):
    empty = SD.divergence(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0
    rows = clashing(spark.createDataFrame(ROWS, SCHEMA)).withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    assert found(SD.divergence(rows)) == brute_force(ROWS)
