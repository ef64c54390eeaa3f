import base64
import gzip
import hashlib
import heapq
import io
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_risk.llm import common as C
from cohort_risk.llm import warc_index as WI

from .helpers import clashing

PAGE = "page_id long, url string, html string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=12).map(sorted), max_size=9))
def test_loser_tree_is_a_merge(runs):
    sources = [iter([((x,), i) for x in r]) for i, r in enumerate(runs)]
    got = [k[0] for k, _ in WI.LoserTree(sources)]
    assert got == list(heapq.merge(*runs))


def test_url_keys():
    assert WI.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert WI.url_key("http://example.com:8080") == "com,example:8080)/"
    assert [WI.url_key(x) for x in (None, "", "not a url#x", "http://[bad")] == ["", "", "not a url", "http://[bad"]


ROWS = [
    (5, "http://b.org/", "<p>same</p>"), (2, "http://a.org/x", "<p>same</p>"), (9, "http://a.org/x", "other é"), (7, None, None), (8, "http://c.org/\r\nX: y", ""),
    (2, "http://a.org/x", "<p>same</p>"), (None, "http://a.org/n", "<p>same</p>"), (None, "http://z.org/", "alone"), (11, "http://a.org/x", "x" * 200_000),
]


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        refers = first.get(h or "") if first.get(h or "") != p else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def build(spark, rows, parts=3, **kw):
    folder = C.work_path(spark, "test-warc")
    runs = WI.write_archives(clashing(spark.createDataFrame(rows, PAGE)).repartition(parts), folder)
    return folder, runs, WI.merge_runs(spark, folder, runs, **kw)


def check(spark, rows, **kw):
    folder, runs, files = build(spark, rows, **kw)
    records = WI.read_archives(spark, folder, runs)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()]
    assert sorted(got, key=repr) == brute(rows)
    index = WI.read_index(spark, files)
    assert index.join(records, ["archive", "offset"]).count() == len(rows) == index.count()
    # one file after the other, the entries are in global order
    keys = [WI._key(e["url_key"], e["timestamp"], e["page_id"]) for f in files for e in WI.pq.read_table(f).to_pylist()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    return folder, runs


def test_archives_and_index(spark):
    folder, runs = check(spark, ROWS)
    fs, path = C.filesystem(folder)
    for r in runs:  # an offset alone leads to a record
        entries = WI.pq.read_table(f"{path}/runs/{r['name']}.parquet").to_pylist()
        data = open(f"{path}/{r['name']}.warc.gz", "rb").read()
        for e in entries:
            raw = gzip.decompress(data[e["offset"] : e["offset"] + e["size"]])
            assert raw.startswith(b"WARC/1.1\r\n") and WI.parse(raw)["page_id"] == e["page_id"]
        assert [o for o, _ in WI.read_members(io.BytesIO(data), 100)] == sorted(e["offset"] for e in entries)


def test_several_passes_and_a_hot_url(spark):
    r = random.Random(2)
    rows = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{r.randint(0, 9)}.org/{i}", f"page {i % 50}") for i in range(400)]
    check(spark, rows, parts=7, fan_in=2, ranges=5)


def test_time_column_orders_a_history(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "x", "2024-05-01 00:00:00"), (2, "http://a.org/", "y", "2020-01-01 00:00:00"), (3, "http://a.org/", "z", None)], PAGE + ", at string")
    folder = C.work_path(spark, "test-warc")
    runs = WI.write_archives(df.withColumn("at", F.to_timestamp("at")), folder, time_col="at")
    files = WI.merge_runs(spark, folder, runs)
    assert [e["page_id"] for f in files for e in WI.pq.read_table(f).to_pylist()] == [2, 3, 1]


def test_empty_table(spark):
    folder, runs, files = build(spark, [])
    assert runs == [] == files and WI.read_index(spark, files).count() == 0 == WI.read_archives(spark, folder, runs).count()


def test_a_payload_of_a_third_of_all_pages(spark):
    """Archives stay bounded, keys are thinned, and the result is that of any other layout."""
    rows = [(i, f"http://h{i % 7}.org/{i}", "the same page" if i % 3 == 0 else f"page {i}") for i in range(600)]
    folder = C.work_path(spark, "test-hot")
    runs = WI.write_archives(spark.createDataFrame(rows, PAGE).repartition(4), folder, archive_rows=50)
    assert sum(r["n"] for r in runs) == 600 and max(r["n"] for r in runs) <= 50 and len(runs) >= 12
    files = WI.merge_runs(spark, folder, runs, fan_in=4)
    index = WI.read_index(spark, files).orderBy("part").collect()
    assert sorted(r.page_id for r in index) == list(range(600))
    assert {r.refers_to for r in index if r.page_id % 3 == 0 and r.page_id} == {0} and {r.record_type for r in index if r.page_id % 3} == {"response"}
    found = {(r.archive, r.offset): r.page_id for r in WI.read_archives(spark, folder, runs).collect()}
    assert found == {(r.archive, r.offset): r.page_id for r in index}
