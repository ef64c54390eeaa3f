"""WARC archives with an externally merged capture index.

Write: payloads are digested, the smallest page id of each digest becomes the
response and every other page with that payload a revisit of it. Tasks write
archives (a gzip member per record) of at most ``ARCHIVE_ROWS`` records, each with
one *run*: the index entries of that archive, sorted by URL key, timestamp and page id.

Merge: the runs are merged k ways with a loser tree. The key space is cut into
ranges by keys sampled from the runs, so a merge task handles one range of at
most ``fan_in`` runs and streams row groups; more runs take further passes. A
URL that holds a third of all captures is cut by timestamp and page id. The
result is a list of files that hold the capture histories in global order.

Read: archives are streamed member by member; payloads are checked against
their digests.

Defined results: null html is an empty payload; a null url has the empty key;
rows that share the first page id of their payload are all responses; null
page ids are revisits where the payload has a numbered page, else responses;
without a time column, or where it is null, a capture is dated by its page id
(seconds after EPOCH); extra columns are ignored; an empty table gives empty
results."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FAN_IN = 64
SAMPLE_KEYS = 100_000
ARCHIVE_ROWS = 50_000
ENTRY = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()),
])
RECORD_DDL = "archive string, offset long, page_id long, url string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, without scheme, port 80/443, ``www.`` and fragment."""
    try:
        p = urlsplit((url or "").strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").split("#")[0].lower()
    host = re.sub(r"^www\d*\.", "", host)
    tail = f":{port}" if port not in (None, 80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){p.path or '/'}{'?' + p.query if p.query else ''}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(s: str | None) -> str:
    return re.sub("[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), s or "")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, when: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers only; their
    Content-Length is the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Target-URI: {_header_text(url)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is None:
        http += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(http)}", "", ""]).encode() + http + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, block = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't have its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("X-Page-Id"), "url": h["WARC-Target-URI"], "timestamp": h["WARC-Date"], "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")}


def read_members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    offset, held = 0, b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        d, parts, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    raise ValueError("the archive ends inside a member")
            parts.append(d.decompress(held))
            used += len(held) - len(d.unused_data)
            held = d.unused_data
        yield offset, b"".join(parts)
        offset += used


class LoserTree:
    """k-way merge of sorted iterators of (key, row): each inner node keeps the
    loser of its match, so the next row costs one match per level."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.k = max(len(sources), 1)
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # while building: wait here for the opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def _key(url_key, timestamp, page_id) -> tuple:
    return (url_key, timestamp, page_id is not None, page_id or 0)


def _run_slice(fs, path: str, lo, hi) -> Iterator:
    """Sorted (key, row) of a run with lo <= key < hi; only the row groups that can hold such keys are read."""
    with fs.open_input_file(path) as f:
        run = pq.ParquetFile(f)
        at = run.schema_arrow.names.index("url_key")
        for g in range(run.num_row_groups):
            s = run.metadata.row_group(g).column(at).statistics
            if s is not None and s.has_min_max and (hi is not None and s.min > hi[0] or lo is not None and s.max < lo[0]):
                continue
            for b in run.iter_batches(batch_size=2048, row_groups=[g]):
                for row in b.to_pylist():
                    key = _key(row["url_key"], row["timestamp"], row["page_id"])
                    if hi is not None and key >= hi:
                        return
                    if lo is None or key >= lo:
                        yield key, row


def _write_entries(folder: str, name: str, rows: Iterator[dict]) -> int:
    n = 0

    def fill(out):
        nonlocal n
        with pq.ParquetWriter(out, ENTRY, compression="zstd") as w:
            part = []
            for row in rows:
                part.append(row)
                if len(part) == 4096:
                    w.write_batch(pa.RecordBatch.from_pylist(part, schema=ENTRY))
                    n += len(part)
                    part = []
            w.write_batch(pa.RecordBatch.from_pylist(part, schema=ENTRY))
            n += len(part)

    C.publish(folder, name, fill)
    return n


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, archive_rows: int = ARCHIVE_ROWS) -> list[dict]:
    """Write the archives of at most ``archive_rows`` records and their sorted runs;
    returns one entry per run: name, n and, with the first, a bounded sample of all keys."""
    when = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    rows = df.select(
        F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("__when"),
    ).withColumn("__sha1", F.sha1(F.col("__html").cast("binary")))
    first = rows.groupBy("__sha1").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    # sorted within a task: a retried task writes the same bytes; a payload that many pages share may be split
    rows = C.split_join(rows, first, ["__sha1"], "left").select("__id", "__url", "__html", "__when", "__first").sortWithinPartitions("__id", "__url", "__when")

    def write(batches):
        pages = (r for b in batches for lo in range(0, b.num_rows, 256) for r in b.slice(lo, 256).to_pylist())
        task = TaskContext.get().partitionId()
        for number in itertools.count():
            part = list(itertools.islice(pages, 1))
            if not part:
                return
            name, entries = f"part-{task:06d}-{number:04d}", []

            def fill(out, part=part, name=name, entries=entries):
                offset = 0
                for r in itertools.chain(part, itertools.islice(pages, archive_rows - 1)):
                    payload = r["__html"].encode("utf-8", "surrogatepass")
                    digest = payload_digest(payload)
                    when = r["__when"] or (EPOCH + timedelta(seconds=(r["__id"] or 0) % 1_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                    refers = r["__first"] if r["__first"] != r["__id"] else None
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = gz.compress(record(r["__id"], r["__url"], when, payload, digest, refers)) + gz.flush()
                    out.write(packed)
                    entries.append({"url_key": url_key(r["__url"]), "timestamp": when, "page_id": r["__id"], "url": r["__url"], "digest": digest, "record_type": "response" if refers is None else "revisit", "refers_to": refers, "archive": f"{name}.warc.gz", "offset": offset, "size": len(packed)})
                    offset += len(packed)

            C.publish(folder, f"{name}.warc.gz", fill)
            entries.sort(key=lambda e: _key(e["url_key"], e["timestamp"], e["page_id"]))
            _write_entries(f"{folder}/runs", f"{name}.parquet", iter(entries))
            step = -(-len(entries) // 64)
            sample = [{k: e[k] for k in ("url_key", "timestamp", "page_id")} for e in entries[step // 2 :: step]]
            yield pa.RecordBatch.from_pylist([{"name": name, "n": len(entries), "keys": sample}], schema=pa.schema([("name", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.struct([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64())])))]))

    found = C.written(C.map_arrow(rows, write, "name string, n long, keys array<struct<url_key: string, timestamp: string, page_id: long>>"), "warc-runs")
    runs = [{"name": r["name"], "n": r["n"], "keys": []} for r in found.select("name", "n").orderBy("name").collect()]  # a line per archive
    if runs:  # keys are thinned before they reach the driver; they belong to no run in particular
        keys = found.select("name", F.posexplode("keys").alias("at", "key")).orderBy(F.xxhash64("name", "at")).limit(SAMPLE_KEYS).select("key.*")
        runs[0]["keys"] = [_key(*k) for k in keys.collect()]
    return runs


def merge_runs(spark: SparkSession, folder: str, runs: list[dict], fan_in: int = FAN_IN, ranges: int | None = None) -> list[str]:
    """Merge the runs into ``folder``/merged; returns the files in global order."""
    if not runs:
        return []
    keys = sorted(k for r in runs for k in r["keys"])
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in runs) // 1_000_000)
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    level, groups = 0, [[f"{folder}/runs/{r['name']}.parquet"] for r in runs]
    # sources[i]: the file of source i for each range (the same file where a run isn't cut yet)
    sources = [g * len(bounds) for g in groups]
    while True:
        groups = [sources[i : i + fan_in] for i in range(0, len(sources), fan_in)]
        out = f"{folder}/merged" if len(groups) == 1 else f"{folder}/level{level}"
        name = lambda r, g, whole=len(groups) == 1: f"range-{r:06d}" + ("" if whole else f"-{g:06d}") + ".parquet"
        jobs = [(r, name(r, g), [s[r] for s in group]) for g, group in enumerate(groups) for r in range(len(bounds))]
        limits = spark.sparkContext.broadcast(bounds)  # at most one key per range

        def merge(batches, out=out, limits=limits):
            fs, _ = C.filesystem(out)
            for b in batches:
                for job in b.to_pylist():
                    lo, hi = limits.value[job["range"]]
                    tree = LoserTree([_run_slice(fs, C.filesystem(p)[1], lo, hi) for p in job["paths"]])
                    n = _write_entries(out, job["name"], (row for _, row in tree))
                    yield pa.RecordBatch.from_pylist([{"n": n}])

        done = C.map_arrow(spark.createDataFrame(jobs, "range int, name string, paths array<string>").repartition(len(jobs)), merge, "n long")
        total = done.agg(F.sum("n")).first()[0]
        if total != sum(r["n"] for r in runs):
            raise RuntimeError(f"merged {total} index entries of {sum(r['n'] for r in runs)}")
        sources = [[f"{out}/{name(r, g)}" for r in range(len(bounds))] for g in range(len(groups))]
        level += 1
        if len(sources) == 1:
            return sources[0]


def read_index(spark: SparkSession, files: list[str]) -> DataFrame:
    """Merged entries; ``part`` numbers the files in global order."""
    ddl = "url_key string, timestamp string, page_id long, url string, digest string, record_type string, refers_to long, archive string, offset long, size long"
    if not files:
        return spark.createDataFrame([], ddl + ", part int")
    return spark.read.schema(ddl).parquet(*files).withColumn("part", F.regexp_extract(F.input_file_name(), r"range-(\d+)", 1).cast("int"))


def read_archives(spark: SparkSession, folder: str, runs: list[dict]) -> DataFrame:
    """All records of the archives, streamed member by member."""
    if not runs:
        return spark.createDataFrame([], RECORD_DDL)
    types = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD_DDL.split(", ")])

    def read(batches):
        fs, path = C.filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for offset, raw in read_members(f):
                        rows.append({"archive": name, "offset": offset, **parse(raw)})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = spark.createDataFrame([(f"{r['name']}.warc.gz",) for r in runs], "name string")
    return C.map_arrow(names.repartition(len(runs)), read, RECORD_DDL)
