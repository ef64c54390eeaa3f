"""Token-ID output: documents as unsigned 32-bit ids in zstandard shards that
can be read in part.

A shard is a sequence of independent zstandard frames, each of ``frame_ids``
ids, closed by a seek table in a skippable frame (the public zstandard
seekable layout): compressed size, decompressed size and XXH64 checksum of
every frame. A second file of the same layout holds (doc_id, number of ids) of
each document. A reader turns a document into an id range, the range into
frames, and decompresses and checks only those.

Documents are range-partitioned and sorted by (id, text hash, input partition), so
the shards in order hold ascending ids, equal rows from many partitions spread over
shards, a retried task writes the same bytes, and files appear whole or not at all. The driver keeps one manifest row per shard.

Defined results: null texts are empty (only the end id); rows sharing an id
stay separate documents, in the order of their text hash; null ids come first
and read back as null; other columns are not written; an empty table gives an
empty manifest."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokenize as TK

# fixed values of the public seekable layout
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 65_536
NULL_ID = -(2**63)
INDEX_DTYPE = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8")])


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FramedWriter:
    """Cuts a byte stream into independent frames and closes with the seek table."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.buffer, self.frames = bytearray(), []

    def write(self, data: bytes) -> None:
        self.buffer += data
        done = 0
        while len(self.buffer) - done >= self.frame_bytes:
            self._frame(bytes(self.buffer[done : done + self.frame_bytes]))
            done += self.frame_bytes
        del self.buffer[:done]

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.frames.append((len(packed), len(data), checksum(data)))
        self.out.write(packed)

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
            self.buffer.clear()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)


class FramedFile:
    """Random access to a framed file; ``decompressed`` counts the frames opened."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table")
        self.file.seek(size - 9 - 12 * n - 8)
        head = struct.unpack("<II", self.file.read(8))
        if head != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError(f"{path}: broken seek table")
        table = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3)
        self.path, self.sums = path, table[:, 2]
        self.at = np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        self.start = np.concatenate(([0], np.cumsum(table[:, 1], dtype=np.int64)))
        self.zstd, self.decompressed = zstandard.ZstdDecompressor(), 0

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.at[i]))
        size = int(self.start[i + 1] - self.start[i])
        data = self.zstd.decompress(self.file.read(int(self.at[i + 1] - self.at[i])), max_output_size=max(size, 1))
        if len(data) != size or checksum(data) != self.sums[i]:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        self.decompressed += 1
        return data

    def read(self, start: int, size: int) -> bytes:
        """Decompressed bytes [start, start + size), from the frames that hold them."""
        if not size:
            return b""
        i = int(np.searchsorted(self.start, start, "right")) - 1
        parts, base = [], int(self.start[i])
        while int(self.start[i]) < start + size:
            parts.append(self.frame(i))
            i += 1
        return b"".join(parts)[start - base : start - base + size]


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS, special_as_text: bool = False) -> list[dict]:
    """Write ``df`` as shards under ``folder``; returns the manifest (also saved
    there), one entry per shard in ascending document order."""
    spark = df.sparkSession
    end = struct.pack("<I", end_id)

    def write(batches):
        enc = TK.encoder(tokenizer, special_as_text)
        shard = TaskContext.get().partitionId()
        name, stats = f"shard-{shard:06d}", {"docs": 0, "bytes": 0, "first": None}
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def docs():
            for b in (first, *()):
                yield b
            yield from batches

        def index(out_index, out_ids):
            ids_w, index_w = FramedWriter(out_ids, 4 * frame_ids), FramedWriter(out_index, 1 << 18)
            for b in docs():
                keys = [NULL_ID if k is None else k for k in b.column(0).to_pylist()]
                stats["first"] = keys[0] if stats["first"] is None and keys else stats["first"]
                for lo in range(0, len(keys), 512):
                    ids = [x + end for x in enc.encode(b.column(1).slice(lo, 512).to_pylist())]
                    part = np.empty(len(ids), INDEX_DTYPE)
                    part["doc_id"], part["n_tokens"] = keys[lo : lo + 512], [len(x) // 4 for x in ids]
                    index_w.write(part.tobytes())
                    for x in ids:
                        ids_w.write(x)
                    stats["docs"] += len(ids)
                    stats["bytes"] += sum(map(len, ids))
            ids_w.close()
            index_w.close()

        C.publish(folder, f"{name}.docs", lambda o: C.publish(folder, f"{name}.ids", lambda i: index(o, i)))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": stats["docs"], "n_ids": stats["bytes"] // 4}], schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = [F.col("__id"), F.xxhash64("__text"), F.col("__from")]
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.spark_partition_id().alias("__from"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = C.map_arrow(rows, write, "shard long, name string, n_docs long, n_ids long").collect()
    manifest, start = [], 0
    for s in sorted(shards, key=lambda r: r["shard"]):
        manifest.append({"name": s["name"], "n_docs": s["n_docs"], "n_ids": s["n_ids"], "start": start})
        start += s["n_ids"]
    C.publish(folder, "manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def read_manifest(folder: str) -> list[dict]:
    fs, path = C.filesystem(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def read_index(fs, path: str) -> np.ndarray:
    f = FramedFile(fs, path)
    return np.frombuffer(f.read(0, int(f.start[-1])), INDEX_DTYPE)


def read_documents(folder: str, shard: str, doc_ids: list[int]) -> tuple[dict[int, np.ndarray], int]:
    """Ids of the wanted documents of a shard, and how many frames were opened."""
    fs, path = C.filesystem(folder)
    index = read_index(fs, f"{path}/{shard}.docs")
    ends = np.cumsum(index["n_tokens"].astype(np.int64))
    ids = FramedFile(fs, f"{path}/{shard}.ids")
    found = {}
    for k in doc_ids:
        i = int(np.searchsorted(index["doc_id"], k))
        if i < len(index) and index["doc_id"][i] == k:
            n = int(index["n_tokens"][i])
            found[k] = np.frombuffer(ids.read(4 * (int(ends[i]) - n), 4 * n), "<u4")
    return found, ids.decompressed


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """All documents of a folder: doc_id, start (ids before it), n_tokens,
    ids_crc32 and, on request, ids. One task streams a shard frame by frame."""
    manifest = read_manifest(folder)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    schema = pa.schema(fields)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest:
        return spark.createDataFrame([], ddl)

    def read(batches):
        fs, path = C.filesystem(folder)
        for b in batches:
            for shard in b.to_pylist():
                index = read_index(fs, f"{path}/{shard['name']}.docs")
                ids = FramedFile(fs, f"{path}/{shard['name']}.ids")
                start, held, frame, rows = shard["start"], bytearray(), 0, []
                for k, n in zip(index["doc_id"].tolist(), index["n_tokens"].tolist(), strict=True):
                    while len(held) < 4 * n:
                        held += ids.frame(frame)
                        frame += 1
                    data = bytes(held[: 4 * n])
                    del held[: 4 * n]
                    row = {"doc_id": None if k == NULL_ID else k, "start": start, "n_tokens": n, "ids_crc32": zlib.crc32(data)}
                    if with_ids:
                        row["ids"] = np.frombuffer(data, "<u4").tolist()
                    rows.append(row)
                    start += n
                    if len(rows) >= (256 if with_ids else 8192):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    shards = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    return C.map_arrow(shards.repartition(len(manifest)), read, ddl)
