"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import io
import os
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import tokenize as TK

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Byte table of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
# A-Z: digits, a-z and every byte of a non-ASCII character belong to a word,
# all other bytes become spaces.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers: in $PUBLIC_TOKENIZERS if set, else where the installed package has it."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, by way of the
    shared folder (so they need not have it installed)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, packed = Path(__file__).parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    folder = work_path(spark, "code")
    publish(folder, f"{root.name}.zip", lambda out: out.write(packed.getvalue()))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which hold the state of the
    operator at work only and return what a task has freed."""
    ship(df.sparkSession)
    owner = function.__module__

    def run(batches):
        TK.only_state_of(owner)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system: a worker lives
    on after its task, beside those of the executor's other cores."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage is cut and
    a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI, usable in tasks on any executor."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def publish(folder: str, name: str, write) -> str:
    """Write a task's file whole or not at all: ``write(stream)`` fills a private
    name that is then moved over the final one, so a retried or speculative
    task replaces the file with the same bytes."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    private = f"{path}/_{name}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(private, compression=None) as out:
        write(out)
    fs.move(private, f"{path}/{name}")
    return f"{path}/{name}"


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join whose two sides are both shuffled for it (the extra key keeps Spark from
    reusing the partitioning of an aggregate below), so AQE can split a hot key."""
    tag = F.xxhash64(F.lit("split"), *on)
    return left.withColumn("__split", tag).join(right.withColumn("__split", tag), [*on, "__split"], how).drop("__split")


def whole_groups(batches, key: str = "__g"):
    """Tables made of whole groups, from the batches of a partition sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        last = k[b.num_rows - 1].as_py()
        # rows of the last group wait for the next batch
        at = int(np.searchsorted(k.to_numpy(zero_copy_only=False), last))
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = [b.slice(at)]
        elif held and held[-1].column(held[-1].schema.get_field_index(key))[0].as_py() != last:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (public constants), element-wise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII and is much
    faster than ``translate``, which handles the rest."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def held_out(id_col: str) -> Column:
    """The labelled rows kept for evaluation: crc32 of the id as text mod 5 is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
