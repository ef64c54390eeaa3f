"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of at most a chunk is one piece. A longer one is encoded by many tasks:

1. It is cut into chunks that start at multiples of ``chunk`` characters and
   reach ``overlap`` characters into their successor; each chunk is a row.
2. Every chunk is pre-tokenised by itself from its first character. Only the
   boundaries that it sees in the two overlaps it shares are kept.
3. Where two neighbours have a boundary in common, after a character that is
   no white space, they have resynchronised: the pattern matches from left to right
   and looks at most ``LOOK`` characters past a match, so from a common boundary
   on both see the same matches. The first such place is the cut. By induction
   from the start of the text, every cut is a boundary of the whole text.
4. Neighbours without a common boundary (one pre-token reaches across the overlap)
   are merged into one chunk and pre-tokenised again, until all have a cut.
5. The pieces between cuts are encoded by themselves, every match of the pattern
   separately (byte pairs by rank), and a text's pieces are put together in order.

The scan runs with the ``regex`` library; characters that it classes otherwise than
the encoder does (``stand_ins``) are exchanged for it. No cut can part a run of white space, the one place where the pattern looks
ahead, so a piece's matches are those of the whole text. Decoding concatenates
the bytes of the ids.

Rows of long texts are named by task, content hash and how often that content has
occurred in the task, so a retried task names them alike in any order of rows. A
row (text and ids) must fit a Spark row, a single pre-token a task's memory.

Defined results: null texts are empty and have no ids; strings of special tokens
are ordinary text; rows are encoded one by one, repeated rows and ids stay; extra
columns pass through, result columns of the input are replaced; an empty table
gives an empty result. Null ids decode to null, an id without bytes fails."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tokenize import worker_state

CHUNK = 32_768
OVERLAP = 512
#: Characters after a match that can decide it: a contraction's two letters, or what follows white space.
LOOK = 2
ROWS = 256
_KEY = ["__task", "__h1", "__h2", "__copy"]
_KEY_DDL = "__task int, __h1 long, __h2 long, __copy int"
_KEY_FIELDS = [("__task", pa.int32()), ("__h1", pa.int64()), ("__h2", pa.int64()), ("__copy", pa.int32())]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> rank of a rank file (base64 and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoding(path: str, pattern: str):
    """The worker's encoder, loaded once per worker."""
    import tiktoken

    state = worker_state()
    if (path, pattern) not in state:
        state[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return state[path, pattern]


_CLASS = regex.compile(r"\\[pP]\{[^}]*\}|\\[sSdDwW]")


def stand_ins(pattern: str) -> dict[int, int]:
    """Characters that the encoder's library and ``regex`` class differently (their
    Unicode versions differ), each with one that ``regex`` classes as the encoder
    does that character, for all classes that the pattern names."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    as_encoder, as_regex = {}, {}
    for bit, name in enumerate(sorted(set(_CLASS.findall(pattern)))):
        only = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for of, found in ((as_encoder, only.decode(only.encode_ordinary(every))), (as_regex, "".join(regex.findall(name, every)))):
            for c in found:
                of[c] = of.get(c, 0) | 1 << bit
    odd = [c for c in every if as_encoder.get(c, 0) != as_regex.get(c, 0)]
    unlike, like = set(odd), {}
    for c in reversed(every):  # a character beyond those that a pattern spells out
        if c not in unlike and ord(c) > 0x2FF:
            like.setdefault(as_regex.get(c, 0), c)
    return {ord(c): ord(like[as_encoder.get(c, 0)]) for c in odd}


def boundaries(text: str, pattern: regex.Pattern, like: dict[int, int], lo: int, hi: int) -> list[int]:
    """Ends in [lo, hi] of the matches of a scan of ``text`` from its start, after
    characters that are no white space."""
    if not text.isascii():
        text = text.translate(like)
    return [e for m in pattern.finditer(text) if lo <= (e := m.end()) <= hi and not text[e - 1].isspace()]


def _cut(chunk: int, overlap: int):
    """Chunk rows of long texts: key, start, next (the successor's start, null at the end), text."""

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            for at in range(b.num_rows):
                text, h1, h2 = (b.column(i)[at].as_py() for i in (1, 2, 3))
                copy = seen[h1, h2] = seen.get((h1, h2), -1) + 1
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for lo in range(0, len(starts), 64):
                    part = starts[lo : lo + 64]
                    n = len(part)
                    following = [s + chunk if s + chunk in starts else None for s in part]
                    pieces = [text[s:] if f is None else text[s : f + overlap] for s, f in zip(part, following, strict=True)]
                    key = [pa.array([x] * n, kind) for x, (_, kind) in zip((task, h1, h2, copy), _KEY_FIELDS, strict=True)]
                    kept = b.column(0).take(pa.array([at if s == 0 else None for s in part], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*key, pa.array(part, pa.int64()), pa.array(following, pa.int64()), pa.array(pieces, pa.string()), kept], names=[*_KEY, "start", "next", "piece", "kept"]
                    )

    return cut



def _scan(pattern: str, like: dict[int, int], overlap: int):
    """Boundaries in the overlap with the predecessor (heads) and the successor (tails), counted in the text."""
    schema = pa.schema([*_KEY_FIELDS, ("start", pa.int64()), ("next", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))])

    def scan(batches):
        compiled = regex.compile(pattern)
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            rows = []
            for r in part.to_pylist():
                start, following, text = r["start"], r["next"], r.pop("piece")
                safe = len(text) if following is None else len(text) - LOOK
                from_tail = len(text) + 1 if following is None else following - start
                found = boundaries(text, compiled, like, 0, safe)
                # the predecessor reaches ``overlap`` characters into this chunk
                r["heads"] = [start + e for e in found if e <= overlap] if start else []
                r["tails"] = [start + e for e in found if e >= from_tail]
                rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return scan


def _stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """``chunks`` with ``from`` and ``to``, the places in the text where their pieces begin and end."""
    like = stand_ins(pattern)
    while True:
        zones = C.written(
            C.map_arrow(chunks.select(*_KEY, "start", "next", "piece"), _scan(pattern, like, overlap), f"{_KEY_DDL}, start long, next long, heads array<long>, tails array<long>"),
            "bpe-zones",
        )
        tails = zones.filter("next IS NOT NULL").select(*_KEY, F.col("next").alias("start"), "tails")
        cuts = zones.filter("start > 0").drop("tails").join(tails, [*_KEY, "start"])
        cuts = C.written(cuts.select(*_KEY, "start", F.array_min(F.array_intersect("heads", "tails")).alias("cut")), "bpe-cuts")
        if cuts.filter("cut IS NULL").isEmpty():
            break
        chunks = _merged(chunks, zones, cuts)
    own = cuts.select(*_KEY, "start", F.col("cut").alias("from"))
    following = cuts.select(*_KEY, F.col("start").alias("next"), F.col("cut").alias("to"))
    bounds = zones.select(*_KEY, "start", "next").join(own, [*_KEY, "start"], "left").join(following, [*_KEY, "next"], "left")
    bounds = bounds.select(*_KEY, "start", F.coalesce("from", F.lit(0)).alias("from"), "to")
    return C.split_join(chunks, bounds, [*_KEY, "start"])


def _merged(chunks: DataFrame, zones: DataFrame, cuts: DataFrame) -> DataFrame:
    """Chunks with those that have no cut at their start joined to their predecessors.
    The window is over the numbers of one text's chunks."""
    first = F.when((F.col("start") == 0) | F.col("cut").isNotNull(), F.col("start"))
    to = zones.select(*_KEY, "start").join(cuts, [*_KEY, "start"], "left")
    to = to.select(*_KEY, "start", F.max(first).over(Window.partitionBy(*_KEY).orderBy("start")).alias("first"))
    parts = C.split_join(chunks, to, [*_KEY, "start"]).groupBy(*_KEY, "first").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("parts"), F.max_by("next", "start").alias("next"), F.first("kept", ignorenulls=True).alias("kept")
    )
    # a part ends where its successor starts
    ends = F.transform(
        "parts",
        lambda p, i: F.when(i + 1 < F.size("parts"), F.substring(p["piece"], F.lit(1), (F.get("parts", i + 1)["start"] - p["start"]).cast("int"))).otherwise(p["piece"]),
    )
    return C.written(parts.select(*_KEY, F.col("first").alias("start"), "next", F.array_join(ends, "").alias("piece"), "kept"), "bpe-chunks")


def _texts(column: pa.Array):
    """The texts of a column, one in memory at a time."""
    return (t.as_py() or "" for t in column)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    """A list column of arrays of 32-bit integers. As Python objects an id takes nine times
    these four bytes, so only those of one text exist at a time."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _encode(path: str, pattern: str, names: list[str]):
    """The other columns and the ids of the last one, a text."""

    def run(batches):
        enc = _encoding(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ids = [np.array(enc.encode_ordinary(t), np.int32) for t in _texts(part.columns[-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(ids)], names=names)

    return run


def encode(df: DataFrame, ranks: str, pattern: str | None = None, text_col: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``keep`` columns (all by default) and ``ids``, array<int>, of each text."""
    if not LOOK < overlap <= chunk:
        raise ValueError(f"an overlap is longer than {LOOK} characters and at most a chunk")
    pattern = pattern or default_pattern()
    kept = [c for c in (keep or df.columns) if c != "ids"]
    # a name of its own for every column, so that one row type serves all inputs
    values = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(values.alias("kept"), text.alias("piece"))
    kept_type = rows.schema["kept"].dataType
    ids_type = T.ArrayType(T.IntegerType())
    long = F.length("piece") > chunk + overlap
    done = T.StructType([T.StructField("kept", kept_type), T.StructField("ids", ids_type)])
    short = C.map_arrow(rows.filter(~long), _encode(ranks, pattern, ["kept", "ids"]), done)

    key = T.StructType.fromDDL(_KEY_DDL)
    cut = T.StructType([*key, *T.StructType.fromDDL("start long, next long, piece string"), T.StructField("kept", kept_type)])
    content = [F.coalesce(F.to_json("kept"), F.lit("")), F.col("piece")]
    found = rows.filter(long).select("kept", "piece", F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit(1), *content).alias("h2"))
    chunks = C.written(C.map_arrow(found, _cut(chunk, overlap), cut).repartition(*_KEY, "start"), "bpe-chunks")
    span = F.substring(F.col("piece"), (F.col("from") - F.col("start") + 1).cast("int"), F.coalesce(F.col("to") - F.col("from"), F.length("piece")).cast("int"))
    pieces = _stitched(chunks, pattern, overlap).select(*_KEY, "start", "kept", span.alias("piece"))
    coded = T.StructType([*key, *T.StructType.fromDDL("start long"), T.StructField("kept", kept_type), T.StructField("ids", ids_type)])
    coded = C.map_arrow(pieces, _encode(ranks, pattern, [*_KEY, "start", "kept", "ids"]), coded)
    whole = coded.groupBy(*_KEY).agg(F.first("kept", ignorenulls=True).alias("kept"), F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("parts"))
    whole = whole.select("kept", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole).select(*[F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(kept)], "ids")


def decode(df: DataFrame, ranks: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``bytes``, the bytes of each row's ids."""
    kept = [c for c in (keep or df.columns) if c != "bytes"]

    def run(batches):
        state = worker_state()
        if ("bytes", ranks) not in state:
            state["bytes", ranks] = {i: token for token, i in load_ranks(ranks).items()}
        token = state["bytes", ranks].__getitem__
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                lists = part.column(len(kept))
                raw = [b"".join(map(token, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else None for ids in lists]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(raw, pa.binary())], names=[*kept, "bytes"])

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), T.StructField("bytes", T.BinaryType())])
    return C.map_arrow(df.select(*[f"`{c}`" for c in kept], F.col(f"`{ids_col}`").alias("__ids")), run, schema)
