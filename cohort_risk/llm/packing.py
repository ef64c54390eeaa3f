"""Packing into fixed-size training sequences by order-preserving dynamic
programming.

Documents are taken in id order. The cuts of a sequence lie at document ends,
sentence ends or, inside stretches without either, at every ``STRETCH`` ids.
Over these candidate cuts the least total of padding plus truncation penalties
is found exactly: padding of a window of L ids is size - L (nothing when L is
a power of two), so the best window start for a cut minimises cost + position
over a sliding window of ``size`` ids, which a monotone queue keeps in
constant time per cut; the cuts a power of two away are tried beside it.

A task packs its id range in blocks of about ``BLOCK_IDS`` ids; what lies
behind the best cut near a block's end moves on to the next block, so only the
last sequence of a task is cut short by the partitioning. Sequence ids rise in
document order (task number and running number).

Defined results: null texts are empty (only the end id); rows sharing an id
are packed one after the other, by text hash; null ids come first; extra
columns are ignored; an empty table gives no piece."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokenize as TK

SIZE = 1024
STRETCH = 32
BLOCK_IDS = 1 << 18
SENTENCE_PENALTY = 2
STRETCH_PENALTY = 4


def best_cuts(pos: list[int], penalty: list[int], size: int, last: bool = True) -> list[int]:
    """Indices into ``pos`` of the cheapest chain of cuts from 0. Neighbouring
    positions lie at most ``size`` apart. ``last``: the chain ends at the last
    position, else at the cheapest one among those within ``size`` of it."""
    n = len(pos)
    # the cuts that lie exactly a power of two before a cut (the powers below size)
    exact: dict[int, list[int]] = {}
    at = np.array(pos)
    for k in range((size - 1).bit_length()):
        start = np.searchsorted(at, at - (1 << k))
        j = np.flatnonzero(at[start] == at - (1 << k))
        for x, y in zip(j.tolist(), start[j].tolist(), strict=True):
            exact.setdefault(x, []).append(y)
    cost, back, key = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        key[j - 1] = k = cost[j - 1] + pos[j - 1]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j - 1)
        p = pos[j]
        while p - pos[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - p
        for x in exact.get(j, ()):
            if cost[x] < best:
                best, i = cost[x], x
        cost[j], back[j] = best + penalty[j], i
    j = n - 1
    if not last and n > 1:
        near = [i for i in range(1, n) if pos[n - 1] - pos[i] <= size]
        j = min(near, key=lambda i: (cost[i], -i))
    cuts = []
    while j > 0:
        cuts.append(j)
        j = back[j]
    return [0, *reversed(cuts)]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Candidate cuts of a block and their penalties."""
    step = min(STRETCH, size)
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][sentence_end[ids]] = 2
    kind[0] = 1
    kind[doc_ends] = 1
    at = np.flatnonzero(kind)
    gaps = np.flatnonzero(np.diff(at) > step)
    for g in gaps.tolist():
        kind[at[g] + step : at[g + 1] : step] = 3
    at = np.flatnonzero(kind)
    costs = np.array([0, 0, SENTENCE_PENALTY, STRETCH_PENALTY])
    return at.tolist(), costs[kind[at]].tolist()


def sentence_ends(tokenizer) -> np.ndarray:
    """By id: does the token end a sentence or a line?"""
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 2, bool)
    ends[[i for t, i in vocab.items() if t.removesuffix("</w>").endswith((".", "!", "?", "\n", "Ċ"))]] = True
    return ends


def pack(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, on request, ids."""
    fields = [(id_col, pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    ddl = ", ".join(f"`{n}` long" for n, _ in fields) + ", ids array<long>" * with_ids
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = TK.encoder(tokenizer, special_as_text)
        stops = sentence_ends(enc.tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (doc id, ids before, ids of the whole document, ids as bytes)

        def solve(last):
            nonlocal held, sequence
            ids = np.frombuffer(b"".join(x[3] for x in held), "<u4")
            ends = np.cumsum([len(x[3]) // 4 for x in held])
            pos, penalty = candidates(ids, ends, stops, size)
            cuts = [pos[i] for i in best_cuts(pos, penalty, size, last)]
            rows, d = [], 0
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                at = lo
                while at < hi:
                    doc, before, whole, data = held[d]
                    first = int(ends[d]) - len(data) // 4
                    stop = min(hi, int(ends[d]))
                    piece = data[4 * (at - first) : 4 * (stop - first)]
                    row = {id_col: doc, "start": before + at - first, "length": stop - at, "ids_crc32": zlib.crc32(piece), "doc_tokens": whole, "sequence_id": sequence, "offset": at - lo}
                    if with_ids:
                        row["ids"] = np.frombuffer(piece, "<u4").tolist()
                    rows.append(row)
                    at = stop
                    d += stop == ends[d]
                sequence += 1
            rest = held[d:]
            if rest and cuts[-1] > int(ends[d]) - len(rest[0][3]) // 4:
                doc, before, whole, data = rest[0]
                used = cuts[-1] - (int(ends[d]) - len(data) // 4)
                rest[0] = (doc, before + used, whole, data[4 * used :])
            held = rest
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        size_now = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for lo in range(0, len(keys), 256):
                coded = enc.encode(b.column(1).slice(lo, 256).to_pylist())
                for k, x in zip(keys[lo : lo + 256], coded, strict=True):
                    x += end
                    held.append((k, 0, len(x) // 4, x))
                    size_now += len(x) // 4
                    if size_now >= BLOCK_IDS:
                        yield solve(False)
                        size_now = sum(len(y[3]) // 4 for y in held)
        if held:
            yield solve(True)

    # equal rows of many input partitions spread over tasks
    order = [F.col("__id"), F.xxhash64("__text"), F.col("__from")]
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.spark_partition_id().alias("__from"))
    return C.map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, ddl)
