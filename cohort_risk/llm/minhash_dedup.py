"""Near-duplicate documents by improved consistent weighted sampling (ICWS)
over TF-IDF word shingles, banded, verified by weighted Jaccard similarity.

1. Document frequencies of words over all documents, in a fixed number of
   hash slots (``SLOTS`` counters whatever the corpus size).
2. Every whole text becomes weighted 5-word shingles: term frequency times the
   mean inverse document frequency of the words. (A shingle's own document
   frequency would lower the weight of exactly the shingles that a large group
   of near copies shares, and part the group.) Texts with equal words form one
   class, named by its smallest id; from here on only classes are compared.
3. ICWS draws ``BANDS * ROWS`` consistent samples per class; two classes agree
   in a sample with a probability equal to their weighted Jaccard similarity.
   ``ROWS`` samples make a band key; classes that share a key are candidates
   (0.998 of the pairs at similarity 0.8, more above).
4. First every candidate is compared with the smallest class of its key (one
   row per class and key), verified on whole texts, and components are formed.
5. What may still link different components is compared in blocks: in a key
   that holds several components, the classes outside the largest one meet
   all others of the key, first by their samples (a pair whose estimate lies
   4.5 standard errors under the threshold is taken not to link: 0.00002 of the pairs
   at 0.8, beside the 0.0018 that share no key), then on
   whole texts, most similar first and only across what is still apart. Tasks
   return links, at most one less than they have classes; pairs are never rows,
   and the copies of a group are not expanded into pairs.

Defined results: texts without words (null, empty, symbols only) and rows with
a null id link with nothing; a text of fewer than five words is one shingle;
rows sharing an id are one document (``one_row_per_id`` keeps one of them); extra columns pass through (result
columns of the input are replaced); an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import components as CC
from . import tokenize as TK

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SLOTS = 1 << 18
BLOCK = 256
MAX_KNOWN_WORDS = 150_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


class _Known(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None) -> np.ndarray:
    words = C.words_of(text)
    known = TK.worker_state().setdefault("word_hashes", None)
    if known is None:
        known = TK.worker_state()["word_hashes"] = _Known()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, idf: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and their TF-IDF weights."""
    n = min(n, len(h))
    size = len(h) - n + 1
    key, weight = np.full(size, n, np.uint64), np.zeros(size)
    value = idf[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
    for j in range(n):
        key = (key ^ h[j : j + size]) * _PRIME
        key ^= key >> np.uint64(31)
        weight += value[j : j + size]
    key, first, count = np.unique(key, return_index=True, return_counts=True)
    return key, count * weight[first] / n


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Mid-point quantiles of Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 64.0)
    for _ in range(80):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


class Sampler:
    """ICWS with its random variables read from tables of their quantiles."""

    def __init__(self, samples: int = BANDS * ROWS):
        self.r = _gamma2_quantiles(1 << 12).astype(np.float32)
        self.inverse_r = (1 / self.r).astype(np.float32)
        self.log_c = np.log(_gamma2_quantiles(1 << 16)).astype(np.float32)
        self.seeds = C.mix64(np.arange(1, samples + 1, dtype=np.uint64) * _PRIME)[:, None]

    def __call__(self, key: np.ndarray, weight: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """One 32-bit value per sample, for the (shingle, quantised weight) drawn."""
        best = None
        rows = np.arange(len(self.seeds))
        for lo in range(0, len(key), step):
            k, log_w = key[lo : lo + step], np.log(weight[lo : lo + step]).astype(np.float32)
            g = (k ^ self.seeds) * _ODD
            g ^= g >> np.uint64(32)
            g *= _PRIME
            at = ((g >> np.uint64(12)) & np.uint64(0xFFF)).astype(np.int32)
            beta = ((g >> np.uint64(24)) & np.uint64(0xFFF)).astype(np.float32) * np.float32(1 / 4096)
            t = np.floor(log_w * self.inverse_r[at] + beta)
            log_a = self.log_c[(g >> np.uint64(48)).astype(np.int32)] - self.r[at] * (t - beta + 1)
            i = log_a.argmin(1)
            a = log_a[rows, i]
            drawn = C.mix64(k[i] ^ (t[rows, i].astype(np.int64).astype(np.uint64) * _ODD))
            if best is None:
                best, value = a, drawn
            else:
                value = np.where(a < best, drawn, value)
                best = np.minimum(a, best)
        return (value >> np.uint64(32)).astype("<u4")


def weighted_jaccard(a: tuple, b: tuple) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def word_idf(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency by hash slot, over all documents."""

    def count(batches):
        n, docs = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            docs += b.num_rows
            for text in b.column(0):
                slots = np.unique(word_hashes(text.as_py()) & np.uint64(SLOTS - 1))
                n[slots.astype(np.int64)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], docs), pa.int64())], names=["slot", "n"])

    counts = C.map_arrow(df.select(F.col(text_col).alias("text")), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SLOTS + 1)
    n[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(float)  # -1: the documents
    return np.log1p(n[-1] / (1 + n[:-1])) + 0.1


def _signatures(df: DataFrame, id_col: str, text_col: str, idf) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("samples", pa.binary())])

    def sign(batches):
        draw, value = Sampler(), idf.value
        for b in batches:
            rows = []
            for key, text in zip(b.column(0), b.column(1), strict=True):
                h = word_hashes(text.as_py())
                if len(h):
                    d = xxhash.xxh128_digest(h.tobytes())
                    rows.append((key.as_py(), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), draw(*shingles(h, value)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return C.map_arrow(rows, sign, "id long, h1 long, h2 long, samples binary")


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough; ``a`` may be hot."""

    def check(batches):
        value, last = idf.value, (None, None)
        for b in batches:
            left, right = [], []
            for x, y, tx, ty in zip(*(b.column(i) for i in range(4)), strict=True):
                x = x.as_py()
                if last[0] != x:
                    last = (x, shingles(word_hashes(tx.as_py()), value))
                if weighted_jaccard(last[1], shingles(word_hashes(ty.as_py()), value)) >= threshold:
                    left.append(x)
                    right.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = C.split_join(pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), ["b"])
    rows = C.split_join(rows, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), ["a"])
    return C.map_arrow(rows.select("a", "b", "ta", "tb"), check, "a long, b long")


def _meetings(keys: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """The classes of every band key that still holds several components, dealt
    out to meetings (``__g``) of two blocks: those outside the key's largest
    component meet each other and it; the largest doesn't meet itself."""
    rows = C.split_join(keys, component.withColumnRenamed("node", "id"), ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("hub"))
    sizes = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("in_major"), F.min("hub").alias("hub"))
    sizes = sizes.filter("n > in_major").select(
        "key", "major", "hub", F.ceil((F.col("n") - F.col("in_major")) / BLOCK).cast("int").alias("minor_blocks"), F.ceil(F.col("in_major") / BLOCK).cast("int").alias("major_blocks")
    )
    rows = C.split_join(rows, sizes, ["key"]).withColumn("is_major", F.col("component") == F.col("major"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_major"), F.col("major_blocks")).otherwise(F.col("minor_blocks"))).cast("int")
    rows = rows.withColumn("block", block)
    # minor block i with minor block j >= i, or with major block j
    meetings = F.when(
        F.col("is_major"),
        F.transform(F.sequence(F.lit(0), F.col("minor_blocks") - 1), lambda i: F.struct(i.alias("i"), (F.col("minor_blocks") + F.col("block")).alias("j"))),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("minor_blocks") + F.col("major_blocks") - 1),
            lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")),
        )
    )
    rows = rows.select("key", "band", "id", "component", "hub", "block", "is_major", F.explode(meetings).alias("meeting"))
    return C.split_join(rows, classes.select("id", "samples"), ["id"]).select(
        F.xxhash64("key", "meeting.i", "meeting.j").alias("__g"), "band", "id", "component", (F.col("id") == F.col("hub")).alias("hub"),
        F.when(F.col("is_major"), F.lit(-1)).otherwise(F.col("block")).alias("side"), (F.col("meeting.i") == F.col("meeting.j")).alias("inner"), "samples",
    )


_MEETING = "__g long, band int, id long, component long, hub boolean, side int, inner boolean, samples binary"
#: Matching samples below which a pair is taken not to link: 4.5 standard errors under
#: the threshold, a hundredth of what the bands miss.
MIN_MATCHES = int(np.floor(BANDS * ROWS * THRESHOLD - 4.5 * np.sqrt(BANDS * ROWS * THRESHOLD * (1 - THRESHOLD))))


def _pairs(t: pa.Table) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Of each meeting in a table: its first and last row, and (matches, x, y) of the
    pairs that may link: other components, not yet compared through the key's
    hub, sharing no earlier band, with enough matching samples."""
    g, band, comp, hub, side, inner = (t.column(c).to_numpy() for c in ("__g", "band", "component", "hub", "side", "inner"))
    s = np.frombuffer(b"".join(t.column("samples").to_pylist()), "<u4").reshape(-1, BANDS, ROWS)
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        found = []
        for x in range(lo, hi - 1):
            y = np.arange(x + 1, hi)
            y = y[(comp[y] != comp[x]) & ~(hub[y] | hub[x]) & (inner[x] | (side[y] != side[x]))]
            same = s[y] == s[x]
            shared = same.all(2)
            matches = same.sum((1, 2))
            ok = (matches >= MIN_MATCHES) & (shared.argmax(1) == band[x]) & shared.any(1)
            found += [(m, x, j) for m, j in zip(matches[ok].tolist(), y[ok].tolist(), strict=True)]
        yield lo, hi, found


def _live(batches):
    """The rows of the meetings that are part of some pair."""
    for t in C.whole_groups(batches):
        live = np.zeros(t.num_rows, bool)
        for _, _, pairs in _pairs(t):
            for _, x, y in pairs:
                live[x] = live[y] = True
        yield from t.filter(pa.array(live)).to_batches()


def _cross_links(keys: DataFrame, classes: DataFrame, component: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between classes of different components that share a band
    key. Tasks first find, by samples alone, the classes of each meeting that
    have a pair at all; their texts then come to the meeting, where pairs are
    verified most similar first, and only across what is still apart."""
    rows = _meetings(keys, classes, component)
    live = C.written(C.map_arrow(rows.repartition("__g").sortWithinPartitions("__g", "id"), _live, _MEETING), "cross-meetings")

    def verify(batches):
        value = idf.value
        for t in C.whole_groups(batches):
            ids, comp, text = t.column("id").to_pylist(), t.column("component").to_pylist(), t.column("text")
            for _, _, pairs in _pairs(t):
                parent: dict[int, int] = {}
                known: dict[int, tuple] = {}
                links = []

                def root(c, parent=parent):
                    while parent.setdefault(c, c) != c:
                        parent[c] = parent[parent[c]]
                        c = parent[c]
                    return c

                for _, x, y in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
                    a, b = root(comp[x]), root(comp[y])
                    if a != b:
                        for i in (x, y):
                            if i not in known:
                                known[i] = shingles(word_hashes(text[i].as_py()), value)
                        if weighted_jaccard(known[x], known[y]) >= threshold:
                            parent[max(a, b)] = min(a, b)
                            links.append((ids[x], ids[y]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    rows = C.split_join(live, texts, ["id"])
    return C.map_arrow(rows.repartition("__g").sortWithinPartitions("__g", "id"), verify, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default), ``component_id`` (smallest id of the
    near-duplicate group) and ``kept`` (it is that one)."""
    spark = df.sparkSession
    idf = spark.sparkContext.broadcast(word_idf(df, text_col))  # SLOTS numbers
    signed = C.written(_signatures(df, id_col, text_col, idf), "signatures")
    classes = C.written(signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("samples").alias("samples")).select("id", "samples"), "classes")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("samples", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])
    keys = classes.select("id", F.posexplode(bands).alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keys = C.written(C.split_join(keys, shared, ["key"]), "band-keys")
    pairs = keys.filter("id > a").select("a", F.col("id").alias("b")).distinct()
    needed = keys.select("id").distinct()
    # one plan at every size: the ids grow with the corpus and are not broadcast
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(needed.hint("merge"), "id", "left_semi")
    texts = C.written(texts, "candidate-texts")
    links = C.written(_verified(pairs, texts, idf, threshold), "links")
    component = C.written(CC.components(links), "component")
    found = C.written(_cross_links(keys.select("key", "band", "id"), classes, component, texts, idf, threshold), "cross-links")
    if not found.isEmpty():
        component = CC.components(found.unionByName(component.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))).select("a", "b"))
    member = C.split_join(signed.select("id", "h1", "h2"), signed.groupBy("h1", "h2").agg(F.min("id").alias("node")), ["h1", "h2"])
    member = C.split_join(member, component, ["node"], "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("__component"))
    kept = [c for c in (keep or df.columns) if c not in ("component_id", "kept")]
    rows = df.select(*[f"`{c}`" for c in kept], F.col(id_col).cast("long").alias("__member"))
    # rows without an id stay where they are, a repeated id may be split
    numbered = C.split_join(rows.filter("__member IS NOT NULL"), member.withColumnRenamed("id", "__member"), ["__member"], "left")
    out = numbered.unionByName(rows.filter("__member IS NULL").withColumn("__component", F.lit(None).cast("long")))
    component_id = F.coalesce("__component", "__member")
    return out.select(*[f"`{c}`" for c in kept], component_id.alias("component_id"), F.coalesce(component_id == F.col("__member"), F.lit(True)).alias("kept"))


def one_row_per_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each id: that with the smallest hash of its text, then of all its
    columns (equal rows are one); rows without an id all stay. Only ids and hashes are
    grouped; texts move only where some id is repeated."""
    marked = df.withColumn("__h", F.struct(F.xxhash64(f"`{text_col}`"), F.xxhash64(F.lit(1), *[f"`{c}`" for c in df.columns]))).withColumn("__id", F.col(f"`{id_col}`"))
    repeated = marked.filter("__id IS NOT NULL").groupBy("__id").agg(F.count("*").alias("__n"), F.min("__h").alias("__first")).filter("__n > 1")
    repeated = C.written(repeated.select("__id", "__first"), "repeated-ids")
    if repeated.isEmpty():
        return df
    both = C.split_join(marked.filter("__id IS NOT NULL"), repeated, ["__id"], "left")
    once = both.filter("__first IS NULL")
    again = both.filter("__h = __first").groupBy("__id").agg(*[F.first(f"`{c}`").alias(c) for c in df.columns])
    names = [f"`{c}`" for c in df.columns]
    return once.select(*names).unionByName(again.select(*names)).unionByName(marked.filter("__id IS NULL").select(*names))
