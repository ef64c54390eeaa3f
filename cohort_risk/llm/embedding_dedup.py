"""Embedding near-duplicates by iterative quantisation (ITQ), multi-index
Hamming tables and a rerank with the original vectors.

1. Vectors that are equal within a label form one class with a multiplicity.
2. On a bounded sample (``FIT_ROWS`` unit vectors by hash order) a PCA basis and
   rotations are learned that make the signs of the rotated coordinates balanced
   binary codes close to the vectors; several random starts give independent
   codes. Every vector is encoded and indexed; the sample only shapes the codes.
   Codes are those of vectors minus the sample's mean, so that bits stay balanced
   where vectors share a direction.
3. The codes are cut into substrings of s bits, one hash table each. s follows
   the size of the largest label (about one vector of it per bucket), and the
   number of tables follows s, so that a pair at the threshold shares a bucket
   with probability ``RECALL`` at every size (pairs above it more often). What a
   hyperplane parts is the pair's angle as seen from the mean: for two vectors
   at least r from it (``NEAREST``: all but 0.001 of the sample), at most
   arccos(1 - (1 - threshold) / r^2). Where the nearest vectors lie so close to the
   mean that this exceeds ``WIDEST``, nearly all vectors link and nothing is
   gained by the mean; codes are then seen from the origin.
4. Vectors that share a bucket are compared by their original components in
   double precision. A pair is counted only in the first table it shares. Large
   buckets are cut into blocks that meet pairwise in separate tasks; a task
   returns a count per vector and a spanning forest of the links it found,
   never the pairs of a large group.
5. The forests' connected components name the groups.

Defined results: null ids, null labels, null, zero or non-finite vectors link
with nothing; vectors of different length don't link; equal vectors link (also
rows that share an id, which is then one node with the links of all its rows);
extra columns pass through, result columns of the input are replaced; an empty
table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import components as CC

THRESHOLD = 0.93
RECALL = 0.997
NEAREST, WIDEST = 0.001, 0.45 * math.pi
FIT_ROWS = 5_000
FIT_ROUNDS = 30
BLOCK = 1024
SMALL = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 (scaled first, so no square overflows)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def itq(x: np.ndarray, seed: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Projection (PCA basis times rotation learned on centred vectors) whose signs are the code."""
    d = x.shape[1]
    basis = np.linalg.eigh(np.cov(x.T).reshape(d, d) + 1e-12 * np.eye(d))[1][:, ::-1]
    v = (x - x.mean(0)) @ basis
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        b = np.where(v @ rotation >= 0, 1.0, -1.0)
        m = b.T @ v
        # directions without variance (fewer vectors than dimensions) stay where the seed put them: what the
        # decomposition picks there may be alike for all seeds, and part close vectors in every table
        left, _, right = np.linalg.svd(m + (1e-9 * np.abs(m).max() + 1e-300) * rotation.T)
        rotation = (left @ right).T
    return basis @ rotation


def projection(sample: np.ndarray, d: int, seed: int) -> np.ndarray:
    """ITQ of the sample; a single vector has no partner, so its code doesn't matter."""
    return itq(sample, seed) if len(sample) > 1 else np.eye(d)


def viewpoint(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """(point that codes are seen from, widest angle of a pair at the threshold from there)."""
    mean = sample.mean(0)
    r = float(np.quantile(np.sqrt(((sample - mean) ** 2).sum(1)), NEAREST))
    angle = math.acos(max(1 - (1 - threshold) / (r * r), -1.0)) if r else math.pi
    if len(sample) < 2 or angle > WIDEST:
        return np.zeros_like(mean), math.acos(threshold)
    return mean, angle


def plan(largest: int, d: int, angle: float) -> tuple[int, int]:
    """(bits per table, number of tables) for a largest label of so many vectors and
    pairs of at most this angle."""
    bits = min(d, max(8, min(31, math.ceil(math.log2(max(largest, 2))))))
    same = (1 - angle / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def table_keys(x: np.ndarray, model: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """One 32-bit key per table and vector (from the viewpoint)."""
    per = x.shape[1] // bits
    weights = 1 << np.arange(bits, dtype=np.int64)
    keys = []
    for p in model:
        code = x @ p >= 0
        keys += [code[:, bits * i : bits * (i + 1)] @ weights for i in range(per)]
    return np.stack(keys[:tables], 1).astype("<u4")


def _classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Comparable rows: id, label, vector (doubles), h1, h2 (of label and vector)."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    big = F.lit(1.7976931348623157e308)  # NaN is larger than any number, infinities lie beyond
    usable = F.forall("v", lambda x: x.isNotNull() & (x >= -big) & (x <= big)) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(usable)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    return rows.select("id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2"))


def _compare(threshold: float):
    """Counts and forest edges from the groups of a partition sorted by ``__g``."""

    def block(x, keys, label, side, inner, table, ids, mult, n, edges):
        """One group of more than SMALL members."""
        hit = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
        if not inner[0]:
            hit &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(hit, 1))
        first = (keys[a, table] == keys[b, table]) & ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[first], b[first]
        np.add.at(n, a, mult[b])
        np.add.at(n, b, mult[a])
        parent = list(range(len(x)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:  # joins two trees: an edge of the forest
                parent[max(i, j)] = min(i, j)
                edges.append((int(ids[i]), int(ids[j])))

    def compare(batches):
        for t in C.whole_groups(batches):
            g, ids, mult, side, inner, table, label = (t.column(c).to_numpy() for c in ("__g", "id", "mult", "side", "inner", "table", "label"))
            raw, packed = t.column("x").to_pylist(), t.column("keys").to_pylist()
            size = np.array([len(r) for r in raw])
            edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (size[1:] != size[:-1]), [True])))
            n, edges = np.zeros(len(g), np.int64), []
            length = np.diff(edge)
            for lo, hi in zip(edge[:-1][length > SMALL].tolist(), edge[1:][length > SMALL].tolist(), strict=True):
                x = np.frombuffer(b"".join(raw[lo:hi]), "<f8").reshape(hi - lo, -1)
                k = np.frombuffer(b"".join(packed[lo:hi]), "<u4").reshape(hi - lo, -1)
                part = np.zeros(hi - lo, np.int64)
                block(x, k, label[lo:hi], side[lo:hi], inner[lo:hi], int(table[lo]), ids[lo:hi], mult[lo:hi], part, edges)
                n[lo:hi] += part
            for d in np.unique(size[edge[:-1]]) if len(g) else []:
                # small groups of one vector length, compared at growing distance in the sorted rows
                of = np.concatenate([np.arange(lo, hi) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if 1 < hi - lo <= SMALL and size[lo] == d] or [np.zeros(0, int)])
                if not len(of):
                    continue
                x = np.frombuffer(b"".join([raw[i] for i in of]), "<f8").reshape(len(of), -1)
                k = np.frombuffer(b"".join([packed[i] for i in of]), "<u4").reshape(len(of), -1)
                for off in range(1, SMALL):
                    a = np.arange(len(of) - off)
                    a = a[(g[of[a]] == g[of[a + off]])]
                    if not len(a):
                        break
                    a = a[(label[of[a]] == label[of[a + off]]) & (inner[of[a]] | (side[of[a]] != side[of[a + off]]))]
                    a = a[(x[a] * x[a + off]).sum(1) >= threshold]
                    b = a + off
                    same = k[a] == k[b]
                    first = same.argmax(1) == table[of[a]]
                    a, b = of[a[first & same.any(1)]], of[b[first & same.any(1)]]
                    np.add.at(n, a, mult[b])
                    np.add.at(n, b, mult[a])
                    edges += zip(ids[a].tolist(), ids[b].tolist(), strict=True)
            at = np.flatnonzero(n)
            count = [(int(ids[i]), None, int(n[i])) for i in at] + [(a, b, 0) for a, b in edges]
            columns = list(zip(*count, strict=True)) if count else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return compare


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default), ``n_links``, ``component_id`` and ``kept``."""
    spark = df.sparkSession
    rows = _classes(df, id_col, vector_col, label_col)
    grouped = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = C.written(grouped, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    models = {}
    for d in dims:
        sample = classes.filter(F.size("v") == d).orderBy(F.xxhash64("v"), "id").limit(FIT_ROWS).select("v").collect()
        x = unit(np.array([r["v"] for r in sample]))
        center, angle = viewpoint(x, threshold)
        bits, tables = plan(largest, d, angle)
        models[d] = (bits, tables, center, [projection(x, d, seed) for seed in range(math.ceil(tables / (d // bits)))])
    shared = spark.sparkContext.broadcast(models)  # a few d x d matrices per vector length

    def encode(batches):
        for b in batches:
            values = b.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                by_size.setdefault(len(v), []).append(i)
            for d, at in by_size.items():
                bits, tables, center, model = shared.value[d]
                x = unit(np.array([values[i] for i in at]))
                keys = table_keys(x - center, model, bits, tables)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(keys.astype(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["id", "mult", "label", "x", "keys", "tables"],
                )

    coded = C.map_arrow(
        classes.select("id", "mult", "v", F.xxhash64("label").alias("label")), encode, "id long, mult long, label long, x binary, keys binary, tables array<long>"
    )
    coded = C.written(coded, "vector-codes")
    entries = coded.select("id", F.octet_length("x").alias("d"), "label", F.posexplode("tables").alias("table", "key"))
    entries = entries.select("id", "table", F.xxhash64("label", "d", "table", "key").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    entries = C.split_join(entries, sizes, ["bucket"])
    entries = entries.withColumn("side", F.pmod(F.xxhash64("id", F.lit("side")), F.col("blocks")).cast("int"))
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("side")).alias("i"), F.greatest(j, F.col("side")).alias("j")))
    entries = entries.select("id", "table", "bucket", "side", F.explode(meetings).alias("meeting"))
    entries = C.split_join(entries, coded.drop("tables"), ["id"]).select(
        F.xxhash64("bucket", "meeting.i", "meeting.j").alias("__g"), "id", "mult", "label", "side",
        (F.col("meeting.i") == F.col("meeting.j")).alias("inner"), "table", "x", "keys",
    )
    found = C.map_arrow(entries.repartition("__g").sortWithinPartitions("__g", F.octet_length("x"), "id"), _compare(threshold), "a long, b long, n long")
    found = C.written(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    component = CC.components(found.filter("b IS NOT NULL").select("a", "b"))
    member = C.split_join(rows.select("id", "h1", "h2"), grouped.select("h1", "h2", F.col("id").alias("node"), "mult"), ["h1", "h2"])
    member = C.split_join(C.split_join(member, counts, ["node"], "left"), component, ["node"], "left")
    member = member.groupBy(F.col("id").alias("__member")).agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("__links"), F.min(F.coalesce("component", "node")).alias("__component")
    )
    kept = [c for c in (keep or df.columns) if c not in ("n_links", "component_id", "kept")]
    own = F.col("__member")
    every = df.select(*[f"`{c}`" for c in kept], F.col(id_col).cast("long").alias("__member"))
    # rows without an id stay where they are, a repeated id may be split
    out = C.split_join(every.filter("__member IS NOT NULL"), member, ["__member"], "left")
    out = out.unionByName(every.filter("__member IS NULL").withColumns({"__links": F.lit(None).cast("long"), "__component": F.lit(None).cast("long")}))
    component_id = F.coalesce("__component", own)
    return out.select(*[f"`{c}`" for c in kept], F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == own, F.lit(True)).alias("kept"))
