"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams,
scanned over the token windows of every document, each hash hit verified word
by word, then spans or whole documents removed.

A window is ``n`` consecutive words of an item; an item with fewer words (but
not none) is one window. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z. Benchmark words get small integer ids; a document word not
among them ends every window, so only runs of known words are hashed.

The benchmark is read in parts of at most ``PART_CHARS`` characters (one
unless the benchmark is larger; about 190 MB of memory while a part's windows are
built, 34 MB broadcast), each broadcast on its own, hits written before the next: repeated rows are
removed first, long items are cut into pieces that overlap by n - 1 words, and
parts are filled from hash buckets by their measured lengths. A document passes
through the scans of all parts in turn, one part in memory at a time, and adds up
its hits; it isn't shuffled.

Defined results: null or empty texts have no words and no hits; rows are judged
one by one, so repeated rows get equal results; benchmark rows with null text
have no window, rows sharing an item id count as one item, a null item id hits
but is not listed; an empty benchmark hits nothing; extra columns pass
through, and result columns of the input are replaced."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

NGRAM = 13
PART_CHARS = 2_000_000
RESULT = ("n_words", "n_hit", "hit_spans", "hit_items")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PRIME = np.uint64(0x100000001B3)


class Windows:
    """The windows of a part of the benchmark, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in C.words_of(text)]
            size = min(n, len(ids))
            found = by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        by_length.pop(0, None)
        self.sets = []
        for size, found in sorted(by_length.items()):
            grams = np.array(list(found), np.int64).reshape(len(found), size)
            hashes = self.hashes(grams, size)
            order = np.argsort(hashes, kind="stable")
            owners = list(found.values())
            self.sets.append((size, hashes[order], grams[order], [frozenset(owners[i]) for i in order]))

    @staticmethod
    def hashes(grams: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(grams), np.uint64)
        for j in range(size):
            h = (h ^ C.mix64(grams[:, j].astype(np.uint64))) * _PRIME
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Hit flags of the words, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, hashes, grams, owners in self.sets:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            seen = ids[at[:, None] + np.arange(size)]
            h = self.hashes(seen, size)
            first = np.searchsorted(hashes, h)
            last = np.searchsorted(hashes, h, "right")
            while len(at):  # more than one round only where hashes collide
                live = first < last
                at, seen, first, last = at[live], seen[live], first[live], last[live]
                same = (grams[first] == seen).all(1)
                for p, g in zip(at[same].tolist(), first[same].tolist(), strict=True):
                    hit[p : p + size] = True
                    items |= owners[g]
                first = first + 1
        return hit, items


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _pieces(words: list[bytes], n: int, chars: int) -> list[str]:
    """Texts of about ``chars`` bytes, at least n words, each window of n words in one."""
    out, lo = [], 0
    while True:
        hi, size = lo, 0
        while hi < len(words) and (hi - lo < n or size + len(words[hi]) < chars):
            size += len(words[hi]) + 1
            hi += 1
        out.append(b" ".join(words[lo:hi]).decode("utf-8", "surrogatepass"))
        if hi >= len(words):
            return out
        lo = hi - n + 1


def _parts(items: DataFrame, n: int, part_chars: int) -> list[DataFrame]:
    """The distinct (item, text) in parts of at most ``part_chars`` characters."""
    most = max(part_chars // 16, 1)

    def cut(batches):
        for b in batches:
            rows = [(i, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in (_pieces(C.words_of(t), n, most) if len(t) > most else [t])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["item", "text"])

    items = C.written(C.map_arrow(items.filter("text IS NOT NULL").distinct(), cut, "item string, text string").distinct(), "benchmark-items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= part_chars:
        return [items]
    buckets = 16 * -(-chars // part_chars)
    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(buckets))
    parts, size = [[]], 0
    for b, length in sorted(items.groupBy(bucket.alias("b")).agg(F.sum(F.length("text"))).collect()):
        if parts[-1] and size + length > part_chars:
            parts.append([])
            size = 0
        parts[-1].append(b)
        size += length
    return [items.filter((bucket >= p[0]) & (bucket <= p[-1])) for p in parts]


def find_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, part_chars: int = PART_CHARS) -> DataFrame:
    """``df`` with n_words, n_hit, hit_spans (array of start, end word numbers)
    and hit_items (sorted item ids as strings)."""
    spark = df.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kept = [c for c in df.columns if c not in RESULT]
    types = [T.StructField(c, df.schema[c].dataType) for c in kept]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    types += [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    out = df.select(
        *[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast(types[-2].dataType).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"),
    )
    at = kept.index(text_col)
    for number, part in enumerate(_parts(items, n, part_chars)):
        if number:
            out = C.written(out, "benchmark-hits")
        rows = part.collect()
        windows = spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in rows], n))

        def scan(batches, windows=windows):
            w = windows.value
            for b in batches:
                n_words, n_hit, spans, found = [], [], [], []
                for text, old, had in zip(b.column(at), b.column(len(kept) + 2), b.column(len(kept) + 3), strict=True):
                    words = C.words_of(text.as_py())
                    hit, items_hit = w.scan(words)
                    old = old.as_py()
                    for s in old:
                        hit[s["start"] : s["end"]] = True
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    spans.append(_spans(hit))
                    found.append(sorted({*had.as_py(), *(i for i in items_hit if i is not None)}))
                s_type = b.schema.types[len(kept) + 2]
                columns = [*b.columns[: len(kept)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, s_type), pa.array(found, b.schema.types[len(kept) + 3])]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

        out = C.map_arrow(out, scan, T.StructType(types))
    return out


def contaminated(min_share: int = 20):
    """A document is contaminated if it has hits and they are at least 1/``min_share`` of its words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))


def remove_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the hit word ranges out of the texts (a range goes from the first
    character of its first word to the last of its last)."""

    @F.pandas_udf(df.schema[text_col].dataType)
    def cut(texts, spans):
        out = texts.astype(object).copy()
        for i, (t, ss) in enumerate(zip(texts, spans, strict=True)):
            if t is not None and len(ss):
                raw = t.encode("utf-8", "surrogatepass")
                at = [m.span() for m in _WORD.finditer(raw.translate(C.WORD_BYTES))]
                kept, end = [], 0
                for s in ss:
                    kept.append(raw[end : at[s["start"]][0]])
                    end = at[s["end"] - 1][1]
                out.iloc[i] = b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")
        return out

    return df.withColumn(text_col, F.when(F.col("n_hit") > 0, cut(F.col(text_col), F.col("hit_spans"))).otherwise(F.col(text_col)))


def decontaminate(df: DataFrame, benchmark: DataFrame, action: str = "document", **kw) -> DataFrame:
    """``df`` without contaminated documents (``action="document"``) or with the
    hit spans cut out of every text (``action="span"``); columns as given."""
    hits = find_hits(df, benchmark, **kw)
    hits = hits.filter(~contaminated()) if action == "document" else remove_spans(hits, kw.get("text_col", "text"))
    return hits.select(*[f"`{c}`" for c in df.columns if c not in RESULT])
