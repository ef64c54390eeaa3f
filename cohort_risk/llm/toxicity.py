"""Toxicity by compression distance: one zstandard dictionary of ordinary text
and two of toxic text; a window of a document is compressed with the ordinary
dictionary alone and with each toxic one in front of it, and the bytes saved
say how toxic the window is.

All compressors share the ordinary dictionary, so ordinary words cost the same
in each and the difference is close to zero on clean text. What the toxic
dictionaries hold is chosen by contrast: the pieces of words that occur in
significantly more contexts (distinct left neighbour and word; copies of a
document repeat contexts and so count once) in toxic than in ordinary windows.
One is trained on the stretches of such pieces; the other holds the toxic
words they occur in, whole: where a language builds its toxic words from
ordinary parts, a stretch alone saves nothing. A second round adds the words by which ordinary windows still gain to the
ordinary side. Thresholds and weights of a document's window figures are
calibrated by logistic regression on labelled documents that neither
dictionary has seen.

Training reads a bounded sample of the labelled rows: at most ``MAX_DOCS``
documents and ``MAX_WINDOWS`` windows of each class, by hash order (whole texts
are cut into windows). Scoring reads whole texts, window by window.

Defined results: null and empty texts have no window and score as such; rows
are scored one by one; null labels are not learned from, a document labelled
twice counts by its largest label; without documents of both classes on both
sides of the split the score is the share of label 1 (0 without labels); extra
columns pass through, a ``score`` of the input is replaced."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAX_DOCS = 6_000
MAX_WINDOWS = 100_000
WINDOW = 64
LEVEL = 6
#: Bounds of the dictionaries at every corpus size; what is listed is cut between words,
#: the least frequent first.
ORDINARY_BYTES, TOXIC_BYTES, WORD_BYTES, NEUTRAL_BYTES = 65_536, 2_048, 65_536, 16_384
PIECE, MIN_Z = 5, 3.0
_WORDS = re.compile(r"[^\W\d_]+")


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of whole lower-cased words of about ``size`` characters."""
    out, part, n = [], [], 0
    for w in _WORDS.findall((text or "").lower()):
        part.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(f" {' '.join(part)} ".encode())
            part, n = [], 0
    if part:
        out.append(f" {' '.join(part)} ".encode())
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def gains(ordinary, toxic, ws: list[bytes]) -> np.ndarray:
    a, b = ordinary.compress, toxic.compress
    return np.array([len(a(w)) - len(b(w)) for w in ws], float)


def _of_windows(g: np.ndarray) -> list[float]:
    top = np.sort(g)[::-1]
    sure = np.where(g >= 2, g, 0)
    return [min(top[0], 8.0), float(top[0] >= 2), float(top[0] >= 3), float(np.log1p(sure.sum())), float(10 * sure.mean()), float(10 * g.mean()), float(np.log1p(len(g)) * (top[0] >= 1))]


def window_figures(ordinary, toxic, words, text: str | None) -> list[float]:
    """What the calibration sees of a document, by the stretches and by the words."""
    ws = windows(text)
    if not ws:
        return [0.0] * 17
    plain = [len(ordinary.compress(w)) for w in ws]
    g, h = (np.array([n - len(c.compress(w)) for n, w in zip(plain, ws, strict=True)], float) for c in (toxic, words))
    spread = [float(10 * (h >= 1).mean()), float(10 * (h >= 2).mean()), float(np.clip(h.sum() / np.sqrt(len(h)), -8, 8))]
    return [*_of_windows(g), *_of_windows(h), *spread]


def _first(items, size: int) -> list[bytes]:
    """The first items whose length with separators stays within ``size``."""
    out, held = [], 1
    for x in items:
        held += len(x) + 1
        if held > size:
            break
        out.append(x)
    return out


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # the trainer refuses very few samples: whole samples, last ones first, are the dictionary
        return b"".join(reversed(_first(reversed(list(dict.fromkeys(samples))), size)))


def _contexts(ws: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Distinct (left neighbour, word)."""
    seen = set()
    for w in ws:
        words = w.split()
        seen.update(zip([b"", *words], words, strict=False))
    return seen


def _pieces(word: bytes) -> list[bytes]:
    s = b" " + word + b" "
    return [s[i : i + PIECE] for i in range(len(s) - PIECE + 1)]


def _marked(word: bytes, marked: set[bytes]) -> list[bytes]:
    """The stretches of a word that consist of marked pieces."""
    s, out, end = b" " + word + b" ", [], -1
    for i, p in enumerate(_pieces(word)):
        if p in marked:
            if i <= end:
                out[-1] += s[end : i + PIECE]
            else:
                out.append(p)
            end = i + PIECE
    return out


def _contributors(ws: list[bytes], ordinary, toxic) -> collections.Counter:
    """The words whose removal lowers a window's gain most."""
    out = collections.Counter()
    for w, g in zip(ws, gains(ordinary, toxic, ws), strict=True):
        if g >= 2:
            words = w.split()
            without = [b" " + b" ".join(words[:i] + words[i + 1 :]) + b" " for i in range(len(words))]
            out[words[int(gains(ordinary, toxic, without).argmin())]] += 1
    return out


def train_dictionaries(toxic_windows: list[bytes], ordinary_windows: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(ordinary, toxic, words) dictionary contents."""
    r = len(toxic_windows) / max(len(ordinary_windows), 1)
    ordinary = _train(ordinary_windows, ORDINARY_BYTES, 64, 8)
    contexts = _contexts(toxic_windows)
    here = collections.Counter(p for _, x in contexts for p in _pieces(x))
    there = collections.Counter(p for _, x in _contexts(ordinary_windows) for p in _pieces(x))
    marked = {p for p, k in here.items() if (k - r * there[p]) / np.sqrt(k + r * r * there[p] + 1) >= MIN_Z and k > 4 * r * there[p]}
    bag = [x for _, word in sorted(contexts) for x in _marked(word, marked)]
    random.Random(5).shuffle(bag)
    toxic = _train([b" " + b"  ".join(bag[i : i + 8]) + b" " for i in range(0, len(bag), 8)], TOXIC_BYTES, 24, 6)
    n = collections.Counter(word for _, word in contexts if _marked(word, marked))
    listed = _first(sorted(n, key=lambda x: (n[x], x), reverse=True), WORD_BYTES)
    words = b" " + b" ".join(reversed(listed)) + b" "  # the most frequent last
    a, neutral = compressor(ordinary), {}
    for content in (toxic, words):
        b = compressor(content + ordinary)
        good, bad = _contributors(toxic_windows, a, b), _contributors(ordinary_windows, a, b)
        neutral |= {x: max(k, neutral.get(x, 0)) for x, k in bad.items() if 2 * r * k > good[x] and not _marked(x, marked)}
    neutral = b" ".join(_first(sorted(neutral, key=lambda x: (-neutral[x], x)), NEUTRAL_BYTES))
    return ordinary + b" " + neutral + b" ", toxic, words


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (intercept first) by Newton's method, steps halved until the loss falls."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.r_[0, np.ones(x.shape[1] - 1)]

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        while (after := loss(w + step)) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w + step, after
    return w


def _cut_windows(batches):
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ws = list(dict.fromkeys(windows(text)))
            if ws:
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(ws), pa.int32()), pa.array(ws, pa.binary())], names=["y", "w"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> dict:
    """Dictionaries and calibration from the labelled documents of ``docs``."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.0
    if min(n.get(0, 0), n.get(1, 0)) == 0:
        return {"constant": share}
    sample = None
    for y in (0, 1):  # the smallest hashes of a class: at most max_docs ids, so they may be broadcast
        part = known.filter(F.col("__y") == y).orderBy(F.xxhash64(F.lit("toxicity"), F.col(id_col).cast("string")), id_col).limit(max_docs)
        sample = part if sample is None else sample.unionByName(part)
    side = F.pmod(F.xxhash64(F.lit("side"), F.col(id_col).cast("string")), F.lit(2)).alias("__side")
    texts = C.written(docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col).select("__y", "__text", side), "toxicity-sample")
    cut = C.map_arrow(texts.filter("__side = 0").select("__y", "__text"), _cut_windows, "y int, w binary").distinct()
    ws = {y: sorted(bytes(r["w"]) for r in cut.filter(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(max_windows).collect()) for y in (0, 1)}
    for w in ws.values():
        random.Random(1).shuffle(w)
    if not ws[0] or not ws[1]:
        return {"constant": share}
    model = dict(zip(("ordinary", "toxic", "words"), train_dictionaries(ws[1], ws[0]), strict=True))
    seen = _figures(texts.filter("__side = 1").select("__y", "__text"), "__text", model, keep=["__y"]).collect()
    y = np.array([r["__y"] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return {"constant": share}
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum()) * len(y) / sum(n.values())
    model["weights"] = _logistic(np.array([r["figures"] for r in seen]), y, weight)
    return model


def _figures(df: DataFrame, text_col: str, model: dict, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the window figures of the texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # three dictionaries of bounded size
    read = [*keep, *([] if text_col in keep else [text_col])]

    def run(batches):
        ordinary = shared.value["ordinary"]
        a, b, c = compressor(ordinary), compressor(shared.value["toxic"] + ordinary), compressor(shared.value["words"] + ordinary)
        for batch in batches:
            rows = [window_figures(a, b, c, t) for t in batch.column(read.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "figures"])

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("figures", T.ArrayType(T.DoubleType()))])
    return C.map_arrow(df.select(*[f"`{c}`" for c in read]), run, schema)


def score(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``score``, the calibrated probability of label 1."""
    kept = [c for c in (keep or df.columns) if c not in ("score", "figures")]
    if "constant" in model:
        return df.select(*[f"`{c}`" for c in kept], F.lit(float(model["constant"])).alias("score"))
    figures = _figures(df, text_col, {k: model[k] for k in ("ordinary", "toxic", "words")}, kept)
    z = F.lit(float(model["weights"][0]))
    for i, w in enumerate(model["weights"][1:]):
        z = z + F.col("figures")[i] * float(w)
    return figures.select(*[f"`{c}`" for c in kept], (1 / (1 + F.exp(-z))).alias("score"))
