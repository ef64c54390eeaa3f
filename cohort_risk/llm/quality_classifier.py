"""Quality classifier: regularised quadratic discriminant analysis over
transformed document statistics.

Every text is read once and reduced to ``FEATURES`` numbers. Class counts,
means and second moments are one grouped aggregate over all labelled rows
(partial sums in every task, one row per class at the driver). Covariances are
shrunk towards the pooled covariance and its diagonal; their Cholesky factors
are computed once, cached in the model, and a document's score is the logistic
of the difference of the two log densities (Mahalanobis distances through the
factors) plus the log prior odds.

Defined results: null and empty texts have the statistics of an empty
document and get a score; rows are scored one by one; null labels and labels of
unknown documents are not learned from, a document labelled twice counts by
its largest label; with fewer than two rows of a class the score is the share
of label 1 (0.5 without labels); extra columns pass through."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FEATURES = (
    "log_words", "log_word_length", "distinct_words", "repeated_neighbours", "distinct_trigrams", "upper_letters",
    "digits", "symbols", "decorated_words", "bare_symbols", "log_line_words", "distinct_lines", "sentence_marks", "top_word",
)
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-?]")
_MARKS = re.compile(r"[.,;:?]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d")
_DECORATED = re.compile(r"\S[!#$%&*+=@^~<>_|\\/]{2,}(?=\s|$)")


def _share(x: float, n: float) -> float:
    """A share, on a scale that spreads small values (empty parts count as 0)."""
    return float(np.log((x / n if n else 0.0) + 0.01))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    neighbours = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    length = sum(map(len, words))
    return [
        float(np.log1p(n)), float(np.log((length + 1) / (n + 1))), _share(n - len(counts), n), _share(neighbours, n - 1),
        _share(max(n - 2, 0) - trigrams, n - 2), _share(len(_UPPER.findall(text)), chars), _share(len(_DIGITS.findall(text)), chars),
        _share(len(_SYMBOLS.findall(text)), chars), _share(len(_DECORATED.findall(text)), n),
        _share(sum(1 for w in counts for _ in range(counts[w]) if not w[0].isalnum() and len(w) < 3), n),
        float(np.log1p(n / max(len(lines), 1))), _share(len(lines) - len(set(lines)), len(lines)), _share(len(_MARKS.findall(text)), n),
        _share(max(counts.values(), default=0), n),
    ]


def with_features(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``features``."""
    kept = [c for c in (keep or df.columns) if c != "features"]
    read = [*kept, *([] if text_col in kept else [text_col])]

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(read.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(rows, pa.list_(pa.float64()))], names=[*kept, "features"])

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return C.map_arrow(df.select(*[f"`{c}`" for c in read]), run, schema)


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Model from rows of ``features`` (id, features) labelled 0 or 1 in ``labels``."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    rows = features.select(id_col, "features").join(known, id_col)
    d = len(FEATURES)
    x = [F.col("features")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("__y").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
    found = {int(r["__y"]): r for r in sums.collect()}
    n = [found[y]["n"] if y in found else 0 for y in (0, 1)]
    if min(n) < 2:
        return {"constant": n[1] / sum(n) if sum(n) else 0.5}
    means, covs = [], []
    for y in (0, 1):
        m = np.array([found[y][f"s{i}"] for i in range(d)]) / n[y]
        cov = np.empty((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = found[y][f"p{i}_{j}"] / n[y] - m[i] * m[j]
        means.append(m)
        covs.append(cov)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    model = {"means": means, "factors": [], "log_odds": float(np.log(n[1] / n[0])), "log_det": []}
    for cov in covs:
        s = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(s)
        model["factors"].append(np.linalg.inv(factor))
        model["log_det"].append(2 * float(np.log(np.diag(factor)).sum()))
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for rows of features."""
    density = []
    for mean, inverse, log_det in zip(model["means"], model["factors"], model["log_det"], strict=True):
        z = (x - mean) @ inverse.T
        density.append(-0.5 * ((z * z).sum(1) + log_det))
    return density[1] - density[0] + model["log_odds"]


def score(features: DataFrame, model: dict) -> DataFrame:
    """``features`` without its feature column, with ``score`` in [0, 1]."""
    kept = [c for c in features.columns if c not in ("features", "score")]
    shared = features.sparkSession.sparkContext.broadcast(model)  # two 14 x 14 factors

    def run(batches):
        m = shared.value
        for b in batches:
            if "constant" in m:
                p = np.full(b.num_rows, m["constant"])
            else:
                x = np.array(b.column(len(kept)).to_pylist()).reshape(b.num_rows, len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(log_odds(m, x), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(p, pa.float64())], names=[*kept, "score"])

    schema = T.StructType([*(T.StructField(c, features.schema[c].dataType) for c in kept), T.StructField("score", T.DoubleType())])
    return C.map_arrow(features.select(*[f"`{c}`" for c in kept], "features"), run, schema)
