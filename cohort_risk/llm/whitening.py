"""Embedding whitening by shifted CholeskyQR.

Entries c become whole numbers x = floor(scale * c) + offset. With A the rows
x - S/n (S the exact sums of all n rows):

1. A Gram pass adds up A'A: every task reduces its rows to one d x d matrix, Spark
   adds the entries up, d^2 numbers reach the driver.
2. The first factor R1 is the Cholesky factor of A'A plus a shift of the size of the
   Gram matrix's rounding error, so that it exists also where A is ill-conditioned.
3. Further passes orthogonalise again: tasks solve their rows through R1, R2, ...
   (triangular solves, A itself is never rewritten) and the Gram matrix of what
   comes out gives the next factor, until it is the identity to ``DONE``.
4. A = Q R with R the product of the factors and Q orthonormal, so the covariance's
   eigenvectors are the right singular vectors of the small R and its eigenvalues
   the squared singular values over n: the covariance itself, whose condition is
   the square of A's, is never decomposed.

Directions in which A has (numerically) no extent, such as constant dimensions or
more dimensions than rows, show as eigenvalues under ``NO_EXTENT`` of the second
Gram matrix (whose others lie near 1) and are left out there: they have no whitened
value, and there are fewer components.

Defined results: rows whose vector is null or holds null or non-finite entries are
dropped; shorter vectors are read as if they ended in zeros; repeated rows and ids
all count; a component's largest entry (the first of equals) is positive; entries
beyond a long's range count as its end; a deviation beyond it is null; without
extent in any direction, or on an empty table, the result is empty; extra columns
pass through, result columns of the input are replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
DONE = 1e-8
NO_EXTENT = 1e-12
MAX_PASSES = 8
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def _usable(v: Column) -> Column:
    big = F.lit(1.7976931348623157e308)  # NaN is larger than any number, infinities lie beyond
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (x >= -big) & (x <= big))


def whole_numbers(df: DataFrame, vector_col: str, keep: list[str], scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The ``keep`` columns and ``__x`` of the rows that take part."""
    rows = df.select(*[f"`{c}`" for c in keep], F.col(f"`{vector_col}`").cast("array<double>").alias("__v")).filter(_usable(F.col("__v")))
    # beyond 2^62 a double has no fraction to lose and the sum stays a long
    number = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-(2.0**62))), F.lit(2.0**62))) + F.lit(offset).cast("long")
    return rows.select(*[f"`{c}`" for c in keep], F.transform("__v", number).alias("__x"))


def _matrix(column, d: int, fill: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(len(column), d)
    x = np.full((len(column), d), fill, np.int64)
    x[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return x


def sums(rows: DataFrame, offset: int = OFFSET) -> tuple[int, list[int]]:
    """n and the exact sums by dimension."""

    def run(batches):
        n, at, total = 0, [], []
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            n += b.num_rows
            d = int(lengths.max(initial=0))
            total += [0] * (d - len(total))
            at += [0] * (d - len(at))
            x = _matrix(b.column(0), d, 0)
            for i in range(d):
                at[i] += int((lengths > i).sum())
                wide = x[:, i].astype(object) if np.abs(x[:, i].astype(float)).max(initial=0) > 2.0**48 else x[:, i]
                total[i] += int(wide.sum())
        if n:
            yield pa.RecordBatch.from_pydict({"i": [-1, *range(len(total))], "rows": [n, *at], "total": ["0", *map(str, total)]}, schema=pa.schema([("i", pa.int32()), ("rows", pa.int64()), ("total", pa.string())]))

    parts = C.map_arrow(rows.select("__x"), run, "i int, rows long, total string")
    found = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = found[-1]["rows"] if found else 0
    d = max(found, default=-1) + 1
    return n, [int(found[i]["total"]) + offset * (n - found[i]["rows"]) for i in range(d)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n: the whole part is taken off exactly, the rest is one rounding."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole).astype(float) - rest


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    whole, rest = np.array([s // n for s in total], np.int64), [s % n for s in total]
    far = x - whole
    if (n * (np.abs(far.astype(float)).max(initial=0) + 1)) ** 2 * max(x.shape[1], 1) < 2.0**62:
        y = n * far - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    y = far.astype(object) * n - np.array(rest, object)
    return [s if s < 2**63 else None for s in (y * y).sum(1).tolist()]


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of the factors, by triangular solves; a factor (upper, basis)
    first turns to the basis of the directions that have extent."""
    q = rows.T
    for upper, basis in factors:
        if basis is not None:
            q = basis.T @ q
        out = np.empty_like(q)
        for i in range(len(upper)):
            out[i] = (q[i] - upper[:i, i] @ out[:i]) / upper[i, i]
        q = out
    return q.T


def gram(rows: DataFrame, step, size: int, offset: int = OFFSET, d: int | None = None) -> np.ndarray:
    """Distributed Y'Y of the rows Y = step(x): one matrix per task, added up by Spark."""
    d = d or size
    shared = rows.sparkSession.sparkContext.broadcast(step)  # a few d x d matrices
    i, j = np.triu_indices(size)

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                y = shared.value(_matrix(b.column(0).slice(lo, 4096), d, offset))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = C.map_arrow(rows.select("__x"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in parts.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


class _Rows:
    """Centred rows, orthogonalised by the factors found so far (sent to the tasks)."""

    def __init__(self, n, total, factors):
        self.n, self.total, self.factors = n, total, list(factors)

    def __call__(self, x):
        return _solved(centred(x, self.n, self.total), self.factors)


class _Whitened:
    """Centred rows in whitened components, minus their mean where it is given."""

    def __init__(self, n, total, components, mean=None, ones=False):
        self.n, self.total, self.components, self.mean, self.ones = n, total, components, mean, ones

    def __call__(self, x):
        y = centred(x, self.n, self.total) @ self.components
        if self.mean is not None:
            y = y - self.mean
        return np.column_stack((y, np.ones(len(y)))) if self.ones else y


def fit(rows: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> dict | None:
    """n, sums, the d x k matrix that whitens, and the shares of variance."""
    n, total = sums(rows, offset)
    d = len(total)
    if not n or not d:
        return None
    factors, r = [], np.eye(d)
    for k in range(MAX_PASSES):
        size = len(r)
        g = gram(rows, _Rows(n, total, factors), size, offset, d)
        basis = None
        if k == 0:
            norm = float(np.linalg.eigvalsh(g)[-1])
            if norm <= 0:
                return None
            g = g + 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * norm * np.eye(d)
        elif k == 1:
            values, vectors = np.linalg.eigh(g)
            extent = values > NO_EXTENT
            if not extent.all():
                basis = vectors[:, extent]
                g = basis.T @ g @ basis
        off = float(np.abs(g - np.eye(len(g))).max())
        upper = np.linalg.cholesky(g).T
        r = upper @ (r if basis is None else basis.T @ r)
        if k >= 2 and off < DONE:
            break
        factors.append((upper, basis))
    _, sigma, right = np.linalg.svd(r)
    variance = sigma**2 / n
    k = min(components, len(sigma))
    vectors = right[:k]
    vectors = vectors * np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])[:, None]
    whitening = (vectors / np.sqrt(variance[:k])[:, None]).T
    model = {"n": n, "total": total, "components": vectors, "variance": variance, "whitening": whitening, "explained": variance[:k] / variance.sum()}
    # the covariance of what comes out, centred by its own mean
    sums_of = gram(rows, _Whitened(n, total, whitening, ones=True), k + 1, offset, d)
    cov = gram(rows, _Whitened(n, total, whitening, sums_of[k, :k] / n), k, offset, d) / n
    model["identity_error"] = float(np.abs(cov - np.eye(k)).max())
    return model


def whiten(df: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The ``keep`` columns (all by default) and a row per component: ``component``, ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    kept = [c for c in (keep or df.columns) if c not in RESULT]
    rows = whole_numbers(df, vector_col, kept, scale, offset)
    model = fit(rows, components, offset)
    kinds = zip(RESULT, ("int", "long", "long", "double", "double", "double"), strict=True)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in kinds))])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast({k: model[k] for k in ("n", "total", "whitening", "explained", "identity_error")})

    def run(batches):
        m = shared.value
        d, k = m["whitening"].shape
        step = _Whitened(m["n"], m["total"], m["whitening"])
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = _matrix(part.column(len(kept)), d, offset)
                y, n = step(x), len(x)
                again = pa.array(np.repeat(np.arange(n), k))
                columns = [c.take(again) for c in part.columns[:-1]]
                columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m["n"], np.int64))]
                columns += [pa.array(deviations(x, m["n"], m["total"]), pa.int64()).take(again), pa.array(y.reshape(-1))]
                columns += [pa.array(np.tile(m["explained"], n)), pa.array(np.full(n * k, m["identity_error"]))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return C.map_arrow(rows, run, schema)
