"""Embedding whitening by mixed-precision eigenvectors.

1. One pass gives sums, one the products of the centred vectors. Entries are integers and every product is summed exactly, so the
   covariance is the exact one, rounded once; it does not depend on the order of the rows.
2. The eigenvectors are first taken in single precision and then corrected by the matrix-multiplication iteration of Ogita and Aishima
   (2018) in extended precision. Each step squares the error of every pair of eigenvalues that lie far enough apart. Pairs
   closer than the error bound form clusters; a cluster's small matrix, shifted by its mean eigenvalue, is solved by itself (Ogita and
   Aishima 2019) and the iteration goes on, as the gaps inside the cluster now count against a much smaller error.
3. One pass projects the rows; two passes over the few projected numbers measure how white they are.

The driver holds matrices of the vector's length squared, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import sliced, stored

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Longest vectors; the driver's matrices have so many rows and columns.
MOST_LENGTH = 4096
#: Digits of 2 ** LIMB; products of two digits of LIMB_ROWS rows are exact in doubles.
LIMB, LIMB_ROWS = 20, 8192
#: Eigenvalues below this share of the trace are zero: such a component has no scale to be divided by.
ZERO = 1e-15
ROUNDS = 30


# --- rows ---


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their lengths, entries one after the other as x) of the vectors without a null, NaN or infinity."""
    lists = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(vectors.type) else vectors.cast(pa.large_list(pa.float64()))
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()  # without the entries of null lists
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.zeros(len(size), bool)
    np.logical_or.at(bad, row[~np.isfinite(c) | flat.is_null().to_numpy(zero_copy_only=False)], True)
    good = np.flatnonzero(~bad & ~lists.is_null().to_numpy(zero_copy_only=False) & (size > 0))
    kept = c[np.isin(row, good)]
    scaled = np.floor(kept * SCALE)
    if len(scaled) and np.abs(scaled).max() > 2.0**62:
        raise OverflowError(f"an entry times {SCALE} does not fit into a long")
    return good, size[good], scaled.astype(np.int64) + SHIFT


def _by_length(good, size, flat) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        mine = np.flatnonzero(size == d)
        yield int(d), good[mine], flat[(at[mine][:, None] + np.arange(d)).reshape(-1)].reshape(-1, d)


def _digits(d: np.ndarray) -> list[np.ndarray]:
    """Signed digits of integers to the base 2 ** LIMB, lowest first, as doubles; the highest that any entry needs is the last."""
    out = []
    while True:
        low = ((d + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        d = (d - low) >> LIMB
        if not d.any():
            return out


def gram(d: np.ndarray) -> np.ndarray:
    """d' d of integers, exactly (an array of Python integers)."""
    total = np.zeros((d.shape[1], d.shape[1]), object)
    for lo in range(0, len(d), LIMB_ROWS):
        digits = _digits(d[lo : lo + LIMB_ROWS])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


_PARTS = "d int, i int, n long, s decimal(38,0)"
_PARTS_ARROW = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])


def _parts(d: int, n: int, values) -> pa.RecordBatch:
    values = [Decimal(int(v)) for v in values]
    return pa.RecordBatch.from_arrays([pa.array([d] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([n] * len(values), pa.int64()), pa.array(values, pa.decimal128(38, 0))], schema=_PARTS_ARROW)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by length of vector: one row for every dimension and task."""
    have: dict[int, list] = {}
    for b in sliced(batches, LIMB_ROWS):
        for d, rows, x in _by_length(*integers(b.column(0))):
            t = have.setdefault(d, [0, np.zeros(d, object)])
            t[0] += len(rows)
            t[1] += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    for d, (n, s) in have.items():
        yield _parts(d, n, s)


def _products(length: int, centre: np.ndarray):
    """Upper triangle of the products of x - centre, row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((length, length), object), 0
        for b in sliced(batches, LIMB_ROWS):
            for d, rows, x in _by_length(*integers(b.column(0))):
                if d == length:
                    total, n = total + gram(x - centre), n + len(rows)
        if n:
            yield _parts(length, n, total[np.triu_indices(length)])

    return run


def exact_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(length, n, S): the most frequent length of vector (of equals the longest), the number of such vectors, and their sums."""
    t = stored(vectors.mapInArrow(_sums, _PARTS).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")))
    best = t.filter("i = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if best is None:
        return 0, 0, []
    if best.d > MOST_LENGTH:
        raise ValueError(f"vectors of {best.d} entries; at most {MOST_LENGTH}")
    return best.d, best.n, [int(r.s) for r in t.filter(F.col("d") == best.d).orderBy("i").select("s").collect()]


def covariance(vectors: DataFrame, length: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The exact covariance (divisor n) as extended-precision numbers, and the integer centre that was subtracted before multiplying."""
    centre = np.array([s // n for s in sums], np.int64)
    g = vectors.mapInArrow(_products(length, centre), _PARTS).groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()  # length squared / 2 numbers
    rest = [s - n * int(m) for s, m in zip(sums, centre, strict=True)]
    v = np.zeros((length, length), np.longdouble)
    for r, i, j in zip(g, *np.triu_indices(length), strict=True):
        v[i, j] = v[j, i] = _extended(n * int(r.s) - rest[i] * rest[j], n * n)
    return v, centre


def _extended(p: int, q: int) -> np.longdouble:
    hi = p / q
    return np.longdouble(hi) + np.longdouble(float(Fraction(p, q) - Fraction(hi)))


# --- eigenvectors ---


def _clusters(values: np.ndarray, bound) -> list[np.ndarray]:
    """Indices of eigenvalues that a chain of gaps of at most ``bound`` links, where there are two or more."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, in the precision of ``a`` (np.longdouble)."""
    size = len(a)
    norm = np.sqrt((a * a).sum())
    if not size or norm == 0:
        return np.zeros(size, a.dtype), np.eye(size, dtype=a.dtype)
    a = a / norm
    _, x = np.linalg.eigh(a.astype(np.float32))
    x, eye, eps = x.astype(a.dtype), np.eye(size, dtype=a.dtype), np.finfo(a.dtype).eps
    frobenius = lambda m: np.sqrt((m * m).sum())  # noqa: E731  an upper bound of the 2-norm
    solved, fresh = set(), False
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # the corrections of a pair then add up to what it lacks in orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (frobenius(s - np.diag(values)) + frobenius(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        if not fresh and np.abs(r).max() <= 4 * eps * np.sqrt(size) and np.abs(s - np.diag(np.diag(s))).max() <= 4 * eps * np.sqrt(size):
            break
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        fresh = False
        for c in _clusters(values, bound):
            # The sub-solve in double precision, of numbers as small as the cluster is wide.
            v = x[:, c]
            t = v.T @ (a @ v) - values[c].mean() * (v.T @ v)
            width = np.abs(t).max()
            if width > 0 and (key := (frozenset(c.tolist()), float(np.log2(width)) // 8)) not in solved:
                solved.add(key)
                x[:, c] = v @ np.linalg.eigh(((t + t.T) / (2 * width)).astype(np.float64))[1].astype(a.dtype)
                fresh = True
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order] * norm, x[:, order]


# --- whitening ---


def _project(length: int, n: int, centre: np.ndarray, rest: list[int], weights: np.ndarray):
    """Rows of (id, deviation, whitened). (n x - S) is n (x - centre) - rest, so the squares expand into three exact sums."""
    mean = np.array([r / n for r in rest])
    squares = sum(r * r for r in rest)
    odd = np.array(rest, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            for d, rows, x in _by_length(*integers(b.column(1))):
                if d != length:
                    continue
                y = x - centre
                if np.abs(y).max() < 1 << 24 and max(map(abs, rest), default=0) < 1 << 38:  # sums of 4096 products fit into 62 bits
                    two, one = (y * y).sum(1).astype(object), (y.astype(object) @ odd) if n > 1 << 26 else (y * np.array(rest, np.int64)).sum(1).astype(object)
                else:
                    two, one = (y.astype(object) ** 2).sum(1), y.astype(object) @ odd
                deviation = [Decimal(int(v)) for v in two * (n * n) - one * (2 * n) + squares]
                white = (y - mean) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * weights.shape[1], pa.int32()), pa.array(white.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(deviation, pa.decimal128(38, 0)), lists], ["id", "deviation", "white"])

    return run


def _white_sums(count: int, mean: np.ndarray | None):
    """Sums of the whitened numbers, or with ``mean`` of the products of what is left after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
            total = total + (w.sum(0) if mean is None else (w - mean).T @ (w - mean))
        if np.ndim(total):
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "s"])

    return run


def _collected(df: DataFrame, count: int, mean: np.ndarray | None) -> np.ndarray:
    t = df.select("white").mapInArrow(_white_sums(count, mean), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r.s for r in t])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict | None:
    """The model from a table of one column of vectors: length, n, sums, centre, eigenvalues, eigenvectors, trace; None without vectors."""
    length, n, sums = exact_sums(vectors)
    if not n:
        return None
    v, centre = covariance(vectors, length, n, sums)
    values, x = refined_eigenvectors(v)
    trace = np.trace(v)
    k = min(components, int((values > ZERO * trace).sum()))
    return {"length": length, "n": n, "sums": sums, "centre": centre, "values": values[:k], "vectors": x[:, :k], "trace": trace}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each whole vector and component.

    Vectors that are null, empty or hold a null, NaN or infinity go, and so do those whose length is not the most frequent one (of
    equals the longest). Repeated rows and null ids stay rows of their own. deviation is null where it does not fit into a long; deviation_exact has 38 digits. Components
    without variance (below ``ZERO`` of the trace) are not returned, so equal vectors, a single vector and an empty table give no row. Of equal
    eigenvalues any orthogonal components may come, the same for all rows. An entry past 2**52 is an error. Other columns are not carried,
    whatever their names.
    """
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    d = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    m = fit(d.select("v"), components)
    if m is None or not len(m["values"]):
        return rows.sparkSession.createDataFrame([], schema)
    k, n = len(m["values"]), m["n"]
    rest = [s - n * int(c) for s, c in zip(m["sums"], m["centre"], strict=True)]
    weights = (m["vectors"] / np.sqrt(m["values"])).astype(np.float64)
    run = _project(m["length"], n, m["centre"], rest, weights)
    out = stored(d.mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, deviation decimal(38,0), white array<double>"))
    mean = _collected(out, k, None) / n
    error = float(np.abs(_collected(out, k, mean).reshape(k, k) / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e / m["trace"])) for e in m["values"]])
    return out.select("id", "deviation", F.posexplode("white").alias("j", "whitened")).select(
        F.col("id").alias(id_col), (F.col("j") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("j")).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
