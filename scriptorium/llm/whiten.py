"""Embedding whitening with a FEAST eigensolver.

Entries become whole numbers, so counts and sums are exact. The covariance matrix is summed in the tasks from centred
rows; it has a row for each dimension, and only it reaches the driver. Its leading eigenpairs come from contour
integrals: an interval of the spectrum is ringed by a circle, the resolvent is applied to a block of vectors at the
nodes of a Gauss-Legendre rule (a complex shifted solve each), the sum projects the block onto the eigenvectors inside,
and a Rayleigh-Ritz step extracts them; this is repeated until residuals are at the rounding level. How many
eigenvalues lie above a shift is the number of positive pivots of a symmetric indefinite factorisation (Sylvester's law
of inertia): bisection by such counts finds the interval ends, cuts the wanted part of the spectrum into intervals of a
few eigenvalues, and verifies that each interval gave as many as it holds.

Rows are projected where they are; a second pass over the table sums the covariance of what was projected, for the
error that each row reports.

Cases: null vectors and vectors with null, NaN or infinite entries go, and so do those with an entry past LARGEST,
whose sums would leave 64 bits, and those whose length is not the most frequent one (the longer of two as frequent),
which no covariance can take in; empty vectors have no components. Repeated rows, ties and null ids stay, each a row of
its own. Fewer dimensions give fewer components. A component without variance (an eigenvalue at the rounding level of
the largest) has a null `whitened`. `deviation` is null where it does not fit in 64 bits. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**20
#: Components; quadrature nodes on the half circle; eigenvalues of an interval; most refinements of it.
K, NODES, EACH, ROUNDS = 8, 16, 4, 60
TINY = np.finfo(float).eps


# The eigensolver: dense symmetric matrices of the size of a vector.


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: the inertia of its Bunch-Kaufman factorisation."""
    a = np.array(a, float)
    n, k, found = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8
    while k < n:
        col = np.abs(a[k + 1 :, k])
        r = k + 1 + int(col.argmax()) if len(col) else k
        most = col[r - k - 1] if len(col) else 0.0
        width = 1
        if abs(a[k, k]) < alpha * most:
            other = np.abs(a[r, k:])
            other[r - k] = 0
            far = other.max()
            if abs(a[k, k]) * far < alpha * most**2:
                width = 1 if abs(a[r, r]) >= alpha * far else 2
                to = k + width - 1
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if width == 1:
            d = a[k, k]
            if d != 0:
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
            found += d > 0
        else:
            block, c = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            found += 1  # a block of two is taken only where it is indefinite
        k += width
    return int(found)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v lie above a shift."""
    return positive_pivots(v - shift * np.eye(len(v)))


def intervals(v: np.ndarray, k: int, each: int = EACH) -> list[tuple[float, float, int]]:
    """Intervals (low, high, number) that together hold the k largest eigenvalues, or more where the k-th is tied.

    Ends come from bisection by inertia counts and lie in gaps of the spectrum; `each` eigenvalues share one at most, but for ties.
    """
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12) + 1e-300  # no eigenvalue is larger
    floor, least = -top * 1e-9, 4 * len(v) * TINY * top
    seen = {floor: len(v), top: 0}
    count = lambda s: seen.setdefault(s, above(v, s))

    def gap(want: int, low: float, high: float) -> float:
        """A shift with `want` eigenvalues above it and away from them; where a tie is in the way, just below it."""
        while count(low) > want and high - low > least:
            mid = (low + high) / 2
            if count(mid) < want:
                high = mid
            elif count(mid) > want:
                low = mid
            else:
                # Both edges of the gap, to an eighth of its width.
                up, down, left, right = mid, mid, low, high
                while right - up > (up - down) / 8 + least or down - left > (up - down) / 8 + least:
                    a, b = (up + right) / 2, (down + left) / 2
                    up, right = (a, right) if count(a) == want else (up, a)
                    down, left = (b, left) if count(b) == want else (down, b)
                return (up + down) / 2
        return low

    end = gap(min(k, len(v)), floor, top) if k < len(v) else floor
    found, high = [], top
    while count(end) > count(high):
        low = gap(count(high) + each, end, high) if count(end) - count(high) > each else end
        if count(low) == count(high):
            low = end
        found.append((low, high, count(low) - count(high)))
        high = low
    return found


def feast(v: np.ndarray, low: float, high: float, number: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and their vectors, as many as inertia has counted there."""
    d = len(v)
    rng = np.random.default_rng(seed)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (nodes + 1) / 2)  # the upper half; the lower is its conjugate
    mid, radius = (low + high) / 2, (high - low) / 2
    solve = [np.linalg.inv((mid + radius * z) * np.eye(d) - v) for z in turn]
    width = min(d, max(2 * number, number + 4))
    scale = max(abs(low), abs(high), TINY * float(np.abs(v).max()))
    while True:
        y, last = rng.standard_normal((d, width)), np.inf
        for _ in range(ROUNDS):
            q = sum((w / 2) * radius * (z * (s @ y)).real for w, z, s in zip(weights, turn, solve, strict=True))
            q, _ = np.linalg.qr(q)
            e, u = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz in the projected block
            y = q @ u
            inside = (e > low) & (e < high)
            rest = np.abs(v @ y[:, inside] - y[:, inside] * e[inside]).max(initial=0.0)
            if inside.sum() == number and (rest <= 64 * TINY * scale or rest <= 1e-11 * scale and rest > 0.5 * last):
                return e[inside], y[:, inside]
            last = rest
        if width == d:
            raise ArithmeticError(f"{number} eigenvalues counted between {low} and {high}, {int(inside.sum())} found")
        width = min(d, 2 * width)  # a crowded neighbourhood needs a wider block


def leading(v: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns."""
    k = min(k, len(v))
    size = float(np.abs(v).max(initial=0.0))
    if not k or not size:
        return np.zeros(k), np.eye(len(v), k)
    v = (v + v.T) / 2 / size
    parts = intervals(v, k)
    found = [feast(v, *part, seed=i) for i, part in enumerate(parts)]
    assert sum(len(e) for e, _ in found) == above(v, parts[-1][0])  # none is missed
    q, _ = np.linalg.qr(np.hstack([y for _, y in found]))  # vectors of neighbouring intervals, made orthogonal to the last bit
    e, u = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-e)[:k]
    return e[order] * size, (q @ u)[:, order]


# The table.


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that count, all of one length."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    left = vectors.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = left.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return left.filter(F.size("x") == (sizes[0].d if sizes else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("x"))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, d)


def _summed(rows: DataFrame, d: int, schema: str, add) -> DataFrame:
    """Sums over all rows of what `add` (a batch's matrix) gives, an array with a first axis: one partial sum a task, then by that axis and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(_matrix(batch, d))
                total = part if total is None else total + part
        if total is not None:
            flat = np.atleast_2d(total)
            i = np.repeat(np.arange(flat.shape[0]), flat.shape[1])
            j = np.tile(np.arange(flat.shape[1]), flat.shape[0])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(flat.ravel())], ["i", "j", "s"])

    return rows.select("x").mapInArrow(run, f"i int, j int, s {schema}").groupBy("i", "j").agg(F.sum("s").alias("s"))


def _collected(sums: DataFrame, shape: tuple[int, int], kind: type) -> np.ndarray:
    """A matrix of the size of a vector, from its entries."""
    out = np.zeros(shape, kind)
    pdf = sums.toPandas()
    out[pdf.i.to_numpy(), pdf.j.to_numpy()] = pdf.s.to_numpy()
    return out


def deviation(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; null past 64 bits."""
    far = n * x.astype(object) - total.astype(object) if n * 2**31 >= 2**63 else n * x - total
    near = (np.asarray(far, float) ** 2).sum(axis=1)
    if near.max(initial=0.0) < 9e18:
        return (far.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in far]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and leading component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, rows = vectors.sparkSession, usable(vectors)
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first or not first[0].d:
        return spark.createDataFrame([], schema)
    d = first[0].d
    sums = _collected(_summed(rows, d, "long", lambda x: np.concatenate([[len(x)], x.sum(axis=0)])), (1, d + 1), np.int64)[0]
    n, total = int(sums[0]), sums[1:].copy()
    whole, part = total // n, (total % n) / n  # the mean in two parts, so that centring keeps all its digits

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - part

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    v = _collected(_summed(rows, d, "double", products), (d, d), float) / n
    e, q = leading(v, k)
    trace = float(np.trace(v))
    live = e > d * TINY * max(float(e.max(initial=0.0)), 0.0)
    basis = np.where(live, q / np.sqrt(np.where(live, e, 1.0)), 0.0)
    m = len(e)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ basis
        return np.vstack([w.sum(axis=0), w.T @ w])

    got = _collected(_summed(rows, d, "double", moments), (m + 1, m), float) / n
    spread = got[1:] - np.outer(got[0], got[0])
    error = float(np.abs(spread - np.eye(m))[np.ix_(live, live)].max(initial=0.0))
    explained = e / trace if trace else np.zeros(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            w = centred(x) @ basis
            each = lambda a: np.tile(a, len(x))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m)))
            far = pa.array(deviation(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m)))
            cols = [ids, pa.array(each(np.arange(1, m + 1)).astype(np.int32)), pa.array(np.full(len(x) * m, n)), far, pa.array(w.ravel(), mask=~each(live)), pa.array(each(explained)), pa.array(np.full(len(x) * m, error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
