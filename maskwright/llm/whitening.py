"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

A vector's entries c become whole numbers x = floor(1024 c) + 100000. With n vectors and sums S the centred rows are (n x - S) / n, where
n x - S is exact, so nothing cancels. For the matrix Y of these rows the steps build orthonormal u (as long as the table) and v (as long as a vector)
with Y V = U B, B upper bidiagonal:

1. p = Y v_j - beta u_(j-1), freed from all earlier u; alpha is its norm and u_j = p / alpha.
2. r = Y' u_j - alpha v_j, freed from all earlier v (twice); beta is its norm and v_(j+1) = r / beta.

Each u is Y w for a short vector w, so the long vectors are never stored: a task forms its rows of p and of all earlier u, and gives
U'p, p'p and Y'p of its rows. One pass over the table is one step, and what comes to the driver are as many numbers as a vector has entries and steps were done.
The singular values and vectors of the small B give the components (V times its right vectors) and deviations; a step's residual is the last
beta times the last entry of a left vector. When those of all wanted components are at rounding level, the run goes on from
a new direction for a few steps, so that equal eigenvalues aren't missed; it ends at the vectors' length at the latest.

Vectors that are null, hold null or non-finite entries or one whose x is beyond 2^62, or have another length than most (the shorter on a tie) are left out. Rows are
taken one by one: repeated and null vec_ids are rows of their own, other columns are ignored. Components with a deviation of 1e-12 of the largest or less
(none of n equal vectors has more) can't be scaled and aren't returned. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE, OFFSET = 1024, 100_000
CONFIRM = 8  # steps from a new direction after all residuals are at rounding level
SMALL = 1e-12


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): x has the whole numbers of a vector, 8 bytes each."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lists = lists.cast(pa.large_list(pa.float64()))
            sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
            flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())) if len(lists) else lists.values
            c = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * SCALE)
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(c) < 2.0**62)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.asarray(lists.is_valid()) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
            c[bad] = 0
            x = (c.astype(np.int64) + OFFSET)[keep[row]]
            ends = np.concatenate([[0], np.cumsum(sizes[keep] * 8)]).astype(np.int64)
            out = pa.Array.from_buffers(pa.large_binary(), int(keep.sum()), [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<i8"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), out.cast(pa.binary())], names=["vec_id", "x"])

    return embeddings.select("vec_id", vector).mapInArrow(convert, f"vec_id {kind}, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The whole numbers of a batch's rows."""
    column = column.cast(pa.large_binary())
    start = column.offset and int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    return np.frombuffer(column.buffers()[2], "<i8", count=len(column) * d, offset=start).reshape(-1, d)


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: Python's integers where longs don't suffice."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if most * n + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        shifted = _shifted(_matrix(column, len(self.sums)), self.n, self.sums)
        return shifted, (shifted / self.n).astype(float)

    def whitened(self, column: pa.Array) -> np.ndarray:
        return self.centred(column)[1] @ (self.components / np.sqrt(self.eigenvalues))


def _totals(vectors: DataFrame, part: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``part``, an array of one length: each task sums its own, the rest is a grouped sum by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + part(batch.column(0))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    rows = vectors.select("x").mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return np.array([r.s for r in sorted(rows, key=lambda r: r.pos)])


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            fits = x.size and int(np.abs(x).max()) * len(x) < 1 << 62
            total = total + (x.sum(axis=0) if fits else x.astype(object).sum(axis=0) if x.size else 0)
        values = [Decimal(n), *[Decimal(int(t)) for t in total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["pos", "s"])

    rows = vectors.select("x").mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s")).collect()
    found = [int(r.s) for r in sorted(rows, key=lambda r: r.pos)]
    return found[0], found[1:]


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the distributed matrix and their right vectors.

    product(w, W): with p = Y w and U = Y W, the numbers (U'p, p'p, Y'p) in one array.
    """
    random = np.random.default_rng(seed)
    vs, ws, ts = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas, confirmed, best = [], [], 0, None

    def fresh() -> np.ndarray:
        v = random.standard_normal(d)
        for _ in range(3):
            v = v - vs @ (vs.T @ v)
            v = v / np.linalg.norm(v)
        return v

    v, beta = fresh(), 0.0
    while True:
        k = vs.shape[1]
        w = v - beta * ws[:, -1] if k and beta else v
        out = product(w, ws)
        c, s, t = out[:k], out[k], out[k + 1 :]
        if k and c @ c > 1e-8 * s:  # much of p lay in earlier u: free the rest from them once more
            w, t = w - ws @ c, t - ts @ c
            again = product(w, ws)
            c, s, t = again[:k], again[k], again[k + 1 :]
        alpha = np.sqrt(max(s - c @ c, 0.0))
        scale = max([alpha, *alphas])
        vs = np.column_stack([vs, v])
        dead = alpha <= 1e-14 * scale or alpha == 0
        ws = np.column_stack([ws, np.zeros(d) if dead else (w - ws @ c) / alpha])
        ts = np.column_stack([ts, np.zeros(d) if dead else (t - ts @ c) / alpha])
        alphas.append(0.0 if dead else alpha)
        r = ts[:, -1] - alphas[-1] * v
        for _ in range(2):
            r = r - vs @ (vs.T @ r)
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        k = len(alphas)
        top = min(wanted, k)
        if k == d:
            break
        settled = k >= min(wanted, d) and np.all(beta * np.abs(left[-1, :top]) <= 1e-16 * values[0])
        if settled or confirmed:
            if best is not None and not np.allclose(values[:top], best, rtol=1e-12, atol=1e-14 * values[0]):
                confirmed = 0
            best = values[:top]
            confirmed += 1
        if confirmed > CONFIRM and settled:
            break
        if confirmed == 1 or beta <= 1e-14 * scale or dead:
            v, beta = fresh(), 0.0
        else:
            v = r / beta
        betas.append(beta)
    return values[:top], vs @ right[:top].T


def fit(vectors: DataFrame, wanted: int = 8) -> Whitening | None:
    """vectors: (vec_id, x) of one length, stored. None if nothing varies."""
    length = vectors.select(F.length("x").alias("k")).first()
    d = length.k // 8 if length else 0
    if not d:
        return None
    n, sums = _sums(vectors, d)
    own = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)

    def product(w: np.ndarray, ws: np.ndarray) -> np.ndarray:
        def part(column: pa.Array) -> np.ndarray:
            y = own.centred(column)[1]
            p = y @ w
            return np.concatenate([(y @ ws).T @ p, [p @ p], y.T @ p])

        return _totals(vectors, part)

    values, components = bidiagonalise(product, d, min(wanted, d))
    kept = values > SMALL * values[0]
    values, components = values[kept], components[:, kept]
    if not len(values):
        return None
    found = Whitening(n, sums, components, values**2 / n, values * 0, 0.0)
    k = len(values)

    def moments(column: pa.Array) -> np.ndarray:
        y = found.centred(column)[1]
        z = y @ (components / np.sqrt(found.eigenvalues))
        return np.concatenate([[(y * y).sum()], z.sum(axis=0), (z.T @ z).ravel()])

    total = _totals(vectors, moments)
    mean = total[1 : k + 1] / n
    covariance = total[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)
    found.explained = found.eigenvalues / (total[0] / n)
    found.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return found


def usual_length(vectors: DataFrame) -> DataFrame:
    """The vectors whose length is the commonest."""
    sizes = vectors.groupBy(F.length("x").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return vectors if sizes is None else vectors.filter(F.length("x") == sizes.k)


def whiten(embeddings: DataFrame, wanted: int = 8, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = usual_length(written(whole_numbers(embeddings, vector), "vectors"))
    model = fit(vectors, wanted)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k, n = len(model.eigenvalues), model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted, y = model.centred(batch.column(1))
            if shifted.dtype != object and float(np.abs(shifted).max(initial=0)) ** 2 * shifted.shape[1] >= 2.0**62:
                shifted = shifted.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (shifted * shifted).sum(axis=1)]
            rows = np.repeat(np.arange(len(y)), k)
            whitened = (y @ (model.components / np.sqrt(model.eigenvalues))).ravel()
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(rows), n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(rows)), pa.array(whitened), pa.array(np.tile(model.explained, len(y))), pa.array(np.full(len(rows), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(run, schema)
