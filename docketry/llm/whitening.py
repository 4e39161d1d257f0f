"""Embedding whitening by shifted CholeskyQR over distributed rows.

Entries become fixed-point integers. With n vectors, their sums S and the centred rows A (rows x - S/n), passes over the data
orthogonalise A: each pass adds up the Gram matrix of the rows after the triangular solves so far, whose Cholesky factor is
the next solve. The first factor is shifted, so that it exists whatever the condition of A; the later passes mend the loss of
orthogonality, until the Gram matrix is the identity. The factors multiply to R with A = QR, and the singular values and right
vectors of R are those of A: components and standard deviations without forming a covariance matrix, whose
eigenvalues would lose half of their digits.

Tasks send sums of their own rows: d entries for the means, d(d+1)/2 for a Gram matrix, and Spark adds them up by entry; no vector is
shuffled and the driver gets matrices of d x d only. The vectors are read again in each pass; tasks hold a batch of them.

Defined results: a vector that is null or holds null or non-finite entries is dropped, and so are empty vectors, vectors with an entry
whose fixed-point value has no exact double (2^52 and more), and vectors of another length than most have (ties: the longest). No vector
left: no rows. Components beyond the rank of the data (the same in all vectors, or the same combination of others) have null in
`whitened` and 0 in `explained`; identity_error leaves them out and is 0 if there are none. A deviation that doesn't fit a long is null.
Rows that repeat a vec_id, or have none, are vectors of their own. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ship

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Passes end when no entry of the Gram matrix is further from the identity, or after MAX_PASSES.
ORTHOGONAL, MAX_PASSES = 1e-12, 5
#: Rows that a task works on at once.
AT_ONCE = 4096
_EXACT = 2.0**52


@dataclass
class Whitening:
    """What the data give: number of vectors, sums of the fixed-point values without OFFSET (exact), right singular vectors (columns) and eigenvalues, all of them; the rank."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    rank: int


def fixed_point(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the valid vectors, their values floor(SCALE * c) as a matrix), of vectors with dims entries."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    own = column.take(pa.array(at))
    values = pc.fill_null(own.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE)
        good = (np.abs(values) < _EXACT).all(axis=1)  # false for nan and infinities, too
    return at[good], values[good].astype(np.int64)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of valid vectors by length."""
    for b in batches:
        column = b.column(0)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths > 0]).tolist():
            n = len(fixed_point(column, d)[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([n], pa.int64())], names=["dims", "n"])


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            values = fixed_point(b.column(0), dims)[1]
            n += len(values)
            # 2^52 a value and at most 2^11 values at a time
            for lo in range(0, len(values), 2048):
                total = [t + s for t, s in zip(total, values[lo : lo + 2048].sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(x) for x in (n, *total)])], names=["i", "s"])

    return run


def centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from integers without rounding before the division where they fit."""
    if n * (np.abs(values).max(initial=0) + 1) < 2**61:
        return (n * values - np.array(sums, dtype=np.int64)) / n
    return ((n * values.astype(object) - np.array(sums, dtype=object)) / n).astype(np.float64)


def deviations(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sums over the dimensions of (n*x - S)^2, as objects; None beyond a long."""
    d = n * values.astype(object) - np.array(sums, dtype=object)
    if n * (np.abs(values).max(initial=0) + 1) < 2**61:
        d = n * values - np.array(sums, dtype=np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2.0**62:
            return (d * d).sum(axis=1)
        d = d.astype(object)
    return np.array([x if x < 2**63 else None for x in (d * d).sum(axis=1)], dtype=object)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows @ inverse(factor) for an upper triangular factor, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram_part(dims: int, into: Callable[[np.ndarray], np.ndarray]):
    """The upper triangle of the Gram matrix of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                rows = into(fixed_point(b.column(0).slice(lo, AT_ONCE), dims)[1])
                if len(rows):
                    total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _gram(vectors: DataFrame, dims: int, size: int, into: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of all rows into(values), size x size."""
    parts = vectors.mapInArrow(_gram_part(dims, into), "i int, j int, v double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def factorise(dims: int, n: int, gram: Callable[[list[np.ndarray]], np.ndarray], max_passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values, falling) of the centred rows. gram(factors): the Gram matrix of the rows after the solves with factors."""
    u = np.finfo(float).eps / 2
    factors: list[np.ndarray] = []
    product, eye = np.eye(dims), np.eye(dims)
    while True:
        g = gram(factors)
        if factors and (np.abs(g - eye).max() <= ORTHOGONAL or len(factors) >= max_passes):
            break
        shift = 11 * (n * dims + dims * (dims + 1)) * u * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
        try:
            if not factors:
                g = g + shift * eye
            upper = np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:  # rows without full rank
            upper = np.linalg.cholesky(g + shift * eye).T
        factors.append(upper)
        product = upper @ product
    # what is left between the last rows and orthonormal ones
    w, v = np.linalg.eigh(g)
    _, values, right = np.linalg.svd((np.sqrt(np.maximum(w, 0))[:, None] * v.T) @ product)
    return right.T, values


def learn(vectors: DataFrame) -> Whitening | None:
    """The whitening of the column `v` of vectors; None if no vector is valid."""
    ship(vectors.sparkSession)
    first = vectors.mapInArrow(_lengths, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None
    dims = first["dims"]
    # sums of any size: Python's integers in a task, decimals between tasks
    own = vectors.mapInArrow(_sums(dims), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    of = {r["i"]: int(r["s"]) for r in own}
    n, sums = of[-1], [of[i] for i in range(dims)]

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def into(values: np.ndarray) -> np.ndarray:
            rows = centred(values, n, sums)
            for f in factors:
                rows = solved(rows, f)
            return rows

        return _gram(vectors, dims, dims, into)

    right, singular = factorise(dims, n, gram)
    rank = int((singular > singular.max(initial=0) * max(n, dims) ** 0.5 * dims * np.finfo(float).eps * 8).sum())
    # either sign would do: the largest entry is positive
    right = right * np.where(right[np.abs(right).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    return Whitening(n, sums, right, singular**2 / n, rank)


def whitener(model: Whitening, components: int) -> Callable[[np.ndarray], np.ndarray]:
    """Fixed-point values to whitened rows, of the components within the rank."""
    m = min(components, model.rank)
    to = model.vectors[:, :m] / np.sqrt(model.values[:m])
    return lambda values: centred(values, model.n, model.sums) @ to


def _rows(model: Whitening, components: int, error: float):
    dims = len(model.sums)
    k, white = min(components, dims), whitener(model, components)
    share = np.where(np.arange(dims) < model.rank, model.values, 0)[:k] / max(model.values.sum(), np.finfo(float).tiny)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                at, values = fixed_point(part.column(0), dims)
                if not len(at):
                    continue
                y = np.full((len(at), k), np.nan)
                y[:, : min(k, model.rank)] = white(values)
                y = y.reshape(-1)
                cols = {
                    "vec_id": part.column(1).take(pa.array(np.repeat(at, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    "n": pa.array(np.full(len(y), model.n)),
                    "deviation": pa.array(np.repeat(deviations(values, model.n, model.sums), k), pa.int64()),
                    "whitened": pa.array(y, mask=np.isnan(y)),
                    "explained": pa.array(np.tile(share, len(at))),
                    "identity_error": pa.array(np.full(len(y), error)),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component."""
    vectors = embeddings.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("vec_id"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = learn(vectors.select("v"))
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    m, error = min(components, model.rank), 0.0
    if m:
        # measured on the rows as they are returned; they are centred, as all of the fit list are
        cov = _gram(vectors.select("v"), len(model.sums), m, whitener(model, components)) / model.n
        error = float(np.abs(cov - np.eye(m)).max())
    return vectors.mapInArrow(_rows(model, components, error), schema)
