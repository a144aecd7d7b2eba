"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become whole numbers x = floor(scale * c) + offset, packed into blocks that are one row
each, and sums S of each dimension are exact. Rows are centred as (n*x - S) / n, whose numerator is
a whole number, so the offset costs no digit.

A step multiplies the centred rows X by a right vector and the result by X transposed. Left vectors
have as many entries as there are rows, so none is stored: u = Xp for a p that is as long as one row,
and the products with all earlier left vectors come out of the same pass. Full reorthogonalisation
of left and right vectors therefore needs one distributed pass a step, of which the driver sees a
few sums as long as one row. The small bidiagonal matrix is decomposed on the driver.

Steps go on until the wanted values have settled to rounding. One start vector finds one component of
each value, so a second run, over what the found components leave, looks for a twin; if it finds a
value as large as one that was found, that takes part, and another run follows.

Defined results: vectors that are null, or hold null, NaN, infinity or an entry too large for a 64-bit x,
take no part, and of vectors of several lengths only those of the commonest (then shortest) do. Rows
without an id, repeated ids and repeated rows all count. A direction without deviation is no
component, so equal vectors, one vector and empty ones give no rows. A deviation past 64 bits is null.
Of equal eigenvalues any basis is taken, the same for all rows. Other columns are not looked at.
"""

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import small_batches
from ._vectors import NO_ID, id_numbers, ids_array, usable

EPS = float(np.finfo(float).eps)
LARGEST = 2.0**62
BLOCKS = "dim int, ids binary, x binary"


def blocks(scale: float, offset: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each Arrow batch of (id, vector): ids and whole-number vectors, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = id_numbers(batch)
            for dim, rows, vectors in usable(batch):
                with np.errstate(over="ignore"):
                    whole = np.floor(vectors * scale) + offset
                fits = (np.abs(whole) < LARGEST).all(axis=1)
                x = np.floor(vectors[fits] * scale).astype("<i8") + offset
                if fits.any():
                    small = "<i4" if np.abs(x).max(initial=0) < 2**31 else "<i8"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([ids[rows[fits]].astype("<i8").tobytes()]), pa.array([x.astype(small).tobytes()])],
                        ["dim", "ids", "x"],
                    )

    return run


def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole numbers of every block."""
    for batch in batches:
        for dim, ids, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "x"))):
            own = np.frombuffer(ids, "<i8")
            yield own, np.frombuffer(x, "<i4" if len(x) == 4 * dim * len(own) else "<i8").astype(np.int64).reshape(len(own), dim)


class Center(NamedTuple):
    """How many rows there are, and the exact sum of each dimension."""

    n: int
    sums: tuple[int, ...]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit numbers where they suffice, else of any size."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < 2**62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        apart = self.apart(x)
        if np.abs(apart.astype(float)).max(initial=0) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return (apart.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart.tolist()]
        return [v if v < 2**63 else None for v in exact]


def summed(table: DataFrame, partial: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray:
    """The sum of what ``partial`` makes of the rows of each task: one short vector reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = partial(x for _, x in unpack(batches))
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)), pa.int32()), pa.array(own)], ["k", "value"])

    parts = table.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value"))
    found = {r.k: r.value for r in parts.collect()}
    return np.array([found[k] for k in range(len(found))])


def center_of(table: DataFrame) -> Center:
    """Counts and sums, exact whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for _, x in unpack(batches):
            wide = int(np.abs(x).max(initial=0)) * max(1, len(x)) >= 2**62
            own = (x.astype(object) if wide else x).sum(axis=0)
            n, sums = n + len(x), [int(v) for v in own] if sums is None else [a + int(v) for a, v in zip(sums, own)]
        if n:
            digits = [str(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(digits)), pa.int32()), pa.array(digits)], ["k", "digits"])

    parts = table.mapInArrow(run, "k int, digits string").groupBy("k").agg(F.sum(F.col("digits").cast("decimal(38,0)")).alias("value"))
    found = {r.k: int(r.value) for r in parts.collect()}
    return Center(found.get(0, 0), tuple(found[k] for k in range(1, len(found))))


class Found(NamedTuple):
    """Right vectors as columns with their singular values, falling; and whether all directions were seen."""

    values: np.ndarray
    vectors: np.ndarray
    complete: bool


def across(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """What is left of ``v`` across the basis, in two rounds."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def bidiagonalise(table: DataFrame, center: Center, wanted: int, locked: list[np.ndarray], total: float, seed: int = 7) -> Found:
    """The largest ``wanted`` singular values across the ``locked`` vectors, each settled to rounding."""
    dim, rng = len(center.sums), np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v_j
    left: list[np.ndarray] = []  # p_j: u_j = X p_j
    images: list[np.ndarray] = []  # X^T u_j
    alphas, betas = [], []
    scale = np.sqrt(total)
    v = across(rng.standard_normal(dim), locked)
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        before = betas[-1] if betas else 0.0
        p = v - before * left[-1] if betas else v.copy()
        products = np.array([*left, p]).T

        def partial(parts: Iterator[np.ndarray], products=products) -> np.ndarray | None:
            total_ = None
            for x in parts:
                rows = center.rows(x)
                y = rows @ products
                own = np.concatenate([y.T @ y[:, -1], rows.T @ y[:, -1]])
                total_ = own if total_ is None else total_ + own
            return total_

        sums = summed(table, partial)
        shared, norm2, image = sums[: len(left)], sums[len(left)], sums[len(left) + 1 :]
        for own, other, back in zip(shared, left, images):
            p, image, norm2 = p - own * other, image - own * back, norm2 - own * own
        alpha = float(np.sqrt(max(norm2, 0.0)))
        if alpha > 4 * EPS * dim * scale:
            p, image = p / alpha, image / alpha
        else:  # this direction adds no new left vector
            alpha, p, image = 0.0, np.zeros(dim), np.zeros(dim)
        left.append(p)
        images.append(image)
        alphas.append(alpha)
        w = across(image - alpha * v, locked + right)
        beta = float(np.linalg.norm(w))
        if beta <= 4 * EPS * dim * scale:
            beta = 0.0
        bidiagonal = np.diag(alphas) + np.diag(betas, 1)
        ends, values, turned = np.linalg.svd(bidiagonal)
        complete = len(locked) + len(right) == dim
        settled = beta * np.abs(ends[-1, :wanted]) <= EPS * scale
        if complete or (len(values) >= wanted and beta > 0 and settled.all()):
            return Found(values, np.array(right).T @ turned.T, complete)
        if beta == 0:  # an invariant subspace: go on with another direction
            w = across(rng.standard_normal(dim), locked + right)
            beta_next, w = 0.0, w / np.linalg.norm(w)
        else:
            beta_next, w = beta, w / beta
        betas.append(beta_next)
        v = w


def principal(table: DataFrame, center: Center, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors as columns, eigenvalues (falling) of the covariance, and its trace."""
    dim = len(center.sums)

    def squares(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        own = [float((center.rows(x) ** 2).sum()) for x in parts]
        return np.array([sum(own)]) if own else None

    total = float(summed(table, squares)[0]) if dim and center.n else 0.0
    wanted = min(components, dim)
    if not total:
        return np.zeros((dim, 0)), np.zeros(0), 0.0
    values, vectors = np.zeros(0), np.zeros((dim, 0))
    while vectors.shape[1] < dim:
        kept = vectors.shape[1]
        run = bidiagonalise(table, center, 1 if kept else wanted, list(vectors.T), total, seed=7 + kept)
        more = len(run.values) if run.complete else 1 if kept else wanted
        least = values[wanted - 1] if kept >= wanted else -1.0
        values = np.concatenate([values, run.values[:more]])
        vectors = np.linalg.qr(np.hstack([vectors, run.vectors[:, :more]]))[0]
        if run.complete or (kept and run.values[0] < least * (1 - 1e-12)):
            break
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    some = values > 4 * EPS * max(dim, 8) * values[0]
    return vectors[:, some], values[some] ** 2 / center.n, total / center.n


def whiten(
    vectors: DataFrame,
    components: int = 8,
    scale: float = 1024,
    offset: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation`` (the sum of
    (n*x - S)^2), ``whitened`` (the centred projection over the component's deviation), ``explained`` (its share of
    the variance) and ``identity_error`` (how far the whitened rows' covariance is from the identity, at most)."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    table = settle(rows.mapInArrow(blocks(scale, offset), BLOCKS), "whitening")
    lengths = table.groupBy("dim").agg(F.sum(F.length("ids")).alias("size")).orderBy(F.desc("size"), "dim").first()
    table = table.where(F.col("dim") == (lengths.dim if lengths else 0))
    center = center_of(table)
    found, eigenvalues, trace = principal(table, center, components)
    k, projection = len(eigenvalues), found / np.sqrt(eigenvalues)

    def moments(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            y = center.rows(x) @ projection
            own = np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
            total = own if total is None else total + own
        return total

    error = 0.0
    if k:
        sums = summed(table, moments) / center.n
        covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])  # the mean is zero but for rounding
        error = float(np.abs(covariance - np.eye(k)).max())
    explained = eigenvalues / trace if k else eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in unpack(batches):
            if k:
                n = len(ids)
                columns = [
                    ids_array(np.repeat(ids, k)),
                    pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                    pa.array(np.full(n * k, center.n), pa.int64()),
                    pa.array([d for d in center.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array((center.rows(x) @ projection).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return table.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
