"""Whitening of embeddings by shifted CholeskyQR (operator 13).

Entries become whole numbers, so the sums are exact and rows are centred without
loss. Each pass over the rows adds up a Gram matrix in the tasks and in groups of
partial sums; the driver sees one matrix of dim x dim. Its Cholesky factor, of the
first pass with a shift that makes it positive whatever the data, turns the rows
into more nearly orthogonal ones by a triangular solve in the next pass, until the
Gram matrix is the identity. The product of the factors is the R of the centred
rows, and its singular vectors and values are the components: no product of raw
rows is ever decomposed, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from editpulse.llm.common import Scratch
from editpulse.session import configure

#: Fixed by the use: x = floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
COMPONENTS = 32
#: Gram passes at most; three are enough for rows of full rank.
PASSES, ORTHOGONAL = 6, 2.0**-40
#: Partial sums are added in so many groups, then once more; rows are made so many at a time.
GROUPS, ROWS = 32, 4096
UNIT = 2.0**-53
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    gram: np.ndarray | None = None
    done: bool = False
    to_white: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, and the rest of the sums."""
        whole, rest = np.divmod(self.sums, self.n)
        return x - whole, rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        near, rest = self.offsets(x)
        return near - rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; None where a long can't hold one."""
        near, rest = self.offsets(x)
        sizes = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            exact = ((self.n * near - rest) ** 2).sum(axis=1)
        return [int(e) if s < 2.0**62.9 else None for e, s in zip(exact, sizes)]

    def orthogonalised(self, x: np.ndarray) -> np.ndarray:
        rows = self.centred(x)
        for r in self.factors:
            rows = solved(rows, r)
        return rows

    def add_factor(self, gram: np.ndarray) -> None:
        """Take in a pass: the rows are orthonormal now, or get one more factor."""
        self.gram, dim = gram, len(gram)
        if np.abs(gram - np.eye(dim)).max() <= ORTHOGONAL or len(self.factors) == PASSES or not gram.any():
            self.done = True
            return
        shift = 11 * (self.n * dim + dim * (dim + 1)) * UNIT * np.linalg.norm(gram, 2)
        try:
            self.factors.append(np.linalg.cholesky(gram if self.factors else gram + shift * np.eye(dim)).T)
        except np.linalg.LinAlgError:  # the rows don't span all dimensions
            self.factors.append(np.linalg.cholesky(gram + shift * np.eye(dim)).T)

    def solve(self, most: int) -> None:
        """Components from the product of the factors; what the last Gram matrix lacks goes in by its square root."""
        values, vectors = np.linalg.eigh(self.gram)
        r = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
        for factor in reversed(self.factors):
            r = r @ factor
        _, singular, rows = np.linalg.svd(r)
        known = singular > max(singular[0], 2.0**-500) * len(r) * 2.0**-50
        total = (singular**2).sum()
        rows, singular = rows[known][:most], singular[known][:most]
        signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
        self.to_white = (rows * signs[:, None]).T / (singular / np.sqrt(self.n))
        self.explained = singular**2 / total

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.to_white


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The Q of rows = Q r, for an upper triangular r."""
    q = np.empty_like(rows)
    for j in range(len(r)):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Per length of vector: its ids and their x, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            vectors = rows.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                same = pa.array(lengths == dim)
                values = vectors.filter(same).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                whole = np.clip(np.floor(values * SCALE), -(2.0**53), 2.0**53)
                yield int(dim), rows.column("vec_id").filter(same), whole.astype(np.int64) + ORIGIN


def added(rows: pa.Table) -> pa.Table:
    """The sum of arrays of one length, in order of their parts."""
    rows = rows.sort_by("part")
    values = rows["values"].combine_chunks()
    total = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).sum(axis=0)
    return pa.table({"dim": rows["dim"][:1], "part": rows["part"][:1], "values": pa.array([total], values.type)})


def totals(vectors: DataFrame, measure: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """Per length: the sum over all rows of what ``measure`` gives for some of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), {}
        for dim, _, x in matrices(batches):
            value = measure(dim, x).ravel()
            sums[dim] = sums[dim] + value if dim in sums else value
        if sums:
            dims = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims, pa.int64()), pa.array([part] * len(dims), pa.int64()), pa.array([sums[d] for d in dims])], ["dim", "part", "values"]
            )

    schema = f"dim long, part long, values array<{kind}>"
    parts = vectors.mapInArrow(partial, schema)
    some = parts.groupBy("dim", F.pmod("part", F.lit(GROUPS))).applyInArrow(added, schema)
    return {r["dim"]: np.array(r["values"]) for r in some.groupBy("dim").applyInArrow(added, schema).collect()}


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Per length of vector: the components, and how far the whitened rows are from having the identity as covariance."""

    def count_and_sums(_: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0)])

    fits = {d: Fit(int(v[0]), v[1:].astype(np.int64)) for d, v in totals(vectors, count_and_sums, "long").items()}

    def gram(dim: int, x: np.ndarray) -> np.ndarray:
        q = fits[dim].orthogonalised(x)
        return q.T @ q

    def white_gram(dim: int, x: np.ndarray) -> np.ndarray:
        w = fits[dim].whitened(x)  # centred, as x is
        return w.T @ w

    while not all(f.done for f in fits.values()):
        for dim, matrix in totals(vectors, gram, "double").items():
            if not fits[dim].done:
                fits[dim].add_factor(matrix.reshape(dim, dim))
    for fit in fits.values():
        fit.solve(components)
    for dim, matrix in totals(vectors, white_gram, "double").items() if fits else ():
        k = len(fits[dim].explained)
        error = np.abs(matrix.reshape(k, k) / fits[dim].n - np.eye(k))
        fits[dim].identity_error = float(error.max()) if k else 0.0
    return fits


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out.
    Vectors of different length have no common covariance; those of each length are
    whitened among themselves (the driver holds a matrix of dim x dim for each).
    Components without variance, such as all of a single or repeated vector, can't
    be whitened and give no rows. Repeated and null vec_ids are rows like others.
    ``deviation`` is null where a long can't hold it; entries beyond 2**53 / 64 count
    as that. Other columns are ignored; an empty table gives no rows.
    """
    Scratch(embeddings.sparkSession, "whitening")
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("embedding"))
    vectors = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    fits = fitted(vectors, components)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, x in matrices(batches):
            fit = fits[dim]
            k, n = len(fit.explained), len(x)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, fit.n, np.int64)), pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.explained, n)), pa.array(np.full(n * k, fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, RESULT)


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
