r"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become integers ``x = floor(64 c) + 1000000``; the model is fitted on each distinct
x vector once. A task reduces its vectors, batch by batch, to a state: their number, exact
integer sums, and all singular values and right vectors of the centred block. Two states merge
by stacking their scaled vectors, and one further row
``sqrt(n_a n_b / (n_a + n_b)) (mean_a - mean_b)``, and decomposing anew: the stack has the same
scatter matrix as all vectors about their common mean, and as every dimension is kept, nothing
is lost. Merges go up a tree of :data:`FAN` states a group, so neither a task nor the driver
sees more than FAN matrices of d x d, however many vectors there are; the driver takes the
components that are asked for, d sums and d singular values.

Nothing is squared before it is centred: a block is shifted by an integer vector, exactly, and
differences of means come from integers, so the offset of 10^6 costs no digits. Components are
right singular vectors, that is unit eigenvectors of the covariance (divisor n), by falling
eigenvalue, with the largest entry positive. ``identity_error`` is measured: the whitened
vectors of the fit list go through the same kind of tree, as means and co-moments.

Defined cases: a vector that is null, empty or holds a null, a NaN, an infinity or an entry
whose x is beyond a long is dropped; of vectors of several lengths the commonest length is kept
(of equally common ones the longest); a component without variance (below the rounding of the
decomposition) can't be whitened and is left out, so equal vectors, one vector or none give no
rows; a deviation beyond a long is null; repeated rows give equal outputs; null ids stay; other
columns are kept by :func:`whiten` unless they are named like ``into``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.columns import unused_name
from linkweave.runtime import checkpoint_dir, remove, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: States that one merging task takes.
FAN = 8
#: Entries below this have an x that is a long.
BOUND = float(2**57 - 2**20)
#: Entries of a batch that a task decomposes at a time; a batch has four vectors a dimension at least.
BATCH_ENTRIES = 1 << 20
_INT64 = 2**63


def integer_vectors(vectors: DataFrame, vector: str, into: str) -> DataFrame:
    """``vectors`` with ``into`` (array of longs), less those that have none."""
    entry = lambda c: c.cast("double")
    good = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(entry(c)) < BOUND))
    x = F.transform(vector, lambda c: F.floor(entry(c) * SCALE) + OFFSET)
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))).withColumn(into, x)


def matrix(column: pa.Array, kind: str = "int64") -> np.ndarray:
    """A list column of equal lengths, without nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def integer_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(column) for column in x.T.tolist()]


@dataclass
class State:
    """Vectors so far: their number, exact sums, and their centred block's singular values and right vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        sums, n = integer_sums(x), len(x)
        base = [s // n for s in sums]
        # Python integers where a difference of longs could wrap
        wide = max((abs(b) for b in base), default=0) + int(np.abs(x.astype(np.float64)).max(initial=0)) >= 2**62
        near = (x.astype(object) - np.array(base, dtype=object) if wide else x - np.array(base, dtype=np.int64)).astype(np.float64)
        near -= np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
        _, values, vectors = np.linalg.svd(near, full_matrices=False)
        return cls(n, sums, values, vectors)

    def merge(self, other: State) -> State:
        n = self.n + other.n
        # one division of integers gives the difference of the means to full precision
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        correction = np.sqrt(self.n / n * other.n) * gap
        stack = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction[None, :]])
        _, values, vectors = np.linalg.svd(stack, full_matrices=False)
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], values, vectors)


@dataclass
class Moments:
    """Mean and co-moments about it, merged without a difference of large sums."""

    n: int
    mean: np.ndarray
    about: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        return cls(len(z), mean, (z - mean).T @ (z - mean))

    def merge(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.about + other.about + np.outer(gap, gap) * (self.n / n * other.n))


def tree_merge(rows: DataFrame, state: Callable[[np.ndarray], object]) -> object | None:
    """The merged state of all rows of ``rows.x``: per task, then up a tree of FAN states a merge.

    Each level is a written table in the shared checkpoint folder, so a lost executor costs the
    level it worked on; the folder is deleted at the end. None without rows.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    dumped = "part bigint, state binary"

    def row(part: int, found: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(found)], pa.binary())], names=["part", "state"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, entries = None, [], 0
        for batch in batches:
            column = batch.column("x")
            step = max(1, BATCH_ENTRIES // 4 // max(1, len(column.flatten()) // max(1, len(column))))
            for at in range(0, len(column), step):
                held.append(matrix(column[at : at + step]))
                entries += held[-1].size
                if entries >= max(BATCH_ENTRIES, 4 * held[0].shape[1] ** 2):
                    one = state(np.vstack(held))
                    total, held, entries = one if total is None else total.merge(one), [], 0
        if held:
            one = state(np.vstack(held))
            total = one if total is None else total.merge(one)
        if total is not None:
            yield row(TaskContext.get().partitionId(), total)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        states = [pickle.loads(s) for _, s in sorted(zip(table["part"].to_pylist(), table["state"].to_pylist(), strict=True))]
        return pa.Table.from_batches([row(key[0].as_py(), reduce(lambda a, b: a.merge(b), states))])

    try:
        level = written(rows.select("x").mapInArrow(reduced, dumped), f"{folder}/0")
        turn = 0
        while (most := level.agg(F.max("part").alias("most")).first()["most"]) not in (None, 0):
            turn += 1
            level = written(level.groupBy((F.col("part") / FAN).cast("bigint").alias("g")).applyInArrow(merged, dumped), f"{folder}/{turn}")
        found = level.select("state").first()
        return None if found is None else pickle.loads(found["state"])
    finally:
        remove(spark, folder)


@dataclass(frozen=True)
class Whitener:
    """What the driver keeps: sums, all eigenvalues, and the components that are asked for."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @classmethod
    def of(cls, state: State, most: int = COMPONENTS) -> Whitener:
        e = state.values**2 / state.n
        real = state.values > state.values.max(initial=0.0) * max(state.n, len(state.sums)) * np.finfo(np.float64).eps
        k = min(most, int(real.sum()))
        rows = state.vectors[:k]
        sign = np.where(rows[np.arange(k), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0) if k else np.zeros(0)
        return cls(state.n, tuple(state.sums), rows * sign[:, None], e[:k], float(e.sum()))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` less the mean, on the components, over the root of their eigenvalues."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s - self.n * (s // self.n)) / self.n for s in self.sums])
        near = x - base if np.abs(x.astype(np.float64)).max(initial=0) < 2**61 else (x.astype(object) - base.astype(object))
        return ((near.astype(np.float64) - rest) @ self.components.T) / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact: in longs where they fit, in Python integers where they may not."""
        sums = np.array(self.sums, dtype=object)
        rough = ((x.astype(np.float64) * self.n - sums.astype(np.float64)) ** 2).sum(axis=1)
        span = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        out: list[int | None] = [None] * len(x)
        easy = rough < 2.0**62 if span < 2.0**61 else np.zeros(len(x), bool)
        if easy.any():
            away = x[easy] * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            for i, d in zip(np.flatnonzero(easy).tolist(), (away * away).sum(axis=1).tolist(), strict=True):
                out[i] = d
        for i in np.flatnonzero(~easy).tolist():
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = exact if exact < _INT64 else None
        return out


def commonest_length(vectors: DataFrame, x: str) -> int | None:
    found = vectors.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return None if found is None else found["d"]


def fit(vectors: DataFrame, *, vector: str = "embedding", most: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct integer vectors; None where there are none.

    Distinct vectors are found by a grouping with map-side combine, so a vector that a third of
    the rows share is one row a task, and are written once for the fit and the check of it.
    """
    spark = vectors.sparkSession
    folder = f"{checkpoint_dir(spark)}/whitening-list-{uuid.uuid4().hex}"
    try:
        distinct = written(integer_vectors(vectors.select(vector), vector, "x").select("x").distinct(), folder)
        d = commonest_length(distinct, "x")
        if d is None:
            return None
        listed = distinct.where(F.size("x") == d)
        model = Whitener.of(tree_merge(listed, State.of), most)
        if not len(model.eigenvalues):
            return model
        shared = spark.sparkContext.broadcast(model)
        seen = tree_merge(listed, lambda x: Moments.of(shared.value.whitened(x)))
        error = float(np.abs(seen.about / seen.n - np.eye(len(model.eigenvalues))).max())
        return Whitener(model.n, model.sums, model.components, model.eigenvalues, model.trace, error)
    finally:
        remove(spark, folder)


def whiten(vectors: DataFrame, model: Whitener | None, *, vector: str = "embedding", into: str = "white") -> DataFrame:
    """The vectors that the model can take, with ``into``: deviation, and the whitened entries by component."""
    kind = "struct<deviation:bigint,whitened:array<double>>"
    x = unused_name(vectors, into)
    rows = integer_vectors(vectors, vector, x)
    if model is None:
        return rows.where("false").withColumn(into, F.lit(None).cast(kind)).drop(x)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            m = shared.value
            if not len(column):
                yield pa.array([], pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))
                continue
            values = matrix(column)
            white = m.whitened(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.reshape(-1)))
            yield pa.StructArray.from_arrays([pa.array(m.deviations(values), pa.int64()), lists], names=["deviation", "whitened"])

    return rows.where(F.size(x) == len(model.sums)).withColumn(into, run(F.col(x))).drop(x)


def whitening_report(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each kept vector and component: deviation, whitened entry, and the model's figures."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    model = fit(rows)
    shares = [] if model is None else (model.eigenvalues / model.trace).tolist()
    share: Column = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
    each = whiten(rows, model, into="w").select("vec_id", "w.deviation", F.posexplode("w.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(0 if model is None else model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(0.0 if model is None else model.identity_error).alias("identity_error"),
    )
