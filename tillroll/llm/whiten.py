"""Embedding whitening: principal components by contour integration.

Components become integers floor(256 c); the fit list holds every distinct
vector once. Tasks add up sums and then products of centred vectors; what
leaves a task is one number per dimension or pair of dimensions. The
eigenvectors of the covariance, a matrix of the embedding's width, come from
``feast``; one more pass over the fit list measures how far the whitened
vectors' covariance is from the identity, and a narrow pass over all rows
projects them.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite component (or one of 2^53 / 256 or more, no exact integer) take no
part, nor do rows whose length is not the most frequent one (the longer of
equally frequent). Repeated rows and ids stay rows of their own, null ids too.
An empty table, a single distinct vector or a dimension without variance gives
no row for the missing component (eigenvalues of at most 1e-12 of the largest
count as none). ``deviation`` is null where it does not fit into 64 bits,
``deviation_exact`` holds it to 38 digits and is null beyond. Eigenvectors of
equal eigenvalues are any orthonormal ones. Only the id and vector columns are
read, so no other column can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import field, written
from tillroll.llm.feast import largest

COMPONENTS = 4
SCALE = 256
MAX_WIDTH = 4096  # widest embedding: its covariance is held by the driver and every task
ROWS = 2048  # vectors handled at once


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` for the rows that take part."""
    v = F.col(f"`{vec_col}`")
    scaled = F.transform(v, lambda c: c.cast("double") * scale)
    fits = F.forall(scaled, lambda c: F.coalesce((F.abs(c) < 2.0 ** 53) & ~F.isnan(c), F.lit(False)))
    rows = (vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(fits & (F.size(v) > 0), scaled).alias("v"))
            .where("v is not null").select("vec_id", F.transform("v", lambda c: F.floor(c).cast("long")).alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return rows
    if usual["d"] > MAX_WIDTH:
        raise ValueError(f"vectors of {usual['d']} components; at most {MAX_WIDTH}")
    return rows.where(F.size("x") == usual["d"])


def _blocks(batches, rows: int = ROWS):
    """Arrow batches in slices with the matrix of their vectors."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            x = part.column("x")
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


@dataclass
class Model:
    """n, exact sums per dimension, eigenvalues (falling), unit eigenvectors as columns, trace, measured identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean()) @ (self.vectors / np.sqrt(self.values))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and exact sums per dimension."""
    def run(batches):
        n, total = 0, None
        for _, x in _blocks(batches):
            small = np.abs(x).max() < 2 ** 62 // ROWS
            s = (x if small else x.astype(object)).sum(axis=0)
            n, total = n + len(x), s.astype(object) if total is None else total + s
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()),
                 pa.array([Decimal(int(s)) for s in (n, *total)], pa.decimal128(38, 0))], names=["i", "s"])

    got = {r["i"]: int(r["s"]) for r in fit.select("x").mapInArrow(run, "i int, s decimal(38,0)")
           .groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = got.pop(-1, 0)
    return n, [got[i] for i in range(len(got))]


def _products(fit: DataFrame, of, d: int) -> np.ndarray:
    """Sum over the fit list of the products of all pairs of ``of(x)``'s columns, as a symmetric matrix."""
    at = np.triu_indices(d)

    def run(batches):
        total = None
        for _, x in _blocks(batches):
            y = of(x)
            total = y.T @ y + (0.0 if total is None else total)
        if total is not None:
            i, j = at
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[at])],
                                             names=["i", "j", "p"])

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["p"]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    """The model of the distinct vectors of ``integers`` rows."""
    distinct = written(rows.select("x").distinct(), "whiten")
    n, sums = _sums(distinct)
    d = len(sums)
    model = Model(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    if n < 2:
        return model
    mean = model.mean()
    cov = _products(distinct, lambda x: x - mean, d) / n
    model.values, model.vectors = largest(cov, components)
    model.trace = float(np.trace(cov))
    k = len(model.values)
    if k:
        # a last column of ones carries the sums, by which the products are centred
        both = _products(distinct, lambda x: np.hstack([model.whitened(x), np.ones((len(x), 1))]), k + 1) / n
        centred = both[:k, :k] - np.outer(both[:k, k], both[:k, k])
        model.identity_error = float(np.abs(centred - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum over dimensions of (n x - S)^2, exact."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if reach * reach * max(1, x.shape[1]) < 2 ** 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """Per row that takes part and component: ``vec_id, component, n, deviation,
    deviation_exact, whitened, explained, identity_error``."""
    rows = integers(vectors, id_col, vec_col, scale)
    model = fit(rows, components)
    k = len(model.values)
    share = model.values / model.trace if k else np.zeros(0)
    out = T.StructType([field(rows, "vec_id"), *[T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("deviation_exact", T.DecimalType(38, 0)),
        ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])

    def run(batches):
        for b, x in _blocks(batches):
            if not k:
                continue
            m = len(x)
            w = model.whitened(x)
            dev = _deviations(x, model.n, model.sums)
            where = pa.array(np.repeat(np.arange(m), k))
            narrow = pa.array([v if v < 2 ** 63 else None for v in dev], pa.int64())
            exact = pa.array([Decimal(v) if v < 10 ** 38 else None for v in dev], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(where), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), narrow.take(where), exact.take(where), pa.array(w.reshape(-1)),
                 pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))], names=out.names)

    return rows.mapInArrow(run, out)


def report(vectors: DataFrame) -> DataFrame:
    """Contract columns per row and component."""
    return whiten(vectors)
