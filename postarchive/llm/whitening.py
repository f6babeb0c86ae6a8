"""Embedding whitening by shifted CholeskyQR.

An entry ``c`` becomes the integer ``floor(SCALE * c) + OFFSET``, so sums are exact.
Rows are centred exactly, ``(n * x - S) / n``, and never multiplied before.  Then passes
over the rows orthogonalise them: a pass solves the rows by the triangular factors found
so far, sums their Gram matrix over all tasks, and its Cholesky factor is the next one.
The first Gram matrix gets a small shift, so that its factor exists however ill
conditioned the vectors are; the passes after it remove what the shift left.  The
factors' product R has the singular values and right vectors of the centred rows: its
singular value decomposition on the driver, of one small matrix, gives the components.
Squaring happens only where rows are near to orthogonal, so small components keep the
precision that a covariance matrix would lose.

What leaves a task is a Gram matrix (dimensions squared), summed by Spark entry by
entry; what reaches the driver is one such matrix for each pass.

Defined cases: NULL vectors and those with a NULL or non-finite entry are dropped, as are
vectors without entries, of another length than most (of equally many the longest), or
with an entry whose integer
needs more than 62 bits.  Repeated ids are rows of their own; a missing id stays.
Directions without variance have no unit variance to be given: they are no components,
so equal vectors, or a single one, give no rows.  A ``deviation`` beyond 64 bits is
NULL.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postarchive.llm.common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
PASSES = 8
EXACT = 1e-12  # Gram matrices this near to the identity need no further pass
LIMIT = 1 << 62  # of an entry times SCALE: beyond, it has no 64-bit integer
UNIT = np.finfo(np.float64).eps / 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows of ``vectors`` (vec_id, embedding) that remain."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LIMIT // SCALE))))
    rows = vectors.select("vec_id", entries.alias("v")).where("v IS NOT NULL AND size(v) > 0").where(fine)
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET))
    rows = written(rows.select("vec_id", whole.alias("x")), "whitening-vectors")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, exact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                # Python's integers where 64 bits are too few.
                wide = len(x) * float(np.abs(x).max()) >= 2.0**62
                part = np.array([int(s) for s in (x.astype(object) if wide else x).sum(0)], object)
                n, sums = n + len(batch), part if sums is None else sums + part
        if n:
            yield pd.DataFrame({"at": np.arange(len(sums)), "n": n, "total": [str(s) for s in sums]})

    found = rows.select("x").mapInPandas(run, "at int, n long, total string").groupBy("at")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    sums = found.agg(F.sum("n").alias("n"), total.alias("total")).orderBy("at").collect()
    return (sums[0]["n"], [int(r["total"]) for r in sums]) if sums else (0, [])


@dataclass
class Centre:
    """n and the sums S of the fit list; rows are centred as (n * x - S) / n."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers; Python's own where 64 bits are too few."""
        largest = int(np.abs(x).max(initial=0))
        if max(map(abs, self.sums)) + self.n * largest >= 1 << 63:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; None beyond 64 bits."""
        y = self.scaled(x)
        if x.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
            return (y * y).sum(1).tolist()
        found = [sum(int(c) ** 2 for c in row) for row in y]
        return [s if s < 1 << 63 else None for s in found]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inv(factor)`` for an upper triangular factor, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, make, d: int) -> np.ndarray:
    """The Gram matrix of ``make(x)`` over all rows: tasks' matrices, summed entry by entry."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                part = make(matrix(batch["x"]))
                total += part.T @ part
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "v": total[upper]})

    found = rows.select("x").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for i, j, v in found.collect():  # d * (d + 1) / 2 entries
        out[i, j] = out[j, i] = v
    return out


def square_root(gram_matrix: np.ndarray) -> np.ndarray:
    """A factor R with R' R the matrix, also where it is singular."""
    values, vectors = np.linalg.eigh(gram_matrix)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def triangular_factor(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R with R' R the Gram matrix of the centred rows."""
    d = len(centre.sums)
    factors: list[np.ndarray] = []
    for number in range(PASSES):

        def orthogonalised(x: np.ndarray, factors=tuple(factors)) -> np.ndarray:
            out = centre(x)
            for factor in factors:
                out = solved(out, factor)
            return out

        g = gram(rows, orthogonalised, d)
        if not np.trace(g):
            return np.zeros((d, d))
        near = number and np.abs(g - np.eye(d)).max() <= EXACT
        shift = 0.0 if number else 11 * (centre.n * d + d * (d + 1)) * UNIT * float(np.trace(g))
        try:
            # However large the shift's bound is, more than this is never needed.
            factor = np.linalg.cholesky(g + min(shift, 1e-6 * float(np.trace(g))) * np.eye(d)).T
        except np.linalg.LinAlgError:
            factor = None
        if factor is None or near or number == PASSES - 1:
            factors.append(square_root(g))
            break
        factors.append(factor)
    product = np.eye(d)
    for factor in factors:
        product = factor @ product
    return product


@dataclass
class Whitening:
    """Components by falling variance: unit vectors (columns), variances and their shares."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components / np.sqrt(self.variances)


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (x), or None without any variance."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    centre, d = Centre(n, sums), len(sums)
    _, singular, vectors = np.linalg.svd(triangular_factor(rows, centre))
    rank = int((singular > singular[0] * max(n, d) * 2 * UNIT).sum()) if singular[0] > 0 else 0
    if not rank:
        return None
    variances, k = singular**2 / n, min(rank, most)
    return Whitening(centre, vectors[:k].T.copy(), variances[:k], variances[:k] / variances.sum())


def identity_error(rows: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(whitening.variances)
    found = gram(rows, whitening.apply, k) / whitening.centre.n
    return float(np.abs(found - np.eye(k)).max())


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(spark: SparkSession, vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    rows = usable(vectors)
    model = fit(rows, most)
    if model is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(rows, model)

    @F.pandas_udf("deviation long, whitened array<double>")
    def projected(x: pd.Series) -> pd.DataFrame:
        data = matrix(x)
        deviation = pd.array(model.centre.deviations(data), "Int64")
        return pd.DataFrame({"deviation": deviation, "whitened": list(model.apply(data))})

    share = F.array(*map(F.lit, model.explained.tolist()))
    found = rows.select("vec_id", projected("x").alias("found"))
    each = found.select("vec_id", "found.deviation", F.posexplode("found.whitened").alias("at", "whitened"))
    return each.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
