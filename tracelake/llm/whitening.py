"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows are rounded to integers, and every distinct vector counts once in the fit. For the centred fit rows X, the process builds orthonormal directions v of
the dimensions and unit columns u over the rows with X v_j = alpha_j u_j + (earlier u) and X^T u_j = alpha_j v_j + beta_j v_(j+1), so that U^T X V is upper
bidiagonal. A column u is as long as the table, so it is never stored: it is X y for a short vector y, and one Spark pass takes the products X y, row by row, and X^T (X y), summed
by task; what goes to the driver is one vector per task. Both sides are orthogonalised fully, twice: the v among themselves, the
u through their inner products U^T (X y) = Y^T X^T (X y). The singular values of the bidiagonal matrix are those of X, its right singular vectors turned by V the
components.

The process runs through all dimensions (up to ``EXACT`` of them; of more, until the leading components move by less than ``TOLERANCE`` of the largest
singular value), and begins anew with an orthogonal direction where it breaks down, so equal singular values and constant or dependent dimensions are found
too. A last pass measures the covariance of the whitened fit rows. Passes: one per step and two more, each over the stored fit table of integers, without a shuffle.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, also rows of a length other than the most frequent one (of
several, the greatest); entries beyond a 64-bit integer are rounded to its ends; a null id stays; repeated rows are repeated results; extra columns are ignored. Components
with no variance are not returned, so a table of one distinct vector, like an empty one, gives no rows. A ``deviation`` beyond a 64-bit integer is null.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches, stored

SCALE = 256
COMPONENTS = 4
EXACT = 64
TOLERANCE = 1e-13
#: A direction whose length falls below this share of the largest singular value counts as null.
NOTHING = 1e-11
SEED = 7
ROWS = 4096


def quantised(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the remaining rows as vectors of integers."""
    small = lambda c: F.abs(c.cast("double")) < F.lit(2.0**52)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    large = lambda c: F.when(c.cast("double") > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    x = F.transform(vector, lambda c: F.when(small(c), F.floor(F.when(small(c), c.cast("double") * SCALE).otherwise(F.lit(0.0)))).otherwise(large(c)))
    return rows.select(F.col(key).alias("vec_id"), x.alias("x"))


def as_matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def batches_of(batches, name: str = "x"):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        for s in range(0, len(column), ROWS):
            part = column.slice(s, ROWS)
            if len(part):
                yield as_matrix(part)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums of each dimension)."""

    def add(batches):
        n, sums = 0, None
        for x in batches_of(batches):
            big = np.abs(x.astype(np.float64)).max() >= 2**50
            part = [sum(c) for c in x.T.tolist()] if big else x.sum(0).tolist()
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]})

    found = fit.mapInArrow(add, "n long, sums array<string>").collect()
    return sum(r["n"] for r in found), [sum(int(v) for v in c) for c in zip(*(r["sums"] for r in found))]


def moments(fit: DataFrame, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For the columns Y of ``directions``: (X^T X Y, Y^T X^T X Y, trace of X^T X), over the centred rows X, in one pass."""
    width, d = directions.shape[1], len(mean)

    def add(batches):
        total = np.zeros(d * width + width * width + 1)
        for x in batches_of(batches):
            centred = x - mean
            u = centred @ directions
            total += np.concatenate([(centred.T @ u).reshape(-1), (u.T @ u).reshape(-1), [float((centred * centred).sum())]])
        yield pa.RecordBatch.from_pydict({"sums": [total.tolist()]})

    found = np.sum([r["sums"] for r in fit.mapInArrow(add, "sums array<double>").collect()], axis=0)
    return found[: d * width].reshape(d, width), found[d * width : -1].reshape(width, width), float(found[-1])


def orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` without its parts along an orthonormal basis, taken off twice."""
    if basis:
        b = np.stack(basis, 1)
        for _ in range(2):
            vector = vector - b @ (b.T @ vector)
    return vector


def bidiagonalise(fit: DataFrame, mean: np.ndarray, steps: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the centred rows, by Golub-Kahan-Lanczos."""
    random = np.random.default_rng(SEED)
    d = len(mean)
    v, y, g = [], [], []  # orthonormal directions; u_j = X y_j; g_j = X^T u_j
    upper = np.zeros((d, d))  # U^T X V
    start, largest = random.standard_normal(d), 0.0
    direction = start / np.linalg.norm(start)
    while len(v) < min(steps, d):
        k = len(v)
        v.append(direction)
        # X v without its parts along the earlier u: X (v - Y c), with c = U^T X v from the products known already
        c = np.array([gi @ direction for gi in g])
        now = direction - (np.stack(y, 1) @ c if k else 0)
        h, uu, _ = moments(fit, mean, now[:, None])
        h, square = h[:, 0], float(uu[0, 0])
        if k:
            again = np.stack(y, 1).T @ h  # U^T u: what rounding has left
            now, h, square = now - np.stack(y, 1) @ again, h - np.stack(g, 1) @ again, square - float(again @ again)
            c = c + again
        alpha = np.sqrt(max(square, 0.0))
        largest = max(largest, alpha)
        upper[:k, k] = c
        follow = np.zeros(d)
        if alpha > NOTHING * largest:
            upper[k, k] = alpha
            y.append(now / alpha)
            g.append(h / alpha)
            follow = orthogonal(g[-1], v)
        else:  # X v lies in the earlier u: no new column
            y.append(np.zeros(d))
            g.append(np.zeros(d))
        beta = float(np.linalg.norm(follow))
        largest = max(largest, beta)
        if len(v) == d:
            break
        if beta <= NOTHING * largest:
            follow = orthogonal(random.standard_normal(d), v)
            beta = 0.0
        direction = orthogonal(follow / np.linalg.norm(follow), v)
        direction = direction / np.linalg.norm(direction)
        if d > EXACT and len(v) > count:
            left, values, _ = np.linalg.svd(upper[: len(v), : len(v)])
            if (beta * np.abs(left[-1, :count])).max() <= TOLERANCE * values[0] and beta > 0:
                break
    k = len(v)
    _, values, right = np.linalg.svd(upper[:k, :k])
    return values, np.stack(v, 1) @ right.T


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component up to ``count``."""
    schema = f"vec_id {dict(embeddings.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = stored(quantised(embeddings, key, vector), "whitening-rows")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    rows = rows.where(F.size("x") == d)
    fit = stored(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    n, sums = totals(fit)
    mean = np.array([float(s / n) if abs(s) < 2**53 else float(Decimal(s) / n) for s in sums])
    values, components = bidiagonalise(fit, mean, d, count)
    some = [i for i in range(min(count, len(values))) if values[i] > NOTHING * max(values[0], 1e-300) and values[i] > 0]
    if not some:
        return spark.createDataFrame([], schema)
    w = components[:, some]
    _, gram, trace = moments(fit, mean, w)
    e = np.diag(gram) / n
    error = float(np.abs(gram / n / np.sqrt(np.outer(e, e)) - np.eye(len(some))).max())
    turned, explained, fewest = w / np.sqrt(e), (e * n / trace).tolist(), max(abs(s) for s in sums)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(1))
            k = turned.shape[1]
            if n * float(np.abs(x.astype(np.float64)).max()) + fewest < 2**31 / np.sqrt(d):  # squares and their sum stay in 64 bits
                far = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                far = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
                far = [f if f < 2**63 else None for f in far]
            place = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(place), n, np.int64)), pa.array(far, pa.int64()).take(pa.array(place)),
                    pa.array(((x - mean) @ turned).reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(place), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return short_batches(rows).mapInArrow(project, schema)
