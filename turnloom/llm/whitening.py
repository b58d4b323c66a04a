"""Whitening of embeddings by upper-triangle column aggregates.

Entries become integers x = floor(SCALE * c) + SHIFT, so counts and sums are exact. One aggregation has n and each
dimension's sum S; a second one has a Spark SQL expression for every pair of dimensions i <= j that sums the
products of the centred entries, each task for its rows and then over all tasks, so nothing but one row of
sums reaches the driver. LAPACK decomposes the covariance assembled from it, and tasks project
their rows. A last aggregation of the same expressions over the projected rows measures how far their
covariance is from the identity.

Entries are centred without loss: a dimension's whole mean is taken off as an integer, its rest as a double.

Defined results: rows whose vector is null, has null or non-finite entries, or entries whose x passes 52 bits are left
out, as are rows with fewer entries than the longest vector has; empty vectors have no components; repeated rows and null ids
count and are returned each; components whose eigenvalue isn't over RANK times the largest are left out, as
they hold rounding errors only (so one vector alone, or equal vectors, give no rows); a deviation beyond 64 bits
is null; an empty table gives an empty result; other columns aren't read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import table
from ._text import released

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this, times SCALE, are not told from infinity: x would lose bits.
MOST = float(1 << 52)
#: Eigenvalues up to this part of the largest are zero but for rounding.
RANK = 1e-12
#: Rows projected at a time.
ROWS = 2048


def valid(vectors: DataFrame) -> DataFrame:
    """vectors: id, v (array of numbers). Those whose entries are all finite."""
    fit = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False)) & ~F.isnan(c.cast("double")))
    return vectors.filter(F.col("v").isNotNull()).filter(fit)


def _entries(vectors: DataFrame, dims: int, whole: list[int], rest: list[float]) -> DataFrame:
    """Columns c0, c1, ...: x less the dimension's mean, whole and rest."""
    columns = [f"CAST(FLOOR({SCALE} * CAST(v[{k}] AS DOUBLE)) + {SHIFT} - ({whole[k]}L) AS DOUBLE) - ({rest[k]!r}D) AS c{k}" for k in range(dims)]
    return vectors.selectExpr(*columns)


def centred_products(columns: DataFrame, dims: int) -> np.ndarray:
    """Sums of ci * cj over all rows of columns c0, c1, ...: the upper triangle in one aggregation, as a symmetric matrix."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    sums = columns.agg(*[F.expr(f"SUM(c{i} * c{j})") for i, j in pairs]).first()
    out = np.zeros((dims, dims))
    for (i, j), s in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = s or 0.0
    return out


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Dimensions (of the longest vector), number of the vectors that have as many, and each dimension's sum of x."""
    first = vectors.select(F.size("v")).first()
    dims = first[0] if first else 0
    while True:
        full = F.size("v") == dims
        entry = lambda k: F.expr(f"SUM(CAST(IF(SIZE(v) = {dims}, FLOOR({SCALE} * CAST(v[{k}] AS DOUBLE)) + {SHIFT}, 0) AS DECIMAL(20, 0)))")  # noqa: E731, B023
        longest, n, *s = vectors.agg(F.max(F.size("v")), F.count_if(full), *[entry(k) for k in range(dims)]).first()
        if (longest or 0) <= dims:
            return dims, n, [int(x or 0) for x in s]
        dims = longest


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; of each the entry of largest size is positive."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    keep = np.flatnonzero((e > max(e[0], 0) * RANK) & (e > 0))[:most] if len(e) else np.zeros(0, int)
    v = v[:, keep]
    if len(keep):
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(keep))])
    return e[keep], v


def _deviations(steps: np.ndarray, n: int, s: list[int], whole: list[int]) -> pa.Array:
    """Exact sums of (n * x - S)^2 over the dimensions; steps: x less whole."""
    rest = [t - n * w for t, w in zip(s, whole, strict=True)]
    if len(steps) and steps.shape[1] * (n * (float(np.abs(steps).max()) + 1)) ** 2 < 2.0**62:
        d = n * steps.astype(np.int64) - np.array(rest, np.int64)
        return pa.array((d * d).sum(axis=1))
    sums = [sum((n * int(x) - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in steps]
    return pa.array([x if x < 1 << 63 else None for x in sums], pa.int64())


def project(vectors: DataFrame, n: int, s: list[int], weights: np.ndarray) -> DataFrame:
    """vectors: id, v. id, deviation and w, the centred entries times weights, as an array."""
    dims, many = weights.shape
    whole = [t // n for t in s]
    rest = np.array([(t - n * w) / n for t, w in zip(s, whole, strict=True)])
    names = ["id", "deviation", "w"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                steps = np.floor(SCALE * v) + SHIFT - np.array(whole, np.float64)
                w = np.ascontiguousarray((steps - rest) @ weights)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * many), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), _deviations(steps, n, s, whole), lists], names=names)

    return vectors.mapInArrow(released(run), f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component."""
    vectors = valid(embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")))
    dims, n, s = sums(vectors)
    vectors = vectors.filter(F.size("v") == dims)
    none = vectors.filter("false").select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if not n or not dims:
        return none
    whole = [t // n for t in s]
    covariance = centred_products(_entries(vectors, dims, whole, [(t - n * w) / n for t, w in zip(s, whole, strict=True)]), dims) / n
    e, v = components(covariance, most)
    if not len(e):
        return none
    projected = project(vectors, n, s, v / np.sqrt(e))
    # what is projected was centred; its means are rounding errors, and taken off all the same
    many = len(e)
    spread = projected.selectExpr(*[f"w[{k}] AS c{k}" for k in range(many)], "1D AS c%d" % many)
    products = centred_products(spread, many + 1) / n
    error = float(np.abs(products[:many, :many] - np.outer(products[many, :many], products[many, :many]) - np.eye(many)).max())
    explained = (e / np.trace(covariance)).tolist()
    of = F.array(*[F.lit(x) for x in explained])
    rows = projected.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", of[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
