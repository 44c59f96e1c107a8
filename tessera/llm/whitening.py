"""Whitening of embeddings: covariance by generated upper-triangle sums in one aggregation, components by LAPACK.

Vectors are put on a grid of whole numbers, so that sums and deviations are exact; the covariance is summed in doubles
over products of centred entries, one SQL expression for each pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, ship

#: Grid steps in a unit, and the number that stands for zero.
STEPS = 64
ZERO = 1_000_000
#: Pair sums of one aggregation: all pairs of 90 dimensions. Longer vectors take several.
PAIRS = 4096
#: Directions with less variance than this share of the largest are none: doubles cannot tell them from zero.
LEAST = 1e-10


def on_grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null and has finite entries only."""
    c = F.col("embedding").cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(c.isNotNull() & whole).select("vec_id", F.transform(c, lambda v: F.floor(STEPS * v).cast("long") + ZERO).alias("x"))


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n, of fit's columns x0, x1, ...: products of centred entries, summed pair by pair."""
    d = len(sums)
    centred = fit.select([((F.col(f"x{i}") * F.lit(n) - F.lit(s)) / F.lit(float(n))).alias(f"c{i}") for i, s in enumerate(sums)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = np.zeros((d, d))
    for lo in range(0, len(pairs), PAIRS):
        some = pairs[lo : lo + PAIRS]
        row = centred.selectExpr(*[f"sum(c{i} * c{j})" for i, j in some]).first()
        for (i, j), total in zip(some, row, strict=True):
            v[i, j] = v[j, i] = total / n
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, their unit eigenvectors as columns, their shares of the trace."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    some = int(np.count_nonzero(e[:most] > LEAST * max(e[0], 0.0)))
    u = u[:, :some]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(some)])
    return e[:some], u * sign, e[:some] / np.trace(v)


def _rows(b: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(b.column(at).flatten(), np.int64).reshape(b.num_rows, -1)


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each kept vector and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. The fit takes each distinct vector on the
    grid once; repeated rows and rows with null ids each get their own result. A shorter vector counts as having zeros
    at its end. Components are numbered by falling eigenvalue, with the largest entry of each positive; directions
    without variance (below 1e-10 of the largest eigenvalue) have no component, so one distinct vector, like an empty
    table, gives an empty result. Other columns are ignored. A deviation that no long holds is an error.

    What reaches the driver is a number for each pair of dimensions. Vectors are shuffled once, to find the distinct.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = on_grid(vectors)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(vectors.schema["vec_id"].dataType.simpleString())
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(ZERO).cast("long"), F.lit(d) - F.size("x"))))
    fit = durable(rows.select("x").distinct().select([F.col("x")[i].alias(f"x{i}") for i in range(d)]), "whitening-fit")
    n, *sums = fit.selectExpr("count(*)", *[f"sum(x{i})" for i in range(d)]).first()
    e, u, share = components(covariance(fit, n, sums), most)
    if not len(e):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((n, np.array(sums, np.int64), u / np.sqrt(e)))  # a number for each dimension and component

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, sums, turn = shared.value
        far = int(np.abs(x).max(initial=0))
        if far * n + int(np.abs(sums).max()) >= 1 << 63:
            raise OverflowError("n * x exceeds a long")
        off = n * x - sums
        if np.square(off.astype(np.float64)).sum(axis=1).max(initial=0) > 9.2e18:
            raise OverflowError("a deviation exceeds a long")
        return np.square(off).sum(axis=1), (off / n) @ turn

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, w = project(_rows(b, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["w"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deviation, w = project(_rows(b, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    k = len(e)
    again = fit.select(F.array(*[f"x{i}" for i in range(d)]).alias("x")).mapInArrow(of_fit, "w array<double>").select([F.col("w")[i].alias(f"w{i}") for i in range(k)])
    got = again.selectExpr(*[f"covar_pop(w{i}, w{j}) - {int(i == j)}D" for i in range(k) for j in range(i, k)]).first()
    error = float(max(abs(g) for g in got))
    out = rows.mapInArrow(of_rows, schema.split(",")[0] + ", deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.array(*map(F.lit, share.tolist())), F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
