"""Fronts of rows that no other row beats, in any number of dimensions, without comparing all rows with all."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import store

#: Rows that a task holds as its own front before it gives them up as candidates, and candidates compared at once.
HELD = 20_000
BLOCK = 4096
#: Cells that the candidates are dealt to, at most.
CELLS = 256


def beaten(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of x some row of `by` matches everywhere and exceeds somewhere."""
    out = np.zeros(len(x), bool)
    step = max(1, 4_000_000 // max(1, len(by) * x.shape[1]))
    for i in range(0, len(x), step):
        a = x[i : i + step, None, :]
        out[i : i + step] = ((by[None] >= a).all(axis=2) & (by[None] > a).any(axis=2)).any(axis=1)
    return out


def _merge(front: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x[np.argsort(-x.sum(axis=1), kind="stable")]
    for i in range(0, len(x), 512):  # the strongest first, so that most of the rest falls to few
        some = x[i : i + 512]
        some = some[~beaten(some, front)] if len(front) else some
        some = some[~beaten(some, some)]
        front = np.concatenate([front[~beaten(front, some)], some]) if len(front) else some
    return front


def _local(values: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of values that no other row of their task beats; all of the front of values are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = np.zeros((0, len(dims)))
        give = lambda f: pa.RecordBatch.from_arrays([pa.array(f[:, i]) for i in range(len(dims))], dims)
        for b in batches:
            front = _merge(front, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if len(front) > HELD:
                yield give(front)
                front = front[:0]
        yield give(front)

    return values.mapInArrow(run, ", ".join(f"{d} double" for d in dims))


def _global(local: DataFrame, dims: list[str]) -> DataFrame:
    """The front of what the tasks left.

    Candidates are dealt to cells by a few cuts a dimension. A cell below another one in every dimension falls as a
    whole; of the others only pairs that may beat each other meet, in blocks of bounded size.
    """
    spark = local.sparkSession
    per = max(2, int(CELLS ** (1 / len(dims)) + 1e-9)) if len(dims) <= 8 else 2
    cut = dims[:8]
    cuts = local.approxQuantile(cut, [i / per for i in range(1, per)], 0.01)
    cell = F.lit(0)
    for d, q in zip(cut, cuts, strict=True):
        # a value equal to a cut stands above it, so a higher place is a higher value
        cell = cell * per + sum(((F.col(d) >= v).cast("int") for v in sorted(set(q))), F.lit(0))
    path = store.scratch(spark, "front")
    local.withColumn("cell", cell).withColumn("h", F.xxhash64(*dims)).write.parquet(path)
    x = spark.read.parquet(path)
    count = {r.cell: r["count"] for r in x.groupBy("cell").count().collect()}  # CELLS rows at most
    places = {c: p for c, p in ((sum(v * per ** (len(cut) - 1 - i) for i, v in enumerate(p)), p) for p in product(range(per), repeat=len(cut))) if c in count}
    alive = [c for c, p in places.items() if not any(all(a > b for a, b in zip(q, p, strict=True)) for q in places.values())]
    blocks = {c: -(-count[c] // BLOCK) for c in alive}
    width = F.element_at(F.create_map(*[F.lit(v) for c in alive for v in (c, blocks[c])]), F.col("cell"))
    x = x.filter(F.col("cell").isin(alive)).withColumn("block", F.pmod("h", width).cast("int"))
    meet = [(a, b) for a in alive for b in alive if all(p >= q for p, q in zip(places[a], places[b], strict=True))]
    pairs = spark.createDataFrame([(a, b, blocks[a], blocks[b]) for a, b in meet], "a int, b int, na int, nb int")  # CELLS squared at most
    # a block goes to every block of the cells that it may beat, and waits for every block that may beat it
    to = x.join(F.broadcast(pairs), F.col("cell") == F.col("a")).select(*dims, "a", "b", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("beats"))
    at = x.join(F.broadcast(pairs), F.col("cell") == F.col("b")).select(*dims, "a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("beats"))

    def fall(rows: pd.DataFrame) -> pd.DataFrame:
        by, mine = rows[rows["beats"]][dims].to_numpy(), rows[~rows["beats"]][dims].to_numpy()
        return pd.DataFrame(mine[beaten(mine, by)] if len(by) and len(mine) else mine[:0], columns=dims)

    fallen = to.unionByName(at).groupBy("a", "b", "i", "j").applyInPandas(fall, ", ".join(f"{d} double" for d in dims))
    return x.select(*dims).join(fallen.distinct(), dims, "left_anti")


def front(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of df that no row matches in all dims and beats in one; more is better.

    Rows with a null or NaN in a dim neither beat nor are beaten and stay; equal rows stay or go together. Any number of
    dims. Distinct values are thinned where they stand, then what is left is compared by cells.
    """
    d = [f"d{i}" for i in range(len(dims))]
    known = None
    for c in dims:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        known = ok if known is None else known & ok
    values = df.filter(known).select(*[(F.col(c).cast("double") + 0.0).alias(a) for c, a in zip(dims, d, strict=True)]).distinct()
    local = _local(values, d)
    best = _global(local, d)
    on = [F.col(c).cast("double") + 0.0 == F.col(a) for c, a in zip(dims, d, strict=True)]
    return df.filter(known).join(best, on, "left_semi").unionByName(df.filter(~known))


def utility(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """df with _utility: weighted sum of the dims, each scaled to 0..1 by its extremes (a constant one counts as 1); null counts as 0."""
    ends = df.agg(*[e for c in weights for e in (F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}"))])
    part = lambda c: F.coalesce(F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))), F.lit(0.0))
    x = df.crossJoin(F.broadcast(ends))  # one row
    return x.withColumn("_utility", sum((w * part(c) for c, w in weights.items()), F.lit(0.0))).drop(*ends.columns)
