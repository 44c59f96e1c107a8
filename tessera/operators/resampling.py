"""Row-level bootstrap of rank metrics: hashed Poisson weights for all resamples at once, cumulated over ranges of the score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import store

#: Chances that a row is drawn at most 0, 1, 2, ... times; a dozen is out of reach of 32 bits.
CHANCES = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def draws(key: str, times: int, seed: int = 42) -> Column:
    """How often each of `times` resamples draws a row: a Poisson variable of mean 1 from the hash of seed, resample and key."""
    first = F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda b: F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), F.col(key).cast("string"))), 1, 8))
    return F.transform(first, _drawn)


def _drawn(digits: Column) -> Column:
    """How many of CHANCES are at most a fraction of 32 bits, given as eight hexadecimal digits: these stand in the order of the numbers."""
    least = [math.ceil(c * 4294967296) for c in CHANCES]
    out = F.when(digits < F.lit(f"{least[0]:08x}"), F.lit(0).cast("tinyint"))
    for k, n in enumerate(least[1:], 1):
        out = out.when(digits < F.lit(f"{n:08x}" if n < 4294967296 else "g"), F.lit(k).cast("tinyint"))
    return out.otherwise(F.lit(len(CHANCES)).cast("tinyint"))


def weighted(df: DataFrame, key: str, times: int = 100, seed: int = 42) -> DataFrame:
    """df with _w, draws() of every row, stored: for several orders of the same rows."""
    path = store.scratch(df.sparkSession, "weighted")
    df.withColumn("_w", draws(key, times, seed)).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rank_metrics(df: DataFrame, key: str, score: str, positive: str, ks: tuple[int, ...] = (20, 50, 100), times: int = 100, seed: int = 42, rows_a_range: int = 100_000) -> DataFrame:
    """(b, metric, value): precision and recall at each k and average precision of every resample, b = -1 being df itself.

    Rows stand by falling score, then key, which no two rows share; a row drawn w times stands w times. Rows with a null
    score are left out, a null positive is none. An empty resample scores 0. Rows are sorted once, by range; a range
    starts from the sums of those before it, two numbers a resample, and passes on a few numbers a resample. Rows of
    weighted() come with their draws, by the same key, times and seed.
    """
    spark = df.sparkSession
    x = df.filter(F.col(score).isNotNull()).select(F.col(key).alias("k"), F.col(score).cast("double").alias("s"), F.coalesce(F.col(positive).cast("int"), F.lit(0)).alias("p"), *(["_w"] if "_w" in df.columns else []))
    n = x.count()
    path = store.scratch(spark, "ranges")
    sorted_ = x.repartitionByRange(max(1, -(-n // rows_a_range)), F.desc("s"), "k").withColumn("part", F.spark_partition_id())
    # if need be drawn after the exchange: it would carry the draws, and looking for its bounds would make them once more
    sorted_.withColumn("w", F.concat(F.array(F.lit(1).cast("tinyint")), F.col("_w") if "_w" in df.columns else draws("k", times, seed))).drop("_w").write.parquet(path)
    ranges = spark.read.parquet(path)
    width = times + 1
    sums = ranges.groupBy("part").agg(F.array(*[F.sum(F.get("w", F.lit(b))) for b in range(width)]).alias("w"), F.array(*[F.sum(F.get("w", F.lit(b)) * F.col("p")) for b in range(width)]).alias("p"))
    start, at = {}, np.zeros((2, width), np.int64)
    for r in sorted(sums.collect()):  # a row a range
        start[r.part] = at.copy()
        at = at + np.array([r.w, r.p])
    shared = spark.sparkContext.broadcast(start)
    total, hits = at

    def part_sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "k"], ascending=[False, True], kind="stable")
        w, p = np.stack(rows["w"].to_numpy()).astype(np.int64), rows["p"].to_numpy()[:, None]
        begin, had = shared.value[int(rows["part"].iloc[0])]
        before, positives = np.cumsum(w, axis=0) - w + begin, np.cumsum(w * p, axis=0) - w * p + had
        area = np.zeros(w.shape[1])
        for j in range(1, int(w.max(initial=0)) + 1):
            area += np.where((w >= j) & (p > 0), (positives + j) / (before + j), 0.0).sum(axis=0)
        at_k = [(np.clip(k - before, 0, w) * p).sum(axis=0) for k in ks]
        return pd.DataFrame({"b": np.arange(w.shape[1]) - 1, "area": area} | {f"k{k}": v for k, v in zip(ks, at_k, strict=True)})

    got = ranges.groupBy("part").applyInPandas(part_sums, "b int, area double, " + ", ".join(f"k{k} long" for k in ks)).groupBy("b").agg(F.sum("area").alias("area"), *[F.sum(f"k{k}").alias(f"k{k}") for k in ks])
    base = spark.createDataFrame([(b - 1, int(total[b]), int(hits[b])) for b in range(width)], "b int, n long, hits long")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    made = [(f"precision_at_{k}", ratio(F.col(f"k{k}"), F.least(F.lit(k), F.col("n")))) for k in ks] + [(f"recall_at_{k}", ratio(F.col(f"k{k}"), F.col("hits"))) for k in ks] + [("average_precision", ratio(F.col("area"), F.col("hits")))]
    both = base.join(got, "b", "left").fillna(0)
    return both.select("b", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in made])))


def intervals(metrics: DataFrame, *more: Column) -> DataFrame:
    """(metric, point, low, high, more): the value of the rows themselves, and the middle 95 of 100 resamples."""
    again = F.col("b") >= 0
    q = lambda p: F.round(F.percentile(F.when(again, F.col("value")), p), 6)
    return metrics.groupBy("metric").agg(F.round(F.max(F.when(~again, F.col("value"))), 6).alias("point"), q(0.025).alias("low"), q(0.975).alias("high"), *more)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(metric, delta, low, high, share_above): second less first, resample by resample; share_above counts rises."""
    both = first.select("b", "metric", F.col("value").alias("v1")).join(second.select("b", "metric", F.col("value").alias("v2")), ["b", "metric"])
    d = both.select("b", "metric", F.round(F.col("v2") - F.col("v1"), 9).alias("value"))
    up = F.round(F.avg(F.when(F.col("b") >= 0, (F.col("value") > 0).cast("int"))), 4).alias("share_above")
    return intervals(d, up).withColumnRenamed("point", "delta")  # one aggregation: another would make the resamples again
