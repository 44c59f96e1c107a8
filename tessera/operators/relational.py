"""Joins and set operations with the rules that screening needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as K


def first_source(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin): the primary value of each key, else the fallback's."""
    a, b = primary.select(key, F.col(value).alias("a")), fallback.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").select(key, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "primary").otherwise("fallback").alias("origin"))


def pareto(df: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Keys that no other row matches in all dims and beats in one; a null in a dim neither beats nor is beaten.

    Two dims: the best second value of each first value against a running maximum over higher first values, within
    buckets and then among what these leave. Other numbers of dims, for small tables of methods: a theta anti-join.
    """
    if len(dims) == 2:
        return _front(df, key, *dims)
    other = df.select(*[F.col(c).alias(f"o_{c}") for c in [key, *dims]])
    no_worse = F.lit(True)
    better = F.lit(False)
    for d in dims:
        no_worse &= F.col(f"o_{d}") >= F.col(d)
        better |= F.col(f"o_{d}") > F.col(d)
    return df.join(other, no_worse & better, "left_anti").select(key)


def _front(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    best = df.filter(known).groupBy(F.col(a).alias("f_a")).agg(F.max(b).alias("f_b")).withColumn("bucket", F.pmod(F.xxhash64("f_a"), F.lit(64)))

    def kept(x, *part):
        above = F.max("f_b").over(Window.partitionBy(*part).orderBy(F.desc("f_a")).rowsBetween(Window.unboundedPreceding, -1))
        return x.withColumn("above", above).filter(F.col("above").isNull() | (F.col("above") < F.col("f_b"))).drop("above")

    front = kept(kept(best, "bucket")).select("f_a", "f_b")
    return df.filter(known).join(front, (F.col(a) == F.col("f_a")) & (F.col(b) == F.col("f_b")), "left_semi").select(key).unionByName(df.filter(~known).select(key))


def group_similarity(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, n_pairs, mean_jaccard): mean token similarity of the pairs of a group.

    Groups are claim groups of a few rows each; pairs never leave their group.
    """
    t = df.select(group, key, F.array_distinct(K.tokenize(F.col(text))).alias("t"))
    o = t.select(F.col(group).alias("g2"), F.col(key).alias("k2"), F.col("t").alias("t2"))
    pairs = t.join(o, (F.col(group) == F.col("g2")) & (F.col(key) < F.col("k2")))
    return pairs.groupBy(group).agg(F.count("*").alias("n_pairs"), F.round(F.avg(K.jaccard(F.col("t"), F.col("t2"))), 6).alias("mean_jaccard"))


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(part, n): how many keys are in both, only the first and only the second."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    part = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), "both").when(F.col("x").isNotNull(), "first").otherwise("second")
    return x.join(y, key, "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
