"""Simulated samples, splits by rules that go group by group, and tables of metrics over methods and label views."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordinal, sampling

STRONG = 2


def allotted(n: int, shares: dict[int, float]) -> dict[int, int]:
    """n rows dealt by shares (which sum to one): label i gets what lies between the rounded ends of its stretch of 0..n."""
    ends = [math.floor(n * x + 0.5) for x in accumulate(shares.values())]
    return dict(zip(shares, (b - a for a, b in zip([0, *ends], ends)), strict=True))


def composition(prevalence: float, n: int, shares: dict[int, float], positive: int = STRONG) -> dict[int, int]:
    """Rows of each label in a sample of n: positives by prevalence, one at least, the others by their shares of the rest."""
    first = max(1, math.floor(n * prevalence + 0.5))
    return {positive: first} | allotted(n - first, shares)


def compositions(df: DataFrame, label: str, positive: int, prevalences: list[float], n: int) -> DataFrame:
    """(prevalence, label, n): what samples of n are made of, the other labels by the shares that they have in df."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("c"))  # a row a label
    other = F.col(label) != positive
    upto = F.sum(F.when(other, F.col("c")).otherwise(0)).over(Window.partitionBy("prevalence").orderBy(label))
    every = F.sum(F.when(other, F.col("c")).otherwise(0)).over(Window.partitionBy("prevalence"))
    first = F.greatest(F.lit(1), F.floor(n * F.col("prevalence") + 0.5))
    end = lambda c: F.floor((n - first) * c / every + 0.5)
    x = counts.withColumn("prevalence", F.explode(F.array(*map(F.lit, prevalences))))
    return x.select("prevalence", label, F.when(other, end(upto) - end(upto - F.col("c"))).otherwise(first).cast("long").alias("n"))


def drawn(df: DataFrame, key: str, label: str, sizes: dict[int, int], times: int) -> DataFrame:
    """(b, label, key): resamples with replacement, sizes[label] rows of each label in each of `times`.

    Slot i of resample b takes row (i * 48271 + b * 69621 + i * b * 16807) mod n of its label, numbered by key. Draws are
    bounded by sizes and times; rows are numbered over ranges of keys within labels.
    """
    pools = ordinal.running(df.select(label, key, F.lit(1).cast("long").alias("_one")), key, {"_one": "_at"}, descending=False, within=(label,)).select(F.col(label), key, (F.col("_at") - 1).alias("_at"))
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    spark = df.sparkSession
    slots = spark.createDataFrame([(k, v) for k, v in sizes.items() if v > 0], "_label long, _size long").select("_label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).alias("_i"))
    slots = slots.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))).join(F.broadcast(n.withColumnRenamed(label, "_label")), "_label")
    at = (F.col("_i") * 48271 + F.col("b") * 69621 + F.col("_i") * F.col("b") * 16807) % F.col("_n")
    return slots.select("b", F.col("_label").alias(label), at.alias("_at")).join(pools, [label, "_at"]).select("b", label, key)


def screening(sample: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    """(by, tp, fp, fn, tn, recall, precision, fp_tp, burden, nnr): cells and rates of a screen; null where a ratio has no base."""
    n = lambda c: F.count_if(c)
    s = sample.groupBy(*by).agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    r = lambda a, b, name: F.round(F.try_divide(a.cast("double"), b), 6).alias(name)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select(*by, "tp", "fp", "fn", "tn", r(tp, tp + fn, "recall"), r(tp, tp + fp, "precision"), r(fp, tp, "fp_tp"), r(tp + fp, tp + fp + fn + tn, "burden"), r(tp + fp, tp, "nnr"))


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, median, low, high): the mean, and percentiles of the sorted values."""
    q = lambda p, n: F.round(F.percentile(value, p), 6).alias(n)
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), q(0.5, "median"), q(0.025, "low"), q(0.975, "high"))


def stratified_membership(df: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """(group, split): whole groups dealt to splits by shares, so that every label is split about alike.

    A group belongs to the label of which it holds the largest part, the smallest label on ties. The groups of a label
    stand in hashed order on a line as long as they have rows, and a group gets the split in whose stretch its middle
    lies: a split misses its share of a label's line by half a group at most at each end. All groups at once, by running
    sums over ranges of the order.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    every = counts.groupBy(label).agg(F.sum("n").alias("all"))
    part = counts.join(F.broadcast(every), label)  # a row a label
    own = part.groupBy(group).agg(F.sum("n").alias("_n"), F.max_by(label, F.struct(F.round(F.col("n") / F.col("all"), 9), -F.col(label))).alias("_label"))
    at = F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int")
    line = ordinal.running(own.withColumn("_hash", sampling.order_key(seed, group)), "_hash", {"_n": "_end"}, descending=False, within=("_label",), at=at)
    length = own.groupBy("_label").agg(F.sum("_n").alias("_all"))
    x = line.join(F.broadcast(length), "_label").withColumn("_middle", (F.col("_end") - F.col("_n") / 2) / F.col("_all"))
    ends = list(accumulate(shares.values()))
    split = F.lit(list(shares)[-1])
    for name, end in reversed(list(zip(shares, ends, strict=True))[:-1]):
        split = F.when(F.col("_middle") < end, name).otherwise(split)
    return x.select(group, split.alias("split"))


def exact_splits(df: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """(key, stratum, split): of each stratum just sizes[split] rows for each split in turn, in hashed order; the rest have none.

    At most the sum of sizes rows of a stratum are ranked and kept.
    """
    first = sampling.per_label(df.select(key, stratum), key, stratum, sum(sizes.values()), seed)
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(sampling.order_key(seed, key), key))
    upto, split = 0, F.lit(None).cast("string")
    for name, n in reversed(list(sizes.items())):
        upto = sum(v for k, v in sizes.items() if list(sizes).index(k) <= list(sizes).index(name))
        split = F.when(F.col("_at") <= upto, name).otherwise(split)
    return first.withColumn("_at", at).select(key, stratum, split.alias("split"))


def cyclic_splits(groups: DataFrame, key: str, order: list[str], cycle: list[str]) -> DataFrame:
    """(key, split): a table of groups dealt to a cycle of splits in order."""
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, key)) - 1
    return groups.select(key, *[c for c in order if c != key]).withColumn("_at", at).select(key, F.element_at(F.array(*map(F.lit, cycle)), (F.col("_at") % len(cycle) + 1).cast("int")).alias("split"))


def remapped(df: DataFrame, views: dict[str, dict[int, str]], truth: str, methods: list[str]) -> DataFrame:
    """(view, method, truth, said, n): confusion counts of every method under every grouping of the labels.

    Rows fold into cells of truth and prediction before they meet the views, which are literal tables.
    """
    cells = df.unpivot([truth], methods, "method", "_said").groupBy("method", truth, "_said").agg(F.count("*").alias("n"))
    to = lambda m, c: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c.cast("int"))
    rows = [F.struct(F.lit(v).alias("view"), to(m, F.col(truth)).alias("t"), to(m, F.col("_said")).alias("s")) for v, m in views.items()]
    return cells.select("method", "n", F.inline(F.array(*rows))).groupBy("view", "method", F.col("t").alias("truth"), F.col("s").alias("said")).agg(F.sum("n").alias("n"))
