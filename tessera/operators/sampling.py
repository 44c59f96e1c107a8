"""Samples, splits, resamples and simulated prevalences; each choice is a hash of a seed and a key, so it can be repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics, ordinal


def order_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hashed_places(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with _place = 1, 2, ... in hashed order of a key that no two rows share; hashes deal themselves to even ranges."""
    at = F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int")
    return ordinal.places(df.withColumn("_hash", order_key(seed, key)), "_hash", at).drop("_hash")


def per_label(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each label in hashed order. Ranks within labels stop at n, so no label is held whole."""
    w = Window.partitionBy(label).orderBy(order_key(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def round_robin(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, dealt from one stratum after the other, larger strata first, ties by name."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    w = Window.partitionBy(stratum).orderBy(order_key(seed, key), key)
    turn = df.withColumn("_turn", F.row_number().over(w)).filter(F.col("_turn") <= n)
    return turn.join(F.broadcast(size), stratum).orderBy("_turn", F.desc("_size"), stratum).limit(n).drop("_turn", "_size")


def group_split(df: DataFrame, group: str, train: float = 0.70, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """df with a split column: whole groups in hashed order, round(train n) of them, round(dev n), the rest."""
    g = df.select(group).distinct()
    n = g.agg(F.count("*").alias("_n"))
    at = hashed_places(g, group, seed).withColumnRenamed("_place", "_at").crossJoin(F.broadcast(n))
    first, second = F.bround(F.col("_n") * train), F.bround(F.col("_n") * dev)
    split = F.when(F.col("_at") <= first, "train").when(F.col("_at") <= first + second, "dev").otherwise("test")
    return df.join(at.select(group, split.alias("split")), group)


def folds(group: str, k: int, seed: int = 42) -> Column:
    """Fold of a row by its group: needs no count of groups, hence no order of them."""
    return F.conv(F.substring(order_key(seed, group), 1, 8), 16, 10).cast("long") % k


def paired_delta(df: DataFrame, a: str, b: str, group: str, times: int = 100) -> DataFrame:
    """One row: mean of b minus a, its 95 % interval over group resamples, and the share of resamples above 0.

    Deltas are rounded to nine places, so that a delta of rounding errors only does not count as above 0.
    """
    d = df.groupBy(group).agg(F.sum(F.col(b) - F.col(a)).alias("d"), F.count("*").alias("n"))
    each = metrics.draws(d, group, times).join(d, group).groupBy("b").agg(F.round(F.sum(F.col("d") * F.col("weight")) / F.sum(F.col("n") * F.col("weight")), 9).alias("delta"))
    ci = each.agg(F.round(F.percentile("delta", 0.025), 6).alias("low"), F.round(F.percentile("delta", 0.975), 6).alias("high"), F.round(F.avg((F.col("delta") > 0).cast("int")), 6).alias("share_above"))
    return d.agg(F.round(F.sum("d") / F.sum("n"), 6).alias("delta")).crossJoin(ci)


def prevalence_metrics(df: DataFrame, key: str, score: str, positive: str, rates: list[float], budget: float, seed: int = 42) -> DataFrame:
    """(prevalence, n, reviewed, tp, fp): all positives with just so many negatives, hashed, that positives have the rate.

    The first ceil(budget * n) rows by score are reviewed, ties by key. Negatives are numbered once for all rates, over
    ranges of their hashes; only the rows that tie at the last reviewed score are put in order.
    """
    neg = hashed_places(df.filter(~F.col(positive)).select(key, F.col(score).alias("s")), key, seed).withColumn("y", F.lit(0).cast("long"))
    pos = df.filter(positive).select(key, F.col(score).alias("s"), F.lit(0).cast("long").alias("_place"), F.lit(1).cast("long").alias("y"))
    p = pos.agg(F.count("*").alias("_p"))
    rows = pos.unionByName(neg).crossJoin(F.broadcast(p)).withColumn("prevalence", F.explode(F.array(*map(F.lit, rates))))
    rows = rows.filter(F.col("_place") <= F.floor(F.col("_p") * (1 - F.col("prevalence")) / F.col("prevalence"))).select("prevalence", key, "s", "y")
    by = rows.groupBy("prevalence", "s").agg(F.count("*").alias("c"), F.sum("y").alias("t"))
    total = by.groupBy("prevalence").agg(F.sum("c").alias("n")).withColumn("reviewed", F.ceil(F.col("n") * F.lit(budget)))
    run = ordinal.running(by, "s", {"c": "upto", "t": "upto_t"}, within=("prevalence",)).join(F.broadcast(total), "prevalence")
    # the score at which the budget ends, and how many rows of it are within
    edge = run.filter((F.col("upto") >= F.col("reviewed")) & (F.col("upto") - F.col("c") < F.col("reviewed"))).select("prevalence", "s", "n", "reviewed", (F.col("reviewed") - (F.col("upto") - F.col("c"))).alias("left"), (F.col("upto_t") - F.col("t")).alias("above"))
    tied = rows.join(F.broadcast(edge), ["prevalence", "s"]).withColumn("rn", F.row_number().over(Window.partitionBy("prevalence").orderBy(key))).filter(F.col("rn") <= F.col("left"))
    out = tied.groupBy("prevalence", "n", "reviewed").agg((F.max("above") + F.sum("y")).alias("tp"))
    return out.select("prevalence", "n", "reviewed", "tp", (F.col("reviewed") - F.col("tp")).alias("fp"))


def budget_curve(df: DataFrame, key: str, score: str, positive: str, budgets: list[float]) -> DataFrame:
    """(budget, reviewed, tp, recall): what reviewing the first ceil(budget * n) rows finds.

    Distinct scores are counted first; within a tie the share of positives is taken evenly, so no order of rows is needed.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("c"))
    total = by.agg(F.sum("p").alias("all_p"), F.sum("c").alias("n"))
    run = ordinal.running(by, "s", {"c": "upto"}).crossJoin(F.broadcast(total))
    cut = run.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("reviewed", F.ceil(F.col("n") * F.col("budget")))
    part = F.greatest(F.lit(0), F.least(F.col("c"), F.col("reviewed") - (F.col("upto") - F.col("c")))) / F.col("c")
    out = cut.groupBy("budget", "reviewed").agg(F.sum(part * F.col("p")).alias("tp"), F.max("all_p").alias("all_p"))
    return out.select("budget", "reviewed", F.round("tp", 6).alias("tp"), F.round(F.try_divide("tp", "all_p"), 6).alias("recall"))


def derangement(df: DataFrame, key: str, group: str) -> DataFrame:
    """(key, partner): a row of another group for every row, by the next group in order and the position within the group.

    Partner groups repeat their rows where they have fewer. With a single group there is no partner.
    """
    g = df.groupBy(group).agg(F.count("*").alias("_m"))
    at = ordinal.places(g.select(group), group)
    follow = at.select(F.col(group).alias("_next"), F.col("_place").alias("_to"))
    nxt = at.crossJoin(F.broadcast(g.agg(F.count("*").alias("_n")))).join(follow, F.col("_to") == F.col("_place") % F.col("_n") + 1).select(group, "_next").filter(F.col("_next") != F.col(group))
    pos = df.select(key, group, (F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).alias("_at"))
    other = pos.select(F.col(key).alias("partner"), F.col(group).alias("_next"), F.col("_at").alias("_slot"))
    sizes = g.select(F.col(group).alias("_next"), "_m")
    want = pos.join(nxt, group).join(sizes, "_next").withColumn("_slot", (F.col("_at") % F.col("_m")).cast("int"))
    return want.join(other, ["_next", "_slot"]).select(key, "partner")


def greedy_caps(df: DataFrame, key: str, bucket: str, group: str, caps: dict[str, int], per_group: int, n: int, seed: int = 42) -> DataFrame:
    """(key, bucket, place): buckets in the order of caps, rows in hashed order, under bucket, group and total caps.

    The choice depends on all earlier ones, so one task makes it, over a bounded part of the table that holds every row
    the choice can reach. Only n rows are ever taken, so of one bucket and group at most n rows are taken before and
    per_group or n more are wanted, and in one bucket at most n groups are full. Rows without a group have no group cap.
    """
    rank = F.element_at(F.create_map(*[F.lit(v) for i, b in enumerate(caps) for v in (b, i)]), F.col(bucket))
    rows = df.filter(F.col(bucket).isin(*caps)).select(key, F.col(bucket).alias("bucket"), F.col(group).alias("grp"), rank.alias("_b"), order_key(seed, key).alias("_o")).dropDuplicates([key, "bucket"])
    reach = 2 * n + per_group
    for by, bound in ((["bucket", "grp"], reach), (["bucket"], 2 * n + n * reach)):
        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_o", key))).filter(F.col("_i") <= bound)
    kind = df.schema[key].dataType.simpleString()

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, groups, seen, out = dict.fromkeys(caps, 0), {}, set(), []
        for part in parts:
            for k, b, g in zip(part[key], part["bucket"], part["grp"], strict=True):
                if len(out) >= n:
                    break
                grouped = not pd.isna(g)
                if taken[b] >= caps[b] or k in seen or (grouped and groups.get(g, 0) >= per_group):
                    continue
                seen.add(k)
                taken[b] += 1
                if grouped:
                    groups[g] = groups.get(g, 0) + 1
                out.append((k, b, len(out) + 1))
        yield pd.DataFrame(out, columns=[key, "bucket", "place"])

    ordered = rows.repartition(1).sortWithinPartitions("_b", "_o", key)
    return ordered.select(key, "bucket", "grp").mapInPandas(pick, f"{key} {kind}, bucket string, place long")
