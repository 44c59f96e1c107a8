"""Classification, ranking, threshold and resampling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordinal


def per_label(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, precision, recall, f1) of every label that occurs."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(pred)).alias("tp"))
    p = df.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    both = t.join(p, "label", "full").fillna(0, ["support", "tp", "predicted"])
    precision, recall = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return both.select("label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def confusion(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    return df.groupBy(truth).pivot(pred, labels).count().fillna(0)


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs with margins; 'All' stands for a total."""
    out = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return out.select(F.when(F.col("ga") == 1, "All").otherwise(F.col(a).cast("string")).alias(a), F.when(F.col("gb") == 1, "All").otherwise(F.col(b).cast("string")).alias(b), "n")


def top_metrics(df: DataFrame, score: str, key: str, positive: str, cutoffs: tuple = (10, 20, 50, 100)) -> DataFrame:
    """(k, precision, recall, tp, fp) over the k best rows; only the largest k rows are ever ordered."""
    total = df.agg(F.sum(F.col(positive).cast("long")).alias("positives"))
    best = df.orderBy(F.desc(score), key).limit(max(cutoffs)).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), key)))
    cut = best.withColumn("k", F.explode(F.array(*map(F.lit, cutoffs)))).filter("rn <= k").groupBy("k").agg(F.sum(F.col(positive).cast("long")).alias("tp"), F.count("*").alias("n"))
    return cut.crossJoin(F.broadcast(total)).select("k", F.round(F.col("tp") / F.col("k"), 6).alias("precision"), F.round(F.try_divide("tp", "positives"), 6).alias("recall"), "tp", (F.col("n") - F.col("tp")).alias("fp"))


def threshold_cells(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(threshold, p, tp, fp, fn) at each distinct score: rows with that score or more are called positive, p have just that.

    Counts come first, so the running sums go over distinct scores, not rows, and over ranges of them.
    """
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    run = ordinal.running(by, "threshold", {"p": "tp", "n": "called"}).crossJoin(F.broadcast(by.agg(F.sum("p").alias("positives"))))
    return run.select("threshold", "p", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: step area under precision over recall, by distinct thresholds."""
    step = threshold_cells(df, score, positive).select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("p") / (F.col("tp") + F.col("fn"))).alias("dr"))
    return step.agg(F.round(F.sum(F.col("precision") * F.col("dr")), 6).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: share of positive-negative pairs in the right order, ties half, by cumulative counts of distinct scores."""
    by = df.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n")).withColumn("q", F.col("n") - F.col("p"))
    run = ordinal.running(by, score, {"q": "upto"}, descending=False)
    return run.agg(F.round(F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2)) / (F.sum("p") * F.sum("q")), 6).alias("auc"))


def weighted_kappa(df: DataFrame, a: str, b: str, tiers: int) -> DataFrame:
    """One row: quadratic weighted kappa of two ordinal columns and their mean absolute difference."""
    d = (F.col(a) - F.col(b)).cast("double")
    s = df.agg(F.avg(d * d).alias("o"), F.avg(F.col(a) * F.col(a)).alias("aa"), F.avg(F.col(b) * F.col(b)).alias("bb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(F.abs(d)).alias("mae"))
    expected = F.col("aa") + F.col("bb") - 2 * F.col("ma") * F.col("mb")
    return s.select(F.round(1 - F.col("o") / expected, 6).alias("kappa"), F.round("mae", 6).alias("mae"))


def draws(groups: DataFrame, group: str, times: int) -> DataFrame:
    """(b, group, weight): group resamples with replacement, by a hash that any engine can compute.

    In resample b, slot i draws group (i * 48271 + b * 69621 + i * b * 16807) mod n; weight says how often a group came.
    """
    numbered = ordinal.places(groups.select(group).distinct(), group).select(group, (F.col("_place") - 1).alias("slot"))
    n = numbered.agg(F.count("*").alias("n"))
    spun = numbered.select("slot").crossJoin(F.broadcast(n)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = (F.col("slot") * 48271 + F.col("b") * 69621 + F.col("slot") * F.col("b") * 16807) % F.col("n")
    count = spun.groupBy("b", at.alias("slot")).agg(F.count("*").alias("weight"))
    return count.join(numbered, "slot").select("b", group, "weight")


def bootstrap_rate(df: DataFrame, group: str, positive: str, times: int = 100) -> DataFrame:
    """One row: a rate, and its 95 % interval over group resamples; rows are summed by group before they meet a draw."""
    sums = df.groupBy(group).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    each = draws(sums, group, times).join(sums, group).groupBy("b").agg((F.sum(F.col("p") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("rate"))
    ci = each.agg(F.round(F.percentile("rate", 0.025), 6).alias("low"), F.round(F.percentile("rate", 0.975), 6).alias("high"))
    point = sums.agg(F.round(F.sum("p") / F.sum("n"), 6).alias("rate"))
    return point.crossJoin(ci)


def best_threshold(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (threshold, f1): the best F1 of distinct scores but the least, which calls all positive; ties to the smaller."""
    c = threshold_cells(df, score, positive)
    low = c.agg(F.min("threshold").alias("low"))
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6)
    return c.crossJoin(F.broadcast(low)).filter("threshold > low").select("threshold", f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def grid_search(df: DataFrame, a: str, b: str, truth: str, grid_a: list[float], grid_b: list[float]) -> DataFrame:
    """(ta, tb, f1) of every pair of thresholds: positive where a >= ta and b < tb.

    Rows fold into cells of the grid first (how many thresholds each score passes), so the pairs of thresholds meet
    at most (len(grid_a) + 1) * (len(grid_b) + 1) cells, whatever the number of rows.
    """
    passed = lambda c, grid: sum(((F.col(c) >= t).cast("int") for t in sorted(grid)), F.lit(0))
    cells = df.groupBy(passed(a, grid_a).alias("ia"), passed(b, grid_b).alias("ib")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))
    at = lambda grid: F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(sorted(grid))]))
    met = cells.withColumn("ga", at(grid_a)).withColumn("gb", at(grid_b))
    hit = (F.col("ia") >= F.col("ga.i")) & (F.col("ib") < F.col("gb.i"))
    out = met.groupBy(F.col("ga.t").alias("ta"), F.col("gb.t").alias("tb")).agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("called"), F.sum("p").alias("p"))
    return out.select("ta", "tb", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("p")), F.lit(0.0)), 6).alias("f1"))


def mcnemar(df: DataFrame, first_right: str, second_right: str) -> DataFrame:
    """One row (b, c, p_value): rows that only the first or only the second has right, exact two-sided binomial test."""
    cells = df.agg(F.count_if(F.col(first_right) & ~F.col(second_right)).alias("b"), F.count_if(~F.col(first_right) & F.col(second_right)).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    # log of n choose i by its recurrence, then the tail up to k
    step = lambda acc, i: F.struct((acc["l"] + F.log((n - i + 1) / i)).alias("l"), (acc["s"] + F.exp(acc["l"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("s"))
    start = F.struct(F.lit(0.0).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), start, step, lambda acc: acc["s"])
    return cells.select("b", "c", F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p_value"))


def spread(df: DataFrame, label: str, score: str) -> DataFrame:
    """(label, n, mean, std, q1, median, q3) of a score; std is the population's. Quantiles are taken over distinct scores."""
    by = df.groupBy(label, score).agg(F.count("*").alias("n"))
    q = lambda p: F.round(F.percentile(score, p, F.col("n")), 6)
    quantiles = by.groupBy(label).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    return df.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std")).join(quantiles, label)


def long_scores(df: DataFrame, key: list[str], scores: list[str]) -> DataFrame:
    """(key, variant, score): one row for each score column."""
    return df.unpivot(key, scores, "variant", "score")
