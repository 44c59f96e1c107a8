"""Calibration and ordinal metrics, tier arithmetic, and running sums that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a running sum is cut into; each is one task's, and their totals are the only rows that meet in one.
RANGES = 64


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = True, ranges: int = RANGES, within: tuple[str, ...] = (), at: Column | None = None) -> DataFrame:
    """df with sums[c] = the running sum of c up to and with the row, by order, whose values must be distinct within `within`.

    Rows are dealt to ranges of order by approximate quantiles (which move work, never results), by what a range
    partitioning of other than plain numbers finds, or by `at`, a whole number that does not fall as order rises; sums
    run within ranges and start from the totals of the ranges before, a row each.
    """
    if at is None:
        numeric = df.schema[order].dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint")
        if numeric:
            cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.001)))
        else:
            ends = df.select(order).filter(F.col(order).isNotNull()).repartitionByRange(ranges, order).groupBy(F.spark_partition_id()).agg(F.max(order).alias("end"))
            cuts = sorted(r.end for r in ends.collect())  # a value a range
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q < F.col(order))) if cuts else F.lit(0)
    x = df.withColumn("_range", at)
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    by = x.groupBy(*within, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(*within).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    start = by.select(*within, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    w = Window.partitionBy(*within, "_range").orderBy(turn(order))
    return x.join(F.broadcast(start), [*within, "_range"]).select(*df.columns, *[(F.sum(c).over(w) + F.col(f"_{c}")).alias(n) for c, n in sums.items()])


def places(df: DataFrame, order: str, at: Column | None = None) -> DataFrame:
    """df with _place = 1, 2, ... by order, whose values must be distinct."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {"_one": "_place"}, descending=False, at=at).drop("_one")


def calibration(df: DataFrame, prob: str, truth: str, bins: int = 10) -> DataFrame:
    """One row (ece, brier, nll): expected calibration error over equal bins, Brier score, negative log-likelihood."""
    y = F.col(truth).cast("double")
    at = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins))
    by = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(y).alias("y"))
    ece = by.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))
    q = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col(prob)))
    rest = df.agg(F.round(F.avg((F.col(prob) - y) * (F.col(prob) - y)), 6).alias("brier"), F.round(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q)), 6).alias("nll"))
    return ece.crossJoin(rest)  # one row each


def reliability(df: DataFrame, prob: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, share): what was said and what was so in each bin of probability."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(prob), 6).alias("mean_prob"), F.round(F.avg(F.col(truth).cast("double")), 6).alias("share"))


def threshold_grid(df: DataFrame, prob: str, truth: str, points: int) -> DataFrame:
    """(threshold, f1) at `points` even thresholds from 0 to 1; rows fold into the points they pass first."""
    passed = F.floor(F.col(prob) * (points - 1) + 1e-9)
    by = df.groupBy(passed.alias("i")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("p"))
    met = by.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = met.groupBy("k").agg(F.sum(F.when(F.col("i") >= F.col("k"), F.col("n")).otherwise(0)).alias("called"), F.sum(F.when(F.col("i") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum("p").alias("p"))
    return out.select(F.round(F.col("k") / (points - 1), 6).alias("threshold"), F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("p")), F.lit(0.0)), 6).alias("f1"))


def per_dimension(df: DataFrame, dims: list[str], claim: str, predicted: str, support: str) -> DataFrame:
    """(dim, kappa, mae, over, under, exact, exceeds): agreement of tiers by dimension; columns are <prefix>_<dim>."""
    rows = [F.struct(F.lit(d).alias("dim"), F.col(f"{claim}_{d}").alias("c"), F.col(f"{predicted}_{d}").alias("p"), F.col(f"{support}_{d}").alias("s")) for d in dims]
    x = df.select(F.inline(F.array(*rows)))
    d = (F.col("c") - F.col("p")).cast("double")
    s = x.groupBy("dim").agg(
        F.avg(d * d).alias("o"), F.avg(F.col("c") * F.col("c")).alias("cc"), F.avg(F.col("p") * F.col("p")).alias("pp"), F.avg("c").alias("mc"), F.avg("p").alias("mp"), F.avg(F.abs(d)).alias("mae"),
        F.count_if(F.col("p") > F.col("c")).alias("over"), F.count_if(F.col("p") < F.col("c")).alias("under"), F.count_if(F.col("p") == F.col("c")).alias("exact"),
        F.avg(((F.col("c") > F.col("s")) == (F.col("p") > F.col("s"))).cast("int")).alias("exceeds"),
    )
    expected = F.col("cc") + F.col("pp") - 2 * F.col("mc") * F.col("mp")
    return s.select("dim", F.round(1 - F.try_divide(F.col("o"), expected), 6).alias("kappa"), F.round("mae", 6).alias("mae"), "over", "under", "exact", F.round("exceeds", 6).alias("exceeds"))


def gaps(claim: Column, support: Column, dims: list[str]) -> Column:
    """Names of the dimensions in which a claim's tier exceeds its support, as `<dim>_missing`; empty if supported."""
    return F.array_compact(F.array(*[F.when(F.get(claim, F.lit(i)) > F.get(support, F.lit(i)), f"{d}_missing") for i, d in enumerate(dims)]))


def tier_probabilities(theta: Column, thresholds: list[float]) -> Column:
    """Probabilities of the tiers of a proportional-odds model: differences of 1 / (1 + exp(theta - t))."""
    below = [1 / (1 + F.exp(theta - F.lit(float(t)))) for t in sorted(thresholds)]
    return F.array(below[0], *[b - a for a, b in zip(below[:-1], below[1:], strict=True)], 1 - below[-1])


def capped(probs: Column, cap: Column) -> Column:
    """Probabilities with nothing above the tier `cap`, scaled to sum 1 again."""
    kept = F.transform(probs, lambda p, i: F.when(i <= cap, p).otherwise(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.transform(kept, lambda p: p / F.when(total == 0, 1.0).otherwise(total))


def support_ceiling(tier: Column, claim: Column, has_evidence: Column) -> Column:
    """A support tier, at most 2 where a claim of tier 3 or more has no evidence of its kind."""
    return F.when((claim >= 3) & ~has_evidence, F.least(tier, F.lit(2))).otherwise(tier)


def noisy_or(probs: Column) -> Column:
    return 1 - F.aggregate(probs, F.lit(1.0), lambda a, p: a * (1 - p))


def lower_bound(value: Column, confidence: Column, width: float = 1.0) -> tuple[Column, Column]:
    """Lower end and width of an interval that widens as confidence falls."""
    half = (1 - confidence) * width
    return F.greatest(F.lit(0.0), value - half), 2 * half


def complete_groups(df: DataFrame, group: str, variant: str, n: int) -> DataFrame:
    """Groups that have all n variants."""
    return df.groupBy(group).agg(F.count_distinct(variant).alias("n_variants")).filter(F.col("n_variants") == n).select(group)


def single_class_splits(df: DataFrame, split: str, label: str) -> DataFrame:
    """Splits with fewer than two labels."""
    return df.groupBy(split).agg(F.count_distinct(label).alias("n_labels")).filter("n_labels < 2")


def split_values(x: Column) -> Column:
    """Values of a cell parted by commas or semicolons, trimmed; null for NA."""
    return F.when(F.upper(F.trim(x)).isin("NA", "N/A", ""), None).otherwise(F.filter(F.transform(F.split(x, "[,;]"), lambda v: F.trim(v)), lambda v: v != ""))


def nan_free(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def fill_label(label: Column, claim: Column, support: Column) -> Column:
    """A label, or where it is missing whether the claim's tier exceeds its support."""
    return F.coalesce(label, (claim > support).cast("int"))


def label_conflicts(df: DataFrame, label: str, claim: str, support: str) -> DataFrame:
    """Rows whose label says other than their tiers do; the caller raises or overwrites."""
    return df.filter(F.col(label).isNotNull() & (F.col(label) != (F.col(claim) > F.col(support)).cast("int")))
