"""The four thresholds of the cascade, searched over a summed-area cube: one count of cells, whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds tried, and what each metric weighs in the objective.
CONTRA = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)
CONTRA_LOW = (0.2, 0.25, 0.3, 0.35, 0.4)
STRONG = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)
SVM = (0.4, 0.45, 0.5, 0.55, 0.6)
OBJECTIVE = {"macro_f1": 0.4, "strong_f1": 0.3, "contra_f1": 0.2, "escalation_f1": 0.1}

LABELS = 4


def only(df: DataFrame, split: str, allowed: tuple[str, ...] = ("dev",)) -> DataFrame:
    """df, or a ValueError if any row is of another split: thresholds are never fitted on what they are judged by."""
    if found := sorted(str(r[0]) for r in df.filter(F.col(split).isNull() | ~F.col(split).isin(*allowed)).select(split).distinct().limit(20).collect()):
        raise ValueError(f"thresholds are fitted on {', '.join(allowed)} only, not on {', '.join(found)}")
    return df


def _passed(p: str, grid: list[float]) -> Column:
    return sum((F.coalesce(F.col(p) >= t, F.lit(False)).cast("int") for t in grid), F.lit(0))


def _cube(df: DataFrame, label: str, contra: str, strong: str, svm: str, grids: tuple[list[float], list[float], list[float]]) -> DataFrame:
    """One row (cube): for each label and each corner of the grids the rows that reach the corner in all three.

    Rows fold into cells first; a cell, of which there are as many as the grids make, adds to the corners that it reaches.
    """
    c, s, v = grids
    cells = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("l"), _passed(contra, c).alias("c"), _passed(strong, s).alias("s"), _passed(svm, v).alias("v")).agg(F.count("*").alias("n"))
    upto = lambda x: F.explode(F.sequence(F.lit(0), F.col(x)))
    corners = cells
    for x in ("c", "s", "v"):  # one axis after another, added up between
        corners = corners.withColumn(f"{x}_", upto(x)).drop(x).withColumnRenamed(f"{x}_", x).groupBy("l", "c", "s", "v").agg(F.sum("n").alias("n"))
    at = ((F.col("l") * (len(c) + 1) + F.col("c")) * (len(s) + 1) + F.col("s")) * (len(v) + 1) + F.col("v")
    return corners.agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "n"))).alias("cube"))


def search(df: DataFrame, label: str, contra: str, strong: str, svm: str, t_contra=CONTRA, t_low=CONTRA_LOW, t_strong=STRONG, t_svm=SVM, objective=OBJECTIVE) -> DataFrame:
    """(place, t_contra, t_low, t_strong, t_svm, macro_f1, strong_f1, contra_f1, escalation_f1, score) of every combination.

    Labels are 0 supported, 1 mild, 2 strong, 3 contradiction; a null label is left out, a null probability reaches no
    threshold. A row is routed as cascade() routes it. place counts combinations in nested order of the grids, so the
    first best is the least place of the highest score. Macro scores are over labels that occur or are predicted.
    """
    merged = sorted({*t_contra, *t_low})
    cube = _cube(df, label, contra, strong, svm, (merged, list(t_strong), list(t_svm)))
    grid = cube
    for name, ts in (("t_contra", t_contra), ("t_low", t_low), ("t_strong", t_strong), ("t_svm", t_svm)):
        grid = grid.select("*", F.posexplode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(ts)])).alias(f"{name}_at", name))
    place = F.lit(0)
    for name, ts in (("t_contra", t_contra), ("t_low", t_low), ("t_strong", t_strong), ("t_svm", t_svm)):
        place = place * len(ts) + F.col(f"{name}_at")
    index = lambda t: F.array_position(F.array(*map(F.lit, merged)), t)
    high, low = index(F.col("t_contra.t")), index(F.least("t_contra.t", "t_low.t"))
    s, v, none = F.col("t_strong_at") + 1, F.col("t_svm_at") + 1, F.lit(0)

    def n(l: int, i: Column, j: Column, k: Column) -> Column:
        return F.coalesce(F.col("cube")[(((l * (len(merged) + 1) + i) * (len(t_strong) + 1) + j) * (len(t_svm) + 1) + k).cast("int")], F.lit(0))

    cells = []  # said[l][p] of truth l and prediction p
    for x in range(LABELS):
        three = n(x, high, none, none)
        two = n(x, none, s, none) - n(x, low, s, none)
        one = n(x, none, none, v) - n(x, high, none, v) - (n(x, none, s, v) - n(x, low, s, v))
        cells += [(n(x, none, none, none) - three - two - one).alias(f"n{x}0"), one.alias(f"n{x}1"), two.alias(f"n{x}2"), three.alias(f"n{x}3")]
    flat = grid.select(place.alias("place"), *[F.col(f"{t}.t").alias(t) for t in ("t_contra", "t_low", "t_strong", "t_svm")], *cells)

    def f1(hit: Column, truth: Column, said: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * hit, truth + said), F.lit(0.0))

    def macro(parts: list[tuple[Column, Column, Column]]) -> Column:
        some = sum(((t + p > 0).cast("int") for _, t, p in parts), F.lit(0))
        return F.coalesce(F.try_divide(sum((f1(*x) for x in parts), F.lit(0.0)), some), F.lit(0.0))

    c = lambda x, p: F.col(f"n{x}{p}")
    truth = [sum((c(x, p) for p in range(LABELS)), F.lit(0)) for x in range(LABELS)]
    said = [sum((c(x, p) for x in range(LABELS)), F.lit(0)) for p in range(LABELS)]
    total = sum(truth, F.lit(0))
    raised = sum((c(x, p) for x in (1, 2, 3) for p in (1, 2, 3)), F.lit(0))
    made = {
        "macro_f1": macro([(c(x, x), truth[x], said[x]) for x in range(LABELS)]),
        "strong_f1": f1(c(2, 2), truth[2], said[2]),
        "contra_f1": f1(c(3, 3), truth[3], said[3]),
        "escalation_f1": macro([(c(0, 0), truth[0], said[0]), (raised, total - truth[0], total - said[0])]),
    }
    out = flat.select("place", "t_contra", "t_low", "t_strong", "t_svm", *[F.round(x, 9).alias(k) for k, x in made.items()])
    return out.withColumn("score", F.round(sum((w * F.col(k) for k, w in objective.items()), F.lit(0.0)), 9))


def best(searched: DataFrame) -> DataFrame:
    """The one row of the highest score, the first in order on ties."""
    return searched.orderBy(F.desc("score"), "place").limit(1)


def fit(df: DataFrame, split: str, label: str, contra: str, strong: str, svm: str) -> dict[str, float]:
    """The best thresholds by rows of the dev split; rows of any other are an error."""
    r = best(search(only(df, split), label, contra, strong, svm)).first()
    return {t: r[t] for t in ("t_contra", "t_low", "t_strong", "t_svm")}
