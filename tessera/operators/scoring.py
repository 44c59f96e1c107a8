"""Scores, profiles, routing and review queues as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of (p_strong, p_contra, entropy, flag, evidence) in each profile.
PROFILES = {
    "conservative": (1.20, -0.90, -0.35, 0.40, 0.15),
    "balanced": (1.00, -0.60, -0.25, 0.25, 0.25),
    "high_recall": (1.10, -0.35, -0.15, 0.0, 0.10),
}


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_norm of each column: extremes by one aggregate row, so no frame holds the table."""
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        out = out.withColumn(f"{c}_norm", F.when(hi - lo < 1e-10, 0.5).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop(*ends.columns)


def length_penalty(n: Column) -> Column:
    return F.when(n.between(10, 45), 0.0).when(n.between(6, 70), 0.15).otherwise(0.35)


def evidence_score(selector: Column, bm25: Column, rank: Column, penalty: Column) -> Column:
    return 0.40 * selector + 0.25 * bm25 - 0.15 * rank - 0.20 * penalty


def profile_score(name: str, p_strong: Column, p_contra: Column, entropy: Column, flag: Column, evidence: Column) -> Column:
    a, b, c, d, e = PROFILES[name]
    return a * p_strong + b * p_contra + c * entropy + d * flag + e * evidence


def bucket(p_strong: Column, p_contra: Column, entropy: Column, evidence: Column) -> Column:
    high = (p_strong >= 0.55) & (p_contra < 0.36) & (entropy < 0.85) & (evidence >= 0.35)
    return F.when(p_contra >= 0.55, "contradiction_or_conflict_review").when(high, "high_priority_strong_review").when((p_strong >= 0.55) & (evidence < 0.35), "evidence_check_needed").otherwise("low_priority")


def ranking_scores(low: float = 0.36) -> dict[str, Column]:
    """Eight ways to order candidates by p_strong, p_contra, entropy, flag, selector, rank and n_words."""
    s, c, e, f, sel, r, n = (F.col(x) for x in ("p_strong", "p_contra", "entropy", "flag", "selector", "rank", "n_words"))
    sure = (f == 1) & (c < low)
    return {
        "A": f * 1000.0 + s,
        "B": s,
        "C": s - c,
        "D": s - c - 0.2 * e,
        "E": s - c + 0.1 * sel - 0.05 * r,
        "F": s - c - 0.2 * e + F.when(n.between(10, 40), 0.1).otherwise(0.0),
        "G": F.when(sure, s - e).otherwise(-1000.0 + s),
        "H": 0.5 * s - 0.3 * c - 0.2 * e + 0.1 * sel - 0.05 * r,
    }


def capped_queue(df: DataFrame, score: str, key: str, group: str, cap: int, top: int) -> DataFrame:
    """The first `top` rows by score with at most `cap` of each group, with their queue_rank.

    Taking rows greedily under a cap is the same as ranking within groups first, which needs no global order; the
    global one then is over the rows taken only.
    """
    inner = Window.partitionBy(group).orderBy(F.desc(score), key)
    best = df.withColumn("in_group", F.row_number().over(inner)).filter(F.col("in_group") <= cap).orderBy(F.desc(score), key).limit(top)
    return best.withColumn("queue_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), key))).drop("in_group")


def cascade(p_contra: Column, p_strong: Column, p_svm: Column, t_contra: float, t_contra_low: float, t_strong: float, t_svm: float) -> Column:
    """Contradiction first, then strong where contradiction is low, then mild or supported: label index 3, 2, 1, 0."""
    return F.when(p_contra >= t_contra, 3).when((p_strong >= t_strong) & (p_contra < t_contra_low), 2).when(p_svm >= t_svm, 1).otherwise(0)


def vote(predictions: DataFrame, key: str, label: str, n_labels: int = 4) -> DataFrame:
    """(key, label, entropy): the most frequent label of each key, the smallest on ties, and the mean of -p ln p over all labels."""
    counts = predictions.groupBy(key, label).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return counts.withColumn("h", -share * F.log(share)).withColumn("rn", rn).groupBy(key).agg(F.min(F.when(F.col("rn") == 1, F.col(label))).alias(label), F.round(F.sum("h") / n_labels, 6).alias("entropy"))
