"""Evaluation over folds and disturbed labels, and linear classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _f1(tp: Column, called: Column, actual: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(2.0 * tp, called + actual), F.lit(0.0)), 6)


def held_out_thresholds(df: DataFrame, fold: str, score: str, positive: str, grid: list[float]) -> DataFrame:
    """(fold, threshold, train_f1, test_f1): the threshold of the grid with the best F1 on all other folds, applied to the fold.

    The smallest threshold wins ties. Rows are counted once by fold and by how many thresholds they reach; all folds
    are then evaluated on that table of folds times thresholds, so the data is read once however many folds there are.
    """
    steps = sorted(grid)
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col(score)))
    small = df.groupBy(fold, reached.alias("reached")).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("p"))
    hit = F.col("reached") > F.col("i")
    cells = small.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).groupBy(fold, "i")
    cells = cells.agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("called"), F.sum("p").alias("actual"))
    rest = [(F.sum(c).over(Window.partitionBy("i")) - F.col(c)).alias(f"{c}_rest") for c in ("tp", "called", "actual")]
    both = cells.select("*", *rest).select(
        fold,
        F.element_at(F.array(*map(F.lit, steps)), F.col("i") + 1).alias("threshold"),
        _f1(F.col("tp_rest"), F.col("called_rest"), F.col("actual_rest")).alias("train_f1"),
        _f1(F.col("tp"), F.col("called"), F.col("actual")).alias("test_f1"),
    )
    return both.withColumn("rn", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("train_f1"), "threshold"))).filter("rn = 1").drop("rn")


def label_shift(df: DataFrame, key: str, predicted: str, actual: str, shares: list[int], draws: int) -> DataFrame:
    """(share, f1, low, high): F1 when a seeded share (in thousandths) of the true labels is flipped; mean and 95 % interval over draws.

    Every draw of a row is counted for all shares at once and combined before the shuffle.
    """
    cut = (F.col(key) * 48271 + F.col("b") * 69621 + (F.col(key) % 1009) * (F.col("b") + 1)) % 1000
    rows = df.select(key, F.col(predicted).alias("said"), F.col(actual).alias("true")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    cells = []
    for s in shares:
        now = F.col("true") != (cut < s)
        cells += [F.count_if(F.col("said") & now).alias(f"tp{s}"), F.count_if(now).alias(f"actual{s}")]
    by = rows.groupBy("b").agg(F.count_if("said").alias("called"), *cells)
    flat = by.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.coalesce(F.try_divide(2.0 * F.col(f"tp{s}"), F.col("called") + F.col(f"actual{s}")), F.lit(0.0)).alias("f")) for s in shares])).alias("x"))
    ci = lambda q: F.round(F.percentile("x.f", q), 6)
    return flat.groupBy(F.col("x.share").alias("share")).agg(F.round(F.avg("x.f"), 6).alias("f1"), ci(0.025).alias("low"), ci(0.975).alias("high"))


def linear_classifier(train: DataFrame, rows: DataFrame, key: str, vector: str, label: str, kind: str = "svm", l2: float = 1e-4) -> DataFrame:
    """(key, predicted int, margin): a linear support vector machine or logistic regression on standardised vectors.

    train and rows hold arrays of one length without nulls; label is 0 or 1. Standard deviations and weights come from train only.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if kind not in ("svm", "logistic"):
        raise ValueError(f"unknown kind {kind!r}")
    prepared = lambda d: d.withColumn("raw_features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    learner = (LinearSVC if kind == "svm" else LogisticRegression)(featuresCol="features", labelCol="truth", predictionCol="said", rawPredictionCol="raw", regParam=l2, maxIter=50)
    steps = [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), learner]
    model = Pipeline(stages=steps).fit(prepared(train).select("raw_features", F.col(label).cast("double").alias("truth")))
    return model.transform(prepared(rows).select(key, "raw_features")).select(key, F.col("said").cast("int").alias("predicted"), vector_to_array("raw")[1].alias("margin"))
