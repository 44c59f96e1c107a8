"""Many balanced logistic detectors fitted at once: every Newton step of all runs and targets is one scan of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import store


@dataclass(frozen=True)
class Target:
    """A detector: a 0/1 column (null: not for this detector) and the columns that it sees."""

    label: str
    features: tuple[str, ...]


def scalers(df: DataFrame, features: list[str], runs: dict[int, Column]) -> DataFrame:
    """(run, n, <feature>_mean, <feature>_std) of each run's training rows; the deviation is that of the population, 1 if zero."""
    mine = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in runs.items()])))
    s = df.select(*[F.col(f).cast("double").alias(f) for f in features], mine.alias("run")).groupBy("run").agg(F.count("*").alias("n"), *[e for f in features for e in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))])
    return s.select("run", "n", *[e for f in features for e in (f"{f}_mean", F.when(F.col(f"{f}_std") == 0, 1.0).otherwise(F.col(f"{f}_std")).alias(f"{f}_std"))])


def fit(df: DataFrame, targets: dict[str, Target], runs: dict[int, Column], c: float = 1.0, steps: int = 60, tolerance: float = 1e-9) -> dict[tuple[int, str], tuple[float, dict[str, float]]]:
    """(run, target) -> (intercept, weight of each feature), for features as they stand in df.

    runs names each run's training rows. Features are standardised by all training rows of the run; the classes of a
    target weigh alike; the loss is c times the weighted log loss plus half the squared weights of standardised
    features. Rows with a null feature are left out everywhere. A target with one class in a run has no model.

    Every step is one scan: tasks add up gradients and Hessians of all models that still move, a few dozen numbers each,
    and send those alone. A step that raises a model's loss is halved.
    """
    spark = df.sparkSession
    features = sorted({f for t in targets.values() for f in t.features})
    known = df
    for f in features:
        known = known.filter(F.col(f).isNotNull())
    path = store.scratch(spark, "detectors")  # what every step reads: numbers only, however the features were made
    known.select(
        *[F.col(f).cast("double").alias(f"x_{f}") for f in features],
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*[F.coalesce(e, F.lit(False)) for e in runs.values()]).alias("r"),
        F.array(*[F.coalesce(F.col(t.label).cast("int"), F.lit(-1)) for t in targets.values()]).alias("y"),
    ).write.parquet(path)
    packed = spark.read.parquet(path)
    mine = packed.select(*[F.col(f"x_{f}").alias(f) for f in features], "r")
    scale = {r.run: r for r in scalers(mine, features, {k: F.get("r", F.lit(i)) for i, k in enumerate(runs)}).collect()}  # a row a run
    packed = packed.select("x", "r", "y")
    sides = {}
    for j, t in enumerate(targets):
        for i, k in enumerate(runs):
            sides[k, t] = [F.count_if(F.get("r", F.lit(i)) & (F.get("y", F.lit(j)) == v)) for v in (0, 1)]
    counted = packed.agg(*[e for v in sides.values() for e in v]).first()
    count = {m: (counted[2 * i], counted[2 * i + 1]) for i, m in enumerate(sides)}
    at = {k: i for i, k in enumerate(runs)}, {t: j for j, t in enumerate(targets)}
    state = {}
    for (k, t), (none, some) in count.items():
        if none and some:
            cols = [features.index(f) for f in targets[t].features]
            mean = np.array([scale[k][f"{f}_mean"] for f in targets[t].features])
            std = np.array([scale[k][f"{f}_std"] for f in targets[t].features])
            n = none + some
            state[k, t] = {"run": at[0][k], "target": at[1][t], "cols": cols, "mean": mean, "std": std, "weight": np.array([n / (2 * none), n / (2 * some)]), "w": np.zeros(len(cols) + 1), "step": None, "loss": None}
    moving = list(state)
    for _ in range(steps):
        if not moving:
            break
        sums = _sums(spark, packed, [state[m] for m in moving], len(features), len(runs), len(targets))
        still = []
        for i, m in enumerate(moving):
            s, d = state[m], len(state[m]["w"])
            got = sums[i]
            free = np.r_[0.0, np.ones(d - 1)]
            loss = c * got[0] + 0.5 * float(free @ (s["w"] ** 2))
            if s["loss"] is not None and loss > s["loss"] * (1 + 1e-12):
                s["step"] = s["step"] / 2
                s["w"] = s["w"] + s["step"]  # halfway back
                if np.abs(s["step"]).max() > tolerance:
                    still.append(m)
                continue
            gradient = c * got[1 : d + 1] + free * s["w"]
            hessian = c * got[d + 1 :].reshape(d, d) + np.diag(free)
            step = np.linalg.solve(hessian, gradient)
            s["loss"], s["step"], s["w"] = loss, step, s["w"] - step
            if np.abs(step).max() > tolerance:
                still.append(m)
        moving = still
    out = {}
    for (k, t), s in state.items():
        plain = s["w"][1:] / s["std"]
        out[k, t] = (float(s["w"][0] - plain @ s["mean"]), dict(zip(targets[t].features, plain.tolist(), strict=True)))
    return out


def _sums(spark, packed: DataFrame, models: list[dict], n_features: int, n_runs: int, n_targets: int) -> list[np.ndarray]:
    """For each model the loss, gradient and Hessian of its weighted rows."""
    shared = spark.sparkContext.broadcast(models)  # some dozens of numbers a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] = [np.zeros(1 + len(m["w"]) + len(m["w"]) ** 2) for m in shared.value]
        for b in batches:
            flat = lambda i, kind, n, b=b: np.asarray(b.column(i).flatten().to_numpy(zero_copy_only=False), kind).reshape(b.num_rows, n)
            x, r, y = flat(0, float, n_features), flat(1, bool, n_runs), flat(2, int, n_targets)
            for m, add in zip(shared.value, total, strict=True):
                own = y[:, m["target"]]
                mine = r[:, m["run"]] & (own >= 0)
                if not mine.any():
                    continue
                z = np.c_[np.ones(mine.sum()), (x[mine][:, m["cols"]] - m["mean"]) / m["std"]]
                t, weight = own[mine], m["weight"][own[mine]]
                score = z @ m["w"]
                p = 0.5 * (1 + np.tanh(score / 2))
                d = z.shape[1]
                add[0] += weight @ (np.logaddexp(0, score) - t * score)
                add[1 : d + 1] += z.T @ (weight * (p - t))
                add[d + 1 :] += ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()
        for i, add in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(add), i, np.int32)), pa.array(np.arange(len(add), dtype=np.int32)), pa.array(add)], ["model", "i", "v"])

    out = [np.zeros(1 + len(m["w"]) + len(m["w"]) ** 2) for m in models]
    for r in packed.mapInArrow(run, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect():  # a few dozen rows a model
        out[r.model][r.i] = r.v
    return out


def probability(model: tuple[float, dict[str, float]] | None) -> Column:
    """The probability that a fitted model gives a row, as an expression; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    return 1 / (1 + F.exp(-sum((F.col(f) * w for f, w in model[1].items()), F.lit(model[0]))))


def predictions(df: DataFrame, key: str, models: dict, targets: dict[str, Target], runs: dict[int, Column]) -> DataFrame:
    """(key, run, p_<target>...): for each run the probabilities of the rows that its condition names."""
    rows = [F.when(c, F.struct(F.lit(k).alias("run"), *[probability(models.get((k, t))).alias(f"p_{t}") for t in targets])) for k, c in runs.items()]
    return df.select(key, F.inline(F.array_compact(F.array(*rows))))


def weight_table(spark, models: dict) -> DataFrame:
    """(run, target, feature, weight), the intercept's feature being ''."""
    rows = [(k, t, f, w) for (k, t), (b, ws) in models.items() for f, w in [("", b), *ws.items()]]
    return spark.createDataFrame(rows, "run int, target string, feature string, weight double")
