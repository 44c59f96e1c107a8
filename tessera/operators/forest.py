"""A forest of histogram trees: all trees and all nodes of a level are split in one scan of binned rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordinal, resampling
from tessera.sources import store


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 4
    bins: int = 32
    features_a_node: int | None = None  # the root of their number where not given
    least: int = 2  # drawn rows that each side of a split keeps
    seed: int = 42


@dataclass
class Forest:
    """Trees in heap order: node i has children 2 i and 2 i + 1; feature -1 is a leaf."""

    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray = field(repr=False)
    cut: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """For each value the number of cuts at or below it."""
        return np.stack([np.searchsorted(q, x[:, i], side="right") for i, q in enumerate(self.cuts)], axis=1)

    def nodes(self, b: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node at which each row stands after so many levels; rows stay in leaves."""
        at = np.ones(len(b), np.int64)
        for _ in range(levels):
            f = self.feature[tree, at]
            down = 2 * at + (b[np.arange(len(b)), np.maximum(f, 0)] > self.cut[tree, at])
            at = np.where(f >= 0, down, at)
        return at

    def score(self, x: np.ndarray, depth: int) -> np.ndarray:
        b = self.bins(x)
        return np.mean([self.value[t, self.nodes(b, t, depth)] for t in range(len(self.value))], axis=0)


def allowed(s: Settings, n_features: int, tree: int, node: int) -> np.ndarray:
    """The features that a node may split by, in order."""
    k = s.features_a_node or max(1, int(n_features**0.5))
    return np.sort(np.random.default_rng([s.seed, tree, node]).permutation(n_features)[:k])


def fit(df: DataFrame, key: str, features: list[str], positive: str, s: Settings = Settings()) -> Forest:
    """A forest for a 0/1 column. Rows with a null in a feature or in positive are left out.

    Values are binned by approximate quantiles; trees draw rows by hashed Poisson weights of the key. At each level tasks
    add up two numbers for each node, feature and bin that some node may split by; the best split of a node (most Gini
    impurity removed, then the first feature, then the lowest bin) is found by windows over those sums.
    """
    spark = df.sparkSession
    known = df
    for c in [*features, positive]:
        known = known.filter(F.col(c).isNotNull())
    quantiles = known.approxQuantile(features, [i / s.bins for i in range(1, s.bins)], 0.001)
    cuts = [np.unique(np.array(q)) for q in quantiles]
    size = 2 ** (s.depth + 1)
    forest = Forest(features, cuts, np.full((s.trees, size), -1, np.int64), np.zeros((s.trees, size), np.int64), np.zeros((s.trees, size)))
    path = store.scratch(spark, "forest")
    known.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(positive).cast("int").alias("y"), resampling.draws(key, s.trees, s.seed).alias("w")).write.parquet(path)
    rows = spark.read.parquet(path)
    open_ = {(t, 1) for t in range(s.trees)}
    for level in range(s.depth + 1):
        if not open_:
            break
        may = {n: allowed(s, len(features), *n) for n in open_}
        grown = set()
        for r in _best(_histograms(spark, rows, forest, may, level, s), s, level < s.depth).collect():  # a row a node
            forest.value[r.tree, r.node] = r.pos / r.n if r.n else 0.0
            if r.best is not None and level < s.depth:
                forest.feature[r.tree, r.node], forest.cut[r.tree, r.node] = r.best.f, r.best.bin
                grown |= {(r.tree, 2 * r.node), (r.tree, 2 * r.node + 1)}
        open_ = grown
    return forest


def _histograms(spark, rows: DataFrame, forest: Forest, may: dict, level: int, s: Settings) -> DataFrame:
    """(tree, node, f, bin, n, pos) of the drawn rows that stand at open nodes."""
    shared = spark.sparkContext.broadcast((forest, may))  # bounded by trees, depth and features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, may = shared.value
        d, width = len(forest.features), s.bins
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(0).flatten(), float).reshape(n, d)
            y = np.asarray(batch.column(1), np.int64)
            w = np.asarray(batch.column(2).flatten(), np.int64).reshape(n, -1)
            b = forest.bins(x)
            for t in range(w.shape[1]):
                at = forest.nodes(b, t, level)
                for node in np.unique(at[w[:, t] > 0]).tolist():
                    if (t, node) not in may:
                        continue
                    mine = (at == node) & (w[:, t] > 0)
                    h = total.setdefault((t, node), np.zeros((2, len(may[t, node]), width), np.int64))
                    for i, f in enumerate(may[t, node].tolist()):
                        h[0, i] += np.bincount(b[mine, f], w[mine, t], width).astype(np.int64)
                        h[1, i] += np.bincount(b[mine, f], w[mine, t] * y[mine], width).astype(np.int64)
        for (t, node), h in total.items():
            i, j = np.nonzero(h[0])
            some = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some, t)), pa.array(np.full(some, node)), pa.array(may[t, node][i]), pa.array(j), pa.array(h[0][i, j]), pa.array(h[1][i, j])], ["tree", "node", "f", "bin", "n", "pos"])

    return rows.mapInArrow(run, "tree long, node long, f long, bin long, n long, pos long").groupBy("tree", "node", "f", "bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _best(h: DataFrame, s: Settings, split: bool) -> DataFrame:
    """(tree, node, n, pos, best): a node's rows and its best split (f, bin: bins up to it go left), null for none."""
    part = Window.partitionBy("tree", "node", "f")
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = h.select("tree", "node", "f", "bin", F.sum("n").over(part).alias("n"), F.sum("pos").over(part).alias("pos"), F.sum("n").over(upto).alias("ln"), F.sum("pos").over(upto).alias("lp"))
    impure = lambda n, p: p * (n - p) / n
    rn, rp = F.col("n") - F.col("ln"), F.col("pos") - F.col("lp")
    gain = F.round(impure(F.col("n"), F.col("pos")) - impure(F.col("ln"), F.col("lp")) - F.when(rn > 0, impure(rn, rp)), 9)
    fits = (F.col("ln") >= s.least) & (rn >= s.least) & F.lit(split)
    best = F.max(F.when(fits & (gain > 1e-9), F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))))
    out = x.groupBy("tree", "node").agg(F.max("n").alias("n"), F.max("pos").alias("pos"), best.alias("best"))
    return out.select("tree", "node", "n", "pos", F.when(F.col("best").isNotNull(), F.struct((-F.col("best.f")).alias("f"), (-F.col("best.bin")).alias("bin"))).alias("best"))


def score(df: DataFrame, key: str, forest: Forest, s: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, score): the mean of the trees' leaf shares; null where a feature is null."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(forest)  # bounded by trees and depth
    n = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns[n:]], axis=1)
            got = shared.value.score(np.nan_to_num(x), s.depth)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got, mask=np.isnan(x).any(axis=1))], [*b.schema.names[:n], "score"])

    cols = df.select(key, *keep, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(forest.features)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:n])
    return cols.mapInArrow(run, f"{kinds}, score double")


def ranking(df: DataFrame, key: str, score: str, positive: str, ks: tuple[int, ...] = (10, 20, 50, 100), share: float = 0.05) -> DataFrame:
    """One row (n, n_positive, auc, average_precision, precision_at_k and recall_at_k, fp_tp): how well a score ranks positives.

    Equal scores share a step of the area and of the average precision; places for k go by falling score, then key.
    fp_tp is the false for each true one among the first `share` of rows (all false where none is true), a row at least.
    Rows with a null score are left out. Areas are null without both classes.
    """
    x = df.filter(F.col(score).isNotNull()).select(F.col(key).alias("k"), F.col(score).cast("double").alias("s"), F.coalesce(F.col(positive).cast("int"), F.lit(0)).alias("p"))
    by = x.groupBy("s").agg(F.sum("p").cast("long").alias("p"), F.count("*").alias("n"))
    run = ordinal.running(by, "s", {"p": "tp", "n": "called"})
    all_ = x.agg(F.count("*").alias("all"), F.coalesce(F.sum("p"), F.lit(0)).alias("hits"))
    area = run.agg(
        # negatives that stand below a step, half of those on it
        F.sum(F.col("p") * (F.col("called") - F.col("tp") - (F.col("n") - F.col("p")) / 2.0)).alias("over"),
        F.sum(F.col("p") * F.col("tp") / F.col("called")).alias("ap"),
    )
    most = max(ks)
    top = x.orderBy(F.desc("s"), "k").limit(most).withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), "k")))  # `most` rows
    heads = top.agg(*[F.coalesce(F.sum(F.when(F.col("at") <= k, F.col("p"))), F.lit(0)).alias(f"k{k}") for k in ks])
    n, hits = F.col("all"), F.col("hits")
    review = all_.select(F.greatest(F.lit(1), F.floor(n * share)).alias("reviewed"))
    reach = run.crossJoin(F.broadcast(review)).filter(F.col("called") - F.col("n") < F.col("reviewed"))
    whole = reach.filter(F.col("called") <= F.col("reviewed")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("whole"))
    edge = reach.filter(F.col("called") > F.col("reviewed")).select("s", (F.col("reviewed") - (F.col("called") - F.col("n"))).alias("left"))
    # of the step that the end of the review falls into, the first rows by key
    part = ordinal.running(x.join(F.broadcast(edge), "s").select("k", "p", "left", F.lit(1).cast("long").alias("one")), "k", {"one": "at"}, descending=False).filter(F.col("at") <= F.col("left")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("part"))
    row = all_.crossJoin(area).crossJoin(heads).crossJoin(review).crossJoin(whole).crossJoin(part)  # one row each
    tp = F.col("whole") + F.col("part")
    r = lambda a, b, name: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6).alias(name)
    return row.select(
        n.alias("n"), hits.alias("n_positive"),
        F.round(1 - F.try_divide(F.col("over"), hits * (n - hits)), 6).alias("auc"), F.round(F.try_divide(F.col("ap"), hits), 6).alias("average_precision"),
        *[r(F.col(f"k{k}"), F.least(F.lit(k), n), f"precision_at_{k}") for k in ks], *[r(F.col(f"k{k}"), F.greatest(hits, F.lit(1)), f"recall_at_{k}") for k in ks],
        F.round((F.col("reviewed") - tp) / F.greatest(tp, F.lit(1)), 6).alias("fp_tp"),
    )
