"""Trained baselines against plain numpy fits and plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble, sparse, thresholds
from tessera.plans import learning

SF = "/root/testdata/sf0.001"


def newton(x, y, classes, weight, c=1.0, free=(0,)):
    """Softmax regression by Newton steps; columns of x named in free are not shrunk."""
    n, d = x.shape
    w, shrink = np.zeros((classes, d)), np.ones(d)
    shrink[list(free)] = 0
    t = np.eye(classes)[y]
    for _ in range(100):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = c * ((weight[:, None] * (p - t)).T @ x) + shrink * w
        h = np.zeros((classes * d, classes * d))
        for a in range(classes):
            for b in range(classes):
                q = weight * p[:, a] * ((a == b) - p[:, b])
                h[a * d : a * d + d, b * d : b * d + d] = c * (x.T * q) @ x + (np.diag(shrink) if a == b else 0)
        step = np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(w.shape)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def plain_folds(rows, stop, least=2, c=1.0):
    """(key -> probabilities) of models fitted on the other folds."""
    words = lambda t: [x for x in re.findall(r"[^\W]{2,}", t.lower()) if x not in stop]
    terms = {k: Counter((w := words(t)) + [f"{a} {b}" for a, b in zip(w, w[1:])]) for k, _, t, _ in rows}
    labels = sorted({y for *_, y in rows})
    out = {}
    for f in sorted({f for _, f, _, _ in rows}):
        train, test = [r for r in rows if r[1] != f], [r for r in rows if r[1] == f]
        df = Counter(t for r in train for t in terms[r[0]])
        known = sorted(t for t, n in df.items() if n >= least)
        idf = np.array([math.log((1 + len(train)) / (1 + df[t])) + 1 for t in known])

        def vector(r):
            v = np.array([1 + math.log(terms[r[0]][t]) if terms[r[0]][t] else 0.0 for t in known]) * idf
            return v / (np.linalg.norm(v) or 1.0)

        x = np.array([[1.0, *vector(r)] for r in train])
        y = np.array([labels.index(r[3]) for r in train])
        count = Counter(y.tolist())
        weight = np.array([len(y) / (len(count) * count[v]) for v in y.tolist()])
        if len(labels) == 2:  # one weight vector, shrunk once
            xs = x.copy()
            w = newton_binary(xs, y, weight, c)
            for r in test:
                p = 1 / (1 + math.exp(-(np.r_[1.0, vector(r)] @ w)))
                out[r[0]] = [1 - p, p]
        else:
            w = newton(x, y, len(labels), weight, c)
            for r in test:
                s = w @ np.r_[1.0, vector(r)]
                out[r[0]] = (np.exp(s - s.max()) / np.exp(s - s.max()).sum()).tolist()
    return out


def newton_binary(x, y, weight, c):
    w, shrink = np.zeros(x.shape[1]), np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(c * (x.T * (weight * p * (1 - p))) @ x + np.diag(shrink), c * x.T @ (weight * (p - y)) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.mark.parametrize("labels", [("a", "b"), ("a", "b", "c")])
def test_out_of_fold_equals_numpy_fit(spark, labels):
    rng = random.Random(len(labels))
    topic = {"a": ["red", "blue", "green", "pink"], "b": ["one", "two", "three", "four"], "c": ["cat", "dog", "cow", "hen"]}
    rows = []
    for i in range(60):
        y = rng.choice(labels)
        rows.append((i, i % 3, " ".join(rng.choices(topic[y] + ["the", "x", "stone", "river", "Élan"], k=rng.randint(1, 8))), y))
    rows += [(100, 0, "only unknown things", "a"), (101, 1, "", "b")]
    df = spark.createDataFrame(rows + [(102, 1, None, "a"), (103, None, "red", "a"), (104, 1, "red", None)], "k long, fold int, text string, y string")
    got = {r.k: r for r in sparse.out_of_fold(df, "k", "fold", F.col("text"), "y", ["the"], tolerance=1e-9).collect()}
    want = plain_folds([(k, f, t or "", y) for k, f, t, y in [*rows, (102, 1, None, "a")]], {"the"})
    assert set(got) == set(want)
    for k, p in want.items():
        assert np.allclose(got[k].p, p, atol=2e-4)
        assert got[k].predicted == sorted(labels)[int(np.argmax(got[k].p))]
    assert all(got[k].truth == y for k, _, _, y in rows)


def test_out_of_fold_of_poor_tables(spark):
    schema = "k long, fold int, text string, y string"
    run = lambda rows: sparse.out_of_fold(spark.createDataFrame(rows, schema), "k", "fold", F.col("text"), "y").collect()
    assert run([]) == []
    assert run([(1, 0, "a b", "x"), (2, 1, "a b", "x")]) == []  # one label
    assert run([(1, 0, "aa bb", "x"), (2, 0, "aa bb", "y")]) == []  # one fold


def test_vocabulary_knows_nothing_of_the_held_out_fold(spark):
    rows = spark.createDataFrame([(1, 0, "alpha beta"), (2, 1, "alpha beta"), (3, 2, "alpha gamma"), (4, 2, "gamma"), (5, 1, "gamma gamma")], "k long, fold int, text string")
    v = sparse.vocabularies(sparse.fold_terms(rows, "k", "fold", F.col("text")), "fold", {0: 1, 1: 2, 2: 2}).collect()
    assert {f: sorted(r.term for r in v if r.held_out == f) for f in (0, 1, 2)} == {0: ["alpha", "gamma"], 1: ["alpha", "gamma"], 2: ["alpha", "alpha beta", "beta"]}
    assert {f: sorted(r.i for r in v if r.held_out == f) for f in (0, 1, 2)} == {0: [0, 1], 1: [0, 1], 2: [0, 1, 2]}
    few = sparse.vocabularies(sparse.fold_terms(rows, "k", "fold", F.col("text")), "fold", {0: 1, 1: 2, 2: 2}, most=1).collect()
    assert {r.held_out: r.term for r in few} == {0: "gamma", 1: "alpha", 2: "alpha"}


def test_many_detectors_equal_single_fits(spark):
    df = learning._shaped(spark, "/root/testdata/sf0.01").cache()
    runs = {k: c for k, c in learning._runs(0, 70).items() if k < 4}
    models = ensemble.fit(df, learning.TARGETS, runs)
    assert models
    for k, c in runs.items():
        rows = df.filter(c).collect()
        for name, t in learning.TARGETS.items():
            x = np.array([[r[f] for f in t.features] for r in rows], float)
            std = np.where(x.std(axis=0) == 0, 1.0, x.std(axis=0))
            y = np.array([-1 if r[t.label] is None else r[t.label] for r in rows])
            z, y = np.c_[np.ones((y >= 0).sum()), ((x - x.mean(axis=0)) / std)[y >= 0]], y[y >= 0]
            if len(set(y.tolist())) < 2:
                assert (k, name) not in models
                continue
            weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
            w = newton_binary(z, y, weight, 1.0)
            plain = w[1:] / std
            intercept, got = models[k, name]
            assert np.allclose([got[f] for f in t.features], plain, atol=1e-6)
            assert abs(intercept - (w[0] - plain @ x.mean(axis=0))) < 1e-6


def test_detectors_on_separable_and_odd_rows(spark):
    rows = [(i, float(i), None if i == 5 else 1.0, int(i > 10), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int, z int")
    t = {"y": ensemble.Target("y", ("a", "b")), "z": ensemble.Target("z", ("a",))}
    models = ensemble.fit(df, t, {0: F.col("k") >= 0, 1: F.col("k") < 5})
    assert set(models) == {(0, "y")}  # one class only elsewhere
    assert models[0, "y"][1]["b"] == 0.0
    p = {r.k: r.p_y for r in ensemble.predictions(df, "k", models, t, {0: F.col("k") % 2 == 0}).collect()}
    assert set(p) == set(range(0, 20, 2)) and p[0] < 0.1 and p[18] > 0.9
    assert ensemble.fit(df.limit(0), t, {0: F.lit(True)}) == {}


def test_threshold_search_equals_loops(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, 3, 3]), rng.choice([0.2, 0.3, 0.55, rng.random()]), rng.random(), rng.random(), "dev") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, c double, s double, v double, split string")
    grids = {"t_contra": (0.3, 0.55), "t_low": (0.2, 0.3, 0.6), "t_strong": (0.3, 0.5), "t_svm": (0.5,)}

    def f1(pairs, what):
        hit = sum(what(y) and what(p) for y, p in pairs)
        n = sum(what(y) for y, _ in pairs) + sum(what(p) for _, p in pairs)
        return 2 * hit / n if n else 0.0

    want = []
    for a in grids["t_contra"]:
        for b in grids["t_low"]:
            for e in grids["t_strong"]:
                for g in grids["t_svm"]:
                    pairs = [(y, 3 if c >= a else 2 if s >= e and c < b else 1 if v >= g else 0) for _, y, c, s, v, _ in rows]
                    seen = {x for p in pairs for x in p}
                    macro = sum(f1(pairs, lambda x, l=l: x == l) for l in seen) / len(seen)
                    up = [f1(pairs, lambda x: x > 0), f1(pairs, lambda x: x == 0)]
                    want.append((len(want), a, b, e, g, macro, f1(pairs, lambda x: x == 2), f1(pairs, lambda x: x == 3), sum(up) / 2))
    got = thresholds.search(df, "y", "c", "s", "v", **grids).orderBy("place").collect()
    assert np.allclose([tuple(r)[:-1] for r in got], want, atol=1e-8)
    top = thresholds.best(thresholds.search(df, "y", "c", "s", "v", **grids)).first()
    assert top.place == min(range(len(got)), key=lambda i: (-got[i].score, i))
    assert set(thresholds.fit(df, "split", "y", "c", "s", "v")) == set(grids)
    with pytest.raises(ValueError, match="dev only, not on test"):
        thresholds.fit(df.withColumn("split", F.when(F.col("k") == 3, "test").otherwise("dev")), "split", "y", "c", "s", "v")
