"""Forests, row-level bootstrap, containment and fronts against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import containment, forest, resampling, skyline
from tessera.plans import learning


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(seed, b, key):
    u = int(hashlib.md5(f"{seed}|{b}|{key}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= c for c in resampling.CHANCES)


def plain_forest(rows, cuts, s):
    """The same trees by plain recursion over lists of (key, bins, y)."""
    binned = [(k, [sum(c <= v for c in cuts[i]) for i, v in enumerate(x)], y) for k, x, y in rows]

    def grow(t, node, mine, level):
        n, pos = sum(w for *_, w in mine), sum(w * y for _, y, w in mine)
        best = None
        impure = lambda a, p: p * (a - p) / a if a else 0.0
        if level < s.depth:
            for f in forest.allowed(s, len(cuts), t, node).tolist():
                for c in sorted({b[f] for b, _, _ in mine}):
                    ln, lp = sum(w for b, _, w in mine if b[f] <= c), sum(w * y for b, y, w in mine if b[f] <= c)
                    gain = round(impure(n, pos) - impure(ln, lp) - impure(n - ln, pos - lp), 9)
                    if ln >= s.least and n - ln >= s.least and gain > 1e-9 and (best is None or (gain, -f, -c) > best):
                        best = (gain, -f, -c)
        if best is None:
            return pos / n
        f, c = -best[1], -best[2]
        return f, c, grow(t, 2 * node, [r for r in mine if r[0][f] <= c], level + 1), grow(t, 2 * node + 1, [r for r in mine if r[0][f] > c], level + 1)

    def value(tree, b):
        while isinstance(tree, tuple):
            tree = tree[2] if b[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = []
    for t in range(s.trees):
        mine = [(b, y, w) for k, b, y in binned if (w := drawn(s.seed, t, k))]
        trees.append(grow(t, 1, mine, 0))
    return lambda x: float(np.mean([value(t, [sum(c <= v for c in cuts[i]) for i, v in enumerate(x)]) for t in trees]))


def test_forest_equals_plain_trees(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        x = [rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1), 7.0]
        rows.append((i, *x, int(x[0] + 0.3 * x[1] + rng.gauss(0, 0.2) > 0.8)))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y int")
    s = forest.Settings(trees=4, depth=3, bins=8)
    grown = forest.fit(df.repartition(3), "k", list("abcd"), "y", s)
    want = plain_forest([(r[0], list(r[1:5]), r[5]) for r in rows], grown.cuts, s)
    got = {r.k: r.score for r in forest.score(df, "k", grown, s).collect()}
    assert all(abs(got[r[0]] - want(r[1:5])) < 1e-9 for r in rows)
    m = forest.ranking(forest.score(df, "k", grown, s, keep=("y",)), "k", "score", "y").first()
    assert m.auc > 0.9
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0, 1), (2, 0.1, 1.0, 1.0, 1.0, None)], df.schema)
    both = {r.k: r.score for r in forest.score(odd, "k", forest.fit(df.unionByName(odd), "k", list("abcd"), "y", s), s).collect()}
    assert both[1] is None and both[2] is not None


def test_ranking_equals_plain_figures(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.1, 0.2, 0.5, rng.random()]), int(rng.random() < 0.3)) for i in range(150)] + [(900, None, 1)]
    got = forest.ranking(spark.createDataFrame(rows, "k long, s double, y int"), "k", "s", "y", (10, 500)).first()
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    pos, neg = [r for r in known if r[2]], [r for r in known if not r[2]]
    auc = sum((p[1] > q[1]) + (p[1] == q[1]) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    ap = sum(sum(r[1] >= p[1] and r[2] for r in known) / sum(r[1] >= p[1] for r in known) for p in pos) / len(pos)
    tp = sum(r[2] for r in known[:7])
    assert (got.n, got.n_positive) == (150, len(pos))
    assert np.allclose([got.auc, got.average_precision, got.precision_at_10, got.recall_at_500, got.fp_tp], [auc, ap, sum(r[2] for r in known[:10]) / 10, 1.0, (7 - tp) / max(tp, 1)], atol=1e-6)
    empty = forest.ranking(spark.createDataFrame([], "k long, s double, y int"), "k", "s", "y", (10,)).first()
    assert (empty.n, empty.auc, empty.precision_at_10) == (0, None, 0.0)


@pytest.mark.parametrize("size", [7, 100_000])
def test_rank_metrics_of_resamples_equal_plain_lists(spark, size):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.3, rng.random()]), rng.choice([0, 0, 1, None])) for i in range(80)]
    df = spark.createDataFrame([*rows, (500, None, 1)], "k long, s double, y int")
    got = {(r.b, r.metric): r.value for r in resampling.rank_metrics(df, "k", "s", "y", ks=(5, 200), times=6, rows_a_range=size).collect()}
    for b in range(-1, 6):
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        got_list = [r[2] or 0 for r in order for _ in range(1 if b < 0 else drawn(42, b, r[0]))]
        hits = sum(got_list)
        ap = sum(sum(got_list[: i + 1]) / (i + 1) for i, y in enumerate(got_list) if y) / hits
        assert got[b, "precision_at_5"] == pytest.approx(sum(got_list[:5]) / 5)
        assert got[b, "precision_at_200"] == pytest.approx(hits / min(200, len(got_list)))
        assert got[b, "recall_at_5"] == pytest.approx(sum(got_list[:5]) / hits)
        assert got[b, "average_precision"] == pytest.approx(ap)
    assert resampling.rank_metrics(df.limit(0), "k", "s", "y", times=2).agg(F.max("value")).first()[0] == 0.0


@pytest.mark.parametrize("piece", [3, 256])
def test_containment_equals_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(containment, "PIECE", piece)
    rng = random.Random(1)
    make = lambda n: "".join(rng.choices("ab ", k=n))
    hays = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(900, None), (901, "the long éáí passage")]
    needles = [(i, make(rng.randint(0, 14))) for i in range(120)] + [(i + 200, hays[i][1][5:40]) for i in range(20)] + [(900, None), (901, ""), (902, "éá"), (903, hays[3][1]), (904, hays[3][1])]
    n, h = spark.createDataFrame(needles, "n long, a string"), spark.createDataFrame(hays, "h long, b string")
    found = containment.contained(n, "n", "a", h, "h", "b")
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i, a in needles for j, b in hays if a and b and a in b)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert containment.contained(n.limit(0), "n", "a", h, "h", "b").count() == 0
    assert containment.contained(n, "n", "a", h.limit(0), "h", "b").count() == 0


def test_lookup_takes_exact_before_substring_before_zeros(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "bc"), (3, "xabcx"), (4, "qq"), (5, None), (6, "")], "k long, x string")
    table = spark.createDataFrame([(10, "abcabc", 1.5), (11, "abc", 2.5), (12, "abc", 3.5), (13, "", 9.0), (14, None, 9.0)], "o long, t string, v double")
    got = {r.k: (r.kind, r.v) for r in containment.lookup(rows, "k", "x", table, "o", "t", ["v"]).collect()}
    assert got == {1: ("exact", 2.5), 2: ("substring", 1.5), 3: ("substring", 2.5), 4: ("missing", 0.0), 5: ("missing", 0.0), 6: ("exact", 9.0)}


def plain_front(rows, n):
    whole = [r for r in rows if all(v is not None and not math.isnan(v) for v in r[1 : n + 1])]
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))
    return sorted(r[0] for r in rows if r not in whole or not any(beats(o[1 : n + 1], r[1 : n + 1]) for o in whole))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_front_equals_all_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(skyline, "BLOCK", 5)  # many blocks
    rng = random.Random(n)
    rows = [(i, *[rng.choice([rng.randint(0, 4), rng.gauss(0, 2)]) * 1.0 for _ in range(n)]) for i in range(400)]
    rows += [(1000, *rows[0][1:]), (1001, None, *[9.0] * (n - 1)), (1002, float("nan"), *[9.0] * (n - 1)), (1003, *[-0.0] * n), (1004, *[0.0] * n)]
    dims = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{d} double" for d in dims)).repartition(6)
    got = skyline.front(df, dims)
    assert sorted(r.k for r in got.collect()) == plain_front(rows, n)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert skyline.front(df.limit(0), dims).count() == 0


def test_task_fronts_may_be_given_up_early(spark, monkeypatch):
    monkeypatch.setattr(skyline, "HELD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(i, float(i % 37), float(-(i % 37)), float(i % 5)) for i in range(200)]
        df = spark.createDataFrame(rows, "k long, x0 double, x1 double, x2 double").coalesce(1)
        assert sorted(r.k for r in skyline.front(df, ["x0", "x1", "x2"]).collect()) == plain_front(rows, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_utility_scales_by_extremes(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, None, 5.0)], "k long, a double, b double")
    assert {r.k: r._utility for r in skyline.utility(df, {"a": 0.75, "b": 0.25}).collect()} == {1: 0.25, 2: 1.0, 3: 0.25}


def test_learners_of_the_registered_ranker_see_training_groups_only(spark):
    x = learning._shaped(spark, "/root/testdata/sf0.01").select("doc_id", "grp", learning._runs(0, 85)[0].alias("train"))
    by = x.groupBy("grp").agg(F.count_distinct("train").alias("n")).agg(F.max("n")).first()[0]
    assert by == 1
