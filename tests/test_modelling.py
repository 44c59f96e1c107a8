"""Pairs, folds and linear classifiers on small fixtures."""

import pytest

from tessera.operators import evaluation, pairs


@pytest.mark.parametrize("kind", ["svm", "logistic"])
def test_linear_classifier_separates(spark, kind):
    rows = [(i, [float(i % 7), float(i % 5), 3.0], int(i % 7 + 2 * (i % 5) > 7)) for i in range(140)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    got = {r.k: r.predicted for r in evaluation.linear_classifier(df.filter("k < 100"), df.filter("k >= 100"), "k", "v", "y", kind).collect()}
    assert len(got) == 40 and sum(got[k] == y for k, _, y in rows[100:]) >= 38


def test_label_cosines_leaves_out_empty_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, None), (2, [0.0, 0.0])], "y int, v array<double>")
    assert tuple(pairs.label_cosines(df, "v", "y").first()) == (1.0, 0.0)


def test_held_out_threshold_comes_from_the_other_folds(spark):
    rows = [("a", 0.9, True), ("a", 0.1, False), ("b", 0.6, True), ("b", 0.4, False)]
    got = {r.f: (r.threshold, r.test_f1) for r in evaluation.held_out_thresholds(spark.createDataFrame(rows, "f string, s double, p boolean"), "f", "s", "p", [0.2, 0.5, 0.8]).collect()}
    assert got == {"a": (0.5, 1.0), "b": (0.2, 0.666667)}


def test_two_text_cosine(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "b"), (3, None, "b"), (4, "", "")], "k long, x string, y string")
    assert {r.k: r.cosine for r in pairs.two_text_cosine(df, ["k"], "x", "y").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
