"""Nested manifests of odd shapes."""

import json

import pytest

from tessera.operators import nested
from tessera.plans import learning
from tessera.sources import store


def walk(x, path=""):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(x, list) and x:
        for v in x:
            yield from walk(v, path + "[]")
    else:
        yield path


ODD = [{"a": 1, "b": {"c": [1, "x", None, {"d e": True}], "empty": {}, "none": []}}, [], {}, [[1, 2], [3]], "plain", 7, None, {"k": [{"z": [{"z": [0.5]}]}]}]


def test_leaves_equal_a_plain_walk(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(ODD)] + [(90, "{broken"), (91, None)]
    got = nested.leaves(spark.createDataFrame(rows, "k long, j string"), ["k"], "j").collect()
    assert sorted((r.k, r.path) for r in got) == sorted((i, p) for i, x in enumerate(ODD) for p in walk(x))
    assert {r.text for r in got if r.k == 0 and r.path == "b.c[]"} == {"1", "x", None}
    with pytest.raises(ValueError, match="deeper than 2"):
        nested.leaves(spark.createDataFrame(rows, "k long, j string"), ["k"], "j", levels=2)


def test_ledger_keeps_places_and_missing_fields(spark):
    rows = [(1, '{"g": [{"id": "a", "n": 1}, {"id": "b"}], "h": [{"n": "x"}], "scalar": 3, "none": []}'), (2, "[1]"), (3, None), (4, "nope")]
    got = nested.ledger(spark.createDataFrame(rows, "k long, j string"), ["k"], "j", {"id": "string", "n": "bigint"}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "g", 0, "a", 1), (1, "g", 1, "b", None), (1, "h", 0, None, None)], key=str)


def test_leaves_store_rows_once_however_deep_they_are(spark, monkeypatch):
    rows = [(i, '{"a": [1]}') for i in range(200)] + [(200, "[" * 9 + '"x"' + "]" * 9), (201, '{"b": 2} [[[[')]
    made, scratch = [], store.scratch
    monkeypatch.setattr(store, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    got = nested.leaves(spark.createDataFrame(rows, "k long, j string").repartition(5), ["k"], "j").collect()
    assert sorted(map(tuple, got)) == [(i, "a[]", "BIGINT", "1") for i in range(200)] + [(200, "[]" * 9, "STRING", "x"), (201, "b", "BIGINT", "2")]
    assert len(made) == 1 and spark.read.parquet(made[0]).count() == len(rows)


def test_manifests_take_one_shuffle(spark):
    plan = learning._manifests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
