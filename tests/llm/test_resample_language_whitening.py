"""Importance resampling, language identification and whitening against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, resample, whitening

SF = "/root/testdata/sf0.001"


def plain_resample(rows, target, depth, buckets=10_000, seed=2024, least=20, percent=10):
    def runs(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t)[1])
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text in rows:
        w, f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w) >= least])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(best[: len(best) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def text_of(rng, n, words="aa ab Ba é日本 c9 dd ee ÀB x".split()):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-_-"]) for _ in range(n))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_resample_equals_plain_version(spark, monkeypatch, depth):
    monkeypatch.setattr(resample, "MOST_NODES", 10)  # tries start anew again and again
    rng = random.Random(depth)
    rows = [(i, text_of(rng, rng.randint(0, 60))) for i in range(300)]
    rows += [(3, rows[3][1]), (None, text_of(rng, 40)), (-5, None), (900, ""), (901, "!?"), (902, text_of(rng, 30_000))]
    target = [text_of(rng, 20, ["aa", "c9", "é日本"]), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.lit(1).alias("weight"), "doc_id", F.lit(2).alias("rank"), "text", F.lit(3).alias("score"))
    got = resample.resample(docs.repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), depth, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, depth, percent=30)


def test_resample_equals_plain_version_on_documents(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resample.resample(docs, target).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 1)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    assert resample.resample(none, some).collect() == []
    assert [tuple(r)[:2] + tuple(r)[4:] for r in resample.resample(some, none).collect()] == [(1, 2, None)]


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)
    text = b"Hello, wonderfully long World! a b c 12x" * 3
    assert [w for part in resample.words(text) for w in part] == re.findall(b"[0-9a-z\x80-\xff]+", text.lower())


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_sees_texts_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text for r in docs.limit(50).collect()]
    alone = [model.predict([t])[0][0] for t in texts]
    assert model.predict(texts)[0] == alone
    shifted = language.identify(docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))))
    assert {r.lang_pred for r in shifted.collect()} <= {"en", "de", "fr", "es"}


def test_language_of_odd_rows(spark):
    rng = random.Random(2)
    some = {"aa": "bcdfg", "bb": "vwxyz", "cc": "βγδεζ"}
    make = lambda lang, n: " ".join("".join(rng.choices(some[lang], k=4)) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(list(some) * 40)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (None, make("bb", 9), None), (5, rows[5][1], rows[5][2]), (1003, make("cc", 200_000), None), (1004, "b", None), (1005, "B" * 70_000, None), (1006, "qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("LANG_PRED", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows) - 1
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert (got[None].lang_pred, got[1003].lang_pred, got[1004].lang_pred, got[1005].lang_pred) == ("bb", "cc", "aa", "aa")
    assert got[1006].rejected and got[1006].lang_pred in some
    assert got[1003].score > 0.5
    assert language.identify(docs.limit(0)).collect() == []
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_runs_of_letters_against_a_plain_count(monkeypatch):
    texts = ["Ab  c-dé", "", "9", "éa " * 5, "xyz" * 11]
    want = []
    for t in texts:
        s = " " + "".join(c if language.kinds()[ord(c)] else " " for c in t.lower()) + " "
        n = len(s)
        runs = [s[i] for i in range(n) if s[i] != " "] + [s[i : i + 2] for i in range(n - 1) if s[i : i + 2] != "  "] + [s[i : i + 3] for i in range(n - 2) if s[i + 1] != " "]
        want.append(Counter(runs))
    whole, has = language.bucket_counts(texts)
    for v, w in zip(whole, want, strict=True):
        assert v.sum() == w.total() and 0 <= len(w) - np.count_nonzero(v) <= 2  # few runs share a bucket
    assert has.tolist() == [True, False, False, True, True]
    monkeypatch.setattr(language, "SLICE", 3)
    assert np.array_equal(language.bucket_counts(texts)[0], whole)


def plain_whiten(rows, most=16):
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    d = max((len(v) for _, v in good), default=0)
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] + [1_000_000] * (d - len(v)) for _, v in good], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:most] > 1e-10 * e[0]).sum())
    off = n * x - s
    w = (off / n).astype(float) @ u[:, :k] / np.sqrt(e[:k])
    return n, [int((r * r).sum()) for r in off], w, e[:k] / e.sum(), [i for i, _ in good]


def compare(got, rows, most=16):
    n, deviation, w, share, ids = plain_whiten(rows, most)
    assert len(got) == w.size
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, w.shape[1] + 1))
    for c, mine in by.items():
        have = np.array([mine[i][0].whitened for i in ids])
        assert min(np.abs(have - w[:, c - 1]).max(), np.abs(have + w[:, c - 1]).max()) < 1e-6
        assert [mine[i][0].deviation for i in ids] == deviation
        assert {(r.n, r.explained) for rs in mine.values() for r in rs} == {(n, mine[ids[0]][0].explained)}
        assert abs(mine[ids[0]][0].explained / share[c - 1] - 1) < 1e-4
    assert max(r.identity_error for r in got) <= 1e-4 and len({r.identity_error for r in got}) == 1


def test_whitening_equals_plain_version_on_embeddings(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    compare(whitening.whiten(v).collect(), [(r.vec_id, r.embedding) for r in v.collect()])


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 4)  # several aggregations
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1][:3]), (102, []), (103, [-1e5] * 5), (104, [0.0] * 4)]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 5), (203, [1.0, float("inf")])]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("x", F.lit("y"))
    compare(whitening.whiten(v).collect(), rows + odd)
    twice = whitening.whiten(v.unionByName(v.filter("vec_id = 7"))).filter("vec_id = 7").collect()
    assert len(twice) == 10 and twice[0].n == len({tuple(math.floor(64 * e) for e in x) for _, x in rows if x})
    assert whitening.whiten(v.limit(0)).collect() == []
    assert whitening.whiten(v.filter("vec_id in (0, 100, 200)")).collect() == []
    two = whitening.whiten(v.filter("vec_id in (0, 1, 100)")).collect()
    assert {r.component for r in two} == {1} and {r.n for r in two} == {2}


def test_deviation_that_no_long_holds_is_an_error(spark):
    v = spark.createDataFrame([(i, [float(i % 7), (-1) ** i * 1e8]) for i in range(60)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds a long"):
        whitening.whiten(v).collect()
