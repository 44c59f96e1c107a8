"""Comparisons on small cases: nulls, ties, missing rows, and a plain version of the queue's change."""

import random

from pyspark.sql import functions as F

from tessera.operators import comparison, corpus


def test_selection_oracle(spark):
    rows = [(0, "same text", 1, "same text", 2), (1, "five words shared by both", 3, "five words shared by all", 3), (2, "five words shared by both", 3, "five words shared by all", 4), (3, None, 0, None, 0), (4, "x", 0, "y", 0), (5, "!", 2, "!", 2)]
    x = comparison.selection_oracle(spark.createDataFrame(rows, "id int, s string, sp int, e string, p int"), "s", "sp", "e", "p")
    got = {r.id: (r.hash_exact, r.page_match, r.overlap, r.hit) for r in x.collect()}
    assert got == {0: (True, False, 1.0, True), 1: (False, True, 0.8, True), 2: (False, False, 0.8, False), 3: (False, False, 0.0, False), 4: (False, False, 0.0, False), 5: (True, True, 0.0, True)}


def test_by_dice_ties_and_empty(spark):
    units = spark.createDataFrame([(1, 0, "b a"), (1, 1, "a b"), (1, 2, "c"), (1, 3, None), (2, 0, "a")], "d int, u int, t string")
    claims = spark.createDataFrame([(1, "a b"), (3, "a")], "d int, c string")
    got = [(r.d, r.u, r.score, r["rank"]) for r in comparison.by_dice(units, claims, "d", "u", "t", "c", 3).orderBy("rank").collect()]
    assert got[:2] == [(1, 0, 1.0, 1), (1, 1, 1.0, 2)] and len(got) == 3
    assert comparison.by_dice(units.limit(0), claims, "d", "u", "t", "c", 3).count() == 0


def test_deltas_and_need(spark):
    x = spark.createDataFrame([(1, "correct", 0.9), (1, "empty", 0.4), (2, "correct", 0.5), (3, "empty", 0.1), (4, "correct", 0.7), (4, "empty", 0.2)], "k int, c string, m double")
    got = comparison.deltas(x, "k", "c", ["m"], {"empty": ["m"]})
    assert {r.k: (r.m, r.m_delta_empty) for r in got.collect()} == {1: (0.9, 0.5), 2: (0.5, None), 3: (None, None), 4: (0.7, 0.49999999999999994)}
    need = comparison.evidence_need(got.select("k", F.round("m_delta_empty", 6).alias("n")), "k", "n", 1).collect()
    assert [(r.end, r.place, r.k) for r in need] == [("top", 1, 1), ("bottom", 1, 1)]


def test_boundary_cases_and_signals(spark):
    x = spark.createDataFrame([(1, 1, 2, 2, 1), (2, 2, 1, 1, 3), (3, 0, 0, 0, 1), (4, 3, 3, 3, 3)], "k int, t int, s int, sl int, r int")
    forced = spark.createDataFrame([(4,), (4,), (9,)], "k int")
    got = {(r.k, r.case_type) for r in comparison.boundary_cases(x, "k", "t", "s", "sl", "r", forced).collect()}
    assert got == {(1, "scalar_high_but_mild"), (1, "routed_right_scalar_wrong"), (2, "scalar_low_but_strong"), (2, "both_wrong"), (3, "scalar_right_routed_wrong"), (4, "strong_action_too_forced")}
    p = [(1, "t", m, v, c) for m, v, c in [("judge", "claim_only", True), ("judge", "claim_evidence", False), ("a", "claim_only", True), ("a", "claim_evidence", True)]] + [(2, "t", "a", "evidence_only", True), (2, "t", "b", "evidence_only", True)]
    got = {r.k: (r.claim_only, r.claim_evidence, r.evidence_only, r.patterns) for r in comparison.signal_audit(spark.createDataFrame(p, "k int, target string, model string, view string, correct boolean"), "k", "target", "judge").collect()}
    assert got == {1: (2, 1, 0, "judge_right_without_evidence_only;claim_only_advantage"), 2: (0, 0, 2, "evidence_only_prior")}


def test_upgrade_effects_against_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.random() < 0.4, rng.randrange(4), rng.randrange(30) / 30, rng.randrange(12) / 12, rng.randrange(12) / 12) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, truth int, was boolean, label int, overlap double, new double, old double")
    learned = df.filter("k % 7 <> 0").select("k", "label", (F.col("label") == 2).alias("flag"), "overlap")
    got = comparison.upgrade_effects(df.select("k", "truth", F.col("was").alias("flag")), learned, df.select("k", F.col("new").alias("score")), df.select("k", F.col("old").alias("score")), "k", depth=40)
    kept = [r for r in rows if r[0] % 7]
    for r in got.collect():
        k, truth, was, label, overlap, new, old = rows[r.k]
        ahead, before = sum(x[5] > new for x in kept) < 40, sum(x[6] > old for x in kept) < 40
        assert r.ranker == {1: "helped", 0: "neutral", -1: "harmed"}[ahead - before]
        assert r.selector == {1: "helped", 0: "neutral", -1: "harmed"}[(label == 2) - was]
        assert (r.screening == "recovery") == (truth == 2 == label and not was) and r.missed == (overlap < 0.1)
    assert got.count() == len(kept)


def test_windows_within_the_row(spark):
    docs = spark.createDataFrame([(1, "One is. Two is. Three is. Four is."), (2, "Only one."), (3, ""), (4, None)], "doc_id int, text string")
    a = corpus.forward_windows(corpus.sentences(docs)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, corpus.document_windows(docs).collect())) and len(a) == 3


def test_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(12)))), (2, "too short"), (3, " \n"), (4, ""), (5, None)], "doc_id int, text string")
    assert [(r.doc_id, r.chunk, r.n_words) for r in corpus.chunks(docs, 10, 6, 5).orderBy("doc_id", "chunk").collect()] == [(1, 0, 10), (1, 1, 6)]
