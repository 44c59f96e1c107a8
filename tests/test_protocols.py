"""Selectors, folds, splits and containment on small cases with known results."""

from pyspark.sql import functions as F

from tessera.operators import pairs, protocols, selection

LONG = "alpha beta gamma delta epsilon zeta eta theta"


def test_containing(spark):
    docs = spark.createDataFrame([(1, f"x{LONG}y"), (2, LONG.replace(" ", "  ")), (3, f"so {LONG} {LONG}"), (4, None), (5, ""), (6, "a" * 50 + " b"), (7, "alpha")], "doc int, text string")
    claims = spark.createDataFrame([(1, LONG), (2, "a" * 40 + " b"), (3, "alpha"), (4, None), (5, LONG + " iota"), (6, "a" * 45)], "item int, claim string")
    got = protocols.containing(docs, "doc", "text", claims, "item", "claim")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 3), (2, 6), (6, 6)]
    assert protocols.containing(docs.limit(0), "doc", "text", claims, "item", "claim").count() == 0


def test_two_sentences_and_length(spark):
    first = "Red cats run far. Green cows sleep long today. Red cats run home fast. Blue fish swim."
    rows = [(1, "red cats run home fast", 1, 7, 0, first), (1, "red cats run home fast", 2, 8, 0, "Red cats run home now."), (2, "red cats run", 1, 9, 0, "Red cats run."), (3, "red cats run", 1, 9, 0, "Red.")]
    top = spark.createDataFrame(rows, "q int, claim string, rank int, doc_id int, unit int, text string")
    got = {r.q: (r.evidence, r.reason) for r in selection.two_sentences(top, "q").collect()}
    # the neighbours in the chunk come before the closer sentence of the other chunk; equals go to the earlier one
    assert got == {1: ("Green cows sleep long today. Red cats run home fast.", "best+neighbor_overlap"), 2: ("Red cats run.", "best_only_no_neighbor")}
    fits = {r.q: (r.evidence, r.fits) for r in selection.length_limited(top, "q", 5, 5).collect()}
    assert fits == {1: ("Red cats run home fast.", True), 2: ("Red cats run.", False)}


def test_pseudo_labels(spark):
    one = spark.createDataFrame([(1, "a cat", "a cat", 1, 1, 0, "The only cat here.")], "q int, claim string, oracle string, rank int, doc_id int, unit int, text string")
    assert [r.label for r in selection.pseudo_labels(one, "q").collect()] == [1]
    text = " ".join(f"Cat number {w} sits here." for w in ("one", "two", "three", "four"))
    many = spark.createDataFrame([(1, "cat three", "cat three", k, k, 0, text) for k in (1, 2)], "q int, claim string, oracle string, rank int, doc_id int, unit int, text string")
    got = selection.pseudo_labels(many, "q").orderBy("place").collect()
    assert [(r.rank, r.label) for r in got] == [(1, 1), (1, -1), (1, 0), (1, 0)] and "three" in got[0].evidence


def test_fold_bayes(spark):
    rows = [(0, 1, "good fine", 1), (0, 2, "bad poor", 0), (1, 3, "good good", 1), (1, 4, "bad", 0), (2, 5, None, 1), (2, 6, "unheard", 0)]
    df = spark.createDataFrame(rows, "f int, k int, t string, y int")
    got = {r.key: r.predicted for r in protocols.fold_bayes(df, "k", "f", "t", "y", [0, 1]).collect()}
    # texts without a known term go by the priors, equal here, so to the first label
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    alone = protocols.fold_bayes(df.filter("f = 0"), "k", "f", "t", "y", [0, 1]).collect()
    assert [r.predicted for r in alone] == [None, None]
    f1 = protocols.fold_f1(protocols.fold_bayes(df, "k", "f", "t", "y", [0, 1]), [0, 1], 1)
    assert {r.fold: (r.n, r.macro_f1, r.f1) for r in f1.collect()} == {0: (2, 1.0, 1.0), 1: (2, 1.0, 1.0), 2: (2, 0.333333, 0.0)}
    assert protocols.fold_bayes(df.limit(0), "k", "f", "t", "y", [0, 1]).count() == 0


def test_votes_and_methods(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    votes = spark.createDataFrame([(1, "test", 2), (1, "test", 1), (1, "dev", 3), (1, "dev", 3), (2, "dev", 3), (3, "train", 1)], "k int, s string, p int")
    assert {tuple(r) for r in protocols.fold_votes(keys, votes, "k", "s", "p").collect()} == {(1, 1, 2, "test"), (2, 3, 1, "dev"), (3, -1, 0, "train_only")}
    m = spark.createDataFrame([("b", 0.5, 0.1, False), ("a", 0.5, 0.9, False), ("c", 0.9, 0.9, True), ("c", 0.9, 0.9, False)], "m string, e1 double, e2 double, out boolean")
    best = lambda x: tuple(protocols.best_method(x, "m", "e1", "e2", "out").first())
    assert best(m) == ("a", 0.5)
    assert best(m.withColumn("e1", F.lit(None).cast("double"))) == ("a", 0.9)
    assert best(m.filter("out")) == ("none", 0.0)


def test_held_out(spark):
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") % 9 < 8, F.col("id") % 9).alias("g"))
    got = {r.side: r for r in protocols.held_out(df, "id", "g", 2, F.col("id") % 2 == 0).collect()}
    assert set(got) == {"train", "dev", "test"} and sum(r.n for r in got.values()) == 200
    assert all(r.n_leaked == 0 for r in got.values()) and 44 <= got["test"].n <= 46


def test_seed_votes_and_cosine(spark):
    df = spark.createDataFrame([(1, 2, 0.2, 1), (1, 0, 0.4, 0), (2, 3, 1.0, 1)], "k int, p int, c double, f int")
    got = {r.k: r for r in protocols.seed_votes(df, "k", "p", ["c"], "f", [0, 1, 2, 3]).collect()}
    assert (got[1].predicted, got[1].c, got[1].flag, got[1].n_seeds) == (0, 0.3, 0, 2)
    assert (got[2].predicted, got[2].flag, got[2].entropy) == (3, 1, 0.0)
    texts = spark.createDataFrame([(1, "red cat", "red cat"), (2, "red cat", "blue fish"), (3, None, "red"), (4, "", "")], "k int, a string, b string")
    assert {r.k: r.cosine for r in pairs.corpus_cosine(texts, "k", "a", "b", ["the"]).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_weighted_sentence(spark):
    top = spark.createDataFrame([(1, "red cat", 1, 7, 0, 9.0, "Blue fish swim."), (1, "red cat", 2, 8, 0, 1.0, "Red cat sleeps.")], "q int, claim string, rank int, doc_id int, unit int, score double, text string")
    pick = lambda w: selection.weighted_sentence(top, "q", 2, w).first().doc_id
    assert pick(0.0) == 8 and pick(0.2) == 7
