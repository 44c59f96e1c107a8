"""Cases that larger and odd tables brought up: word edges beside other letters, vocabularies without a bound, work within rows."""

import hashlib
import math

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import comparison, containment, corpus, resampling, retrieval, rules, sparse
from tessera.plans import comparing


def test_letters_beyond_ascii_end_words(spark):
    said = lambda x: spark.range(1).select(x.alias("x")).first().x
    claim = F.lit("Zu er tzer erge dem chen ver chung erie enerst. Bestö.")
    assert said(rules.single_realism(claim, F.lit(""), F.lit(2))) == "too_extreme"
    assert said(rules.single_realism(F.lit("Zu er tzer erge dem chen ver chung erie enerst. Besto."), F.lit(""), F.lit(2))) == "mild_strong_boundary_unclear"
    assert said(K.word_cues(F.lit("notö anot not_ x"), ["not"])) == 1
    assert said(K.word_cues(F.lit("anot not_ x"), ["not"])) == 0
    assert said(T.section_hint(F.lit("Abstractä"))) == "abstract"
    assert said(T.clean_chunk(F.lit("Seite ö3/4ü hier"))) == "Seite öü hier"


def test_vocabularies_have_no_bound_of_their_own(spark):
    n = 1 << 18
    terms = spark.range(n + 1).select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1).cast("long").alias("tf"))
    v = sparse.vocabularies(terms, "fold", {0: n, 1: n, 2: n})
    assert {tuple(r) for r in v.groupBy("held_out").agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i")).collect()} == {(f, n + 1, 0, n, n + 1) for f in range(3)}
    few = sparse.vocabularies(terms.filter("length(term) < 4"), "fold", {0: n, 1: n, 2: n}, most=13)
    first = sorted(f"t{i}" for i in range(100))[:13]
    assert {(r.held_out, r.i): r.term for r in few.collect()} == {(f, i): t for f in range(3) for i, t in enumerate(first)}


def test_terms_of_a_text_are_counted_within_its_row(spark):
    rows = spark.createDataFrame([(1, 0, "aa bb aa bb"), (2, 1, None), (3, 1, "")], "k long, fold int, text string")
    terms = sparse.fold_terms(rows, "k", "fold", F.col("text"))
    assert sorted(map(tuple, terms.collect())) == [(1, 0, "aa", 2), (1, 0, "aa bb", 2), (1, 0, "bb", 2), (1, 0, "bb aa", 1)]
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()


def test_scores_in_small_blocks_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 2 + i % 40))) for i in range(300)] + [(300, None)], "doc_id long, text string")
    claims = spark.createDataFrame([(i, f"w{i % 17} w{i % 5} w{i % 3}") for i in range(60)], "item_id long, text string")
    run = lambda: sorted(map(tuple, retrieval.bm25(docs, ["doc_id"], "text", claims, "item_id", "text").collect()))
    want = run()
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 7)
    assert want and run() == want


def test_centred_windows_are_cut_within_the_row(spark):
    docs = spark.createDataFrame([(1, "A b c d e. Short one. F g h i j? K l m n o."), (2, None), (3, "")], "doc_id long, text string")
    got = corpus.document_centred(docs)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "A b c d e. F g h i j?"), (1, 2, "A b c d e. F g h i j? K l m n o."), (1, 3, "F g h i j? K l m n o.")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_centred_words_are_those_of_the_windows(spark):
    docs = spark.createDataFrame([(1, "A b c-d the e. Short one. F g h i j? K l m n o. P q r s t."), (2, None), (3, "")], "doc_id long, text string")
    got = corpus.centred_words(docs, stop=["the"])
    want = corpus.document_centred(docs).select("doc_id", "sent_id", K.tokenize(F.col("window"), stop=["the"]).alias("words"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "regexp_extract_all" not in plan
    said = spark.range(1).select(*[T.has_words(F.lit(x), 3).alias(f"c{i}") for i, x in enumerate(["a b", "a b ", " \t\na\nb\tc", "a b c d", "", "   "])]).first()
    assert list(said) == [False, False, True, True, False, False]


def test_the_closest_sentence_is_found_within_the_row(spark):
    rows = [(1, ["x y", "a b c", "c b q", "a b z"], "a b c", 1), (2, ["only"], "only", 0), (3, ["p", "q"], None, None), (4, ["p q", "r", "s t"], "r", 1)]
    got = comparison.closest(spark.createDataFrame(rows, "k long, s array<string>, claim string, at int"), "s", "claim", "at")
    assert sorted((r.k, r.selected, r.selected_at) for r in got.collect()) == [(1, "c b q", 2), (2, None, None), (3, None, None), (4, "p q", 0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_claims_are_cut_once_however_often_they_are_read(spark):
    claims = comparing._claims(spark, "/root/testdata/sf0.001")
    assert claims.count() and "split(" not in claims._jdf.queryExecution().executedPlan().toString()


def test_few_texts_are_looked_up_where_they_stand(spark, monkeypatch):
    n = spark.createDataFrame([(1, "ein langer Satz über Wörter"), (2, "kurz"), (3, "über Wört"), (4, "steht nirgends"), (5, None), (6, ""), (7, "x" * 300)], "a long, s string")
    h = spark.createDataFrame([(1, "davor ein langer Satz über Wörter danach"), (2, "zu kurz"), (3, "y" * 250 + "x" * 310), (4, None)], "b long, t string")
    run = lambda: sorted(map(tuple, containment.contained(n, "a", "s", h, "b", "t").collect()))
    want = [(1, 1), (2, 2), (3, 1), (7, 3)]
    assert run() == want
    assert sorted(r.a for r in containment._possible(n.filter("length(s) > 0").select("a", F.col("s").alias("needle")), h.select("b", F.col("t").alias("hay"))).collect()) == [1, 2, 3, 7]
    monkeypatch.setattr(containment, "FEW", 0)
    assert run() == want
    monkeypatch.setattr(containment, "LITERALS", 0)
    assert run() == want


def test_draws_are_counted_on_digits_and_never_travel(spark):
    want = {k: [sum(c <= int(hashlib.md5(f"42|{b}|{k}".encode()).hexdigest()[:8], 16) / 4294967296 for c in resampling.CHANCES) for b in range(30)] for k in range(50)}
    got = spark.range(50).select("id", resampling.draws("id", 30).alias("w"))
    assert {r.id: r.w for r in got.collect()} == want and got.schema["w"].dataType.elementType.simpleString() == "tinyint"
    edges = [d for c in resampling.CHANCES for i in (-1, 0, 1) if 0 <= (d := math.ceil(c * 4294967296) + i) < 4294967296]
    said = spark.createDataFrame([(d, f"{d:08x}") for d in edges], "d long, x string").select("d", resampling._drawn(F.col("x")).alias("w")).collect()
    assert all(r.w == sum(c <= r.d / 4294967296 for c in resampling.CHANCES) for r in said)


def test_a_fit_has_no_more_partitions_than_its_share_of_the_cores(spark, monkeypatch):
    seen, fit = [], sparse.logistic
    monkeypatch.setattr(sparse, "logistic", lambda train, *a: (seen.append((train.rdd.getNumPartitions(), train.columns)), fit(train, *a))[1])
    rows = spark.createDataFrame([(i, i % 3, f"word{i % 2} also word{i % 5}", i % 2) for i in range(120)], "k long, fold int, text string, y int").repartition(40)
    got = sparse.out_of_fold(rows, "k", "fold", F.col("text"), "y").collect()
    assert len(got) == 120 and all(r.truth == r.predicted for r in got)
    assert len(seen) == 3 and max(n for n, _ in seen) <= -(-spark.sparkContext.defaultParallelism // 3)
