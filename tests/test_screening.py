"""Operators without a SQL form against plain versions, and the schema guards."""

import math
import difflib
import hashlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import audit, errors, metrics, models, relational, retrieval, sampling, validation
from tessera.plans import catalog, screening  # noqa: F401


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_greedy_caps(spark):
    data = [(i % 50, "abc"[i % 3], None if i % 11 == 0 else f"g{i % 7}") for i in range(200)]
    df = spark.createDataFrame(data, "cid long, bucket string, grp string").dropDuplicates(["cid", "bucket"])
    caps, per_group, n = {"b": 6, "a": 5, "c": 40}, 3, 14
    got = [(r.cid, r.bucket) for r in sampling.greedy_caps(df, "cid", "bucket", "grp", caps, per_group, n).orderBy("place").collect()]
    want, groups, seen, rows = [], {}, set(), df.collect()
    for b, cap in caps.items():
        taken = 0
        for r in sorted((r for r in rows if r.bucket == b), key=lambda r: (hashlib.md5(f"42|{r.cid}".encode()).hexdigest(), r.cid)):
            if len(want) == n or taken == cap or r.cid in seen or (r.grp is not None and groups.get(r.grp, 0) >= per_group):
                continue
            seen.add(r.cid)
            taken += 1
            if r.grp is not None:
                groups[r.grp] = groups.get(r.grp, 0) + 1
            want.append((r.cid, b))
    assert got == want and 0 < len(got) <= n


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("same", "same"), ("", "x"), ("private", "thesis")]
    got = [r.s for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", K.sequence_ratio("a", "b").alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs])


def test_alignment(spark):
    rows = [
        (1, "", "some claim text"),
        (2, "the model gains 3 points", "we show the model gains 3 points here"),
        (3, "the model gains 3 points overall", "the model gains 5 points overall"),
        (4, "the model gains points overall today", "the model gains points overall"[::1] + " now"),
        (5, "zzzz qqqq xxxx", "the model gains"),
        (6, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, f string, c string")
    got = {r.k: r.alignment for r in retrieval.alignment(df, "k", "f", "c").collect()}
    assert got == {1: "missing_or_invalid", 2: "exact_or_contained", 3: "conflict_candidate", 4: "high_overlap", 5: "low_or_unrelated", 6: "missing_or_invalid"}


def test_contract(spark):
    df = spark.range(2).withColumn("label", F.lit(1)).withColumn("other", F.lit(2))
    c = validation.Contract(("id", "text"), ("other",), ("label",))
    assert c.problems(df) == ["missing: text", "forbidden: label"]
    assert validation.Contract(("id",)).problems(df, strict=True) == ["unexpected: label", "unexpected: other"]
    with pytest.raises(ValueError, match="missing: text"):
        c.check(df)
    assert validation.Contract(("id",)).check(df) is df


def test_guard_fields(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "k long, score double, gold int")
    assert validation.guard_fields(df.select("k", "score").filter("score > 0"), {"gold"}).count() == 1
    with pytest.raises(ValueError, match="gold"):
        validation.guard_fields(df.orderBy("gold").select("k"), {"gold"})


def test_error_columns(spark):
    assert one(spark, errors.n_sentences(F.lit("One. Two?! x"))) == 2
    assert one(spark, errors.n_sentences(F.lit(None).cast("string"))) == 0
    assert one(spark, errors.tags({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)})) == "a;c"
    assert one(spark, errors.has_tag(F.lit("a;c"), "c")) is True
    assert one(spark, audit.mask_cues(F.lit("It is Always fine, the , end and ."), ["always", "the"])) == "It is fine, end and."


def test_empty_tables(spark):
    none = spark.createDataFrame([], "cid long, grp long, label long, s double, strong boolean")
    assert sampling.per_label(none, "cid", "label", 3).count() == 0
    assert sampling.group_split(none, "grp").count() == 0
    assert sampling.derangement(none, "cid", "grp").count() == 0
    assert metrics.best_threshold(none, "s", "strong").count() == 0
    assert metrics.mcnemar(none.select("strong", (~F.col("strong")).alias("o")), "strong", "o").first().p_value == 1.0
    assert models.temperature(none, "s", "strong", [1.0]).count() == 0


def test_isotonic_is_monotone(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) / 100, (i * 37 % 100) + (i * 13 % 40) > 60) for i in range(200)], "cid long, p double, y boolean")
    rows = models.calibrate(df, "cid", "p", "y").join(df, "cid").orderBy("p").collect()
    for c in ("isotonic", "platt"):
        values = [r[c] for r in rows]
        assert all(a <= b + 1e-12 for a, b in zip(values, values[1:], strict=False)) and 0 <= values[0] and values[-1] <= 1


def test_mcnemar_over_all_candidates(spark):
    sf, part = "/root/testdata/sf0.001", " WHERE cid % 37 = 0 AND grp < 60"
    sql = catalog.oracle_sql()["mcnemar_exact"]
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{sf}/orders.parquet'")
    want = c.sql(sql.replace(part, "")).fetchall()[0]
    got = tuple(catalog.queries()["mcnemar_exact"](spark, sf).first())
    assert got[:2] == want[:2] and got[2] == pytest.approx(want[2], abs=2e-6)


def test_mcnemar_of_many_pairs(spark):
    b, c = 40_000, 40_350
    df = spark.range(b + c).select((F.col("id") < b).alias("one"), (F.col("id") >= b).alias("two"))
    n, total, term = b + c, 0, 1
    for i in range(b + 1):
        total += term
        term = term * (n - i) // (i + 1)
    assert metrics.mcnemar(df, "one", "two").first().p_value == pytest.approx(float(Fraction(2 * total, 2**n)), abs=2e-6)


def test_pareto_over_all_suppliers(spark, tmp_path):
    rows = [(i, round((i * 7331 % 997) * 1.5, 2)) for i in range(1, 301)] + [(400, 2000.0), (401, None)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    m = {k: (a, k * 7919 % 101) for k, a in rows if a is not None}
    want = {k for k, x in m.items() if not any(y[0] >= x[0] and y[1] >= x[1] and y != x for y in m.values())} | {401}
    assert {r.s_suppkey for r in catalog.queries()["pareto_front"](spark, str(tmp_path)).collect()} == want and 400 in want
    three = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1, 1), (3, 2, 0, 0)], "k int, a int, b int, c int")
    assert {r.k for r in relational.pareto(three, "k", ["a", "b", "c"]).collect()} == {1, 3}


def test_alignment_reads_the_whole_text(spark, tmp_path):
    fill = " ".join(f"Other filler number{i} stands here alone." for i in range(40))
    quoted, close = "The model gains three points on the harder set. It loses none elsewhere.", "Deep frost damaged seven vineyards along the northern river"
    docs = [(1, f"{fill} {quoted} {fill}"), (2, f"{fill} {close} valley. {fill}"), (3, f"{fill} Nothing else.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    claims = [(1, quoted.replace(" It", "\n it")), (2, close + " delta."), (3, "Else zebra quartz violins hum softly under marble domes tonight.")]
    spark.createDataFrame(claims, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r.alignment for r in catalog.queries()["alignment_class"](spark, str(tmp_path)).collect()}
    assert got == {1: "exact_or_contained", 2: "high_overlap", 3: "low_or_unrelated"}
    empty = spark.createDataFrame([(1, None, "a claim"), (2, "", None)], "k int, t string, c string")
    assert {r.k: r.found for r in retrieval.closest_window(empty, "k", "t", "c").collect()} == {1: None, 2: None}


def test_action_shortcut(spark):
    rows = [("we improve and extend it", "they improved things", True), ("we improve and extend it", "improvements extended", False), ("we build it", "building on sand", False), ("we build it", "no such thing", True), ("nothing here", "x", False), ("we build it", "", False)]
    got = spark.createDataFrame(rows, "c string, e string, want boolean").select("want", errors.action_shortcut(F.col("c"), F.col("e")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_platt_of_odd_counts(spark):
    counts = lambda rows: spark.createDataFrame(rows, "s double, p double, n double")
    assert models.platt(counts([])) == (0.0, 0.0)
    a, b = models.platt(counts([(0.5, 3.0, 4.0)]))
    assert a == 0.0 and b == pytest.approx(math.log(3))
    a, b = models.platt(counts([(0.0, 1.0, 4.0), (1.0, 3.0, 4.0)]))
    assert (a, b) == (pytest.approx(2 * math.log(3)), pytest.approx(-math.log(3)))
