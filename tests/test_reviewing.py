"""Sheets, reasons and mismatched evidence on small cases."""

from pyspark.sql import functions as F

from tessera.operators import review


def test_recoded_names_codes_and_the_rest(spark):
    rows = [(1, " 强行动过度 ", "是", "x"), (2, "supported", "no", None), (3, None, "", "足够"), (4, "别的", "否", "不足")]
    df = spark.createDataFrame(rows, "`审计编号` int, `人工标签` string, `是否二审` string, `系统证据是否足够` string").withColumn("odd.name", F.lit(5))
    got = review.recoded(df)
    assert got.columns == ["audit_item_id", "auditor_label", "requires_second_review", "selected_evidence_sufficiency", "odd.name"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, "strong_action_overclaim", "True", "x"), (2, "supported", "no", None), (3, None, "", "sufficient"), (4, "别的", "False", "insufficient")]
    both = spark.createDataFrame([("支持", "english wins")], "`人工标签` string, auditor_label string")
    assert [tuple(r) for r in review.recoded(both).collect()] == [("english wins",)]
    assert review.recoded(df.limit(0)).count() == 0


def test_audit_counts_unranked_rows_as_early(spark):
    s, o = review.STRONG, "supported"
    rows = [("a", s, s, "3", "4", "True"), ("a", s, o, "", "9", "False"), ("a", s, s, "21", "x", "true"), ("a", o, s, "1", "2", None), ("a", "", s, "1", None, None), ("b", None, s, None, None, None)]
    df = spark.createDataFrame(rows, "domain string, auditor_label string, silver_label string, queue_rank string, auditor_confidence string, requires_second_review string")
    got = {r.domain: tuple(r)[1:] for r in review.audit(df, "domain").collect()}
    assert got == {"a": (4, 3, 0.5, 2, 3.0, 0.5), "b": (0, 0, None, 0, None, None)}


def test_reason(spark):
    rows = [(1, review.STRONG, 0.1, 0.2), (2, "supported", 0.4, 0.9), (3, "supported", 0.399, 0.4), (4, "supported", 0.0, None), (5, "supported", None, 0.1)]
    df = spark.createDataFrame(rows, "id int, l string, s double, c double")
    got = {r.id: r.reason for r in df.select("id", review.reason(F.col("l"), F.col("s"), F.col("c")).alias("reason")).collect()}
    assert got == {1: "R4 flagged strong_action (p_strong=0.100, p_contra=0.200)", 2: "High p_strong=0.400 but below threshold; pred=supported", 3: "High p_contra=0.400; pred=supported", 4: "Low priority; pred=supported", 5: "Low priority; pred=supported"}


def test_mismatched_never_lends_to_itself(spark):
    for n in (1, 2, 3, 50):
        df = spark.createDataFrame([(i, f"e{i}") for i in range(n)] + [(1000, None)], "k long, e string")
        got = review.mismatched(df, "k", "e").collect()
        assert len(got) == (n if n > 1 else 0)
        assert all(r.k != r.wrong_key and r.wrong_evidence == f"e{r.wrong_key}" and r.e == f"e{r.k}" for r in got)
    few = review.mismatched(df, "k", "e", most=7).collect()
    assert len(few) == 7 and {(r.k, r.wrong_key) for r in few} <= {(r.k, r.wrong_key) for r in got}
    assert review.mismatched(df.limit(0), "k", "e").count() == 0
