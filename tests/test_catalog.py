"""Every registered query against its SQL at the smallest scale, and expressions on literals."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import scoring
from tessera.plans import catalog, comparing, evidence, filework, judging, learning, modelling, protocols, reviewing, screening, tablework  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def show(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.6f}"
        return "null" if v is None else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, T.dehyphenate(F.lit("exam-\n ple"))) == "example"
    assert one(spark, T.repair_linebreaks(F.lit("a\nb\n\n\n c "))) == "a b\n\nc"
    assert one(spark, T.split_sentences(F.lit('One. Two? "Three" 3.5 four.'))) == ["One.", "Two?", '"Three" 3.5 four.']
    assert one(spark, T.merge_abbreviations(F.array(F.lit("See Fig."), F.lit("2 now."), F.lit("End.")), ["Fig."])) == ["See Fig. 2 now.", "End."]
    assert one(spark, T.section_hint(F.lit("1 Introduction"))) == "introduction"
    assert one(spark, T.section_hint(F.lit(""))) == "unknown"
    assert one(spark, T.sha256_text(F.lit(None).cast("string"))) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_similarity(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    none = F.array().cast("array<string>")
    assert one(spark, K.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, K.dice(a, b)) == pytest.approx(0.5)
    assert one(spark, K.jaccard(none, none)) == 0.0
    assert one(spark, K.jaccard(none, none, 1.0)) == 1.0
    assert one(spark, K.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a__b", "b__c"]
    assert one(spark, K.number_conflict(F.lit("3 of 4"), F.lit("3 of 5"))) is True
    assert one(spark, K.count_terms(F.lit("Deployment"), ["deploy", "deployment", "x"])) == 2


def test_capped_queue_is_greedy(spark):
    data = [(i, i % 3, (i * 37) % 50) for i in range(60)]
    got = [r.cid for r in scoring.capped_queue(spark.createDataFrame(data, "cid long, grp long, s long"), "s", "cid", "grp", 4, 10).orderBy("queue_rank").collect()]
    want, taken = [], {}
    for cid, grp, s in sorted(data, key=lambda r: (-r[2], r[0])):
        if taken.get(grp, 0) < 4 and len(want) < 10:
            want.append(cid)
            taken[grp] = taken.get(grp, 0) + 1
    assert got == want


def test_minmax_of_a_constant(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k long, v double")
    assert [r.v_norm for r in scoring.scaled(df, ["v"]).collect()] == [0.5, 0.5]


def test_containment_of_whole_texts(spark, tmp_path):
    claim = "a passage that stands far down in one document only"
    spark.createDataFrame([(1, "x " * 500 + claim + " y"), (2, claim[:40]), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, claim), (8, "x x"), (9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(r) for r in catalog.queries()["text_containment"](spark, str(tmp_path)).collect()] == [(7, 1)]
