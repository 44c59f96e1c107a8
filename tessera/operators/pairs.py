"""Pairs of rows and of texts: means over pairs without forming them, one pair a case, similarity of two texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as K


def label_cosines(df: DataFrame, vector: str, label: str) -> DataFrame:
    """One row (same, other): mean cosine over the pairs of equal and of different labels.

    The sum over pairs follows from sums of unit vectors by label, so no pair is formed and what is shuffled is one
    partial sum a label and component. Null and zero vectors and those with non-finite parts are left out.
    """
    x = df.select(label, F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    sums = x.select(label, F.posexplode(F.transform("x", lambda v: v / F.col("n"))).alias("i", "u")).groupBy(label, "i").agg(F.sum("u").alias("s"))
    by = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(x.groupBy(label).agg(F.count("*").alias("c")), label)
    own = by.agg(F.sum("q").alias("q"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    all_ = sums.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    same = F.try_divide(F.col("q") - F.col("n"), F.col("cc") - F.col("n"))
    other = F.try_divide(F.col("t") - F.col("q"), F.col("n") * F.col("n") - F.col("cc"))
    return own.crossJoin(F.broadcast(all_)).select(F.round(same, 6).alias("same"), F.round(other, 6).alias("other"))  # one row each


def case_pairs(df: DataFrame, case: str, key: str, label: str, one, other) -> DataFrame:
    """(case, first, second): the smallest keys of both labels in each case that has both; one aggregation, no self-join."""
    low = lambda v: F.min(F.when(F.col(label) == v, F.col(key)))
    return df.groupBy(case).agg(low(one).alias("first"), low(other).alias("second")).filter("first IS NOT NULL AND second IS NOT NULL")


def two_text_cosine(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, cosine): cosine of tf-idf weights whose idf is fitted on the two texts alone; 0 where either has no term.

    A term of both texts weighs its count, a term of one its count times ln(3/2) + 1. keys must be unique.
    """
    none = F.array().cast("array<string>")
    side = lambda c, p, q: F.transform(F.coalesce(K.tokenize(F.col(c), "plain"), none), lambda t: F.struct(t.alias("term"), F.lit(p).alias("p"), F.lit(q).alias("q")))
    terms = df.select(*keys, F.explode_outer(F.concat(side(a, 1, 0), side(b, 0, 1))).alias("x")).groupBy(*keys, "x.term").agg(F.coalesce(F.sum("x.p"), F.lit(0)).alias("p"), F.coalesce(F.sum("x.q"), F.lit(0)).alias("q"))
    idf = F.when((F.col("p") > 0) & (F.col("q") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    square = lambda c: F.sum(F.col(c) * F.col(c) * idf * idf)
    sums = terms.groupBy(*keys).agg(F.sum(F.col("p") * F.col("q")).alias("dot"), square("p").alias("aa"), square("q").alias("bb"))
    return sums.select(*keys, F.round(F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)), 6).alias("cosine"))


def corpus_cosine(df: DataFrame, key: str, a: str, b: str, stop: list[str] | None = None) -> DataFrame:
    """(key, cosine): cosine of tf-idf weights whose idf is fitted on both texts of all rows; 0 where either has no term.

    Terms are words of two characters or more outside `stop`. The smooth idf ln((1 + n) / (1 + df)) + 1 counts every text
    of every row once. Null text counts as empty; keys must
    be unique.
    """
    none = F.array().cast("array<string>")
    side = lambda c, p, q: F.transform(F.filter(F.coalesce(K.tokenize(F.col(c), "plain", stop), none), lambda t: F.length(t) > 1), lambda t: F.struct(t.alias("term"), F.lit(p).alias("p"), F.lit(q).alias("q")))
    terms = df.select(key, F.explode(F.concat(side(a, 1, 0), side(b, 0, 1))).alias("x")).groupBy(key, "x.term").agg(F.sum("x.p").alias("p"), F.sum("x.q").alias("q"))
    texts = terms.groupBy("term").agg(F.sum((F.col("p") > 0).cast("int") + (F.col("q") > 0).cast("int")).alias("df"))
    n = df.agg((2 * F.count("*")).alias("n"))
    w = terms.join(texts, "term").crossJoin(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)  # one row
    square = lambda c: F.sum(F.col(c) * F.col(c) * F.col("idf") * F.col("idf"))
    sums = w.groupBy(key).agg(F.sum(F.col("p") * F.col("q") * F.col("idf") * F.col("idf")).alias("dot"), square("p").alias("aa"), square("q").alias("bb"))
    cosine = F.try_divide(F.col("dot"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    return df.select(key).join(sums, key, "left").select(key, F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("cosine"))
