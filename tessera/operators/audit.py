"""Leakage, integrity and redaction audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def shared_hashes(df: DataFrame, text: str, group: str) -> DataFrame:
    """(text_hash, n_rows, n_groups): texts that occur in more than one group."""
    return df.select(T.sha256_text(F.col(text)).alias("text_hash"), group).groupBy("text_hash").agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups")).filter("n_groups > 1")


def token_log_odds(df: DataFrame, text: str, positive: str, least: int = 5) -> DataFrame:
    """(term, n_pos, n_neg, log_odds): documents of each class with a term, add-one smoothed."""
    terms = df.select(F.col(positive).cast("long").alias("y"), F.explode(F.array_distinct(K.tokenize(F.col(text), "plain"))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg")).filter(F.col("n_pos") + F.col("n_neg") >= least)
    total = df.agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg"))
    odds = F.log((F.col("n_pos") + 1) / (F.col("pos") + 2)) - F.log((F.col("n_neg") + 1) / (F.col("neg") + 2))
    return counts.crossJoin(F.broadcast(total)).select("term", "n_pos", "n_neg", F.round(odds, 6).alias("log_odds"))


def cue_rates(df: DataFrame, text: str, label: str, cues: list[str]) -> DataFrame:
    """(label, one rate for each cue): share of texts that hold the cue."""
    low = F.lower(F.col(text))
    return df.groupBy(label).agg(*[F.round(F.avg(F.contains(low, F.lit(c)).cast("int")), 6).alias(f"rate_{i}") for i, c in enumerate(cues)])


def purity(df: DataFrame, unit: str, label: str) -> DataFrame:
    """One row: mean share of the most frequent label over units of more than one row."""
    per = df.groupBy(unit, label).agg(F.count("*").alias("n")).groupBy(unit).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.filter("all > 1").agg(F.round(F.avg(F.col("top") / F.col("all")), 6).alias("purity"), F.count("*").alias("n_units"))


def prefix_rule(train: DataFrame, rows: DataFrame, text: str, label: str, key: str, words: int = 4) -> DataFrame:
    """(key, predicted): the majority label of the text's prefix in train, else of all of train; ties to the smallest."""
    pref = T.prefix_key(F.col(text), words)
    counts = train.withColumn("prefix", pref).groupBy("prefix", label).agg(F.count("*").alias("n"))
    best = counts.withColumn("rn", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), label))).filter("rn = 1").select("prefix", F.col(label).alias("own"))
    common = train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("common"))
    return rows.withColumn("prefix", pref).join(best, "prefix", "left").crossJoin(F.broadcast(common)).select(key, F.coalesce("own", "common").alias("predicted"))


def redacted(df: DataFrame, texts: list[str]) -> DataFrame:
    """df with each text column replaced by its hash and length."""
    out = df
    for c in texts:
        out = out.withColumn(f"{c}_sha256", T.sha256_text(F.col(c))).withColumn(f"{c}_length", F.length(F.coalesce(F.col(c), F.lit("")))).drop(c)
    return out


def long_lines(df: DataFrame, key: str, text: str, least: int = 300) -> DataFrame:
    """(key, n_long): texts with lines longer than `least`, and how many."""
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(x) > least))
    return df.select(key, n.alias("n_long")).filter("n_long > 0")


def url_hosts(pages: DataFrame) -> DataFrame:
    """(host, n_pages): pages by the host of their address."""
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"))


def overlap_by_label(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """(label, mean_overlap, mean_tokens, upper_median): token overlap of two texts, and token counts of the first."""
    ta, tb = K.tokenize(F.col(a), "plain"), K.tokenize(F.col(b), "plain")
    rows = df.select(label, K.jaccard(F.array_distinct(ta), F.array_distinct(tb)).alias("o"), F.size(ta).alias("n"))
    counts = rows.groupBy(label, "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(label)
    # the upper median from counts of distinct lengths, so no list of a label's rows is built
    mid = counts.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("t", F.sum("c").over(w)).filter(F.col("upto") > F.floor(F.col("t") / 2)).groupBy(label).agg(F.min("n").alias("upper_median"))
    return rows.groupBy(label).agg(F.round(F.avg("o"), 6).alias("mean_overlap"), F.round(F.avg("n"), 6).alias("mean_tokens")).join(mid, label)


def label_cues(df: DataFrame, key: str, text: str, label: str, top: int = 5, least: int = 5) -> DataFrame:
    """(label, term, rate, other_rate): the terms most over-represented in a label's texts against all others."""
    rows = df.select(key, label, F.explode(F.array_distinct(K.tokenize(F.col(text), "plain"))).alias("term"))
    c = rows.groupBy(label, "term").agg(F.count("*").alias("c"))
    total = c.groupBy("term").agg(F.sum("c").alias("t"))
    size = df.groupBy(label).agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("all"))
    r = c.filter(F.col("c") >= least).join(total, "term").join(F.broadcast(size), label).crossJoin(F.broadcast(n))
    r = r.select(label, "term", F.round(F.col("c") / F.col("n"), 6).alias("rate"), F.round(F.try_divide(F.col("t") - F.col("c"), F.col("all") - F.col("n")), 6).alias("other_rate"))
    w = Window.partitionBy(label).orderBy(F.desc(F.round(F.col("rate") - F.coalesce("other_rate", F.lit(0.0)), 6)), "term")
    return r.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).drop("rn")


def prefix_distribution(df: DataFrame, text: str, label: str, words: int = 4) -> DataFrame:
    """(prefix, n, dominant, share): rows of each prefix and its most frequent label, the smallest on ties."""
    c = df.select(T.prefix_key(F.col(text), words).alias("prefix"), label).groupBy("prefix", label).agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("m"), F.col(label).alias("l")))
    return c.groupBy("prefix").agg(F.sum("c").alias("n"), best.alias("b")).select("prefix", "n", F.col("b.l").alias("dominant"), F.round(-F.col("b.m") / F.col("n"), 6).alias("share"))


def purity_lift(df: DataFrame, text: str, positive: str, least: int = 2, lift: float = 0.2) -> DataFrame:
    """(term, df, purity): terms whose share of positive texts is more than `lift` from that of all texts."""
    t = df.select(F.col(positive).cast("long").alias("y"), F.explode(F.array_distinct(K.tokenize(F.col(text), "plain"))).alias("term"))
    c = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("p")).filter(F.col("df") >= least)
    base = df.agg(F.avg(F.col(positive).cast("long")).alias("base"))
    pure = F.col("p") / F.col("df")
    return c.crossJoin(F.broadcast(base)).filter(F.abs(pure - F.col("base")) > lift).select("term", "df", F.round(pure, 6).alias("purity"))


def mask_cues(x, cues: list[str]):
    """x without the cues as whole words, longest first, with its punctuation closed up."""
    words = "|".join(sorted(cues, key=lambda c: (-len(c), c)))
    out = T.normalize_space(F.regexp_replace(x, T.edged(rf"(?i)\b(?:{words})\b", words=False), ""))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([,.])", "$1"), r",\s*,", ",")
    return T.normalize_space(F.regexp_replace(out, r"\s+and\s+\.", "."))


def template_risk(df: DataFrame, group: str, key: str, text: str, limit: float = 0.6) -> DataFrame:
    """(key columns, sibling_mean, template_like): a row's mean token similarity to the rest of its group.

    Groups are claim groups of a few rows each; pairs never leave their group.
    """
    t = df.select(group, key, F.array_distinct(K.tokenize(F.col(text))).alias("t"))
    o = t.select(F.col(group).alias("g2"), F.col(key).alias("k2"), F.col("t").alias("t2"))
    pairs = t.join(o, (F.col(group) == F.col("g2")) & (F.col(key) != F.col("k2")))
    return pairs.groupBy(group, key).agg(F.round(F.avg(K.jaccard(F.col("t"), F.col("t2"))), 6).alias("sibling_mean")).withColumn("template_like", F.col("sibling_mean") > limit)
