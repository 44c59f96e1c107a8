"""Exact BM25 over postings, retrieval metrics and evidence selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import text as T
from tessera.functions import tokens as K

# Texts that stand for a missing one.
PLACEHOLDERS = ("197", "nan", "none", "null", "n/a", "na", "todo", "tbd", "-")


#: Query terms held by a worker at once (about 50 MB); more queries are taken in blocks of that size.
BLOCK_TERMS = 500_000
#: Pairs of a unit's word and a query that holds it which a worker adds up at once, and cells of units by queries.
BLOCK_POSTINGS, BLOCK_CELLS = 3_000_000, 4_000_000


def bm25(units: DataFrame, keys: list[str], text: str, queries: DataFrame, query_id: str, query_text: str, top: int = 10, k1: float = 1.5, b: float = 0.75, dedup_query: bool = False, stop: list[str] | None = None, cut: bool = False) -> DataFrame:
    """(query_id, keys, score, rank): the top units by Okapi BM25 over all units.

    With cut, the column text holds a unit's words, as K.tokenize gives them, without stop words.
    Query terms count as often as they occur, or once with dedup_query; stop words are left out of units and queries.
    Units without a query term are not ranked (see pad); ties go by keys; a missing text is a unit of no words. Two passes over the units: one counts lengths
    and, by map-side sums, the documents of the queries' terms; the other scores every unit against the queries where
    it stands and lets only the best `top` of a partition leave it. So neither postings nor scores are shuffled, and a
    term that all units and queries share costs additions in memory only. Queries travel in blocks of BLOCK_TERMS.
    """
    toks = K.tokenize(F.col(query_text), stop=stop)
    q = queries.select(F.col(query_id).alias("q_id"), F.explode(F.array_distinct(toks) if dedup_query else toks).alias("term")).groupBy("q_id", "term").agg(F.count("*").alias("qtf"))
    sized = units.select(*keys, (F.col(text) if cut else K.tokenize(F.coalesce(F.col(text), F.lit("")), stop=stop)).alias("toks"))
    blocks = max(1, -(-q.count() // BLOCK_TERMS))
    parts = [_scored(sized, keys, q.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i), top, k1, b) for i in range(blocks)]
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), *keys))
    return total.withColumn("rank", rank).filter(F.col("rank") <= top).withColumnRenamed("q_id", query_id)


def _scored(sized: DataFrame, keys: list[str], q: DataFrame, top: int, k1: float, b: float) -> DataFrame:
    """(q_id, keys, score): the best `top` units of every partition for each query of a block."""
    spark = sized.sparkSession
    rows = q.toPandas().sort_values(["term", "q_id"], ignore_index=True)  # BLOCK_TERMS rows at most, or one query's
    wanted = F.broadcast(q.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string")))
    seen = sized.select(F.size("toks").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("toks"))).alias("term"))
    counts = seen.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words")).toPandas()
    whole = counts[counts.term == ""]
    n = int(whole.df.iloc[0]) if len(whole) else 0
    avgdl = float(whole.words.iloc[0]) / n if n else 0.0
    terms, first = np.unique(rows.term.to_numpy(str), return_index=True) if len(rows) else (np.zeros(0, str), np.zeros(0, int))
    ids, at = np.unique(rows.q_id.to_numpy(), return_inverse=True) if len(rows) else (np.zeros(0), np.zeros(0, int))
    df = counts.set_index("term").df.reindex(terms).fillna(0).to_numpy(float)
    index = spark.sparkContext.broadcast((terms, np.append(first, len(rows)), at, rows.qtf.to_numpy(float), np.log((n - df + 0.5) / (df + 0.5) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edge, qs, qtf, idf = index.value
        known, many, reps_of = pa.array(words, pa.string()), max(1, len(ids)), np.diff(edge)
        step = max(1, BLOCK_CELLS // many)
        best: pd.DataFrame | None = None
        bar = np.zeros(many)
        for whole in batches:
            column = whole.column(len(keys))
            sizes = np.asarray(pc.list_value_length(column).fill_null(0), float)
            found = pc.index_in(column.flatten(), known)
            at_unit, codes = np.repeat(np.arange(whole.num_rows), sizes.astype(int))[np.asarray(found.is_valid())], np.asarray(found.drop_null())
            ends = np.concatenate(([0], np.cumsum(np.bincount(at_unit, minlength=whole.num_rows))))
            cost = np.concatenate(([0], np.cumsum(np.bincount(at_unit, reps_of[codes], whole.num_rows))))
            hi = 0
            while hi < whole.num_rows:
                lo, hi = hi, min(hi + step, whole.num_rows, max(hi + 1, int(np.searchsorted(cost, cost[hi] + BLOCK_POSTINGS, side="right")) - 1))
                part, dl = whole.slice(lo, hi - lo), sizes[lo:hi]
                unit = at_unit[ends[lo] : ends[hi]] - lo
                pair, tf = np.unique(unit * len(words) + codes[ends[lo] : ends[hi]].astype(np.int64), return_counts=True)
                u, t = np.divmod(pair, max(1, len(words)))
                weight = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[u] / (avgdl or 1.0)))
                reps = edge[t + 1] - edge[t]
                posting = np.repeat(edge[t] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
                score = np.bincount(np.repeat(u, reps) * many + qs[posting], np.repeat(weight, reps) * qtf[posting], part.num_rows * many).reshape(-1, many)
                i, j = np.nonzero(score >= np.maximum(bar - 1e-4, 1e-5))  # what rounding may lift over the bar
                s = np.floor(score[i, j] * 1e4 + 0.5) / 1e4
                kept = (s > 0) & (s >= bar[j])
                i, j, s = i[kept], j[kept], s[kept]
                if not len(i):
                    continue
                new = part.select(range(len(keys))).to_pandas().iloc[i].reset_index(drop=True).assign(_q=j, _s=s)
                best = new if best is None else pd.concat((best, new), ignore_index=True)
                best = best.sort_values(["_q", "_s", *keys], ascending=[True, False, *[True] * len(keys)]).groupby("_q", sort=False).head(top)
                last = best.groupby("_q").agg(c=("_s", "size"), s=("_s", "min"))
                bar[last.index[last.c == top]] = last.s[last.c == top]
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.assign(q_id=ids[best["_q"]], score=best["_s"])[["q_id", *keys, "score"]], schema=out, preserve_index=False)

    fields = T_.StructType([q.schema["q_id"], *[sized.schema[k] for k in keys], T_.StructField("score", T_.DoubleType())])
    out = to_arrow_schema(fields)
    return sized.mapInArrow(run, fields)


def bm25_within(units: DataFrame, scope: str, key: str, text: str, queries: DataFrame, query_text: str, top: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(scope, key, score, rank): the top units of each document for its own query, by BM25 over that document's units only.

    queries (scope, query_text), one row for each document. All counts are within documents, so everything is keyed by
    scope, and only terms of the query leave a unit.
    """
    q = queries.select(scope, K.tokenize(F.col(query_text)).alias("q"))
    rows = units.select(scope, key, K.tokenize(F.col(text)).alias("toks")).withColumn("dl", F.size("toks")).join(q, scope)
    all_ = Window.partitionBy(scope)
    rows = rows.withColumn("n", F.count("*").over(all_)).withColumn("avgdl", F.avg("dl").over(all_)).withColumn("hit", F.array_intersect("toks", "q"))
    tf = lambda t: F.size(F.filter("toks", lambda x: x == t))
    qtf = lambda t: F.size(F.filter("q", lambda x: x == t))
    post = rows.select(scope, key, "dl", "n", "avgdl", F.explode(F.transform("hit", lambda t: F.struct(t.alias("term"), tf(t).alias("tf"), qtf(t).alias("qtf")))).alias("x")).select(scope, key, "dl", "n", "avgdl", "x.*")
    post = post.withColumn("df", F.count("*").over(Window.partitionBy(scope, "term")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = post.groupBy(scope, key).agg(F.round(F.sum(part), 4).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), key))).filter(F.col("rank") <= top)


def pad(ranked: DataFrame, queries: DataFrame, query_id: str, units: DataFrame, key: str, top: int) -> DataFrame:
    """ranked filled to `top` rows a query with the first units by key that it lacks, at score 0."""
    first = units.select(key).orderBy(key).limit(2 * top).withColumn("score", F.lit(0.0))  # a bounded list
    fill = queries.select(query_id).crossJoin(F.broadcast(first)).join(ranked.select(query_id, key), [query_id, key], "left_anti")
    both = ranked.select(query_id, key, "score").unionByName(fill)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), key))).filter(F.col("rank") <= top)


def recall_mrr(ranked: DataFrame, hits: DataFrame, queries: DataFrame, query_id: str, on: list[str], cutoffs: tuple = (1, 5, 10)) -> DataFrame:
    """One row: recall at each cutoff and mean reciprocal rank of the first hit, over all queries."""
    first = ranked.join(hits.select(query_id, *on).distinct(), [query_id, *on], "left_semi").groupBy(query_id).agg(F.min("rank").alias("first"))
    every = queries.select(query_id).distinct().join(first, query_id, "left")
    return every.agg(*[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in cutoffs], F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def best_sentence(candidates: DataFrame, sentences: DataFrame, on: str, query_id: str) -> DataFrame:
    """(query_id, on, sent_id, score): the sentence with the highest Dice overlap times length penalty; the earliest wins.

    candidates (query_id, on, claim), sentences (on, sent_id, sentence).
    """
    n = F.size(F.filter(F.split("sentence", r"\s+"), lambda t: t != ""))
    penalty = F.when(n < 8, 0.5).when(n > 60, 0.7).otherwise(1.0)
    scored = candidates.join(sentences, on).withColumn("score", F.round(K.dice(K.tokenize(F.col("claim")), K.tokenize(F.col("sentence"))) * penalty, 6))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), on, "sent_id")
    return scored.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(query_id, on, "sent_id", "score")


def closest_window(pairs: DataFrame, key: str, text: str, claim: str, least: int = 10) -> DataFrame:
    """(key, claim, found): the run of sentences of the whole text that is closest to the claim; one row for each key.

    The text itself where it contains the claim. Else, of the runs of one sentence up to one more than the claim has
    (three at least), at every offset, one of `least` characters within the claim, then the highest Dice overlap, then
    the earliest and shortest. A missing text gives null.
    """
    plain = lambda c: T.normalize_space(F.lower(F.coalesce(c, F.lit(""))))
    rows = pairs.select(key, F.col(claim).alias("claim"), F.col(text).alias("t"))
    rows = rows.withColumn("whole", (plain(F.col("claim")) != "") & F.contains(plain(F.col("t")), plain(F.col("claim"))))
    longest = F.greatest(F.lit(3), F.size(T.split_sentences(F.coalesce("claim", F.lit("")))) + 1)
    parts = rows.filter("NOT whole").select(key, "claim", T.split_sentences(F.col("t")).alias("s"), longest.alias("m"))
    at = parts.select("*", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("at")).filter("size(s) > 0")
    runs = at.select(key, "claim", "at", F.slice("s", F.col("at"), F.col("m")).alias("s")).select(key, "claim", "at", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    runs = runs.select(key, "claim", "at", "n", F.array_join(F.slice("s", F.lit(1), F.col("n")), " ").alias("found"))
    inside = (F.length(plain(F.col("found"))) >= least) & F.contains(plain(F.col("claim")), plain(F.col("found")))
    order = F.struct((~inside).alias("outside"), (-F.round(K.dice(K.tokenize(F.col("claim")), K.tokenize(F.col("found"))), 6)).alias("far"), "at", "n")
    best = runs.groupBy(key).agg(F.min_by("found", order).alias("best"))
    return rows.join(best, key, "left").select(key, "claim", F.when(F.col("whole"), F.col("t")).otherwise(F.col("best")).alias("found"))


def alignment(pairs: DataFrame, key: str, found: str, claim: str, high: float = 0.60, partial: float = 0.20, least: int = 10) -> DataFrame:
    """(key, alignment, similarity): how a found text sits against a claim.

    Missing texts first, then containment either way, then the larger of block matching and token overlap, where
    differing numbers make a conflict. Pairs are top-ranked rows, a few for each claim.
    """
    a, b = T.normalize_space(F.lower(F.coalesce(F.col(found), F.lit("")))), T.normalize_space(F.lower(F.coalesce(F.col(claim), F.lit(""))))
    rows = pairs.select(key, F.col(found).alias("f"), F.col(claim).alias("c"), a.alias("a"), b.alias("b"))
    shared = K.jaccard(F.array_distinct(K.tokenize(F.col("a"))), F.array_distinct(K.tokenize(F.col("b"))))
    rows = rows.withColumn("similarity", F.round(F.greatest(K.sequence_ratio("a", "b"), shared), 6))
    missing = (F.length("a") < least) | F.col("a").isin(*PLACEHOLDERS) | F.rlike("a", F.lit("^[0-9]+$")) | (F.col("b") == "")
    within = F.contains("b", F.col("a")) | F.contains("a", F.col("b"))
    kind = F.when(missing, "missing_or_invalid").when(within, "exact_or_contained").when((F.col("similarity") >= partial) & K.number_conflict(F.col("f"), F.col("c")), "conflict_candidate")
    kind = kind.when(F.col("similarity") >= high, "high_overlap").when(F.col("similarity") >= partial, "partial_overlap").otherwise("low_or_unrelated")
    return rows.select(key, kind.alias("alignment"), F.when(missing, 0.0).when(within, 1.0).otherwise(F.col("similarity")).alias("similarity"))
