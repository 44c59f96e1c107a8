"""Evidence selectors, evidence variants and the lexical features of claim-evidence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K

# Names of the selectors and of the evidence variants, in their order.
SELECTORS = ("raw_top1_chunk", "cleaned_top1_chunk", "first_sentence_top1", "best_sentence_top1_overlap", "best_sentence_top5_overlap", "three_sentence_window_top5", "sentence_bm25_top1", "window_bm25_top1")
VARIANTS = ("oracle_clean", "oracle_plus_metadata", "oracle_lengthened", "oracle_plus_metadata_lengthened", "raw_bm25_top1_chunk", "cleaned_bm25_top1_chunk", "canonicalized_best_sentence_top5", "canonicalized_three_sentence_window_top5")
# Lexicons of claims and evidence.
LEXICONS = {
    "claim_action": (
        "deploy", "deployment", "real-world", "real world", "production", "operational", "safe", "robust", "guarantee", "all scenarios",
        "all settings", "all environments", "replace", "should be used", "policy", "engineering decision", "ready for use", "in practice", "uniformly",
        "without caveat", "irrespective", "across all", "will be", "must be", "always",
    ),
    "evidence_support": (
        "real-world validation", "field deployment", "production test", "external validation", "safety certification", "multi-site evaluation",
        "stress test", "failure analysis", "operational trial", "empirical validation", "benchmark results", "ablation", "evaluation",
        "experiments show", "results demonstrate", "we evaluate", "we compare", "performance", "accuracy", "ground truth",
    ),
    "certainty": (
        "will", "must", "always", "guarantee", "ensure", "definitely", "certainly",
    ),
    "deployment": (
        "deploy", "deployment", "production", "operational", "field",
    ),
    "metric": (
        "metric", "accuracy", "precision", "recall", "f1", "score", "benchmark", "baseline",
    ),
    "scope": (
        "may", "might", "could", "some", "subset", "narrow", "broad", "scope", "boundary", "limit",
    ),
}


def terms(name: str) -> list[str]:
    return list(LEXICONS[name])


_FIELDS = ("doc_id", "unit", "rank", "score", "n_words", "source_type", "evidence")


def _penalty(n: Column) -> Column:
    return F.when(n < 8, 0.5).when(n > 60, 0.7).otherwise(1.0)


def _overlap(claim: str, sentence: str) -> Column:
    stop = K.STOP_WORDS["selection"]
    return K.dice(K.tokenize(F.col(claim), stop=stop), K.tokenize(F.col(sentence), stop=stop))


def best_sentences(top: DataFrame, query_id: str, most: int) -> DataFrame:
    """(query_id, doc_id, unit, rank, score, n_words, evidence, window): the best sentence of the first `most` chunks.

    top: (query_id, claim, rank, doc_id, unit, text). The score is Dice overlap times length penalty over sentences of
    three words or more; of equals the earliest wins. window: the sentence with its neighbours in the chunk.
    """
    s = top.filter(F.col("rank") <= most).select(query_id, "claim", "rank", "doc_id", "unit", T.split_chunk(T.clean_chunk(F.col("text"))).alias("all"))
    s = s.select("*", F.posexplode("all").alias("i", "evidence")).withColumn("n_words", T.count_words(F.col("evidence"))).filter("n_words >= 3")
    s = s.withColumn("score", _overlap("claim", "evidence") * _penalty(F.col("n_words")))
    first = Window.partitionBy(query_id).orderBy(F.desc("score"), "rank", "i")
    best = s.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    window = F.array_join(F.slice("all", F.greatest(F.col("i"), F.lit(1)), F.when(F.col("i") > 0, 3).otherwise(2)), " ")
    return best.select(query_id, "doc_id", "unit", "rank", "score", "n_words", "evidence", window.alias("window"))


def select(name: str, claims: DataFrame, query_id: str, top: DataFrame, sentences: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, unit, rank, score, n_words, source_type, evidence): what a selector picks for every claim.

    top: ranked chunks as in best_sentences(), with score; sentences and windows: ranked units (query_id, doc_id, unit,
    rank, score, text). A claim for which nothing is there gets the empty selection: rank 0, score 0, type empty.
    """
    one = top.filter("rank = 1").withColumn("clean", T.clean_chunk(F.col("text")))
    plain = lambda x, kind, text: x.withColumn("evidence", F.col(text)).withColumn("n_words", T.count_words(F.col("evidence"))).withColumn("source_type", F.lit(kind))
    if name == "raw_top1_chunk":
        out = plain(one, "raw_chunk", "text")
    elif name == "cleaned_top1_chunk":
        out = plain(one, "cleaned_chunk", "clean")
    elif name == "first_sentence_top1":
        s = T.split_chunk(F.col("clean"))
        long_ = F.get(F.filter("s", lambda x: T.count_words(x) >= 5), F.lit(0))
        out = plain(one.withColumn("s", s).withColumn("pick", F.coalesce(long_, F.get("s", F.lit(0)))), "first_sentence", "pick")
    elif name in ("best_sentence_top1_overlap", "best_sentence_top5_overlap", "three_sentence_window_top5"):
        most = 1 if "top1" in name else 5
        best = best_sentences(top, query_id, most).withColumn("score", F.round("score", 6))
        out = plain(best, "window_3", "window") if "window" in name else plain(best, f"best_sentence_top{most}", "evidence")
    else:
        out = plain((sentences if name.startswith("sentence") else windows).filter("rank = 1"), name.removesuffix("_top1"), "text")
    got = claims.select(query_id).join(out.select(query_id, *_FIELDS), query_id, "left")
    default = {"rank": F.lit(0), "score": F.lit(0.0), "n_words": F.lit(0), "source_type": F.lit("empty"), "evidence": F.lit("")}
    return got.select(query_id, *[F.coalesce(F.col(c), default[c]).alias(c) if c in default else F.col(c) for c in _FIELDS])


def closest_bounded(pairs: DataFrame, key: str, claim: str, text: str) -> DataFrame:
    """(key, i, score, evidence, window): the sentence of 4 to 80 words closest to the claim, with a window of three.

    Dice overlap of distinct words of three letters or more, the earliest of equals; the middle sentence where the claim
    has no such word. The window is filled from the other side at either end.
    """
    words = lambda c: F.array_distinct(K.tokenize(c, "word"))
    s = pairs.select(key, words(F.col(claim)).alias("c"), T.split_bounded(T.clean_markup(F.col(text))).alias("all")).filter(F.size("all") > 0)
    at = s.select("*", F.posexplode("all").alias("i", "evidence")).withColumn("score", F.when(F.size("c") > 0, K.dice(F.col("c"), words(F.col("evidence")))).otherwise(F.when(F.col("i") == F.floor(F.size("all") / 2), 1.0).otherwise(0.0)))
    best = at.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "i"))).filter("rn = 1")
    start = F.greatest(F.lit(0), F.least(F.col("i") - 1, F.size("all") - 3)).cast("int")
    return best.select(key, "i", F.when(F.size("c") > 0, F.round("score", 6)).otherwise(0.0).alias("score"), "evidence", F.array_join(F.slice("all", start + 1, F.lit(3)), " ").alias("window"))


def variants(claims: DataFrame, query_id: str, first: DataFrame, second: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, variant, evidence, n_words, sha, uses_oracle, has_metadata, lengthened): eight evidence texts a claim.

    claims: (query_id, title, page, oracle); first, second: (query_id, text) of the chunks of rank 1 and 2; best:
    (query_id, evidence, window). What a claim lacks is the empty text.
    """
    x = claims.join(first.select(query_id, F.col("text").alias("t1")), query_id, "left").join(second.select(query_id, F.col("text").alias("t2")), query_id, "left").join(best.select(query_id, F.col("evidence").alias("b1"), F.col("window").alias("b3")), query_id, "left")
    e = {c: F.coalesce(F.col(c), F.lit("")) for c in ("oracle", "t1", "t2", "b1", "b3")}
    head = F.concat(F.lit("Title: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("unknown")), F.lit(" Page: "), F.col("page").cast("string"), F.lit(" Section: unknown"))
    longer = F.when(e["t2"] == "", e["oracle"]).otherwise(F.trim(F.concat(e["oracle"], F.lit(" "), e["t2"])))
    with_head = lambda t: F.when(t == "", head).otherwise(F.concat(head, F.lit("\n"), t))
    texts = (e["oracle"], with_head(e["oracle"]), longer, with_head(longer), e["t1"], T.clean_chunk(e["t1"]), e["b1"], e["b3"])
    rows = [F.struct(F.lit(n).alias("variant"), t.alias("evidence"), F.lit(n.startswith("oracle")).alias("uses_oracle"), F.lit("metadata" in n).alias("has_metadata"), F.lit("lengthened" in n).alias("lengthened")) for n, t in zip(VARIANTS, texts, strict=True)]
    out = x.select(query_id, F.inline(F.array(*rows)))
    return out.select(query_id, "variant", "evidence", T.count_words(F.col("evidence")).alias("n_words"), T.sha256_text(F.col("evidence")).alias("sha"), "uses_oracle", "has_metadata", "lengthened")


def action_gaps(claim: Column, evidence: Column) -> dict[str, Column]:
    """Eight lexicon gaps between a claim and its evidence, as whole numbers."""
    c = lambda name: K.count_terms(claim, terms(name))
    e = lambda name: K.count_terms(evidence, terms(name))
    act = c("claim_action")
    return {
        "action_escalation_gap": act - e("evidence_support"),
        "claim_action_strength": act,
        "evidence_action_support": e("evidence_support"),
        "deployment_gap": c("deployment") - e("deployment"),
        "metric_to_action_gap": act - e("metric"),
        "certainty_gap": c("certainty") - e("certainty"),
        "scope_gap": c("scope") - e("scope"),
        "length_diff": F.length(claim) - F.length(evidence),
    }


def toy_scores(claim: Column, evidence: Column) -> dict[str, Column]:
    """A closed-form stand-in for the trained cascade: overlap, action terms, three probabilities and a label."""
    stop = K.STOP_WORDS["toy"]
    a, b = (F.array_distinct(K.tokenize(x, "plain", stop)) for x in (claim, evidence))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    action = K.count_terms(evidence, ["deploy", "production", "safe", "guarantee", "must", "always"])
    empty = (claim == "") | (evidence == "")
    contra = F.when(empty, 0.1).otherwise(F.greatest(F.lit(0.05), 0.3 - overlap * 0.5))
    strong = F.when(empty, 0.1).otherwise(F.least(F.lit(0.9), 0.2 + action * 0.15))
    svm = F.when(empty, 0.3).otherwise(0.3 + overlap * 0.2)
    label = F.when(empty, "supported").when(contra > 0.25, "contradiction_candidate").when(strong > 0.4, "strong_action_overclaim").when(svm > 0.4, "mild_scope_overclaim").otherwise("supported")
    return {"p_contra": F.round(contra, 6), "p_strong": F.round(strong, 6), "p_svm": F.round(svm, 6), "pred_label": label}


def pair_features(claim: Column, evidence: Column, negations: list[str]) -> dict[str, Column]:
    """Shares of common and of own words, of numbers, and negation counts of a claim and its evidence."""
    ct, et = K.tokenize(claim, "plain"), K.tokenize(evidence, "plain")
    a, b = F.array_distinct(ct), F.array_distinct(et)
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    na, nb = K.numbers(claim), K.numbers(evidence)
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0)), 6)
    neg = lambda t: F.size(F.filter(t, lambda w: w.isin(*negations)))
    return {
        "in_claim": share(both, F.size(a)),
        "in_evidence": share(both, F.size(b)),
        "in_both": share(both, every),
        "claim_only": share(F.size(a) - both, F.size(a)),
        "evidence_only": share(F.size(b) - both, F.size(b)),
        "numbers_shared": share(F.size(F.array_intersect(na, nb)), F.size(F.array_union(na, nb))),
        "numbers_differ": K.number_conflict(claim, evidence).cast("int"),
        "claim_negations": neg(ct),
        "negation_gap": F.abs(neg(ct) - neg(et)),
        "length_ratio": share(F.size(ct), F.size(et)),
        "claim_words": F.size(a),
    }


def standardised(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """columns less the mean and over the standard deviation of the training rows; a deviation of 0 counts as 1."""
    part = [f(F.when(train, F.col(c))).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    out = df.crossJoin(F.broadcast(df.agg(*part)))  # one row
    scale = lambda c: F.when(F.coalesce(F.col(f"{c}_sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{c}_sd"))
    return out.select(*[c for c in df.columns if c not in columns], *[F.round((F.col(c) - F.col(f"{c}_mean")) / scale(c), 6).alias(c) for c in columns])


def chunk_sentences(top: DataFrame, query_id: str) -> DataFrame:
    """(query_id, claim, doc_id, unit, rank, i, n_words, overlap, evidence): sentences of three words or more, with Dice overlap.

    top: ranked chunks as in best_sentences(), a few for each claim; i is the sentence's place in its chunk.
    """
    s = top.select(query_id, "claim", "rank", "doc_id", "unit", F.posexplode(T.split_chunk(T.clean_chunk(F.col("text")))).alias("i", "evidence"))
    s = s.withColumn("n_words", T.count_words(F.col("evidence"))).filter("n_words >= 3")
    return s.select(query_id, "claim", "doc_id", "unit", "rank", "i", "n_words", _overlap("claim", "evidence").alias("overlap"), "evidence")


def two_sentences(top: DataFrame, query_id: str) -> DataFrame:
    """(query_id, doc_id, unit, rank, score, n_words, reason, evidence): the closest sentence and one beside it.

    The partner is the closest neighbour in the chunk, else the closest other sentence of the chunk, else the next
    closest of all. Two of one chunk stand in the chunk's order, others in the order of their overlap.
    """
    by = Window.partitionBy(query_id).orderBy(F.desc("overlap"), "rank", "i")
    s = chunk_sentences(top, query_id).withColumn("rn", F.row_number().over(by))
    for c in ("unit", "doc_id", "i"):
        s = s.withColumn(f"b_{c}", F.first(c).over(by))
    same = (F.col("unit") == F.col("b_unit")) & (F.col("doc_id") == F.col("b_doc_id"))
    s = s.withColumn("near", F.when(F.col("rn") == 1, 0).when(same & (F.abs(F.col("i") - F.col("b_i")) == 1), 1).when(same, 2).otherwise(3))
    pair = Window.partitionBy(query_id).orderBy("near", "rn")
    s = s.withColumn("p", F.lead(F.struct("evidence", "i", "near")).over(pair)).filter("rn = 1")
    text = F.when(F.col("p").isNull(), F.col("evidence")).when((F.col("p.near") < 3) & (F.col("p.i") < F.col("i")), F.concat_ws(" ", "p.evidence", "evidence")).otherwise(F.concat_ws(" ", "evidence", "p.evidence"))
    reason = F.when(F.col("p").isNull(), "best_only_no_neighbor").otherwise("best+neighbor_overlap")
    return s.select(query_id, "doc_id", "unit", "rank", F.round("overlap", 6).alias("score"), T.count_words(text).alias("n_words"), reason.alias("reason"), text.alias("evidence"))


def length_limited(top: DataFrame, query_id: str, low: int = 10, high: int = 40) -> DataFrame:
    """(query_id, doc_id, unit, rank, score, n_words, fits, evidence): the closest sentence of low to high words, else of any length."""
    s = chunk_sentences(top, query_id).withColumn("fits", F.col("n_words").between(low, high))
    first = Window.partitionBy(query_id).orderBy(F.desc("fits"), F.desc("overlap"), "rank", "i")
    best = s.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return best.select(query_id, "doc_id", "unit", "rank", F.round("overlap", 6).alias("score"), "n_words", "fits", "evidence")


def weighted_sentence(top: DataFrame, query_id: str, most: int, weight: float = 0.0) -> DataFrame:
    """(query_id, doc_id, unit, rank, score, n_words, evidence): the best of the first `most` chunks by overlap + weight * chunk score.

    top: as in best_sentences(), with score; of equals the earliest wins.
    """
    chunks = top.filter(F.col("rank") <= most)
    s = chunk_sentences(chunks, query_id).join(chunks.select(query_id, "rank", F.col("score").alias("base")), [query_id, "rank"])
    s = s.withColumn("score", F.round(F.col("overlap") + weight * F.col("base"), 6))
    best = s.withColumn("rn", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "rank", "i"))).filter("rn = 1")
    return best.select(query_id, "doc_id", "unit", "rank", "score", "n_words", "evidence")


def pseudo_labels(top: DataFrame, query_id: str) -> DataFrame:
    """(query_id, rank, i, n_words, overlap, place, label, evidence): sentences marked for training by their place.

    A sentence that stands in several chunks counts once, in the best of them. By overlap with the known evidence, the
    column oracle of top, the first 30 % of a claim's sentences are 1 and the last half 0, at least one each; the others
    are -1. Of equals the earlier sentence comes first.
    """
    s = chunk_sentences(top, query_id)
    s = s.groupBy(query_id, "evidence").agg(F.min(F.struct("rank", "i", "n_words", "overlap")).alias("s")).select(query_id, "evidence", "s.*")
    known = top.select(query_id, "oracle").distinct()
    s = s.join(known, query_id).withColumn("aim", F.round(_overlap("oracle", "evidence"), 6))
    w = Window.partitionBy(query_id)
    s = s.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("aim"), "rank", "i")) - 1)
    pos = F.greatest(F.lit(1), F.floor(F.col("n") * 0.30))
    neg = F.greatest(F.lit(1), F.floor(F.col("n") * 0.50))
    label = F.when(F.col("place") < pos, 1).when(F.col("place") >= F.col("n") - neg, 0).otherwise(-1)
    return s.select(query_id, "rank", "i", "n_words", F.round("overlap", 6).alias("overlap"), "place", label.alias("label"), "evidence")


def mock_scores(key: Column, score: Column, n_words: Column) -> dict[str, Column]:
    """Closed-form stand-ins for the scores of a trained cascade, with a jitter that hangs on the key alone."""
    at = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    span = lambda salt, low, high: low + (high - low) * at(salt)
    inside = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    base = 0.3 + 0.4 * F.least(F.lit(1.0), score) - F.when((n_words < 8) | (n_words > 60), 0.1).otherwise(0.0)
    strong = inside(base + span("strong", -0.1, 0.1), 0.05, 0.95)
    share = F.when(strong > 0.5, strong).otherwise((1 - strong) * 0.3)
    return {
        "p_strong": F.round(strong, 6),
        "p_contra": F.round(inside(0.2 + span("contra", -0.1, 0.15), 0.02, 0.8), 6),
        "p_svm": F.round(inside(0.3 + span("svm", -0.1, 0.1), 0.05, 0.9), 6),
        "flag": (strong > 0.5).cast("int"),
        "vote_share": F.round(share, 6),
        "entropy": F.round(1.0 - F.abs(share - 0.5) * 2, 6),
    }
