"""Comparisons of evidence, predictors and queues: what a choice hits, what the right evidence adds, where two methods part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K

# Labels of the pairs.
SUPPORTED, MILD, STRONG, CONTRA = 0, 1, 2, 3


def by_dice(units: DataFrame, claims: DataFrame, key: str, order: str, text: str, claim: str, most: int) -> DataFrame:
    """(key, order, score, rank): the `most` units of a claim's own document that share most tokens with it (Dice), ties to the first.

    One claim a document; a document's units meet its claim alone, so the work is linear in the text.
    """
    terms = lambda c: F.array_distinct(K.tokenize(F.col(c)))
    both = units.select(key, order, terms(text).alias("_u")).join(claims.select(key, terms(claim).alias("_c")), key)
    scored = both.select(key, order, F.round(K.dice(F.col("_c"), F.col("_u")), 6).alias("score"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))
    return scored.withColumn("rank", at).filter(F.col("rank") <= most)


def closest(df: DataFrame, sentences: str, claim: str, claim_at: str) -> DataFrame:
    """df with selected and selected_at: of a row's sentences the one that shares most tokens with its claim (Dice), ties to the first.

    The claim's own place is left out; both are null where there is no claim or no other sentence. All stays within the
    row, so nothing is shuffled and every sentence is cut into tokens once.
    """
    terms = lambda x: F.array_distinct(K.tokenize(x))
    x = df.withColumn("_c", terms(F.col(claim)))
    scored = F.transform(F.transform(sentences, terms), lambda u, i: F.when(i != F.col(claim_at), F.struct(F.round(K.dice(F.col("_c"), u), 6).alias("score"), (-i).alias("turn"))))
    x = x.withColumn("_best", F.array_max(scored)).withColumn("selected_at", -F.col("_best.turn"))
    return x.withColumn("selected", F.get(sentences, F.col("selected_at"))).drop("_c", "_best")


def selection_oracle(df: DataFrame, selected: str, selected_page: str, evidence: str, page: str, least: float = 0.65) -> DataFrame:
    """df with hash_exact, page_match, overlap and hit: whether what was selected is the known evidence.

    A hit is the same text, or the known page and a token overlap (F1 of sets) of `least`. Without known evidence there
    is none, and a page below 1 is not known.
    """
    a, b = F.coalesce(selected, F.lit("")), F.coalesce(evidence, F.lit(""))
    exact = (T.sha256_text(a) == T.sha256_text(b)) & (b != "")
    same = (F.col(selected_page) == F.col(page)) & (F.col(page) > 0)
    overlap = F.when((b == "") | (F.size(K.tokenize(a)) == 0), 0.0).otherwise(K.dice(K.tokenize(a), K.tokenize(b)))
    x = df.withColumn("hash_exact", exact).withColumn("page_match", F.coalesce(same, F.lit(False))).withColumn("overlap", F.round(overlap, 6))
    return x.withColumn("hit", F.col("hash_exact") | (F.col("page_match") & (F.col("overlap") >= least)))


def deltas(df: DataFrame, key: str, condition: str, measures: list[str], pairs: dict[str, list[str]], base: str = "correct") -> DataFrame:
    """(key, <measure>..., <measure>_delta_<condition>...): measures under `base`, and by how much they exceed those of other conditions.

    pairs says which measures are compared with which condition. Conditions come as rows, one of each a key; a key that
    lacks one has a null there.
    """
    at = lambda m, c: F.max(F.when(F.col(condition) == c, F.col(m)))
    wide = df.groupBy(key).agg(*[at(m, base).alias(m) for m in measures], *[(at(m, base) - at(m, c)).alias(f"{m}_delta_{c}") for c, ms in pairs.items() for m in ms])
    return wide


def evidence_need(df: DataFrame, key: str, delta: str, most: int = 10) -> DataFrame:
    """(end, place, key, delta): the `most` keys that lose most and least without their evidence, ties to the smaller key."""
    out = None
    for end, turn in (("top", F.desc), ("bottom", F.asc)):
        first = df.filter(F.col(delta).isNotNull()).orderBy(turn(delta), key).limit(most)
        one = first.select(F.lit(end).alias("end"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(turn(delta), key)).alias("place"), key, delta)
        out = one if out is None else out.unionByName(one)
    return out


def boundary_cases(df: DataFrame, key: str, truth: str, scalar: str, scalar_label: str, routed: str, forced: DataFrame) -> DataFrame:
    """(case_type, key, truth, scalar, scalar_label, routed): a row for each kind of case that a row of df is.

    One scan: a row's kinds are gathered and exploded. `forced` holds the keys that another audit found forced.
    """
    right, said = F.col(routed) == F.col(truth), F.col(scalar_label) == F.col(truth)
    kinds = {
        "scalar_high_but_mild": (F.col(truth) == MILD) & (F.col(scalar) >= 2),
        "scalar_low_but_strong": (F.col(truth) == STRONG) & (F.col(scalar) <= 1),
        "routed_right_scalar_wrong": right & ~said,
        "scalar_right_routed_wrong": said & ~right,
        "both_wrong": ~right & ~said,
        "strong_action_too_forced": F.col("_forced").isNotNull(),
    }
    x = df.join(forced.select(key).distinct().withColumn("_forced", F.lit(True)), key, "left")
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return x.select(F.explode(found).alias("case_type"), key, truth, scalar, scalar_label, routed)


def signal_audit(predictions: DataFrame, key: str, target: str, judge: str) -> DataFrame:
    """(key, target, claim_only, claim_evidence, evidence_only, patterns): how many models are right on each view of a pair.

    predictions (key, target, model, view, correct), one row a model and view; a missing one is no signal. The patterns
    say where the model `judge` does without the evidence or by it, and where few or many models are right on one part.
    """
    n = lambda v: F.count_if((F.col("view") == v) & F.col("correct"))
    judged = lambda v: F.bool_or(F.when((F.col("model") == judge) & (F.col("view") == v), F.col("correct")))
    x = predictions.groupBy(key, target).agg(*[n(v).alias(v) for v in ("claim_only", "claim_evidence", "evidence_only")], judged("claim_only").alias("_c"), judged("claim_evidence").alias("_e"))
    kinds = {
        "judge_right_without_evidence_only": F.col("_c") & ~F.col("_e"),
        "evidence_helped_judge": ~F.col("_c") & F.col("_e"),
        "claim_only_advantage": (F.col("claim_only") >= 2) & (F.col("claim_evidence") <= 1),
        "evidence_only_prior": F.col("evidence_only") >= 2,
    }
    found = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])), ";")
    return x.select(key, target, "claim_only", "claim_evidence", "evidence_only", found.alias("patterns"))


def within_best(df: DataFrame, score: str, most: int) -> Column:
    """Whether a row's rank by score (ties share the best one) is at most `most`: its score is no less than the most-th best.

    The bound is one value; only `most` rows are ordered for it.
    """
    bound = df.filter(F.col(score).isNotNull()).select(score).orderBy(F.desc(score)).limit(most).agg(F.min(score))
    return F.coalesce(F.col(score) >= bound.scalar(), F.lit(False))


def upgrade_effects(base: DataFrame, learned: DataFrame, ranker: DataFrame, priority: DataFrame, key: str, depth: int = 100, least: float = 0.1) -> DataFrame:
    """What a learned selector and a learned ranker change for each key that all four tables hold.

    base (key, truth, flag), learned (key, label, flag, overlap), ranker (key, score) and priority (key, score), flag
    being whether strong was predicted. Returns key, selector, ranker, combined, screening, ambiguous and missed (the
    selected evidence overlaps the known one by less than `least`). Queue places are those among the joined rows.
    """
    b = base.select(key, "truth", F.col("flag").alias("_was"))
    n = learned.select(key, F.col("label").alias("_label"), F.col("flag").alias("_is"), "overlap")
    x = b.join(n, key).join(ranker.select(key, F.col("score").alias("_new")), key).join(priority.select(key, F.col("score").alias("_old")), key)
    ahead, before = within_best(x, "_new", depth), within_best(x, "_old", depth)
    change = lambda now, then: F.when(now & ~then, "helped").when(then & ~now, "harmed").otherwise("neutral")
    x = x.withColumn("selector", change(F.col("_is"), F.col("_was"))).withColumn("ranker", change(ahead, before))
    both = lambda w: (F.col("selector") == w) & (F.col("ranker") == w)
    strong = F.col("truth") == STRONG
    return x.select(
        key, "selector", "ranker",
        F.when(both("helped"), "both_helped").when(both("harmed"), "both_failed").when((F.col("selector") == "helped") | (F.col("ranker") == "helped"), "partial_help").otherwise("no_change").alias("combined"),
        F.when(strong & ~F.col("_is"), "false_negative").when(~strong & F.col("_is"), "false_positive").when(strong & ~F.col("_was"), "recovery").otherwise("neutral").alias("screening"),
        (((F.col("truth") == MILD) & (F.col("_label") == STRONG)) | (strong & (F.col("_label") == MILD))).alias("ambiguous"),
        (F.col("overlap") < least).alias("missed"),
    )
