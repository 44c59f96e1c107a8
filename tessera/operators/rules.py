"""Rules that judge claims, groups, files and runs: realism risks, cue scores, failure and case types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K

# Cues and patterns of the realism audit.
NON_SCIENTIFIC = (
    r"\bshould be (deployed|adopted|used|implemented|required|mandated)\b", r"\bwe recommend\b", r"\bpolicy makers should\b", r"\bpolicymakers should\b", r"\bmust be adopted\b", r"\bcall for\b", r"\burge\b",
    r"\bgame-?changer\b", r"\brevolutioniz\w+\b", r"\bcutting-?edge\b", r"\bnext-?generation\b", r"\bparadigm shift\b", r"\bunlock\w*\b", r"\bholy grail\b", r"\bsilver bullet\b", r"\bgroundbreaking\b",
)
UNNATURAL = (
    r"\bas the main comparison basis\b", r"\bas the primary comparison basis\b", r"\bas the key comparison basis\b", r"\bas the main evaluation basis\b", r"\bas the primary evaluation basis\b", r"\bas the key evaluation basis\b",
    r"\bas the main basis\b", r"\bas the primary basis\b", r"\bas the key basis\b", r"\bas the principal\b", r"\bin all contexts\b", r"\bunder all conditions\b", r"\bwithout any caveat\b", r"\bwithout any limitation\b",
    r"\bwithout any constraint\b", r"\bacross all\b", r"\bfor all\b", r"\bas the sole\b", r"\bas the only\b", r"\bthe paper asserts that\b", r"\bthe paper claims that\b", r"\bthe paper declares that\b", r"\bthe paper mandates that\b",
)
NEGATED = (r"\bnot\b", r"\bfails?\b", r"\bfailure\b", r"\bunable\b", r"\bcannot\b", r"\bdoes not\b", r"\bdo not\b", r"\bnever\b")
FORCED = (
    "deployment", "deploy", "deployed", "deploying", "safety-critical", "safety critical", "safe deployment", "policy", "policymaker", "policymakers", "regulation", "regulatory",
    "generalization", "generalize", "generalizes", "generalizability", "real-world", "real world", "production", "industry", "industrial", "mission-critical", "mission critical",
    "high-stakes", "high stakes", "robust deployment", "trustworthy", "reliable deployment",
)
# The single-claim audit. Kinds in order of priority.
PRIORITY = ("not_scientific_claim", "contradiction_too_mechanical", "strong_action_too_forced", "too_extreme", "unnatural_wording", "too_template_like", "mild_strong_boundary_unclear")
TEMPLATE_OPENING = r"^(the|this|our)\s+(benchmark|method|system|approach|model|results|framework|system)\s+(demonstrates|shows|achieves|provides|enables|ensures|guarantees)"
TEMPLATE_PHRASE = r"\b(results show|experiments demonstrate|our approach achieves|our method outperforms)\b"
SUPERLATIVE = r"\b(state-of-the-art|sota|best|first|novel|groundbreaking|revolutionary|superior|unprecedented|remarkable|exceptional|outperforms\s+all|always|never|fully|completely)\b"
PLACEHOLDER = r"\b(broader\s+\w+\s+stack|comprehensive\s+\w+\s+context|universal\s+\w+\s+frame|all\s+\w+\s+scenarios|complete\s+\w+\s+setting)\b"
INFORMAL = r"\b(awesome|cool|great|amazing|stuff|thing)\b"
MECHANICAL = r"\b(not\s+(?:achieve|demonstrate|show|provide|enable|support|reach|outperform|handle|address))\b"
ACTION_CUE = r"\b(deployment|deploy|safety|guarantee|policy|always|fully|replace|production-ready|operational|robust)\b"
ACTION_PHRASE = r"\b(deployment-ready|production-ready|safety guarantee|operational guarantee)\b"

SUPPORTED, MILD, STRONG, CONTRA = 0, 1, 2, 3


def _any(x: Column, patterns) -> Column:
    low = F.lower(x)
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(low, F.lit(T.edged(p)))
    return out


def content(x: Column) -> Column:
    """Words of three characters or more without the audit's stop words."""
    return F.filter(K.tokenize(x, "pair", K.STOP_WORDS["realism"]), lambda t: F.length(t) > 2)


def group_realism(claims: DataFrame, group: str, key: str, label: str, claim: str, evidence: str) -> DataFrame:
    """(group, key, risks, score, realism, action): realism risks of every claim beside the others of its group.

    A group has a few claims, one of each label; where it has more of a label, the first by key stands for it. Groups are
    gathered by label only (one text each), siblings by an equi-join.
    """
    t = claims.select(group, key, label, claim, evidence, content(F.col(claim)).alias("c"))
    pick = lambda v: F.min_by(F.when(F.col(label) == v, F.col("c")), F.when(F.col(label) == v, F.col(key)))
    by = t.groupBy(group).agg(pick(SUPPORTED).alias("supported"), pick(MILD).alias("mild"), pick(STRONG).alias("strong"))
    o = t.select(F.col(group).alias("g2"), F.col(key).alias("k2"), F.col("c").alias("c2"))
    near = t.join(o, (F.col(group) == F.col("g2")) & (F.col(key) != F.col("k2"))).groupBy(group, key).agg(F.avg(K.jaccard(F.array_distinct("c"), F.array_distinct("c2"), 1.0)).alias("sibling"))
    x = t.join(by, group).join(near, [group, key], "left")
    d = lambda c: F.array_distinct(c)
    words = T.count_words(F.col(claim))
    both = lambda a, b: (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0)
    to_supported, boundary = K.jaccard(d("c"), d("supported")), K.jaccard(d("mild"), d("strong"))
    apart = F.size(F.array_except("mild", "strong")) + F.size(F.array_except("strong", "mild"))
    cues = lambda c: K.count_terms(F.col(c), FORCED)
    risks = {
        "too_template_like": F.col("sibling") > 0.6,
        "unnatural_wording": _any(F.col(claim), UNNATURAL) | ((words > 0) & ((words < 6) | (words > 70))),
        "not_scientific_claim": _any(F.col(claim), NON_SCIENTIFIC),
        "contradiction_too_mechanical": (F.col(label) == CONTRA) & both(F.col("c"), F.col("supported")) & ((to_supported > 0.7) | ((to_supported > 0.5) & _any(F.col(claim), NEGATED))),
        "strong_action_too_forced": (F.col(label) == STRONG) & (cues(claim) > 0) & ((cues(evidence) == 0) | (cues(claim) >= 3)),
        "mild_strong_boundary_unclear": F.col(label).isin(MILD, STRONG) & both(F.col("mild"), F.col("strong")) & ((boundary > 0.75) | ((apart <= 3) & (boundary > 0.5))),
    }
    x = x.withColumn("risks", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in risks.items()])))
    score = F.least(F.lit(5), F.size("risks"))
    return x.select(group, key, F.array_join("risks", ";").alias("risks"), score.alias("score"), F.least(F.lit(5), score + 1).alias("realism"), recommended_action(score, F.col("risks")).alias("action"))


def recommended_action(score: Column, risks: Column) -> Column:
    worst = F.array_contains(risks, "too_extreme") | F.array_contains(risks, "too_template_like")
    return F.when(score <= 1, "keep").when(score == 2, "review").when(score == 3, "prioritize_gold_realism").when(worst, "exclude_from_paper_examples").otherwise("prioritize_gold_realism")


def risk_level(most: Column, mean: Column) -> Column:
    return F.when((most >= 4) | (mean >= 3), "high").when((most >= 2) | (mean >= 2), "medium").otherwise("low")


def gradient(sm: Column, ms: Column, sc: Column) -> Column:
    """1 to 5: how naturally claims step from supported (s) over mild (m) and strong to contradiction (c), by similarities."""
    lost = F.when((sm > 0.85) & (ms > 0.85), 2).otherwise(0) + F.when(ms > 0.8, 1).otherwise(0) + F.when(sc > 0.75, 1).otherwise(0) + F.when(sc > sm + 0.1, 1).otherwise(0)
    return F.greatest(F.lit(1), 5 - lost)


def single_realism(claim: Column, evidence: Column, label: Column) -> Column:
    """The realism risk of one claim, of several the first by PRIORITY; none where there is none."""
    low, n = F.lower(claim), T.count_words(claim)
    hit = lambda p: F.rlike(low, F.lit(T.edged(p)))
    count = lambda p: F.regexp_count(low, F.lit(T.edged(p)))
    # whole words, any letter being part of one, that are of four plain letters or more
    four = lambda x: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.rlike(w, F.lit("^[a-z]{4,}$"))))
    shared = F.try_divide(F.size(F.array_intersect(four(claim), four(evidence))).cast("double"), F.size(four(claim)))
    found = {
        "not_scientific_claim": (claim == "") | (n < 8) | hit(INFORMAL),
        "contradiction_too_mechanical": (label == CONTRA) & hit(MECHANICAL),
        "strong_action_too_forced": (label == STRONG) & ((count(ACTION_CUE) >= 2) | hit(ACTION_PHRASE)),
        "too_extreme": (count(SUPERLATIVE) >= 2) | ((count(SUPERLATIVE) == 1) & (label == STRONG)),
        "unnatural_wording": hit(PLACEHOLDER) | ((F.size(four(evidence)) > 0) & F.coalesce(shared < 0.15, F.lit(False))),
        "too_template_like": hit(TEMPLATE_OPENING) | hit(TEMPLATE_PHRASE),
        "mild_strong_boundary_unclear": label.isin(MILD, STRONG) & (n < 15),
    }
    out = F.lit("none")
    for kind in reversed(PRIORITY):
        out = F.when(found[kind], kind).otherwise(out)
    return out


def scalar_score(claim: Column, evidence: Column, contra: list[str], action: list[str], mild: list[str], limits: list[str]) -> Column:
    """0 to 3 by the strongest cue of claim or evidence; a limitation in the evidence adds one, up to 3."""
    seen = lambda cues: (K.word_cues(claim, cues) > 0) | (K.word_cues(evidence, cues) > 0)
    base = F.when(seen(contra), 3).when(seen(action), 2).when(seen(mild), 1).otherwise(0)
    return F.least(F.lit(3), base + (K.word_cues(evidence, limits) > 0).cast("int"))


def cue_risk(claim: Column, evidence: Column, strong: list[str], limits: list[str]) -> Column:
    """0 to 3: strong cues in the claim against limitations in the evidence."""
    c, e = K.count_terms(claim, strong), K.count_terms(evidence, limits)
    return F.when((c >= 2) & (e >= 1), 3).when((c >= 1) & (e >= 1), 2).when(c >= 1, 1).otherwise(0)


def failure_type(missing: Column, known: Column, retrieved: Column, hit: Column, same_paper: Column, agrees: Column) -> Column:
    """The first of the ways in which the search for a claim's evidence failed."""
    return F.when(missing, "pdf_missing").when(~known, "oracle_not_in_pdf_text").when(~retrieved, "retrieval_empty").when(~hit & ~same_paper, "retrieved_wrong_paper").when(~hit, "oracle_chunk_not_retrieved").when(~agrees, "relation_screening_failed_after_good_retrieval").otherwise("none")


def review_priority(first_flagged: Column, known_flagged: Column, label: Column) -> Column:
    return F.when(first_flagged, 1).when(known_flagged, 2).when(label == STRONG, 3).when(label == CONTRA, 4).otherwise(5)


def selector_change(before: Column, after: Column) -> Column:
    return F.when(after & ~before, "helped").when(~after & before, "harmed").otherwise("neutral")


def combined_change(selector: Column, ranker: Column) -> Column:
    return F.when((selector == "helped") & (ranker == "helped"), "both_helped").when((selector == "harmed") & (ranker == "harmed"), "both_failed").when((selector == "helped") | (ranker == "helped"), "partial_help").otherwise("no_change")


def screening_change(truth: Column, before: Column, after: Column) -> Column:
    return F.when(truth & ~after, "strong_action_false_negative").when(~truth & after, "strong_action_false_positive").when(truth & after & ~before, "screening_recovery").otherwise("screening_neutral")


def normalize_risk(x: Column) -> Column:
    low = F.lower(T.normalize_space(F.coalesce(x, F.lit(""))))
    return F.when(low == "", "unknown").when(F.contains(low, F.lit("high")), "high").when(F.contains(low, F.lit("moderate")) | F.contains(low, F.lit("medium")), "medium").when(F.contains(low, F.lit("low")), "low").otherwise("medium")


def derive_group(x: Column) -> Column:
    """An identifier of four dashed parts or more without its last part."""
    return F.when(F.size(F.split(x, "-")) >= 4, F.regexp_replace(x, "-[^-]*$", "")).otherwise(x)


def suspicion(label: Column, claim: Column, evidence: Column, cues: list[str]) -> Column:
    """Whether a claim that is not supported says hardly anything that its evidence does not say."""
    a, b = (F.array_distinct(content(x)) for x in (claim, evidence))
    own = F.try_divide(F.size(F.array_except(a, b)).cast("double"), F.size(a))
    na, nb = K.numbers(claim), K.numbers(evidence)
    other = (F.size(na) > 0) & (F.size(nb) > 0) & (F.size(F.array_except(na, nb)) > 0)
    cue = F.size(F.array_intersect(a, F.array(*map(F.lit, cues)))) > 0
    return F.when(label == SUPPORTED, "").when(F.size(a) == 0, "empty_claim").when((own < 0.12) & ~other & ~cue, "low_claim_only_signal").otherwise("")


def excluded(path: Column, folders: list[str], suffixes: list[str], names: list[str]) -> Column:
    """Why a path is left out: the first folder, suffix or part of a name that rules it out; empty if none does."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    file = F.lower(F.element_at(parts, -1))
    out = F.lit("")
    for n in reversed(names):
        out = F.when(F.contains(file, F.lit(n)), f"file_pattern:{n}").otherwise(out)
    for s in reversed(suffixes):
        out = F.when(F.endswith(file, F.lit(s)), f"suffix:{s}").otherwise(out)
    hit = F.get(F.filter(parts, lambda p: p.isin(*folders)), F.lit(0))
    return F.when(hit.isNotNull(), F.concat(F.lit("excluded_dir:"), hit)).otherwise(out)


def asset_type(path: Column, kinds: list[tuple[str, str]]) -> Column:
    """The kind of the first of (pattern, kind) whose pattern the file's lower-cased name holds; other if none does."""
    name, out = F.lower(F.element_at(F.split(path, "/"), -1)), F.lit("other")
    for pattern, kind in reversed(kinds):
        out = F.when(F.rlike(name, F.lit(pattern)), kind).otherwise(out)
    return out


def decision(eligible: Column, usable: Column) -> tuple[Column, Column]:
    tier = F.when(eligible >= 0.85, "proceed_full_label_audit").when(eligible >= 0.70, "eligible_subset_only").otherwise("stop_formal_label_audit")
    return tier, F.when(usable < 0.50, "insufficient").otherwise("adequate")


def best_variant(results: DataFrame, key: str, order: Column, p20: str, p50: str, r100: str) -> DataFrame:
    """The row of the best variant: of those that meet all targets, else of all, the highest P@20 plus R@100; ties to the first."""
    meets = (F.col(p20) >= 0.40) & (F.col(p50) >= 0.35) & (F.col(r100) >= 0.45)
    x = results.withColumn("meets", meets).withColumn("composite", F.round(F.col(p20) + F.col(r100), 6)).withColumn("ord", order)
    return x.orderBy(F.desc("meets"), F.desc("composite"), "ord").limit(1).select(key, "meets", "composite")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def parsed_answer(raw: Column, labels: list[str]) -> Column:
    """Struct (status, label, confidence) of a free-text answer that holds a JSON object, bare, fenced or amid other text."""
    body = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(body, r"(?s)\{[^{}]*\}", 0)
    value = lambda k: F.get_json_object(inner, f"$.{k}")
    label = F.lower(F.trim(F.coalesce(value("label"), F.lit(""))))
    sure = F.coalesce(value("confidence").try_cast("double"), F.lit(0.0))
    whole = F.try_parse_json(inner).isNotNull() & (inner != "")
    status = F.when(~whole, "parse_failed").when(~label.isin(*labels), "invalid_label").otherwise("ok")
    return F.struct(status.alias("status"), F.when(whole, label).otherwise("").alias("label"), F.when(status == "ok", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3)).otherwise(0.0).alias("confidence"))
