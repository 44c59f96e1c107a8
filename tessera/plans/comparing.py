"""Registered queries that compare evidence, predictors and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import comparison, corpus
from tessera.plans.catalog import _PRED, _SENT, _TOKENS, _W, _predicted, _scores, _t, query
from tessera.sources import store

_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
#: A document's claim is its second sentence of eight words or more, its known evidence the first; ten sentences are a page.
_CLAIMS = rf"{_SENT}, long AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS i FROM sent WHERE {_WORDS.format('sentence')} >= 8), known AS (SELECT a.doc_id, a.sentence AS claim, a.sent_id AS claim_at, b.sentence AS evidence, b.sent_id // 10 + 1 AS page FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.i = 2 AND b.i = 1)"
_DICE = "coalesce(2.0 * len(list_intersect({0}, {1})) / nullif(len({0}) + len({1}), 0), 0.0)"
_DISTINCT = lambda x: f"list_distinct({_TOKENS.format(x)})"


def _stored(df):
    """df written and read back: texts are cut once however often it is read, and filters on it do not cut them again."""
    path = store.scratch(df.sparkSession, "claims")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _long(sentences):
    """The first two sentences of eight words or more with their places."""
    at = F.transform(sentences, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.slice(F.filter(at, lambda x: T.has_words(x["s"], 8)), 1, 2)


def _page(at):
    return F.floor(at / 10) + 1


def _claims(spark, d):
    """(doc_id, claim, claim_at, evidence, page): the first two long sentences of a document, found within its row."""
    x = _stored(_t(spark, d, "documents").select("doc_id", _long(T.split_sentences(F.col("text"))).alias("l"))).filter(F.size("l") == 2)
    return x.select("doc_id", F.col("l")[1]["s"].alias("claim"), F.col("l")[1]["i"].alias("claim_at"), F.col("l")[0]["s"].alias("evidence"), _page(F.col("l")[0]["i"]).alias("page"))


@query(rf"""WITH {_CLAIMS}, w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents), c AS (SELECT doc_id, ((s - 1) // 150)::INTEGER AS chunk, array_to_string(w[s : s + 199], ' ') AS t FROM w, unnest(range(1, len(w) + 1, 150)) AS t(s) WHERE len(w[s : s + 199]) >= 10)
, s AS (SELECT doc_id, chunk, {_DISTINCT('claim')} AS a, {_DISTINCT('t')} AS z FROM c JOIN known USING (doc_id)), r AS (SELECT doc_id, chunk, round({_DICE.format('a', 'z')}, 6) AS score FROM s)
SELECT doc_id, chunk, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS rank FROM r) WHERE rank <= 5""")
def chunks_by_dice(spark, d):
    """A document's five chunks that share most with its claim."""
    return comparison.by_dice(corpus.chunks(_t(spark, d, "documents")), _claims(spark, d), "doc_id", "chunk", "chunk_text", "claim", 5)


@query(rf"""WITH {_CLAIMS}, u AS (SELECT doc_id, sent_id, sentence, claim, claim_at, evidence, page, {_DISTINCT('claim')} AS a, {_DISTINCT('sentence')} AS z, {_DISTINCT('evidence')} AS e FROM sent JOIN known USING (doc_id) WHERE sent_id <> claim_at)
, b AS (SELECT *, round({_DICE.format('a', 'z')}, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_id) = 1)
, o AS (SELECT doc_id, sentence = evidence AS hash_exact, sent_id // 10 + 1 = page AS page_match, round({_DICE.format('z', 'e')}, 6) AS overlap FROM b)
SELECT lang, count(*) AS n, round(avg(hash_exact::INTEGER), 6) AS hash_exact, round(avg(page_match::INTEGER), 6) AS page_match, round(avg(overlap), 6) AS overlap, round(avg((hash_exact OR (page_match AND overlap >= 0.65))::INTEGER), 6) AS hit FROM o JOIN documents USING (doc_id) GROUP BY lang""")
def selected_evidence_oracle(spark, d):
    """How often the sentence that is closest to a document's claim is the known evidence, by language."""
    x = _t(spark, d, "documents").select("lang", T.split_sentences(F.col("text")).alias("all"))
    x = x.select("lang", "all", _long(F.col("all")).alias("l")).select("lang", "all", F.get("l", F.lit(0)).alias("known"), F.get("l", F.lit(1)).alias("claim"))
    best = comparison.closest(x.select("lang", "all", "known", F.col("claim.s").alias("claim"), F.col("claim.i").alias("claim_at")), "all", "claim", "claim_at")
    kept = _stored(best.select("lang", "selected", _page(F.col("selected_at")).alias("selected_page"), F.col("known.s").alias("evidence"), _page(F.col("known.i")).alias("page")))
    x = comparison.selection_oracle(kept.filter("selected IS NOT NULL"), "selected", "selected_page", "evidence", "page")
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return x.groupBy("lang").agg(F.count("*").alias("n"), *map(share, ("hash_exact", "page_match", "overlap", "hit")))


# -- what the right evidence adds

_ASKED = {"shuffled": ["entails", "against", "entropy"], "empty": ["entails", "against", "entropy"], "title": ["entails", "against"]}
_PLOGP = lambda x: f"CASE WHEN {x} > 0 THEN -{x} * ln({x}) ELSE 0.0 END"
_NEED = rf"""{_CLAIMS}, docs AS (SELECT doc_id, text FROM documents), cond AS (SELECT doc_id, claim, 'correct' AS condition, evidence AS ev FROM known UNION ALL SELECT k.doc_id, k.claim, 'shuffled', o.evidence FROM known k JOIN known o ON o.doc_id = k.doc_id + 1
  UNION ALL SELECT doc_id, claim, 'empty', '' FROM known UNION ALL SELECT doc_id, claim, 'title', array_to_string(string_split(evidence, ' ')[1:4], ' ') FROM known)
, sets AS (SELECT doc_id, condition, {_DISTINCT('claim')} AS a, {_DISTINCT('ev')} AS z FROM cond), m AS (SELECT doc_id, condition, {_DICE.format('a', 'z')} AS entails, (1 - {_DICE.format('a', 'z')}) * (1 - coalesce(len(list_intersect(a, z))::DOUBLE / nullif(len(z), 0), 0.0)) / 2 AS against FROM sets)
, n AS (SELECT doc_id, condition, entails, against, {_PLOGP('entails')} + {_PLOGP('against')} + {_PLOGP('(1 - entails - against)')} AS entropy FROM m)
, x AS (SELECT doc_id, {", ".join(f"max({c}) FILTER (condition = 'correct') AS {c}" for c in ("entails", "against", "entropy"))}, {", ".join(f"max({c}) FILTER (condition = 'correct') - max({c}) FILTER (condition = '{k}') AS {c}_delta_{k}" for k, cs in _ASKED.items() for c in cs)} FROM n GROUP BY doc_id)"""
_NAMES = ["entails", "against", "entropy", *[f"{c}_delta_{k}" for k, cs in _ASKED.items() for c in cs]]


def _need(spark, d):
    """Shares of words stand in for a language model's probabilities; another document's evidence is that of the next id."""
    claims = _claims(spark, d)
    nxt = claims.select((F.col("doc_id") - 1).alias("doc_id"), F.col("evidence").alias("other"))
    one = lambda c, e: F.struct(F.lit(c).alias("condition"), e.alias("ev"))
    title = F.array_join(F.slice(F.split("evidence", " "), 1, 4), " ")
    x = claims.join(nxt, "doc_id", "left").select("doc_id", "claim", F.inline(F.array(one("correct", F.col("evidence")), one("shuffled", F.col("other")), one("empty", F.lit("")), one("title", title)))).filter("ev IS NOT NULL")
    a, z = F.array_distinct(K.tokenize(F.col("claim"))), F.array_distinct(K.tokenize(F.col("ev")))
    x = x.select("doc_id", "condition", a.alias("a"), z.alias("z")).withColumn("entails", K.dice(F.col("a"), F.col("z")))
    precision = F.coalesce(F.try_divide(F.size(F.array_intersect("a", "z")).cast("double"), F.size("z")), F.lit(0.0))
    x = x.withColumn("against", (1 - F.col("entails")) * (1 - precision) / 2)
    part = lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)
    x = x.withColumn("entropy", part(F.col("entails")) + part(F.col("against")) + part(1 - F.col("entails") - F.col("against")))
    return comparison.deltas(x, "doc_id", "condition", ["entails", "against", "entropy"], _ASKED)


@query(f"WITH {_NEED} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM x")
def evidence_deltas(spark, d):
    """What a claim's own evidence says, and by how much that exceeds another's, none and a title's."""
    return _need(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in _NAMES])


@query(f"WITH {_NEED}, r AS (SELECT doc_id, round(entails_delta_empty, 6) AS need FROM x) SELECT 'top' AS \"end\", row_number() OVER (ORDER BY need DESC, doc_id)::INTEGER AS place, doc_id, need FROM r QUALIFY place <= 10 UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY need, doc_id)::INTEGER AS place, doc_id, need FROM r QUALIFY place <= 10")
def evidence_necessity(spark, d):
    """The ten claims that need their evidence most, and least."""
    return comparison.evidence_need(_need(spark, d).select("doc_id", F.round("entails_delta_empty", 6).alias("need")), "doc_id", "need")


# -- where two methods part

_SCALAR = "LEAST(3, FLOOR(2 * (p_strong + p_svm)))"


@query(_PRED + f""", y AS (SELECT cid, label, {_SCALAR}::INTEGER AS scalar, {_SCALAR}::BIGINT AS said, pred::BIGINT AS pred, flag = 1 AND entropy > 0.9 AS forced FROM x)
SELECT case_type, cid, label, scalar, said, pred FROM y, unnest([CASE WHEN label = 1 AND scalar >= 2 THEN 'scalar_high_but_mild' END, CASE WHEN label = 2 AND scalar <= 1 THEN 'scalar_low_but_strong' END, CASE WHEN pred = label AND said <> label THEN 'routed_right_scalar_wrong' END,
  CASE WHEN said = label AND pred <> label THEN 'scalar_right_routed_wrong' END, CASE WHEN said <> label AND pred <> label THEN 'both_wrong' END, CASE WHEN forced THEN 'strong_action_too_forced' END]) AS t(case_type) WHERE case_type IS NOT NULL""")
def boundary_cases(spark, d):
    """Rows on which the scalar rule and the cascade part, by kind."""
    p = _predicted(spark, d)
    forced = p.filter("flag = 1 AND entropy > 0.9").select("cid")
    return comparison.boundary_cases(p.withColumn("scalar", F.expr(_SCALAR).cast("int")).withColumn("said", F.col("scalar").cast("long")), "cid", "label", "scalar", "said", "pred", forced)


_VIEWS = {"claim_only": "p_strong", "claim_evidence": "p_svm", "evidence_only": "p_contra"}
_CUTS = {"centroid": 0.5, "bayes": 0.4, "judge": 0.6}
_TARGETS = {"strong": "label = 2", "flagged": "label > 0"}


@query(_W + f""", p AS (SELECT cid, target, model, view, (score >= cut) = truth AS correct FROM (SELECT cid, unnest([{", ".join(f"{{'target': '{t}', 'truth': {c}}}" for t, c in _TARGETS.items())}], recursive := true), p_strong, p_svm, p_contra FROM s)
  CROSS JOIN (VALUES {", ".join(f"('{m}', {c}::DOUBLE)" for m, c in _CUTS.items())}) AS m(model, cut) CROSS JOIN LATERAL (SELECT unnest([{", ".join(f"{{'view': '{v}', 'score': {c}}}" for v, c in _VIEWS.items())}], recursive := true)))
, g AS (SELECT cid, target, {", ".join(f"count(*) FILTER (view = '{v}' AND correct) AS {v}" for v in _VIEWS)}, bool_or(correct) FILTER (model = 'judge' AND view = 'claim_only') AS c, bool_or(correct) FILTER (model = 'judge' AND view = 'claim_evidence') AS e FROM p GROUP BY ALL)
SELECT cid, target, claim_only, claim_evidence, evidence_only, array_to_string(list_filter([CASE WHEN c AND NOT e THEN 'judge_right_without_evidence_only' END, CASE WHEN NOT c AND e THEN 'evidence_helped_judge' END, CASE WHEN claim_only >= 2 AND claim_evidence <= 1 THEN 'claim_only_advantage' END, CASE WHEN evidence_only >= 2 THEN 'evidence_only_prior' END], lambda k: k IS NOT NULL), ';') AS patterns FROM g""")
def signal_patterns(spark, d):
    """Which models are right on which part of a pair, and what that says of it."""
    s = _scores(spark, d)
    rows = [F.struct(F.lit(t).alias("target"), F.lit(m).alias("model"), F.lit(v).alias("view"), ((F.col(c) >= cut) == F.expr(truth)).alias("correct")) for t, truth in _TARGETS.items() for m, cut in _CUTS.items() for v, c in _VIEWS.items()]
    return comparison.signal_audit(s.select("cid", F.inline(F.array(*rows))), "cid", "target", "judge")


@query(_PRED + """, b AS (SELECT cid, label AS truth, p_strong >= 0.5 AS was FROM x WHERE cid % 11 <> 0), n AS (SELECT cid, pred AS said, pred = 2 AS is_, p_svm AS overlap FROM x WHERE cid % 13 <> 0)
, j AS (SELECT b.*, said, is_, overlap, round(p_strong - p_contra, 3) AS fresh, round(p_strong * 0.7 + entropy * 0.3, 6) AS old FROM b JOIN n USING (cid) JOIN x USING (cid)), r AS (SELECT *, rank() OVER (ORDER BY fresh DESC) <= 100 AS ahead, rank() OVER (ORDER BY old DESC) <= 100 AS before_ FROM j)
, c AS (SELECT *, CASE WHEN is_ AND NOT was THEN 'helped' WHEN was AND NOT is_ THEN 'harmed' ELSE 'neutral' END AS selector, CASE WHEN ahead AND NOT before_ THEN 'helped' WHEN before_ AND NOT ahead THEN 'harmed' ELSE 'neutral' END AS ranker FROM r)
SELECT cid, selector, ranker, CASE WHEN selector = 'helped' AND ranker = 'helped' THEN 'both_helped' WHEN selector = 'harmed' AND ranker = 'harmed' THEN 'both_failed' WHEN 'helped' IN (selector, ranker) THEN 'partial_help' ELSE 'no_change' END AS combined
, CASE WHEN truth = 2 AND NOT is_ THEN 'false_negative' WHEN truth <> 2 AND is_ THEN 'false_positive' WHEN truth = 2 AND NOT was THEN 'recovery' ELSE 'neutral' END AS screening, (truth = 1 AND said = 2) OR (truth = 2 AND said = 1) AS ambiguous, overlap < 0.1 AS missed FROM c""")
def upgrade_effects(spark, d):
    """What the cascade and a new order of the queue change against a plain threshold and the old order."""
    p = _predicted(spark, d)
    base = p.filter("cid % 11 <> 0").select("cid", F.col("label").alias("truth"), (F.col("p_strong") >= 0.5).alias("flag"))
    learned = p.filter("cid % 13 <> 0").select("cid", F.col("pred").alias("label"), (F.col("pred") == 2).alias("flag"), F.col("p_svm").alias("overlap"))
    fresh = p.select("cid", F.round(F.col("p_strong") - F.col("p_contra"), 3).alias("score"))
    old = p.select("cid", F.round(F.col("p_strong") * 0.7 + F.col("entropy") * 0.3, 6).alias("score"))
    return comparison.upgrade_effects(base, learned, fresh, old, "cid")
