"""Registered queries on reviewers' sheets, reasons in a queue and mismatched evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review
from tessera.plans.catalog import _PRED, _W, _predicted, _scores, _t, query
from tessera.plans.comparing import _CLAIMS, _DICE, _DISTINCT, _claims

_LABELS = ["supported", "mild_scope_overclaim", "strong_action_overclaim", "contradiction_candidate"]
_CODED = list(review.ANSWERS["auditor_label"])
_SQL_LABEL = f"['{_LABELS[0]}', '{_LABELS[1]}', '{_LABELS[2]}', '{_LABELS[3]}']"


def _sheet(spark, d):
    """A sheet in the second language over all candidates: every third answer stands in English, every seventh in space."""
    s = _scores(spark, d)
    coded, plain = F.array(*map(F.lit, _CODED)), F.array(*map(F.lit, review.ANSWERS["auditor_label"].values()))
    at = (F.col("n_words") % 5).cast("int")
    answer = F.when(F.col("cid") % 3 == 0, F.get(plain, at)).when(F.col("cid") % 7 == 0, F.concat(F.lit(" "), F.get(coded, at), F.lit("  "))).otherwise(F.get(coded, at))
    return s.select(
        F.col("cid").alias("审计编号"), F.col("domain").alias("领域"), F.when(F.col("cid") % 4 > 0, (F.col("cid") % 40).cast("string")).otherwise("").alias("队列排名"),
        F.get(F.array(*map(F.lit, _LABELS)), F.col("label").cast("int")).alias("silver标签"), answer.alias("人工标签"), (F.col("rank") + F.col("flag")).cast("string").alias("信心1到5"),
        F.when(F.col("entropy") > 0.5, "是").otherwise("否").alias("是否二审"),
    )


@query(_W + f""", a AS (SELECT domain, {_SQL_LABEL}[label + 1] AS silver, ['supported', 'mild_scope_overclaim', 'strong_action_overclaim', 'contradiction_candidate', 'uncertain_insufficient_context'][n_words % 5 + 1] AS said
  , CASE WHEN cid % 4 > 0 THEN cid % 40 ELSE 0 END AS place, entropy > 0.5 AS again, rank + flag AS sure FROM s)
SELECT domain, count(*) AS n, count(*) FILTER (said = '{review.STRONG}') AS n_strong, round(avg((said = silver)::INTEGER), 6) AS agreement, count(*) FILTER (again) AS second_reviews, round(avg(sure) FILTER (sure <= 5), 6) AS confidence
, round(avg((silver = '{review.STRONG}')::INTEGER) FILTER (said = '{review.STRONG}' AND place <= 20), 6) AS silver_in_top FROM a GROUP BY domain""")
def bilingual_audit(spark, d):
    """What an audit in a second language says of each domain, once its columns and answers are recoded."""
    return review.audit(review.recoded(_sheet(spark, d)), "domain")


@query(_PRED + f""", r AS (SELECT cid, p_strong, p_contra, {_SQL_LABEL}[pred + 1] AS said FROM x)
SELECT row_number() OVER (ORDER BY p_strong DESC, cid)::INTEGER AS review_rank, cid, CASE WHEN said = '{review.STRONG}' THEN printf('R4 flagged strong_action (p_strong=%.3f, p_contra=%.3f)', p_strong, p_contra) WHEN p_strong >= 0.4 THEN printf('High p_strong=%.3f but below threshold; pred=%s', p_strong, said)
  WHEN p_contra >= 0.4 THEN printf('High p_contra=%.3f; pred=%s', p_contra, said) ELSE 'Low priority; pred=' || said END AS reason FROM r QUALIFY review_rank <= 100""")
def queue_reasons(spark, d):
    """The hundred rows to review first and why they stand there; the limit is the queue's."""
    said = F.get(F.array(*map(F.lit, _LABELS)), F.col("pred").cast("int"))
    top = _predicted(spark, d).select("cid", "p_strong", review.reason(said, F.col("p_strong"), F.col("p_contra")).alias("reason")).orderBy(F.desc("p_strong"), "cid").limit(100)
    return top.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("p_strong")).alias("p"), "cid", "reason"))).alias("l")).select(F.posexplode("l").alias("i", "x")).select((F.col("i") + 1).alias("review_rank"), "x.cid", "x.reason")


@query(_PRED + f""", r AS (SELECT grp, {_SQL_LABEL}[pred + 1] AS said, p_strong, p_contra FROM x)
SELECT grp, CASE WHEN said = '{review.STRONG}' THEN 'R4' WHEN p_strong >= 0.4 OR p_contra >= 0.4 THEN 'High' ELSE 'Low' END AS kind, count(*) AS n FROM r GROUP BY ALL""")
def reason_kinds(spark, d):
    """How often each kind of reason stands in every group of candidates."""
    said = F.get(F.array(*map(F.lit, _LABELS)), F.col("pred").cast("int"))
    x = _predicted(spark, d).select("grp", F.substring_index(review.reason(said, F.col("p_strong"), F.col("p_contra")), " ", 1).alias("kind"))
    return x.groupBy("grp", "kind").agg(F.count("*").alias("n"))


_HASH = "md5('42|' || doc_id::VARCHAR)"
_LENT = rf"""{_CLAIMS}, line AS (SELECT *, row_number() OVER (ORDER BY {_HASH}) AS place, count(*) OVER () AS n, ('0x' || substr({_HASH}, 3, 8))::BIGINT AS h FROM known)
, lent AS (SELECT a.doc_id, b.doc_id AS wrong_id, a.claim, a.evidence, b.evidence AS other FROM line a JOIN line b ON b.place = (a.place - 1 + a.h % (a.n - 1) + 1) % a.n + 1)
, gap AS (SELECT doc_id, wrong_id, {_DISTINCT('claim')} AS c, {_DISTINCT('evidence')} AS r, {_DISTINCT('other')} AS w FROM lent)
, o AS (SELECT doc_id, wrong_id, round({_DICE.format('c', 'r')}, 6) AS right_overlap, round({_DICE.format('c', 'w')}, 6) AS wrong_overlap FROM gap)"""


def _mismatched(spark, d):
    x = review.mismatched(_claims(spark, d).select("doc_id", "claim", "evidence"), "doc_id", "evidence")
    own, other = review.overlap_gap("claim", "evidence", "wrong_evidence")
    return x.select("doc_id", F.col("wrong_key").alias("wrong_id"), own.alias("right_overlap"), other.alias("wrong_overlap"))


@query(f"WITH {_LENT} SELECT * FROM o")
def mismatched_evidence(spark, d):
    """Every claim with its own evidence and with that of another document, and what it shares with either."""
    return _mismatched(spark, d)


@query(f"WITH {_LENT} SELECT lang, count(*) AS n, round(avg(CASE WHEN right_overlap > wrong_overlap THEN 1.0 WHEN right_overlap = wrong_overlap THEN 0.5 ELSE 0.0 END), 6) AS prefers_own, round(avg(right_overlap - wrong_overlap), 6) AS gap FROM o JOIN documents USING (doc_id) GROUP BY lang")
def mismatch_sensitivity(spark, d):
    """How often a claim shares more with its own evidence than with lent one, by language; ties count half."""
    x = _mismatched(spark, d).join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    won = F.when(F.col("right_overlap") > F.col("wrong_overlap"), 1.0).when(F.col("right_overlap") == F.col("wrong_overlap"), 0.5).otherwise(0.0)
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(won), 6).alias("prefers_own"), F.round(F.avg(F.col("right_overlap") - F.col("wrong_overlap")), 6).alias("gap"))
