"""Registered queries that judge: realism, cue scores, failures, calibration, tiers, case types and run decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import errors, metrics, ordinal, rules
from tessera.plans.catalog import _PRED, _W, _predicted, _scores, _t, query
from tessera.plans.evidence import _PAIRS, _TOP, _count_sql, _top, pairs


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any_sql(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({x}), {_q(p)})" for p in patterns) + ")"


_CONTENT = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda w: length(w) > 2 AND w NOT IN (" + ",".join(map(_q, K.STOP_WORDS["realism"])) + "))"
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN {2} ELSE len(list_intersect(list_distinct({0}), list_distinct({1})))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"
_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
_LIST = "list_filter([{0}], lambda e: e IS NOT NULL)"

_REALISM = f"""{_PAIRS}, rc AS (SELECT *, {_CONTENT.format('claim')} AS c FROM pr), rg AS (SELECT grp, arg_min(c, uid) FILTER (label = 0) AS sup, arg_min(c, uid) FILTER (label = 1) AS mild, arg_min(c, uid) FILTER (label = 2) AS strong FROM rc GROUP BY grp)
, rs AS (SELECT a.uid, avg({_JAC.format('a.c', 'b.c', '1.0')}) AS sibling FROM rc a JOIN rc b ON a.grp = b.grp AND a.uid <> b.uid GROUP BY a.uid)
, ra AS (SELECT rc.*, coalesce(sup, []) AS sup, coalesce(mild, []) AS mild, coalesce(strong, []) AS strong, coalesce(sibling, 0) AS sibling, {_WORDS.format('claim')} AS n, {_count_sql('claim', rules.FORCED)} AS cc, {_count_sql('evidence', rules.FORCED)} AS ec FROM rc JOIN rg USING (grp) LEFT JOIN rs USING (uid))
, rb AS (SELECT *, {_JAC.format('c', 'sup', '0.0')} AS j1, {_JAC.format('mild', 'strong', '0.0')} AS j2, len(list_filter(list_distinct(mild), lambda w: NOT list_contains(strong, w))) + len(list_filter(list_distinct(strong), lambda w: NOT list_contains(mild, w))) AS apart FROM ra)
, rr AS (SELECT grp, uid, label, {_LIST.format(f'''CASE WHEN sibling > 0.6 THEN 'too_template_like' END, CASE WHEN {_any_sql('claim', rules.UNNATURAL)} OR (n > 0 AND (n < 6 OR n > 70)) THEN 'unnatural_wording' END, CASE WHEN {_any_sql('claim', rules.NON_SCIENTIFIC)} THEN 'not_scientific_claim' END,
  CASE WHEN label = 3 AND len(c) > 0 AND len(sup) > 0 AND (j1 > 0.7 OR (j1 > 0.5 AND {_any_sql('claim', rules.NEGATED)})) THEN 'contradiction_too_mechanical' END, CASE WHEN label = 2 AND cc > 0 AND (ec = 0 OR cc >= 3) THEN 'strong_action_too_forced' END,
  CASE WHEN label IN (1, 2) AND len(mild) > 0 AND len(strong) > 0 AND (j2 > 0.75 OR (apart <= 3 AND j2 > 0.5)) THEN 'mild_strong_boundary_unclear' END''')} AS risks FROM rb), rz AS (SELECT *, least(5, len(risks))::INTEGER AS score FROM rr)"""


def _realism(spark, d):
    return rules.group_realism(pairs(spark, d), "grp", "uid", "label", "claim", "evidence")


@query(f"WITH {_REALISM} SELECT grp, uid, array_to_string(risks, ';') AS risks, score, least(5, score + 1)::INTEGER AS realism, CASE WHEN score <= 1 THEN 'keep' WHEN score = 2 THEN 'review' WHEN score = 3 THEN 'prioritize_gold_realism' WHEN list_contains(risks, 'too_template_like') THEN 'exclude_from_paper_examples' ELSE 'prioritize_gold_realism' END AS action FROM rz")
def claim_realism(spark, d):
    """Realism risks of every turn beside the other turns of its conversation."""
    return _realism(spark, d)


@query(f"WITH {_REALISM} SELECT grp, count(*) AS n, round(avg(score), 6) AS mean_score, CASE WHEN max(score) >= 4 OR avg(score) >= 3 THEN 'high' WHEN max(score) >= 2 OR avg(score) >= 2 THEN 'medium' ELSE 'low' END AS level FROM rz GROUP BY grp")
def group_risk(spark, d):
    return _realism(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), rules.risk_level(F.max("score"), F.avg("score")).alias("level"))


@query(f"""WITH {_PAIRS}, g AS (SELECT grp, coalesce(arg_min({_CONTENT.format('claim')}, uid) FILTER (label = 0), []) AS s, coalesce(arg_min({_CONTENT.format('claim')}, uid) FILTER (label = 1), []) AS m, coalesce(arg_min({_CONTENT.format('claim')}, uid) FILTER (label = 2), []) AS a, coalesce(arg_min({_CONTENT.format('claim')}, uid) FILTER (label = 3), []) AS c FROM pr GROUP BY grp)
, j AS (SELECT grp, {_JAC.format('s', 'm', '1.0')} AS sm, {_JAC.format('m', 'a', '1.0')} AS ms, {_JAC.format('s', 'c', '1.0')} AS sc FROM g)
SELECT grp, greatest(1, 5 - (CASE WHEN sm > 0.85 AND ms > 0.85 THEN 2 ELSE 0 END + CASE WHEN ms > 0.8 THEN 1 ELSE 0 END + CASE WHEN sc > 0.75 THEN 1 ELSE 0 END + CASE WHEN sc > sm + 0.1 THEN 1 ELSE 0 END))::INTEGER AS naturalness FROM j""")
def gradient_naturalness(spark, d):
    """How naturally a group's claims step from supported to contradiction; a label that a group lacks has no words."""
    x = pairs(spark, d).select("grp", "uid", "label", rules.content(F.col("claim")).alias("c"))
    pick = lambda v: F.coalesce(F.min_by(F.when(F.col("label") == v, F.col("c")), F.when(F.col("label") == v, F.col("uid"))), F.array().cast("array<string>"))
    g = x.groupBy("grp").agg(*[pick(v).alias(n) for v, n in enumerate("smac")])
    j = lambda a, b: K.jaccard(F.array_distinct(a), F.array_distinct(b), 1.0)
    return g.select("grp", rules.gradient(j("s", "m"), j("m", "a"), j("s", "c")).alias("naturalness"))


_R = {n: f"regexp_matches(lower(claim), {_q(getattr(rules, n))})" for n in ("TEMPLATE_OPENING", "TEMPLATE_PHRASE", "PLACEHOLDER", "INFORMAL", "MECHANICAL", "ACTION_PHRASE")}
_C = {n: f"len(regexp_extract_all(lower(claim), {_q(getattr(rules, n))}))" for n in ("SUPERLATIVE", "ACTION_CUE")}
_FOUR = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}')))"


@query(rf"""WITH {_PAIRS}, f AS (SELECT *, {_WORDS.format('claim')} AS n, {_FOUR.format('claim')} AS a, {_FOUR.format('evidence')} AS b FROM pr)
SELECT uid, CASE WHEN claim = '' OR n < 8 OR {_R['INFORMAL']} THEN 'not_scientific_claim' WHEN label = 3 AND {_R['MECHANICAL']} THEN 'contradiction_too_mechanical' WHEN label = 2 AND ({_C['ACTION_CUE']} >= 2 OR {_R['ACTION_PHRASE']}) THEN 'strong_action_too_forced'
  WHEN {_C['SUPERLATIVE']} >= 2 OR ({_C['SUPERLATIVE']} = 1 AND label = 2) THEN 'too_extreme' WHEN {_R['PLACEHOLDER']} OR (len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(a) < 0.15) THEN 'unnatural_wording'
  WHEN {_R['TEMPLATE_OPENING']} OR {_R['TEMPLATE_PHRASE']} THEN 'too_template_like' WHEN label IN (1, 2) AND n < 15 THEN 'mild_strong_boundary_unclear' ELSE 'none' END AS risk FROM f""")
def realism_risk(spark, d):
    return pairs(spark, d).select("uid", rules.single_realism(F.col("claim"), F.col("evidence"), F.col("label")).alias("risk"))


_CUES = {"contra": ["not", "however", "contrary"], "action": ["deploy", "always", "must"], "mild": ["all", "every", "general"], "limits": ["only", "may", "some"]}


def _cue_sql(x: str, cues: list[str]) -> str:
    return "(" + " + ".join((rf"regexp_matches(lower({x}), '\b{c}\b')" if len(c) <= 3 else f"contains(lower({x}), '{c}')") + "::INTEGER" for c in cues) + ")"


_SEEN = {n: f"({_cue_sql('claim', c)} > 0 OR {_cue_sql('evidence', c)} > 0)" for n, c in _CUES.items()}


@query(f"WITH {_PAIRS}, b AS (SELECT uid, label, CASE WHEN {_SEEN['contra']} THEN 3 WHEN {_SEEN['action']} THEN 2 WHEN {_SEEN['mild']} THEN 1 ELSE 0 END AS base, ({_cue_sql('evidence', _CUES['limits'])} > 0)::INTEGER AS limited FROM pr) SELECT uid, least(3, base + limited)::INTEGER AS score, least(3, base + limited) = label AS agrees FROM b")
def scalar_rule_score(spark, d):
    s = rules.scalar_score(F.col("claim"), F.col("evidence"), _CUES["contra"], _CUES["action"], _CUES["mild"], _CUES["limits"])
    return pairs(spark, d).select("uid", s.alias("score"), (s == F.col("label")).alias("agrees"))


_ACTIONS = "[" + ", ".join(map(_q, errors.ACTIONS)) + "]"


@query(rf"""WITH {_PAIRS}, a AS (SELECT uid, claim, evidence, list_intersect(list_distinct(regexp_extract_all(lower(claim), '[\p{{L}}\p{{N}}_]+')), {_ACTIONS}) AS acts, {_WORDS.format('evidence')} AS n, CASE WHEN evidence = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(evidence, '[.!?]+'))) END AS ns FROM pr)
SELECT uid, ns::INTEGER AS n_sentences, (n > 0 AND n < 5) OR n > 50 OR ns >= 3 AS noise, claim <> '' AND evidence <> '' AND len(acts) > 0 AND len(list_filter(acts, lambda w: NOT contains(lower(evidence), w))) >= greatest(1, len(acts) // 2) AS shortcut FROM a""")
def text_error_tags(spark, d):
    """The tags that need texts: evidence that is too short, too long or of many sentences, and claims of action without support."""
    e = F.col("evidence")
    n = errors.n_sentences(e)
    return pairs(spark, d).select("uid", n.cast("int").alias("n_sentences"), errors.format_noise(T.count_words(e), F.lit(1), n).alias("noise"), errors.action_shortcut(F.col("claim"), e).alias("shortcut"))


# -- screening with known and with retrieved evidence

_STRONG_C, _LIMIT_C = ["the", "all", "with", "must", "will"], ["may", "some", "only", "but"]


def _risk_sql(c: str, e: str) -> str:
    a, b = _count_sql(c, _STRONG_C), _count_sql(e, _LIMIT_C)
    return f"CASE WHEN {a} >= 2 AND {b} >= 1 THEN 3 WHEN {a} >= 1 AND {b} >= 1 THEN 2 WHEN {a} >= 1 THEN 1 ELSE 0 END"


_SCREEN = f"""{_TOP}, sr AS (SELECT item_id, rank, {_risk_sql('claim', 'text')} AS risk, contains(text, claim) AS hit FROM top)
, sc AS (SELECT b.item_id, (b.item_id % 4)::INTEGER AS label, {_risk_sql('b.text', 'b.text')} AS known, coalesce(max(risk) FILTER (rank = 1), -1) AS first, coalesce(max(risk) FILTER (rank <= 3), -1) AS three, coalesce(bool_or(hit) FILTER (rank = 1), false) AS hit, count(risk) > 0 AS got FROM benchmark b LEFT JOIN sr USING (item_id) GROUP BY b.item_id, b.text)"""


def _screen(spark, d):
    x = _top(spark, d).select("item_id", "rank", rules.cue_risk(F.col("claim"), F.col("text"), _STRONG_C, _LIMIT_C).alias("risk"), F.contains("text", "claim").alias("hit"))
    by = x.groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("risk"))).alias("first"), F.max(F.when(F.col("rank") <= 3, F.col("risk"))).alias("three"), F.bool_or(F.when(F.col("rank") == 1, F.col("hit"))).alias("hit"))
    claims = _t(spark, d, "benchmark").select("item_id", (F.col("item_id") % 4).cast("int").alias("label"), rules.cue_risk(F.col("text"), F.col("text"), _STRONG_C, _LIMIT_C).alias("known"))
    return claims.join(by.withColumn("got", F.lit(True)), "item_id", "left").select("item_id", "label", "known", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("three", F.lit(-1)).alias("three"), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("got", F.lit(False)).alias("got"))


@query(f"WITH {_SCREEN} SELECT item_id, known::INTEGER AS known, first::INTEGER AS first, three::INTEGER AS three, hit FROM sc")
def downstream_screening(spark, d):
    """The cue score of every claim with its own passage, with the best chunk and with the best three chunks."""
    return _screen(spark, d).select("item_id", "known", "first", "three", "hit")


@query(f"WITH {_SCREEN}, u AS (SELECT label = 2 AS y, unnest(['known', 'first', 'three']) AS evidence, unnest([known >= 2, first >= 2, three >= 2]) AS said FROM sc) SELECT evidence, count(*) FILTER (y AND said) AS tp, count(*) FILTER (NOT y AND said) AS fp, count(*) FILTER (y AND NOT said) AS fn, round(coalesce(2.0 * count(*) FILTER (y AND said) / nullif(count(*) FILTER (said) + count(*) FILTER (y), 0), 0), 6) AS f1 FROM u GROUP BY evidence")
def downstream_metrics(spark, d):
    y = F.col("label") == 2
    u = _screen(spark, d).select(y.alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("evidence"), (F.col(c) >= 2).alias("said")) for c in ("known", "first", "three")])))
    n = lambda c: F.count_if(c)
    s, t = F.col("said"), F.col("y")
    f1 = F.round(F.coalesce(F.try_divide(2.0 * n(s & t), n(s) + n(t)), F.lit(0.0)), 6)
    return u.groupBy("evidence").agg(n(s & t).alias("tp"), n(s & ~t).alias("fp"), n(~s & t).alias("fn"), f1.alias("f1"))


@query(f"WITH {_SCREEN} SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 'pdf_missing' WHEN item_id % 7 = 0 THEN 'oracle_not_in_pdf_text' WHEN NOT got THEN 'retrieval_empty' WHEN NOT hit AND item_id % 2 = 0 THEN 'retrieved_wrong_paper' WHEN NOT hit THEN 'oracle_chunk_not_retrieved' WHEN (known >= 2) <> (first >= 2) THEN 'relation_screening_failed_after_good_retrieval' ELSE 'none' END AS failure FROM sc")
def failure_types(spark, d):
    """Why the evidence of a claim was not found; which papers are missing and known is arithmetic on the id here."""
    i = F.col("item_id")
    kind = rules.failure_type(i % 11 == 0, i % 7 != 0, F.col("got"), F.col("hit"), i % 2 != 0, (F.col("known") >= 2) == (F.col("first") >= 2))
    return _screen(spark, d).select("item_id", kind.alias("failure"))


@query(f"WITH {_SCREEN}, p AS (SELECT item_id, CASE WHEN first >= 2 THEN 1 WHEN known >= 2 THEN 2 WHEN label = 2 THEN 3 WHEN label = 3 THEN 4 ELSE 5 END AS priority FROM sc WHERE got) SELECT item_id, priority::INTEGER AS priority, row_number() OVER (ORDER BY priority, item_id)::INTEGER AS place FROM p ORDER BY priority, item_id LIMIT 100")
def risk_queue(spark, d):
    """The hundred claims to review first; the limit is the queue's."""
    p = _screen(spark, d).filter("got").select("item_id", rules.review_priority(F.col("first") >= 2, F.col("known") >= 2, F.col("label")).alias("priority"))
    best = p.orderBy("priority", "item_id").limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy("priority", "item_id")))


# -- cases and decisions

_CASES = _PRED + ", y AS (SELECT cid, label, strong, flag = 1 AS before, pred = 2 AS after, pred, rank() OVER (ORDER BY p_strong DESC) <= 100 AS top_before, rank() OVER (ORDER BY p_svm DESC) <= 100 AS top_after FROM x), z AS (SELECT *, CASE WHEN after AND NOT before THEN 'helped' WHEN before AND NOT after THEN 'harmed' ELSE 'neutral' END AS sel, CASE WHEN top_after AND NOT top_before THEN 'helped' WHEN top_before AND NOT top_after THEN 'harmed' ELSE 'neutral' END AS rnk FROM y)"


@query(_CASES + " SELECT sel, rnk, CASE WHEN sel = 'helped' AND rnk = 'helped' THEN 'both_helped' WHEN sel = 'harmed' AND rnk = 'harmed' THEN 'both_failed' WHEN sel = 'helped' OR rnk = 'helped' THEN 'partial_help' ELSE 'no_change' END AS combined, CASE WHEN strong AND NOT after THEN 'strong_action_false_negative' WHEN NOT strong AND after THEN 'strong_action_false_positive' WHEN strong AND after AND NOT before THEN 'screening_recovery' ELSE 'screening_neutral' END AS screening, count(*) AS n FROM z GROUP BY ALL")
def change_categories(spark, d):
    """Whether new predictions and new ranks help; a rank within the first hundred counts ties with the best of them."""
    x = _predicted(spark, d)
    # the hundredth best score decides who is within: no rank of all rows is needed
    cut = lambda c: x.select(c).orderBy(F.desc(c)).limit(100).agg(F.min(c).alias(f"cut_{c}"))
    y = x.crossJoin(F.broadcast(cut("p_strong"))).crossJoin(F.broadcast(cut("p_svm")))  # one row each
    y = y.select("strong", (F.col("flag") == 1).alias("before"), (F.col("pred") == 2).alias("after"), (F.col("p_strong") >= F.col("cut_p_strong")).alias("tb"), (F.col("p_svm") >= F.col("cut_p_svm")).alias("ta"))
    z = y.withColumn("sel", rules.selector_change(F.col("before"), F.col("after"))).withColumn("rnk", rules.selector_change(F.col("tb"), F.col("ta")))
    return z.groupBy("sel", "rnk", rules.combined_change(F.col("sel"), F.col("rnk")).alias("combined"), rules.screening_change(F.col("strong"), F.col("before"), F.col("after")).alias("screening")).agg(F.count("*").alias("n"))


@query(_PRED + ", c AS (SELECT avg((pred = label)::INTEGER) AS e, avg((p_strong > 0.5)::INTEGER) AS u FROM x) SELECT CASE WHEN e >= 0.85 THEN 'proceed_full_label_audit' WHEN e >= 0.70 THEN 'eligible_subset_only' ELSE 'stop_formal_label_audit' END AS tier, CASE WHEN u < 0.50 THEN 'insufficient' ELSE 'adequate' END AS selected FROM c")
def audit_decision(spark, d):
    c = _predicted(spark, d).agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("e"), F.avg((F.col("p_strong") > 0.5).cast("int")).alias("u"))
    tier, selected = rules.decision(F.col("e"), F.col("u"))
    return c.select(tier.alias("tier"), selected.alias("selected"))


@query(_W + """, v AS (UNPIVOT (SELECT cid, strong, p_strong AS "A", p_svm AS "B", entropy AS "C" FROM s) ON "A", "B", "C" INTO NAME variant VALUE score), r AS (SELECT variant, strong, row_number() OVER (PARTITION BY variant ORDER BY score DESC, cid) AS rn FROM v)
, m AS (SELECT variant, count(*) FILTER (strong AND rn <= 20) / 20.0 AS p20, count(*) FILTER (strong AND rn <= 50) / 50.0 AS p50, count(*) FILTER (strong AND rn <= 100)::DOUBLE / count(*) FILTER (strong) AS r100 FROM r GROUP BY variant)
SELECT variant, p20 >= 0.40 AND p50 >= 0.35 AND r100 >= 0.45 AS meets, round(p20 + r100, 6)::DOUBLE AS composite FROM m ORDER BY meets DESC, composite DESC, variant LIMIT 1""")
def best_variant(spark, d):
    """The best of three orders by precision and recall; each is cut to its first hundred rows before any rank."""
    s = _scores(spark, d).select("cid", "strong", F.col("p_strong").alias("A"), F.col("p_svm").alias("B"), F.col("entropy").alias("C"))
    rows = [metrics.top_metrics(s, v, "cid", "strong", (20, 50, 100)).withColumn("variant", F.lit(v)) for v in "ABC"]
    m = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("variant").agg(F.max(F.when(F.col("k") == 20, F.col("precision"))).alias("p20"), F.max(F.when(F.col("k") == 50, F.col("precision"))).alias("p50"), F.max(F.when(F.col("k") == 100, F.col("recall"))).alias("r100"))
    return rules.best_variant(m, "variant", F.col("variant"), "p20", "p50", "r100")


@query("SELECT doc_id, CASE WHEN lower(text) = '' THEN 'unknown' WHEN contains(lower(text), 'high') THEN 'high' WHEN contains(lower(text), 'moderate') OR contains(lower(text), 'medium') THEN 'medium' WHEN contains(lower(text), 'low') THEN 'low' ELSE 'medium' END AS risk FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM documents)")
def risk_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", rules.normalize_risk(F.col("text")).alias("risk"))


@query("WITH i AS (SELECT o_orderkey, 'SB' || o_custkey || '-' || replace(o_orderpriority, ' ', '-') || '-G' || o_orderkey AS id FROM orders) SELECT o_orderkey, CASE WHEN len(string_split(id, '-')) >= 4 THEN regexp_replace(id, '-[^-]*$', '') ELSE id END AS grp FROM i")
def derived_groups(spark, d):
    i = F.concat(F.lit("SB"), F.col("o_custkey"), F.lit("-"), F.replace("o_orderpriority", F.lit(" "), F.lit("-")), F.lit("-G"), F.col("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey", rules.derive_group(i).alias("grp"))


_SUSP = ["not", "fails", "cannot", "contrary", "instead"]


@query(rf"""WITH {_PAIRS}, a AS (SELECT uid, label, list_distinct({_CONTENT.format('claim')}) AS a, {_CONTENT.format('evidence')} AS b, list_distinct(regexp_extract_all(claim, '\d+(?:\.\d+)?')) AS na, list_distinct(regexp_extract_all(evidence, '\d+(?:\.\d+)?')) AS nb FROM pr)
SELECT uid, CASE WHEN label = 0 THEN '' WHEN len(a) = 0 THEN 'empty_claim' WHEN len(list_filter(a, lambda w: NOT list_contains(b, w)))::DOUBLE / len(a) < 0.12 AND NOT (len(na) > 0 AND len(nb) > 0 AND len(list_filter(na, lambda v: NOT list_contains(nb, v))) > 0) AND len(list_intersect(a, {_SUSP})) = 0 THEN 'low_claim_only_signal' ELSE '' END AS suspicion FROM a""")
def semantic_suspicion(spark, d):
    return pairs(spark, d).select("uid", rules.suspicion(F.col("label"), F.col("claim"), F.col("evidence"), _SUSP).alias("suspicion"))


_FOLDERS, _SUFFIXES, _NAMES = ["private", "cache"], [".pkl", ".pdf"], ["raw", "secret", "a"]
_KINDS = [(r"\.(pkl|joblib|pickle)$", "model_artifact"), ("threshold|manifest", "threshold"), ("prediction|per_item", "prediction"), ("router|routing", "routing_logic"), ("candidate", "candidate_pool")]


@query("""WITH p AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'data/private/x' || page_id || '.csv' WHEN 1 THEN 'runs/thresholds_' || page_id || '.json' WHEN 2 THEN 'models/seed_' || page_id || '.pkl' WHEN 3 THEN 'out\\raw_' || page_id || '.txt' ELSE 'docs/q' || page_id || '.md' END AS path FROM pages), s AS (SELECT *, string_split(replace(path, '\\', '/'), '/') AS l FROM p)
SELECT page_id, CASE WHEN len(list_intersect(l, ['private', 'cache'])) > 0 THEN 'excluded_dir:private' WHEN ends_with(lower(l[-1]), '.pkl') THEN 'suffix:.pkl' WHEN ends_with(lower(l[-1]), '.pdf') THEN 'suffix:.pdf' WHEN contains(lower(l[-1]), 'raw') THEN 'file_pattern:raw' WHEN contains(lower(l[-1]), 'secret') THEN 'file_pattern:secret' WHEN contains(lower(l[-1]), 'a') THEN 'file_pattern:a' ELSE '' END AS reason,
  CASE WHEN regexp_matches(string_split(path, '/')[-1], '\\.(pkl|joblib|pickle)$') THEN 'model_artifact' WHEN regexp_matches(string_split(path, '/')[-1], 'threshold|manifest') THEN 'threshold' WHEN regexp_matches(string_split(path, '/')[-1], 'prediction|per_item') THEN 'prediction' WHEN regexp_matches(string_split(path, '/')[-1], 'router|routing') THEN 'routing_logic' WHEN contains(string_split(path, '/')[-1], 'candidate') THEN 'candidate_pool' ELSE 'other' END AS kind FROM s""")
def path_rules(spark, d):
    """Why a file is left out of a release, and what kind of asset it is; paths are made from page numbers."""
    i = F.col("page_id")
    name = lambda a, b: F.concat(F.lit(a), i, F.lit(b))
    path = F.when(i % 5 == 0, name("data/private/x", ".csv")).when(i % 5 == 1, name("runs/thresholds_", ".json")).when(i % 5 == 2, name("models/seed_", ".pkl")).when(i % 5 == 3, name("out\\raw_", ".txt")).otherwise(name("docs/q", ".md"))
    return _t(spark, d, "pages").select("page_id", rules.excluded(path, _FOLDERS, _SUFFIXES, _NAMES).alias("reason"), rules.asset_type(path, _KINDS).alias("kind"))


_LABELS = ["supported", "mild", "strong"]


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'parse_failed' WHEN turn % 4 = 2 THEN 'invalid_label' ELSE 'ok' END AS status, CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 4 = 2 THEN 'unsure' ELSE 'strong' END AS label, CASE WHEN turn % 4 IN (2, 3) THEN 0.0::DOUBLE WHEN turn % 4 = 1 THEN 1.0::DOUBLE ELSE round((conv_id % 10) / 10.0::DOUBLE, 3) END AS confidence FROM conversations""")
def parsed_answers(spark, d):
    """Labels read from answers that are bare JSON, fenced JSON, JSON amid text with an unknown label, or none at all."""
    t, c = F.col("turn") % 4, F.col("conv_id") % 10
    raw = F.when(t == 0, F.concat(F.lit('{"label": " Strong ", "confidence": 0.'), c, F.lit("}"))).when(t == 1, F.lit('```json\n{"label": "strong", "confidence": 3}\n```')).when(t == 2, F.lit('I say {"label": "unsure", "confidence": 1} here')).otherwise(F.lit("no idea {"))
    return _t(spark, d, "conversations").select("conv_id", "turn", rules.parsed_answer(raw, _LABELS).alias("p")).select("conv_id", "turn", "p.*")


# -- calibration and tiers


@query(_W + ", b AS (SELECT least(9, floor(p_strong * 10)) AS bin, count(*) AS n, avg(p_strong) AS p, avg(strong::INTEGER) AS y FROM s GROUP BY 1) SELECT (SELECT round(sum(n * abs(p - y)) / sum(n), 6) FROM b) AS ece, round(avg((p_strong - strong::INTEGER) ** 2), 6) AS brier, round(-avg(CASE WHEN strong THEN ln(least(1 - 1e-7, greatest(1e-7, p_strong))) ELSE ln(1 - least(1 - 1e-7, greatest(1e-7, p_strong))) END), 6) AS nll FROM s")
def calibration_report(spark, d):
    return ordinal.calibration(_scores(spark, d), "p_strong", "strong")


@query(_W + " SELECT least(9, floor(p_strong * 10))::INTEGER AS bin, count(*) AS n, round(avg(p_strong), 6) AS mean_prob, round(avg(strong::INTEGER), 6) AS share FROM s GROUP BY 1")
def reliability_bins(spark, d):
    return ordinal.reliability(_scores(spark, d), "p_strong", "strong")


@query(_W + ", g AS (SELECT i, round(i / 10.0::DOUBLE, 6) AS threshold FROM unnest(range(0, 11)) AS t(i)) SELECT threshold, round(coalesce(2.0 * count(*) FILTER (strong AND floor(p_strong * 10 + 1e-9) >= i) / nullif(count(*) FILTER (floor(p_strong * 10 + 1e-9) >= i) + count(*) FILTER (strong), 0), 0), 6) AS f1 FROM s CROSS JOIN g GROUP BY i, threshold")
def even_thresholds(spark, d):
    return ordinal.threshold_grid(_scores(spark, d), "p_strong", "strong", 11)


_DIMS = ("scope", "action", "certainty", "causal")
_TIER_SQL = "SELECT o_orderkey AS id, " + ", ".join(f"(o_orderkey * {7 + i}) % 5 AS c_{x}, (o_orderkey * {7 + i} + o_custkey % {3 + i} % 2) % 5 AS p_{x}, (o_orderkey * {11 + i}) % 5 AS s_{x}" for i, x in enumerate(_DIMS)) + " FROM orders"


def _tiers(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    cols = [e for i, x in enumerate(_DIMS) for e in (((o * (7 + i)) % 5).alias(f"c_{x}"), ((o * (7 + i) + c % (3 + i) % 2) % 5).alias(f"p_{x}"), ((o * (11 + i)) % 5).alias(f"s_{x}"))]
    return _t(spark, d, "orders").select(o.alias("id"), *cols)


@query(f"WITH t AS ({_TIER_SQL}), u AS (SELECT unnest({list(_DIMS)}) AS dim, unnest([{', '.join('c_' + x for x in _DIMS)}]) AS c, unnest([{', '.join('p_' + x for x in _DIMS)}]) AS p, unnest([{', '.join('s_' + x for x in _DIMS)}]) AS s FROM t) SELECT dim, round(1 - avg((c - p) ** 2) / (avg(c * c) + avg(p * p) - 2 * avg(c) * avg(p)), 6) AS kappa, round(avg(abs(c - p)), 6) AS mae, count(*) FILTER (p > c) AS over, count(*) FILTER (p < c) AS under, count(*) FILTER (p = c) AS exact, round(avg(((c > s) = (p > s))::INTEGER), 6) AS exceeds FROM u GROUP BY dim")
def tier_metrics(spark, d):
    """Agreement, over- and underestimates and exceedance accuracy of tiers, by dimension."""
    return ordinal.per_dimension(_tiers(spark, d), list(_DIMS), "c", "p", "s")


@query(f"WITH t AS ({_TIER_SQL}) SELECT id, array_to_string(list_filter([{', '.join(f'''CASE WHEN c_{x} > s_{x} THEN '{x}_missing' END''' for x in _DIMS)}], lambda e: e IS NOT NULL), ';') AS gaps, (CASE WHEN c_causal >= 3 AND id % 2 = 0 THEN least(s_causal, 2) ELSE s_causal END)::BIGINT AS ceiling, round(1 - {' * '.join(f'(1 - c_{x} / 5.0::DOUBLE)' for x in _DIMS)}, 6) AS escalation, round(greatest(c_{_DIMS[0]}, c_{_DIMS[1]}, c_{_DIMS[2]}, c_{_DIMS[3]}) / 5.0::DOUBLE, 6) AS worst, coalesce(CASE WHEN id % 3 = 0 THEN 1 END, (c_scope > s_scope)::INTEGER) AS label FROM t")
def tier_gaps(spark, d):
    """Gap names, support ceilings, combined escalation and filled labels of tiered claims."""
    t = _tiers(spark, d)
    c, s = F.array(*[f"c_{x}" for x in _DIMS]), F.array(*[f"s_{x}" for x in _DIMS])
    probs = F.transform(c, lambda v: v / 5.0)
    return t.select(
        "id", F.array_join(ordinal.gaps(c, s, list(_DIMS)), ";").alias("gaps"), ordinal.support_ceiling(F.col("s_causal"), F.col("c_causal"), F.col("id") % 2 != 0).alias("ceiling"), F.round(ordinal.noisy_or(probs), 6).alias("escalation"),
        F.round(F.array_max(probs), 6).alias("worst"), ordinal.fill_label(F.when(F.col("id") % 3 == 0, 1), F.col("c_scope"), F.col("s_scope")).alias("label"),
    )


@query(_W + """, p AS (SELECT cid, rank, [1 / (1 + exp(p_strong * 4 - 1)), 1 / (1 + exp(p_strong * 4 - 2)) - 1 / (1 + exp(p_strong * 4 - 1)), 1 / (1 + exp(p_strong * 4 - 3)) - 1 / (1 + exp(p_strong * 4 - 2)), 1 - 1 / (1 + exp(p_strong * 4 - 3))] AS pr, p_svm, entropy FROM s), k AS (SELECT *, list_sum(pr[1 : least(4, rank % 4 + 1)]) AS total FROM p)
SELECT cid, round(pr[1], 6) AS p0, round(pr[4], 6) AS p3, round(pr[1] / total, 6) AS capped0, round(CASE WHEN rank % 4 >= 3 THEN pr[4] / total ELSE 0 END, 6) AS capped3, round(greatest(0, p_svm - (1 - entropy)), 6) AS low, round(2 * (1 - entropy), 6) AS width FROM k""")
def tier_probabilities(spark, d):
    """Proportional-odds probabilities of four tiers, cut at a tier and scaled again, and an interval by confidence."""
    pr = ordinal.tier_probabilities(F.col("p_strong") * 4, [1.0, 2.0, 3.0])
    cut = ordinal.capped(pr, F.col("rank") % 4)
    low, width = ordinal.lower_bound(F.col("p_svm"), F.col("entropy"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return _scores(spark, d).select("cid", r(F.get(pr, F.lit(0)), "p0"), r(F.get(pr, F.lit(3)), "p3"), r(F.get(cut, F.lit(0)), "capped0"), r(F.get(cut, F.lit(3)), "capped3"), r(low, "low"), r(width, "width"))


@query(_PRED + ", a AS (SELECT grp FROM x GROUP BY grp HAVING count(DISTINCT label) = 4), b AS (SELECT grp FROM x GROUP BY grp HAVING count(DISTINCT label) < 2) SELECT (SELECT count(*) FROM a) AS complete, (SELECT count(*) FROM b) AS single, (SELECT count(*) FROM x WHERE (flag = 1) <> (label > pred)) AS conflicts")
def group_completeness(spark, d):
    x = _predicted(spark, d)
    one = lambda y, n: y.agg(F.count("*").alias(n))
    conflicts = ordinal.label_conflicts(x, "flag", "label", "pred")
    return one(ordinal.complete_groups(x, "grp", "label", 4), "complete").crossJoin(one(ordinal.single_class_splits(x, "grp", "label"), "single")).crossJoin(one(conflicts, "conflicts"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE array_to_string(list_filter(list_transform(string_split_regex(o_orderstatus || ' ,' || o_orderpriority || '; ' || o_custkey, '[,;]'), lambda v: trim(v)), lambda v: v <> ''), '|') END AS cells FROM orders")
def multi_value_cells(spark, d):
    x = F.when(F.col("o_orderkey") % 4 == 0, "NA").otherwise(F.concat(F.col("o_orderstatus"), F.lit(" ,"), F.col("o_orderpriority"), F.lit("; "), F.col("o_custkey")))
    return _t(spark, d, "orders").select("o_orderkey", F.when(ordinal.split_values(x).isNotNull(), F.array_join(ordinal.split_values(x), "|")).alias("cells"))
