"""Registered queries on errors, samples, thresholds, text audits and validation; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import audit, corpus, errors, metrics, models, retrieval, sampling, validation
from tessera.plans.catalog import _PRED, _SENT, _W, _predicted, _ranked, _scores, _t, query

_PLAIN = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_HYPHEN = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"

# -- errors and routes

_TAGGED = _PRED + """, g AS (SELECT grp, count(DISTINCT label) AS nl, count(DISTINCT pred) AS np FROM x GROUP BY grp), tg AS (SELECT x.*, concat_ws(';', CASE WHEN bm25 < 5 THEN 'retrieval_miss' END,
  CASE WHEN (n_words > 0 AND n_words < 5) OR n_words > 50 OR rank > 5 THEN 'evidence_format_noise' END, CASE WHEN bm25 / 50 < 0.30 THEN 'weak_selector_overlap' END,
  CASE WHEN p_contra > 0.30 AND label <> 3 THEN 'contradiction_confusion' END, CASE WHEN (label = 1 AND pred = 2) OR (label = 2 AND pred = 1) THEN 'mild_vs_strong_boundary' END,
  CASE WHEN label = 0 AND flag = 1 THEN 'supported_overflag' END, CASE WHEN entropy > 0.50 THEN 'uncertainty_high_entropy' END, CASE WHEN nl >= 2 AND np = 1 THEN 'group_variant_artifact' END) AS tags FROM x JOIN g USING (grp))"""


def _tagged(spark, d):
    x = _predicted(spark, d)
    g = x.groupBy("grp").agg(F.count_distinct("label").alias("nl"), F.count_distinct("pred").alias("np"))
    c = {n: F.col(n) for n in ("label", "pred", "p_contra", "n_words", "rank", "bm25")}
    flags = {
        "retrieval_miss": c["bm25"] < 5,
        "evidence_format_noise": errors.format_noise(c["n_words"], c["rank"], F.lit(1)),
        "weak_selector_overlap": c["bm25"] / 50 < errors.LOW_SELECTOR,
        "contradiction_confusion": errors.contra_confusion(c["p_contra"], c["label"]),
        "mild_vs_strong_boundary": errors.boundary_swap(c["label"], c["pred"]),
        "supported_overflag": (c["label"] == errors.SUPPORTED) & (F.col("flag") == 1),
        "uncertainty_high_entropy": F.col("entropy") > errors.HIGH_ENTROPY,
        "group_variant_artifact": (F.col("nl") >= 2) & (F.col("np") == 1),
    }
    return x.join(g, "grp").withColumn("tags", errors.tags(flags))


@query(_TAGGED + " SELECT cid, tags FROM tg")
def error_tags(spark, d):
    return _tagged(spark, d).select("cid", "tags")


@query(_TAGGED + " SELECT domain, tag, count(*) AS n FROM (SELECT domain, unnest(string_split(tags, ';')) AS tag FROM tg) WHERE tag <> '' GROUP BY domain, tag")
def error_tag_counts(spark, d):
    return _tagged(spark, d).select("domain", F.explode(F.split("tags", ";")).alias("tag")).filter("tag <> ''").groupBy("domain", "tag").agg(F.count("*").alias("n"))


@query(_PRED + " SELECT domain, CASE WHEN label = 2 AND pred = 2 THEN 'TP' WHEN pred = 2 THEN 'FP' WHEN label = 2 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM x GROUP BY 1, 2")
def outcome_counts(spark, d):
    return _predicted(spark, d).groupBy("domain", errors.outcome(F.col("label"), F.col("pred")).alias("outcome")).agg(F.count("*").alias("n"))


@query(_PRED + """ SELECT cid, (CASE WHEN p_contra >= 0.55 THEN 3 WHEN p_strong >= 0.5 THEN 2 WHEN p_svm >= 0.5 THEN 1 ELSE 0 END)::INTEGER AS contra_first, (CASE WHEN p_strong >= 0.5 THEN 2 WHEN p_contra >= 0.55 THEN 3 WHEN p_svm >= 0.5 THEN 1 ELSE 0 END)::INTEGER AS strong_first,
  (CASE WHEN p_contra - p_strong >= 0.205 THEN 3 WHEN p_strong - p_contra >= 0.205 THEN 2 ELSE pred END)::BIGINT AS margin FROM x""")
def route_variants(spark, d):
    c, s, m = F.col("p_contra"), F.col("p_strong"), F.col("p_svm")
    return _predicted(spark, d).select("cid", errors.contra_first(c, s, m, 0.55, 0.5, 0.5).alias("contra_first"), errors.strong_first(c, s, m, 0.55, 0.5, 0.5).alias("strong_first"), errors.by_margin(c, s, F.col("pred"), 0.205).alias("margin"))


@query(_W + ", m AS (SELECT median(n_words) AS mw, median(entropy) AS me FROM s) SELECT CASE WHEN entropy > me AND n_words > mw THEN 'uncertain_long' WHEN entropy > me THEN 'uncertain_short' WHEN n_words > mw THEN 'sure_long' ELSE 'sure_short' END AS kind, count(*) AS n FROM s CROSS JOIN m GROUP BY 1")
def median_error_class(spark, d):
    s = _scores(spark, d)
    # over distinct values, so that what is held does not grow with the rows
    half = lambda c, n: s.groupBy(c).agg(F.count("*").alias("n")).agg(F.percentile(c, 0.5, F.col("n")).alias(n))
    mid = half("n_words", "mw").crossJoin(half("entropy", "me"))
    unsure, long_ = F.col("entropy") > F.col("me"), F.col("n_words") > F.col("mw")
    kind = F.when(unsure & long_, "uncertain_long").when(unsure, "uncertain_short").when(long_, "sure_long").otherwise("sure_short")
    return s.crossJoin(F.broadcast(mid)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(_W + " SELECT grp, count(*) AS n, array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains, round(max(p_strong), 6) AS worst FROM s GROUP BY grp")
def group_rollup(spark, d):
    return _scores(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.round(F.max("p_strong"), 6).alias("worst"))


@query(_W + ", r AS (SELECT cid, domain, row_number() OVER w AS rn, count(*) OVER (PARTITION BY domain) AS n FROM s WINDOW w AS (PARTITION BY domain ORDER BY p_strong DESC, cid)) SELECT domain, CASE WHEN rn * 3 <= n THEN 'early' WHEN rn * 3 <= 2 * n THEN 'middle' ELSE 'late' END AS third, count(*) AS n, min(cid) AS first_cid FROM r GROUP BY 1, 2")
def positional_thirds(spark, d):
    w = Window.partitionBy("domain")
    r = _scores(spark, d).select("cid", "domain", F.row_number().over(w.orderBy(F.desc("p_strong"), "cid")).alias("rn"), F.count("*").over(w).alias("n"))
    third = F.when(F.col("rn") * 3 <= F.col("n"), "early").when(F.col("rn") * 3 <= 2 * F.col("n"), "middle").otherwise("late")
    return r.groupBy("domain", third.alias("third")).agg(F.count("*").alias("n"), F.min("cid").alias("first_cid"))


# -- thresholds, tests and distributions

_CUM = _W + ", b AS (SELECT p_strong AS threshold, count(*) FILTER (strong) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS called, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM b)"


@query(_CUM + " SELECT threshold, round(2.0 * tp / (called + pos), 6) AS f1 FROM c WHERE threshold > (SELECT min(threshold) FROM c) ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(_scores(spark, d), "p_strong", "strong")


@query(_W + ", g AS (SELECT a / 20.0 AS ta, b / 20.0 AS tb FROM unnest(range(4, 13)) AS t(a), unnest(range(8, 17, 2)) AS u(b)) SELECT ta::DOUBLE AS ta, tb::DOUBLE AS tb, round(2.0 * count(*) FILTER (strong AND p_strong >= ta AND p_contra < tb) / (count(*) FILTER (p_strong >= ta AND p_contra < tb) + count(*) FILTER (strong)), 6) AS f1 FROM s CROSS JOIN g GROUP BY ta, tb")
def threshold_grid(spark, d):
    return metrics.grid_search(_scores(spark, d), "p_strong", "p_contra", "strong", [a / 20 for a in range(4, 13)], [b / 20 for b in range(8, 17, 2)])


@query(_PRED + """, y AS (SELECT count(*) FILTER (pred = label AND (flag = 1) <> (label = 2)) AS b, count(*) FILTER (pred <> label AND (flag = 1) = (label = 2)) AS c FROM x)
SELECT b, c, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) FROM unnest(range(0, least(b, c) + 1)) AS t(i))), 6) AS p_value FROM y""")
def mcnemar_exact(spark, d):
    """Whether routes or flags are right more often, over all candidates."""
    x = _predicted(spark, d)
    return metrics.mcnemar(x.select((F.col("pred") == F.col("label")).alias("one"), ((F.col("flag") == 1) == F.col("strong")).alias("two")), "one", "two")


@query(_W + " SELECT label, count(*) AS n, round(avg(p_strong), 6) AS mean, round(stddev_pop(p_strong), 6) AS std, round(quantile_cont(p_strong, 0.25), 6) AS q1, round(quantile_cont(p_strong, 0.5), 6) AS median, round(quantile_cont(p_strong, 0.75), 6) AS q3 FROM s GROUP BY label")
def score_spread(spark, d):
    return metrics.spread(_scores(spark, d), "label", "p_strong")


@query(_W + ", u AS (UNPIVOT (SELECT cid, strong, p_strong, p_contra, p_svm FROM s) ON p_strong, p_contra, p_svm INTO NAME variant VALUE score) SELECT variant, count(*) AS n, round(avg(score), 6) AS mean, round(avg((score >= 0.5)::INTEGER), 6) AS share_high, count(*) FILTER (strong AND score >= 0.5) AS tp FROM u GROUP BY variant")
def variant_summary(spark, d):
    u = metrics.long_scores(_scores(spark, d).select("cid", "strong", "p_strong", "p_contra", "p_svm"), ["cid", "strong"], ["p_strong", "p_contra", "p_svm"])
    high = F.col("score") >= 0.5
    return u.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(high.cast("int")), 6).alias("share_high"), F.count_if(F.col("strong") & high).alias("tp"))


@query("SELECT round(corr(o_totalprice, (o_orderkey * 7919) % 1000), 6) AS r, count(*) AS n FROM orders")
def pearson(spark, d):
    return _t(spark, d, "orders").agg(F.round(F.corr(F.col("o_totalprice").cast("double"), ((F.col("o_orderkey") * 7919) % 1000).cast("double")), 6).alias("r"), F.count("*").alias("n"))


@query(_W + ", q AS (SELECT strong, least(1 - 1e-7, greatest(1e-7, p_strong)) AS x FROM s), g AS (SELECT strong, t, 1 / (1 + exp(-ln(x / (1 - x)) / t)) AS q FROM q, unnest([0.5, 0.75, 1.0, 1.5, 2.0, 3.0]::DOUBLE[]) AS u(t)) SELECT t, round(-avg(CASE WHEN strong THEN ln(q) ELSE ln(1 - q) END), 6) AS loss FROM g GROUP BY t")
def temperature_grid(spark, d):
    return models.temperature(_scores(spark, d), "p_strong", "strong", [0.5, 0.75, 1.0, 1.5, 2.0, 3.0])


# isotonic: the largest, over starts at or before a score, of the smallest, over ends at or after it, of the mean between
_ISO = """by_ AS (SELECT p_strong AS s, count(*) FILTER (strong)::DOUBLE AS p, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY p_strong) AS i FROM s GROUP BY p_strong), up AS (SELECT *, sum(p) OVER (ORDER BY i) AS sp, sum(n) OVER (ORDER BY i) AS sn FROM by_)
, pair AS (SELECT a.i AS i, b.i AS j, (b.sp - a.sp + a.p) / (b.sn - a.sn + a.n) AS m FROM up a JOIN up b ON a.i <= b.i), low AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM pair), iso AS (SELECT j AS i, max(m) AS isotonic FROM low GROUP BY j)"""
_PLATT = """fit AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT k + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT k, a, b, sum((p - n * q) * s) AS ga, sum(p - n * q) AS gb, sum(n * q * (1 - q) * s * s) AS haa, sum(n * q * (1 - q) * s) AS hab, sum(n * q * (1 - q)) AS hbb FROM (SELECT fit.*, by_.*, 1 / (1 + exp(-(a * s + b))) AS q FROM fit, by_ WHERE k < 12) GROUP BY k, a, b))"""


@query(_W.replace("WITH", "WITH RECURSIVE", 1) + f", {_ISO}, {_PLATT} SELECT cid, round(isotonic, 6) AS isotonic, round(1 / (1 + exp(-(a * p_strong + b))), 6) AS platt FROM s JOIN by_ ON by_.s = p_strong JOIN iso USING (i) CROSS JOIN (SELECT a, b FROM fit WHERE k = 12)")
def calibrated(spark, d):
    """Scores calibrated by isotonic regression and by a logistic curve."""
    return models.calibrate(_scores(spark, d), "cid", "p_strong", "strong")


# -- samples, splits and resamples

_H = "md5('42|' || {0}::VARCHAR)"


@query(_W + f", r AS (SELECT cid, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format('cid')}, cid) AS rn FROM s) SELECT cid, label FROM r WHERE rn <= 25")
def label_balanced_sample(spark, d):
    return sampling.per_label(_scores(spark, d).select("cid", "label"), "cid", "label", 25)


@query(_W + f", z AS (SELECT domain, count(*) AS size FROM s GROUP BY domain), r AS (SELECT cid, domain, size, row_number() OVER (PARTITION BY domain ORDER BY {_H.format('cid')}, cid) AS turn FROM s JOIN z USING (domain)) SELECT cid, domain FROM r ORDER BY turn, size DESC, domain LIMIT 100")
def round_robin_sample(spark, d):
    return sampling.round_robin(_scores(spark, d).select("cid", "domain"), "cid", "domain", 100).select("cid", "domain")


@query(_W + f", g AS (SELECT grp, row_number() OVER (ORDER BY {_H.format('grp')}, grp) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM s)), p AS (SELECT grp, CASE WHEN place <= round_even(n * 0.70, 0) THEN 'train' WHEN place <= round_even(n * 0.70, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END AS split FROM g) SELECT split, label, count(*) AS n, count(DISTINCT grp) AS n_groups FROM s JOIN p USING (grp) GROUP BY split, label")
def group_split_counts(spark, d):
    return sampling.group_split(_scores(spark, d), "grp").groupBy("split", "label").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))


@query(_W + """, g AS (SELECT grp, sum(p_svm - p_strong) AS d, count(*) AS n, row_number() OVER (ORDER BY grp) - 1 AS slot FROM s GROUP BY grp)
, dr AS (SELECT b, (slot * 48271 + b * 69621 + slot * b * 16807) % (SELECT count(*) FROM g) AS slot FROM g, unnest(range(0, 100)) AS t(b))
, e AS (SELECT b, round(sum(d) / sum(n), 9) AS delta FROM dr JOIN g USING (slot) GROUP BY b)
SELECT (SELECT round(sum(d) / sum(n), 6) FROM g) AS delta, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg((delta > 0)::INTEGER), 6) AS share_above FROM e""")
def paired_bootstrap(spark, d):
    return sampling.paired_delta(_scores(spark, d), "p_strong", "p_svm", "grp")


@query(_W + f""", n AS (SELECT cid, p_strong, row_number() OVER (ORDER BY {_H.format('cid')}, cid) AS place, 0 AS y FROM s WHERE NOT strong), a AS (SELECT * FROM n UNION ALL SELECT cid, p_strong, 0, 1 FROM s WHERE strong)
, k AS (SELECT prevalence, cid, p_strong, y FROM a, unnest([0.25, 0.5]::DOUBLE[]) AS t(prevalence) WHERE place <= floor((SELECT count(*) FROM s WHERE strong) * (1 - prevalence) / prevalence))
, r AS (SELECT prevalence, y, row_number() OVER (PARTITION BY prevalence ORDER BY p_strong DESC, cid) AS rn, count(*) OVER (PARTITION BY prevalence) AS n FROM k)
SELECT prevalence, max(n) AS n, count(*) FILTER (rn <= ceil(n * 0.1::DOUBLE)) AS reviewed, count(*) FILTER (rn <= ceil(n * 0.1::DOUBLE) AND y = 1) AS tp, count(*) FILTER (rn <= ceil(n * 0.1::DOUBLE) AND y = 0) AS fp FROM r GROUP BY prevalence""")
def low_prevalence(spark, d):
    return sampling.prevalence_metrics(_scores(spark, d), "cid", "p_strong", "strong", [0.25, 0.5], 0.1)


@query(_CUM + ", e AS (SELECT budget, ceil(total * budget)::BIGINT AS reviewed, pos, sum(greatest(0, least(n, ceil(total * budget) - (called - n)))::DOUBLE / n * p) AS tp FROM c JOIN b USING (threshold), unnest([0.01, 0.05, 0.1, 0.2, 0.5]::DOUBLE[]) AS t(budget) GROUP BY ALL) SELECT budget, reviewed, round(tp, 6) AS tp, round(tp / pos, 6) AS recall FROM e")
def budget_curve(spark, d):
    return sampling.budget_curve(_scores(spark, d), "cid", "p_strong", "strong", [0.01, 0.05, 0.1, 0.2, 0.5])


_DERANGED = """g AS (SELECT conv_id, count(*) AS m, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first(conv_id) OVER (ORDER BY conv_id)) AS nxt FROM conversations GROUP BY conv_id)
, p AS (SELECT conv_id, conv_id * 1000 + turn AS uid, text, row_number() OVER (PARTITION BY conv_id ORDER BY conv_id * 1000 + turn) - 1 AS at FROM conversations)
, o AS (SELECT a.uid, b.uid AS partner, a.text, b.text AS other FROM p a JOIN g ON g.conv_id = a.conv_id AND g.nxt <> g.conv_id JOIN g h ON h.conv_id = g.nxt JOIN p b ON b.conv_id = g.nxt AND b.at = a.at % h.m)"""


@query(f"WITH {_DERANGED} SELECT uid, partner, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM (SELECT uid, partner, list_distinct({_PLAIN.format('text')}) AS x, list_distinct({_PLAIN.format('other')}) AS y FROM o)")
def shuffled_partner(spark, d):
    """Token overlap of every turn with a turn of another conversation: the baseline that real pairs must beat."""
    c = _t(spark, d, "conversations").withColumn("uid", F.col("conv_id") * 1000 + F.col("turn"))
    toks = c.select("uid", F.array_distinct(K.tokenize(F.col("text"), "plain")).alias("t"))
    pairs = sampling.derangement(c, "uid", "conv_id")
    both = pairs.join(toks, "uid").join(toks.select(F.col("uid").alias("partner"), F.col("t").alias("t2")), "partner")
    return both.select("uid", "partner", F.round(K.jaccard(F.col("t"), F.col("t2")), 6).alias("overlap"))


@query()
def capped_sample(spark, d):
    """An audit sample: buckets in order, with caps on buckets and groups; the greedy choice has no SQL form."""
    return sampling.greedy_caps(_scores(spark, d), "cid", "domain", "grp", {"F": 30, "O": 20, "P": 10}, 2, 50)


# -- text audits

_LAB = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, quality FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")


@query(f"WITH t AS (SELECT role, {_PLAIN.format('text')} AS a, {_PLAIN.format('prev')} AS b FROM (SELECT role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations)), r AS (SELECT role, len(a) AS n, len(list_intersect(list_distinct(a), list_distinct(b))) AS i, len(list_distinct(list_concat(a, b))) AS u FROM t), q AS (SELECT role, n, row_number() OVER (PARTITION BY role ORDER BY n) AS rn, count(*) OVER (PARTITION BY role) AS c FROM r) SELECT r.role, round(avg(CASE WHEN u = 0 THEN 0.0 ELSE i::DOUBLE / u END), 6) AS mean_overlap, round(avg(n), 6) AS mean_tokens, (SELECT min(n)::INTEGER FROM q WHERE q.role = r.role AND rn > c // 2) AS upper_median FROM r GROUP BY r.role")
def overlap_by_label(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").withColumn("prev", F.coalesce(F.lag("text").over(w), F.lit("")))
    return audit.overlap_by_label(c, "role", "text", "prev")


@query(f"""WITH t AS (SELECT lang, unnest(list_distinct({_PLAIN.format('text')})) AS term FROM documents), c AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL), z AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS a FROM documents GROUP BY lang)
, r AS (SELECT lang, term, round(c::DOUBLE / n, 6) AS rate, round((sum(c) OVER (PARTITION BY term) - c)::DOUBLE / nullif(a - n, 0), 6) AS other_rate, c FROM c JOIN z USING (lang))
SELECT lang, term, rate, other_rate FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(rate - coalesce(other_rate, 0), 6) DESC, term) AS rn FROM r WHERE c >= 5) WHERE rn <= 5""")
def label_cues(spark, d):
    return audit.label_cues(_t(spark, d, "documents"), "doc_id", "text", "lang")


@query(r"WITH c AS (SELECT array_to_string(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')[1:4], ' ') AS prefix, lang, count(*) AS c FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, lang) AS rn, sum(c) OVER (PARTITION BY prefix) AS n FROM c) SELECT prefix, n::BIGINT AS n, lang AS dominant, round(c::DOUBLE / n, 6) AS share FROM r WHERE rn = 1")
def prefix_distribution(spark, d):
    return audit.prefix_distribution(_t(spark, d, "documents"), "text", "lang")


@query(f"WITH {_LAB}, t AS (SELECT quality, unnest(list_distinct({_PLAIN.format('text')})) AS term FROM docs), c AS (SELECT term, count(*) AS df, sum(quality) AS p FROM t GROUP BY term HAVING count(*) >= 2) SELECT term, df, round(p::DOUBLE / df, 6) AS purity FROM c WHERE abs(p::DOUBLE / df - (SELECT avg(quality) FROM docs)) > 0.2")
def purity_lift(spark, d):
    return audit.purity_lift(_labelled(spark, d), "text", "quality")


@query(f"WITH a AS (SELECT conv_id, turn, list_distinct({_HYPHEN.format('text')}) AS t FROM conversations), p AS (SELECT x.conv_id, x.turn, CASE WHEN len(list_distinct(list_concat(x.t, y.t))) = 0 THEN 0.0 ELSE len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(list_concat(x.t, y.t))) END AS j FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.turn <> y.turn) SELECT conv_id, turn, round(avg(j), 6) AS sibling_mean, round(avg(j), 6) > 0.6 AS template_like FROM p GROUP BY conv_id, turn")
def template_risk(spark, d):
    return audit.template_risk(_t(spark, d, "conversations"), "conv_id", "turn", "text")


_CUES = ["always", "the", "of", "should be"]


@query(r"SELECT item_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '(?i)\b(?:should be|always|the|of)\b', '', 'g'), '\s+', ' ', 'g')), '\s+([,.])', '\1', 'g'), ',\s*,', ',', 'g'), '\s+and\s+\.', '.', 'g'), '\s+', ' ', 'g'))) AS masked, (contains(lower(text), 'always')::INTEGER + regexp_matches(lower(text), '\bthe\b')::INTEGER + regexp_matches(lower(text), '\bof\b')::INTEGER + contains(lower(text), 'should be')::INTEGER) AS n_cues FROM benchmark")
def masked_cues(spark, d):
    x = F.col("text")
    return _t(spark, d, "benchmark").select("item_id", F.md5(audit.mask_cues(x, _CUES)).alias("masked"), K.word_cues(x, _CUES).alias("n_cues"))


@query(f"WITH t AS (SELECT item_id, {_PLAIN.format('text')} AS t FROM benchmark), u AS (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1]))) AS term FROM t) SELECT item_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, md5(string_agg(term, ',' ORDER BY term)) AS terms FROM u GROUP BY item_id")
def ngram_terms(spark, d):
    t = K.tokenize(F.col("text"), "plain")
    terms = F.array_sort(F.concat(t, K.ngrams(t, 2)))
    return _t(spark, d, "benchmark").select("item_id", F.size(terms).cast("long").alias("n_terms"), F.size(F.array_distinct(terms)).cast("long").alias("n_distinct"), F.md5(F.array_join(terms, ",")).alias("terms")).filter("n_terms > 0")


@query(f"""WITH {_SENT} SELECT doc_id, min(sent_id) AS sent_id, md5(arg_min(sentence, sent_id)) AS anchor FROM sent WHERE len(list_filter(string_split_regex(sentence, '\\s+'), lambda w: w <> '')) >= 8 GROUP BY doc_id""")
def anchor_sentence(spark, d):
    """The first sentence of eight words or more of each document, as a query that should find the document again."""
    s = corpus.sentences(_t(spark, d, "documents")).filter(T.count_words(F.col("sentence")) >= 8)
    return s.groupBy("doc_id").agg(F.min("sent_id").cast("long").alias("sent_id"), F.md5(F.min_by("sentence", "sent_id")).alias("anchor"))


@query()
def alignment_class(spark, d):
    """How the best-ranked document's closest sentences sit against the claim, by containment, numbers and similarity."""
    top = _ranked(spark, d).filter("rank = 1").join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    pair = top.join(_t(spark, d, "benchmark").withColumnRenamed("text", "claim"), "item_id")
    return retrieval.alignment(retrieval.closest_window(pair, "item_id", "text", "claim"), "item_id", "found", "claim")


# -- lexical models


@query(f"""WITH t AS (SELECT item_id, {_PLAIN.format('text')} AS t FROM benchmark), u AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '__' || t[i + 1]))) AS term FROM t) GROUP BY ALL)
, v AS (SELECT term, count(*) AS df FROM u GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 200), w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS w FROM u JOIN v USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS w FROM w""")
def tfidf_vocabulary(spark, d):
    return models.top_vocabulary(_t(spark, d, "benchmark"), "item_id", "text", 200).select("item_id", "term", F.round("w", 6).alias("w"))


@query("SELECT lang, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, d):
    return models.class_weights(_t(spark, d, "documents"), "lang")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1")
def majority_class(spark, d):
    return models.majority(_t(spark, d, "documents"), "lang")


@query(f"WITH {_LAB}, tr AS (SELECT * FROM docs WHERE doc_id % 3 <> 0), m AS (SELECT median(length(text)) AS mid FROM tr), a AS (SELECT avg(((length(text) > mid)::INTEGER = quality)::INTEGER) AS acc FROM tr CROSS JOIN m) SELECT doc_id, CASE WHEN acc < 0.5 THEN 1 - (length(text) > mid)::INTEGER ELSE (length(text) > mid)::INTEGER END AS predicted FROM docs CROSS JOIN m CROSS JOIN a WHERE doc_id % 3 = 0")
def length_rule(spark, d):
    x = _labelled(spark, d)
    return models.length_rule(x.filter("doc_id % 3 <> 0"), x.filter("doc_id % 3 = 0"), "doc_id", "text", "quality")


@query(_W + """, m AS (SELECT avg(p_strong) AS a, stddev_pop(p_strong) AS sa, avg(entropy) AS b, stddev_pop(entropy) AS sb FROM s WHERE cid % 5 <> 0), z AS (SELECT cid, label, (p_strong - a) / sa AS x, (entropy - b) / sb AS y FROM s CROSS JOIN m)
, c AS (SELECT label AS predicted, avg(x) AS cx, avg(y) AS cy FROM z WHERE cid % 5 <> 0 GROUP BY label) SELECT cid, predicted FROM (SELECT cid, predicted, row_number() OVER (PARTITION BY cid ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 6), predicted) AS rn FROM z CROSS JOIN c WHERE cid % 5 = 0) WHERE rn = 1""")
def nearest_profile(spark, d):
    s = _scores(spark, d)
    return models.nearest_profile(s.filter("cid % 5 <> 0"), s.filter("cid % 5 = 0"), "cid", ["p_strong", "entropy"], "label")


# -- validation


@query("SELECT count(*) AS n_rows, round(avg((coalesce(trim(text) <> '', false) AND coalesce(trim(lang) <> '', false))::INTEGER), 6) AS complete, count(*) FILTER (quality = 1) AS n_true, count(*) FILTER (quality = 0) AS n_false FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return x.agg(F.count("*").alias("n_rows"), F.round(validation.completeness(x, ["text", "lang"]), 6).alias("complete"), validation.bool_count(F.col("quality"), True).alias("n_true"), validation.bool_count(F.col("quality"), False).alias("n_false"))


@query("SELECT cid, array_to_string(list_filter([CASE WHEN NOT p_strong < 0.9 THEN 'score' END, CASE WHEN NOT rank <= 4 THEN 'rank' END, CASE WHEN n_words < 3 THEN 'words' END], lambda e: e IS NOT NULL), ';') AS errors FROM (" + _W + " SELECT * FROM s) WHERE NOT (p_strong < 0.9 AND rank <= 4 AND n_words >= 3)")
def row_errors(spark, d):
    s = _scores(spark, d)
    e = validation.row_errors({"score": F.col("p_strong") < 0.9, "rank": F.col("rank") <= 4, "words": F.col("n_words") >= 3})
    return s.select("cid", F.array_join(e, ";").alias("errors")).filter("errors <> ''")


@query("SELECT 'text' AS \"column\", max(length(text))::INTEGER AS longest, count(*) FILTER (length(text) > 300) AS n_long FROM documents UNION ALL SELECT 'lang', max(length(lang))::INTEGER, count(*) FILTER (length(lang) > 300) FROM documents UNION ALL SELECT 'source', max(length(source))::INTEGER, count(*) FILTER (length(source) > 300) FROM documents")
def long_cells(spark, d):
    return validation.long_cells(_t(spark, d, "documents"))


@query(r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda s: trim(s) <> '') AS l, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS w, length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS a FROM x)
SELECT doc_id, length(t)::INTEGER AS n_chars, w::INTEGER AS n_words, len(l)::INTEGER AS n_lines, len(list_filter(l, lambda s: length(trim(s)) < 20))::INTEGER AS n_short, round(CASE WHEN t = '' THEN 0.0 ELSE a::DOUBLE / length(t) END, 6) AS alnum, t <> '' AND a::DOUBLE / nullif(length(t), 0) < 0.10 AND w < 10 AS scanned, regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS corrupted FROM l""")
def page_quality(spark, d):
    return validation.page_quality(_t(spark, d, "documents"), "doc_id", "text")
