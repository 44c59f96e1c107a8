"""Registered queries on protocols: selectors that learn or pair sentences, folds, held-out splits, rankers and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import metrics, protocols, selection
from tessera.operators import pairs as pair_ops
from tessera.plans.catalog import _PRED, _W, _predicted, _scores, _t, query
from tessera.plans.evidence import _CLEANED, _DICE, _MERGED, _PAIRS, _SEL, _TOP, _WORDS, _top, pairs

_CS = f"""cs0 AS (SELECT item_id, claim, rank, doc_id, unit, {_MERGED.format(_CLEANED.format('text'))} AS al FROM top), cs1 AS (SELECT item_id, claim, rank, doc_id, unit, i - 1 AS i, al[i] AS evidence FROM cs0, unnest(range(1, len(al) + 1)) AS t(i))
, cs AS (SELECT *, {_WORDS.format('evidence')}::INTEGER AS n_words, {_DICE.format(_SEL.format('claim'), _SEL.format('evidence'))} AS overlap FROM cs1 WHERE {_WORDS.format('evidence')} >= 3)"""


@query(f"""WITH {_TOP}, {_CS}, a AS (SELECT *, row_number() OVER o AS rn, first(unit) OVER o AS bu, first(doc_id) OVER o AS bd, first(i) OVER o AS bi FROM cs WINDOW o AS (PARTITION BY item_id ORDER BY overlap DESC, rank, i))
, b AS (SELECT *, CASE WHEN rn = 1 THEN 0 WHEN unit = bu AND doc_id = bd AND abs(i - bi) = 1 THEN 1 WHEN unit = bu AND doc_id = bd THEN 2 ELSE 3 END AS near FROM a)
, c AS (SELECT *, lead(evidence) OVER o AS pe, lead(i) OVER o AS pi, lead(near) OVER o AS pn FROM b WINDOW o AS (PARTITION BY item_id ORDER BY near, rn))
, d AS (SELECT item_id, doc_id, unit, rank, round(overlap, 6) AS score, CASE WHEN pe IS NULL THEN 'best_only_no_neighbor' ELSE 'best+neighbor_overlap' END AS reason, CASE WHEN pe IS NULL THEN evidence WHEN pn < 3 AND pi < i THEN pe || ' ' || evidence ELSE evidence || ' ' || pe END AS evidence FROM c WHERE rn = 1)
SELECT item_id, doc_id, unit, rank, score, {_WORDS.format('evidence')}::INTEGER AS n_words, reason, md5(evidence) AS evidence FROM d""")
def select_two_sentence_window_top5(spark, d):
    """The closest sentence of a claim's five best chunks and the one beside it."""
    return selection.two_sentences(_top(spark, d), "item_id").withColumn("evidence", F.md5("evidence"))


@query(f"""WITH {_TOP}, {_CS} SELECT item_id, doc_id, unit, rank, round(overlap, 6) AS score, n_words, n_words BETWEEN 10 AND 40 AS fits, md5(evidence) AS evidence FROM cs
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY (n_words BETWEEN 10 AND 40) DESC, overlap DESC, rank, i) = 1""")
def select_length_limited_top5(spark, d):
    """The closest sentence of 10 to 40 words of a claim's five best chunks, else the closest of any length."""
    return selection.length_limited(_top(spark, d), "item_id").withColumn("evidence", F.md5("evidence"))


def _weighted_sql(most: int, weight: float) -> str:
    return f"""WITH {_TOP}, {_CS}, w AS (SELECT cs.*, round(overlap + {weight}::DOUBLE * score, 6) AS score FROM cs JOIN top USING (item_id, rank) WHERE rank <= {most})
SELECT item_id, doc_id, unit, rank, score, n_words, md5(evidence) AS evidence FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, i) = 1"""


@query(_weighted_sql(5, 0.2))
def select_best_sentence_top5_bm25weighted(spark, d):
    """The best sentence of five chunks by overlap and a fifth of the chunk's BM25 score."""
    return selection.weighted_sentence(_top(spark, d), "item_id", 5, 0.2).withColumn("evidence", F.md5("evidence"))


@query(_weighted_sql(3, 0.0))
def select_best_sentence_top3_overlap(spark, d):
    return selection.weighted_sentence(_top(spark, d), "item_id", 3).withColumn("evidence", F.md5("evidence"))


_PSEUDO = f"""{_TOP}, {_CS}, u AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY item_id, evidence ORDER BY rank, i) = 1)
, aim AS (SELECT *, round({_DICE.format(_SEL.format('claim'), _SEL.format('evidence'))}, 6) AS aim FROM u), pl AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY aim DESC, rank, i) - 1 AS place FROM aim)
, ps AS (SELECT item_id, rank, i::INTEGER AS i, n_words, round(overlap, 6) AS overlap, place::INTEGER AS place, CASE WHEN place < greatest(1, floor(n * 0.30::DOUBLE)) THEN 1 WHEN place >= n - greatest(1, floor(n * 0.50::DOUBLE)) THEN 0 ELSE -1 END AS label, evidence FROM pl)"""


def _pseudo(spark, d):
    return selection.pseudo_labels(_top(spark, d).withColumn("oracle", F.col("claim")), "item_id")


@query(f"WITH {_PSEUDO} SELECT * EXCLUDE (evidence), md5(evidence) AS evidence FROM ps")
def selector_pseudo_labels(spark, d):
    """Sentences marked to train a selector; the claim's own passage stands for the known evidence."""
    return _pseudo(spark, d).withColumn("evidence", F.md5("evidence"))


_FEATURES = ("overlap", "n_words", "i", "rank")
_STAT = ", ".join(f"{f}({c}::DOUBLE) FILTER (label = {y}) AS {c}_{n}{y}" for c in _FEATURES for y in (0, 1) for n, f in (("m", "avg"), ("v", "var_pop")))
_FAR = lambda c, y: f"(pow({c} - {c}_m{y}, 2) / (2 * greatest({c}_v{y}, 1e-6)) + ln(greatest({c}_v{y}, 1e-6)) / 2)"


@query(f"""WITH {_PSEUDO}, st AS (SELECT {_STAT}, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM ps WHERE item_id % 5 < 4 AND label >= 0)
, sm AS (SELECT ps.*, round({' + '.join(f'{_FAR(c, 0)} - {_FAR(c, 1)}' for c in _FEATURES)} + ln(n1 / n0), 4) AS margin FROM ps CROSS JOIN st)
SELECT item_id, rank, i, margin, md5(evidence) AS evidence FROM sm QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY margin DESC, rank, i) = 1""")
def learned_selector(spark, d):
    """The sentence that normal densities over four features, fitted on the claims of four fifths of the groups, like best."""
    s = _pseudo(spark, d)
    scored = protocols.gaussian_margin(s.filter("item_id % 5 < 4 AND label >= 0"), s, list(_FEATURES), "label")
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("margin"), "rank", "i"))).filter("rn = 1")
    return best.select("item_id", "rank", "i", "margin", F.md5("evidence").alias("evidence"))


_JIT = lambda salt, low, high: f"({low}::DOUBLE + {high - low!r}::DOUBLE * (('0x' || substr(md5('{salt}' || cid::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE))"


@query(_W + f""", m AS (SELECT cid, least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.3::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, entropy) - CASE WHEN n_words < 8 OR n_words > 60 THEN 0.1::DOUBLE ELSE 0 END + {_JIT('strong', -0.1, 0.1)})) AS p FROM s), v AS (SELECT *, CASE WHEN p > 0.5 THEN p ELSE (1 - p) * 0.3::DOUBLE END AS share FROM m)
SELECT cid, round(p, 6) AS p_strong, round(least(0.8::DOUBLE, greatest(0.02::DOUBLE, 0.2::DOUBLE + {_JIT('contra', -0.1, 0.15)})), 6) AS p_contra, round(least(0.9::DOUBLE, greatest(0.05::DOUBLE, 0.3::DOUBLE + {_JIT('svm', -0.1, 0.1)})), 6) AS p_svm, (p > 0.5)::INTEGER AS flag, round(share, 6) AS vote_share, round(1 - abs(share - 0.5) * 2, 6) AS entropy FROM v""")
def mock_scores(spark, d):
    return _scores(spark, d).select("cid", *[c.alias(n) for n, c in selection.mock_scores(F.col("cid"), F.col("entropy"), F.col("n_words")).items()])


# -- rankers

_ROUTES = ("supported", "mild_scope", "strong_action", "contradiction")


@query(_PRED + f" SELECT cid, grp, (label = 2)::INTEGER AS is_strong, round(greatest(p_strong, p_contra, p_svm) - least(p_strong, p_contra, p_svm), 6) AS confidence, coalesce([{', '.join(repr(r) for r in _ROUTES)}][pred + 1], 'unknown') AS route FROM x")
def ranker_features(spark, d):
    """What a ranker is trained on: the truth, how far the three scores part, and the route of the prediction."""
    p = [F.col(c) for c in ("p_strong", "p_contra", "p_svm")]
    route = F.coalesce(F.get(F.array(*map(F.lit, _ROUTES)), F.col("pred").cast("int")), F.lit("unknown"))
    return _predicted(spark, d).select("cid", "grp", (F.col("label") == 2).cast("int").alias("is_strong"), F.round(F.greatest(*p) - F.least(*p), 6).alias("confidence"), route.alias("route"))


_RANKERS = ("p_strong", "p_svm", "entropy")


@query(_W + f""", h AS (SELECT * FROM s WHERE grp % 5 = 0), l AS ({' UNION ALL '.join(f"SELECT '{r}' AS ranker, {r} AS v, strong, cid FROM h" for r in _RANKERS)})
, e AS (SELECT ranker, v, count(*) AS n, count(*) FILTER (strong) AS p FROM l GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY ranker) AS tp, sum(n - p) OVER (PARTITION BY ranker) AS tn FROM e WINDOW w AS (PARTITION BY ranker ORDER BY v DESC))
, m AS (SELECT ranker, round(sum(cp::DOUBLE / cn * p / tp), 6) AS average_precision, round(sum(p * (tn - (cn - cp) + (n - p) / 2.0::DOUBLE)) / (any_value(tp) * any_value(tn)), 6) AS auc FROM c GROUP BY ranker)
, k AS (SELECT ranker, round(count(*) FILTER (strong) / 20.0::DOUBLE, 6) AS precision_20 FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY ranker ORDER BY v DESC, cid) <= 20) GROUP BY ranker)
SELECT * FROM m JOIN k USING (ranker)""")
def ranker_comparison(spark, d):
    """Average precision, area under the curve and precision at 20 of three rankers on the groups that none was fitted on."""
    h = _scores(spark, d).filter("grp % 5 = 0")
    out = None
    for r in _RANKERS:
        at20 = metrics.top_metrics(h, r, "cid", "strong", (20,)).select(F.col("precision").alias("precision_20"))
        row = metrics.average_precision(h, r, "strong").crossJoin(metrics.roc_auc(h, r, "strong")).crossJoin(at20).select(F.lit(r).alias("ranker"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


_METHODS = "SELECT o_orderpriority AS method, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE END AS e1, (o_orderkey * 104729 % 1000) / 1000.0::DOUBLE AS e2, o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 AS skipped FROM orders"


@query(f"WITH r AS ({_METHODS}), g AS (SELECT method, avg(e1) AS a, avg(e2) AS b FROM r GROUP BY method HAVING NOT bool_or(skipped)) SELECT coalesce((SELECT method FROM g WHERE a IS NOT NULL ORDER BY a DESC, method LIMIT 1), (SELECT method FROM g WHERE b IS NOT NULL ORDER BY b DESC, method LIMIT 1), 'none') AS method, round(coalesce((SELECT max(a) FROM g), (SELECT max(b) FROM g), 0), 6) AS score")
def best_method(spark, d):
    o = F.col("o_orderkey")
    r = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.when(o % 3 > 0, o * 7919 % 1000 / 1000).alias("e1"), (o * 104729 % 1000 / 1000).alias("e2"), ((F.col("o_orderpriority") == "5-LOW") & (o % 7 == 0)).alias("skipped"))
    return protocols.best_method(r, "method", "e1", "e2", "skipped")


_SHARES = [f"count(*) FILTER (pred = {k})::DOUBLE / count(*)" for k in range(4)]


@query(_PRED + f""" SELECT grp, arg_max(pred, (n, -pred))::INTEGER AS predicted, any_value(p_contra) AS p_contra, any_value(p_strong) AS p_strong, any_value(p_svm) AS p_svm, any_value(flag) AS flag, any_value(entropy) AS entropy, sum(n)::BIGINT AS n_seeds
FROM (SELECT grp, pred, count(*) AS n FROM x GROUP BY ALL) JOIN (SELECT grp, round(avg(p_contra), 6) AS p_contra, round(avg(p_strong), 6) AS p_strong, round(avg(p_svm), 6) AS p_svm, (avg(flag) > 0.5)::INTEGER AS flag, round(({' + '.join(f'-({p}) * ln({p} + 1e-10)' for p in _SHARES)}) / 4, 6) AS entropy FROM x GROUP BY grp) USING (grp) GROUP BY grp""")
def seed_votes(spark, d):
    """One prediction for each group, whose candidates stand for the seeds."""
    return protocols.seed_votes(_predicted(spark, d), "grp", "pred", ["p_contra", "p_strong", "p_svm"], "flag", [0, 1, 2, 3])


# -- folds and held-out splits


def _bayes_sql(source: str, labels: list[int], alpha: float = 0.7) -> str:
    """CTEs up to bp(fold, key, label, predicted) over nb(fold, key, label, text), for every fold by a plain fit on the rest."""
    names = ", ".join(map(str, labels))
    return f"""nb AS ({source}), tk AS (SELECT fold, key, label, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM nb), fo AS (SELECT DISTINCT fold AS f FROM nb)
, tc AS (SELECT f, term, label, count(*) AS c FROM fo JOIN tk ON tk.fold <> f GROUP BY ALL), vo AS (SELECT f, count(DISTINCT term) AS v FROM tc GROUP BY f), ma AS (SELECT f, label, sum(c) AS m FROM tc GROUP BY ALL)
, pr0 AS (SELECT f, label, count(*) AS d FROM fo JOIN nb ON nb.fold <> f GROUP BY ALL), pri AS (SELECT f, label, ln(d::DOUBLE / sum(d) OVER (PARTITION BY f)) AS lp FROM pr0 WHERE label IN ({names}))
, rt AS (SELECT fold, key, term, count(*) AS tf FROM tk GROUP BY ALL), rv AS (SELECT rt.* FROM rt JOIN (SELECT DISTINCT f, term FROM tc) x ON x.f = rt.fold AND x.term = rt.term)
, sc AS (SELECT fold, key, pri.label, sum(tf * ln((coalesce(c, 0) + {alpha}::DOUBLE) / (coalesce(m, 0) + {alpha}::DOUBLE * v))) AS z FROM rv JOIN pri ON pri.f = fold JOIN vo ON vo.f = fold LEFT JOIN ma ON ma.f = fold AND ma.label = pri.label LEFT JOIN tc ON tc.f = fold AND tc.term = rv.term AND tc.label = pri.label GROUP BY ALL)
, bp AS (SELECT nb.fold, nb.key, nb.label, arg_max(pri.label, (round(lp + coalesce(z, 0), 4), -pri.label)) AS predicted FROM nb LEFT JOIN pri ON pri.f = nb.fold LEFT JOIN sc ON sc.fold = nb.fold AND sc.key = nb.key AND sc.label = pri.label GROUP BY ALL)"""


def _f1_sql(labels: list[int], positive: int) -> str:
    one = lambda k: f"2.0::DOUBLE * count(*) FILTER (label = {k} AND predicted = {k}) / nullif(count(*) FILTER (label = {k}) + count(*) FILTER (predicted = {k}), 0)"
    return f"ff AS (SELECT fold, count(*) AS n, round(coalesce(list_avg([{', '.join(one(k) for k in labels)}]), 0), 6) AS macro_f1, round(coalesce({one(positive)}, 0), 6) AS f1 FROM bp GROUP BY fold)"


_SUM_SQL = """SELECT count(*) AS n_folds, round(avg(f1), 4) AS f1_mean, round(stddev_pop(f1), 4) AS f1_std, round(greatest(0, avg(f1) - 1.96 * stddev_pop(f1) / sqrt(count(*))), 4) AS f1_low, round(least(1, avg(f1) + 1.96 * stddev_pop(f1) / sqrt(count(*))), 4) AS f1_high, round(avg(macro_f1), 4) AS macro_f1_mean, round(stddev_pop(macro_f1), 4) AS macro_f1_std,
  CASE WHEN avg(f1) >= 0.4503 THEN 'fail' WHEN avg(f1) >= 0.8 * 0.4503 THEN 'warning' ELSE 'pass' END AS status FROM ff"""
_FOLDED = _PAIRS + ", " + _bayes_sql("SELECT grp % 5 AS fold, uid AS key, label, {0} AS text FROM pr", [0, 1, 2, 3]) + ", " + _f1_sql([0, 1, 2, 3], 2)


def _folded(spark, d, text):
    x = pairs(spark, d).select((F.col("grp") % 5).alias("fold"), "uid", "label", text.alias("text"))
    return protocols.fold_f1(protocols.fold_bayes(x, "uid", "fold", "text", "label", [0, 1, 2, 3]), [0, 1, 2, 3], 2)


@query(f"WITH {_FOLDED.format('claim')} {_SUM_SQL}")
def claim_only_folds(spark, d):
    """How well claims alone, without evidence, tell their labels over five folds of whole groups."""
    return protocols.fold_summary(_folded(spark, d, F.col("claim")), 0.4503)


@query("WITH " + _FOLDED.format("claim || ' ' || evidence") + " SELECT * FROM ff")
def claim_evidence_folds(spark, d):
    """F1 of each fold from claims with their evidence."""
    return _folded(spark, d, F.concat_ws(" ", "claim", "evidence"))


@query("WITH " + _bayes_sql("SELECT lang AS fold, doc_id AS key, quality AS label, coalesce(text, '') AS text FROM documents JOIN labels USING (doc_id)", [0, 1]) + ", " + _f1_sql([0, 1], 1) + " SELECT * FROM ff")
def domain_holdout(spark, d):
    """F1 on the documents of each language by a model that saw none of them; the language is the domain."""
    x = _t(spark, d, "documents").select("doc_id", "lang", "text").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return protocols.fold_f1(protocols.fold_bayes(x, "doc_id", "lang", "text", "quality", [0, 1]), [0, 1], 1)


@query("""WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 10 < 3 THEN 'dev' ELSE 'train' END AS split, o_orderkey * 7919 % 1000 // 250 AS pred FROM orders)
, g0 AS (SELECT o_custkey, split, pred, count(*) AS n FROM v WHERE split <> 'train' GROUP BY ALL), g AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey, split) AS n_votes FROM g0), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY split = 'dev', n DESC, pred) = 1)
SELECT c_custkey, coalesce(pred, -1)::BIGINT AS predicted, coalesce(n_votes, 0)::BIGINT AS n_votes, coalesce(split, 'train_only') AS used FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def fold_votes(spark, d):
    o = F.col("o_orderkey")
    split = F.when(o % 10 == 0, "test").when(o % 10 < 3, "dev").otherwise("train")
    v = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), split.alias("split"), F.floor(o * 7919 % 1000 / 250).cast("long").alias("pred"))
    return protocols.fold_votes(_t(spark, d, "customer"), v, "c_custkey", "split", "pred")


_HOLD = """{0}0 AS (SELECT DISTINCT {1} AS v FROM customer WHERE {1} IS NOT NULL), {0}1 AS (SELECT v FROM {0}0 ORDER BY md5('0:' || v), v LIMIT {2})
, {0}2 AS (SELECT {1} AS v, c_acctbal > 0 AS y, CASE WHEN {1} IN (SELECT v FROM {0}1) THEN 'test' WHEN ('0x' || substr(md5('0:' || c_custkey), 1, 4))::BIGINT % 5 = 0 THEN 'dev' ELSE 'train' END AS side FROM customer)
, {0}3 AS (SELECT '{3}' AS variant, side, count(*) AS n, count(*) FILTER (y) AS n_positive, count(*) FILTER (side <> 'test' AND v IN (SELECT v FROM {0}2 WHERE side = 'test')) AS n_leaked FROM {0}2 GROUP BY side)"""


@query(f"WITH {_HOLD.format('t', 'c_nationkey', 5, 'template_heldout')}, {_HOLD.format('m', 'c_mktsegment', 1, 'domain_heldout')} SELECT * FROM t3 UNION ALL SELECT * FROM m3")
def held_out_splits(spark, d):
    """Splits that hold out whole templates (nations) or domains (segments), with the rows that leak across, which is none."""
    c, y = _t(spark, d, "customer"), F.coalesce(F.col("c_acctbal") > 0, F.lit(False))
    one = lambda by, most, name: protocols.held_out(c, "c_custkey", by, most, y).select(F.lit(name).alias("variant"), "*")
    return one("c_nationkey", 5, "template_heldout").unionByName(one("c_mktsegment", 1, "domain_heldout")).withColumn("n_positive", F.col("n_positive").cast("long"))


# -- baselines

_LONG = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + ",".join(f"'{w}'" for w in K.STOP_WORDS["selection"]) + "))"


@query(rf"""WITH {_PAIRS}, t AS (SELECT uid, unnest({_LONG.format('claim')}) AS term, 1 AS p, 0 AS q FROM pr UNION ALL SELECT uid, unnest({_LONG.format('evidence')}), 0, 1 FROM pr), g AS (SELECT uid, term, sum(p) AS p, sum(q) AS q FROM t GROUP BY ALL)
, w AS (SELECT term, ln((1 + (SELECT 2 * count(*) FROM pr)) / (1 + sum((p > 0)::INTEGER + (q > 0)::INTEGER))) + 1 AS idf FROM g GROUP BY term), c AS (SELECT uid, sum(p * q * idf * idf) / nullif(sqrt(sum(p * p * idf * idf)) * sqrt(sum(q * q * idf * idf)), 0) AS cosine FROM g JOIN w USING (term) GROUP BY uid)
SELECT uid, round(coalesce(cosine, 0), 6) AS cosine FROM pr LEFT JOIN c USING (uid)""")
def claim_evidence_cosine(spark, d):
    """How alike claims and their evidence are by tf-idf over all claims and evidence."""
    return pair_ops.corpus_cosine(pairs(spark, d), "uid", "claim", "evidence", K.STOP_WORDS["selection"])


_PLAIN = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_BASE = "SELECT '{0}' AS baseline, count(*) AS n, round(avg(j), 6) AS mean_overlap, round(max(j), 6) AS max_overlap FROM (SELECT len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS j FROM {1} WHERE len(x) > 0 AND len(y) > 0)"
_TITLE, _BODY = "<title>([^<]*)</title>", "<[^>]*>"


@query(f"""WITH {_PAIRS}, a AS (SELECT {_PLAIN.format('claim')} AS x, {_PLAIN.format('evidence')} AS y FROM pr), b AS (SELECT x, {_PLAIN.format("''")} AS y FROM a), t AS (SELECT {_PLAIN.format(f"regexp_extract(html, '{_TITLE}', 1)")} AS x, {_PLAIN.format(f"regexp_replace(html, '{_BODY}', ' ', 'g')")} AS y FROM pages)
, r AS ({_BASE.format('evidence', 'a')} UNION ALL {_BASE.format('empty', 'b')} UNION ALL {_BASE.format('title', 't')})
SELECT *, CASE WHEN n = 0 THEN 'skip' WHEN baseline = 'evidence' THEN CASE WHEN mean_overlap > 0.05 THEN 'pass' ELSE 'warning' END WHEN mean_overlap >= 0.5 THEN 'fail' WHEN mean_overlap >= 0.3 THEN 'warning' ELSE 'pass' END AS status FROM r""")
def baseline_checks(spark, d):
    """Overlap of claims with their evidence and with none, and of page titles with their pages: titles must not give all away."""
    p = pairs(spark, d)
    pages = _t(spark, d, "pages").select(F.regexp_extract("html", _TITLE, 1).alias("claim"), F.regexp_replace("html", _BODY, " ").alias("evidence"))
    parts = {"evidence": p, "empty": p.withColumn("evidence", F.lit("")), "title": pages}
    out = None
    for name, x in parts.items():
        row = protocols.baseline_overlap(x, "claim", "evidence").select(F.lit(name).alias("baseline"), "*")
        out = row if out is None else out.unionByName(row)
    m = F.col("mean_overlap")
    status = F.when(F.col("n") == 0, "skip").when(F.col("baseline") == "evidence", F.when(m > 0.05, "pass").otherwise("warning")).when(m >= 0.5, "fail").when(m >= 0.3, "warning").otherwise("pass")
    return out.withColumn("status", status)


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON length(b.text) >= 30 AND contains(d.text, b.text)")
def text_containment(spark, d):
    """Claims of thirty characters or more that stand whole in a document, wherever in it."""
    return protocols.containing(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "benchmark"), "item_id", "text")
