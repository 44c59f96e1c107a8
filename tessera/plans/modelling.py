"""Registered queries on pairs, folds, disturbed labels and linear classifiers; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation, pairs
from tessera.plans.catalog import _PRED, _W, _predicted, _scores, _t, query


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.label = b.label AS same, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT round(avg(c) FILTER (same), 6) AS same, round(avg(c) FILTER (NOT same), 6) AS other FROM p""")
def label_cosines(spark, d):
    return pairs.label_cosines(_t(spark, d, "embeddings"), "embedding", "label")


@query(_W + ", p AS (SELECT a.grp, a.cid AS first, b.cid AS second, row_number() OVER (PARTITION BY a.grp ORDER BY a.cid, b.cid) AS rn FROM s a JOIN s b ON a.grp = b.grp AND a.label = 0 AND b.label = 3) SELECT grp, first, second FROM p WHERE rn = 1")
def case_pairs(spark, d):
    return pairs.case_pairs(_scores(spark, d), "grp", "cid", "label", 0, 3)


@query("""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lead(turn) OVER w IS NOT NULL)
, x AS (SELECT conv_id, turn, term, sum(n)::DOUBLE AS n, sum(m)::DOUBLE AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS term, 1 AS n, 0 AS m FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[a-z0-9]+')), 0, 1 FROM p) GROUP BY ALL)
, i AS (SELECT *, ln(3 / (1 + (n > 0)::INTEGER + (m > 0)::INTEGER)::DOUBLE) + 1 AS idf FROM x)
, c AS (SELECT conv_id, turn, sum(n * m * idf * idf) / sqrt(sum(n * n * idf * idf) * sum(m * m * idf * idf)) AS c, sum(n) AS sn, sum(m) AS sm FROM i GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN sn > 0 AND sm > 0 THEN round(c, 6) ELSE 0.0 END AS cosine FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn""")
def two_text_cosine(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"), F.lead("turn").over(w).alias("after")).filter("after IS NOT NULL")
    return pairs.two_text_cosine(rows, ["conv_id", "turn"], "text", "next")


_F1 = "round(coalesce(2.0 * count(*) FILTER (strong AND p_strong >= t) / nullif(count(*) FILTER (p_strong >= t) + count(*) FILTER (strong), 0), 0.0), 6)"


@query(_W + f""", g AS (SELECT i / 20.0::DOUBLE AS t FROM unnest(range(2, 19)) AS u(i)), f AS (SELECT DISTINCT domain AS fold FROM s)
, e AS (SELECT fold, t, (SELECT {_F1} FROM s WHERE domain <> fold) AS train_f1, (SELECT {_F1} FROM s WHERE domain = fold) AS test_f1 FROM f CROSS JOIN g)
SELECT fold AS domain, t AS threshold, train_f1, test_f1 FROM e QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_f1 DESC, t) = 1""")
def held_out_thresholds(spark, d):
    return evaluation.held_out_thresholds(_scores(spark, d), "domain", "p_strong", "strong", [i / 20 for i in range(2, 19)])


@query(_PRED + """, r AS (SELECT share, b, pred = 2 AS said, strong <> ((cid * 48271 + b * 69621 + (cid % 1009) * (b + 1)) % 1000 < share) AS truth FROM x, unnest([0, 50, 100, 200]) AS h(share), unnest(range(0, 40)) AS t(b))
, e AS (SELECT share, b, coalesce(2.0 * count(*) FILTER (said AND truth) / nullif(count(*) FILTER (said) + count(*) FILTER (truth), 0), 0.0) AS f FROM r GROUP BY share, b)
SELECT share::INTEGER AS share, round(avg(f), 6) AS f1, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM e GROUP BY share""")
def label_shift(spark, d):
    return evaluation.label_shift(_predicted(spark, d).withColumn("said", F.col("pred") == 2), "cid", "said", "strong", [0, 50, 100, 200], 40)


def _vectors(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("odd"))
    return e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0")


@query()
def linear_svm(spark, d):
    train, rows = _vectors(spark, d)
    return evaluation.linear_classifier(train, rows, "vec_id", "embedding", "odd").select("vec_id", "predicted")


@query()
def logistic_rule(spark, d):
    train, rows = _vectors(spark, d)
    return evaluation.linear_classifier(train, rows, "vec_id", "embedding", "odd", "logistic").select("vec_id", "predicted")
