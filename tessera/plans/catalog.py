"""Registered queries of the engine, by name, with the SQL that checks them.

The driver's tables stand in for the domain's: documents for pages of papers, benchmark for claims, orders for scored
candidates (their scores are whole-number arithmetic on the key, the same in any engine), conversations for ordered
units, labels for judgements, embeddings for dense features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import audit, corpus, metrics, models, relational, retrieval, scoring
from tessera.sources import tables

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, d, name)


# Candidates with scores, the same expressions for both engines.
_SCORES = """
SELECT o_orderkey AS cid, o_custkey % 200 AS grp, o_orderstatus AS domain,
  CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS p_strong, CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 1000 AS p_contra,
  CAST((o_orderkey * 15485863) % 1000 AS DOUBLE) / 1000 AS p_svm, CAST((o_orderkey * 1299709) % 1000 AS DOUBLE) / 1000 AS entropy,
  CASE WHEN (o_orderkey * 7919) % 1000 >= 550 THEN 1 ELSE 0 END AS flag, CAST(o_totalprice AS DOUBLE) AS selector,
  CAST((o_orderkey * 611953) % 5000 AS DOUBLE) / 100 AS bm25, 1 + o_orderkey % 5 AS rank, o_orderkey % 80 AS n_words,
  (o_orderkey * 31 + o_custkey) % 4 AS label, (o_orderkey * 31 + o_custkey) % 4 = 2 AS strong
FROM orders"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "orders").createOrReplaceTempView("tessera_orders")
    return spark.sql(_SCORES.replace("FROM orders", "FROM tessera_orders"))


_W = f"WITH s AS ({_SCORES})"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"
_ABBR = T.ABBREVIATIONS.replace(".", r"\.")


def _cut(x: str) -> str:
    """SQL for the pieces that sentences are trimmed from."""
    kept = rf"regexp_replace(regexp_replace({x}, '({_ABBR})\.', '\1' || chr(2), 'g'), '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g')"
    return rf"""string_split(regexp_replace({kept}, '([.!?])\s+([A-Z"(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


_SENT = f"""sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_id, s AS sentence FROM (
  SELECT doc_id, i, trim(replace(p[i], chr(2), '.')) AS s FROM (SELECT doc_id, {_cut('text')} AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i)) WHERE s <> '')"""

_W_ = r"[\p{L}\p{N}_]"
_NFC = "replace(translate(nfc_normalize(coalesce(text, '')), '\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u2009\u200a\u202f\u200b', '''''\"\"--    '), '\u2026', '...')"
_JOINED = rf"regexp_replace(regexp_replace({_NFC}, '({_W_})-\n({_W_})', '\1\2', 'g'), '({_W_})-\n\s+({_W_})', '\1\2', 'g')"
_CLEAN = rf"array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({_JOINED}, '\r\n?', chr(10), 'g'), '\n\s*\n'), lambda p: regexp_replace(regexp_replace(replace(p, chr(10), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))"
#: Clean pages, a source being a paper and its documents the pages.
_PAGES = rf"""raw AS (SELECT source, doc_id, {_CLEAN} AS text FROM documents), lines AS (SELECT source, doc_id, list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda s: trim(s)) AS l FROM raw)
, cnt AS (SELECT source, count(*) AS n_pages FROM raw GROUP BY source)
, edge AS (SELECT source, line FROM (SELECT source, unnest(list_distinct(list_filter(list_concat(l[1:3], l[greatest(1, len(l) - 2):]), lambda s: s <> '' AND length(s) < 120))) AS line FROM lines) JOIN cnt USING (source) GROUP BY source, line, n_pages HAVING n_pages >= 3 AND count(*) >= greatest(3, n_pages // 2))
, edges AS (SELECT source, n_pages, coalesce((SELECT list(line ORDER BY line) FROM edge WHERE edge.source = cnt.source), []) AS edges FROM cnt)
, page AS (SELECT source, doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_full_match(trim(s), '[0-9]+') AND NOT list_contains(edges, trim(s))), chr(10)) AS text FROM raw JOIN edges USING (source))"""


# -- text and tokens


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS n_tokens, len(list_distinct({_TOKENS.format('text')}))::INTEGER AS n_distinct FROM documents")
def tokenize_stats(spark, d):
    toks = K.tokenize(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_distinct"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::INTEGER AS n_words, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::INTEGER AS n_clean FROM documents")
def text_profile(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.sha256_text(F.col("text")).alias("sha"), T.count_words(F.col("text")).alias("n_words"), F.length(T.normalize_space(F.col("text"))).alias("n_clean"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS plain, md5({_JOINED}) AS joined, md5({_CLEAN}) AS clean FROM documents")
def normalize_and_dehyphenate(spark, d):
    x = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalize_plain(x)).alias("plain"), F.md5(T.dehyphenate(T.normalize_unicode(x))).alias("joined"), F.md5(T.clean_page(x)).alias("clean"))


@query(f"WITH {_SENT} SELECT doc_id, sent_id, md5(sentence) AS sentence FROM sent")
def sentence_split(spark, d):
    return corpus.sentences(_t(spark, d, "documents")).select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.md5("sentence").alias("sentence"))


@query(f"WITH {_SENT}, w AS (SELECT doc_id, sent_id AS start, list(sentence) OVER f AS parts, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS total FROM sent WINDOW f AS (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT doc_id, start, len(parts)::INTEGER AS n, md5(array_to_string(parts, ' ')) AS win FROM w WHERE rn <= greatest(1, total - 2)")
def window_forward(spark, d):
    return corpus.document_windows(_t(spark, d, "documents")).select("doc_id", F.col("start").cast("long").alias("start"), "n", F.md5("window").alias("win"))


@query("SELECT conv_id, turn, md5(concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w)) AS win FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def window_centered(spark, d):
    return corpus.centred_windows(_t(spark, d, "conversations")).select("conv_id", "turn", F.md5("window").alias("win"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents), c AS (SELECT doc_id, (s - 1) // 150 AS chunk, w[s : s + 199] AS p FROM w, unnest(range(1, len(w) + 1, 150)) AS t(s)) SELECT doc_id, chunk::INTEGER AS chunk, len(p)::INTEGER AS n_words, md5(array_to_string(p, ' ')) AS body FROM c WHERE len(p) >= 10")
def chunk_stride(spark, d):
    return corpus.chunks(_t(spark, d, "documents")).select("doc_id", "chunk", "n_words", F.md5("chunk_text").alias("body"))


@query("SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark, d):
    return corpus.repeated_lines(_t(spark, d, "documents"))


@query(rf"WITH {_PAGES} SELECT doc_id, md5(text) AS body, length(text)::INTEGER AS n_chars, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''))::INTEGER AS n_words FROM page")
def header_footer_filter(spark, d):
    """Pages after cleaning, without page numbers and without headers and footers that half of the paper's pages share."""
    x = corpus.clean_pages(_t(spark, d, "documents"))
    return x.select("doc_id", F.md5("text").alias("body"), F.length("text").alias("n_chars"), T.count_words(F.col("text")).alias("n_words"))


_SECTION = "CASE WHEN block = '' THEN 'unknown' " + " ".join("WHEN regexp_matches(substr(lower(block), 1, 300), '" + p.replace("'", "''") + f"') THEN '{h}'" for p, h in T.SECTIONS) + " ELSE 'unknown' END"
_BLOCKS = rf"""{_PAGES}, b0 AS (SELECT doc_id, i - 1 AS block_id, regexp_replace(regexp_replace(p[i], '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g') AS block FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS p FROM page), unnest(range(1, len(p) + 1)) AS t(i))
, b1 AS (SELECT *, {_SECTION} AS own, len(list_filter(string_split_regex(block, '\s+'), lambda t: t <> '')) AS n_words FROM b0 WHERE block <> '')
, b2 AS (SELECT *, last_value(CASE WHEN n_words < 10 AND own <> 'unknown' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM b1)
, blk AS (SELECT doc_id, block_id, block, n_words, CASE WHEN own <> 'unknown' THEN own ELSE coalesce(carried, 'unknown') END AS section FROM b2)"""


@query(f"WITH {_BLOCKS} SELECT doc_id, block_id::INTEGER AS block_id, n_words::INTEGER AS n_words, section, md5(block) AS body FROM blk")
def section_carry(spark, d):
    """Blocks of clean pages with the section that they are in."""
    return corpus.blocks(corpus.clean_pages(_t(spark, d, "documents"))).select("doc_id", "block_id", "n_words", "section", F.md5("block").alias("body"))


@query(rf"""WITH {_BLOCKS}, s0 AS (SELECT doc_id, block_id, section, i, trim(replace(p[i], chr(2), '.')) AS s FROM (SELECT doc_id, block_id, section, {_cut('block')} AS p FROM blk), unnest(range(1, len(p) + 1)) AS t(i))
, s1 AS (SELECT *, len(list_filter(string_split_regex(s, '\s+'), lambda t: t <> '')) AS n_words FROM s0 WHERE s <> '')
SELECT doc_id, block_id::INTEGER AS block_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_id, i) - 1)::INTEGER AS sentence_id, n_words::INTEGER AS n_words, section, md5(s) AS body FROM s1 WHERE n_words >= 5""")
def retrieval_units(spark, d):
    """The corpus that sentences are retrieved from: sentences of five words or more with page, block and section."""
    x = corpus.retrieval_units(corpus.blocks(corpus.clean_pages(_t(spark, d, "documents"))))
    return x.select("doc_id", "block_id", "sentence_id", "n_words", "section", F.md5("sentence").alias("body"))


@query(f"WITH a AS (SELECT conv_id, turn, list_distinct({_TOKENS.format('text')}) AS t FROM conversations), p AS (SELECT x.conv_id, len(list_intersect(x.t, y.t)) AS i, len(list_distinct(list_concat(x.t, y.t))) AS u FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.turn < y.turn) SELECT conv_id, count(*) AS n_pairs, round(avg(CASE WHEN u = 0 THEN 0.0 ELSE i::DOUBLE / u END), 6) AS mean_jaccard FROM p GROUP BY conv_id")
def token_jaccard_pairs(spark, d):
    return relational.group_similarity(_t(spark, d, "conversations"), "conv_id", "turn", "text")


# -- retrieval

_STOP = "('" + "','".join(K.STOP_WORDS["retrieval"]) + "')"
_KEPT = f"list_filter({_TOKENS}, lambda w: w NOT IN {_STOP})"

_BM25 = f"""WITH u AS (SELECT doc_id, {_KEPT.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM u)
, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_KEPT.format('text')}) AS term FROM benchmark) GROUP BY ALL)
, p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM u) WHERE term IN (SELECT term FROM q) GROUP BY ALL)
, f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
, s AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _ranked(spark, d):
    docs, claims = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    return retrieval.bm25(docs, ["doc_id"], "text", claims, "item_id", "text", stop=K.STOP_WORDS["retrieval"])


@query(_BM25 + " SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def bm25_retrieval(spark, d):
    return _ranked(spark, d)


_BM25_S = rf"""{_SENT}, us AS (SELECT doc_id, sent_id, {_KEPT.format('sentence')} AS t FROM sent WHERE len(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) >= 5), ss AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM us)
, qs AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_KEPT.format('text')}) AS term FROM benchmark))
, ps AS (SELECT doc_id, sent_id, dl, term, count(*) AS tf FROM (SELECT doc_id, sent_id, len(t) AS dl, unnest(t) AS term FROM us) WHERE term IN (SELECT term FROM qs) GROUP BY ALL)
, fs AS (SELECT term, count(*) AS df FROM ps GROUP BY term)
, cs AS (SELECT item_id, doc_id, sent_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM ps JOIN fs USING (term) JOIN qs USING (term) CROSS JOIN ss GROUP BY ALL)
, rs AS (SELECT item_id, doc_id, sent_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, sent_id) AS rank FROM cs)"""


def _sentences(spark, d):
    return corpus.sentences(_t(spark, d, "documents")).withColumn("sent_id", F.col("sent_id").cast("long"))


def _ranked_sentences(spark, d):
    units = _sentences(spark, d).filter(T.count_words(F.col("sentence")) >= 5)
    return retrieval.bm25(units, ["doc_id", "sent_id"], "sentence", _t(spark, d, "benchmark"), "item_id", "text", dedup_query=True, stop=K.STOP_WORDS["retrieval"])


@query(f"WITH {_BM25_S} SELECT item_id, doc_id, sent_id, score, rank::INTEGER AS rank FROM rs WHERE rank <= 10")
def bm25_sentences(spark, d):
    return _ranked_sentences(spark, d)


@query(_BM25 + """, f10 AS (SELECT item_id, doc_id, score FROM r WHERE rank <= 10), fill AS (SELECT item_id, doc_id, 0.0::DOUBLE AS score FROM (SELECT item_id, doc_id FROM (SELECT item_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents)) ANTI JOIN f10 USING (item_id, doc_id))
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM f10 UNION ALL SELECT * FROM fill)) WHERE rank <= 10""")
def bm25_padded(spark, d):
    """Ten documents for every claim: where fewer hold a term of it, the first others at score 0."""
    return retrieval.pad(_ranked(spark, d), _t(spark, d, "benchmark"), "item_id", _t(spark, d, "documents"), "doc_id", 10)


@query(_BM25 + """, hit AS (SELECT item_id, min(rank) AS first FROM r JOIN benchmark USING (item_id) JOIN documents USING (doc_id) WHERE rank <= 10 AND contains(documents.text, benchmark.text) GROUP BY item_id)
SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM benchmark LEFT JOIN hit USING (item_id)""")
def recall_mrr(spark, d):
    ranked, docs, claims = _ranked(spark, d), _t(spark, d, "documents"), _t(spark, d, "benchmark")
    # at most ten documents a claim are read for whether they hold it
    hits = ranked.join(claims.withColumnRenamed("text", "claim"), "item_id").join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("claim"))).select("item_id", "doc_id")
    return retrieval.recall_mrr(ranked, hits, claims, "item_id", ["doc_id"])


@query(f"""{_BM25}, {_SENT}, c AS (SELECT item_id, doc_id, list_distinct({_TOKENS.format('text')}) AS a FROM r JOIN benchmark USING (item_id) WHERE rank <= 5)
, e AS (SELECT item_id, doc_id, sent_id, a, list_distinct({_TOKENS.format('sentence')}) AS z, len(list_filter(string_split_regex(sentence, '\\s+'), lambda t: t <> '')) AS n FROM c JOIN sent USING (doc_id))
, g AS (SELECT *, round(coalesce(2.0 * len(list_intersect(a, z)) / nullif(len(a) + len(z), 0), 0.0) * CASE WHEN n < 8 THEN 0.5 WHEN n > 60 THEN 0.7 ELSE 1.0 END, 6) AS score FROM e)
SELECT item_id, doc_id, sent_id::INTEGER AS sent_id, score FROM g QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, sent_id) = 1""")
def dice_best_sentence(spark, d):
    top = _ranked(spark, d).filter("rank <= 5").join(_t(spark, d, "benchmark").withColumnRenamed("text", "claim"), "item_id").select("item_id", "doc_id", "claim")
    return retrieval.best_sentence(top, corpus.sentences(_t(spark, d, "documents")), "doc_id", "item_id")


_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS w FROM documents), c AS (SELECT doc_id, ((s - 1) // 150)::INTEGER AS chunk, {_NORMAL.format("array_to_string(w[s : s + 199], ' ')")} AS hay FROM w, unnest(range(1, len(w) + 1, 150)) AS t(s) WHERE len(w[s : s + 199]) >= 10)
SELECT DISTINCT doc_id, chunk, item_id FROM c JOIN (SELECT item_id, {_NORMAL.format('text')} AS needle FROM benchmark) q ON length(needle) >= 30 AND contains(hay, needle)""")
def claim_chunks(spark, d):
    return corpus.chunk_hits(corpus.chunks(_t(spark, d, "documents")), _t(spark, d, "benchmark"))


# -- scores and queues

_EVID = _W + """, m AS (SELECT min(selector) AS a, max(selector) AS b, min(bm25) AS c, max(bm25) AS e, min(rank) AS f, max(rank) AS g FROM s)
, ev AS (SELECT s.*, 0.40 * ((selector - a) / (b - a)) + 0.25 * ((bm25 - c) / (e - c)) - 0.15 * ((rank - f)::DOUBLE / (g - f)) - 0.20 * (CASE WHEN n_words BETWEEN 10 AND 45 THEN 0.0 WHEN n_words BETWEEN 6 AND 70 THEN 0.15 ELSE 0.35 END) AS evidence FROM s CROSS JOIN m)"""


def _evidence(spark, d):
    s = scoring.scaled(_scores(spark, d), ["selector", "bm25", "rank"])
    return s.withColumn("evidence", scoring.evidence_score(F.col("selector_norm"), F.col("bm25_norm"), F.col("rank_norm"), scoring.length_penalty(F.col("n_words"))))


@query(_EVID + " SELECT cid, round(evidence, 6) AS evidence, round(1.2 * p_strong - 0.9 * p_contra - 0.35 * entropy + 0.4 * flag + 0.15 * evidence, 6) AS conservative, round(p_strong - 0.6 * p_contra - 0.25 * entropy + 0.25 * flag + 0.25 * evidence, 6) AS balanced, round(1.1 * p_strong - 0.35 * p_contra - 0.15 * entropy + 0.1 * evidence, 6) AS high_recall FROM ev")
def minmax_profiles(spark, d):
    c = [F.col(x) for x in ("p_strong", "p_contra", "entropy", "flag", "evidence")]
    return _evidence(spark, d).select("cid", F.round("evidence", 6).alias("evidence"), *[F.round(scoring.profile_score(p, *c), 6).alias(p) for p in ("conservative", "balanced", "high_recall")])


@query(_EVID + " SELECT CASE WHEN p_contra >= 0.55 THEN 'contradiction_or_conflict_review' WHEN p_strong >= 0.55 AND p_contra < 0.36 AND entropy < 0.85 AND evidence >= 0.35 THEN 'high_priority_strong_review' WHEN p_strong >= 0.55 AND evidence < 0.35 THEN 'evidence_check_needed' ELSE 'low_priority' END AS bucket, count(*) AS n FROM ev GROUP BY 1")
def bucket_counts(spark, d):
    b = scoring.bucket(*[F.col(x) for x in ("p_strong", "p_contra", "entropy", "evidence")])
    return _evidence(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(_W + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p_strong DESC, cid) AS rn FROM s) SELECT cid, grp, p_strong, row_number() OVER (ORDER BY p_strong DESC, cid)::INTEGER AS queue_rank FROM r WHERE rn <= 2 ORDER BY p_strong DESC, cid LIMIT 50")
def queue_group_cap(spark, d):
    return scoring.capped_queue(_scores(spark, d).select("cid", "grp", "p_strong"), "p_strong", "cid", "grp", 2, 50)


@query(_W + " SELECT cid, round(flag * 1000.0 + p_strong, 6) AS \"A\", p_strong AS \"B\", round(p_strong - p_contra, 6) AS \"C\", round(p_strong - p_contra - 0.2 * entropy, 6) AS \"D\", round(p_strong - p_contra + 0.1 * selector - 0.05 * rank, 4) AS \"E\", round(p_strong - p_contra - 0.2 * entropy + CASE WHEN n_words BETWEEN 10 AND 40 THEN 0.1 ELSE 0.0 END, 6) AS \"F\", round(CASE WHEN flag = 1 AND p_contra < 0.36 THEN p_strong - entropy ELSE -1000.0 + p_strong END, 6) AS \"G\", round(0.5 * p_strong - 0.3 * p_contra - 0.2 * entropy + 0.1 * selector - 0.05 * rank, 4) AS \"H\" FROM s")
def ranking_formulas(spark, d):
    f = scoring.ranking_scores()
    return _scores(spark, d).select("cid", *[(F.col("p_strong") if k == "B" else F.round(v, 4 if k in "EH" else 6)).alias(k) for k, v in f.items()])


@query(_W + " SELECT cid, (CASE WHEN p_contra >= 0.55 THEN 3 WHEN p_strong >= 0.5 AND p_contra < 0.36 THEN 2 WHEN p_svm >= 0.5 THEN 1 ELSE 0 END)::INTEGER AS route FROM s")
def cascade_route(spark, d):
    return _scores(spark, d).select("cid", scoring.cascade(F.col("p_contra"), F.col("p_strong"), F.col("p_svm"), 0.55, 0.36, 0.5, 0.5).alias("route"))


_VOTES = _W + ", v AS (SELECT grp, label, count(*) AS n FROM s GROUP BY grp, label), h AS (SELECT grp, label, n, n::DOUBLE / sum(n) OVER (PARTITION BY grp) AS p, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS rn FROM v)"


@query(_VOTES + " SELECT grp, min(CASE WHEN rn = 1 THEN label END) AS label, round(sum(-p * ln(p)) / 4, 6) AS entropy FROM h GROUP BY grp")
def majority_vote(spark, d):
    return scoring.vote(_scores(spark, d), "grp", "label")


# -- metrics

_PRED = _W + ", x AS (SELECT *, CASE WHEN p_contra >= 0.55 THEN 3 WHEN p_strong >= 0.5 AND p_contra < 0.36 THEN 2 WHEN p_svm >= 0.5 THEN 1 ELSE 0 END AS pred FROM s)"


def _predicted(spark, d):
    return _scores(spark, d).withColumn("pred", scoring.cascade(F.col("p_contra"), F.col("p_strong"), F.col("p_svm"), 0.55, 0.36, 0.5, 0.5).cast("long"))


@query(_PRED + ", t AS (SELECT label AS l, count(*) AS support, count(*) FILTER (pred = label) AS tp FROM x GROUP BY 1), p AS (SELECT pred AS l, count(*) AS predicted FROM x GROUP BY 1) SELECT l::BIGINT AS label, support, round(coalesce(tp::DOUBLE / predicted, 0.0), 6) AS precision, round(tp::DOUBLE / support, 6) AS recall, round(2.0 * tp / (support + coalesce(predicted, 0)), 6) AS f1 FROM t LEFT JOIN p USING (l)")
def macro_f1(spark, d):
    return metrics.per_label(_predicted(spark, d), "label", "pred")


@query(_PRED + " SELECT label, count(*) FILTER (pred = 0) AS \"0\", count(*) FILTER (pred = 1) AS \"1\", count(*) FILTER (pred = 2) AS \"2\", count(*) FILTER (pred = 3) AS \"3\" FROM x GROUP BY label")
def confusion_pivot(spark, d):
    return metrics.confusion(_predicted(spark, d), "label", "pred", [0, 1, 2, 3])


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(spark, d):
    return metrics.crosstab_margins(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(_W + ", r AS (SELECT strong, row_number() OVER (ORDER BY p_strong DESC, cid) AS rn FROM s) SELECT k, round(count(*) FILTER (strong) / k::DOUBLE, 6) AS precision, round(count(*) FILTER (strong)::DOUBLE / (SELECT count(*) FROM s WHERE strong), 6) AS recall, count(*) FILTER (strong) AS tp, count(*) FILTER (NOT strong) AS fp FROM r JOIN (SELECT unnest([10, 20, 50, 100])::INTEGER AS k) ON rn <= k GROUP BY k")
def precision_recall_at_k(spark, d):
    return metrics.top_metrics(_scores(spark, d), "p_strong", "cid", "strong")


_CELLS = _W + ", b AS (SELECT p_strong AS threshold, count(*) FILTER (strong) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n - p) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS pos FROM b)"


@query(_CELLS + " SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn FROM c")
def threshold_sweep(spark, d):
    return metrics.threshold_cells(_scores(spark, d), "p_strong", "strong").drop("p")


@query(_CELLS + ", e AS (SELECT tp::DOUBLE / (tp + fp) AS pr, (tp - coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0))::DOUBLE / pos AS dr FROM c) SELECT round(sum(pr * dr), 6) AS average_precision FROM e")
def average_precision(spark, d):
    return metrics.average_precision(_scores(spark, d), "p_strong", "strong")


@query(_CELLS + " SELECT round(max(tp::DOUBLE / pos) FILTER (tp::DOUBLE / (tp + fp) >= 0.25), 6) AS recall FROM c")
def recall_at_precision(spark, d):
    c = metrics.threshold_cells(_scores(spark, d), "p_strong", "strong")
    return c.agg(F.round(F.max(F.when(F.col("tp") / (F.col("tp") + F.col("fp")) >= 0.25, F.col("tp") / (F.col("tp") + F.col("fn")))), 6).alias("recall"))


@query(_W + ", r AS (SELECT strong, avg(rn) OVER (PARTITION BY p_strong) AS ar FROM (SELECT strong, p_strong, row_number() OVER (ORDER BY p_strong) AS rn FROM s)), n AS (SELECT count(*) FILTER (strong)::DOUBLE AS p, count(*) FILTER (NOT strong)::DOUBLE AS q, sum(ar) FILTER (strong) AS sr FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * q), 6) AS auc FROM n")
def roc_auc_ranksum(spark, d):
    return metrics.roc_auc(_scores(spark, d), "p_strong", "strong")


@query(_PRED + ", k AS (SELECT avg((label - pred) ** 2) AS o, avg(label * label) AS aa, avg(pred * pred) AS bb, avg(label) AS ma, avg(pred) AS mb, avg(abs(label - pred)) AS mae FROM x) SELECT round(1 - o / (aa + bb - 2 * ma * mb), 6) AS kappa, round(mae, 6) AS mae FROM k")
def qwk(spark, d):
    return metrics.weighted_kappa(_predicted(spark, d), "label", "pred", 4)


@query(_W + """, g AS (SELECT grp, count(*) FILTER (strong) AS p, count(*) AS n, row_number() OVER (ORDER BY grp) - 1 AS slot FROM s GROUP BY grp)
, dr AS (SELECT b, (slot * 48271 + b * 69621 + slot * b * 16807) % (SELECT count(*) FROM g) AS slot FROM g, unnest(range(0, 100)) AS t(b))
, e AS (SELECT b, sum(p)::DOUBLE / sum(n) AS rate FROM dr JOIN g USING (slot) GROUP BY b)
SELECT (SELECT round(sum(p)::DOUBLE / sum(n), 6) FROM g) AS rate, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM e""")
def bootstrap_ci(spark, d):
    return metrics.bootstrap_rate(_scores(spark, d), "grp", "strong")


# -- audits


@query(_W + " SELECT grp, count(DISTINCT domain) AS n_splits FROM s GROUP BY grp HAVING count(DISTINCT domain) > 1")
def group_split_integrity(spark, d):
    return audit.split_leaks(_scores(spark, d), "grp", "domain")


@query("SELECT sha256(coalesce(text, '')) AS text_hash, count(*) AS n_rows, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_group_duplicates(spark, d):
    return audit.shared_hashes(_t(spark, d, "documents"), "text", "source")


@query("""WITH x AS (SELECT doc_id, quality, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT term, sum(quality) AS n_pos, sum(1 - quality) AS n_neg FROM (SELECT quality, unnest(t) AS term FROM x) GROUP BY term HAVING count(*) >= 5), n AS (SELECT sum(quality) AS pos, sum(1 - quality) AS neg FROM x)
SELECT term, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(ln((n_pos + 1) / (pos + 2)::DOUBLE) - ln((n_neg + 1) / (neg + 2)::DOUBLE), 6) AS log_odds FROM c CROSS JOIN n""")
def token_log_odds(spark, d):
    return audit.token_log_odds(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), "text", "quality")


_CUES = ["licensed", "the ", "token", "!!"]


@query("SELECT lang, " + ", ".join(f"round(avg(contains(lower(text), '{c}')::INTEGER), 6) AS rate_{i}" for i, c in enumerate(_CUES)) + " FROM documents GROUP BY lang")
def cue_rates(spark, d):
    return audit.cue_rates(_t(spark, d, "documents"), "text", "lang", _CUES)


@query("WITH p AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), q AS (SELECT o_custkey, max(n) AS m, sum(n) AS t FROM p GROUP BY 1) SELECT round(avg(m::DOUBLE / t), 6) AS purity, count(*) AS n_units FROM q WHERE t > 1")
def page_purity(spark, d):
    return audit.purity(_t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH p AS (SELECT doc_id, lang, array_to_string(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')[1:4], ' ') AS prefix FROM documents), t AS (SELECT * FROM p WHERE doc_id % 2 = 0), b AS (SELECT prefix, lang, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, lang) AS rn FROM t GROUP BY prefix, lang)
SELECT doc_id, coalesce(b.lang, (SELECT lang FROM t GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS predicted FROM p LEFT JOIN b ON b.prefix = p.prefix AND rn = 1""")
def prefix_rule(spark, d):
    docs = _t(spark, d, "documents")
    return audit.prefix_rule(docs.filter("doc_id % 2 = 0"), docs, "text", "lang", "doc_id")


@query("SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, ''))::INTEGER AS text_length FROM conversations")
def redaction_hash(spark, d):
    return audit.redacted(_t(spark, d, "conversations"), ["text"])


@query("SELECT doc_id, n::INTEGER AS n_long FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 300)) AS n FROM documents) WHERE n > 0")
def long_text_scan(spark, d):
    return audit.long_lines(_t(spark, d, "documents"), "doc_id", "text")


@query("SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS n_pages FROM pages GROUP BY 1")
def identifier_scan(spark, d):
    return audit.url_hosts(_t(spark, d, "pages"))


# -- joins and sets


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, d.doc_id % 2)::BIGINT AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 'primary' ELSE 'fallback' END AS origin FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def first_source_wins(spark, d):
    a = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    b = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return relational.first_source(a, b, "doc_id", "quality")


@query("WITH m AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS a, CAST((s_suppkey * 7919) % 101 AS DOUBLE) AS b FROM supplier) SELECT s_suppkey FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))")
def pareto_front(spark, d):
    m = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("a"), ((F.col("s_suppkey") * 7919) % 101).cast("double").alias("b"))
    return relational.pareto(m, "s_suppkey", ["a", "b"])


@query("SELECT CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'first' ELSE 'second' END AS part, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id GROUP BY 1")
def id_set_ops(spark, d):
    return relational.id_sets(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


# -- models


@query("WITH t AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), w AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS w FROM w")
def tfidf_weights(spark, d):
    return models.tfidf(_t(spark, d, "benchmark"), "item_id", "text").select("item_id", "term", F.round("w", 6).alias("w"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x[i]) AS a FROM e, unnest(range(1, 65)) AS t(i) GROUP BY label, i) GROUP BY label), p AS (SELECT vec_id, c.label AS predicted, round(list_dot_product(x, c) / sqrt(list_dot_product(x, x) * list_dot_product(c, c)), 6) AS cosine FROM e CROSS JOIN c)
SELECT vec_id, predicted, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, predicted) AS rn FROM p) WHERE rn = 1""")
def centroid_predict(spark, d):
    return models.vector_centroids(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("""WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
, t AS (SELECT lang, term, count(*) AS c FROM (SELECT lang, unnest(w) AS term FROM d WHERE doc_id % 5 <> 0) GROUP BY ALL), m AS (SELECT lang, sum(c) AS m FROM t GROUP BY lang), v AS (SELECT count(DISTINCT term) AS v FROM t)
, p AS (SELECT lang, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM d WHERE doc_id % 5 <> 0 GROUP BY lang)
, k AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d WHERE doc_id % 5 = 0) WHERE term IN (SELECT term FROM t) GROUP BY ALL)
, s AS (SELECT d.doc_id, p.lang, round(ln(any_value(p)) + coalesce(sum(tf * ln((coalesce(c, 0) + 0.7::DOUBLE) / (m + 0.7::DOUBLE * v))), 0), 4) AS score FROM d CROSS JOIN p JOIN m ON m.lang = p.lang CROSS JOIN v LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.lang = p.lang AND t.term = k.term WHERE d.doc_id % 5 = 0 GROUP BY d.doc_id, p.lang)
SELECT doc_id, lang AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1""")
def naive_bayes(spark, d):
    docs = _t(spark, d, "documents")
    return models.naive_bayes(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"), "doc_id", "text", "lang")
