"""Registered queries on evidence: chunk, sentence and window retrieval, the selectors, evidence variants and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.operators import corpus, retrieval, selection
from tessera.plans.catalog import _BM25_S, _KEPT, _SENT, _TOKENS, _ranked_sentences, _t, query
from tessera.sources import store

_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
_SEL = f"list_filter({_TOKENS}, lambda w: w NOT IN (" + ",".join(f"'{w}'" for w in K.STOP_WORDS["selection"]) + "))"


def _bm25_sql(tag: str, units: str, keys: str, text: str) -> str:
    """CTEs that rank the rows of `units` for every claim, as r<tag>(item_id, keys, score, rank)."""
    return f"""u{tag} AS (SELECT {keys}, {_KEPT.format(text)} AS t FROM {units}), st{tag} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM u{tag})
, q{tag} AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_KEPT.format('text')}) AS term FROM benchmark) GROUP BY ALL)
, p{tag} AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, len(t) AS dl, unnest(t) AS term FROM u{tag}) WHERE term IN (SELECT term FROM q{tag}) GROUP BY ALL)
, f{tag} AS (SELECT term, count(*) AS df FROM p{tag} GROUP BY term)
, c{tag} AS (SELECT item_id, {keys}, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM p{tag} JOIN f{tag} USING (term) JOIN q{tag} USING (term) CROSS JOIN st{tag} GROUP BY ALL)
, r{tag} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {keys})::INTEGER AS rank FROM c{tag})"""


_CHUNKS = r"""cw AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents)
, ch AS (SELECT doc_id, ((s - 1) // 150)::INTEGER AS unit, array_to_string(w[s : s + 199], ' ') AS text FROM cw, unnest(range(1, len(w) + 1, 150)) AS t(s) WHERE len(w[s : s + 199]) >= 10)"""
_TOP = f"{_CHUNKS}, {_bm25_sql('c', 'ch', 'doc_id, unit', 'text')}, top AS (SELECT item_id, b.text AS claim, rank, doc_id, unit, score, ch.text FROM rc JOIN benchmark b USING (item_id) JOIN ch USING (doc_id, unit) WHERE rank <= 5)"
_CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '-\s*\n\s*', '', 'g'), '\b\d+\s*/\s*\d+\b', '', 'g'), '\s+', ' ', 'g'))"
_ENDS = "|".join(e.replace(".", r"\.") for e in T.ENDINGS)
_PIECES = rf"list_filter(list_transform(string_split(regexp_replace({{0}}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_MERGED = rf"string_split(list_reduce({_PIECES}, lambda a, x: a || CASE WHEN regexp_matches(a, '(?i)(?:{_ENDS})$') THEN ' ' ELSE chr(1) END || x), chr(1))"
_DICE = "coalesce(2.0::DOUBLE * len(list_intersect(list_distinct({0}), list_distinct({1}))) / nullif(len(list_distinct({0})) + len(list_distinct({1})), 0), 0.0::DOUBLE)"
_BEST = f"""pcs AS (SELECT item_id, claim, rank, doc_id, unit, {_MERGED.format(_CLEANED.format('text'))} AS al FROM top)
, ps1 AS (SELECT item_id, claim, rank, doc_id, unit, al, i, al[i] AS evidence FROM pcs, unnest(range(1, len(al) + 1)) AS t(i))
, ps2 AS (SELECT *, {_WORDS.format('evidence')}::INTEGER AS n_words FROM ps1), ps3 AS (SELECT *, {_DICE.format(_SEL.format('claim'), _SEL.format('evidence'))} * CASE WHEN n_words < 8 THEN 0.5::DOUBLE WHEN n_words > 60 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS sc FROM ps2 WHERE n_words >= 3)
, best5 AS (SELECT *, array_to_string(al[greatest(i - 1, 1) : i + 1], ' ') AS win FROM ps3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, rank, i) = 1)
, best1 AS (SELECT * FROM ps3 WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, rank, i) = 1)"""
_WIN = r"""wn AS (SELECT doc_id, sent_id, concat_ws(' ', lag(sentence) OVER v, sentence, lead(sentence) OVER v) AS text FROM sent WHERE len(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) >= 5 WINDOW v AS (PARTITION BY doc_id ORDER BY sent_id))"""


def _chunks(spark, d):
    return _cut_chunks(_t(spark, d, "documents"))


def _kept(spark, ranked):
    """A ranking stored, a few rows a claim, so that it is made once and only its documents are cut again."""
    path = store.scratch(spark, "ranked")
    ranked.write.parquet(path)
    return spark.read.parquet(path)


def _cut_chunks(docs):
    return corpus.chunks(docs).select("doc_id", F.col("chunk").alias("unit"), F.col("chunk_text").alias("text"))


def _top(spark, d):
    """The five best chunks of every claim with their texts: at most five rows a claim."""
    units, claims = _chunks(spark, d), _t(spark, d, "benchmark")
    ranked = _kept(spark, retrieval.bm25(units, ["doc_id", "unit"], "text", claims, "item_id", "text", top=5, stop=K.STOP_WORDS["retrieval"]))
    return ranked.join(claims.withColumnRenamed("text", "claim"), "item_id").join(_cut_chunks(corpus.among(_t(spark, d, "documents"), ranked)), ["doc_id", "unit"])


def _ranked_windows(spark, d, top):
    stop = K.STOP_WORDS["retrieval"]
    windows = corpus.centred_words(_t(spark, d, "documents"), stop=stop)
    return retrieval.bm25(windows, ["doc_id", "sent_id"], "words", _t(spark, d, "benchmark"), "item_id", "text", top=top, stop=stop, cut=True)


@query(f"WITH {_CHUNKS}, {_bm25_sql('c', 'ch', 'doc_id, unit', 'text')} SELECT item_id, doc_id, unit, score, rank FROM rc WHERE rank <= 20")
def bm25_chunks(spark, d):
    """Twenty chunks of 200 words for every claim."""
    return retrieval.bm25(_chunks(spark, d), ["doc_id", "unit"], "text", _t(spark, d, "benchmark"), "item_id", "text", top=20, stop=K.STOP_WORDS["retrieval"])


@query(f"WITH {_SENT}, {_WIN}, {_bm25_sql('w', 'wn', 'doc_id, sent_id', 'text')} SELECT item_id, doc_id, sent_id, score, rank FROM rw WHERE rank <= 10")
def bm25_windows(spark, d):
    """Ten windows of a sentence and its neighbours for every claim."""
    return _ranked_windows(spark, d, 10)


_OUT = "SELECT b.item_id, x.doc_id, x.unit, coalesce(x.rank, 0)::INTEGER AS rank, coalesce(x.score, 0.0::DOUBLE) AS score, coalesce(x.n_words, 0)::INTEGER AS n_words, coalesce(x.source_type, 'empty') AS source_type, md5(coalesce(x.evidence, '')) AS evidence FROM benchmark b LEFT JOIN x USING (item_id)"
_N = f"{_WORDS.format('evidence')} AS n_words"
_SELECTOR_SQL = {
    "raw_top1_chunk": f"WITH {_TOP}, y AS (SELECT *, text AS evidence FROM top WHERE rank = 1), x AS (SELECT *, {_N}, 'raw_chunk' AS source_type FROM y) {_OUT}",
    "cleaned_top1_chunk": f"WITH {_TOP}, y AS (SELECT *, {_CLEANED.format('text')} AS evidence FROM top WHERE rank = 1), x AS (SELECT *, {_N}, 'cleaned_chunk' AS source_type FROM y) {_OUT}",
    "first_sentence_top1": f"WITH {_TOP}, z AS (SELECT *, {_MERGED.format(_CLEANED.format('text'))} AS s FROM top WHERE rank = 1), y AS (SELECT *, coalesce(list_filter(s, lambda v: {_WORDS.format('v')} >= 5)[1], s[1]) AS evidence FROM z), x AS (SELECT *, {_N}, 'first_sentence' AS source_type FROM y) {_OUT}",
    "best_sentence_top1_overlap": f"WITH {_TOP}, {_BEST}, x AS (SELECT *, round(sc, 6) AS score, 'best_sentence_top1' AS source_type FROM best1) {_OUT}",
    "best_sentence_top5_overlap": f"WITH {_TOP}, {_BEST}, x AS (SELECT *, round(sc, 6) AS score, 'best_sentence_top5' AS source_type FROM best5) {_OUT}",
    "three_sentence_window_top5": f"WITH {_TOP}, {_BEST}, y AS (SELECT * EXCLUDE (evidence, n_words), win AS evidence FROM best5), x AS (SELECT *, {_N}, round(sc, 6) AS score, 'window_3' AS source_type FROM y) {_OUT}",
    "sentence_bm25_top1": f"WITH {_BM25_S}, y AS (SELECT item_id, doc_id, sent_id AS unit, rank, score, sentence AS evidence FROM rs JOIN sent USING (doc_id, sent_id) WHERE rank = 1), x AS (SELECT *, {_N}, 'sentence_bm25' AS source_type FROM y) {_OUT}",
    "window_bm25_top1": f"WITH {_SENT}, {_WIN}, {_bm25_sql('w', 'wn', 'doc_id, sent_id', 'text')}, y AS (SELECT item_id, doc_id, sent_id AS unit, rank, score, text AS evidence FROM rw JOIN wn USING (doc_id, sent_id) WHERE rank = 1), x AS (SELECT *, {_N}, 'window_bm25' AS source_type FROM y) {_OUT}",
}


def _selector(name: str):
    def run(spark, d):
        claims = _t(spark, d, "benchmark")
        if name == "sentence_bm25_top1":
            first = _kept(spark, _ranked_sentences(spark, d).filter("rank = 1"))
            units = corpus.sentences(corpus.among(_t(spark, d, "documents"), first)).withColumn("sent_id", F.col("sent_id").cast("long"))
            got = first.join(units, ["doc_id", "sent_id"]).select("item_id", "doc_id", F.col("sent_id").alias("unit"), "rank", "score", F.col("sentence").alias("text"))
            out = selection.select(name, claims, "item_id", got, sentences=got)
        elif name == "window_bm25_top1":
            first = _kept(spark, _ranked_windows(spark, d, 1))
            units = corpus.document_centred(corpus.among(_t(spark, d, "documents"), first)).withColumnRenamed("window", "text")
            got = first.join(units, ["doc_id", "sent_id"]).withColumnRenamed("sent_id", "unit")
            out = selection.select(name, claims, "item_id", got, windows=got)
        else:
            out = selection.select(name, claims, "item_id", _top(spark, d))
        return out.withColumn("evidence", F.md5("evidence"))

    run.__name__ = f"select_{name}"
    run.__doc__ = f"The evidence that {name} picks for every claim."
    return query(_SELECTOR_SQL[name])(run)


for _name in selection.SELECTORS:
    globals()[f"select_{_name}"] = _selector(_name)


_MARK = "coalesce(text, '')"
for _p, _new in T.MARKUP:
    _p, _new = _p.replace("'", "''").replace("(?i:", "(?:"), _new.replace("$1$2", r"\1\2")
    _MARK = f"regexp_replace({_MARK}, '{_p}', '{_new}', '{'gi' if _p.startswith('^') else 'g'}')"
_FITS = f"({_WORDS} BETWEEN 4 AND 80)"
_BOUNDED = rf"""flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(trim({{0}}), '([.!?])\s+([A-Z"(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: {_WORDS.format('s')} >= 4), lambda s: CASE WHEN {_WORDS.format('s')} > 80 THEN list_filter(list_transform(string_split(s, ';'), lambda p: trim(p)), lambda p: {_FITS.format('p')}) ELSE [s] END))"""
_WORD3 = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_-]{{2,}}'))"


@query(f"""WITH {_TOP}, m AS (SELECT item_id * 10 + rank AS uid, {_WORD3.format('claim')} AS c, {_BOUNDED.format(f'trim({_MARK})')} AS al FROM top), e AS (SELECT uid, c, al, i, al[i] AS evidence FROM m, unnest(range(1, len(al) + 1)) AS t(i))
, s AS (SELECT *, CASE WHEN len(c) > 0 THEN {_DICE.format('c', _WORD3.format('evidence'))} ELSE (i - 1 = len(al) // 2)::INTEGER::DOUBLE END AS sc FROM e), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY uid ORDER BY sc DESC, i) = 1)
SELECT uid, (i - 1)::INTEGER AS i, CASE WHEN len(c) > 0 THEN round(sc, 6) ELSE 0.0::DOUBLE END AS score, md5(evidence) AS evidence, md5(array_to_string(al[greatest(0, least(i - 2, len(al) - 3)) + 1 : greatest(0, least(i - 2, len(al) - 3)) + 3], ' ')) AS win FROM b""")
def canonical_sentence(spark, d):
    """The closest sentence of each of the five best chunks, and three sentences around it."""
    top = _top(spark, d).withColumn("uid", F.col("item_id") * 10 + F.col("rank"))
    return selection.closest_bounded(top, "uid", "claim", "text").select("uid", "i", "score", F.md5("evidence").alias("evidence"), F.md5("window").alias("win"))


@query(f"""WITH {_TOP}, {_BEST}, h AS (SELECT b.item_id, b.text AS oracle, 'Title: item-' || b.item_id || ' Page: ' || b.item_id % 7 || ' Section: unknown' AS head, coalesce(t1.text, '') AS t1, coalesce(t2.text, '') AS t2, coalesce(best5.evidence, '') AS b1, coalesce(best5.win, '') AS b3
  FROM benchmark b LEFT JOIN top t1 ON t1.item_id = b.item_id AND t1.rank = 1 LEFT JOIN top t2 ON t2.item_id = b.item_id AND t2.rank = 2 LEFT JOIN best5 ON best5.item_id = b.item_id)
, g AS (SELECT *, CASE WHEN t2 = '' THEN oracle ELSE trim(oracle || ' ' || t2) END AS longer FROM h)
, v AS (SELECT item_id, unnest([{', '.join(f"'{v}'" for v in selection.VARIANTS)}]) AS variant, unnest([oracle, CASE WHEN oracle = '' THEN head ELSE head || chr(10) || oracle END, longer, CASE WHEN longer = '' THEN head ELSE head || chr(10) || longer END, t1, {_CLEANED.format('t1')}, b1, b3]) AS evidence FROM g)
SELECT item_id, variant, {_WORDS.format('evidence')}::INTEGER AS n_words, sha256(evidence) AS sha, starts_with(variant, 'oracle') AS uses_oracle, contains(variant, 'metadata') AS has_metadata, contains(variant, 'lengthened') AS lengthened FROM v""")
def format_variants(spark, d):
    """Eight evidence texts of every claim; the claim's own passage stands for the known evidence."""
    claims = _t(spark, d, "benchmark").select("item_id", F.concat(F.lit("item-"), F.col("item_id")).alias("title"), (F.col("item_id") % 7).alias("page"), F.col("text").alias("oracle"))
    top = _top(spark, d)
    return selection.variants(claims, "item_id", top.filter("rank = 1"), top.filter("rank = 2"), selection.best_sentences(top, "item_id", 5)).drop("evidence")


# -- pairs of a claim and its evidence: a turn of a conversation and the turn before it

_PAIRS = "pr AS (SELECT conv_id * 1000 + turn AS uid, conv_id AS grp, turn % 4 AS label, coalesce(text, '') AS claim, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS evidence FROM conversations)"


def pairs(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.col("conv_id").alias("grp"), (F.col("turn") % 4).alias("label"), F.coalesce("text", F.lit("")).alias("claim"), F.coalesce(before, F.lit("")).alias("evidence"))


def _count_sql(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{t}')::INTEGER" for t in terms) + ")"


_G = {f"{n}_{s}": _count_sql(s, selection.terms(n)) for n in selection.LEXICONS for s in ("claim", "evidence")}


@query(f"WITH {_PAIRS} SELECT uid, {_G['claim_action_claim']} - {_G['evidence_support_evidence']} AS action_escalation_gap, {_G['claim_action_claim']} AS claim_action_strength, {_G['evidence_support_evidence']} AS evidence_action_support, {_G['deployment_claim']} - {_G['deployment_evidence']} AS deployment_gap, {_G['claim_action_claim']} - {_G['metric_evidence']} AS metric_to_action_gap, {_G['certainty_claim']} - {_G['certainty_evidence']} AS certainty_gap, {_G['scope_claim']} - {_G['scope_evidence']} AS scope_gap, (length(claim) - length(evidence))::INTEGER AS length_diff FROM pr")
def action_gap_features(spark, d):
    return pairs(spark, d).select("uid", *[c.alias(n) for n, c in selection.action_gaps(F.col("claim"), F.col("evidence")).items()])


_TOY = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN (" + ",".join(f"'{w}'" for w in K.STOP_WORDS["toy"]) + ")))"


@query(f"""WITH {_PAIRS}, t AS (SELECT *, {_TOY.format('claim')} AS a, {_TOY.format('evidence')} AS b, {_count_sql('evidence', ['deploy', 'production', 'safe', 'guarantee', 'must', 'always'])} AS act FROM pr), o AS (SELECT *, claim = '' OR evidence = '' AS none, len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1) AS ov FROM t)
, p AS (SELECT uid, none, CASE WHEN none THEN 0.1::DOUBLE ELSE greatest(0.05::DOUBLE, 0.3::DOUBLE - ov * 0.5) END AS c, CASE WHEN none THEN 0.1::DOUBLE ELSE least(0.9::DOUBLE, 0.2::DOUBLE + act * 0.15::DOUBLE) END AS s, CASE WHEN none THEN 0.3::DOUBLE ELSE 0.3::DOUBLE + ov * 0.2::DOUBLE END AS m FROM o)
SELECT uid, round(c, 6) AS p_contra, round(s, 6) AS p_strong, round(m, 6) AS p_svm, CASE WHEN none THEN 'supported' WHEN c > 0.25::DOUBLE THEN 'contradiction_candidate' WHEN s > 0.4::DOUBLE THEN 'strong_action_overclaim' WHEN m > 0.4::DOUBLE THEN 'mild_scope_overclaim' ELSE 'supported' END AS pred_label FROM p""")
def toy_scorer(spark, d):
    return pairs(spark, d).select("uid", *[c.alias(n) for n, c in selection.toy_scores(F.col("claim"), F.col("evidence")).items()])


_NEG = ["not", "no", "never", "cannot", "without"]


@query(rf"""WITH {_PAIRS}, t AS (SELECT uid, regexp_extract_all(lower(claim), '[a-z0-9]+') AS ct, regexp_extract_all(lower(evidence), '[a-z0-9]+') AS et, list_distinct(regexp_extract_all(claim, '\d+(?:\.\d+)?')) AS na, list_distinct(regexp_extract_all(evidence, '\d+(?:\.\d+)?')) AS nb FROM pr)
, u AS (SELECT *, list_distinct(ct) AS a, list_distinct(et) AS b FROM t), v AS (SELECT *, len(list_intersect(a, b)) AS x, len(list_distinct(list_concat(a, b))) AS y, len(list_filter(ct, lambda w: w IN ('not', 'no', 'never', 'cannot', 'without'))) AS cn, len(list_filter(et, lambda w: w IN ('not', 'no', 'never', 'cannot', 'without'))) AS en FROM u)
SELECT uid, round(coalesce(x::DOUBLE / nullif(len(a), 0), 0), 6) AS in_claim, round(coalesce(x::DOUBLE / nullif(len(b), 0), 0), 6) AS in_evidence, round(coalesce(x::DOUBLE / nullif(y, 0), 0), 6) AS in_both, round(coalesce((len(a) - x)::DOUBLE / nullif(len(a), 0), 0), 6) AS claim_only, round(coalesce((len(b) - x)::DOUBLE / nullif(len(b), 0), 0), 6) AS evidence_only,
  round(coalesce(len(list_intersect(na, nb))::DOUBLE / nullif(len(list_distinct(list_concat(na, nb))), 0), 0), 6) AS numbers_shared, (len(na) > 0 AND len(nb) > 0 AND list_sort(na) <> list_sort(nb))::INTEGER AS numbers_differ, cn::INTEGER AS claim_negations, abs(cn - en)::INTEGER AS negation_gap, round(coalesce(len(ct)::DOUBLE / nullif(len(et), 0), 0), 6) AS length_ratio, len(a)::INTEGER AS claim_words FROM v""")
def pair_interaction_features(spark, d):
    return pairs(spark, d).select("uid", *[c.alias(n) for n, c in selection.pair_features(F.col("claim"), F.col("evidence"), _NEG).items()])


_LET = r"regexp_extract_all(lower({0}), '[a-z][a-z0-9_\-]+')"


@query(rf"""WITH {_PAIRS}, t AS (SELECT uid, grp, length(claim) AS claim_len, length(evidence) AS evidence_len, {_LET.format('claim')} AS ct, {_LET.format('evidence')} AS et FROM pr)
, f AS (SELECT uid, grp, claim_len::DOUBLE AS claim_len, (evidence_len - claim_len)::DOUBLE AS len_gap, len(ct)::DOUBLE AS claim_words, coalesce(len(list_intersect(list_distinct(ct), list_distinct(et)))::DOUBLE / nullif(len(list_distinct(list_concat(ct, et))), 0), 0) AS shared FROM t)
, m AS (SELECT avg(claim_len) AS a1, stddev_pop(claim_len) AS s1, avg(len_gap) AS a2, stddev_pop(len_gap) AS s2, avg(claim_words) AS a3, stddev_pop(claim_words) AS s3, avg(shared) AS a4, stddev_pop(shared) AS s4 FROM f WHERE grp % 3 <> 0)
SELECT uid, grp, round((claim_len - a1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS claim_len, round((len_gap - a2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS len_gap, round((claim_words - a3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS claim_words, round((shared - a4) / CASE WHEN s4 = 0 THEN 1 ELSE s4 END, 6) AS shared FROM f CROSS JOIN m""")
def overlap_features(spark, d):
    """Lengths and overlap of claims and evidence on the scale of the training groups."""
    p = pairs(spark, d)
    ct, et = K.tokenize(F.col("claim"), "letter"), K.tokenize(F.col("evidence"), "letter")
    n = lambda x: x.cast("double")
    f = p.select("uid", "grp", n(F.length("claim")).alias("claim_len"), n(F.length("evidence") - F.length("claim")).alias("len_gap"), n(F.size(ct)).alias("claim_words"), K.jaccard(F.array_distinct(ct), F.array_distinct(et)).alias("shared"))
    return selection.standardised(f, ["claim_len", "len_gap", "claim_words", "shared"], F.col("grp") % 3 != 0)


_ANCHOR = rf"anc AS (SELECT doc_id, arg_min(sentence, sent_id) AS anchor FROM sent WHERE {_WORDS.format('sentence')} >= 8 GROUP BY doc_id)"


@query(f"""WITH {_SENT}, {_ANCHOR}, ut AS (SELECT doc_id, sent_id, {_TOKENS.format('sentence')} AS t FROM sent JOIN anc USING (doc_id)), un AS (SELECT *, len(t) AS dl, count(*) OVER (PARTITION BY doc_id) AS n, avg(len(t)) OVER (PARTITION BY doc_id) AS avgdl FROM ut)
, qa AS (SELECT doc_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest({_TOKENS.format('anchor')}) AS term FROM anc) GROUP BY ALL), pa AS (SELECT doc_id, sent_id, dl, n, avgdl, term, count(*) AS tf FROM (SELECT doc_id, sent_id, dl, n, avgdl, unnest(t) AS term FROM un) GROUP BY ALL)
, pb AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM pa JOIN qa USING (doc_id, term)), sc AS (SELECT doc_id, sent_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM pb GROUP BY ALL)
, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_id) AS rank FROM sc), hit AS (SELECT doc_id, min(rank) AS first FROM rk JOIN sent USING (doc_id, sent_id) JOIN anc USING (doc_id) WHERE rank <= 10 AND sentence = anchor GROUP BY doc_id)
SELECT lang, count(*) AS n, round(avg((coalesce(first, 99) <= 1)::INTEGER), 6) AS recall_1, round(avg((coalesce(first, 99) <= 5)::INTEGER), 6) AS recall_5, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM anc JOIN documents USING (doc_id) LEFT JOIN hit USING (doc_id) GROUP BY lang""")
def retrieval_within_documents(spark, d):
    """Whether a document's anchor sentence finds itself again among the document's sentences, by language."""
    docs = _t(spark, d, "documents")
    s = corpus.sentences(docs)
    anchors = s.filter(T.count_words(F.col("sentence")) >= 8).groupBy("doc_id").agg(F.min_by("sentence", "sent_id").alias("anchor"))
    ranked = retrieval.bm25_within(s, "doc_id", "sent_id", "sentence", anchors, "anchor")
    first = ranked.join(s, ["doc_id", "sent_id"]).join(anchors, "doc_id").filter("sentence = anchor").groupBy("doc_id").agg(F.min("rank").alias("first"))
    every = anchors.join(docs.select("doc_id", "lang"), "doc_id").join(first, "doc_id", "left")
    at = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("int")), 6)
    return every.groupBy("lang").agg(F.count("*").alias("n"), at(1).alias("recall_1"), at(5).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""WITH {_TOP}, k AS (SELECT item_id, unnest([1, 3, 5]) AS k FROM benchmark), j AS (SELECT k.item_id, k.k, string_agg('[RANK=' || rank || '][PDF=' || doc_id || '][PAGE=' || unit || '] ' || text, ' ' ORDER BY rank) AS s, bool_or(contains(text, claim)) AS hit FROM k JOIN top ON top.item_id = k.item_id AND rank <= k.k GROUP BY ALL)
SELECT item_id, k::INTEGER AS k, length(s)::INTEGER AS n_chars, md5(CASE WHEN length(s) > 3000 THEN substr(s, 1, 3000) || '...[TRUNCATED]' ELSE s END) AS joined, hit FROM j""")
def concatenated_evidence(spark, d):
    """The first one, three and five chunks of a claim as one marked text, cut and marked as cut after 3000 characters, which is the feature."""
    top = _top(spark, d).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).filter("rank <= k")
    part = F.concat(F.lit("[RANK="), F.col("rank"), F.lit("][PDF="), F.col("doc_id"), F.lit("][PAGE="), F.col("unit"), F.lit("] "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))  # five rows at most
    out = top.groupBy("item_id", "k").agg(rows.alias("rows"), F.bool_or(F.contains("text", "claim")).alias("hit"))
    joined = F.array_join(F.transform("rows", lambda r: r["part"]), " ")
    cut = F.when(F.length(joined) > 3000, F.concat(F.substring(joined, 1, 3000), F.lit("...[TRUNCATED]"))).otherwise(joined)
    return out.select("item_id", "k", F.length(joined).alias("n_chars"), F.md5(cut).alias("joined"), "hit")
