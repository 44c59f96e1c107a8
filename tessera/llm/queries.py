"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embeddings, language, licenses, media, minhash, mixing, pii, quality, repeats, resample, tokens, unigram, whitening
from tessera.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.piece_report(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "mix_copy", "mix_key")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_embedding_dedup, op3_minhash_dedup, op4_sentencepiece, op5_quality, op6_mixing, op7_media, op8_pii, op9_licenses, op10_repeats, op11_importance_resampling, op12_language_id, op13_whitening, pipeline)}


_COMPONENTS = """
, linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
, reach AS (SELECT a, b FROM linked UNION SELECT r.a, e.b FROM reach r JOIN linked e ON r.b = e.a)
, comp AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

SQL = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
, n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS s FROM v WHERE x IS NOT NULL)
, links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM n p JOIN n q ON p.vec_id < q.vec_id AND p.s > 0 AND q.s > 0 AND list_dot_product(p.x, q.x) >= 0.9 * p.s * q.s)
{_COMPONENTS}
, deg AS (SELECT a, count(*) AS d FROM linked GROUP BY a)
SELECT vec_id, coalesce(d, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN comp ON comp.a = vec_id LEFT JOIN deg ON deg.a = vec_id""",
    "op3_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents)
, s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i : i + 4], ' ')) END) AS sh FROM w))
, n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id)
, links AS (SELECT c.a, c.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.sh = q.sh AND p.doc_id < q.doc_id GROUP BY 1, 2) c JOIN n m ON m.doc_id = c.a JOIN n o ON o.doc_id = c.b WHERE 100 * i >= 85 * (m.k + o.k - i))
{_COMPONENTS}
SELECT w.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.a = w.doc_id""",
    "op6_mixing": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
, r AS (SELECT source, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE AS whole FROM c)
, m AS (SELECT source, greatest(1, ceil(whole / 64))::BIGINT AS parts, whole / greatest(1, ceil(whole / 64)) AS rate FROM r)
, pmf AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM m, unnest(range(0, 22 + ceil(rate + 10 * sqrt(rate))::BIGINT)) AS t(k))
, cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf)
, lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source)
, u AS (SELECT doc_id, documents.source, ('0x' || substr(md5('0:' || CASE WHEN i > 1 THEN i || '/' ELSE '' END || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source, unnest(range(1, parts + 1)) AS t(i))
, e AS (SELECT doc_id, sum(len(list_filter(cs, lambda c: c <= u)))::BIGINT AS copies FROM u JOIN lists ON u.source IS NOT DISTINCT FROM lists.source GROUP BY doc_id)
, d AS (SELECT documents.*, copies FROM documents JOIN e USING (doc_id))
SELECT doc_id, source, lang, n_chars, text, mix_copy::INTEGER AS mix_copy, md5('order-0:' || doc_id::VARCHAR || ':' || mix_copy::VARCHAR) AS mix_key
FROM d, unnest(range(1, copies + 1)) AS t(mix_copy)""",
    "op11_importance_resampling": r"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i))
, d AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
, w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d)
, words AS (SELECT DISTINCT word FROM w)
, bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), (2 * k + 1)::BIGINT, 2))::BIGINT) AS b FROM words)
, bucket AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc)
, counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN bucket USING (word) GROUP BY bucket)
, gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts)
, f AS (SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN bucket USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id)
, noise AS (SELECT doc_id, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents)
, scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM noise LEFT JOIN f ON f.id = doc_id)
, drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, place AS rank FROM scored LEFT JOIN drawn ON drawn.doc_id = scored.doc_id AND place <= n * 10 // 100""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
