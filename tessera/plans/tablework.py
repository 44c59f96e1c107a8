"""Registered queries on files, unions, ranks, simulated samples and tables of metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import corpus, ordinal, rules, sampling, simulation, validation
from tessera.plans.catalog import _BLOCKS, _BM25, _PRED, _W, _cut, _predicted, _ranked, _scores, _t, query
from tessera.sources import store, tables

_H = "md5('42|' || {0}::VARCHAR)"
_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"


# -- files written and read again


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS body FROM conversations")
def csv_round_trip(spark, d):
    """Turns as CSV and back: line breaks, quotes and empty texts survive; missing texts become empty."""
    path = store.write_csv(_t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), store.scratch(spark, "csv"))
    return tables.read_csv(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("body"))


@query("SELECT o_orderkey::VARCHAR AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'paper-' || o_custkey END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END::INTEGER AS page_number, CASE WHEN o_orderkey % 5 = 0 THEN 'given' ELSE sha256(o_orderpriority) END AS evidence_sha, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '' END AS label FROM orders")
def candidate_scan(spark, d):
    """Candidates from a CSV with missing titles, hashes and labels and pages that are no numbers."""
    k = F.col("o_orderkey")
    when = lambda m, r, x: F.when(k % m == r, x).otherwise("")
    raw = _t(spark, d, "orders").select(
        k.cast("string").alias("candidate_id"), F.lit("a claim").alias("claim_text"), when(3, 0, F.col("o_orderstatus")).alias("title"), F.concat(F.lit("paper-"), F.col("o_custkey"), F.lit(".pdf")).alias("pdf_filename"),
        F.when(k % 4 == 0, "p. 3").otherwise(F.col("o_custkey").cast("string")).alias("page_number"), F.col("o_orderpriority").alias("evidence_text"), when(5, 0, "given").alias("evidence_text_sha256"),
        when(4, 0, "a").alias("true_label"), when(4, 1, "b").alias("final_label"), F.lit("").alias("gold_label"), when(4, 2, "c").alias("label_guess"),
    )
    path = store.write_csv(raw, store.scratch(spark, "candidates"))
    return store.candidates(spark, path).drop("claim_text")


@query("SELECT 'c' || o_orderkey AS chunk_id, md5(o_orderpriority) AS body, o_custkey::INTEGER AS page_start, 0::INTEGER AS chunk_index FROM orders WHERE o_orderkey % 2 = 0")
def chunk_scan(spark, d):
    k = F.col("o_orderkey")
    raw = _t(spark, d, "orders").select(F.concat(F.lit("c"), k).alias("chunk_id"), F.concat(F.col("o_orderpriority"), F.lit("\u0000")).alias("chunk_text"), F.when(k % 2 == 0, "ok").otherwise("failed").alias("extract_status"), F.col("o_custkey").cast("string").alias("page_start"), F.lit("none").alias("chunk_index"))
    return store.chunk_rows(spark, store.write_csv(raw, store.scratch(spark, "chunks"))).select("chunk_id", F.md5("chunk_text").alias("body"), "page_start", "chunk_index")


@query(rf"""WITH {_BLOCKS}, s0 AS (SELECT doc_id, section, trim(replace(p[i], chr(2), '.')) AS s FROM (SELECT doc_id, section, {_cut('block')} AS p FROM blk), unnest(range(1, len(p) + 1)) AS t(i)) SELECT section, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM s0 WHERE {_WORDS.format('s')} >= 5 AND section <> 'reference' GROUP BY section""")
def jsonl_corpus(spark, d):
    """Sentences as JSON lines and back, without those of reference sections."""
    units = corpus.retrieval_units(corpus.blocks(corpus.clean_pages(_t(spark, d, "documents"))))
    path = store.write_jsonl(units, store.scratch(spark, "sentences"))
    back = tables.read_jsonl(spark, path, units.schema).filter("section <> 'reference'")
    return back.groupBy("section").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0")
def tolerant_jsonl(spark, d):
    """JSON lines with bad ones among them, which are dropped."""
    c = _t(spark, d, "conversations")
    line = F.when(F.col("turn") % 3 == 0, F.lit('{"conv_id": 1, "turn": oops')).otherwise(F.to_json(F.struct("conv_id", "turn")))
    path = store.scratch(spark, "lines")
    c.select(line.alias("value")).write.text(path)
    return tables.read_jsonl(spark, path, "conv_id long, turn long")


@query("SELECT 'S' || doc_id % 3 AS split, lang, count(*) AS n FROM documents GROUP BY ALL")
def split_sink(spark, d):
    """Documents written in a folder for each split and read back by folder."""
    x = _t(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("S"), F.col("doc_id") % 3).alias("split"))
    path = store.write_splits(x, "split", store.scratch(spark, "splits"))
    return spark.read.parquet(path).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(_BM25 + rf" SELECT item_id, doc_id, score, rank::INTEGER AS rank, sha256(coalesce(text, '')) AS text_sha256, {_WORDS.format('text')}::INTEGER AS text_words FROM r JOIN documents USING (doc_id) WHERE rank <= 3")
def redacted_top(spark, d):
    """The three best documents of every claim without their texts."""
    return store.redacted(_ranked(spark, d).join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id"), ["text"], "item_id", "rank").select("item_id", "doc_id", "score", "rank", "text_sha256", "text_words")


@query(_W + ", q AS (SELECT cid, p_strong FROM s ORDER BY p_strong DESC, cid LIMIT 40) SELECT 'AUDIT-V1-' || lpad((row_number() OVER (ORDER BY p_strong DESC, cid))::VARCHAR, 4, '0') AS audit_id, cid FROM q")
def audit_sheet(spark, d):
    """Forty numbered rows to audit; the limit is the sheet's."""
    q = _scores(spark, d).select("cid", "p_strong").orderBy(F.desc("p_strong"), "cid").limit(40)
    return store.numbered(q, [F.desc("p_strong"), "cid"], "AUDIT-V1").select("audit_id", "cid")


@query(_W + """, v AS (UNPIVOT (SELECT cid, strong, p_strong, p_svm, p_contra FROM s) ON p_strong, p_svm, p_contra INTO NAME variant VALUE score), m AS (SELECT variant, round(2.0 * count(*) FILTER (strong AND score >= 0.5) / (count(*) FILTER (score >= 0.5) + count(*) FILTER (strong)), 6)::DOUBLE AS f1 FROM v GROUP BY variant)
SELECT variant, f1, round(f1 - (SELECT f1 FROM m WHERE variant = 'p_strong'), 6) AS f1_less_p_strong, round(f1 - (SELECT f1 FROM m WHERE variant = 'p_contra'), 6) AS f1_less_p_contra FROM m""")
def metric_deltas(spark, d):
    v = _scores(spark, d).unpivot(["cid", "strong"], ["p_strong", "p_svm", "p_contra"], "variant", "score")
    said = F.col("score") >= 0.5
    m = v.groupBy("variant").agg(F.round(2.0 * F.count_if(F.col("strong") & said) / (F.count_if(said) + F.count_if("strong")), 6).alias("f1"))
    return store.against(m, "variant", "f1", ["p_strong", "p_contra"])


@query(_PRED + " SELECT cid, pred, label FROM x WHERE (pred = 2) <> (flag = 1) ORDER BY cid LIMIT 100")
def variant_disagreements(spark, d):
    """The first hundred candidates on which two variants disagree; the limit is the report's."""
    return _predicted(spark, d).filter((F.col("pred") == 2) != (F.col("flag") == 1)).orderBy("cid").limit(100).select("cid", "pred", "label")


@query(r"SELECT o_orderkey, t[1]::DOUBLE AS t1, t[2]::DOUBLE AS t2, t[3]::DOUBLE AS t3, t[4]::DOUBLE AS t4 FROM (SELECT o_orderkey, regexp_extract_all('(0.' || o_orderkey % 90 || ', ' || o_custkey || ', -0.5, 1e-2)', '-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?') AS t FROM orders)")
def parsed_thresholds(spark, d):
    raw = F.concat(F.lit("(0."), F.col("o_orderkey") % 90, F.lit(", "), F.col("o_custkey"), F.lit(", -0.5, 1e-2)"))
    found = F.regexp_extract_all(raw, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?"), F.lit(0))
    return _t(spark, d, "orders").select("o_orderkey", found.alias("t")).select("o_orderkey", *[F.get("t", F.lit(i)).try_cast("double").alias(f"t{i + 1}") for i in range(4)])


@query("SELECT conv_id, turn, v AS text_view, length(CASE v WHEN 'claim' THEN c WHEN 'evidence' THEN e ELSE c || ' [SEP] ' || e END)::INTEGER AS n_chars FROM (SELECT conv_id, turn, coalesce(text, '') AS c, role AS e FROM conversations), (SELECT unnest(['claim', 'evidence', 'both']) AS v)")
def text_views(spark, d):
    c, e = F.coalesce("text", F.lit("")), F.col("role")
    views = [F.struct(F.lit(n).alias("text_view"), F.length(x).alias("n_chars")) for n, x in (("claim", c), ("evidence", e), ("both", F.concat(c, F.lit(" [SEP] "), e)))]
    return _t(spark, d, "conversations").select("conv_id", "turn", F.inline(F.array(*views)))


@query("SELECT doc_id, count(*) FILTER (length(l) > 300 AND NOT starts_with(trim(l), '|')) > 0 AS raw_text, max(length(l))::INTEGER AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def report_text_check(spark, d):
    """Whether a report holds a long line that is no table row."""
    lines = F.split("text", "\n")
    long_ = F.exists(lines, lambda s: (F.length(s) > 300) & ~F.startswith(F.trim(s), F.lit("|")))
    return _t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", long_.alias("raw_text"), F.array_max(F.transform(lines, F.length)).alias("longest"))


@query("SELECT 'documents' AS name, true AS has_text, false AS has_label, 5::INTEGER AS n_columns, (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS n_empty UNION ALL SELECT 'labels', false, true, 3, (SELECT count(*) FROM labels), (SELECT count(*) FROM labels WHERE quality IS NULL OR toxic IS NULL) UNION ALL SELECT 'benchmark', true, false, 2, (SELECT count(*) FROM benchmark), (SELECT count(*) FROM benchmark WHERE coalesce(text, '') = '')")
def artifact_columns(spark, d):
    """Which tables hold texts and which labels, how many rows they have, and in how many a text or label is missing."""
    def row(name):
        t = _t(spark, d, name)
        texts, labels = [c for c in t.columns if c in ("text", "claim_text", "evidence_text")], [c for c in t.columns if c in ("quality", "toxic", "label")]
        empty = F.lit(False)
        for c in texts:
            empty |= F.coalesce(F.col(c), F.lit("")) == ""
        for c in labels:
            empty |= F.col(c).isNull()
        return t.agg(F.lit(name).alias("name"), F.lit(bool(texts)).alias("has_text"), F.lit(bool(labels)).alias("has_label"), F.lit(len(t.columns)).alias("n_columns"), F.count("*").alias("n_rows"), F.count_if(empty).alias("n_empty"))

    contract = validation.Contract(("doc_id", "text"), ("lang", "source", "n_chars"), ("true_label", "oracle_hit"))
    contract.check(_t(spark, d, "documents"), strict=True)
    return row("documents").unionByName(row("labels")).unionByName(row("benchmark"))


@query("SELECT o_orderkey, o_orderkey % 5 < 3 AS flag FROM orders")
def boolean_spellings(spark, d):
    """Flags spelt in several ways in a CSV."""
    k = F.col("o_orderkey") % 5
    raw = _t(spark, d, "orders").select("o_orderkey", F.when(k == 0, "True").when(k == 1, " true").when(k == 2, "1").when(k == 3, "no").otherwise("").alias("flag"))
    back = tables.read_csv(spark, store.write_csv(raw, store.scratch(spark, "flags")), "o_orderkey long, flag string")
    return back.select("o_orderkey", tables.tolerant_bool(F.col("flag")).alias("flag"))


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace('[RANK=1][PDF=a.pdf] ' || coalesce(text, '') || ' [PAGE=3]', '\[(?:RANK|PDF|PAGE)[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM conversations")
def stripped_markers(spark, d):
    x = F.concat(F.lit("[RANK=1][PDF=a.pdf] "), F.coalesce("text", F.lit("")), F.lit(" [PAGE=3]"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(X.strip_markers(x)).alias("plain"))


@query(_W + " SELECT domain, count(*) AS n, count(*) FILTER (cid % 5 <> 0) AS n_known, round(avg(p_strong) FILTER (cid % 5 <> 0), 6) AS mean, round(min(p_strong) FILTER (cid % 5 <> 0), 6) AS low, round(max(p_strong) FILTER (cid % 5 <> 0), 6) AS high FROM s GROUP BY domain")
def nan_free_summary(spark, d):
    """Summary of a score that is not a number in every fifth row."""
    s = _scores(spark, d).select("domain", ordinal.nan_free(F.when(F.col("cid") % 5 == 0, float("nan")).otherwise(F.col("p_strong"))).alias("v"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return s.groupBy("domain").agg(F.count("*").alias("n"), F.count("v").alias("n_known"), r(F.avg("v"), "mean"), r(F.min("v"), "low"), r(F.max("v"), "high"))


# -- unions, first rows and ranks


@query("WITH u AS (SELECT 'train' AS split, doc_id, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'dev', doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'test', doc_id, lang FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, split, lang FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY split) = 1")
def union_keep_first(spark, d):
    """Three tagged splits as one table, of each document the first by split."""
    x = _t(spark, d, "documents").select("doc_id", "lang")
    tag = lambda name, keep: x.filter(keep).select(F.lit(name).alias("split"), "doc_id", "lang")
    u = tag("train", "doc_id % 3 <> 0").unionByName(tag("dev", "doc_id % 3 = 0")).unionByName(tag("test", "doc_id % 5 = 0"))
    return rules.first_seen(u, ["doc_id"], ["split"]).select("doc_id", "split", "lang")


@query(_W + ", a AS (SELECT grp, cid, p_strong, rank() OVER (PARTITION BY grp ORDER BY p_strong DESC)::INTEGER AS place FROM s) SELECT grp, cid, place FROM a WHERE place <= 3")
def competition_rank(spark, d):
    """Ranks within groups that ties share, the next rank skipped."""
    a = _scores(spark, d).select("grp", "cid", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("p_strong"))).alias("place"))
    return a.filter("place <= 3")


@query(_W + " (SELECT 'largest' AS side, cid, p_svm FROM s ORDER BY p_svm DESC, cid LIMIT 10) UNION ALL (SELECT 'smallest', cid, p_svm FROM s ORDER BY p_svm, cid LIMIT 10)")
def extremes(spark, d):
    """The ten largest and the ten smallest."""
    s = _scores(spark, d).select("cid", "p_svm")
    end = lambda n, o: s.orderBy(o, "cid").limit(10).select(F.lit(n).alias("side"), "cid", "p_svm")
    return end("largest", F.desc("p_svm")).unionByName(end("smallest", F.asc("p_svm")))


@query("WITH g AS (SELECT DISTINCT o_custkey AS grp FROM orders), x AS (SELECT grp, unnest(['supported', 'mild', 'strong', 'contradiction']) AS slot FROM g) SELECT grp, slot, grp || '-' || slot AS id FROM x")
def candidate_slots(spark, d):
    g = _t(spark, d, "orders").select(F.col("o_custkey").alias("grp")).distinct()
    x = g.withColumn("slot", F.explode(F.array(*map(F.lit, ("supported", "mild", "strong", "contradiction")))))
    return x.select("grp", "slot", F.concat("grp", F.lit("-"), "slot").alias("id"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'queue' END, CASE WHEN o_orderkey % 2 = 0 THEN 'review' END, 'errors') AS origin FROM orders")
def three_sources(spark, d):
    """A label from the first of three tables that has it; each lacks some candidates."""
    o = _t(spark, d, "orders").select("o_orderkey")
    a, b = o.filter("o_orderkey % 3 = 0").withColumn("a", F.lit("queue")), o.filter("o_orderkey % 2 = 0").withColumn("b", F.lit("review"))
    return o.join(a, "o_orderkey", "left").join(b, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b", F.lit("errors")).alias("origin"))


@query("WITH n AS (SELECT doc_id, 'S' || doc_id % 4 AS source_id FROM documents), e AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), g AS (SELECT 'S1' AS source_id) SELECT n.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'exact_filename' WHEN r.doc_id IS NOT NULL THEN 'recursive_filename' WHEN g.source_id IS NOT NULL THEN 'source_id_glob' ELSE 'missing' END AS method, CASE WHEN e.doc_id IS NOT NULL THEN 1.0 WHEN r.doc_id IS NOT NULL THEN 0.95 WHEN g.source_id IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM n LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN g USING (source_id)")
def source_inventory(spark, d):
    """How a paper's file was found, by the surest of three ways, and how sure that is."""
    n = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("S"), F.col("doc_id") % 4).alias("source_id"))
    e, r = n.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("e")), n.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("r"))
    g = spark.createDataFrame([("S1", 1)], "source_id string, g int")  # one row
    x = n.join(e, "doc_id", "left").join(r, "doc_id", "left").join(F.broadcast(g), "source_id", "left")
    pick = lambda *v: F.when(F.col("e").isNotNull(), v[0]).when(F.col("r").isNotNull(), v[1]).when(F.col("g").isNotNull(), v[2]).otherwise(v[3])
    return x.select("doc_id", pick("exact_filename", "recursive_filename", "source_id_glob", "missing").alias("method"), pick(1.0, 0.95, 0.9, 0.0).alias("confidence"))


@query("SELECT conv_id, turn, s[turn % len(s) + 1] AS word, len(s)::INTEGER AS n FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS s FROM conversations) WHERE len(s) > 0")
def indexed_rationales(spark, d):
    """Parts of a text named by their place in it, as evidence is by sentence number."""
    s = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    x = _t(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).filter("size(s) > 0")
    return x.select("conv_id", "turn", F.get("s", (F.col("turn") % F.size("s")).cast("int")).alias("word"), F.size("s").alias("n"))


# -- samples and splits

_SHARES = {0: 0.80, 1: 0.15, 3: 0.05}
_SIZES = {p: simulation.composition(p, 400, _SHARES) for p in (0.01, 0.05, 0.10)}


def _drawn_sql(sizes: dict[int, int], times: int) -> str:
    want = ", ".join(f"({k}, {v})" for k, v in sizes.items())
    return f"""pool AS (SELECT cid, label, pred, flag, row_number() OVER (PARTITION BY label ORDER BY cid) - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM x), want(label, size) AS (VALUES {want}), slot AS (SELECT label, i, b, n FROM want JOIN (SELECT DISTINCT label, n FROM pool) USING (label), unnest(range(0, size)) AS t(i), unnest(range(0, {times})) AS u(b))
, dr AS (SELECT b, slot.label, cid, pred, flag FROM slot JOIN pool ON pool.label = slot.label AND pool.at = (i * 48271 + b * 69621 + i * b * 16807) % slot.n)"""


@query(_PRED + ", " + _drawn_sql(_SIZES[0.05], 20) + " SELECT b, count(*) FILTER (label = 2 AND pred = 2) AS tp, count(*) FILTER (label <> 2 AND pred = 2) AS fp, count(*) FILTER (label = 2 AND pred <> 2) AS fn, count(*) FILTER (label <> 2 AND pred <> 2) AS tn, round(count(*) FILTER (label = 2 AND pred = 2)::DOUBLE / count(*) FILTER (label = 2), 6) AS recall, round(count(*) FILTER (label = 2 AND pred = 2)::DOUBLE / nullif(count(*) FILTER (pred = 2), 0), 6) AS precision, round(count(*) FILTER (label <> 2 AND pred = 2)::DOUBLE / nullif(count(*) FILTER (label = 2 AND pred = 2), 0), 6) AS fp_tp, round(count(*) FILTER (pred = 2)::DOUBLE / count(*), 6) AS burden, round(count(*) FILTER (pred = 2)::DOUBLE / nullif(count(*) FILTER (label = 2 AND pred = 2), 0), 6) AS nnr FROM dr GROUP BY b")
def screening_draws(spark, d):
    """Screening metrics of twenty resamples at a prevalence of one in twenty."""
    x = _predicted(spark, d)
    dr = simulation.drawn(x, "cid", "label", _SIZES[0.05], 20).join(x.select("cid", "pred"), "cid")
    return simulation.screening(dr, ["b"], F.col("label") == 2, F.col("pred") == 2)


@query(_PRED + ", " + _drawn_sql(_SIZES[0.10], 40) + ", m AS (SELECT b, count(*) FILTER (label = 2 AND pred = 2)::DOUBLE / count(*) FILTER (label = 2) AS recall, count(*) FILTER (label = 2 AND pred <> 2 AND flag = 1) AS captured FROM dr GROUP BY b) SELECT 'recall' AS metric, round(avg(recall), 6) AS mean, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.025), 6) AS low, round(quantile_cont(recall, 0.975), 6) AS high FROM m UNION ALL SELECT 'captured', round(avg(captured), 6), round(quantile_cont(captured, 0.5), 6), round(quantile_cont(captured, 0.025), 6), round(quantile_cont(captured, 0.975), 6) FROM m")
def screening_intervals(spark, d):
    """Recall, and positives that one method misses and the other catches, over forty resamples at a prevalence of one in ten."""
    x = _predicted(spark, d)
    dr = simulation.drawn(x, "cid", "label", _SIZES[0.10], 40).join(x.select("cid", "pred", "flag"), "cid")
    y, said = F.col("label") == 2, F.col("pred") == 2
    m = dr.groupBy("b").agg((F.count_if(y & said) / F.count_if(y)).alias("recall"), F.count_if(y & ~said & (F.col("flag") == 1)).cast("double").alias("captured"))
    return simulation.interval(m.unpivot(["b"], ["recall", "captured"], "metric", "value"), ["metric"], "value")


@query(_W + """, c AS (SELECT label, count(*) AS c FROM s GROUP BY label), p AS (SELECT prevalence, label, CASE WHEN label = 2 THEN 0 ELSE c END AS c, greatest(1, floor(400 * prevalence + 0.5::DOUBLE)) AS first FROM c, unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS t(prevalence))
, e AS (SELECT *, sum(c) OVER (PARTITION BY prevalence ORDER BY label) AS upto, sum(c) OVER (PARTITION BY prevalence) AS every FROM p)
SELECT prevalence, label, (CASE WHEN label = 2 THEN first ELSE floor((400 - first) * upto::DOUBLE / every + 0.5::DOUBLE) - floor((400 - first) * (upto - c)::DOUBLE / every + 0.5::DOUBLE) END)::BIGINT AS n FROM e""")
def sample_compositions(spark, d):
    """What samples of 400 are made of at three prevalences, other labels as in the table."""
    return simulation.compositions(_scores(spark, d), "label", 2, [0.01, 0.05, 0.10], 400)


@query(_W + f""", c AS (SELECT grp, label, count(*) AS n FROM s GROUP BY grp, label), p AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 9) AS part FROM c)
, o AS (SELECT grp, sum(n) AS n, arg_max(label, (part, -label)) AS own FROM p GROUP BY grp), m AS (SELECT grp, (sum(n) OVER (PARTITION BY own ORDER BY {_H.format('grp')}) - n / 2::DOUBLE) / sum(n) OVER (PARTITION BY own) AS middle FROM o)
SELECT grp, CASE WHEN middle < 0.6 THEN 'train' WHEN middle < 0.8 THEN 'dev' ELSE 'test' END AS split FROM m""")
def stratified_membership(spark, d):
    """Whole groups dealt to three splits, alike for every label."""
    return simulation.stratified_membership(_scores(spark, d).select("grp", "label"), "grp", "label", {"train": 0.6, "dev": 0.2, "test": 0.2})


@query(_W + f", r AS (SELECT cid, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format('cid')}, cid) AS place FROM s) SELECT cid, label, CASE WHEN place <= 24 THEN 'train' WHEN place <= 32 THEN 'dev' ELSE 'test' END AS split FROM r WHERE place <= 40")
def exact_splits(spark, d):
    """Of every label 24, 8 and 8 rows for the three splits."""
    return simulation.exact_splits(_scores(spark, d), "cid", "label", {"train": 24, "dev": 8, "test": 8})


@query(_W + ", g AS (SELECT grp, count(*) AS n FROM s GROUP BY grp), r AS (SELECT grp, row_number() OVER (ORDER BY n, grp) - 1 AS place FROM g) SELECT grp, ['train', 'train', 'train', 'dev', 'test'][place % 5 + 1] AS split FROM r")
def cyclic_splits(spark, d):
    """Groups dealt in order of size to a cycle of five."""
    g = _scores(spark, d).groupBy("grp").agg(F.count("*").alias("n"))
    return simulation.cyclic_splits(g, "grp", ["n"], ["train", "train", "train", "dev", "test"])


@query(_W + f", c AS (SELECT cid, label, entropy > 0.5 AS unsure, row_number() OVER (PARTITION BY label ORDER BY entropy > 0.5, {_H.format('cid')}, cid) AS rn FROM s) SELECT cid, label, unsure FROM c WHERE rn <= 4")
def trusted_sample(spark, d):
    """Four rows of every label, those without a flag first."""
    x = _scores(spark, d).select("cid", "label", (F.col("entropy") > 0.5).alias("unsure"))
    w = Window.partitionBy("label").orderBy("unsure", sampling.order_key(42, "cid"), "cid")
    return x.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").drop("rn")


@query(_W + ", b AS (SELECT cid, 'high_strong' AS bucket, p_strong AS v FROM s WHERE p_strong >= 0.9 UNION ALL SELECT cid, 'contra', p_contra FROM s WHERE p_contra >= 0.9 UNION ALL SELECT cid, 'unsure', entropy FROM s WHERE entropy >= 0.9) SELECT bucket, count(*) AS n, count(DISTINCT cid) AS n_ids, round(avg(v), 6) AS mean FROM b GROUP BY bucket")
def priority_buckets(spark, d):
    s = _scores(spark, d)
    part = lambda n, c: s.filter(F.col(c) >= 0.9).select("cid", F.lit(n).alias("bucket"), F.col(c).alias("v"))
    b = part("high_strong", "p_strong").unionByName(part("contra", "p_contra")).unionByName(part("unsure", "entropy"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("cid").alias("n_ids"), F.round(F.avg("v"), 6).alias("mean"))


# -- tables of metrics

_VIEWS = {"four": {0: "supported", 1: "mild", 2: "strong", 3: "contra"}, "binary": {0: "fine", 1: "issue", 2: "issue", 3: "issue"}, "strong": {0: "other", 1: "other", 2: "strong", 3: "other"}}


def _view_sql(c: str) -> str:
    return "CASE view " + " ".join(f"WHEN '{v}' THEN CASE {c} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in m.items()) + " END" for v, m in _VIEWS.items()) + " END"


@query(_PRED + f", m AS (SELECT label, unnest(['cascade', 'flagged']) AS method, unnest([pred, CASE WHEN flag = 1 THEN 2 ELSE 0 END]) AS said FROM x), v AS (SELECT *, unnest(['four', 'binary', 'strong']) AS view FROM m) SELECT view, method, {_view_sql('label')} AS truth, {_view_sql('said')} AS said, count(*) AS n FROM v GROUP BY ALL")
def taxonomy_views(spark, d):
    """Confusion counts of two methods under three groupings of the labels."""
    x = _predicted(spark, d).select(F.col("label").cast("long").alias("label"), F.col("pred").cast("long").alias("cascade"), F.when(F.col("flag") == 1, 2).otherwise(0).cast("long").alias("flagged"))
    return simulation.remapped(x, _VIEWS, "label", ["cascade", "flagged"])


@query(_PRED + ", m AS (SELECT unnest(['cascade', 'flagged']) AS method, unnest([pred, CASE WHEN flag = 1 THEN 2 ELSE 0 END]) AS said FROM x WHERE label = 2) SELECT method, count(*) FILTER (said = 0) AS \"0\", count(*) FILTER (said = 1) AS \"1\", count(*) FILTER (said = 2) AS \"2\", count(*) FILTER (said = 3) AS \"3\" FROM m GROUP BY method")
def predictions_of_strong(spark, d):
    """What each method says of the rows that are strong."""
    x = _predicted(spark, d).filter("label = 2").select(F.col("pred").cast("long").alias("cascade"), F.when(F.col("flag") == 1, 2).otherwise(0).cast("long").alias("flagged"))
    return x.unpivot([], ["cascade", "flagged"], "method", "said").groupBy("method").pivot("said", [0, 1, 2, 3]).count().fillna(0)


@query(_PRED + ", f AS (SELECT domain, label, unnest(list_filter([CASE WHEN bm25 < 10 THEN 'weak_retrieval' END, CASE WHEN entropy > 0.5 THEN 'uncertain' END, CASE WHEN n_words > 50 THEN 'long_evidence' END, CASE WHEN bm25 >= 10 AND entropy <= 0.5 AND n_words <= 50 THEN 'unexplained' END], lambda t: t IS NOT NULL)) AS cause FROM x WHERE pred = 2 AND label <> 2) SELECT domain, label, cause, count(*) AS n FROM f GROUP BY ALL")
def false_positive_causes(spark, d):
    weak, unsure, long_ = F.col("bm25") < 10, F.col("entropy") > 0.5, F.col("n_words") > 50
    causes = F.array_compact(F.array(F.when(weak, "weak_retrieval"), F.when(unsure, "uncertain"), F.when(long_, "long_evidence"), F.when(~weak & ~unsure & ~long_, "unexplained")))
    return _predicted(spark, d).filter("pred = 2 AND label <> 2").select("domain", "label", F.explode(causes).alias("cause")).groupBy("domain", "label", "cause").agg(F.count("*").alias("n"))


@query(_PRED + ", e AS (SELECT 'support_contradiction' AS task, label = 3 AS y, pred = 3 AS said FROM x WHERE label IN (0, 3) UNION ALL SELECT 'support_other', label <> 0, pred <> 0 FROM x) SELECT task, count(*) AS n, round(avg((y = said)::INTEGER), 6) AS accuracy, round(coalesce(2.0 * count(*) FILTER (y AND said) / nullif(count(*) FILTER (y) + count(*) FILTER (said), 0), 0), 6) AS f1 FROM e GROUP BY task")
def gold_tasks(spark, d):
    """Support against contradiction on rows of these two, and support against all others."""
    x = _predicted(spark, d)
    e = x.filter("label IN (0, 3)").select(F.lit("support_contradiction").alias("task"), (F.col("label") == 3).alias("y"), (F.col("pred") == 3).alias("said")).unionByName(x.select(F.lit("support_other").alias("task"), (F.col("label") != 0).alias("y"), (F.col("pred") != 0).alias("said")))
    f1 = F.round(F.coalesce(F.try_divide(2.0 * F.count_if(F.col("y") & F.col("said")), F.count_if("y") + F.count_if("said")), F.lit(0.0)), 6)
    return e.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("said")).cast("int")), 6).alias("accuracy"), f1.alias("f1"))


@query(_W + ", p AS (SELECT grp, avg(p_strong) FILTER (label = 0) AS a, avg(p_strong) FILTER (label = 3) AS b FROM s GROUP BY grp HAVING count(*) FILTER (label = 0) > 0 AND count(*) FILTER (label = 3) > 0), m AS (SELECT avg(b - a) AS delta, avg(((a >= 0.5) <> (b >= 0.5))::INTEGER) AS flips, avg((b > a)::INTEGER) AS sensitive FROM p) SELECT round(delta, 6) AS delta, round(flips, 6) AS flips, round(sensitive, 6) AS sensitive, CASE WHEN abs(delta) < 0.05 THEN 'high' WHEN abs(delta) < 0.15 THEN 'medium' ELSE 'low' END AS leakage_risk FROM m")
def evidence_sensitivity(spark, d):
    """How scores move between the supporting and the refuting rows of a group; hardly at all means that evidence is not read."""
    side = lambda v: F.avg(F.when(F.col("label") == v, F.col("p_strong")))
    p = _scores(spark, d).groupBy("grp").agg(side(0).alias("a"), side(3).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    m = p.agg(F.avg(F.col("b") - F.col("a")).alias("delta"), F.avg(((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).cast("int")).alias("flips"), F.avg((F.col("b") > F.col("a")).cast("int")).alias("sensitive"))
    risk = F.when(F.abs("delta") < 0.05, "high").when(F.abs("delta") < 0.15, "medium").otherwise("low")
    return m.select(F.round("delta", 6).alias("delta"), F.round("flips", 6).alias("flips"), F.round("sensitive", 6).alias("sensitive"), risk.alias("leakage_risk"))


@query(_W + ", c AS (SELECT domain, grp % 10 AS seed, avg(((flag = 1) = strong)::INTEGER) AS acc FROM s GROUP BY ALL) SELECT domain, count(*) AS n_seeds, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS std, round(min(acc), 6) AS low, round(max(acc), 6) AS high, bool_and(acc > 0.2) AS all_pass FROM c GROUP BY domain")
def seed_summary(spark, d):
    """Mean, spread and extremes over seeds of each configuration."""
    c = _scores(spark, d).groupBy("domain", (F.col("grp") % 10).alias("seed")).agg(F.avg(((F.col("flag") == 1) == F.col("strong")).cast("int")).alias("acc"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return c.groupBy("domain").agg(F.count("*").alias("n_seeds"), r(F.avg("acc"), "mean"), r(F.stddev_samp("acc"), "std"), r(F.min("acc"), "low"), r(F.max("acc"), "high"), F.bool_and(F.col("acc") > 0.2).alias("all_pass"))


@query(_PRED + ", t AS (SELECT grp, cid, (pred = label)::INTEGER AS local, (flag = 1) = (label = 2) AS llm FROM x), e AS (SELECT cid, grp, CASE WHEN llm AND local = 0 THEN 'llm_claim_only_correct_ce_wrong' WHEN local = 1 AND NOT llm THEN 'local_claim_only_advantage' ELSE 'none' END AS pattern FROM t), p AS (SELECT *, 2 + CASE pattern WHEN 'llm_claim_only_correct_ce_wrong' THEN 4 WHEN 'local_claim_only_advantage' THEN 3 ELSE 0 END AS priority FROM e) SELECT priority::INTEGER AS priority, CASE pattern WHEN 'llm_claim_only_correct_ce_wrong' THEN 'rewrite_claim_to_force_evidence_comparison' WHEN 'local_claim_only_advantage' THEN 'reduce_claim_only_surface_cues' ELSE 'review_only' END AS action, count(*) AS n, min(cid) AS first_cid FROM p GROUP BY ALL")
def repair_queue(spark, d):
    """Priority and action of the repair of claims that are right without their evidence."""
    right, llm = F.col("pred") == F.col("label"), (F.col("flag") == 1) == (F.col("label") == 2)
    pattern = F.when(llm & ~right, "llm").when(right & ~llm, "local").otherwise("none")
    x = _predicted(spark, d).select("cid", pattern.alias("pattern"))
    priority = 2 + F.when(F.col("pattern") == "llm", 4).when(F.col("pattern") == "local", 3).otherwise(0)
    action = F.when(F.col("pattern") == "llm", "rewrite_claim_to_force_evidence_comparison").when(F.col("pattern") == "local", "reduce_claim_only_surface_cues").otherwise("review_only")
    return x.groupBy(priority.alias("priority"), action.alias("action")).agg(F.count("*").alias("n"), F.min("cid").alias("first_cid"))


@query("WITH p AS (SELECT source, count(*) AS n_rows, avg((coalesce(text, '') <> '' AND coalesce(lang, '') <> '')::INTEGER) AS complete, bool_or(quality IS NOT NULL) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT source, n_rows, round(complete, 6) AS complete, (CASE WHEN n_rows >= 100 THEN 20 WHEN n_rows >= 50 THEN 10 ELSE 0 END + CASE WHEN labelled THEN 8 ELSE 0 END + CASE WHEN complete >= 0.9 THEN 15 ELSE 0 END)::INTEGER AS score, CASE WHEN n_rows >= 100 AND complete >= 0.9 AND labelled THEN 'possible_source_pool' WHEN n_rows >= 50 AND labelled THEN 'needs_trace_check' WHEN n_rows >= 10 AND complete >= 0.9 THEN 'small_complete_pool' ELSE 'low_priority' END AS role FROM p")
def source_pool(spark, d):
    """Size, completeness, score and role of every source of documents."""
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    p = x.groupBy("source").agg(F.count("*").alias("n_rows"), validation.completeness(x, ["text", "lang"]).alias("complete"), F.bool_or(F.col("quality").isNotNull()).alias("labelled"))
    n, c, y = F.col("n_rows"), F.col("complete"), F.col("labelled")
    score = F.when(n >= 100, 20).when(n >= 50, 10).otherwise(0) + F.when(y, 8).otherwise(0) + F.when(c >= 0.9, 15).otherwise(0)
    role = F.when((n >= 100) & (c >= 0.9) & y, "possible_source_pool").when((n >= 50) & y, "needs_trace_check").when((n >= 10) & (c >= 0.9), "small_complete_pool").otherwise("low_priority")
    return p.select("source", "n_rows", F.round("complete", 6).alias("complete"), score.alias("score"), role.alias("role"))


@query("WITH v AS (SELECT conv_id, count(*) AS n, count(DISTINCT md5(coalesce(text, ''))) AS n_texts, count(DISTINCT role) AS n_roles, max(length(text)) - min(length(text)) AS gap FROM conversations GROUP BY conv_id) SELECT conv_id, n, n - n_texts AS duplicates, n_roles, gap::INTEGER AS gap, n = n_texts AND n_roles > 1 AS valid FROM v")
def group_validation(spark, d):
    """Repeated texts, roles and spread of lengths of every group."""
    g = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct(F.md5(F.coalesce("text", F.lit("")))).alias("n_texts"), F.count_distinct("role").alias("n_roles"), (F.max(F.length("text")) - F.min(F.length("text"))).alias("gap"))
    return g.select("conv_id", "n", (F.col("n") - F.col("n_texts")).alias("duplicates"), "n_roles", "gap", ((F.col("n") == F.col("n_texts")) & (F.col("n_roles") > 1)).alias("valid"))


@query("WITH c AS (SELECT 'texts' AS name, count(*) FILTER (text IS NULL) = 0 AS ok FROM documents UNION ALL SELECT 'ids', count(*) = count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'labels', count(*) FILTER (quality NOT IN (0, 1)) = 0 FROM labels) SELECT name, ok, CASE WHEN (SELECT bool_and(ok) FROM c) THEN 'pass' ELSE 'fail' END AS status FROM c")
def final_gate(spark, d):
    """Checks of a run and their roll-up."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    one = lambda df, n, c: df.agg(c.alias("ok")).select(F.lit(n).alias("name"), "ok")
    c = one(docs, "texts", F.count_if(F.col("text").isNull()) == 0).unionByName(one(docs, "ids", F.count("*") == F.count_distinct("doc_id"))).unionByName(one(labels, "labels", F.count_if(~F.col("quality").isin(0, 1)) == 0))
    return c.crossJoin(F.broadcast(c.agg(F.bool_and("ok").alias("all_ok")))).select("name", "ok", F.when(F.col("all_ok"), "pass").otherwise("fail").alias("status"))


@query(r"WITH l AS (SELECT doc_id, i, p[i] AS line, lag(p[i]) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i)) SELECT doc_id, count(*) FILTER (regexp_matches(lower(line), '\b(not|never|without)\b')) AS negated, count(*) FILTER (NOT regexp_matches(lower(line), '\b(not|never|without)\b') AND regexp_matches(lower(coalesce(before, '')), '\b(not|never|without)\b')) AS after_negated, count(*) AS n FROM l WHERE contains(lower(line), 'licen') GROUP BY doc_id")
def finding_lines(spark, d):
    """Lines with a keyword, by whether they or the line before them negate it."""
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("before", F.coalesce(F.lag("line").over(w), F.lit("")))
    neg = lambda c: F.rlike(F.lower(c), F.lit(X.edged(r"\b(not|never|without)\b")))
    hit = lines.filter(F.contains(F.lower("line"), F.lit("licen")))
    return hit.groupBy("doc_id").agg(F.count_if(neg("line")).alias("negated"), F.count_if(~neg("line") & neg("before")).alias("after_negated"), F.count("*").alias("n"))


@query(rf"SELECT doc_id, lower(lang) AS tag, {_WORDS.format('text')}::INTEGER AS n_words, md5(trim(regexp_replace(coalesce(text, ''), '^[A-Za-z]+:\s*', ''))) AS stripped FROM documents")
def stripped_prefixes(spark, d):
    """Texts without a leading word and colon."""
    return _t(spark, d, "documents").select("doc_id", F.lower("lang").alias("tag"), X.count_words(F.col("text")).alias("n_words"), F.md5(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[A-Za-z]+:\s*", ""))).alias("stripped"))
