"""Each stage of the pipeline against a plain version, on a small table with nulls, repeats and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, mixing, pii, quality

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = ("score", "predicted", "pii_key", "pii_spans", "mix_source", "mix_times", "mix_copy", "mix_key", "gone_id", "rid", "root", "component_id", "n_shingles", "piece_ids", "quality_text", "mix_row")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [words(rng, 60) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", None, "", "  ", words(rng, 30_000), "mail me a.b@cd.ef now", words(rng, 3)]
    rows = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], "en", "a", 1), (None, texts[3], "en", "b", 1), (3, "another text of one id", "en", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD)])


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_every_stage_takes_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_quality_filter(spark, docs):
    got = corpus_pipeline.quality_filter(spark, docs, SF)
    assert got.columns == docs.columns
    sample, share = quality.labelled_sample(docs.select("doc_id", "text"), common.table(spark, SF, "labels"), quality.Settings())
    model = quality.fit(sample, share, quality.Settings())
    want = Counter({r: n for r, n in bag(docs).items() if model.score(r[1] or "") >= 0.7})
    assert bag(got) == want


def test_near_duplicates(spark, docs):
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    sets, low = [], []
    rows = sorted(docs.filter("doc_id is not null").collect(), key=lambda r: r.doc_id)
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
        near = [low[i] for i, s in enumerate(sets[:-1]) if s and 100 * len(s & sets[-1]) >= 80 * len(s | sets[-1])]
        low.append(min(near, default=len(low)))
    want = Counter(tuple(r) for i, r in enumerate(rows) if low[i] == i) + bag(docs.filter("doc_id is null"))
    assert bag(got) == want and len(rows) > got.count() - 1


def test_redact(spark, docs):
    got = corpus_pipeline.redact(spark, docs, SF)
    assert got.columns == docs.columns and got.count() == docs.count()
    spans = {}
    for r in pii.report(docs).collect():
        spans.setdefault(r.doc_id, set()).add(r.spans)

    def plain(r):
        for s in spans[r.doc_id]:
            t, at, out = r.text or "", 0, ""
            for kind, a, b in (x.split(":") for x in s.split(",") if x):
                out, at = (out + t[at : int(a)] + f"[{kind.upper()}]" if int(a) >= at else out), max(at, int(b))
            yield None if r.text is None else out + t[at:]

    texts = {i: {x for r in docs.collect() if r.doc_id == i for x in plain(r)} for i in spans}
    assert all(r.text in texts[r.doc_id] for r in got.collect())
    assert any(r.text == "mail me [EMAIL] now" and r.n_chars == 19 for r in got.collect())


def test_mix_sources(spark, docs):
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns
    rates = {r.source: r for r in mixing.rates(docs).collect()}
    us = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), 0).alias("u")).collect()}
    want = Counter()
    for r, n in bag(docs).items():
        if k := sum(c <= us[r[0]] for c in rates[r[3]].cdf):
            want[r] = k * n
    assert bag(got) == want


def test_encode(spark, docs):
    got = corpus_pipeline.encode(spark, docs, SF)
    assert got.count() == docs.count() and got.filter("NOT round_trip OR n_pieces != size(piece_ids)").count() == 0
    assert {r.n_pieces for r in got.filter("doc_id = 32").collect()} == {0}


def test_run_keeps_only_what_it_reads(spark):
    before = common.standing()
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert common.standing() == before + 1
