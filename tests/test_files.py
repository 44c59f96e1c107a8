"""File sources and sinks on small files made here, and operators without SQL against plain versions."""

import hashlib
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import ordinal, retrieval, sampling, simulation
from tessera.sources import store, tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_xlsx(spark, tmp_path):
    sheet = f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x &amp; y</t></is></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3"><v>3.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = [(r.name, r.row, list(r.cells)) for r in store.read_xlsx(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [("a.xlsx", 0, ["name", "", "x & y"]), ("a.xlsx", 2, ["", "3.5"])]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "f.npz", a=np.arange(6.0).reshape(3, 2), b=np.array([7, 8]))
    got = [(r.array, r.row, list(r["values"])) for r in store.read_npz(spark, str(tmp_path)).orderBy("array", "row").collect()]
    assert got == [("a", 0, [0.0, 1.0]), ("a", 1, [2.0, 3.0]), ("a", 2, [4.0, 5.0]), ("b", 0, [7.0, 8.0])]


def test_pdf(spark, tmp_path):
    one, two = b"BT /F1 12 Tf (Hello \\(there\\)) Tj T* (second line) Tj ET", zlib.compress(b"BT [(Page) -200 ( two)] TJ ET")
    body = b"%PDF-1.4\n<< /Length 9 >>\nstream\n" + one + b"\nendstream\n<< /Filter /FlateDecode >>\nstream\n" + two + b"\nendstream\n<< /Length 3 >>\nstream\nabc\nendstream\n"
    (tmp_path / "p.pdf").write_bytes(body)
    got = [(r.page_number, r.page_text) for r in store.read_pdf(spark, str(tmp_path)).orderBy("page_number").collect()]
    assert got == [(1, "Hello (there)\nsecond line"), (2, "Page two")]
    assert store.read_pdf(spark, str(tmp_path), max_pages=1).count() == 1
    assert store.read_pdf(spark, str(tmp_path), parse=lambda b: [(1, str(len(b)))]).first().page_text == str(len(body))


def test_inventory_manifest_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "late_threshold.txt").write_text("one\ftwo\nlines")
    (tmp_path / "other.txt").write_text("z")
    (tmp_path / "empty.txt").write_text("")
    got = {r.name: (r.length, r.sha256) for r in store.manifest(spark, str(tmp_path)).collect()}
    assert got["other.txt"] == (1, hashlib.sha256(b"z").hexdigest()) and len(got) == 2
    assert [(r.name, list(r.hits)) for r in store.inventory(spark, str(tmp_path), ["late", "threshold", "zip"]).collect()] == [("late_threshold.txt", ["late", "threshold"])]
    private = spark.createDataFrame([(got["other.txt"][1],)], "sha256 string")
    assert [r.name for r in store.known_hashes(store.manifest(spark, str(tmp_path)), private).collect()] == ["other.txt"]
    pages = tables.read_pages(spark, str(tmp_path)).filter("path LIKE '%late%'").orderBy("page_number").collect()
    assert [(r.page_number, r.page_text) for r in pages] == [(0, "one"), (1, "two\nlines")]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text('{"a": 1, "b": [true, "x"]}')
    assert store.read_yaml(str(tmp_path / "c.yaml")) == {"a": 1, "b": [True, "x"]}


@pytest.mark.parametrize(("dedup", "room"), [(False, 500_000), (True, 3)])
def test_bm25_against_plain_version(spark, monkeypatch, dedup, room):
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", room)
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon the of zeta".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)] + [(60, None)]
    claims = [(i, " ".join(rng.choices([*words, "unseen"], k=6))) for i in range(7)] + [(7, ""), (8, "the of"), (9, None)]
    stop = ["the", "of"]
    toks = {i: [w for w in re.findall(K.PATTERNS["hyphen"], t or "") if w not in stop] for i, t in docs}
    df = Counter(w for t in toks.values() for w in set(t))
    # a missing text is a document of no words
    mean, n = sum(map(len, toks.values())) / len(docs), len(docs)
    want = {}
    for c, q in claims:
        terms = [w for w in (q or "").split() if w not in stop]
        terms = list(dict.fromkeys(terms)) if dedup else terms
        scores = []
        for i, t in toks.items():
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms if w in t)
            if s > 0:
                scores.append((-round(s, 4), i))
        want |= {(c, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scores)[:5])}
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), ["doc_id"], "text", spark.createDataFrame(claims, "item_id long, text string"), "item_id", "text", top=5, dedup_query=dedup, stop=stop).collect()
    assert {(r.item_id, r.rank): (r.doc_id, pytest.approx(r.score, abs=1e-4)) for r in got} == want


def test_bm25_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for units, claims in ((none, one), (one, none), (none, none)):
        assert retrieval.bm25(units, ["doc_id"], "text", claims.withColumnRenamed("doc_id", "item_id"), "item_id", "text").count() == 0


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(g, x, rng.randint(0, 9)) for g in "ab" for x in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    got = {(r.g, r.x): r.s for r in ordinal.running(df, "x", {"v": "s"}, within=("g",)).collect()}
    for g, x, _ in rows:
        assert got[g, x] == sum(v for h, y, v in rows if h == g and y >= x)
    assert [r._place for r in ordinal.places(df.filter("g = 'a'"), "x").orderBy("x").collect()] == list(range(1, 501))
    assert [r._place for r in sampling.hashed_places(df.filter("g = 'a'").select("x"), "x").orderBy(sampling.order_key(42, "x")).collect()] == list(range(1, 501))
    assert ordinal.running(df.limit(0), "x", {"v": "s"}).count() == 0
    for kind in ("string", "decimal(12,2)", "timestamp"):
        typed = df.filter("g = 'b'").withColumn("x", F.col("x").cast(kind))
        order = sorted(typed.collect(), key=lambda r: r.x)
        got = {r.x: r.s for r in ordinal.running(typed, "x", {"v": "s"}, descending=False, ranges=8).collect()}
        assert [got[r.x] for r in order] == np.cumsum([r.v for r in order]).tolist()


def test_stratified_membership_keeps_groups_whole_and_shares_near(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice("aaabbc")) for g in range(400) for _ in range(rng.randint(1, 5))]
    shares = {"train": 0.5, "dev": 0.25, "test": 0.25}
    df = spark.createDataFrame([(g, ord(v)) for g, v in rows], "grp long, label int")
    got = {r.grp: r.split for r in simulation.stratified_membership(df, "grp", "label", shares).collect()}
    assert set(got) == {g for g, _ in rows}
    for v in "abc":
        have = Counter(got[g] for g, x in rows if x == v)
        assert all(abs(have[s] / have.total() - share) < 0.08 for s, share in shares.items())
    assert simulation.stratified_membership(df.limit(0), "grp", "label", shares).count() == 0


def test_composition():
    for p in (0.001, 0.01, 0.5, 1.0):
        assert sum(simulation.composition(p, 400, {0: 0.80, 1: 0.15, 3: 0.05}).values()) == 400


def test_labels_that_contradict_tiers(spark):
    df = spark.createDataFrame([(1, 1, 3, 2), (2, 0, 3, 2), (3, None, 3, 2)], "k long, label int, c int, s int")
    assert [r.k for r in ordinal.label_conflicts(df, "label", "c", "s").collect()] == [2]
    assert [r.x for r in df.orderBy("k").select(ordinal.fill_label(F.col("label"), F.col("c"), F.col("s")).alias("x")).collect()] == [1, 0, 1]
