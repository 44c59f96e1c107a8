"""Odd inputs of the operators for training text: look-alike hashes, repeated ids, clashing columns, hot keys, long strings."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, embeddings, licenses, minhash, mixing, pii, quality, repeats
from tessera.llm.hashing import roots

ABC = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return " ".join("".join(rng.choices(ABC, k=rng.randint(2, 9))) for _ in range(n))


def thue_morse(bits):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_minhash_keeps_words_apart_that_sums_of_powers_confuse(spark):
    rows = []
    for bits in (10, 11, 12):
        for x in thue_morse(bits):
            rows += [x, f"one two {x} three four five six"]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)
    assert [r.n_shingles for r in sorted(got)] == [1, 3] * 6


def test_repeats_compares_bytes(spark):
    texts = [x for bits in (9, 10) for x in thue_morse(bits)]
    rng = random.Random(3)
    texts += ["".join(rng.choices("xyz", k=300)) + x + "".join(rng.choices("xyz", k=300)) for x in texts]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for t in texts:
        gone = {j for i in range(len(t) - 199) if count[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        want.append((len(gone), hashlib.sha256("".join(c for i, c in enumerate(t) if i not in gone).encode()).hexdigest()))
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == want


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (3, ""), (3, ""), (None, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("rid"), F.lit(2).alias("gone"), F.lit(3).alias("root"), F.lit(4).alias("set_key"))
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (3, ""), (3, "")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]


def test_minhash_hot_set_and_list(spark):
    rng = random.Random(4)
    base = words(rng, 300).split()
    texts = [" ".join(base)] * 1500 + [" ".join([*base[:i], "zz", *base[i + 1 :]]) for i in range(200)] + [words(rng, 40) for _ in range(50)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter(r.component_id == 0 for r in got) == {True: 1700, False: 50}


def test_minhash_order_of_words_counts(spark):
    five = "alpha beta gamma delta omega".split()
    texts = [" ".join(p) for p in itertools.permutations(five)]
    got = minhash.shingle_sets([t.encode() for t in [*texts, *texts, texts[0].upper(), "alpha beta gamma delta", " alpha\tbeta gamma\x0bdelta "]])
    assert len({g.tobytes() for g in got}) == len(texts) + 1 and {len(g) for g in got} == {1}


@pytest.mark.parametrize("least, percent", [(40, 85), (9, 60), (1, 10), (0, 10)])
def test_minhash_merging_finds_what_all_pairs_find(least, percent):
    rng = np.random.default_rng(least)
    for _ in range(30):
        n, kinds = int(rng.integers(2, 60)), int(rng.integers(1, 6))
        base = rng.integers(0, 256, (kinds, 63), dtype=np.uint8)
        sketch = base[rng.integers(0, kinds, n)].copy()
        noise = rng.random(sketch.shape) < rng.random((n, 1)) * 0.7
        sketch[noise] = rng.integers(0, 256, int(noise.sum()))
        pool = rng.integers(1, 1 << 62, 40, dtype=np.uint64)
        shingles = np.empty(n, object)
        shingles[:] = [np.unique(rng.choice(pool, int(rng.integers(20, 40)), replace=False)) for _ in range(n)]
        rows = {"id": np.arange(n) * 3 + 5, "n": np.array([len(x) for x in shingles]), "sketch": sketch}
        for full in (False, True):
            cols = rows | ({"shingles": shingles} if full else {})
            side = rng.random(n) < 0.5
            for split in (False, True):
                cut = [{k: v[m] for k, v in cols.items()} for m in (side, ~side)]
                if split and not (len(cut[0]["id"]) and len(cut[1]["id"])):
                    continue
                a, b = minhash._links(*cut, least, percent) if split else minhash._links(cols, None, least, percent)
                want = []
                for i, j in itertools.combinations(range(n), 2):
                    common = len(np.intersect1d(shingles[i], shingles[j]))
                    small, large = sorted((len(shingles[i]), len(shingles[j])))
                    near = (sketch[i] == sketch[j]).sum() >= least and 100 * small >= percent * large
                    if near and (not split or side[i] != side[j]) and (not full or 100 * common >= percent * (small + large - common)):
                        want.append((i, j))
                x, y = np.array(want, np.int64).reshape(-1, 2).T
                got = roots(n, (a - 5) // 3, (b - 5) // 3)
                assert np.array_equal(got, roots(n, x, y)) and len(a) < n


def test_components_of_chains_and_cliques(spark):
    rng = random.Random(8)
    names = rng.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[i], names[j]) for i in range(200, 215) for j in range(200, 215)] + [(names[i], names[rng.randrange(230, 400)]) for i in range(230, 330)]
    at = {v: i for i, v in enumerate(sorted(names))}
    want = roots(400, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    back = sorted(names)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges for v in (a, b) if a != b}
    assert got == {v: back[want[at[v]]] for v in linked}


def test_components_of_a_hub(spark):
    edges = spark.range(1, 20_001).select(F.lit(50_000).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(7).cast("long").alias("b")))
    got = common.components(edges).agg(F.count("*"), F.max("component"), F.count_distinct("id")).first()
    assert tuple(got) == (20_002, 0, 20_002)


def test_join_counted_is_a_join(spark):
    rows = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.range(3000).select(F.lit(100).cast("long").alias("k"), F.col("id").alias("v")))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).filter("k != 2")
    want = sorted(map(tuple, rows.join(sizes, "k").select("k", "v", "n", "m").collect()))
    assert sorted(map(tuple, common.join_counted(rows, sizes, ["k"], "n", 8000).select("k", "v", "n", "m").collect())) == want


def test_embeddings_of_repeated_rows_and_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])] + [(i, [3.0, 3.0]) for i in range(10, 1500)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", "embedding", F.lit("x").alias("id"), F.lit(1).alias("n"), F.lit(2).alias("root"), F.lit(0).alias("component"))
    got = sorted(tuple(r) for r in embeddings.near_vectors(docs).collect())
    assert got[:5] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True)]
    assert got[5:] == [(i, 1489, 10, i == 10) for i in range(10, 1500)]


def test_embeddings_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STRETCH_BYTES", 1 << 10)
    g = np.random.default_rng(2)
    x = np.repeat(g.normal(size=(500, 8)), 4, 0) + 0.15 * g.normal(size=(2000, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want.tolist()


@pytest.mark.parametrize("most", [10_000, 1])
def test_mixing_with_rare_sources_and_odd_columns(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = spark.range(4000).select("id", F.when(F.col("id") < 2, "rare").when(F.col("id") < 1500, "some").alias("source"), F.lit("t").alias("text"))
    docs = docs.select(F.col("id").alias("doc_id"), "source", "text", *[F.lit(i).alias(f"mix_{c}") for i, c in enumerate(("source", "cdf", "parts", "salt", "at", "times", "copy", "key"))])
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns[:-2], "mix_copy", "mix_key"]
    rows = got.collect()
    assert {(r.mix_source, r.mix_cdf, r.mix_parts, r.mix_salt, r.mix_at, r.mix_times) for r in rows} == {(0, 1, 2, 3, 4, 5)}
    n = Counter(r.source for r in rows)
    assert all(abs(n[s] - 4000 / 3) < 250 for s in ("rare", "some", None))
    table = mixing.rates(docs).collect()
    assert all(len(r.cdf) <= mixing.LAST and r.rate / r.parts <= mixing.PART for r in table) and max(r.parts for r in table) > 1
    twice = docs.unionByName(docs.filter("doc_id = 1"))
    again = Counter(r.doc_id for r in mixing.mix(twice, seed=1).filter("doc_id < 2").collect())
    assert again[1] % 2 == 0 and again[1] > 0


def test_pii_long_strings_and_odd_columns(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(9)]
    long = ["q7" * 150, "k" * 70 + "9", "a" * 300 + "-" + "b7" * 20]
    mark = "w" * 60
    texts = [f'login key = "{k}" end' for k in keys] + [f'login key = "{k}" end' for k in long] + [f"{mark} :::::::::::: {k} end" for k in keys] + [f"{mark} :::::::::::: {long[0]} end", f"x{mark} :::::::::::: {long[1]}z1 end", f"{mark} ::: {long[1]}z2 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.lit("k").alias("pii_key"), F.lit(7).alias("pii_spans"))
    got = [r.spans for r in pii.report(docs).orderBy("doc_id").collect()]
    assert got[9:12] == [f"id:13:{13 + len(k)}" for k in long]
    assert got[21] == f"id:74:{74 + 300}" and got[22] == "" and got[23] == ""
    red = pii.redact(docs)
    assert red.columns == docs.columns and {(r.pii_key, r.pii_spans) for r in red.collect()} == {("k", 7)}


def plain_base(t):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0, 9 <= len(d) <= 15][k]
            if ok:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_pii_base_against_plain_version(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", " ", "x", "é", "-", "+", "7", "00", "a@b", "\n", "𝔘"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert r.base_sha256 == hashlib.sha256(plain_base(t).encode()).hexdigest(), t


def test_licenses_of_repeated_rows_and_scattered_shingles(spark):
    full = licenses.TEMPLATES["mit-text"]
    w = re.findall(licenses.WORD, full.lower())
    apart = " ".join(" ".join(w[i : i + 5]) + f" pad{i}" for i in range(len(w) - 4))
    rows = [(1, full), (1, full), (2, full.upper()), (3, apart), (4, "x " * 50_000 + full), (5, "Released under the MIT License"), (6, "a released under the MIT License b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("h"), F.lit(1).alias("own"), F.lit(1).alias("license"), F.lit(1).alias("k"))
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    assert {k for k in got if k[1] != "mit-grant"} == {*((i, "mit-text") for i in (1, 2, 3, 4)), (5, "mit"), (6, "mit")}
    assert got[1, "mit-text"].containment == got[3, "mit-text"].containment == 1.0 and got[4, "mit-text"].start_word == 50_000
    assert licenses.scan(docs, {}).count() == 0
    nameless = spark.createDataFrame([(None, full), (None, full), (None, "one " + full), (None, "two three " + full)], "doc_id long, text string")
    assert sorted(r.start_word for r in licenses.scan(nameless).filter("license = 'mit-text'").collect()) == [0, 1, 2]


def test_quality_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(none, labels).count() == 0
    rows = spark.createDataFrame([(1, "x" * 3_000_000), (2, None)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = quality.score_documents(rows, labels).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
