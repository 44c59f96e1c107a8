"""Operators for training text against brute force, on small tables with nulls, empties, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, jpeg, licenses, media, minhash, mixing, pii, quality, repeats, tokens, unigram
from tessera.llm.common import components

P = pytest.importorskip("public_tokenizers")
rng = random.Random(5)
WORDS = "alpha beta gamma delta the of and Über naïve 12 x7 running-fast don't 'street".split()


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


BASE = prose(120)
TEXTS = [None, "", " \n\t ", "one two", "one two", BASE, BASE, BASE + " tail", BASE.replace("alpha", "omega", 2), "x" * 700, prose(400), "é☃𝔘 <|endoftext|> ÀÀ", "mail a.b@c.de, 10.2.3.4 and 1.2.3.999 call +1 (555) 123-4567 card 4111 1111 1111 1111 token = \"" + "0f" * 20 + "\""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 2}" if i else None, 1, 2.0) for i, t in enumerate(TEXTS)] + [(None, "no id", "src0", 1, 2.0), (5, BASE, "src1", 1, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = tokens.token_counts(docs, path).collect()
    assert len(got) == docs.count() and tokens.token_counts(none, path).count() == 0
    for r in got:
        t = {**dict(enumerate(TEXTS)), None: "no id"}[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids))


def test_embeddings(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=(40, 8))
    x = np.concatenate((base, base[:20] + 0.1 * g.normal(size=(20, 8)), base[:5], base[:2] * 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [None] * 8), (104, [1.0, 2.0]), (105, []), (None, base[0].tolist())]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    for i in range(len(x)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id) == (near[i].sum(), min(seen))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(100, 106))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_many_lengths(spark):
    two = spark.range(4400).select((F.col("id") % 2200).cast("int").alias("dim")).filter("dim < 1100 or dim % 2 = 0").dropDuplicates(["dim"])
    reps = two.unionByName(two.filter("dim < 1100"))
    assert embeddings._lengths(reps) == list(range(1100))
    rows = [(d, [1.0] * d) for d in range(1, 1051)] + [(5000 + d, [1.0] * (d - 1) + [1.01]) for d in (2, 1050)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (0, i) for i, _ in rows}, 2: (1, 2), 5002: (1, 2), 1050: (1, 1050), 6050: (1, 1050)}


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash(spark, docs, none):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and minhash.near_duplicates(none).count() == 0
    sets = {i: shingle_set(t) for i, t in enumerate(TEXTS)}
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    left = minhash.one_of_each(docs, 80)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.filter("doc_id between 3 and 8").collect()) == [3, 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def best_path(uni, text):
    data, best = text.encode(), {0: (0.0, [])}
    keys = {p.encode(): i for i, (p, k) in enumerate(zip(uni.m["pieces"], uni.m["kinds"])) if k in (1, 4)}
    for at in range(len(data)):
        if at not in best or data[at] & 0xC0 == 0x80:
            continue
        s, ids = best[at]
        step = next(n for n in (1, 2, 3, 4) if at + n == len(data) or data[at + n] & 0xC0 != 0x80)
        for end in range(at + 1, min(len(data), at + 64) + 1):
            if (v := keys.get(data[at:end])) is not None and (end not in best or s + uni.scores[v] > best[end][0]):
                best[end] = (s + uni.scores[v], [*ids, v])
        if data[at : at + step] not in keys and (at + step not in best or s + uni.low > best[at + step][0]):
            best[at + step] = (s + uni.low, ids + [uni.bytes_at[x] for x in data[at : at + step]])
    return best[len(data)][1]


def test_unigram(spark, docs, none):
    path = P.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        uni = unigram.Unigram(unigram.read_model(f.read()))
    for t in (prose(12), "  two  spaces\n", "é☃𝔘", "a" * 70):
        assert list(uni.encode(t)) == best_path(uni, (" " + t).replace(" ", unigram.MARK))
        assert uni.decode(uni.encode(t)) == t
    assert uni.decode([uni.bytes_at[0xE2], uni.bytes_at[0x98]]) == "��"
    both = unigram.decode_documents(unigram.encode_documents(docs, path), path)
    assert all(r.decoded == (r.text or "") for r in both.collect())
    assert unigram.encode_documents(none, path).count() == 0
    marked = docs.withColumn("text", F.when(F.col("doc_id") == 5, unigram.MARK).otherwise(F.col("text"))).withColumn("same", F.lit("x"))
    coded = unigram.encode_documents(marked, path, same="same").collect()
    assert {r.same for r in coded if r.doc_id != 5} == {True} and {r.same for r in coded if r.doc_id == 5} == {False}


def test_quality(spark):
    good = [prose(60) for _ in range(80)]
    bad = ["$$$ ### %%% " * rng.randint(5, 30) + prose(5) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (None, good[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 160]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 10 and sum((r.score > 0.5) == (r.doc_id < 80) for r in held) >= 0.9 * len(held)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_mixing(spark, none):
    docs = spark.createDataFrame([(i, "t", "a" if i % 3 else None) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, {"a": 0.25, "": 0.75}, seed=3)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 750) < 120 and abs(n[None] - 2250) < 200
    assert mixing.mix(none).count() == 0 and set(r.source for r in mixing.mix(docs, {"a": 1.0}).collect()) == {"a"}
    big = [r.cdf for r in mixing.rates(docs, {"a": 1.0}, size=900.0).filter("source = 'a'").collect()][0]
    assert abs(big[-1] - 1) < 1e-9


@pytest.mark.parametrize("data", [b"", b"abc", bytes(range(256)) * 20, bytes([128]) * 900, bytes(random.Random(1).choices([126, 127, 128, 129, 130], k=6000)), bytes(random.Random(2).choices([128] * 40 + [127, 129, 3, 250], k=9000))])
def test_jpeg(data):
    raw = media.padded(data)
    img = jpeg.parse(jpeg.encode(raw))
    planes = jpeg.coefficients([img])[0]
    assert jpeg.payload(img, planes) == raw
    pic = jpeg.rgb(img, planes)
    assert pic.shape == (img.height, img.width, 3)
    c = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for k in range(8)] for x in range(8)])
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = planes[0][0]
    want = np.clip(np.round(c @ block.reshape(8, 8) @ c.T + 128), 0, 255)
    assert np.abs(jpeg.samples(planes[0][:1], img.quant[0])[0] - want).max() <= 1


def test_media(spark, docs, none):
    got = media.report(docs).collect()
    assert len(got) == docs.count() and media.report(none).count() == 0
    for r in got:
        t = ({**dict(enumerate(TEXTS)), None: "no id"}[r.doc_id] or "").encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    pics = media.tensors(media.store(docs)).select("height", "width", F.length("rgb").alias("n")).collect()
    assert all(p.n == p.height * p.width * 3 for p in pics)


def test_pii(spark, docs, none):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert pii.report(none).count() == 0
    r, t = got[12], TEXTS[12]
    want = sorted([(t.index("a.b@"), 0, 8), (t.index("10.2"), 1, 8), (t.index("4111"), 2, 19), (t.index("+1"), 3, 17)])
    text = ",".join(f"{pii.KINDS[k]}:{s}:{s + n}" for s, k, n in want)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and f"id:{t.index('0f0f')}:" in r.spans
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    red = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert "[EMAIL]" in red[12] and "4111" not in red[12] and red[10] == TEXTS[10] and red[0] is None


def test_pii_bootstrap_finds_unseen(spark):
    rows = [(i, f'login key = "{i * 0xABCDEF123:040x}" end') for i in range(1, 9)] + [(20, 'login key = "abc123def4" end'), (21, "room 12345678 free")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "id:13:23" and got[21] == ""


def test_pii_bootstrap_reaches_other_shapes(spark):
    hexes = [f"{i * 0xABCDEF123:040x}" for i in range(1, 61)]
    new = ["ghp_Ab12Cd34Ef56", "sk-Test9Key8Part", "123e4567-e89b-12d3-a456-426614174000", "Zx9" * 120, "q" * 100 + "7", "AB12CD34EF", "n5-new-five-x", "eight_8_eight"]
    late = "Lone_5tring_Late"
    texts = [f'token = "{x}" end' for x in hexes + new] + [f"alias: {x} end" for x in [*new, late]]
    texts += [f"room {x} free" for x in ("12345678", "a-b-c-d-e-1", new[0])] + ["sum " + "0a" * 100 + " end", "word abcdefghij--1 end", "a-" * 50_000 + "b"]
    got = [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:68] == [f"id:9:{9 + len(x)}" for x in hexes + new]
    assert got[68:77] == [f"id:7:{7 + len(x)}" for x in [*new, late]]
    assert got[77:] == ["", "", "", "id:4:204", "", ""]


def test_licenses(spark, none):
    rows = [(1, "x y " + licenses.TEMPLATES["gpl-3.0"] + " z"), (2, "Released under the\nMIT License"), (3, "license to nothing at all here"), (4, None), (5, ""), (6, licenses.TEMPLATES["mit-grant"].replace("free of charge", "at no cost"))]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "gpl-3.0"), (2, "mit")} and got[1, "gpl-3.0"].start_word == 2 and got[1, "gpl-3.0"].containment == 1.0
    assert licenses.scan(none).count() == 0


def test_licenses_with_insertions(spark):
    given = licenses.TEMPLATES
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
    texts = [f"{'x ' * n}{t} tail" for n in range(3) for t in (mit, bsd, gpl)]
    for name in ("mit-grant", "gpl-notice", "bsd-redistribution"):
        ws = given[name].split()
        for at in range(0, len(ws), 3):
            texts += [" ".join(["pad"] * (at % 4) + ws[:at] + new + ws[at + gone :]) for new, gone in ((["changed"], 1), (["one"], 0), (["one", "two", "three"], 0), (["more"] * 60, 0))]
    texts += [given["mit-grant"] + " and " + bsd + " " + mit]

    def grams(t):
        w = re.findall(licenses.WORD, t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, t in enumerate(texts):
        g = grams(t)
        for name, body in given.items():
            own = set(grams(body))
            both = own & set(g)
            if len(both) >= 0.8 * len(own):
                at = [k for k, x in enumerate(g) if x in both]
                spans = [(k, next((e for e in at if both <= set(g[k : e + 1])), None)) for k in at]
                width, k = min((e - k, k) for k, e in spans if e is not None)
                need = {(k, next((e for e in at if e >= k and len(both & set(g[k : e + 1])) >= 0.8 * len(own)), None)) for k in at}
                n = len({e for _, e in need if e is not None})
                want[i, name] = (len(both) / len(own), k, k + width + 5, n)
    got = {(r.doc_id, r.license): (r.containment, r.start_word, r.end_word, r.n_windows) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and {(n, k) for n in range(0, 9, 3) for k in ("mit-grant",)} <= set(got)


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for x in raw:
        for i in range(len(x) - 199):
            count[x[i : i + 200]] = count.get(x[i : i + 200], 0) + 1
    out = []
    for x in raw:
        gone = set()
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        runs = sum(i in gone and i - 1 not in gone for i in range(len(x)))
        out.append((len(x), len(gone), runs, hashlib.sha256(bytes(c for i, c in enumerate(x) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("merged", [100_000, 1])
def test_repeats(spark, none, monkeypatch, merged):
    monkeypatch.setattr(repeats, "MERGED", merged)
    passage = prose(80)
    texts = [*TEXTS, prose(30) + passage + prose(20), passage, "q" + passage[5:330] + prose(40), prose(50) + passage[100:301], "ab" * 200, "é" * 150]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts)
    assert repeats.remove_repeats(none).count() == 0
    twice = repeats.remove_repeats(spark.createDataFrame([(1, passage), (1, passage), (None, "z")], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in twice) == [0, len(passage.encode()), len(passage.encode())]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 50 and all(r.round_trip for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "redact", "mix_sources", "encode"]
