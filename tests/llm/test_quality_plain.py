"""The quality classifier against a plain version: own choice of rows, dictionaries, working least squares for the curve."""

import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


def dictionary(texts):
    pieces = [t[i : i + 1000] for t in texts for i in range(0, len(t), 1000)]
    return zstandard.ZstdCompressionDict(zstandard.train_dictionary(min(512 << 10, sum(map(len, pieces)) // 4), pieces, level=3).as_bytes())


def plain_scores(texts, labels):
    fit = {k: q for k, q in labels.items() if zlib.crc32(str(k).encode()) % 4 != 2}
    order = lambda k: (xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed=42) + (1 << 63)) % (1 << 64)  # noqa: E731  as a signed number
    part = {}
    for q in (0, 1):
        own = sorted((k for k in fit if fit[k] == q), key=order)
        part |= {k: int(i + 1 > len(own) * 2 / 3) for i, k in enumerate(own)}
    used = [k for k in sorted(fit, key=order) if 1 <= len(texts.get(k) or "") <= 16_384]
    tools = []
    for q in (1, 0):
        data = dictionary([texts[k].encode() for k in used if fit[k] == q and part[k] == 0])
        data.precompute_compress(level=3)
        tools.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False))

    def features(t):
        data = t.encode()
        good, bad = (len(c.compress(data)) for c in tools)
        return [(bad - good) * 20 / max(1, len(data)), min(6.0, max(-6.0, (bad - good) / 50)), 1.0]

    rows = [k for k in used if part[k]]
    x, y = np.array([features(texts[k]) for k in rows]), np.array([fit[k] for k in rows], float)
    share = sum(fit.values()) / len(fit)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(200):  # least squares on the working response, with a ridge of 0.1
        p = 1 / (1 + np.exp(-x @ w))
        root = np.sqrt(weight * p * (1 - p))
        a = np.vstack([x * root[:, None], np.sqrt(0.1) * np.eye(3)])
        w = np.linalg.lstsq(a, np.concatenate([root * (x @ w + (y - p) / (p * (1 - p))), np.zeros(3)]), rcond=None)[0]
    return {k: 1 / (1 + np.exp(-np.dot(w, features(t or "")))) for k, t in texts.items()}


def test_scores_equal_a_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    want = plain_scores(texts, labels)
    got = queries.queries()["op5_quality"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
