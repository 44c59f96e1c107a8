"""Language identification by nearest centroids of normalised tf-idf vectors of character runs.

Runs of one to three letters, word ends included, are hashed to a fixed number of buckets. Document frequencies come
from all training texts; the texts of a bounded sample of each language are clustered by cosine into a few centroids. A
text gets the language of its nearest centroid and is marked as rejected when it lies farther than nearly all texts that
the language was learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.quality import held_out

BITS = 13
BUCKETS = 1 << BITS
#: Characters that are hashed at once; bounds memory however long a text is.
SLICE = 1 << 16
UNKNOWN = "und"

_rng = np.random.default_rng(11)
_TIMES = _rng.integers(1, 1 << 63, (3, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. Document frequencies and predictions take every text whole."""

    sample: int = 2400  # training vectors in all, shared out evenly among the languages
    most_per_language: int = 300
    languages: int = 1000  # more different values of lang are an error
    centroids: int = 4  # of each language
    rounds: int = 12
    reject: float = 0.01  # share of a language's training vectors that lie beyond its distance


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point 0, 1 for a combining mark, 2 for a letter."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8))
    return _kinds[0]


def bucket_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of bucket counts for each text, and whether it has a letter.

    A run has letters or marks only, but for a first or last character that may be anything else and counts as a space.
    """
    out, has = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    pieces, own, rows = [], [], []

    def flush() -> None:
        code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[code]
        word = kind > 0
        c = np.where(word, code, 32).astype(np.uint64)
        size = np.array([len(p) for p in pieces])
        start = np.cumsum(size) - size
        row = np.repeat(rows, size)
        mine = np.arange(len(code)) - np.repeat(start, size) < np.repeat(own, size)
        has[row[kind == 2]] = True
        keep = [word & mine, (word[:-1] | word[1:]) & mine[:-1], word[1:-1] & mine[:-2]]
        for k, some in enumerate(keep):
            at = np.flatnonzero(some)
            h = c[at] * _TIMES[k, 0]
            for j in range(1, k + 1):
                h = (h ^ (h >> np.uint64(29))) + c[at + j] * _TIMES[k, j]
            h = (h ^ (h >> np.uint64(32))) * _TIMES[2, 2]
            cell = row[at] * BUCKETS + (h >> np.uint64(64 - BITS)).astype(np.int64)
            lo, hi = rows[0], rows[-1] + 1
            out[lo:hi] += np.bincount(cell - lo * BUCKETS, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)
        pieces.clear(), own.clear(), rows.clear()

    held = 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for lo in range(0, len(t), SLICE):
            pieces.append(t[lo : lo + SLICE + 2])
            own.append(min(SLICE, len(t) - lo))
            rows.append(i)
            held += own[-1]
            if held >= SLICE:
                flush()
                held = 0
    if pieces:
        flush()
    return out, has


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one (or zero): damped counts times idf."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k unit centroids of the rows of v by cosine, begun with rows far from each other, and each row's cosine."""
    c = v.mean(axis=0, keepdims=True)
    first = [int((v @ c[0]).argmax())]
    while len(first) < min(k, len(v)):
        first.append(int((v @ v[first].T).max(axis=1).argmin()))
    c = v[first]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == i].mean(axis=0) for i in range(len(c)) if (near == i).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).max(axis=1)


@dataclass
class Model:
    names: list[str]
    owner: np.ndarray  # of each centroid, the index of its language
    centroids: np.ndarray
    least: np.ndarray  # of each language, the cosine under which a text is rejected
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, has = bucket_counts(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = unit(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        near = np.where(has, np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0.0, 1.0), 0.0)
        language = self.owner[best]
        return [self.names[x] if h else UNKNOWN for x, h in zip(language, has, strict=True)], near, ~has | (near < self.least[language])


def training(docs: DataFrame) -> DataFrame:
    """(lang, text, h) of the rows to learn from; h is a hash of the text."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    return rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """For each bucket, the rows that hold a run of it; last, the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            total[:-1] += (bucket_counts(b.column(0).to_pylist())[0] > 0).sum(axis=0)
            total[-1] += b.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """The sample of a language is taken by the hash of the text, equal texts once, about as many from each language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training(docs)
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("different")).orderBy(F.desc("n"), "lang").limit(s.languages + 1).collect()
    if len(known) > s.languages:
        raise ValueError(f"more than {s.languages} languages")
    if not known:
        return Model([], np.zeros(0, int), np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(BUCKETS))
    df = document_frequencies(rows)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    each = min(s.most_per_language, max(4, s.sample // len(known)))
    # the lowest hashes, twice as many as wanted: fewer are found with no chance to speak of
    reach = spark.createDataFrame([(r.lang, int(-(1 << 63) + min(1.0, 2 * (each + 20) / r.different) * ((1 << 64) - 1024)) if 2 * (each + 20) < r.different else (1 << 63) - 1) for r in known], "lang string, reach long")
    few = rows.join(F.broadcast(reach), "lang").filter("h <= reach")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a few hundred hashes a language
        for b in batches:
            lang, text, h = (c.to_pylist() for c in b.columns)
            new = [i for i, k in enumerate(zip(lang, h, strict=True)) if k not in seen and not seen.add(k)]
            if new:
                v = bucket_counts([text[i] for i in new])[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in new]), pa.array([h[i] for i in new], pa.int64()), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "h", "v"])

    each_once = few.select("lang", "text", "h").mapInArrow(vectors, "lang string, h long, v binary").dropDuplicates(["lang", "h"])
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for r in each_once.collect():  # bounded by Settings.sample, twice over
        by_lang.setdefault(r.lang, []).append((r.h, r.v))
    names, owner, centroids, least = [r.lang for r in known], [], [], []
    for i, name in enumerate(names):
        got = sorted(by_lang[name])[:each]
        c, near = cluster(unit(np.stack([np.frombuffer(v, np.float32) for _, v in got]), idf), s.centroids, s.rounds)
        owner += [i] * len(c)
        centroids.append(c)
        least.append(np.quantile(near, s.reject))
    return Model(names, np.array(owner), np.concatenate(centroids), np.array(least), idf)


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs (doc_id, text, lang).

    score is the cosine to the nearest centroid; ties go to the language with more training rows, then to the smaller
    name. Null and empty texts, like all without a letter, get 'und', score 0 and are rejected; with nothing to learn
    from, every text does. Rows with a null lang or held out are predicted but not learned from; null ids are not held
    out. Repeated rows each get their result, equal texts the same. Other columns are ignored, an empty table gives an
    empty result. Long texts are read whole, in slices. Of lang, source and doc_id a prediction sees nothing.

    Two scans learn (document frequencies from all rows, vectors of the sample), one predicts; no text is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, s))  # a few vectors of fixed length for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, near, rejected = shared.value.predict([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(near), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    cols = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
