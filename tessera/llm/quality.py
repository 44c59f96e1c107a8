"""Quality classifier by compression: two zstandard dictionaries, one from good and one from bad labelled text.

A text resembles the side whose dictionary shortens it more; the difference of the two compressed sizes, normalised by
length, is calibrated to a probability by a logistic curve fitted on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. Only the fit is bounded; scoring reads every text whole."""

    train_per_class: int = 4000  # labelled texts of each class for the dictionaries
    calibrate_per_class: int = 2000  # further labelled texts of each class for the calibration
    longest_sample: int = 16_384  # longer labelled texts are not used for the fit
    dictionary_bytes: int = 512 << 10
    piece_bytes: int = 1000  # training texts are cut into pieces of this size
    level: int = 3
    threshold: float = 0.7


def held_out(doc_id) -> F.Column:
    """Rows kept from the fit: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[tuple[str, int, int]], float]:
    """(text, label, part) of a bounded sample of rows that are not held out; part 0 trains, part 1 calibrates.

    Beside it, the share of label 1 among all labelled rows that are not held out."""
    w = Window.partitionBy("quality").orderBy("o", "doc_id")
    most = s.train_per_class + s.calibrate_per_class
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("o", F.xxhash64("doc_id"))
    # at most `most` rows of each class leave any partition, so the window never holds more than that from each
    few = known.filter("quality = 1").orderBy("o", "doc_id").limit(most).unionByName(known.filter("quality = 0").orderBy("o", "doc_id").limit(most))
    few = few.withColumn("part", (F.row_number().over(w) > s.train_per_class * F.count("*").over(Window.partitionBy("quality")) / most).cast("int"))
    # at most 2 * most rows of ids: broadcast has a fixed bound
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, s.longest_sample)).join(F.broadcast(few), "doc_id")
    share = known.agg(F.avg("quality")).first()[0]
    rows = [(r.text, r.quality, r.part) for r in texts.orderBy("o", "doc_id", "text").limit(2 * most).select("text", "quality", "part").collect()]
    return rows, 0.5 if share is None else share


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, level: int, trained: bool, prior: float):
        self.good, self.bad, self.weights, self.level, self.trained, self.prior = good, bad, weights, level, trained, prior
        self._c = None

    def __getstate__(self):
        return self.__dict__ | {"_c": None}

    def features(self, data: bytes) -> tuple[float, float, float]:
        if self._c is None:
            import zstandard as z

            self._c = []
            for d in (self.good, self.bad):
                own = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO)
                own.precompute_compress(level=self.level)
                self._c.append(z.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))
        g, b = (len(c.compress(data)) for c in self._c)
        n = max(1, len(data))
        return (b - g) / n * 20, float(np.clip((b - g) / 50, -6, 6)), 1.0

    def score(self, text: str) -> float:
        if not self.trained:
            return self.prior
        x = float(np.dot(self.weights, self.features(text.encode("utf-8"))))
        return 1.0 / (1.0 + np.exp(-min(max(x, -60.0), 60.0)))


def dictionary(texts: list[bytes], s: Settings) -> bytes:
    import zstandard as z

    pieces = [t[i : i + s.piece_bytes] for t in texts for i in range(0, len(t), s.piece_bytes)]
    room = min(s.dictionary_bytes, max(256, sum(map(len, pieces)) // 4))
    try:
        return z.train_dictionary(room, pieces, level=s.level).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(pieces)[-s.dictionary_bytes :]  # too little to train on: the texts themselves


def fit(sample: list[tuple[str, int, int]], share: float, s: Settings) -> Model:
    """Dictionaries from part 0, a ridge logistic calibration by Newton steps from part 1 (part 0 if that lacks a class)."""
    side = lambda q, part: [t.encode("utf-8") for t, y, p in sample if y == q and p == part]
    good, bad = side(1, 0), side(0, 0)
    prior = (sum(y for _, y, _ in sample) + 1) / (len(sample) + 2)
    if not good or not bad:
        return Model(b"", b"", np.zeros(3), s.level, False, prior)
    model = Model(dictionary(good, s), dictionary(bad, s), np.zeros(3), s.level, True, prior)
    rest = [(t, y) for t, y, p in sample if p == 1]
    if len({y for _, y in rest}) < 2:
        rest = [(t, y) for t, y, _ in sample]
    x, y = np.array([model.features(t.encode("utf-8")) for t, _ in rest]), np.array([y for _, y in rest], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the classes weigh as in all labels
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.1 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    return model


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Empty and null texts are scored as the empty text. Equal texts get equal scores; every row is kept, repeated ones
    too; other columns pass through, except ones named score or predicted, which are replaced. An id labelled both 0
    and 1 counts as labelled 1. Without labelled rows
    of both classes every score is the labelled share of class 1, smoothed (0.5 with no labels at all). Labels, ids
    and other columns are never inputs of a score. One scan for the bounded sample, then a map without a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, s), s))  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.score(t or "") for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "score"])

    kept = docs.drop("score", "predicted")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])).withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
