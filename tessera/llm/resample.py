"""Importance resampling of documents towards a target corpus, by hashed word runs kept in partition-local tries.

A trie's edges are words; a node stands for the run of words on its path and holds the CRC-32 of that run, extended from
its parent's, and either how often the run occurred or the gain of its bucket. Counting adds node counts to bucket
totals, partition by partition; a log-ratio of the totals gives each bucket a gain; scoring walks the same paths with
gains at the nodes. Gumbel noise hashed from the id makes the highest scores a sample by importance without replacement.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, small_batches

#: A trie that has more nodes, or more bytes of words, gives its counts to the buckets and starts anew.
MOST_NODES = 1 << 18
MOST_BYTES = 32 << 20
#: Words are cut from pieces of about this many bytes, so that a long text never stands as one list of words.
PIECE = 1 << 20

#: What is no word character becomes a space, A-Z becomes a-z: words are runs of digits, a-z and bytes from 128 on.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    data = text.translate(_PLAIN)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE) if lo + PIECE < len(data) else -1
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


class _Words(dict):
    """The root's edges: word -> node of the first level."""

    def __init__(self):
        super().__init__()
        self.crc, self.spelt, self.size = array("Q"), [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = node = len(self.spelt)
        self.crc.append(zlib.crc32(word))
        self.spelt.append(word)
        self.size += len(word)
        return node


class _Level(dict):
    """The edges into a deeper level: (parent, word) as one number -> node."""

    def __init__(self):
        super().__init__()
        self.crc = array("Q")


class Trie:
    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.root, self.deep = _Words(), [_Level() for _ in range(self.depth - 1)]
        self.counts = [np.zeros(0, np.int64) for _ in range(self.depth)]

    def full(self) -> bool:
        return self.root.size > MOST_BYTES or len(self.root) + sum(map(len, self.deep)) > MOST_NODES

    def buckets(self, buckets: int) -> list[np.ndarray]:
        """For each level, the bucket of every node."""
        return [(np.array(lv.crc, np.uint64) % np.uint64(buckets)).astype(np.int64) for lv in (self.root, *self.deep)]

    def walk(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """How many words each text has and, for each length of run, where runs start in all the words and their nodes."""
        ids, n = array("L"), np.zeros(len(texts), np.int64)
        find = self.root.__getitem__
        for i, t in enumerate(texts):
            before = len(ids)
            for some in words(t):
                ids.extend(map(find, some))
            n[i] = len(ids) - before
        word = np.array(ids, np.int64)
        end = np.repeat(np.cumsum(n), n)  # where the text of each word ends
        at, node = np.arange(len(word)), word
        out = [(at, node)]
        for k, level in enumerate(self.deep, 1):
            stay = at + k < end[at]
            at, node = at[stay], node[stay]
            keys, which = np.unique((node << 32) | word[at + k], return_inverse=True)
            crc = self.root.crc if k == 1 else self.deep[k - 2].crc
            found = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys.tolist()):
                if (have := level.get(key)) is None:
                    have = level[key] = len(level)
                    level.crc.append(zlib.crc32(b" " + self.root.spelt[key & 0xFFFFFFFF], crc[key >> 32]))
                found[i] = have
            node = found[which]
            out.append((at, node))
        return n, out

    def add(self, texts: list[bytes]) -> None:
        for k, (_, node) in enumerate(self.walk(texts)[1]):
            new = np.bincount(node, minlength=len((self.root, *self.deep)[k]))
            new[: len(self.counts[k])] += self.counts[k]
            self.counts[k] = new

    def give(self, totals: np.ndarray) -> None:
        for bucket, count in zip(self.buckets(len(totals)), self.counts, strict=True):
            np.add.at(totals, bucket[: len(count)], count)
        self.clear()


def bucket_counts(texts: DataFrame, depth: int, buckets: int) -> np.ndarray:
    """How often runs of 1 to depth words fall into each bucket, over all rows of texts (a column text)."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(depth), np.zeros(buckets, np.int64)
        for b in batches:
            trie.add(b.column(0).to_pylist())
            if trie.full():
                trie.give(totals)
        trie.give(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    plain = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    for bucket, n in plain.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of a bucket to the corpus's, each smoothed by one, floored."""
    b, s_all, t_all = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, depth: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's runs, 0 where it has none."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = Trie(depth), shared.value
        for b in batches:
            n, found = trie.walk(b.column(1).to_pylist())
            ends = np.cumsum(n)
            sums = np.zeros(int(n.sum()) + 1, np.int64)
            for bucket, (at, node) in zip(trie.buckets(len(gain)), found, strict=True):
                sums[at + 1] += gain[bucket][node]
            sums = np.cumsum(sums)
            features = np.sum([np.maximum(n - k, 0) for k in range(depth)], axis=0)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
            if trie.full():
                trie.clear()

    cols = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return cols.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, depth: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; target has a column text.

    Of the rows with at least least_words words, percent in a hundred (rounded down) are drawn, those with the highest
    scores, and ranked 1, 2, ...; the others have a null rank. Ties go to the smaller doc_id, a null id last. Null texts
    count as empty and have weight 0, null ids draw noise as an empty id does. Every row is kept; rows of one id and
    text get equal scores, so repeated rows are ranked one after the other. Other columns are ignored, an empty docs
    gives an empty result, an empty target makes all gains those of the smoothing. Long texts are read whole.

    Two scans of the texts without a shuffle of them. Only the rows at or above the lowest drawn score are sorted, by
    range, so that no task ranks more than its part.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, depth, buckets), bucket_counts(target, depth, buckets))
    known = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(known, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = durable(weights(docs, gain, depth).withColumn("score", F.col("weight") + noise), "resample-scores")
    # gains and noise are thousandths of logarithms of doubles, so there are some 100,000 different scores at most
    held = sorted(scored.filter(F.col("n_words") >= least_words).groupBy("score").count().collect(), reverse=True)
    wanted = sum(n for _, n in held) * percent // 100
    above, lowest = 0, None
    for score, n in held:
        if above >= wanted:
            break
        above, lowest = above + n, score
    in_reach = (F.col("n_words") >= least_words) & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    ordered = scored.filter(in_reach).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features")
    top = durable(ordered.withColumn("place", F.monotonically_increasing_id()), "resample-top")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    starts, done = [], 0
    for p, n in sorted(top.groupBy(part).count().collect()):  # a row a partition
        starts.append((p, done))
        done += n
    starts = spark.createDataFrame(starts, "part long, start long")
    ranked = top.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + within + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = ranked.select(scored.columns + ["rank"]).unionByName(scored.filter(~in_reach).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
