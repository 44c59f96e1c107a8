"""Removal of repeated byte strings by a sparse, sharded suffix order.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Suffixes are kept only where every such
string must hold one: at anchors, the positions whose hash of GRAM bytes is the least of a window (so which one a string
holds depends on its own bytes alone). Each map task is a shard that gives its anchors with hashes of what stands around
them. Anchors that occur once are done with; so are those whose whole surroundings recur, by a digest of 128 bits: no
cheaper hash removes a byte. The suffixes left, and the
reversed prefixes before them, are merged across shards by iterative interleave refinement: all suffixes of an anchor
start as one interval, each round splits the intervals that still have company by the next eight bytes, and the round
and byte where neighbours part is their common prefix. No suffix is compared again once it is alone. A string of SPAN
bytes recurs exactly if two suffixes share an interval at its length to the right and, reversed, one to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, join_counted, numbered, small_batches, tasks
from tessera.llm.hashing import Spans, digest

SPAN = 200
GRAM = 32
AROUND = SPAN - GRAM  # bytes of a string on either side of its anchor
HALF = AROUND // 2
#: Bytes of concatenated texts handled at once.
CHUNK = 4 << 20
#: Suffixes of one anchor and half that are merged in one task; beyond, strings are counted by hash across tasks.
MERGED = 100_000


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    spans = Spans(data)
    at = np.arange(max(0, len(data) - GRAM + 1))
    return spans.of(at, at + GRAM)


def _least_in_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of keys[i : i + w] for every i, by block-wise running minima from both sides."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, position, left, right, hash, and two halves of a context digest) of the anchors of texts.

    left and right: bytes at hand around the anchor, AROUND at most; the digest is over how many and all of them.
    """
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    w = AROUND + 1
    found, hashes = [], []
    for lo in range(0, max(0, len(data) - SPAN + 1), CHUNK):
        hi = min(len(data), lo + CHUNK + SPAN - 1)
        h = _gram_hashes(data[lo:hi])
        key = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        least = _least_in_windows(key, w)
        start = np.arange(lo, lo + len(least))
        inside = start + SPAN <= end[np.searchsorted(end, start, "right")]
        pos = np.unique(0xFFFFFF - (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64))
        whole = pos + lo
        found.append(whole)
        hashes.append(h[pos])
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, z
    at = np.concatenate(found)
    at, first = np.unique(at, return_index=True)  # chunks overlap
    doc = np.searchsorted(end, at, "right")
    left, right = np.minimum(at - (end - size)[doc], AROUND), np.minimum(end[doc] - at - GRAM, AROUND)
    sums = b"".join([digest(bytes((n,)) + raw[p - n : p + GRAM + r]) for p, n, r in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)])
    context = np.frombuffer(sums, np.int64).reshape(-1, 2)
    return doc, at - (end - size)[doc], left, right, np.concatenate(hashes)[first].view(np.int64), context[:, 0], context[:, 1]


def interleave(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of suffixes, and for each the bytes it shares with the one before it (-1 where a group begins).

    group: the interval each suffix starts in; words: its bytes as big-endian 64-bit words, a row each.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    lcp = np.where(new, -1, words.shape[1] * 8)
    alone = lambda: new & np.concatenate((new[1:], [True]))
    live = np.flatnonzero(~alone()) if len(g) else np.zeros(0, np.int64)
    for t in range(words.shape[1]):
        if not len(live):
            break
        w = words[order[live], t]
        interval = np.cumsum(new)[live]
        o = np.lexsort((w, interval))
        order[live], w = order[live][o], w[o]
        part = np.flatnonzero((interval[1:] == interval[:-1]) & (w[1:] != w[:-1])) + 1
        x = w[part] ^ w[part - 1]
        lcp[live[part]] = 8 * t + sum((x < np.uint64(1 << s)).astype(int) for s in range(8, 64, 8))
        new[live[part]] = True
        live = live[~alone()[live]]
    return order, lcp


def _as_words(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def reach(group: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, rights: range) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after its anchor that recurring strings cover, for each context; (-1, -1) where none does.

    rows: contexts with the anchor at AROUND; left, right: the bytes at hand; rights: how much of a string may stand
    to the right of the anchor. All strings hold the anchor, so their union has no gaps.
    """
    m = len(group)
    ranks, common = [], []
    for side in (rows[:, :AROUND][:, ::-1], rows[:, AROUND:]):  # the gram itself is compared with the right side
        order, lcp = interleave(group, _as_words(side))
        back = np.empty(m, np.int64)
        back[order] = np.arange(m)
        ranks.append(back)
        common.append(lcp)
    most_left, most_right = np.full(m, -1), np.full(m, -1)
    for r in rights:
        here = np.flatnonzero((left >= AROUND - r) & (right >= r))
        if len(here) < 2:
            continue
        a = np.cumsum(common[0] < AROUND - r)[ranks[0][here]]
        b = np.cumsum(common[1] < GRAM + r)[ranks[1][here]]
        key = a * (m + 1) + b
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = here[count[which] > 1]
        most_left[hit] = np.maximum(most_left[hit], AROUND - r)
        most_right[hit] = r  # rights ascend
    return most_left, most_right


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, rid, pos, l, r, body, lk, rk): surroundings of the wanted anchors, with hashes of their halves."""
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("pos", "h", "l", "r")).alias("at"))
    rows = texts.join(asked.hint("shuffle_hash"), "rid").select("text", "rid", "at")
    names = ("h", "rid", "pos", "l", "r", "body", "lk", "rk")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = lambda s: int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for text, rid, at in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for x in at:
                    p, left, right = x["pos"], x["l"], x["r"]
                    body = bytes(AROUND - left) + text[p - left : p + GRAM + right] + bytes(AROUND - right)
                    lk, rk = half(text[p - HALF : p]) if left >= HALF else None, half(text[p + GRAM : p + GRAM + HALF]) if right >= HALF else None
                    for k, v in zip(names, (x["h"], rid, p, left, right, body, lk, rk), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(names))

    return durable(rows.mapInArrow(run, "h long, rid long, pos int, l int, r int, body binary, lk long, rk long"), "repeat-contexts")


def _compared(ctx: DataFrame) -> DataFrame:
    """(rid, pos, ml, mr) of contexts that share a string of SPAN bytes with another context of their anchor.

    Groups of up to MERGED suffixes are merged in a task; larger ones are spread, each string of SPAN bytes by its
    digest. Both find the same strings.
    """
    # a string has half of AROUND bytes or more on one side: only contexts that share that half need to meet
    half = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lk").alias("half")), F.struct(F.lit(1).alias("side"), F.col("rk").alias("half"))))
    keyed = ctx.withColumn("x", half).filter("x.half is not null").select("h", "rid", "pos", "l", "r", F.col("x.side").alias("side"), F.col("x.half").alias("half"), "body")
    sizes = keyed.groupBy("h", "side", "half").agg(F.count("*").alias("n")).filter("n > 1").withColumn("shared", F.lit(True))
    rows = join_counted(keyed, sizes, ["h", "side", "half"], "n", 2 * ctx.count()).drop("shared")
    few = rows.filter(F.col("n") <= MERGED).repartition(tasks(ctx.sparkSession), "h", "side", "half").sortWithinPartitions("h", "side", "half")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            h, rid, pos, side, half = (np.asarray(t.column(c)) for c in ("h", "rid", "pos", "side", "half"))
            left, right = np.asarray(t.column("l")), np.asarray(t.column("r"))
            rows = np.frombuffer(b"".join(t.column("body").to_pylist()), np.uint8).reshape(len(h), -1)
            step = (h[1:] != h[:-1]) | (side[1:] != side[:-1]) | (half[1:] != half[:-1])
            group = np.concatenate(([0], np.cumsum(step)))
            got = [[], [], [], []]
            for s, rights in ((0, range(0, AROUND - HALF + 1)), (1, range(HALF, AROUND + 1))):
                own = np.flatnonzero(side == s)
                if len(own) < 2:
                    continue
                a, b = reach(group[own], left[own], right[own], rows[own], rights)
                hit = a >= 0
                for g, v in zip(got, (rid[own][hit], pos[own][hit], a[hit], b[hit]), strict=True):
                    g.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(g) if g else np.zeros(0), k) for g, k in zip(got, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["rid", "pos", "ml", "mr"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            have += b.num_rows
            if have >= 20_000:  # whole groups only: the last one stays for what follows
                t = pa.Table.from_batches(held).combine_chunks()
                h, side, half = (np.asarray(t.column(c)) for c in ("h", "side", "half"))
                last = np.flatnonzero((h[1:] != h[:-1]) | (side[1:] != side[:-1]) | (half[1:] != half[:-1]))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield flush(t.slice(0, cut))
                    held, have = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if have:
            yield flush(pa.Table.from_batches(held))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rights = range(max(0, AROUND - r["l"]), min(r["r"], AROUND - HALF) + 1) if r["side"] == 0 else range(max(HALF, AROUND - r["l"]), r["r"] + 1)
                body = r["body"]
                keys = [hashlib.blake2b(body[x : x + SPAN], digest_size=16).digest() for x in rights]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([r["h"]] * n, pa.int64()), pa.array([r["rid"]] * n, pa.int64()), pa.array([r["pos"]] * n, pa.int32()), pa.array(list(rights), pa.int32()), pa.array(keys, pa.binary())], ["h", "rid", "pos", "right", "string"])

    many = rows.filter(F.col("n") > MERGED).select("h", "rid", "pos", "l", "r", "side", "body").mapInArrow(strings, "h long, rid long, pos int, right int, string binary").distinct()
    many = durable(many, "repeat-strings")
    often = many.groupBy("h", "right", "string").agg(F.count("*").alias("n")).filter("n > 1").withColumn("shared", F.lit(True))
    hot = join_counted(many, often, ["h", "right", "string"], "n", many.count()).select("rid", "pos", (AROUND - F.col("right")).alias("ml"), F.col("right").alias("mr"))
    out = few.mapInArrow(merge, "rid long, pos int, ml int, mr int").unionByName(hot).groupBy("rid", "pos").agg(F.max("ml").alias("ml"), F.max("mr").alias("mr"))
    out = durable(out, "repeat-compared")
    discard(many)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs (doc_id, text); kept: the bytes left.

    Strings are judged on the input, as UTF-8 bytes, within one document; occurrences may overlap. Null text counts as
    empty: nothing removed, the hash of no bytes. Repeated rows are documents of their own, so texts of SPAN bytes or
    more that are repeated go whole; ids may repeat or be null. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, _ = numbered(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "rid")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = np.asarray(b.column(0))
            doc, pos, left, right, h, ck, ck2 = anchors(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(rid[doc]), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(h), pa.array(ck), pa.array(ck2)], ["rid", "pos", "l", "r", "h", "ck", "ck2"])

    found = durable(texts.filter(F.octet_length("text") >= SPAN).select("rid", "text").mapInArrow(shard, "rid long, pos int, l int, r int, h long, ck long, ck2 long"), "repeat-anchors")
    both = [F.min(c).alias(f"lo_{c}") for c in ("ck", "ck2")] + [F.max(c).alias(f"hi_{c}") for c in ("ck", "ck2")]
    often = found.groupBy("h").agg(F.count("*").alias("n"), *both).filter("n > 1").select("h", "n", ((F.col("lo_ck") != F.col("hi_ck")) | (F.col("lo_ck2") != F.col("hi_ck2"))).alias("mixed"))
    often = durable(often, "repeat-often")
    again = durable(join_counted(found, often, ["h"], "n", found.count()).drop("n"), "repeat-again")
    discard(found, often)
    kinds = durable(again.filter("mixed").groupBy("h", "ck", "ck2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "l", "r")).alias("x")).select("h", "n", "x.*"), "repeat-kinds")
    ctx = _contexts(texts.select("rid", "text"), kinds)
    shared = _compared(ctx)
    # surroundings that recur as a whole need no company; the others, known by place, have what they share
    whole = F.struct(F.col("l").alias("ml"), F.col("r").alias("mr"))
    once = kinds.filter("n = 1").select("rid", "pos")
    alone = once.join(shared, ["rid", "pos"]).select("rid", "pos", F.struct("ml", "mr").alias("m"))
    repeated = again.filter("mixed").join(once, ["rid", "pos"], "left_anti").unionByName(again.filter("not mixed"))
    cover = repeated.select("rid", "pos", whole.alias("m")).unionByName(alone).filter("m.ml + m.mr >= " + str(AROUND))
    cuts = cover.groupBy("rid").agg(F.collect_list(F.struct((F.col("pos") - F.col("m.ml")).alias("s"), (F.col("pos") + GRAM + F.col("m.mr")).alias("e"))).alias("cuts"))
    cuts = durable(cuts, "repeat-cuts")
    discard(again, kinds, ctx, shared)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, sums, rest = [], [], [], [], []
            for text, at in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in at or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(text)]
                left = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                size.append(len(text))
                gone.append(len(text) - len(left))
                spans.append(len(merged))
                sums.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(cuts.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
