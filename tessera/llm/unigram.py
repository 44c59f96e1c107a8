"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file is read (never trained): pieces with their log scores become a double array, a text becomes the path of
pieces with the highest score sum, characters without a piece fall back to their bytes, and decoding turns the
white-space marker back into spaces and byte pieces back into characters.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches

MARK = "▁"
CACHE_ENTRIES = 400_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Score below the lowest piece of a character that no piece covers (a fixed value of the format).
_UNKNOWN_PENALTY = 10.0

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


def read_model(data: bytes) -> dict:
    """Pieces, scores and types from the protocol-buffer bytes of a .model file, and the normaliser flags used here."""

    def fields(buf: bytes):
        i = 0
        while i < len(buf):
            key, i = number(buf, i)
            if key & 7 == 0:
                val, i = number(buf, i)
            elif key & 7 == 2:
                n, i = number(buf, i)
                val, i = buf[i : i + n], i + n
            else:
                n = 4 if key & 7 == 5 else 8
                val, i = buf[i : i + n], i + n
            yield key >> 3, val

    def number(buf: bytes, i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (buf[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if buf[i - 1] < 128:
                return out, i

    pieces, scores, kinds, flags = [], [], [], {"dummy_prefix": True}
    for f, v in fields(data):
        if f == 1:
            own = dict(fields(v))
            pieces.append(own[1].decode("utf-8"))
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, _NORMAL))
        elif f == 3:
            own = dict(fields(v))
            flags["dummy_prefix"] = bool(own.get(3, 1))
            flags["squeeze"] = bool(own.get(4, 1))
    return {"pieces": pieces, "scores": scores, "kinds": kinds, **flags}


class DoubleArray:
    """A static trie over byte strings: child of s by byte c is base[s] + c + 1 where check says s; slot +0 holds values."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check = array("i", [1]), array("i", [0])
        self.used, self.free_from = bytearray([1]), 1
        items = sorted(keys.items())
        stack = [(0, 0, len(items), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            kids: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                code = 0 if len(items[i][0]) == depth else items[i][0][depth] + 1
                j = i + 1
                while j < hi and code and len(items[j][0]) > depth and items[j][0][depth] + 1 == code:
                    j += 1
                kids.append((code, i, j))
                i = j
            base = self._place([c for c, _, _ in kids])
            self.base[node] = base
            for code, i, j in kids:
                self.check[base + code] = node
                self.used[base + code] = 1
                if code == 0:
                    self.base[base] = -items[i][1] - 1
                else:
                    stack.append((base + code, i, j, depth + 1))

    def _place(self, codes: list[int]) -> int:
        while self.free_from < len(self.used) and self.used[self.free_from]:
            self.free_from += 1
        at = max(1, self.free_from - codes[0])
        tried = 0
        while True:
            need = at + 258
            if need > len(self.used):
                grow = need - len(self.used) + 4096
                self.used.extend(bytes(grow))
                self.base.extend([0] * grow)
                self.check.extend([-1] * grow)
            if not any(self.used[at + c] for c in codes):
                return at
            at += 1
            tried += 1
            if tried > 2000:  # leave a crowded stretch behind
                at, tried = max(at, len(self.used) - 4096), 0

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that is a prefix of text[start:]."""
        base, check, s, i, n = self.base, self.check, 0, start, len(text)
        while i < n:
            t = base[s] + text[i] + 1
            if t >= len(check) or check[t] != s:
                return
            s, i = t, i + 1
            v = base[s]
            if check[v] == s and base[v] < 0:
                yield i, -base[v] - 1


class Unigram:
    def __init__(self, model: dict, cache: int = CACHE_ENTRIES):
        self.m = model
        usable = {p.encode("utf-8"): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k in (_NORMAL, _USER)}
        self.trie = DoubleArray(usable)
        self.scores = model["scores"]
        self.low = min((s for s, k in zip(self.scores, model["kinds"], strict=True) if k == _NORMAL), default=0.0) - _UNKNOWN_PENALTY
        self.unk = next((i for i, k in enumerate(model["kinds"]) if k == _UNKNOWN), 0)
        self.bytes_at = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k == _BYTE}
        self.fallback = len(self.bytes_at) == 256
        # A piece never runs on from another character into a marker, so texts fall apart before each run of markers.
        self.splits = all(MARK not in p.lstrip(MARK) for p in map(lambda k: k.decode("utf-8"), usable))
        self.cache: dict[str, bytes] = {}
        self.limit = cache
        self.raw = [
            bytes([int(p[1:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(MARK, " ").encode("utf-8")
            for p, k in zip(model["pieces"], model["kinds"], strict=True)
        ]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; among equal sums, the one found first, by shorter last pieces."""
        data = text.encode("utf-8")
        n, low, scores, prefixes = len(data), self.low, self.scores, self.trie.prefixes
        best: list[float | None] = [None] * (n + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = data[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single = best[at], False
            for end, v in prefixes(data, at):
                s = here + scores[v]
                if best[end] is None or s > best[end]:
                    best[end], came[end] = s, (at, v)
                single = single or end == at + step
            if not single and (best[at + step] is None or here + low > best[at + step]):
                best[at + step], came[at + step] = here + low, (at, -1)
            at += step
        out: list[int] = []
        while n:
            at, v = came[n]
            if v >= 0:
                out.append(v)
            elif self.fallback:
                out.extend(self.bytes_at[x] for x in reversed(data[at:n]))
            else:
                out.append(self.unk)
            n = at
        return out[::-1]

    def fill(self, segments: list[str]) -> dict[str, bytes]:
        """Packed ids of many short segments at once: the trie walk, the path search and the way back in lockstep.

        The trie is walked from every byte position of all segments together, one depth at a time; the search then
        takes start positions in ascending order, so of equal sums the longer last piece stays, as in viterbi().
        """
        import numpy as np

        if not hasattr(self, "_np"):
            self._np = np.frombuffer(self.trie.base, np.int32), np.frombuffer(self.trie.check, np.int32), np.array(self.scores)
        base, check, scores = self._np
        raw = [x.encode("utf-8") for x in segments]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        seg = np.repeat(np.arange(len(raw)), lens)
        rel = np.arange(len(text)) - first[seg]
        lead = (text & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        state = np.zeros(len(at), np.int64)
        left = (lens[seg] - rel)[at]
        found: list[tuple] = []
        depth = 0
        while len(at):
            t = base[state] + text[at + depth].astype(np.int64) + 1
            ok = (t < len(check)) & (check[np.minimum(t, len(check) - 1)] == state)
            at, state, left = at[ok], t[ok], left[ok]
            depth += 1
            v = base[state]
            end = (check[np.maximum(v, 0)] == state) & (base[np.maximum(v, 0)] < 0)
            found.append((at[end], np.full(int(end.sum()), depth), -base[v[end]] - 1))
            ok = left > depth
            at, state, left = at[ok], state[ok], left[ok]
        starts, spans, values = (np.concatenate(x) for x in zip(*found, strict=True))
        # a character that no piece covers alone costs self.low
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        single = np.zeros(len(text), bool)
        single[starts[spans == width[starts]]] = True
        bare = np.flatnonzero(lead & ~single)
        starts = np.concatenate((starts, bare))
        spans = np.concatenate((spans, width[bare]))
        values = np.concatenate((values, np.full(len(bare), -1)))
        costs = np.where(values >= 0, scores[values], self.low)
        order = np.lexsort((spans, rel[starts]))
        starts, spans, values, costs = starts[order], spans[order], values[order], costs[order]
        ends = starts + seg[starts] + spans  # one slot more for each segment before
        best = np.full(len(text) + len(raw), -np.inf)
        came, piece = np.full(len(best), -1), np.full(len(best), -2)
        origin = first + np.arange(len(raw))
        best[origin] = 0.0
        key = rel[starts] * 4096 + spans
        cuts = np.concatenate((np.flatnonzero(np.diff(key, prepend=-1)), [len(key)]))
        slot = starts + seg[starts]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            e = ends[lo:hi]
            s = best[slot[lo:hi]] + costs[lo:hi]
            win = s > best[e]
            e = e[win]
            best[e], came[e], piece[e] = s[win], slot[lo:hi][win], values[lo:hi][win]
        here, who = origin + lens, np.arange(len(raw))
        whose, ids = [], []
        while len(here):
            whose.append(who)
            ids.append(piece[here])
            here = came[here]
            more = here > origin[who]
            here, who = here[more], who[more]
        whose, ids = np.concatenate(whose[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(whose, kind="stable")
        ids, n = ids[order].astype("<i4"), np.bincount(whose, minlength=len(raw))
        stop = np.cumsum(n) * 4
        odd = set(whose[order][ids < 0].tolist())
        flat, out, lo = ids.tobytes(), {}, 0
        for i, (x, hi) in enumerate(zip(segments, stop.tolist(), strict=True)):
            out[x] = flat[lo:hi] if i not in odd else array("i", self.viterbi(x)).tobytes()
            lo = hi
        return out

    _SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode_all(self, texts: list[str]) -> list[array]:
        """Ids of each text: spaces become markers, with one in front if the model asks for that; "" has none."""
        mark = lambda t: (" " + t if self.m["dummy_prefix"] else t).replace(" ", MARK)
        if not self.splits:
            return [array("i", self.viterbi(mark(t))) if t else array("i") for t in texts]
        cut = [self._SEGMENT.findall(mark(t)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.cache)
        known = self.cache
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set().union(*cut)
            short = [x for x in new if len(x) <= 48]
            for i in range(0, len(short), 16384):
                known.update(self.fill(short[i : i + 16384]))
        long = {x: array("i", self.viterbi(x)).tobytes() for x in new if len(x) > 48}
        out = []
        for words in cut:
            ids = array("i")
            ids.frombytes(b"".join([known[w] if w in known else long[w] for w in words] if long else map(known.__getitem__, words)))
            out.append(ids)
        return out

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids: markers become spaces, the one in front goes, bytes that form no character become U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "one-by-one")
        return text[1:] if self.m["dummy_prefix"] and text[:1] == " " else text


_loaded: dict[int, Unigram] = {}


def _unigram(data: bytes) -> Unigram:
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Unigram(read_model(data))
    return _loaded[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", out: str = "piece_ids", same: str | None = None) -> DataFrame:
    """docs with a column of piece ids (array<int>) of the whole text.

    Null text encodes as empty: no pieces. Row-wise map without a shuffle: repeated rows, ties and null ids keep one
    row each, an empty table stays empty, long texts cost their own length. A column called like ``out`` is replaced,
    and so is ``same``, if given: whether the pieces, decoded where they were made, give the text back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model_bytes(model_path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = _unigram(shared.value)
        for b in batches:
            i = b.schema.names.index(text)
            rows = uni.encode_all([t or "" for t in b.column(i).to_pylist()])
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r))
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(r.tobytes() for r in rows))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            more = [pa.array([uni.decode(r) == (t or "") for r, t in zip(rows, b.column(i).to_pylist(), strict=True)], pa.bool_())] if same else []
            yield pa.RecordBatch.from_arrays([*b.columns, ids, *more], [*b.schema.names, out, *([same] if same else [])])

    kept = docs.drop(out, *([same] if same else []))
    extra = [T.StructField(same, T.BooleanType())] if same else []
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), *extra]))


def decode_documents(docs: DataFrame, model_path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """docs with the text of their piece ids; a null list gives null, an empty one the empty text.

    Row-wise map without a shuffle: repeated rows and null ids keep a row each, an empty table stays empty. A column
    called like ``out`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = _unigram(shared.value)
        for b in batches:
            texts = [None if r is None else uni.decode(r) for r in b.column(b.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def piece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_sha256, decoded_sha256, round_trip) of every document.

    ids_sha256 is over the ids as little-endian 32-bit integers; round_trip says that decoding gave the text back,
    which only texts that hold the marker character itself fail. Null text counts as empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        uni = _unigram(shared.value)
        is_byte = np.zeros(len(uni.raw), bool)
        is_byte[list(uni.bytes_at.values())] = True
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            texts = b.column(1).to_pylist()
            for t, ids in zip(texts, uni.encode_all([t or "" for t in texts]), strict=True):
                back = uni.decode(ids)
                arr = np.frombuffer(ids, dtype="<i4") if ids else np.zeros(0, "<i4")
                for c, v in zip(cols, (len(ids), int(is_byte[arr].sum()), hashlib.sha256(arr.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), back == (t or "")), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
