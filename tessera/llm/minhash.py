"""MinHash near-dedup: an inverted join on signature coordinates, then confirmation on full shingle sets.

Documents with equal shingle sets are one class. Each class is posted under its (coordinate, value) pairs. Two
signatures that agree in t of K coordinates agree in one of any K - t + 1, so only that prefix is posted; lists with one
member are skipped. Inside a list the members' other coordinates form inverted lists of their own. A member merges its
lists of a prefix of these, counting collisions with the members that no component of the list holds yet; the lists of
the remaining coordinates are skipped, and only looked into for members that the prefix has named. Those with t or more
collisions join its component and merge in turn, so that copies cost their number and not their pairs. What leaves a
list are the links of its components. Components of these candidates are confirmed inside on the full sets in the same
way, and the components of confirmed links are the answer. Lists and candidate components over a block's size are dealt
out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, discard, durable, fresh, join_counted, numbered, runs, small_batches, tasks
from tessera.llm.hashing import WordDigests, digest, mix

COORDINATES = 64
WORDS = 5
#: Members of a list, or of a candidate component, that are compared with each other at once.
BLOCK = 1024
#: Shingles of a candidate component that one block holds.
BLOCK_SHINGLES = 600_000

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def agreement(percent: int) -> int:
    """Coordinates that must agree: five standard deviations below what the threshold similarity gives on average."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


_WORD = WordDigests()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z become a-z; words are runs without space and bytes 9-13; a shingle is five words; with one to four words the
    whole sequence is the only shingle; without words the set is empty. A shingle's hash takes in the digests of its words
    one after the other and is mixed in between, so that their order counts.
    """
    out = []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z only, and just the white space named above
        n = len(words)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        word = np.fromiter(map(_WORD.__getitem__, words), np.uint64, n)
        width = min(n, WORDS)
        h = word[: n - width + 1] + np.uint64(width)
        for k in range(1, width):
            h = mix(h) + word[k : k + len(h)]
        out.append(np.unique(mix(h)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES 32-bit minima for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    return np.stack([np.minimum.reduceat((flat * m + a) >> np.uint64(32), at) for m, a in zip(_MULTIPLY, _ADD, strict=True)], 1)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, prefix: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, prefix, sketch): size and 128-bit hash of the set, its posted pairs, a byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(_utf8(b.column(1)))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            posts: list[list[int] | None] = [None] * len(sets)
            low: list[bytes | None] = [None] * len(sets)
            if some:
                sig = signatures([sets[i] for i in some])
                pairs = (sig[:, :prefix] | (np.arange(prefix, dtype=np.uint64) << np.uint64(32))).astype(np.int64)
                for i, p, row in zip(some, pairs.tolist(), (sig & np.uint64(255)).astype(np.uint8), strict=True):
                    s = sets[i]
                    keys[i] = digest(s.tobytes())
                    posts[i], low[i] = p, row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["doc_id", "n_shingles", "set_key", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, prefix array<long>, sketch binary")


class _Lists:
    """Inverted lists over a prefix of the coordinates of a block's members; members leave once a component holds them."""

    def __init__(self, block: dict, least: int, percent: int):
        self.sketch, self.n, self.least, self.percent = block["sketch"], block["n"], least, percent
        columns = self.sketch.shape[1]
        self.base = 256 * np.arange(min(columns, columns - least + 1))
        self.left = np.ones(len(self.n), bool)
        self.many = len(self.n)
        self._post()

    def _post(self) -> None:
        self.own = np.flatnonzero(self.left)
        codes = (self.sketch[self.own, : len(self.base)] + self.base).T.ravel()
        order = np.argsort(codes, kind="stable")
        self.codes, self.members = codes[order], order % max(1, len(self.own))

    def leave(self, who: np.ndarray) -> None:
        self.left[who] = False
        self.many -= len(who)
        if 2 * self.many <= len(self.own):
            self._post()

    def near(self, sketch: np.ndarray, n: int) -> np.ndarray:
        """Members left that agree with sketch in `least` coordinates and whose sizes allow the similarity."""
        k = len(self.base)
        code = sketch[:k] + self.base
        lo, hi = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, "right")
        hits = np.bincount(self.members[_spans(lo, hi - lo)], minlength=len(self.own))
        met = np.flatnonzero(hits >= min(1, self.least))
        who, hits = self.own[met], hits[met]
        m = self.n[who]
        fit = self.left[who] & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        who, hits = who[fit], hits[fit]
        return who[hits + (self.sketch[who, k:] == sketch[k:]).sum(1) >= self.least]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then those of the next, and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class _Sets:
    """Common shingles of the members of some blocks, numbered through."""

    def __init__(self, blocks: list[dict]):
        sets = [s for b in blocks for s in b["shingles"]]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.cumsum(self.size) - self.size
        _, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.code), np.uint8)

    def similar(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of others (one at least) reach the similarity with x."""
        own = self.code[self.at[x] : self.at[x] + self.size[x]]
        size = self.size[others]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.code[_spans(self.at[others], size)]], np.cumsum(size) - size, dtype=np.int64)
        self.mark[own] = 0
        return 100 * both >= percent * (self.size[x] + size - both)


def _links(one: dict, two: dict | None, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids that connect every near pair (one with two; two None: within one): each to the first of its component.

    Near is who agrees in `least` coordinates and, where the blocks have shingles, reaches the similarity on them.
    """
    blocks = [one] if two is None else [one, two]
    lists = [_Lists(b, least, percent) for b in blocks]
    sets, offset = None, (0, len(one["id"]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(len(one["id"])):
        if not lists[0].left[first]:
            continue
        lists[0].leave(np.array([first]))
        if not lists[-1].many:
            break
        todo = [(0, first)]
        while todo:
            side, x = todo.pop()
            far = len(blocks) - 1 - side
            if not lists[far].many:
                continue
            got = lists[far].near(blocks[side]["sketch"][x], blocks[side]["n"][x])
            if len(got) and "shingles" in one:
                sets = sets or _Sets(blocks)
                got = got[sets.similar(offset[side] + x, offset[far] + got, percent)]
            if len(got):
                lists[far].leave(got)
                a.append(blocks[far]["id"][got])
                b.append(np.full(len(got), one["id"][first]))
                todo += [(far, y) for y in got.tolist()]
    return np.concatenate(a), np.concatenate(b)


def _sides(t: pa.Table) -> tuple[dict, dict | None]:
    """Members of a group's two blocks; the second None where the group is one block."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    own = np.asarray(t.column("block"))
    cols = {"id": np.asarray(t.column("id")), "n": np.asarray(t.column("n")), "sketch": np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)}
    if "shingles" in t.column_names:
        sets = np.empty(t.num_rows, object)
        sets[:] = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        cols["shingles"] = sets
    pick = lambda m: {k: v[m] for k, v in cols.items()}
    return (pick(own == i), None) if i == j else (pick(own == i), pick(own == j))


def _emit(a: list, b: list) -> pa.RecordBatch:
    cat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])


def _dealt(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows with (i, j, block): each once for every pair of blocks of its group that holds its own."""
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return rows.withColumn("block", block).withColumn("x", F.explode(pairs)).select(key, F.col("x.i").alias("i"), F.col("x.j").alias("j"), "block", *[c for c in rows.columns if c not in (key, "members", "weight")]).repartition(tasks(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def candidate_links(reps: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) that connect every pair of classes whose signatures agree in `least` coordinates.

    reps: a row for each class, of distinct ids, with n_shingles, prefix and sketch; other columns are ignored, a class
    has words; an empty table gives an empty result.
    """
    posted = durable(reps.select("id", F.explode("prefix").alias("pair")), "postings")
    lists = durable(posted.groupBy("pair").agg(F.count("*").alias("members")).filter("members > 1"), "lists")
    rows = join_counted(posted, lists.withColumn("shared", F.lit(True)), ["pair"], "members", posted.count()).drop("shared").join(reps.select("id", F.col("n_shingles").alias("n"), "sketch"), "id")
    dealt = _dealt(rows, "pair", F.ceil(F.col("members") / BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, 3):
            one, two = _sides(t)
            if not len(one["id"]) or (two is not None and not len(two["id"])):
                continue
            shared = t.column("pair")[0].as_py() >> 32  # the coordinate in which all agree
            for side in (one,) if two is None else (one, two):
                side["sketch"] = side["sketch"][:, np.arange(side["sketch"].shape[1]) != shared]
            p, q = _links(one, two, least - 1, percent)
            a.append(p)
            b.append(q)
            if len(a) > 4096:
                yield _emit(a, b)
                a, b = [], []
        yield _emit(a, b)

    links = durable(dealt.mapInArrow(run, "a long, b long").distinct(), "candidates")
    discard(posted, lists)
    return links


def confirmed_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, least: int, percent: int) -> DataFrame:
    """Links that connect every similar pair of classes within the candidate components (id, component).

    docs holds the text of every id of reps; rows and columns beyond are ignored. Empty clusters give an empty result.
    """
    sized = clusters.join(reps.select("id", F.col("n_shingles").alias("n"), "sketch", "set_key"), "id")
    sizes = sized.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    wanted = join_counted(sized, sizes, ["component"], "members", clusters.count()).select(F.col("id"), F.col("component").alias("cluster"), "n", "sketch", "members", "weight")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("id", "cluster", "n", "sketch", "members", "weight", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s.tobytes() for s in shingle_sets(_utf8(b.column(6)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(got, pa.binary())], [*b.schema.names[:6], "shingles"])

    full = rows.mapInArrow(sets, "id long, cluster long, n long, sketch binary, members long, weight long, shingles binary")
    dealt = _dealt(full, "cluster", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, 3):
            one, two = _sides(t)
            if not len(one["id"]) or (two is not None and not len(two["id"])):
                continue
            p, q = _links(one, two, least, percent)
            a.append(p)
            b.append(q)
            if len(a) > 4096:
                yield _emit(a, b)
                a, b = [], []
        yield _emit(a, b)

    return durable(dealt.mapInArrow(run, "a long, b long"), "confirmed")


def _classes(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id long, distinct and not null; text): tables (doc_id, n_shingles, set_key) and (set_key, root, n).

    The second has a row for each distinct set that is not empty: the smallest doc_id reachable, and how many rows have it.
    """
    least = agreement(percent)
    own = durable(sketches(rows, COORDINATES - least + 1), "sketches")
    reps = durable(own.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "classes")
    maybe = candidate_links(reps, least, percent)
    clusters = durable(components(maybe), "clusters")
    links = confirmed_links(rows, reps, clusters, least, percent)
    found = components(links).withColumnRenamed("component", "root")
    named = durable(reps.join(found, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"), "n"), "named")
    discard(reps, maybe, clusters, links)
    return own, named


def _rooted(own: DataFrame, named: DataFrame) -> DataFrame:
    """own with root, null where the set is empty; a very common set does not gather in one task."""
    total, own = own.count(), own.select("doc_id", "n_shingles", "set_key")
    some = join_counted(own.filter("set_key is not null"), named, ["set_key"], "n", total).drop("n")
    return some.unionByName(own.filter("set_key is null").withColumn("root", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Documents link where 100 * common >= percent * united distinct shingles; component_id is the smallest doc_id
    reachable, the document's own included; kept says that it is the document's own. A pair that reaches the threshold
    is missed only if its signatures agree in fewer than agreement(percent) of the coordinates, about once in a
    million at the threshold itself and less above it. Two different shingles count as one with a chance of 2 ** -64.
    Null and empty texts have no shingles and link with nothing. Every row is judged by its own text: repeated rows get
    equal results, and an id repeated with different texts has a row, and may have a component, for each. Rows with a
    null doc_id are linked with nothing: component_id null, kept true. Other columns are ignored; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    known = docs.filter("doc_id is not null").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows, plain = numbered(known, "rid")
    own, named = _classes(rows.select(F.col("rid").alias("doc_id"), "text"), percent)
    if plain:
        out = _rooted(own, named).select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    else:  # numbers ascend with ids, so the least number is of the least id
        ids = rows.select(F.col("rid").alias("root"), F.col("doc_id").cast("long").alias("component_id"))
        roots_ = named.groupBy("root").agg(F.count("*").alias("classes")).join(ids, "root")
        by_id = join_counted(named, roots_, ["root"], "classes", named.count()).select("set_key", F.col("component_id").alias("root"), "n")
        found = _rooted(own, by_id).withColumnRenamed("root", "component_id")
        named_rows = rows.select("rid", F.col("doc_id").cast("long").alias("id")).join(found.withColumnRenamed("doc_id", "rid"), "rid")
        out = named_rows.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
    unnamed = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bare = sketches(unnamed, 1).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(bare)


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, of repeated rows any one.

    Every row is judged by its own text, so an id repeated with different texts keeps a row for each that has no
    duplicate. Rows without words and rows with a null doc_id stay as they are. Columns are those of docs, whatever
    their names; an empty table gives an empty result. Texts are shuffled once at most, by row number.
    """
    small_batches(docs.sparkSession)
    rid = fresh(docs.columns, "rid")
    rows, _ = numbered(docs.filter("doc_id is not null"), rid)
    own, named = _classes(rows.select(F.col(rid).alias("doc_id"), F.col("text").cast("string").alias("text")), percent)
    gone = fresh([*docs.columns, rid], "gone")
    out = durable(_rooted(own, named).filter("root != doc_id").select(F.col("doc_id").alias(gone)), "gone")
    discard(own, named)
    left = rows.join(out.hint("shuffle_hash"), F.col(rid) == F.col(gone), "left_anti").drop(rid)
    return left.unionByName(docs.filter("doc_id is null"))
