"""Embedding near-dedup: an epsilon grid order join.

Unit vectors are sorted by the cells that a grid of width epsilon cuts along their leading principal axes. The sorted
sequence is cut into intervals of intervals; pairs of intervals are joined recursively, and a pair whose boxes on those
axes lie more than epsilon apart is skipped with all it holds. The upper levels recurse as equi-joins of intervals with
their children, the lower ones inside the task that holds two stretches of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, discard, durable, join_counted, runs, small_batches, tasks
from tessera.llm.hashing import roots

AXES = 4
#: Vectors of the bounded sample that the principal axes are taken from; they order the join and change no result.
AXES_SAMPLE = 20_000
STRETCH_BYTES = 2 << 20  # of the vectors of one row, joined within a task
BLOCK = 8  # stretches of a block; two blocks meet in one task, so a stretch is sent once for each block it meets
LEAF = 512
FAN = 8  # intervals in an interval of the next level


def _box_apart(axes: int, eps: float):
    """Whether boxes of intervals a and b lie more than eps apart."""
    gap = [F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}")) for i in range(axes)]
    return sum((g * g for g in gap), F.lit(0.0)) > eps * eps


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _join(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, eps: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b with cosine >= least; same: each pair of a with itself once."""
    xs, ys = [], []
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m or (same and m <= i):
            continue
        p, q = pa_[i:j], pb[k:m]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if j - i > LEAF or m - k > LEAF:
            mid, mid2 = (i + j) // 2, (k + m) // 2
            todo += [(i, mid, k, mid2), (i, mid, mid2, m), (mid, j, k, mid2), (mid, j, mid2, m)]
            continue
        x, y = np.nonzero(a32[i:j] @ b32[k:m].T >= least - 1e-4)  # single precision only sorts out
        x, y = x + i, y + k
        if same:
            x, y = x[x < y], y[x < y]
        ok = np.einsum("ij,ij->i", a[x], b[y]) >= least
        xs.append(x[ok])
        ys.append(y[ok])
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(xs), cat(ys)


def _linked(reps: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, w): for distinct vectors of one dimension, b null: a has w links more; else a and b are connected.

    Beside it, the written table it reads."""
    spark = reps.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    axes, stretch = min(AXES, dim), max(64, min(4096, STRETCH_BYTES // (8 * dim)))
    sample = np.array([r[0] for r in reps.orderBy(F.xxhash64("id")).limit(AXES_SAMPLE).select("embedding").collect()], float)
    _, v = np.linalg.eigh(np.cov(_unit(sample).T.reshape(dim, -1)) if len(sample) > 1 else np.eye(dim))
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(v[:, ::-1][:, :axes]))  # dim x 4 numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten()).astype(float).reshape(b.num_rows, dim)
            y = _unit(x) @ shared.value
            cells = np.floor(y / eps).astype(np.int32)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(cells[:, i]) for i in range(axes)), pa.array(raw, pa.binary())], ["id", "n", *(f"c{i}" for i in range(axes)), "x"])

    cells = [f"c{i}" for i in range(axes)]
    flat = reps.select("id", "n", "embedding").mapInArrow(project, "id long, n long, " + ", ".join(f"{c} int" for c in cells) + ", x binary")
    # ties of a crowded cell are dealt by a hash of the id, so that no cell is one task's
    order = [*cells, F.xxhash64("id")]
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    box = [f"{s}{i}" for i in range(axes) for s in ("lo", "hi")]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = at = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal at
            raw = b"".join(t.column("x").to_pylist())
            y = _unit(np.frombuffer(raw, float).reshape(-1, dim)) @ shared.value
            row = {"part": t.column("part")[0].as_py(), "at": at, "ids": np.asarray(t.column("id"), np.int64).tobytes(), "ns": np.asarray(t.column("n"), np.int64).tobytes(), "xs": raw}
            row |= {f"lo{i}": float(y[:, i].min()) for i in range(axes)} | {f"hi{i}": float(y[:, i].max()) for i in range(axes)}
            at += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            held.append(b)
            have += b.num_rows
            while have >= stretch:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, stretch))
                held, have = t.slice(stretch).to_batches(), have - stretch
        if have:
            yield out(pa.Table.from_batches(held))

    schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("ids", pa.binary()), ("ns", pa.binary()), ("xs", pa.binary()), *((c, pa.float64()) for c in box)])
    rows = durable(ordered.mapInArrow(stretches, "part int, at int, ids binary, ns binary, xs binary, " + ", ".join(f"{c} double" for c in box)), "stretches")
    parts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, offsets = 0, []
    for p in sorted(parts):
        offsets.append((p, before))
        before += parts[p]
    numbered = rows.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("node", F.col("offset") + F.col("at"))

    levels = [numbered.select("node", *box)]
    width = before
    while width > 1:
        width = -(-width // FAN)
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in box]))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        kid = level.withColumn("up", F.floor(F.col("node") / FAN))
        side = lambda s: kid.select(F.col("up").alias(f"{s}_up"), F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in box])  # noqa: B023, E731
        pairs = pairs.join(side("a"), F.col("a") == F.col("a_up")).join(side("b"), F.col("b") == F.col("b_up")).filter((F.col("a_node") <= F.col("b_node")) & ~_box_apart(axes, eps)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    # a pair of blocks gets each of its stretches once, however many pairs of stretches are left in it
    met = pairs.withColumn("i", F.floor(F.col("a") / BLOCK)).withColumn("j", F.floor(F.col("b") / BLOCK))
    need = met.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    data = need.join(numbered.select("node", "ids", "ns", "xs"), "node").select("i", "j", "node", "ids", "ns", "xs")
    data = data.repartition(tasks(spark), "i", "j").sortWithinPartitions("i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            part = {}
            for r in t.select(["node", "ids", "ns", "xs"]).to_pylist():
                x = _unit(np.frombuffer(r["xs"], float).reshape(-1, dim))
                part[r["node"]] = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ns"], np.int64), x, x @ shared.value)
            at = dict(zip(part, np.cumsum([0, *(len(v[0]) for v in part.values())]), strict=False))
            ids, ns = (np.concatenate([v[k] for v in part.values()]) for k in (0, 1))
            xs, ys = [], []
            for p in part:
                for q in part:
                    if p <= q and p // BLOCK == i and q // BLOCK == j:
                        x, y = _join(part[p][2], part[p][3], part[q][2], part[q][3], p == q, eps, least)
                        xs.append(x + at[p])
                        ys.append(y + at[q])
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
            w = np.bincount(x, ns[y], len(ids)) + np.bincount(y, ns[x], len(ids))
            some = np.flatnonzero(w)
            root = roots(len(ids), x, y)
            far = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids[some], ids[far]))), pa.array([*([None] * len(some)), *ids[root[far]].tolist()], pa.int64()), pa.array(np.concatenate((w[some], np.zeros(len(far)))).astype(np.int64))], ["a", "b", "w"]
            )

    return data.mapInArrow(run, "a long, b long, w long"), rows


def _lengths(reps: DataFrame) -> list[int]:
    """The lengths that two or more distinct vectors have, all of them; a single vector has nothing to link with."""
    return sorted(r.dim for r in reps.groupBy("dim").count().filter("count > 1").collect())


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Vectors link where their cosine in double precision is >= least. n_links: other rows linked directly;
    component_id: the smallest vec_id reachable, the row's own included; kept: it is the row's own. Null, empty and
    zero vectors and ones with null or non-finite components link with nothing, vectors of different lengths neither.
    Equal vectors are one until the end, so their pairs are never made; repeated rows count as vectors of their own
    and share their id's component. Rows with a null vec_id link with nothing: component_id null, kept true. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.transform("embedding", lambda c: c.cast("double"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    big = F.array_max(F.transform("embedding", F.abs))
    fine = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c)) & (big < float("inf")) & (big > 0), F.lit(False))
    reps = durable(own.filter(fine).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")), "vectors")
    # in range for the sums of squares, however large or small the components are
    scaled = reps.withColumn("embedding", F.transform("embedding", lambda c: c / F.array_max(F.transform("embedding", F.abs))))
    found = spark.createDataFrame([], "a long, b long, w long")
    used: list[DataFrame] = []
    for i, d in enumerate(_lengths(reps)):
        if i % 50 == 49:  # ends the lineage now and then, so that many lengths do not make one plan
            found, old = durable(found, "vector-links"), [*used, found]
            discard(*old)
            used = [found]
        links, rows = _linked(scaled.filter(F.col("dim") == d), d, least)
        found = found.unionByName(links)
        used.append(rows)
    found = durable(found, "vector-links")
    discard(*used)
    degree = found.filter("b is null").groupBy(F.col("a").alias("d_id")).agg(F.sum("w").alias("w"))
    comp = components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("c_id"), F.col("component"))
    named = reps.join(degree, F.col("id") == F.col("d_id"), "left").join(comp, F.col("id") == F.col("c_id"), "left")
    named = durable(named.select("embedding", "n", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("root")), "vector-names")
    discard(reps, found)
    bare = own.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))
    out = join_counted(own.filter(fine), named, ["embedding"], "n", vectors.count()).select("vec_id", "n_links", "root").unionByName(bare)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
