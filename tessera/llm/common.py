"""What the operators of this subpackage share: table access, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; bounds its memory however long the texts are.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that they need neither a shared checkout nor PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Documents vary from bytes to megabytes, so batches are cut by bytes as well as by rows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode, where nothing is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


#: Tables of durable() that still stand, in the order in which they were written.
_written: list[str] = []


def discard(*dfs: DataFrame) -> None:
    """Delete what durable() wrote, once nothing that is still to run reads it."""
    for df in dfs:
        if (path := getattr(df, "_tessera_path", None)) in _written:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def standing() -> int:
    """How many tables of durable() stand; sweep() takes it to delete those written since."""
    return len(_written)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since, apart from those of keep. What was lazily built on them must have been written."""
    kept = {getattr(df, "_tessera_path", None) for df in keep}
    for path in _written[since:]:
        if path not in kept:
            _delete(spark, path)


#: A key with more than one in HOT of all rows is joined apart; by counting, fewer than HOT keys can be.
HOT = 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with counted, which has a row for each key and in column n how many of the `total` rows have it.

    Keys of more than total / HOT rows, fewer than HOT of them whatever the data, meet their rows by broadcast; in the
    shuffle that joins the others no key has more than total / HOT rows. counted must have a column beside on and n.
    """
    often = F.col(n) * HOT > F.lit(total)
    k = [f"hot_{c}" for c in on]
    rest = [c for c in counted.columns if c not in on]
    side = lambda keep, names: counted.filter(keep).select(*[F.col(c).alias(x) for c, x in zip(on, names, strict=True)], *rest)
    met = rows.join(F.broadcast(side(often, k)), [F.col(c) == F.col(x) for c, x in zip(on, k, strict=True)], "left")
    hot = met.filter(F.col(n).isNotNull()).drop(*k)
    cold = met.filter(F.col(n).isNull()).drop(*k, *rest).join(side(~often, k), [F.col(c) == F.col(x) for c, x in zip(on, k, strict=True)]).drop(*k)
    return hot.unionByName(cold)


def fresh(taken: list[str], name: str) -> str:
    """name, lengthened until no column of taken has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """docs with a column that tells rows apart and ascends with key, and whether it is key itself.

    It is where key is a whole number that no two rows share and none lacks. Else rows are sorted by key and the whole
    row, numbered and written, so that a row keeps its number.
    """
    if docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        if docs.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
            return docs.withColumn(name, F.col(key).cast("long")), True
    # the second part of the order deals the rows of a very common key to several partitions
    plain = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    return durable(docs.orderBy(F.col(key), F.xxhash64(*[docs[f"`{c}`"] for c in plain])).withColumn(name, F.monotonically_increasing_id()), "rows"), False


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal leading columns in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def tasks(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its bytes suggest, so that it is not packed into a few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (id, component): alternating large-star and small-star.

    Each round is two hash aggregations and two equi-joins on node ids. A hub's rows meet only its own minimum, which
    join_counted() brings to them where they stand, so no task gets all of them and nothing is gathered per group.
    component is the smallest id reachable. Self-loops and repeated edges do no harm; an empty input gives an empty
    result.
    """

    def met(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
        return join_counted(rows, least, ["a"], "n", total)

    def large(e: DataFrame, total: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        return met(both.filter("b > a"), least, 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame, total: int) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return met(e, least, total).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    def settled(e: DataFrame) -> bool:
        """Whether every node below another has that one only, and none below it: components are stars around their least ids."""
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 OR (up = 1 AND low = 1)").isEmpty()

    cur = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    for _ in range(max_rounds):
        if settled(cur):
            break
        old, total = cur, cur.count()
        star = durable(large(cur, total).filter("a > b").distinct(), "edges")
        cur = durable(small(star, total).filter("a > b").distinct(), "edges")
        discard(old)
        discard(star)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
