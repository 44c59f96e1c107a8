"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets the repetition rate that turns its share into its weight; a document's number of copies is the inverse
Poisson distribution of that mean at a uniform number hashed from seed and id, so it is the same in every run and on
every cluster. A rate above PART is drawn as equal parts with a number each, whose sum has the same distribution.
Documents are exploded by their count and shuffled globally by a hash of seed, id and copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

#: The largest mean that one table of probabilities is made for; a table has LAST entries at most, 1.3 KB.
PART = 64.0
LAST = 164
#: Sources whose tables may be broadcast, 13 MB at most; beyond that the join is salted instead.
BROADCAST_SOURCES = 10_000
SALTS = 64


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): mean copies of each source present, and the cumulative Poisson distribution of a part.

    The number of copies is the sum of `parts` draws of mean rate / parts, at most PART each, so that a table is of
    LAST entries or fewer however rare a source is.
    weights: source -> weight, scaled to sum 1 over the sources present; a source without one gets 0 and so no copies.
    None: every source present alike. size: rows wanted, as a multiple of the rows given.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.lit(1.0)
    elif not weights:
        w = F.lit(0.0)
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]).cast("map<string,double>"), F.coalesce("source", F.lit(""))), F.lit(0.0))
    counts = counts.withColumn("w", w)
    total = counts.agg(F.sum("n").alias("total_n"), F.sum("w").alias("total_w"))  # one row
    out = counts.crossJoin(F.broadcast(total)).withColumn("rate", F.when(F.col("total_w") > 0, F.lit(float(size)) * F.col("w") / F.col("total_w") * F.col("total_n") / F.col("n")).otherwise(0.0))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("lf"), F.exp(-F.col("mean")).alias("sum"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc, k):
        lf = acc["lf"] + F.log(k.cast("double"))
        s = acc["sum"] + F.exp(k * F.log("mean") - F.col("mean") - lf)
        return F.struct(lf.alias("lf"), s.alias("sum"), F.concat(acc["cdf"], F.array(s)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).otherwise(F.array(F.lit(2.0)))
    return out.select("source", "rate", "parts", cdf.alias("cdf"))


def uniform(doc_id, seed: int, part=None):
    """52 bits of the md5 of seed, part (none for the first) and id, as a number in [0, 1)."""
    mark = F.lit("") if part is None else F.when(part > 1, F.concat(part.cast("string"), F.lit("/"))).otherwise("")
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), mark, F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(bits, 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, size: float = 1.0) -> DataFrame:
    """Rows of docs, each as often as drawn, with mix_copy (1, 2, ...) and mix_key, in a global random order.

    Rows with null source form a source of their own, under "" in weights. Repeated rows and rows of equal or null id
    get the same number of copies each. Null, empty and long texts are carried like others. An empty table gives an
    empty result. Columns called mix_copy or mix_key are replaced; all others pass through, whatever their names. The
    only shuffle of texts is the one that orders them; sources are never a shuffle key, so a source with a third of all
    rows is no hot spot. The order: hash-dealt to partitions and sorted within by mix_key.
    """
    own = docs.drop("mix_copy", "mix_key")
    source, cdf, parts, salt, at, times = (fresh(own.columns, f"mix_{c}") for c in ("source", "cdf", "parts", "salt", "at", "times"))
    table = rates(docs, weights, size).select(F.col("source").alias(source), F.col("cdf").alias(cdf), F.col("parts").alias(parts))
    if table.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(table), F.col("source").eqNullSafe(F.col(source)), "left")
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn(at, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col(source)) & (F.col(at) == F.col(salt)), "left").drop(at, salt)
    one = F.size(F.filter(cdf, lambda c: c <= uniform(F.col("doc_id"), seed)))
    more = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, i: n + F.size(F.filter(cdf, lambda c: c <= uniform(F.col("doc_id"), seed, i))))
    copies = joined.withColumn(times, F.when(F.col(parts) == 1, one).otherwise(more)).drop(source, cdf, parts).filter(F.col(times) > 0)
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
    key = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
