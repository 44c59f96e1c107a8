"""Containment of texts in texts, by equi-joins on rare character runs instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import store

#: Characters of the runs that index texts; shorter texts are looked up by runs of their own length.
RUN = 8
#: Characters of the pieces that runs are cut from.
PIECE = 256


#: Hays, and characters of them, whose runs are sent to all needles; and runs that are compared with hays as literals.
FEW, FEW_CHARS, LITERALS = 10_000, 1_000_000, 5_000


def _anchor_runs(needle: str) -> Column:
    """The first, middle and last run of a text."""
    n = F.length(needle)
    size = F.least(F.lit(RUN), n)
    return F.array(*[F.substring(F.col(needle), i, size) for i in (F.lit(1), F.floor((n - size) / 2).cast("int") + 1, n - size + 1)])


def _anchors(needles: DataFrame) -> DataFrame:
    """(needle, run): the first, middle and last run of each distinct text."""
    return needles.select("needle", F.explode(F.array_distinct(_anchor_runs("needle"))).alias("run"))


def _runs(piece: Column, size: int) -> Column:
    """All runs that start in a piece; a longer text would be walked from its start for each."""
    starts = F.sequence(F.lit(1), F.greatest(F.least(F.length(piece) - (size - 1), F.lit(PIECE)), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(piece, i, F.lit(size)))


def _found(hay: str, sizes: list[int], only: list[str] | None = None) -> Column:
    """The distinct runs of a text, or those that stand in `only`."""
    begins = F.sequence(F.lit(0), F.floor((F.length(hay) - 1) / PIECE).cast("int"))
    pieces = F.transform(begins, lambda j: F.substring(F.col(hay), j * PIECE + 1, F.lit(PIECE + RUN - 1)))
    wanted = lambda runs: runs if only is None else F.filter(runs, lambda r: r.isin(*only))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.concat(*[wanted(_runs(p, s)) for s in sizes]))))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = store.scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _possible(n: DataFrame, h: DataFrame) -> DataFrame:
    """The needles of which no anchor is missing in all hays, if the hays are few: their runs are then sent to the needles."""
    size = h.select(F.length("hay").alias("c")).limit(FEW + 1).agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    if size.n > FEW or (size.c or 0) > FEW_CHARS:
        return n
    runs = F.broadcast(_stored(h.select(F.explode(_found("hay", list(range(1, RUN + 1)))).alias("run")).distinct(), "runs"))
    for k in range(3):
        n = n.join(runs, F.get(_anchor_runs("needle"), F.lit(k)) == F.col("run"), "left_semi")
    return _stored(n, "needles")


def contained(needles: DataFrame, needle_key: str, needle: str, hays: DataFrame, hay_key: str, hay: str) -> DataFrame:
    """(needle_key, hay_key) of all pairs whose first text stands in the second, itself included if equal.

    Null and empty texts neither hold nor are held. Each distinct needle is looked up by that of its first, middle and
    last run which the fewest different hays hold; a run that no hay holds ends the search for its needle at once. Where
    hays are few, needles with a run that they lack go first, where they stand. Runs of hays meet the anchors within the
    hay's row where the anchors are few, else by equi-join, and what meets is stored; a run that very many hays hold is joined only
    for needles which have no rarer one, and then all its hays are candidates that the whole texts decide.
    """
    n = needles.filter(F.length(needle) > 0).select(F.col(needle_key), F.col(needle).alias("needle"))
    h = hays.filter(F.length(hay) > 0).select(F.col(hay_key), F.col(hay).alias("hay"))
    n = _possible(n, h)
    anchors = _anchors(n.select("needle").distinct())
    sizes = sorted(r[0] for r in n.select(F.least(F.lit(RUN), F.length("needle"))).distinct().collect())  # RUN of them at most
    if not sizes:
        return n.join(h, F.lit(False)).select(needle_key, hay_key)
    wanted = anchors.select("run").distinct()
    few = [r.run for r in wanted.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        met = h.select(hay_key, F.explode(_found("hay", sizes, few)).alias("run"))
    else:
        met = h.select(hay_key, F.explode(_found("hay", sizes)).alias("run")).join(wanted, "run", "left_semi")
    met = _stored(met, "met")
    count = met.groupBy("run").agg(F.count("*").alias("n"))
    ranked = anchors.join(count, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("needle").agg(F.min(F.struct("n", "run")).alias("best")).filter("best.n > 0").select("needle", F.col("best.run").alias("run"))
    pairs = met.join(best, "run").select("needle", hay_key).join(h, hay_key).filter(F.contains("hay", "needle")).select("needle", hay_key)
    return n.join(pairs, "needle").select(needle_key, hay_key)


def lookup(rows: DataFrame, key: str, text: str, table: DataFrame, order: str, table_text: str, values: list[str]) -> DataFrame:
    """(key, kind, values): for each row the table's row of the same text, else one that holds it or is held by it, else zeros.

    Of several the least by order, which no two rows of the table share. kind is exact, substring or missing. The table
    is read four times, so it is stored first.
    """
    path = store.scratch(table.sparkSession, "lookup")
    table.write.parquet(path)
    table = table.sparkSession.read.parquet(path)
    t = table.select(F.col(order).alias("_o"), F.col(table_text).alias("_t"))
    r = rows.select(key, F.col(text).alias("_x"))
    exact = r.join(t, F.col("_x") == F.col("_t")).select(key, "_o", F.lit(0).alias("_rank"))
    either = contained(r, key, "_x", t, "_o", "_t").unionByName(contained(t, "_o", "_t", r, key, "_x")).select(key, "_o", F.lit(1).alias("_rank"))
    first = exact.unionByName(either).groupBy(key).agg(F.min(F.struct("_rank", "_o")).alias("_m")).select(key, "_m.*")
    found = first.join(table.select(F.col(order).alias("_o"), *values), "_o")
    kind = F.when(F.col("_rank") == 0, "exact").when(F.col("_rank") == 1, "substring").otherwise("missing")
    return rows.select(key).join(found, key, "left").select(key, kind.alias("kind"), *[F.coalesce(F.col(v), F.lit(0).cast(table.schema[v].dataType)).alias(v) for v in values])
