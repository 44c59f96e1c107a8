"""Nested manifests: JSON of any shape walked as Variant values, so that keys need not be known before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import store


def parsed(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, v): the JSON of each row as a Variant; null where it is null or not JSON."""
    return df.select(*keys, F.try_parse_json(F.col(json)).alias("v"))


def _opened(df: DataFrame, value: str, explode) -> DataFrame:
    """df with _pos, _key and _value of each member of the Variant in value; explode is a function of spark.tvf."""
    return df.lateralJoin(explode(F.col(value).outer()).toDF("_pos", "_key", "_value"))


def members(df: DataFrame, value: str, name: str | None = None, place: str | None = None) -> DataFrame:
    """df with a row for each member of the object or array in value, which the member replaces.

    name is the column for an object's key (null in an array), place that for an array's position (null in an object);
    what is neither object nor array, or is empty, gives no row.
    """
    each = _opened(df, value, df.sparkSession.tvf.variant_explode)
    rest = [F.col(c) for c in df.columns if c != value]
    extra = ([F.col("_key").alias(name)] if name else []) + ([F.when(F.col("_key").isNull(), F.col("_pos")).alias(place)] if place else [])
    return each.select(*rest, *extra, F.col("_value").alias(value))


def leaves(df: DataFrame, keys: list[str], json: str, levels: int = 16) -> DataFrame:
    """(keys, path, kind, text): every value of every row's JSON that holds no other, with the path to it.

    A path names keys, and [] for any place in an array; kind is the type. Empty objects and arrays are leaves of their
    own. A row that is null or not JSON has no leaf. JSON nested deeper than levels is an error. Rows are parsed and
    stored once; one pass over them opens all levels, as many as the deepest row has, where each row stands.
    """
    spark = df.sparkSession
    path = store.scratch(spark, "nested")
    parsed(df, keys, json).write.parquet(path)
    cur = spark.read.parquet(path).filter("v IS NOT NULL").withColumn("path", F.lit(""))
    for _ in range(levels):
        if not members(cur, "v").limit(1).count():  # a task stops at its first value that holds others
            out = cur.withColumn("kind", F.regexp_replace(F.schema_of_variant("v"), r"(?s)^(OBJECT|ARRAY)<.*$", "$1"))
            return out.select(*keys, "path", "kind", F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.lit("")).otherwise(F.expr("cast(v AS string)")).alias("text"))
        leaf = F.col("_pos").isNull()
        name = F.when(F.col("_key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("_key")).otherwise(F.concat_ws(".", "path", "_key"))
        cur = _opened(cur, "v", spark.tvf.variant_explode_outer).select(*keys, F.when(leaf, F.col("path")).otherwise(name).alias("path"), F.when(leaf, F.col("v")).otherwise(F.col("_value")).alias("v"))
    raise ValueError(f"JSON nested deeper than {levels} levels")


def field(value: str, path: str, kind: str) -> Column:
    """A member of a Variant by its path, null where it is absent or of another kind."""
    return F.try_variant_get(F.col(value), f"$.{path}", kind)


def ledger(df: DataFrame, keys: list[str], json: str, fields: dict[str, str]) -> DataFrame:
    """(keys, grp, place, fields): the records of a manifest that maps groups of unknown names to arrays of records.

    fields gives each wanted member's type; records lacking one have null there. place counts a group's records from 0.
    """
    groups = members(parsed(df, keys, json).filter("v IS NOT NULL"), "v", name="grp").filter("grp IS NOT NULL")
    records = members(groups, "v", place="place").filter("place IS NOT NULL")
    return records.select(*keys, "grp", F.col("place").cast("int").alias("place"), *[field("v", f, kind).alias(f) for f, kind in fields.items()])
