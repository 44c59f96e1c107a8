"""Readers: Parquet by table name, CSV and JSON lines under fixed schemas, binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks and empty strings kept as values, never null."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped, or raise if strict."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, page_number, page_text) of text files whose pages are parted by form feeds."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page_number", "page_text"))


def tolerant_int(x) -> F.Column:
    """Whole numbers from text; anything else is 0."""
    return F.when(F.rlike(x, F.lit("^[0-9]+$")), F.coalesce(x.try_cast("int"), F.lit(0))).otherwise(0)


def tolerant_bool(x) -> F.Column:
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes")
