"""Registered queries on document files: tables written as PDF pages, workbooks and array archives, and read back in ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import _t, query
from tessera.sources import formats, store, tables


@query("SELECT doc_id, length(coalesce(text, ''))::INTEGER AS n_chars, md5(coalesce(text, '')) AS body FROM documents")
def pdf_pages(spark, d):
    """Documents as pages of PDF files and back, whole and with every character; a missing text is a page that shows nothing."""
    path = store.scratch(spark, "pdf")
    formats.register(spark)
    _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("label"), F.col("text").alias("page_text")).write.format("pages_pdf").mode("append").save(path)
    return spark.read.format("pages_pdf").load(path).select(F.col("label").cast("long").alias("doc_id"), F.length("page_text").alias("n_chars"), F.md5("page_text").alias("body"))


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS body FROM conversations")
def workbook_rows(spark, d):
    """Turns as workbooks and back; cells without text are null."""
    path = store.scratch(spark, "xlsx")
    formats.register(spark)
    _t(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.format("rows_xlsx").mode("append").save(path)
    back = spark.read.format("rows_xlsx").schema("conv_id string, turn string, role string, text string").load(path)
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5(F.coalesce("text", F.lit(""))).alias("body"))


@query("SELECT label, count(*) AS n, sum(len(embedding))::BIGINT AS n_entries, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[len(embedding)]::DOUBLE), 6) AS last FROM embeddings GROUP BY label")
def feature_cache(spark, d):
    """Vectors from archives of arrays, joined by key to what a CSV says of them."""
    e, path = _t(spark, d, "embeddings"), store.scratch(spark, "npz")
    formats.register(spark)
    e.select("vec_id", "embedding").write.format("arrays_npz").mode("append").save(path)
    about = tables.read_csv(spark, store.write_csv(e.select("vec_id", "label"), store.scratch(spark, "about")), "vec_id long, label int")
    x = spark.read.format("arrays_npz").schema("vec_id long, embedding array<float>").load(path).join(about, "vec_id")
    at = lambda i, name: F.round(F.avg(F.try_element_at("embedding", i).cast("double")), 6).alias(name)
    return x.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("n_entries"), at(F.lit(1), "first"), at(F.lit(-1), "last"))
