"""Sinks and file sources: CSV, JSON lines, spreadsheets, arrays, PDF text, inventories and manifests of files."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.sources import tables


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; a temporary folder only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# -- sinks


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; quotes are doubled, so texts with line breaks come back as they were. Arrays become JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.csv(path, header=True, escape='"', quoteAll=True)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.json(path, ignoreNullFields=False)
    return path


def write_splits(df: DataFrame, split: str, path: str) -> str:
    """One folder for each split."""
    df.write.partitionBy(split).parquet(path)
    return path


def redacted(df: DataFrame, texts: list[str], key: str, rank: str, most: int = 3) -> DataFrame:
    """The first `most` rows of each key without texts: their hash and number of words instead."""
    first = df.filter(F.col(rank) <= most)
    extra = [e for c in texts for e in (X.sha256_text(F.col(c)).alias(f"{c}_sha256"), X.count_words(F.col(c)).alias(f"{c}_words"))]
    return first.select(*[c for c in df.columns if c not in texts], *extra)


def numbered(df: DataFrame, order: list, prefix: str) -> DataFrame:
    """df, an audit sheet of a few rows, with audit_id `<prefix>-0001`, ... by order."""
    return df.withColumn("audit_id", F.format_string(f"{prefix}-%04d", F.row_number().over(Window.orderBy(*order))))


def against(df: DataFrame, key: str, metric: str, baselines: list[str]) -> DataFrame:
    """df with the difference of metric to the rows of the named keys."""
    out = df
    for b in baselines:
        base = df.filter(F.col(key) == b).agg(F.max(metric).alias("_base"))  # one row
        out = out.crossJoin(F.broadcast(base)).withColumn(f"{metric}_less_{b}", F.round(F.col(metric) - F.col("_base"), 6)).drop("_base")
    return out


# -- file sources


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, content) of all files below path, but for empty ones, which Spark's source leaves out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, length, sha256) of all files below path that are not empty."""
    return files(spark, path, pattern).select("name", "length", F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """(name, length, hits): files whose name holds a keyword, with the keywords it holds."""
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("name"), k))
    return files(spark, path).select("name", "length", hits.alias("hits")).filter(F.size("hits") > 0)


def known_hashes(manifest_: DataFrame, private: DataFrame) -> DataFrame:
    """Rows of a manifest whose content is among the private ones (sha256)."""
    return manifest_.join(private.select("sha256").distinct(), "sha256", "left_semi")


def _each(spark: SparkSession, path: str, pattern: str, parse, schema: str) -> DataFrame:
    """Rows that parse(content) yields for every file, beside its name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                rows = [(name, *r) for r in parse(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["name", *(c.split()[0] for c in schema.split(", "))]
    return files(spark, path, pattern).select("name", "content").mapInPandas(run, f"name string, {schema}")


def parse_xlsx(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """Rows of the first sheet of a workbook as texts; rows without any text are left out."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", space)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for i, row in enumerate(ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", space)):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iterfind("m:c", space)):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = k if letters is None else sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters[0]))) - 1
                value = c.find("m:v", space)
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", space)) if value is None else value.text or ""
                cells[at] = shared[int(text)] if c.get("t") == "s" else text
            if any(v.strip() for v in cells.values()):
                yield i, [cells.get(k, "") for k in range(max(cells) + 1)]


def parse_npz(content: bytes) -> Iterator[tuple[str, int, list[float]]]:
    """(array, row, values) of every two-dimensional array of an archive; pickled arrays are refused."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        for key in z.files:
            for i, row in enumerate(np.atleast_2d(z[key])):
                yield key, i, row.astype(float).tolist()


def parse_pdf(content: bytes) -> Iterator[tuple[int, str]]:
    """(page_number, text) of content streams that show literal strings, plain or deflated; others have no text.

    No font is looked up, so files that encode glyphs by number need another parser in read_pdf().
    """
    page = 0
    for m in re.finditer(rb"<<(?P<d>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<s>.*?)endstream", content, re.S):
        data = m["s"]
        if b"FlateDecode" in m["d"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if not re.search(rb"\bBT\b", data):
            continue
        page += 1
        out = []
        for s in re.finditer(rb"\((?P<t>(?:\\.|[^\\()])*)\)|(?P<nl>\bT\*|\bT[dD]\b|\bET\b|'|\")", data, re.S):
            out.append("\n" if s["t"] is None else re.sub(rb"\\(.)", lambda e: {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(e[1], e[1]), s["t"], flags=re.S).decode("latin-1"))
        yield page, re.sub(r"\n+", "\n", "".join(out)).strip()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, cells) of the first sheet of every workbook below path."""
    return _each(spark, path, "*.xlsx", parse_xlsx, "row long, cells array<string>")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(name, array, row, values) of every array below path."""
    return _each(spark, path, "*.npz", parse_npz, "array string, row long, values array<double>")


def read_pdf(spark: SparkSession, path: str, parse=parse_pdf, max_pages: int | None = None) -> DataFrame:
    """(name, page_number, page_text) of every PDF file below path, by any function that yields (number, text) of its bytes."""
    pages = _each(spark, path, "*.pdf", parse, "page_number long, page_text string")
    return pages if max_pages is None else pages.filter(F.col("page_number") <= max_pages)


def read_yaml(path: str) -> dict:
    """Settings of a run, on the driver; JSON is YAML too."""
    try:
        import yaml
    except ImportError:
        import json

        with open(path, encoding="utf-8") as f:
            return json.load(f)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


# -- typed scans


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a CSV: allowed columns only, page 0 where it is no number, a missing hash made, a missing title the file's name.

    label is the first of true_label, final_label, gold_label and label_guess that is not empty.
    """
    schema = "candidate_id string, claim_text string, title string, pdf_filename string, page_number string, evidence_text string, evidence_text_sha256 string, true_label string, final_label string, gold_label string, label_guess string"
    x = tables.read_csv(spark, path, schema)
    either = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    sha = F.when((F.col("evidence_text_sha256") == "") & (F.col("evidence_text") != ""), X.sha256_text(F.col("evidence_text"))).otherwise(F.col("evidence_text_sha256"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.replace("pdf_filename", F.lit(".pdf"), F.lit("")))
    return x.select("candidate_id", "claim_text", title.alias("title"), tables.tolerant_int(F.col("page_number")).alias("page_number"), sha.alias("evidence_sha"), either("true_label", "final_label", "gold_label", "label_guess").alias("label"))


def chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a CSV whose extraction went well, without NUL characters; numbers that are none become 0."""
    x = tables.read_csv(spark, path, "chunk_id string, chunk_text string, extract_status string, page_start string, chunk_index string")
    number = lambda c: tables.tolerant_int(F.col(c)).alias(c)
    return x.filter("extract_status = 'ok'").select("chunk_id", F.translate("chunk_text", "\u0000", "").alias("chunk_text"), number("page_start"), number("chunk_index"))
