"""A corpus from raw documents: quality filter, near-duplicate removal, redaction, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it back as the next stage's documents. All stages but the last return the columns of documents, other
columns of theirs included, whatever their names. In every stage an empty table gives an empty result; what becomes of
nulls, empty and very long texts, ties and repeated rows is said in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, pii, quality, unigram
from tessera.llm.common import durable, fresh, standing, sweep, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good (score >= 0.7); the others go.

    A null text is scored as the empty text, and long ones whole. Equal texts share their fate, so repeated rows stay or
    go together; ids, null ones too, play no part. Columns named score or predicted are kept as they are.
    """
    own = fresh(docs.columns, "quality_text")
    scored = quality.score_documents(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(f"{own}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Texts without words (null, empty) and rows with a null id stay. Rows are judged by their own texts: of repeated rows
    one stays, and an id repeated with different texts keeps them. Long texts are compared whole.
    """
    return minhash.one_of_each(docs, 80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text.

    Every row stays, repeated ones and those with a null id too; a null text stays null, an empty one empty; long texts
    are read whole.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that all sources weigh alike, in a global random order.

    Null is a source of its own. The number of copies follows the id, so repeated rows and rows with null ids of a
    source get the same number each; texts play no part. Columns named mix_copy or mix_key are kept as they are.
    """
    own = fresh(docs.columns, "mix_row")
    mixed = mixing.mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), "doc_id", "source"))
    return mixed.select(f"{own}.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text.

    Null text counts as empty and has no pieces. Every row keeps its own, repeated ones and those with a null id too;
    long texts are encoded whole. The only model at hand is of another kind than the method (see README): ids are those
    of the best path over its scores, not the library's.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    # decoded in the worker that encoded, so that texts and pieces do not travel again
    coded = unigram.encode_documents(docs.select("doc_id", "source", "lang", "text"), path, same="round_trip")
    return coded.select("doc_id", "source", "lang", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("redact", redact),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Compression, signatures and piece models have no SQL form; tests/llm/test_stages.py holds each stage against a plain
#: version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; of what the stages wrote on the way, only the documents that it reads still stand."""
    docs = table(spark, sf_dir, "documents")
    since = standing()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        sweep(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
