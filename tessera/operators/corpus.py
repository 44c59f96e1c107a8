"""Documents to blocks, sentences, windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.sources import store


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if it has no more rows than said; its rows must be of bounded size."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeated_edges(pages: DataFrame, paper: str, page: str, text: str) -> DataFrame:
    """(paper, n_pages, edges): lines under 120 characters among the first and last three of at least half a paper's pages.

    Three pages at least. A page gives six lines at most, so a paper has twelve such lines at most, whatever its length.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda s: F.trim(s))
    ends = F.concat(F.slice(lines, 1, 3), F.reverse(F.slice(F.reverse(lines), 1, 3)))
    seen = pages.select(paper, page, F.explode(F.array_distinct(F.filter(ends, lambda s: (s != "") & (F.length(s) < 120)))).alias("line"))
    n = pages.groupBy(paper).agg(F.count("*").alias("n_pages"))
    often = seen.groupBy(paper, "line").agg(F.count("*").alias("c")).join(small(n), paper).filter((F.col("n_pages") >= 3) & (F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") / 2))))
    return n.join(often.groupBy(paper).agg(F.array_sort(F.collect_set("line")).alias("edges")), paper, "left").select(paper, "n_pages", F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def clean_pages(docs: DataFrame, paper: str = "source", page: str = "doc_id", text: str = "text") -> DataFrame:
    """(paper, page, text): pages cleaned, with page numbers and the paper's repeated headers and footers taken out.

    Lines are compared after single line breaks have become spaces, hence whole paragraphs.
    """
    pages = docs.select(paper, page, T.clean_page(F.col(text)).alias("text"))
    edges = repeated_edges(pages, paper, page, "text")
    keep = lambda s: ~F.rlike(F.trim(s), F.lit("^[0-9]+$")) & ~F.array_contains("edges", F.trim(s))
    return pages.join(small(edges), paper).select(paper, page, F.array_join(F.filter(F.split("text", "\n"), keep), "\n").alias("text"))


def blocks(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block_id, block, n_words, section): paragraphs of clean pages, numbered as they stand, empty ones dropped.

    A block's section is its own hint, or that of the last heading (a block under ten words with a hint) before it.
    """
    raw = pages.select(key, F.posexplode(T.paragraphs(F.col("text"))).alias("block_id", "block")).filter("block != ''")
    raw = raw.withColumn("block", F.regexp_replace("block", r"[ \t]+", " ")).withColumn("own", T.section_hint(F.col("block"))).withColumn("n_words", T.count_words(F.col("block")))
    w = Window.partitionBy(key).orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when((F.col("n_words") < 10) & (F.col("own") != "unknown"), F.col("own")), ignorenulls=True).over(w)
    return raw.withColumn("section", F.when(F.col("own") != "unknown", F.col("own")).otherwise(F.coalesce(carried, F.lit("unknown")))).drop("own")


def retrieval_units(blocks_: DataFrame, key: str = "doc_id", least: int = 5) -> DataFrame:
    """(key, block_id, sentence_id, sentence, n_words, section): sentences of `least` words or more, numbered within a page."""
    cut = blocks_.select(key, "block_id", "section", F.posexplode(T.split_sentences(F.col("block"))).alias("i", "sentence")).withColumn("n_words", T.count_words(F.col("sentence"))).filter(F.col("n_words") >= least)
    number = F.row_number().over(Window.partitionBy(key).orderBy("block_id", "i")) - 1
    return cut.select(key, "block_id", number.alias("sentence_id"), "sentence", "n_words", "section")


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_id, sentence): sentences of the whole text, numbered from 0."""
    return docs.select(key, F.posexplode(T.split_sentences(F.col("text"))).alias("sent_id", "sentence"))


def forward_windows(rows: DataFrame, size: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, start, n, window): each run of `size` sentences; one shorter run where a document has fewer."""
    order = Window.partitionBy(key).orderBy("sent_id")
    frame = order.rowsBetween(0, size - 1)
    all_ = Window.partitionBy(key)
    out = rows.select(key, F.col("sent_id").alias("start"), F.collect_list("sentence").over(frame).alias("parts"), F.row_number().over(order).alias("rn"), F.count("*").over(all_).alias("total"))
    return out.filter(F.col("rn") <= F.greatest(F.lit(1), F.col("total") - size + 1)).select(key, "start", F.size("parts").alias("n"), F.array_join("parts", " ").alias("window"))


def document_windows(docs: DataFrame, size: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, start, n, window): forward_windows of whole texts, cut from a document's sentences within its row, without a shuffle."""
    rows = docs.select(key, T.split_sentences(F.col("text")).alias("s"))
    # a filter on the number of sentences would split every text twice
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - (size - 1)))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.slice("s", i, F.lit(size)).alias("parts")))
    return rows.select(key, F.inline(cut)).select(key, "start", F.size("parts").alias("n"), F.array_join("parts", " ").alias("window"))


def centred_windows(rows: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, window): each unit with the one before and the one after."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select(key, order, F.concat_ws(" ", F.lag(text).over(w), F.col(text), F.lead(text).over(w)).alias("window"))


def document_centred(docs: DataFrame, least: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, sent_id, window): each sentence of `least` words or more with those before and after it, within a document's row."""
    long_ = F.filter(F.transform(T.split_sentences(F.col("text")), lambda s, i: F.struct(s.alias("s"), i.cast("long").alias("sent_id"))), lambda x: T.count_words(x["s"]) >= least)
    near = F.transform("l", lambda x, k: F.struct(x["sent_id"].alias("sent_id"), F.concat_ws(" ", F.get("l", k - 1)["s"], x["s"], F.get("l", k + 1)["s"]).alias("window")))
    return docs.select(key, long_.alias("l")).select(key, F.inline(near))


def centred_words(docs: DataFrame, least: int = 5, stop: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, sent_id, words): document_centred() as words, without stop words.

    No word reaches over the space between sentences, so each sentence is cut into words once, for the three windows
    that hold it, and the sentences' words are stored, since retrieval reads windows twice.
    """
    long_ = F.filter(F.transform(T.split_sentences(F.col("text")), lambda s, i: F.struct(s.alias("s"), i.cast("long").alias("sent_id"))), lambda x: T.has_words(x["s"], least))
    path = store.scratch(docs.sparkSession, "words")
    docs.select(key, F.transform(long_, lambda x: F.struct(x["sent_id"].alias("sent_id"), K.tokenize(x["s"], stop=stop).alias("words"))).alias("l")).write.parquet(path)
    beside = lambda k: F.coalesce(F.get("l", k)["words"], F.array().cast("array<string>"))
    near = F.transform("l", lambda x, k: F.struct(x["sent_id"].alias("sent_id"), F.concat(beside(k - 1), x["words"], beside(k + 1)).alias("words")))
    return docs.sparkSession.read.parquet(path).select(key, F.inline(near))


def among(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that stand in ranked, a table of a few rows a claim that is stored."""
    return docs.join(small(ranked.select(key).distinct()), key, "left_semi")


def chunks(docs: DataFrame, size: int = 200, stride: int = 150, least: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, chunk, n_words, chunk_text): overlapping runs of words; runs under `least` words are dropped."""
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    rows = docs.select(key, words.alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))
    return rows.select(key, F.posexplode(cut).alias("chunk", "part")).filter(F.size("part") >= least).select(key, "chunk", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk_text"))


def repeated_lines(docs: DataFrame, least: int = 3, key: str = "doc_id", group: str = "source") -> DataFrame:
    """(group, line, n_docs): lines that stand in at least `least` documents of a group: headers and footers."""
    lines = docs.select(group, key, F.explode(F.split("text", r"\n")).alias("raw")).select(group, key, F.trim("raw").alias("line")).filter("line != ''")
    return lines.groupBy(group, "line").agg(F.count_distinct(key).alias("n_docs")).filter(F.col("n_docs") >= least)


def chunk_hits(chunks_: DataFrame, claims: DataFrame, least: int = 30) -> DataFrame:
    """Claims contained in chunks, after normalisation, by an equi-join on the claim's first words.

    claims (item_id, text). A contained claim starts at one of the chunk's words, so its first five words, taken at
    every word of the chunk, find it without comparing every claim with every chunk.
    """
    q = claims.select("item_id", T.normalize_plain(F.col("text")).alias("needle")).filter(F.length("needle") >= least)
    q = q.withColumn("head", F.array_join(F.slice(F.split("needle", " "), 1, 5), " "))
    c = chunks_.withColumn("hay", T.normalize_plain(F.col("chunk_text"))).withColumn("w", F.split("hay", " "))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.lit(5)), " ")))
    # a chunk's text would be copied for each of its words: only the few that meet are looked at as a whole
    met = c.select("doc_id", "chunk", F.explode(heads).alias("head")).join(small(q), "head").select("doc_id", "chunk", "item_id", "needle")
    path = store.scratch(met.sparkSession, "met")
    met.write.parquet(path)
    met = small(met.sparkSession.read.parquet(path))
    return c.select("doc_id", "chunk", "hay").join(met, ["doc_id", "chunk"]).filter(F.contains("hay", F.col("needle"))).select("doc_id", "chunk", "item_id").distinct()
