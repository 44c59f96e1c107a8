"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string that ends a word is given to the merge table alone; those that come
back as one token form a set of *whole tokens*. In the corpus a pre-token of that set counts one without merging, and
only the rest goes through the merges, behind a bounded cache of lengths.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

#: Lengths of merged pre-tokens that a worker remembers.
CACHE_ENTRIES = 200_000

# The split pattern of the word vocabulary, with its white space written out for characters under U+0300.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t\n\x0b\x0c\r \x85\xa0\p{L}\p{N}]+")
#: Characters from U+0300 on may compose, or belong to other Unicode versions' classes: the library cuts such texts.
_FAR = regex.compile("[^\x00-˿]")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stay, others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return out


def whole_tokens(tokenizer_json: str) -> list[str]:
    """The pre-tokens (as text) that are proven to encode alone as one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    spec = json.loads(tokenizer_json)
    end = spec["model"].get("end_of_word_suffix") or ""
    back = {v: k for k, v in byte_letters().items()}
    out = []
    for entry in spec["model"]["vocab"]:
        body = entry[: len(entry) - len(end)] if end else entry
        if not body or not entry.endswith(end) or any(c not in back for c in body):
            continue
        try:
            text = bytes(back[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(model.tokenize(body)) == 1:
            out.append(text)
    return out


class Lengths(dict):
    """Pre-token -> number of tokens. Starts as the whole tokens; misses are merged and, up to a bound, kept."""

    def __init__(self, whole: list[str], model, limit: int = CACHE_ENTRIES):
        super().__init__((w, 1) for w in whole)
        self.model, self.limit = model, limit + len(whole)
        self.letters = byte_letters()

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters)))
        if len(self) < self.limit:
            self[word] = n
        return n


class Counter:
    def __init__(self, tokenizer_json: str, whole: list[str]):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(tokenizer_json)
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.lengths = Lengths(whole, self.lib.model)

    def plain(self, text: str) -> int:
        if _FAR.search(text):
            cut = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
            back = {v: k for k, v in self.lengths.letters.items()}
            words = [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in cut]
        else:
            words = _SPLIT.findall(text.lower())
        return sum(map(self.lengths.__getitem__, words))

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows and repeated or null ids
    give one result row each, other columns are ignored, an empty table gives an empty result, and a long text only
    costs its own length. Map only: no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    cols = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
