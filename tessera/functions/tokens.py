"""Tokenizers and set similarities as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import text as T

# Token patterns by name, each operator says which it takes; and words that it leaves out.
PATTERNS = {
    "hyphen": r"[a-z0-9]+(?:[-'][a-z0-9]+)*",
    "plain": r"[a-z0-9]+",
    "word": r"[a-z][a-z0-9_-]{2,}",
    "letter": r"[a-z][a-z0-9_\-]+",
    "pair": r"[a-z0-9]+(?:-[a-z0-9]+)?",
    "words": r"[\p{L}\p{N}_]{2,}",
}
STOP_WORDS = {
    "selection": [
        "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
        "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "this", "that",
        "these", "those", "i", "you", "he", "she", "it", "we", "they", "as", "if", "then", "than", "so", "such", "not", "no", "nor", "just", "only",
        "also", "too", "very", "more", "most", "some", "any", "all",
    ],
    "leakage": [
        "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "this", "that", "these", "those",
        "it", "its", "as", "by", "from", "we", "our", "their",
    ],
    "realism": [
        "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "this", "that",
        "these", "those", "it", "its", "as", "with", "by", "from", "at", "into", "over", "under", "above", "below", "between", "among", "through",
        "during", "before", "after", "not", "no",
    ],
    "toy": [
        "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were",
    ],
}
STOP_WORDS["retrieval"] = [*STOP_WORDS["selection"], "each", "every", "other", "another", "same", "different", "new", "old"]


def tokenize(x: Column, kind: str = "hyphen", stop: list[str] | None = None) -> Column:
    out = F.regexp_extract_all(F.lower(x), F.lit(PATTERNS[kind]), F.lit(0))
    return F.filter(out, lambda t: ~t.isin(*stop)) if stop else out


def ngrams(tokens: Column, n: int, joiner: str = "__") -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), joiner))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared share of two arrays as sets; `empty` where both are."""
    united = F.size(F.array_union(a, b))
    return F.when(united == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / united)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def count_terms(x: Column, terms: list[str]) -> Column:
    """How many of the terms occur in x as substrings, each once."""
    low = F.lower(x)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def numbers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def number_conflict(a: Column, b: Column) -> Column:
    """Both hold numbers, and not the same ones."""
    p, q = numbers(a), numbers(b)
    return (F.size(p) > 0) & (F.size(q) > 0) & ((F.size(F.array_except(p, q)) > 0) | (F.size(F.array_except(q, p)) > 0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching share of two texts by longest common blocks, 0 where either is empty; no built-in has this measure."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def word_cues(x: Column, cues: list[str], short: int = 3) -> Column:
    """How many cues occur in x: short ones as whole words, others as substrings."""
    low = F.lower(x)
    return sum(((F.rlike(low, F.lit(T.edged(rf"\b{c}\b"))) if len(c) <= short else F.contains(low, F.lit(c))).cast("int") for c in cues), F.lit(0))
