"""Error tags, outcomes and routes of scored candidates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label indices, and the limits past which a tag is set.
SUPPORTED, MILD, STRONG, CONTRA = 0, 1, 2, 3
LOW_SELECTOR, HIGH_ENTROPY, HIGH_CONTRA = 0.30, 0.50, 0.30
FEW_WORDS, MANY_WORDS, MANY_SENTENCES, HIGH_RANK = 5, 50, 3, 5
# Words of action.
ACTIONS = """extend extends extended extending add adds added adding improve improves improved improving propose proposes proposed
    proposing introduce introduces introduced introducing enhance enhances enhanced enhancing boost boosts boosted boosting increase
    increases increased increasing achieve achieves achieved achieving enable enables enabled enabling optimize optimizes optimized
    optimizing design designs designed designing develop develops developed developing build builds built building create creates
    created creating deliver delivers delivered delivering provide provides provided providing""".split()


def action_shortcut(claim: Column, evidence: Column) -> Column:
    """Whether the evidence lacks half of the claim's words of action, rounded down but one at least, even as parts of words."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(claim), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    acts = F.array_intersect(runs, F.array(*map(F.lit, ACTIONS)))
    alone = F.size(F.filter(acts, lambda w: ~F.contains(F.lower(evidence), w)))
    return (claim != "") & (evidence != "") & (F.size(acts) > 0) & (alone >= F.greatest(F.lit(1), F.floor(F.size(acts) / 2)))


def n_sentences(x: Column) -> Column:
    """Runs of . ! or ?, at least one; 0 for no text."""
    return F.when(F.coalesce(x, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(x, F.lit("[.!?]+"))))


def format_noise(n_words: Column, rank: Column, sentences: Column) -> Column:
    return ((n_words > 0) & (n_words < FEW_WORDS)) | (n_words > MANY_WORDS) | (sentences >= MANY_SENTENCES) | (rank > HIGH_RANK)


def contra_confusion(p_contra: Column, truth: Column) -> Column:
    """A high contradiction score on a row of any other label, whatever was predicted."""
    return (p_contra > HIGH_CONTRA) & (truth != CONTRA)


def boundary_swap(truth: Column, pred: Column) -> Column:
    return ((truth == MILD) & (pred == STRONG)) | ((truth == STRONG) & (pred == MILD))


def tags(flags: dict[str, Column]) -> Column:
    """Names of the set flags, in the order given, joined by semicolons."""
    return F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in flags.items()])


def has_tag(x: Column, tag: str) -> Column:
    return F.array_contains(F.split(x, ";"), tag)


def outcome(truth: Column, pred: Column, positive: int = STRONG) -> Column:
    t, p = truth == positive, pred == positive
    return F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").otherwise("TN")


def contra_first(c: Column, s: Column, m: Column, tc: float, ts: float, tm: float) -> Column:
    return F.when(c >= tc, CONTRA).when(s >= ts, STRONG).when(m >= tm, MILD).otherwise(SUPPORTED)


def strong_first(c: Column, s: Column, m: Column, tc: float, ts: float, tm: float) -> Column:
    return F.when(s >= ts, STRONG).when(c >= tc, CONTRA).when(m >= tm, MILD).otherwise(SUPPORTED)


def by_margin(c: Column, s: Column, other: Column, margin: float) -> Column:
    """The clearly larger of the two scores decides; else another prediction does."""
    return F.when(c - s >= margin, CONTRA).when(s - c >= margin, STRONG).otherwise(other)
