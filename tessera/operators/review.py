"""Reviewers' sheets and queues: coded answers in two languages, what an audit says of them, reasons, mismatched evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import sampling

# Names of columns and codes of answers in the second language of the sheets.
COLUMNS = {
    "审计编号": "audit_item_id",
    "领域": "domain",
    "队列排名": "queue_rank",
    "系统预测": "model_pred",
    "silver标签": "silver_label",
    "人工标签": "auditor_label",
    "信心1到5": "auditor_confidence",
    "是否二审": "requires_second_review",
    "备注": "audit_notes",
    "证据是否一致": "evidence_consistency",
    "系统证据是否足够": "selected_evidence_sufficiency",
}
ANSWERS = {
    "auditor_label": {
        "支持": "supported",
        "轻微过度": "mild_scope_overclaim",
        "强行动过度": "strong_action_overclaim",
        "矛盾": "contradiction_candidate",
        "不确定": "uncertain_insufficient_context",
    },
    "evidence_consistency": {
        "一致": "consistent",
        "部分一致": "partial_consistent",
        "不一致": "inconsistent",
        "selected为空或太短": "selected_empty_or_too_short",
    },
    "selected_evidence_sufficiency": {
        "足够": "sufficient",
        "部分足够": "partial_sufficient",
        "不足": "insufficient",
        "无法判断": "cannot_judge",
    },
    "requires_second_review": {"是": "True", "否": "False"},
}
STRONG = "strong_action_overclaim"


def recoded(df: DataFrame, names: dict[str, str] = COLUMNS, answers: dict[str, dict[str, str]] = ANSWERS) -> DataFrame:
    """df with columns renamed by names and coded answers by answers; values outside a code's table stay as they stand.

    Codes are met with space around them. Of columns that end up with one name the last one in df counts. No shuffle.
    """
    last = {names.get(c, c): c for c in df.columns}
    out = []
    for name, c in last.items():
        x = F.col(f"`{c}`")
        if name in answers:
            codes = F.create_map(*[F.lit(v) for pair in answers[name].items() for v in pair])
            x = F.coalesce(F.try_element_at(codes, F.trim(x)), x)
        out.append(x.alias(name))
    return df.select(*out)


def audit(df: DataFrame, by: str, top: int = 20) -> DataFrame:
    """(by, n, n_strong, agreement, second_reviews, confidence, silver_in_top) of a sheet with its columns in English.

    agreement is the share of answered rows whose answer is the silver label. silver_in_top is the share of silver
    strong rows among those that the auditor calls strong and whose rank is at most `top`; a row without a rank counts
    as rank 0, so it is among them. Null where a share has no base. Confidences outside 1 to 5 are left out.
    """
    said, silver = F.col("auditor_label"), F.col("silver_label")
    answered = F.coalesce(F.trim(said) != "", F.lit(False))
    rank = F.coalesce(F.expr("try_cast(queue_rank AS INT)"), F.lit(0))
    sure = F.expr("try_cast(auditor_confidence AS INT)")
    early = (said == STRONG) & (rank <= top)
    share = lambda hit, base: F.round(F.try_divide(F.count_if(base & hit).cast("double"), F.count_if(base)), 6)
    return df.groupBy(by).agg(
        F.count_if(answered).alias("n"),
        F.count_if(said == STRONG).alias("n_strong"),
        share(said == silver, answered).alias("agreement"),
        F.count_if(F.lower(F.trim("requires_second_review")) == "true").alias("second_reviews"),
        F.round(F.avg(F.when(sure.between(1, 5), sure)), 6).alias("confidence"),
        share(silver == STRONG, early).alias("silver_in_top"),
    )


def reason(label: Column, strong: Column, contra: Column, strong_label: str = STRONG, least: float = 0.4) -> Column:
    """Why a row stands in the queue: its label, else a high score of either kind (null counts as low), else nothing."""
    flagged = F.format_string("R4 flagged strong_action (p_strong=%.3f, p_contra=%.3f)", strong, contra)
    high = F.format_string("High p_strong=%.3f but below threshold; pred=%s", strong, label)
    against = F.format_string("High p_contra=%.3f; pred=%s", contra, label)
    return F.when(label == strong_label, flagged).when(strong >= least, high).when(contra >= least, against).otherwise(F.concat(F.lit("Low priority; pred="), label))


def mismatched(df: DataFrame, key: str, evidence: str, seed: int = 42, most: int | None = None) -> DataFrame:
    """df with wrong_key and wrong_evidence: those of another row, by a hashed step of 1 to n - 1 in a hashed order.

    key must be unique and not null; rows without evidence are left out and lend none. `most` keeps the first rows of
    the order, a sample. One row alone has no other and is left out. Places come from running sums over ranges of the
    order; the lent evidence meets its row in one join on places, which are unique on both sides.
    """
    line = sampling.hashed_places(df.filter(F.col(evidence).isNotNull()), key, seed)
    n = line.agg(F.count("*").alias("_n"))  # one row
    step = F.pmod(F.conv(F.substring(sampling.order_key(seed, key), 3, 8), 16, 10).cast("long"), F.col("_n") - 1) + 1
    own = line.crossJoin(F.broadcast(n)).filter("_n > 1")
    if most is not None:
        own = own.filter(F.col("_place") <= most)
    lent = line.select(F.col("_place").alias("_to"), F.col(key).alias("wrong_key"), F.col(evidence).alias("wrong_evidence"))
    return own.withColumn("_to", (F.col("_place") - 1 + step) % F.col("_n") + 1).join(lent, "_to").select(*df.columns, "wrong_key", "wrong_evidence")


def overlap_gap(claim: str, right: str, wrong: str) -> tuple[Column, Column]:
    """Shares of words (Dice) that a claim has in common with its own and with lent evidence."""
    words = lambda c: F.array_distinct(K.tokenize(F.col(c)))
    return F.round(K.dice(words(claim), words(right)), 6), F.round(K.dice(words(claim), words(wrong)), 6)
