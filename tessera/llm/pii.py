"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame functions only.

The fixed patterns give base spans. Base spans and key-shaped strings are the seeds of a bootstrap: the word and marks
before an identifier form a lexical pattern, alone and with the shape of the identifier; patterns and the distinct
strings they precede form a graph on which trust spreads from the seeds; trusted patterns mark every string they
precede, strings no seed had among them, and what is marked supports further patterns until none is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable, fresh

KINDS = ("email", "ip", "card", "phone", "id")
_SPAN = "array<struct<k:int,s:int,e:int,t:string,c:string>>"

# Fixed values. The same languages as the stated patterns; possessive, with the starts that cannot match looked behind,
# so that neither long runs nor long lists cost more than their length.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings that may be identifiers: eight or more letters, digits and joiners with a digit among them.
_TOKEN = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][_-])(?=(?:[A-Za-z]|[_-](?=[A-Za-z0-9]))*+[0-9])[A-Za-z0-9](?:[A-Za-z0-9]|[_-](?=[A-Za-z0-9])){7,}+"
#: Seeds beside the base spans: access-key ids and long hexadecimal keys.
_KEY = r"^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,})$"


#: Matches whose spans one fold gathers; a fold copies what it gathered at every match.
_FOLD = 256


def _located(text: Column, pattern: str, kind: int, wanted) -> Column:
    """Spans of the matches of pattern that are wanted, from the lengths of the pieces between them and of themselves.

    c is the context of a match in the piece before it, which reaches back to the match before or to the start. Matches
    are taken in folds of bounded size, each begun where the ones before it end, so the cost follows their number."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), _context(g).alias("c"), h.alias("h"), F.char_length(h).alias("n")))

    def step(acc, x):
        s = acc["at"] + x["g"]
        one = F.array(F.struct(F.lit(kind).alias("k"), s.alias("s"), (s + x["n"]).alias("e"), x["h"].alias("t"), x["c"].alias("c")))
        return F.struct((s + x["n"]).alias("at"), F.when(wanted(x["h"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def spans(fold, at):
        return F.aggregate(fold, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]

    def begins(folds):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        length = lambda fold: F.aggregate(fold, F.lit(0), lambda n, x: n + x["g"] + x["n"])
        return F.aggregate(F.transform(folds, length), none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    # an array of one binds what it holds, which is so made once and not at every use
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _FOLD).cast("int")), lambda i: F.slice(p, i * _FOLD + 1, F.lit(_FOLD)))
    laid = lambda folds: F.flatten(F.zip_with(folds, begins(folds), spans))
    return F.when(F.size(hits) > 0, bound(bound(pairs, cut), laid)).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.char_length(d)

    def add(acc, i):
        v = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(0), F.when(n.between(12, 19), n - 1).otherwise(0)), F.lit(0), add) % 10 == 0)


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.substring(F.ltrim(p, F.lit("0")), 1, 3), 3, "0").cast("int") <= 255))


def _phone_ok(x: Column) -> Column:
    return F.char_length(_digits(x)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Base spans, by start and then kind: (k, s, e, t, c) with the matched string and its context."""
    none = F.array().cast(_SPAN)
    return F.array_sort(
        F.concat(
            F.when(F.contains(text, F.lit("@")), _located(text, _EMAIL, 0, lambda h: F.lit(True))).otherwise(none),
            F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), _located(text, _IP, 1, _octets)).otherwise(none),
            F.when(F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")), _located(text, _CARD, 2, _luhn)).otherwise(none),
            F.when(F.contains(text, F.lit("+")), _located(text, _PHONE, 3, _phone_ok)).otherwise(none),
        ),
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]),
    )


def _context(before: Column) -> Column:
    """The lexical pattern of what stands before a string: its last word and the marks after that, whole; null without a word.

    Read from the end backwards, so that it costs what it takes and no more, however long the piece is.
    """
    back = F.reverse(before)
    word = F.lower(F.reverse(F.regexp_extract(back, r"^[^\p{L}]*+(\p{L}++)", 1)))
    marks = F.regexp_replace(F.reverse(F.regexp_extract(back, r"^([^\p{L}]*+)\p{L}", 1)), r"\s+", "")
    return F.when(F.char_length(word) > 0, F.concat_ws("|", word, marks))


def _shape(string: Column) -> Column:
    return F.when(F.rlike(string, F.lit("^[0-9]+$")), "digits").when(F.rlike(string, F.lit("^[0-9a-f]+$")), "hex").when(F.rlike(string, F.lit("^[A-Z0-9]+$")), "upper").when(F.rlike(string, F.lit("^[A-Za-z0-9_-]+$")), "mixed").otherwise("other")


def trusted_patterns(seen: DataFrame, rounds: int = 2, least: float = 0.8, support: int = 3) -> DataFrame:
    """Patterns to trust, from occurrences (context, pattern, string, seed boolean); pattern is the context with a shape.

    Edges join each context to each distinct string it precedes, so neither copies nor frequent strings weigh more.
    The score of a pattern, and of a context over all shapes, is the mean trust of its strings, with one untrusted
    string added; a string's trust is 1 for a seed or a string accepted before and else one minus the product of
    (1 - score) of its contexts, each by its better level. Trusted, after ``rounds`` scorings: score >= least and at
    least ``support`` strings of trust 1. Strings of trusted patterns are accepted and all is scored again, until no
    pattern is added; both sets only grow, so that ends. Hot patterns meet only aggregates and equi-joins.
    """
    # a string that a context precedes once is as good as one it precedes a thousand times
    edges = durable(seen.filter(F.col("context").isNotNull()).groupBy("context", "pattern", "string").agg(F.max("seed").alias("seed")), "pii-edges")
    sure, known = edges.withColumn("sure", F.col("seed")), 0
    while True:
        trust = sure.withColumn("trust", F.col("sure").cast("double"))
        for i in range(rounds):
            score = lambda c: trust.groupBy(F.col(c).alias(f"by_{c}")).agg((F.sum("trust") / (F.count("*") + 1)).alias(f"{c}_score"), F.sum(F.col("sure").cast("int")).alias("sures"))  # noqa: B023, E731
            levels = [score("context"), score("pattern")]
            if i == rounds - 1:
                break
            near = trust
            for c, level in zip(("context", "pattern"), levels, strict=True):
                near = near.join(level.filter("sures > 0").drop("sures"), F.col(c) == F.col(f"by_{c}"), "left")
            far = near.withColumn("score", F.greatest("context_score", "pattern_score")).filter("score is not null").groupBy("string").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("far"))
            old, trust = trust, durable(sure.join(far, "string", "left").select("context", "pattern", "string", "sure", F.when(F.col("sure"), 1.0).otherwise(F.coalesce("far", F.lit(0.0))).alias("trust")), "pii-trust")
            discard(old)
        # a context ends in marks and a pattern in the name of a shape, so the two cannot be confused
        context, pattern = [x.filter((F.col(f"{c}_score") >= least) & (F.col("sures") >= support)).select(F.col(f"by_{c}").alias("pattern")) for c, x in zip(("context", "pattern"), levels, strict=True)]
        good = durable(context.unionByName(pattern), "pii-good")
        discard(trust)
        n = good.count()
        if n == known:
            discard(edges, sure)
            return good
        known = n
        accepted = _marked(edges, good).filter("good").select("string").distinct().withColumn("accepted", F.lit(True))
        old, sure = sure, durable(edges.join(accepted, "string", "left").select("context", "pattern", "string", (F.col("seed") | F.col("accepted").isNotNull()).alias("sure")), "pii-sure")
        discard(old, good)


def _marked(x: DataFrame, good: DataFrame) -> DataFrame:
    """x with good: whether its pattern or its context is trusted."""
    for c in ("context", "pattern"):
        x = x.join(good.select(F.col("pattern").alias(f"by_{c}")), F.col(c) == F.col(f"by_{c}"), "left")
    return x.withColumn("good", F.col("by_context").isNotNull() | F.col("by_pattern").isNotNull()).drop("by_context", "by_pattern")


def find(docs: DataFrame, **graph) -> DataFrame:
    """One row for each row of docs: doc_id, text_key (sha256 of the text), base and spans.

    base and spans are arrays of (k, s, e): index into KINDS, start and end in code points, end exclusive, by start
    and then kind; spans holds base and what the bootstrap adds (kind id: key-shaped seeds, and strings that a trusted
    pattern precedes, unless they overlap a base span). Null text counts as empty and has no spans. Equal texts have
    equal spans; repeated rows and ids keep one row each; other columns are ignored; an empty table gives an empty
    result. Texts are read once; what is shuffled are spans and contexts only. What the bootstrap adds are strings of
    eight or more ASCII letters, digits, hyphens and underscores with a digit among them: a secret without a digit, or
    with other characters inside, is not found.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_key"), text.alias("t")).select(
        "doc_id", "text_key", base_spans(F.col("t")).alias("base"), F.when(F.rlike("t", F.lit("[0-9]")), _located(F.col("t"), _TOKEN, 4, lambda h: F.lit(True))).otherwise(F.array().cast(_SPAN)).alias("maybe")
    )
    clear = F.filter("maybe", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    rows = durable(rows.withColumn("maybe", clear), "pii-rows")
    once = rows.filter((F.size("base") > 0) | (F.size("maybe") > 0)).groupBy("text_key").agg(F.first("base").alias("base"), F.first("maybe").alias("maybe"))
    seen = once.select("text_key", F.explode(F.concat("base", "maybe")).alias("x")).select("text_key", "x.k", "x.s", "x.e", F.col("x.t").alias("string"), F.col("x.c").alias("context"), ((F.col("x.k") < 4) | F.rlike("x.t", F.lit(_KEY))).alias("seed"))
    seen = durable(seen.withColumn("pattern", F.concat_ws("|", "context", F.when(F.col("context").isNotNull(), _shape(F.col("string"))))), "pii-seen")
    good = trusted_patterns(seen, **graph)
    added = _marked(seen.filter("k = 4"), good).filter("seed or good").groupBy("text_key").agg(F.collect_set(F.struct("k", "s", "e")).alias("more"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    order = lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"])
    out = rows.select("doc_id", "text_key", bare(F.col("base")).alias("base")).join(added, "text_key", "left").select("doc_id", "text_key", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")), order).alias("spans"))
    out = durable(out, "pii-found")
    discard(rows, seen, good)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def report(docs: DataFrame, **graph) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id) of every document."""
    found = find(docs, **graph)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    n = [count(k) for k in range(4)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_id"))


def redact(docs: DataFrame, **graph) -> DataFrame:
    """docs with each found span replaced by its kind in brackets (n_chars follows, where docs has it); rows and other columns stay.

    Overlapping spans become one replacement named for the first. Null texts stay null, empty ones empty; repeated rows
    and ids keep a row each; columns may have any names; an empty table gives an empty result.
    """
    key, spans = (fresh(docs.columns, f"pii_{c}") for c in ("key", "spans"))
    found = find(docs, **graph).filter(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias(spans)).withColumnRenamed("text_key", key)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        new = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.element_at(names, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    out = docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256)).join(found, key, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(done))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
