"""Evaluation protocols: models trained without a fold or domain, votes over folds, held-out splits, rankers compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as K


def fold_bayes(df: DataFrame, key: str, fold: str, text: str, label: str, labels: list, alpha: float = 0.7) -> DataFrame:
    """(fold, key, label, predicted): every row by naive Bayes on the texts of all other folds.

    One count of terms serves all folds: what a fold trains on is the total less its own share. Terms that the other
    folds lack are left out; a label that they lack is never predicted, and with none at all predicted is null. Ties go
    to the first of `labels`; null text counts as empty. The terms of a row are summed in one place, never collected.
    """
    x = df.select(F.col(fold).alias("fold"), F.col(key).alias("key"), F.col(label).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = len(labels)
    by = lambda c, v: [F.sum(F.when(F.col("label") == k, F.col(c) if isinstance(c, str) else c).otherwise(0)).alias(f"{v}{i}") for i, k in enumerate(labels)]
    tf = x.select("fold", "key", "label", F.explode(K.tokenize(F.col("text"), "plain")).alias("term")).groupBy("fold", "key", "label", "term").agg(F.count("*").alias("tf"))
    own = tf.groupBy("fold", "term").agg(*by("tf", "c"))
    every = own.groupBy("term").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(n)])
    size = every.agg(F.count("*").alias("v"), *[F.sum(f"t{i}").alias(f"m{i}") for i in range(n)])
    rest = own.join(every, "term").select("fold", "term", *[(F.col(f"t{i}") - F.col(f"c{i}")).alias(f"r{i}") for i in range(n)], *[f"c{i}" for i in range(n)])
    absent = sum((F.col(f"r{i}") for i in range(n)), F.lit(0)) == 0
    docs = x.groupBy("fold").agg(*by(F.lit(1), "d"))
    total = docs.agg(*[F.sum(f"d{i}").alias(f"a{i}") for i in range(n)])
    lost = rest.groupBy("fold").agg(F.count_if(absent).alias("gone"), *[F.sum(f"c{i}").alias(f"o{i}") for i in range(n)])
    # one row a fold: priors, and for each label the sum that a term's count is divided by
    f = docs.join(lost, "fold", "left").fillna(0).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size))  # one row each
    left = sum((F.col(f"a{i}") - F.col(f"d{i}") for i in range(n)), F.lit(0))
    prior = [F.when(F.col(f"a{i}") > F.col(f"d{i}"), F.log((F.col(f"a{i}") - F.col(f"d{i}")) / left)) for i in range(n)]
    mass = [F.coalesce(F.col(f"m{i}"), F.lit(0)) - F.col(f"o{i}") + alpha * (F.coalesce("v", F.lit(0)) - F.col("gone")) for i in range(n)]
    f = f.select("fold", *[p.alias(f"p{i}") for i, p in enumerate(prior)], *[m.alias(f"s{i}") for i, m in enumerate(mass)])
    gain = rest.filter(~absent).join(f, "fold").select("fold", "term", *[F.log((F.col(f"r{i}") + alpha) / F.col(f"s{i}")).alias(f"g{i}") for i in range(n)])
    summed = tf.join(gain, ["fold", "term"]).groupBy("fold", "key").agg(*[F.sum(F.col("tf") * F.col(f"g{i}")).alias(f"z{i}") for i in range(n)])
    out = x.select("fold", "key", "label").join(summed, ["fold", "key"], "left").join(f, "fold")
    score = [F.round(F.col(f"p{i}") + F.coalesce(f"z{i}", F.lit(0.0)), 4) for i in range(n)]
    best = F.greatest(*score) if n > 1 else score[0]
    pick = F.coalesce(*[F.when(s == best, F.lit(k)) for s, k in zip(score, labels, strict=True)])
    return out.select("fold", "key", "label", pick.alias("predicted"))


def fold_f1(predicted: DataFrame, labels: list, positive) -> DataFrame:
    """(fold, n, macro_f1, f1): F1 of each fold, its mean over the fold's labels and predictions, and that of one label."""
    cells = [e for i, k in enumerate(labels) for e in (F.count_if((F.col("label") == k) & (F.col("predicted") == k)).alias(f"tp{i}"), (F.count_if(F.col("label") == k) + F.count_if(F.col("predicted") == k)).alias(f"u{i}"))]
    g = predicted.groupBy("fold").agg(F.count("*").alias("n"), *cells)
    f1 = [F.try_divide(2 * F.col(f"tp{i}"), F.col(f"u{i}")) for i in range(len(labels))]
    some = sum(((F.col(f"u{i}") > 0).cast("int") for i in range(len(labels))), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(f, F.lit(0.0)) for f in f1), F.lit(0.0)), some)
    return g.select("fold", "n", F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("macro_f1"), F.round(F.coalesce(f1[labels.index(positive)], F.lit(0.0)), 6).alias("f1"))


def fold_summary(folds: DataFrame, reference: float) -> DataFrame:
    """One row: mean, deviation and normal interval of F1 over folds, and how it stands to a reference F1.

    warning from 0.8 of the reference, fail from all of it: a control that knows too little must stay below.
    """
    a = folds.agg(F.count("*").alias("n_folds"), F.avg("f1").alias("m"), F.stddev_pop("f1").alias("s"), F.avg("macro_f1").alias("mm"), F.stddev_pop("macro_f1").alias("ms"))
    half = 1.96 * F.col("s") / F.sqrt("n_folds")
    status = F.when(F.col("m") >= reference, "fail").when(F.col("m") >= 0.8 * reference, "warning").otherwise("pass")
    r = lambda c, n: F.round(c, 4).alias(n)
    return a.select("n_folds", r("m", "f1_mean"), r("s", "f1_std"), r(F.greatest(F.lit(0.0), F.col("m") - half), "f1_low"), r(F.least(F.lit(1.0), F.col("m") + half), "f1_high"), r("mm", "macro_f1_mean"), r("ms", "macro_f1_std"), status.alias("status"))


def fold_votes(keys: DataFrame, votes: DataFrame, key: str, split: str, pred: str) -> DataFrame:
    """(key, predicted, n_votes, used): the majority of a key's test predictions, else of its dev ones, else -1 and train_only.

    Of equally frequent predictions the smallest wins.
    """
    g = votes.filter(F.col(split).isin("test", "dev")).groupBy(key, split, pred).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key, split))
    first = Window.partitionBy(key).orderBy((F.col(split) == "dev"), F.desc("n"), pred)
    best = g.withColumn("n_votes", total).withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(key, pred, "n_votes", F.col(split).alias("used"))
    return keys.select(key).join(best, key, "left").select(key, F.coalesce(pred, F.lit(-1)).alias("predicted"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.coalesce("used", F.lit("train_only")).alias("used"))


def seed_votes(df: DataFrame, key: str, pred: str, means: list[str], flag: str, labels: list) -> DataFrame:
    """(key, predicted, means, flag, entropy, n_seeds): one row a key from its predictions under several seeds.

    The most frequent label wins, of equals the first of `labels`; scores are averaged, the flag is set where it is in
    more than half, and entropy is the mean, not the sum, over labels of -p ln(p + 1e-10).
    """
    n = [F.count_if(F.col(pred) == k).alias(f"n{i}") for i, k in enumerate(labels)]
    g = df.groupBy(key).agg(*n, F.count("*").alias("n_seeds"), *[F.round(F.avg(c), 6).alias(c) for c in means], (F.avg(flag) > 0.5).cast("int").alias("flag"))
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(labels))])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") == most, F.lit(k)) for i, k in enumerate(labels)])
    share = [F.col(f"n{i}") / F.col("n_seeds") for i in range(len(labels))]
    entropy = sum((-p * F.log(p + 1e-10) for p in share), F.lit(0.0)) / len(labels)
    return g.select(key, pick.alias("predicted"), *means, "flag", F.round(entropy, 6).alias("entropy"), "n_seeds")


def held_out(df: DataFrame, key: str, by: str, most: int, positive: Column, seed: str = "0") -> DataFrame:
    """(side, n, n_positive, n_leaked): a split whose test side is all rows of `most` values of a column.

    The values come first by the md5 of seed and value; of the other rows a fifth, by the md5 of their key, is dev and
    the rest train. n_leaked counts rows whose value is also on the test side, 0 but there; null is no value and never
    held out.
    """
    mark = lambda c: F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(c).cast("string")))
    values = df.select(by).na.drop().distinct().orderBy(mark(by), by).limit(most)
    x = df.select(F.col(key), F.col(by), positive.cast("int").alias("y")).join(F.broadcast(values.withColumn("out", F.lit(True))), by, "left")  # `most` rows
    dev = F.conv(F.substring(mark(key), 1, 4), 16, 10).cast("long") % 5 == 0
    x = x.withColumn("side", F.when(F.col("out"), "test").when(dev, "dev").otherwise("train"))
    test = x.filter("side = 'test'").select(F.col(by).alias("value")).distinct()  # `most` rows
    x = x.join(F.broadcast(test), F.col(by) == F.col("value"), "left")
    return x.groupBy("side").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.count_if(F.col("value").isNotNull() & (F.col("side") != "test")).alias("n_leaked"))


def best_method(df: DataFrame, method: str, first: str, second: str, skipped: str) -> DataFrame:
    """One row (method, score): the highest mean of first, or of second where no method has a first; none and 0 for neither.

    Methods with a skipped row are out; of equals the smallest name wins.
    """
    g = df.groupBy(F.col(method).alias("method")).agg(F.avg(first).alias("a"), F.avg(second).alias("b"), F.max(F.col(skipped).cast("int")).alias("out")).filter("out = 0")
    top = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("method"))))
    best = lambda c: F.min(F.when(F.col(c) == F.col(f"top_{c}"), F.col("method")))
    high = g.agg(top("a")["a"].alias("top_a"), top("b")["b"].alias("top_b"))
    out = g.crossJoin(F.broadcast(high)).agg(best("a").alias("ma"), best("b").alias("mb"), F.max("top_a").alias("top_a"), F.max("top_b").alias("top_b"))  # one row
    return out.select(F.coalesce("ma", "mb", F.lit("none")).alias("method"), F.round(F.coalesce("top_a", "top_b", F.lit(0.0)), 6).alias("score"))


def gaussian_margin(train: DataFrame, rows: DataFrame, features: list[str], label: str, least: float = 1e-6) -> DataFrame:
    """rows with margin: log odds of label 1 by one normal density for each feature and label, variances at least `least`."""
    part = [f(F.when(F.col(label) == y, F.col(c).cast("double"))).alias(f"{c}_{n}{y}") for c in features for y in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))]
    stats = train.agg(*part, F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    var = lambda c, y: F.greatest(F.col(f"{c}_v{y}"), F.lit(least))
    far = lambda c, y: F.pow(F.col(c) - F.col(f"{c}_m{y}"), 2) / (2 * var(c, y)) + F.log(var(c, y)) / 2
    margin = sum((far(c, 0) - far(c, 1) for c in features), F.log(F.col("n1") / F.col("n0")))
    return rows.crossJoin(F.broadcast(stats)).select(*rows.columns, F.round(margin, 4).alias("margin"))  # one row


def baseline_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, mean_overlap, max_overlap): Jaccard of two texts over rows where both have words."""
    x, y = (F.array_distinct(K.tokenize(F.col(c), "plain")) for c in (a, b))
    s = df.select(x.alias("x"), y.alias("y")).filter((F.size("x") > 0) & (F.size("y") > 0)).select(K.jaccard(F.col("x"), F.col("y")).alias("j"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("mean_overlap"), F.round(F.max("j"), 6).alias("max_overlap"))


def containing(docs: DataFrame, doc_key: str, text: str, claims: DataFrame, claim_key: str, claim: str, least: int = 30) -> DataFrame:
    """(claim_key, doc_key): whole texts that hold a claim of `least` characters or more, by an equi-join on three words.

    The words inside a claim, all but its first and last, are whole words of any text that holds it. So the first three
    of them find the texts to compare. Claims of fewer than five words, if there are any, are a query set that is held
    against every text. Null texts and claims match nothing.
    """
    q = claims.select(F.col(claim_key), F.col(claim).alias("needle"), F.split(F.col(claim), r"\s+").alias("w")).filter(F.length("needle") >= least)
    d = docs.select(F.col(doc_key), F.col(text).alias("hay"))
    key = q.filter(F.size("w") >= 5).select(claim_key, "needle", F.array_join(F.slice("w", 2, 3), " ").alias("run"))
    w = F.split(F.col("hay"), r"\s+")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " ")))
    # texts travel only to the claims whose words they hold
    found = d.withColumn("w", w).select(doc_key, F.explode(runs).alias("run")).join(key, "run")
    long_ = found.select(doc_key, claim_key, "needle").distinct().join(d, doc_key).filter(F.contains("hay", "needle"))
    few = q.filter(F.size("w") < 5).select(claim_key, "needle")
    return long_.select(claim_key, doc_key).unionByName(d.join(few, F.contains("hay", "needle")).select(claim_key, doc_key)).distinct()
