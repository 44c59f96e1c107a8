"""Lexical models: TF-IDF, centroids, naive Bayes, majority and length rules, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as K


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(K.tokenize(F.col(text), "plain")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w): unit-length tf-idf with idf = ln((1 + n) / (1 + df)) + 1."""
    tf = term_counts(df, key, text)
    idf = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    w = tf.join(idf, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def naive_bayes(train: DataFrame, rows: DataFrame, key: str, text: str, label: str, alpha: float = 0.7) -> DataFrame:
    """(key, predicted): multinomial naive Bayes with additive smoothing; ties to the smallest label."""
    t = train.select(label, F.explode(K.tokenize(F.col(text), "plain")).alias("term")).groupBy(label, "term").agg(F.count("*").alias("c"))
    vocab = t.select("term").distinct().agg(F.count("*").alias("v"))
    mass = t.groupBy(label).agg(F.sum("c").alias("m"))
    prior = train.groupBy(label).agg(F.count("*").alias("docs"))
    classes = prior.join(mass, label).crossJoin(F.broadcast(vocab)).crossJoin(F.broadcast(train.agg(F.count("*").alias("n"))))
    classes = classes.select(label, F.log(F.col("docs") / F.col("n")).alias("lp"), F.log(alpha / (F.col("m") + alpha * F.col("v"))).alias("unseen"))
    known = t.join(classes, label).join(mass, label).crossJoin(F.broadcast(vocab)).select(label, "term", (F.log((F.col("c") + alpha) / (F.col("m") + alpha * F.col("v"))) - F.col("unseen")).alias("gain"))
    toks = term_counts(rows, key, text).join(t.select("term").distinct(), "term")
    size = toks.groupBy(key).agg(F.sum("tf").alias("len"))
    base = rows.select(key).join(size, key, "left").crossJoin(F.broadcast(classes)).select(key, label, (F.col("lp") + F.coalesce("len", F.lit(0)) * F.col("unseen")).alias("s"))
    gain = toks.join(known, "term").groupBy(key, label).agg(F.sum(F.col("tf") * F.col("gain")).alias("g"))
    total = base.join(gain, [key, label], "left").withColumn("score", F.round(F.col("s") + F.coalesce("g", F.lit(0.0)), 4))
    return total.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), label))).filter("rn = 1").select(key, F.col(label).alias("predicted"))


def vector_centroids(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, predicted, cosine): the label whose mean vector is nearest by cosine."""
    flat = df.select(key, label, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("i", "x"))
    cent = flat.groupBy(label, "i").agg(F.avg("x").alias("c"))
    cn = cent.groupBy(label).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("cn"))
    packed = cent.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c")).join(cn, label).withColumnRenamed(label, "predicted")
    own = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = own.join(F.broadcast(packed)).withColumn("cosine", F.round(dot(F.col("x"), F.col("c")) / (F.sqrt(dot(F.col("x"), F.col("x"))) * F.col("cn")), 6))
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "predicted"))).filter("rn = 1").select(key, "predicted", "cosine")


def top_vocabulary(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, term, w): sublinear unit-length tf-idf over the `size` most frequent terms of one and two words, ties by term."""
    toks = K.tokenize(F.col(text), "plain")
    terms = df.select(key, F.explode(F.concat(toks, K.ngrams(toks, 2))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    stats = terms.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(size)
    n = df.agg(F.count("*").alias("n"))
    w = terms.join(F.broadcast(stats), "term").crossJoin(F.broadcast(n))
    w = w.select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    c = df.groupBy(label).agg(F.count("*").alias("c"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("n"), F.count("*").alias("k")))).select(label, F.round(F.col("n") / (F.col("k") * F.col("c")), 6).alias("weight"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, the smallest on ties."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def length_rule(train: DataFrame, rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, predicted): 1 where a text is longer than train's median, or the reverse if that is right on less than half of train."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    mid = train.agg(F.percentile(n, 0.5).alias("mid"))
    right = train.crossJoin(F.broadcast(mid)).agg(F.avg(((n > F.col("mid")).cast("int") == F.col(label)).cast("int")).alias("acc"))
    rule = F.broadcast(mid.crossJoin(right))
    call = (n > F.col("mid")).cast("int")
    return rows.crossJoin(rule).select(key, F.when(F.col("acc") < 0.5, 1 - call).otherwise(call).alias("predicted"))


def nearest_profile(train: DataFrame, rows: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """(key, predicted): the class whose mean of standardised features is nearest; population deviations, 1 for a constant."""
    stats = train.agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s"))
    cent = train.crossJoin(F.broadcast(stats)).groupBy(F.col(label).alias("predicted")).agg(*[F.avg(z(c)).alias(f"{c}_c") for c in features])
    own = rows.crossJoin(F.broadcast(stats)).select(key, *[z(c).alias(c) for c in features])
    far = F.round(sum(((F.col(c) - F.col(f"{c}_c")) * (F.col(c) - F.col(f"{c}_c")) for c in features), F.lit(0.0)), 6)
    # one row a class: as many as there are labels
    return own.crossJoin(F.broadcast(cent)).groupBy(key).agg(F.min(F.struct(far.alias("d"), "predicted")).alias("best")).select(key, F.col("best.predicted").alias("predicted"))


def temperature(df: DataFrame, p: str, positive: str, grid: list[float]) -> DataFrame:
    """(t, loss): mean log loss of sigmoid(logit(p) / t) at every t, so that the least can be taken."""
    x = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col(p)))
    # equal scores share a row, so the grid meets distinct scores only
    by = df.groupBy(x.alias("x")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count("*").alias("n"))
    q = 1 / (1 + F.exp(-F.log(F.col("x") / (1 - F.col("x"))) / F.col("t")))
    return by.withColumn("t", F.explode(F.array(*map(F.lit, grid)))).groupBy("t").agg(F.round(-F.sum(F.col("pos") * F.log(q) + (F.col("n") - F.col("pos")) * F.log(1 - q)) / F.sum("n"), 6).alias("loss"))


def platt(counts: DataFrame, steps: int = 25, least: float = 1e-12) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve that fits counts (s, p, n) best: n rows of score s, of which p are positive.

    Newton's method; a step is one scan of the counts that brings five sums back. It ends when the largest change is
    below `least`. Where the positives lie wholly apart there is no best curve, and the one after `steps` steps is given.
    """
    a = b = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(a * F.col("s") + b)))
        r, w = F.col("p") - F.col("n") * q, F.col("n") * q * (1 - q)
        ga, gb, haa, hab, hbb = counts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (r * F.col("s"), r, w * F.col("s") * F.col("s"), w * F.col("s"), w)]).first()
        det = haa * hbb - hab * hab
        if det <= 1e-12 * max(haa * hbb, 1e-300):  # one distinct score, or none: the slope says nothing
            da, db = 0.0, gb / hbb if hbb > 0 else 0.0
        else:
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < least:
            break
    return a, b


def calibrate(df: DataFrame, key: str, p: str, positive: str) -> DataFrame:
    """(key, isotonic, platt): scores mapped by isotonic regression and by a logistic curve, both fitted on df.

    Rows are counted by distinct score once, and both fits read these counts alone.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    from tessera.sources import store

    path = store.scratch(df.sparkSession, "score-counts")
    df.groupBy(F.col(p).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count("*").cast("double").alias("n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    points = VectorAssembler(inputCols=["s"], outputCol="features").transform(counts.withColumn("label", F.col("p") / F.col("n")))
    iso = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="n", predictionCol="isotonic").fit(points)
    a, b = platt(counts)
    mapped = iso.transform(points).select(F.col("s").alias(p), F.round("isotonic", 6).alias("isotonic"), F.round(1 / (1 + F.exp(-(a * F.col("s") + b))), 6).alias("platt"))
    return df.select(key, F.col(p).cast("double").alias(p)).join(mapped, p).select(key, "isotonic", "platt")
