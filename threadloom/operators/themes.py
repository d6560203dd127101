"""Themes of texts: TF-IDF, clusters, topic models and change of meaning."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.running import hour_of, row_numbers
from threadloom.session import cut


#: Terms that a topic model holds at most.
VOCABULARY = 2**18


def windows_of_messages(messages: DataFrame, size: int = 40, least_tail: int = 10) -> DataFrame:
    """(conversation_id, window_no, row_id, ordinal): runs of ``size`` messages; a short tail joins the one before.

    Order is by time, then row.
    """
    sizes = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("conversation_id", "_c")
    slim = messages.select("conversation_id", "row_id", "sent_at")
    numbered = row_numbers(slim, ["conversation_id"], "sent_at", "row_id", "_i").join(sizes, F.col("conversation_id").eqNullSafe(F.col("_c")))
    numbered = numbered.withColumn("ordinal", (F.col("_i") - 1).cast("int"))
    last = F.floor((F.col("_n") - 1) / size)
    tail = F.col("_n") - last * size
    own = F.floor(F.col("ordinal") / size)
    return numbered.select(
        "conversation_id", F.when((own == last) & (last > 0) & (tail < least_tail), own - 1).otherwise(own).alias("window_no"), "row_id", "ordinal"
    )


def tfidf(rows: DataFrame, key: str, text: str, least_df: int = 2, most_share: float = 0.9, vocabulary: int = 2**18) -> DataFrame:
    """(key, term, weight): (1 + ln tf)·(ln((1 + N)/(1 + df)) + 1), of unit length per text.

    Terms of four characters at least, in at least ``least_df`` and at most ``most_share`` of the texts; the
    ``vocabulary`` most frequent ones: beyond that the terms are too many to hold in every task.
    """
    words = rows.where(F.col(text).isNotNull()).select(key, F.explode(T.tokens(F.col(text), 4)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("_tf"))
    n = rows.where(F.col(text).isNotNull()).select(key).distinct().count()
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).where((F.col("_df") >= least_df) & (F.col("_df") <= most_share * n))
    df = df.orderBy(F.desc("_df"), "term").limit(vocabulary)
    raw = words.join(F.broadcast(df), "term").withColumn("_w", (1 + F.log("_tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


def clusters(rows: DataFrame, key: str, vector: str, most: int = 10, seed: int = 42, least: int = 6) -> DataFrame:
    """(key, cluster, k, separation): k-means with the k of 2 … ``most`` of best cosine silhouette.

    ``vector`` is an array column. The label of the separation is high from 0.2, moderate from 0.1, else
    low. No rows below ``least`` vectors.
    """
    data = cut(Normalizer(inputCol="_v", outputCol="features").transform(rows.select(key, array_to_vector(vector).alias("_v"))).drop("_v"))
    n = data.count()
    if n < least:
        return data.select(key, F.lit(0).alias("cluster"), F.lit(0).alias("k"), F.lit("unavailable").alias("separation")).where(F.lit(False))
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    best = None
    for k in range(2, min(most, n - 1) + 1):
        fitted = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(data)
        labelled = fitted.transform(data)
        if labelled.select("prediction").distinct().count() < 2:
            continue
        score = judge.evaluate(labelled)
        if best is None or score > best[0] + 1e-12:
            best = (score, k, fitted)
    if best is None:
        return data.select(key, F.lit(0).alias("cluster"), F.lit(1).alias("k"), F.lit("unavailable").alias("separation"))
    name = "high" if best[0] >= 0.2 else "moderate" if best[0] >= 0.1 else "low"
    return best[2].transform(data).select(key, F.col("prediction").alias("cluster"), F.lit(best[1]).alias("k"), F.lit(name).alias("separation"))


def topic_count(n: int) -> int:
    """How many topics ``n`` texts get: between 2 and 5, about one for three; none below 6 texts."""
    return 0 if n < 6 else min(5, max(2, round(n / 3)))


def topics_lda(rows: DataFrame, key: str, text: str, k: int = 5, top: int = 10, seed: int = 42) -> DataFrame:
    """(topic, place, term, weight): the ``top`` terms of each topic of a latent Dirichlet model."""
    words = rows.where(F.col(text).isNotNull()).select(key, T.tokens(F.col(text), 4).alias("_w")).where(F.size("_w") > 0)
    counter = CountVectorizer(inputCol="_w", outputCol="features", vocabSize=VOCABULARY, minDF=2.0).fit(words)
    data = cut(counter.transform(words).select(key, "features"))
    model = LDA(k=k, seed=seed, maxIter=10, optimizer="online").fit(data)
    names = F.array(*[F.lit(v) for v in counter.vocabulary])
    described = model.describeTopics(top).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "_t"))
    return described.select("topic", "place", F.element_at(names, F.col("_t.termIndices") + 1).alias("term"), F.col("_t.termWeights").alias("weight"))


def topics_nmf(weights: DataFrame, key: str, k: int = 5, rounds: int = 400, seed: int = 42, top: int = 10, settled: float = 1e-3) -> DataFrame:
    """(topic, place, term, weight): non-negative factors of a (key, term, weight) matrix.

    Rounds end after ``rounds``, or when the length of the terms' factor changes by less than the share ``settled`` in one.

    Multiplicative updates by joins: the factor of the texts is distributed by key, that of the terms by
    term, and only their k×k products meet on the driver.
    """
    cells = cut(weights.select(F.col(key).alias("_d"), "term", "weight"))
    start = lambda c: F.array(*[(F.pmod(F.xxhash64(F.lit(seed + i), c), F.lit(1000)) + 1) / 1000.0 for i in range(k)])
    left = cells.select("_d").distinct().withColumn("h", start(F.col("_d")))
    right = cells.select("term").distinct().withColumn("w", start(F.col("term")))

    def gram(df: DataFrame, c: str) -> np.ndarray:
        sums = df.agg(*[F.sum(F.col(c)[i] * F.col(c)[j]).alias(f"{i}_{j}") for i in range(k) for j in range(k)]).first()
        return np.array(sums, float).reshape(k, k)

    def update(own: DataFrame, other: DataFrame, own_key: str, other_key: str, mine: str, theirs: str) -> DataFrame:
        g = gram(other, theirs)
        up = cells.join(other, other_key).groupBy(own_key).agg(F.array(*[F.sum(F.col("weight") * F.col(theirs)[i]) for i in range(k)]).alias("_up"))
        down = [sum((F.col(mine)[j] * float(g[j, i]) for j in range(k)), F.lit(1e-12)) for i in range(k)]
        new = F.array(*[F.col(mine)[i] * F.col("_up")[i] / down[i] for i in range(k)])
        return cut(own.join(up, own_key).select(own_key, new.alias(mine)))

    length = 0.0
    for _ in range(rounds):
        left = update(left, right, "_d", "term", "h", "w")
        right = update(right, left, "term", "_d", "w", "h")
        before, length = length, float(np.sqrt(np.trace(gram(right, "w") @ gram(left, "h"))))
        if abs(length - before) < settled * length:
            break
    each = right.select("term", F.posexplode("w").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return each.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < top).select("topic", "place", "term", "weight")


def later_half(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_late``: false for the first n // 2 by time, then row id.

    The counts of hours tell in which of them the middle lies, and only the rows of that hour are ordered.
    """
    hours = dict(rows.groupBy(hour_of("sent_at").alias("_p")).count().collect())
    left = sum(hours.values()) // 2
    for hour in sorted(hours):
        if left < hours[hour]:
            break
        left -= hours[hour]
    else:
        return rows.withColumn("_late", F.lit(True))
    inside = rows.where(hour_of("sent_at") == hour).select("sent_at", "row_id").orderBy("sent_at", "row_id").limit(left + 1)
    middle = F.broadcast(inside.agg(F.max(F.struct("sent_at", "row_id")).alias("_middle")))
    return rows.join(middle, F.lit(True)).withColumn("_late", F.struct("sent_at", "row_id") >= F.col("_middle")).drop("_middle")


def semantic_change(messages: DataFrame, vectors: DataFrame, least: int = 2, top: int = 50, least_rows: int = 6) -> DataFrame:
    """(term, n_early, n_late, distance, shift): how the contexts of a term move from the early to the late half.

    ``vectors`` hold row_id and an array; the early half are the first n // 2 messages with a vector, by time. ``distance``
    is the mean cosine distance between early and late contexts, which for unit vectors is one less the
    product of the two means; ``shift`` is the length of the difference of the means. Below ``least_rows`` messages nothing comes out.
    """
    rows = messages.where(F.col("text").isNotNull() & F.col("sent_at").isNotNull()).select("row_id", "text", "sent_at").join(vectors, "row_id")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform("vec", lambda x: x / norm)).otherwise(F.col("vec"))
    enough = rows.limit(least_rows).count() == least_rows
    sides = later_half(rows).where(F.lit(enough)).select("text", "_late", unit.alias("_u"))
    halves = sides.select(F.explode(F.array_distinct(T.tokens(F.col("text"), 4))).alias("term"), "_late", "_u")
    counts = halves.groupBy("term").agg(F.count_if(~F.col("_late")).alias("n_early"), F.count_if(F.col("_late")).alias("n_late")).where((F.col("n_early") >= least) & (F.col("n_late") >= least))
    kept = halves.join(counts.select("term"), "term", "left_semi").select("term", "_late", F.posexplode("_u").alias("_i", "_x"))
    means = kept.groupBy("term", "_i").agg(F.avg(F.when(~F.col("_late"), F.col("_x"))).alias("_a"), F.avg(F.when(F.col("_late"), F.col("_x"))).alias("_b"))
    moved = means.groupBy("term").agg(
        (1 - F.sum(F.col("_a") * F.col("_b"))).alias("distance"), F.sqrt(F.sum((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b")))).alias("shift")
    )
    return moved.join(counts, "term").select("term", "n_early", "n_late", F.round("distance", 9).alias("distance"), "shift").orderBy(F.desc("distance"), "term").limit(top)
