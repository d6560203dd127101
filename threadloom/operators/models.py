"""Models of replying: whom a sender answers, and which messages are answered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

CHOICE = ["repetition", "reciprocity", "popularity", "recency"]


def choice_fit(sets: DataFrame, ridge: float = 0.01, least: int = 10, rounds: int = 25) -> DataFrame:
    """(feature, coefficient, odds, n_sets) of a conditional choice model over ``replies.choice_features``.

    Newton steps on the penalised likelihood, which is concave, so the optimum is the only one. Each step
    sends ten sums to the driver. No rows below ``least`` risk sets.
    """
    rows = cut(sets.select("source", F.col("chosen").cast("double").alias("y"), *[F.col(c).cast("double") for c in CHOICE]))
    n = rows.select("source").distinct().count()
    schema = "feature string, coefficient double, odds double, n_sets long"
    if n < least:
        return sets.sparkSession.createDataFrame([], schema)
    k = len(CHOICE)
    beta = np.zeros(k)
    by_set = Window.partitionBy("source")
    for _ in range(rounds):
        score = sum((F.col(c) * float(b) for c, b in zip(CHOICE, beta, strict=True)), F.lit(0.0))
        p = rows.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(by_set)))
        p = p.withColumn("_p", F.col("_e") / F.sum("_e").over(by_set))
        means = p.groupBy("source").agg(*[F.sum(F.col("_p") * F.col(c)).alias(f"_m{i}") for i, c in enumerate(CHOICE)])
        first = p.agg(*[F.sum((F.col("y") - F.col("_p")) * F.col(c)) for c in CHOICE], *[F.sum(F.col("_p") * F.col(a) * F.col(b)) for a in CHOICE for b in CHOICE]).first()
        second = means.agg(*[F.sum(F.col(f"_m{i}") * F.col(f"_m{j}")) for i in range(k) for j in range(k)]).first()
        slope = np.array(first[:k], float) - ridge * beta
        bend = np.array(first[k:], float).reshape(k, k) - np.array(second, float).reshape(k, k) + ridge * np.eye(k)
        move = np.linalg.solve(bend, slope)
        beta = beta + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return sets.sparkSession.createDataFrame([(c, float(b), float(np.exp(b)), n) for c, b in zip(CHOICE, beta, strict=True)], schema)


FIXED = ["intercept", "log_length", "question", "hour_sin", "hour_cos"]


def answered_model(messages: DataFrame, events: DataFrame, rounds: int = 12, fixed_sd: float = 5.0, group_sd: float = 1.0) -> DataFrame:
    """(kind, name, value): a logistic model of being answered, with intercepts per sender and conversation.

    Fixed effects are the intercept, log1p of the length, a question mark, and the hour on a circle. Group
    intercepts have a normal prior of deviation ``group_sd``, fixed effects of ``fixed_sd``; the maximum of
    the posterior is found by Newton steps on the fixed effects and on each group in turn, whose sums are
    grouped aggregates. No rows below 50 messages, 5 answered, 5 unanswered or 3 senders.
    """
    hour = 2 * np.pi * F.hour("sent_at") / 24
    base = (
        messages.where(F.col("sender").isNotNull() & F.col("sent_at").isNotNull())
        .join(events.select(F.col("target").alias("row_id")).distinct().withColumn("_y", F.lit(1.0)), "row_id", "left")
        .select(
            "conversation_id", "sender", F.coalesce("_y", F.lit(0.0)).alias("y"), F.lit(1.0).alias("intercept"), F.log1p(F.coalesce(F.length("text"), F.lit(0))).alias("log_length"),
            F.coalesce(F.col("text").contains("?"), F.lit(False)).cast("double").alias("question"), F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos"),
        )
    )
    base = cut(base)
    schema = "kind string, name string, value double"
    facts = base.agg(F.count(F.lit(1)), F.sum("y"), F.count_distinct("sender")).first()
    n, yes, people = facts[0], facts[1] or 0, facts[2]
    if n < 50 or yes < 5 or n - yes < 5 or people < 3:
        return messages.sparkSession.createDataFrame([], schema)
    beta = np.zeros(len(FIXED))
    zero = F.lit(0.0)
    groups = {g: cut(base.select(g).distinct().withColumn(f"_{g}", zero)) for g in ("sender", "conversation_id")}
    k = len(FIXED)

    def chances() -> DataFrame:
        eta = sum((F.col(c) * float(b) for c, b in zip(FIXED, beta, strict=True)), F.lit(0.0)) + F.col("_sender") + F.col("_conversation_id")
        return base.join(groups["sender"], "sender").join(groups["conversation_id"], "conversation_id").withColumn("p", 1 / (1 + F.exp(-eta)))

    for _ in range(rounds):
        sums = chances().agg(
            *[F.sum((F.col("y") - F.col("p")) * F.col(c)) for c in FIXED], *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(a) * F.col(b)) for a in FIXED for b in FIXED]
        ).first()
        slope = np.array(sums[:k], float) - beta / fixed_sd**2
        move = np.linalg.solve(np.array(sums[k:], float).reshape(k, k) + np.eye(k) / fixed_sd**2, slope)
        beta = beta + np.clip(move, -2, 2)
        for g in groups:
            step = chances().groupBy(g).agg(F.sum(F.col("y") - F.col("p")).alias("_d"), F.sum(F.col("p") * (1 - F.col("p"))).alias("_h"), F.first(f"_{g}").alias("_old"))
            delta = (F.col("_d") - F.col("_old") / group_sd**2) / (F.col("_h") + 1 / group_sd**2)
            groups[g] = cut(step.select(g, (F.col("_old") + F.greatest(F.least(delta, F.lit(1.0)), F.lit(-1.0))).alias(f"_{g}")))
        if np.abs(move).max() < 1e-6:
            break
    fixed = messages.sparkSession.createDataFrame([("fixed", c, float(b)) for c, b in zip(FIXED, beta, strict=True)], schema)
    for g, kind in (("sender", "sender"), ("conversation_id", "conversation")):
        fixed = fixed.unionByName(groups[g].select(F.lit(kind).alias("kind"), F.col(g).alias("name"), F.col(f"_{g}").alias("value")))
    return fixed
