"""Who takes part and how much: shares, entropy, inequality, monthly activity and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.running import running_sum


def nearest_rank_by_count(df: DataFrame, value: str, quantiles: dict[str, float], width: float = 1.0) -> DataFrame:
    """One row, one column per quantile: the value at position round((n − 1)·q), half to even.

    Null values don't count. Values are counted first and put in order inside steps of ``width``, so one
    task orders the steps, not the values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(counts, [], F.floor(F.col(value) / width), [value], F.col("_n"), "_upto")
    total = counts.agg(F.sum("_n").alias("_total"))
    return upto.crossJoin(F.broadcast(total)).agg(
        *[F.min(F.when(F.col("_upto") > F.bround((F.col("_total") - 1) * F.lit(q), 0), F.col(value))).alias(name) for name, q in quantiles.items()]
    )


def sender_counts(messages: DataFrame, sender: str = "sender", text: str = "text") -> DataFrame:
    """(sender, n_messages, n_chars, n_questions) of every non-null sender."""
    return (
        messages.where(F.col(sender).isNotNull())
        .groupBy(sender)
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"),
            F.count_if(F.col(text).contains("?")).alias("n_questions"),
        )
    )


def participation_share(messages: DataFrame, sender: str = "sender") -> DataFrame:
    """(sender, n_messages, share): shares of the messages that have a sender."""
    counts = messages.where(F.col(sender).isNotNull()).groupBy(sender).agg(F.count(F.lit(1)).alias("n_messages"))
    total = counts.agg(F.sum("n_messages").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(sender, "n_messages", (F.col("n_messages") / F.col("_total")).alias("share"))


def concentration(messages: DataFrame, sender: str = "sender") -> DataFrame:
    """One row: entropy_bits, normalized_entropy, gini, n_senders, n_messages, top_1_share, top_10_share.

    Shares are of all messages, those without a sender included. Ranks for the Gini coefficient come from
    the distribution of counts, never from a sort of all senders in one task.
    """
    total = messages.agg(F.count(F.lit(1)).alias("n_messages"))
    counts = messages.where(F.col(sender).isNotNull()).groupBy(sender).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.crossJoin(F.broadcast(total)).agg(
        F.sum(-(F.col("_n") / F.col("n_messages")) * F.log2(F.col("_n") / F.col("n_messages"))).alias("_entropy"),
        F.count(F.lit(1)).alias("n_senders"),
        F.sum("_n").alias("_sum"),
    )
    sizes = counts.groupBy("_n").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.withColumn("_before", before).agg(
        F.sum(F.col("_n") * (F.col("_k") * F.col("_before") + F.col("_k") * (F.col("_k") + 1) / 2)).alias("_weighted")
    )
    top = counts.orderBy(F.desc("_n"), sender).limit(10).agg(F.max("_n").alias("_one"), F.sum("_n").alias("_ten"))
    n = F.col("n_senders")
    row = sums.crossJoin(F.broadcast(ranks)).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(top))
    return row.select(
        F.coalesce("_entropy", F.lit(0.0)).alias("entropy_bits"),
        F.when(n > 1, F.col("_entropy") / F.log2(n)).otherwise(0.0).alias("normalized_entropy"),
        F.when(F.col("_sum") > 0, 2 * F.col("_weighted") / (n * F.col("_sum")) - (n + 1) / n).otherwise(0.0).alias("gini"),
        "n_senders",
        "n_messages",
        F.coalesce(F.col("_one") / F.col("n_messages"), F.lit(0.0)).alias("top_1_share"),
        F.coalesce(F.col("_ten") / F.col("n_messages"), F.lit(0.0)).alias("top_10_share"),
    )


def monthly_counts(messages: DataFrame, at: str = "sent_at") -> DataFrame:
    """(month, n): messages by calendar month in UTC; months without messages have no row."""
    return messages.where(F.col(at).isNotNull()).groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def robust_change_points(series: DataFrame, label: str = "month", value: str = "n", top: int = 6) -> DataFrame:
    """(label, previous, n, log_change, robust_score, direction) of the ``top`` most unusual changes.

    The change is the difference of log1p between neighbouring rows, its score the distance from the median
    in scaled median deviations (unscaled where those are 0), kept from 2 upwards. The series is an
    aggregate by month or week and small whatever the data.
    """
    order = Window.orderBy(label)
    deltas = series.select(
        label,
        value,
        F.lag(value).over(order).alias("previous"),
        (F.log1p(value) - F.log1p(F.lag(value).over(order))).alias("log_change"),
    ).where(F.col("previous").isNotNull())
    center = deltas.agg(F.median("log_change").alias("_center"))
    spread = deltas.crossJoin(F.broadcast(center)).agg(F.median(F.abs(F.col("log_change") - F.col("_center"))).alias("_mad"))
    away = F.abs(F.col("log_change") - F.col("_center"))
    score = F.when(F.col("_mad") > 0, away / (1.4826 * F.col("_mad"))).otherwise(away)
    return (
        deltas.crossJoin(F.broadcast(center))
        .crossJoin(F.broadcast(spread))
        .withColumn("robust_score", score)
        .where(F.col("robust_score") >= 2)
        .select(label, "previous", value, "log_change", "robust_score", F.when(F.col("log_change") > 0, "increase").otherwise("decrease").alias("direction"))
        .orderBy(F.desc("robust_score"), label)
        .limit(top)
    )


def change_splits(series: DataFrame, label: str = "month", value: str = "n", least: int = 6) -> DataFrame:
    """(method, label, score): the best binary split by squared error and the largest CUSUM deviation.

    No rows below ``least`` points. A split before point i is tried for i = 2 … n − 2; equal gains go to the
    later one, equal deviations to the first. Prefix sums give every split at once.
    """
    order = Window.orderBy(label)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    x = F.col(value).cast("double")
    rows = series.select(
        label,
        F.row_number().over(order).alias("i"),
        F.sum(x).over(upto).alias("s"),
        F.sum(x * x).over(upto).alias("q"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sum(x).over(whole).alias("all_s"),
        F.sum(x * x).over(whole).alias("all_q"),
        F.lead(label).over(order).alias("_next"),
    ).where(F.col("n") >= least)
    i, n, s, q, all_s, all_q = (F.col(c) for c in ("i", "n", "s", "q", "all_s", "all_q"))
    gain = (all_q - all_s * all_s / n) - (q - s * s / i) - ((all_q - q) - (all_s - s) * (all_s - s) / (n - i))
    binary = (
        rows.where((i >= 2) & (i <= n - 2))
        .select(F.lit("binary_segmentation_sse").alias("method"), F.col("_next").alias(label), gain.alias("score"), "i")
        .orderBy(F.desc("score"), F.desc("i"))
        .limit(1)
    )
    cusum = (
        rows.where(i <= n - 1)
        .select(F.lit("cusum_max_deviation").alias("method"), F.col("_next").alias(label), F.abs(s - i * all_s / n).alias("score"), "i")
        .orderBy(F.desc("score"), "i")
        .limit(1)
    )
    return binary.unionByName(cusum).drop("i")
