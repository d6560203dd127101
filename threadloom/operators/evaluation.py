"""Comparing predictions with human labels: set metrics, calibration, ranking and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) per label, and a row 'MICRO' and one 'MACRO'.

    A prediction is right when gold has the same keys and label; repeated rows count once.
    """
    g = gold.select(*keys, label).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys, label).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, [*keys, label], "full")
    hit = lambda a, b: F.count_if(a & b)
    has_g, has_p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    each = both.groupBy(label).agg(hit(has_g, has_p).alias("tp"), hit(~has_g, has_p).alias("fp"), hit(has_g, ~has_p).alias("fn"))
    micro = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).withColumn(label, F.lit("MICRO"))

    def rates(df: DataFrame) -> DataFrame:
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return df.select(
            label, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
        )

    rows = rates(each)
    macro = rows.agg(
        F.lit("MACRO").alias(label),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
    )
    return rows.unionByName(rates(micro)).unionByName(macro)


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, ece. Bins are half-open, the last one closed; rows with a null count nowhere."""
    rows = rows.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    p, y = F.col(confidence).cast("double"), F.col(correct).cast("double")
    each = rows.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"), F.sum((p - y) * (p - y)).alias("_b")
    )
    return each.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        (F.sum("_b") / F.sum("_n")).alias("brier"),
        (F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / F.sum("_n")).alias("ece"),
    )


def ranking_metrics(gold: DataFrame, ranked: DataFrame, query: str, item: str, rank: str = "rank") -> DataFrame:
    """One row: n_gold, recall, mrr, coverage: gold items found, mean reciprocal first rank, queries ranked."""
    g = gold.select(query, item).distinct()
    hits = g.join(ranked.groupBy(query, item).agg(F.min(rank).alias("_r")), [query, item], "left")
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.count("_r").alias("_k"), F.min("_r").alias("_first"))
    covered = found.join(ranked.select(query).distinct().withColumn("_any", F.lit(1)), query, "left")
    return covered.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_gold"),
        (F.sum("_k") / F.sum("_n")).alias("recall"),
        F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        (F.count("_any") / F.count(F.lit(1))).alias("coverage"),
    )


def span_overlap_f1(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """F1 of two half-open spans by their common length; 0 where they don't overlap."""
    common = F.greatest(F.least(hi, other_hi) - F.greatest(lo, other_lo), F.lit(0))
    total = (hi - lo) + (other_hi - other_lo)
    return F.when(total > 0, 2 * common / total).otherwise(0.0)


def greedy_matches(pairs: DataFrame, group: list[str], gold: str, predicted: str, score: str) -> DataFrame:
    """(group, gold, predicted, score): greedy one-to-one matches by descending score within each group.

    Pairs of score 0 or less don't match; ties go to the smaller gold, then the smaller predicted item. In
    each round the pairs that are best for both their sides match and remove all pairs of the two, which is
    what taking pairs one by one in order of score does; rounds end when nothing is left.
    """
    from threadloom.session import cut

    left = cut(pairs.where(F.col(score) > 0).select(*group, gold, predicted, score))
    found = None
    while not left.isEmpty():
        order = [F.desc(score), gold, predicted]
        marked = left.withColumn("_g", F.row_number().over(Window.partitionBy(*group, gold).orderBy(*order))).withColumn(
            "_p", F.row_number().over(Window.partitionBy(*group, predicted).orderBy(*order))
        )
        best = cut(marked.where((F.col("_g") == 1) & (F.col("_p") == 1)).select(*group, gold, predicted, score))
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best.select(*group, gold), [*group, gold], "left_anti").join(best.select(*group, predicted), [*group, predicted], "left_anti"))
    return found if found is not None else left
