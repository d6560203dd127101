"""Running sums and numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def hour_of(at: str) -> Column:
    """The hour of a timestamp as a number; null times come first."""
    return F.coalesce(F.floor(F.unix_micros(at) / HOUR_US), F.lit(-(2**62)))


def running_sum(rows: DataFrame, keys: list[str], part: Column, order: list, weight: Column, name: str) -> DataFrame:  # noqa: ANN001
    """``rows`` with ``name``: the sum of ``weight`` up to and with each row, in order within its keys.

    ``part`` must rise with ``order`` (an hour, a whole number of minutes). Sums inside a part come from a
    window over (keys, part); what lies before a part comes from one row per part. So a group with a third
    of all rows is ordered by many tasks, and what one task orders as a whole is its parts only.
    """
    rows = rows.withColumn("_part", part).withColumn("_weight", weight)
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before")
    )
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(before, on)
        .withColumn(name, F.col("_before") + F.sum("_weight").over(inside))
        .drop("_part", "_weight", "_before", "_p", *[f"_k{i}" for i in range(len(keys))])
    )


def row_numbers(rows: DataFrame, keys: list[str], at: str, tie: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, … by time and then ``tie`` within the keys."""
    return running_sum(rows, keys, hour_of(at), [at, tie], F.lit(1).cast("long"), name)
