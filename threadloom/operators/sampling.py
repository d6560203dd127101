"""Deterministic samples, splits and annotation tasks, by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut


def priority(seed: str, key: Column) -> Column:
    """A hash that orders keys in the same way for the same seed, everywhere."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def length_bucket(text: Column) -> Column:
    """empty, short (under 40 code points), medium (under 200) or long."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, "empty").when(n < 40, "short").when(n < 200, "medium").otherwise("long")


def stratified_sample(rows: DataFrame, key: str, strata: list[str], size: int, seed: str) -> DataFrame:
    """(key, strata, depth, place): ``size`` rows taken round-robin over the strata, in order of hashes.

    Within a stratum rows come by the hash of their key; round by round each stratum gives one, strata being
    ordered by their own hash. Nothing is collected: first every task keeps its best rows of each stratum.
    """
    h = rows.select(key, *strata, priority(seed, F.col(key)).alias("_h"))
    inside = Window.partitionBy(*strata).orderBy("_h", key)
    kept = h.withColumn("depth", F.row_number().over(inside)).where(F.col("depth") <= size)
    stratum = priority(seed, F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]))
    top = kept.withColumn("_s", stratum).orderBy("depth", "_s", key).limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy("depth", "_s", key))).select(key, *strata, "depth", "place")


def lowest_hashes(rows: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """(key): the round(n·fraction) keys of lowest hash, half to even.

    The counts of the 65,536 first halves of hashes, at most so many rows, tell in which of them the last key lies; all below are
    taken as they are, and only that one share is ordered.
    """
    hashed = rows.select(key, priority(seed, F.col(key)).alias("_h")).withColumn("_first", F.substring("_h", 1, 4))
    counts = dict(hashed.groupBy("_first").count().collect())
    left, last = int(round(sum(counts.values()) * fraction)), ""
    for first in sorted(counts):
        last = first
        if left <= counts[first]:
            break
        left -= counts[first]
    below = hashed.where(F.col("_first") < last).select(key)
    return below.unionByName(hashed.where(F.col("_first") == last).orderBy("_h", key).limit(left).select(key))


def balanced_split(rows: DataFrame, group: str, shares: dict[str, float], seed: str) -> DataFrame:
    """(group, n, split): whole groups dealt to splits so that sizes come close to ``shares``.

    Groups with more than a thousandth of the rows, at most a thousand of them, are dealt one by one from
    the largest, each to the split that is furthest below its share; all others, whose sum decides little
    singly, follow their hash over what room is left.
    """
    sizes = cut(rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") * 1000 >= total).orderBy(F.desc("n"), group).collect()
    room = {s: share * total for s, share in shares.items()}
    dealt = []
    for row in large:
        split = max(room, key=lambda s: (room[s], s))
        room[split] -= row["n"]
        dealt.append((row[group], split))
    rest = sum(max(r, 0.0) for r in room.values())
    u = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1_000_000)) / 1_000_000.0
    choice, upto = None, 0.0
    for split, r in room.items():
        upto += max(r, 0.0) / rest if rest else 1.0 / len(room)
        choice = F.when(u < upto, split) if choice is None else choice.when(u < upto, split)
    spark = rows.sparkSession
    fixed = spark.createDataFrame(dealt, f"_g {rows.schema[group].dataType.simpleString()}, _split string")
    return sizes.join(F.broadcast(fixed), sizes[group] == F.col("_g"), "left").select(
        group, "n", F.coalesce("_split", choice.otherwise(list(room)[-1])).alias("split")
    )


def missing_tasks(units: DataFrame, judgments: DataFrame, tasks: list[str], slots: list[str]) -> DataFrame:
    """(unit_id, task, slot) of every task and slot of a unit that has no judgment yet."""
    grid = units.select("unit_id").distinct().select(
        "unit_id", F.explode(F.array(*map(F.lit, tasks))).alias("task")
    ).select("unit_id", "task", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    return grid.join(judgments.select("unit_id", "task", "slot"), ["unit_id", "task", "slot"], "left_anti")
