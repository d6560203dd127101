"""Small series and streams of states: entropy measures, information flow and hidden states."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(df: DataFrame, keys: list[str], name: str, group: list[str]) -> DataFrame:
    """(group, name): Shannon entropy in bits of the joint distribution of ``keys`` within each group."""
    counts = df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(
        (F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name)
    )


def weekly_states(messages: DataFrame, state: str) -> DataFrame:
    """(sender, week, state): each sender's most frequent state of the ISO week, ties to the first seen."""
    rows = messages.where(F.col("sender").isNotNull() & F.col("sent_at").isNotNull()).select(
        "sender", F.date_trunc("week", "sent_at").cast("date").alias("week"), F.col(state).alias("state"), "sent_at", "row_id"
    )
    counts = rows.groupBy("sender", "week", "state").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("sent_at", "row_id")).alias("_first"))
    best = Window.partitionBy("sender", "week").orderBy(F.desc("_n"), "_first")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("sender", "week", "state")


def transfer_entropy(states: DataFrame, least: int = 20) -> DataFrame:
    """(source, target, n, bits): I(target next; source now | target now) over common consecutive weeks.

    Plug-in estimate, at least 0, for ordered pairs with ``least`` triples. ``states`` are weekly, so a pair
    has few rows. Only senders that have so many weeks, or so many consecutive ones, can be in such a pair, so only they
    meet on the week; the four entropies come from one table of counts per pair.
    """
    now = states.select("sender", "week", "state")
    nxt = now.select("sender", F.date_add("week", -7).alias("week"), F.col("state").alias("next"))
    busy = lambda df, key: df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least).select(key), key, "left_semi")
    target = busy(now.join(nxt, ["sender", "week"]).select(F.col("sender").alias("target"), "week", F.col("state").alias("z"), F.col("next").alias("y")), "target")
    source = busy(now.select(F.col("sender").alias("source"), "week", F.col("state").alias("x")), "source")
    pair = ["source", "target"]
    cells = target.join(source, "week").where(F.col("source") != F.col("target")).groupBy(*pair, "x", "y", "z").agg(F.count(F.lit(1)).alias("_n"))
    every = F.collect_list(F.struct("x", "y", "z", "_n")).alias("_cells")
    pairs = cells.groupBy(*pair).agg(F.sum("_n").alias("n"), every).where(F.col("n") >= least)

    # Σ n·log2(n / total of its margin) over the cells of a pair; a pair has at most as many cells as weeks.
    def of(*keys: str) -> Column:
        same = lambda c, o: reduce(lambda p, q: p & q, [c[k].eqNullSafe(o[k]) for k in keys])
        margin = lambda c: F.aggregate(F.filter("_cells", lambda o: same(c, o)), F.lit(0).cast("long"), lambda t, o: t + o["_n"])
        return F.aggregate(F.transform("_cells", lambda c: c["_n"] * F.log2(margin(c))), F.lit(0.0), lambda t, v: t + v)

    bits = (of("x", "y", "z") + of("z") - of("y", "z") - of("x", "z")) / F.col("n")
    return pairs.select(*pair, "n", F.greatest(bits, F.lit(0.0)).alias("bits"))


def information_atoms(triples: DataFrame, group: list[str], least: int = 30) -> DataFrame:
    """(group, n, redundancy, unique_1, unique_2, synergy) of two sources x1, x2 about y.

    Redundancy is the smaller of the two specific informations, averaged over the outcomes of y.
    """
    n = triples.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = triples.join(n.select(*group), group, "left_semi")

    def specific(x: str, name: str) -> DataFrame:
        joint = rows.groupBy(*group, "y", x).agg(F.count(F.lit(1)).alias("_xy"))
        by_y, by_x, every = Window.partitionBy(*group, "y"), Window.partitionBy(*group, x), Window.partitionBy(*group)
        parts = joint.select(
            *group, "y", "_xy", F.sum("_xy").over(by_y).alias("_y"), F.sum("_xy").over(by_x).alias("_x"), F.sum("_xy").over(every).alias("_n")
        )
        term = F.col("_xy") / F.col("_y") * F.log2(F.col("_xy") * F.col("_n") / (F.col("_x") * F.col("_y")))
        return parts.groupBy(*group, "y").agg(F.sum(term).alias(name), (F.max("_y") / F.max("_n")).alias("_py"))

    one, two = specific("x1", "_s1"), specific("x2", "_s2").drop("_py")
    by_y = one.join(two, [*group, "y"]).groupBy(*group).agg(
        F.sum(F.col("_py") * F.least("_s1", "_s2")).alias("redundancy"),
        F.sum(F.col("_py") * F.col("_s1")).alias("_i1"),
        F.sum(F.col("_py") * F.col("_s2")).alias("_i2"),
    )
    both = n
    for name, keys in (("_hy", ["y"]), ("_hx", ["x1", "x2"]), ("_hxy", ["x1", "x2", "y"])):
        both = both.join(entropy(rows, keys, name, group), group)
    total = F.col("_hy") + F.col("_hx") - F.col("_hxy")
    r = F.col("redundancy")
    return both.join(by_y, group).select(
        *group, "n", "redundancy", (F.col("_i1") - r).alias("unique_1"), (F.col("_i2") - r).alias("unique_2"), (total - F.col("_i1") - F.col("_i2") + r).alias("synergy")
    )


def monthly_vector(messages: DataFrame) -> DataFrame:
    """(month, n, mean_chars, question_share, reply_share, entropy): observations of each month.

    The entropy is that of the month's known senders, in bits.
    """
    rows = messages.where(F.col("sent_at").isNotNull()).withColumn("month", F.date_format("sent_at", "yyyy-MM"))
    base = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.length("text"), F.lit(0))).alias("mean_chars"),
        (F.count_if(F.col("text").contains("?")) / F.count(F.lit(1))).alias("question_share"),
        (F.count_if(F.col("reply") != "") / F.count(F.lit(1))).alias("reply_share"),
    )
    mixed = entropy(rows.where(F.col("sender").isNotNull()), ["sender"], "entropy", ["month"])
    return base.join(mixed, "month", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def _two_states(rows: pd.DataFrame, label: str, values: list[str], rounds: int) -> pd.DataFrame:
    rows = rows.sort_values(label)
    x = rows[values].to_numpy(float)
    sd = x.std(0)
    x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    state = (np.arange(len(x)) >= len(x) // 2).astype(int)
    for _ in range(rounds):
        mean = np.stack([x[state == s].mean(0) if (state == s).any() else x.mean(0) for s in (0, 1)])
        var = np.stack([x[state == s].var(0) if (state == s).any() else x.var(0) for s in (0, 1)]) + 0.1
        move = np.ones((2, 2))
        np.add.at(move, (state[:-1], state[1:]), 1)
        move = np.log(move / move.sum(1, keepdims=True))
        seen = -0.5 * (((x[:, None] - mean[None]) ** 2) / var[None] + np.log(2 * np.pi * var[None])).sum(2)
        best = seen[0] + np.log(0.5)
        back = []
        for t in range(1, len(x)):
            options = best[:, None] + move
            back.append(options.argmax(0))
            best = options.max(0) + seen[t]
        path = [int(best.argmax())]
        for origin in reversed(back):
            path.append(int(origin[path[-1]]))
        new = np.array(path[::-1])
        if (new == state).all():
            break
        state = new
    return pd.DataFrame({label: rows[label].to_numpy(), "state": state.astype("int64")})


def hidden_states(series: DataFrame, label: str, values: list[str], least: int = 6, rounds: int = 8) -> DataFrame:
    """(label, state): a two-state Gaussian model of a short series, by hard expectation-maximisation.

    Diagonal variances, transitions with one pseudo-count, decoded by Viterbi. The series has one row per
    month, which bounds it; no rows below ``least`` points.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < least:
            return pd.DataFrame({label: pd.Series(dtype="str"), "state": pd.Series(dtype="int64")})
        return _two_states(rows, label, values, rounds)

    return series.select(label, *[F.col(v).cast("double").alias(v) for v in values]).groupBy().applyInPandas(run, f"{label} string, state bigint")
