"""One label per item out of several annotators' labels, with reliabilities and agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import stage

#: Annotators and distinct (task, label) pairs that the model may have; both are held by every task.
MAX_ANNOTATORS, MAX_LABELS = 1_000_000, 100_000
#: Rounds of expectation and maximisation, and steps on an item's difficulty in each.
ROUNDS, STEPS = 25, 6
#: Normal priors: mean and deviation of the ability, deviation of the logarithm of the easiness.
ABILITY, ABILITY_SPREAD, EASE_SPREAD = 2.0, 2.0, 0.7


def responses(judgments: DataFrame) -> DataFrame:
    """(annotation_set_id, unit_id, task, annotator, label): the label that counts of each annotator per item.

    Only rows with status PRESENT, an annotator and a label that isn't blank count; labels are trimmed and
    in upper case; the last submitted one of an annotator for an item stays (null times are oldest, ties go
    to the greater ``judgment_id``). Rows with a null unit or task belong to no item.
    """
    clean = F.upper(F.regexp_replace("label", r"^[\s ​]+|[\s ​]+$", ""))
    return (
        judgments.where((F.col("status") == "PRESENT") & F.col("annotator").isNotNull() & F.col("unit_id").isNotNull() & F.col("task").isNotNull())
        .withColumn("_label", clean)
        .where(F.col("_label") != "")
        .groupBy("unit_id", "task", "annotator")
        .agg(F.max_by(F.struct("annotation_set_id", "_label"), F.struct("submitted_at", "judgment_id")).alias("_last"))
        .select(F.col("_last.annotation_set_id").alias("annotation_set_id"), "unit_id", "task", "annotator", F.col("_last._label").alias("label"))
    )


def _items(given: DataFrame, annotators: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, task, who, what): each item with the numbers of its annotators and labels."""
    return (
        given.join(F.broadcast(annotators), "annotator")
        .join(F.broadcast(labels.select("task", "label", "_l")), ["task", "label"])
        .groupBy("unit_id", "task")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_a").alias("a"), F.col("_l").alias("l")))).alias("_r"))
        .select("unit_id", "task", F.transform("_r", lambda r: r["a"]).alias("who"), F.transform("_r", lambda r: r["l"]).alias("what"))
    )


class _Batch:
    """The responses of a batch of items, with the posterior of their labels under given abilities."""

    def __init__(self, batch: pa.RecordBatch, ability: np.ndarray, prior: np.ndarray, choices: np.ndarray) -> None:
        who, what = batch.column(batch.schema.get_field_index("who")), batch.column(batch.schema.get_field_index("what"))
        count = np.diff(who.offsets.to_numpy())
        self.who, self.what = who.flatten().to_numpy(), what.flatten().to_numpy()
        self.item = np.repeat(np.arange(len(count)), count)
        n = len(count)
        key = self.item.astype(np.int64) * len(prior) + self.what
        self.pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.pair_item, self.pair_label = self.pairs // len(prior), self.pairs % len(prior)
        chance = np.log(np.maximum(choices[self.what] - 1, 1))
        skill = ability[self.who]
        log_prior = np.log(prior[self.pair_label])
        unseen = np.maximum(1 - np.bincount(self.pair_item, prior[self.pair_label], n), 1e-12)
        ease = np.zeros(n)
        for step in range(STEPS + 1):
            strength = skill * np.exp(ease)[self.item]
            vote = np.bincount(self.pair_of, strength, len(self.pairs)) + log_prior
            top = np.maximum(np.full(n, -np.inf), 0.0)
            np.maximum.at(top, self.pair_item, vote)
            mass = np.exp(vote - top[self.pair_item])
            total = np.bincount(self.pair_item, mass, n) + unseen * np.exp(-top)
            self.posterior = mass / total[self.pair_item]
            self.right = self.posterior[self.pair_of]
            self.expected = 1 / (1 + np.exp(-np.clip(strength - chance, -30, 30)))
            if step == STEPS:
                break
            slope = np.bincount(self.item, (self.right - self.expected) * strength, n) - ease / EASE_SPREAD**2
            bend = np.bincount(self.item, self.expected * (1 - self.expected) * strength**2, n) + 1 / EASE_SPREAD**2
            ease = np.clip(ease + np.clip(slope / bend, -0.5, 0.5), -2.5, 2.5)
        self.ease = ease


def fit(judgments: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray, pd.DataFrame, pd.DataFrame]:
    """(items, abilities, label priors, annotators, labels) of the latent ability and difficulty model.

    The log-odds that annotator a labels item j rightly are ability(a) * exp(ease(j)) less the log-odds of a
    guess, so ability 0 is guessing. Each round finds every item's posterior and easiness under the present
    abilities by gradient steps where the item is read, and sends per-annotator sums of slopes, from which
    the abilities take a damped Newton step.
    """
    given = stage(responses(judgments))
    spark = given.sparkSession
    people = given.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_labels")).orderBy("annotator").limit(MAX_ANNOTATORS + 1).toPandas()
    kinds = given.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("task", "label").limit(MAX_LABELS + 1).toPandas()
    if len(people) > MAX_ANNOTATORS or len(kinds) > MAX_LABELS:
        raise ValueError("more annotators or labels than the model may hold")
    people["_a"] = np.arange(len(people))
    kinds["_l"] = np.arange(len(kinds))
    annotators = spark.createDataFrame(list(people[["annotator", "_a"]].itertuples(index=False, name=None)), "annotator string, _a int")
    labels = spark.createDataFrame(list(kinds[["task", "label", "_l"]].itertuples(index=False, name=None)), "task string, label string, _l int")
    items = stage(_items(given, annotators, labels))

    ability = np.full(len(people), ABILITY)
    task_size = kinds.groupby("task")["label"].transform("size").to_numpy(float) if len(kinds) else np.empty(0)
    prior = 1 / task_size
    for _ in range(rounds if len(people) else 0):
        shared = spark.sparkContext.broadcast((ability, prior, task_size))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            now, chance, size = shared.value
            slope, bend, mass = np.zeros(len(now)), np.zeros(len(now)), np.zeros(len(chance))
            for batch in batches:
                if len(batch):
                    b = _Batch(batch, now, chance, size)
                    scale = np.exp(b.ease)[b.item]
                    slope += np.bincount(b.who, (b.right - b.expected) * scale, len(now))
                    bend += np.bincount(b.who, b.expected * (1 - b.expected) * scale**2, len(now))
                    mass += np.bincount(b.pair_label, b.posterior, len(chance))
            at = np.flatnonzero(bend)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), "a")), pa.array(at), pa.array(slope[at]), pa.array(bend[at])], ["kind", "at", "x", "y"])
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), "l")), pa.array(at), pa.array(mass[at]), pa.array(np.zeros(len(at)))], ["kind", "at", "x", "y"])

        got = (
            items.mapInArrow(sums, "kind string, at bigint, x double, y double")
            .groupBy("kind", "at")
            .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
            .toPandas()
        )
        a = got[got["kind"] == "a"]
        slope, bend, mass = np.zeros(len(ability)), np.zeros(len(ability)), np.ones(len(prior))
        slope[a["at"]], bend[a["at"]] = a["x"], a["y"]
        named = got[got["kind"] == "l"]
        mass[named["at"]] += named["x"].to_numpy()
        move = (slope - (ability - ABILITY) / ABILITY_SPREAD**2) / (bend + 1 / ABILITY_SPREAD**2)
        ability = ability + np.clip(move, -0.7, 0.7)
        prior = mass / pd.Series(mass).groupby(kinds["task"]).transform("sum").to_numpy()
        shared.unpersist()
        if np.abs(move).max() < 1e-4:
            break
    return items, ability, prior, people, kinds


def _posteriors(judgments: DataFrame) -> DataFrame:
    items, ability, prior, _, kinds = fit(judgments)
    names = kinds["label"].to_numpy(object)
    size = kinds.groupby("task")["label"].transform("size").to_numpy(float) if len(kinds) else np.empty(0)
    shared = items.sparkSession.sparkContext.broadcast((ability, prior, size, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chance, sizes, label_names = shared.value
        for batch in batches:
            if not len(batch):
                continue
            b = _Batch(batch, now, chance, sizes)
            order = np.lexsort((b.pair_label, -b.posterior, b.pair_item))
            first = order[np.r_[True, np.diff(b.pair_item[order]) > 0]]
            n = np.bincount(b.item, minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(label_names[b.pair_label[first]], pa.string()),
                    pa.array(b.posterior[first]),
                    pa.array(np.exp(-b.ease)),
                    pa.array(n.astype(np.int64)),
                ],
                ["unit_id", "task", "label", "certainty", "difficulty", "n_annotators"],
            )

    return items.mapInArrow(run, "unit_id string, task string, label string, certainty double, difficulty double, n_annotators bigint")


def consensus(judgments: DataFrame) -> DataFrame:
    """(unit_id, task, label, certainty, difficulty, n_annotators) of every item with a label that counts.

    The label is the likeliest one under the model of ``fit``, ties go to the alphabetically first; the
    certainty is its posterior. See ``responses`` for the rows that count; repeated and revised judgments
    count once; an empty table gives an empty table. Annotators and labels are checked to be few enough to
    be held by every task, so an item's responses are bounded too.
    """
    return _posteriors(judgments)


def reliability(judgments: DataFrame) -> DataFrame:
    """(annotator, n_labels, ability, share_right): the ability of each annotator, 0 being a guess.

    ``share_right`` is the expected share of the annotator's labels that agree with the true ones.
    """
    items, ability, prior, people, kinds = fit(judgments)
    size = kinds.groupby("task")["label"].transform("size").to_numpy(float) if len(kinds) else np.empty(0)
    shared = items.sparkSession.sparkContext.broadcast((ability, prior, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                b = _Batch(batch, *shared.value)
                right = np.bincount(b.who, b.right, len(shared.value[0]))
                at = np.unique(b.who)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(right[at])], ["_a", "_right"])

    sums = items.mapInArrow(run, "_a bigint, _right double").groupBy("_a").agg(F.sum("_right").alias("_right"))
    rows = [(p.annotator, int(p.n_labels), int(p._2), float(ability[p._2])) for p in people[["annotator", "n_labels", "_a"]].itertuples(index=False)]
    table = items.sparkSession.createDataFrame(rows, "annotator string, n_labels bigint, _a bigint, ability double")
    return table.join(sums, "_a").select("annotator", "n_labels", "ability", (F.col("_right") / F.col("n_labels")).alias("share_right"))


def agreement(judgments: DataFrame) -> DataFrame:
    """(annotation_set_id, task, n_units, n_labels, observed, alpha): chance-corrected agreement.

    Over the items of a set and task that have at least two labels: ``observed`` is the share of agreeing
    pairs, each item weighted by its number of labels, ``alpha`` is Krippendorff's for nominal labels (null
    where all labels are equal or no item has two).
    """
    given = responses(judgments)
    cells = given.groupBy("annotation_set_id", "task", "unit_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    units = (
        cells.groupBy("annotation_set_id", "task", "unit_id")
        .agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_same"))
        .where(F.col("_m") > 1)
    )
    paired = cells.join(units.select("annotation_set_id", "task", "unit_id"), ["annotation_set_id", "task", "unit_id"], "left_semi")
    labels = paired.groupBy("annotation_set_id", "task", "label").agg(F.sum("_n").alias("_n"))
    expected = labels.groupBy("annotation_set_id", "task").agg(
        F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_chance"), F.sum("_n").alias("n_labels")
    )
    observed = units.groupBy("annotation_set_id", "task").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.col("_same") / (F.col("_m") - 1)).alias("_agree")
    )
    n = F.col("n_labels")
    by_chance = F.col("_chance") / (n * (n - 1))
    return observed.join(expected, ["annotation_set_id", "task"]).select(
        "annotation_set_id",
        "task",
        "n_units",
        "n_labels",
        (F.col("_agree") / n).alias("observed"),
        F.when(by_chance < 1, 1 - (1 - F.col("_agree") / n) / (1 - by_chance)).alias("alpha"),
    )
