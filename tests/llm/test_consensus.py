"""Consensus labels on judgments whose truth is known."""

import random
from datetime import datetime, timedelta, timezone

from threadloom.llm.consensus import agreement, consensus, reliability, responses

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "judgment_id long, annotation_set_id string, unit_id string, task string, slot string, status string, annotator string, label string, submitted_at timestamp, posterior int"


def made(seed=3, units=250):
    r = random.Random(seed)
    names = {"dialogue_act": list("ABCDEFG"), "stance": list("XYZ")}
    skill = {f"good{i}": 0.93 for i in range(3)} | {f"fair{i}": 0.75 for i in range(3)} | {f"noise{i}": 0.2 for i in range(5)} | {"liar": 0.0, "lazy": None}
    rows, truth, k = [], {}, 0
    for u in range(units):
        for task, labels in names.items():
            truth[f"u{u}", task] = right = r.choice(labels)
            for who in r.sample(sorted(skill), r.choice([1, 3, 5, 7])):
                p = skill[who]
                label = labels[0] if p is None else right if r.random() < p else r.choice([x for x in labels if x != right])
                rows.append((k, "s1", f"u{u}", task, "A", "PRESENT", who, r.choice([label, label.lower(), f" {label} "]), T0 + timedelta(seconds=k), 1))
                k += 1
    return rows, truth


def test_consensus_beats_the_majority(spark):
    rows, truth = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [x for x in consensus(df).collect() if x.n_annotators >= 3]
    votes = {}
    for row in rows:
        votes.setdefault((row[2], row[3]), []).append(row[7].strip().upper())
    right = sum(x.label == truth[x.unit_id, x.task] for x in got) / len(got)
    majority = sum(max(sorted(set(votes[x.unit_id, x.task])), key=votes[x.unit_id, x.task].count) == truth[x.unit_id, x.task] for x in got) / len(got)
    assert right > majority + 0.05 and right > 0.85
    skill = {x.annotator: x for x in reliability(df).collect()}
    assert min(skill[f"good{i}"].ability for i in range(3)) > max(skill[f"noise{i}"].ability for i in range(5))
    assert skill["liar"].ability < 0.5 and skill["good0"].share_right > 0.8


def test_which_rows_count(spark):
    def row(k, who, label, status="PRESENT", unit="u", at=0, task="stance"):
        return (k, "s", unit, task, "A", status, who, label, None if at is None else T0 + timedelta(seconds=at), 1)

    rows = [
        row(1, "a", " x "), row(2, "a", "y", at=5), row(3, "a", "z", at=5), row(3, "a", "z", at=5), row(4, "b", None), row(5, None, "x"), row(6, "c", "  "),
        row(7, "d", "X", "ABSENT"), row(8, "e", "x", at=None), row(9, "e", "w", at=1), row(10, "f", "x", unit=None), row(11, "f", "x", task=None), row(12, "g", "x", unit="v"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(x.unit_id, x.annotator, x.label) for x in responses(df).collect()} == {("u", "a", "Z"), ("u", "e", "W"), ("v", "g", "X")}
    assert {(x.unit_id, x.n_annotators) for x in consensus(df).collect()} == {("u", 2), ("v", 1)}
    for op in (consensus, reliability, agreement):
        assert op(df.limit(0)).count() == 0


def test_agreement_by_hand(spark):
    rows = [(i, "s", unit, "t", "A", "PRESENT", who, label, T0, 1) for i, (unit, who, label) in enumerate([("1", "a", "x"), ("1", "b", "x"), ("2", "a", "x"), ("2", "b", "y"), ("3", "a", "y")])]
    got = agreement(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    # Pairs: item 1 agrees, item 2 doesn't; x three times, y once: chance (3·2)/(4·3) = 1/2.
    assert (got.n_units, got.n_labels, got.observed, got.alpha) == (2, 4, 0.5, 0.0)
