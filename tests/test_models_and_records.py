"""Models against their defining properties, and records by hand."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np

from threadloom.functions import text as T
from threadloom.operators import models, observations, records
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = "row_id long, conversation_id string, external_id string, sender string, sent_at timestamp, reply string, text string"


def test_choice_fit_is_the_optimum_and_gated(spark):
    r = random.Random(3)
    rows = []
    for s in range(120):
        x = [[r.random() * 3, r.random(), r.random(), r.random()] for _ in range(3)]
        w = [math.exp(1.2 * a[0] - 0.5 * a[2]) for a in x]
        pick = r.choices(range(3), w)[0]
        rows += [(s, f"c{i}", i == pick, *x[i]) for i in range(3)]
    df = spark.createDataFrame(rows, "source long, candidate string, chosen boolean, repetition double, reciprocity double, popularity double, recency double")
    got = {x.feature: x.coefficient for x in models.choice_fit(df).collect()}
    beta = np.array([got[c] for c in models.CHOICE])
    x = np.array([list(row[3:]) for row in rows]).reshape(120, 3, 4)
    y = np.array([row[2] for row in rows], float).reshape(120, 3)
    e = np.exp(x @ beta)
    p = e / e.sum(1, keepdims=True)
    slope = np.einsum("sc,sck->k", y - p, x) - 0.01 * beta
    assert np.abs(slope).max() < 1e-5 and got["repetition"] > 0.5
    assert models.choice_fit(df.where("source < 9")).count() == 0


def test_answered_model_prefers_what_is_answered(spark):
    rows = [(i, f"c{i % 4}", str(i), f"s{i % 5}", T0 + timedelta(hours=i), None, "why?" if i % 2 else "long text " * (i % 7)) for i in range(160)]
    df = spark.createDataFrame(rows, BASE)
    r = random.Random(5)
    answered = [(i, 0) for i in range(160) if r.random() < (0.8 if i % 2 else 0.15)]
    ev = spark.createDataFrame(answered, "target long, source long")
    got = {(x.kind, x.name): x.value for x in models.answered_model(df, ev, rounds=5).collect()}
    assert got["fixed", "question"] > 1 and len(got) == 5 + 5 + 4
    assert models.answered_model(df.limit(20), ev).count() == 0


def test_act_sequences_and_coreference(spark):
    texts = ["давайте завтра", "согласен", "Глеб придёт", "он знает", "Глеб тут"]
    rows = [(i, "c", str(i), "s", T0 + timedelta(minutes=i), None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, BASE)
    got = {(x.size, x.pattern): x.n for x in observations.act_sequences(df).collect()}
    assert got[2, "PROPOSE>AGREE"] == 1 and got[2, "ASSERT>ASSERT"] == 2 and got[5, "PROPOSE>AGREE>ASSERT>ASSERT>ASSERT"] == 1
    people = spark.createDataFrame([("p1", "Глеб Лопин"), ("p2", "Вера Лопин"), ("p3", None)], "person string, name string")
    found = observations.mentions(df, people)
    assert {(x.row_id, x.surface, x.person) for x in found.collect()} == {(2, "глеб", "p1"), (3, "он", None), (4, "глеб", "p1")}
    refs = {(x.row_id, x.antecedent): x.score for x in observations.coreference(df, found).collect()}
    assert refs == {(3, 2): 0.545, (4, 2): 0.89}


def test_discourse_and_components(spark):
    df = spark.createDataFrame([("но это верно, потому что так", "почему?", 0.2), ("спасибо", "текст", 0.0)], "s string, t string, v double")
    got = [x.l for x in df.select(observations.discourse_labels(F.col("s"), F.col("t"), F.col("v")).alias("l")).collect()]
    assert got == [["ANSWERS", "CONTRASTS", "ELABORATES"], ["ACKNOWLEDGES"]]
    kinds = [x.k for x in spark.createDataFrame([("исследования показали",), ("так как иначе",), ("просто текст",), (None,)], "s string").select(observations.argument_component(F.col("s")).alias("k")).collect()]
    assert kinds == ["EVIDENCE", "PREMISE", "CLAIM", "CLAIM"]


def test_affect_and_style_rates(spark):
    row = spark.createDataFrame([("Рад, отлично! не уверен",)], "t string").select(T.affect(F.col("t")).alias("a"), T.style(F.col("t")).alias("s")).first()
    assert row.a.joy == 0.5 and row.a.valence == 0.5 and row.a.dominance == -0.25
    assert row.s[0] == 0.25 and math.isclose(row.s[3], 2 / 23) and row.s[5] == 0.04


def test_theme_changes_need_points_and_report_persistence(spark):
    rows = [("t", f"2024-{i:02}", 10, 0.1 + 0.001 * (i % 3) if i < 7 else 0.4 + 0.001 * (i % 3)) for i in range(1, 11)] + [("few", f"2024-{i:02}", 10, 0.1 * i) for i in range(1, 4)]
    got = observations.share_changes(spark.createDataFrame(rows, "theme string, month string, n long, share double")).collect()
    assert got[0].theme == "t" and got[0].month == "2024-07" and got[0].persistence == 4 and all(x.theme == "t" for x in got)


def test_codebooks_and_manifests(spark):
    old, new = {"a": {"x": 1, "y": [1, 2]}, "b": "t"}, {"b": "t", "a": {"y": [1, 3], "z": 0}}
    got = {(x.path, x.change) for x in records.codebook_difference(spark, old, new).collect()}
    assert got == {("/a/x", "removed"), ("/a/y", "changed"), ("/a/z", "added")}
    assert records.codebook_hash(old) == records.codebook_hash({"b": "t", "a": {"y": [1, 2], "x": 1}}) != records.codebook_hash(new)
    rows = [(1, "s", "u", "t", "A", "PRESENT", None, "x"), (2, "s", "u", "t", "B", "ABSENT", "a", None)]
    schema = "judgment_id long, annotation_set_id string, unit_id string, task string, slot string, status string, annotator string, label string"
    one, two = (records.frozen_manifest(spark.createDataFrame(r, schema)).first().manifest for r in (rows, rows[::-1]))
    assert one == two
    assert records.unit_status(spark.createDataFrame(rows, schema)).first().status == "reviewed"


def test_pseudonyms_follow_first_appearance(spark):
    rows = [("b", T0), ("a", T0), ("c", T0 - timedelta(5)), ("b", T0 - timedelta(1)), (None, T0)]
    got = {x.sender: x.number for x in records.pseudonyms(spark.createDataFrame(rows, "sender string, sent_at timestamp")).collect()}
    assert got == {"c": 1, "b": 2, "a": 3}
