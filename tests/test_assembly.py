"""Views, annotation sets and layered networks: small cases by hand."""

import math

from pyspark.sql import functions as F

from threadloom.operators import annotation, assembly, evaluation, networks
from threadloom.operators.sessions import episode_messages


def test_episodes_follow_the_pauses_of_a_conversation(spark):
    rows = [(1, "c", 0), (2, "c", 8 * 3600), (3, "c", 16 * 3600 + 1), (4, "d", 5), (5, "c", None)]
    df = spark.createDataFrame(rows, "row_id long, conversation_id string, s long").select("row_id", "conversation_id", F.timestamp_seconds("s").alias("sent_at"))
    got = {x.row_id: (x.episode_no, x.ordinal) for x in episode_messages(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (1, 1)}
    assert episode_messages(df.limit(0)).count() == 0


def test_chunks_keep_a_short_tail(spark):
    rows = spark.range(1, 46).select(F.col("id").alias("o"), F.lit(45).alias("n"))
    assert {x.k for x in rows.select(assembly.chunk_of(F.col("o"), F.col("n")).alias("k")).collect()} == {0}
    rows = spark.range(1, 51).select(F.col("id").alias("o"), F.lit(50).alias("n"))
    assert [x.k for x in rows.select(assembly.chunk_of(F.col("o"), F.col("n")).alias("k")).orderBy("o").collect()] == [0] * 40 + [1] * 10


def test_two_groups_are_two_communities(spark):
    edges = [(m, a, b, 1) for m in ("x", "y") for g in ("abcd", "pqrs") for i, a in enumerate(g) for b in g[i + 1 :]] + [("x", "a", "p", 1), ("x", "a", "a", 9)]
    got = networks.label_communities(spark.createDataFrame(edges, "month string, src string, dst string, weight int"), ["month"]).collect()
    assert len(got) == 16
    for month in ("x", "y"):
        label = {x.id: x.community for x in got if x.month == month}
        assert len({label[c] for c in "abcd"}) == 1 and len({label[c] for c in "pqrs"}) == 1 and label["a"] != label["p"]


def test_similar_writers_against_all_pairs(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"s{k}", " ".join(["common"] * 3 + [words[min(int(r.expovariate(0.06)), 59)] for _ in range(12)])) for k in range(40)] + [(None, "common w1"), ("s1", None)]
    got = {(x.left, x.right): x.similarity for x in networks.similar_writers(spark.createDataFrame(rows, "sender string, text string")).collect()}
    tf = {}
    for s, t in rows:
        if s and t:
            for w in t.split():
                tf.setdefault(s, {}).setdefault(w, 0)
                tf[s][w] += 1
    df = {w: sum(w in x for x in tf.values()) for w in {w for x in tf.values() for w in x}}
    vec = {s: {w: c * (math.log((1 + len(tf)) / (1 + df[w])) + 1) for w, c in x.items() if df[w] > 1} for s, x in tf.items()}
    norm = {s: math.sqrt(sum(v * v for v in x.values())) for s, x in vec.items()}
    want = {}
    for a in vec:
        for b in vec:
            if a < b:
                dot = sum(v * vec[b].get(w, 0) for w, v in vec[a].items()) / (norm[a] * norm[b])
                if dot >= 0.25:
                    want[a, b] = dot
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_excitation_gate_and_radius(spark):
    pairs = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], "source string, target string, excess double")
    many = spark.createDataFrame([("a", "x")] * 20, "sender string, text string")
    row = networks.excitation_radius(pairs, many).collect()[0]
    assert abs(row.spectral_radius - 2.0) < 1e-9 and row.stability_warning and row.n_events == 20
    assert networks.excitation_radius(pairs, many.limit(19)).count() == 0


def test_greedy_matches_one_to_one(spark):
    pairs = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.8), ("g", 2, 1, 0.85), ("g", 2, 2, 0.0), ("h", 1, 1, 0.5)], "k string, g int, p int, s double")
    got = sorted(tuple(x) for x in evaluation.greedy_matches(pairs, ["k"], "g", "p", "s").collect())
    assert got == [("g", 1, 1, 0.9), ("h", 1, 1, 0.5)]


def test_task_evaluation_skips_abstentions(spark):
    gold = spark.createDataFrame([("u", "t", "PRESENT", "yes "), ("v", "t", "ABSENT", None), ("w", "t", "ABSTAIN", None), ("x", "t", "ABSENT", None)], "unit_id string, task string, status string, label string")
    told = spark.createDataFrame([("u", "t", "YES"), ("v", "t", "NO"), ("w", "t", "NO")], "unit_id string, task string, label string")
    x = annotation.evaluate_tasks(gold, told).collect()[0]
    assert (x.tp, x.fp, x.fn, x.skipped, x.absent_right, x.absent_total) == (1, 1, 0, 1, 1, 2)


def test_parser_faults_and_spans(spark):
    schema = "key int, text string, tokens array<struct<id: int, start: int, end: int, form: string, head: int>>"
    rows = [(1, "ab cd", [(1, 0, 2, "ab", 2), (2, 3, 5, "cd", None)]), (2, "ab cd", [(1, 0, 2, "xx", None)]), (3, "ab cd", [(1, 0, 2, "ab", 7), (1, 3, 5, "cd", None)]), (4, "ab", [(1, 0, 3, "ab", None)])]
    got = sorted((x.key, x.fault) for x in annotation.parser_faults(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "offsets"), (3, "heads"), (3, "ids"), (4, "offsets")]


def test_comparison_cases_of_both_sides(spark):
    notes = [(o, f"n{o}{label}", label, o / 10) for o in range(1, 9) for label in ("A" if o % 2 else "B",)]
    df = spark.createDataFrame(notes, "object long, annotation string, label string, confidence double")
    got = assembly.comparison_cases(df, spark.createDataFrame([(1,)], "row_id long"), top=2).collect()
    assert sorted((x.side, x.annotation, x.place) for x in got) == [("hard_negative", "n6B", 2), ("hard_negative", "n8B", 1), ("supporting", "n5A", 2), ("supporting", "n7A", 1)]


def test_communities_of_writers_equal_those_of_their_edges(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(f"{'ж' if k % 5 else 'B'}{k}", " ".join(["all"] + [f"w{k % 4}{min(int(r.expovariate(0.2)), 19)}" for _ in range(10)])) for k in range(60)] + [("lone", "nobody else"), (None, "all")]
    df = spark.createDataFrame(rows, "sender string, text string")
    got = {tuple(x) for x in networks.similar_writer_communities(df).select("id", "community").collect()}
    monkeypatch.setattr(networks, "MAX_WEIGHTS", 0)
    assert got == {tuple(x) for x in networks.similar_writer_communities(df).select("id", "community").collect()} and len({c for _, c in got}) > 1
    monkeypatch.undo()
    assert networks.similar_writer_communities(df.limit(0)).count() == 0


def test_staging_leaves_no_shuffle_files(spark):
    from threadloom.session import stage

    kept = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before = kept()
    rows = stage(spark.range(5000).groupBy(F.pmod("id", F.lit(7)).alias("k")).agg(F.sum("id").alias("s")).repartition(3))
    assert not kept() - before and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_labels_of_most_senders_are_decided_early_and_right(monkeypatch):
    import numpy as np

    from threadloom.operators import kernels

    r, n, terms = np.random.default_rng(6), 900, 40
    key = np.unique(np.r_[np.arange(n) * terms, r.integers(0, n * terms, 6 * n)])
    at, term, w = (key // terms).astype(np.int32), (key % terms).astype(np.int32), r.integers(1, 4, len(key)).astype(float)
    labels = np.where(r.random(n) < 0.8, 3, r.integers(0, n, n))
    unit = np.zeros((n, terms))
    unit[at, term] = w
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    near = unit @ unit.T
    near[np.arange(n), np.arange(n)] = 0
    near[near < 0.25] = 0
    sums = np.round(np.array([np.bincount(labels, line, n) for line in near]), 9)
    own = sums[np.arange(n), labels] == sums.max(axis=1)
    want = np.where(own | (sums.max(axis=1) == 0), labels, sums.argmax(axis=1))
    whole = []
    rare = kernels._rare
    monkeypatch.setattr(kernels, "_rare", lambda vectors, block, among, out: whole.append(out.size) or rare(vectors, block, among, out))
    for dense in (1, 20, 40):
        vectors = kernels.split_vectors(n, terms, [(at[:999], term[:999], w[:999]), (at[999:], term[999:], w[999:])], n * dense)
        best, some = kernels.best_labels(vectors, np.arange(n), labels, 0.25)
        assert (best == want).all() and (some == (near > 0).any(axis=1)).all()
    assert sum(whole[-3:]) < 0.4 * n * n


def test_only_paired_messages_are_taken_apart(spark, monkeypatch):
    from threadloom.operators import observations

    seen, whole = [], observations.propositions
    monkeypatch.setattr(observations, "propositions", lambda rows, most=5: seen.append(rows) or whole(rows, most))
    messages = spark.createDataFrame([(i, f"Мы сделали отчёт номер {i}.") for i in range(1, 9)], "row_id long, text string")
    pairs = spark.createDataFrame([(2, 1, True, "x"), (5, 1, True, "x"), (7, 6, False, "x")], "source long, target long, source_native boolean, reason string")
    got = {(x.source, x.target): x.eligible for x in observations.proposition_pairs(messages, pairs).collect()}
    assert {x.row_id for x in seen[0].collect()} == {1, 2, 5} and got.keys() <= {(2, 1), (5, 1)}
