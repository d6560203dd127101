"""Operators without SQL against brute force, by hand, or by what must hold."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from threadloom.functions import text as T
from threadloom.operators import evaluation, graph, participation, replies, sampling, series, snapshots, themes
from threadloom.operators.running import running_sum
from threadloom.plans.registry import Measurement, Registry, artifact_json
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = "row_id long, conversation_id string, external_id string, sender string, sent_at timestamp, reply string, text string"


def chat(spark, rows):
    return spark.createDataFrame([(i, "c", str(i), who, T0 + timedelta(minutes=m), reply, text) for i, (who, m, reply, text) in enumerate(rows, 1)], BASE)


def acts(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [x.a for x in df.select(T.dialogue_acts(F.col("t")).alias("a")).collect()]


def test_acts_negation_and_borders(spark):
    assert acts(spark, "не согласен", "Согласен, давайте", "Ок.", "Что показывает отчёт?", "какой-то текст", "возьму завтра") == [
        ["DISAGREE"], ["PROPOSE", "AGREE"], ["ACKNOWLEDGE"], ["QUESTION"], ["ASSERT"], ["COMMIT"],
    ]


def test_sentences_count_code_points(spark):
    df = spark.createDataFrame([("🙂 Да. Нет…  ",), ("",), ("...",), (None,), ("a. a. a",)], "t string")
    got = [x.s for x in df.select(T.sentences(F.col("t")).alias("s")).collect()]
    assert [(s.start, s.end, s.sentence) for s in got[0]] == [(0, 5, "🙂 Да."), (6, 10, "Нет…")]
    assert got[1] == [] and [(s.start, s.end) for s in got[2]] == [(0, 3)]
    assert [(s.start, s.end) for s in got[4]] == [(0, 2), (3, 5), (6, 7)]


def test_normal_form_and_cosine(spark):
    row = spark.createDataFrame([("é\r\nx\ry", [1.0, 0.0], [0.0, 0.0], [3.0, 4.0], [1.0])], "t string, a array<double>, z array<double>, b array<double>, s array<double>")
    got = row.select(T.normalize_text(F.col("t")), T.cosine(F.col("a"), F.col("b")), T.cosine(F.col("a"), F.col("z")), T.cosine(F.col("a"), F.col("s"))).first()
    assert tuple(got) == ("é\nx\ny", 0.6, 0.0, None)


def test_running_sum_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(1000), r.randrange(5)) for _ in range(300)]
    rows = [(k, t, i, w) for i, (k, t, w) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t long, i long, w long")
    got = {x.i: x.s for x in running_sum(df, ["k"], F.floor(F.col("t") / 50), ["t", "i"], F.col("w"), "s").collect()}
    for k, t, i, _ in rows:
        assert got[i] == sum(w for kk, tt, ii, w in rows if kk == k and (tt, ii) <= (t, i))


def test_nearest_rank_is_half_even(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "v double")
    assert participation.nearest_rank_by_count(df, "v", {"p": 0.5}).first().p == 3.0
    assert participation.nearest_rank_by_count(df.limit(0), "v", {"p": 0.5}).first().p is None


def test_kaplan_meier_equals_the_product(spark):
    r = random.Random(2)
    rows = [(float(r.randrange(12)), r.random() < 0.6) for _ in range(80)] + [(20.0, True)]
    got = {x.minutes: x for x in replies.kaplan_meier(spark.createDataFrame(rows, "minutes double, replied boolean")).collect()}
    risk, s = len(rows), 1.0
    for t in sorted({t for t, _ in rows}):
        d = sum(x == t and e for x, e in rows)
        s *= 1 - d / risk
        assert (got[t].at_risk, got[t].events) == (risk, d) and math.isclose(got[t].survival, s, abs_tol=1e-12)
        risk -= sum(x == t for x, _ in rows)
    assert got[20.0].survival == 0.0


def test_candidates_horizon_and_eligibility(spark):
    rows = [("a", 0, None, "schedule of the pump"), ("b", 9 * 60, None, " "), ("b", 9 * 60 + 1, "404", "pump schedule"), ("a", 9 * 60 + 2, None, "pump schedule now"), ("c", 9 * 60 + 3, "1", "agreed")]
    got = {(x.source, x.target): x for x in replies.response_candidates(chat(spark, rows)).collect()}
    assert set(got) == {(4, 3), (5, 4), (5, 3), (5, 1)}
    assert got[4, 3].eligible and got[4, 3].rank == 1
    assert got[5, 1].source_native and got[5, 1].eligible and not got[5, 4].eligible


def test_explicit_target_takes_the_last_place(spark):
    rows = [("a", 0, None, "zzz")] + [("b", i, None, f"pump {i}") for i in range(1, 8)] + [("c", 9, "1", "pump")]
    got = sorted((x.rank, x.target) for x in replies.response_candidates(chat(spark, rows)).where("source = 9").collect())
    assert len(got) == 5 and got[-1] == (5, 1)


def test_choice_features_see_strictly_earlier_replies(spark):
    rows = [("a", 0, None, "x"), ("b", 1, "1", "x"), ("c", 2, "1", "x"), ("b", 25 * 60, "1", "x")]
    df = chat(spark, rows)
    got = {(x.source, x.candidate): x for x in replies.choice_features(df, replies.reply_events(df)).collect()}
    assert got[2, "a"].repetition == 0 and math.isclose(got[4, "a"].repetition, math.log(2)) and math.isclose(got[4, "a"].popularity, math.log(3))
    assert got[4, "a"].chosen and not got[4, "c"].chosen
    assert math.isclose(got[4, "a"].recency, math.exp(-(25 * 60 - 1) / 60 / 24))


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, w) for a, b, w in rows], "src string, dst string, weight long")


def test_graph_measures_by_hand(spark):
    path = edges(spark, ("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "a", 1))
    row = graph.motif_counts(path).first()
    assert (row.reciprocal_dyads, row.transitive_triples) == (1, 1)
    assert math.isclose(sum(x.rank for x in graph.page_rank(path).collect()), 1.0, abs_tol=1e-9)
    between = {x.id: x.betweenness for x in graph.betweenness(edges(spark, ("a", "b", 2), ("b", "c", 2), ("c", "d", 2))).collect()}
    assert between == {"a": 0, "b": 2, "c": 2, "d": 0}
    two = [(x, y, 5) for g in ("abcd", "wxyz") for x in g for y in g if x < y] + [("a", "w", 1)]
    found = {x.id: x.community for x in graph.communities(edges(spark, *two)).collect()}
    assert len({found[x] for x in "abcd"}) == 1 and len({found[x] for x in "wxyz"}) == 1 and found["a"] != found["w"]
    assert graph.page_rank(path.limit(0)).count() == 0 and graph.communities(path.limit(0)).count() == 0


def test_dyad_null_expects_the_product_of_shares(spark):
    rows = [("c", i, s, t) for i, (s, t) in enumerate([("a", "b")] * 30 + [("a", "x")] * 10 + [("d", "b")] * 10 + [("d", "x")] * 30)]
    df = spark.createDataFrame(rows, "conversation_id string, source long, source_sender string, target_sender string")
    got = {(x.sender, x.receiver): x for x in graph.dyad_null(df, permutations=100).collect()}
    assert abs(got["a", "b"].expected - 40 * 40 / 80) < 1.0 and got["a", "b"].z > 3 and got["a", "b"].p < 0.05


def test_information_measures(spark):
    r = random.Random(4)
    xs = [r.randrange(2) for _ in range(400)]
    rows = [("x", 7 * i, str(v)) for i, v in enumerate(xs)] + [("y", 7 * (i + 1), str(v)) for i, v in enumerate(xs)]
    day = datetime(2000, 1, 3).date()
    df = spark.createDataFrame([(s, day + timedelta(days=d), v) for s, d, v in rows], "sender string, week date, state string")
    bits = {(x.source, x.target): x.bits for x in series.transfer_entropy(df).collect()}
    assert bits["x", "y"] > 0.9 and bits["y", "x"] < 0.1
    atoms = [("g", str(a), str(b), str(a ^ b)) for a in (0, 1) for b in (0, 1) for _ in range(20)]
    got = series.information_atoms(spark.createDataFrame(atoms, "g string, x1 string, x2 string, y string"), ["g"]).first()
    assert abs(got.synergy - 1) < 1e-9 and abs(got.redundancy) < 1e-9 and abs(got.unique_1) < 1e-9
    assert series.information_atoms(spark.createDataFrame(atoms[:5], "g string, x1 string, x2 string, y string"), ["g"]).count() == 0


def test_hidden_states_find_the_switch(spark):
    rows = [(f"2024-{i:02}", 1.0 + i % 2 * 0.1 if i < 7 else 9.0 + i % 2 * 0.1) for i in range(1, 13)]
    got = [x.state for x in series.hidden_states(spark.createDataFrame(rows, "month string, v double"), "month", ["v"]).orderBy("month").collect()]
    assert len(set(got[:6])) == 1 and len(set(got[6:])) == 1 and got[0] != got[-1]
    assert series.hidden_states(spark.createDataFrame(rows[:4], "month string, v double"), "month", ["v"]).count() == 0


def test_change_splits_find_the_step_and_need_six_points(spark):
    rows = [(f"m{i}", 1 if i < 5 else 10) for i in range(9)]
    got = {x.method: x.month for x in participation.change_splits(spark.createDataFrame(rows, "month string, n long")).collect()}
    assert got == {"binary_segmentation_sse": "m5", "cusum_max_deviation": "m5"}
    assert participation.change_splits(spark.createDataFrame(rows[:5], "month string, n long")).count() == 0


def test_greedy_matches_equal_one_by_one(spark):
    r = random.Random(6)
    rows = [("g", f"a{i}", f"b{j}", round(r.random(), 1)) for i in range(6) for j in range(6)]
    got = {(x.gold, x.pred) for x in evaluation.greedy_matches(spark.createDataFrame(rows, "g string, gold string, pred string, s double"), ["g"], "gold", "pred", "s").collect()}
    want, left, right = set(), set(), set()
    for _, a, b, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if s > 0 and a not in left and b not in right:
            want.add((a, b)), left.add(a), right.add(b)
    assert got == want


def test_splits_are_whole_groups_of_the_right_size(spark):
    rows = [(f"g{i}",) for i in range(60) for _ in range(1 + i % 9)] + [("huge",)] * 150
    got = sampling.balanced_split(spark.createDataFrame(rows, "g string"), "g", {"train": 0.6, "dev": 0.2, "test": 0.2}, "s").collect()
    sizes = {}
    for x in got:
        sizes[x.split] = sizes.get(x.split, 0) + x.n
    assert sum(sizes.values()) == len(rows) and len({x.g for x in got}) == len(got) == 61
    assert abs(sizes["train"] / len(rows) - 0.6) < 0.05


def test_lineage_with_a_circle_ends(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), (None, "x")], "source_id string, target_id string")
    got = {(x.start_id, x.id, x.distance) for x in snapshots.lineage_closure(links, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2)}


def test_snapshots_do_not_leak_newer_texts(spark):
    rows = [(1, "c", "1", T0, "h1"), (2, "c", "1", T0 + timedelta(1), "h1"), (3, "c", "1", T0 + timedelta(2), "h2"), (4, "d", "1", T0, "h3")]
    revised = snapshots.revisions(spark.createDataFrame(rows, "row_id long, conversation_id string, external_id string, imported_at timestamp, text_hash string"))
    assert {(x.row_id, x.revision_no) for x in revised.collect()} == {(1, 1), (3, 2), (4, 1)}
    old, new = snapshots.members_at(revised, "2024-01-02 12:00:00"), snapshots.members_at(revised, "2024-02-01 00:00:00")
    assert {x.text_hash for x in old.collect()} == {"h1", "h3"} and {x.text_hash for x in new.collect()} == {"h2", "h3"}
    merged = snapshots.advance(old, new.where("conversation_id = 'c'"))
    assert {x.manifest for x in snapshots.manifest(merged).collect()} == {x.manifest for x in snapshots.manifest(new).collect()}


def test_topics_and_tfidf_have_unit_rows(spark):
    rows = [(i, ("pump valve sensor pump" if i % 2 else "archive ledger protocol archive") + f" word{i % 3}") for i in range(20)]
    w = themes.tfidf(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert all(abs(x.n - 1) < 1e-9 for x in w.groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect())
    topics = themes.topics_nmf(w, "k", k=2, rounds=6, top=3).collect()
    first = {t: {x.term for x in topics if x.topic == t} for t in (0, 1)}
    assert ("pump" in first[0]) != ("pump" in first[1])


def test_registry_refuses_a_second_definition(spark):
    r = Registry()
    m = Measurement("m", "1", lambda t: t["x"])
    r.register(m)
    with pytest.raises(ValueError):
        r.register(m)
    with pytest.raises(KeyError):
        r.get("other")
    out = artifact_json(r.execute("m", {"x": spark.createDataFrame([(1, None)], "b long, a string")}, "in")).first()
    assert out.payload.startswith('{"a":null,"b":1,"definition_id":"m"') and len(out.content_hash) == 64


def test_graphs_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_WHOLE_EDGES", 1)
    for find in (graph.betweenness, graph.communities):
        with pytest.raises(ValueError, match="at most 1"):
            find(edges(spark, ("a", "b", 1), ("b", "c", 1)))


def _replies(spark, n, conversations):
    r = random.Random(9)
    rows = [(f"c{r.randrange(conversations) ** 2 // conversations}", i * 7 % 1009 + 2000 * i, r.choice("aaabcdé"), r.choice("abbcdex")) for i in range(n)]
    return spark.createDataFrame(rows, "conversation_id string, source long, source_sender string, target_sender string")


def test_dyads_on_arrays_equal_those_of_joins(spark, monkeypatch):
    df = _replies(spark, 400, 9)
    order = lambda out: sorted(map(tuple, out.collect()))
    monkeypatch.setattr(graph, "MAX_IN_CONVERSATION", 0)
    want = order(graph.dyad_null(df, permutations=12, top=8))
    for most, shared, once in ((10**6, 10**6, 10**6), (10**6, 10, 16), (60, 25, 40)):
        monkeypatch.setattr(graph, "MAX_IN_CONVERSATION", most), monkeypatch.setattr(graph, "SHARED_FROM", shared), monkeypatch.setattr(graph, "AT_ONCE", once)
        assert order(graph.dyad_null(df, permutations=12, top=8)) == want
    assert graph.dyad_null(df.limit(0), permutations=3).count() == 0


def test_motifs_on_arrays_equal_those_of_joins(spark, monkeypatch):
    df = _replies(spark, 60, 3)
    monkeypatch.setattr(graph, "MAX_IN_ALL", 10**6)
    got = sorted(map(tuple, graph.motif_null(df, permutations=5).collect()))
    monkeypatch.setattr(graph, "MAX_IN_ALL", 0)
    assert got == sorted(map(tuple, graph.motif_null(df, permutations=5).collect())) and got[0][1] > 0 and got[1][3] > 0
    monkeypatch.setattr(graph, "MAX_IN_ALL", 10**6)
    assert {x.observed for x in graph.motif_null(df.limit(0), permutations=2).collect()} == {0}


def test_betweenness_of_many_shares_by_hand(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROOTS_TIMES_EDGES", 20)
    star = [(f"s{i}", "hub", 1) for i in range(6)] + [("hub", f"t{i}", 2) for i in range(5)] + [("s0", "x", 1), ("x", "y", 1), ("y", "z", 4)]
    got = graph.betweenness(edges(spark, *star))
    between = {x.id: x.betweenness for x in got.collect()}
    assert between.pop("hub") == 30 and between.pop("x") == 2 and between.pop("y") == 2
    assert set(between.values()) == {0}
    assert "MapInPandas" in (plan := got._jdf.queryExecution().toString()) and "Coalesce 1" not in plan and graph.betweenness(edges(spark, *star).limit(0)).count() == 0


def test_betweenness_by_way_of_a_hub_equals_all_paths():
    from fractions import Fraction

    from threadloom.operators import kernels

    r = random.Random(4)
    for n in (9, 14):
        nodes = range(n)
        edges = {(a, b): r.randint(1, 3) for a in nodes for b in nodes if a != b and (a < 9) == (b < 9) and r.random() < (0.7 if {0, 9} & {a, b} else 0.25)}
        want = [0.0] * n
        dist = [{a: Fraction(0)} for a in nodes]
        for a in nodes:
            for _ in nodes:
                for (u, v), w in edges.items():
                    if u in dist[a] and dist[a][u] + Fraction(1, w) < dist[a].get(v, 99):
                        dist[a][v] = dist[a][u] + Fraction(1, w)
        for a in nodes:
            paths = {a: [(a,)]}
            for v in sorted(dist[a], key=lambda v: dist[a][v])[1:]:
                paths[v] = [(*x, v) for u in nodes if (u, v) in edges and u in dist[a] and dist[a][u] + Fraction(1, edges[u, v]) == dist[a][v] for x in paths[u]]
                for x in paths[v]:
                    for u in x[1:-1]:
                        want[u] += 1 / len(paths[v])
        src, dst = (np.array([k[i] for k in edges]) for i in (0, 1))
        graph_ = kernels.hub_paths(n, src, dst, np.array([*edges.values()]))
        got = sum(kernels.betweenness(graph_, np.arange(k, n, 3)) for k in range(3))
        assert np.allclose(got, want, atol=1e-9) and max(want) > 1


def test_betweenness_walks_only_what_the_hub_does_not_give(monkeypatch):
    from threadloom.operators import kernels

    r, n = np.random.default_rng(2), 3000
    ring, far = np.arange(1, n), np.zeros(n - 1, int)
    src, dst = np.r_[ring, far, r.integers(1, n, 9000)], np.r_[far, ring, r.integers(1, n, 9000)]
    weight = np.r_[np.full(2 * (n - 1), 4.0), np.ones(9000)]
    hops, walked = kernels._hops, []
    monkeypatch.setattr(kernels, "_hops", lambda start, end, x: walked.append(len(start)) or hops(start, end, x))
    got = kernels.betweenness(kernels.hub_paths(n, src, dst, weight), np.arange(n))
    assert got[0] == (n - 1) * (n - 2) and not got[1:].any() and sum(walked) < 5 * n
