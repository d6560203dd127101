"""The weighted reply graph: ranks, motifs, communities, betweenness, roles and null models."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.participation import nearest_rank_by_count
from threadloom.session import cut

#: Most edges of an actor graph that are worked on as a whole by one task; beyond it the result is unavailable.
MAX_WHOLE_EDGES = 2_000_000
#: Roots times edges that one task of betweenness takes, and its most tasks (each gives a row per node).
ROOTS_TIMES_EDGES, MAX_SHARES = 200_000_000, 64
#: Replies whose shuffles are made on arrays: of one conversation in one task, and of all that every task gets. Beyond them joins make the same shuffles.
MAX_IN_CONVERSATION, MAX_IN_ALL = 5_000_000, 4_000_000
#: Replies of a conversation from which several tasks share its permutations, and replies that are shuffled at once.
SHARED_FROM, AT_ONCE = 200_000, 300_000


def reply_edges(events: DataFrame) -> DataFrame:
    """(src, dst, weight): replies between different known senders, from the replier to the one replied to."""
    return (
        events.where(F.col("source_sender") != F.col("target_sender"))
        .groupBy(F.col("source_sender").alias("src"), F.col("target_sender").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after ``rounds`` of weighted PageRank; ranks sum to 1, nodes without exits spread evenly.

    Each round is one join and one aggregation; lineage is cut every few rounds.
    """
    edges = cut(edges)
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(None).cast("double"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    moves = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("_p")))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    exits = out.select(F.col("src").alias("id"), F.lit(True).alias("_exits"))
    for i in range(1, rounds + 1):
        lost = ranks.join(exits, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_lost"))
        got = moves.join(ranks, moves["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("_p") * F.col("rank")).alias("_got"))
        ranks = (
            nodes.join(got, nodes["id"] == got["dst"], "left")
            .crossJoin(F.broadcast(lost))
            .select("id", ((1 - damping) / n + damping * (F.coalesce("_got", F.lit(0.0)) + F.col("_lost") / n)).alias("rank"))
        )
        if i % 4 == 0 or i == rounds:
            ranks = cut(ranks)
    return ranks


def _transitive_triples(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n): a→b, b→c, a→c with three different nodes in each graph of distinct edges ``src``, ``dst``.

    Every triangle of the undirected graph is met once, from its node of least degree, whose neighbours of higher degree
    are few in any graph: a hot node makes no wedges. Its six possible arrows then tell how many triples it holds.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    links = pairs.groupBy(*keys, low.alias("u"), high.alias("v")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("f"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("b"))
    ends = links.select(*keys, F.explode(F.array("u", "v")).alias("id")).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("d"))
    at = lambda end: ends.select(*keys, F.col("id").alias(end), F.col("d").alias(f"_d{end}"))
    ranked = links.join(at("u"), [*keys, "u"]).join(at("v"), [*keys, "v"])
    up = F.struct("_du", "u") < F.struct("_dv", "v")
    turned = cut(
        ranked.select(
            *keys, F.when(up, F.struct(F.col("_du").alias("d"), F.col("u").alias("i"))).otherwise(F.struct(F.col("_dv").alias("d"), F.col("v").alias("i"))).alias("a"),
            F.when(up, F.struct(F.col("_dv").alias("d"), F.col("v").alias("i"))).otherwise(F.struct(F.col("_du").alias("d"), F.col("u").alias("i"))).alias("z"),
            F.when(up, F.col("f")).otherwise(F.col("b")).alias("f"), F.when(up, F.col("b")).otherwise(F.col("f")).alias("b"),
        )
    )
    one = turned.select(*keys, "a", F.col("z").alias("x"), F.col("f").alias("ax"), F.col("b").alias("xa"))
    two = turned.select(*keys, "a", F.col("z").alias("y"), F.col("f").alias("ay"), F.col("b").alias("ya"))
    three = turned.select(*keys, F.col("a").alias("x"), F.col("z").alias("y"), F.col("f").alias("xy"), F.col("b").alias("yx"))
    found = one.join(two, [*keys, "a"]).where("x < y").join(three, [*keys, "x", "y"])
    arrows = F.expr("ax*xy*ay + ay*yx*ax + xa*ay*xy + xy*ya*xa + ya*ax*yx + yx*xa*ya")
    return found.groupBy(*keys).agg(F.sum(arrows).alias("_n"))


def motif_counts(edges: DataFrame) -> DataFrame:
    """One row: reciprocal_dyads and transitive_triples (a→b, b→c, a→c with three different nodes)."""
    pairs = cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    dyads = pairs.join(back, ["src", "dst"], "left_semi").where(F.col("src") < F.col("dst")).agg(F.count(F.lit(1)).alias("reciprocal_dyads"), F.lit(0).cast("long").alias("transitive_triples"))
    triples = _transitive_triples(pairs, []).agg(F.lit(0).cast("long").alias("reciprocal_dyads"), F.coalesce(F.sum("_n"), F.lit(0)).alias("transitive_triples"))
    return dyads.unionByName(triples).agg(F.max("reciprocal_dyads").alias("reciprocal_dyads"), F.max("transitive_triples").alias("transitive_triples"))


def role_profiles(senders: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """(sender, n_messages, mean_chars, question_share, sent, received, role) of senders with ``least`` messages.

    A role is given by the first of the thresholds at the 75th nearest-rank percentile that a sender
    reaches: broker (sent and received), initiator (received), responder (sent), questioner, broadcaster.
    """
    sent = edges.groupBy(F.col("src").alias("sender")).agg(F.sum("weight").alias("sent"))
    received = edges.groupBy(F.col("dst").alias("sender")).agg(F.sum("weight").alias("received"))
    rows = (
        senders.where(F.col("n_messages") >= least)
        .join(sent, "sender", "left")
        .join(received, "sender", "left")
        .select(
            "sender",
            "n_messages",
            (F.col("n_chars") / F.col("n_messages")).alias("mean_chars"),
            (F.col("n_questions") / F.col("n_messages")).alias("question_share"),
            F.coalesce("sent", F.lit(0)).alias("sent"),
            F.coalesce("received", F.lit(0)).alias("received"),
        )
    )
    marks = None
    for c, width in (("sent", 1.0), ("received", 1.0), ("question_share", 0.001), ("mean_chars", 1.0)):
        mark = nearest_rank_by_count(rows, c, {f"_{c}": 0.75}, width)
        marks = mark if marks is None else marks.crossJoin(F.broadcast(mark))
    high = lambda c: (F.col(c) >= F.col(f"_{c}")) & (F.col(c) > 0)
    role = (
        F.when(high("sent") & high("received"), "broker")
        .when(high("received"), "initiator")
        .when(high("sent"), "responder")
        .when(high("question_share"), "questioner")
        .when(high("mean_chars"), "broadcaster")
        .otherwise("participant")
    )
    return rows.crossJoin(F.broadcast(marks)).select("sender", "n_messages", "mean_chars", "question_share", "sent", "received", role.alias("role"))


def top_roles(profiles: DataFrame, top: int = 30) -> DataFrame:
    """(profiles, place): the ``top`` profiles, brokers first, then by number of messages, ties by sender."""
    order = [F.desc((F.col("role") == "broker").cast("int")), F.desc("n_messages"), F.col("sender")]
    return profiles.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _communities(edges: pd.DataFrame) -> pd.DataFrame:
    """Greedy modularity moves over undirected weights, level by level, in a fixed order."""
    names = sorted(set(edges["src"]) | set(edges["dst"]))
    number = {v: i for i, v in enumerate(names)}
    links: dict[tuple[int, int], float] = {}
    for s, d, w in edges[["src", "dst", "weight"]].itertuples(index=False):
        key = tuple(sorted((number[s], number[d])))
        links[key] = links.get(key, 0.0) + float(w)
    member = list(range(len(names)))
    nodes = len(names)
    loops = np.zeros(nodes)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(nodes)]
        for (a, b), w in links.items():
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        degree = np.array([sum(n.values()) for n in near]) + 2 * loops
        twice = degree.sum()
        if twice == 0:
            break
        home = list(range(nodes))
        weight = degree.copy()
        queue, moved = deque(range(nodes)), False
        waiting = [True] * nodes
        while queue:
            v = queue.popleft()
            waiting[v] = False
            toward: dict[int, float] = {}
            for u, w in near[v].items():
                toward[home[u]] = toward.get(home[u], 0.0) + w
            old = home[v]
            weight[old] -= degree[v]
            gain = {c: w - degree[v] * weight[c] / twice for c, w in toward.items()}
            best = max(sorted(gain), key=lambda c: gain[c], default=old)
            if best != old and gain[best] <= gain.get(old, -degree[v] * weight[old] / twice) + 1e-9:
                best = old
            weight[best] += degree[v]
            if best != old:
                home[v], moved = best, True
                for u in near[v]:
                    if not waiting[u] and home[u] != best:
                        waiting[u] = True
                        queue.append(u)
        if not moved:
            break
        relabel = {c: i for i, c in enumerate(sorted(set(home)))}
        member = [relabel[home[m]] for m in member]
        fresh: dict[tuple[int, int], float] = {}
        inside = np.zeros(len(relabel))
        for v in range(nodes):
            inside[relabel[home[v]]] += loops[v]
        for (a, b), w in links.items():
            x, y = sorted((relabel[home[a]], relabel[home[b]]))
            if x == y:
                inside[x] += w
            else:
                fresh[(x, y)] = fresh.get((x, y), 0.0) + w
        links, nodes, loops = fresh, len(relabel), inside
    order = {c: i for i, c in enumerate(dict.fromkeys(member))}
    return pd.DataFrame({"id": names, "community": [order[m] for m in member]})


def _bounded(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    n = edges.count()
    if n > MAX_WHOLE_EDGES:
        raise ValueError(f"the graph has {n} edges; one task holds at most {MAX_WHOLE_EDGES}")
    return edges


def _numbered(rows: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(id, _no) of all nodes, and ``rows`` with the numbers of both ends in ``left`` and ``right``, as longs with gaps."""
    nodes = rows.select(F.col(left).alias("id")).union(rows.select(right)).distinct()
    nodes = cut(nodes.withColumn("_no", F.monotonically_increasing_id()))
    for end in (left, right):
        rows = rows.join(nodes.select(F.col("id").alias(end), F.col("_no").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return nodes, rows


def _column(table, name: str) -> np.ndarray:  # noqa: ANN001
    return table.column(name).to_numpy()


def _whole(edges: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    """One task over the whole graph, after a check that it is small; an error beyond the bound."""
    edges = _bounded(edges)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if rows:
            yield work(pd.concat(rows))

    return edges.coalesce(1).mapInPandas(run, schema)


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness) over shortest paths of length 1/weight; an error beyond ``MAX_WHOLE_EDGES`` edges.

    Every task has the numbered edges and takes a share of the nodes as roots of paths; what they add is summed up. Paths by way of the
    node of most edges are counted together, so a root costs what it reaches as soon without that node (of each part of the graph).
    """
    from threadloom.operators import kernels

    nodes, rows = _numbered(_bounded(edges).select("src", "dst", F.col("weight").cast("double").alias("weight")), "src", "dst")
    found = rows.toArrow()
    numbers, ends = np.unique(np.concatenate([_column(found, "src"), _column(found, "dst")]), return_inverse=True)
    n, m = len(numbers), found.num_rows
    if not m:
        return nodes.select("id", F.lit(None).cast("double").alias("betweenness"))
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((numbers, kernels.hub_paths(n, ends[:m], ends[m:], _column(found, "weight"))))
    shares = int(min(n, 1 + n * m // ROOTS_TIMES_EDGES, MAX_SHARES))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, graph = shared.value
        for part in parts:
            for share in part["id"]:
                total = kernels.betweenness(graph, np.arange(share, n, shares))
                some = np.flatnonzero(total)
                yield pd.DataFrame({"_no": numbers[some], "_x": total[some]})

    added = spark.range(0, shares, 1, shares).mapInPandas(run, "_no bigint, _x double").groupBy("_no").agg(F.sum("_x").alias("_x"))
    return nodes.join(added, "_no", "left").select("id", F.coalesce("_x", F.lit(0.0)).alias("betweenness"))


def communities(edges: DataFrame) -> DataFrame:
    """(id, community) by greedy modularity; an error beyond ``MAX_WHOLE_EDGES`` edges."""
    return _whole(edges, _communities, "id string, community bigint")


def _seeds(spark, permutations: int, seed: int) -> list[int]:  # noqa: ANN001
    """The hash of (seed, permutation) from which those of the events go on, of the permutations from 1."""
    rows = spark.range(1, permutations + 1).select("id", F.xxhash64(F.lit(seed), F.col("id").cast("int")).alias("h")).collect()
    return [x.h for x in sorted(rows, key=lambda x: x.id)]


def _dyads_on_arrays(rows: DataFrame, seen: DataFrame, sizes: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(sender, receiver, p, _n) of the dyads ``seen`` in the shuffles of all conversations but the huge ones; several rows may belong together."""
    from threadloom.operators import kernels

    pairs = seen.select("sender", "receiver").collect()
    coded = {c: {v: i for i, v in enumerate(sorted({x[c] for x in pairs}), 1)} for c in ("sender", "receiver")}
    code = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in coded[c].items() for x in kv])[F.col(c)], F.lit(0)).cast("short") if pairs else F.lit(0).cast("short")
    width = 1 + max([0, *map(len, coded.values())])
    seeds = _seeds(rows.sparkSession, permutations, seed)
    shares = F.least(F.lit(permutations), F.ceil(F.coalesce("_size", F.lit(1)) / SHARED_FROM).cast("int"))
    narrow = (
        rows.select("conversation_id", F.col("source").cast("long").alias("source"), code("sender").alias("a"), code("receiver").alias("b"))
        .join(F.broadcast(sizes), "conversation_id", "left")
        .where(F.coalesce("_size", F.lit(0)) <= MAX_IN_CONVERSATION)
        .withColumn("shares", shares)
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("conversation_id", "share", "shares", "source", "a", "b")
        .repartition("conversation_id", "share")
        .sortWithinPartitions("conversation_id", "share", "source")
    )

    def shuffle(group: np.ndarray, source: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray, shares: np.ndarray, totals: np.ndarray) -> None:
        n = int(group[-1]) + 1
        both = (np.bincount(group, a > 0, n) > 0) & (np.bincount(group, b > 0, n) > 0)
        for p, s in enumerate(seeds):
            take = both[group] & (p % shares == share) if not p or shares.max() > 1 else take
            if not p or shares.max() > 1:
                g, x, aa, bb = group[take], source[take], a[take], b[take]
                g = g.astype(np.uint16) if n <= 65_536 else g
                asked = np.flatnonzero(aa)
                first = aa[asked].astype(np.int64) * width
            if len(asked):
                order = kernels.shuffled(x, s, g)
                totals[p] += np.bincount(first + bb[order[asked]], minlength=width * width)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        totals = np.zeros((permutations, width * width), np.int64)
        held, most = [], AT_ONCE

        def work(last: bool) -> None:
            nonlocal held, most
            table = pa.Table.from_batches(held).combine_chunks()
            names = table.column("conversation_id").combine_chunks()
            names = names.dictionary_encode().indices.to_numpy()
            share = _column(table, "share")
            begins = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (share[1:] != share[:-1])])
            end = table.num_rows if last else int(begins[-1])
            if end:
                group = np.zeros(end, np.int64)
                group[begins[begins < end][1:]] = 1
                shuffle(np.cumsum(group), *(_column(table, c)[:end] for c in ("source", "a", "b", "share", "shares")), totals)
            held = table.slice(end).to_batches()
            most = max(AT_ONCE, 2 * (table.num_rows - end))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= most:
                    work(False)
        if held:
            work(True)
        p, ab = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array((p + 1).astype(np.int32)), pa.array((ab // width).astype(np.int32)), pa.array((ab % width).astype(np.int32)), pa.array(totals[p, ab])], ["p", "a", "b", "_n"])

    found = narrow.mapInArrow(run, "p int, a int, b int, _n bigint").groupBy("p", "a", "b").agg(F.sum("_n").alias("_n"))
    keys = seen.select("sender", "receiver", code("sender").cast("int").alias("a"), code("receiver").cast("int").alias("b"))
    return found.join(F.broadcast(keys), ["a", "b"]).select("sender", "receiver", "p", "_n")


def _dyads_by_joins(rows: DataFrame, seen: DataFrame, permutations: int, seed: int) -> DataFrame:
    """As ``_dyads_on_arrays``, with the permutation as a column; places are running counts over parts of the hash."""
    from threadloom.operators.running import running_sum

    one = F.lit(1).cast("long")
    placed = cut(running_sum(rows, ["conversation_id"], F.floor(F.col("source") / 1000), ["source"], one, "_i"))
    shuffles = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p")
    fixed = placed.select("conversation_id", "sender", "_i", shuffles)
    each = placed.select("conversation_id", "source", "receiver", shuffles).withColumn("_h", F.xxhash64(F.lit(seed), "p", "source"))
    mixed = running_sum(each, ["conversation_id", "p"], F.shiftright("_h", 56), ["_h", "source"], one, "_i").select("conversation_id", "p", "receiver", "_i")
    return (
        fixed.join(mixed, ["conversation_id", "p", "_i"])
        .join(F.broadcast(seen.select("sender", "receiver")), ["sender", "receiver"])
        .groupBy("sender", "receiver", "p")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def dyad_null(events: DataFrame, permutations: int = 200, seed: int = 42, top: int = 50) -> DataFrame:
    """(sender, receiver, observed, expected, sd, z, p) of the ``top`` most frequent dyads.

    Receivers are shuffled within their conversation ``permutations`` times, all dyads sharing the shuffles.
    A shuffle orders the receivers of a conversation by a hash of (permutation, event); p counts shuffles at
    least as far from their mean, (extreme + 1)/(permutations + 1). Each conversation meets one task, which makes all shuffles on
    arrays and keeps counts only; from ``SHARED_FROM`` replies on several tasks share its permutations, and one of more
    than ``MAX_IN_CONVERSATION`` replies is shuffled by joins, without being ordered by one task.
    """
    rows = cut(
        events.where(F.col("source_sender").isNotNull() & F.col("target_sender").isNotNull()).select(
            "conversation_id", "source", F.col("source_sender").alias("sender"), F.col("target_sender").alias("receiver")
        )
    )
    seen = cut(rows.groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("observed")).orderBy(F.desc("observed"), "sender", "receiver").limit(top))
    sizes = cut(rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > min(SHARED_FROM, MAX_IN_CONVERSATION)))
    counts = _dyads_on_arrays(rows, seen, sizes, permutations, seed)
    huge = sizes.where(F.col("_size") > MAX_IN_CONVERSATION).select("conversation_id")
    if not huge.isEmpty():
        counts = counts.unionByName(_dyads_by_joins(rows.join(F.broadcast(huge), "conversation_id", "left_semi"), seen, permutations, seed))
    counts = counts.groupBy("sender", "receiver", "p").agg(F.sum("_n").alias("_n"))
    stats = counts.groupBy("sender", "receiver").agg(
        F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"), F.collect_list("_n").alias("_all")
    )
    mean = F.coalesce("_s", F.lit(0)) / permutations
    sd = F.sqrt(F.greatest((F.coalesce("_q", F.lit(0)) - permutations * F.col("expected") * F.col("expected")) / (permutations - 1), F.lit(0.0)))
    every = F.coalesce("_all", F.array().cast("array<bigint>"))
    far = F.abs(F.col("observed") - F.col("expected"))
    extreme = F.size(F.filter(every, lambda x: F.abs(x - F.col("expected")) >= far)) + F.when(F.col("expected") >= far, permutations - F.size(every)).otherwise(0)
    return (
        seen.join(stats, ["sender", "receiver"], "left")
        .withColumn("expected", mean)
        .withColumn("sd", sd)
        .select("sender", "receiver", "observed", "expected", "sd", F.when(F.col("sd") > 0, (F.col("observed") - F.col("expected")) / F.col("sd")).alias("z"), ((extreme + 1) / (permutations + 1)).alias("p"))
    )


def excitation(messages: DataFrame, top: int = 10, beta_hours: float = 24.0, cutoff_hours: int = 120) -> DataFrame:
    """(source, target, pairs, excess): time-decayed influence between the ``top`` senders.

    For each ordered pair: Σ exp(−hours/beta) over messages of the target within the cutoff after one of the
    source in the same conversation, less what its rate alone would give, per message of the source. Both
    sides meet on (conversation, window of the cutoff), so no message is joined with a whole conversation.
    """
    busy = messages.where(F.col("sender").isNotNull()).groupBy("sender").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "sender").limit(top)
    width = cutoff_hours * 3_600_000_000
    rows = messages.where(F.col("sent_at").isNotNull()).join(F.broadcast(busy), "sender").select("conversation_id", "sender", F.unix_micros("sent_at").alias("us"), "_n")
    left = rows.withColumn("_w", F.explode(F.array(F.floor(F.col("us") / width), F.floor(F.col("us") / width) + 1)))
    right = rows.select("conversation_id", F.col("sender").alias("target"), F.col("us").alias("_t"), F.floor(F.col("us") / width).alias("_w"))
    hours = (F.col("_t") - F.col("us")) / 3_600_000_000
    pairs = (
        left.join(right, ["conversation_id", "_w"])
        .where((F.col("_t") > F.col("us")) & (F.col("_t") - F.col("us") <= width))
        .groupBy(F.col("sender").alias("source"), "target")
        .agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.exp(-hours / beta_hours)).alias("_sum"), F.max("_n").alias("_n"))
    )
    span = rows.groupBy("sender").agg(((F.max("us") - F.min("us")) / 3_600_000_000).alias("_hours"), F.max("_n").alias("_m"))
    rate = F.when(F.col("_hours") > 0, F.col("_m") / F.col("_hours")).otherwise(0.0) * beta_hours
    return pairs.join(F.broadcast(span.withColumnRenamed("sender", "target")), "target").select(
        "source", "target", "pairs", F.greatest(F.col("_sum") / F.col("_n") - rate, F.lit(0.0)).alias("excess")
    )


def _motifs_on_arrays(rows: DataFrame, permutations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(motif, observed) and (motif, _s, _q): counts of the graph, and their sums and squares over the shuffles."""
    from threadloom.operators import kernels

    spark = rows.sparkSession
    _, numbered = _numbered(rows.withColumn("source", F.col("source").cast("long")), "src", "dst")
    found = numbered.toArrow()
    by = np.argsort(_column(found, "source"), kind="stable")
    names, ends = np.unique(np.concatenate([_column(found, "src")[by], _column(found, "dst")[by]]), return_inverse=True)
    n, m = max(1, len(names)), len(by)
    shared = spark.sparkContext.broadcast((_column(found, "source")[by], ends[:m].astype(np.int32), ends[m:].astype(np.int32)))
    seeds = _seeds(spark, permutations, seed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, src, dst = shared.value
        for part in parts:
            for p in part["id"]:
                counts = kernels.motifs(src, dst[kernels.shuffled(source, seeds[p - 1])] if p else dst, n)
                yield pd.DataFrame({"p": p, "motif": ["reciprocal_dyads", "transitive_triples"], "_n": counts})

    each = cut(spark.range(0, permutations + 1, 1, permutations + 1).mapInPandas(run, "p bigint, motif string, _n bigint"))
    sums = each.where("p > 0").groupBy("motif").agg(F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    return each.where("p = 0").select("motif", F.col("_n").alias("observed")), sums


def _motifs_by_joins(rows: DataFrame, permutations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """As ``_motifs_on_arrays``, with the permutation as a column."""
    from threadloom.operators.running import running_sum

    part = F.floor(F.col("source") / 100_000)
    fixed = cut(running_sum(rows, [], part, ["source"], F.lit(1).cast("long"), "_i"))
    each = fixed.select("source", "dst").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_h", F.xxhash64(F.lit(seed), "p", "source"))
    mixed = running_sum(each, ["p"], F.shiftright("_h", 52), ["_h", "source"], F.lit(1).cast("long"), "_i").select("p", "_i", "dst")
    shuffled = cut(mixed.join(fixed.select("_i", "src"), "_i").where(F.col("src") != F.col("dst")).select("p", "src", "dst").distinct())
    back = shuffled.select("p", F.col("dst").alias("src"), F.col("src").alias("dst"))
    dyads = shuffled.join(back, ["p", "src", "dst"], "left_semi").where(F.col("src") < F.col("dst")).groupBy("p").agg(F.count(F.lit(1)).alias("_n")).withColumn("motif", F.lit("reciprocal_dyads"))
    triples = _transitive_triples(shuffled, ["p"]).withColumn("motif", F.lit("transitive_triples"))
    sums = dyads.unionByName(triples).groupBy("motif").agg(F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    seen = motif_counts(fixed).unpivot([], ["reciprocal_dyads", "transitive_triples"], "motif", "observed")
    return seen, sums


def motif_null(events: DataFrame, permutations: int = 100, seed: int = 42) -> DataFrame:
    """(motif, observed, expected, sd, z): motif counts against shuffles of who is replied to.

    Replies keep their sender and get another reply's receiver; deviations have the divisor n. Each shuffle
    orders the receivers by a hash. Up to ``MAX_IN_ALL`` replies every task has them all as arrays and makes whole shuffles;
    beyond, joins make the same ones, numbered by running counts over parts of the hash. Self-replies are no edges, as in
    the observed graph.
    """
    rows = cut(events.where(F.col("source_sender").isNotNull() & F.col("target_sender").isNotNull()).select("source", F.col("source_sender").alias("src"), F.col("target_sender").alias("dst")))
    seen, sums = (_motifs_on_arrays if rows.count() <= MAX_IN_ALL else _motifs_by_joins)(rows, permutations, seed)
    mean = F.coalesce("_s", F.lit(0)) / permutations
    return (
        seen.join(sums, "motif", "left")
        .withColumn("expected", mean)
        .withColumn("sd", F.sqrt(F.greatest(F.coalesce("_q", F.lit(0)) / permutations - F.col("expected") * F.col("expected"), F.lit(0.0))))
        .select("motif", "observed", "expected", "sd", F.when(F.col("sd") > 0, (F.col("observed") - F.col("expected")) / F.col("sd")).alias("z"))
    )
