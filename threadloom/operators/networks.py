"""Networks in layers: who writes alike, communities of every layer and month, themes of terms, and how far activity excites itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import kernels
from threadloom.operators.graph import communities
from threadloom.operators.retrieval import term_frequencies
from threadloom.session import stage

#: Weights of vectors that a Python worker may hold, terms that are broadcast, and senders whose similarities one task makes.
MAX_WEIGHTS, MAX_TERMS, WRITERS_AT_ONCE = 20_000_000, 500_000, 400


def _writer_terms(messages: DataFrame, least_df: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, term, tf) of each sender; (term, df) of the terms that ``least_df`` senders use; one row, n: the number of senders with a text."""
    rows = messages.where("sender IS NOT NULL AND text IS NOT NULL").select(F.col("sender").alias("id"), "text")
    tf = stage(term_frequencies(rows, "id", "text", 2))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    return tf, df, rows.agg(F.countDistinct("id").alias("n"))


def _weight(n: int) -> Column:
    return F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def writer_vectors(messages: DataFrame, least_df: int = 2) -> DataFrame:
    """(id, term, df, w): the unit TF-IDF vector of all words of each sender, of terms that ``least_df`` senders use."""
    tf, df, senders = _writer_terms(messages, least_df)
    weighted = tf.join(df, "term").withColumn("w", _weight(senders.first()["n"]))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return stage(weighted.join(norm, "id").select("id", "term", "df", (F.col("w") / F.col("_norm")).alias("w")))


def similar_writer_communities(messages: DataFrame, at_least: float = 0.25, rounds: int = 8) -> DataFrame:
    """(id, community) as ``label_communities`` gives it for the edges of ``similar_writers``, without making these.

    Such edges are a good part of all pairs of senders, so they are never rows: each round multiplies blocks of the vectors of the
    senders that move with all others and keeps labels only, until two rounds move none. Up to ``MAX_WEIGHTS`` weights,
    which one task splits and leaves in the shared folder, for all to map into memory; beyond, from the rows of edges.
    """
    spark = messages.sparkSession
    tf, df, senders = _writer_terms(messages, 2)
    df = stage(df)
    size = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("terms")).first()
    if size["n"] > MAX_WEIGHTS:
        edges = similar_writers(messages, at_least).select(F.lit(0).alias("_g"), F.col("left").alias("src"), F.col("right").alias("dst"), F.col("similarity").alias("weight"))
        return label_communities(edges, ["_g"], rounds).drop("_g")
    ids = tf.select("id").distinct().select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")).toPandas().sort_values("id", key=lambda x: x.map(lambda v: v.encode()), ignore_index=True)
    n, terms = len(ids), size["terms"]
    if not terms:
        return tf.limit(0).select("id", F.col("id").alias("community"))
    numbers = F.broadcast(spark.createDataFrame(pd.DataFrame({"id": ids["id"], "_i": np.arange(n, dtype=np.int32)}), "id string, _i int"))
    known = df.withColumn("_t", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)
    known = F.broadcast(known) if terms <= MAX_TERMS else known
    vectors = stage(tf.join(known, "term").join(numbers, "id").select("_i", "_t", _weight(senders.first()["n"]).alias("w")))
    folder = vectors.inputFiles()[0].rpartition("/")[0]

    def store(parts):  # noqa: ANN001, ANN202
        for part in parts:
            kernels.store_vectors(folder, n, terms)
            yield part

    if folder.startswith("file:"):
        spark.range(0, 1, 1, 1).mapInPandas(store, "id bigint").collect()
    labels, half = np.arange(n), ids["half"].to_numpy()
    linked, still = np.zeros(n, bool), 0
    for turn in range(rounds):
        own = np.flatnonzero(half == turn % 2)
        given = spark.sparkContext.broadcast(labels)

        def run(parts):  # noqa: ANN001, ANN202
            for part in parts:
                for block in part["id"]:
                    rows = own[block * WRITERS_AT_ONCE : (block + 1) * WRITERS_AT_ONCE]
                    best, any_ = kernels.best_labels(kernels.stored_vectors(folder, n, terms), rows, given.value, at_least)
                    yield pd.DataFrame({"i": rows, "best": best, "linked": any_})

        blocks = -(-len(own) // WRITERS_AT_ONCE)
        if blocks:
            got = spark.range(0, blocks, 1, blocks).mapInPandas(run, "i bigint, best bigint, linked boolean").toPandas()
            fresh = labels.copy()
            fresh[got["i"]] = np.where(got["linked"], got["best"], labels[got["i"]])
            linked[got["i"]] = got["linked"]
            still = still + 1 if (fresh == labels).all() else 0
            labels = fresh
        else:
            still += 1
        if still == 2:
            break
    names = ids["id"].to_numpy()
    out = pd.DataFrame({"id": names[linked], "community": names[labels[linked]]})
    return spark.createDataFrame(out, "id string, community string")


def similar_writers(messages: DataFrame, at_least: float = 0.25, least_df: int = 2) -> DataFrame:
    """(left, right, similarity): senders whose TF-IDF vectors of all their words have a cosine of ``at_least``; left < right.

    Terms count that ``least_df`` senders use; weights are tf · (ln((1+n)/(1+df)) + 1). Unit vectors with such a cosine share a term
    among the rarest of one of them, those before which the rest of the vector is shorter than ``at_least``: only these
    are matched with all terms of the others, so the words that everybody uses make no pairs.
    """
    unit = writer_vectors(messages, least_df)
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = unit.withColumn("_rest", rest).where(F.col("_rest") >= at_least * at_least - 1e-9).select(F.col("id").alias("a"), "term")
    pairs = rare.join(unit.select(F.col("id").alias("b"), "term"), "term").where("a <> b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()
    own = unit.select(F.col("id").alias("left"), "term", F.col("w").alias("_x"))
    other = unit.select(F.col("id").alias("right"), "term", F.col("w").alias("_y"))
    dots = pairs.join(own, "left").join(other, ["right", "term"]).groupBy("left", "right").agg(F.sum(F.col("_x") * F.col("_y")).alias("similarity"))
    return dots.where(F.col("similarity") >= at_least)


def label_communities(edges: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """(keys, id, community) of every graph at once, by label propagation over undirected weights of ``src``, ``dst``, ``weight``.

    In each round a node takes the label of most weight around it, its own on ties and then the smallest; nodes of one half
    move in even, the others in odd rounds, by a hash, so that labels settle. A round is one join and one aggregate.
    """
    plain = edges.where("src <> dst").select(*keys, "src", "dst", F.col("weight").cast("double").alias("w"))
    both = stage(plain.unionByName(plain.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w")))
    labels = both.select(*keys, F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for turn in range(rounds):
        near = both.join(labels.withColumnsRenamed({"id": "dst"}), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id"), "community").agg(F.sum("w").alias("_w"))
        near = near.join(labels.withColumnRenamed("community", "_own"), [*keys, "id"])
        best = near.groupBy(*keys, "id").agg(F.min_by("community", F.struct((-F.round("_w", 9)).alias("w"), (F.col("community") != F.col("_own")).alias("o"), "community")).alias("_best"), F.first("_own").alias("_own"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2
        labels = stage(best.select(*keys, "id", F.when(moves, F.col("_best")).otherwise(F.col("_own")).alias("community")))
    return labels


def term_themes(cooccurring: DataFrame, vocabulary: DataFrame, top: int = 10) -> DataFrame:
    """(theme, size, documents, terms): communities of at least two terms over their co-occurrences, the ``top`` of most documents."""
    groups = communities(cooccurring.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight")))
    each = groups.join(vocabulary.select(F.col("term").alias("id"), "df"), "id").groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.sum("df").alias("documents"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("d"), "id"))), lambda x: x["id"]).alias("terms")
    )
    order = Window.orderBy(F.desc("documents"), F.col("terms")[0])
    return each.where("size >= 2").orderBy(F.desc("documents"), F.col("terms")[0]).limit(top).select(F.row_number().over(order).alias("theme"), "size", "documents", "terms")


def excitation_radius(pairs: DataFrame, messages: DataFrame, least: int = 20) -> DataFrame:
    """(n_events, spectral_radius, stability_warning) of the matrix of excitation, of at most ten senders; no row below ``least`` events."""

    def radius(parts):  # noqa: ANN001, ANN202
        import numpy as np

        rows = pd.concat(list(parts))
        names = sorted(set(rows["source"].dropna()) | set(rows["target"].dropna()))
        at = {v: i for i, v in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        for s, t, x in rows[["source", "target", "excess"]].dropna().itertuples(index=False):
            matrix[at[t], at[s]] = x
        size = float(max(abs(np.linalg.eigvals(matrix)))) if len(names) else 0.0
        yield pd.DataFrame({"n_events": [int(rows["n_events"].iloc[0])], "spectral_radius": [size], "stability_warning": [size >= 1]})

    count = messages.where("sender IS NOT NULL AND text <> ''").agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= least)
    rows = count.join(pairs.select("source", "target", "excess"), F.lit(True), "left")
    return rows.coalesce(1).mapInPandas(radius, "n_events bigint, spectral_radius double, stability_warning boolean") if not count.isEmpty() else count.select(
        "n_events", F.lit(None).cast("double").alias("spectral_radius"), F.lit(None).cast("boolean").alias("stability_warning")
    )


def linked_messages(*edge_lists: DataFrame) -> DataFrame:
    """(row_id): the ends of all edges of several lists of (source, target), each once."""
    out = None
    for edges in edge_lists:
        ends = edges.select(F.explode(F.array("source", "target")).alias("row_id"))
        out = ends if out is None else out.unionByName(ends)
    return out.distinct()
