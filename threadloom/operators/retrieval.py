"""Lexical retrieval, document frequencies and co-occurrence of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T


def term_frequencies(rows: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """(key, term, tf): how often each term occurs in each text."""
    return (
        rows.where(F.col(text).isNotNull())
        .select(key, F.explode(T.tokens(F.col(text), least)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(rows: DataFrame, text: str, least_chars: int = 4) -> DataFrame:
    """(term, df): the number of texts that hold a term of ``least_chars`` characters."""
    return (
        rows.where(F.col(text).isNotNull())
        .select(F.explode(F.array_distinct(T.tokens(F.col(text), least_chars))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def cooccurrence(rows: DataFrame, text: str, vocabulary: DataFrame, per_text: int = 15, least: int = 3) -> DataFrame:
    """(a, b, n): pairs of vocabulary terms that occur together in ``least`` texts.

    Of each text the first ``per_text`` vocabulary terms in alphabetical order pair up, so a text of any
    length gives at most 105 pairs. ``vocabulary`` is a top list of terms and small by construction.
    """
    words = vocabulary.agg(F.collect_set("term").alias("_v"))
    own = F.slice(F.array_sort(F.array_intersect(T.tokens(F.col(text), 4), F.col("_v"))), 1, per_text)
    found = rows.where(F.col(text).isNotNull()).crossJoin(F.broadcast(words)).select(own.alias("_t")).where(F.size("_t") > 1)
    left = found.select("_t", F.posexplode("_t").alias("_i", "a"))
    pairs = left.select("a", F.explode(F.expr("slice(_t, _i + 2, size(_t))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def search(rows: DataFrame, queries: DataFrame, key: str, text: str, at: str, top: int = 20) -> DataFrame:
    """(query_id, key, score, rank): texts by Σ (1 + ln tf)·ln(1 + N/(1 + df)), plus 3 for the whole phrase.

    ``queries`` hold query_id and query and are few. N and df are taken over all texts. Ties go to the
    earlier text, then the smaller key. All texts are scored; only the ranking cuts.
    """
    total = rows.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("_N"))
    asked = queries.select("query_id", F.lower("query").alias("_phrase"), F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    tf = term_frequencies(rows, key, text).join(F.broadcast(asked.select("term").distinct()), "term")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("_N") / (1 + F.col("_df")))
    scored = (
        tf.join(F.broadcast(df), "term")
        .join(F.broadcast(asked), "term")
        .crossJoin(F.broadcast(total))
        .groupBy("query_id", key)
        .agg(F.sum(weight).alias("_s"), F.first("_phrase").alias("_phrase"))
    )
    full = scored.join(rows.select(key, F.lower(text).alias("_low"), at), key).withColumn(
        "score", F.round(F.col("_s") + F.when(F.col("_low").contains(F.col("_phrase")), 3.0).otherwise(0.0), 9)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last(at), key)
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", key, "score", "rank")
