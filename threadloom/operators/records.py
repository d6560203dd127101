"""Records about the corpus and its labels: pseudonyms, identities, progress, frozen sets, codebooks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.snapshots import digest_tree

from threadloom.operators.running import hour_of, running_sum


def pseudonyms(messages: DataFrame) -> DataFrame:
    """(sender, number): senders numbered from 1 by first appearance, then by id."""
    first = messages.where(F.col("sender").isNotNull()).groupBy("sender").agg(F.min("sent_at").alias("_at"))
    return running_sum(first, [], hour_of("_at"), ["_at", "sender"], F.lit(1).cast("long"), "number").select("sender", "number")


def identity_profile(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(sender, n_messages, n_conversations, first_at, last_at, n_names): what is known of each sender."""
    seen = messages.where(F.col("sender").isNotNull()).groupBy("sender").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct("conversation_id").alias("n_conversations"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at")
    )
    names = people.groupBy(F.col("person").alias("sender")).agg(F.count_distinct("name").alias("n_names"))
    return seen.join(names, "sender", "left").withColumn("n_names", F.coalesce("n_names", F.lit(0)))


def progress(judgments: DataFrame) -> DataFrame:
    """(annotation_set_id, task, slot, n, n_done, n_present, share_done): judgments by slot; NOT_ANNOTATED is open."""
    done = F.coalesce(F.col("status") != "NOT_ANNOTATED", F.lit(False))
    return judgments.groupBy("annotation_set_id", "task", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_done"), F.count_if(F.col("status") == "PRESENT").alias("n_present"), (F.count_if(done) / F.count(F.lit(1))).alias("share_done")
    )


def unit_status(judgments: DataFrame) -> DataFrame:
    """(unit_id, status): reviewed when all its judgments are done, annotated when some are, else pending."""
    done = F.coalesce(F.col("status") != "NOT_ANNOTATED", F.lit(False))
    each = judgments.where(F.col("unit_id").isNotNull()).groupBy("unit_id").agg(F.bool_and(done).alias("_all"), F.bool_or(done).alias("_some"))
    return each.select("unit_id", F.when(F.col("_all"), "reviewed").when(F.col("_some"), "annotated").otherwise("pending").alias("status"))


def frozen_manifest(judgments: DataFrame) -> DataFrame:
    """(annotation_set_id, n, manifest): a SHA-256 over each set's judgments, the same in any order of rows."""
    cells = ["judgment_id", "unit_id", "task", "slot", "status", "annotator", "label"]
    key = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in cells])
    return digest_tree(judgments, ["annotation_set_id"], key)


def lineage_edges(annotations: DataFrame) -> DataFrame:
    """(source_id, target_id, relation): one edge per annotation and item of its evidence, without repeats.

    ``annotations`` hold annotation_id and evidence, an array of structs with object_id.
    """
    rows = annotations.select(F.col("annotation_id").alias("target_id"), F.explode("evidence").alias("_e"))
    return rows.select(F.col("_e.object_id").alias("source_id"), "target_id", F.lit("DERIVED_FROM").alias("relation")).where(F.col("source_id").isNotNull()).dropDuplicates()


def codebook_hash(codebook: Mapping[str, Any]) -> str:
    """The same for codebooks of the same content, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(codebook, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def codebook_difference(spark: SparkSession, old: Mapping[str, Any], new: Mapping[str, Any]) -> DataFrame:
    """(path, change, old_value, new_value): added, removed and changed leaves of two codebooks."""

    def leaves(value: Any, path: str = "") -> dict[str, str]:
        if isinstance(value, Mapping):
            return {k: v for key, part in value.items() for k, v in leaves(part, f"{path}/{key}").items()}
        return {path: json.dumps(value, sort_keys=True, ensure_ascii=False)}

    schema = "path string, value string"
    a = spark.createDataFrame(sorted(leaves(old).items()), schema).withColumnRenamed("value", "old_value")
    b = spark.createDataFrame(sorted(leaves(new).items()), schema).withColumnRenamed("value", "new_value")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("path", change.alias("change"), "old_value", "new_value")


def corpus_profile(rows: DataFrame) -> DataFrame:
    """(measure, value): sizes and gaps of the stored message rows, in one pass and one distinct count each."""
    out = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("conversation_id").alias("conversations"),
        F.count_distinct("sender_external_id").alias("senders"),
        F.count_distinct("conversation_id", "external_id").alias("messages"),
        F.count_if(F.col("text").isNull()).alias("null_texts"),
        F.count_if(F.col("text") == "").alias("empty_texts"),
        F.count_if(F.col("reply_to_external_id") != "").alias("reply_marks"),
        F.count_if(F.col("resolution_confidence") < 0.5).alias("uncertain_times"),
    )
    return out.unpivot([], out.columns, "measure", "value")


def last_reviews(reviews: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each ``key`` by ``at`` and then ``tie``, with all columns."""
    newest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return reviews.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")
