"""Queries of the text and vector problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.consensus import agreement, consensus, reliability
from threadloom.llm.conversations import conversations
from threadloom.llm.mojibake import repair_texts
from threadloom.llm.neighbours import similar_vectors
from threadloom.llm.packing import pack
from threadloom.llm.pii import find_items, redact
from threadloom.llm.tokenizer import count_tokens, encode_texts, round_trips
from threadloom.session import cut
from threadloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "message_features")).select(
        F.col("a").alias("feature_id_a"), F.col("b").alias("feature_id_b")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        consensus(table(spark, sf_dir, "gold_task_judgments")).where(F.col("n_annotators") >= 3).select("unit_id", "task", "label")
    )


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "gold_task_judgments"))


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability(table(spark, sf_dir, "gold_task_judgments"))


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each set and task beside the share of double annotation that the set asks for."""
    asked = table(spark, sf_dir, "annotation_sets").select("annotation_set_id", "double_annotation_fraction")
    return agreement(table(spark, sf_dir, "gold_task_judgments")).join(asked, "annotation_set_id", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        find_items(table(spark, sf_dir, name), key, "text").withColumn("source_table", F.lit(name))
        for name, key in (("messages", "row_id"), ("evidence_items", "evidence_id"))
    ]
    return parts[0].unionByName(parts[1]).select("source_table", "row_key", "pii_type", "start_codepoint")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_key, redacted, n_items): every text with placeholders for its personal items."""
    parts = [
        redact(table(spark, sf_dir, name), key, "text").withColumnRenamed(key, "row_key").withColumn("source_table", F.lit(name))
        for name, key in (("messages", "row_id"), ("evidence_items", "evidence_id"))
    ]
    return parts[0].unionByName(parts[1]).select("source_table", "row_key", "redacted", "n_items")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "messages")).drop("sender")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, same): every document encoded, decoded and compared with its text."""
    return round_trips(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    budgets = table(spark, sf_dir, "token_budgets").where(F.col("max_input_tokens") > 0)
    capacities = [r[0] for r in budgets.select("max_input_tokens").distinct().limit(1001).collect()]
    sizes = cut(count_tokens(table(spark, sf_dir, "documents")))
    return pack(sizes, capacities), budgets


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, budgets = _packed(spark, sf_dir)
    return packed.join(
        F.broadcast(budgets.select("budget_id", F.col("max_input_tokens").cast("long").alias("capacity"))), "capacity"
    ).select("budget_id", "container", "doc_id", "piece_no", "start_token", "piece_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers used, the least number that the tokens need, and the share of room used."""
    packed, budgets = _packed(spark, sf_dir)
    each = packed.where(F.col("container").isNotNull()).groupBy("capacity", "container").agg(
        F.sum("piece_tokens").alias("_used")
    )
    return (
        each.groupBy("capacity")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("_used").alias("n_tokens"), F.max("_used").alias("fullest"))
        .join(F.broadcast(budgets.select("budget_id", F.col("max_input_tokens").cast("long").alias("capacity"))), "capacity")
        .select(
            "budget_id",
            "n_containers",
            F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
            "n_tokens",
            "fullest",
            (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("share_used"),
        )
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(table(spark, sf_dir, "documents")).where("garbled").select("doc_id")


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, layers, repaired): the text of every garbled document with what can be restored."""
    return repair_texts(table(spark, sf_dir, "documents")).where("garbled").select("doc_id", "layers", "repaired")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_consensus": p3_consensus,
    "p3_reliability": p3_reliability,
    "p3_agreement": p3_agreement,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}

SQL: dict[str, str] = {
    "p3_agreement": """
WITH r AS (
  SELECT annotation_set_id, unit_id, task, annotator, upper(trim(label, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203))) AS label
  FROM gold_task_judgments
  WHERE status = 'PRESENT' AND annotator IS NOT NULL AND unit_id IS NOT NULL AND task IS NOT NULL
    AND trim(label, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203)) <> ''
  QUALIFY row_number() OVER (PARTITION BY unit_id, task, annotator ORDER BY submitted_at DESC NULLS LAST, judgment_id DESC) = 1
),
cells AS (SELECT annotation_set_id, task, unit_id, label, count(*) AS n FROM r GROUP BY ALL),
units AS (
  SELECT annotation_set_id, task, unit_id, sum(n) AS m, sum(n * (n - 1)) AS same FROM cells GROUP BY annotation_set_id, task, unit_id
  HAVING sum(n) > 1
),
labels AS (
  SELECT annotation_set_id, task, label, sum(n) AS n FROM cells SEMI JOIN units USING (annotation_set_id, task, unit_id)
  GROUP BY annotation_set_id, task, label
),
e AS (SELECT annotation_set_id, task, sum(n * (n - 1)) AS chance, sum(n) AS n_labels FROM labels GROUP BY annotation_set_id, task),
o AS (SELECT annotation_set_id, task, count(*) AS n_units, sum(same / (m - 1)) AS agree FROM units GROUP BY annotation_set_id, task)
SELECT o.annotation_set_id, o.task, o.n_units::BIGINT AS n_units, e.n_labels::BIGINT AS n_labels, (agree / n_labels)::DOUBLE AS observed,
       CASE WHEN chance / (n_labels * (n_labels - 1)) < 1
            THEN 1 - (1 - agree / n_labels) / (1 - chance / (n_labels * (n_labels - 1))) END::DOUBLE AS alpha,
       s.double_annotation_fraction
FROM o JOIN e USING (annotation_set_id, task) LEFT JOIN annotation_sets s ON s.annotation_set_id = o.annotation_set_id""",
    "p6_found": """
WITH RECURSIVE latest AS (
  SELECT *, CASE WHEN message_type = 'message' AND text IS NOT NULL
                  AND regexp_matches(text, '[^ \\t\\r\\n\\x{00A0}\\x{200B}]') THEN 1 ELSE 0 END AS turn
  FROM messages
  QUALIFY row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY imported_at DESC, row_id DESC) = 1
),
nodes AS (
  SELECT c.row_id, c.conversation_id, p.row_id AS parent, coalesce(c.reply_to_external_id, '') <> '' AND p.row_id IS NULL AS loose
  FROM latest c LEFT JOIN latest p
    ON p.conversation_id = c.conversation_id AND p.external_id = c.reply_to_external_id AND c.reply_to_external_id <> ''
),
tree AS (
  SELECT row_id FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.row_id FROM nodes n JOIN tree t ON n.parent = t.row_id
),
broken AS (
  SELECT conversation_id FROM nodes WHERE loose
  UNION SELECT conversation_id FROM nodes WHERE row_id NOT IN (SELECT row_id FROM tree)
),
kept AS (
  SELECT conversation_id FROM latest WHERE turn = 1 AND conversation_id NOT IN (SELECT conversation_id FROM broken)
  GROUP BY conversation_id HAVING count(DISTINCT sender_external_id) >= 2
),
turns AS (
  SELECT conversation_id, message_id, sender_external_id AS sender,
         row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, external_id::HUGEINT, external_id) AS turn_no
  FROM latest WHERE turn = 1 AND conversation_id IN (SELECT conversation_id FROM kept)
),
speakers AS (
  SELECT conversation_id, sender, row_number() OVER (PARTITION BY conversation_id ORDER BY min(turn_no)) AS speaker_no
  FROM turns WHERE sender IS NOT NULL GROUP BY conversation_id, sender
)
SELECT t.conversation_id, t.turn_no::BIGINT AS turn_no, t.message_id, coalesce(s.speaker_no, 0)::BIGINT AS speaker_no
FROM turns t LEFT JOIN speakers s ON s.conversation_id = t.conversation_id AND s.sender = t.sender""",
}
