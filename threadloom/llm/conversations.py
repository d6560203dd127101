"""Ordered conversations with numbered speakers out of an event log of message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import resolve_hierarchy
from threadloom.operators.messages import latest_messages, non_blank
from threadloom.session import stage

#: Turns are numbered inside slices of this length, which are then strung together.
SLICE_US = 3600 * 1_000_000


def fold_events(rows: DataFrame) -> DataFrame:
    """One row per message out of created, edited, emptied and repeated rows.

    (row_id, message_id, conversation_id, external_id, sender, sent_us, reply, turn): the values of the
    row with the latest ``imported_at``; ``turn`` tells whether it is a message with text to read.
    Texts stay where they are read: only the verdict on them is shuffled.
    """
    slim = rows.select(
        "row_id",
        "message_id",
        "conversation_id",
        "external_id",
        "imported_at",
        F.col("sender_external_id").alias("sender"),
        F.unix_micros("sent_at").alias("sent_us"),
        F.nullif(F.col("reply_to_external_id"), F.lit("")).alias("reply"),
        (F.coalesce(F.col("message_type") == "message", F.lit(False)) & non_blank(F.col("text"))).alias("turn"),
    )
    return latest_messages(slim, ["message_id", "sender", "sent_us", "reply", "turn"])


def conversations(rows: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, message_id, speaker_no, sender): the turns of every sound conversation.

    ``rows`` are message rows in any number of versions. A turn is a message of type message whose latest
    text has a character besides space, tab, line break, U+00A0 and U+200B. A conversation is dropped when
    it has no turns, when a non-empty reply link of any of its messages names no message of it or reply
    links run in a circle, or when its turns have fewer than two different non-null senders. Turns count
    from 1 by time, then by ``external_id`` as a number, then as text; null times come first, ids that are
    no number before numbers. Speakers count from 1 by first turn, a null sender is 0. Messages with a null
    conversation belong to none. Other columns are ignored; an empty table gives an empty table.

    Numbering is done inside slices of an hour and the slices are strung together by their counts, so a
    conversation with a third of all rows is ordered by many tasks.
    """
    folded = fold_events(rows).where(F.col("conversation_id").isNotNull())
    nodes = folded.where(F.col("external_id").isNotNull()).select(
        F.col("conversation_id").alias("_c"), F.col("external_id").alias("_e"), F.col("row_id").alias("parent")
    )
    linked = folded.join(
        nodes, (F.col("conversation_id") == F.col("_c")) & (F.col("reply") == F.col("_e")), "left"
    ).select(
        "row_id", "message_id", "conversation_id", "external_id", "sender", "sent_us", "turn", "parent",
        (F.col("reply").isNotNull() & F.col("parent").isNull()).alias("loose"),
    )
    linked = stage(linked)
    speaking = F.when(F.col("turn"), F.col("sender"))
    sound = (
        linked.groupBy("conversation_id")
        .agg(F.max("loose").alias("_loose"), F.min(speaking).alias("_first"), F.max(speaking).alias("_last"))
        .where(~F.col("_loose") & (F.col("_first") != F.col("_last")))
        .select("conversation_id")
    )
    kept = stage(linked.drop("loose").join(sound, "conversation_id", "left_semi"))
    links = kept.where(F.col("parent").isNotNull())
    circles = (
        resolve_hierarchy(links, "row_id", "parent", leaves=False)
        .where(F.col("depth") < 0)
        .join(links.select(F.col("row_id").alias("id"), "conversation_id"), "id")
        .select("conversation_id")
        .distinct()
    )
    turns = (
        kept.where("turn")
        .join(circles, "conversation_id", "left_anti")
        .select(
            "conversation_id",
            "message_id",
            "sender",
            "sent_us",
            "external_id",
            F.col("external_id").try_cast("decimal(38,0)").alias("_number"),
            F.coalesce(F.floor(F.col("sent_us") / SLICE_US), F.lit(-(2**62))).alias("_slice"),
        )
    )
    parts = turns.groupBy("conversation_id", "_slice", "sender").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("sent_us", "_number", "external_id")).alias("_first")
    )
    parts = stage(parts)
    before = (
        parts.groupBy("conversation_id", "_slice")
        .agg(F.sum("_n").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy("conversation_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("conversation_id", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    speakers = (
        parts.where(F.col("sender").isNotNull())
        .groupBy("conversation_id", "sender")
        .agg(F.min("_first").alias("_first"))
        .withColumn("speaker_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy("_first")))
        .select("conversation_id", "sender", "speaker_no")
    )
    guide = (
        parts.select("conversation_id", "_slice", "sender")
        .join(before, ["conversation_id", "_slice"])
        .join(speakers, ["conversation_id", "sender"], "left")
        .select(
            F.col("conversation_id").alias("_c"),
            F.col("_slice").alias("_s"),
            F.col("sender").alias("_who"),
            "_before",
            F.coalesce("speaker_no", F.lit(0)).alias("speaker_no"),
        )
    )
    inside = Window.partitionBy("conversation_id", "_slice").orderBy("sent_us", "_number", "external_id", "message_id")
    return (
        turns.join(
            guide,
            (F.col("conversation_id") == F.col("_c")) & (F.col("_slice") == F.col("_s")) & F.col("sender").eqNullSafe(F.col("_who")),
        )
        .withColumn("turn_no", F.col("_before") + F.row_number().over(inside))
        .select("conversation_id", "turn_no", "message_id", F.col("speaker_no").cast("long").alias("speaker_no"), "sender")
    )
