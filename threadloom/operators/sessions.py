"""Cutting the activity of each actor into sessions separated by pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EIGHT_HOURS_US = 8 * 3600 * 1_000_000


def sessionize(
    events: DataFrame,
    actor: str,
    at: str,
    gap_us: int = EIGHT_HOURS_US,
) -> DataFrame:
    """Sessions of each ``actor``: (actor, session_no, start_us, end_us, duration_us, n_events).

    A session begins where the time since the actor's previous event is more than ``gap_us``; a pause
    of exactly ``gap_us`` doesn't split. Rows with a null actor or time belong to no session. Equal
    times and repeated rows fall into one session and all count. Other columns are ignored.

    Events less than one gap apart always share a session, so all events of an actor in one time slice
    as long as the gap collapse into (first, last, count) by a hash aggregate with map-side combine.
    ``lag`` and the running sum of flags then see one row per actor and slice, not one per event: an
    actor with a third of all events leaves at most (time range / gap) rows to sort.
    """
    if gap_us <= 0:
        raise ValueError("gap_us must be positive")
    us = F.unix_micros(F.col(at))
    slices = (
        events.where(F.col(actor).isNotNull() & F.col(at).isNotNull())
        .select(F.col(actor).alias("_actor"), us.alias("_us"))
        .groupBy("_actor", F.floor(F.col("_us") / F.lit(gap_us)).alias("_slice"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n"))
    )
    by_time = Window.partitionBy("_actor").orderBy("_first")
    flagged = slices.withColumn(
        "_new", F.coalesce((F.col("_first") - F.lag("_last").over(by_time) > gap_us).cast("long"), F.lit(1).cast("long"))
    )
    numbered = flagged.withColumn(
        "session_no", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        numbered.groupBy("_actor", "session_no")
        .agg(F.min("_first").alias("start_us"), F.max("_last").alias("end_us"), F.sum("_n").alias("n_events"))
        .select(
            F.col("_actor").alias(actor),
            "session_no",
            "start_us",
            "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "n_events",
        )
    )


def episode_messages(messages: DataFrame, gap_us: int = EIGHT_HOURS_US) -> DataFrame:
    """(conversation_id, row_id, episode_no, ordinal): the sessions of each conversation as episodes of its messages.

    Every slice as long as the gap lies in one session, so messages meet their session on (conversation, slice);
    ordinals count from 1 by time and row id. Messages without a time belong to no episode.
    """
    from threadloom.operators.running import row_numbers

    slices = F.sequence(F.floor(F.col("start_us") / gap_us), F.floor(F.col("end_us") / gap_us))
    sessions = sessionize(messages, "conversation_id", "sent_at", gap_us).select("conversation_id", F.col("session_no").alias("episode_no"), F.explode(slices).alias("_slice"))
    placed = (
        messages.where("conversation_id IS NOT NULL AND sent_at IS NOT NULL")
        .select("conversation_id", "row_id", "sent_at", F.floor(F.unix_micros("sent_at") / gap_us).alias("_slice"))
        .join(sessions, ["conversation_id", "_slice"])
    )
    return row_numbers(placed, ["conversation_id", "episode_no"], "sent_at", "row_id", "ordinal").select("conversation_id", "row_id", "episode_no", "ordinal")
