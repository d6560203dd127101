"""Streams of events: sessions as they close, late rows, and writes that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def closed_sessions(events: DataFrame, actor: str, at: str, gap: str = "8 hours", lateness: str = "1 hour") -> DataFrame:
    """(actor, start_at, end_at, n_events) of sessions that the watermark has closed, in append mode.

    A pause longer than ``gap`` splits; the end is the last event. Events later than ``lateness`` behind the
    latest are dropped by the watermark (see ``split_late``). State is one row per open session.
    """
    stream = events.where(F.col(actor).isNotNull() & F.col(at).isNotNull()).select(actor, F.col(at).cast("timestamp").alias("_at"))
    # Session windows are half-open: a microsecond more lets a pause of exactly the gap join.
    reach = f"{gap} 1 microsecond"
    return (
        stream.withWatermark("_at", lateness)
        .groupBy(actor, F.session_window("_at", reach).alias("_w"))
        .agg(F.min("_at").alias("start_at"), F.max("_at").alias("end_at"), F.count(F.lit(1)).alias("n_events"))
        .select(actor, "start_at", "end_at", "n_events")
    )


def split_late(batch: DataFrame, segmented: DataFrame, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows not before, and rows before the last segmented event of their actor.

    ``segmented`` holds (actor, last_at). Late rows call for cutting that actor's events anew.
    """
    last = segmented.select(F.col(actor).alias("_who"), "last_at")
    joined = batch.join(last, F.col(actor) == F.col("_who"), "left")
    late = F.coalesce(F.col(at) < F.col("last_at"), F.lit(False))
    return joined.where(~late).select(*batch.columns), joined.where(late).select(*batch.columns)


def append_once(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes each micro-batch to its own folder of ``path``, over any earlier try at the same batch.

    Takes what is available and stops; started again with the same ``checkpoint`` it goes on from there.
    """

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
