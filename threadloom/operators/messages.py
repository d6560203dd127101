"""The base relation: one row per message out of rows that may have been imported repeatedly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("conversation_id", "external_id")


def latest_messages(
    rows: DataFrame,
    columns: list[str],
    key: tuple[str, str] = KEY,
    version: str = "imported_at",
    row_id: str = "row_id",
) -> DataFrame:
    """The latest stored row of each message, reduced to ``key``, ``row_id`` and ``columns``.

    A message is one value of ``key``; its latest row has the greatest ``version``, ties go to the
    greater ``row_id``, a null version counts as the oldest. Rows with a null in the key can't repeat
    another row, so each stands for itself. An empty table gives an empty table; columns that aren't
    asked for are never read.

    One shuffle on the key with a map-side combine, so a conversation that holds a third of all rows
    is spread over all tasks.
    """
    kept = [row_id, *[c for c in columns if c not in (*key, row_id)]]
    own = F.when(F.col(key[0]).isNull() | F.col(key[1]).isNull(), F.col(row_id))
    return (
        rows.groupBy(*[F.col(k) for k in key], own.alias("_own"))
        .agg(F.max_by(F.struct(*kept), F.struct(F.col(version), F.col(row_id))).alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in kept])
    )


def non_blank(text: Column) -> Column:
    """True where a text has a character other than space, tab, line break, U+00A0 and U+200B."""
    return F.coalesce(text.rlike("[^ \\t\\r\\n\\u00A0\\u200B]"), F.lit(False))
