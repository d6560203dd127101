"""Queries of the general data problems: sessions (1), timestamps (5) and hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import descendant_counts, reply_links, resolve_hierarchy
from threadloom.operators.messages import latest_messages
from threadloom.operators.sessions import sessionize
from threadloom.operators.timestamps import normalise_timestamps, parser_version
from threadloom.session import cut, shared_folder
from threadloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = latest_messages(table(spark, sf_dir, "messages"), ["sender_external_id", "sent_at"])
    return sessionize(messages, "sender_external_id", "sent_at").select(
        "sender_external_id", "start_us", "end_us", F.col("n_events").alias("n_messages")
    )


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = latest_messages(table(spark, sf_dir, "messages"), ["sender_external_id", "sent_at"])
    return sessionize(messages, "sender_external_id", "sent_at").withColumnRenamed("n_events", "n_messages")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "import_messages")
    kept = shared_folder(spark, f"timestamps-{parser_version()}")
    return normalise_timestamps(rows, "record_id", "source_local_timestamp", "source_timezone_assumption", kept).where(
        F.col("utc_us").isNotNull()
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(reply_links(latest_messages(table(spark, sf_dir, "messages"), ["reply_to_external_id"])))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    solved = resolve_hierarchy(links)
    roots = links.groupBy("parent").agg(F.first("parent_external_id").alias("_root_external_id"))
    return (
        links.select("id", "conversation_id", "external_id")
        .join(solved, "id")
        .join(roots, F.col("root") == roots["parent"], "left")
        .select(
            "conversation_id",
            "external_id",
            F.coalesce("_root_external_id", F.lit("")).alias("root_external_id"),
            F.col("depth").alias("node_depth"),
        )
    )


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, depth, root_row_id, path): the path from the root down to the parent, by row ids."""
    solved = resolve_hierarchy(_links(spark, sf_dir), with_path=True)
    return solved.select(
        F.col("id").alias("row_id"),
        F.col("depth").alias("node_depth"),
        F.col("root").alias("root_row_id"),
        F.array_join(F.transform(F.reverse("path"), lambda x: x.cast("string")), "/").alias("path"),
    )


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ancestor, n_descendants, max_distance) of every message with a reply below it."""
    return descendant_counts(_links(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
}

_LATEST = """
latest AS (
  SELECT * FROM messages
  QUALIFY row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY imported_at DESC, row_id DESC) = 1
)"""

_SESSIONS = f"""
WITH {_LATEST},
t AS (SELECT sender_external_id, epoch_us(sent_at) AS us FROM latest
      WHERE sender_external_id IS NOT NULL AND sent_at IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sender_external_id ORDER BY us) <= 28800000000 THEN 0 ELSE 1 END AS b FROM t),
s AS (SELECT *, sum(b) OVER (PARTITION BY sender_external_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM g)
"""

_TREE = f"""
WITH RECURSIVE {_LATEST},
nodes AS (
  SELECT c.row_id, c.conversation_id, c.external_id, p.row_id AS parent
  FROM latest c LEFT JOIN latest p
    ON p.conversation_id = c.conversation_id AND p.external_id = c.reply_to_external_id AND c.reply_to_external_id <> ''
),
tree AS (
  SELECT row_id, row_id AS root, external_id AS root_external_id, 0 AS depth, '' AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.row_id, t.root, t.root_external_id, t.depth + 1,
         CASE WHEN t.path = '' THEN t.row_id::VARCHAR ELSE t.path || '/' || t.row_id END
  FROM nodes n JOIN tree t ON n.parent = t.row_id
)
"""

SQL = {
    "p1_found": _SESSIONS
    + """SELECT sender_external_id, min(us)::BIGINT AS start_us, max(us)::BIGINT AS end_us, count(*)::BIGINT AS n_messages
FROM s GROUP BY sender_external_id, n""",
    "p1_sessions": _SESSIONS
    + """SELECT sender_external_id, n::BIGINT AS session_no, min(us)::BIGINT AS start_us, max(us)::BIGINT AS end_us,
       (max(us) - min(us))::BIGINT AS duration_us, count(*)::BIGINT AS n_messages
FROM s GROUP BY sender_external_id, n""",
    "p7_found": _TREE
    + """SELECT n.conversation_id, n.external_id, coalesce(t.root_external_id, '') AS root_external_id,
       coalesce(t.depth, -1)::BIGINT AS node_depth
FROM nodes n LEFT JOIN tree t ON t.row_id = n.row_id WHERE n.parent IS NOT NULL""",
    "p7_paths": _TREE
    + """SELECT n.row_id, coalesce(t.depth, -1)::BIGINT AS node_depth, t.root AS root_row_id, t.path
FROM nodes n LEFT JOIN tree t ON t.row_id = n.row_id WHERE n.parent IS NOT NULL""",
    "p7_descendants": _TREE
    + """, pairs AS (
  SELECT unnest(string_split(path, '/'))::BIGINT AS ancestor, unnest(range(depth, 0, -1)) AS distance
  FROM tree WHERE depth > 0
)
SELECT ancestor, count(*)::BIGINT AS n_descendants, max(distance)::BIGINT AS max_distance FROM pairs GROUP BY ancestor""",
}
