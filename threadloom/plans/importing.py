"""Queries of the readers: messages written as exports into the shared folder and read again, with SQL over the messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import records as C
from threadloom.operators.snapshots import new_rows
from threadloom.plans.analytics import _M, base
from threadloom.session import shared_folder
from threadloom.sources import chats
from threadloom.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _written(spark: SparkSession, lines: DataFrame) -> str:
    path = shared_folder(spark, f"export-{uuid.uuid4().hex}")
    lines.write.text(path)
    return path


#: Senders and texts that the text form can hold: no colon in a name, no line that looks like the head of a message.
_PLAIN = r"sender IS NOT NULL AND sent_at IS NOT NULL AND text IS NOT NULL AND text <> ''"


@query(rf"""WITH {_M} SELECT sender AS sender_name, epoch_us(date_trunc('second', sent_at)) AS sent_us, regexp_replace(text, '\n+$', '') AS text FROM m WHERE {_PLAIN} AND NOT regexp_matches(sender, ':') AND NOT regexp_matches(text, '[\r\[]')""")
def export_txt(spark: SparkSession, d: str) -> DataFrame:
    """Messages as lines of a text export, read again."""
    rows = base(spark, d, ["sender", "sent_at", "text"]).where(_PLAIN).where(~F.col("sender").contains(":") & ~F.col("text").rlike(r"[\r\[]"))
    line = F.concat(F.lit("["), F.date_format("sent_at", "dd.MM.yyyy, HH:mm:ss"), F.lit("] "), "sender", F.lit(": "), "text")
    found = chats.read_txt(spark, _written(spark, rows.select(line.alias("value"))))
    return found.select("sender_name", F.unix_micros("sent_at").alias("sent_us"), "text")


@query(f"""WITH {_M} SELECT row_id::VARCHAR AS external_id, sender AS sender_external_id, epoch_us(date_trunc('second', sent_at)) AS sent_us, coalesce(message_type, 'message') AS message_type, nullif(reply, '') AS reply_to_external_id, coalesce(text, '') AS text,
  1.0::DOUBLE AS resolution_confidence FROM m WHERE sent_at IS NOT NULL""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """Messages as a JSON export with one field per line, texts as lists of pieces, read again by many tasks."""
    rows = base(spark, d).where("sent_at IS NOT NULL")
    pieces = F.array(F.struct(F.lit("plain").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    message = F.struct(
        F.col("row_id").cast("string").alias("id"), F.coalesce("message_type", F.lit("message")).alias("type"), F.unix_seconds("sent_at").cast("string").alias("date_unixtime"),
        F.col("sender").alias("from_id"), pieces.alias("text"), F.nullif("reply", F.lit("")).alias("reply_to_message_id"),
    )
    body = F.regexp_replace(F.to_json(message), r'^\{|\}$', "")
    path = _written(spark, rows.select(F.concat(F.lit("  {\n   "), body, F.lit("\n  },")).alias("value")))
    found = chats.read_large_json(spark, path)
    return found.select("external_id", "sender_external_id", F.unix_micros("sent_at").alias("sent_us"), "message_type", "reply_to_external_id", "text", "resolution_confidence")


@query(f"""WITH {_M} SELECT row_id::VARCHAR AS external_id, sender AS sender_name, epoch_us(date_trunc('second', sent_at)) AS sent_us, 1.0::DOUBLE AS resolution_confidence, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS text FROM m
WHERE sender IS NOT NULL AND sent_at IS NOT NULL AND regexp_matches(text, '^[A-Za-zА-Яа-яЁё0-9 .,!?-]+$') AND regexp_matches(text, '[^ ]') AND regexp_matches(sender, '^[A-Za-z0-9_-]+$')""")
def export_html(spark: SparkSession, d: str) -> DataFrame:
    """Messages of plain words as pages of an HTML export, read again."""
    rows = base(spark, d, ["sender", "sent_at", "text"]).where(F.col("sender").rlike("^[A-Za-z0-9_-]+$") & F.col("sent_at").isNotNull() & F.col("text").rlike("^[A-Za-zА-Яа-яЁё0-9 .,!?-]+$") & F.col("text").rlike("[^ ]"))
    stamp = F.concat(F.date_format("sent_at", "dd.MM.yyyy HH:mm:ss"), F.lit(" UTC+00:00"))
    page = F.concat(
        F.lit('<div class="message default" id="message'), F.col("row_id").cast("string"), F.lit('"><div class="pull_right date details" title="'), stamp,
        F.lit('"></div><div class="from_name">'), "sender", F.lit('</div><div class="text">'), "text", F.lit("</div></div>"),
    )
    found = chats.read_html(spark, _written(spark, rows.select(page.alias("value"))))
    return found.select("external_id", "sender_name", F.unix_micros("sent_at").alias("sent_us"), "resolution_confidence", "text")


@query("""WITH g AS (SELECT range AS i FROM range(3000)) SELECT (i + 1)::VARCHAR AS external_id, 's' || i % 3 AS sender_external_id, (1700000000 + i * 30) * 1000000 AS sent_us, CASE WHEN i % 3 <> 0 THEN i::VARCHAR END AS reply_to_external_id,
  ['the schedule moves', 'agreed', 'why the schedule?', 'I will check', 'done'][i % 5 + 1] AS text FROM g""")
def generated_chat(spark: SparkSession, d: str) -> DataFrame:
    return chats.generated(spark, 3000).select("external_id", "sender_external_id", F.unix_micros("sent_at").alias("sent_us"), "reply_to_external_id", "text")


@query("""WITH p AS (SELECT trim(display_name, ' ') AS name, regexp_extract(external_id, '[0-9]+') AS external_id FROM participants WHERE regexp_matches(display_name, '[^ ]') AND regexp_matches(external_id, '[0-9]'))
SELECT name, min(external_id) AS sender_external_id FROM p GROUP BY name HAVING count(DISTINCT external_id) = 1""")
def roster_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names that rosters in messages map to exactly one id; the rosters hold the participants, a hundred to a message."""
    people = table(spark, d, "participants").where(F.col("display_name").rlike("[^ ]") & F.col("external_id").rlike("[0-9]")).withColumn("external_id", F.regexp_extract("external_id", "[0-9]+", 0))
    lines = people.select(F.concat_ws(": ", "external_id", F.trim("display_name")).alias("line"), F.pmod(F.xxhash64("external_id"), F.lit(max(1, people.count() // 100))).alias("k"))
    return chats.roster(lines.groupBy("k").agg(F.array_join(F.collect_list("line"), "\n").alias("text")))


@query("""SELECT row_id, nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS normal, sha256(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS text_hash FROM messages WHERE text IS NOT NULL""")
def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    """Line ends and Unicode of every row made alike, and the hash that tells revisions apart."""
    normal = T.normalize_text(F.col("text"))
    return table(spark, d, "messages").where("text IS NOT NULL").select("row_id", normal.alias("normal")).withColumn("text_hash", F.sha2("normal", 256))


@query("""WITH f AS (SELECT conversation_id, external_id FROM messages GROUP BY ALL HAVING min(imported_at) < TIMESTAMP '2024-01-01'), r AS (SELECT * FROM messages WHERE imported_at >= TIMESTAMP '2024-01-01')
SELECT row_id FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conversation_id = r.conversation_id AND f.external_id = r.external_id)""")
def fresh_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows imported from 2024 on of messages that no earlier import holds: importing twice adds nothing."""
    rows = table(spark, d, "messages")
    early = F.col("imported_at") < F.lit("2024-01-01").cast("timestamp")
    return new_rows(rows.where(~early), rows.where(early), ["conversation_id", "external_id"]).select("row_id")


@query("""SELECT '/dialogue_act' AS path, 'changed' AS change UNION ALL SELECT '/grounding', 'removed' UNION ALL SELECT '/stance', 'added'""")
def codebook_changes(spark: SparkSession, d: str) -> DataFrame:
    """What two editions of a codebook differ in."""
    old = {"dialogue_act": ["QUESTION", "PROPOSE", "ASSERT"], "grounding": ["REPAIRED"], "task": ["one"]}
    new = {"dialogue_act": ["QUESTION", "PROPOSE", "COMMIT"], "stance": ["SUPPORT", "OPPOSE"], "task": ["one"]}
    return C.codebook_difference(spark, old, new).select("path", "change")
