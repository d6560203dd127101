"""Readers of exported chats: JSON, plain text and HTML, all with the columns of ``SCHEMA``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.running import running_sum

#: Columns that every reader gives: the chat, the message's id in it, who and when, what it answers, the text.
SCHEMA = (
    "chat STRING, external_id STRING, sender_external_id STRING, sender_name STRING, sent_at TIMESTAMP, source_local_timestamp STRING, "
    "resolution_confidence DOUBLE, message_type STRING, reply_to_external_id STRING, text STRING"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

_MESSAGE = (
    "STRUCT<id: STRING, type: STRING, date: STRING, date_unixtime: STRING, `from`: STRING, from_id: STRING, "
    "actor: STRING, actor_id: STRING, text: VARIANT, caption: VARIANT, reply_to_message_id: STRING>"
)
_JSON = f"id STRING, name STRING, messages ARRAY<{_MESSAGE}>"


def _flat_text(value: str) -> Column:
    """A text that is a string, or a list of strings and objects with a text."""
    return F.expr(
        f"""coalesce(
          array_join(transform(try_cast({value} AS ARRAY<VARIANT>), x -> coalesce(try_variant_get(x, '$.text', 'string'), try_variant_get(x, '$', 'string'), '')), ''),
          try_variant_get({value}, '$', 'string'))"""
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON exports, one chat per file.

    A Unix time is certain (confidence 1), so is a time with a zone; one without is taken as UTC at 0.5. A
    message without any time has none, at 0.
    """
    return _of_json(spark.read.schema(_JSON).option("multiLine", True).json(path).select(F.col("id").alias("chat"), F.explode("messages").alias("m")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of text files: ``block`` and ``at`` give the order in a file, which many tasks may share."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line")
    )


def read_large_json(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """Messages of JSON exports written with one field per line, as exporting programs do, each file shared by many tasks.

    A message begins with a lone brace ``indent`` blanks deep and ends with the next one; its lines are put together and parsed
    by themselves, so no task holds a file. The chat's own id stands before the messages, less deep.
    """
    lines = _lines(spark, path)
    deep = " " * indent
    opens, closes = F.col("line").rlike(rf"^{deep}\{{\s*$"), F.col("line").rlike(rf"^{deep}\}},?\s*$")
    rows = running_sum(lines, ["file"], F.col("block"), ["block", "at"], opens.cast("long"), "_k")
    number = rows.where(F.col("_k") > 0).withColumn("_end", closes)
    ended = running_sum(number, ["file", "_k"], F.col("block"), ["block", "at"], F.col("_end").cast("long"), "_e")
    inside = ended.where((F.col("_e") == 0) | (F.col("_end") & (F.col("_e") == 1)))
    each = inside.groupBy("file", "_k").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("_l"))
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), r",\s*$", "")
    chats = lines.where(F.col("line").rlike(rf'^ {{0,{indent - 1}}}"id":')).groupBy("file").agg(F.min_by(F.regexp_extract("line", r'"id":\s*"?([^",]+)', 1), F.struct("block", "at")).alias("chat"))
    return _of_json(each.join(chats, "file", "left").select("chat", F.from_json(text, _MESSAGE).alias("m")))


def _of_json(m: DataFrame) -> DataFrame:
    unix = F.col("m.date_unixtime").try_cast("bigint")
    zoned = F.col("m.date").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.coalesce(F.timestamp_seconds(unix), F.try_to_timestamp(F.col("m.date")))
    return m.select(
        "chat",
        F.col("m.id").alias("external_id"),
        F.coalesce("m.from_id", "m.actor_id").alias("sender_external_id"),
        F.coalesce("m.from", "m.actor").alias("sender_name"),
        at.alias("sent_at"),
        F.coalesce("m.date", "m.date_unixtime").alias("source_local_timestamp"),
        F.when(at.isNull(), 0.0).when(unix.isNotNull() | zoned, 1.0).otherwise(0.5).alias("resolution_confidence"),
        F.coalesce("m.type", F.lit("message")).alias("message_type"),
        F.col("m.reply_to_message_id").alias("reply_to_external_id"),
        F.coalesce(F.nullif(_flat_text("m.text"), F.lit("")), _flat_text("m.caption"), F.lit("")).alias("text"),
    )


_HEAD = r"^‎?\[?(\d{1,2}[./]\d{1,2}[./]\d{2,4}),? (\d{1,2}:\d{2}(?::\d{2})?)\]?(?: -)? ([^:]{1,80}): (.*)$"


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text exports: ``[dd.mm.yyyy, HH:MM:SS] sender: text``, brackets optional.

    Lines without such a head continue the message before. Ids are ordinals in the file, confidence is 0.4. A file is read by
    as many tasks as it has blocks; heads are counted block by block.
    """
    lines = _lines(spark, path).withColumn("chat", F.regexp_extract("file", r"([^/]+)$", 1)).withColumn("n", F.struct("block", "at"))
    head = F.col("line").rlike(_HEAD)
    numbered = running_sum(lines, ["chat"], F.col("block"), ["block", "at"], head.cast("long"), "k").where(F.col("k") > 0)
    body = F.when(head, F.regexp_extract("line", _HEAD, 4)).otherwise(F.col("line"))
    parts = numbered.select("chat", "k", "n", body.alias("body"), *[F.when(head, F.regexp_extract("line", _HEAD, i)).alias(f"h{i}") for i in (1, 2, 3)])
    each = parts.groupBy("chat", "k").agg(
        F.max("h1").alias("day"), F.max("h2").alias("clock"), F.max("h3").alias("who"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n").alias("text"),
    )
    p = F.split(F.regexp_replace("day", "[.]", "/"), "/")
    year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
    stamp = F.concat_ws(" ", F.concat_ws("-", year, F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")), F.col("clock"))
    return each.select(
        "chat", F.col("k").cast("string").alias("external_id"), F.col("who").alias("sender_external_id"), F.col("who").alias("sender_name"),
        F.try_to_timestamp(stamp).alias("sent_at"), F.concat_ws(", ", "day", "clock").alias("source_local_timestamp"),
        F.lit(0.4).alias("resolution_confidence"), F.lit("message").alias("message_type"), F.lit(None).cast("string").alias("reply_to_external_id"),
        F.regexp_replace("text", r"\n+$", "").alias("text"),
    )


class _Page(HTMLParser):
    """Collects the messages of one exported page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.depth = 0
        self.fields: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        classes = set((given.get("class") or "").split())
        if tag == "br":
            self._add("\n")
            return
        if tag == "a" and self.rows and (m := re.search(r"go_to_message(-?\d+)", given.get("href") or "")) and any(f == "reply" for _, f in self.fields):
            self.rows[-1]["reply"] = m.group(1)
        if tag != "div":
            return
        self.depth += 1
        if "message" in classes:
            number = re.search(r"(-?\d+)$", given.get("id") or "")
            self.rows.append({"id": number.group(1) if number else None, "kind": "service" if "service" in classes else "message", "joined": "joined" in classes})
        elif self.rows:
            for mark, name in (("from_name", "sender"), ("text", "text"), ("reply_to", "reply"), ("media_wrap", "media")):
                if mark in classes:
                    self.fields.append((self.depth, name))
            if "details" in classes and self.rows[-1]["kind"] == "service":
                self.fields.append((self.depth, "text"))
            if "date" in classes and given.get("title"):
                self.rows[-1]["date"] = given["title"]

    def handle_endtag(self, tag: str) -> None:
        if tag == "div":
            if self.fields and self.fields[-1][0] == self.depth:
                self.fields.pop()
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        self._add(data)

    def _add(self, data: str) -> None:
        if self.fields and self.rows:
            name = self.fields[-1][1]
            if name in ("sender", "text"):
                self.rows[-1][name] = self.rows[-1].get(name, "") + data


def parse_page(html: str) -> list[dict]:
    """Messages of a page in order: id, kind, joined, sender, date, reply, text."""
    page = _Page()
    page.feed(html)
    for row in page.rows:
        lines = [re.sub(r"[ \t]+", " ", x).strip() for x in row.get("text", "").split("\n")]
        row["text"] = "\n".join(lines).strip()
        row["sender"] = re.sub(r"\s+", " ", row.get("sender", "")).strip() or None
    return page.rows


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Messages of HTML exports, pages messages.html, messages2.html … of one folder per chat.

    A joined message has the sender of the one before it; a service message without a time gets the latest
    one, at confidence 0.1. Times are dd.mm.yyyy HH:MM:SS with or without a UTC offset (1.0 or 0.5).
    """
    pages = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("chat"),
        F.coalesce(F.regexp_extract("_metadata.file_path", r"messages(\d+)\.html$", 1).try_cast("int"), F.lit(1)).alias("page"),
        "value",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (chat, page, i, r["id"], r["kind"], r["joined"], r["sender"], r.get("date"), r.get("reply"), r["text"])
                for chat, page, value in batch.itertuples(index=False)
                for i, r in enumerate(parse_page(value or ""))
            ]
            yield pd.DataFrame(rows, columns=["chat", "page", "i", "id", "kind", "joined", "sender", "date", "reply", "text"])

    rows = pages.mapInPandas(run, "chat string, page int, i int, id string, kind string, joined boolean, sender string, date string, reply string, text string")
    order = Window.partitionBy("chat").orderBy("page", "i")
    stamp = F.regexp_extract("date", r"^(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2})", 1)
    offset = F.regexp_extract("date", r"UTC([+-]\d{2}:\d{2})", 1)
    own = F.try_to_timestamp(stamp, F.lit("dd.MM.yyyy HH:mm:ss"))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    shift = sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))
    at = F.when(offset != "", F.timestamp_micros(F.unix_micros(own) - shift.cast("long") * 60_000_000)).otherwise(own)
    rows = rows.withColumn("_at", at)
    return rows.select(
        "chat",
        F.coalesce("id", F.concat_ws("-", F.lit("row"), "page", "i")).alias("external_id"),
        F.when(F.col("kind") == "message", F.coalesce("sender", F.last(F.when(F.col("kind") == "message", F.col("sender")), True).over(order))).alias("sender_external_id"),
        F.when(F.col("kind") == "message", F.coalesce("sender", F.last(F.when(F.col("kind") == "message", F.col("sender")), True).over(order))).alias("sender_name"),
        F.coalesce("_at", F.last("_at", True).over(order)).alias("sent_at"),
        F.col("date").alias("source_local_timestamp"),
        F.when(F.col("_at").isNull(), 0.1).when(offset != "", 1.0).otherwise(0.5).alias("resolution_confidence"),
        F.col("kind").alias("message_type"),
        F.col("reply").alias("reply_to_external_id"),
        "text",
    )


def roster(messages: DataFrame) -> DataFrame:
    """(name, sender_external_id): names that messages with three ``id: name`` lines map to exactly one id."""
    found = messages.select(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+: [^\n]+)$"), F.lit(1)).alias("_l")).where(F.size("_l") >= 3)
    pairs = found.select(F.explode("_l").alias("_x")).select(F.trim(F.regexp_extract("_x", r"^\d+: (.+)$", 1)).alias("name"), F.regexp_extract("_x", r"^(\d+):", 1).alias("_id"))
    return pairs.groupBy("name").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("sender_external_id")).where("_n = 1").drop("_n")


def generated(spark: SparkSession, n: int) -> DataFrame:
    """``n`` messages in the form of the readers: 3 senders, 5 texts, half a minute apart, two of three replying."""
    i = F.col("id")
    texts = ["the schedule moves", "agreed", "why the schedule?", "I will check", "done"]
    return spark.range(n).select(
        F.lit("generated").alias("chat"), (i + 1).cast("string").alias("external_id"), F.concat(F.lit("s"), i % 3).alias("sender_external_id"),
        F.concat(F.lit("Sender "), i % 3).alias("sender_name"), F.timestamp_seconds(1_700_000_000 + i * 30).alias("sent_at"),
        F.lit(None).cast("string").alias("source_local_timestamp"), F.lit(1.0).alias("resolution_confidence"), F.lit("message").alias("message_type"),
        F.when((i % 3 != 0), i.cast("string")).alias("reply_to_external_id"), F.element_at(F.array(*map(F.lit, texts)), (i % 5 + 1).cast("int")).alias("text"),
    )
