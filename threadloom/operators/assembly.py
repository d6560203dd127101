"""Putting measurements together: dimensions, findings, the primitives of health, and views of single messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import replies as R
from threadloom.operators.participation import concentration, sender_counts
from threadloom.operators.sessions import episode_messages, sessionize

# Measures of health that no operator gives; there is no score over all of them.
MISSING_DIMENSIONS = ["constructiveness", "goal_progress", "grounding", "repair", "semantic_responsivity"]

#: Labels that comparison cases may have; their first rows are broadcast.
MAX_LABELS = 1000


def busiest_month_message(messages: DataFrame) -> DataFrame:
    """(month, n, row_id): the month with most messages, the earlier one on ties, and its first message as evidence."""
    month = F.date_format("sent_at", "yyyy-MM")
    each = messages.where("sent_at IS NOT NULL").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min_by("row_id", F.struct("sent_at", "row_id")).alias("row_id"))
    return each.orderBy(F.desc("n"), "month").limit(1)


def _reply_marks(messages: DataFrame, events: DataFrame, count: Column) -> DataFrame:
    """(marks, found) in one row: messages with a reply link, and ``count`` over the links that name a message."""
    marks = messages.agg(F.count_if(F.coalesce(F.col("reply"), F.lit("")) != "").alias("marks"), F.lit(0).cast("long").alias("found"))
    found = events.agg(F.lit(0).cast("long").alias("marks"), count.alias("found"))
    return marks.unionByName(found).agg(F.max("marks").alias("marks"), F.max("found").alias("found"))


def health_primitives(messages: DataFrame) -> DataFrame:
    """(name, value): balance, resolution of targets, reciprocity, median latency and sessions; absent ones have a null value."""
    events = R.reply_events(messages)
    target = _reply_marks(messages, events, F.count_distinct("source")).select(F.when(F.col("marks") > 0, F.col("found") / F.col("marks")).alias("v"))
    parts = {
        "participation_balance": concentration(messages).select(F.col("normalized_entropy").alias("v")),
        "reply_target_resolution": target,
        "dyadic_reciprocity": R.reciprocity(events).select(F.col("reciprocity").alias("v")),
        "session_count": sessionize(messages, "conversation_id", "sent_at").agg(F.count(F.lit(1)).cast("double").alias("v")),
    }
    out = None
    for name, value in parts.items():
        row = value.select(F.lit(name).alias("name"), F.col("v").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    absent = messages.sparkSession.createDataFrame([(n, None) for n in ["aggregate_score", *MISSING_DIMENSIONS]], "name string, value double")
    return out.unionByName(absent)


def findings(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(dimension, claim, evidence_row, epistemic_level, causal_status): what the overview says, each with the row that it rests on."""
    busiest = busiest_month_message(messages).select(
        F.lit("temporal").alias("dimension"), F.concat(F.lit("Most messages fell in "), "month", F.lit(": "), F.col("n").cast("string")).alias("claim"), F.col("row_id").alias("evidence_row")
    )
    first = messages.where("sender IS NOT NULL").groupBy("sender").agg(F.min_by("row_id", F.struct("sent_at", "row_id")).alias("evidence_row"))
    counts = sender_counts(messages).select("sender", "n_messages").unionByName(messages.where("sender IS NULL").groupBy("sender").agg(F.count(F.lit(1)).alias("n_messages")))
    most_of_all = counts.agg(F.sum("n_messages").alias("total"), F.max(F.when(F.col("sender").isNotNull(), F.col("n_messages"))).alias("n_messages"))
    top = counts.where("sender IS NOT NULL").join(F.broadcast(most_of_all), "n_messages").orderBy("sender").limit(1)
    names = people.groupBy(F.col("person").alias("sender")).agg(F.min("name").alias("name"))
    share = F.format_string("%.1f", F.floor(F.col("n_messages") * 1000 / F.col("total")) / 10)
    most = top.join(first, "sender").join(names, "sender", "left").select(
        F.lit("participation").alias("dimension"), F.concat(F.coalesce("name", "sender"), F.lit(" wrote "), share, F.lit(" percent of the messages")).alias("claim"), "evidence_row"
    )
    replies = _reply_marks(messages, R.reply_events(messages), F.count(F.lit(1))).select(
        F.lit("reply_structure").alias("dimension"), F.concat(F.col("found").cast("string"), F.lit(" of "), F.col("marks").cast("string"), F.lit(" reply links name a message")).alias("claim"),
        F.lit(None).cast("long").alias("evidence_row"),
    )
    return busiest.unionByName(most).unionByName(replies).select("*", F.lit("L2_MEASUREMENT").alias("epistemic_level"), F.lit("descriptive").alias("causal_status"))


def chunk_of(ordinal: Column, size: Column, limit: int = 40, least_tail: int = 10) -> Column:
    """Window of an episode that a message lies in, from 0; a tail shorter than ``least_tail`` belongs to the window before."""
    last = F.floor((size - 1) / limit)
    short = (last > 0) & (size - last * limit < least_tail)
    return F.least(F.floor((ordinal - 1) / limit), F.when(short, last - 1).otherwise(last))


def microscope(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """(selected, row_id, ordinal, is_selected, acts, grounding, n_propositions): the window of its episode around each selected message.

    ``selected`` holds row ids; only the windows they lie in meet the texts.
    """
    placed = episode_messages(messages)
    size = placed.groupBy("conversation_id", "episode_no").agg(F.max("ordinal").alias("_size"))
    placed = placed.join(size, ["conversation_id", "episode_no"]).withColumn("_chunk", chunk_of(F.col("ordinal"), F.col("_size"))).drop("_size")
    keys = ["conversation_id", "episode_no", "_chunk"]
    wanted = placed.join(selected.select("row_id").distinct(), "row_id").select(*keys, F.col("row_id").alias("selected"))
    rows = placed.join(wanted, keys).join(messages.select("row_id", "text"), "row_id")
    said = T.sentences(F.coalesce("text", F.lit("")))
    grounds = F.filter(F.transform(said, lambda s: T.grounding(s["sentence"])), lambda g: g.isNotNull())
    return rows.select(
        "selected", "row_id", "ordinal", (F.col("row_id") == F.col("selected")).alias("is_selected"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(said, lambda s: T.dialogue_acts(s["sentence"]))))).alias("acts"), grounds.alias("grounding"),
        F.size(F.filter(said, lambda s: T.is_proposition(s["sentence"], T.dialogue_acts(s["sentence"])))).alias("n_propositions"),
    )


def evidence_chain(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """(row_id, level, kind, value): the source of each selected message, what is observed in it, and what is measured from it."""
    rows = messages.join(selected.select("row_id").distinct(), "row_id")
    said = F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("_i", "_s")
    spoken = rows.select("row_id", said).select("row_id", F.col("_s.sentence").alias("_t"))
    row = lambda df, level, kind, value: df.select("row_id", F.lit(level).alias("level"), kind.alias("kind"), value.alias("value"))
    source = row(rows, "L0", F.lit("text_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256))
    acts = spoken.select("row_id", F.explode(T.dialogue_acts(F.col("_t"))).alias("_a"))
    observed = row(acts, "L1", F.lit("dialogue_act"), F.col("_a"))
    ground = spoken.select("row_id", T.grounding(F.col("_t")).alias("_g")).where("_g IS NOT NULL")
    measured = acts.groupBy("row_id").agg(F.count(F.lit(1)).cast("string").alias("_n"))
    return source.unionByName(observed).unionByName(row(ground, "L1", F.lit("grounding"), F.col("_g"))).unionByName(row(measured, "L2", F.lit("n_acts"), F.col("_n")))


def comparison_cases(annotations: DataFrame, selected: DataFrame, top: int = 3) -> DataFrame:
    """(selected, side, annotation, label, confidence, place): ``top`` annotations that share a label with the selected object, and the
    hardest that don't: those of highest confidence.

    ``annotations`` hold object, annotation, label and confidence. Candidates of each side come from the first ``4 * top`` rows
    of each label, so no selected object meets all annotations; there may be ``MAX_LABELS`` labels, more are an error.
    """
    if annotations.select("label").distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    order = [F.desc("confidence"), F.col("annotation")]
    best = annotations.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("_r") <= 4 * top)
    mine = annotations.join(selected.select(F.col("row_id").alias("object")).distinct(), "object").groupBy(F.col("object").alias("selected")).agg(F.collect_set("label").alias("_labels"))
    pairs = mine.join(F.broadcast(best.select("object", "annotation", "label", "confidence")), F.col("selected") != F.col("object"))
    sided = pairs.withColumn("side", F.when(F.array_contains("_labels", F.col("label")), "supporting").otherwise("hard_negative"))
    ranked = sided.withColumn("place", F.row_number().over(Window.partitionBy("selected", "side").orderBy(*order)))
    return ranked.where(F.col("place") <= top).select("selected", "side", "annotation", "label", "confidence", "place")


def search_before(messages: DataFrame, anchors: DataFrame, words: list[str], top: int = 10) -> DataFrame:
    """(anchor, row_id, place): messages of the anchor's conversation up to its time, not itself, that hold any of the words; latest first."""
    anchor = messages.join(anchors.select("row_id").distinct(), "row_id").select(F.col("row_id").alias("anchor"), "conversation_id", F.col("sent_at").alias("_until"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("text").contains(w.lower())
    rows = messages.where(hit & F.col("sent_at").isNotNull()).select("conversation_id", "row_id", "sent_at")
    pairs = rows.join(anchor, "conversation_id").where((F.col("sent_at") <= F.col("_until")) & (F.col("row_id") != F.col("anchor")))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("sent_at"), F.desc("row_id")))
    return pairs.withColumn("place", place).where(F.col("place") <= top).select("anchor", "row_id", "place")
