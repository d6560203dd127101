"""Annotation sets: drawing units over strata, agreement between slots, signatures of judgments, and task evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.sampling import priority


def is_difficult(text: Column, reply: Column) -> Column:
    """An explicit reply, a question, more than 180 characters or more than one full stop."""
    text = F.coalesce(text, F.lit(""))
    return (F.coalesce(reply, F.lit("")) != "") | text.contains("?") | (F.length(text) > 180) | (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) > 1)


def strata(messages: DataFrame, episodes: DataFrame, chats: DataFrame) -> DataFrame:
    """One row per message with its eleven strata: quarter, conversation, participant, size of episode, reply, length, question,
    several sentences, the first rare cue, platform and goal."""
    size = episodes.groupBy("conversation_id", "episode_no").agg(F.count(F.lit(1)).alias("_size"))
    sized = episodes.join(size, ["conversation_id", "episode_no"]).select("row_id", "_size")
    known = chats.select("conversation_id", "platform", "goal").dropDuplicates(["conversation_id"])
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    bucket = lambda v, low, high: F.when(v < low, "short").when(v < high, "medium").otherwise("long")
    rows = messages.join(sized, "row_id", "left").join(known, "conversation_id", "left")
    return rows.select(
        "row_id",
        F.concat(F.year("sent_at").cast("string"), F.lit("-Q"), F.quarter("sent_at").cast("string")).alias("time_period"),
        "conversation_id", F.coalesce("sender", F.lit("UNRESOLVED")).alias("participant"),
        F.when(F.coalesce("_size", F.lit(0)) < 10, "small").when(F.col("_size") < 50, "medium").otherwise("large").alias("episode_size"),
        (F.coalesce("reply", F.lit("")) != "").alias("has_reply"), bucket(n, 60, 180).alias("length"), text.contains("?").alias("question"),
        (F.size(T.sentences(text)) > 1).alias("several"), T.rare_cue(text).alias("rare"), "platform", "goal",
    )


STRATA = ["time_period", "conversation_id", "participant", "episode_size", "has_reply", "length", "question", "several", "rare", "platform", "goal"]


def draw_units(units: DataFrame, size: int, seed: str, per_bucket: int = 2) -> DataFrame:
    """(row_id, depth, place): ``size`` units, at first up to ``per_bucket`` of each combination of strata in turn, then the lowest hashes.

    Priorities are hashes of seed and id, buckets follow one another by their own hash. Every unit is weighed; of the units
    only the lowest ``size`` hashes of the rest are ordered as a whole.
    """
    bucket = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STRATA])
    rows = units.select("row_id", bucket.alias("_bucket"), priority(seed, F.col("row_id").cast("string")).alias("_p"))
    order = Window.partitionBy("_bucket").orderBy("_p", "row_id")
    ranked = rows.withColumn("depth", F.row_number().over(order))
    inside = ranked.where(F.col("depth") <= per_bucket).select("row_id", "depth", priority(seed, F.col("_bucket")).alias("_o"), F.lit(0).alias("_late"))
    rest = ranked.where(F.col("depth") > per_bucket).select("row_id", F.lit(per_bucket + 1).alias("depth"), F.col("_p").alias("_o"), F.lit(1).alias("_late"))
    chosen = inside.unionByName(rest).orderBy("_late", "depth", "_o", "row_id").limit(size)
    place = F.row_number().over(Window.orderBy("_late", "depth", "_o", "row_id"))
    return chosen.withColumn("place", place).select("row_id", "depth", "place")


def legacy_draw(messages: DataFrame, size: int, seed: str) -> DataFrame:
    """(row_id, difficult, place): half difficult and half routine messages by the lowest hashes, filled up from all."""
    p = priority(seed, F.col("row_id").cast("string"))
    rows = messages.select("row_id", is_difficult(F.col("text"), F.col("reply")).alias("difficult"), p.alias("_p"))
    low = lambda df, n: df.orderBy("_p", "row_id").limit(n)
    halves = low(rows.where("difficult"), size // 2).unionByName(low(rows.where("NOT difficult"), size // 2)).withColumn("_late", F.lit(0))
    # Of all rows the lowest 2 * size hashes hold what is left to fill up with, since the halves take at most size of them.
    more = low(rows, 2 * size).join(halves.select("row_id"), "row_id", "left_anti").withColumn("_late", F.lit(1))
    chosen = halves.unionByName(more).orderBy("_late", "_p", "row_id").limit(size)
    return chosen.select("row_id", "difficult", F.row_number().over(Window.orderBy("_late", "_p", "row_id")).alias("place"))


def judgment_signatures(judgments: DataFrame) -> DataFrame:
    """(unit_id, task, slot, status, signature): the last judgment of each slot with its labels, normalised and sorted, as one string."""
    label = F.upper(F.trim("label"))
    last = judgments.where("unit_id IS NOT NULL AND task IS NOT NULL AND slot IS NOT NULL").withColumn(
        "_r", F.row_number().over(Window.partitionBy("unit_id", "task", "slot").orderBy(F.col("submitted_at").desc_nulls_last(), F.desc("judgment_id")))
    )
    return last.where("_r = 1").select("unit_id", "task", "slot", "status", F.concat_ws("|", F.coalesce("status", F.lit("")), F.coalesce(label, F.lit(""))).alias("signature"))


def slot_agreement(signed: DataFrame, left: str = "A", right: str = "B") -> DataFrame:
    """(task, comparable, exact, raw_rate): equal signatures of two slots before anything is settled between them."""
    done = signed.where(F.col("status") != "NOT_ANNOTATED")
    a = done.where(F.col("slot") == left).select("unit_id", "task", F.col("signature").alias("_a"))
    b = done.where(F.col("slot") == right).select("unit_id", "task", F.col("signature").alias("_b"))
    both = a.join(b, ["unit_id", "task"]).groupBy("task").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("_a") == F.col("_b")).alias("exact"))
    return both.withColumn("raw_rate", F.col("exact") / F.col("comparable"))


def readiness(judgments: DataFrame, sets: DataFrame) -> DataFrame:
    """(annotation_set_id, total_units, confirmed_units, double_units, target_size, freeze_ready): a unit is confirmed when none of its tasks is open."""
    each = judgments.where("unit_id IS NOT NULL").groupBy("annotation_set_id", "unit_id").agg(
        F.count_if(F.coalesce(F.col("status"), F.lit("NOT_ANNOTATED")) == "NOT_ANNOTATED").alias("_open"), F.count_distinct("slot").alias("_slots")
    )
    units = each.groupBy("annotation_set_id").agg(
        F.count(F.lit(1)).alias("total_units"), F.count_if(F.col("_open") == 0).alias("confirmed_units"), F.count_if(F.col("_slots") > 1).alias("double_units")
    )
    return sets.select("annotation_set_id", "target_size").join(units, "annotation_set_id", "left").select(
        "annotation_set_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_units", "confirmed_units", "double_units")], "target_size",
        F.coalesce((F.col("total_units") > 0) & (F.col("total_units") == F.col("confirmed_units")), F.lit(False)).alias("freeze_ready"),
    )


def confirmed(judgments: DataFrame) -> DataFrame:
    """(unit_id, task, judgment_id, label): judgments that no later one of the same annotator replaces and that give a label."""
    order = Window.partitionBy("unit_id", "task", "annotator").orderBy(F.col("submitted_at").desc_nulls_last(), F.desc("judgment_id"))
    rows = judgments.where("unit_id IS NOT NULL AND task IS NOT NULL AND annotator IS NOT NULL").withColumn("_r", F.row_number().over(order))
    return rows.where("_r = 1 AND status = 'PRESENT' AND label IS NOT NULL").select("unit_id", "task", "judgment_id", F.upper(F.trim("label")).alias("label"))


def annotation_label(value: Column, kind: Column) -> Column:
    """The first of label, position, type and text in a JSON value that isn't empty, else the kind."""
    field = lambda name: F.nullif(F.get_json_object(value, f"$.{name}"), F.lit(""))
    return F.coalesce(field("label"), field("position"), field("type"), field("text"), kind)


def valid_span(start: Column, end: Column, text: Column) -> Column:
    """Whether 0 ≤ start < end ≤ length of the text."""
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)), F.lit(False))


def parser_faults(rows: DataFrame) -> DataFrame:
    """(key, fault) for analyses that don't rebuild their text: ``rows`` hold key, text and tokens (id, start, end, form, head)."""
    t = F.col("tokens")
    broken = F.exists(t, lambda x: ~valid_span(x["start"], x["end"], F.col("text")) | (F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["form"]))
    ids = F.transform(t, lambda x: x["id"])
    loose = F.exists(t, lambda x: x["head"].isNotNull() & ~F.array_contains(ids, x["head"]))
    faults = F.array(F.when(broken, F.lit("offsets")), F.when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("ids")), F.when(loose, F.lit("heads")))
    return rows.select("key", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def evaluate_tasks(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(task, tp, fp, fn, skipped, absent_right, absent_total, precision, recall, f1): predictions against judgments, per task.

    ``gold`` holds unit_id, task, status and label, ``predicted`` unit_id, task and label. Units whose judgment is ABSTAIN are
    skipped; on ABSENT ones every prediction is wrong and none is right. Labels match whatever their case, one to one.
    """
    clean = lambda df: df.withColumn("label", F.upper(F.trim("label")))
    g, p = clean(gold), clean(predicted).select("unit_id", "task", "label").distinct()
    status = g.groupBy("unit_id", "task").agg(F.max(F.when(F.col("status") == "ABSTAIN", 2).when(F.col("status") == "ABSENT", 1).otherwise(0)).alias("_s"))
    present = g.where("status = 'PRESENT' AND label IS NOT NULL").select("unit_id", "task", "label").distinct()
    both = present.withColumn("_g", F.lit(1)).join(p.withColumn("_p", F.lit(1)), ["unit_id", "task", "label"], "full").join(status, ["unit_id", "task"])
    used = both.where("_s < 2")
    has_g, has_p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    counts = used.groupBy("task").agg(F.count_if(has_g & has_p).alias("tp"), F.count_if(~has_g & has_p).alias("fp"), F.count_if(has_g & ~has_p).alias("fn"))
    guessed = p.select("unit_id", "task").distinct().withColumn("_any", F.lit(1))
    absent = status.join(guessed, ["unit_id", "task"], "left").groupBy("task").agg(
        F.count_if(F.col("_s") == 2).alias("skipped"), F.count_if((F.col("_s") == 1) & F.col("_any").isNull()).alias("absent_right"), F.count_if(F.col("_s") == 1).alias("absent_total")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = absent.join(counts, "task", "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("task", "tp", "fp", "fn", "skipped", "absent_right", "absent_total", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
