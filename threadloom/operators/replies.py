"""What replies tell: latency, reciprocity, survival, style accommodation, event history and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.participation import nearest_rank_by_count
from threadloom.operators.running import hour_of, running_sum
from threadloom.session import stage

MAX_LATENCY_MINUTES = 30 * 24 * 60


def reply_events(messages: DataFrame, columns: tuple[str, ...] = ("sender", "sent_at")) -> DataFrame:
    """(conversation_id, source, target, source_…, target_…): messages joined with the message they reply to.

    ``messages`` hold one row per message with row_id, conversation_id, external_id, reply and ``columns``.
    """
    source = messages.where(F.col("reply") != "").select(
        "conversation_id", F.col("row_id").alias("source"), "reply", *[F.col(c).alias(f"source_{c}") for c in columns]
    )
    target = messages.select(
        F.col("conversation_id").alias("_c"), F.col("external_id").alias("_e"), F.col("row_id").alias("target"),
        *[F.col(c).alias(f"target_{c}") for c in columns],
    )
    return source.join(target, (F.col("conversation_id") == F.col("_c")) & (F.col("reply") == F.col("_e"))).drop("_c", "_e", "reply")


def latency_minutes(events: DataFrame) -> DataFrame:
    """``events`` with ``latency``: minutes from target to reply, null outside 0 … 30 days."""
    minutes = (F.unix_micros("source_sent_at") - F.unix_micros("target_sent_at")) / 60_000_000
    return events.withColumn("latency", F.when(minutes.between(0, MAX_LATENCY_MINUTES), minutes))


def reply_structure(messages: DataFrame, events: DataFrame) -> DataFrame:
    """One row: messages, reply marks, resolved and missing targets, and latency quantiles in minutes."""
    counts = messages.agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("reply") != "").alias("n_marked"))
    timed = latency_minutes(events)
    found = timed.agg(F.count(F.lit(1)).alias("n_resolved"), F.count("latency").alias("n_timed"))
    ranks = nearest_rank_by_count(timed, "latency", {"p50_minutes": 0.5, "p90_minutes": 0.9})
    return (
        counts.crossJoin(F.broadcast(found))
        .join(F.broadcast(ranks), F.lit(True), "left")
        .withColumn("n_missing", F.col("n_marked") - F.col("n_resolved"))
    )


def reciprocity(events: DataFrame) -> DataFrame:
    """One row: reciprocated and all replies between different known senders, and their ratio."""
    pairs = (
        events.where(F.col("source_sender") != F.col("target_sender"))
        .groupBy(F.col("source_sender").alias("a"), F.col("target_sender").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.sum("n").alias("_all"), F.when(F.count(F.lit(1)) == 2, 2 * F.min("n")).otherwise(0).alias("_mutual")
    )
    return both.agg(
        F.coalesce(F.sum("_mutual"), F.lit(0)).alias("reciprocated"), F.coalesce(F.sum("_all"), F.lit(0)).alias("replies")
    ).withColumn("reciprocity", F.when(F.col("replies") > 0, F.col("reciprocated") / F.col("replies")))


def first_reply_durations(messages: DataFrame, events: DataFrame) -> DataFrame:
    """(row_id, minutes, replied): time to the first reply, else to the conversation's last message."""
    ends = messages.groupBy("conversation_id").agg(F.max("sent_at").alias("_end"))
    firsts = events.groupBy(F.col("target").alias("row_id")).agg(F.min("source_sent_at").alias("_first"))
    minutes = lambda c: (F.unix_micros(c) - F.unix_micros("sent_at")) / 60_000_000
    return (
        messages.where(F.col("sent_at").isNotNull())
        .select("row_id", "conversation_id", "sent_at")
        .join(firsts, "row_id", "left")
        .join(ends, "conversation_id")
        .select(
            "row_id",
            F.greatest(minutes(F.coalesce("_first", "_end")), F.lit(0.0)).alias("minutes"),
            F.col("_first").isNotNull().alias("replied"),
        )
    )


def kaplan_meier(durations: DataFrame, time: str = "minutes", observed: str = "replied") -> DataFrame:
    """(time, at_risk, events, censored, survival) at every distinct time.

    Times are counted before they are ordered, in steps of a whole unit. Numbers at risk come from a running
    sum of the counts and the product from a running sum of logarithms, with an exact zero once all at risk
    have an event.
    """
    counts = durations.where(F.col(time).isNotNull()).groupBy(time).agg(
        F.count_if(F.col(observed)).alias("events"), F.count_if(~F.col(observed)).alias("censored")
    )
    n = F.col("events") + F.col("censored")
    minute = F.floor(F.col(time))
    # At risk: all that lasted at least as long, which is a running sum from the longest time.
    rows = running_sum(counts, [], -minute, [F.desc(time)], n, "at_risk")
    ends = F.col("events") == F.col("at_risk")
    log = F.when(~ends, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0))
    rows = running_sum(rows, [], minute, [time], log, "_log")
    # Only at the longest time can all at risk have an event.
    return rows.select(time, "at_risk", "events", "censored", F.when(ends, 0.0).otherwise(F.exp("_log")).alias("survival"))


def coordination(messages: DataFrame, events: DataFrame) -> DataFrame:
    """(initiator, responder, n, delta, lower, upper): style accommodation of replies.

    The similarity of a reply's style to its target's, less that of the responder's mean style, averaged
    over each ordered pair of different senders. ``events`` carry source and target sender and text.
    """
    rates = ["r0", "r1", "r2", "r3", "r4", "r5"]
    styled = messages.where(F.col("sender").isNotNull() & (F.col("text") != "")).select("sender", T.style(F.col("text")).alias("_s"))
    means = styled.groupBy("sender").agg(*[F.avg(F.col("_s")[i]).alias(r) for i, r in enumerate(rates)])
    base = means.select(F.col("sender").alias("source_sender"), F.array(*rates).alias("_base"))
    pairs = (
        events.where(F.col("source_sender") != F.col("target_sender"))
        .select("source_sender", "target_sender", T.style(F.coalesce("source_text", F.lit(""))).alias("_r"), T.style(F.coalesce("target_text", F.lit(""))).alias("_t"))
        .join(base, "source_sender")
        .withColumn("_d", T.style_similarity(F.col("_t"), F.col("_r")) - T.style_similarity(F.col("_t"), F.col("_base")))
    )
    se = F.when(F.count(F.lit(1)) > 1, F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).otherwise(0.0)
    return (
        pairs.groupBy(F.col("target_sender").alias("initiator"), F.col("source_sender").alias("responder"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("delta"), se.alias("_se"))
        .select("initiator", "responder", "n", "delta", (F.col("delta") - 1.96 * F.col("_se")).alias("lower"), (F.col("delta") + 1.96 * F.col("_se")).alias("upper"))
    )


def choice_features(messages: DataFrame, events: DataFrame) -> DataFrame:
    """(source, candidate, chosen, repetition, reciprocity, popularity, recency) of every informative reply.

    The candidates of a reply are the other senders of its conversation; a reply is informative when its
    receiver is one of at least two. Features are counts over all earlier replies (log1p), and the decay
    exp(−hours/24) since the sender last replied to the candidate. Replies count in order of time, then of
    source. Candidates are joined by conversation, which is what the risk set is; every history is a running
    count over one ordered pair or one receiver.
    """
    known = events.where(F.col("source_sender").isNotNull() & F.col("target_sender").isNotNull())
    people = messages.where(F.col("sender").isNotNull()).select("conversation_id", F.col("sender").alias("candidate")).distinct()
    sets = (
        known.select("conversation_id", "source", "source_sender", "target_sender", "source_sent_at")
        .join(people, "conversation_id")
        .where(F.col("candidate") != F.col("source_sender"))
    )
    risk = Window.partitionBy("source")
    sets = (
        sets.withColumn("_k", F.count(F.lit(1)).over(risk))
        .withColumn("_in", F.max((F.col("candidate") == F.col("target_sender")).cast("int")).over(risk))
        .where((F.col("_k") > 1) & (F.col("_in") == 1))
    )
    asked = sets.select(
        "source", "candidate", "source_sender", F.col("source_sent_at").alias("at"), (F.col("candidate") == F.col("target_sender")).alias("chosen")
    )

    def history(pair_from: str | None, pair_to: str, name: str) -> DataFrame:
        """Earlier replies from ``pair_from`` to ``pair_to`` (anyone if None), and the time of the last."""
        keys = [F.col(pair_to).alias("_to"), *([F.col(pair_from).alias("_from")] if pair_from else [])]
        happened = known.select(
            F.col("target_sender").alias("_to"), *([F.col("source_sender").alias("_from")] if pair_from else []),
            F.col("source_sent_at").alias("at"), "source", F.lit(None).cast("string").alias("candidate"), F.lit(1).alias("_hit"),
        )
        wanted = asked.select(*keys, "at", "source", "candidate", F.lit(0).alias("_hit"))
        # A question stands before the reply itself, so it sees strictly earlier replies only.
        rows = happened.unionByName(wanted)
        if pair_from is None:
            # Everybody may write to one receiver: counts run over hours, so that no receiver is ordered by one task.
            rows = running_sum(rows, ["_to"], hour_of("at"), ["at", "source", "_hit"], F.col("_hit").cast("long"), name).withColumn(f"{name}_at", F.col("at"))
        else:
            order = Window.partitionBy("_to", "_from").orderBy("at", "source", "_hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = rows.withColumn(name, F.sum("_hit").over(order)).withColumn(f"{name}_at", F.max(F.when(F.col("_hit") == 1, F.col("at"))).over(order))
        return rows.where(F.col("_hit") == 0).select("source", "candidate", name, f"{name}_at")

    both = asked.join(history("source_sender", "candidate", "_rep"), ["source", "candidate"])
    both = both.join(history("candidate", "source_sender", "_rec"), ["source", "candidate"])
    both = both.join(history(None, "candidate", "_pop"), ["source", "candidate"])
    hours = (F.unix_micros("at") - F.unix_micros("_rep_at")) / 3_600_000_000
    return both.select(
        "source",
        "candidate",
        "chosen",
        F.log1p("_rep").alias("repetition"),
        F.log1p("_rec").alias("reciprocity"),
        F.log1p("_pop").alias("popularity"),
        F.when(hours >= 0, F.exp(-hours / 24)).otherwise(0.0).alias("recency"),
    )


def _norm(words: Column, terms: Column) -> Column:
    """Length of the vector of term counts."""
    times = lambda term: F.size(F.filter(words, lambda w: w == term)).cast("double")
    return F.sqrt(F.when(F.size(words) == F.size(terms), F.size(terms).cast("double")).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + times(t) * times(t))))


def response_candidates(messages: DataFrame, window: int = 40, horizon_hours: int = 8, keep: int = 5) -> DataFrame:
    """(source, target, score, rank, source_native, eligible, reason): ranked candidates a message may answer.

    Candidates are the ``window`` latest non-empty earlier messages of the conversation within the horizon,
    and the message its reply link names. They rank by the cosine of their token counts, later ones first on
    ties, then by row id; the linked one is kept as the last if it ranks below ``keep``. Order is by time,
    then row id; empty messages are ranked for but never candidates. A message is joined with its 40
    predecessors by numbering them, in blocks of 40 so that both sides meet on (conversation, block); the numbered
    messages are staged, as both sides are made of them.
    """
    filled = F.coalesce(F.trim(F.col("text")) != "", F.lit(False))
    base = messages.where(F.col("sent_at").isNotNull()).select(
        "conversation_id", "row_id", "external_id", "reply", "sent_at", filled.alias("_filled"),
        T.tokens(F.coalesce("text", F.lit("")), 2).alias("_tokens"),
    )
    # Terms as numbers; their repetitions stay behind where no term of a message occurs twice, which is the rule.
    hashed = F.transform("_tokens", lambda t: F.xxhash64(t))
    base = base.withColumn("_tokens", hashed).withColumn("_terms", F.array_distinct("_tokens")).withColumn("_norm", _norm(F.col("_tokens"), F.col("_terms")))
    base = base.withColumn("_tokens", F.when(F.size("_tokens") > F.size("_terms"), F.col("_tokens")))
    counted = running_sum(base, ["conversation_id"], hour_of("sent_at"), ["sent_at", "row_id"], F.col("_filled").cast("long"), "_upto")
    counted = stage(counted.withColumn("_before", F.col("_upto") - F.col("_filled").cast("long")).drop("_upto"))
    source = counted.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(F.col("_before") - window, F.lit(0)) / window), F.floor(F.greatest(F.col("_before") - 1, F.lit(0)) / window))))
    target = counted.where("_filled").select(
        F.col("conversation_id").alias("_c"), F.col("row_id").alias("target"), F.col("external_id").alias("_e"), F.col("sent_at").alias("_t"),
        F.col("_tokens").alias("_words"), F.col("_terms").alias("_other"), F.col("_norm").alias("_size"), F.col("_before").alias("_k"), F.floor(F.col("_before") / window).alias("_b"),
    )
    within = (
        (F.col("_k") < F.col("_before"))
        & (F.col("_k") >= F.col("_before") - window)
        & (F.unix_micros("_t") >= F.unix_micros("sent_at") - horizon_hours * 3_600_000_000)
    )
    near = source.join(target, (F.col("conversation_id") == F.col("_c")) & (F.col("_block") == F.col("_b"))).where(within).drop("_block")
    linked = counted.where(F.col("reply") != "").join(
        target, (F.col("conversation_id") == F.col("_c")) & (F.col("reply") == F.col("_e")) & (F.col("row_id") != F.col("target"))
    )
    pairs = near.unionByName(linked.where(~within))
    times = lambda words, term: F.when(words.isNull(), 1.0).otherwise(F.size(F.filter(words, lambda w: w == term)).cast("double"))
    shared = F.array_intersect("_terms", "_other")
    repeated = F.aggregate(shared, F.lit(0.0), lambda s, t: s + times(F.col("_tokens"), t) * times(F.col("_words"), t))
    dot = F.when(F.col("_tokens").isNull() & F.col("_words").isNull(), F.size(shared).cast("double")).otherwise(repeated)
    size = F.col("_norm") * F.col("_size")
    scored = pairs.select(
        F.col("row_id").alias("source"),
        "target",
        F.round(F.when(size > 0, dot / size).otherwise(0.0), 9).alias("score"),
        F.coalesce(F.col("_e") == F.col("reply"), F.lit(False)).alias("source_native"),
        (F.coalesce(F.col("reply"), F.lit("")) != "").alias("_has"),
        "_t",
    )
    best = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("_t"), "target")
    ranked = scored.withColumn("_rank", F.row_number().over(best)).withColumn(
        "_below", F.max(F.when(F.col("source_native") & (F.col("_rank") > keep), 1).otherwise(0)).over(Window.partitionBy("source"))
    )
    kept = ranked.where(
        F.when(F.col("_below") == 1, (F.col("_rank") < keep) | F.col("source_native")).otherwise(F.col("_rank") <= keep)
    ).withColumn("rank", F.least(F.col("_rank"), F.lit(keep)))
    reason = (
        F.when(F.col("_has") & F.col("source_native"), "source_native_reply_target")
        .when(F.col("_has"), "source_native_reply_target_takes_precedence")
        .when(F.col("rank") != 1, "only_rank_1_is_relation_eligible")
        .when(F.col("score") < 0.15, "lexical_similarity_below_0.15")
        .otherwise("rank_1_lexical_similarity_at_least_0.15")
    )
    eligible = F.when(F.col("_has"), F.col("source_native")).otherwise((F.col("rank") == 1) & (F.col("score") >= 0.15))
    return kept.select("source", "target", "score", "rank", "source_native", eligible.alias("eligible"), reason.alias("reason"))
