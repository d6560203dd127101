"""Observations on messages and pairs of messages: sequences, discourse, arguments, mentions, theme changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import lexicon as L
from threadloom.functions import text as T
from threadloom.operators.running import row_numbers
from threadloom.session import stage

# Personal pronouns of the third person.
PRONOUNS = ["он", "она", "они", "оно", "его", "её", "их", "ему", "ей", "им"]


def act_sequences(messages: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5), top: int | None = 30) -> DataFrame:
    """(size, pattern, n): runs of first dialogue acts of neighbouring messages of a conversation.

    Each message goes to the runs that it can belong to, keyed by conversation, size and place of the
    first, so a long conversation is no large group. With ``top`` only the most frequent of each size stay.
    """
    rows = messages.where(F.col("text") != "").select("conversation_id", "row_id", "sent_at", F.element_at(T.dialogue_acts(F.col("text")), 1).alias("act"))
    numbered = row_numbers(rows, ["conversation_id"], "sent_at", "row_id", "i").select("conversation_id", "i", "act")
    each = numbered.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn(
        "start", F.explode(F.sequence(F.greatest(F.col("i") - F.col("size") + 1, F.lit(1)), F.col("i")))
    )
    runs = each.groupBy("conversation_id", "size", "start").agg(F.array_sort(F.collect_list(F.struct("i", "act"))).alias("_r")).where(F.size("_r") == F.col("size"))
    counts = runs.select("size", F.array_join(F.transform("_r", lambda x: x["act"]), ">").alias("pattern")).groupBy("size", "pattern").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    order = Window.partitionBy("size").orderBy(F.desc("n"), "pattern")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def discourse_labels(source: Column, target: Column, score: Column) -> Column:
    """Sorted distinct labels of what ``source`` does with ``target``."""
    rules = [F.when(T.has_words(source, words), F.lit(name)) for name, words in L.DISCOURSE.items()]
    answers = F.when(target.contains("?") & ~source.contains("?") & (T.n_words(source) >= 2), F.lit("ANSWERS"))
    elaborates = F.when((score > 0) & (T.n_words(source) > T.n_words(target)), F.lit("ELABORATES"))
    return F.array_sort(F.array_distinct(F.filter(F.array(*rules, answers, elaborates), lambda x: x.isNotNull())))


def discourse(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, target, label): labels of the pairs that are eligible for a relation."""
    text = messages.select("row_id", F.coalesce("text", F.lit("")).alias("_x"))
    pairs = candidates.where("eligible").select("source", "target", "score")
    pairs = pairs.join(text.select(F.col("row_id").alias("source"), F.col("_x").alias("_s")), "source")
    pairs = pairs.join(text.select(F.col("row_id").alias("target"), F.col("_x").alias("_t")), "target")
    return pairs.select("source", "target", F.explode(discourse_labels(F.col("_s"), F.col("_t"), F.col("score"))).alias("label"))


def argument_component(text: Column) -> Column:
    """EVIDENCE before PREMISE before CLAIM."""
    return F.when(T.has_words(text, L.EVIDENCE), "EVIDENCE").when(T.has_words(text, L.PREMISE), "PREMISE").otherwise("CLAIM")


def propositions(messages: DataFrame, most: int = 5) -> DataFrame:
    """(row_id, ordinal, start, end, proposition, component): the first ``most`` sentences of a message that state something."""
    rows = messages.where(F.col("text").isNotNull()).select("row_id", F.posexplode(T.sentences(F.col("text"))).alias("_i", "_s"))
    said = F.col("_s.sentence")
    kept = rows.where(T.is_proposition(said, T.dialogue_acts(said)))
    order = Window.partitionBy("row_id").orderBy("_i")
    return kept.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most).select(
        "row_id", "ordinal", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), said.alias("proposition"), argument_component(said).alias("component")
    )


def proposition_pairs(messages: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """(source, source_ordinal, target, target_ordinal, source_text, eligible): propositions of paired messages, ``most`` by ``most``.

    Only messages of pairs are taken apart, once. Pairs are explicit replies, and candidates of rank 1 from a score of 0.15 of messages without a reply link. Both
    ends must hold one proposition alone for a pair to be eligible.
    """
    own = F.col("reason") == "rank_1_lexical_similarity_at_least_0.15"
    pairs = stage(candidates.where(F.col("source_native") | own).select("source", "target").distinct())
    paired = messages.join(pairs.select(F.explode(F.array("source", "target")).alias("row_id")).distinct(), "row_id", "left_semi")
    said = propositions(paired, most).select("row_id", "ordinal", "proposition")
    said = stage(said.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("row_id"))))
    left = said.select(F.col("row_id").alias("source"), F.col("ordinal").alias("source_ordinal"), F.col("proposition").alias("source_text"), F.col("_n").alias("_ns"))
    right = said.select(F.col("row_id").alias("target"), F.col("ordinal").alias("target_ordinal"), F.col("_n").alias("_nt"))
    return pairs.join(left, "source").join(right, "target").select(
        "source", "source_ordinal", "target", "target_ordinal", "source_text", ((F.col("_ns") == 1) & (F.col("_nt") == 1)).alias("eligible")
    )


def argument_relations(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, target, relation): ATTACKS before SUPPORTS between the single propositions of paired messages."""
    pairs = proposition_pairs(messages, candidates).where("eligible")
    labels = discourse(messages, candidates).groupBy("source", "target").agg(F.collect_set("label").alias("_labels"))
    rows = pairs.join(labels, ["source", "target"], "left").withColumn("_labels", F.coalesce("_labels", F.array().cast("array<string>")))
    text = F.col("source_text")
    among = lambda *names: F.arrays_overlap("_labels", F.array(*map(F.lit, names)))
    relation = F.when(T.has_words(text, L.ATTACK) | among("REJECTS", "CORRECTS", "CONTRASTS"), "ATTACKS").when(
        T.has_words(text, L.SUPPORT) | T.has_words(text, L.PREMISE) | among("ACCEPTS", "ANSWERS", "ELABORATES"), "SUPPORTS"
    )
    return rows.select("source", "target", relation.alias("relation")).where(F.col("relation").isNotNull())


def linguistic_counts(messages: DataFrame) -> DataFrame:
    """(row_id, n_tokens, n_modals, n_negations, n_governed): a negation governs the first word of its next three tokens.

    Tokens are words and single signs; ``n_tokens`` counts words. Lemmas are surface forms.
    """
    pieces = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_-]+|[^\p{L}\p{N}_\s])"), F.lit(1))
    rows = messages.where(F.col("text").isNotNull()).select("row_id", pieces.alias("w"))
    is_word = lambda x: x.rlike(r"^[\p{L}\p{N}_-]+$")
    count = lambda test: F.size(F.filter("w", test))
    governing = F.filter(
        F.sequence(F.lit(1), F.size("w")),
        lambda i: F.element_at("w", i.cast("int")).isin(L.NEGATIONS) & F.exists(F.slice("w", (i + 1).cast("int"), F.lit(3)), is_word),
    )
    return rows.select(
        "row_id", count(is_word).alias("n_tokens"), count(lambda x: x.isin(L.MODALS)).alias("n_modals"), count(lambda x: x.isin(L.NEGATIONS)).alias("n_negations"),
        F.when(F.size("w") > 0, F.size(governing)).otherwise(0).alias("n_governed"),
    )


def mentions(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(row_id, surface, person, basis): names of known people, and pronouns, in messages.

    ``people`` hold person and name. A word of four letters that is part of exactly one person's name stands
    for that person; parts that several share name nobody.
    """
    parts = people.where(F.col("name").isNotNull()).select("person", F.explode(F.array_distinct(T.tokens(F.col("name"), 4))).alias("surface"))
    known = parts.groupBy("surface").agg(F.count_distinct("person").alias("_n"), F.min("person").alias("person"))
    words = messages.where(F.col("text").isNotNull()).select("row_id", F.explode(F.array_distinct(T.tokens(F.col("text"), 2))).alias("surface"))
    named = words.join(known, "surface").select("row_id", "surface", F.when(F.col("_n") == 1, F.col("person")).alias("person"), F.lit("name").alias("basis"))
    pronouns = words.where(F.col("surface").isin(PRONOUNS)).select("row_id", "surface", F.lit(None).cast("string").alias("person"), F.lit("pronoun").alias("basis"))
    return named.unionByName(pronouns)


def coreference(messages: DataFrame, found: DataFrame, reach: int = 40, top: int = 5) -> DataFrame:
    """(row_id, surface, antecedent, antecedent_surface, score, rank): what a mention may refer back to.

    Earlier mentions of the conversation within ``reach`` messages: 0.9 for the same surface, 0.55 for a
    pronoun looking at a name, less distance/200; names don't look at other names. Both sides meet on
    (conversation, block of ``reach`` messages).
    """
    place = row_numbers(messages.select("conversation_id", "row_id", "sent_at"), ["conversation_id"], "sent_at", "row_id", "i")
    rows = found.join(place.select("row_id", "conversation_id", "i"), "row_id")
    left = rows.withColumn("_b", F.explode(F.array(F.floor(F.col("i") / reach), F.floor(F.col("i") / reach) - 1)))
    right = rows.select(
        F.col("conversation_id").alias("_c"), F.floor(F.col("i") / reach).alias("_rb"), F.col("row_id").alias("antecedent"),
        F.col("surface").alias("antecedent_surface"), F.col("basis").alias("_basis"), F.col("i").alias("_j"),
    )
    pairs = left.join(right, (F.col("conversation_id") == F.col("_c")) & (F.col("_b") == F.col("_rb"))).where((F.col("_j") < F.col("i")) & (F.col("i") - F.col("_j") <= reach))
    same = F.when(F.col("surface") == F.col("antecedent_surface"), 0.9).when((F.col("basis") == "pronoun") & (F.col("_basis") == "name"), 0.55)
    scored = pairs.withColumn("_s", same).where(F.col("_s").isNotNull()).withColumn("score", F.round(F.col("_s") - (F.col("i") - F.col("_j")) / 200, 6))
    order = Window.partitionBy("row_id", "surface").orderBy(F.desc("score"), F.desc("_j"), "antecedent_surface")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("row_id", "surface", "antecedent", "antecedent_surface", "score", "rank")


def distinctive_terms(weights: DataFrame, groups: DataFrame, key: str, group: str, top: int = 10) -> DataFrame:
    """(group, place, term, score): terms by c·max(ln((c + 1e-9)/(g + 1e-9)), 0).

    c is a term's mean weight in the group, g in all rows; ``weights`` hold (key, term, weight).
    """
    rows = weights.join(groups.select(key, group), key)
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("_m"))
    total = groups.agg(F.count(F.lit(1)).alias("_all"))
    own = rows.groupBy(group, "term").agg(F.sum("weight").alias("_c")).join(sizes, group)
    every = rows.groupBy("term").agg(F.sum("weight").alias("_g")).crossJoin(F.broadcast(total))
    c, g = F.col("_c") / F.col("_m"), F.col("_g") / F.col("_all")
    scored = own.join(every, "term").select(group, "term", F.round(c * F.greatest(F.log((c + 1e-9) / (g + 1e-9)), F.lit(0.0)), 9).alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(order)).where((F.col("place") <= top) & (F.col("score") > 0)).select(group, "place", "term", "score")


def share_changes(shares: DataFrame, theme: str = "theme", label: str = "month", least_points: int = 4, least_messages: int = 5, top: int = 5) -> DataFrame:
    """(theme, label, log_change, robust_score, persistence): the ``top`` most unusual changes of a theme's share.

    ``shares`` hold theme, label, n and share. The change is ln((share + 1e-4)/(previous + 1e-4)), scored by
    its distance from the theme's median in scaled median deviations; months below ``least_messages`` don't
    count, nor themes with fewer than ``least_points`` months. Persistence is the number of following months,
    this one included, that stay on the same side of the share before.
    """
    order = Window.partitionBy(theme).orderBy(label)
    whole = Window.partitionBy(theme)
    rows = shares.where(F.col("n") >= least_messages).withColumn("_k", F.count(F.lit(1)).over(whole)).where(F.col("_k") >= least_points)
    rows = rows.withColumn("_previous", F.lag("share").over(order)).withColumn("_after", F.collect_list("share").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.where(F.col("_previous").isNotNull()).withColumn("log_change", F.log((F.col("share") + 1e-4) / (F.col("_previous") + 1e-4)))
    center = rows.groupBy(theme).agg(F.median("log_change").alias("_center"))
    rows = rows.join(center, theme)
    spread = rows.groupBy(theme).agg(F.median(F.abs(F.col("log_change") - F.col("_center"))).alias("_mad"))
    away = F.abs(F.col("log_change") - F.col("_center"))
    up = F.col("log_change") > 0
    against = F.filter(F.sequence(F.lit(1), F.size("_after")), lambda i: F.when(up, F.element_at("_after", i) <= F.col("_previous")).otherwise(F.element_at("_after", i) >= F.col("_previous")))
    scored = rows.join(spread, theme).select(
        theme, label, "log_change", F.when(F.col("_mad") > 0, away / (1.4826 * F.col("_mad"))).otherwise(away).alias("robust_score"),
        F.when(F.size(against) > 0, F.element_at(against, 1) - 1).otherwise(F.size("_after")).alias("persistence"),
    )
    return scored.where(F.col("robust_score") >= 2).orderBy(F.desc("robust_score"), theme, label).limit(top)
