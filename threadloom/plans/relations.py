"""Queries of the relations between messages: acts, propositions, candidates, discourse, arguments and stances, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import evaluation as E
from threadloom.operators import observations as O
from threadloom.operators import replies as R
from threadloom.plans.analytics import _EV, _M, base
from threadloom.plans.rules import ACTS, ATTACKS, CANDIDATES, COMMITMENT, COMPONENT, DISCOURSE, GROUNDING, SUPPORTS, acts, said
from threadloom.session import cut
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


@query(f"""WITH {_M}, a AS (SELECT row_id, list_filter([{ACTS}], lambda x: x IS NOT NULL) AS x FROM m WHERE text IS NOT NULL AND text <> '')
SELECT row_id, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['ASSERT'] END) AS act FROM a""")
def dialogue_acts(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["text"]).where(F.col("text") != "")
    return rows.select("row_id", F.explode(T.dialogue_acts(F.col("text"))).alias("act"))


@query(f"""WITH {_M} SELECT row_id, {GROUNDING} AS label, {COMMITMENT} AS commitment FROM m WHERE text IS NOT NULL AND text <> ''""")
def grounding_labels(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return base(spark, d, ["text"]).where(text != "").select("row_id", T.grounding(text).alias("label"), T.commitment(text).alias("commitment"))


@query(f"""WITH {_M}, {said()} SELECT row_id, ordinal::INT AS ordinal, body AS proposition, {COMPONENT} AS component FROM said""")
def propositions(spark: SparkSession, d: str) -> DataFrame:
    return O.propositions(base(spark, d, ["text"])).select("row_id", "ordinal", "proposition", "component")


@query(f"""WITH {_M}, {said()} SELECT sender, body AS proposition, row_id, ordinal::INT AS ordinal FROM said JOIN m USING (row_id) WHERE sender IS NOT NULL""")
def proposition_senders(spark: SparkSession, d: str) -> DataFrame:
    """Every proposition with the sender of its message."""
    rows = base(spark, d, ["text", "sender"])
    return O.propositions(rows).select("row_id", "ordinal", "proposition").join(rows.where("sender IS NOT NULL").select("row_id", "sender"), "row_id")


@query(rf"""WITH {_M}, w AS (SELECT row_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+|[^\p{{L}}\p{{N}}_\s]') AS w FROM m WHERE text IS NOT NULL)
SELECT row_id, len(list_filter(w, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}_-]+$')))::INT AS n_tokens,
  len(list_filter(w, lambda x: x IN ('мочь', 'должный', 'нужно', 'необходимо', 'следовать', 'хотеть', 'возможно', 'вероятно')))::INT AS n_modals, len(list_filter(w, lambda x: x IN ('не', 'ни')))::INT AS n_negations,
  len(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('не', 'ни') AND len(list_filter(w[i + 1:i + 3], lambda y: regexp_matches(y, '^[\p{{L}}\p{{N}}_-]+$'))) > 0))::INT AS n_governed FROM w""")
def linguistic_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.linguistic_counts(base(spark, d, ["text"]))


@query(f"WITH {_M}, {CANDIDATES} SELECT source, target, score, rank, source_native, eligible, reason FROM cand")
def response_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.response_candidates(base(spark, d))


@query(f"""WITH {_M}, {CANDIDATES} SELECT source, list(struct_pack(target := target, score := score) ORDER BY rank, target) AS alternatives, count(*) FILTER (eligible)::BIGINT AS n_eligible,
  arg_min(reason, rank) AS decision FROM cand GROUP BY source""")
def candidate_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the array of its ranked candidates and why the first is eligible or not."""
    rows = R.response_candidates(base(spark, d))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "target", "score")))
    return rows.groupBy("source").agg(
        F.transform(ranked, lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"))).alias("alternatives"),
        F.count_if("eligible").alias("n_eligible"),
        F.min_by("reason", "rank").alias("decision"),
    )


@query(f"WITH {_M}, {CANDIDATES}, {DISCOURSE} SELECT source, target, label FROM disc")
def discourse_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d)
    return O.discourse(rows, cut(R.response_candidates(rows)))


_PAIRS = f"""{said()}, sn AS (SELECT row_id, count(*) AS n FROM said GROUP BY row_id),
pp AS (SELECT DISTINCT source, target FROM cand WHERE source_native OR reason = 'rank_1_lexical_similarity_at_least_0.15'),
pq AS (SELECT source, a.ordinal AS source_ordinal, target, b.ordinal AS target_ordinal, a.body, x.n = 1 AND y.n = 1 AS eligible FROM pp
  JOIN said a ON a.row_id = source JOIN said b ON b.row_id = target JOIN sn x ON x.row_id = source JOIN sn y ON y.row_id = target)"""
_RELATIONS = f"""rel AS (SELECT pq.source, pq.target, CASE WHEN {ATTACKS} OR coalesce(list_has_any(l, ['REJECTS', 'CORRECTS', 'CONTRASTS']), false) THEN 'ATTACKS'
  WHEN {SUPPORTS} OR coalesce(list_has_any(l, ['ACCEPTS', 'ANSWERS', 'ELABORATES']), false) THEN 'SUPPORTS' END AS relation
  FROM pq LEFT JOIN (SELECT source, target, list(label) AS l FROM disc GROUP BY ALL) x ON x.source = pq.source AND x.target = pq.target WHERE eligible)"""


@query(f"WITH {_M}, {CANDIDATES}, {_PAIRS} SELECT source, source_ordinal::INT AS source_ordinal, target, target_ordinal::INT AS target_ordinal, eligible FROM pq")
def proposition_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Up to five propositions of a message with up to five of the one it answers."""
    rows = base(spark, d)
    return O.proposition_pairs(rows, R.response_candidates(rows)).drop("source_text")


@query(f"WITH {_M}, {CANDIDATES}, {DISCOURSE}, {_PAIRS}, {_RELATIONS} SELECT source, target, relation FROM rel WHERE relation IS NOT NULL")
def argument_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d)
    return O.argument_relations(rows, cut(R.response_candidates(rows)))


@query(f"""WITH {_M}, {CANDIDATES}, {DISCOURSE}, {_PAIRS}, {_RELATIONS} SELECT s.sender AS source_sender, t.sender AS target_sender, relation, count(*)::BIGINT AS n
FROM rel JOIN m s ON s.row_id = source JOIN m t ON t.row_id = target WHERE relation IS NOT NULL AND s.sender IS NOT NULL AND t.sender IS NOT NULL GROUP BY ALL""")
def argument_layers(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the support and attack layers between the senders of propositions."""
    rows = base(spark, d)
    relations = O.argument_relations(rows, cut(R.response_candidates(rows)))
    who = rows.where("sender IS NOT NULL")
    return (
        relations.join(who.select(F.col("row_id").alias("source"), F.col("sender").alias("source_sender")), "source")
        .join(who.select(F.col("row_id").alias("target"), F.col("sender").alias("target_sender")), "target")
        .groupBy("source_sender", "target_sender", "relation")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""WITH {_EV}, {said(most=10**9)}, n AS (SELECT row_id, count(*) AS k FROM said GROUP BY row_id),
x AS (SELECT source, target, source_sender, k, list_filter({acts('source_text')}, lambda x: x IS NOT NULL) AS a FROM ev JOIN n ON n.row_id = target WHERE source_sender IS NOT NULL),
y AS (SELECT *, CASE WHEN list_contains(a, 'AGREE') THEN 'support' WHEN list_contains(a, 'DISAGREE') THEN 'oppose' END AS position FROM x)
SELECT source, target, source_sender AS holder, position, CASE WHEN position = 'support' THEN 0.8 ELSE -0.8 END::DOUBLE AS strength, CASE WHEN k = 1 THEN 'RESOLVED' ELSE 'ABSTAIN' END AS status,
  k::BIGINT AS n_alternatives, 1.0::DOUBLE / k AS weight FROM y WHERE position IS NOT NULL""")
def stance_from_replies(spark: SparkSession, d: str) -> DataFrame:
    """Support (0.8) or opposition (-0.8) of a reply to the one proposition of its target; of several each has an equal weight and none is chosen."""
    ev = R.reply_events(base(spark, d, ["sender", "reply", "text"]), ("sender", "text")).where(F.col("source_sender").isNotNull())
    spoken = T.sentences(F.coalesce("target_text", F.lit("")))
    count = F.size(F.filter(spoken, lambda s: T.is_proposition(s["sentence"], T.dialogue_acts(s["sentence"]))))
    kinds = T.dialogue_acts(F.coalesce("source_text", F.lit("")))
    side = F.when(F.array_contains(kinds, "AGREE"), "support").when(F.array_contains(kinds, "DISAGREE"), "oppose")
    rows = ev.select("source", "target", F.col("source_sender").alias("holder"), side.alias("position"), count.cast("long").alias("n_alternatives"))
    return rows.where("position IS NOT NULL AND n_alternatives > 0").select(
        "source", "target", "holder", "position", F.when(F.col("position") == "support", 0.8).otherwise(-0.8).alias("strength"),
        F.when(F.col("n_alternatives") == 1, "RESOLVED").otherwise("ABSTAIN").alias("status"), "n_alternatives", (1 / F.col("n_alternatives")).alias("weight"),
    )


@query(f"""WITH {_EV}, {CANDIDATES}, g AS (SELECT DISTINCT source, target FROM ev), h AS (SELECT g.source, g.target, c.rank AS r FROM g LEFT JOIN cand c ON c.source = g.source AND c.target = g.target),
q AS (SELECT source, count(*) AS n, count(r) AS k, min(r) AS first FROM h GROUP BY source)
SELECT sum(n)::BIGINT AS n_gold, sum(k) / sum(n) AS recall, avg(coalesce(1.0 / first, 0))::DOUBLE AS mrr, count(*) FILTER (source IN (SELECT source FROM cand)) / count(*) AS coverage FROM q""")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of the response candidates against the reply links that the messages carry."""
    rows = base(spark, d)
    gold = R.reply_events(rows).select("source", "target")
    return E.ranking_metrics(gold, cut(R.response_candidates(rows)), "source", "target")


@query(f"""WITH {_EV}, {CANDIDATES}, g AS (SELECT DISTINCT source, target FROM ev), p AS (SELECT DISTINCT source, target FROM cand WHERE rank = 1),
x AS (SELECT (SELECT count(*) FROM g SEMI JOIN p USING (source, target)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (source, target)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (source, target)) AS fn)
SELECT unnest(['REPLIES_TO', 'MICRO', 'MACRO']) AS label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM x""")
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the best candidate of each message against the links that messages carry."""
    rows = base(spark, d)
    gold = R.reply_events(rows).select("source", "target", F.lit("REPLIES_TO").alias("label"))
    best = R.response_candidates(rows).where("rank = 1").select("source", "target", F.lit("REPLIES_TO").alias("label"))
    return E.precision_recall(gold, best, ["source", "target"], "label")


@query(r"""WITH a AS (SELECT evidence_id, regexp_replace(regexp_replace(text, '(?i)https?://\S+', '[REDACTED]', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g') AS t FROM evidence_items),
b AS (SELECT evidence_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])(\+?\p{Nd}[\p{Nd} ()-]{7,}\p{Nd})([^\p{L}\p{N}_]|$)', '\1[REDACTED]\3', 'g') AS t FROM a),
c AS (SELECT evidence_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])@[A-Za-z0-9_]{3,}', '\1[REDACTED]', 'g') AS redacted FROM b)
SELECT evidence_id, redacted, ((length(redacted) - length(replace(redacted, '[REDACTED]', ''))) / 10)::INT AS n_redactions FROM c""")
def evidence_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Texts before they leave: pages, mailboxes, telephone numbers and handles replaced, and how many."""
    return table(spark, d, "evidence_items").select("evidence_id", T.redact(F.col("text")).alias("redacted"), T.n_redactions(F.col("text")).alias("n_redactions"))
