"""Queries of the assembled views, annotation sets and layered networks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import annotation as A
from threadloom.operators import assembly as S
from threadloom.operators import evaluation as E
from threadloom.operators import graph as G
from threadloom.operators import networks as N
from threadloom.operators import replies as R
from threadloom.operators import retrieval as Q
from threadloom.operators.sessions import episode_messages as episodes_of
from threadloom.operators.sessions import sessionize
from threadloom.plans.analytics import _EV, _M, base
from threadloom.plans.rules import CANDIDATES, DISCOURSE, RARE, acknowledged, acts, sentences, word
from threadloom.session import cut, stage
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


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "participants").select(F.col("external_id").alias("person"), F.col("display_name").alias("name"))


_EP = """eg AS (SELECT *, CASE WHEN epoch_us(sent_at) - lag(epoch_us(sent_at)) OVER (PARTITION BY conversation_id ORDER BY sent_at, row_id) <= 28800000000 THEN 0 ELSE 1 END AS fresh FROM m WHERE sent_at IS NOT NULL),
en AS (SELECT *, sum(fresh) OVER (PARTITION BY conversation_id ORDER BY sent_at, row_id) AS episode_no FROM eg),
ep AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, episode_no ORDER BY sent_at, row_id) AS ordinal, count(*) OVER (PARTITION BY conversation_id, episode_no) AS size FROM en)"""


# ------------------------------------------------------------------------------------------ assembled views


@query(f"WITH {_M}, {_EP} SELECT conversation_id, row_id, episode_no::BIGINT AS episode_no, ordinal::BIGINT AS ordinal FROM ep")
def episode_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message with its episode, a session of its conversation, and its place in it."""
    return episodes_of(base(spark, d, ["sent_at"]))


@query(f"""WITH {_M}, {_EP} SELECT conversation_id, episode_no::BIGINT AS session_no, min(epoch_us(sent_at)) AS start_us, max(epoch_us(sent_at)) AS end_us, max(epoch_us(sent_at)) - min(epoch_us(sent_at)) AS duration_us,
  count(*)::BIGINT AS n_events FROM ep GROUP BY conversation_id, episode_no""")
def conversation_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(base(spark, d, ["sent_at"]), "conversation_id", "sent_at")


@query(f"""WITH {_M}, c AS (SELECT strftime(sent_at, '%Y-%m') AS month, count(*) AS n, arg_min(row_id, (sent_at, row_id)) AS row_id FROM m WHERE sent_at IS NOT NULL GROUP BY 1)
SELECT month, n::BIGINT AS n, row_id FROM c ORDER BY n DESC, month LIMIT 1""")
def busiest_month(spark: SparkSession, d: str) -> DataFrame:
    return S.busiest_month_message(base(spark, d, ["sent_at"]))


@query(f"""WITH {_EV}, c AS (SELECT sender, count(*) AS n FROM m WHERE sender IS NOT NULL GROUP BY sender), t AS (SELECT count(*) AS total FROM m),
ed AS (SELECT source_sender AS a, target_sender AS b, count(*) AS w FROM ev WHERE source_sender <> target_sender GROUP BY ALL), {_EP}
SELECT 'participation_balance' AS name, (SELECT -sum(n / total * log2(n / total)) / log2(count(*)) FROM c, t)::DOUBLE AS value
UNION ALL SELECT 'reply_target_resolution', (SELECT count(DISTINCT source) FROM ev) / (SELECT count(*) FROM m WHERE coalesce(reply, '') <> '')
UNION ALL SELECT 'dyadic_reciprocity', (SELECT sum(least(x.w, coalesce(y.w, 0))) / sum(x.w) FROM ed x LEFT JOIN ed y ON y.a = x.b AND y.b = x.a)
UNION ALL SELECT 'session_count', (SELECT count(DISTINCT (conversation_id, episode_no)) FROM ep)
UNION ALL SELECT unnest(['aggregate_score', 'constructiveness', 'goal_progress', 'grounding', 'repair', 'semantic_responsivity']), NULL""")
def health_primitives(spark: SparkSession, d: str) -> DataFrame:
    return S.health_primitives(cut(base(spark, d, ["sender", "sent_at", "reply"])))


@query(f"""WITH {_EV}, c AS (SELECT strftime(sent_at, '%Y-%m') AS month, count(*) AS n, arg_min(row_id, (sent_at, row_id)) AS row_id FROM m WHERE sent_at IS NOT NULL GROUP BY 1),
b AS (SELECT * FROM c ORDER BY n DESC, month LIMIT 1), s AS (SELECT sender, count(*) AS n, arg_min(row_id, (sent_at, row_id)) AS row_id FROM m WHERE sender IS NOT NULL GROUP BY sender ORDER BY 2 DESC, 1 LIMIT 1),
p AS (SELECT external_id, min(display_name) AS name FROM participants GROUP BY 1)
SELECT 'temporal' AS dimension, 'Most messages fell in ' || month || ': ' || n AS claim, row_id AS evidence_row, 'L2_MEASUREMENT' AS epistemic_level, 'descriptive' AS causal_status FROM b
UNION ALL SELECT 'participation', coalesce(name, sender) || ' wrote ' || printf('%.1f', floor(n * 1000 / (SELECT count(*) FROM m)) / 10) || ' percent of the messages', row_id, 'L2_MEASUREMENT', 'descriptive' FROM s LEFT JOIN p ON p.external_id = sender
UNION ALL SELECT 'reply_structure', (SELECT count(*) FROM ev) || ' of ' || (SELECT count(*) FROM m WHERE coalesce(reply, '') <> '') || ' reply links name a message', NULL, 'L2_MEASUREMENT', 'descriptive'""")
def findings(spark: SparkSession, d: str) -> DataFrame:
    return S.findings(cut(base(spark, d, ["sender", "sent_at", "reply", "text"])), _people(spark, d))


#: Every twentieth message is looked at, each in its whole window.
_PICK = "row_id % 20 = 0"
_WIN = f"""ck AS (SELECT *, least((ordinal - 1) // 40, CASE WHEN (size - 1) // 40 > 0 AND size - (size - 1) // 40 * 40 < 10 THEN (size - 1) // 40 - 1 ELSE (size - 1) // 40 END) AS chunk FROM ep),
wn AS (SELECT s.row_id AS selected, c.row_id, c.ordinal, c.row_id = s.row_id AS is_selected, c.text FROM ck s JOIN ck c ON c.conversation_id = s.conversation_id AND c.episode_no = s.episode_no AND c.chunk = s.chunk WHERE s.{_PICK})"""
_GROUND = f"""CASE WHEN {word('уточни|уточните|что значит|не понял|не поняла|правильно ли', 'body')} THEN 'CLARIFICATION_REQUESTED'
  WHEN {word('точнее|я имел в виду|я имела в виду|поправлюсь|не так выразил', 'body')} THEN 'REPAIRED' WHEN {acknowledged('body')} THEN 'ACKNOWLEDGED' END"""
_SPOKEN = f"""sa AS (SELECT row_id, i, body, list_filter({acts('body')}, lambda x: x IS NOT NULL) AS a, {_GROUND} AS g FROM sent),
sb AS (SELECT row_id, i, body, CASE WHEN len(a) > 0 THEN a ELSE ['ASSERT'] END AS a, g, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS words FROM sa),
sp AS (SELECT row_id, list_sort(list_distinct(flatten(list(a)))) AS acts, list_filter(list(g ORDER BY i), lambda x: x IS NOT NULL) AS grounding,
  count(*) FILTER (words >= 3 AND a <> ['ACKNOWLEDGE'] AND NOT list_contains(a, 'QUESTION')) AS n FROM sb GROUP BY row_id)"""


@query(f"""WITH {_M}, {_EP}, {_WIN}, {sentences('m', 'row_id')}, {_SPOKEN}
SELECT selected, row_id, ordinal::BIGINT AS ordinal, is_selected, array_to_string(coalesce(acts, []), ',') AS acts, array_to_string(coalesce(grounding, []), ',') AS grounding, coalesce(n, 0)::INT AS n_propositions
FROM wn LEFT JOIN sp USING (row_id)""")
def microscope(spark: SparkSession, d: str) -> DataFrame:
    """The window around every message whose id is divisible by 20, with acts, grounding and propositions of all its messages."""
    rows = base(spark, d, ["sent_at", "text"])
    out = S.microscope(rows, rows.where(_PICK))
    return out.withColumn("acts", F.array_join("acts", ",")).withColumn("grounding", F.array_join("grounding", ","))


@query(f"""WITH {_M}, {sentences('m', 'row_id')}, {_SPOKEN}, pk AS (SELECT row_id, coalesce(text, '') AS text FROM m WHERE {_PICK}), ac AS (SELECT row_id, unnest(a) AS act FROM sb SEMI JOIN pk USING (row_id))
SELECT row_id, 'L0' AS level, 'text_sha256' AS kind, sha256(text) AS value FROM pk UNION ALL SELECT row_id, 'L1', 'dialogue_act', act FROM ac
UNION ALL SELECT row_id, 'L1', 'grounding', g FROM sb SEMI JOIN pk USING (row_id) WHERE g IS NOT NULL UNION ALL SELECT row_id, 'L2', 'n_acts', count(*)::VARCHAR FROM ac GROUP BY row_id""")
def evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    """Source, observations and a measurement of every message whose id is divisible by 20."""
    rows = base(spark, d, ["text"])
    return S.evidence_chain(rows, rows.where(_PICK))


@query(f"""WITH {_M}, {CANDIDATES}, a AS (SELECT source AS object, source || ':' || target AS annotation, reason AS label, score AS confidence FROM cand),
sl AS (SELECT object AS selected, list(DISTINCT label) AS l FROM a WHERE object % 20 = 0 GROUP BY 1),
bt AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY label ORDER BY confidence DESC, annotation) <= 12),
pr AS (SELECT selected, CASE WHEN list_contains(l, label) THEN 'supporting' ELSE 'hard_negative' END AS side, annotation, label, confidence FROM sl JOIN bt ON bt.object <> selected)
SELECT *, row_number() OVER (PARTITION BY selected, side ORDER BY confidence DESC, annotation)::INT AS place FROM pr QUALIFY place <= 3""")
def comparison_cases(spark: SparkSession, d: str) -> DataFrame:
    """For every message whose id is divisible by 20 the candidates of others with and without its labels, the surest first."""
    cand = cut(R.response_candidates(base(spark, d)))
    notes = cand.select(F.col("source").alias("object"), F.concat_ws(":", F.col("source").cast("string"), F.col("target").cast("string")).alias("annotation"), F.col("reason").alias("label"), F.col("score").alias("confidence"))
    return S.comparison_cases(notes, cand.where("source % 20 = 0").select(F.col("source").alias("row_id")))


@query(f"""WITH {_M}, a AS (SELECT row_id AS anchor, conversation_id, sent_at AS u FROM m WHERE {_PICK})
SELECT anchor, row_id, row_number() OVER (PARTITION BY anchor ORDER BY sent_at DESC, row_id DESC)::INT AS place FROM a JOIN m USING (conversation_id)
WHERE sent_at <= u AND row_id <> anchor AND (contains(lower(text), 'schedule') OR contains(lower(text), 'график')) QUALIFY place <= 10""")
def search_before_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest hits of two words up to every message whose id is divisible by 20."""
    rows = base(spark, d, ["sent_at", "text"])
    return S.search_before(rows, rows.where(_PICK), ["schedule", "график"])


@query(f"""WITH {_M}, {CANDIDATES}, {DISCOURSE}, l AS (SELECT source, target, string_agg(label, ',' ORDER BY label) AS labels FROM disc GROUP BY ALL)
SELECT cand.source, cand.target, rank, score, eligible, reason, coalesce(labels, '') AS labels FROM cand LEFT JOIN l ON l.source = cand.source AND l.target = cand.target""")
def candidate_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph of candidates with eligibility and the labels proposed for eligible pairs."""
    from threadloom.operators.observations import discourse

    rows = base(spark, d)
    cand = cut(R.response_candidates(rows))
    labels = discourse(rows, cand).groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return cand.drop("source_native").join(labels, ["source", "target"], "left").withColumn("labels", F.coalesce("labels", F.lit("")))


@query(f"""WITH {_EV}, {CANDIDATES}, {DISCOURSE} SELECT source AS row_id FROM ev UNION SELECT target FROM ev UNION SELECT source FROM cand UNION SELECT target FROM cand UNION SELECT source FROM disc UNION SELECT target FROM disc""")
def linked_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message that a reply link, a candidate or a discourse label touches."""
    from threadloom.operators.observations import discourse

    rows = base(spark, d)
    cand = cut(R.response_candidates(rows))
    return N.linked_messages(R.reply_events(rows), cand, discourse(rows, cand))


@query(f"""WITH {_M} SELECT json_extract_string(metadata_json, '$.language') AS language, json_extract_string(metadata_json, '$.relative_order')::INT AS relative_order, count(*)::BIGINT AS n,
  count(*) FILTER (participant IS NULL)::BIGINT AS n_unresolved FROM evidence_items GROUP BY ALL""")
def metadata_paths(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by what its metadata say, read by path."""
    path = lambda p: F.get_json_object("metadata_json", f"$.{p}")
    return table(spark, d, "evidence_items").groupBy(path("language").alias("language"), path("relative_order").cast("int").alias("relative_order")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("participant").isNull()).alias("n_unresolved")
    )


@query("""SELECT platform, source_namespace, external_id, min(conversation_id) AS conversation_id, count(*)::BIGINT AS n_rows FROM chats GROUP BY ALL""")
def natural_conversations(spark: SparkSession, d: str) -> DataFrame:
    """One conversation per platform, namespace and outer id, whatever the number of rows that name it."""
    return table(spark, d, "chats").groupBy("platform", "source_namespace", "external_id").agg(F.min("conversation_id").alias("conversation_id"), F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {_M} SELECT message_id AS object_id, 'SEND' AS event, epoch_us(sent_at) AS at_us FROM m UNION ALL
SELECT m.message_id, 'EVIDENCE', epoch_us(sent_at) FROM m JOIN evidence_items e ON e.message_id = m.message_id UNION ALL SELECT m.message_id, 'FEATURE', epoch_us(sent_at) FROM m JOIN message_features f ON f.message_id = m.message_id""")
def message_events(spark: SparkSession, d: str) -> DataFrame:
    """Each message fanned out into its sending and the items that hang on it."""
    rows = base(spark, d, ["message_id", "sent_at"]).select(F.col("message_id").alias("object_id"), F.unix_micros("sent_at").alias("at_us"))
    hung = table(spark, d, "evidence_items").select(F.col("message_id").alias("object_id"), F.lit("EVIDENCE").alias("event"))
    hung = hung.unionByName(table(spark, d, "message_features").select(F.col("message_id").alias("object_id"), F.lit("FEATURE").alias("event")))
    return rows.withColumn("event", F.lit("SEND")).unionByName(rows.join(hung, "object_id"))


@query(f"""WITH {_M}, p AS (SELECT DISTINCT producer_hash FROM message_features WHERE producer_hash IS NOT NULL), h AS (SELECT DISTINCT message_id, producer_hash FROM message_features WHERE len(vec_values) = 64)
SELECT m.message_id, p.producer_hash FROM m, p WHERE m.text <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.message_id = m.message_id AND h.producer_hash = p.producer_hash)""")
def vectors_to_make(spark: SparkSession, d: str) -> DataFrame:
    """Messages with text and producers of which no vector is stored yet."""
    stored = table(spark, d, "message_features")
    producers = [r[0] for r in stored.where("producer_hash IS NOT NULL").select("producer_hash").distinct().limit(1001).collect()]
    if len(producers) > 1000:
        raise ValueError("more than 1000 producers")
    wanted = base(spark, d, ["message_id", "text"]).where("text <> ''").select("message_id", F.explode(F.array(*map(F.lit, producers)).cast("array<string>")).alias("producer_hash"))
    held = stored.where(F.size("vec_values") == 64).select("message_id", "producer_hash")
    return wanted.join(held, ["message_id", "producer_hash"], "left_anti")


# ------------------------------------------------------------------------------------------ annotation sets

_STRATA = f"""st AS (SELECT m.row_id, extract(year FROM m.sent_at) || '-Q' || extract(quarter FROM m.sent_at) AS time_period, m.conversation_id, coalesce(m.sender, 'UNRESOLVED') AS participant,
  CASE WHEN coalesce(ep.size, 0) < 10 THEN 'small' WHEN ep.size < 50 THEN 'medium' ELSE 'large' END AS episode_size, coalesce(m.reply, '') <> '' AS has_reply,
  CASE WHEN length(coalesce(m.text, '')) < 60 THEN 'short' WHEN length(m.text) < 180 THEN 'medium' ELSE 'long' END AS length, contains(coalesce(m.text, ''), '?') AS question, coalesce(sn.n, 0) > 1 AS several,
  ma.rare, c.platform, c.goal
  FROM m LEFT JOIN ep ON ep.row_id = m.row_id LEFT JOIN (SELECT conversation_id, platform, goal FROM chats) c ON c.conversation_id = m.conversation_id
  LEFT JOIN (SELECT row_id, count(*) AS n FROM sent GROUP BY row_id) sn ON sn.row_id = m.row_id LEFT JOIN (SELECT row_id, {RARE} AS rare FROM m) ma ON ma.row_id = m.row_id)"""
_BUCKET = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in A.STRATA) + ")"


@query(f"WITH {_M}, {_EP}, {sentences('m', 'row_id')}, {_STRATA} SELECT * FROM st")
def unit_strata(spark: SparkSession, d: str) -> DataFrame:
    """The eleven strata of every message."""
    rows = base(spark, d)
    return A.strata(rows, episodes_of(rows), table(spark, d, "chats"))


@query(f"""WITH {_M}, {_EP}, {sentences('m', 'row_id')}, {_STRATA}, b AS (SELECT row_id, {_BUCKET} AS bucket, sha256('gold:' || row_id) AS p FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p, row_id) AS depth FROM b),
o AS (SELECT row_id, least(depth, 3) AS depth, CASE WHEN depth <= 2 THEN 0 ELSE 1 END AS late, CASE WHEN depth <= 2 THEN sha256('gold:' || bucket) ELSE p END AS o FROM r),
f AS (SELECT row_id, depth, row_number() OVER (ORDER BY late, depth, o, row_id) AS place FROM o)
SELECT row_id, depth::INT AS depth, place::INT AS place FROM f WHERE place <= 300""")
def annotation_units(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred units drawn over the combinations of all eleven strata."""
    rows = base(spark, d)
    return A.draw_units(A.strata(rows, episodes_of(rows), table(spark, d, "chats")), 300, "gold")


_HARD = "(coalesce(reply, '') <> '' OR contains(coalesce(text, ''), '?') OR length(coalesce(text, '')) > 180 OR length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', '')) > 1)"


@query(f"""WITH {_M}, h AS (SELECT row_id, {_HARD} AS difficult, sha256('old:' || row_id) AS p FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY difficult ORDER BY p, row_id) AS k FROM h),
o AS (SELECT *, CASE WHEN k <= 100 THEN 0 ELSE 1 END AS late FROM r) SELECT row_id, difficult, row_number() OVER (ORDER BY late, p, row_id)::INT AS place FROM o QUALIFY place <= 200""")
def legacy_units(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred units, half of them difficult."""
    return A.legacy_draw(base(spark, d, ["text", "reply"]), 200, "old")


@query(f"WITH {_M} SELECT {_HARD} AS difficult, CASE WHEN length(coalesce(text, '')) < 60 THEN 'short' WHEN length(text) < 180 THEN 'medium' ELSE 'long' END AS length, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def difficulty_strata(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    size = F.when(n < 60, "short").when(n < 180, "medium").otherwise("long")
    return base(spark, d, ["text", "reply"]).groupBy(A.is_difficult(F.col("text"), F.col("reply")).alias("difficult"), size.alias("length")).agg(F.count(F.lit(1)).alias("n"))


_SIGNED = """sg AS (SELECT unit_id, task, slot, status, coalesce(status, '') || '|' || coalesce(upper(trim(label, ' ')), '') AS signature FROM gold_task_judgments WHERE unit_id IS NOT NULL AND task IS NOT NULL AND slot IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY unit_id, task, slot ORDER BY submitted_at DESC NULLS LAST, judgment_id DESC) = 1)"""


@query(f"WITH {_SIGNED} SELECT unit_id, task, slot, status, signature FROM sg")
def judgment_signatures(spark: SparkSession, d: str) -> DataFrame:
    return A.judgment_signatures(table(spark, d, "gold_task_judgments"))


@query(f"""WITH {_SIGNED} SELECT a.task, count(*)::BIGINT AS comparable, count(*) FILTER (a.signature = b.signature)::BIGINT AS exact, count(*) FILTER (a.signature = b.signature) / count(*) AS raw_rate
FROM sg a JOIN sg b ON b.unit_id = a.unit_id AND b.task = a.task WHERE a.slot = 'A' AND b.slot = 'B' AND a.status <> 'NOT_ANNOTATED' AND b.status <> 'NOT_ANNOTATED' GROUP BY a.task""")
def slot_agreement(spark: SparkSession, d: str) -> DataFrame:
    return A.slot_agreement(A.judgment_signatures(table(spark, d, "gold_task_judgments")))


@query("""WITH e AS (SELECT annotation_set_id, unit_id, count(*) FILTER (coalesce(status, 'NOT_ANNOTATED') = 'NOT_ANNOTATED') AS o, count(DISTINCT slot) AS s FROM gold_task_judgments WHERE unit_id IS NOT NULL GROUP BY ALL),
u AS (SELECT annotation_set_id, count(*) AS t, count(*) FILTER (o = 0) AS c, count(*) FILTER (s > 1) AS k FROM e GROUP BY 1)
SELECT annotation_set_id, coalesce(t, 0)::BIGINT AS total_units, coalesce(c, 0)::BIGINT AS confirmed_units, coalesce(k, 0)::BIGINT AS double_units, target_size, coalesce(t > 0 AND t = c, false) AS freeze_ready
FROM annotation_sets LEFT JOIN u USING (annotation_set_id)""")
def freeze_readiness(spark: SparkSession, d: str) -> DataFrame:
    return A.readiness(table(spark, d, "gold_task_judgments"), table(spark, d, "annotation_sets"))


_CONFIRMED = """cf AS (SELECT unit_id, task, judgment_id, status, label, annotator FROM gold_task_judgments WHERE unit_id IS NOT NULL AND task IS NOT NULL AND annotator IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY unit_id, task, annotator ORDER BY submitted_at DESC NULLS LAST, judgment_id DESC) = 1)"""


@query(f"WITH {_CONFIRMED} SELECT unit_id, task, judgment_id, upper(trim(label, ' ')) AS label FROM cf WHERE status = 'PRESENT' AND label IS NOT NULL")
def confirmed_judgments(spark: SparkSession, d: str) -> DataFrame:
    return A.confirmed(table(spark, d, "gold_task_judgments"))


@query(f"""WITH {_CONFIRMED}, c AS (SELECT unit_id, task, count(*) AS n, count(DISTINCT upper(trim(label, ' '))) AS k FROM cf WHERE status = 'PRESENT' AND label IS NOT NULL GROUP BY ALL)
SELECT task, count(*)::BIGINT AS units, count(*) FILTER (n > 1)::BIGINT AS comparable, count(*) FILTER (n > 1 AND k = 1)::BIGINT AS agreeing FROM c GROUP BY task""")
def legacy_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Units with confirmed labels per task, and of those with several how many agree."""
    rows = A.confirmed(table(spark, d, "gold_task_judgments")).groupBy("unit_id", "task").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("label").alias("_k"))
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("_n") > 1).alias("comparable"), F.count_if((F.col("_n") > 1) & (F.col("_k") == 1)).alias("agreeing"))


@query(f"""WITH {_SIGNED}, g AS (SELECT unit_id, task, status, split_part(signature, '|', 2) AS label FROM sg WHERE slot = 'A'), p AS (SELECT DISTINCT unit_id, task, split_part(signature, '|', 2) AS label FROM sg WHERE slot = 'B' AND status = 'PRESENT' AND split_part(signature, '|', 2) <> ''),
s AS (SELECT unit_id, task, max(CASE status WHEN 'ABSTAIN' THEN 2 WHEN 'ABSENT' THEN 1 ELSE 0 END) AS s FROM g GROUP BY ALL), r AS (SELECT DISTINCT unit_id, task, label FROM g WHERE status = 'PRESENT' AND label <> ''),
b AS (SELECT coalesce(r.unit_id, p.unit_id) AS unit_id, coalesce(r.task, p.task) AS task, r.unit_id IS NOT NULL AS hg, p.unit_id IS NOT NULL AS hp FROM r FULL JOIN p ON p.unit_id = r.unit_id AND p.task = r.task AND p.label = r.label),
c AS (SELECT task, count(*) FILTER (hg AND hp) AS tp, count(*) FILTER (NOT hg AND hp) AS fp, count(*) FILTER (hg AND NOT hp) AS fn FROM b JOIN s USING (unit_id, task) WHERE s < 2 GROUP BY task),
a AS (SELECT task, count(*) FILTER (s = 2) AS skipped, count(*) FILTER (s = 1 AND q.unit_id IS NULL) AS ar, count(*) FILTER (s = 1) AS at_ FROM s LEFT JOIN (SELECT DISTINCT unit_id, task FROM p) q USING (unit_id, task) GROUP BY task)
SELECT task, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(fn, 0)::BIGINT AS fn, skipped::BIGINT AS skipped, ar::BIGINT AS absent_right, at_::BIGINT AS absent_total,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM a LEFT JOIN c USING (task)""")
def task_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Slot B as predictions against slot A as judgments, per task, abstentions skipped and absences counted apart."""
    signed = A.judgment_signatures(table(spark, d, "gold_task_judgments")).withColumn("label", F.nullif(F.element_at(F.split("signature", r"\|"), 2), F.lit("")))
    return A.evaluate_tasks(signed.where("slot = 'A'"), signed.where("slot = 'B' AND status = 'PRESENT' AND label IS NOT NULL"))


@query(rf"""WITH RECURSIVE s AS (SELECT evidence_id, text FROM evidence_items WHERE text IS NOT NULL AND text <> ''), {sentences('s', 'evidence_id')},
w AS (SELECT evidence_id, i, 0 AS lo, length(body) AS hi, least(length(body), 20 * i) AS cut FROM sent)
SELECT evidence_id, i::INT AS sentence_no, CASE WHEN hi + cut > 0 THEN 2 * cut::DOUBLE / (hi + cut) ELSE 0 END AS f1 FROM w""")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """F1 by length of each sentence and its beginning of 20 characters times its number."""
    from threadloom.functions import text as T

    rows = table(spark, d, "evidence_items").where("text <> ''").select("evidence_id", F.posexplode(T.sentences(F.col("text"))).alias("_i", "_s"))
    n = F.length("_s.sentence")
    zero = F.lit(0)
    return rows.select("evidence_id", (F.col("_i") + 1).alias("sentence_no"), E.span_overlap_f1(zero, n, zero, F.least(n, 20 * (F.col("_i") + 1))).alias("f1"))


@query()
def matched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one matches of messages with their candidates inside each conversation, by descending score."""
    rows = base(spark, d)
    cand = R.response_candidates(rows).join(rows.select(F.col("row_id").alias("source"), "conversation_id"), "source")
    return E.greedy_matches(cand, ["conversation_id"], "source", "target", "score")


@query("""SELECT feature_id, coalesce(nullif(json_extract_string(v, '$.label'), ''), nullif(json_extract_string(v, '$.position'), ''), nullif(json_extract_string(v, '$.type'), ''), nullif(json_extract_string(v, '$.text'), ''), 'none') AS label
FROM (SELECT feature_id, '{"type":"' || coalesce(feature_type, '') || '"}' AS v FROM message_features)""")
def annotation_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "message_features").select("feature_id", F.concat(F.lit('{"type":"'), F.coalesce("feature_type", F.lit("")), F.lit('"}')).alias("v"))
    return rows.select("feature_id", A.annotation_label(F.col("v"), F.lit("none")).alias("label"))


# ------------------------------------------------------------------------------------------ layered networks


@query(rf"""WITH {_M}, t AS (SELECT sender AS k, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 2)) AS term FROM m WHERE sender IS NOT NULL AND text IS NOT NULL),
tf AS (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT sender) AS n FROM m WHERE sender IS NOT NULL AND text IS NOT NULL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT k, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), u AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM w)
SELECT a.k AS left, b.k AS right, sum(a.w * b.w) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.k < b.k GROUP BY ALL HAVING sum(a.w * b.w) >= 0.25""")
def similar_writers(spark: SparkSession, d: str) -> DataFrame:
    return N.similar_writers(base(spark, d, ["sender", "text"]))


@query(f"""WITH {_EV} SELECT strftime(source_sent_at, '%Y-%m') AS month, least(source_sender, target_sender) AS left, greatest(source_sender, target_sender) AS right, count(*)::BIGINT AS weight
FROM ev WHERE source_sender <> target_sender AND source_sent_at IS NOT NULL GROUP BY ALL""")
def monthly_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Undirected weights of the reply layer of every month."""
    ev = R.reply_events(base(spark, d, ["sender", "sent_at", "reply"])).where("source_sender <> target_sender AND source_sent_at IS NOT NULL")
    pair = (F.least("source_sender", "target_sender").alias("left"), F.greatest("source_sender", "target_sender").alias("right"))
    return ev.groupBy(F.date_format("source_sent_at", "yyyy-MM").alias("month"), *pair).agg(F.count(F.lit(1)).alias("weight"))


@query()
def monthly_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the reply layer of every month, all months at once."""
    edges = monthly_interaction(spark, d).withColumnsRenamed({"left": "src", "right": "dst"})
    return N.label_communities(edges, ["month"])


@query()
def layer_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the layers of replies, of similar writing, of support and of attack."""
    from threadloom.operators.observations import argument_relations

    rows = stage(base(spark, d))
    edge = lambda df, name, a, b, w: df.select(F.lit(name).alias("layer"), F.col(a).alias("src"), F.col(b).alias("dst"), w.cast("double").alias("weight"))
    ev = R.reply_events(rows)
    who = rows.where("sender IS NOT NULL")
    argued = argument_relations(rows, stage(R.response_candidates(rows)))
    argued = argued.join(who.select(F.col("row_id").alias("source"), F.col("sender").alias("_a")), "source").join(who.select(F.col("row_id").alias("target"), F.col("sender").alias("_b")), "target")
    layers = edge(ev, "interaction", "source_sender", "target_sender", F.lit(1)).where("src IS NOT NULL AND dst IS NOT NULL")
    layers = layers.unionByName(argued.select(F.when(F.col("relation") == "SUPPORTS", "support").otherwise("attack").alias("layer"), F.col("_a").alias("src"), F.col("_b").alias("dst"), F.lit(1.0).alias("weight")))
    alike = N.similar_writer_communities(rows).select(F.lit("semantic_similarity").alias("layer"), "id", "community")
    return N.label_communities(stage(layers), ["layer"]).unionByName(alike)


@query()
def term_themes(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the 80 terms of most messages by their co-occurrence."""
    rows = base(spark, d, ["text"])
    top = cut(Q.document_frequency(rows, "text").where(F.col("df") >= 5).orderBy(F.desc("df"), "term").limit(80))
    return N.term_themes(Q.cooccurrence(rows, "text", top), top)


@query()
def excitation_radius(spark: SparkSession, d: str) -> DataFrame:
    """Spectral radius of the excitation between the ten busiest senders; none below 20 events."""
    rows = base(spark, d, ["sender", "sent_at", "text"])
    return N.excitation_radius(G.excitation(rows), rows)
