"""Queries of the observation, model and record operators, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import evaluation as E
from threadloom.operators import graph as G
from threadloom.operators import models as M
from threadloom.operators import observations as O
from threadloom.operators import records as C
from threadloom.operators import replies as R
from threadloom.operators import retrieval as Q
from threadloom.operators import themes as H
from threadloom.plans.analytics import _EV, _M, _TFIDF, base, events
from threadloom.plans.rules import ACTS as _ACTS
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


@query(f"""WITH {_M}, a AS (SELECT conversation_id, row_id, sent_at, list_filter([{_ACTS}], lambda x: x IS NOT NULL) AS x FROM m WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT conversation_id, CASE WHEN len(x) > 0 THEN x[1] ELSE 'ASSERT' END AS act, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, row_id) AS i FROM a),
r AS (SELECT p.size, string_agg(c.act, '>' ORDER BY c.i) AS pattern, count(*) AS k FROM b s, (VALUES (2), (3), (4), (5)) p(size), b c
  WHERE c.conversation_id = s.conversation_id AND c.i BETWEEN s.i AND s.i + p.size - 1 GROUP BY s.conversation_id, s.i, p.size HAVING count(*) = p.size),
n AS (SELECT size, pattern, count(*) AS n FROM r GROUP BY ALL)
SELECT size::INT AS size, pattern, n::BIGINT AS n FROM n QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, pattern) <= 30""")
def act_sequences(spark: SparkSession, d: str) -> DataFrame:
    return O.act_sequences(base(spark, d, ["text", "sent_at"]))




def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "participants").select(F.col("external_id").alias("person"), F.col("display_name").alias("name"))


@query(rf"""WITH {_M}, p AS (SELECT DISTINCT external_id AS person, unnest(list_filter(regexp_extract_all(lower(display_name), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 4)) AS surface FROM participants),
k AS (SELECT surface, count(DISTINCT person) AS n, min(person) AS person FROM p GROUP BY surface),
w AS (SELECT DISTINCT row_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 2)) AS surface FROM m WHERE text IS NOT NULL)
SELECT row_id, surface, CASE WHEN n = 1 THEN person END AS person, 'name' AS basis FROM w JOIN k USING (surface)
UNION ALL SELECT row_id, surface, NULL, 'pronoun' FROM w WHERE surface IN ('он', 'она', 'они', 'оно', 'его', 'её', 'их', 'ему', 'ей', 'им')""")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return O.mentions(base(spark, d, ["text"]), _people(spark, d))


@query(rf"""WITH {_M}, pl AS (SELECT conversation_id, row_id, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at NULLS FIRST, row_id) AS i FROM m),
p AS (SELECT DISTINCT external_id AS person, unnest(list_filter(regexp_extract_all(lower(display_name), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 4)) AS surface FROM participants), k AS (SELECT DISTINCT surface FROM p),
w AS (SELECT DISTINCT row_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 2)) AS surface FROM m WHERE text IS NOT NULL),
f AS (SELECT row_id, surface, 'name' AS basis FROM w JOIN k USING (surface) UNION ALL SELECT row_id, surface, 'pronoun' FROM w WHERE surface IN ('он', 'она', 'они', 'оно', 'его', 'её', 'их', 'ему', 'ей', 'им')),
r AS (SELECT f.*, conversation_id, i FROM f JOIN pl USING (row_id)),
s AS (SELECT a.row_id, a.surface, b.row_id AS antecedent, b.surface AS antecedent_surface, b.i AS j, round(CASE WHEN a.surface = b.surface THEN 0.9 WHEN a.basis = 'pronoun' AND b.basis = 'name' THEN 0.55 END - (a.i - b.i) / 200, 6) AS score
  FROM r a JOIN r b ON b.conversation_id = a.conversation_id AND b.i < a.i AND a.i - b.i <= 40)
SELECT row_id, surface, antecedent, antecedent_surface, score, row_number() OVER (PARTITION BY row_id, surface ORDER BY score DESC, j DESC, antecedent_surface)::INT AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 5""")
def coreference(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["text", "sent_at"])
    return O.coreference(rows, O.mentions(rows, _people(spark, d)))


@query(f"""WITH {_TFIDF.replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")}, gr AS (SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), sz AS (SELECT lang, count(*) AS k FROM gr GROUP BY lang),
own AS (SELECT lang, term, sum(weight) AS c FROM tw JOIN gr USING (doc_id) GROUP BY ALL), ev AS (SELECT term, sum(weight) / (SELECT count(*) FROM gr) AS g FROM tw GROUP BY term),
sc AS (SELECT lang, term, round(c / k * greatest(ln((c / k + 1e-9) / (g + 1e-9)), 0), 9) AS score FROM own JOIN sz USING (lang) JOIN ev USING (term))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term)::INT AS place, term, score FROM sc WHERE score > 0 QUALIFY place <= 10""")
def document_themes(spark: SparkSession, d: str) -> DataFrame:
    """Distinctive terms of the languages of the documents, as groups that are known."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return O.distinctive_terms(H.tfidf(rows, "doc_id", "text"), rows, "doc_id", "lang")


@query(rf"""WITH {_M}, r AS (SELECT row_id, strftime(sent_at, '%Y-%m') AS month, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+') AS w FROM m WHERE text IS NOT NULL),
t AS (SELECT DISTINCT row_id, month, unnest(list_filter(w, lambda x: length(x) >= 4)) AS theme FROM r), top AS (SELECT theme FROM t GROUP BY theme ORDER BY count(*) DESC, theme LIMIT 20), tot AS (SELECT month, count(*) AS k FROM r GROUP BY month),
c AS (SELECT theme, month, count(*) AS n FROM t SEMI JOIN top USING (theme) GROUP BY ALL), sh AS (SELECT theme, month, n, n / k AS share FROM c JOIN tot USING (month) WHERE n >= 5 QUALIFY count(*) OVER (PARTITION BY theme) >= 4),
p AS (SELECT *, lag(share) OVER (PARTITION BY theme ORDER BY month) AS previous, list(share) OVER (PARTITION BY theme ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM sh),
g AS (SELECT *, ln((share + 1e-4) / (previous + 1e-4)) AS log_change FROM p WHERE previous IS NOT NULL), ce AS (SELECT theme, median(log_change) AS ce FROM g GROUP BY theme), ma AS (SELECT theme, median(abs(log_change - ce)) AS mad FROM g JOIN ce USING (theme) GROUP BY theme),
s AS (SELECT theme, month, log_change, CASE WHEN mad > 0 THEN abs(log_change - ce) / (1.4826 * mad) ELSE abs(log_change - ce) END AS robust_score,
  coalesce(list_min(list_filter(range(1, len(after) + 1), lambda i: CASE WHEN log_change > 0 THEN after[i] <= previous ELSE after[i] >= previous END)) - 1, len(after))::INT AS persistence FROM g JOIN ce USING (theme) JOIN ma USING (theme))
SELECT theme, month, log_change, robust_score, persistence FROM s WHERE robust_score >= 2 ORDER BY robust_score DESC, theme, month LIMIT 5""")
def theme_share_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the monthly share of messages that hold each of the 20 most frequent terms."""
    rows = base(spark, d, ["text", "sent_at"]).where(F.col("text").isNotNull())
    top = Q.document_frequency(rows, "text").orderBy(F.desc("df"), "term").limit(20)
    month = F.date_format("sent_at", "yyyy-MM").alias("month")
    totals = rows.groupBy(month).agg(F.count(F.lit(1)).alias("_all"))
    held = Q.term_frequencies(rows, "row_id", "text", 4).join(F.broadcast(top.select("term")), "term").join(rows.select("row_id", month), "row_id")
    counts = held.groupBy(F.col("term").alias("theme"), "month").agg(F.count(F.lit(1)).alias("n"))
    return O.share_changes(counts.join(totals, "month").withColumn("share", F.col("n") / F.col("_all")))


@query()
def choice_model(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "reply"])
    return M.choice_fit(R.choice_features(rows, R.reply_events(rows)))


@query()
def answered_model(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d, ["sender", "sent_at", "reply", "text"])
    return M.answered_model(rows, R.reply_events(rows))


@query()
def motif_null(spark: SparkSession, d: str) -> DataFrame:
    return G.motif_null(events(spark, d))


@query(f"""WITH {_M} SELECT sender, row_number() OVER (ORDER BY min(sent_at) NULLS FIRST, sender)::BIGINT AS number FROM m WHERE sender IS NOT NULL GROUP BY sender""")
def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return C.pseudonyms(base(spark, d, ["sender", "sent_at"]))


@query(f"""WITH {_M}, n AS (SELECT external_id, count(DISTINCT display_name) AS k FROM participants GROUP BY 1)
SELECT sender, count(*)::BIGINT AS n_messages, count(DISTINCT conversation_id)::BIGINT AS n_conversations, epoch_us(min(sent_at)) AS first_us, epoch_us(max(sent_at)) AS last_us,
  coalesce(any_value(k), 0)::BIGINT AS n_names FROM m LEFT JOIN n ON n.external_id = sender WHERE sender IS NOT NULL GROUP BY sender""")
def identity_profile(spark: SparkSession, d: str) -> DataFrame:
    out = C.identity_profile(base(spark, d, ["sender", "sent_at"]), _people(spark, d))
    return out.select("sender", "n_messages", "n_conversations", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n_names")


@query("""SELECT annotation_set_id, task, slot, count(*)::BIGINT AS n, count(*) FILTER (status <> 'NOT_ANNOTATED')::BIGINT AS n_done, count(*) FILTER (status = 'PRESENT')::BIGINT AS n_present,
  count(*) FILTER (status <> 'NOT_ANNOTATED') / count(*) AS share_done FROM gold_task_judgments GROUP BY ALL""")
def judgment_progress(spark: SparkSession, d: str) -> DataFrame:
    return C.progress(table(spark, d, "gold_task_judgments"))


@query("""SELECT unit_id, CASE WHEN bool_and(coalesce(status <> 'NOT_ANNOTATED', false)) THEN 'reviewed' WHEN bool_or(coalesce(status <> 'NOT_ANNOTATED', false)) THEN 'annotated' ELSE 'pending' END AS status
FROM gold_task_judgments WHERE unit_id IS NOT NULL GROUP BY unit_id""")
def unit_status(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_status(table(spark, d, "gold_task_judgments"))


@query("""WITH e AS (SELECT annotation_set_id, sha256(concat_ws(chr(1), coalesce(judgment_id::VARCHAR, chr(2)), coalesce(unit_id::VARCHAR, chr(2)), coalesce(task::VARCHAR, chr(2)), coalesce(slot::VARCHAR, chr(2)), coalesce(status::VARCHAR, chr(2)), coalesce(annotator::VARCHAR, chr(2)), coalesce(label::VARCHAR, chr(2)))) AS h FROM gold_task_judgments), f AS (SELECT annotation_set_id, substr(h, 1, 5) AS five, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY ALL),
c AS (SELECT annotation_set_id, substr(five, 1, 2) AS two, sum(n) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM f GROUP BY annotation_set_id, substr(five, 1, 2)) SELECT annotation_set_id, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h)) AS manifest FROM c GROUP BY annotation_set_id""")
def frozen_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.frozen_manifest(table(spark, d, "gold_task_judgments"))


@query("""SELECT DISTINCT message_id AS source_id, 'e' || evidence_id AS target_id, 'DERIVED_FROM' AS relation FROM evidence_items WHERE message_id IS NOT NULL""")
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_items").select(
        F.concat(F.lit("e"), F.col("evidence_id").cast("string")).alias("annotation_id"), F.array(F.struct(F.col("message_id").alias("object_id"))).alias("evidence")
    )
    return C.lineage_edges(rows)


@query("""WITH a AS (SELECT count(*)::BIGINT AS rows, count(DISTINCT conversation_id)::BIGINT AS conversations, count(DISTINCT sender_external_id)::BIGINT AS senders,
  count(DISTINCT (conversation_id, external_id))::BIGINT AS messages, count(*) FILTER (text IS NULL)::BIGINT AS null_texts, count(*) FILTER (text = '')::BIGINT AS empty_texts,
  count(*) FILTER (reply_to_external_id <> '')::BIGINT AS reply_marks, count(*) FILTER (resolution_confidence < 0.5)::BIGINT AS uncertain_times FROM messages)
UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE value""")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_profile(table(spark, d, "messages"))


@query("""SELECT judgment_id, unit_id, task, annotator, label FROM gold_task_judgments WHERE annotator IS NOT NULL AND unit_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY submitted_at DESC NULLS LAST, judgment_id DESC) = 1""")
def last_reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gold_task_judgments").where(F.col("annotator").isNotNull() & F.col("unit_id").isNotNull())
    return C.last_reviews(rows, "unit_id", "submitted_at", "judgment_id").select("judgment_id", "unit_id", "task", "annotator", "label")


@query(f"""WITH {_M} SELECT s.row_id AS source, t.row_id AS target, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM m s
JOIN m t ON t.conversation_id = s.conversation_id AND t.external_id = s.reply AND s.reply <> ''
JOIN (SELECT message_id, arg_min(vec_values::DOUBLE[], feature_id) AS v FROM message_features WHERE len(vec_values) = 64 AND len(list_filter(vec_values, lambda x: isfinite(x))) = 64 AND len(list_filter(vec_values, lambda x: x <> 0)) > 0 GROUP BY 1) a ON a.message_id = s.message_id
JOIN (SELECT message_id, arg_min(vec_values::DOUBLE[], feature_id) AS v FROM message_features WHERE len(vec_values) = 64 AND len(list_filter(vec_values, lambda x: isfinite(x))) = 64 AND len(list_filter(vec_values, lambda x: x <> 0)) > 0 GROUP BY 1) b ON b.message_id = t.message_id""")
def reply_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the stored vectors of a reply and its target, the first usable one of each message."""
    from threadloom.functions.text import cosine

    v = F.col("vec_values")
    good = table(spark, d, "message_features").where(
        (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    one = good.groupBy("message_id").agg(F.min_by(F.transform("vec_values", lambda x: x.cast("double")), "feature_id").alias("v"))
    rows = base(spark, d, ["message_id", "reply"])
    ev = R.reply_events(rows, ("message_id",))
    a = one.select(F.col("message_id").alias("source_message_id"), F.col("v").alias("_a"))
    b = one.select(F.col("message_id").alias("target_message_id"), F.col("v").alias("_b"))
    return ev.join(a, "source_message_id").join(b, "target_message_id").select("source", "target", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("score"))


# ------------------------------------------------------------------------------------------ search and pages


@query(f"""WITH {_M} SELECT row_id, conversation_id FROM m WHERE contains(lower(text), 'schedule') OR contains(lower(text), 'график')""")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages that hold any of some terms, whatever the case."""
    text = F.lower("text")
    return base(spark, d, ["text"]).where(text.contains("schedule") | text.contains("график")).select("row_id", "conversation_id")


@query(rf"""WITH {_M} SELECT row_id FROM m WHERE list_has_all(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), ['the', 'schedule'])""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages that hold all of some words."""
    words = T.tokens(F.col("text"))
    return base(spark, d, ["text"]).where(F.array_contains(words, "the") & F.array_contains(words, "schedule")).select("row_id")


@query(f"""WITH {_M}, r AS (SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty_text' WHEN message_type <> 'message' THEN 'system_message'
  WHEN NOT regexp_matches(text, '[а-яёА-ЯЁ]') THEN 'no_cyrillic_text' ELSE 'eligible' END AS reason FROM m) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason""")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why messages can or can't be annotated: the first reason that holds."""
    text = F.col("text")
    reason = (
        F.when(text.isNull() | (F.trim(text) == ""), "empty_text")
        .when(F.col("message_type") != "message", "system_message")
        .when(~text.rlike("[а-яёА-ЯЁ]"), "no_cyrillic_text")
        .otherwise("eligible")
    )
    return base(spark, d, ["text", "message_type"]).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EV}, c AS (SELECT target, count(*) AS n FROM ev GROUP BY target)
SELECT m.row_id, conversation_id, sender, epoch_us(sent_at) AS sent_us, coalesce(n, 0)::BIGINT AS n_replies FROM m LEFT JOIN c ON c.target = m.row_id ORDER BY sent_at DESC, m.row_id DESC LIMIT 500""")
def latest_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the latest messages with their numbers of replies: only the page meets the replies."""
    rows = base(spark, d, ["sender", "sent_at", "reply"])
    page = rows.orderBy(F.desc("sent_at"), F.desc("row_id")).limit(500)
    replies = R.reply_events(rows, ()).groupBy(F.col("target").alias("row_id")).agg(F.count(F.lit(1)).alias("n"))
    return page.join(replies, "row_id", "left").select("row_id", "conversation_id", "sender", F.unix_micros("sent_at").alias("sent_us"), F.coalesce("n", F.lit(0)).alias("n_replies"))


@query(f"""WITH {_M} SELECT row_id, ln(1 + coalesce(length(text), 0)) AS log_length, sin(2 * pi() * extract(hour FROM sent_at) / 24) AS hour_sin, cos(2 * pi() * extract(hour FROM sent_at) / 24) AS hour_cos,
  (coalesce(length(text), 0) // 4)::BIGINT AS token_estimate, strftime(sent_at, '%G-W%V') AS iso_week, extract(year FROM sent_at) || '-Q' || extract(quarter FROM sent_at) AS quarter FROM m WHERE sent_at IS NOT NULL""")
def message_shape(spark: SparkSession, d: str) -> DataFrame:
    """Length, time of day on a circle, a token estimate, the ISO week and the quarter of each message."""
    n = F.coalesce(F.length("text"), F.lit(0))
    angle = 2 * F.pi() * F.hour("sent_at") / 24
    return base(spark, d, ["text", "sent_at"]).where(F.col("sent_at").isNotNull()).select(
        "row_id", F.log1p(n).alias("log_length"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"), F.floor(n / 4).alias("token_estimate"),
        F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "sent_at"), F.weekofyear("sent_at")).alias("iso_week"),
        F.concat(F.year("sent_at").cast("string"), F.lit("-Q"), F.quarter("sent_at").cast("string")).alias("quarter"),
    )


@query(f"""WITH {_M}, n AS (SELECT external_id, display_name FROM participants WHERE display_name IS NOT NULL)
SELECT external_id, upper(substr(split_part(trim(display_name, ' '), ' ', 1), 1, 1)) || upper(substr(split_part(trim(display_name, ' '), ' ', 2), 1, 1)) AS initials FROM n WHERE trim(display_name, ' ') <> ''""")
def initials(spark: SparkSession, d: str) -> DataFrame:
    """First letters of the first two words of every name."""
    words = F.slice(F.filter(F.split(F.trim("display_name"), " "), lambda w: w != ""), 1, 2)
    rows = table(spark, d, "participants").where(F.trim("display_name") != "")
    return rows.select("external_id", F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "").alias("initials"))
